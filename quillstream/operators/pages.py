"""Web pages: their main content by score, their title, and their tables.

A page is read once into flat lists of nodes and texts in the order of the page; what a node holds is a range of
them, so counts of letters, links, tables and pictures in any subtree are differences of running sums. Nothing recurses, and
time grows with the page however deep it is. Tags that the page leaves open end where HTML ends them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# What goes from a page, by tag, by parts of class, id, role and style, and by class alone; what protects a node from going by its class or id.
GONE_TAGS = ("script", "style", "noscript", "iframe", "nav", "footer", "header", "aside", "form", "input", "button", "select")
GONE_NAMES = ("ad", "banner", "nav", "menu", "footer", "sidebar", "widget", "comment", "share", "social", "popup", "cookie", "disclaimer")
GONE_ROLES = ("navigation", "banner", "contentinfo")
GONE_STYLES = ("display: none", "display:none")
GONE_BARS = re.compile("(?i)yb_|float|fixed|toolbar|service|客服|erwei|qrcode|cb-box|weixin|cont-in-box|f-ser-box")
KEPT_IDS = ("content", "main", "article", "post", "entry", "body")
KEPT_CLASSES = (*KEPT_IDS, "text")
# Which nodes can be the main content, and what their score is made of.
CONTAINERS = ("article", "main", "section", "div")
PARAGRAPHS = ("p", "h1", "h2", "h3", "h4")
GOOD_NAMES = re.compile("content|conten|article|post|entry|body|text|detail|main|con_p|t-con")
RIGHT = re.compile(r"\bright\b")
NAVIGATION = ("首页", "上一篇", "下一篇", "相关信息", "客服", "下载APP", "收藏本页面", "打印", "返回顶部", "导航")
PER_PARAGRAPH, PER_TABLE, PER_IMAGE, PER_LONE_IMAGE, NAMED, ON_THE_RIGHT, PER_LINK, PER_NAVIGATION, HIDDEN, LEAST = 35, 120, 900, 20, 180, 80, 1.2, 70, 10_000, 50
# From these to the end of its line a text is a disclaimer.
DISCLAIMERS = ("免责声明", "免责申明", "风险提示", "版权所有", "投资有风险", "市场有风险", "本报告仅供参考", "扫码关注", "All Rights Reserved")
BARRED, NOT_ALLOWED = "未经许可", "不得"

#: A cell spans at most so many columns, as in browsers.
MOST_SPAN = 1000

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCKS = frozenset("address article aside blockquote center details dialog dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main menu nav ol p pre section summary table ul".split())
#: Which open node a tag ends, by the last one open of its family; other members of a family hide those outside.
_FAMILIES = {"p": frozenset(("p", "table", "td", "th", "caption", "button")), "list": frozenset(("ul", "ol", "li", "dl", "dt", "dd", "table")), "grid": frozenset(("table", "thead", "tbody", "tfoot", "tr", "td", "th"))}
_OPEN_TAG = re.compile("<[A-Za-z/!?]")
_ROWS, _CELLS = ("thead", "tbody", "tfoot"), ("td", "th")
_ENDS = {"li": ("list", ("li",)), "dt": ("list", ("dt", "dd")), "dd": ("list", ("dt", "dd")), "td": ("grid", _CELLS), "th": ("grid", _CELLS), "tr": ("grid", (*_CELLS, "tr")), **dict.fromkeys(_ROWS, ("grid", (*_CELLS, "tr", *_ROWS)))}


class Page(HTMLParser):
    """Nodes (tag, attributes, parent) and texts (text, node) in order; a node's are those from its beginning to its end."""

    def __init__(self, html: str) -> None:
        super().__init__(convert_charrefs=True)
        self.tags, self.attrs, self.parents = [""], [{}], [0]
        self.ends, self.text_begins, self.text_ends = [0], [0], [0]
        self.texts: list[str] = []
        self.owners: list[int] = []
        self._open = [0]
        self._by_tag: dict[str, list[int]] = {}
        self._last: dict[str, list[int]] = {f: [] for f in _FAMILIES}
        # a tag that begins after the last end of one never ends: what stands there is no text, and the parser would try it again and again
        whole = html.rfind(">") + 1
        rest = html[whole:]
        open_tag = _OPEN_TAG.search(rest)
        self.feed(html[:whole] + (rest[: open_tag.start()] if open_tag else rest))
        self.close()
        self._close(0)

    def _close(self, place: int) -> None:
        """Ends all that is open from a place on."""
        while len(self._open) > place:
            node = self._open.pop()
            self.ends[node], self.text_ends[node] = len(self.tags), len(self.texts)
            if node:
                self._by_tag[self.tags[node]].pop()
            for places in self._last.values():
                if places and places[-1] == len(self._open):
                    places.pop()

    def _close_last(self, family: str, tags: tuple[str, ...]) -> None:
        places = self._last[family]
        while places and self.tags[self._open[places[-1]]] in tags:
            self._close(places[-1])

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in _BLOCKS:
            self._close_last("p", ("p",))
        if tag in _ENDS:
            self._close_last(*_ENDS[tag])
        node = len(self.tags)
        self.tags.append(tag)
        self.attrs.append({k: v or "" for k, v in attrs})
        self.parents.append(self._open[-1])
        self.ends.append(node + 1)
        self.text_begins.append(len(self.texts))
        self.text_ends.append(len(self.texts))
        if tag not in VOID:
            self._by_tag.setdefault(tag, []).append(len(self._open))
            for family, members in _FAMILIES.items():
                if tag in members:
                    self._last[family].append(len(self._open))
            self._open.append(node)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if self._by_tag.get(tag):
            self._close(self._by_tag[tag][-1])

    def handle_data(self, data: str) -> None:
        if text := data.strip():
            self.texts.append(text)
            self.owners.append(self._open[-1])

    def gone(self) -> list[bool]:
        """Which nodes are no part of the text: by themselves, or because one round them is."""
        out = [False] * len(self.tags)
        for i in range(1, len(self.tags)):
            out[i] = out[self.parents[i]] or self.tags[i] in GONE_TAGS or (bool(self.attrs[i]) and _goes(self.attrs[i]))
        return out

    def nearest(self, tags: tuple[str, ...], stop: tuple[str, ...] = ()) -> list[int]:
        """For each node the nearest of these tags that it is or lies in (0: none), not beyond one of `stop`."""
        out = [0] * len(self.tags)
        for i in range(1, len(self.tags)):
            out[i] = i if self.tags[i] in tags else 0 if self.tags[i] in stop else out[self.parents[i]]
        return out


def _goes(attrs: dict[str, str]) -> bool:
    name, own = " ".join(attrs.get("class", "").split()), attrs.get("id", "")
    found = any(x in name or x in own for x in GONE_NAMES) or attrs.get("role") in GONE_ROLES or any(x in attrs.get("style", "") for x in GONE_STYLES) or bool(GONE_BARS.search(name))
    return found and not any(x in own.lower() for x in KEPT_IDS) and not any(x in name.lower() for x in KEPT_CLASSES)


def _sums(values) -> list:
    return [0, *accumulate(values)]


class Content:
    """A page without what goes from it, and its best container."""

    def __init__(self, html: str, letters: re.Pattern) -> None:
        self.page = page = Page(html)
        gone = page.gone()
        self.live = [not gone[o] for o in page.owners]
        nodes, kept = range(len(page.tags)), [not g for g in gone]
        self.kept = kept
        shown = [t if live else "" for t, live in zip(page.texts, self.live, strict=True)]
        self.lengths = _sums(map(len, shown))
        self.letters = _sums(len(letters.findall(t)) for t in shown)
        self.signs = _sums(len("".join(t.split())) for t in shown)
        self.navigation = _sums(sum(t.count(m) for m in NAVIGATION) for t in shown)
        count = lambda tags: _sums(kept[i] and page.tags[i] in tags for i in nodes)
        self.paragraphs, self.tables, self.images = count(PARAGRAPHS), count(("table",)), count(("img",))
        self.links = _sums(self.lengths[page.text_ends[i]] - self.lengths[page.text_begins[i]] if kept[i] and page.tags[i] == "a" else 0 for i in nodes)
        self.body = next((i for i in nodes if kept[i] and page.tags[i] == "body"), 0)
        self.best, self.score = self.body, 0.0
        order = {t: k for k, t in enumerate(CONTAINERS)}
        scored = [(order[page.tags[i]], i) for i in range(self.body, page.ends[self.body]) if kept[i] and page.tags[i] in order and i != self.body]
        value = -1.0
        for _, i in sorted(scored):
            if (own := self.score_of(i)) > value:
                value, best = own, i
        if value >= LEAST:
            self.best, self.score = best, value

    def score_of(self, i: int) -> float:
        page = self.page
        text = lambda sums: sums[page.text_ends[i]] - sums[page.text_begins[i]]
        inner = lambda sums: sums[page.ends[i]] - sums[i + 1]
        letters, signs, tables, images = text(self.letters), text(self.signs), inner(self.tables), inner(self.images)
        if not signs and not images and not tables:
            return -1.0
        attrs = page.attrs[i]
        name = f"{attrs.get('id', '')} {' '.join(attrs.get('class', '').split())}".lower()
        named = NAMED if GOOD_NAMES.search(name) else ON_THE_RIGHT if RIGHT.search(name) and letters >= ON_THE_RIGHT else 0
        pictures = images * (PER_LONE_IMAGE if images and not tables and letters < 10 else PER_IMAGE)
        hidden = HIDDEN if "display: none" in attrs.get("style", "").lower() else 0
        dense = inner(self.links) / max(signs, 1)
        return letters + inner(self.paragraphs) * PER_PARAGRAPH + tables * PER_TABLE + pictures + named - dense * letters * PER_LINK - text(self.navigation) * PER_NAVIGATION - hidden

    def title(self) -> str:
        """The first heading of the content, else of the page, else the page's title."""
        page, heads = self.page, ("h1", "h2")

        def first(nodes: range, tags: tuple[str, ...]) -> str:
            i = next((i for i in nodes if self.kept[i] and page.tags[i] in tags), 0)
            inside = range(page.text_begins[i], page.text_ends[i]) if i else ()
            return " ".join(" ".join(page.texts[k] for k in inside if self.live[k]).split())

        every = range(len(page.tags))
        return first(range(self.best + 1, page.ends[self.best]), heads) or first(every, heads) or first(every, ("title",))

    def text(self) -> str:
        """The text without tables, pictures' descriptions after it, and no disclaimers."""
        page = self.page
        tables = page.nearest(("table",))  # one round the content comes before it and does not count
        inside = range(page.text_begins[self.best], page.text_ends[self.best])
        lines = [page.texts[k] for k in inside if self.live[k] and tables[page.owners[k]] <= self.best]
        lines += [f"[图片说明: {alt}]" for i in range(self.best, page.ends[self.best]) if self.kept[i] and page.tags[i] == "img" and tables[i] <= self.best and (alt := page.attrs[i].get("alt", "").strip())]
        return without_disclaimers(re.sub(r"[ \t]{2,}", " ", re.sub(r"\n{3,}", "\n\n", "\n".join(lines))))


def without_disclaimers(text: str) -> str:
    """Lines end where a disclaimer begins."""
    out = []
    for line in text.split("\n"):
        low = line.lower()
        cuts = [at for mark in DISCLAIMERS if (at := low.find(mark.lower())) >= 0]
        barred = line.find(BARRED)
        if barred >= 0 and line.find(NOT_ALLOWED, barred) >= 0:
            cuts.append(barred)
        out.append(line[: min(cuts)] if cuts else line)
    return re.sub(r"(?im)Copyright\s.*?$", "", "\n".join(out)).strip()


def main_content(html: str, letters: re.Pattern) -> tuple[str, str, float]:
    """Title, text and score of the part of a page that scores best; of the whole page, with score 0, if none is good enough."""
    content = Content(html or "", letters)
    return content.title(), content.text(), round(content.score, 4)


def page_content(pages: DataFrame, letters: str = "[一-鿿]", key: str = "page_id", html: str = "html") -> DataFrame:
    """key, title, content and score of each page's main part; a null page has none."""
    schema = f"{key} {pages.schema[key].dataType.simpleString()}, title string, content string, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern = re.compile(letters)
        for batch in batches:
            rows = [main_content(x, pattern) for x in batch.column(html).to_pylist()]
            columns = list(zip(*rows, strict=True)) if rows else [(), (), ()]
            yield pa.RecordBatch.from_arrays([batch.column(key), *(pa.array(list(c), t) for c, t in zip(columns, (pa.string(), pa.string(), pa.float64()), strict=True))], names=[key, "title", "content", "score"])

    return pages.select(key, html).mapInArrow(run, schema)


def grids(html: str) -> list[list[list[str]]]:
    """The outermost tables of a page as rows of cells, filled up to equal width. Rows of a table within a cell follow as rows of the outer one; each text is in its nearest cell alone."""
    page = Page(html)
    row_of, cell_of = page.nearest(("tr",)), page.nearest(_CELLS, ("tr", "table"))
    outer = [0] * len(page.tags)
    for i in range(1, len(page.tags)):
        outer[i] = outer[page.parents[i]] or (i if page.tags[i] == "table" else 0)
    texts: dict[int, list[str]] = {}
    for text, owner in zip(page.texts, page.owners, strict=True):
        if cell_of[owner]:
            texts.setdefault(cell_of[owner], []).append(text)
    tables: dict[int, dict[int, list[str]]] = {i: {} for i in range(1, len(page.tags)) if outer[i] == i}
    for i, tag in enumerate(page.tags):
        if tag == "tr" and outer[i]:
            tables[outer[i]].setdefault(i, [])
        elif tag in _CELLS and outer[i] and row_of[i]:
            span = page.attrs[i].get("colspan", "1").strip()
            tables[outer[i]].setdefault(row_of[i], []).extend([" ".join(" ".join(texts.get(i, ())).split()), *[""] * (min(int(span), MOST_SPAN) - 1 if span.isdecimal() and len(span) < 9 else 0)])
    out = []
    for rows in tables.values():
        width = max(map(len, rows.values()), default=0)
        out.append([cells + [""] * (width - len(cells)) for cells in rows.values()] if width else [])
    return out


def table_rows(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """key, table, rows (arrays of cells) of the tables of pages; a cell that spans columns is followed by empty ones, short rows are filled up."""
    schema = f"{key} {pages.schema[key].dataType.simpleString()}, table int, rows array<array<string>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, numbers, tables = [], [], []
            for k, text in zip(batch.column(key).to_pylist(), batch.column(html).to_pylist(), strict=True):
                for i, lines in enumerate(grids(text or "")):
                    if lines:
                        keys.append(k)
                        numbers.append(i)
                        tables.append(lines)
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.column(key).type), pa.array(numbers, pa.int32()), pa.array(tables, pa.list_(pa.list_(pa.string())))], names=[key, "table", "rows"])

    return pages.select(key, html).mapInArrow(run, schema)


def rendered(tables: DataFrame, described: bool = False, headless: bool = False) -> DataFrame:
    """tables (rows, and with `headless` a row `head` that may be null) with markdown, the first row or `head` being its head, and plain, a line for each row."""
    line = lambda row: F.concat(F.lit("| "), F.array_join(F.transform(row, lambda c: F.when(c == "", " ").otherwise(c)), " | "), F.lit(" |"))
    first, later = F.get("rows", F.lit(0)), F.slice("rows", F.lit(2), F.greatest(F.size("rows") - 1, F.lit(0)))
    head, rest = (F.coalesce("head", first), F.when(F.col("head").isNull(), later).otherwise(F.col("rows"))) if headless else (first, later)
    rule = F.concat(F.lit("| "), F.array_join(F.transform(head, lambda c: F.lit("---")), " | "), F.lit(" |"))
    body = F.array_join(F.concat(F.array(line(head), rule), F.transform(rest, line)), "\n")
    if described:
        body = F.concat(F.lit("\n下表包含 "), F.size("rows"), F.lit(" 行 "), F.size(head), F.lit(" 列的表格数据：\n\n"), body, F.lit("\n\n（上表共 "), F.size(rest), F.lit(" 行数据）\n"))
    plain = F.transform("rows", lambda r, i: F.concat(F.when(i == 0, "表头: ").otherwise(F.concat(F.lit("第"), i, F.lit("行: "))), F.array_join(r, " | ")))
    return tables.withColumns({"markdown": body, "plain": F.array_join(plain, "\n")})
