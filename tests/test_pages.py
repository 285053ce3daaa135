"""Pages: the score against its formula on a plain tree, deep and broken pages, and what goes from them."""

import random
import re
import time

import pytest

from quillstream.operators import pages as pg

LETTERS = re.compile("[一-鿿]")


class Node:
    def __init__(self, tag, attrs=(), parts=()):
        self.tag, self.attrs, self.parts = tag, dict(attrs), list(parts)

    def html(self):
        own = "".join(f' {k}="{v}"' for k, v in self.attrs.items())
        if self.tag in pg.VOID:
            return f"<{self.tag}{own}>"
        return f"<{self.tag}{own}>" + "".join(p if isinstance(p, str) else p.html() for p in self.parts) + f"</{self.tag}>"

    def below(self):
        for p in self.parts:
            if isinstance(p, Node):
                yield p
                yield from p.below()

    def texts(self):
        for p in self.parts:
            if isinstance(p, str):
                if p.strip():
                    yield p.strip()
            else:
                yield from p.texts()

    def cleaned(self):
        """Without what goes."""
        parts = [p if isinstance(p, str) else p.cleaned() for p in self.parts if isinstance(p, str) or not goes(p)]
        return Node(self.tag, self.attrs, parts)


def goes(node):
    name, own, style = node.attrs.get("class", ""), node.attrs.get("id", ""), node.attrs.get("style", "")
    if node.tag in ("script", "style", "noscript", "iframe", "nav", "footer", "header", "aside", "form", "input", "button", "select"):
        return True
    words = ("ad", "banner", "nav", "menu", "footer", "sidebar", "widget", "comment", "share", "social", "popup", "cookie", "disclaimer")
    found = any(w in name or w in own for w in words) or node.attrs.get("role") in ("navigation", "banner", "contentinfo") or "display: none" in style or "display:none" in style
    found = found or re.search("yb_|float|fixed|toolbar|service|客服|erwei|qrcode|cb-box|weixin|cont-in-box|f-ser-box", name, re.I)
    kept = any(w in own.lower() for w in ("content", "main", "article", "post", "entry", "body")) or any(w in name.lower() for w in ("content", "main", "article", "post", "entry", "body", "text"))
    return bool(found) and not kept


def score(node):
    text = "\n".join(node.texts())
    compact = re.sub(r"\s+", "", text)
    inner = list(node.below())
    n = lambda *tags: sum(x.tag in tags for x in inner)
    if not compact and not n("img", "table"):
        return -1.0
    cjk = len(LETTERS.findall(compact))
    links = sum(len("".join(a.texts())) for a in inner if a.tag == "a")
    name = f"{node.attrs.get('id', '')} {node.attrs.get('class', '')}".lower()
    bonus = 180 if re.search("content|conten|article|post|entry|body|text|detail|main|con_p|t-con", name) else 80 if re.search(r"\bright\b", name) and cjk >= 80 else 0
    images = n("img") * 20 if n("img") and not n("table") and cjk < 10 else n("img") * 900
    navigation = sum(text.count(w) for w in ("首页", "上一篇", "下一篇", "相关信息", "客服", "下载APP", "收藏本页面", "打印", "返回顶部", "导航"))
    return cjk + 35 * n("p", "h1", "h2", "h3", "h4") + 120 * n("table") + images + bonus - links / max(len(compact), 1) * cjk * 1.2 - 70 * navigation - (10_000 if "display: none" in node.attrs.get("style", "").lower() else 0)


def merged(parts):
    """Neighbouring texts are one."""
    out = []
    for p in parts:
        if isinstance(p, str) and out and isinstance(out[-1], str):
            out[-1] += p
        else:
            out.append(p)
    return out


def grown(rng, depth):
    """A random well-formed subtree: blocks hold blocks, paragraphs hold text."""
    words = ["铜价上涨", "库存", "首页", "下一篇", "abc ", " ", "　", "导航", "库存下降，需求改善。" * 6, "\n"]
    names = ["", "content", "ad-box", "right", "nav", "text", "main-ad", "sidebar", "x", "Float", "share detail", "t-con"]
    kind = rng.choice(["div", "section", "article", "main", "p", "h1", "h3", "a", "span", "img", "table", "nav", "div", "div"])
    attrs = {k: v for k, v in (("class", rng.choice(names)), ("id", rng.choice(["", "", "main", "cookie"])), ("style", rng.choice(["", "", "", "display: none", "Display: None; x"])), ("alt", rng.choice(["", "图"]))) if v}
    if kind == "img":
        return Node(kind, attrs)
    if kind == "table":
        return Node("table", attrs, [Node("tr", {}, [Node("td", {}, [rng.choice(words)]) for _ in range(rng.randint(1, 3))]) for _ in range(rng.randint(0, 3))])
    if depth == 0 or kind in ("p", "h1", "h3", "a", "span"):
        return Node(kind, attrs, merged(rng.choice(words) for _ in range(rng.randint(0, 3))))
    return Node(kind, attrs, merged(grown(rng, depth - 1) if rng.random() < 0.7 else rng.choice(words) for _ in range(rng.randint(0, 5))))


def test_scores_are_the_formula():
    rng = random.Random(2)
    chosen = 0
    for _ in range(1500):
        body = Node("body", {}, [grown(rng, 4) for _ in range(rng.randint(1, 4))])
        clean = body.cleaned()
        order = ("article", "main", "section", "div")
        found = [(score(n), n) for tag in order for n in clean.below() if n.tag == tag]
        value, best = 0.0, clean
        if found and max(s for s, _ in found) >= 50:
            value = max(s for s, _ in found)
            best = next(n for s, n in found if s == value)
            chosen += 1
        title, content, own = pg.main_content(f"<html>{body.html()}</html>", LETTERS)
        assert own == pytest.approx(value, abs=1e-3), body.html()

        def lines(node):
            for p in node.parts:
                if isinstance(p, str):
                    if p.strip():
                        yield p.strip()
                elif p.tag != "table":
                    yield from lines(p)

        def alts(node):
            for p in node.parts:
                if isinstance(p, Node) and p.tag != "table":
                    if p.tag == "img" and p.attrs.get("alt"):
                        yield f"[图片说明: {p.attrs['alt']}]"
                    yield from alts(p)

        assert content == re.sub(r"[ \t]{2,}", " ", re.sub(r"\n{3,}", "\n\n", "\n".join([*lines(best), *alts(best)]))).strip()
        heads = [n for n in best.below() if n.tag == "h1"][:1] + [n for n in clean.below() if n.tag == "h1"][:1]
        assert title == next((t for n in heads if (t := " ".join(" ".join(n.texts()).split()))), "")
    assert chosen > 300


@pytest.mark.parametrize("piece", ["<div>", "<p>价", "<li>价", "<table><tr><td>", "<td>", "<b><p>", "</div>", "<ul><li>", "<div class=content>价", "<", "<a href=", "<tr>", "&lt;"])
def test_deep_and_broken_pages(piece):
    took = []
    for n in (20_000, 100_000):
        began = time.time()
        title, content, _ = pg.main_content(piece * n, LETTERS)
        pg.grids(piece * n)
        took.append(time.time() - began)
    assert took[1] < 15 * max(took[0], 0.1) and (content.count("价") == (100_000 if "价" in piece else 0))


def test_open_tags_end_where_html_ends_them():
    page = pg.Page("<ul><li>a<li>b<ul><li>c</ul><li>d</ul><p>e<div>f</div><table><tr><td>g<td>h<tr><td>i</table>j")
    kinds = {t: page.tags[page.parents[o]] for t, o in zip(page.texts, page.owners, strict=True)}
    assert {page.tags[o] for t, o in zip(page.texts, page.owners, strict=True) if t in "abcd"} == {"li"} and kinds["c"] == kinds["d"] == "ul"
    assert page.tags[page.owners[page.texts.index("j")]] == "" and page.tags[page.owners[page.texts.index("f")]] == "div" and page.tags[page.parents[page.owners[page.texts.index("f")]]] == ""
    assert pg.grids("<table><tr><th colspan=2>a<tr><td>b<td>c<tr><td>d<table><tr><td>e</table></table><table></table>") == [[["a", ""], ["b", "c"], ["d", ""], ["e", ""]], []]


def test_disclaimers_and_titles():
    html = "<title> 站 </title><body><div id=content><p>铜价上涨</p><p>观点 免责声明：略</p><p>未经许可，不得转载</p><p>未经许可</p><p>Copyright 2024 x</p></div></body>"
    assert pg.main_content(html, LETTERS)[:2] == ("站", "铜价上涨\n观点 \n\n未经许可")
    began = time.time()
    pg.without_disclaimers("未经许可" * 100_000)
    assert time.time() - began < 1
