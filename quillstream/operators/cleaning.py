"""Cleaning by lines: one table of lines, predicates over each, and documents put together again."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstream.functions.columns import BLANKS, let, settled, stripped
from quillstream.functions.phrases import CONTACTS, SIGNS, signed
from quillstream.operators.tables import written
from quillstream.packs import CHART_TERMS, CHART_TITLES, DISPLAY_NOISE, FRAGMENT_TERMS, SECTION_FIELDS, SOURCE_CODES, SOURCE_MARKS, TABLE_WORDS, ZH, CleaningPack, any_of

MOST_CHARS = 500_000


#: A character that carries Chinese texts.
CJK = "[一-鿿]"


def spelled(letters: str) -> str:
    """A class of ranges (as in brackets) with the signs of one byte listed one by one: these are one table, while each range would be asked for every character."""
    out = ""
    for a, b in re.findall(r"(.)-(.)", letters):
        out += "".join(map(chr, range(ord(a), min(ord(b), 255) + 1))) + (f"{max(a, 'Ā')}-{b}" if ord(b) > 255 else "")
    return out


def bare(x: Column) -> Column:
    """Without any blank. Few texts hold other blanks than spaces and line ends, which are taken out without a pattern."""
    # listed like `spelled` ones
    narrow = r"\t\x0B\x0C\r\x1C\x1D\x1E\x1F"
    other = F.when(F.octet_length(x) == F.length(x), x.rlike(f"[{narrow}]")).otherwise(x.rlike(rf"[{narrow}\x{{85}}\x{{A0}}\x{{1680}}-\x{{3000}}]"))
    return F.when(other, F.regexp_replace(x, rf"[\n{BLANKS}]+", "")).otherwise(F.replace(F.replace(x, F.lit(" "), F.lit("")), F.lit("\n"), F.lit("")))


def count(x: Column, pattern: str) -> Column:
    return F.regexp_count(x, F.lit(pattern))


def has(x: Column, words, wide: Column | None = None) -> Column:
    """Whether a text holds one of some words. Plain searches: a pattern of many alternatives would try each at each place.

    Chinese words are searched only in texts that hold a Chinese character (`wide`, where that is known)."""
    chinese = [w for w in words if re.search(CJK, w)]
    found = [F.contains(x, F.lit(w)) for w in words if w not in chinese]
    if chinese:
        found.append((x.rlike(CJK) if wide is None else wide) & F.exists(F.array(*map(F.lit, chinese)), lambda w: F.contains(x, w)))
    return reduce(lambda a, y: a | y, found, F.lit(False))


def count_of(x: Column, letters: str) -> Column:
    """How many characters of a class (as in brackets) a text holds."""
    n = F.length(F.regexp_replace(x, f"[^{spelled(letters)}]+", ""))
    # ASCII texts hold none of a class without ASCII
    return n if any(c.isascii() for c in letters.replace("-", "")) else F.when(F.octet_length(x) == F.length(x), 0).otherwise(n)


def noise_line(line: Column, pack: CleaningPack = ZH) -> Column:
    """A line that is an address, a rule, a page number or the like, or holds a noise word. Blank lines are none."""
    x = stripped(line)
    chinese = [w.lower() for w in pack.noise_words if re.search(CJK, w)]
    latin = [w for w in pack.noise_words if not re.search(CJK, w)]
    # texts beyond ASCII are slow to lower: other words are a pattern, tried where one of their first letters stands
    firsts = "".join(sorted({c for w in latin for c in (w[0].lower(), w[0].upper(), *{"s": "ſ", "k": "\u212a"}.get(w[0].lower(), ""))}))
    named = lambda y: y.rlike(f"(?=[{re.escape(firsts)}])(?iu:{any_of(latin)})") if latin else F.lit(False)
    # patterns of whole lines share one anchor: with one in each alternative all of them would be tried at each place
    whole = [p[1:] for p in pack.noise_patterns if p.startswith("^") and "|" not in p]
    rest = [p for p in pack.noise_patterns if not p.startswith("^") or "|" in p]
    fits = lambda y: reduce(lambda a, p: a | y.rlike(p), ["^(?:" + "|".join(whole) + ")"] * bool(whole) + ["|".join(rest)] * bool(rest), F.lit(False))
    return let(x, lambda y: (y != "") & (fits(y) | named(y) | (y.rlike(CJK) & let(F.lower(y), lambda low: has(low, chinese, F.lit(True))))))


def paragraph_pattern(pack: CleaningPack) -> str:
    """A noise paragraph: from a mark to the end of its line, and the indented lines that follow."""
    return rf"(?i)(?:{'|'.join(pack.paragraphs)})[^\n]*(?:\n[{BLANKS}][^\n]*)*(?:\n\z)?"


def without_noise_paragraphs(text: Column, pack: CleaningPack = ZH) -> Column:
    return F.regexp_replace(text, paragraph_pattern(pack), "")


def without_noise_lines(text: Column, pack: CleaningPack = ZH) -> Column:
    """The lines of a text that are no noise, in an array."""
    return F.filter(F.split(text, "\n"), lambda x: ~noise_line(x, pack))


def template_parts(table: DataFrame) -> DataFrame:
    """Lines (doc_id, pos, line) of a templated text with their role (title, source, parser, heading, text) and section (body, tables, ocr, ai, other)."""
    by = Window.partitionBy("doc_id")
    x = stripped(F.col("line"))
    name = stripped(F.split_part(F.substring(x, F.lit(4), F.length(x)), F.lit(":"), F.lit(1)))
    field = F.coalesce(F.create_map(*[F.lit(v) for kv in SECTION_FIELDS.items() for v in kv])[name], F.lit("other"))
    titled = F.min(F.when(x.startswith("# "), F.col("pos"))).over(by)
    role = F.when(F.col("pos") == titled, "title").when(x.startswith("来源文件:"), "source").when(x.startswith("解析器:"), "parser").when(x.startswith("## "), "heading").otherwise("text")
    out = table.select("doc_id", "pos", x.alias("line"), role.alias("role"), F.when(x.startswith("## "), field).alias("begun"))
    section = F.last("begun", True).over(by.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    return out.withColumn("section", F.coalesce(section, F.lit("other"))).drop("begun")


#: What `featured` adds to a line beside x.
FEATURES = ("bare", "wide", "letters", "judged", "semantic", "core", "digits", "dates", "size", "signs", "numbers", "alpha")


def featured(table: DataFrame, pack: CleaningPack = ZH, known: bool = False) -> DataFrame:
    """Lines with what the predicates need: x (stripped), bare, letters, digits, dates, numbers, alpha, and whether Chinese (wide) and hints of each kind occur.

    Counts that no predicate asks for, since the line has meaning, are null. With `known` the table has all of this for another
    text of each line (`_x`, `_bare` and so on), which counts where the line is that text."""
    x, b, wide, semantic = F.col("x"), F.col("bare"), F.col("wide"), F.col("semantic")

    def added(rows: DataFrame, **features: Column) -> DataFrame:
        return rows.withColumns({k: F.when(F.col("_x") == x, F.col(f"_{k}")).otherwise(v) if known else v for k, v in features.items()})

    out = added(table.withColumn("x", stripped(F.col("line"))), bare=bare(x), wide=x.rlike(CJK))
    out = added(out, letters=count_of(x, pack.letters[1:-1]), judged=has(x, pack.judgement_hints, wide))
    core = has(x, pack.core_hints, wide) | ((F.col("letters") >= 12) & F.col("judged"))
    out = added(out, semantic=(F.col("letters") >= 7) | has(x, pack.hints, wide), core=core)
    # `strict_noise` asks for numbers of lines that are not judged, and for letters of those that are not core; all ask for these only where few others are
    alpha = F.when((F.col("letters") < 6) & (~semantic | ~F.col("core")), count_of(x, "A-Za-z"))
    out = added(out, numbers=F.when(~semantic | ~F.col("judged"), count(x, r"(?=[-+0123456789])[-+]?\d[\d,.]*")), alpha=alpha)
    numbered = lambda v: F.when(F.col("numbers") > 0, v).otherwise(0)
    counts = {
        "digits": numbered(count_of(x, "0-9")),
        "dates": numbered(count(x, r"(?=\d)\b\d{1,2}[-/.]\d{1,2}\b")),
        "size": F.length(F.replace(x, F.lit(" "), F.lit(""))),
        "signs": F.length(F.regexp_replace(b, f"[{spelled('A-Za-z0-9' + pack.letters[1:-1])}]+", "")),
    }
    return added(out, **{k: F.when(~semantic, v) for k, v in counts.items()}).drop(*(f"_{c}" for c in ("x", *FEATURES) if known))


def numeric_line(mode: str = "body") -> Column:
    """A featured line of numbers alone, or nearly so."""
    x, letters, numbers = F.col("x"), F.col("letters"), F.col("numbers")
    ratio = F.col("digits") / F.greatest(F.col("size"), F.lit(1))
    dense = (F.col("size") == 0) | (F.col("dates") >= 5) | ((ratio >= 0.35) & (numbers >= 2)) | x.rlike(r"^[\d\s,.\-+/%()]+\z")
    if mode == "ocr":
        dense = dense | ((ratio >= 0.25) & (letters <= 2) & (numbers >= 3))
    kept = x.startswith("|") & (letters > 0) if mode == "table" else F.lit(False)
    return ~F.col("semantic") & ~kept & (letters <= 6) & dense


def axis_line() -> Column:
    """A line of a chart's axis: dates, large numbers, or numbers as in recognised images."""
    x = F.col("x")
    return ~F.col("semantic") & ((F.col("dates") >= 3) | ((F.col("letters") <= 2) & (count(x, r"(?=\d)\b\d{4,5}\b") >= 4)) | numeric_line("ocr"))


def low_value_line(mode: str = "body", least: int = 8) -> Column:
    x, letters, size = F.col("x"), F.col("letters"), F.length("bare")
    marked = x.startswith("#") | x.startswith("|")
    low = (size < least) & (letters == 0)
    if mode in ("ocr", "body"):
        low = low | ((letters == 0) & (F.col("alpha") >= 3) & (size <= 24))
    if mode == "ocr":
        low = low | ((letters <= 1) & ((size == 0) | (F.col("signs") / size > 0.45)))
    return ~marked & ~F.col("semantic") & low


def disclaimer_start(b: Column, wide: Column, pack: CleaningPack = ZH) -> Column:
    """`wide`: whether the line holds Chinese at all."""
    phrases = (b.startswith("的观点") & b.contains("概不负责")) | (b.startswith("书面许可") & b.contains("复制")) | (b.startswith("经许可") & b.contains("损失赔偿")) | b.rlike("[一-鿿]{2,16}期货有限公司是经")
    return has(b, pack.starts, wide) | (wide & phrases)


#: The codes' first letters are looked for before the border of a word, which costs more.
_CODES = SOURCE_CODES.replace("(?i)", "(?i)(?=[WFBS])")


def strict_noise(pack: CleaningPack = ZH) -> Column:
    """A featured line of body or image text that is a disclaimer's rest, a footer, a data source, a chart's title, garbled letters, or a fragment of a page or table."""
    x, b, wide, letters, numbers, judged, core = (F.col(c) for c in ("x", "bare", "wide", "letters", "numbers", "judged", "core"))
    size = F.length(b)
    dated = F.when(numbers > 0, count(x, r"\d{4}[-/.]\d{1,2}[-/.]\d{1,2}")).otherwise(0)
    title = F.regexp_replace(x, r"[、，,。.\s]+", "")
    residual = has(b, pack.residual, wide) | (b.startswith("的观点") & b.contains("概不负责"))
    footer = wide & (b.isin("浙商期货有限公司", "请务必阅读正文之后的免责条款和声明") | b.rlike(r"^[一-鿿]{2,12}期货有限公司\z"))
    source = has(b, SOURCE_MARKS, wide) | (~judged & x.rlike(_CODES))
    chart = ~judged & ((wide & title.isin(*CHART_TITLES)) | ((dated > 0) & has(b, CHART_TERMS, wide)) | (dated >= 2))
    garbled = ~core & ((size == 0) | ((F.col("alpha") >= 8) & (F.col("alpha") / F.greatest(size, F.lit(1)) >= 0.45) & (letters < 6)) | ((F.col("alpha") >= 12) & (letters <= 2)))
    fragment = ~judged & wide & (
        (x.rlike(r"^(?:吨|元|手|面|方面|仓|单|量)[,，.。;；\s]") & (numbers >= 1))
        | (b.rlike("^(?:吨|元|手)") & (letters <= 8) & (numbers >= 1))
        | b.rlike(r"^(?:当日注册仓|注册仓|变化至|环比变化至)|环比变化至\d")
        | (b.rlike(r"(?:主力合约持仓量|总持仓|持仓量).*环比减少\d") & (letters <= 18))
        | ((numbers >= 3) & (letters <= 8) & has(b, FRAGMENT_TERMS, wide))
    )
    short = b.rlike(r"^[A-Za-z|、。.,:：;；()（）_\-+=/\\\d一-鿿]{1,8}\z") & ~has(b, pack.core_hints, wide)
    table = b.isin("[日报", "日报", "参与角色行为导向情形导向") | has(b, TABLE_WORDS, wide) | (~judged & (short | (x.rlike(r"^\d+\s+\d+、") & (numbers >= 4)) | ((numbers >= 4) & ~core)))
    return ~(x.startswith("#") | x.startswith("|")) & (residual | footer | source | chart | garbled | fragment | table)


def repaired(line: Column, pack: CleaningPack = ZH) -> Column:
    """A recognised line without blanks between its characters and signs before its first word, known misreadings put right."""
    out = F.regexp_replace(F.regexp_replace(line, r"\s{2,}", " "), rf"({pack.letters})\s+({pack.letters})", "$1$2")
    out = F.regexp_replace(out, rf"^[\[\]【】“”\"'汪\s]+((?:{pack.priority})[:：])", "$1")
    misread = (("年未", "年末"), ("装直", "装置"), ("上且", "且"), ("产员穿全年", "产能压力贯穿全年"))
    right = lambda y: reduce(lambda z, w: F.replace(z, F.lit(w[0]), F.lit(w[1])), misread, y)
    out = let(out, lambda y: F.when(F.octet_length(y) == F.length(y), y).otherwise(right(y)))
    return stripped(out)


def navigation_line(b: Column, pack: CleaningPack = ZH) -> Column:
    return b.isin(*pack.navigation) | b.rlike(r"^【?[一-鿿A-Za-z]{1,12}(?:日报|周报|月报|年报)\d{6,8}】?\z")


def table_lines(table: DataFrame, pack: CleaningPack = ZH) -> DataFrame:
    """doc_id, pos, line and reason (null: it stays) of lines of tables: separators stay, numbers and low values go."""
    x = F.col("x")
    separator = x.rlike(r"^\|?\s*:?-{3,}:?\s*(\|\s*:?-{3,}:?\s*)+\|?\z")
    reason = F.when((x == "") | separator, None).when(numeric_line("table"), "numeric").when(low_value_line("table"), "low_value")
    # callers filter by the reason: copied into their filter, each feature would be computed wherever the reason names it
    return settled(featured(table, pack).withColumnRenamed("line", "_raw"), line=x, reason=reason).select("doc_id", "pos", "line", "reason")


def semantic_lines(table: DataFrame, mode: str = "body", pack: CleaningPack = ZH) -> DataFrame:
    """doc_id, pos, line (repaired) and reason (null: it stays) of lines of body or image text.

    A disclaimer goes on while its lines look like one; a blank line ends it. Lines of axes go if several stand together."""
    by = Window.partitionBy("doc_id").orderBy("pos")
    x, b, wide = F.col("x"), F.col("bare"), F.col("wide")
    body = mode in ("body", "ocr")
    # all that a line alone decides comes before any window, which then sorts flags
    out = featured(table, pack).withColumn("start", disclaimer_start(b, wide, pack) if body else F.lit(False))
    other = F.when(x.startswith("[图片分片") & x.endswith("]"), "slice").when(navigation_line(b, pack), "navigation").when(numeric_line(mode), "numeric").when(low_value_line(mode), "low_value")
    like = F.col("start") | has(b, pack.more, wide) if body else F.lit(False)
    told = out.select("doc_id", "pos", repaired(x, pack).alias("line"), "start", like.alias("like"), (x == "").alias("blank"), other.alias("other"), *(F.col(c).alias(f"_{c}") for c in ("x", *FEATURES)))
    again = featured(told, pack, known=True)
    strict = strict_noise(pack) if body else F.lit(False)
    again = again.select("doc_id", "pos", "line", "start", "like", "blank", "other", strict.alias("strict"), (axis_line() & (x != "")).alias("axis"))
    # lines that may belong to one disclaimer, up to the next that cannot
    again = again.withColumn("block", F.sum(F.when(F.col("like"), 0).otherwise(1)).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    begun = F.max(F.col("start").cast("int")).over(Window.partitionBy("doc_id", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)) == 1
    again = again.withColumn("begun", begun)
    early = F.when(F.col("like") & F.col("begun"), "disclaimer").otherwise(F.col("other"))
    again = again.select("doc_id", "pos", "line", F.when(F.col("blank"), None).otherwise(F.coalesce(early, F.when(F.col("strict"), "strict"))).alias("reason"), "axis")
    # what is left, numbered, and its runs of axis lines
    left = F.col("reason").isNull()
    number = F.sum(F.when(left, 1).otherwise(0)).over(by.rowsBetween(Window.unboundedPreceding, 0))
    again = again.withColumn("n", number)
    run = F.sum(F.when(left & F.col("axis"), 0).otherwise(F.when(left, 1).otherwise(0))).over(by.rowsBetween(Window.unboundedPreceding, 0))
    again = again.withColumn("run", run)
    together = F.sum(F.when(left & F.col("axis"), 1).otherwise(0)).over(Window.partitionBy("doc_id", "run"))
    return again.select("doc_id", "pos", "line", F.when(left & F.col("axis") & (together >= 2), "axis_run").otherwise(F.col("reason")).alias("reason"))


def prioritised(table: DataFrame, pack: CleaningPack = ZH) -> DataFrame:
    """Lines (doc_id, pos, line) without repeats, observations first: doc_id, rank, line. Blank lines stay."""
    b = bare(F.col("line"))
    first = F.row_number().over(Window.partitionBy("doc_id", "bare").orderBy("pos"))
    once = table.withColumn("bare", b).withColumn("n", first).filter((F.col("bare") == "") | (F.col("n") == 1))
    front = F.col("bare").rlike(rf"^[\[\]【】“”\"'汪]*(?:{pack.priority})[:：]")
    return once.select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy(front.desc(), "pos")).alias("rank"), "line")


def compacted_lines(lines: Column) -> Column:
    """An array of lines as one text: blank ones go where few lines are full, else at most one stands between others."""
    full = F.filter(lines, lambda x: stripped(x) != "")
    few = F.size(full) < 0.7 * F.size(lines)
    return stripped(F.regexp_replace(F.array_join(F.when(few, full).otherwise(lines), "\n"), r"\n{3,}", "\n\n"))


def put_together(table: DataFrame, order: str = "pos", *by: str) -> DataFrame:
    """The lines of each document (and `by`) in order as text."""
    held = F.transform(F.sort_array(F.collect_list(F.struct(order, "line"))), lambda x: x["line"])
    return table.groupBy("doc_id", *by).agg(held.alias("_lines")).select("doc_id", *by, let(F.col("_lines"), compacted_lines).alias("text"))


def structured_text(parts: DataFrame, pack: CleaningPack = ZH) -> DataFrame:
    """doc_id, cleaned: templated documents (as `template_parts` gives them) with four cleaned sections under new headings."""
    # written once: four sections and the heads would each cut the texts anew
    parts = written(parts)
    lines = parts.filter("role = 'text'").withColumn("section", F.when(F.col("section") == "other", "body").otherwise(F.col("section")))
    cleaned = None
    for section, title, mode in (("body", "## 核心正文", "body"), ("tables", "## 表格与数据", "table"), ("ocr", "## 图文识别正文", "ocr"), ("ai", "## AI图表解读", "ai")):
        own = lines.filter(F.col("section") == section).select("doc_id", "pos", "line").filter(~noise_line(F.col("line"), pack))
        flagged = table_lines(own, pack) if mode == "table" else semantic_lines(own, mode, pack)
        left = flagged.filter("reason IS NULL").select("doc_id", "pos", "line")
        if mode == "ocr":
            left = prioritised(left, pack).withColumnRenamed("rank", "pos")
        text = put_together(left).filter("text <> ''").select("doc_id", F.lit(section).alias("section"), F.lit(title).alias("title"), "text")
        cleaned = text if cleaned is None else cleaned.unionByName(text)
    named = lambda role: F.max(F.when(F.col("role") == role, F.col("line")))
    heads = parts.groupBy("doc_id").agg(named("title").alias("t"), named("source").alias("s"), named("parser").alias("p"))
    of = lambda s: F.max(F.when(F.col("section") == s, F.concat(F.col("title"), F.lit("\n\n"), F.when(F.col("section") == "tables", F.when(F.col("text").startswith("### 表格"), "").otherwise("### 表格: 价格/库存/基差数据\n")).otherwise(""), F.col("text"))))
    bodies = cleaned.groupBy("doc_id").agg(*[of(s).alias(s) for s in ("body", "tables", "ocr", "ai")])
    title = stripped(F.regexp_replace("t", "^#+", ""))
    shown = F.when((title != "") & ~title.isin("解析文档", "浙商期货官网") & ~title.contains("官网"), F.concat(F.lit("# "), title))
    source = stripped(F.substring("s", F.lit(6), F.length("s")))
    info = F.concat_ws("\n", F.when(source != "", F.concat(F.lit("来源文件: "), F.regexp_extract(source, r"([^/\\]*)\z", 1))), F.when(F.length("p") > 4, F.concat(F.lit("解析器: "), stripped(F.substring("p", F.lit(5), F.length("p"))))))
    joined = heads.join(bodies, "doc_id", "left")
    return joined.select("doc_id", F.concat_ws("\n\n", shown, F.when(info != "", F.concat(F.lit("## 文档信息\n\n"), info)), "body", "tables", "ocr", "ai").alias("cleaned"))


def clean_outcome(raw: Column, cleaned: Column, analyzable: Column, most: int = MOST_CHARS) -> list[Column]:
    """ratio, warning, failure (null: none) and text (capped) of a cleaned document."""
    ratio = F.coalesce(F.round(1 - F.try_divide(F.length(cleaned), F.length(raw)), 6), F.lit(0.0))
    failure = F.when(stripped(raw) == "", "raw_text 为空").when(stripped(cleaned) == "", "清洗后文本为空").when(~analyzable, "清洗后未发现可分析正文，可能仅包含目录、导航或文档信息")
    capped = F.when(F.length(cleaned) > most, F.concat(F.left(cleaned, F.lit(most)), F.lit("\n\n[文本过长，已截断，原长度: "), F.length(cleaned).cast("string"), F.lit(" 字符]"))).otherwise(cleaned)
    return [ratio.alias("ratio"), F.when(ratio > 0.95, "high").when(ratio < 0.05, "low").otherwise("none").alias("warning"), failure.alias("failure"), F.when(failure.isNull(), capped).alias("text")]


# What goes from within a line that is shown, and labels that may be left alone on one.
INLINE_NOISE = (*CONTACTS, r"请务必(?:仔细)?阅读正文后免责(?:申明|声明|条款)?", r"all rights reserved")
ORPHANS = r"^(?:基本|联系电话|咨询电话|客服电话|客服热线|电话|传真|邮箱)[ \t]*[:：]?[ \t]*$"
ENDS = r" \t:：,，;；"


#: The same within lines: blanks of any kind, but none of them ends a line.
_IN_LINE = tuple((sign, x.replace(r"[-\s]", f"[-{BLANKS}]").replace(r"\s", f"[{BLANKS}]")) for sign, x in zip((*SIGNS, "请务必", "[aA][lL]{2} "), INLINE_NOISE, strict=True))


def _where(text: Column, sign: str, pattern: str, to: str = "") -> Column:
    """A pattern's matches replaced in texts that hold its sign; the others are not searched."""
    return let(text, lambda t: F.when(signed(t, sign), F.regexp_replace(t, pattern, to)).otherwise(t))


def _single_spaced(text: Column) -> Column:
    """Blanks and tabs collapsed. Few texts hold a tab or two blanks together; the others stay as they are."""
    return let(text, lambda t: F.when(signed(t, "\t|  "), F.regexp_replace(t, r"[ \t]+", " ")).otherwise(t))


def _each_line(text: Column, change) -> Column:
    return F.array_join(F.transform(F.split(text, "\n"), change), "\n")


def shown_lines(text: Column) -> Column:
    """A text whose lines are as users see them: without contacts and page marks, compacted, and blank if nothing but a label is left. Each pattern reads the text once, and none goes beyond a line."""
    # ends of lines without a pattern, which would ask at each place whether blanks up to an end begin there
    out = _each_line(text, stripped)
    for sign, pattern in _IN_LINE:
        out = _where(out, sign, "(?i)" + pattern, " ")
    out = _where(out, "/", rf"\b\d+[{BLANKS}]*/[{BLANKS}]*\d+\b", " ")
    out = _single_spaced(out)
    # signs: one of the marks, or another character between the first and last of them
    out = _where(out, "[)\u3001-\uff1f]", rf"(?<![{BLANKS}])[{BLANKS}]+([，。；：！？、】）)])", "$1")
    out = _where(out, "[(\u3010-\uff08]", rf"([【（(])[{BLANKS}]+", "$1")
    label = lambda x: F.when(x.rlike(f"{ORPHANS[:-1]}\\z"), "").otherwise(stripped(x))
    return _each_line(out, lambda x: let(F.btrim(x, F.lit(ENDS.replace(r"\t", "\t"))), label))


def displayed(text: Column, most: int | None = None, words=DISPLAY_NOISE) -> Column:
    """A text as users see it: fences, page heads and source lines go, lines are cleaned, noise and adjacent repeats go; a cap ends in a full stop."""
    out = _where(text, "\r", r"\r\n?", "\n")
    for sign, pattern, to in (("```", r"```(?:\w+)?\s*([\s\S]*?)\s*```", "$1"), ("##", r"(?im)^#{2,}\s*Page\s+\d+\s*$", ""), ("文档信息", r"(?m)^#+\s*文档信息\s*$", ""), ("来源文件|解析器", r"(?m)^(?:来源文件|解析器)\s*[:：].*$", "")):
        out = _where(out, sign, pattern, to)
    # each line with its bare form, by which noise and repeats are told
    lines = F.transform(F.split(shown_lines(out), "\n"), lambda x: F.struct(x.alias("x"), bare(x).alias("b")))
    marks = r"^(?:第?\d+页?|[\d/\-.]+|[一-鿿]{2,16}(?:期货)?(?:有限责任)?公司(?:研究所)?)\z"
    kept = F.filter(lines, lambda y: (y["b"] != "") & ~has(y["b"], words) & ~y["b"].rlike(marks))

    def single(own: Column) -> Column:
        # lines unlike the one before
        last = F.filter(own, lambda y, i: (i == 0) | (F.get(own, i - F.lit(1))["b"] != y["b"]))
        return stripped(let(F.array_join(F.transform(last, lambda y: y["x"]), "\n"), lambda t: _where(t, "\t|  ", r"[ \t]{2,}", " ")))

    joined = let(kept, lambda own: F.when(F.size(own) > 0, single(own)).otherwise(""))
    return capped(joined, most) if most else joined


def capped(text: Column, most: int) -> Column:
    """A shown text up to a cap, where it ends in a full stop."""
    return let(text, lambda t: F.when(F.length(t) > most, F.concat(F.regexp_replace(F.left(t, F.lit(most)), r"[，,；;、 ]+\z", ""), F.lit("。"))).otherwise(t))


def document_text(title: Column, source: Column, parser: Column, body: Column, tables: Column, images: Column, readings: Column, most: int = MOST_CHARS) -> Column:
    """The template of a parsed document: title, source and parser lines, then a section for whatever is not blank. `images` and `readings` are arrays of (name, text)."""
    shown = F.coalesce(F.nullif(stripped(title), F.lit("")), F.nullif(F.regexp_extract(source, r"([^/]*)\z", 1), F.lit("")), F.lit("解析文档"))
    named = lambda head: lambda x: F.concat(F.lit(head), x["name"], F.lit("\n\n"), stripped(x["text"]))
    full = lambda x: stripped(x["text"]) != ""
    parts = [
        F.concat(F.lit("# "), shown), F.concat(F.lit("来源文件: "), source), F.concat(F.lit("解析器: "), parser),
        F.when(stripped(body) != "", F.concat(F.lit("## 正文文本\n\n"), stripped(body))), F.when(stripped(tables) != "", F.concat(F.lit("## 表格数据\n\n"), stripped(tables))),
    ]
    text = F.concat_ws("\n\n", *parts, F.transform(F.filter(images, full), named("## 图片OCR文本: ")), F.transform(F.filter(readings, full), named("## AI图表解读: ")))
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit("\n\n[文本过长，已截断，原长度: "), F.length(text).cast("string"), F.lit(" 字符]"))).otherwise(text)
