"""Queries of the cleaning operators over the documents' lines, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstream import packs
from quillstream.functions.columns import settled
from quillstream.operators import cleaning as cl
from quillstream.operators import text
from quillstream.packs import DRIVER, any_of
from quillstream.sources import bindings as b

_QUERIES: dict = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return add


def _docs(s, d) -> DataFrame:
    return b.table(s, d, "documents")


def q(text: str) -> str:
    return text.replace("'", "''")


def hit(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, '{q(pattern)}')"


def count(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, '{q(pattern)}'))"


def sub(x: str, pattern: str, to: str = "") -> str:
    return f"regexp_replace({x}, '{q(pattern)}', '{q(to)}', 'g')"


def strip(x: str) -> str:
    return sub(x, r"^\s+|\s+\z")


LINES = "lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents)"


def noise(x: str) -> str:
    return f"({strip(x)} <> '' AND ({hit(strip(x), '|'.join(DRIVER.noise_patterns))} OR {hit(strip(x), '(?i)' + any_of(DRIVER.noise_words))}))"


def features(name: str, source: str) -> str:
    return f"""{name} AS (SELECT *, {strip("line")} AS x, {sub("x", r"\s+")} AS bare, {count("x", DRIVER.letters)} AS letters, {count("x", r"\d")} AS digits, {count("x", r"\b\d{1,2}[-/.]\d{1,2}\b")} AS dates,
    {count("x", r"[-+]?\d[\d,.]*")} AS numbers, {count("x", "[A-Za-z]")} AS alpha, length(replace(x, ' ', '')) AS size, {count("bare", f"[^A-Za-z0-9{DRIVER.letters[1:]}")} AS signs,
    {hit("x", any_of(DRIVER.judgement_hints))} AS judged, {hit("x", any_of(DRIVER.core_hints))} OR (letters >= 12 AND judged) AS core, {hit("x", any_of(DRIVER.hints))} OR letters >= 7 AS semantic FROM {source})"""


def numeric(mode: str) -> str:
    dense = f"size = 0 OR dates >= 5 OR (digits / greatest(size, 1) >= 0.35 AND numbers >= 2) OR {hit('x', cl_numbers)}" + (" OR (digits / greatest(size, 1) >= 0.25 AND letters <= 2 AND numbers >= 3)" if mode == "ocr" else "")
    kept = "starts_with(x, '|') AND letters > 0" if mode == "table" else "false"
    return f"(NOT semantic AND NOT ({kept}) AND letters <= 6 AND ({dense}))"


cl_numbers = r"^[\d\s,.\-+/%()]+\z"


def axis() -> str:
    return f"(NOT semantic AND (dates >= 3 OR ({count('x', chr(92) + 'b' + chr(92) + 'd{4,5}' + chr(92) + 'b')} >= 4 AND letters <= 2) OR {numeric('ocr')}))"


def low(mode: str) -> str:
    parts = "(length(bare) < 8 AND letters = 0)"
    if mode in ("ocr", "body"):
        parts += " OR (letters = 0 AND alpha >= 3 AND length(bare) <= 24)"
    if mode == "ocr":
        parts += " OR (letters <= 1 AND (length(bare) = 0 OR signs / length(bare) > 0.45))"
    return f"(NOT (starts_with(x, '#') OR starts_with(x, '|')) AND NOT semantic AND ({parts}))"


def strict() -> str:
    size = "length(bare)"
    dated = count("x", r"\d{4}[-/.]\d{1,2}[-/.]\d{1,2}")
    titles = ", ".join(f"'{t}'" for t in packs.CHART_TITLES)
    residual = f"{hit('bare', any_of(DRIVER.residual))} OR (starts_with(bare, '的观点') AND contains(bare, '概不负责'))"
    footer = f"bare IN ('浙商期货有限公司', '请务必阅读正文之后的免责条款和声明') OR {hit('bare', chr(94) + '[一-鿿]{2,12}期货有限公司' + chr(92) + 'z')}"
    source = f"{hit('bare', any_of(packs.SOURCE_MARKS))} OR ({hit('x', packs.SOURCE_CODES)} AND NOT judged)"
    chart = f"NOT judged AND ({sub('x', '[、，,。.' + chr(92) + 's]+')} IN ({titles}) OR ({dated} > 0 AND {hit('bare', any_of(packs.CHART_TERMS))}) OR {dated} >= 2)"
    garbled = f"NOT core AND ({size} = 0 OR (alpha >= 8 AND alpha / greatest({size}, 1) >= 0.45 AND letters < 6) OR (alpha >= 12 AND letters <= 2))"
    fragment = "NOT judged AND (" + " OR ".join(
        [
            f"({hit('x', r'^(?:吨|元|手|面|方面|仓|单|量)[,，.。;；' + chr(92) + 's]')} AND numbers >= 1)",
            f"({hit('bare', '^(?:吨|元|手)')} AND letters <= 8 AND numbers >= 1)",
            hit("bare", r"^(?:当日注册仓|注册仓|变化至|环比变化至)|环比变化至\d"),
            f"({hit('bare', '(?:主力合约持仓量|总持仓|持仓量).*环比减少' + chr(92) + 'd')} AND letters <= 18)",
            f"(numbers >= 3 AND letters <= 8 AND {hit('bare', any_of(packs.FRAGMENT_TERMS))})",
        ]
    ) + ")"
    short = f"({hit('bare', r'^[A-Za-z|、。.,:：;；()（）_' + chr(92) + r'-+=/' + chr(92) + chr(92) + chr(92) + r'd一-鿿]{1,8}' + chr(92) + 'z')} AND NOT {hit('bare', any_of(DRIVER.core_hints))})"
    table = f"bare IN ('[日报', '日报', '参与角色行为导向情形导向') OR {hit('bare', any_of(packs.TABLE_WORDS))} OR (NOT judged AND ({short} OR ({hit('x', r'^' + chr(92) + 'd+' + chr(92) + 's+' + chr(92) + 'd+、')} AND numbers >= 4) OR (numbers >= 4 AND NOT core)))"
    return f"(NOT (starts_with(x, '#') OR starts_with(x, '|')) AND (({residual}) OR ({footer}) OR ({source}) OR ({chart}) OR ({garbled}) OR ({fragment}) OR ({table})))"


def repair(x: str) -> str:
    out = sub(sub(x, r"\s{2,}", " "), rf"({DRIVER.letters})\s+({DRIVER.letters})", r"\1\2")
    out = sub(out, rf"^[\[\]【】“”\"'汪\s]+((?:{DRIVER.priority})[:：])", r"\1")
    for wrong, right in (("年未", "年末"), ("装直", "装置"), ("上且", "且"), ("产员穿全年", "产能压力贯穿全年")):
        out = f"replace({out}, '{wrong}', '{right}')"
    return strip(out)


def semantic(name: str, source: str, mode: str) -> str:
    """CTEs that end in `name`: doc_id, pos, line, reason."""
    starts = f"({hit('bare', any_of(DRIVER.starts))} OR (starts_with(bare, '的观点') AND contains(bare, '概不负责')) OR (starts_with(bare, '书面许可') AND contains(bare, '复制')) OR (starts_with(bare, '经许可') AND contains(bare, '损失赔偿')) OR {hit('bare', '[一-鿿]{2,16}期货有限公司是经')})"
    navigation = f"(bare IN ({', '.join(repr(x) for x in DRIVER.navigation)}) OR {hit('bare', '^【?[一-鿿A-Za-z]{1,12}(?:日报|周报|月报|年报)' + chr(92) + 'd{6,8}】?' + chr(92) + 'z')})"
    disclaimer = "WHEN alike AND begun = 1 THEN 'disclaimer'" if mode in ("body", "ocr") else ""
    strictly = f"WHEN {strict()} THEN 'strict'" if mode in ("body", "ocr") else ""
    f, p = features, name
    return f"""{f(p + "_f", source)}, {p}_l AS (SELECT *, {starts} AS starts, starts OR {hit("bare", any_of(DRIVER.more))} AS alike FROM {p}_f),
    {p}_b AS (SELECT *, sum(CASE WHEN alike THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY pos) AS block FROM {p}_l),
    {p}_s AS (SELECT *, max(starts::INT) OVER (PARTITION BY doc_id, block ORDER BY pos) AS begun FROM {p}_b),
    {p}_e AS (SELECT doc_id, pos, {repair("x")} AS line, CASE WHEN x = '' THEN '' {disclaimer} WHEN starts_with(x, '[图片分片') AND ends_with(x, ']') THEN 'slice' WHEN {navigation} THEN 'navigation' WHEN {numeric(mode)} THEN 'numeric' WHEN {low(mode)} THEN 'low_value' END AS early FROM {p}_s),
    {f(p + "_g", p + "_e")}, {p}_r AS (SELECT doc_id, pos, line, CASE WHEN early = '' THEN NULL WHEN early IS NOT NULL THEN early {strictly} END AS reason, {axis()} AND x <> '' AS axis FROM {p}_g),
    {p}_n AS (SELECT *, sum(CASE WHEN reason IS NULL AND NOT axis THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM {p}_r),
    {p} AS (SELECT doc_id, pos, line, CASE WHEN reason IS NULL AND axis AND sum(CASE WHEN reason IS NULL AND axis THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, run) >= 2 THEN 'axis_run' ELSE reason END AS reason FROM {p}_n)"""


@query("c1_noise_lines", f"WITH {LINES} SELECT doc_id, count(*) FILTER ({noise('line')}) AS removed, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT {noise('line')}), '')) AS digest FROM lines GROUP BY doc_id")
def c1(s, d):
    kept = cl.without_noise_lines(F.col("text"), DRIVER)
    return _docs(s, d).select("doc_id", (F.size(F.split("text", "\n")) - F.size(kept)).cast("long").alias("removed"), F.sha2(F.array_join(kept, "\n"), 256).alias("digest"))


@query("c2_noise_paragraphs", f"SELECT doc_id, length(text) - length({sub('text', cl.paragraph_pattern(DRIVER))}) AS removed, sha256({sub('text', cl.paragraph_pattern(DRIVER))}) AS digest FROM documents")
def c2(s, d):
    out = cl.without_noise_paragraphs(F.col("text"), DRIVER)
    return _docs(s, d).select("doc_id", (F.length("text") - F.length(out)).cast("long").alias("removed"), F.sha2(out, 256).alias("digest"))


TEMPLATE = f"""built AS (SELECT doc_id, concat_ws(chr(10) || chr(10), '# ' || lang, '来源文件: dir/' || source || '_' || doc_id || '.html', '解析器: html', CASE WHEN {strip("left(text, length(text) // 2)")} <> '' THEN '## 正文文本' || chr(10) || chr(10) || {strip("left(text, length(text) // 2)")} END,
    CASE WHEN {strip("substring(text, length(text) // 2 + 1, 400)")} <> '' THEN '## 表格数据' || chr(10) || chr(10) || {strip("substring(text, length(text) // 2 + 1, 400)")} END,
    CASE WHEN doc_id % 3 = 0 AND {strip("left(text, 700)")} <> '' THEN '## 图片OCR文本: p.png' || chr(10) || chr(10) || {strip("left(text, 700)")} END, CASE WHEN doc_id % 5 = 0 AND {strip("right(text, 300)")} <> '' THEN '## AI图表解读: p.png' || chr(10) || chr(10) || {strip("right(text, 300)")} END) AS text FROM documents)"""


def _built(s, d) -> DataFrame:
    half = F.expr("CAST(length(text) DIV 2 AS INT)")
    of = lambda n, x: F.when(F.col("doc_id") % n == 0, F.array(F.struct(F.lit("p.png").alias("name"), x.alias("text")))).otherwise(F.array().cast("array<struct<name:string,text:string>>"))
    source = F.concat(F.lit("dir/"), F.col("source"), F.lit("_"), F.col("doc_id"), F.lit(".html"))
    out = cl.document_text(F.col("lang"), source, F.lit("html"), F.left("text", half), F.substring("text", half + F.lit(1), F.lit(400)), of(3, F.left("text", F.lit(700))), of(5, F.right("text", F.lit(300))))
    return _docs(s, d).select("doc_id", out.alias("text"))


@query("s10_document_text", f"WITH {TEMPLATE} SELECT doc_id, length(text) AS n, sha256(text) AS digest FROM built")
def s10(s, d):
    return _built(s, d).select("doc_id", F.length("text").cast("long").alias("n"), F.sha2("text", 256).alias("digest"))


_FIELDS = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in packs.SECTION_FIELDS.items())
PARTS = f"""{TEMPLATE}, blines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM built),
    bx AS (SELECT doc_id, pos, {strip("raw")} AS line FROM blines), bt AS (SELECT *, min(pos) FILTER (starts_with(line, '# ')) OVER (PARTITION BY doc_id) AS titled, CASE WHEN starts_with(line, '## ') THEN CASE {strip("split_part(substring(line, 4), ':', 1)")} {_FIELDS} ELSE 'other' END END AS begun FROM bx),
    parts AS (SELECT doc_id, pos, line, CASE WHEN pos = titled THEN 'title' WHEN starts_with(line, '来源文件:') THEN 'source' WHEN starts_with(line, '解析器:') THEN 'parser' WHEN starts_with(line, '## ') THEN 'heading' ELSE 'text' END AS role, coalesce(last_value(begun IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos), 'other') AS section FROM bt)"""


def _parts(s, d):
    return cl.template_parts(text.lines(_built(s, d)))


@query("c4_template_parts", f"WITH {PARTS} SELECT doc_id, section, role, count(*) AS n, sum(length(line))::BIGINT AS chars FROM parts GROUP BY ALL")
def c4(s, d):
    return _parts(s, d).groupBy("doc_id", "section", "role").agg(F.count("*").alias("n"), F.sum(F.length("line")).alias("chars"))


def compact(lines: str) -> str:
    full = f"list_filter({lines}, lambda v: {strip('v')} <> '')"
    text = f"coalesce(array_to_string(CASE WHEN len({full}) < 0.7 * len({lines}) THEN {full} ELSE {lines} END, chr(10)), '')"
    return strip(f"regexp_replace({text}, '\\n{{3,}}', chr(10) || chr(10), 'g')")


_TEXT = f"plines AS (SELECT doc_id, pos, line, CASE section WHEN 'other' THEN 'body' ELSE section END AS section FROM parts WHERE role = 'text' AND NOT {noise('line')})"
_SEPARATOR = r"^\|?\s*:?-{3,}:?\s*(\|\s*:?-{3,}:?\s*)+\|?\z"


def flagged_table(name: str, source: str) -> str:
    return f"{features(name + '_f', source)}, {name} AS (SELECT doc_id, pos, x AS line, CASE WHEN x = '' OR {hit('x', _SEPARATOR)} THEN NULL WHEN {numeric('table')} THEN 'numeric' WHEN {low('table')} THEN 'low_value' END AS reason FROM {name}_f)"


def once(name: str, source: str) -> str:
    front = hit("bare", rf"^[\[\]【】“”\"'汪]*(?:{DRIVER.priority})[:：]")
    return f"{name}_o AS (SELECT *, {sub('line', r'\s+')} AS bare, row_number() OVER (PARTITION BY doc_id, {sub('line', r'\s+')} ORDER BY pos) AS n FROM {source}), {name} AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY {front} DESC, pos) AS rank, line FROM {name}_o WHERE bare = '' OR n = 1)"


_SECTIONS = ", ".join(
    [f"own_{k} AS (SELECT doc_id, pos, line FROM plines WHERE section = '{k}')" for k in ("body", "tables", "ocr", "ai")]
    + [semantic("body", "own_body", "body"), flagged_table("tables", "own_tables"), semantic("ocr", "own_ocr", "ocr"), semantic("ai", "own_ai", "ai")]
    + ["ocr_left AS (SELECT doc_id, pos, line FROM ocr WHERE reason IS NULL)", once("ocr_once", "ocr_left")]
)
_BODIES = " UNION ALL ".join(
    [f"SELECT doc_id, '{k}' AS section, list(line ORDER BY pos) AS l FROM {k} WHERE reason IS NULL GROUP BY doc_id" for k in ("body", "tables", "ai")] + ["SELECT doc_id, 'ocr', list(line ORDER BY rank) FROM ocr_once GROUP BY doc_id"]
)
_HEADINGS = {"body": "## 核心正文", "tables": "## 表格与数据", "ocr": "## 图文识别正文", "ai": "## AI图表解读"}


def _placed(k: str) -> str:
    head = f"CASE WHEN starts_with(t, '### 表格') THEN '' ELSE '### 表格: 价格/库存/基差数据' || chr(10) END || " if k == "tables" else ""
    return f"max(CASE WHEN section = '{k}' AND t <> '' THEN '{_HEADINGS[k]}' || chr(10) || chr(10) || {head}t END) AS {k}"


@query(
    "c5_structured_text",
    f"""WITH {PARTS}, {_TEXT}, {_SECTIONS}, lists AS ({_BODIES}), texts AS (SELECT doc_id, section, {compact("l")} AS t FROM lists), bodies AS (SELECT doc_id, {", ".join(map(_placed, _HEADINGS))} FROM texts GROUP BY doc_id),
    heads AS (SELECT doc_id, max(line) FILTER (role = 'title') AS title, max(line) FILTER (role = 'source') AS source, max(line) FILTER (role = 'parser') AS parser FROM parts GROUP BY doc_id)
    SELECT doc_id, sha256(concat_ws(chr(10) || chr(10), title, '## 文档信息' || chr(10) || chr(10) || '来源文件: ' || regexp_extract(source, '([^/]*)$', 1) || chr(10) || parser, body, tables, ocr, ai)) AS digest FROM heads LEFT JOIN bodies USING (doc_id)""",
)
def c5(s, d):
    return cl.structured_text(_parts(s, d), DRIVER).select("doc_id", F.sha2("cleaned", 256).alias("digest"))


@query("c6_table_lines", f"WITH {LINES}, {flagged_table('flagged', 'lines')} SELECT doc_id, pos, reason FROM flagged WHERE reason IS NOT NULL")
def c6(s, d):
    return cl.table_lines(text.lines(_docs(s, d)), DRIVER).filter("reason IS NOT NULL").select("doc_id", "pos", "reason")


@query("c7_semantic_lines", f"WITH {LINES}, {semantic('flagged', 'lines', 'body')} SELECT doc_id, pos, reason FROM flagged WHERE reason IS NOT NULL")
def c7(s, d):
    return cl.semantic_lines(text.lines(_docs(s, d)), "body", DRIVER).filter("reason IS NOT NULL").select("doc_id", "pos", "reason")


@query("c7_image_lines", f"WITH {LINES}, {semantic('flagged', 'lines', 'ocr')} SELECT doc_id, coalesce(reason, 'kept') AS reason, count(*) AS n FROM flagged GROUP BY ALL")
def c7_image(s, d):
    return cl.semantic_lines(text.lines(_docs(s, d)), "ocr", DRIVER).groupBy("doc_id", F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


@query("c8_numeric_lines", f"WITH {LINES}, {features('f', 'lines')} SELECT doc_id, count(*) FILTER ({numeric('body')}) AS body, count(*) FILTER ({numeric('ocr')}) AS ocr, count(*) FILTER ({numeric('table')}) AS tables, count(*) FILTER ({axis()}) AS axes FROM f GROUP BY doc_id")
def c8(s, d):
    flags = {"body": cl.numeric_line(), "ocr": cl.numeric_line("ocr"), "tables": cl.numeric_line("table"), "axes": cl.axis_line()}
    return cl.featured(text.lines(_docs(s, d)), DRIVER).groupBy("doc_id").agg(*[F.count_if(v).alias(k) for k, v in flags.items()])


@query("c9_noise_tests", f"WITH {LINES}, {features('f', 'lines')} SELECT doc_id, count(*) FILTER ({low('body')}) AS body, count(*) FILTER ({low('ocr')}) AS ocr, count(*) FILTER ({low('table')}) AS tables, count(*) FILTER ({strict()}) AS strict FROM f GROUP BY doc_id")
def c9(s, d):
    flags = {"body": cl.low_value_line(), "ocr": cl.low_value_line("ocr"), "tables": cl.low_value_line("table"), "strict": cl.strict_noise(DRIVER)}
    return cl.featured(text.lines(_docs(s, d)), DRIVER).groupBy("doc_id").agg(*[F.count_if(v).alias(k) for k, v in flags.items()])


@query("c10_prioritised_lines", f"WITH {LINES}, {once('o', 'lines')} SELECT doc_id, count(*) AS n, sha256(string_agg(line, chr(10) ORDER BY rank)) AS digest FROM o GROUP BY doc_id")
def c10(s, d):
    ranked = cl.prioritised(text.lines(_docs(s, d)), DRIVER)
    held = F.transform(F.array_sort(F.collect_list(F.struct("rank", "line"))), lambda x: x["line"])
    return ranked.groupBy("doc_id").agg(F.count("*").alias("n"), F.sha2(F.array_join(held, "\n"), 256).alias("digest"))


@query("c11_compacted_lines", f"SELECT doc_id, sha256({compact('string_split(text, chr(10))')}) AS digest FROM documents")
def c11(s, d):
    return _docs(s, d).select("doc_id", F.sha2(cl.compacted_lines(F.split("text", "\n")), 256).alias("digest"))


_CLEAN = f"coalesce(array_to_string(list_filter(string_split(text, chr(10)), lambda v: NOT {noise('v')}), chr(10)), '')"


@query(
    "c12_clean_outcome",
    f"""WITH k AS (SELECT doc_id, text, {_CLEAN} AS c FROM documents), r AS (SELECT *, coalesce(round(1 - length(c) / nullif(length(text), 0), 6), 0) AS ratio, CASE WHEN {strip('text')} = '' THEN 'raw_text 为空' WHEN {strip('c')} = '' THEN '清洗后文本为空' WHEN NOT contains(c, 'the') THEN '清洗后未发现可分析正文，可能仅包含目录、导航或文档信息' END AS failure FROM k)
    SELECT doc_id, ratio, CASE WHEN ratio > 0.95 THEN 'high' WHEN ratio < 0.05 THEN 'low' ELSE 'none' END AS warning, failure, sha256(CASE WHEN failure IS NULL THEN CASE WHEN length(c) > 2000 THEN left(c, 2000) || chr(10) || chr(10) || '[文本过长，已截断，原长度: ' || length(c) || ' 字符]' ELSE c END END) AS digest FROM r""",
)
def c12(s, d):
    cleaned = F.array_join(cl.without_noise_lines(F.col("text"), DRIVER), "\n")
    rows = _docs(s, d).select("doc_id", "text", cleaned.alias("c"))
    return rows.select("doc_id", *cl.clean_outcome(F.col("text"), F.col("c"), F.contains("c", F.lit("the")), 2000)).select("doc_id", "ratio", "warning", "failure", F.sha2("text", 256).alias("digest"))


_WORDS = (*packs.DISPLAY_NOISE, "Licensedunder", "redistribution")


def shown(x: str) -> str:
    out = strip(x)
    for pattern in cl.INLINE_NOISE:
        out = sub(out, "(?i)" + pattern, " ")
    for pattern, to in ((r"\b\d+\s*/\s*\d+\b", " "), (r"[ \t]+", " "), (r"\s+([，。；：！？、])", r"\1"), (r"([【（(])\s+", r"\1"), (r"\s+([】）)])", r"\1"), (f"^[{cl.ENDS}]+|[{cl.ENDS}]+\\z", ""), (cl.ORPHANS, "")):
        out = sub(out, pattern, to)
    return strip(out)


_NOISY = r"^(?:第?\d+页?|[\d/\-.]+|[一-鿿]{2,16}(?:期货)?(?:有限责任)?公司(?:研究所)?)\z"
_BARE = sub("v", r"\s+")
_PLAIN = sub(sub(sub(sub(sub("text", r"\r\n?", "\n").replace("'\n'", "chr(10)"), r"```(?:\w+)?\s*([\s\S]*?)\s*```", r"\1"), r"(?im)^#{2,}\s*Page\s+\d+\s*$"), r"(?m)^#+\s*文档信息\s*$"), r"(?m)^(?:来源文件|解析器)\s*[:：].*$")


@query(
    "c13_displayed_text",
    f"""WITH p AS (SELECT doc_id, list_filter(list_transform(string_split({_PLAIN}, chr(10)), lambda v: {shown("v")}), lambda v: {_BARE} <> '' AND NOT {hit(_BARE, any_of(_WORDS))} AND NOT {hit(_BARE, _NOISY)}) AS l FROM documents),
    k AS (SELECT doc_id, list_filter(l, lambda v, i: i = 1 OR {_BARE} <> {sub("l[i - 1]", chr(92) + "s+")}) AS l FROM p), j AS (SELECT doc_id, {strip(sub("coalesce(array_to_string(l, chr(10)), '')", "[ " + chr(92) + "t]{2,}", " "))} AS t FROM k)
    SELECT doc_id, sha256(t) AS digest, sha256(CASE WHEN length(t) > 260 THEN {sub("left(t, 260)", "[，,；;、 ]+" + chr(92) + "z")} || '。' ELSE t END) AS capped FROM j""",
)
def c13(s, d):
    shown = settled(_docs(s, d).select("doc_id", "text"), shown=cl.displayed(F.col("text"), words=_WORDS))
    return shown.select("doc_id", F.sha2("shown", 256).alias("digest"), F.sha2(cl.capped(F.col("shown"), 260), 256).alias("capped"))


def queries() -> dict:
    return _QUERIES


def oracle_sql() -> dict[str, str]:
    return _SQL
