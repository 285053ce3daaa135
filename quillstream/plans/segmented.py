"""Queries of sections, segments and product rules, with SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstream.operators import segmenting as sg
from quillstream.operators import text
from quillstream.operators.text import ALIASES
from quillstream.packs import DRIVER_DIRECTIONS as PACK
from quillstream.packs import SECTION_TYPES
from quillstream.plans.cleaned import hit, strip
from quillstream.plans.relational import WITH
from quillstream.plans.textual import directions_sql
from quillstream.sources import bindings as b

_QUERIES: dict = {}
_SQL: dict[str, str] = {}
#: Products that the driver's documents name: four of the words that are aliases, and symbols.
NAMES = sg.Names(ALIASES, {"is": "K.IS", "x": "K.X"})


def query(name: str, sql: str | None = None):
    def add(f):
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return add


#: Documents with headings as cleaned texts have them: two sections, and brackets before some sentences.
HEADED = "headed AS (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN text ELSE (['## 核心正文', '## 图文识别正文', '## Other'])[doc_id % 3 + 1] || chr(10) || replace(left(text, length(text) // 2), '. The ', '。【the】') || chr(10) || '## 文档信息  ' || chr(10) || '## 表格与数据' || chr(10) || replace(right(text, length(text) - length(text) // 2), '. Der ', '。' || chr(10) || 'der: ') END AS text FROM documents)"


def _headed(s, d) -> DataFrame:
    i, half = F.col("doc_id"), F.expr("CAST(length(text) DIV 2 AS INT)")
    first = F.get(F.array(F.lit("## 核心正文"), F.lit("## 图文识别正文"), F.lit("## Other")), (i % 3).cast("int"))
    left = F.replace(F.left("text", half), F.lit(". The "), F.lit("。【the】"))
    right = F.replace(F.right("text", (F.length("text") - half).cast("int")), F.lit(". Der "), F.lit("。\nder: "))
    made = F.concat(first, F.lit("\n"), left, F.lit("\n## 文档信息  \n## 表格与数据\n"), right)
    return b.table(s, d, "documents").select("doc_id", F.when(i % 10 == 0, F.col("text")).otherwise(made).alias("text"))


_HEAD = r"(?m)^##\s+[^\n]+?[ \t]*$"
_TYPES = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in SECTION_TYPES.items())
SECTIONS = f"""hcut AS (SELECT doc_id, text, unnest(regexp_extract_all(text, '{_HEAD}')) AS phrase, length(unnest(string_split_regex(text, '{_HEAD}'))) AS gap, unnest(range(len(string_split_regex(text, '{_HEAD}')))) AS pos FROM headed),
    hsum AS (SELECT *, sum(gap + coalesce(length(phrase), 0)) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING)::BIGINT AS stop FROM hcut),
    heads AS (SELECT doc_id, text, phrase, stop - length(phrase) AS start, stop FROM hsum WHERE phrase IS NOT NULL),
    cut AS (SELECT doc_id, regexp_replace(regexp_replace(phrase, '^##\\s+', ''), '\\s+\\z', '') AS heading, stop AS f, substring(text, stop + 1, coalesce(lead(start) OVER (PARTITION BY doc_id ORDER BY start), length(text)) - stop) AS raw FROM heads
      UNION ALL SELECT doc_id, '', 0, text FROM headed WHERE doc_id NOT IN (SELECT doc_id FROM heads)),
    trimmed AS (SELECT doc_id, heading, f + length(raw) - length(regexp_replace(raw, '^\\s+', '')) AS start, {strip("raw")} AS text FROM cut),
    sections AS (SELECT doc_id, heading, CASE heading {_TYPES} ELSE 'core' END AS section_type, start, start + length(text) AS stop, text FROM trimmed WHERE text <> '')"""


@query("g1_sections", f"WITH {HEADED}, {SECTIONS} SELECT doc_id, heading, section_type, start, stop, sha256(text) AS digest FROM sections")
def g1(s, d):
    return sg.sections(_headed(s, d)).select("doc_id", "heading", "section_type", "start", "stop", F.sha2("text", 256).alias("digest"))


def _parts(s, d) -> DataFrame:
    return sg.segments(sg.blocks(sg.sections(_headed(s, d)), NAMES), NAMES)


@query("g2_blocks")
def g2(s, d):
    return sg.blocks(sg.sections(_headed(s, d)), NAMES).select("doc_id", "section", "section_type", "heading", "explicit", "start", "stop")


@query("g3_segments")
def g3(s, d):
    return _parts(s, d).select("doc_id", "segment_index", "product_key", "contract", "section_type", "heading", "start", "stop", "confidence", "way")


#: Segments of the results' table: each text stands for a part of an article.
SEGS = """segs AS (SELECT id // 12 AS doc_id, id % 12 AS segment_index, CASE WHEN id % 7 = 3 THEN '' ELSE product_key END AS product_key, CASE WHEN id % 4 = 0 THEN '05 合约' WHEN id % 4 = 1 THEN 'RB05' END AS contract, (['core', 'ocr', 'unknown', 'table'])[id % 4 + 1] AS section_type, reason AS heading, id AS start, id + 9 AS stop, CASE WHEN id % 7 = 3 THEN 'unknown' ELSE 'single' END AS way, round(confidence, 4) AS confidence,
  (['with a view from here。this is it。', ' and that is not so。with mit from。', 'for all the others。it will be', 'nothing at all', ' ', 'in fact der。es is that。'])[id % 6 + 1] || CASE WHEN id % 6 = 4 THEN '' ELSE product END AS text FROM results)"""


def _segs(s, d) -> DataFrame:
    i = F.col("id")
    texts = F.array(*map(F.lit, ("with a view from here。this is it。", " and that is not so。with mit from。", "for all the others。it will be", "nothing at all", " ", "in fact der。es is that。")))
    kinds = F.array(*map(F.lit, ("core", "ocr", "unknown", "table")))
    unknown = i % 7 == 3
    return b.results(s, d).select(
        F.floor(i / 12).cast("long").alias("doc_id"), (i % 12).alias("segment_index"), F.when(unknown, "").otherwise(F.col("product_key")).alias("product_key"), F.when(i % 4 == 0, "05 合约").when(i % 4 == 1, "RB05").alias("contract"),
        F.get(kinds, (i % 4).cast("int")).alias("section_type"), F.col("reason").alias("heading"), i.alias("start"), (i + 9).alias("stop"), F.when(unknown, "unknown").otherwise("single").alias("way"), F.round("confidence", 4).alias("confidence"),
        F.concat(F.get(texts, (i % 6).cast("int")), F.when(i % 6 == 4, "").otherwise(F.col("product"))).alias("text"),
    )


_PRINT = "sha256(concat_ws('|', heading, start, stop, left(regexp_replace(text, '\\s+', '', 'g'), 500)))"


def _manual(s, d):
    marked = sg.overridden(_segs(s, d), s.createDataFrame([], "fingerprint string, manual_key string"))
    return marked.filter("start % 5 = 0").select("fingerprint", F.concat(F.lit("M"), F.col("start") % 3).alias("manual_key"))


@query("g4_overridden_segments", f"{WITH}, {SEGS} SELECT doc_id, segment_index, CASE WHEN start % 5 = 0 THEN 'M' || (start % 3) ELSE product_key END AS product_key, CASE WHEN start % 5 = 0 THEN 'manual' ELSE way END AS way, CASE WHEN start % 5 = 0 THEN 1.0 ELSE confidence END AS confidence, {_PRINT} AS fingerprint FROM segs")
def g4(s, d):
    return sg.overridden(_segs(s, d), _manual(s, d)).select("doc_id", "segment_index", "product_key", "way", "confidence", "fingerprint")


@query("g4_unknown_blocks", f"{WITH}, {SEGS} SELECT doc_id, {_PRINT} AS fingerprint, segment_index, heading AS raw_name, left(text, 1000) AS excerpt FROM segs WHERE start % 5 <> 0 AND product_key = '' AND section_type <> 'unknown'")
def g4_unknown(s, d):
    return sg.unknown_blocks(sg.overridden(_segs(s, d), _manual(s, d))).select("doc_id", "fingerprint", "segment_index", "raw_name", "excerpt")


CANDIDATES = f"""{SEGS}, known AS (SELECT *, coalesce(replace(replace(lower(trim(contract)), '合约', ''), ' ', ''), '') AS contract_key FROM segs WHERE product_key <> '' AND section_type <> 'unknown' AND trim(text) <> ''),
    cands AS (SELECT doc_id, product_key, contract_key, string_agg(trim(text), chr(10) ORDER BY segment_index) AS text, list(section_type ORDER BY segment_index) AS kinds FROM known GROUP BY ALL)"""


@query("g5_candidates", f"{WITH}, {CANDIDATES} SELECT doc_id, product_key, contract_key, text, array_to_string(list_filter(kinds, lambda x, i: list_position(kinds, x) = i), ',') AS section_types FROM cands")
def g5(s, d):
    return sg.candidates(_segs(s, d))


_PIECES = f"list_filter(list_transform(regexp_extract_all(text, '([^。！？；\\n]*[。！？；\\n]|[^。！？；\\n]+)', 1), lambda x: {strip('x')}), lambda x: x <> '')"
_WORDS = {"看涨": "|".join(PACK.up), "看跌": "|".join(PACK.down), "中性": "|".join(PACK.flat)}
_HIT = "CASE direction " + " ".join(f"WHEN '{k}' THEN {hit('x', v)}" for k, v in _WORDS.items()) + " ELSE false END"


def reasons_sql(source: str) -> str:
    """CTEs that end in `reasoned`: a source with direction and text, and reason."""
    return f"""pieces AS (SELECT *, {_PIECES} AS s FROM {source}), hits AS (SELECT *, list_filter(list_transform(s, lambda x, i: CASE WHEN {_HIT} THEN i END), lambda v: v IS NOT NULL) AS h FROM pieces),
    near AS (SELECT *, array_to_string(list_filter(s, lambda x, i: len(list_filter(h, lambda v: abs(v - i) <= 2)) > 0), '') AS n FROM hits),
    reasoned AS (SELECT * EXCLUDE (s, h, n), CASE WHEN direction IS NULL THEN '' ELSE coalesce(nullif(n, ''), left(trim(regexp_replace(text, '\\s+', ' ', 'g')), 220)) END AS reason FROM near)"""


@query("g7_reasons", f"WITH marked AS (SELECT doc_id, replace(text, '. ', '。') AS text FROM documents), {directions_sql('marked', 'doc_id, text')}, {reasons_sql('ruled')} SELECT doc_id, direction, sha256(reason) AS digest FROM reasoned")
def g7(s, d):
    docs = b.table(s, d, "documents").select("doc_id", F.replace("text", F.lit(". "), F.lit("。")).alias("text"))
    return sg.reasons(text.directions(docs, PACK), PACK).select("doc_id", "direction", F.sha2("reason", 256).alias("digest"))


RULED = f"{CANDIDATES}, {directions_sql('cands', 'doc_id, product_key, contract_key, text')}, {reasons_sql('ruled')}, saved AS (SELECT *, NOT need_llm AND direction IS NOT NULL AS saved FROM reasoned)"


@query("g9_rule_results", f"{WITH}, {RULED} SELECT doc_id, product_key, contract_key, direction, confidence, need_llm, reason, saved, saved AND row_number() OVER (PARTITION BY doc_id ORDER BY saved DESC, confidence DESC, product_key, contract_key) = 1 AS is_primary FROM saved")
def g9(s, d):
    return sg.rule_results(sg.candidates(_segs(s, d)), PACK).select("doc_id", "product_key", "contract_key", "direction", "confidence", "need_llm", "reason", "saved", "is_primary")


@query("g9_rule_status", f"{WITH}, {RULED}, a AS (SELECT doc_id, bool_or(need_llm) AS ask, coalesce(array_to_string(list_sort(list(DISTINCT product_key) FILTER (need_llm)), ','), '') AS keys FROM saved GROUP BY doc_id), docs AS (SELECT DISTINCT doc_id FROM segs UNION SELECT -1) SELECT doc_id, CASE WHEN coalesce(ask, true) THEN 3 ELSE 5 END AS status, CASE WHEN ask IS NULL THEN '未知' ELSE keys END AS need_llm FROM docs LEFT JOIN a USING (doc_id)")
def g9_status(s, d):
    docs = _segs(s, d).select("doc_id").distinct().union(s.range(1).select(F.lit(-1).cast("long")))
    return sg.rule_status(sg.rule_results(sg.candidates(_segs(s, d)), PACK), docs)


def queries() -> dict:
    return _QUERIES


def oracle_sql() -> dict[str, str]:
    return _SQL
