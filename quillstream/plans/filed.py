"""Queries of files, sinks, aliases and their discovery, with SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstream.functions import phrases as ph
from quillstream.operators import discovery as di
from quillstream.operators import files as fl
from quillstream.operators import ingest
from quillstream.operators import pages as pg
from quillstream.operators.text import ALIASES
from quillstream.plans.cleaned import hit, q
from quillstream.plans.relational import EXT, STATUS, WITH
from quillstream.plans.segmented import NAMES
from quillstream.plans.spanned import _spans_sql
from quillstream.sources import bindings as b
from quillstream.streaming import jobs

_QUERIES: dict = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return add


@query("s5_decoded_texts", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '# head of ' || doc_id || chr(10) || text ELSE text END AS text, 'utf-8-sig' AS encoding, CASE WHEN doc_id % 2 = 0 THEN 'head of ' || doc_id ELSE coalesce(trim(ltrim(list_filter(string_split(text, chr(10)), lambda x: starts_with(x, '#'))[1], '# ')), '') END AS title FROM documents")
def s5(s, d):
    i = F.col("doc_id")
    text = F.when(i % 2 == 0, F.concat(F.lit("# head of "), i, F.lit("\n"), "text")).otherwise(F.col("text"))
    mark = F.when(i % 3 == 0, F.unhex(F.lit("EFBBBF"))).otherwise(F.unhex(F.lit("")))
    return fl.decoded(b.table(s, d, "documents").select("doc_id", F.concat(mark, F.encode(text, "UTF-8")).alias("content")), "doc_id")


@query("s7_main_content")
def s7(s, d):
    return pg.page_content(b.table(s, d, "pages"), "[A-Za-z]")


_GRID = "list_transform(range(page_id % 4 + 2), lambda i: [url, 'r' || i, (page_id * i)::VARCHAR, ''])"
_LINE = "'| ' || array_to_string(list_transform({r}, lambda c: CASE WHEN c = '' THEN ' ' ELSE c END), ' | ') || ' |'"


@query("s8_tables", f"WITH g AS (SELECT page_id, {_GRID} AS rows FROM pages) SELECT page_id, 0 AS \"table\", {_LINE.format(r='rows[1]')} || chr(10) || '| --- | --- | --- | --- |' || chr(10) || array_to_string(list_transform(rows[2:], lambda r: {_LINE.format(r='r')}), chr(10)) AS markdown, array_to_string(list_transform(rows, lambda r, i: CASE WHEN i = 1 THEN '表头: ' ELSE '第' || (i - 1) || '行: ' END || array_to_string(r, ' | ')), chr(10)) AS plain FROM g")
def s8(s, d):
    p = F.col("page_id")
    cell = lambda x: F.concat(F.lit("<td>"), x, F.lit("</td>"))
    rows = F.transform(F.sequence(F.lit(0).cast("long"), p % 4 + 1), lambda i: F.concat(F.lit("<tr>"), cell(F.col("url")), cell(F.concat(F.lit("r"), i)), F.lit("<td colspan='2'>"), p * i, F.lit("</td></tr>")))
    made = b.table(s, d, "pages").select("page_id", F.concat(F.lit("<div><table>"), F.array_join(rows, "\n"), F.lit("</table></div>")).alias("html"))
    return pg.rendered(pg.table_rows(made)).select("page_id", "table", "markdown", "plain")


@query("s4_load_report", f"{WITH} SELECT file_url AS path, CASE {EXT} WHEN 'pdf' THEN 'pdf' WHEN 'html' THEN 'html' WHEN 'png' THEN 'image' ELSE 'unknown' END AS file_type, {STATUS} AS status, title, company, article_id FROM (SELECT * REPLACE (nullif(company, '') AS company) FROM articles)")
def s4(s, d):
    folder = jobs._folder(s) + "/report"
    rows = ingest.classified(b.articles(s, d)).drop("status").withColumnsRenamed({"file_url": "path", "file_status": "status"}).withColumn("publish_time", F.col("publish_time").cast("string"))
    fl.write_report(rows, folder)
    return fl.read_report(s, folder).select("path", "file_type", "status", "title", "company", "article_id")


def _sinks(s, d) -> tuple[str, list[DataFrame]]:
    folder = jobs._folder(s)
    results, reviews = b.results(s, d).select("id", "article_id", "product_key", "direction", "confidence", "method"), b.review_queue(s, d).select("id", "article_id", "reason", "status")
    canonical = results.groupBy("article_id").agg(F.array_sort(F.collect_list(F.struct("id", "product_key", "direction"))).alias("results"))
    fl.write_results(folder, results, results.select("id", "direction"), reviews, canonical)
    return folder, [results, reviews, canonical]


@query("s12_result_sinks", f"{WITH} SELECT 'results' AS sink, count(*) AS n, sum(id)::BIGINT AS ids FROM results UNION ALL SELECT 'evidence', count(*), sum(id)::BIGINT FROM results UNION ALL SELECT 'review_queue', count(*), sum(id)::BIGINT FROM queue UNION ALL SELECT 'canonical_results', count(DISTINCT article_id), sum(DISTINCT article_id)::BIGINT FROM results")
def s12(s, d):
    folder, (results, reviews, canonical) = _sinks(s, d)
    out = None
    for name, schema, key in (("results", results.schema, "id"), ("evidence", "id long, direction string", "id"), ("review_queue", reviews.schema, "id"), ("canonical_results", canonical.schema, "article_id")):
        rows = s.read.schema(schema).json(f"{folder}/{name}").agg(F.lit(name).alias("sink"), F.count("*").alias("n"), F.sum(key).alias("ids"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("s12_run_report", f"{WITH} SELECT (SELECT count(DISTINCT article_id) FROM results) AS documents, (SELECT count(*) FROM results) AS analyses, (SELECT count(*) FROM results WHERE method = 'rule') AS rules, (SELECT count(*) FROM results WHERE method <> 'rule') AS llm, (SELECT count(*) FROM queue) AS reviews, (SELECT count(*) FROM logs WHERE status = 'failed') AS errors")
def s12_report(s, d):
    _, (results, reviews, canonical) = _sinks(s, d)
    return fl.run_report(canonical, results, reviews, b.task_logs(s, d).filter("status = 'failed'"))


@query("s14_lexicon_artifact", "SELECT 'K' || p_partkey AS product_key, p_name AS canonical, p_name || ',' || p_brand AS aliases, p_size::BIGINT AS evidence_count, round(p_size / 50.0, 4)::DOUBLE AS confidence FROM part")
def s14(s, d):
    folder = jobs._folder(s) + "/lexicon"
    entries = b.table(s, d, "part").select(F.concat(F.lit("K"), "p_partkey").alias("product_key"), F.col("p_name").alias("canonical"), F.array("p_name", "p_brand").alias("aliases"), F.col("p_size").cast("long").alias("evidence_count"), F.round(F.col("p_size") / 50, 4).alias("confidence"))
    entries.write.json(folder)
    return fl.read_lexicon(s, folder).withColumn("aliases", F.array_join("aliases", ","))


@query("s9_label_source", "SELECT doc_id::VARCHAR AS source_id, 'K' || quality AS product_key, CASE toxic WHEN 1 THEN '看跌' ELSE '看涨' END AS direction, doc_id % 4 = 0 AS ambiguous, sha256(CASE WHEN doc_id % 5 = 0 THEN 'own text' ELSE text END) AS digest FROM labels LEFT JOIN documents USING (doc_id)")
def s9(s, d):
    folder, i = jobs._folder(s) + "/labels", F.col("doc_id")
    rows = b.table(s, d, "labels").select(i.cast("string").alias("source_id"), F.concat(F.lit("K"), "quality").alias("product_key"), F.when(F.col("toxic") == 1, b.BEARISH).otherwise(b.BULLISH).alias("direction"), F.array(F.lit("e")).alias("evidence"), F.when(i % 4 == 0, True).alias("ambiguous"), F.when(i % 5 == 0, "own text").when(i % 5 == 1, "").alias("raw_text"))
    rows.write.json(folder)
    docs = b.table(s, d, "documents").select(i.cast("string").alias("source_id"), "text")
    return fl.read_labels(s, folder, docs).select("source_id", "product_key", "direction", "ambiguous", F.sha2("raw_text", 256).alias("digest"))


# --- aliases

SEEDS = "seeds AS (SELECT 'K' || (p_partkey % 60) AS product_key, p_name AS display_name, p_brand || ' ' || p_size AS official_name, left(p_brand, 2) || p_size AS symbol, [p_name || '（' || p_size || '）', ' '] AS aliases FROM part)"
_CANONICAL = q(ph.CANONICAL_CLASS)


def _seeds(s, d) -> DataFrame:
    size = F.col("p_size").cast("string")
    return b.table(s, d, "part").select(F.concat(F.lit("K"), F.col("p_partkey") % 60).alias("product_key"), F.col("p_name").alias("display_name"), F.concat_ws(" ", "p_brand", size).alias("official_name"), F.concat(F.left("p_brand", F.lit(2)), size).alias("symbol"), F.array(F.concat("p_name", F.lit("（"), size, F.lit("）")), F.lit(" ")).alias("aliases"))


@query("l7_alias_index", f"WITH {SEEDS}, a AS (SELECT product_key, unnest(list_concat([display_name, official_name, symbol], aliases)) AS raw FROM seeds), k AS (SELECT product_key, regexp_replace(lower(trim(translate(raw, '（）', '()'))), '{_CANONICAL}', '', 'g') AS alias FROM a) SELECT alias, array_to_string(list_sort(list(DISTINCT product_key)), ',') AS product_keys FROM k WHERE alias <> '' GROUP BY alias")
def l7(s, d):
    return di.alias_index(_seeds(s, d)).select("alias", F.array_join("product_keys", ",").alias("product_keys"))


@query("l6_contract_patterns", "SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN '' ELSE '(?<![A-Za-z0-9])' || upper(left(p_brand, 2)) || '\\d{2,4}(?![A-Za-z0-9])' || ' (?<![A-Za-z0-9])' || upper(left(p_brand, 2)) || '\\s*\\d{2,4}\\s*合约' END AS patterns FROM part")
def l6(s, d):
    symbol = F.when(F.col("p_partkey") % 7 == 0, "").otherwise(F.left("p_brand", F.lit(2)))
    return b.table(s, d, "part").select("p_partkey", F.array_join(di.contract_patterns(symbol), " ").alias("patterns"))


_PREFIXES = ("the ", "of ", "de ")
_TOKENS = _spans_sql("runs", "[A-Za-z]+")


@query("l2_foreign_context", f"WITH {_TOKENS}, c AS (SELECT doc_id, start, phrase, substring(text, greatest(start - 12, 0) + 1, start - greatest(start - 12, 0)) AS before, substring(text, start + 1, 32) AS after FROM runs WHERE length(phrase) = 4) SELECT doc_id, start, contains(before, '@') OR {hit('before || phrase || after', chr(92) + 'b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+')} OR {hit('before', '(?i)(?:the |of |de )' + chr(92) + 'z')} AS negative FROM c")
def l2(s, d):
    # words of four letters, as maximal runs
    cut = di.in_context(b.table(s, d, "documents"), "(?<![A-Za-z])[A-Za-z]{4}(?![A-Za-z])")
    return cut.select("doc_id", "start", di.foreign_context(F.col("before"), F.col("phrase"), F.col("after"), _PREFIXES).alias("negative"))


_SAMPLE = "(['12.5%', '3-7', '31°N,121°E', 'qh123', 'x.com', '---', 'RB日报20250101', '收藏本页面', 'some company', 'a/b 3/4', 'F12345', '图片分片1', 'abcdefghijklmnopqrstu', 'word', '���', ' ', '免责声明', 'www.x'])"


@query(
    "l3_rejections",
    f"""WITH s AS (SELECT event_id, {_SAMPLE}[event_id % 18 + 1] AS raw, (['bracket_heading', 'market_context'])[event_id % 2 + 1] AS kind FROM events), t AS (SELECT *, regexp_replace(regexp_replace(trim(raw), '^[\\s【】\\[\\](){{}}<>:、,;]+', '', 'g'), '[\\s【】\\[\\](){{}}<>:、,;]+\\z', '', 'g') AS shown, regexp_replace(lower(trim(raw)), '{_CANONICAL}', '', 'g') AS key FROM s), c AS (SELECT *, regexp_replace(shown, '\\s+', '', 'g') AS compact FROM t)
    SELECT event_id, CASE WHEN key = '' THEN 'bad_alias_shape' WHEN regexp_matches(shown, '[\\x00-\\x08\\x0E-\\x1F\\x7F]') THEN 'control_character' WHEN regexp_matches(shown, '[�\\x{{80}}-\\x{{bf}}]') THEN 'mojibake'
    WHEN regexp_matches(compact, '(?i)^(?:[+-]?\\d+(?:\\.\\d+)?[%‰]?|[+-]?\\d+(?:\\.\\d+)?(?:-|~|至|到)[+-]?\\d+(?:\\.\\d+)?[%‰]?|[+-]?\\d{{1,3}}(?:\\.\\d+)?(?:°|度)?[NSEW东西南北]?(?:[,，/、][+-]?\\d{{1,3}}(?:\\.\\d+)?(?:°|度)?[NSEW东西南北]?)?)\\z') THEN 'numeric_coordinate_or_range'
    WHEN length(compact) = 0 OR len(regexp_extract_all(compact, '[\\p{{P}}\\p{{S}}]')) / greatest(length(compact), 1) >= 0.4 THEN 'punctuation_dominated' WHEN shown IN {di.STOP} THEN 'bad_alias_shape' WHEN regexp_matches(shown, '免责|公司') THEN 'institution_or_disclaimer' WHEN starts_with(shown, '图片分片') THEN 'bad_alias_shape' WHEN regexp_matches(shown, '\\d+\\s*/\\s*\\d+') THEN 'numeric_coordinate_or_range'
    WHEN regexp_matches(shown, '(?i)^[A-Z]{{1,5}}(?:日报|周报|月报|季报)(?:\\d{{4,8}})?\\z') THEN 'bad_alias_shape' WHEN kind = 'bracket_heading' AND length(key) > 16 THEN 'bad_alias_shape' WHEN regexp_matches(shown, '(?i)^[FZ]\\d{{5,}}\\z|\\.(?:com|cn|pdf|html?)\\z|qh\\d+|www|http|@') THEN 'bad_alias_shape' END AS reason FROM c""",
)
def l3(s, d):
    import ast

    values = F.array(*map(F.lit, ast.literal_eval(_SAMPLE)))
    i = F.col("event_id")
    rows = b.table(s, d, "events").select(i, F.get(values, (i % 18).cast("int")).alias("raw"), F.when(i % 2 == 0, "bracket_heading").otherwise("market_context").alias("kind"))
    return rows.select("event_id", di.rejection(F.col("raw"), F.col("kind")).alias("reason"))


@query("l1_occurrences")
def l1(s, d):
    return di.occurrences(b.table(s, d, "documents").select("doc_id", "text"), ALIASES, {"is": "K.IS", "it": "K.IT"}, ("with", "mit", "avec"))


# --- names

_NAMES = "CASE event_id % 5 WHEN 0 THEN 'The' WHEN 1 THEN '【 und 】' WHEN 2 THEN 'is2505' WHEN 3 THEN 'the of' ELSE event_type END"


@query("t3_resolved_names", f"WITH n AS (SELECT event_id, regexp_replace(lower({_NAMES}), '[\\s【】\\[\\]():：（）]+', '', 'g') AS n FROM events) SELECT event_id, CASE WHEN n IN {tuple(ALIASES)} THEN CASE n " + " ".join(f"WHEN '{a}' THEN '{k}'" for a, k in ALIASES.items()) + " END WHEN regexp_full_match(n, 'is(?:\\d{3,4})?') THEN 'K.IS' WHEN regexp_full_match(n, 'x\\d{3,4}') THEN 'K.X' END AS product_key FROM n")
def t3(s, d):
    return b.table(s, d, "events").select("event_id", NAMES.resolved(F.expr(_NAMES)).alias("product_key"))


_BARRED = ("in ", "of ")
_KEYS = " ".join(f"WHEN '{a}' THEN '{k}'" for a, k in ALIASES.items())


@query("t2_legacy_matches", f"WITH {_spans_sql('runs', '[A-Za-z0-9]+')}, m AS (SELECT doc_id, start, stop, lower(phrase) AS p, lower(substring(text, greatest(start - 3, 0) + 1, start - greatest(start - 3, 0))) AS before FROM runs), k AS (SELECT *, CASE WHEN regexp_full_match(p, 'is(?:[0-9]{{3,4}})?') THEN 'K.IS' WHEN regexp_full_match(p, 'x[0-9]{{3,4}}') THEN 'K.X' ELSE CASE p {_KEYS} END END AS product_key FROM m) SELECT doc_id, product_key, start, stop, CASE WHEN product_key IN ('K.IS', 'K.X') THEN 'contract' ELSE 'builtin' END AS tier FROM k WHERE product_key IS NOT NULL AND NOT (p = 'the' AND (ends_with(before, 'in ') OR ends_with(before, 'of ')))")
def t2(s, d):
    return NAMES.barring({"the": _BARRED}).matches(b.table(s, d, "documents").select("doc_id", "text"))


def queries() -> dict:
    return _QUERIES


def oracle_sql() -> dict[str, str]:
    return _SQL
