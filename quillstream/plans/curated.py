"""Queries of the phrase functions and of the catalog, alias and segment tables, each with its SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from quillstream.functions import phrases as ph
from quillstream.operators import analytics
from quillstream.operators import curation as cu
from quillstream.operators import text
from quillstream.plans import textual
from quillstream.plans.relational import WITH
from quillstream.plans.textual import MENTIONS, WORDS
from quillstream.sources import bindings as b

_QUERIES: dict = {}
_SQL: dict[str, str] = {}

#: Packs for the driver's documents.
SYMBOLS = ("v", "x", "usd", "id")
LATIN = "[A-Za-z]"


def query(name: str, sql: str | None):
    def add(f):
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return add


def _docs(s, d):
    return b.table(s, d, "documents")


def _digest(s, d, column):
    return _docs(s, d).select("doc_id", F.sha2(column, 256).alias("digest"))


def _sub(text: str, pattern: str, to: str = "") -> str:
    return f"regexp_replace({text}, '{pattern}', '{to}', 'g')"


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


HALF = f"trim(translate(text, {_literal(ph.WIDE)}, {_literal(ph.NARROW)}))"
#: What the documents hold of compatibility forms and of letters whose folded case is not their lower case.
FOLDED = f"replace(lower({HALF}), 'ß', 'ss')"
ENDS = r"[【】\[\](){}<>:、,;]+"


@query("x1_alias_key", "SELECT doc_id, sha256(" + _sub(FOLDED, ph.ALIAS_CLASS) + ") AS digest, sha256(" + _sub(FOLDED, ph.CANONICAL_CLASS.replace("'", "''")) + ") AS canonical FROM documents")
def x1(s, d):
    return _docs(s, d).select("doc_id", F.sha2(ph.alias_key("text"), 256).alias("digest"), F.sha2(ph.alias_key("text", canonical=True), 256).alias("canonical"))


@query("x2_shown_alias", "SELECT doc_id, sha256(" + _sub(_sub(_sub(HALF, r"^\s+|\s+\z"), f"^{ENDS}"), rf"{ENDS}\z") + ") AS digest FROM documents")
def x2(s, d):
    return _digest(s, d, ph.shown_alias("text"))


@query("x5_half_width", f"SELECT doc_id, sha256(translate(text, {_literal(ph.TEXT_WIDE)}, {_literal(ph.TEXT_NARROW)})) AS digest FROM documents")
def x5(s, d):
    return _digest(s, d, ph.half_width("text"))


@query("x8_residue", "SELECT doc_id, sha256(" + _sub("replace(text, chr(0), '')", "�{2,}", "�") + ") AS digest FROM documents")
def x8(s, d):
    return _digest(s, d, ph.without_residue("text"))


@query("x10_contacts", "SELECT doc_id, sha256(" + reduce(lambda t, p: _sub(t, "(?i)" + p, " "), (*ph.CONTACTS, r"\b\d+\s*/\s*\d+\b"), "text") + ") AS digest FROM documents")
def x10(s, d):
    return _digest(s, d, ph.without_contacts("text"))


_COMPACT = _sub(_sub(_sub(_sub("text", r"[ \t]+", " "), rf"\s+([{ph.CLOSING}])", r"\1"), rf"([{ph.OPENING}])\s+", r"\1"), rf"\s+([{ph.BRACKETS}])", r"\1")


@query("x11_compacted", "SELECT doc_id, sha256(" + _sub(_COMPACT, rf"^[{ph.ENDS}]+|[{ph.ENDS}]+\z") + ") AS digest FROM documents")
def x11(s, d):
    return _digest(s, d, ph.compacted("text"))


@query("x12_residual_contacts", f"SELECT doc_id, regexp_matches({_sub('text', chr(92) + 's+')}, '{'|'.join(ph.RESIDUES)}') OR " + " OR ".join(f"regexp_matches(text, '(?i){p}')" for p in ph.CONTACTS) + " AS noisy FROM documents")
def x12(s, d):
    return _docs(s, d).select("doc_id", ph.has_contacts("text").alias("noisy"))


_JOIN = rf"({ph.CJK})\s+({ph.CJK})"
_SITES, _BOILER = ("www.example.com", "Ouonr"), ("the of", *ph.QUOTE_NOISE)
_QUOTE = _sub(reduce(lambda t, x: _sub(t, "(?i)" + x.replace(".", r"\."), " "), _SITES, _sub("text", r"(?i)\[PAGE\s+\d+\]", " ")), r"\b\d+\s*/\s*\d+\b", " ")
_QUOTE = "trim(" + _sub(reduce(lambda t, x: f"replace({t}, '{x}', ' ')", _BOILER, _QUOTE), r"\s+", " ") + ")"


@query("x13_quotes", "SELECT doc_id, sha256(trim(" + _sub(_sub(_sub(_QUOTE, _JOIN, r"\1\2"), _JOIN, r"\1\2"), r"\s+([，。；：！？!?%])", r"\1") + ")) AS digest FROM documents")
def x13(s, d):
    return _digest(s, d, ph.clean_quote("text", _SITES, _BOILER))


_LABELS = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ph.REASONS.items())
_TRIGGER = "CASE event_id % 4 WHEN 0 THEN 'no_signal:' || event_type WHEN 1 THEN 'no_product_match' WHEN 2 THEN '' ELSE event_type END"


@query("x17_reason_labels", f"WITH r AS (SELECT event_id, {_TRIGGER} AS reason FROM events) SELECT event_id, coalesce(CASE split_part(reason, ':', 1) {_LABELS} END, nullif(reason, ''), '未知原因') AS label FROM r")
def x17(s, d):
    n, kind = F.col("event_id") % 4, F.col("event_type")
    reason = F.when(n == 0, F.concat(F.lit("no_signal:"), kind)).when(n == 1, "no_product_match").when(n == 2, "").otherwise(kind)
    return b.table(s, d, "events").select("event_id", ph.reason_label(reason).alias("label"))


@query("x19_contracts", f"SELECT doc_id, coalesce(list_filter(regexp_extract_all(text, '\\b([A-Za-z]{{1,3}}\\d{{3,4}})\\b', 1), lambda c: lower(regexp_replace(c, '\\d', '', 'g')) IN {SYMBOLS})[1], nullif(regexp_extract(text, '([0-9]{{2,4}})\\s*合约', 1), '')) AS contract FROM (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN replace(text, ' of ', ' v' || (100 + doc_id) || ' ') WHEN doc_id % 4 = 1 THEN text || (10 + doc_id % 90) || ' 合约' ELSE text END AS text FROM documents)")
def x19(s, d):
    spelled = F.when(F.col("doc_id") % 4 == 0, F.replace("text", F.lit(" of "), F.concat(F.lit(" v"), 100 + F.col("doc_id"), F.lit(" ")))).when(F.col("doc_id") % 4 == 1, F.concat("text", 10 + F.col("doc_id") % 90, F.lit(" 合约"))).otherwise(F.col("text"))
    return _docs(s, d).select("doc_id", ph.contract(spelled, SYMBOLS).alias("contract"))


@query("x20_first_number", r"SELECT doc_id, TRY_CAST(nullif(regexp_extract(text, '[+-]?\d+(\.\d+)?', 0), '') AS DOUBLE) AS value FROM documents")
def x20(s, d):
    return _docs(s, d).select("doc_id", ph.first_number("text").alias("value"))


@query("x21_sentences", "WITH x AS (SELECT doc_id, list_filter(regexp_extract_all(text, '([^。！？；\\n]*[。！？；\\n]|[^。！？；\\n]+)', 1), lambda v: trim(regexp_replace(v, '\\s+', '', 'g')) <> '') AS l FROM documents) SELECT doc_id, len(l) AS n, sha256(array_to_string(l, '|')) AS digest FROM x")
def x21(s, d):
    parts = ph.sentences("text")
    return _docs(s, d).select("doc_id", F.size(parts).cast("long").alias("n"), F.sha2(F.array_join(parts, "|"), 256).alias("digest"))


_BARE = _sub("text", r"\s+")


@query("x22_features", f"SELECT doc_id, length(text) - length({_sub('text', ph.CJK)}) AS cjk, round((length(text) - length({_sub('text', '[0-9]')})) / nullif(length(text), 0), 6) AS digits, length(text) - length({_sub('text', LATIN)}) AS latin, round(coalesce((length({_BARE}) - length({_sub(_BARE, '[^A-Za-z0-9一-鿿]')})) / nullif(length({_BARE}), 0), 1), 6)::DOUBLE AS symbols FROM documents")
def x22(s, d):
    digits = F.round(F.try_divide(F.regexp_count("text", F.lit("[0-9]")), F.length("text")), 6)
    return _docs(s, d).select("doc_id", ph.cjk_count("text").alias("cjk"), digits.alias("digits"), F.regexp_count("text", F.lit(LATIN)).cast("long").alias("latin"), F.round(ph.symbol_ratio("text"), 6).alias("symbols"))


@query("x23_fingerprints", f"SELECT doc_id, sha256(concat_ws('|', lang, 0, length(text), left({_sub('text', '[ \\t\\n\\r\\f\\v]+')}, 500))) AS fingerprint FROM documents")
def x23(s, d):
    return _docs(s, d).select("doc_id", ph.block_fingerprint(F.col("lang"), F.lit(0), F.length("text"), "text").alias("fingerprint"))


@query("x24_signal_ids", f"{WITH} SELECT id, left(sha1(concat_ws('|', product_key, id, id + 4, direction, reason)), 16) AS signal_id FROM results")
def x24(s, d):
    return b.results(s, d).select("id", ph.signal_id("product_key", "id", F.col("id") + 4, "direction", "reason").alias("signal_id"))


@query("f10_analyzable", f"WITH x AS (SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda v: trim(v)), lambda v: NOT regexp_matches(v, '^(#|来源文件:|解析器:)')), chr(10)) AS body FROM documents) SELECT doc_id, contains(body, 'heit') OR contains(body, '观点') OR length(body) - length({_sub('body', ph.CJK)}) >= 30 AS ok FROM x")
def f10(s, d):
    return _docs(s, d).select("doc_id", ph.analyzable("text", ("heit", "观点")).alias("ok"))


@query("f11_meaningful", f"WITH x AS (SELECT doc_id, trim({_sub('text', '(?m)^(来源文件|解析器):.*$')}) AS body FROM documents) SELECT doc_id, length(body) >= 20 AND (length(body) - length({_sub('body', ph.CJK)}) >= 4 OR length(body) >= 200) AS ok FROM x")
def f11(s, d):
    return _docs(s, d).select("doc_id", ph.meaningful("text").alias("ok"))


@query("c3_dense_paragraphs", f"WITH x AS (SELECT doc_id, text, list_filter(string_split(text, chr(10) || chr(10)), lambda p: length(p) >= 10 AND (length(p) - length({_sub('p', LATIN)})) / length(p) >= 0.15) AS l FROM documents) SELECT doc_id, len(l) AS kept, length(text) - length(coalesce(array_to_string(l, chr(10) || chr(10)), '')) AS removed FROM x")
def c3(s, d):
    kept = ph.dense_paragraphs("text", LATIN)
    return _docs(s, d).select("doc_id", F.size(kept).cast("long").alias("kept"), (F.length("text") - F.length(F.array_join(kept, "\n\n"))).cast("long").alias("removed"))


# --- catalog, aliases, lexicon

CATALOG = "catalog AS (SELECT p_partkey AS product_key, p_brand || '-' || p_size AS symbol, p_name || ' ' || p_size AS alias FROM part)"


def _catalog(s, d):
    size = F.col("p_size").cast("string")
    return b.table(s, d, "part").select(F.col("p_partkey").alias("product_key"), F.concat_ws("-", "p_brand", size).alias("symbol"), F.concat_ws(" ", "p_name", size).alias("alias"))


CATALOG_TWICE = "catalog AS (SELECT CASE WHEN p_partkey % 50 = 0 THEN 1 ELSE p_partkey END AS product_key, p_brand || '-' || p_size AS symbol, p_name || ' ' || p_size AS alias, p_partkey AS row_no FROM part)"


@query("v3_catalog_violations", f"WITH {CATALOG_TWICE}, v AS (SELECT 'product_key' AS kind, product_key::VARCHAR AS value, row_no FROM catalog UNION ALL SELECT 'symbol', lower(symbol), row_no FROM catalog UNION ALL SELECT 'alias', replace(lower(alias), ' ', ''), row_no FROM catalog) SELECT kind, value, count(DISTINCT row_no) AS n FROM v GROUP BY kind, value HAVING count(DISTINCT row_no) > 1")
def v3(s, d):
    size, key = F.col("p_size").cast("string"), F.col("p_partkey")
    rows = b.table(s, d, "part").select(F.when(key % 50 == 0, 1).otherwise(key).alias("product_key"), F.concat_ws("-", "p_brand", size).alias("symbol"), F.concat_ws(" ", "p_name", size).alias("alias"), key.alias("row_no"))
    return cu.catalog_violations(rows)


_LOOKUP = "asked AS (SELECT l_orderkey, l_linenumber, CASE l_linenumber % 3 WHEN 0 THEN l_partkey::VARCHAR WHEN 1 THEN p_name || ' ' || p_size ELSE p_brand || '-' || p_size END AS asked FROM lineitem JOIN part ON p_partkey = l_partkey)"


@query("j5_catalog_lookup", f"WITH {CATALOG}, {_LOOKUP}, names AS (SELECT product_key::VARCHAR AS name, 0 AS way, product_key FROM catalog UNION ALL SELECT alias, 1, product_key FROM catalog UNION ALL SELECT symbol, 2, product_key FROM catalog), best AS (SELECT name, arg_min(product_key, (way, product_key)) AS product_key, min(way) AS way FROM names GROUP BY name) SELECT l_orderkey, l_linenumber, product_key, way FROM asked LEFT JOIN best ON asked = name")
def j5(s, d):
    size = F.col("p_size").cast("string")
    rows = b.table(s, d, "lineitem").join(b.table(s, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    n = F.col("l_linenumber") % 3
    asked = rows.select("l_orderkey", "l_linenumber", F.when(n == 0, F.col("l_partkey").cast("string")).when(n == 1, F.concat_ws(" ", "p_name", size)).otherwise(F.concat_ws("-", "p_brand", size)).alias("asked"))
    return cu.looked_up(asked, _catalog(s, d)).select("l_orderkey", "l_linenumber", "product_key", "way")


SEEN_MORE = "seen AS (SELECT reason AS alias, replace(reason, ' ', '') AS key, article_id AS doc, method AS kind, product_key, id AS pos, CASE WHEN id % 7 = 0 THEN direction END AS negative, direction || ' ' || contract_key AS snippet FROM results)"


@query(
    "a14_candidate_evidence",
    f"""{WITH}, {SEEN_MORE}, g AS (SELECT * FROM seen WHERE negative IS NULL), d AS (SELECT key, doc FROM (SELECT DISTINCT key, doc FROM g) QUALIFY row_number() OVER (PARTITION BY key ORDER BY doc) <= 8), s AS (SELECT key, snippet, spot FROM (SELECT key, snippet, min((doc, pos)) AS spot FROM g GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY key ORDER BY spot) <= 3)
    SELECT key AS alias, arg_min(alias, (doc, pos)) AS raw_alias, count(*) FILTER (negative IS NULL) AS occurrences, count(DISTINCT doc) FILTER (negative IS NULL) AS docs, coalesce(array_to_string(list_sort(list(DISTINCT kind) FILTER (negative IS NULL)), ','), '') AS kinds, coalesce(array_to_string(list_sort(list(DISTINCT product_key) FILTER (negative IS NULL)), ','), '') AS keys, coalesce(array_to_string(list_sort(list(DISTINCT negative) FILTER (negative IS NOT NULL)), ','), '') AS negative,
    coalesce((SELECT string_agg(doc::VARCHAR, ',' ORDER BY doc) FROM d WHERE d.key = seen.key), '') AS first_docs, coalesce((SELECT string_agg(snippet, '|' ORDER BY spot) FROM s WHERE s.key = seen.key), '') AS snippets FROM seen GROUP BY key""",
)
def a14(s, d):
    i = F.col("id")
    seen = b.results(s, d).select(F.col("reason").alias("alias"), F.col("article_id").alias("doc"), F.col("method").alias("kind"), "product_key", i.alias("pos"), F.when(i % 7 == 0, F.col("direction")).alias("negative"), F.concat_ws(" ", "direction", "contract_key").alias("snippet"))
    return cu.candidate_evidence(seen)


@query(
    "a17_lexicon",
    f"""{WITH}, r AS (SELECT product_key, product AS alias, 0 AS n, 1.0 AS score FROM results WHERE product <> '' UNION ALL SELECT product_key, reason, 1, round(confidence, 4) FROM results WHERE method = 'manual'),
    o AS (SELECT product_key, alias, sum(n) AS n, max(score) AS score FROM r GROUP BY ALL)
    SELECT product_key, string_agg(alias, ',' ORDER BY length(alias), alias) AS aliases, (1 + sum(n))::BIGINT AS evidence_count, max(score)::DOUBLE AS confidence FROM o GROUP BY product_key""",
)
def a17(s, d):
    rows = b.results(s, d)
    approved = rows.filter("method = 'manual'").select("product_key", F.col("reason").alias("alias"), F.lit(1).cast("long").alias("n"), F.round("confidence", 4).alias("score"))
    return cu.lexicon(rows.filter("product <> ''").select("product_key", F.col("product").alias("alias")), approved)


@query("m15_alias_layers", f"""{WITH}, l AS (SELECT reason AS alias, product_key, CASE WHEN method = 'manual' THEN 0 WHEN contract_key <> '' THEN 1 ELSE 2 END AS layer FROM results)
  SELECT alias, layer, min(product_key) AS product_key FROM l GROUP BY alias, layer QUALIFY row_number() OVER (PARTITION BY alias ORDER BY layer) = 1""")
def m15(s, d):
    rows = b.results(s, d).withColumnRenamed("reason", "alias")
    manual, marked = F.col("method") == "manual", F.col("contract_key") != ""
    return cu.by_precedence(rows.filter(manual), rows.filter(~manual & marked), rows.filter(~manual & ~marked))


DECIDED = "decisions AS (SELECT reason AS alias, product_key, id AS line_no, CASE WHEN id % 3 = 0 THEN 'reject' ELSE 'approve' END AS decision FROM results)"


def _decisions(s, d):
    decision = F.when(F.col("id") % 3 == 0, "reject").otherwise("approve")
    return b.results(s, d).select(F.col("reason").alias("alias"), "product_key", F.col("id").alias("line_no"), decision.alias("decision"))


@query("s15_last_decisions", f"{WITH}, {DECIDED} SELECT alias, product_key, line_no FROM decisions QUALIFY row_number() OVER (PARTITION BY alias ORDER BY line_no DESC) = 1 AND decision = 'approve'")
def s15(s, d):
    return cu.last_decisions(_decisions(s, d)).select("alias", "product_key", "line_no")


_BUILTIN = "builtin AS (SELECT DISTINCT 'click ' || user_id AS alias, 'K' || (user_id % 20 + user_id % 2) || 'r' AS product_key FROM events WHERE user_id < 60)"


@query(
    "m9_alias_review",
    f"""{WITH}, {_BUILTIN}, d AS (SELECT reason || ' ' || contract_key AS alias, product_key || left(method, 1) AS product_key, CASE WHEN bool_or(id % 3 = 0) THEN 'reject' ELSE 'approve' END AS decision FROM results GROUP BY 1, 2), r AS (SELECT alias, count(*) AS rivals FROM d WHERE decision = 'approve' GROUP BY alias)
    SELECT d.alias, d.product_key, CASE WHEN decision = 'reject' THEN 'rejected' WHEN u.product_key IS NOT NULL AND u.product_key <> d.product_key THEN 'builtin_conflict' WHEN rivals > 1 THEN 'conflict' ELSE 'approved' END AS status FROM d LEFT JOIN r USING (alias) LEFT JOIN builtin u ON u.alias || ' ' = d.alias""",
)
def m9(s, d):
    pairs = b.results(s, d).groupBy(F.concat_ws(" ", "reason", "contract_key").alias("alias"), F.concat("product_key", F.left("method", F.lit(1))).alias("product_key")).agg(F.bool_or(F.col("id") % 3 == 0).alias("no"))
    user = F.col("user_id")
    builtin = b.table(s, d, "events").filter("user_id < 60").select(F.concat(F.lit("click "), user, F.lit(" ")).alias("alias"), F.concat(F.lit("K"), user % 20 + user % 2, F.lit("r")).alias("product_key")).distinct()
    return cu.reviewed_aliases(pairs.withColumn("decision", F.when(F.col("no"), "reject").otherwise("approve")), builtin).select("alias", "product_key", "status")


# --- segments and blocks

SEGMENTS = """segments AS (SELECT id, id // 12 AS article_id, id % 12 AS segment_index, product, product_key, reason, confidence,
  (['core', 'ocr', 'ai', 'table', 'mixed', 'other', 'unknown'])[id % 7 + 1] AS section FROM results)"""
_RANK = "row_number() OVER (PARTITION BY article_id, product_key ORDER BY CASE section WHEN 'core' THEN 0 WHEN 'ocr' THEN 1 WHEN 'ai' THEN 2 WHEN 'table' THEN 3 WHEN 'mixed' THEN 4 ELSE 9 END, confidence DESC, segment_index, id)"


def _segments(s, d):
    sections = F.array(*map(F.lit, ("core", "ocr", "ai", "table", "mixed", "other", "unknown")))
    rows = b.results(s, d).withColumns({"article_id": F.floor(F.col("id") / 12).cast("long"), "segment_index": F.col("id") % 12, "section": F.get(sections, (F.col("id") % 7).cast("int"))})
    return rows.select("id", "article_id", "segment_index", "product", "product_key", "reason", "confidence", "section")


@query("w4_segment_ranks", f"{WITH}, {SEGMENTS} SELECT id, {_RANK} AS rank FROM segments")
def w4(s, d):
    return cu.ranked_segments(_segments(s, d), "article_id", "product_key").select("id", F.col("rank").cast("long"))


@query("j9_best_segments", f"{WITH}, {SEGMENTS}, best AS (SELECT * FROM segments WHERE section <> 'unknown' QUALIFY {_RANK} = 1) SELECT r.id AS result_id, s.id AS segment_id FROM results r LEFT JOIN best s USING (article_id, product_key)")
def j9(s, d):
    return cu.best_segments(b.results(s, d), _segments(s, d))


@query("j6_key_backfill", f"{WITH}, {SEGMENTS}, k AS (SELECT article_id, product, min(product_key) AS k FROM segments WHERE product_key <> '' GROUP BY ALL HAVING count(DISTINCT product_key) = 1), r AS (SELECT id, article_id, CASE id % 14 WHEN 0 THEN '股指' WHEN 2 THEN '国债' ELSE product END AS product, CASE WHEN id % 2 = 0 THEN '' ELSE product_key END AS product_key FROM results) SELECT id, coalesce(nullif(product_key, ''), k, CASE product WHEN '股指' THEN 'GROUP.CFFEX.INDEX' WHEN '国债' THEN 'GROUP.CFFEX.BOND' END, '') AS product_key FROM r LEFT JOIN k USING (article_id, product)")
def j6(s, d):
    i = F.col("id")
    rows = b.results(s, d).withColumns({"product_key": F.when(i % 2 == 0, "").otherwise(F.col("product_key")), "product": F.when(i % 14 == 0, "股指").when(i % 14 == 2, "国债").otherwise(F.col("product"))})
    return cu.backfilled_keys(rows, _segments(s, d))


@query("f9_refinable", f"{WITH}, {SEGMENTS} SELECT id FROM segments WHERE section <> 'unknown' AND product <> '未知' AND trim(reason) <> ''")
def f9(s, d):
    return _segments(s, d).filter("section <> 'unknown' AND product <> '未知' AND trim(reason) <> ''").select("id")


@query("w8_hit_window", f"{WITH}, {SEGMENTS}, g AS (SELECT *, segment_index + segment_index // 3 * 2 AS pos FROM segments) SELECT id FROM g s WHERE EXISTS (SELECT 1 FROM g t WHERE t.article_id = s.article_id AND abs(t.pos - s.pos) <= 2 AND t.confidence > 0.9)")
def w8(s, d):
    place = F.col("segment_index") + F.floor(F.col("segment_index") / 3) * 2
    return cu.hit_window(_segments(s, d).withColumn("pos", place), F.col("confidence") > 0.9, 2, "article_id").select("id")


@query("w15_first_distinct", f"{WITH}, {SEGMENTS}, f AS (SELECT article_id, reason, min(segment_index) AS i FROM segments GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY i) AS rn FROM f) SELECT article_id, string_agg(reason, '|' ORDER BY i) AS reasons FROM n WHERE rn <= 3 GROUP BY article_id")
def w15(s, d):
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("segment_index", "reason"))), lambda x: x["reason"])
    return _segments(s, d).groupBy("article_id").agg(F.array_join(F.slice(F.array_distinct(ordered), 1, 3), "|").alias("reasons"))


@query("o5_top_excerpts", f"{WITH}, {SEGMENTS}, n AS (SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY confidence DESC, segment_index) AS rn FROM segments) SELECT article_id, string_agg(id::VARCHAR, ',' ORDER BY segment_index) AS ids FROM n WHERE rn <= 3 GROUP BY article_id")
def o5(s, d):
    top = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("confidence")).alias("c"), "segment_index", "id"))), 1, 3)
    back = F.array_sort(F.transform(top, lambda x: F.struct(x["segment_index"].alias("i"), x["id"].alias("id"))))
    return _segments(s, d).groupBy("article_id").agg(F.array_join(F.transform(back, lambda x: x["id"].cast("string")), ",").alias("ids"))


@query("m5_segments_replaced", f"{WITH}, {SEGMENTS} SELECT id FROM segments WHERE id % 24 >= 12 OR article_id % 3 <> 0 UNION ALL SELECT -id FROM segments WHERE article_id % 3 = 0 AND id % 24 < 12")
def m5(s, d):
    rows = _segments(s, d)
    again = rows.filter("article_id % 3 = 0 AND id % 24 < 12").withColumn("id", -F.col("id"))
    return cu.replaced_segments(rows, again).select("id")


BLOCKS = "blocks AS (SELECT sha1(reason || id % 50) AS fingerprint, min(id) AS id FROM results GROUP BY 1)"


@query("m6_blocks_synced", f"{WITH}, {BLOCKS}, c AS (SELECT fingerprint, (['confirmed', 'auto_resolved', 'pending'])[id % 3 + 1] AS status FROM blocks WHERE id % 5 <> 0), l AS (SELECT fingerprint FROM blocks WHERE id % 2 = 0) SELECT fingerprint, CASE WHEN status IN ('confirmed', 'auto_resolved') THEN status WHEN l.fingerprint IS NOT NULL THEN 'pending' ELSE 'obsolete' END AS status FROM c FULL JOIN l USING (fingerprint)")
def m6(s, d):
    blocks = b.results(s, d).groupBy(F.sha1(F.concat("reason", F.col("id") % 50)).alias("fingerprint")).agg(F.min("id").alias("id"))
    status = F.get(F.array(*map(F.lit, ("confirmed", "auto_resolved", "pending"))), (F.col("id") % 3).cast("int"))
    return cu.synced_blocks(blocks.filter("id % 5 <> 0").select("fingerprint", status.alias("status")), blocks.filter("id % 2 = 0"))


@query("m7_auto_resolved", f"{WITH} SELECT id, product_key, round(least(greatest(confidence * 2 - 0.5, 0), 1), 6)::DOUBLE AS confidence, CASE WHEN product_key IN (SELECT 'K' || (p_partkey % 12) FROM part) AND confidence * 2 - 0.5 >= 0.85 THEN 'auto_resolved' ELSE 'pending' END AS status FROM results")
def m7(s, d):
    known = b.table(s, d, "part").select(F.concat(F.lit("K"), F.col("p_partkey") % 12).alias("product_key"))
    rows = cu.auto_resolved(b.results(s, d).withColumn("confidence", F.col("confidence") * 2 - 0.5), known)
    return rows.withColumn("confidence", F.round("confidence", 6))


@query("m11_confirmed", f"{WITH} SELECT id, CASE WHEN id % 9 = 0 THEN '中性' ELSE direction END AS direction, CASE WHEN id % 9 = 0 THEN 'manual' ELSE method END AS method, id % 9 <> 0 AND need_manual_review AS need_manual_review FROM results")
def m11(s, d):
    return _confirmed(s, d)[0]


def _confirmed(s, d):
    rows = b.results(s, d)
    return cu.confirmed_results(rows, rows.filter("id % 9 = 0").select("id", F.lit(b.NEUTRAL).alias("direction")), b.articles(s, d))


@query("m11_audit", f"{WITH} SELECT id, direction AS before, '中性' AS after FROM results WHERE id % 9 = 0")
def m11_audit(s, d):
    return _confirmed(s, d)[1]


@query("m11_articles", f"{WITH} SELECT article_id, CASE WHEN article_id IN (SELECT article_id FROM results WHERE id % 9 = 0) THEN 5 ELSE status END AS status FROM articles")
def m11_articles(s, d):
    return _confirmed(s, d)[2].select("article_id", "status")


OUTCOMES = "o AS (SELECT article_id, arg_max(CASE stage WHEN 'click' THEN 'parse' WHEN 'view' THEN 'clean' ELSE stage END, id) AS stage, arg_max(status, id) <> 'failed' AS ok, max(id) AS log_id FROM logs GROUP BY 1)"


def _outcomes(s, d):
    stage = F.when(F.col("stage") == "click", "parse").when(F.col("stage") == "view", "clean").otherwise(F.col("stage"))
    last = b.task_logs(s, d).groupBy("article_id").agg(F.max_by(stage, "id").alias("stage"), (F.max_by("status", "id") != "failed").alias("ok"), F.max("id").alias("log_id"))
    return last.withColumns({"text": F.concat(F.lit("text of "), "log_id"), "message": F.when(~F.col("ok"), F.concat(F.lit("failed in "), "stage"))})


@query("m17_stage_outcomes", f"{WITH}, {OUTCOMES} SELECT article_id, CASE WHEN ok IS NULL THEN status WHEN NOT ok THEN -1 WHEN stage = 'parse' THEN 1 WHEN stage = 'clean' THEN 2 ELSE status END AS status, CASE WHEN ok AND stage = 'parse' THEN 'text of ' || log_id END AS raw_text, CASE WHEN ok AND stage = 'clean' THEN 'text of ' || log_id END AS cleaned_text, length(CASE WHEN ok AND stage IN ('parse', 'clean') THEN 'text of ' || log_id END) AS length, CASE WHEN NOT ok THEN 'failed in ' || stage END AS error_msg FROM articles LEFT JOIN o USING (article_id)")
def m17(s, d):
    return cu.stage_outcomes(b.articles(s, d), _outcomes(s, d))[0]


@query("m17_stage_logs", f"{WITH}, {OUTCOMES} SELECT article_id, stage, 'failed' AS status, 'failed in ' || stage AS message FROM o JOIN articles USING (article_id) WHERE NOT ok")
def m17_logs(s, d):
    return cu.stage_outcomes(b.articles(s, d), _outcomes(s, d))[1]


@query("s13_canonical_counts", f"{WITH} SELECT article_id, count(*) AS n, count(DISTINCT product_key) AS products, count(*) FILTER (method = 'manual') AS n_manual, count(*) FILTER (method = 'rule') AS n_rule, count(*) FILTER (method = 'llm') AS n_llm FROM results GROUP BY article_id")
def s13(s, d):
    return cu.canonical_payload(b.results(s, d))


@query("j11_label_predictions", f"{WITH}, l AS (SELECT id AS label_id, id // 12 AS article_id, product_key FROM results), j AS (SELECT label_id, r.id AS prediction_id, direction, row_number() OVER (PARTITION BY label_id ORDER BY (r.product_key = l.product_key) DESC NULLS LAST, r.id) AS rn FROM l LEFT JOIN results r USING (article_id)) SELECT label_id, prediction_id, direction FROM j WHERE rn = 1")
def j11(s, d):
    labels = _segments(s, d).select(F.col("id").alias("label_id"), "article_id", "product_key")
    return cu.label_predictions(labels, b.results(s, d))


RUNS = "runs AS (SELECT article_id AS source_id, (['match', 'signal', 'rule', 'llm', 'review'])[id % 5 + 1] AS kind, CASE WHEN id % 5 = 3 THEN id % 3 ELSE 0 END AS retries, CASE WHEN id % 5 = 3 AND id % 2 = 0 THEN (['http_error', 'invalid_json'])[id % 4 // 2 + 1] END AS error_type FROM results)"


@query("a18_processing_stats", f"{WITH}, {RUNS}, e AS (SELECT source_id, string_agg(error_type || ':' || n, ',' ORDER BY error_type) AS errors FROM (SELECT source_id, error_type, count(*) AS n FROM runs WHERE error_type IS NOT NULL GROUP BY ALL) GROUP BY source_id) SELECT source_id, " + ", ".join(f"count(*) FILTER (kind = '{k}') AS {k}_count" for k in ("match", "signal", "rule", "llm", "review")) + ", sum(retries)::BIGINT AS llm_retry_count, count(*) FILTER (kind = 'llm' AND retries > 0 AND error_type IS NULL) AS llm_recovered_count, coalesce(any_value(errors), '') AS errors FROM runs LEFT JOIN e USING (source_id) GROUP BY source_id")
def a18(s, d):
    i = F.col("id")
    kinds, errors = F.array(*map(F.lit, ("match", "signal", "rule", "llm", "review"))), F.array(F.lit("http_error"), F.lit("invalid_json"))
    asked = i % 5 == 3
    runs = b.results(s, d).select(F.col("article_id").alias("source_id"), F.get(kinds, (i % 5).cast("int")).alias("kind"), F.when(asked, i % 3).otherwise(0).alias("retries"), F.when(asked & (i % 2 == 0), F.get(errors, F.floor(i % 4 / 2).cast("int"))).alias("error_type"))
    return analytics.processing_stats(runs)


_KINDS = "['pdf', 'image/png', '.HTML', 'application/pdf', 'text/plain', '', NULL]"
_MAP = lambda x: f"CASE {x} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ({k: k for k in ("pdf", "html", "image", "unknown")} | ph.MIME_TYPES | ph.EXTENSIONS).items()) + " END"
_BY_URL = "CASE e " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ph.EXTENSIONS.items()) + " END"


@query("s11_parser_types", f"{WITH}, x AS (SELECT article_id, ({_KINDS})[article_id % 7 + 1] AS k, regexp_extract(split_part(lower(file_url), '?', 1), '\\.([a-z0-9]+)\\z', 1) AS e FROM articles) SELECT article_id, coalesce({_MAP("ltrim(trim(lower(k)), '.')")}, {_BY_URL}, 'unknown') AS parser, coalesce({_BY_URL}, 'unknown') AS by_url FROM x")
def s11(s, d):
    said = F.get(F.array(*map(F.lit, ("pdf", "image/png", ".HTML", "application/pdf", "text/plain", "", None))), (F.col("article_id") % 7).cast("int"))
    return b.articles(s, d).select("article_id", ph.parser_type("file_url", said).alias("parser"), ph.parser_type("file_url").alias("by_url"))


@query(
    "w12_merged_spans",
    f"""WITH {WORDS}, {MENTIONS}, s AS (SELECT doc_id, product_key, pos, greatest(pos - 2, 0) AS start, pos + 3 AS stop FROM mentions WHERE product_key IS NOT NULL),
    f AS (SELECT *, coalesce(start > max(stop) OVER (PARTITION BY doc_id, product_key ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS fresh FROM s),
    g AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY doc_id, product_key ORDER BY pos ROWS UNBOUNDED PRECEDING) AS g FROM f)
    SELECT doc_id, product_key, min(start)::BIGINT AS start, max(stop)::BIGINT AS stop, count(*) AS hits FROM g GROUP BY doc_id, product_key, g""",
)
def w12(s, d):
    return text.merged_windows(text.mentions(_docs(s, d)), 2)


_STATUS = textual.oracle_sql()["l4_candidate_status"]


_RANK_SQL = "CASE status WHEN 'approved_seed' THEN 0 WHEN 'auto_approved' THEN 1 WHEN 'review_required' THEN 2 ELSE 3 END"


@query("a16_lexicon_report", f"WITH c AS ({_STATUS}) SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(DISTINCT suggested) FROM c WHERE status IN ('approved_seed', 'auto_approved')) AS entries, count(*) AS candidates, count(*) FILTER (status = 'approved_seed') AS approved_seed, count(*) FILTER (status = 'auto_approved') AS auto_approved, count(*) FILTER (status = 'review_required') AS review_required, count(*) FILTER (status = 'rejected') AS rejected, (SELECT string_agg(alias, ',' ORDER BY score DESC, alias) FROM (SELECT * FROM c WHERE status = 'review_required' ORDER BY score DESC, alias LIMIT 20)) AS first_reviews FROM c")
def a16(s, d):
    return cu.lexicon_report(textual.queries()["l4_candidate_status"](s, d), _docs(s, d))


@query("o3_candidate_order", f"SELECT alias, status, score FROM ({_STATUS}) ORDER BY {_RANK_SQL}, score DESC, alias")
def o3(s, d):
    return textual.queries()["l4_candidate_status"](s, d).select("alias", "status", "score").orderBy(cu.status_rank(), F.desc("score"), "alias")


def queries() -> dict:
    return _QUERIES


def oracle_sql() -> dict[str, str]:
    return _SQL
