"""Queries of the store's lists, filters and decisions, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstream.functions import evidence as ev
from quillstream.functions import phrases as ph
from quillstream.operators import merge
from quillstream.operators import store as st
from quillstream.packs import BOILERPLATE
from quillstream.plans.curated import SEGMENTS, _segments
from quillstream.plans.relational import COMPANY, TABS, WITH, _tabs
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


CATALOG = "catalog AS (SELECT CASE WHEN p_partkey % 9 = 0 THEN 'GROUP.' ELSE '' END || 'K' || p_partkey AS product_key, p_name AS display_name, p_brand AS symbol, p_partkey % 4 <> 0 AS active FROM part)"


def _catalog(s, d) -> DataFrame:
    key = F.col("p_partkey")
    return b.table(s, d, "part").select(F.concat(F.when(key % 9 == 0, "GROUP.").otherwise(""), F.lit("K"), key).alias("product_key"), F.col("p_name").alias("display_name"), F.col("p_brand").alias("symbol"), (key % 4 != 0).alias("active"))


@query("f6_active_catalog", f"WITH {CATALOG} SELECT product_key, display_name, symbol, NOT starts_with(product_key, 'GROUP.') AS concrete FROM catalog WHERE active")
def f6(s, d):
    rows = st.active_catalog(_catalog(s, d))
    concrete = st.active_catalog(_catalog(s, d), concrete=True).select("product_key", F.lit(True).alias("concrete"))
    return rows.join(concrete, "product_key", "left").select("product_key", "display_name", "symbol", F.coalesce("concrete", F.lit(False)).alias("concrete"))


@query("f8_resolution_list", f"{WITH}, {CATALOG}, q AS (SELECT * FROM queue WHERE status = 'pending' ORDER BY created_at, id LIMIT 50) SELECT id, q.product_key, display_name AS product_name FROM q LEFT JOIN catalog USING (product_key)")
def f8(s, d):
    return st.listed(b.review_queue(s, d), _catalog(s, d), "pending", 50).select("id", "product_key", "product_name")


_ITEM = "coalesce(nullif({x}->>'$.quote', ''), nullif({x}->>'$.text', ''), nullif({x}->>'$.excerpt', ''), '')"
_ARRAY = "list_transform(json_extract(e, '{path}'), lambda x: CASE WHEN json_type(x) = 'VARCHAR' THEN x->>'$' ELSE " + _ITEM.format(x="x") + " END)"
_OF_ONE = "[coalesce(nullif(e->>'$.quote', ''), nullif(e->>'$.text', ''), nullif(e->>'$.excerpt', ''), nullif(e->>'$.raw', ''), '')]"
_RAW = f"CASE json_type(e) WHEN 'VARCHAR' THEN [e->>'$'] WHEN 'ARRAY' THEN {_ARRAY.format(path='$[*]')} WHEN 'OBJECT' THEN CASE WHEN json_type(e, '$.excerpts') = 'ARRAY' THEN {_ARRAY.format(path='$.excerpts[*]')} ELSE {_OF_ONE} END ELSE [] END"
_TIDY = "trim(regexp_replace(v, '\\s+', ' ', 'g'))"
_MARKS = " + ".join(f"contains({_TIDY}, '{m}')::INT" for m in BOILERPLATE)
QUOTES = f"quoted AS (SELECT *, list_filter(list_transform({_RAW}, lambda v: CASE WHEN regexp_matches({_TIDY}, '(?i)^[a-z_][a-z0-9_:-]*$') OR {_MARKS} >= 2 THEN '' ELSE left({_TIDY}, 1200) END), lambda v: v <> '') AS quotes FROM (SELECT *, evidence::JSON AS e FROM queue))"


@query("x15_evidence_quotes", f"{WITH}, {QUOTES} SELECT id, len(quotes) AS n, coalesce(array_to_string(quotes, '|'), '') AS quotes FROM quoted")
def x15(s, d):
    quotes = ev.evidence_quotes("evidence")
    return b.review_queue(s, d).select("id", F.size(quotes).cast("long").alias("n"), F.array_join(quotes, "|").alias("quotes"))


_DOC_MARKS = ("the", "und", "de la", "que")


@query("x14_review_quotes", "SELECT doc_id, sha256(CASE WHEN regexp_matches(q, '(?i)^[a-z_][a-z0-9_:-]*$') OR " + " + ".join(f"contains(q, '{m}')::INT" for m in _DOC_MARKS) + " >= 2 THEN '' ELSE left(q, 1200) END) AS digest FROM (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS q FROM documents)")
def x14(s, d):
    return b.table(s, d, "documents").select("doc_id", F.sha2(ev.review_quote("text", _DOC_MARKS), 256).alias("digest"))


@query(
    "x16_normal_evidence",
    f"""{WITH}, {QUOTES} SELECT id, len(quotes) AS n, quotes[1] AS first, CASE WHEN json_type(e, '$.excerpts') = 'ARRAY' AND e->>'$.excerpts[0].source' = 'manual' THEN 'manual' END AS source, CASE WHEN json_type(e, '$.excerpts') = 'ARRAY' THEN 0 END AS start_char,
    CASE WHEN e->>'$.kind' IN ('verified', 'candidate_context') THEN e->>'$.kind' END AS kind, nullif(trim(e->>'$.notes'), '') AS notes, CASE WHEN json_type(e, '$.diagnostic') = 'OBJECT' THEN 'unexpected_error' END AS error_type,
    CASE WHEN json_type(e, '$.diagnostic') = 'OBJECT' THEN 'token=[REDACTED]' END AS message, CASE WHEN json_type(e, '$.diagnostic') = 'OBJECT' THEN 0 END AS attempts, CASE WHEN json_type(e, '$.diagnostic') = 'OBJECT' THEN 'invalid_json,unexpected_error' END AS parse_errors FROM quoted""",
)
def x16(s, d):
    rows = b.review_queue(s, d).select("id", ev.normal_evidence("evidence").alias("e"))
    first = F.get("e.excerpts", F.lit(0))
    return rows.select("id", F.size("e.excerpts").cast("long").alias("n"), first["quote"].alias("first"), first["source"].alias("source"), first["start_char"].alias("start_char"), "e.kind", "e.notes", "e.error_type", "e.message", "e.attempts", F.array_join("e.parse_errors", ",").alias("parse_errors"))


_STRIP = "regexp_replace({x}, '^\\s+|\\s+\\z', '', 'g')"
_SHORT = "CASE WHEN doc_id % 2 = 0 THEN replace(left(text, 200 + doc_id % 60), '. ', '。') ELSE replace(text, '. ', '。') END"
_CUT = "^([\\s\\S]*[。！？；;])([^。！？；;]*)\\z"


_TAIL = _STRIP.format(x=f"regexp_extract(x, '{_CUT}', 2)")


@query("x18_dangling_tails", f"WITH x AS (SELECT doc_id, {_STRIP.format(x=_SHORT)} AS x FROM documents), c AS (SELECT *, regexp_extract(x, '{_CUT}', 1) AS cut, {_TAIL} AS tail FROM x) SELECT doc_id, sha256(CASE WHEN regexp_matches(x, '[。！？；.!?;”’」』]\\z') OR cut = '' THEN x WHEN length(tail) <= 32 THEN cut ELSE x END) AS digest FROM c")
def x18(s, d):
    short = F.when(F.col("doc_id") % 2 == 0, F.replace(F.left("text", (200 + F.col("doc_id") % 60).cast("int")), F.lit(". "), F.lit("。"))).otherwise(F.replace("text", F.lit(". "), F.lit("。")))
    return b.table(s, d, "documents").select("doc_id", F.sha2(ev.without_dangling_tail(short), 256).alias("digest"))


@query(
    "f13_review_filters",
    f"""{WITH}, {QUOTES}, f AS (SELECT article_id, bool_or(product_key = 'K5') AS k, bool_or(reason = 'click') AS r, bool_or(len(quotes) = 0) AS m FROM quoted GROUP BY article_id)
    SELECT article_id, coalesce(k AND r, false) AS by_item, coalesce(m, false) AS missing, {COMPANY} = 'BUILDING' AS by_company, contains(lower(concat_ws(' ', title, coalesce(company, ''), coalesce(source, ''))), '5-low') AND contains(lower(concat_ws(' ', title, coalesce(company, ''), coalesce(source, ''))), 'customer') AS by_keyword
    FROM articles LEFT JOIN f USING (article_id)""",
)
def f13(s, d):
    articles, queue = b.articles(s, d), b.review_queue(s, d)
    out = articles.select("article_id")
    for name, wanted in (("by_item", {"product_key": "K5", "reason": "click"}), ("missing", {"missing_evidence": True}), ("by_company", {"company": "BUILDING"}), ("by_keyword", {"keyword": " 5-LOW customer "})):
        found = st.filtered_queue(articles, queue, **wanted).select("article_id", F.lit(True).alias(name))
        out = out.join(found, "article_id", "left")
    return out.na.fill(False)


_LABELS = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ph.REASONS.items())


@query(
    "a9_filter_options",
    f"""{WITH} SELECT DISTINCT 'company' AS kind, {COMPANY} AS value, {COMPANY} AS label FROM articles WHERE {COMPANY} <> ''
    UNION ALL SELECT 'product', q.product_key, arg_max(coalesce(nullif(product, ''), q.product_key), (article_id, id)) FROM queue q JOIN articles USING (article_id) WHERE q.product_key <> '' GROUP BY q.product_key
    UNION ALL SELECT DISTINCT 'reason', reason, coalesce(CASE split_part(reason, ':', 1) {_LABELS} END, nullif(reason, ''), '未知原因') FROM queue JOIN articles USING (article_id)""",
)
def a9_options(s, d):
    return st.filter_options(b.articles(s, d), b.review_queue(s, d))


_TIMED = f"{TABS}, timed AS (SELECT t.*, (SELECT max(reviewed_at) FROM queue q WHERE q.article_id = t.article_id) AS reviewed, (SELECT max(created_at) FROM logs l WHERE l.article_id = t.article_id AND stage = 'pipeline') AS log_time FROM tabs t WHERE tab IS NOT NULL)"


def _timed(s, d):
    logs = b.task_logs(s, d).filter("stage = 'pipeline'").groupBy("article_id").agg(F.max("created_at").alias("log_time"))
    return _tabs(s, d).join(logs, "article_id", "left")


for _tab, _order in (("error", "log_time DESC NULLS LAST, article_id DESC"), ("completed", "reviewed DESC NULLS LAST, article_id DESC")):

    @query(f"o2_{_tab}_order", f"{WITH}, {_TIMED} SELECT article_id, tab FROM timed WHERE tab = '{_tab}' ORDER BY {_order} LIMIT 30")
    def o2(s, d, tab=_tab):
        return st.ordered_tab(_timed(s, d), tab).limit(30).select("article_id", "tab")


@query("o2_oldest_order", f"{WITH}, {_TIMED} SELECT article_id FROM timed WHERE tab = 'pending' ORDER BY oldest, article_id LIMIT 30")
def o2_oldest(s, d):
    return st.ordered_tab(_timed(s, d), "pending", "oldest").limit(30).select("article_id")


@query("o4_reprocessable", f"{WITH}, {QUOTES} SELECT article_id, min(id) AS item_id FROM quoted WHERE status = 'pending' AND split_part(reason, ':', 1) IN ('click', 'error') AND len(quotes) = 0 GROUP BY article_id ORDER BY article_id LIMIT 40")
def o4(s, d):
    return st.reprocessable(b.review_queue(s, d), 40, ("click", "error"))


@query("o7_products_by_name")
def o7(s, d):
    return st.by_name(b.results(s, d).select("product").distinct())


@query(
    "v2_payload_violations",
    f"""{WITH}, r AS (SELECT article_id, row_number() OVER (PARTITION BY article_id ORDER BY id) - 1 AS place, CASE WHEN id % 7 = 0 THEN ' ' ELSE product_key END AS product_key, CASE WHEN id % 11 = 0 THEN 'up' ELSE direction END AS direction, CASE WHEN id % 13 = 0 THEN 'guess' ELSE method END AS method, CASE WHEN id % 17 = 0 THEN confidence + 1 ELSE confidence END AS confidence FROM results),
    q AS (SELECT article_id, row_number() OVER (PARTITION BY article_id ORDER BY id) - 1 AS place, CASE id % 3 WHEN 0 THEN 'http_error' WHEN 1 THEN reason END AS error_type FROM queue), p AS (SELECT DISTINCT article_id FROM results)
    SELECT CASE WHEN article_id % 19 = 0 THEN '' ELSE article_id::VARCHAR END AS source_id, NULL::INT AS place, 'source_id' AS rule FROM p WHERE article_id % 19 = 0
    UNION ALL SELECT CASE WHEN article_id % 19 = 0 THEN '' ELSE article_id::VARCHAR END, NULL, 'document.title' FROM p WHERE article_id % 23 = 0
    UNION ALL SELECT CASE WHEN article_id % 19 = 0 THEN '' ELSE article_id::VARCHAR END, place, unnest(list_filter([CASE WHEN trim(product_key) = '' THEN 'product_key' END, CASE WHEN direction NOT IN ('看涨', '看跌', '中性') THEN 'direction' END, CASE WHEN method NOT IN ('rule', 'llm', 'manual') THEN 'analysis_method' END, CASE WHEN confidence NOT BETWEEN 0 AND 1 THEN 'confidence' END], lambda v: v IS NOT NULL)) FROM r
    UNION ALL SELECT CASE WHEN article_id % 19 = 0 THEN '' ELSE article_id::VARCHAR END, place, 'diagnostic.error_type' FROM q JOIN p USING (article_id) WHERE error_type IS NOT NULL AND error_type NOT IN {ev.ERROR_TYPES}""",
)
def v2(s, d):
    i = F.col("id")
    result = F.struct(i, F.when(i % 7 == 0, " ").otherwise(F.col("product_key")).alias("product_key"), F.when(i % 11 == 0, "up").otherwise(F.col("direction")).alias("direction"), F.when(i % 13 == 0, "guess").otherwise(F.col("method")).alias("method"), F.when(i % 17 == 0, F.col("confidence") + 1).otherwise(F.col("confidence")).alias("confidence"))
    review = F.struct(i, F.when(i % 3 == 0, "http_error").when(i % 3 == 1, F.col("reason")).alias("error_type"))
    payloads = b.results(s, d).groupBy("article_id").agg(F.array_sort(F.collect_list(result)).alias("results"))
    payloads = payloads.join(b.review_queue(s, d).groupBy("article_id").agg(F.array_sort(F.collect_list(review)).alias("reviews")), "article_id", "left")
    a = F.col("article_id")
    return st.payload_violations(payloads.select(F.when(a % 19 == 0, "").otherwise(a.cast("string")).alias("source_id"), F.when(a % 23 == 0, " ").otherwise("t").alias("title"), "results", "reviews"), ev.ERROR_TYPES)


ANSWERS = "answers AS (SELECT id AS line_no, 'b' || (id % 400) AS block_ref, product_key FROM results WHERE id % 3 = 0), blocks AS (SELECT DISTINCT 'b' || (user_id % 300) AS block_ref FROM events)"


def _answers(s, d):
    answers = b.results(s, d).filter("id % 3 = 0").select(F.col("id").alias("line_no"), F.concat(F.lit("b"), F.col("id") % 400).alias("block_ref"), "product_key")
    return b.table(s, d, "events").select(F.concat(F.lit("b"), F.col("user_id") % 300).alias("block_ref")).distinct(), answers


@query("j10_block_answers", f"{WITH}, {ANSWERS}, u AS (SELECT * FROM answers QUALIFY row_number() OVER (PARTITION BY block_ref ORDER BY line_no) = 1) SELECT block_ref, line_no, product_key FROM blocks LEFT JOIN u USING (block_ref)")
def j10(s, d):
    return st.block_answers(*_answers(s, d))[0].select("block_ref", "line_no", "product_key")


@query("j10_answer_errors", f"{WITH}, {ANSWERS}, u AS (SELECT *, row_number() OVER (PARTITION BY block_ref ORDER BY line_no) AS n, block_ref IN (SELECT block_ref FROM blocks) AS known FROM answers) SELECT line_no, block_ref, CASE WHEN NOT known THEN 'unknown' ELSE 'duplicate' END AS error FROM u WHERE NOT known OR n > 1")
def j10_errors(s, d):
    return st.block_answers(*_answers(s, d))[1]


_TEXTS = f"{SEGMENTS}, texts AS (SELECT s.*, CASE id % 4 WHEN 0 THEN '' WHEN 1 THEN reason || ' is ' || product || ' 看涨' WHEN 2 THEN 'view of product，' || reason || ' 较昨日' ELSE 'nothing here 同比' END AS text, CASE id % 4 WHEN 0 THEN '05' WHEN 1 THEN '09' ELSE '' END AS contract_key FROM segments s)"
_COMPACT = "regexp_replace(text, '\\s+', '', 'g')"
_SCORE = f"CASE WHEN trim(text) = '' THEN -100 ELSE CASE WHEN reason <> '' AND contains(text, reason) THEN 100 ELSE 0 END + 12 * len(list_filter(list_distinct(list_filter(string_split_regex(reason, '[。！？；;，,、\\n\\s]+'), lambda x: length(x) >= 4)), lambda t: contains(text, t))) + CASE WHEN direction <> '' AND contains(text, direction) THEN 4 ELSE 0 END - CASE WHEN {_COMPACT} = '' OR (length({_COMPACT}) < 120 AND regexp_matches({_COMPACT}, '(?:跌幅|涨幅|同比|环比|产地|等待|较上周|较昨日|达到)$')) THEN 80 ELSE 0 END END"


def _texts(s, d):
    i = F.col("id")
    text = F.when(i % 4 == 0, "").when(i % 4 == 1, F.concat("reason", F.lit(" is "), "product", F.lit(" 看涨"))).when(i % 4 == 2, F.concat(F.lit("view of product，"), "reason", F.lit(" 较昨日"))).otherwise("nothing here 同比")
    return _segments(s, d).withColumns({"text": text, "contract_key": F.when(i % 4 == 0, "05").when(i % 4 == 1, "09").otherwise("")})


@query("w5_reason_scores", f"{WITH}, {_TEXTS}, t AS (SELECT t.id, t.text, r.reason, r.direction FROM texts t JOIN results r ON r.id = t.id + t.id % 3) SELECT id, {_SCORE} AS score FROM t")
def w5(s, d):
    other = b.results(s, d).select(F.col("id").alias("other"), "reason", "direction")
    rows = _texts(s, d).select("id", "text", (F.col("id") + F.col("id") % 3).alias("other")).join(other, "other")
    return rows.select("id", st.reason_score(F.col("reason"), F.col("direction"), F.col("text")).alias("score"))


_ASKED = "asked AS (SELECT id AS result_id, article_id, CASE WHEN id % 6 = 0 THEN '' ELSE product_key END AS product_key, product, contract_key, direction, reason FROM results)"


@query(
    "j9_supported_segments",
    f"""{WITH}, {_TEXTS}, {_ASKED}, j AS (SELECT result_id, t.id AS segment_id, a.contract_key <> '' AND t.contract_key = a.contract_key AS exact, section, t.confidence, segment_index, t.text, a.reason, a.direction
      FROM asked a JOIN texts t ON a.article_id = t.article_id AND ((a.product_key <> '' AND t.product_key = a.product_key) OR (a.product_key = '' AND t.product = a.product)) WHERE section <> 'unknown'),
    s AS (SELECT *, {_SCORE} AS score FROM j), b AS (SELECT result_id, segment_id, score FROM s QUALIFY row_number() OVER (PARTITION BY result_id ORDER BY exact DESC, score DESC, CASE section WHEN 'core' THEN 0 WHEN 'ocr' THEN 1 WHEN 'ai' THEN 2 WHEN 'table' THEN 3 WHEN 'mixed' THEN 4 ELSE 9 END, confidence DESC, segment_index, segment_id) = 1)
    SELECT result_id, segment_id, score FROM asked LEFT JOIN b USING (result_id)""",
)
def j9(s, d):
    blanked = F.when(F.col("id") % 6 == 0, "").otherwise(F.col("product_key"))
    return st.best_segments(b.results(s, d).withColumn("product_key", blanked), _texts(s, d))


# --- decisions

RESOLUTIONS = f"{CATALOG}, resolutions AS (SELECT id, article_id, segment_index, reason AS raw_name, product_key, 'pending' AS status, 'llm' AS method, confidence FROM segments WHERE id % 5 = 0), decided AS (SELECT id, 'K' || (id % 300) AS chosen, 'ann' AS reviewer FROM segments WHERE id % 10 = 0 OR id % 97 = 1)"


def _resolutions(s, d):
    rows = _segments(s, d).filter("id % 5 = 0").select("id", "article_id", "segment_index", F.col("reason").alias("raw_name"), "product_key", F.lit("pending").alias("status"), F.lit("llm").alias("method"), "confidence")
    decided = _segments(s, d).filter("id % 10 = 0 OR id % 97 = 1").select("id", F.concat(F.lit("K"), F.col("id") % 300).alias("product_key"), F.lit("ann").alias("reviewer"))
    return st.confirmed_resolutions(rows, decided, _catalog(s, d))


_GOOD = "good AS (SELECT d.id, chosen FROM decided d JOIN resolutions USING (id) WHERE chosen IN (SELECT product_key FROM catalog)), confirmed AS (SELECT r.id, article_id, segment_index, coalesce(chosen, product_key) AS product_key, CASE WHEN chosen IS NOT NULL THEN 'confirmed' ELSE status END AS status, CASE WHEN chosen IS NOT NULL THEN 'manual' ELSE method END AS method, CASE WHEN chosen IS NOT NULL THEN 1.0 ELSE confidence END AS confidence, chosen IS NOT NULL AS hit FROM resolutions r LEFT JOIN good USING (id))"


@query("m10_confirmed_resolutions", f"{WITH}, {SEGMENTS}, {RESOLUTIONS}, {_GOOD} SELECT id, product_key, status, method, round(confidence, 6) AS confidence FROM confirmed")
def m10(s, d):
    return _resolutions(s, d)[0].select("id", "product_key", "status", "method", F.round("confidence", 6).alias("confidence"))


@query("m10_errors", f"{WITH}, {SEGMENTS}, {RESOLUTIONS} SELECT id, CASE WHEN id NOT IN (SELECT id FROM resolutions) THEN 'resolution not found' ELSE 'unknown product_key' END AS error FROM decided WHERE id NOT IN (SELECT id FROM resolutions) OR chosen NOT IN (SELECT product_key FROM catalog)")
def m10_errors(s, d):
    return _resolutions(s, d)[1]


def _after(s, d):
    return st.after_confirmation(_resolutions(s, d)[0], _segments(s, d).withColumn("method", F.lit("llm")), b.results(s, d), b.articles(s, d))


@query("m10_segments", f"{WITH}, {SEGMENTS}, {RESOLUTIONS}, {_GOOD}, k AS (SELECT article_id, segment_index, arg_max(product_key, id) AS k FROM confirmed WHERE hit GROUP BY ALL) SELECT id, coalesce(k, product_key) AS product_key, CASE WHEN k IS NULL THEN 'llm' ELSE 'manual' END AS method FROM segments LEFT JOIN k USING (article_id, segment_index)")
def m10_segments(s, d):
    return _after(s, d)[0].select("id", "product_key", "method")


@query("m10_results_left", f"{WITH}, {SEGMENTS}, {RESOLUTIONS}, {_GOOD} SELECT id FROM results WHERE method = 'manual' OR article_id NOT IN (SELECT article_id FROM confirmed WHERE hit)")
def m10_results(s, d):
    return _after(s, d)[1].select("id")


@query("m10_articles", f"{WITH}, {SEGMENTS}, {RESOLUTIONS}, {_GOOD} SELECT article_id, CASE WHEN article_id IN (SELECT article_id FROM confirmed WHERE hit) THEN 2 ELSE status END AS status FROM articles")
def m10_articles(s, d):
    return _after(s, d)[2].select("article_id", "status")


REJECTED = "decided AS (SELECT id, CASE id % 16 WHEN 0 THEN ' ' ELSE 'bob' END AS reviewer, CASE id % 20 WHEN 4 THEN 'because' ELSE 'duplicate' END AS code FROM queue WHERE id % 8 = 0 UNION ALL SELECT -1, 'bob', 'other'), judged AS (SELECT d.id, CASE WHEN trim(reviewer) = '' OR code NOT IN ('navigation_noise', 'not_futures_product', 'no_analysis_content', 'duplicate', 'other') THEN 'a reviewer and a valid reason are required' WHEN status IS NULL THEN 'review item not found' WHEN status = 'resolved' THEN 'resolved items cannot be rejected' END AS error FROM decided d LEFT JOIN queue q USING (id))"


def _rejected(s, d):
    i = F.col("id")
    rows = b.review_queue(s, d)
    decided = rows.filter("id % 8 = 0").select("id", F.when(i % 16 == 0, " ").otherwise("bob").alias("reviewer"), F.when(i % 20 == 4, "because").otherwise("duplicate").alias("code"))
    return st.rejections(rows, decided.unionByName(s.range(1).select(F.lit(-1).cast("long").alias("id"), F.lit("bob").alias("reviewer"), F.lit("other").alias("code"))))


@query("m12_rejected_items", f"{WITH}, {REJECTED} SELECT id, CASE WHEN id IN (SELECT id FROM judged WHERE error IS NULL) THEN 'rejected' ELSE status END AS status FROM queue")
def m12(s, d):
    return _rejected(s, d)[0].select("id", "status")


@query("m12_rejection_errors", f"{WITH}, {REJECTED} SELECT id, error FROM judged WHERE error IS NOT NULL")
def m12_errors(s, d):
    return _rejected(s, d)[1]


CONCLUDED = f"""{CATALOG}, decided AS (SELECT id, CASE WHEN id % 20 = 0 THEN 'up' ELSE '看涨' END AS direction, CASE WHEN id % 28 = 0 THEN ' ' ELSE reason END AS reason, 'seen' AS evidence, 'K' || (id % 150) AS product_key, CASE WHEN id % 44 = 0 THEN '' ELSE 'eve' END AS reviewer FROM queue WHERE id % 12 = 0),
    judged AS (SELECT d.*, q.article_id, q.status, c.display_name, CASE WHEN d.direction NOT IN ('看涨', '看跌', '中性') THEN 'invalid direction' WHEN trim(d.reason) = '' OR evidence = '' THEN 'direction, reason and evidence are required' WHEN reviewer = '' THEN 'a reviewer is required' WHEN q.status IS NULL THEN 'review item not found' WHEN q.status <> 'pending' THEN 'only pending items can be concluded' WHEN c.display_name IS NULL THEN 'an active product is required' END AS error
    FROM (SELECT * RENAME (evidence AS evidence) FROM decided) d LEFT JOIN (SELECT id, article_id, status FROM queue) q USING (id) LEFT JOIN (SELECT * FROM catalog WHERE active AND NOT starts_with(product_key, 'GROUP.')) c ON c.product_key = d.product_key)"""


def _concluded(s, d):
    i = F.col("id")
    rows = b.review_queue(s, d)
    decided = rows.filter("id % 12 = 0").select("id", F.when(i % 20 == 0, "up").otherwise("看涨").alias("direction"), F.when(i % 28 == 0, " ").otherwise(F.col("reason")).alias("reason"), F.lit("seen").alias("evidence"), F.concat(F.lit("K"), i % 150).alias("product_key"), F.when(i % 44 == 0, "").otherwise("eve").alias("reviewer"))
    return st.conclusions(rows, decided, _catalog(s, d))


@query("m12_conclusions", f"{WITH}, {CONCLUDED} SELECT article_id, product_key, display_name AS product, trim(reason) AS reason, 1.0::DOUBLE AS confidence, 'manual' AS method FROM judged WHERE error IS NULL")
def m12_conclusions(s, d):
    return _concluded(s, d)[0].select("article_id", "product_key", "product", "reason", "confidence", "method")


@query("m12_concluded_items", f"{WITH}, {CONCLUDED} SELECT id, CASE WHEN id IN (SELECT id FROM judged WHERE error IS NULL) THEN 'resolved' ELSE status END AS status FROM queue")
def m12_items(s, d):
    return _concluded(s, d)[2].select("id", "status")


@query("m12_conclusion_errors", f"{WITH}, {CONCLUDED} SELECT id, error FROM judged WHERE error IS NOT NULL")
def m12_conclusion_errors(s, d):
    return _concluded(s, d)[3]


@query("m13_imported_articles", f"{WITH}, known AS (SELECT article_id, file_url FROM articles WHERE article_id % 3 <> 0), fresh AS (SELECT file_url, row_number() OVER (ORDER BY file_url) AS n FROM articles WHERE article_id % 3 = 0) SELECT article_id, file_url AS source_id, 'found' AS change FROM known WHERE article_id % 2 = 0 UNION ALL SELECT (SELECT max(article_id) FROM known) + n, file_url, 'created' FROM fresh")
def m13(s, d):
    rows = b.articles(s, d)
    return st.imported(rows.filter("article_id % 3 <> 0"), rows.filter("article_id % 2 = 0 OR article_id % 3 = 0").select(F.col("file_url").alias("source_id")))


@query("m13_imported_segments", f"{WITH}, r AS (SELECT article_id, row_number() OVER (PARTITION BY article_id ORDER BY id) - 1 AS segment_index, product_key, CASE WHEN id % 4 = 0 THEN '' WHEN id % 4 = 1 THEN reason ELSE reason || chr(10) || direction END AS text FROM results) SELECT article_id::VARCHAR AS source_id, segment_index, product_key, coalesce(nullif(r.text, ''), left('text of ' || article_id, 600)) AS text FROM r")
def m13_segments(s, d):
    i = F.col("id")
    quotes = F.when(i % 4 == 0, F.array(F.lit(" "))).when(i % 4 == 1, F.array("reason", F.lit(""))).otherwise(F.array("reason", "direction"))
    payloads = b.results(s, d).groupBy("article_id").agg(F.array_sort(F.collect_list(F.struct("id", "product_key", quotes.alias("quotes")))).alias("results"))
    return st.segments_of(payloads.select(F.col("article_id").cast("string").alias("source_id"), F.concat(F.lit("text of "), "article_id").alias("text"), "results"))


# --- streams

@query(
    "r3_rerun_reviews",
    f"""{WITH}, n AS (SELECT * FROM queue QUALIFY row_number() OVER (PARTITION BY article_id, item_key ORDER BY id DESC) = 1), o AS (SELECT * FROM queue WHERE id % 12 = 0 QUALIFY row_number() OVER (PARTITION BY article_id, item_key ORDER BY id DESC) = 1)
    SELECT article_id, item_key, coalesce(o.id, n.id) AS id, CASE WHEN o.status IN ('resolved', 'rejected') THEN o.status ELSE 'pending' END AS status FROM n LEFT JOIN o USING (article_id, item_key)""",
)
def r3(s, d):
    queue = b.review_queue(s, d)
    start = merge.one_per_key(queue.filter("id % 12 = 0"), ["article_id", "item_key"]).select("article_id", "item_key", "id", "reason", "status")
    incoming = merge.one_per_key(queue, ["article_id", "item_key"]).select("article_id", "item_key", "id", "reason", "status")
    # the same run twice over: the second changes nothing
    once = jobs.applied(jobs.as_stream(incoming), start, merge.upsert_reviews)
    return jobs.applied(jobs.as_stream(incoming), once, merge.upsert_reviews).select("article_id", "item_key", "id", "status")


@query("r5_isolated_failures", "SELECT doc_id, contains(text, 'tion') AS ok, CASE WHEN contains(text, 'tion') THEN length(text) END AS value, CASE WHEN NOT contains(text, 'tion') THEN 'ValueError: no tion' END AS error FROM documents")
def r5(s, d):
    def measure(text: str) -> int:
        if "tion" not in text:
            raise ValueError("no tion")
        return len(text)

    return jobs.isolated(b.table(s, d, "documents"), "text", measure, "long")


@query("r1_batch_summary", "SELECT count(*) AS scanned, count(*) FILTER (value >= 1) AS kept, count(*) FILTER (value < 1) AS failed FROM events")
def r1_summary(s, d):
    rows, summary = jobs.in_batches(jobs.arrivals(s, d, "events"), lambda batch: batch.select("event_id", "event_type", (F.col("value") >= 1).alias("ok")), ok="ok")
    return summary.agg(F.sum("scanned").alias("scanned"), F.sum("kept").alias("kept"), F.sum("failed").alias("failed"))


def queries() -> dict:
    return _QUERIES


def oracle_sql() -> dict[str, str]:
    return _SQL
