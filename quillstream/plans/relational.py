"""Queries of the relational, merge and ingest operators, each with its SQL."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstream.functions import columns as fn
from quillstream.operators import analytics, ingest, merge
from quillstream.sources import bindings as b

WITH = f"WITH {b.SQL}"
SHOWN = "coalesce(trim(product) <> '' AND trim(product) <> '未知', false)"
FORMAL = f"({SHOWN} AND NOT need_manual_review)"
COMPANY = "coalesce(nullif(company, ''), nullif(source, ''), '')"
BEST = f"""best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY article_id, coalesce(nullif(product_key, ''), product)
  ORDER BY is_primary DESC, confidence DESC, id DESC) AS rn FROM results WHERE {FORMAL}) WHERE rn = 1)"""
JOINED = f"joined AS (SELECT r.*, a.publish_time, a.company, a.source FROM results r JOIN articles a USING (article_id) WHERE a.status = 5 AND {FORMAL})"
DAY = "CAST(CAST(coalesce(publish_time, analysis_time) AS DATE) AS VARCHAR)"
SIGNED = "CASE direction WHEN '看涨' THEN confidence WHEN '看跌' THEN -confidence ELSE 0 END"
TODAY = date(1995, 3, 17)

_QUERIES: dict = {}
_SQL: dict[str, str] = {}


def dated(df: DataFrame, *names: str) -> DataFrame:
    """Dates as text, which every engine writes alike."""
    return df.withColumns({n: F.col(n).cast("string") for n in names})


def query(name: str, sql: str | None):
    def add(f):
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return add


@query("a3_trend_heatmap", f"{WITH}, {JOINED} SELECT {DAY} AS day, product_key, product, round(avg({SIGNED}), 4) AS value, count(*) AS n FROM joined WHERE coalesce(publish_time, analysis_time) IS NOT NULL GROUP BY ALL")
def a3(s, d):
    return dated(analytics.trend_heatmap(b.results(s, d), b.articles(s, d)), "day")


@query(
    "a3_trend_heatmap_range",
    f"""{WITH}, {JOINED} SELECT {DAY} AS day, product_key, product, round(avg({SIGNED}), 4) AS value, count(*) AS n FROM joined
    WHERE (publish_time >= TIMESTAMP '1996-01-01' OR analysis_time >= TIMESTAMP '1996-01-01') AND (publish_time <= TIMESTAMP '1998-01-01' OR analysis_time <= TIMESTAMP '1998-01-01') GROUP BY ALL""",
)
def a3_range(s, d):
    return dated(analytics.trend_heatmap(b.results(s, d), b.articles(s, d), datetime(1996, 1, 1), datetime(1998, 1, 1)), "day")


@query(
    "a2_trend_counts_range",
    f"""{WITH}, {JOINED} SELECT {DAY} AS day, product, direction, count(*) AS n FROM joined WHERE coalesce(publish_time, analysis_time) >= TIMESTAMP '1996-01-01' AND coalesce(publish_time, analysis_time) <= TIMESTAMP '1998-01-01' GROUP BY ALL""",
)
def a2_range(s, d):
    return dated(analytics.trend_counts(b.results(s, d), b.articles(s, d), datetime(1996, 1, 1), datetime(1998, 1, 1)), "day")


@query("a2_trend_counts", f"{WITH}, {JOINED} SELECT {DAY} AS day, product, direction, count(*) AS n FROM joined GROUP BY ALL")
def a2(s, d):
    return dated(analytics.trend_counts(b.results(s, d), b.articles(s, d)), "day")


@query(
    "a7_heatmap_matrix",
    f"""{WITH}, {JOINED}, trend AS (SELECT {DAY} AS day, product_key, product, round(avg({SIGNED}), 4) AS value, count(*) AS n FROM joined GROUP BY ALL),
    top AS (SELECT product FROM trend GROUP BY product ORDER BY count(*) DESC, product LIMIT 5)
    SELECT *, CASE WHEN value > 0.3 THEN 'up' WHEN value < -0.3 THEN 'down' ELSE 'flat' END AS label FROM trend WHERE value <> 0 AND product IN (SELECT product FROM top)""",
)
def a7(s, d):
    return analytics.heatmap_matrix(a3(s, d))


COUNTS = "count(*) FILTER (direction = '看涨') AS bullish, count(*) FILTER (direction = '看跌') AS bearish, count(*) FILTER (direction = '中性') AS neutral"


@query("a6_direction_counts", f"{WITH} SELECT product, {COUNTS} FROM results WHERE {FORMAL} GROUP BY product")
def a6(s, d):
    return analytics.direction_counts(b.results(s, d))


@query(
    "a1_dashboard",
    f"""{WITH}, a AS (SELECT count(*) FILTER (CAST(created_at AS DATE) = DATE '{TODAY}') AS today, count(*) AS total, count(*) FILTER (status = 5) AS stored, count(*) FILTER (status = -1) AS failed FROM articles),
    s AS (SELECT article_id FROM articles WHERE status = 5),
    r AS (SELECT count(*) FILTER ({SHOWN} AND need_manual_review) AS flagged, count(*) FILTER ({FORMAL} AND direction = '看涨') AS bullish, count(*) FILTER ({FORMAL} AND direction = '看跌') AS bearish, count(*) FILTER ({FORMAL} AND direction = '中性') AS neutral FROM results WHERE article_id IN (SELECT article_id FROM s)),
    q AS (SELECT count(*) AS pending FROM queue WHERE status = 'pending' AND article_id IN (SELECT article_id FROM s))
    SELECT today, total, stored, failed, bullish, bearish, neutral, round(stored / total, 6) AS success_rate, flagged + pending AS manual_review FROM a, r, q""",
)
def a1(s, d):
    return analytics.dashboard(b.articles(s, d), b.results(s, d), b.review_queue(s, d), TODAY)


def _rolled(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*names, "id", "position", F.round("confidence", 6).alias("confidence"), "direction")


@query("a4_company_roll_up", f"{WITH}, {BEST} SELECT {COMPANY} AS company_name, id, row_number() OVER (PARTITION BY {COMPANY} ORDER BY publish_time DESC NULLS LAST, id DESC) AS position, round(confidence, 6) AS confidence, direction FROM best JOIN articles USING (article_id) WHERE status = 5")
def a4(s, d):
    return _rolled(analytics.company_roll_up(b.results(s, d), b.articles(s, d)), "company_name")


@query("a5_product_roll_up", f"{WITH}, {BEST} SELECT product_key, product, id, row_number() OVER (PARTITION BY product_key, product ORDER BY publish_time DESC NULLS LAST, id DESC) AS position, round(confidence, 6) AS confidence, direction FROM best JOIN articles USING (article_id) WHERE status = 5")
def a5(s, d):
    return _rolled(analytics.product_roll_up(b.results(s, d), b.articles(s, d)), "product_key", "product")


@query("o6_first_predictions", f"{WITH}, {BEST}, p AS (SELECT product, id, row_number() OVER (PARTITION BY product_key, product ORDER BY publish_time DESC NULLS LAST, id DESC) AS position FROM best JOIN articles USING (article_id) WHERE status = 5) SELECT * FROM p WHERE position <= 8")
def o6(s, d):
    return analytics.first_predictions(b.results(s, d), b.articles(s, d)).select("product", "id", "position")


@query("a8_confidence_bands", f"{WITH} SELECT CASE WHEN confidence >= 0.7 THEN 'high' WHEN confidence >= 0.5 THEN 'mid' ELSE 'low' END AS band, count(*) AS n FROM results GROUP BY ALL")
def a8(s, d):
    return b.results(s, d).groupBy(fn.confidence_band("confidence").alias("band")).agg(F.count("*").alias("n"))


@query("w1_best_prediction", f"{WITH}, {BEST} SELECT article_id, product_key, id FROM best")
def w1(s, d):
    return analytics.best_predictions(b.results(s, d).filter(fn.formal())).select("article_id", "product_key", "id")


@query("w2_primary_result", f"{WITH} SELECT article_id, id FROM (SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY is_primary DESC, CASE WHEN is_primary THEN 0 ELSE -confidence END, id) AS rn FROM results) WHERE rn = 1")
def w2(s, d):
    return analytics.primary_results(b.results(s, d)).select("article_id", "id")


@query("w3_latest_log", f"{WITH} SELECT article_id, max(id) AS log_id, arg_max(status, id) AS log_status FROM logs WHERE stage = 'pipeline' GROUP BY article_id")
def w3(s, d):
    return analytics.latest_log(b.task_logs(s, d))


@query("w6_first_primary", f"{WITH} SELECT id, min(id) OVER (PARTITION BY article_id) = id AS is_primary FROM results")
def w6(s, d):
    return merge.first_primary(b.results(s, d)).select("id", "is_primary")


@query("w7_elected_primary", f"{WITH} SELECT id, row_number() OVER (PARTITION BY article_id ORDER BY (is_primary AND method = 'manual') DESC, is_primary DESC, confidence DESC, id) = 1 AS is_primary FROM results")
def w7(s, d):
    return merge.elect_primary(b.results(s, d)).select("id", "is_primary")


@query("f1_displayable", f"{WITH} SELECT id FROM results WHERE {SHOWN}")
def f1(s, d):
    return b.results(s, d).filter(fn.displayable()).select("id")


@query("f2_formal", f"{WITH} SELECT id FROM results WHERE {FORMAL}")
def f2(s, d):
    return b.results(s, d).filter(fn.formal()).select("id")


@query(
    "f3_article_search",
    f"""{WITH}, f AS (SELECT article_id, bool_or({SHOWN}) AS shown, bool_or({SHOWN} AND product = 'P5') AS p, bool_or({SHOWN} AND direction = '看涨') AS d FROM results GROUP BY article_id)
    SELECT article_id FROM articles JOIN f USING (article_id) WHERE shown AND p AND d""",
)
def f3(s, d):
    return analytics.search_articles(b.articles(s, d), b.results(s, d), product="P5", direction="看涨").select("article_id")


_WIDE = "status = 5 AND publish_time >= TIMESTAMP '1993-01-01' AND publish_time <= TIMESTAMP '1997-06-30 12:00:00'"
_KEYED = f"f AS (SELECT article_id, bool_or({SHOWN}) AS shown, bool_or({SHOWN} AND product_key = 'K5') AS k FROM results GROUP BY article_id)"


def _searched(s, d):
    return analytics.search_articles(b.articles(s, d), b.results(s, d), product_key="K5", status=5, since=datetime(1993, 1, 1), until=datetime(1997, 6, 30, 12))


@query("f3_article_range", f"{WITH}, {_KEYED} SELECT article_id FROM articles JOIN f USING (article_id) WHERE shown AND k AND {_WIDE}")
def f3_range(s, d):
    return _searched(s, d).select("article_id")


@query("f3_total", f"{WITH}, {_KEYED} SELECT count(*) AS total FROM articles JOIN f USING (article_id) WHERE shown AND k AND {_WIDE}")
def f3_total(s, d):
    return _searched(s, d).agg(F.count("*").alias("total"))


@query(
    "f3_article_keyword",
    f"""{WITH}, f AS (SELECT article_id, bool_or({SHOWN}) AS shown, bool_or({SHOWN} AND contains(lower(reason), 'click 1')) AS k FROM results GROUP BY article_id)
    SELECT article_id FROM articles LEFT JOIN f USING (article_id) WHERE coalesce(shown, true) AND (contains(lower(title), 'click 1') OR contains(lower(source), 'click 1') OR coalesce(contains(lower(company), 'click 1'), false) OR coalesce(k, false))""",
)
def f3_keyword(s, d):
    return analytics.search_articles(b.articles(s, d), b.results(s, d), keyword="click 1").select("article_id")


@query("f4_finalized_result", f"{WITH} SELECT r.id FROM results r JOIN articles a USING (article_id) WHERE a.status = 5 AND {FORMAL}")
def f4(s, d):
    return b.results(s, d).filter(fn.formal()).join(b.articles(s, d).filter("status = 5").select("article_id"), "article_id").select("id")


@query("f5_pending_pick", f"{WITH} SELECT article_id FROM articles WHERE status = 0 ORDER BY created_at, article_id LIMIT 20")
def f5(s, d):
    return b.articles(s, d).filter("status = 0").orderBy("created_at", "article_id").limit(20).select("article_id")


@query(
    "f7_list_rows",
    f"""{WITH}, top AS (SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY CASE WHEN is_primary THEN 0 ELSE 1 END, product, contract_key, id) AS rn FROM results WHERE {SHOWN}),
    s AS (SELECT article_id, string_agg(product || CASE WHEN contract_key <> '' THEN contract_key || ' ' ELSE '' END || direction || ' ' || printf('%.2f', confidence), '；' ORDER BY rn) AS t FROM top WHERE rn <= 4 GROUP BY article_id)
    SELECT article_id, {COMPANY} AS company, coalesce(t, left(title, 120)) AS summary FROM articles LEFT JOIN s USING (article_id)""",
)
def f7(s, d):
    return analytics.list_rows(b.articles(s, d), b.results(s, d))


TABS = """items AS (SELECT article_id, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'resolved') AS resolved, count(*) FILTER (status = 'rejected') AS rejected, min(created_at) AS oldest FROM queue GROUP BY article_id),
  last AS (SELECT article_id, arg_max(status, id) AS log_status FROM logs WHERE stage = 'pipeline' GROUP BY article_id),
  tabs AS (SELECT a.article_id, pending, resolved, rejected, oldest, CASE WHEN a.status = -1 OR log_status IN ('failed', 'partial') THEN 'error' WHEN pending > 0 THEN 'pending' WHEN resolved > 0 THEN 'completed' WHEN rejected > 0 THEN 'rejected' END AS tab
    FROM articles a LEFT JOIN items USING (article_id) LEFT JOIN last USING (article_id) WHERE a.status = -1 OR pending IS NOT NULL)"""


def _tabs(s, d):
    return analytics.review_tabs(b.articles(s, d), b.review_queue(s, d), b.task_logs(s, d))


@query("f12_review_tabs", f"{WITH}, {TABS} SELECT article_id, tab FROM tabs WHERE tab IS NOT NULL")
def f12(s, d):
    return _tabs(s, d).select("article_id", "tab")


@query("a9_tab_counts", f"{WITH}, {TABS} SELECT tab, count(*) AS n FROM tabs WHERE tab IS NOT NULL GROUP BY tab")
def a9(s, d):
    return _tabs(s, d).groupBy("tab").agg(F.count("*").alias("n"))


@query("a10_item_counts", f"{WITH}, {TABS} SELECT article_id, pending, resolved, rejected FROM items")
def a10(s, d):
    return b.review_queue(s, d).groupBy("article_id").agg(*[F.count_if(F.col("status") == x).alias(x) for x in ("pending", "resolved", "rejected")])


@query("o2_review_order", f"{WITH}, {TABS} SELECT article_id, pending FROM tabs WHERE tab = 'pending' ORDER BY pending DESC, oldest, article_id LIMIT 25")
def o2(s, d):
    return _tabs(s, d).filter("tab = 'pending'").orderBy(F.desc("pending"), "oldest", "article_id").limit(25).select("article_id", "pending")


@query("o1_article_page", f"{WITH} SELECT article_id FROM articles ORDER BY publish_time DESC NULLS LAST, created_at DESC, article_id DESC LIMIT 20 OFFSET 40")
def o1(s, d):
    return analytics.page(b.articles(s, d), 3, 20).select("article_id")


_RATE = "round({n} / nullif({d}, 0)::DOUBLE, 6)"


@query(
    "a15_evaluation",
    f"""{WITH}, l AS (SELECT doc_id AS id, 'K' || quality AS product_key, CASE toxic WHEN 1 THEN '看跌' ELSE '看涨' END AS direction FROM labels),
    p AS (SELECT doc_id AS id, CASE WHEN n_chars > 500 THEN 'K1' ELSE 'K0' END AS pk, CASE WHEN lang = 'en' THEN '看跌' ELSE '看涨' END AS pd, CASE WHEN doc_id % 3 = 0 THEN 'rule' ELSE 'llm' END AS method, doc_id % 5 = 0 AS manual, (doc_id % 7)::DOUBLE AS duration FROM documents WHERE lang <> 'es'),
    j AS (SELECT * FROM l LEFT JOIN p USING (id))
    SELECT count(*) AS total, count(pk) AS predicted, coalesce({_RATE.format(n="count(*) FILTER (pk = product_key)", d="count(pk)")}, 0) AS precision, {_RATE.format(n="count(*) FILTER (pk = product_key)", d="count(*)")} AS recall, {_RATE.format(n="count(*) FILTER (pd = direction)", d="count(*)")} AS direction_accuracy,
    coalesce({_RATE.format(n="count(*) FILTER (method = 'rule' AND pd = direction)", d="count(*) FILTER (method = 'rule')")}, 0) AS rule_precision, {_RATE.format(n="count(*) FILTER (method = 'rule')", d="count(*)")} AS rule_rate, {_RATE.format(n="count(*) FILTER (method = 'llm')", d="count(*)")} AS llm_rate, {_RATE.format(n="count(*) FILTER (manual)", d="count(*)")} AS manual_rate, {_RATE.format(n="sum(coalesce(duration, 0))", d="count(*)")} AS mean_latency FROM j""",
)
def a15(s, d):
    labels = b.table(s, d, "labels").select(F.col("doc_id").alias("id"), F.concat(F.lit("K"), "quality").alias("product_key"), F.when(F.col("toxic") == 1, b.BEARISH).otherwise(b.BULLISH).alias("direction"))
    i = F.col("doc_id")
    predictions = b.table(s, d, "documents").filter("lang <> 'es'").select(i.alias("id"), F.when(F.col("n_chars") > 500, "K1").otherwise("K0").alias("predicted_key"), F.when(F.col("lang") == "en", b.BEARISH).otherwise(b.BULLISH).alias("predicted_direction"), F.when(i % 3 == 0, "rule").otherwise("llm").alias("method"), (i % 5 == 0).alias("manual"), (i % 7).cast("double").alias("duration"))
    return analytics.evaluation(labels, predictions)


@query("a19_scan_summary", f"{WITH} SELECT CAST(CAST(created_at AS DATE) AS VARCHAR) AS day, count(*) AS scanned, count(*) FILTER (status = 'success') AS succeeded, count(*) FILTER (status = 'failed') AS failed, round(sum(duration), 3) AS duration FROM logs GROUP BY day")
def a19(s, d):
    return dated(analytics.scan_summary(b.task_logs(s, d)), "day")


@query("a20_stage_latency", f"{WITH} SELECT stage, count(*) AS n, round(min(duration), 6) AS least, round(quantile_cont(duration, 0.5), 6) AS median, round(max(duration), 6) AS most FROM logs GROUP BY stage")
def a20(s, d):
    return analytics.stage_latency(b.task_logs(s, d))


@query("v1_violations", f"{WITH}, r AS (SELECT id, CASE WHEN trim(product) = '' THEN 'product' END AS rule FROM results UNION ALL SELECT id, CASE WHEN confidence NOT BETWEEN 0 AND 1 THEN 'confidence' END FROM results) SELECT id, rule FROM r WHERE rule IS NOT NULL")
def v1(s, d):
    return analytics.violations(b.results(s, d))


@query("v4_status_validity", f"{WITH} SELECT status, status IN (-1, 0, 1, 2, 3, 4, 5) AS valid, count(*) AS n FROM articles GROUP BY ALL")
def v4(s, d):
    return b.articles(s, d).groupBy("status", F.col("status").isin(-1, 0, 1, 2, 3, 4, 5).alias("valid")).agg(F.count("*").alias("n"))


def _child_sql(name: str, table: str, text: str) -> str:
    return f"(SELECT coalesce(string_agg({text}, ';' ORDER BY id), '') FROM {table} c WHERE c.article_id = a.article_id) AS {name}"


@query("j2_article_detail", f"{WITH} SELECT article_id, {_child_sql('results', 'results', 'id || product || direction')}, {_child_sql('items', 'queue', 'id || status')}, {_child_sql('logs', 'logs', 'id || stage || status')} FROM articles a")
def j2(s, d):
    """Each child table is aggregated once and joined once: no row fans out."""
    out = b.articles(s, d).select("article_id")
    for name, child, text in (("results", b.results(s, d), F.concat("id", "product", "direction")), ("items", b.review_queue(s, d), F.concat("id", "status")), ("logs", b.task_logs(s, d), F.concat("id", "stage", "status"))):
        held = F.transform(F.array_sort(F.collect_list(F.struct("id", text.alias("t")))), lambda x: x["t"])
        out = out.join(child.groupBy("article_id").agg(F.array_join(held, ";").alias(name)), "article_id", "left")
    return out.na.fill("")


@query("j3_without_results", f"{WITH} SELECT article_id FROM articles WHERE article_id NOT IN (SELECT article_id FROM results)")
def j3(s, d):
    return b.articles(s, d).join(b.results(s, d), "article_id", "left_anti").select("article_id")


HALVES = "old AS (SELECT * FROM results WHERE id % 3 < 2), new AS (SELECT *, row_number() OVER (PARTITION BY article_id, product_key, contract_key ORDER BY id DESC) AS rn FROM results WHERE id % 3 > 0), o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY article_id, product_key, contract_key ORDER BY id DESC) AS rn FROM old) WHERE rn = 1), n AS (SELECT * FROM new WHERE rn = 1)"


def _halves(s, d):
    rows = b.results(s, d)
    return rows.filter("id % 3 < 2"), rows.filter("id % 3 > 0")


@query(
    "m1_result_upsert",
    f"""{WITH}, {HALVES} SELECT article_id, product_key, contract_key, CASE WHEN o.id IS NOT NULL AND (n.id IS NULL OR (o.method = 'manual' AND n.method <> 'manual')) THEN o.id ELSE n.id END AS id,
    CASE WHEN o.id IS NULL THEN 'insert' WHEN n.id IS NULL OR (o.method = 'manual' AND n.method <> 'manual') THEN 'keep' ELSE 'update' END AS change FROM o FULL JOIN n USING (article_id, product_key, contract_key)""",
)
def m1(s, d):
    return merge.upsert_results(*_halves(s, d)).select(*merge.KEY, "id", "change")


@query("m2_result_reconcile", f"{WITH}, {HALVES} SELECT id FROM old WHERE method = 'manual' OR article_id NOT IN (SELECT article_id FROM new) OR (article_id, product_key, contract_key) IN (SELECT (article_id, product_key, contract_key) FROM new)")
def m2(s, d):
    return merge.reconcile_results(*_halves(s, d)).select("id")


QUEUES = "old AS (SELECT * FROM queue WHERE id % 3 < 2), new AS (SELECT * FROM queue WHERE id % 3 > 0)"


@query(
    "m3_review_upsert",
    f"""{WITH}, {QUEUES}, o AS (SELECT * FROM old QUALIFY row_number() OVER (PARTITION BY article_id, item_key ORDER BY id DESC) = 1), n AS (SELECT * FROM new QUALIFY row_number() OVER (PARTITION BY article_id, item_key ORDER BY id DESC) = 1)
    SELECT article_id, item_key, coalesce(o.id, n.id) AS id, CASE WHEN n.id IS NULL OR coalesce(o.status IN ('resolved', 'rejected'), false) THEN o.reason ELSE n.reason END AS reason,
    CASE WHEN n.id IS NULL OR coalesce(o.status IN ('resolved', 'rejected'), false) THEN o.status ELSE 'pending' END AS status FROM o FULL JOIN n USING (article_id, item_key)""",
)
def m3(s, d):
    rows = b.review_queue(s, d)
    return merge.upsert_reviews(rows.filter("id % 3 < 2"), rows.filter("id % 3 > 0"))


@query("m4_review_reconcile", f"{WITH}, {QUEUES} SELECT id FROM old WHERE status <> 'pending' OR article_id NOT IN (SELECT article_id FROM new) OR (article_id, item_key) IN (SELECT (article_id, item_key) FROM new)")
def m4(s, d):
    rows = b.review_queue(s, d)
    return merge.reconcile_reviews(rows.filter("id % 3 < 2"), rows.filter("id % 3 > 0")).select("id")


@query(
    "m8_alias_queue",
    f"""{WITH}, known AS (SELECT DISTINCT 'K' || (user_id % 17) AS product_key FROM events), builtin AS (SELECT DISTINCT 'view ' || user_id AS alias, 'K' || (user_id % 20) AS product_key FROM events WHERE user_id % 2 = 0),
    seen AS (SELECT reason AS alias, product_key, count(*) AS n, least(greatest(max(confidence * 1.5), 0), 1) AS c, min(id) AS s FROM results WHERE id % 2 = 1 AND product_key IN (SELECT product_key FROM known) AND (reason, product_key) NOT IN (SELECT (alias, product_key) FROM builtin) GROUP BY ALL),
    cur AS (SELECT reason AS alias, product_key, count(*) AS occurrences, max(confidence) AS confidence, CASE WHEN min(id) % 4 = 0 THEN min(id) END AS source_id FROM results WHERE id % 2 = 0 GROUP BY ALL)
    SELECT alias, product_key, coalesce(occurrences, 0) + coalesce(n, 0) AS occurrences, round(greatest(confidence, c), 6) AS confidence, coalesce(source_id, s) AS source_id FROM cur FULL JOIN seen USING (alias, product_key)""",
)
def m8(s, d):
    rows, user = b.results(s, d).withColumnRenamed("reason", "alias"), F.col("user_id")
    events = b.table(s, d, "events")
    current = rows.filter("id % 2 = 0").groupBy("alias", "product_key").agg(F.count("*").alias("occurrences"), F.max("confidence").alias("confidence"), F.min("id").alias("i"))
    current = current.select("alias", "product_key", "occurrences", "confidence", F.when(F.col("i") % 4 == 0, F.col("i")).alias("source_id"))
    seen = rows.filter("id % 2 = 1").select(F.when(F.col("id") % 5 == 0, F.concat(F.lit(" 【"), "alias", F.lit("】"))).otherwise(F.col("alias")).alias("alias"), "product_key", (F.col("confidence") * 1.5).alias("confidence"), F.col("id").alias("source_id"))
    builtin = events.filter("user_id % 2 = 0").select(F.concat(F.lit("view "), user).alias("alias"), F.concat(F.lit("K"), user % 20).alias("product_key"))
    return merge.queue_aliases(current, seen, events.select(F.concat(F.lit("K"), user % 17).alias("product_key")), builtin).withColumn("confidence", F.round("confidence", 6))


@query("m14_publish_repair", f"{WITH}, x AS (SELECT article_id, CAST(publish_time AS DATE) AS old_date, CAST(created_at AS DATE) AS new_date FROM articles) SELECT article_id, CAST(CASE WHEN year(x.old_date) BETWEEN 2000 AND 2100 THEN x.old_date END AS VARCHAR) AS old_date, CAST(x.new_date AS VARCHAR) AS new_date FROM x WHERE year(x.new_date) BETWEEN 2000 AND 2100 AND CASE WHEN year(x.old_date) BETWEEN 2000 AND 2100 THEN x.old_date END IS DISTINCT FROM x.new_date")
def m14(s, d):
    return dated(merge.publish_time_repairs(b.articles(s, d)), "old_date", "new_date")


@query("m16_retry_routing", f"{WITH} SELECT article_id, CASE WHEN status = -1 THEN CASE WHEN contains(lower(title), 'parse') THEN 0 WHEN contains(lower(title), 'clean') THEN 1 WHEN contains(lower(title), 'rule') THEN 2 WHEN contains(lower(title), 'llm') THEN 3 ELSE 0 END ELSE status END AS status FROM articles")
def m16(s, d):
    return b.articles(s, d).select("article_id", merge.retry_status(F.col("status"), F.col("title")).alias("status"))


EXT = "lower(regexp_extract(file_url, '\\.([A-Za-z0-9]+)$', 1))"
STATUS = f"CASE WHEN {EXT} IN ('pdf', 'html', 'htm') THEN 'candidate' WHEN {EXT} IN ('jpg', 'jpeg', 'png', 'gif', 'bmp', 'webp', 'tif', 'tiff') THEN 'skipped' ELSE 'unsupported' END"


@query(
    "s1_file_classes",
    f"""{WITH} SELECT article_id, CASE {EXT} WHEN 'pdf' THEN 'pdf' WHEN 'html' THEN 'html' WHEN 'png' THEN 'image' ELSE 'unknown' END AS file_type, {STATUS} AS file_status,
    CASE {EXT} WHEN 'pdf' THEN 'supported' WHEN 'html' THEN 'supported' WHEN 'png' THEN 'images_disabled' WHEN 'docx' THEN 'unsupported_extension:docx' ELSE 'unknown_extension' END AS reason FROM articles""",
)
def s1(s, d):
    return ingest.classified(b.articles(s, d)).select("article_id", "file_type", "file_status", "reason")


@query("s2_file_metadata", f"{WITH}, x AS (SELECT article_id, regexp_replace(regexp_extract(file_url, '([^/]*)$', 1), '\\.[^.]*$', '') AS stem FROM articles) SELECT article_id, stem, CASE WHEN contains(stem, '_') THEN split_part(stem, '_', 1) END AS stated_company FROM x")
def s2(s, d):
    return ingest.metadata(b.articles(s, d)).select("article_id", "stem", "stated_company")


@query(
    "s3_ingest_outcome",
    f"""{WITH}, known AS (SELECT DISTINCT file_url FROM articles WHERE article_id % 4 = 0), f AS (SELECT article_id, file_url, {STATUS} AS st, file_url IN (SELECT file_url FROM known) AS k FROM articles),
    chosen AS (SELECT DISTINCT file_url FROM f WHERE st = 'candidate' AND NOT k ORDER BY file_url LIMIT 500)
    SELECT CASE WHEN st <> 'candidate' THEN st WHEN k THEN 'duplicate' WHEN file_url IN (SELECT file_url FROM chosen) THEN 'imported' ELSE 'waiting' END AS outcome, count(*) AS n FROM f GROUP BY ALL""",
)
def s3(s, d):
    files = b.articles(s, d)
    return ingest.ingested(files, files.filter("article_id % 4 = 0"), 500).groupBy("outcome").agg(F.count("*").alias("n"))


def _pages_sql() -> str:
    h = "html"
    for tag in ("script", "style", "noscript", "svg", "nav", "footer"):
        h = f"regexp_replace({h}, '(?is)<{tag}[^>]*>.*?</{tag}>', '', 'g')"
    body = f"regexp_replace(regexp_replace({h}, '(?is)<head[^>]*>.*?</head>', '', 'g'), '(?s)<[^>]*>', chr(10), 'g')"
    for name, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
        body = f"replace({body}, '{name}', '{sign}')"
    return f"SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title, array_to_string(list_filter(list_transform(string_split({body}, chr(10)), lambda x: trim(regexp_replace(x, '[ \\t\\r]+', ' ', 'g'))), lambda x: x <> ''), chr(10)) AS body FROM pages"


@query("s6_page_text", _pages_sql())
def s6(s, d):
    return ingest.page_text(b.table(s, d, "pages")).select("page_id", "title", "body")


@query("d1_path_date", f"{WITH} SELECT article_id, CASE WHEN year(created_at) BETWEEN 2000 AND 2100 THEN CAST(CAST(created_at AS DATE) AS VARCHAR) END AS path_date FROM articles")
def d1(s, d):
    return dated(b.articles(s, d).select("article_id", fn.path_date("file_url").alias("path_date")), "path_date")


@query("x3_contract_key", "SELECT event_id, replace(replace(lower(trim(' ' || event_type || ' 合约 A')), '合约', ''), ' ', '') AS key FROM events")
def x3(s, d):
    return b.table(s, d, "events").select("event_id", fn.contract_key(F.concat(F.lit(" "), "event_type", F.lit(" 合约 A"))).alias("key"))


@query("x4_legacy_key", "SELECT c_custkey, 'LEGACY.' || left(sha1(trim(regexp_replace(c_name, '\\s+', ' ', 'g'))), 12) AS key FROM customer")
def x4(s, d):
    return b.table(s, d, "customer").select("c_custkey", fn.legacy_product_key("c_name").alias("key"))


_SECRETS = ("the of", "zzz-secret")
_BEARER = r"(?i)\bBearer\s+[^\s,;\"']+".replace("'", "''")
_VALUE = r"(?i)(\b(?:api[_-]?key|access[_-]?token|token|secret|password)\b\s*[:=]\s*)(?:\"[^\"]*\"|'[^']*'|[^\s,;&]+)".replace("'", "''")
_PARAMETER = r"(?i)([?&](?:api[_-]?key|access[_-]?token|token|secret|password)=)[^&\s]+"


@query("x9_redaction", f"SELECT doc_id, sha256(left(regexp_replace(regexp_replace(regexp_replace(replace(replace(text, '{_SECRETS[0]}', '[REDACTED]'), '{_SECRETS[1]}', '[REDACTED]'), '{_BEARER}', 'Bearer [REDACTED]', 'g'), '{_PARAMETER}', '\\1[REDACTED]', 'g'), '{_VALUE}', '\\1[REDACTED]', 'g'), 5000)) AS digest FROM documents")
def x9(s, d):
    return b.table(s, d, "documents").select("doc_id", F.sha2(fn.redacted("text", _SECRETS, 5000), 256).alias("digest"))


def _markup_sql() -> str:
    out = "html"
    for name, sign in fn.ENTITIES.items():
        out = f"replace({out}, '{name}', '{sign.replace(chr(39), chr(39) * 2)}')"
    return f"regexp_replace(regexp_replace(regexp_replace({out}, '&#[0-9]+;|&#x[0-9a-fA-F]+;', ' ', 'g'), '</?[a-zA-Z][^>]*/?>', ' ', 'g'), ' {{2,}}', ' ', 'g')"


@query("x7_markup", f"SELECT page_id, {_markup_sql()} AS plain FROM pages")
def x7(s, d):
    return b.table(s, d, "pages").select("page_id", fn.without_markup("html").alias("plain"))


def queries() -> dict:
    return _QUERIES


def oracle_sql() -> dict[str, str]:
    return _SQL
