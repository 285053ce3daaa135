"""The driver's tables as the engine's model: articles, results, review queue, task logs, documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

UNKNOWN_PRODUCT = "未知"
BULLISH, BEARISH, NEUTRAL = DIRECTIONS = ("看涨", "看跌", "中性")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    return orders.join(customers, cust == F.col("c_custkey")).select(
        key.cast("long").alias("article_id"),
        F.concat_ws(" ", "o_orderpriority", "c_mktsegment").alias("title"),
        F.col("c_name").alias("source"),
        F.when(cust % 7 == 0, "").when(cust % 11 == 0, None).otherwise(F.col("c_mktsegment")).alias("company"),
        F.concat(F.lit("data/"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit("/"), F.col("c_mktsegment"), F.lit("_"), key, F.element_at(F.array(*map(F.lit, (".pdf", ".html", ".PNG", ".docx", ".dat"))), (key % 5 + 1).cast("int"))).alias("file_url"),
        F.when(F.col("o_orderpriority") == "4-NOT SPECIFIED", None).otherwise(F.col("o_orderdate")).alias("publish_time"),
        F.when(F.col("o_orderstatus") == "F", 5).when(F.col("o_orderstatus") == "P", 0).otherwise(-1).alias("status"),
        F.col("o_orderdate").alias("created_at"),
    )


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    user, event = F.col("user_id") % 20, F.col("event_id")
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        event.alias("id"),
        F.floor(event / 3).cast("long").alias("article_id"),
        F.when(user == 3, UNKNOWN_PRODUCT).when(user == 7, "").otherwise(F.concat(F.lit("P"), user)).alias("product"),
        F.concat(F.lit("K"), user).alias("product_key"),
        F.when(event % 4 == 0, "05").when(event % 4 == 1, "09").otherwise("").alias("contract_key"),
        F.when(kind.isin("purchase", "signup"), BULLISH).when(kind == "error", BEARISH).otherwise(NEUTRAL).alias("direction"),
        F.concat_ws(" ", kind, F.col("user_id")).alias("reason"),
        F.least(F.lit(1.0), F.col("value") / 97).alias("confidence"),
        F.when(event % 5 == 0, "llm").when(event % 5 == 1, "manual").otherwise("rule").alias("method"),
        F.col("ts").alias("analysis_time"),
        (F.col("value") < 0.5).alias("need_manual_review"),
        (event % 3 == 0).alias("is_primary"),
    )


def evidence_json():
    """Evidence of a review item in one of the shapes that are in use."""
    user, shape = F.col("user_id").cast("string"), F.floor(F.col("event_id") / 4) % 6
    return (
        F.when(shape == 0, F.concat(F.lit('"seen by '), user, F.lit('"')))
        .when(shape == 1, F.concat(F.lit('["first  of '), user, F.lit('", {"quote": "quote of '), user, F.lit('"}, {"text": "", "excerpt": "part of '), user, F.lit('"}]')))
        .when(shape == 2, F.concat(F.lit('{"excerpts": [{"quote": "", "text": "text of '), user, F.lit('", "source": "manual", "start_char": -'), user, F.lit('}, "plain of '), user, F.lit('"], "kind": "verified", "notes": " a note "}')))
        .when(shape == 3, F.concat(F.lit('{"raw": "raw of '), user, F.lit('", "diagnostic": {"error_type": "odd", "message": "token=abc", "attempt_count": -3, "parse_errors": [{"error_type": "invalid_json"}, {"error_type": "x"}]}}')))
        .when(shape == 4, "{}")
        .otherwise('"an_identifier"')
    )


def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    event = F.col("event_id")
    status = F.when(F.col("user_id") % 3 == 0, "pending").when(F.col("user_id") % 3 == 1, "resolved").otherwise("rejected")
    return table(spark, sf_dir, "events").filter(event % 4 == 0).select(
        event.alias("id"),
        F.floor(event / 12).cast("long").alias("article_id"),
        F.sha1(F.concat_ws("|", F.floor(event / 12).cast("long"), F.col("user_id") % 20, F.col("event_type"), event % 7)).alias("item_key"),
        F.concat(F.lit("K"), F.col("user_id") % 20).alias("product_key"),
        F.concat(F.lit("P"), F.col("user_id") % 20).alias("product"),
        F.col("event_type").alias("reason"),
        status.alias("status"),
        F.col("ts").alias("created_at"),
        F.when(status != "pending", F.col("ts")).alias("reviewed_at"),
        evidence_json().alias("evidence"),
    )


def task_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    event = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        event.alias("id"),
        F.floor(event / 5).cast("long").alias("article_id"),
        F.when(event % 5 < 2, "pipeline").otherwise(F.col("event_type")).alias("stage"),
        F.when(F.col("value") < 4, "failed").when(F.col("value") < 8, "partial").otherwise("success").alias("status"),
        F.col("value").alias("duration"),
        F.col("ts").alias("created_at"),
    )


#: The same bindings for DuckDB.
SQL = """
articles AS (
  SELECT o_orderkey::BIGINT AS article_id, concat_ws(' ', o_orderpriority, c_mktsegment) AS title, c_name AS source,
         CASE WHEN o_custkey % 7 = 0 THEN '' WHEN o_custkey % 11 = 0 THEN NULL ELSE c_mktsegment END AS company,
         'data/' || strftime(o_orderdate, '%Y%m%d') || '/' || c_mktsegment || '_' || o_orderkey || (['.pdf', '.html', '.PNG', '.docx', '.dat'])[o_orderkey % 5 + 1] AS file_url,
         CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN NULL ELSE o_orderdate END AS publish_time,
         CASE o_orderstatus WHEN 'F' THEN 5 WHEN 'P' THEN 0 ELSE -1 END AS status, o_orderdate AS created_at
  FROM orders JOIN customer ON o_custkey = c_custkey
), results AS (
  SELECT event_id AS id, event_id // 3 AS article_id,
         CASE user_id % 20 WHEN 3 THEN '未知' WHEN 7 THEN '' ELSE 'P' || (user_id % 20) END AS product, 'K' || (user_id % 20) AS product_key,
         CASE event_id % 4 WHEN 0 THEN '05' WHEN 1 THEN '09' ELSE '' END AS contract_key,
         CASE WHEN event_type IN ('purchase', 'signup') THEN '看涨' WHEN event_type = 'error' THEN '看跌' ELSE '中性' END AS direction,
         concat_ws(' ', event_type, user_id) AS reason, least(1.0, value / 97) AS confidence,
         CASE event_id % 5 WHEN 0 THEN 'llm' WHEN 1 THEN 'manual' ELSE 'rule' END AS method, ts AS analysis_time,
         value < 0.5 AS need_manual_review, event_id % 3 = 0 AS is_primary
  FROM events
), queue AS (
  SELECT event_id AS id, event_id // 12 AS article_id, sha1(concat_ws('|', event_id // 12, user_id % 20, event_type, event_id % 7)) AS item_key,
         'K' || (user_id % 20) AS product_key, 'P' || (user_id % 20) AS product, event_type AS reason,
         CASE user_id % 3 WHEN 0 THEN 'pending' WHEN 1 THEN 'resolved' ELSE 'rejected' END AS status, ts AS created_at,
         CASE WHEN user_id % 3 <> 0 THEN ts END AS reviewed_at,
         CASE (event_id // 4) % 6 WHEN 0 THEN '"seen by ' || user_id || '"'
           WHEN 1 THEN '["first  of ' || user_id || '", {"quote": "quote of ' || user_id || '"}, {"text": "", "excerpt": "part of ' || user_id || '"}]'
           WHEN 2 THEN '{"excerpts": [{"quote": "", "text": "text of ' || user_id || '", "source": "manual", "start_char": -' || user_id || '}, "plain of ' || user_id || '"], "kind": "verified", "notes": " a note "}'
           WHEN 3 THEN '{"raw": "raw of ' || user_id || '", "diagnostic": {"error_type": "odd", "message": "token=abc", "attempt_count": -3, "parse_errors": [{"error_type": "invalid_json"}, {"error_type": "x"}]}}'
           WHEN 4 THEN '{}' ELSE '"an_identifier"' END AS evidence
  FROM events WHERE event_id % 4 = 0
), logs AS (
  SELECT event_id AS id, event_id // 5 AS article_id, CASE WHEN event_id % 5 < 2 THEN 'pipeline' ELSE event_type END AS stage,
         CASE WHEN value < 4 THEN 'failed' WHEN value < 8 THEN 'partial' ELSE 'success' END AS status, value AS duration, ts AS created_at
  FROM events
)"""
