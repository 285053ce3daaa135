"""Table-level changes as functions (current, incoming) -> new; nothing is updated in place."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = ["article_id", "product_key", "contract_key"]


def one_per_key(rows: DataFrame, key: list[str] = KEY) -> DataFrame:
    """The last row (by id) of each key."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("id")))).filter("_n = 1").drop("_n")


def upsert_results(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming rows replace those of their key, but no manual row gives way to another kind. `change` tells what happened."""
    old, new = one_per_key(current), one_per_key(incoming)
    joined = old.alias("o").join(new.alias("n"), KEY, "full_outer")
    keep = F.col("n.id").isNull() | ((F.col("o.method") == "manual") & (F.col("n.method") != "manual"))
    keep = F.coalesce(keep, F.lit(False)) & F.col("o.id").isNotNull()
    change = F.when(F.col("o.id").isNull(), "insert").when(keep, "keep").otherwise("update")
    rest = [c for c in current.columns if c not in KEY]
    return joined.select(*KEY, *[F.when(keep, F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")).alias(c) for c in rest], change.alias("change"))


def reconcile_results(current: DataFrame, latest: DataFrame) -> DataFrame:
    """Without automatic rows of the articles in `latest` whose key it no longer holds; manual rows stay."""
    touched = latest.select("article_id").distinct()
    held = latest.select(*KEY).distinct()
    stale = current.filter("method <> 'manual'").join(touched, "article_id", "left_semi").join(held, KEY, "left_anti").select("id")
    return current.join(stale, "id", "left_anti")


def upsert_reviews(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Items by article and item_key; resolved and rejected ones are final, pending ones are renewed."""
    key = ["article_id", "item_key"]
    old, new = one_per_key(current, key), one_per_key(incoming, key)
    joined = old.alias("o").join(new.alias("n"), key, "full_outer")
    keep = F.col("n.id").isNull() | F.coalesce(F.col("o.status").isin("resolved", "rejected"), F.lit(False))
    status = F.when(keep, F.col("o.status")).otherwise("pending")
    return joined.select(*key, F.when(keep, F.col("o.id")).otherwise(F.coalesce("o.id", "n.id")).alias("id"), F.when(keep, F.col("o.reason")).otherwise(F.col("n.reason")).alias("reason"), status.alias("status"))


def reconcile_reviews(current: DataFrame, latest: DataFrame) -> DataFrame:
    """Without pending items of the articles in `latest` that it no longer holds."""
    stale = current.filter("status = 'pending'").join(latest.select("article_id").distinct(), "article_id", "left_semi").join(latest.select("article_id", "item_key").distinct(), ["article_id", "item_key"], "left_anti").select("id")
    return current.join(stale, "id", "left_anti")


def elect_primary(rows: DataFrame) -> DataFrame:
    """is_primary of one result an article: a manual primary, else an explicit one, else the most confident; lowest id first."""
    order = Window.partitionBy("article_id").orderBy(F.desc(F.col("is_primary") & (F.col("method") == "manual")), F.desc("is_primary"), F.desc("confidence"), "id")
    return rows.withColumn("is_primary", F.row_number().over(order) == 1)


def first_primary(rows: DataFrame) -> DataFrame:
    """is_primary of the lowest id of each article."""
    return rows.withColumn("is_primary", F.min("id").over(Window.partitionBy("article_id")) == F.col("id"))


def queue_aliases(current: DataFrame, seen: DataFrame, catalog: DataFrame, builtin: DataFrame) -> DataFrame:
    """alias, product_key, occurrences, confidence, source_id: counts add up, the larger confidence (clipped) stays, and so does the first source.

    Blank aliases, unknown products, and aliases that the built-in catalog has for the same product are passed over."""
    key = ["alias", "product_key"]
    tidy = F.trim(F.regexp_replace(F.trim("alias"), "^【+|】+$", ""))
    rows = seen.withColumn("alias", tidy).filter("alias <> ''").join(catalog.select("product_key").distinct(), "product_key", "left_semi").join(builtin.select(*key).distinct(), key, "left_anti")
    fresh = rows.groupBy(*key).agg(F.count("*").alias("n"), F.least(F.greatest(F.max("confidence"), F.lit(0.0)), F.lit(1.0)).alias("c"), F.min("source_id").alias("s"))
    joined = current.join(fresh, key, "full_outer")
    return joined.select(*key, (F.coalesce("occurrences", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("occurrences"), F.greatest("confidence", "c").alias("confidence"), F.coalesce("source_id", "s").alias("source_id"))


def publish_time_repairs(articles: DataFrame) -> DataFrame:
    """article_id, old and new date where the path's date is valid and another than the valid current one."""
    from quillstream.functions.columns import path_date, valid_time

    rows = articles.select("article_id", F.to_date(valid_time("publish_time")).alias("old_date"), path_date("file_url").alias("new_date"))
    return rows.filter(F.col("new_date").isNotNull() & ~F.col("old_date").eqNullSafe(F.col("new_date")))


def retry_status(status, error):
    """The status that a failed article goes back to: that of the earliest stage its error names."""
    text = F.lower(error)
    routed = F.when(text.contains("parse"), 0).when(text.contains("clean"), 1).when(text.contains("rule"), 2).when(text.contains("llm"), 3).otherwise(0)
    return F.when(status == -1, routed).otherwise(status)
