"""Relational questions: search, roll-ups, trends, dashboard, rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstream.functions.columns import company_of, displayable, formal, signed
from quillstream.sources.bindings import DIRECTIONS


def search_articles(articles: DataFrame, results: DataFrame, product: str | None = None, direction: str | None = None, company: str | None = None, keyword: str | None = None, product_key: str | None = None, status: int | None = None, since=None, until=None) -> DataFrame:
    """Articles without results or with a displayable one; each result criterion is met by some displayable result, and the publish time lies in the range. Their number is the total of a page's list."""
    shown = displayable()
    flags = [F.bool_or(shown).alias("_shown")]
    wanted: list[Column] = [F.col("_shown").isNull() | F.col("_shown")]
    if product is not None:
        flags.append(F.bool_or(shown & (F.col("product") == product)).alias("_product"))
        wanted.append(F.col("_product"))
    if direction is not None:
        flags.append(F.bool_or(shown & (F.col("direction") == direction)).alias("_direction"))
        wanted.append(F.col("_direction"))
    if product_key is not None:
        flags.append(F.bool_or(shown & (F.col("product_key") == product_key)).alias("_key"))
        wanted.append(F.col("_key"))
    if status is not None:
        wanted.append(F.col("status") == status)
    if since is not None:
        wanted.append(F.col("publish_time") >= F.lit(since))
    if until is not None:
        wanted.append(F.col("publish_time") <= F.lit(until))
    if keyword is not None:
        flags.append(F.bool_or(shown & F.contains(F.lower("reason"), F.lit(keyword.lower()))).alias("_keyword"))
        inside = [F.coalesce(F.contains(F.lower(c), F.lit(keyword.lower())), F.lit(False)) for c in ("title", "source", "company")]
        wanted.append(inside[0] | inside[1] | inside[2] | F.coalesce("_keyword", F.lit(False)))
    if company is not None:
        wanted.append(F.coalesce(F.contains(F.lower("company"), F.lit(company.lower())), F.lit(False)))
    found = articles.join(results.groupBy("article_id").agg(*flags), "article_id", "left")
    for c in wanted:
        found = found.filter(c)
    return found.select(articles.columns)


def page(articles: DataFrame, number: int, size: int) -> DataFrame:
    """Newest first, undated last; ties by creation, then id."""
    order = [F.col("publish_time").desc_nulls_last(), F.col("created_at").desc(), F.col("article_id").desc()]
    return articles.orderBy(*order).offset((number - 1) * size).limit(size)


def best_predictions(results: DataFrame) -> DataFrame:
    """One result for each article and product: primary first, then confidence, then id."""
    name = F.coalesce(F.nullif("product_key", F.lit("")), "product")
    order = Window.partitionBy("article_id", name).orderBy(F.desc("is_primary"), F.desc("confidence"), F.desc("id"))
    return results.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def primary_results(results: DataFrame) -> DataFrame:
    """One result for each article: the primary of lowest id, else the most confident of lowest id."""
    order = Window.partitionBy("article_id").orderBy(F.desc("is_primary"), F.when(F.col("is_primary"), F.lit(0.0)).otherwise(-F.col("confidence")), "id")
    return results.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def trend_counts(results: DataFrame, articles: DataFrame, since=None, until=None) -> DataFrame:
    """Formal results by day, product and direction; a range holds for the time that gives the day."""
    joined = results.filter(formal()).join(articles.filter("status = 5"), "article_id")
    time = F.coalesce("publish_time", "analysis_time")
    if since is not None:
        joined = joined.filter(time >= F.lit(since))
    if until is not None:
        joined = joined.filter(time <= F.lit(until))
    day = F.to_date(time)
    return joined.groupBy(day.alias("day"), "product", "direction").agg(F.count("*").alias("n"))


def trend_heatmap(results: DataFrame, articles: DataFrame, since=None, until=None) -> DataFrame:
    """Mean signed confidence by day and product. A bound holds if either time meets it."""
    joined = results.filter(formal()).join(articles.filter("status = 5").select("article_id", "publish_time"), "article_id")
    for bound, ok in ((since, lambda c: c >= F.lit(since)), (until, lambda c: c <= F.lit(until))):
        if bound is not None:
            joined = joined.filter(F.coalesce(ok(F.col("publish_time")), F.lit(False)) | F.coalesce(ok(F.col("analysis_time")), F.lit(False)))
    day = F.to_date(F.coalesce("publish_time", "analysis_time"))
    value = signed("direction", "confidence")
    return joined.groupBy(day.alias("day"), "product_key", "product").agg(F.round(F.avg(value), 4).alias("value"), F.count("*").alias("n")).filter("day IS NOT NULL")


def heatmap_matrix(trend: DataFrame, top: int = 5) -> DataFrame:
    """Cells of the products with most rows, value not 0, with a label."""
    ranked = trend.groupBy("product").agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "product").limit(top)
    label = F.when(F.col("value") > 0.3, "up").when(F.col("value") < -0.3, "down").otherwise("flat")
    return trend.join(F.broadcast(ranked), "product", "left_semi").filter("value <> 0").withColumn("label", label)


def direction_counts(results: DataFrame, by: str = "product") -> DataFrame:
    """Formal results by direction, zero-filled."""
    counts = [F.count_if(F.col("direction") == d).alias(n) for d, n in zip(DIRECTIONS, ("bullish", "bearish", "neutral"), strict=True)]
    return results.filter(formal()).groupBy(by).agg(*counts)


def _numbered(rows: DataFrame, *by: str) -> DataFrame:
    """rows with position, their number in a group by publish time, newest first: ranked within years, after the sizes of the years before, so that no task ranks a large group whole."""
    year = F.coalesce(F.year("publish_time"), F.lit(-1))
    own = rows.withColumn("_year", year)
    sizes = own.groupBy(*by, "_year").agg(F.count("*").alias("_size"))
    before = sizes.select(*by, "_year", (F.sum("_size").over(Window.partitionBy(*by).orderBy(F.desc("_year"))) - F.col("_size")).alias("_before"))
    ranked = own.withColumn("_own", F.row_number().over(Window.partitionBy(*by, "_year").orderBy(F.col("publish_time").desc_nulls_last(), F.desc("id"))))
    same = [F.col(f"o.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (*by, "_year")]
    joined = ranked.alias("o").join(before.alias("b"), same)
    return joined.select("o.*", (F.col("_before") + F.col("_own")).cast("int").alias("position")).drop("_year", "_own")


def company_roll_up(results: DataFrame, articles: DataFrame) -> DataFrame:
    """Predictions of each company by publish time, newest first, numbered."""
    joined = best_predictions(results.filter(formal())).join(articles.filter("status = 5"), "article_id")
    return _numbered(joined.withColumn("company_name", company_of()), "company_name")


def product_roll_up(results: DataFrame, articles: DataFrame) -> DataFrame:
    """Predictions of each product by publish time, newest first, numbered."""
    joined = best_predictions(results.filter(formal())).join(articles.filter("status = 5"), "article_id")
    return _numbered(joined, "product_key", "product")


def first_predictions(results: DataFrame, articles: DataFrame, most: int = 8) -> DataFrame:
    """The newest predictions of each product."""
    joined = best_predictions(results.filter(formal())).join(articles.filter("status = 5"), "article_id")
    order = Window.partitionBy("product_key", "product").orderBy(F.col("publish_time").desc_nulls_last(), F.desc("id"))
    return joined.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= most)


def dashboard(articles: DataFrame, results: DataFrame, queue: DataFrame, today) -> DataFrame:
    """One row of counts."""
    day = F.to_date("created_at") == F.lit(today)
    a = articles.agg(F.count_if(day).alias("today"), F.count("*").alias("total"), F.count_if(F.col("status") == 5).alias("stored"), F.count_if(F.col("status") == -1).alias("failed"))
    stored = articles.filter("status = 5").select("article_id")
    shown = results.join(stored, "article_id")
    b = shown.agg(F.count_if(displayable() & F.col("need_manual_review")).alias("flagged"), *[F.count_if(formal() & (F.col("direction") == d)).alias(n) for d, n in zip(DIRECTIONS, ("bullish", "bearish", "neutral"), strict=True)])
    c = queue.filter("status = 'pending'").join(stored, "article_id").agg(F.count("*").alias("pending"))
    rate = F.when(F.col("total") > 0, F.round(F.col("stored") / F.col("total"), 6)).otherwise(0.0)
    # one row each
    return a.crossJoin(b).crossJoin(c).withColumn("success_rate", rate).withColumn("manual_review", F.col("flagged") + F.col("pending")).drop("flagged", "pending")


def latest_log(logs: DataFrame, stage: str = "pipeline") -> DataFrame:
    return logs.filter(F.col("stage") == stage).groupBy("article_id").agg(F.max("id").alias("log_id"), F.max_by("status", "id").alias("log_status"))


def review_tabs(articles: DataFrame, queue: DataFrame, logs: DataFrame) -> DataFrame:
    """article_id, tab and item counts: every failed article or one with items is in exactly one tab, or in none."""
    items = queue.groupBy("article_id").agg(
        *[F.count_if(F.col("status") == s).alias(s) for s in ("pending", "resolved", "rejected")], F.min("created_at").alias("oldest"), F.max("reviewed_at").alias("reviewed")
    )
    joined = articles.select("article_id", "status").join(items, "article_id", "left").join(latest_log(logs), "article_id", "left")
    joined = joined.filter((F.col("status") == -1) | F.col("pending").isNotNull())
    tab = (
        F.when((F.col("status") == -1) | F.col("log_status").isin("failed", "partial"), "error")
        .when(F.col("pending") > 0, "pending")
        .when(F.col("resolved") > 0, "completed")
        .when(F.col("rejected") > 0, "rejected")
    )
    return joined.withColumn("tab", tab).filter("tab IS NOT NULL")


def stage_latency(logs: DataFrame) -> DataFrame:
    """By stage: count, least, median and greatest duration. The median is exact: equal durations are counted first, and only these counts are ranked."""
    counted = logs.groupBy("stage", "duration").agg(F.count("*").alias("c"))
    by = Window.partitionBy("stage").orderBy("duration")
    ranked = counted.withColumns({"upto": F.sum("c").over(by.rowsBetween(Window.unboundedPreceding, 0)), "n": F.sum("c").over(Window.partitionBy("stage"))})
    low, high = F.floor((F.col("n") + 1) / 2), F.floor(F.col("n") / 2) + 1
    holds = lambda k: (F.col("upto") >= k) & (F.col("upto") - F.col("c") < k)
    middle = (F.max(F.when(holds(low), F.col("duration"))) + F.max(F.when(holds(high), F.col("duration")))) / 2
    return ranked.groupBy("stage").agg(F.sum("c").alias("n"), F.round(F.min("duration"), 6).alias("least"), F.round(middle, 6).alias("median"), F.round(F.max("duration"), 6).alias("most"))


def scan_summary(logs: DataFrame) -> DataFrame:
    by = F.to_date("created_at").alias("day")
    return logs.groupBy(by).agg(F.count("*").alias("scanned"), F.count_if(F.col("status") == "success").alias("succeeded"), F.count_if(F.col("status") == "failed").alias("failed"), F.round(F.sum("duration"), 3).alias("duration"))


def list_rows(articles: DataFrame, results: DataFrame, first: int = 4) -> DataFrame:
    """article_id, company and a summary of the first results."""
    order = Window.partitionBy("article_id").orderBy(F.when(F.col("is_primary"), 0).otherwise(1), "product", "contract_key", "id")
    text = F.concat(F.col("product"), F.when(F.col("contract_key") != "", F.concat("contract_key", F.lit(" "))).otherwise(""), F.col("direction"), F.lit(" "), F.format_string("%.2f", "confidence"))
    top = results.filter(displayable()).withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= first)
    summary = top.groupBy("article_id").agg(F.array_sort(F.collect_list(F.struct("_n", text.alias("t")))).alias("_s"))
    joined = articles.join(summary, "article_id", "left")
    return joined.select("article_id", company_of().alias("company"), F.coalesce(F.array_join("_s.t", "；"), F.left("title", F.lit(120))).alias("summary"))


def evaluation(labels: DataFrame, predictions: DataFrame) -> DataFrame:
    """One row of metrics over labels (id, product_key, direction) and predictions (id, predicted_key, predicted_direction, method, manual, duration): an id without a label counts for nothing; without labels the total is 0 and the rest null."""
    joined = labels.join(predictions, "id", "left")
    known, right = F.col("predicted_key") == F.col("product_key"), F.col("predicted_direction") == F.col("direction")
    rate = lambda n, d: F.round(F.try_divide(n, d), 6)
    total, rules = F.count("*"), F.count_if(F.col("method") == "rule")
    none = F.when(total > 0, 0.0)
    return joined.agg(
        total.alias("total"),
        F.count("predicted_key").alias("predicted"),
        F.coalesce(rate(F.count_if(known), F.count("predicted_key")), none).alias("precision"),
        rate(F.count_if(known), total).alias("recall"),
        rate(F.count_if(right), total).alias("direction_accuracy"),
        F.coalesce(rate(F.count_if((F.col("method") == "rule") & right), rules), none).alias("rule_precision"),
        rate(rules, total).alias("rule_rate"),
        rate(F.count_if(F.col("method") == "llm"), total).alias("llm_rate"),
        rate(F.count_if("manual"), total).alias("manual_rate"),
        rate(F.sum(F.coalesce("duration", F.lit(0.0))), total).alias("mean_latency"),
    )


def processing_stats(runs: DataFrame) -> DataFrame:
    """By source_id: matches, signals, rule and llm results, retries, recovered ones, reviews, and errors by type as a sorted list; of (source_id, kind, retries, error_type)."""
    kinds = [F.count_if(F.col("kind") == k).alias(f"{k}_count") for k in ("match", "signal", "rule", "llm", "review")]
    recovered = F.count_if((F.col("kind") == "llm") & (F.col("retries") > 0) & F.col("error_type").isNull()).alias("llm_recovered_count")
    by_type = runs.filter("error_type IS NOT NULL").groupBy("source_id", "error_type").agg(F.count("*").alias("n"))
    listed = by_type.groupBy("source_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "error_type", "n"))), ",").alias("errors"))
    stats = runs.groupBy("source_id").agg(*kinds, F.sum("retries").alias("llm_retry_count"), recovered)
    return stats.join(listed, "source_id", "left").na.fill("", ["errors"])


def violations(results: DataFrame) -> DataFrame:
    """id and reason of each rule that a result breaks."""
    rules = F.array_compact(
        F.array(
            F.when(F.coalesce(F.trim("product"), F.lit("")) == "", "product"),
            F.when(~F.coalesce(F.col("direction").isin(*DIRECTIONS), F.lit(False)), "direction"),
            F.when(~F.coalesce(F.col("method").isin("rule", "llm", "manual"), F.lit(False)), "method"),
            F.when(~F.coalesce(F.col("confidence").between(0, 1), F.lit(False)), "confidence"),
        )
    )
    return results.select("id", F.explode(rules).alias("rule"))
