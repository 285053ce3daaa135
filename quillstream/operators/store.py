"""The store's lists, filters and decisions: what users ask of the review queue, catalog and resolutions, and what their answers change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstream.functions.columns import company_of
from quillstream.functions.evidence import evidence_quotes
from quillstream.functions.phrases import reason_label
from quillstream.operators.curation import PRIORITY
from quillstream.sources.bindings import DIRECTIONS

# Codes of a rejection, and reasons for which an article is worth another run.
REJECTION_CODES = ("navigation_noise", "not_futures_product", "no_analysis_content", "duplicate", "other")
ELIGIBLE = ("rule_evidence_quality_failed", "llm_evidence_quality_failed", "llm_error_or_invalid_output")


def active_catalog(catalog: DataFrame, concrete: bool = False) -> DataFrame:
    """Active products; with `concrete`, those that are no group."""
    rows = catalog.filter("active")
    return rows.filter(~F.col("product_key").startswith("GROUP.")) if concrete else rows


def listed(rows: DataFrame, catalog: DataFrame, status: str, most: int) -> DataFrame:
    """The oldest rows of a status with the names of their products."""
    names = catalog.select("product_key", F.col("display_name").alias("product_name"))
    return rows.filter(F.col("status") == status).orderBy("created_at", "id").limit(most).join(names, "product_key", "left")


def filtered_queue(articles: DataFrame, queue: DataFrame, company: str | None = None, product_key: str | None = None, reason: str | None = None, keyword: str | None = None, missing_evidence: bool = False) -> DataFrame:
    """Articles that meet every given filter, each by any of their items; a keyword's words all stand in title, company or source."""
    wanted, flags = [], [F.count("*").alias("_items")]
    for name, ok in (("_key", F.col("product_key") == product_key if product_key else None), ("_reason", F.col("reason") == reason if reason else None), ("_missing", F.size(evidence_quotes("evidence")) == 0 if missing_evidence else None)):
        if ok is not None:
            flags.append(F.bool_or(F.coalesce(ok, F.lit(False))).alias(name))
            wanted.append(F.coalesce(F.col(name), F.lit(False)))
    found = articles.join(queue.groupBy("article_id").agg(*flags), "article_id", "left")
    if company:
        wanted.append(company_of() == company)
    if keyword:
        text = F.lower(F.concat_ws(" ", "title", F.coalesce("company", F.lit("")), F.coalesce("source", F.lit(""))))
        wanted += [F.contains(text, F.lit(w)) for w in keyword.lower().split()]
    for w in wanted:
        found = found.filter(w)
    return found.select(articles.columns)


def filter_options(articles: DataFrame, queue: DataFrame) -> DataFrame:
    """kind (company, product, reason), value, label: what the queue's filters offer; of a product's names the last one is shown."""
    companies = articles.select(company_of().alias("value")).filter("value <> ''").distinct().select(F.lit("company").alias("kind"), "value", F.col("value").alias("label"))
    items = queue.join(articles.select("article_id"), "article_id", "left_semi")
    products = items.filter("product_key <> ''").groupBy(F.col("product_key").alias("value")).agg(F.max_by(F.coalesce(F.nullif("product", F.lit("")), "product_key"), F.struct("article_id", "id")).alias("label"))
    reasons = items.select(F.col("reason").alias("value")).distinct().withColumn("label", reason_label("value"))
    return companies.unionByName(products.select(F.lit("product").alias("kind"), "value", "label")).unionByName(reasons.select(F.lit("reason").alias("kind"), "value", "label"))


def ordered_tab(tabs: DataFrame, tab: str, sort: str | None = None) -> DataFrame:
    """A tab of the review queue in order: most pending items first, latest errors, latest reviews; or the oldest or newest as asked."""
    rows = tabs.filter(F.col("tab") == tab)
    if sort == "oldest":
        return rows.orderBy("oldest", "article_id")
    if sort is None and tab == "pending":
        return rows.orderBy(F.desc("pending"), "oldest", "article_id")
    time = "log_time" if sort is None and tab == "error" else "reviewed"
    return rows.orderBy(F.desc(time), F.desc("article_id"))


def reprocessable(queue: DataFrame, most: int, eligible: tuple[str, ...] = ELIGIBLE) -> DataFrame:
    """The first articles with a pending item of an eligible reason and no usable evidence."""
    rows = queue.filter((F.col("status") == "pending") & F.split_part(F.col("reason"), F.lit(":"), F.lit(1)).isin(*eligible) & (F.size(evidence_quotes("evidence")) == 0))
    return rows.groupBy("article_id").agg(F.min("id").alias("item_id")).orderBy("article_id").limit(most)


def by_name(products: DataFrame, name: str = "product", language: str = "zh") -> DataFrame:
    """Rows in the order of a language's dictionaries."""
    return products.orderBy(F.collate(F.col(name), language), name)


def payload_violations(payloads: DataFrame, error_types: tuple[str, ...]) -> DataFrame:
    """source_id, place, rule: what a canonical payload (source_id, title, results, reviews) breaks; places count from 0."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    own = F.array_compact(F.array(F.when(blank(F.col("source_id")), "source_id"), F.when(blank(F.col("title")), "document.title")))
    heads = payloads.select("source_id", F.lit(None).cast("int").alias("place"), F.explode(own).alias("rule"))

    def broken(r: Column) -> Column:
        return F.array_compact(
            F.array(
                F.when(blank(r["product_key"]), "product_key"),
                F.when(~F.coalesce(r["direction"].isin(*DIRECTIONS), F.lit(False)), "direction"),
                F.when(~F.coalesce(r["method"].isin("rule", "llm", "manual"), F.lit(False)), "analysis_method"),
                F.when(~F.coalesce(r["confidence"].between(0, 1), F.lit(False)), "confidence"),
            )
        )

    results = payloads.select("source_id", F.posexplode("results").alias("place", "r")).select("source_id", "place", F.explode(broken(F.col("r"))).alias("rule"))
    reviews = payloads.select("source_id", F.posexplode("reviews").alias("place", "r")).filter(F.col("r.error_type").isNotNull() & ~F.col("r.error_type").isin(*error_types))
    return heads.unionByName(results).unionByName(reviews.select("source_id", "place", F.lit("diagnostic.error_type").alias("rule")))


def block_answers(blocks: DataFrame, answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pending blocks (block_ref) each with the first answer (by line_no) that names it, and the answers that name none, or one that is answered already."""
    ranked = answers.withColumn("_n", F.row_number().over(Window.partitionBy("block_ref").orderBy("line_no")))
    joined = ranked.join(blocks.select("block_ref", F.lit(True).alias("_known")).distinct(), "block_ref", "left")
    used = joined.filter("_known AND _n = 1").drop("_known", "_n")
    errors = joined.filter("_known IS NULL OR _n > 1").select("line_no", "block_ref", F.when(F.col("_known").isNull(), "unknown").otherwise("duplicate").alias("error"))
    return blocks.join(used, "block_ref", "left"), errors


def terms(reason: Column, least: int = 4) -> Column:
    """Parts of a reason between marks and blanks, of at least `least` characters, each once."""
    return F.array_distinct(F.filter(F.split(reason, r"[。！？；;，,、\n\s]+"), lambda x: F.length(x) >= least))


def reason_score(reason: Column, direction: Column, text: Column) -> Column:
    """How well a segment's text supports a reason: 100 for all of it, 12 for each term, 4 for the direction, -80 for a text that breaks off, -100 for none."""
    compact = F.regexp_replace(text, r"\s+", "")
    broken = (compact == "") | ((F.length(compact) < 120) & compact.rlike(r"(?:跌幅|涨幅|同比|环比|产地|等待|较上周|较昨日|达到)\z"))
    score = F.when((reason != "") & F.contains(text, reason), 100).otherwise(0) + 12 * F.size(F.filter(terms(reason), lambda t: F.contains(text, t)))
    score = score + F.when((direction != "") & F.contains(text, direction), 4).otherwise(0) - F.when(broken, 80).otherwise(0)
    return F.when(F.trim(text) == "", -100).otherwise(score)


def best_segments(results: DataFrame, segments: DataFrame) -> DataFrame:
    """result_id, segment_id, score: of the known segments of a result's product (by key, else by name) the one that supports it best; those of its contract come before others."""
    known = segments.filter("section <> 'unknown'").select(F.col("id").alias("segment_id"), "article_id", F.col("product_key").alias("_key"), F.col("product").alias("_name"), F.col("contract_key").alias("_contract"), "section", F.col("confidence").alias("_c"), "segment_index", "text")
    asked = results.select(F.col("id").alias("result_id"), "article_id", "product_key", "product", "contract_key", "direction", "reason")
    # one equi-join: by key where there is one, else by name
    by = lambda df, key, name: df.withColumn("_by", F.when(F.col(key) != "", F.concat(F.lit("k"), key)).otherwise(F.concat(F.lit("n"), name)))
    both = known.withColumn("_by", F.explode(F.array_distinct(F.array(F.concat(F.lit("k"), "_key"), F.concat(F.lit("n"), "_name")))))
    joined = by(asked, "product_key", "product").join(both, ["article_id", "_by"])
    priority = F.coalesce(F.create_map(*[F.lit(x) for kv in PRIORITY.items() for x in kv])[F.col("section")], F.lit(9))
    exact = (F.col("contract_key") != "") & (F.col("_contract") == F.col("contract_key"))
    scored = joined.withColumn("score", reason_score(F.col("reason"), F.col("direction"), F.col("text")))
    order = Window.partitionBy("result_id").orderBy(exact.desc(), F.desc("score"), priority, F.desc("_c"), "segment_index", "segment_id")
    best = scored.withColumn("_n", F.row_number().over(order)).filter("_n = 1").select("result_id", "segment_id", "score")
    return results.select(F.col("id").alias("result_id")).join(best, "result_id", "left")


def confirmed_resolutions(resolutions: DataFrame, decisions: DataFrame, catalog: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Resolutions (id, article_id, segment_index, raw_name, status, ...) with confirmed ones (method manual, confidence 1), and errors of decisions whose resolution or product is unknown."""
    known = catalog.select(F.col("product_key").alias("chosen"), F.lit(True).alias("_product")).distinct()
    judged = decisions.select("id", F.col("product_key").alias("chosen"), "reviewer").join(known, "chosen", "left").join(resolutions.select("id", F.lit(True).alias("_here")), "id", "left")
    good = judged.filter("_product AND _here").select("id", "chosen", "reviewer")
    errors = judged.filter("_product IS NULL OR _here IS NULL").select("id", F.when(F.col("_here").isNull(), "resolution not found").otherwise("unknown product_key").alias("error"))
    joined = resolutions.join(good, "id", "left")
    hit = F.col("chosen").isNotNull()
    fresh = {"status": F.when(hit, "confirmed").otherwise(F.col("status")), "method": F.when(hit, "manual").otherwise(F.col("method")), "confidence": F.when(hit, 1.0).otherwise(F.col("confidence")), "product_key": F.coalesce("chosen", "product_key"), "reviewer": F.coalesce("reviewer", F.lit(""))}
    return joined.withColumns(fresh).drop("chosen"), errors


def after_confirmation(confirmed: DataFrame, segments: DataFrame, results: DataFrame, articles: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Segments with the confirmed products, results without automatic ones of the articles, and articles set back to cleaned (2)."""
    done = confirmed.filter("status = 'confirmed' AND reviewer <> ''")
    per_segment = done.groupBy("article_id", "segment_index").agg(F.max_by("product_key", "id").alias("_key"))
    joined = segments.join(per_segment, ["article_id", "segment_index"], "left")
    fresh = joined.withColumns({"product_key": F.coalesce("_key", "product_key"), "method": F.when(F.col("_key").isNotNull(), "manual").otherwise(F.col("method")), "confidence": F.when(F.col("_key").isNotNull(), 1.0).otherwise(F.col("confidence"))}).drop("_key")
    touched = done.select("article_id").distinct()
    stale = results.filter("method <> 'manual'").join(touched, "article_id", "left_semi").select("id")
    moved = articles.join(touched.withColumn("_touched", F.lit(True)), "article_id", "left")
    return fresh, results.join(stale, "id", "left_anti"), moved.withColumn("status", F.when(F.col("_touched"), 2).otherwise(F.col("status"))).drop("_touched")


def rejections(queue: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The queue with rejected items, and the decisions (id, reviewer, code) that do not hold, with why."""
    judged = decisions.join(queue.select("id", F.col("status").alias("_status")), "id", "left")
    error = (
        F.when((F.trim(F.coalesce("reviewer", F.lit(""))) == "") | ~F.coalesce(F.col("code").isin(*REJECTION_CODES), F.lit(False)), "a reviewer and a valid reason are required")
        .when(F.col("_status").isNull(), "review item not found")
        .when(F.col("_status") == "resolved", "resolved items cannot be rejected")
    )
    judged = judged.withColumn("error", error)
    good = judged.filter("error IS NULL").select("id", F.col("code").alias("_code"), F.trim("reviewer").alias("_by"))
    joined = queue.join(good, "id", "left")
    hit = F.col("_code").isNotNull()
    fresh = joined.withColumns({"status": F.when(hit, "rejected").otherwise(F.col("status")), "code": F.col("_code"), "reviewed_by": F.col("_by")}).drop("_code", "_by")
    return fresh, judged.filter("error IS NOT NULL").select("id", "error")


def conclusions(queue: DataFrame, decisions: DataFrame, catalog: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Manual results out of pending items, the audit, the queue with these resolved, and decisions (id, direction, reason, evidence, product_key, reviewer) that do not hold."""
    known = active_catalog(catalog, concrete=True).select("product_key", F.col("display_name").alias("_name"))
    items = queue.select("id", "article_id", F.col("status").alias("_status"), F.col("product_key").alias("_key"), F.col("product").alias("_product"), F.col("reason").alias("_reason"))
    text = lambda c: F.trim(F.coalesce(c, F.lit("")))
    judged = decisions.withColumn("product_key", text("product_key")).join(known, "product_key", "left").join(items, "id", "left")
    error = (
        F.when(~text("direction").isin(*DIRECTIONS), "invalid direction")
        .when((text("reason") == "") | (text("evidence") == ""), "direction, reason and evidence are required")
        .when(text("reviewer") == "", "a reviewer is required")
        .when(F.col("_status").isNull(), "review item not found")
        .when(F.col("_status") != "pending", "only pending items can be concluded")
        .when(F.col("_name").isNull(), "an active product is required")
    )
    judged = judged.withColumn("error", error)
    good = judged.filter("error IS NULL")
    results = good.select("article_id", "product_key", F.col("_name").alias("product"), text("direction").alias("direction"), text("reason").alias("reason"), text("evidence").alias("quote"), F.lit(1.0).alias("confidence"), F.lit("manual").alias("method"), F.lit(True).alias("is_primary"), F.lit(False).alias("need_manual_review"))
    audit = good.select("id", "article_id", F.col("_key").alias("before_key"), F.col("_reason").alias("before_reason"), F.col("product_key").alias("after_key"), text("direction").alias("after_direction"), text("reviewer").alias("reviewed_by"))
    joined = queue.join(good.select("id", text("reviewer").alias("reviewed_by"), text("reason").alias("note")), "id", "left")
    fresh = joined.withColumn("status", F.when(F.col("reviewed_by").isNotNull(), "resolved").otherwise(F.col("status")))
    return results, audit, fresh, judged.filter("error IS NOT NULL").select("id", "error")


def imported(articles: DataFrame, payloads: DataFrame) -> DataFrame:
    """article_id, file_url, change of the articles after an import: known ones (by file_url) are found, others get the next ids in the order of their address."""
    first = articles.agg(F.coalesce(F.max("article_id"), F.lit(0)).alias("_last"))
    found = articles.select("article_id", F.col("file_url").alias("source_id"))
    joined = payloads.select("source_id").distinct().join(found, "source_id", "left")
    fresh = joined.filter("article_id IS NULL").select("source_id")
    # numbers by range of the address: no row but a count of each range meets another
    numbered = numbered_by(fresh, "source_id").join(F.broadcast(first)).select((F.col("_last") + F.col("n")).alias("article_id"), "source_id", F.lit("created").alias("change"))
    return joined.filter("article_id IS NOT NULL").select("article_id", "source_id", F.lit("found").alias("change")).unionByName(numbered)


def numbered_by(rows: DataFrame, order: str) -> DataFrame:
    """rows with n, their number from 1 in an order: their rank among those of the same beginning, plus the sizes of the beginnings before."""
    bucket = F.left(F.col(order), F.lit(12))
    sizes = rows.groupBy(bucket.alias("_b")).agg(F.count("*").alias("_size"))
    before = sizes.select("_b", (F.sum("_size").over(Window.orderBy("_b")) - F.col("_size")).alias("_before"))
    own = rows.withColumn("_b", bucket).withColumn("_own", F.row_number().over(Window.partitionBy("_b").orderBy(order)))
    return own.join(before, "_b").withColumn("n", F.col("_before") + F.col("_own")).drop("_b", "_own", "_before")


def segments_of(payloads: DataFrame, most: int = 600) -> DataFrame:
    """source_id, segment_index, product_key, text: a segment for each result of a payload: its quotes joined, else the text's beginning."""
    rows = payloads.select("source_id", "text", F.posexplode("results").alias("segment_index", "r"))
    quotes = F.array_join(F.filter("r.quotes", lambda x: F.trim(x) != ""), "\n")
    return rows.select("source_id", "segment_index", F.col("r.product_key").alias("product_key"), F.coalesce(F.nullif(quotes, F.lit("")), F.left("text", F.lit(most))).alias("text"))
