"""Catalog, alias and segment tables: lookups, candidates, lexicon, back-fill, decisions, ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstream.functions.phrases import alias_key

PRIORITY = {"core": 0, "ocr": 1, "ai": 2, "table": 3, "mixed": 4}


def catalog_violations(catalog: DataFrame) -> DataFrame:
    """kind, value, n: product keys, symbols and folded aliases that more than one row (row_no) of a catalog has."""
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("value")) for k, v in (("product_key", F.col("product_key").cast("string")), ("symbol", F.lower("symbol")), ("alias", alias_key("alias")))])
    rows = catalog.select("row_no", F.inline(kinds))
    return rows.groupBy("kind", "value").agg(F.count_distinct("row_no").alias("n")).filter("n > 1")


def looked_up(asked: DataFrame, catalog: DataFrame, column: str = "asked") -> DataFrame:
    """asked with product_key and way (0: by key, 1: by name, 2: by symbol) of the first catalog entry that goes by that text."""
    names = F.array(*[F.struct(v.cast("string").alias("name"), F.lit(i).alias("way")) for i, v in enumerate((F.col("product_key"), F.col("alias"), F.col("symbol")))])
    ways = catalog.select("product_key", F.inline(names))
    best = ways.groupBy("name").agg(F.min(F.struct("way", "product_key")).alias("x")).select(F.col("name").alias(column), "x.product_key", "x.way")
    return asked.join(best, column, "left")


def candidate_evidence(seen: DataFrame, docs: int = 8, snippets: int = 3) -> DataFrame:
    """Of (alias, doc, pos, kind, product_key, negative, snippet) by folded alias: the first spelling, occurrences, documents, kinds, keys, negative reasons, the first documents and the first distinct snippets.

    Occurrences with a negative reason only give that reason. Only the first documents and snippets are collected."""
    rows = seen.withColumn("raw", F.col("alias")).withColumn("alias", alias_key("alias"))
    good = rows.filter("negative IS NULL")
    sets = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    parts = good.groupBy("alias", "doc", "kind", "product_key").agg(F.count("*").alias("n"))
    counts = parts.groupBy("alias").agg(F.sum("n").alias("occurrences"), F.count_distinct("doc").alias("docs"), sets("kind").alias("kinds"), sets("product_key").alias("keys"))
    every = rows.groupBy("alias").agg(F.min_by("raw", F.struct("doc", "pos")).alias("raw_alias"), sets("negative").alias("negative"))

    def firsts(table: DataFrame, value: str, order: str, most: int, mark: str, name: str) -> DataFrame:
        top = table.withColumn("_n", F.row_number().over(Window.partitionBy("alias").orderBy(order))).filter(F.col("_n") <= most)
        held = F.transform(F.array_sort(F.collect_list(F.struct("_n", F.col(value).cast("string").alias("v")))), lambda x: x["v"])
        return top.groupBy("alias").agg(F.array_join(held, mark).alias(name))

    first_docs = firsts(good.select("alias", "doc").distinct(), "doc", "doc", docs, ",", "first_docs")
    first_snippets = firsts(good.groupBy("alias", "snippet").agg(F.min(F.struct("doc", "pos")).alias("at")), "snippet", "at", snippets, "|", "snippets")
    out = every.join(counts, "alias", "left").join(first_docs, "alias", "left").join(first_snippets, "alias", "left")
    return out.na.fill(0, ["occurrences", "docs"]).na.fill("", ["kinds", "keys", "first_docs", "snippets"])


def lexicon(seeds: DataFrame, approved: DataFrame) -> DataFrame:
    """By product: seed and approved aliases (shorter first), evidence count, confidence."""
    rows = seeds.select("product_key", "alias", F.lit(0).cast("long").alias("n"), F.lit(1.0).alias("score")).unionByName(approved.select("product_key", "alias", "n", "score"))
    once = rows.groupBy("product_key", "alias").agg(F.sum("n").alias("n"), F.max("score").alias("score"))
    aliases = F.transform(F.array_sort(F.collect_list(F.struct(F.length("alias").alias("l"), "alias"))), lambda x: x["alias"])
    return once.groupBy("product_key").agg(F.array_join(aliases, ",").alias("aliases"), (1 + F.sum("n")).alias("evidence_count"), F.max("score").alias("confidence"))


def ranked_segments(segments: DataFrame, *by: str) -> DataFrame:
    """rank: section priority, then confidence, index and id."""
    priority = F.coalesce(F.create_map(*[F.lit(x) for kv in PRIORITY.items() for x in kv])[F.col("section")], F.lit(9))
    return segments.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(priority, F.desc("confidence"), "segment_index", "id")))


def best_segments(results: DataFrame, segments: DataFrame) -> DataFrame:
    """result_id, segment_id: the best-ranked known segment of the result's article and product."""
    best = ranked_segments(segments.filter("section <> 'unknown'"), "article_id", "product_key").filter("rank = 1")
    return results.select(F.col("id").alias("result_id"), "article_id", "product_key").join(best.select("article_id", "product_key", F.col("id").alias("segment_id")), ["article_id", "product_key"], "left").select("result_id", "segment_id")


def backfilled_keys(results: DataFrame, segments: DataFrame) -> DataFrame:
    """id, product_key: blank keys taken from the article's segments where these agree on one key, else from the name of a group."""
    known = segments.filter("product_key <> ''").groupBy("article_id", "product").agg(F.min("product_key").alias("k"), F.max("product_key").alias("l")).filter("k = l")
    joined = results.join(known, ["article_id", "product"], "left")
    groups = F.when(F.col("product") == "股指", "GROUP.CFFEX.INDEX").when(F.col("product") == "国债", "GROUP.CFFEX.BOND")
    return joined.select("id", F.coalesce(F.nullif("product_key", F.lit("")), "k", groups, F.lit("")).alias("product_key"))


def label_predictions(labels: DataFrame, predictions: DataFrame) -> DataFrame:
    """Each label (label_id, article_id, product_key) with the prediction of the same product, else the article's first."""
    joined = labels.join(predictions.select("article_id", F.col("product_key").alias("p"), "id", "direction"), "article_id", "left")
    order = Window.partitionBy("label_id").orderBy(F.desc_nulls_last(F.col("p") == F.col("product_key")), "id")
    return joined.withColumn("_n", F.row_number().over(order)).filter("_n = 1").select("label_id", F.col("id").alias("prediction_id"), "direction")


def auto_resolved(proposals: DataFrame, catalog: DataFrame, least: float = 0.85) -> DataFrame:
    """Proposals (id, product_key, confidence) with status: known and sure ones are auto_resolved, others pending."""
    known = catalog.select("product_key", F.lit(True).alias("known")).distinct()
    clipped = F.least(F.greatest("confidence", F.lit(0.0)), F.lit(1.0))
    rows = proposals.withColumn("confidence", clipped).join(known, "product_key", "left")
    return rows.select("id", "product_key", "confidence", F.when(F.col("known") & (F.col("confidence") >= least), "auto_resolved").otherwise("pending").alias("status"))


def synced_blocks(current: DataFrame, latest: DataFrame) -> DataFrame:
    """fingerprint, status: confirmed and auto_resolved stay, other present ones are pending, vanished pending ones obsolete."""
    joined = current.join(latest.select("fingerprint", F.lit(True).alias("seen")).distinct(), "fingerprint", "full_outer")
    final = F.col("status").isin("confirmed", "auto_resolved")
    return joined.select("fingerprint", F.when(final, F.col("status")).when(F.col("seen"), "pending").when(F.col("status") == "pending", "obsolete").otherwise(F.col("status")).alias("status"))


def replaced_segments(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """All segments of an article that comes again give way to the new ones."""
    return current.join(incoming.select("article_id").distinct(), "article_id", "left_anti").unionByName(incoming)


def reviewed_aliases(aliases: DataFrame, builtin: DataFrame) -> DataFrame:
    """Of (alias, product_key, decision): rejected, builtin_conflict where the built-in catalog has another product for the alias, conflict where products compete for it, else approved."""
    aliases = aliases.join(builtin.select("alias", F.col("product_key").alias("_builtin")), "alias", "left")
    wanted = F.col("decision") == "approve"
    rivals = F.size(F.collect_set(F.when(wanted, F.col("product_key"))).over(Window.partitionBy("alias")))
    other = F.coalesce(F.col("_builtin") != F.col("product_key"), F.lit(False))
    status = F.when(~wanted, "rejected").when(other, "builtin_conflict").when(rivals > 1, "conflict").otherwise("approved")
    return aliases.withColumn("status", status).drop("_builtin")


def last_decisions(decisions: DataFrame) -> DataFrame:
    """The last row (by line_no) of each alias, if it is approved and names a product."""
    last = decisions.groupBy("alias").agg(F.max_by(F.struct("decision", "product_key", "line_no"), "line_no").alias("x")).select("alias", "x.*")
    return last.filter("decision = 'approve' AND alias <> '' AND product_key <> ''")


def by_precedence(*layers: DataFrame) -> DataFrame:
    """alias, product_key of the first layer that has the alias (smallest key within a layer)."""
    rows = None
    for n, layer in enumerate(layers):
        part = layer.select("alias", "product_key", F.lit(n).alias("layer"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("alias").agg(F.min(F.struct("layer", "product_key")).alias("x")).select("alias", "x.product_key", "x.layer")


def confirmed_results(results: DataFrame, decisions: DataFrame, articles: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Results with confirmed directions (manual, not flagged), an audit row for each with before and after, and the articles, those of confirmed results stored (5)."""
    joined = results.join(decisions.select("id", F.col("direction").alias("confirmed")), "id", "left")
    hit = F.col("confirmed").isNotNull()
    new = joined.select("id", F.coalesce("confirmed", "direction").alias("direction"), F.when(hit, "manual").otherwise(F.col("method")).alias("method"), (~hit & F.col("need_manual_review")).alias("need_manual_review"))
    audit = joined.filter(hit).select("id", F.col("direction").alias("before"), F.col("confirmed").alias("after"))
    touched = joined.filter(hit).select("article_id", F.lit(True).alias("_hit")).distinct()
    stored = articles.join(touched, "article_id", "left").withColumn("status", F.when(F.col("_hit"), 5).otherwise(F.col("status"))).drop("_hit")
    return new, audit, stored


def stage_outcomes(articles: DataFrame, outcomes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Articles after stage outcomes (article_id, stage, ok, text, message): parsed (1) or cleaned (2) with that text and its length and no error, or failed (-1) with the message; and the failures' log rows."""
    joined = articles.join(outcomes, "article_id", "left")
    reached = F.when(F.col("stage") == "parse", 1).when(F.col("stage") == "clean", 2)
    got = lambda stage: F.when(F.col("ok") & (F.col("stage") == stage), F.col("text"))
    status = F.when(F.col("ok"), F.coalesce(reached, "status")).when(~F.col("ok"), -1).otherwise(F.col("status"))
    length = F.length(F.coalesce(got("parse"), got("clean"))).cast("long")
    out = joined.select("article_id", status.alias("status"), got("parse").alias("raw_text"), got("clean").alias("cleaned_text"), length.alias("length"), F.when(~F.col("ok"), F.col("message")).alias("error_msg"))
    logs = joined.filter(~F.col("ok")).select("article_id", "stage", F.lit("failed").alias("status"), "message")
    return out, logs


def hit_window(rows: DataFrame, hit: Column, radius: int, *by: str) -> DataFrame:
    """Rows (with pos) whose position is within `radius` of a hit's."""
    near = F.max(hit.cast("int")).over(Window.partitionBy(*by).orderBy("pos").rangeBetween(-radius, radius))
    return rows.withColumn("near", near).filter("near = 1").drop("near")


def canonical_payload(results: DataFrame) -> DataFrame:
    """By article: formal results, distinct products, and counts by method."""
    legal = results.filter("product_key <> '' AND direction IN ('看涨', '看跌', '中性') AND method IN ('manual', 'rule', 'llm')")
    counts = [F.count_if(F.col("method") == m).alias(f"n_{m}") for m in ("manual", "rule", "llm")]
    return legal.groupBy("article_id").agg(F.count("*").alias("n"), F.count_distinct("product_key").alias("products"), *counts)


def status_rank(status: str = "status") -> Column:
    """The order in which candidates are listed."""
    order = {"approved_seed": 0, "auto_approved": 1, "review_required": 2}
    return F.coalesce(F.create_map(*[F.lit(x) for kv in order.items() for x in kv])[F.col(status)], F.lit(3))


def lexicon_report(candidates: DataFrame, docs: DataFrame, most: int = 20) -> DataFrame:
    """One row: documents, lexicon entries, candidates, their number by status, and the first that need a review."""
    counts = [F.count_if(F.col("status") == s).alias(s) for s in ("approved_seed", "auto_approved", "review_required", "rejected")]
    entries = F.count_distinct(F.when(F.col("status").isin("approved_seed", "auto_approved"), F.col("suggested"))).alias("entries")
    top = candidates.filter("status = 'review_required'").orderBy(F.desc("score"), "alias").limit(most)
    listed = top.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "alias"))), lambda x: x["alias"]), ",").alias("first_reviews"))
    # one row each
    return docs.agg(F.count("*").alias("documents")).crossJoin(candidates.agg(entries, F.count("*").alias("candidates"), *counts)).crossJoin(listed)
