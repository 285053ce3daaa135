"""Spans of texts: lexicon matches, sections, scopes of products, signals and their owners. Offsets are code points, ends exclusive.

All of it is linear in spans: positions find their section, scope or nearest anchor by a sort within a document, not by range joins.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstream.functions import phrases as ph
from quillstream.operators import aliases


def spans(docs: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """doc_id, kind, start, stop, phrase, n (length of the text) of each pattern's leftmost non-overlapping matches."""
    found = F.array(*[F.struct(F.lit(k).alias("kind"), F.regexp_extract_all("text", F.lit(p), F.lit(0)).alias("phrase"), F.split("text", p, -1).alias("gap")) for k, p in patterns.items()])
    by_kind = docs.select("doc_id", F.inline(found))
    cut = by_kind.select("doc_id", "kind", F.posexplode(F.arrays_zip("phrase", "gap")).alias("pos", "x")).select("doc_id", "kind", "pos", "x.phrase", F.length("x.gap").alias("gap"))
    by = Window.partitionBy("doc_id", "kind")
    size = F.col("gap") + F.coalesce(F.length("phrase"), F.lit(0))
    stop = F.sum(size).over(by.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    placed = cut.select("doc_id", "kind", "phrase", stop.alias("stop"), F.sum(size).over(by).alias("n")).filter("phrase IS NOT NULL")
    return placed.select("doc_id", "kind", (F.col("stop") - F.length("phrase")).alias("start"), "stop", "phrase", "n")


def matches(docs: DataFrame, names: dict[str, str], negative: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, product_key, start, stop, n of all names of a pack (the longest of those that begin first) without a negative word shortly before."""
    found = aliases.find(docs, [(name, key, key, "lexicon", list(negative)) for name, key in names.items()])
    return found.select("doc_id", "product_key", "start", "stop", "n")


def sections(docs: DataFrame, heading: str) -> DataFrame:
    """doc_id, heading_start, body_start, body_end: a heading's body ends where the next heading begins."""
    found = spans(docs, {"heading": heading})
    end = F.coalesce(F.lead("start").over(Window.partitionBy("doc_id").orderBy("start")), F.col("n"))
    return found.select("doc_id", F.col("start").alias("heading_start"), F.col("stop").alias("body_start"), end.alias("body_end"))


def placed(points: DataFrame, parts: DataFrame) -> DataFrame:
    """points (doc_id, start, ...) with the last heading at or before each: heading_start, body_start, body_end (null before the first)."""
    columns = [c for c in points.columns if c != "doc_id"]
    own = points.select("doc_id", F.col("start").alias("at"), F.lit(1).alias("side"), F.struct(*columns).alias("point"), F.lit(None).cast("struct<heading_start:bigint,body_start:bigint,body_end:bigint>").alias("part"))
    heads = parts.select("doc_id", F.col("heading_start").alias("at"), F.lit(0).alias("side"), F.lit(None).cast(own.schema["point"].dataType).alias("point"), F.struct(*[F.col(c).cast("bigint").alias(c) for c in ("heading_start", "body_start", "body_end")]).alias("part"))
    before = F.last("part", True).over(Window.partitionBy("doc_id").orderBy("at", "side").rowsBetween(Window.unboundedPreceding, 0))
    both = own.unionByName(heads).withColumn("part", before).filter("side = 1")
    return both.select("doc_id", "point.*", "part.heading_start", "part.body_start", "part.body_end")


def owners(found: DataFrame) -> DataFrame:
    """doc_id, heading_start, product_key of the products named inside a heading; `found` is a placed match table."""
    return found.filter("start < body_start").select("doc_id", "heading_start", "product_key").distinct()


def related_only(found: DataFrame) -> DataFrame:
    """doc_id, product_key, n, related: whether every mention lies in a section owned by other, concrete products alone."""
    keys = owners(found).groupBy("doc_id", "heading_start").agg(F.collect_set("product_key").alias("keys"))
    joined = found.join(keys, ["doc_id", "heading_start"], "left")
    concrete = F.exists("keys", lambda k: ~k.startswith("GROUP."))
    foreign = (F.col("start") >= F.col("body_start")) & concrete & ~F.array_contains("keys", F.col("product_key"))
    return joined.groupBy("doc_id", "product_key").agg(F.count("*").alias("n"), F.bool_and(F.coalesce(foreign, F.lit(False))).alias("related"))


def scopes(found: DataFrame, parts: DataFrame, reach: int = 80) -> DataFrame:
    """doc_id, product_key, start, stop, owned: bodies of own sections; products without one get merged windows round their mentions, within their section."""
    own = owners(found)
    bodies = own.join(parts, ["doc_id", "heading_start"]).select("doc_id", "product_key", F.col("body_start").alias("start"), F.col("body_end").alias("stop"), F.lit(True).alias("owned"))
    free = found.join(own.select("doc_id", "product_key").distinct(), ["doc_id", "product_key"], "left_anti")
    inside = F.col("start") >= F.col("body_start")
    low, high = F.when(inside, F.col("body_start")).otherwise(F.lit(0)), F.when(inside, F.col("body_end")).otherwise(F.col("n"))
    around = free.select("doc_id", "product_key", F.greatest(F.col("start") - reach, low).alias("start"), F.least(F.col("stop") + reach, high).alias("stop")).filter("start < stop")
    merged = islands(around, "doc_id", "product_key", touching=True).groupBy("doc_id", "product_key", "island").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    return bodies.unionByName(merged.select("doc_id", "product_key", "start", "stop", F.lit(False).alias("owned")))


def islands(rows: DataFrame, *by: str, touching: bool = False) -> DataFrame:
    """rows with island, the number of their group of overlapping (or touching) spans."""
    order = Window.partitionBy(*by).orderBy("start", "stop")
    last = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.coalesce(F.col("start") > last if touching else F.col("start") >= last, F.lit(True))
    return rows.withColumn("_fresh", fresh.cast("int")).withColumn("island", F.sum("_fresh").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_fresh")


def greedy(rows: DataFrame, rank: list[Column], *by: str) -> DataFrame:
    """The spans that stay if, in the order of `rank`, each is kept unless it overlaps a kept one; decided island by island."""
    columns = [c for c in rows.columns if c not in by]
    item = F.struct(*[r.alias(f"_r{i}") for i, r in enumerate(rank)], *columns)
    held = islands(rows, *by).groupBy(*by, "island").agg(F.array_sort(F.collect_list(item)).alias("items"))
    empty = F.filter("items", lambda x: F.lit(False))
    kept = F.aggregate("items", empty, lambda acc, x: F.when(F.exists(acc, lambda y: (x["start"] < y["stop"]) & (y["start"] < x["stop"])), acc).otherwise(F.array_append(acc, x)))
    return held.select(*by, F.inline(kept)).select(*rows.columns)


def leftmost_longest(rows: DataFrame, *by: str) -> DataFrame:
    return greedy(rows, [F.col("start"), F.col("start") - F.col("stop")], *by)


def longest_first(rows: DataFrame, *by: str) -> DataFrame:
    """Of equal spans and directions the surest one (then the one of greatest further columns, `weight` first), then the longest first."""
    own = (*by, "start", "stop", "direction")
    more = sorted((c for c in rows.columns if c not in (*own, "confidence")), key=lambda c: (c != "weight", c))
    best = rows.groupBy(*own).agg(F.max(F.struct("confidence", *more)).alias("_best")).select(*own, "_best.*")
    return greedy(best, [F.col("start") - F.col("stop"), F.col("start"), F.col("direction")], *by)


def with_context(docs: DataFrame, signals: DataFrame, packs: dict, risks: tuple) -> DataFrame:
    """signals (doc_id, start, stop, ...) with flags of what stands around each, factor (what it counts in arbitration) and sure (how sure it is itself)."""
    n = risks[0]
    low = F.greatest(F.col("start") - n, F.lit(0))
    before = F.substring("text", (low + 1).cast("int"), (F.col("start") - low).cast("int"))
    after = F.substring("text", (F.col("stop") + 1).cast("int"), F.lit(n))
    joined = signals.join(docs.select("doc_id", "text"), "doc_id").withColumns({"_before": before, "_after": after}).drop("text")
    flagged = joined.withColumn("flags", ph.context_flags("_before", "_after", packs, risks)).drop("_before", "_after")
    return flagged.withColumns({"factor": ph.context_factor("flags", packs), "sure": ph.signal_factor("flags")})


def _counted_marks(points: DataFrame, marks: DataFrame, name: str) -> DataFrame:
    """points with `name`, the number of marks before each: the clause or sentence that it lies in."""
    columns = [c for c in points.columns if c != "doc_id"]
    own = points.select("doc_id", F.col("start").alias("at"), F.lit(0).alias("mark"), F.struct(*columns).alias("point"))
    ends = marks.select("doc_id", (F.col("start") + 1).alias("at"), F.lit(1).alias("mark"), F.lit(None).cast(own.schema["point"].dataType).alias("point"))
    number = F.sum("mark").over(Window.partitionBy("doc_id").orderBy("at", F.desc("mark")).rowsBetween(Window.unboundedPreceding, 0))
    return own.unionByName(ends).withColumn(name, number).filter("mark = 0").select("doc_id", "point.*", name)


def _nearest(signals: DataFrame, anchors: DataFrame, unit: str) -> DataFrame:
    """signals with owner: of the anchors in the same unit the nearest one that ends before, else the nearest; none if two products tie."""
    columns = signals.columns
    own = signals.withColumns({"akey": F.lit(None).cast("string"), "aend": F.lit(None).cast("bigint"), "by_end": F.col("start"), "side": F.lit(1)})
    marks = anchors.select(*[F.col(c) if c in ("doc_id", "start", unit) else F.lit(None).cast(signals.schema[c].dataType).alias(c) for c in columns], F.col("product_key").alias("akey"), F.col("stop").cast("bigint").alias("aend"), F.col("stop").alias("by_end"), F.lit(0).alias("side"))
    by = Window.partitionBy("doc_id", unit)
    anchor = F.when(F.col("side") == 0, F.struct("start", "aend", "akey"))
    before = F.last(anchor, True).over(by.orderBy("by_end", "side").rowsBetween(Window.unboundedPreceding, 0))
    over = F.last(anchor, True).over(by.orderBy("start", "side").rowsBetween(Window.unboundedPreceding, 0))
    # backwards: a frame that shrinks from row to row is read anew for each
    after = F.last(anchor, True).over(by.orderBy(F.desc("start"), F.desc("side")).rowsBetween(Window.unboundedPreceding, 0))
    near = own.unionByName(marks).select(*columns, "side", before.alias("_b"), over.alias("_o"), after.alias("_a")).filter("side = 1")
    left, right = F.col("start") - F.col("_o.start"), F.col("_a.start") - F.col("start")
    other = F.when(F.col("_a").isNull() | (left < right), F.col("_o.akey")).when(F.col("_o").isNull() | (right < left), F.col("_a.akey")).when(F.col("_o.akey") == F.col("_a.akey"), F.col("_o.akey"))
    return near.select(*columns, F.when(F.col("_b").isNotNull(), F.col("_b.akey")).otherwise(other).alias("owner"))


CLAUSE, SENTENCE = "[，,；;。！？!?\n]", "[。！？!?\n]"


def owned_signals(docs: DataFrame, signals: DataFrame, anchors: DataFrame, clause: str = CLAUSE, sentence: str = SENTENCE) -> DataFrame:
    """signals (doc_id, start, stop, ...) with owner: the nearest product of the clause, else of the sentence. Signals hold no marks themselves."""
    marks = spans(docs, {"clause": clause, "sentence": sentence})
    of = lambda df: _counted_marks(_counted_marks(df, marks.filter("kind = 'clause'"), "clause"), marks.filter("kind = 'sentence'"), "sentence")
    anchors = of(anchors.select("doc_id", "product_key", "start", "stop"))
    near = _nearest(of(signals), anchors, "clause").withColumnRenamed("owner", "close")
    return _nearest(near, anchors, "sentence").withColumn("owner", F.coalesce("close", "owner")).drop("close", "clause", "sentence")


def product_signals(docs: DataFrame, found: DataFrame, parts: DataFrame, signals: DataFrame, reach: int = 80, clause: str = CLAUSE, sentence: str = SENTENCE) -> DataFrame:
    """doc_id, product_key, start, stop, direction, confidence and the signals' further columns (weight, factor): signals inside a scope that one product owns alone, or in another scope of the product that is their owner; then the longest first."""
    area = scopes(found, parts, reach)
    heads = owners(found).filter(~F.col("product_key").startswith("GROUP.")).groupBy("doc_id", "heading_start").agg(F.count("*").alias("keys"))
    alone = parts.join(heads, ["doc_id", "heading_start"], "left").select("doc_id", F.col("body_start").alias("start"), (F.coalesce("keys", F.lit(0)) == 1).alias("alone"))
    area = area.join(alone, ["doc_id", "start"], "left").withColumn("alone", F.col("owned") & F.coalesce("alone", F.lit(False)))
    asked = owned_signals(docs, signals, found, clause, sentence).join(area.select("doc_id", "product_key").distinct(), "doc_id")
    # scopes of a product lie apart, so the last one that begins at or before a signal is the only one that can hold it
    both = asked.withColumns({"side": F.lit(1), "scope": F.lit(None).cast("struct<stop:bigint,alone:boolean>"), "at": F.col("start")})
    areas = area.select("doc_id", "product_key", F.col("start").alias("at"), F.lit(0).alias("side"), F.struct(F.col("stop").cast("bigint").alias("stop"), "alone").alias("scope"))
    last = F.last("scope", True).over(Window.partitionBy("doc_id", "product_key").orderBy("at", "side").rowsBetween(Window.unboundedPreceding, 0))
    held = both.unionByName(areas, allowMissingColumns=True).withColumn("scope", last).filter("side = 1 AND stop <= scope.stop AND (scope.alone OR owner = product_key)")
    more = [c for c in signals.columns if c not in ("doc_id", "start", "stop", "direction", "confidence")]
    return longest_first(held.select("doc_id", "product_key", "start", "stop", "direction", "confidence", *more), "doc_id", "product_key")


def evidence(docs: DataFrame, found: DataFrame, least: int = 6, most: int = 600, items: int = 6, chars: int = 1200, sentence: str = "[^。！？!?\n]+[。！？!?\n]?", conclusions: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, product_key, evidence_id, start, stop: sentences that mention the product, conclusions and then the earliest first, within a budget of items and characters (too long ones are passed over)."""
    parts = spans(docs, {"sentence": sentence})
    size = F.col("stop") - F.col("start")
    marked = parts.withColumn("rank", F.when(F.lower("phrase").rlike("|".join(map(re.escape, conclusions))), 0).otherwise(1) if conclusions else F.lit(1))
    heads = marked.filter((size >= least) & (size <= most)).select("doc_id", F.col("start").alias("heading_start"), F.struct("rank", F.col("start"), F.col("stop")).alias("sentence"))
    own = found.select("doc_id", F.col("start").alias("at"), F.lit(1).alias("side"), "product_key", F.col("stop").alias("end"), F.lit(None).cast(heads.schema["sentence"].dataType).alias("sentence"))
    rows = own.unionByName(heads.select("doc_id", F.col("heading_start").alias("at"), F.lit(0).alias("side"), "sentence"), allowMissingColumns=True)
    last = F.last("sentence", True).over(Window.partitionBy("doc_id").orderBy("at", "side").rowsBetween(Window.unboundedPreceding, 0))
    named = rows.withColumn("sentence", last).filter("side = 1 AND end <= sentence.stop").select("doc_id", "product_key", "sentence").distinct()
    listed = named.groupBy("doc_id", "product_key").agg(F.array_sort(F.collect_list("sentence")).alias("all"))
    start = F.struct(F.filter("all", lambda x: F.lit(False)).alias("kept"), F.lit(0).cast("bigint").alias("chars"))

    def take(acc: Column, x: Column) -> Column:
        longer = acc["chars"] + x["stop"] - x["start"]
        return F.when((F.size(acc["kept"]) < items) & (longer <= chars), F.struct(F.array_append(acc["kept"], x).alias("kept"), longer.alias("chars"))).otherwise(acc)

    kept = F.aggregate("all", start, take, lambda acc: acc["kept"])
    numbered = listed.select("doc_id", "product_key", F.posexplode(kept).alias("i", "x"))
    return numbered.select("doc_id", "product_key", F.concat(F.lit("E"), F.col("i") + 1).alias("evidence_id"), "x.start", "x.stop")


def valid_excerpts(docs: DataFrame, excerpts: DataFrame) -> DataFrame:
    """excerpts (doc_id, start, stop, raw_quote) with valid: the text has that quote there."""
    joined = excerpts.join(docs.select("doc_id", "text"), "doc_id", "left")
    there = F.substring("text", F.col("start").cast("int") + 1, (F.col("stop") - F.col("start")).cast("int")) == F.col("raw_quote")
    return joined.withColumn("valid", F.coalesce(there, F.lit(False))).drop("text")


def routed(docs: DataFrame, arbitration: DataFrame, quotes: DataFrame, options: DataFrame, mentions: DataFrame, least: float = 0.5) -> DataFrame:
    """doc_id, product_key, outcome, reason, direction, confidence, need_manual_review of every mentioned product, where no model can be asked.

    Accepted with evidence (quotes) it is a rule's result, flagged if unsure; accepted without, or not accepted, a provisional result with the likeliest direction, flagged, and a review item that says whether there is any evidence (options) to ask a model about; a mention without signals is a review item alone, and so is a document without mentions."""
    proven = quotes.select("doc_id", "product_key", F.lit(True).alias("proven")).distinct()
    offered = options.select("doc_id", "product_key", F.lit(True).alias("offered")).distinct()
    keys = ["doc_id", "product_key"]
    joined = mentions.select(*keys, "related").join(arbitration.select(*keys, "accepted", "direction", "confidence"), keys, "left").join(proven, keys, "left").join(offered, keys, "left")
    rows = routes(joined, least)
    none = docs.select("doc_id").join(mentions.select("doc_id").distinct(), "doc_id", "left_anti")
    empty = none.select("doc_id", F.lit(None).cast("string").alias("product_key"), F.lit("review").alias("outcome"), F.lit("no_product_match").alias("reason"), F.lit(None).cast("string").alias("direction"), F.lit(None).cast("double").alias("confidence"), F.lit(None).cast("boolean").alias("need_manual_review"))
    return rows.unionByName(empty)


def routes(joined: DataFrame, least: float = 0.5) -> DataFrame:
    """What `routed` says of products by their mention (related), verdict (accepted, direction, confidence) and evidence (proven, offered); a null product is that of a document without mentions."""
    keys = ["doc_id", "product_key"]
    good = F.coalesce(F.col("accepted") & F.col("proven"), F.lit(False))
    outcome = F.when(F.col("accepted").isNull(), "review").when(good, "rule").otherwise("provisional")
    why = F.when(F.col("accepted"), "rule_evidence_quality_failed").otherwise("fallback")
    rest = F.when(F.col("offered"), "llm_unavailable").otherwise("no_product_scoped_context")
    reason = F.when(F.col("accepted").isNull(), F.when(F.col("product_key").isNull(), "no_product_match").when(F.col("related"), "related_product_mention_only").otherwise("no_signal")).when(~good, F.concat_ws(":", why, rest))
    return joined.select(*keys, outcome.alias("outcome"), reason.alias("reason"), "direction", "confidence", F.when(F.col("accepted").isNotNull(), ~good | (F.col("confidence") < least)).alias("need_manual_review"))
