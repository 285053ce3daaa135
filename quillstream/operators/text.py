"""Line and word tables of documents: noise, features, mentions, windows, directions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstream.functions.columns import let, settled
from quillstream.packs import ZH_DIRECTIONS, DirectionPack
from quillstream.sources.bindings import DIRECTIONS

#: The pack for the driver's documents, as data: noise markers, aliases, direction words.
NOISE = ("licensed under", "general public license", "cookie", "all rights reserved")
ALIASES = {"the": "K.THE", "der": "K.THE", "le": "K.THE", "of": "K.OF", "de": "K.OF", "and": "K.AND", "und": "K.AND", "et": "K.AND"}


def lines(docs: DataFrame) -> DataFrame:
    """doc_id, pos, line."""
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))


def noisy(line: Column) -> Column:
    low = F.lower(line)
    return reduce(lambda a, x: a | x, (F.contains(low, F.lit(w)) for w in NOISE))


def clean_stats(docs: DataFrame) -> DataFrame:
    """Raw and cleaned length, removed lines, removal ratio and warning; blank lines stay."""
    kept = F.filter(F.split("text", "\n"), lambda x: ~noisy(x))
    out = docs.select("doc_id", F.length("text").cast("long").alias("raw_length"), F.size(F.split("text", "\n")).cast("long").alias("n"), kept.alias("kept"))
    out = out.withColumns({"removed_lines": F.col("n") - F.size("kept"), "cleaned_length": F.length(F.array_join("kept", "\n")).cast("long")})
    ratio = F.round(1 - F.try_divide("cleaned_length", "raw_length"), 6)
    return out.withColumn("ratio", F.coalesce(ratio, F.lit(0.0))).withColumn("warning", F.when(F.col("ratio") > 0.95, "high").when(F.col("ratio") < 0.05, "low").otherwise("none")).drop("n", "kept")


def adjacent_distinct(table: DataFrame) -> DataFrame:
    """Lines without those equal, blanks aside, to the non-blank line before."""
    bare = table.withColumn("bare", F.regexp_replace("line", r"\s+", "")).filter("bare <> ''")
    before = F.lag("bare").over(Window.partitionBy("doc_id").orderBy("pos"))
    return bare.withColumn("before", before).filter("before IS NULL OR before <> bare").select("doc_id", "pos", "line")


def long_runs(table: DataFrame, flag: Column, least: int = 2) -> DataFrame:
    """Lines of runs of at least `least` flagged neighbours."""
    w = Window.partitionBy("doc_id")
    island = F.row_number().over(w.orderBy("pos")) - F.row_number().over(Window.partitionBy("doc_id", "flag").orderBy("pos"))
    marked = table.withColumn("flag", flag).withColumn("island", island)
    return marked.withColumn("size", F.count("*").over(Window.partitionBy("doc_id", "flag", "island"))).filter(F.col("flag") & (F.col("size") >= least)).select("doc_id", "pos")


def words(docs: DataFrame) -> DataFrame:
    """doc_id, pos, word (lower case, ASCII punctuation off its ends)."""
    cut = docs.select("doc_id", F.posexplode(F.split(F.lower("text"), "[ \n]")).alias("pos", "raw"))
    return cut.select("doc_id", "pos", F.regexp_replace("raw", r"^[.,!?;:]+|[.,!?;:]+$", "").alias("word"))


def mentions(docs: DataFrame) -> DataFrame:
    """doc_id, product_key, pos of every alias."""
    pairs = F.create_map(*[F.lit(x) for kv in ALIASES.items() for x in kv])
    return words(docs).withColumn("product_key", pairs[F.col("word")]).filter("product_key IS NOT NULL").select("doc_id", "product_key", "pos")


def mention_counts(docs: DataFrame) -> DataFrame:
    return mentions(docs).groupBy("doc_id", "product_key").agg(F.count("*").alias("n"), F.min("pos").cast("long").alias("first_pos"))


def merged_windows(spans: DataFrame, radius: int, gap: int = 0) -> DataFrame:
    """Windows of `radius` around positions of each document and product, merged where at most `gap` lies between; scores (if there are) add up, and the kind is reason if any is."""
    scored = "score" in spans.columns
    spans = spans if scored else spans.withColumns({"score": F.lit(0), "kind": F.lit("keyword")})
    by = Window.partitionBy("doc_id", "product_key").orderBy("pos")
    span = spans.withColumns({"start": F.greatest(F.col("pos") - radius, F.lit(0)), "stop": F.col("pos") + radius + 1})
    fresh = F.coalesce(F.col("start") > F.max("stop").over(by.rowsBetween(Window.unboundedPreceding, -1)) + gap, F.lit(True))
    grouped = span.withColumn("fresh", fresh).withColumn("g", F.sum(F.col("fresh").cast("int")).over(by))
    kind = F.when(F.bool_or(F.col("kind") == "reason"), "reason").otherwise(F.min_by("kind", "pos"))
    out = grouped.groupBy("doc_id", "product_key", "g").agg(F.min("start").cast("long").alias("start"), F.max("stop").cast("long").alias("stop"), F.count("*").alias("hits"), F.sum("score").cast("long").alias("score"), kind.alias("kind")).drop("g")
    return out if scored else out.drop("score", "kind")


def _strong(text: Column, word: str) -> Column:
    """How often a word occurs."""
    return F.when(F.contains(text, F.lit(word)), (F.octet_length(text) - F.octet_length(F.replace(text, F.lit(word), F.lit("")))) / len(word.encode())).otherwise(0).cast("long")


#: Ends of lines, beyond which a dot in a pattern does not go; few texts hold others than the first.
_LINE_ENDS = "\n\r\x85\u2028\u2029"


def _pattern_lines(text: Column) -> Column:
    other = reduce(lambda a, c: a | F.contains(text, F.lit(c)), _LINE_ENDS[1:], F.lit(False))
    return F.when(other, F.split(text, f"[{_LINE_ENDS}]")).otherwise(F.split(text, "\n"))


def _weak(text: Column, lines: Column, pattern: str) -> Column:
    """How often a pattern occurs. Words in order on a line are found once in it, if at all; a pattern of them would read the line's rest for each of the first."""
    parts = pattern.split(".*")
    if len(parts) < 2 or not all(parts) or any(re.escape(p).replace("\\ ", " ") != p for p in parts):
        return F.regexp_count(text, F.lit(pattern)).cast("long")

    def ordered(line: Column, at: Column, rest: list[str]) -> Column:
        here = F.position(F.lit(rest[0]), line, at)
        return here > 0 if len(rest) == 1 else let(here, lambda p: (p > 0) & ordered(line, p + len(rest[0]), rest[1:]))

    all_of = reduce(lambda a, p: a & F.contains(text, F.lit(p)), parts, F.lit(True))
    return F.when(all_of, F.size(F.filter(lines, lambda x: ordered(x, F.lit(1), parts)))).otherwise(0).cast("long")


# What strong words, weak patterns, conflict and repetition count for a rule's confidence.
BASE, STRONG, WEAK, CONFLICT, REPEATED = 0.5, 0.15, 0.1, 0.25, 0.1
NEUTRAL_CAP, WEAK_CAP, SURE = 0.6, 0.55, 0.7


def rule_confidence(found: Column, flat: Column, strong: Column, weak: Column, conflict: Column) -> Column:
    """Confidence of a direction that was found: strong words add, weak patterns and conflict take away, neutral and weak-only ones are capped."""
    raw = BASE + STRONG * strong - WEAK * weak - F.when(conflict, CONFLICT).otherwise(0.0) + F.when((strong >= 2) & ~conflict, REPEATED * (strong - 1)).otherwise(0.0)
    raw = F.when(flat, F.least(raw, F.lit(NEUTRAL_CAP))).otherwise(raw)
    raw = F.when((strong == 0) & (weak > 0), F.least(raw, F.lit(WEAK_CAP))).otherwise(raw)
    return F.when(found, F.least(F.greatest(F.round(raw, 2), F.lit(0.0)), F.lit(1.0))).otherwise(0.0)


def directions(docs: DataFrame, pack: DirectionPack = ZH_DIRECTIONS, names: tuple[str, str, str] = DIRECTIONS, text: str = "text") -> DataFrame:
    """docs with up, down, flat (occurrences), strong and weak (words and patterns that occur), direction (ties in the order up, down, flat), conflict, confidence, and whether a model is to be asked."""
    x, total = F.col(text), lambda columns: reduce(lambda a, y: a + y, columns, F.lit(0).cast("long"))
    sides = {n: ([f"_{n}_s{i}" for i in range(len(s))], [f"_{n}_w{i}" for i in range(len(w))]) for n, s, w in zip(("up", "down", "flat"), (pack.up, pack.down, pack.flat), (pack.up_weak, pack.down_weak, pack.flat_weak), strict=True)}
    words = {c: _strong(x, w) for n, s in zip(sides, (pack.up, pack.down, pack.flat), strict=True) for c, w in zip(sides[n][0], s, strict=True)}
    patterns = {c: _weak(x, F.col("_lines"), p) for n, s in zip(sides, (pack.up_weak, pack.down_weak, pack.flat_weak), strict=True) for c, p in zip(sides[n][1], s, strict=True)}
    # each count is read several times
    counted = settled(settled(docs, _lines=_pattern_lines(x)), **words, **patterns)
    kinds = [[c for s in sides.values() for c in s[k]] for k in (0, 1)]
    found = {n: total(map(F.col, s + w)) for n, (s, w) in sides.items()} | {k: total((F.col(c) > 0).cast("long") for c in cs) for k, cs in zip(("strong", "weak"), kinds, strict=True)}
    out = counted.select(*docs.columns, *(v.alias(k) for k, v in found.items()))
    top = F.greatest("up", "down", "flat")
    direction = F.when(top == 0, None).when(F.col("up") == top, names[0]).when(F.col("down") == top, names[1]).otherwise(names[2])
    out = out.withColumns({"direction": direction, "conflict": (F.col("up") > 0) & (F.col("down") > 0)})
    score = rule_confidence(F.col("direction").isNotNull(), F.col("direction") == names[2], F.col("strong"), F.col("weak"), F.col("conflict"))
    return out.withColumn("confidence", score).withColumn("need_llm", (F.col("confidence") < SURE) | F.col("direction").isNull() | F.col("conflict"))


def arbitrated(signals: DataFrame) -> DataFrame:
    """Weighted arbitration of signals (article_id, product_key, direction, weight, confidence, and factor where context counts): the winner, its confidence, whether it is accepted, and the decision."""
    score = F.col("weight") * F.col("confidence") * (F.col("factor") if "factor" in signals.columns else F.lit(1.0))
    sums = signals.groupBy("article_id", "product_key").agg(*[F.round(F.sum(F.when(F.col("direction") == d, score).otherwise(0.0)), 9).alias(n) for d, n in zip(DIRECTIONS, ("up", "down", "flat"), strict=True)])
    return judged(sums).withColumn("decision", F.when(F.col("accepted"), "rule_accept").otherwise("llm_fallback"))


def judged(sums: DataFrame) -> DataFrame:
    """Sums of scores (up, down, flat) turned into direction, confidence and accepted, beside their other columns."""
    ranked = F.sort_array(F.array("up", "down", "flat"), asc=False)
    out = sums.withColumns({"best": ranked[0], "margin": F.round(ranked[0] - ranked[1], 9), "total": F.col("up") + F.col("down") + F.col("flat")})
    winner = F.when(F.col("up") == F.col("best"), DIRECTIONS[0]).when(F.col("down") == F.col("best"), DIRECTIONS[1]).otherwise(DIRECTIONS[2])
    clash = (F.col("up") >= 0.75) & (F.col("down") >= 0.75) & (F.col("margin") < 1)
    sure = ((F.col("best") >= 1.5) & (F.col("margin") >= 0.5)) | (F.col("margin") >= 0.2)
    confidence = F.least(F.lit(1.0), F.coalesce(F.try_divide("best", "total"), F.lit(0.0)) + F.least("margin", F.lit(1.0)) * 0.15)
    accepted = sure & ~clash
    more = [c for c in sums.columns if c not in ("up", "down", "flat")]
    return out.select(*more, winner.alias("direction"), F.round(confidence, 4).alias("confidence"), accepted.alias("accepted"))


def decided(arbitration: DataFrame, mentions: DataFrame) -> DataFrame:
    """Every mentioned product (article_id, product_key) with its decision: no_signal where none was found."""
    joined = mentions.select("article_id", "product_key").distinct().join(arbitration, ["article_id", "product_key"], "left")
    return joined.withColumn("decision", F.coalesce("decision", F.lit("no_signal")))


# Classes of evidence for an alias.
HIGH_VALUE = ("contract_code", "bracket_heading", "label_field", "catalog_alias", "title_symbol")
SHAPE = ("contract_code", "suffix_pattern", "symbol_context", "title_symbol", "ocr_split_symbol")
CONTEXT = ("market_context", "symbol_context", "ocr_split_symbol")
CATALOG = ("catalog_alias", "contract_code", "symbol_context", "title_symbol", "ocr_split_symbol")
FUTURES = ("contract_code", "suffix_pattern", "symbol_context", "ocr_split_symbol", "market_context")
ANCHORS = ("bracket_heading", "label_field", "title_symbol", "contract_code", "symbol_context", "ocr_split_symbol", "market_context")


def candidate_status(df: DataFrame) -> DataFrame:
    """Score and status of alias candidates: alias, kinds (array), docs, occurrences, keys (array), negative (array of reasons), seed (the catalog's key for it, or null)."""
    has = lambda group: F.arrays_overlap("kinds", F.array(*map(F.lit, group)))
    part = lambda c, x: F.when(c, x).otherwise(0.0)
    negative = F.size("negative") > 0
    classes = has(SHAPE).cast("int") + has(CATALOG).cast("int") + has(CONTEXT).cast("int")
    raw = part(has(HIGH_VALUE), 0.44) + part(has(SHAPE), 0.22) + part(has(CATALOG), 0.24) + part(has(CONTEXT), 0.18) + F.least(F.lit(0.12), 0.04 * F.col("docs"))
    raw = raw + part(F.col("occurrences") >= 3, 0.05) - part(F.size("keys") > 1, 0.28) - part(negative, 0.5)
    raw = F.when((classes < 2) & ~has(("bracket_heading", "label_field")), F.least(raw, F.lit(0.55))).otherwise(raw)
    score = F.when(negative & (F.col("occurrences") == 0), 0.0).otherwise(F.round(F.least(F.greatest(raw, F.lit(0.0)), F.lit(1.0)), 4))
    key = F.coalesce("seed", F.when(F.size("keys") == 1, F.get("keys", F.lit(0))))
    letters = F.regexp_count("alias", F.lit("[A-Za-z]"))
    shaped = F.col("alias").rlike(r"^[一-鿿A-Za-z0-9]{2,12}\z") & ~F.col("alias").rlike(r"^\d+\z") & (F.col("alias").rlike("[一-鿿]") | (letters >= 2))
    reviewable = shaped & has(FUTURES) & has(ANCHORS) & (F.col("docs") >= 2)
    out = df.withColumns({"score": score, "suggested": key, "_classes": classes, "_ok": reviewable, "_negative": negative})
    status = (
        F.when(F.col("_negative") & ((F.col("occurrences") == 0) | (F.col("score") < 0.35)), "rejected")
        .when(F.col("seed").isNotNull(), "approved_seed")
        .when(F.col("suggested").isNotNull() & (F.col("_classes") >= 2) & (F.col("score") >= 0.72), "auto_approved")
        .when(F.col("suggested").isNotNull() & (F.col("score") >= 0.35), "review_required")
        .when(F.col("suggested").isNull() & ~F.col("_ok"), "rejected")
        .when(F.col("score") >= 0.35, "review_required")
        .otherwise("rejected")
    )
    return out.withColumn("status", status).drop("_classes", "_ok", "_negative")
