"""Evidence: whole sentences of a product's own text that show its direction, and candidates among which a model may choose.

Sentences, mentions and signals of a document meet by order within it (as-of), not by range joins."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstream.functions.columns import BLANKS, settled
from quillstream.functions.phrases import clean_quote
from quillstream.operators import spans as sp

# Marks of sentences and clauses, and words that mark comparisons, conclusions and boilerplate.
ENDINGS, CLAUSES = "。！？!?", "，,；;。！？!?\n"
COMPARISONS = ("跟随", "价差", "联动", "替代", "相比", "相较", "带动", "成本", "矛盾", "关注", "提振")
CONCLUSIONS = ("综合来看", "总体来看", "预计", "预期", "短期", "后期", "操作方面", "建议", "维持")
BOILERPLATE = ("重要声明", "免责声明", "本报告由", "不构成对客户的投资建议", "报告中的观点、结论和建议", "信息和建议不会发生任何变更", "在任何情况下，本公司不对", "交易者需自行承担风险", "本报告版权", "未经书面许可", "版权所有", "联系人", "网址", "数据来自")
HEADING = r"【\s*[^】\n]{1,40}?\s*】"
NO_START = r"^(?:[，。；：！？!?%、,.])"


def sentences(docs: DataFrame, endings: str = ENDINGS) -> DataFrame:
    """doc_id, start, stop, phrase: pieces that end in a mark; what stands before a `|` belongs to none."""
    marks = re.escape(endings)
    # what no mark ends is a piece too: else each of its characters would be tried as a beginning
    found = sp.spans(docs.select("doc_id", "text"), {"s": f"[^{marks}|]*+[{marks}|]|[^{marks}|]++"})
    return found.filter(F.right("phrase", F.lit(1)).isin(*endings)).select("doc_id", "start", "stop", "phrase")


def whole(quote: Column, endings: str, heading: str = HEADING) -> Column:
    """Whether a quote is a sentence from its beginning to its mark, without headings."""
    return F.right(quote, F.lit(1)).rlike(f"[{re.escape(endings)}]") & ~quote.rlike(NO_START) & ~quote.rlike(heading)


def offers(quote: Column, endings: str, boilerplate, heading: str = HEADING) -> Column:
    """Whether a quote may be evidence by itself."""
    sound = F.length(quote).between(6, 600) & whole(quote, endings, heading)
    for words in boilerplate:
        sound = sound & ~F.contains(quote, F.lit(words))
    return sound


def apart(listed: Column, most: int) -> Column:
    """The first `most` of an array of sentences (start, stop, quote) that neither overlap nor hold an earlier one."""

    def same(x: Column, y: Column) -> Column:
        shared = F.greatest(F.least(x["stop"], y["stop"]) - F.greatest(x["start"], y["start"]), F.lit(0))
        return F.contains(x["quote"], y["quote"]) | F.contains(y["quote"], x["quote"]) | (shared / F.greatest(F.least(x["stop"] - x["start"], y["stop"] - y["start"]), F.lit(1)) >= 0.8)

    none = F.filter(listed, lambda x: F.lit(False))
    return F.aggregate(listed, none, lambda acc, x: F.when((F.size(acc) >= most) | F.exists(acc, lambda y: same(x, y)), acc).otherwise(F.array_append(acc, x)))


def within(parts: DataFrame, area: DataFrame) -> DataFrame:
    """Sentences (of `mentioned`) in each product's scopes (doc_id, product_key, start, stop, ...): doc_id, product_key, start, stop, phrase, mentions, cut to the scope's beginning and without blanks before it, and the scope's own columns in `scope`.

    Places alone are sorted into scopes; a sentence's text is joined to what is left, once."""
    keys = area.select("doc_id", "product_key").distinct()
    own = parts.select("doc_id", F.struct("start", "stop").alias("s")).join(keys, "doc_id").select("doc_id", "product_key", (F.col("s.stop") - 1).alias("at"), F.lit(1).alias("side"), "s")
    columns = F.struct(*[F.col(c) for c in area.columns if c not in ("doc_id", "product_key")])
    areas = area.select("doc_id", "product_key", F.col("start").cast("bigint").alias("at"), F.lit(0).alias("side"), columns.alias("scope"))
    last = F.last("scope", True).over(Window.partitionBy("doc_id", "product_key").orderBy("at", "side").rowsBetween(Window.unboundedPreceding, 0))
    held = own.unionByName(areas, allowMissingColumns=True).withColumn("scope", last).filter("side = 1 AND s.stop <= scope.stop")
    texts = parts.select("doc_id", "stop", F.col("start").alias("_from"), "phrase", F.col("mentions").alias("_m"))
    joined = held.select("doc_id", F.col("s.stop").alias("stop"), "product_key", "scope").join(texts, ["doc_id", "stop"])
    low = F.greatest(F.col("_from"), F.col("scope.start"))
    raw = F.substring("phrase", (low - F.col("_from") + 1).cast("int"), (F.col("stop") - low).cast("int"))
    cut = settled(joined, phrase=F.regexp_replace(raw, rf"^[\n{BLANKS}]+", "")).withColumn("start", F.col("stop") - F.length("phrase")).filter("start < stop")
    return cut.select("doc_id", "product_key", "start", "stop", "phrase", F.filter("_m", lambda m: m["start"] >= F.col("start")).alias("mentions"), "scope")


def mentioned(parts: DataFrame, found: DataFrame) -> DataFrame:
    """Sentences with mentions: an array of (start, key) of the matches that begin in each."""
    points = found.select("doc_id", F.col("start").alias("at"), F.lit(1).alias("side"), "product_key").withColumnRenamed("product_key", "key")
    # a match belongs to the first sentence that ends after it
    both = points.unionByName(parts.select("doc_id", (F.col("stop") - 1).alias("at"), F.lit(0).alias("side"), F.struct("start", "stop").alias("s")), allowMissingColumns=True)
    # looked for backwards: a frame that shrinks from row to row is read anew for each
    first = F.last("s", True).over(Window.partitionBy("doc_id").orderBy(F.desc("at"), "side").rowsBetween(Window.unboundedPreceding, 0))
    own = both.withColumn("s", first).filter("side = 1 AND at >= s.start").groupBy("doc_id", F.col("s.stop").alias("stop")).agg(F.array_sort(F.collect_list(F.struct(F.col("at").alias("start"), "key"))).alias("mentions"))
    none = F.array().cast("array<struct<start:bigint,key:string>>")
    return parts.join(own, ["doc_id", "stop"], "left").withColumn("mentions", F.coalesce("mentions", none))


def candidates(docs: DataFrame, found: DataFrame, area: DataFrame, items: int = 6, chars: int = 1200, endings: str = ENDINGS, conclusions=CONCLUSIONS, boilerplate=BOILERPLATE, heading: str = HEADING) -> DataFrame:
    """doc_id, product_key, evidence_id, start, stop, quote of the sentences in a product's scopes (start, stop, shared) that may be evidence.

    They are numbered in the text's order; sentences about others alone are left out, and in shared scopes those that do not name the product. The ones with most conclusions, then those that name it, then the earliest come first, within a budget of items and characters (longer ones are passed over)."""
    own = within(mentioned(sentences(docs, endings), found), area)
    target = F.exists("mentions", lambda m: m["key"] == F.col("product_key"))
    rows = settled(own, quote=clean_quote("phrase"), target=target)
    kept = rows.filter(offers(F.col("quote"), endings, boilerplate, heading) & (F.col("target") | ((F.size("mentions") == 0) & ~F.col("scope.shared"))))
    score = F.size(F.filter(F.array(*map(F.lit, conclusions)), lambda w: F.contains(F.col("quote"), w)))
    number = F.row_number().over(Window.partitionBy("doc_id", "product_key").orderBy("start", "stop"))
    ranked = kept.select("doc_id", "product_key", F.struct((-score).alias("a"), F.when(F.col("target"), 0).otherwise(1).alias("b"), "start", "stop", "quote", F.concat(F.lit("E"), number).alias("evidence_id")).alias("x"))
    listed = ranked.groupBy("doc_id", "product_key").agg(F.array_sort(F.collect_list("x")).alias("all"))
    start = F.struct(F.filter("all", lambda x: F.lit(False)).alias("kept"), F.lit(0).alias("chars"))

    def take(acc: Column, x: Column) -> Column:
        longer = acc["chars"] + F.length(x["quote"])
        return F.when((F.size(acc["kept"]) < items) & (longer <= chars), F.struct(F.array_append(acc["kept"], x).alias("kept"), longer.alias("chars"))).otherwise(acc)

    chosen = listed.select("doc_id", "product_key", F.posexplode(F.aggregate("all", start, take, lambda acc: acc["kept"])).alias("rank", "x"))
    return chosen.select("doc_id", "product_key", "rank", "x.evidence_id", "x.start", "x.stop", "x.quote")


def proofs(docs: DataFrame, found: DataFrame, area: DataFrame, signals: DataFrame, most: int = 3, endings: str = ENDINGS, clauses: str = CLAUSES, comparisons=COMPARISONS, heading: str = HEADING) -> DataFrame:
    """doc_id, product_key, place, start, stop, quote: up to `most` whole sentences in which a signal (doc_id, product_key, start, stop) of the product stands in its own scopes.

    A signal that opens its sentence proves nothing. A sentence that names another product counts only if the signal's clause names the product alone, or the sentence compares. Of sentences that overlap or hold each other the first stays."""
    own = within(mentioned(sentences(docs, endings), found), area).drop("scope")
    points = signals.select("doc_id", "product_key", F.col("start").alias("at"), F.lit(1).alias("side"), F.struct(F.col("start").cast("bigint").alias("start"), F.col("stop").cast("bigint").alias("stop")).alias("signal"))
    ends = own.select("doc_id", "product_key", (F.col("stop") - 1).alias("at"), F.lit(0).alias("side"), F.struct("start", "stop").alias("s"))
    first = F.last("s", True).over(Window.partitionBy("doc_id", "product_key").orderBy(F.desc("at"), "side").rowsBetween(Window.unboundedPreceding, 0))
    rows = points.unionByName(ends, allowMissingColumns=True).withColumn("s", first).filter("side = 1 AND s.start < signal.start AND signal.stop <= s.stop")
    # places alone were sorted; the sentences' texts are joined to the signals in them
    rows = rows.select("doc_id", F.col("s.stop").alias("stop"), "product_key", "signal").join(own, ["doc_id", "stop", "product_key"])
    rows = rows.select("doc_id", "product_key", "signal", F.struct("start", "stop", "phrase", "mentions").alias("s"))
    quote = clean_quote(F.col("s.phrase"))
    # the signal's clause, within its sentence
    marks = re.escape(clauses)
    before = F.substring("s.phrase", F.lit(1), (F.col("signal.start") - F.col("s.start")).cast("int"))
    after = F.substring("s.phrase", (F.col("signal.stop") - F.col("s.start") + 1).cast("int"), F.length("s.phrase"))
    low = F.col("signal.start") - F.length(F.regexp_extract(before, rf"([^{marks}]*)\z", 1))
    high = F.col("signal.stop") + F.length(F.regexp_extract(after, rf"^([^{marks}]*[{marks}]?)", 1))
    rows = settled(rows, quote=quote, low=low, high=high)
    key = F.col("product_key")
    other = F.exists("s.mentions", lambda m: m["key"] != key)
    inside = lambda m: (m["start"] >= F.col("low")) & (m["start"] < F.col("high"))
    alone = F.exists("s.mentions", lambda m: inside(m) & (m["key"] == key)) & ~F.exists("s.mentions", lambda m: inside(m) & (m["key"] != key))
    compared = F.col("quote").rlike("|".join(map(re.escape, comparisons)))
    sound = (F.length("quote") >= 8) & whole(F.col("quote"), endings, heading) & (~other | alone | compared)
    # of a sentence's signals the first speaks for all: the others' quote is its own and would be left out
    good = rows.filter(sound).groupBy("doc_id", "product_key", F.col("s.start").alias("start"), F.col("s.stop").alias("stop")).agg(F.min(F.struct(F.col("signal.start").alias("at"), F.col("signal.stop").alias("until"))).alias("f"), F.min("quote").alias("quote"))
    listed = good.groupBy("doc_id", "product_key").agg(F.array_sort(F.collect_list(F.struct("f.at", "f.until", "start", "stop", "quote"))).alias("all"))
    return listed.select("doc_id", "product_key", F.posexplode(apart(F.col("all"), most)).alias("place", "x")).select("doc_id", "product_key", "place", "x.start", "x.stop", "x.quote")
