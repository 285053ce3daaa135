"""Cleaned texts into sections, blocks and segments of products, and rules over each product's text."""

from __future__ import annotations

import re
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstream.functions.columns import BLANK_SIGNS, contract_key, settled, stripped
from quillstream.functions.phrases import block_fingerprint
from quillstream.operators import spans as sp
from quillstream.operators.text import directions
from quillstream.packs import GENERIC_HEADINGS, SECTION_TYPES, ZH_DIRECTIONS, DirectionPack
from quillstream.sources.bindings import DIRECTIONS, UNKNOWN_PRODUCT

HEADING = r"(?m)^##\s+[^\n]+?[ \t]*$"
BRACKET = "【[^】]{1,20}】"


def trimmed(text: Column, start: Column) -> tuple[Column, Column, Column]:
    """A piece of text that begins at `start` without blanks at its ends: its text, start and stop."""
    lead = F.length(text) - F.length(F.ltrim(text, F.lit(BLANK_SIGNS)))
    bare = stripped(text)
    return bare, start + lead, start + lead + F.length(bare)


def _starts(sizes: Column) -> Column:
    """Where each of some pieces begins, by the pieces' lengths (an array). Running sums of one row's numbers: neither texts nor a window have to be moved for them."""

    @F.pandas_udf("array<bigint>")
    def run(rows: pd.Series) -> pd.Series:
        return rows.map(lambda x: None if x is None else np.cumsum(x, dtype=np.int64) - x)

    return run(sizes)


def sections(docs: DataFrame, types: dict[str, str] = SECTION_TYPES) -> DataFrame:
    """doc_id, section, heading, section_type, start, stop, text of the parts under `## ` headings; a text without any is one core section. Empty ones are left out."""
    # headings and what lies between them: each text is cut once and stays in its task
    cut = settled(docs.select("doc_id", "text"), heads=F.regexp_extract_all("text", F.lit(HEADING), F.lit(0)), gaps=F.split("text", HEADING, -1)).drop("text")
    # what stands before the first heading is no section
    sized = F.transform("gaps", lambda x, i: F.length(x) + F.when(i > 0, F.length(F.get("heads", i - 1))).otherwise(0))
    ends = cut.withColumn("starts", _starts(sized))
    whole = F.size("heads") == 0
    at = lambda i: F.get("starts", i) + F.when(i > 0, F.length(F.get("heads", i - 1))).otherwise(0)
    made = F.transform("gaps", lambda x, i: F.struct(F.when(i > 0, F.get("heads", i - 1)).alias("phrase"), at(i).alias("from"), stripped(x).alias("bare"), x.alias("raw")))
    full = F.filter(made, lambda y: (y["bare"] != "") & (whole | y["phrase"].isNotNull()))
    rows = ends.select("doc_id", F.posexplode(full).alias("pos", "x"))
    heading = F.when(F.col("x.phrase").isNull(), "").otherwise(stripped(F.regexp_replace("x.phrase", r"^##", "")))
    text, start, stop = trimmed(F.col("x.raw"), F.col("x.from"))
    named = rows.select("doc_id", heading.alias("heading"), start.alias("start"), stop.alias("stop"), text.alias("text"), (F.col("pos") + 1).alias("section"))
    kind = F.coalesce(F.create_map(*[F.lit(x) for kv in types.items() for x in kv])[F.col("heading")], F.lit("core"))
    return named.select("doc_id", "heading", kind.alias("section_type"), "start", "stop", "text", "section")


class Names:
    """Aliases and contract symbols of products, as patterns."""

    def __init__(self, aliases: dict[str, str], symbols: dict[str, str] | None = None, barred: dict[str, tuple[str, ...]] | None = None) -> None:
        self.barred = barred or {}
        self.aliases, self.symbols = {a.lower(): k for a, k in aliases.items()}, {s.lower(): k for s, k in (symbols or {}).items()}
        ordered = sorted(self.aliases, key=lambda a: (-len(a), a))
        # an alias may not stand right behind certain words
        behind = lambda a: "".join(f"(?<!{re.escape(w)})" for w in self.barred.get(a, ()))
        of = lambda a: behind(a) + (rf"(?<![A-Za-z0-9]){re.escape(a)}(?![A-Za-z0-9])" if re.fullmatch("[a-z0-9]+", a) else re.escape(a))
        # a symbol stands alone or before a contract's digits; one of a single letter only before these
        coded = lambda s: rf"(?<![A-Za-z0-9]){re.escape(s)}(?:\d{{3,4}}){'' if len(s) == 1 else '?'}(?![A-Za-z0-9])"
        # the names are tried, with what may not stand before each, only where one of their first characters does
        firsts = "".join(sorted({c for x in (*self.aliases, *self.symbols) if x for c in (x[0], x[0].upper()) if len(c) == 1 and (c == x[0] or x[0].isascii())}))
        # in both cases, since a class without case is far slower
        here = f"(?-i:(?=[{re.escape(firsts)}]))" if firsts and "" not in self.aliases and "" not in self.symbols else ""
        self.pattern = f"(?i){here}(?:" + "|".join([*(of(a) for a in ordered), *(coded(s) for s in sorted(self.symbols, key=lambda s: (-len(s), s)))]) + ")"
        known = "|".join(re.escape(x) for x in sorted({*self.symbols, *(a for a in self.aliases if re.fullmatch("[a-z]{1,5}", a))}, key=lambda s: (-len(s), s))) or "(?!)"
        self.contract = rf"(?i)(?:{known})\d{{2,4}}\s*合约"
        plain = "|".join(re.escape(a) for a in ordered)
        self.prefix = rf"(?i)(?:(?:{known})\d{{2,4}}\s*合约|(?:{plain})(?:\s*[：:]|\s|\z))"

    def barring(self, barred: dict[str, tuple[str, ...]]) -> Names:
        """The same names, some of them not right behind certain words."""
        return Names(self.aliases, self.symbols, barred)

    def matches(self, docs: DataFrame) -> DataFrame:
        """doc_id, product_key, start, stop and tier (contract: a symbol, with or without digits; builtin: another alias) of all names in texts."""
        found = sp.spans(docs, {"name": self.pattern})
        bare, code = F.lower("phrase"), F.regexp_replace(F.lower("phrase"), r"\d+$", "")
        of = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv]) if d else F.create_map(F.lit(""), F.lit(""))
        by_code, by_name = of(self.symbols)[code], of(self.aliases)[bare]
        return found.select("doc_id", F.coalesce(by_code, by_name).alias("product_key"), "start", "stop", F.when(by_code.isNotNull(), "contract").otherwise("builtin").alias("tier"))

    def keys(self, text: Column) -> Column:
        """Product keys of all names in a text, in order."""
        pairs = F.create_map(*[F.lit(x) for kv in (self.symbols | self.aliases).items() for x in kv])
        found = F.regexp_extract_all(text, F.lit(self.pattern), F.lit(0))
        return F.filter(F.transform(found, lambda x: F.coalesce(pairs[F.lower(x)], pairs[F.lower(F.regexp_replace(x, r"\d+$", ""))])), lambda k: k.isNotNull())

    def resolved(self, name: Column) -> Column:
        """The key of a name that one alias or contract spells whole; else null."""
        bare = F.regexp_replace(F.lower(name), r"[\s【】\[\]():：（）]+", "")
        pairs = F.create_map(*[F.lit(x) for kv in (self.symbols | self.aliases).items() for x in kv])
        whole = bare.rlike(rf"^(?:{self.pattern[4:]})\z") if self.pattern else F.lit(False)
        return F.when(whole, F.coalesce(pairs[bare], pairs[F.regexp_replace(bare, r"\d+$", "")]))

    def code(self, text: Column, least: int = 2) -> Column:
        """The first contract code of a known symbol, else the digits before 合约."""
        codes = F.regexp_extract_all(text, F.lit(rf"\b([A-Za-z]{{1,3}}\d{{{least},4}})(?:\s*合约|[^A-Za-z0-9]|\z)"), F.lit(1))
        known = F.get(F.filter(codes, lambda c: F.lower(F.regexp_replace(c, r"\d", "")).isin(*self.symbols) if self.symbols else F.lit(False)), F.lit(0))
        return F.coalesce(known, F.nullif(F.regexp_extract(text, r"([0-9]{2,4})\s*合约", 1), F.lit("")))


def _borders(names: Names) -> str:
    """A pattern of the places where blocks begin, to cut texts at: it takes no character, so blanks before a contract or line stay with it."""
    # brackets as matches from left to right find them: none begins within 20 characters before the same closing one
    bracket = "|".join(f"(?<!【[^】]{{0,{19 - n}}})(?=【[^】]{{{n}}}】)" if n < 20 else f"(?=【[^】]{{{n}}}】)" for n in range(1, 21))
    contract = rf"(?<=\A|[\n。！？；;])(?=\s*(?i:{names.contract[4:]}))"
    # a line with # counts if its heading names a product
    line = rf"(?<=\n)(?=[ \t]*(?=\S)(?:#|【|{names.prefix[4:]}))"
    return f"(?=【)(?:{bracket})|{line}|{contract}"


def blocks(parts: DataFrame, names: Names) -> DataFrame:
    """Sections (as `sections` gives them) cut where a bracket heading, a contract code or a line of a product begins: doc_id, section, section_type, heading, explicit, start, stop, text."""
    own = parts.select("doc_id", "section", "section_type", F.col("heading").alias("section_heading"), F.col("start").alias("_base"), "text")
    split = settled(own, pieces=F.split("text", _borders(names), -1)).drop("text")
    placed = split.withColumn("starts", _starts(F.transform("pieces", F.length)))
    pieces = placed.select(*(c for c in own.columns if c != "text"), F.inline(F.arrays_zip("pieces", "starts")).alias("raw", "from"))
    text, start, stop = trimmed(F.col("raw"), F.col("from"))
    joined = settled(pieces, text=text, _start=start, _stop=stop).drop("raw", "from").filter("text <> ''")
    joined = settled(joined, _first=stripped(F.substring_index("text", "\n", 1)))
    first = F.col("_first")
    bracket = F.regexp_extract(first, "^【([^】]{1,20})】", 1)
    prefixed = first.rlike("^" + names.prefix)
    code = F.regexp_extract(first, r"^([A-Za-z]{1,5})\d{2,4}\s*合约", 1)
    title = F.when(first.startswith("#"), F.regexp_replace(first, r"^#+\s*", "")).when(F.trim(bracket) != "", bracket).when((code != "") & prefixed, code).when(prefixed, F.left(F.trim(F.regexp_extract(first, "^([^：:]*)", 1)), F.lit(80))).otherwise("")
    out = settled(joined, _title=title)
    return out.select("doc_id", "section", "section_type", F.when(F.col("_title") != "", F.col("_title")).otherwise(F.col("section_heading")).alias("heading"), (F.col("_title") != "").alias("explicit"), (F.col("_base") + F.col("_start")).alias("start"), (F.col("_base") + F.col("_stop")).alias("stop"), "text")


def segments(cut: DataFrame, names: Names, generic: tuple[str, ...] = GENERIC_HEADINGS) -> DataFrame:
    """doc_id, segment_index, product_key ('' if unknown), contract, section_type, heading, start, stop, text, confidence, way of the blocks' segments.

    A heading that names one product decides; else the products of an explicit heading, else those of the text: one alone, one that leads, or the sentences around each; what cannot be told apart is a mixed segment for each."""
    key = names.resolved(F.col("heading"))
    by_heading = F.when(F.col("explicit"), names.keys(F.col("heading"))).otherwise(F.array().cast("array<string>"))
    strange = F.col("explicit") & (F.size("_head") == 0) & ~F.col("heading").isin(*generic)
    # each is read many times below: computed once, and not copied into the filters by way
    rows = settled(settled(cut, _key=key, _head=by_heading), _all=F.when(F.size("_head") > 0, F.col("_head")).otherwise(names.keys(F.col("text"))))
    rows = settled(rows, _distinct=F.array_distinct("_all"))
    times = F.array_sort(F.transform("_distinct", lambda k: F.struct((-F.size(F.filter("_all", lambda x: x == k))).alias("n"), F.array_position("_all", k).alias("at"), k.alias("k"))))
    rows = settled(rows, _ranked=times)
    lead = F.get("_ranked", F.lit(0))
    leading = (lead["n"] <= -2) & (lead["n"] < F.get("_ranked", F.lit(1))["n"])
    marks = F.size(F.regexp_extract_all("text", F.lit("(" + BRACKET + ")"), F.lit(1))) + F.size(F.regexp_extract_all("text", F.lit(r"(?m)^(?:" + names.prefix[4:] + ")"), F.lit(0)))
    way = (
        F.when(F.col("section_type") == "unknown", "unknown")
        .when(F.col("_key").isNotNull(), "heading")
        .when(strange | (F.size("_distinct") == 0), "unknown")
        .when(F.size("_distinct") == 1, "single")
        .when(leading & (marks < 2), "leading")
        .otherwise("split")
    )
    rows = settled(rows, way=way)
    sure = F.create_map(*[F.lit(x) for kv in {"unknown": 0.1, "heading": 0.96, "single": 0.9, "leading": 0.82}.items() for x in kv])[F.col("way")]
    product = F.when(F.col("way") == "heading", F.col("_key")).when(F.col("way") == "single", F.get("_distinct", F.lit(0))).when(F.col("way") == "leading", lead["k"]).otherwise("")
    whole = rows.filter("way <> 'split'").select("doc_id", "section", "section_type", "heading", "start", "stop", "text", product.alias("product_key"), sure.alias("confidence"), "way", F.lit(0).alias("place"), F.col("start").alias("_block"))
    return _indexed(whole.unionByName(_split(rows.filter("way = 'split'"), names)), names)


def _split(rows: DataFrame, names: Names) -> DataFrame:
    """Segments of blocks with several products: from the sentence before the first mention to that after the last."""
    listed = F.transform("_ranked", lambda r: r["k"])
    pieces = F.regexp_extract_all("text", F.lit("([^。！？；]*[。！？；]|[^。！？；]+)"), F.lit(1))
    base = rows.select("doc_id", "section", "section_type", "heading", "start", "stop", "text", listed.alias("products"), F.posexplode(pieces).alias("i", "piece"))
    block = ["doc_id", "section", "start"]
    by = Window.partitionBy(*block).orderBy("i")
    placed = base.withColumn("_to", F.sum(F.length("piece")).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    placed = placed.withColumns({"_from": F.col("_to") - F.length("piece"), "_names": names.keys(F.col("piece"))}).filter(F.regexp_replace("piece", r"\s+", "") != "")
    placed = placed.withColumns({"_i": F.row_number().over(by)})
    edges = placed.withColumns({"_low": F.coalesce(F.lag("_from").over(by), F.col("_from")), "_high": F.coalesce(F.lead("_to").over(by), F.col("_to"))})
    hit = edges.select(*block, "section_type", "heading", "stop", "text", F.posexplode("products").alias("place", "product_key"), "_low", "_high", "_names").filter(F.array_contains("_names", F.col("product_key")))
    spans = hit.groupBy(*block, "section_type", "heading", "stop", "text", "place", "product_key").agg(F.min("_low").alias("_low"), F.max("_high").alias("_high"))
    raw = F.substring("text", (F.col("_low") + 1).cast("int"), (F.col("_high") - F.col("_low")).cast("int"))
    local, low, high = trimmed(raw, F.col("_low"))
    parts = spans.select(*block, "section_type", "heading", "stop", "place", "product_key", F.col("text").alias("whole"), local.alias("local"), low.alias("low"), high.alias("high"))
    bare = lambda c: F.regexp_replace(c, r"\s+", "")
    same = F.min((bare("local") == bare("whole")).cast("int")).over(Window.partitionBy(*block)) == 1
    told = parts.withColumn("_same", same)
    mixed = F.col("_same")
    return told.select("doc_id", "section", F.when(mixed, "mixed").otherwise(F.col("section_type")).alias("section_type"), "heading", F.when(mixed, F.col("start")).otherwise(F.col("start") + F.col("low")).alias("start"), F.when(mixed, F.col("stop")).otherwise(F.col("start") + F.col("high")).alias("stop"), F.when(mixed, F.col("whole")).otherwise(F.col("local")).alias("text"), "product_key", F.when(mixed, 0.35).otherwise(0.72).alias("confidence"), F.when(mixed, "mixed").otherwise("split").alias("way"), "place", F.col("start").alias("_block"))


def _indexed(rows: DataFrame, names: Names) -> DataFrame:
    order = Window.partitionBy("doc_id").orderBy("section", "_block", "place")
    return rows.filter("text <> ''").select("doc_id", (F.row_number().over(order) - 1).cast("long").alias("segment_index"), "product_key", names.code(F.col("text")).alias("contract"), "section_type", "heading", "start", "stop", "text", "confidence", "way")


def overridden(parts: DataFrame, manual: DataFrame) -> DataFrame:
    """Segments with fingerprint; those that a manual key (fingerprint, manual_key) names are its product's, surely."""
    marked = parts.withColumn("fingerprint", block_fingerprint(F.col("heading"), F.col("start"), F.col("stop"), "text"))
    joined = marked.join(manual.select("fingerprint", "manual_key"), "fingerprint", "left")
    hit = F.col("manual_key").isNotNull()
    return joined.withColumns({"product_key": F.coalesce("manual_key", "product_key"), "confidence": F.when(hit, 1.0).otherwise(F.col("confidence")), "way": F.when(hit, "manual").otherwise(F.col("way"))}).drop("manual_key")


def unknown_blocks(marked: DataFrame, most: int = 1000) -> DataFrame:
    """Fingerprint, segment_index, raw_name and excerpt of the segments whose product is not known, outside unknown sections."""
    return marked.filter("product_key = '' AND section_type <> 'unknown'").select("doc_id", "fingerprint", "segment_index", F.col("heading").alias("raw_name"), F.left("text", F.lit(most)).alias("excerpt"), "start", "stop")


def candidates(parts: DataFrame) -> DataFrame:
    """doc_id, product_key, contract_key, text and section_types (in order, each once) of each product and contract: its segments one under another."""
    known = parts.filter((F.col("product_key") != "") & (F.col("section_type") != "unknown") & (F.trim("text") != ""))
    held = F.array_sort(F.collect_list(F.struct("segment_index", F.trim("text").alias("t"), F.col("section_type").alias("s"))))
    rows = known.groupBy("doc_id", "product_key", contract_key("contract").alias("contract_key")).agg(held.alias("_all"))
    return rows.select("doc_id", "product_key", "contract_key", F.array_join(F.transform("_all", lambda x: x["t"]), "\n").alias("text"), F.array_join(F.array_distinct(F.transform("_all", lambda x: x["s"])), ",").alias("section_types"))


def reasons(ruled: DataFrame, pack: DirectionPack = ZH_DIRECTIONS, names: tuple[str, str, str] = DIRECTIONS, window: int = 2, most: int = 220, marks: str = "。！？；\n") -> DataFrame:
    """ruled (direction, text) with reason: the sentences within `window` of a strong word of the direction, else the text's beginning."""
    # a line end behind each mark: cut there, pieces keep their marks, and without blanks they are what stood between marks
    broken = reduce(lambda a, m: F.replace(a, F.lit(m), F.lit(m + "\n")), marks.replace("\n", ""), F.col("text"))
    cut = F.split(broken, "\n") if "\n" in marks else F.regexp_extract_all("text", F.lit(f"([^{marks}]*[{marks}]|[^{marks}]+)"), F.lit(1))
    pieces = F.filter(F.transform(cut, stripped), lambda x: x != "")
    words = dict(zip(names, (pack.up, pack.down, pack.flat), strict=True))
    is_hit = lambda x: reduce(lambda a, n: a | ((F.col("direction") == n) & reduce(lambda b, w: b | F.contains(x, F.lit(w)), words[n], F.lit(False))), names, F.lit(False))
    # texts without a direction are not cut; flags next to a sentence tell whether it is near, not all hits of the text
    rows = settled(ruled, _s=F.when(F.col("direction").isNotNull(), pieces))
    rows = settled(rows, _h=F.transform("_s", is_hit))
    at = lambda i: F.when(i >= 0, F.get("_h", i))
    near = F.filter("_s", lambda x, i: reduce(lambda a, k: a | F.coalesce(at(i + k), F.lit(False)), range(-window, window + 1), F.lit(False)))
    compact = F.left(F.trim(F.regexp_replace("text", r"\s+", " ")), F.lit(most))
    reason = F.when(F.col("direction").isNull(), "").otherwise(F.coalesce(F.nullif(F.array_join(near, ""), F.lit("")), compact))
    return rows.withColumn("reason", reason).drop("_s", "_h")


def rule_results(found: DataFrame, pack: DirectionPack = ZH_DIRECTIONS) -> DataFrame:
    """candidates with direction, confidence, need_llm, reason, saved (sure enough to be stored) and is_primary (the surest of those)."""
    ruled = reasons(directions(found, pack), pack)
    out = ruled.withColumn("saved", ~F.col("need_llm") & F.col("direction").isNotNull())
    best = Window.partitionBy("doc_id").orderBy(F.desc("saved"), F.desc("confidence"), "product_key", "contract_key")
    return out.withColumn("is_primary", F.col("saved") & (F.row_number().over(best) == 1))


def rule_status(results: DataFrame, docs: DataFrame) -> DataFrame:
    """doc_id, status and need_llm after the rules: stored (5) if all results are sure, else rule-analysed (3), which a model completes; a text without any product is one of these."""
    by = results.groupBy("doc_id").agg(F.bool_or("need_llm").alias("_llm"), F.array_join(F.array_sort(F.collect_set(F.when(F.col("need_llm"), F.col("product_key")))), ",").alias("_keys"))
    joined = docs.select("doc_id").join(by, "doc_id", "left")
    ask = F.coalesce("_llm", F.lit(True))
    return joined.select("doc_id", F.when(ask, 3).otherwise(5).alias("status"), F.when(F.col("_llm").isNull(), UNKNOWN_PRODUCT).otherwise(F.col("_keys")).alias("need_llm"))
