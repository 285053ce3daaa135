"""Finding aliases of products in texts: where they occur and with what evidence, what speaks against them, and the index of those that are known."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import accumulate, chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstream.functions.columns import settled
from quillstream.functions.phrases import alias_key, nfkc, shown_alias, without_ends
from quillstream.operators.tables import sliced

# Words of a market's context, foreign prefixes, words that are no alias, and the shapes in which aliases occur.
MARKET = ("上涨", "下跌", "涨", "跌", "反弹", "回落", "偏强", "偏弱", "震荡", "库存", "基差", "开工", "利润", "持仓", "成交", "供应", "需求", "供需", "价格", "现货", "期货", "合约", "主力")
FOREIGN = ("COMEX", "LME", "WTI", "BRENT", "美")
STOP = ("收藏本页面", "FAS", "OCR", "EMAIL", "TEL", "PHONE", "Mysteel")
LEADING = "当前|近期|短期|长期|国内|国际|外盘|主力|品种|商品"
SHAPES = {
    "contract_code": r"(?i)(?<![A-Za-z0-9])([A-Za-z](?:\s*[A-Za-z]){0,4})\s*\d{2,4}\s*合约",
    "bracket_heading": r"[【\[]\s*([^】\]\n]{1,30})\s*[】\]]",
    "label_field": r"(?:品种|商品)\s*[：:]\s*([A-Za-z]{1,8}|[一-鿿A-Za-z0-9（）()]{1,16})",
    "suffix_pattern": r"([一-鿿A-Za-z0-9（）()]{1,16}?)(?:期货|主力|合约)",
    "symbol_context": r"(?<![A-Za-z0-9])([A-Za-z]{2,5})(?![A-Za-z0-9])",
    "ocr_split_symbol": r"(?<![A-Za-z0-9])([A-Za-z](?:\s+[A-Za-z]){1,4})(?![A-Za-z0-9])",
    "market_context": r"([一-鿿A-Za-z]{1,12})",
}
#: A match of these shapes holds one of these words, which plain searches find.
SIGNS = {"contract_code": ("合约",), "bracket_heading": ("【", "["), "label_field": ("品种", "商品"), "suffix_pattern": ("期货", "主力", "合约")}
AROUND, BEFORE, AFTER = 28, 12, 32


def alias_index(catalog: DataFrame) -> DataFrame:
    """alias, product_keys (sorted): every spelling of a catalog's names, aliases and symbols (product_key, display_name, official_name, symbol, aliases)."""
    names = F.concat(F.array("display_name", "official_name", "symbol"), F.coalesce("aliases", F.array().cast("array<string>")))
    rows = catalog.select("product_key", F.explode(names).alias("raw")).select("product_key", alias_key("raw", canonical=True).alias("alias")).filter("alias <> ''")
    return rows.groupBy("alias").agg(F.array_sort(F.collect_set("product_key")).alias("product_keys"))


def contract_patterns(symbol: Column) -> Column:
    """Two patterns for a symbol's contracts: with digits alone, and before 合约."""
    edge, s = "(?<![A-Za-z0-9])", F.upper(symbol)
    both = F.array(F.concat(F.lit(edge), s, F.lit(r"\d{2,4}(?![A-Za-z0-9])")), F.concat(F.lit(edge), s, F.lit(r"\s*\d{2,4}\s*合约")))
    return F.when(F.coalesce(symbol, F.lit("")) != "", both).otherwise(F.array().cast("array<string>"))


def before_and_after(text: Column, start: Column) -> tuple[Column, Column]:
    """The characters before an alias by which its context is told, and those from its beginning on."""
    low = F.greatest(start - BEFORE, F.lit(0))
    return F.substring(text, (low + 1).cast("int"), (start - low).cast("int")), F.substring(text, (start + 1).cast("int"), F.lit(AFTER))


def in_context(docs: DataFrame, pattern: str) -> DataFrame:
    """doc_id, start, phrase, before, after (as `before_and_after` cuts them) of a pattern's matches in texts.

    One pass over each text, wherever it lies: neither its places nor the text itself are moved to meet each other."""
    found = re.compile(pattern, re.ASCII)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 64):
            ids, starts, phrases, before, after = [], [], [], [], []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                for m in found.finditer(text or ""):
                    at = m.start()
                    ids.append(doc)
                    starts.append(at)
                    phrases.append(m[0])
                    before.append(text[max(at - BEFORE, 0) : at])
                    after.append(text[at : at + AFTER])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(starts, pa.int64()), *(pa.array(x, pa.string()) for x in (phrases, before, after))], names=["doc_id", "start", "phrase", "before", "after"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, start long, phrase string, before string, after string")


def foreign_context(before: Column, alias: Column, after: Column, prefixes: tuple[str, ...] = FOREIGN) -> Column:
    """Whether an alias stands by a mail address or right behind a foreign market's name, told by what `before_and_after` cuts out."""
    around = F.concat(before, alias, after)
    return F.contains(before, F.lit("@")) | F.contains(around, F.lit("@")) & around.rlike(r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+") | before.rlike(f"(?i)(?:{'|'.join(map(re.escape, prefixes))})\\z")


def rejection(alias: Column, kind: Column, stop: tuple[str, ...] = STOP, institutions: tuple[str, ...] = ("免责", "公司"), ) -> Column:
    """The first reason why something cannot be an alias; null if none."""
    shown, key = shown_alias(alias), alias_key(alias, canonical=True)
    compact = F.regexp_replace(shown, r"\s+", "")
    number = r"[+-]?\d+(?:\.\d+)?"
    place = r"[+-]?\d{1,3}(?:\.\d+)?(?:°|度)?[NSEW东西南北]?"
    marks = F.regexp_count(compact, F.lit(r"[\p{P}\p{S}]"))
    return (
        F.when(key == "", "bad_alias_shape")
        .when(shown.rlike(r"[\x00-\x08\x0E-\x1F\x7F]"), "control_character")
        .when(shown.rlike("[�\u0080-¿]"), "mojibake")
        .when(compact.rlike(rf"(?i)^(?:{number}[%‰]?|{number}(?:-|~|至|到){number}[%‰]?|{place}(?:[,，/、]{place})?)\z"), "numeric_coordinate_or_range")
        .when((F.length(compact) == 0) | (marks / F.greatest(F.length(compact), F.lit(1)) >= 0.4), "punctuation_dominated")
        .when(shown.isin(*stop), "bad_alias_shape")
        .when(shown.rlike("|".join(map(re.escape, institutions))), "institution_or_disclaimer")
        .when(shown.startswith("图片分片"), "bad_alias_shape")
        .when(shown.rlike(r"\d+\s*/\s*\d+"), "numeric_coordinate_or_range")
        .when(shown.rlike(r"(?i)^[A-Z]{1,5}(?:日报|周报|月报|季报)(?:\d{4,8})?\z"), "bad_alias_shape")
        .when(kind.isin("bracket_heading", "label_field", "suffix_pattern") & (F.length(key) > 16), "bad_alias_shape")
        .when(shown.rlike(r"(?i)^[FZ]\d{5,}\z|\.(?:com|cn|pdf|html?)\z|qh\d+|www|http|@"), "bad_alias_shape")
    )


def _apart(word: str, signs: str) -> str:
    """A word that none of some signs touches, as a pattern that begins with its letters: places without its first one are passed over at once."""
    return f"{re.escape(word)}(?<![{signs}]{re.escape(word)})(?![{signs}])"


def _any(patterns: Iterable[str]) -> re.Pattern:
    return re.compile("|".join(patterns) or "(?!)", re.ASCII)


class Shapes:
    """Finds what may name a product: known aliases, the shapes, and of words (of which texts are full) only those that are known."""

    def __init__(self, known: Iterable[str], codes: Iterable[str], market: Iterable[str]) -> None:
        latin, letters = "a-z0-9", "a-z一-鿿"
        self.shapes = {kind: re.compile(SHAPES[kind], re.ASCII) for kind in (*SIGNS, "ocr_split_symbol")}
        ordered = sorted(filter(None, known), key=lambda a: (-len(a), a))
        self.aliases = _any(_apart(a, latin) if re.fullmatch("[a-z0-9]+", a) else re.escape(a) for a in ordered)
        self.codes = set(codes)
        symbols = sorted(c for c in self.codes if re.fullmatch("[a-z]{2,5}", c))
        self.symbols = _any(_apart(c, latin) for c in symbols)
        self.spread = _any(rf"{c[0]}(?<![{latin}]{c[0]})\s+" + r"\s+".join(c[1:]) + f"(?![{latin}])" for c in symbols)
        # in a market's context a run of letters counts in pieces of twelve
        self.words = {a for a in ordered if re.fullmatch(f"[{letters}]{{2,12}}", a)}
        self.runs, self.long = _any(_apart(a, letters) for a in sorted(self.words)), re.compile(f"[{letters}]{{13,}}")
        self.market = re.compile("|".join(map(re.escape, market)))

    def found(self, text: str) -> Iterator[tuple[str, int, int, str]]:
        """(kind, start, stop, what is named)"""
        low = text.encode().lower().decode()  # ASCII alone, so that places stay
        for m in self.aliases.finditer(low):
            yield "catalog_alias", m.start(), m.end(), text[m.start() : m.end()]
        for kind, signs in SIGNS.items():
            if any(s in text for s in signs):
                for m in self.shapes[kind].finditer(text):
                    if kind != "contract_code" or "".join(m[1].split()).lower() in self.codes:
                        yield kind, m.start(), m.end(), m[1]
        yield from ((kind, a, b, text[a:b]) for kind, a, b in self._words(low) if self.market.search(text, max(a - AROUND, 0), b + AROUND))

    def _words(self, low: str) -> Iterator[tuple[str, int, int]]:
        for m in self.symbols.finditer(low):
            yield "symbol_context", m.start(), m.end()
        if self.spread.search(low):
            for m in self.shapes["ocr_split_symbol"].finditer(low):
                if "".join(m[0].split()) in self.codes:
                    yield "ocr_split_symbol", m.start(), m.end()
        for m in self.runs.finditer(low):
            yield "market_context", m.start(), m.end()
        for m in self.long.finditer(low) if self.words else ():
            for at in range(m.start(), m.end(), 12):
                if low[at : min(at + 12, m.end())] in self.words:
                    yield "market_context", at, min(at + 12, m.end())


def shaped(docs: DataFrame, known: Iterable[str], codes: Iterable[str], market: Iterable[str]) -> DataFrame:
    """kind, raw, places (doc_id, start, before, after, as `before_and_after` cuts them) of what `Shapes` finds, in one pass over each text, wherever it lies.

    What is found again in the next texts of a task is a place of the same row: what follows from its name alone is then asked once."""
    known, codes, market = tuple(known), tuple(codes), tuple(market)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shapes = Shapes(known, codes, market)
        for batch in sliced(batches, 64):
            found: dict[tuple[str, str], list] = {}
            for row, text in enumerate(batch.column("whole").to_pylist()):
                for kind, start, _, raw in shapes.found(text) if text else ():
                    found.setdefault((kind, raw), []).append((row, start, text[max(start - BEFORE, 0) : start], text[start : start + AFTER]))
            rows, starts, before, after = zip(*chain(*found.values())) if found else ((),) * 4
            places = pa.StructArray.from_arrays([batch.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(starts, pa.int64()), pa.array(before, pa.string()), pa.array(after, pa.string())], names=["doc_id", "start", "before", "after"])
            ends = pa.array([0, *accumulate(map(len, found.values()))], pa.int32())
            yield pa.RecordBatch.from_arrays([*(pa.array([k[i] for k in found], pa.string()) for i in (0, 1)), pa.ListArray.from_arrays(ends, places)], names=["kind", "raw", "places"])

    number = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").alias("whole")).mapInArrow(run, f"kind string, raw string, places array<struct<doc_id: {number}, start: bigint, before: string, after: string>>")


def occurrences(docs: DataFrame, aliases: dict[str, str], symbols: dict[str, str], market: tuple[str, ...] = MARKET, foreign: tuple[str, ...] = FOREIGN) -> DataFrame:
    """doc_id, alias, kind, product_key (null if unlinked), start, negative (a reason, or null) of everything that may name a product.

    Kinds: known aliases, contract codes, bracket headings (in their parts where these are known), label fields, words before 期货 and the like, symbols (as one word or spread) and known words with a market's words nearby."""
    known = {a.lower(): k for a, k in aliases.items()}
    codes = {s.lower(): k for s, k in symbols.items()}
    bracket = F.col("kind") == "bracket_heading"
    rows = shaped(docs, known, codes, market).withColumn("_raw", nfkc(F.when(bracket, F.col("raw"))))
    parts = F.when(bracket, F.transform(F.split("_raw", "[/／、,，和及]"), without_ends)).otherwise(F.array("raw"))
    pairs = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv]) if d else F.create_map(F.lit(""), F.lit(""))
    index = pairs({k: v for k, v in known.items()})
    code_of = pairs(codes)
    known_parts = F.filter(parts, lambda p: index[F.lower(p)].isNotNull())
    rows = rows.withColumn("alias", F.explode(F.when((F.size(parts) > 1) & (F.size(known_parts) > 0), known_parts).otherwise(F.array("raw"))))
    bare = F.lower(F.regexp_replace("alias", r"\s+", ""))
    alias = F.when(F.col("kind") == "suffix_pattern", F.regexp_replace("alias", f"^(?:{LEADING})", "")).when(F.col("kind").isin("contract_code", "ocr_split_symbol"), F.upper(bare)).otherwise(F.col("alias"))
    rows = rows.withColumns({"alias": shown_alias(alias), "_code": code_of[bare]})
    rows = settled(rows.select("kind", "places", "alias", "_code"), _name=index[F.lower("alias")])
    coded = F.col("kind").isin("contract_code", "symbol_context", "ocr_split_symbol")
    kept = rows.filter(coded | (F.col("alias") != "")).select("alias", "kind", F.when(coded, F.col("_code")).otherwise(F.col("_name")).alias("product_key"), rejection(F.col("alias"), F.col("kind")).alias("shape"), "places")
    each = kept.select("alias", "kind", "product_key", "shape", F.inline("places"))
    negative = F.coalesce("shape", F.when(F.col("product_key").isNotNull() & foreign_context(F.col("before"), F.col("alias"), F.col("after"), foreign), "foreign_market_context"))
    return each.select("doc_id", "alias", "kind", "product_key", "start", negative.alias("negative"))
