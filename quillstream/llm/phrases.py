"""Phrase collocations by multikey three-way quicksort of suffix pointers.

A suffix begins at each word and ends with its piece. Pointers to suffixes are partitioned by the word at the
current depth into less, equal and greater; equal partitions go one word deeper, to `DEEPEST` at most, and
their sizes are the counts of their phrases. Many partitions are split at once by array operations, so a round
costs one pass over the pointers that are still unsettled.

Tasks first sort the suffixes of their own documents, whereby any phrase leaves a task once per `HELD` words at
most, however common it is. Phrases are then routed over the cluster by the words that lead their suffixes, packed
by the part that they go to, and each part is sorted again with the counts as weights: partitions that hold fewer
than `LEAST` occurrences are abandoned, at any depth. A task holds `HELD` words or one part.
Scores are joins of the counts that remain, in exact decimals.

Words are runs without blanks in pieces between `.,;:!?` and line ends, A-Z lower-cased.

Defined results: null and empty texts have no words; a null lang is `und`; repeated rows count each time; equal
scores go by count, then by phrase; texts of any length are read whole; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstream.llm.common import bounds, tidy, written

DEEPEST = 3
#: A phrase occurs at least so often.
LEAST = 10
#: A phrase goes if one that holds it has at least so many percent of its count.
WITHIN = 50
#: The report's length for each language.
TOP = 2000
#: Words, or bytes of them, that a task sorts at once.
HELD, HELD_BYTES = 1_500_000, 96 << 20
#: Parts of phrases for each task that sorts them again, and parts in which a language is ranked first.
PARTS, RANKED = 2, 64

#: A count is below 10^14, so a million times its square keeps within the 38 digits of a decimal.
_SCORE = "(CAST(1000000 AS DECIMAL(7, 0)) * (CAST(a AS DECIMAL(14, 0)) * CAST(a AS DECIMAL(14, 0)))) DIV (CAST(l AS DECIMAL(14, 0)) * CAST(r AS DECIMAL(14, 0)))"
_BREAK = "\n"
_COLUMNS = ["lang", "w1", "w2", "w3", "n"]


def equal_partitions(keys: np.ndarray, weights: np.ndarray | None = None, least: int = 1) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(depth, a pointer into it, weight) of the equal partitions of suffixes, by multikey three-way quicksort.

    keys[d][p] is the word (as a number) at depth d of suffix p, negative beyond its end. Partitions of a weight
    under `least` are abandoned. Unit weights if none are given."""
    depths, n = keys.shape
    flat = keys.ravel()
    pointers = np.arange(n, dtype=np.int32)
    sizes, depth = np.array([n], np.int64), np.zeros(1, np.int64)
    while len(pointers):
        starts = np.cumsum(sizes) - sizes
        owner = np.repeat(np.arange(len(sizes)), sizes)
        value = flat[pointers + np.repeat(depth * n, sizes)]
        pivot = np.sort(np.stack([value[starts], value[starts + sizes // 2], value[starts + sizes - 1]]), axis=0)[1]
        pivot_of = pivot[owner]
        side = (value >= pivot_of).astype(np.int8) + (value > pivot_of)
        # stable places: a partition's less, equal and greater parts stand one behind the other
        parts = np.stack([np.add.reduceat(side == k, starts, dtype=np.int64) for k in range(3)], axis=1)
        begins = (np.cumsum(parts.ravel()) - parts.ravel()).reshape(-1, 3)
        place = np.empty(len(pointers), np.int32)
        for k in range(3):
            at = np.flatnonzero(side == k)
            place[at] = np.arange(len(at)) + np.repeat(begins[:, k] - (np.cumsum(parts[:, k]) - parts[:, k]), parts[:, k])
        sorted_pointers = np.empty_like(pointers)
        sorted_pointers[place] = pointers
        sizes, begins = parts.ravel(), begins.ravel()
        depth = np.repeat(depth, 3)
        equal = np.tile(np.array([False, True, False]), len(sizes) // 3)
        ended = equal & (np.repeat(pivot, 3) < 0)
        here = sizes > 0
        weight = sizes.copy()
        if weights is not None:
            weight[here] = np.add.reduceat(weights[sorted_pointers], begins[here])
        enough = here & ~ended & (weight >= least)
        found = enough & equal
        for d in range(depths):
            at = found & (depth == d)
            if at.any():
                yield d, sorted_pointers[begins[at]], weight[at]
        kept = enough & ~(equal & (depth == depths - 1))
        depth = depth + equal
        # a partition of one suffix needs no further comparison: its deeper prefixes are partitions of their own
        single = kept & (sizes == 1)
        left, at_depth, weighs = sorted_pointers[begins[single]], depth[single], weight[single]
        for d in range(depths):
            ends = (at_depth <= d) & (flat[left + d * n] < 0)
            left, at_depth, weighs = left[~ends], at_depth[~ends], weighs[~ends]
            at = at_depth <= d
            if at.any():
                yield d, left[at], weighs[at]
        kept &= ~single
        pointers = sorted_pointers[np.repeat(kept, sizes)]
        sizes, depth = sizes[kept], depth[kept]


def _packed(batch: pa.RecordBatch) -> bytes:
    """A batch as compressed Arrow bytes."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpacked(block: bytes) -> pa.Table:
    return pa.ipc.open_stream(block).read_all()


def _keys(langs: list[pa.Array], words: list[pa.Array]) -> tuple[np.ndarray, pa.Array]:
    """The suffixes of some documents' words as rows of numbers (language, then words, -1 beyond the end), and what these stand for.

    words holds breaks between pieces, langs a language for each word."""
    lang = pa.chunked_array(langs).combine_chunks().dictionary_encode()
    word = pa.chunked_array(words).combine_chunks().dictionary_encode()
    ranked = pc.sort_indices(word.dictionary)
    names = word.dictionary.take(ranked)
    rank = np.empty(len(names), np.int32)
    rank[ranked.to_numpy()] = np.arange(len(names), dtype=np.int32)
    first = rank[word.indices.to_numpy(zero_copy_only=False)]
    first[first == pc.index(names, _BREAK).as_py()] = -1
    keys = np.full((DEEPEST + 1, len(first)), -1, np.int32)
    keys[0], keys[1] = lang.indices.to_numpy(zero_copy_only=False) + len(names), first
    for k in range(2, DEEPEST + 1):
        keys[k, : len(first) - k + 1] = first[k - 1 :]
        keys[k, keys[k - 1] < 0] = -1
    return keys[:, first >= 0], pa.concat_arrays([names, lang.dictionary])


def _dealt(keys: np.ndarray, names: pa.Array, parts: int) -> Iterator[pa.RecordBatch]:
    """part, words, rows: the phrases of some suffixes with their counts, packed by the part to which their words route them."""
    rows: list[np.ndarray] = []
    for d, at, weight in equal_partitions(keys) if keys.shape[1] else ():
        if d:
            found = np.full((DEEPEST + 2, len(at)), -1, np.int32)
            found[: d + 1], found[-1] = keys[: d + 1, at], weight
            rows.append(found)
    if not rows:
        return
    found = np.concatenate(rows, axis=1)
    hashes = np.append(pd.util.hash_array(np.array(names.to_pylist(), object), categorize=False), np.uint64(0))
    route = np.zeros(found.shape[1], np.uint64)
    for k in range(DEEPEST + 1):
        route = (route ^ hashes[found[k]]) * np.uint64(0x9E3779B97F4A7C15)
    part = ((route >> np.uint64(32)) % np.uint64(parts)).astype(np.int32)
    order = np.argsort(part.astype(np.int16) if parts < 1 << 15 else part, kind="stable")
    edges = bounds(part[order])
    seen, short = np.zeros(len(names) + 1, bool), np.zeros(len(names) + 1, np.int32)
    short[-1] = -1
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        own = found[:, order[lo:hi]]
        seen[own[:-1]] = True
        known = np.flatnonzero(seen[:-1])
        short[known] = np.arange(len(known))
        codes = short[own[:-1]]
        seen[known] = False
        held = pa.record_batch({"word": names.take(pa.array(known))})
        small = codes.astype(np.int16 if len(known) < 1 << 15 else np.int32)
        rows_ = pa.record_batch({**{f"c{k}": pa.array(small[k]) for k in range(DEEPEST + 1)}, "n": pa.array(own[-1])})
        yield pa.record_batch({"part": pa.array([int(part[order[lo]])], pa.int32()), "words": pa.array([_packed(held)], pa.binary()), "rows": pa.array([_packed(rows_)], pa.binary())})


def _local(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The phrases of a task's documents, each once for HELD words."""
        langs, words, held, size = [], [], 0, 0
        for batch in batches:
            for at in range(0, batch.num_rows, 32):
                part = batch.take(pa.array(range(at, min(at + 32, batch.num_rows))))  # a copy: ascii_lower misreads slices
                text = pc.ascii_lower(pc.fill_null(part["text"], "").cast(pa.large_string()))
                marked = pc.binary_join_element_wise(pc.replace_substring_regex(text, "[.,;:!?\n-\r]", f" {_BREAK} "), pa.scalar(_BREAK, pa.large_string()), pa.scalar(" ", pa.large_string()))
                split = pc.split_pattern_regex(marked, "[ \t]+")
                flat = split.flatten()
                lang = pc.fill_null(part["lang"], "und").take(pc.list_parent_indices(split))
                whole = pc.not_equal(flat, "")
                words.append(flat.filter(whole).cast(pa.string()))
                langs.append(lang.filter(whole))
                held, size = held + len(words[-1]), size + words[-1].nbytes
                if held >= HELD or size >= HELD_BYTES:
                    yield from _dealt(*_keys(langs, words), parts)
                    langs, words, held, size = [], [], 0, 0
        if held:
            yield from _dealt(*_keys(langs, words), parts)

    return run


def _merged(blocks: list[tuple[bytes, bytes]], least: int) -> Iterator[pa.RecordBatch]:
    """The phrases of one part that occur often enough, and for each language all words of the part (without a phrase)."""
    names, keys, weights, past = [], [], [], 0
    for words, rows in blocks:
        name, row = _unpacked(words)["word"].combine_chunks(), _unpacked(rows)
        codes = np.stack([row[f"c{k}"].to_numpy() for k in range(DEEPEST + 1)]).astype(np.int32)
        keys.append(np.where(codes < 0, -1, codes + past))
        names.append(name)
        weights.append(row["n"].to_numpy().astype(np.int64))
        past += len(name)
    known = pa.concat_arrays(names).dictionary_encode()
    code = np.append(known.indices.to_numpy(zero_copy_only=False).astype(np.int32), np.int32(-1))
    key, weight = code[np.concatenate(keys, axis=1)], np.concatenate(weights)
    length = (key >= 0).sum(axis=0)
    # each length apart: a phrase's own rows make its count, not those of longer phrases that it begins
    for k in range(2, DEEPEST + 2):
        at = np.flatnonzero(length == k)
        if not len(at):
            continue
        own, counted = key[:k, at], weight[at]
        for d, pointers, total in equal_partitions(own, counted, least):
            if d == k - 1:
                columns = [known.dictionary.take(pa.array(own[j, pointers])) if j < k else pa.nulls(len(total), pa.string()) for j in range(DEEPEST + 1)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(total.astype(np.int64))], names=_COLUMNS)
        if k == 2:
            lang, where = np.unique(own[0], return_inverse=True)
            none = pa.nulls(len(lang), pa.string())
            yield pa.RecordBatch.from_arrays([known.dictionary.take(pa.array(lang)), none, none, none, pa.array(np.bincount(where, counted).astype(np.int64))], names=_COLUMNS)


def _routed(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A partition is one part."""
        blocks = [pair for batch in batches for pair in zip(batch["words"].to_pylist(), batch["rows"].to_pylist(), strict=True)]
        if blocks:
            yield from _merged(blocks, least)

    return run


def counts(docs: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """lang, w1, w2, w3 (null beyond the phrase's end), n of the phrases of up to 3 words that occur at least so often, a written table;
    and lang, total, all word occurrences."""
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = docs.select("text", "lang").mapInArrow(tidy(_local(PARTS * tasks)), "part int, words binary, rows binary")
    routed = dealt.repartitionById(PARTS * tasks, F.col("part"))
    found = written(routed.mapInArrow(tidy(_routed(least)), ", ".join(f"{c} {'long' if c == 'n' else 'string'}" for c in _COLUMNS)))
    return found.filter("w1 IS NOT NULL"), found.filter("w1 IS NULL").groupBy("lang").agg(F.sum("n").alias("total"))


def _part(first: int, last: int):
    return F.concat_ws(" ", *(f"w{k}" for k in range(first, last + 1)))


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first phrases of 2 or 3 words by the score of their weakest cut."""
    phrases, totals = counts(docs, least)
    known = phrases.select("lang", _part(1, 3).alias("phrase"), "n")

    def cut(length: int, k: int) -> DataFrame:
        """Phrases of a length with the counts of their first k words and of the rest: frequent as they are, both are known."""
        rows = phrases.filter("w2 IS NOT NULL AND w3 IS NULL" if length == 2 else "w3 IS NOT NULL").select("lang", _part(1, length).alias("phrase"), _part(1, k).alias("head"), _part(k + 1, length).alias("tail"), F.col("n").alias("a"))
        for side, count in (("head", "l"), ("tail", "r")):
            rows = rows.join(known.select("lang", F.col("phrase").alias(side), F.col("n").alias(count)), ["lang", side])
        return rows.select("lang", "phrase", F.lit(length).alias("length"), F.lit(k).alias("k"), "a", "l", "r")

    cuts = cut(2, 1).union(cut(3, 1)).union(cut(3, 2))
    scored = cuts.withColumn("score", F.expr(_SCORE))
    weakest = scored.groupBy("lang", "phrase", "length", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("w")).select("lang", "phrase", "length", "a", "w.score", "w.l", "w.r")
    longer = phrases.filter("w3 IS NOT NULL")
    inside = longer.select("lang", F.explode(F.array(_part(1, 2), _part(2, 3))).alias("phrase"), "n").groupBy("lang", "phrase").agg(F.max("n").alias("holder"))
    kept = weakest.join(inside, ["lang", "phrase"], "left").filter(f"length = {DEEPEST} OR holder IS NULL OR 100 * holder < {WITHIN} * a")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    in_part = Window.partitionBy("lang", "part").orderBy(*order)
    first = kept.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(RANKED))).withColumn("rank", F.row_number().over(in_part)).filter(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("total").alias("n"), "score")
