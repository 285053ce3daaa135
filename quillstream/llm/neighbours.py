"""Approximate nearest neighbours by multi-index hashing.

Vectors get binary codes: signs after learned rotations (principal axes, then rotations that bring the
signs close to the values), fitted on a bounded sample. A code is split into substrings, each of which has
an index. By the pigeonhole principle a code within radius r of the query's agrees, in at least one
substring, to within r // m bits (one bit less beyond the first r % m + 1 substrings): probing those
buckets retrieves every code within r. The original vectors of all that is retrieved are then compared in
double precision. Many short substrings with a small radius in each prune best: the radius is the one that
retrieves `COVER` of the true neighbours, among all rows, of `PROBES` rows of the sample. A block with too few hits widens it.

Equal vectors are searched once: an index entry is a distinct vector with the rows of least ids that have
it (as many as an answer can hold), so a vector that a third of all rows have costs no more than another.
All rows are indexed, in blocks dealt by a hash; queries stream past each block, so a task holds one block.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components take no part.
A row is a candidate for every query but itself: rows that repeat an id are rows each, also as queries; rows
without an id are candidates, after those with one. Vectors of another length have no distance and are
not found; each length has its own codes (one that the sample lacks is searched whole). Ties go to the
smaller id, then to the row read first. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstream.llm.common import written

#: Rows that the rotations and the radius are fitted on, at most.
SAMPLE = 6000
BITS, SUBSTRING = 1024, 16
PARTS = BITS // SUBSTRING
#: Share of the true neighbours of so many sampled rows that probing retrieves.
COVER, PROBES = 0.94, 128
#: Distinct vectors of a block, which a task holds, and the number of blocks aimed at in between.
BLOCK_ROWS, BLOCKS = (4096, 131072), 24
#: Stands for a null id: after all others.
NO_ID = (1 << 63) - 1

_COUNT = np.bitwise_count(np.arange(1 << SUBSTRING, dtype=np.uint16))
#: Values of a substring in order of their number of bits, and where each number ends.
_BALL = np.argsort(_COUNT, kind="stable").astype(np.uint16)
_BALL_END = np.cumsum(np.bincount(_COUNT))


def reaches(radius: int) -> np.ndarray:
    """Bits by which each substring may differ, so that codes within `radius` agree in one; -1: it is not probed."""
    near, more = divmod(min(radius, BITS), PARTS)
    return np.minimum(np.where(np.arange(PARTS) <= more, near, near - 1), SUBSTRING)


class Codes:
    """Rotations and the search radius for vectors of one length."""

    def __init__(self, sample: np.ndarray, seed: int = 3) -> None:
        rng = np.random.default_rng(seed)
        self.mean, self.radius = sample.mean(0), BITS
        centred = sample - self.mean
        _, _, axes = np.linalg.svd(centred, full_matrices=False)
        kept = min(len(axes), BITS)
        values = centred @ axes[:kept].T
        parts = []
        for _ in range(-(-BITS // kept)):
            turn, _ = np.linalg.qr(rng.standard_normal((kept, kept)))
            for _ in range(15):  # alternate between signs and the rotation that fits them
                u, _, v = np.linalg.svd(np.where(values @ turn >= 0, 1.0, -1.0).T @ values)
                turn = (u @ v).T
            parts.append(axes[:kept].T @ turn)
        self.turn = np.concatenate(parts, 1)[:, :BITS].astype(np.float32)

    def of(self, vectors: np.ndarray) -> np.ndarray:
        """Codes as substrings, [rows, PARTS] of 16 bits."""
        out = [np.packbits((vectors[i : i + 8192] - self.mean).astype(np.float32) @ self.turn >= 0, axis=1) for i in range(0, len(vectors), 8192)]
        return np.concatenate(out).view(np.uint16)


class Block:
    """Index of some distinct vectors of one length: for each substring, entries in order of its value."""

    def __init__(self, vectors: np.ndarray, members: list, coder: Codes | None) -> None:
        self.vectors, self.members, self.coder = vectors, members, coder
        if coder is not None:
            codes = coder.of(vectors)
            self.order = np.argsort(codes, axis=0, kind="stable").T.astype(np.int32)
            ends = [np.cumsum(np.bincount(c, minlength=1 << SUBSTRING)) for c in codes.T]
            self.start = np.concatenate([np.concatenate([[0], e]) for e in ends]).astype(np.int32)

    def probed(self, code: np.ndarray, radius: int) -> np.ndarray:
        """All entries that agree with `code` in a substring: every code within the radius is among them."""
        reach = reaches(radius)
        part = np.repeat(np.arange(PARTS), np.where(reach < 0, 0, _BALL_END[reach]))
        place = np.concatenate([_BALL[: _BALL_END[r]] for r in reach if r >= 0])
        bucket = part * ((1 << SUBSTRING) + 1) + (place ^ code[part])
        low, n = self.start[bucket], self.start[bucket + 1] - self.start[bucket]
        full = np.flatnonzero(n)
        low, n, part = low[full], n[full], part[full]
        spots = np.arange(n.sum()) + np.repeat(low - np.cumsum(n) + n, n)
        seen = np.zeros(len(self.vectors), bool)
        seen[self.order[np.repeat(part, n), spots]] = True
        return np.flatnonzero(seen)

    def nearest(self, vector: np.ndarray, code: np.ndarray | None, k: int) -> list[tuple[float, int, int]]:
        """(distance, id, row) of the k nearest rows."""
        if self.coder is None:
            at = np.arange(len(self.vectors))
        else:
            radius, wanted = self.coder.radius, min(k, len(self.vectors))
            at = self.probed(code, radius)
            while len(at) < wanted and radius < BITS:
                radius = min(BITS, radius + PARTS)
                at = self.probed(code, radius)
        d = np.sqrt(((self.vectors[at] - vector) ** 2).sum(1))
        if len(at) > k:  # an entry has a row at least: those no further than the k-th
            close = d <= np.partition(d, k - 1)[k - 1]
            at, d = at[close], d[close]
        return sorted((float(x), m["id"], m["row"]) for x, i in zip(d, at, strict=True) for m in self.members[i])[:k]


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding (array of double) and row (a number) of the rows that take part. A written table."""
    ok = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).filter(ok)
    return written(rows.withColumn("row", F.monotonically_increasing_id()))


def _distinct(vectors: DataFrame, k: int) -> DataFrame:
    """cid, embedding and members (the k rows of least id, as id and row) of each distinct vector. A written table."""
    named = vectors.select("embedding", F.coalesce("vec_id", F.lit(NO_ID)).alias("id"), "row")
    ranked = named.withColumn("n", F.row_number().over(Window.partitionBy("embedding").orderBy("id", "row"))).filter(F.col("n") <= k)
    held = ranked.groupBy("embedding").agg(F.sort_array(F.collect_list(F.struct("id", "row"))).alias("members"))
    return written(held.withColumn("cid", F.monotonically_increasing_id()))


def _sample(entries: DataFrame, n: int, size: int = SAMPLE) -> dict[int, np.ndarray]:
    """The entries of least hash, at most `size` of `n`, by length of vector."""
    order = F.xxhash64("embedding")
    # some more than are wanted go to the driver, whatever the table's size
    share = min(1.0, 2 * size / max(n, 1))
    some = entries.select("embedding").filter(F.pmod(order, F.lit(1 << 30)) < int(share * (1 << 30)) + 1)
    by_length: dict[int, list[np.ndarray]] = {}
    for r in some.orderBy(order, "embedding").limit(size).collect():
        by_length.setdefault(len(r["embedding"]), []).append(np.array(r["embedding"]))
    return {length: np.stack(own) for length, own in by_length.items()}


def fitted(entries: DataFrame, n: int, k: int) -> dict[int, Codes]:
    """Codes by length of vector. The radius covers the true neighbours, among all entries, of some of the sample's."""
    sample = _sample(entries, n)
    coders = {length: Codes(own) for length, own in sample.items() if len(own) > 2}
    probes = {length: sample[length][:PROBES] for length in coders}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for frame in frames:
            for length, part in frame.groupby(frame["embedding"].str.len()):
                if length not in coders:
                    continue
                x, own, coder = np.stack(part["embedding"].to_numpy()).astype(float), probes[length], coders[length]
                d = np.stack([((x - y) ** 2).sum(1) for y in own])
                d[d == 0] = np.inf
                near = np.argsort(d, 1)[:, :k]
                codes, asked = coder.of(x), coder.of(own)
                # a substring that differs in t bits is reached from the radius t * PARTS + its number on
                reach = np.stack([(np.bitwise_count(codes[j] ^ c).astype(np.int64) * PARTS + np.arange(PARTS)).min(-1) for j, c in zip(near, asked, strict=True)])
                d = np.take_along_axis(d, near, 1)
                if length in best:
                    d, reach = np.concatenate([best[length][0], d], 1), np.concatenate([best[length][1], reach], 1)
                    near = np.argsort(d, 1)[:, :k]
                    d, reach = np.take_along_axis(d, near, 1), np.take_along_axis(reach, near, 1)
                best[length] = d, reach
        for length, (d, reach) in best.items():
            yield pd.DataFrame({"length": length, "probe": np.repeat(np.arange(len(d)), d.shape[1]), "d": d.ravel(), "reach": reach.ravel()})

    if coders:
        found = entries.select("embedding").mapInPandas(run, "length long, probe long, d double, reach long").filter(F.col("d") < float("inf"))
        ranked = found.withColumn("n", F.row_number().over(Window.partitionBy("length", "probe").orderBy("d", "reach"))).filter(F.col("n") <= k)
        for r in ranked.groupBy("length").agg(F.percentile("reach", F.lit(COVER)).alias("radius")).collect():
            coders[r["length"]].radius = int(np.ceil(r["radius"]))
    return coders


def search(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows of `vectors` (as `usable` gives them) for each of `queries`, which are some of its rows."""
    entries = _distinct(vectors, k + 1)  # a query's own row is among the k + 1 nearest
    n = entries.count()
    coders = fitted(entries, n, k)
    size = min(max(n // BLOCKS, BLOCK_ROWS[0]), BLOCK_ROWS[1])
    blocks = max(1, -(-n // size))

    asked = written(queries.join(entries.select("embedding", "cid"), "embedding").select("row", "vec_id", "cid"))
    wanted = entries.join(asked.select("cid").distinct(), "cid", "left_semi")
    indexed = entries.select(F.pmod(F.xxhash64("cid"), F.lit(blocks)).alias("block"), F.lit(0).alias("kind"), "cid", "embedding", "members")
    none = F.lit(None).cast(entries.schema["members"].dataType)
    streamed = wanted.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"), F.lit(1).alias("kind"), "cid", "embedding", none.alias("members"))
    # a block's entries come first in its partition, then the queries stream past them
    dealt = indexed.unionByName(streamed).repartition(blocks, "block").sortWithinPartitions("block", "kind", "cid")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held, index = None, {}, {}
        for frame in frames:
            found = []
            frame = frame.assign(length=frame["embedding"].str.len())
            for (number, kind, length), part in frame.groupby(["block", "kind", "length"], sort=True):
                if number != at:
                    at, held, index = number, {}, {}
                matrix = np.stack(part["embedding"].to_numpy()).astype(float)
                if kind == 0:
                    held.setdefault(length, []).append((matrix, part["members"].tolist()))
                    continue
                if length not in index and length in held:
                    parts = held.pop(length)
                    index[length] = Block(np.concatenate([m for m, _ in parts]), [x for _, own in parts for x in own], coders.get(length))
                if length in index:
                    block = index[length]
                    codes = block.coder.of(matrix) if block.coder else [None] * len(matrix)
                    for cid, vector, code in zip(part["cid"], matrix, codes, strict=True):
                        found += [(cid, *x) for x in block.nearest(vector, code, k + 1)]
            if found:
                yield pd.DataFrame(found, columns=["cid", "score", "id", "near"])

    near = dealt.mapInPandas(run, "cid long, score double, id long, near long")
    closest = near.withColumn("n", F.row_number().over(Window.partitionBy("cid").orderBy("score", "id", "near"))).filter(F.col("n") <= k + 1)
    others = asked.join(closest.drop("n"), "cid").filter(F.col("row") != F.col("near"))
    ranked = others.withColumn("rank", F.row_number().over(Window.partitionBy("row").orderBy("score", "id", "near"))).filter(F.col("rank") <= k)
    return ranked.select(F.col("vec_id").alias("query_id"), "rank", F.nullif("id", F.lit(NO_ID)).alias("vec_id"), "score")
