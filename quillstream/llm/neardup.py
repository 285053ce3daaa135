"""Near-duplicate documents by SetSketch.

A document's set of word shingles is sketched into registers: each register's least hash over the set
becomes an exponential variable, truncated to exponentially spaced integers. Sketches are mergeable by
taking the larger registers. Documents with equal sets are one class from the start. Registers are banded
into buckets; within a bucket, a joint maximum-likelihood estimate from the counts of larger, smaller and
equal registers links classes that may reach the threshold, which gives clusters of candidates. Inside a
cluster links are confirmed on the full sets, through an inverted index, and connected components follow.

Nothing is sampled or capped: a bucket too large for a task links all its members as candidates, and a
cluster too large for a task is confirmed block against block. Buckets and clusters only bound the search;
what counts as a link is always decided on full sets.

Defined results: null and blank texts have no shingles and are linked with nothing; fewer words than a
shingle has are one shingle; equal sets are always linked; a null doc_id has a null component unless a
member with an id is reached; rows that repeat an id are rows of the result each, and so are repeated rows,
which all stay or all go; texts of any length are read whole; of ties the smallest id stays; an empty table
has no rows. Further columns are ignored by `classes` and kept by `deduplicate`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstream.llm.common import bounds, components, extended, small, tidy, whole_groups, written
from quillstream.llm.wordhash import U64, Words, mix, runs, slabs

REGISTERS = 256
BASE, RATE, TOP = 1.001, 20.0, 65535
#: Bands of eight registers; each register is in two of them.
BAND, BANDS = 8, 64
#: An estimate may fall short of the threshold by so many standard errors.
SLACK = 4.0
#: Members of a bucket whose sketches are compared in one task; larger buckets link all their members.
BUCKET_MEMBERS = 20_000
#: Members and shingles of a block of a cluster.
BLOCK_MEMBERS, BLOCK_SHINGLES = 3000, 4_000_000

_RNG = np.random.default_rng(11)
_TURNS = _RNG.integers(0, 1 << 31, REGISTERS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_PLAN = np.concatenate([_RNG.permutation(REGISTERS).reshape(-1, BAND) for _ in range(BANDS * BAND // REGISTERS)])


def shingle_sets(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text of a slab, one text after the other, sorted, and where each text's begin."""
    grams = runs(words.hash, k)
    first = words.first
    count = np.diff(first)
    short = {n: runs(words.hash, n) ^ U64(n) for n in range(1, k) if (count == n).any()}
    sets, at = [], np.zeros(len(count) + 1, np.int64)
    for i, n in enumerate(count):
        if n >= k:
            own = np.sort(grams[first[i] : first[i + 1] - k + 1])
            if len(own) > 1:
                keep = np.empty(len(own), bool)
                keep[0] = True
                np.not_equal(own[1:], own[:-1], out=keep[1:])
                own = own[keep]
        elif n:
            own = short[int(n)][first[i] : first[i] + 1]
        else:
            own = grams[:0]
        sets.append(own)
        at[i + 1] = at[i] + len(own)
    return np.concatenate(sets) if sets else grams[:0], at


def node_keys(sets: np.ndarray, at: np.ndarray) -> list[bytes | None]:
    """128 bits that name each set; None for an empty one."""
    full = np.flatnonzero(np.diff(at))
    out: list[bytes | None] = [None] * (len(at) - 1)
    if len(full):
        halves = [np.add.reduceat(mix(sets ^ U64(salt)), at[full]) for salt in (0x1B56C4E9, 0x5851F42D4C957F2D)]
        for i, key in zip(full, np.stack(halves, 1), strict=True):
            out[i] = key.tobytes()
    return out


def sketches(sets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Registers of each set, [texts, REGISTERS] of 16 bits; all 0 for an empty set."""
    out = np.zeros((len(at) - 1, REGISTERS), np.uint16)
    full = np.flatnonzero(np.diff(at))
    if not len(full):
        return out
    low = (sets >> U64(32)).astype(np.uint32)
    least = np.empty((REGISTERS, len(full)), np.uint32)
    turned = np.empty_like(low)
    for i, turn in enumerate(_TURNS):
        np.multiply(low, turn, out=turned)
        np.minimum.reduceat(turned, at[full], out=least[i])
    x = -np.log1p(-(least.T + 0.5) / 2.0**32) / RATE
    out[full] = np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, TOP)
    return out


def jaccard_estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Joint maximum-likelihood estimates of the similarity of sketches a and b of sets of known sizes."""
    above, below = (a > b).sum(-1), (a < b).sum(-1)
    equal = REGISTERS - above - below
    u = n_a / (n_a + n_b)
    v = 1 - u
    top = np.minimum(u / v, v / u)
    share = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)
    best, at = np.full(len(u), -np.inf), np.zeros(len(u))
    for j in np.linspace(0, 1, 65):
        j = j * top
        more, less = np.clip(share(u - v * j), 1e-9, 1), np.clip(share(v - u * j), 1e-9, 1)
        same = np.clip(1 - more - less, 1e-9, 1)
        fit = above * np.log(more) + below * np.log(less) + equal * np.log(same)
        better = fit > best
        best[better], at[better] = fit[better], j[better]
    return at


def estimate_reaches(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, floor: float) -> np.ndarray:
    """Whether the joint estimate is at least `floor`: the likelihood has one top, so its slope at `floor` tells."""
    above, below = (a > b).sum(-1), (a < b).sum(-1)
    u = n_a / (n_a + n_b)
    v = 1 - u
    scale = (BASE - 1) / BASE
    share = lambda x: np.maximum(-np.log1p(-np.clip(x, 0, 1) * scale) / np.log(BASE), 1e-9)
    slope = lambda x: scale / ((1 - np.clip(x, 0, 1) * scale) * np.log(BASE))
    x, y = u - v * floor, v - u * floor
    more, less, by_more, by_less = share(x), share(y), v * slope(x), u * slope(y)
    rising = (REGISTERS - above - below) * (by_more + by_less) / np.maximum(1 - more - less, 1e-9) - above * by_more / more - below * by_less / less
    return (rising >= 0) & (np.minimum(u / v, v / u) >= floor)


def sketch(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, text_key (a hash of the text), n_shingles, node (the set's name) and sketch of every whole text."""
    docs = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    schema = extended(docs.select("doc_id", "text_key"), "n_shingles long, node binary, sketch binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = batch.column("doc_id"), batch.column("text_key")
            for row, words in slabs(batch.column("text"), fold=True):
                sets, at = shingle_sets(words, k)
                registers = sketches(sets, at)
                nodes = node_keys(sets, at)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(row, len(at) - 1), keys.slice(row, len(at) - 1), pa.array(np.diff(at), pa.int64()), pa.array(nodes, pa.binary()), pa.array([r.tobytes() if n else None for r, n in zip(registers, nodes, strict=True)], pa.binary())],
                    names=["doc_id", "text_key", "n_shingles", "node", "sketch"],
                )

    return docs.mapInArrow(tidy(run), schema)


def _buckets(nodes: DataFrame) -> DataFrame:
    """bucket, id: one row for each band of each node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            registers = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint16).reshape(-1, REGISTERS)
            for b, own in enumerate(_PLAN):
                packed = np.ascontiguousarray(registers[:, own]).view(np.uint64)
                key = mix(mix(packed[:, 0] + U64(b)) + packed[:, 1])
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), batch.column("id")], names=["bucket", "id"])

    return nodes.select("id", "sketch").mapInArrow(tidy(run), "bucket long, id long")


def _shared(buckets: DataFrame) -> DataFrame:
    """The rows of buckets that hold several nodes; `large`: whether these are more than `BUCKET_MEMBERS`.

    Buckets stream by in order. Of one no more rows are held than tell whether it is large."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0  # the last bucket so far, as it may go on, and its rows; those of a large one are passed on

        def ended() -> Iterator[pd.DataFrame]:
            if 1 < n <= BUCKET_MEMBERS:
                yield pd.concat(held).assign(large=False)

        for frame in frames:
            edge = bounds(frame["bucket"].to_numpy())
            size = np.diff(edge)
            if not len(size):
                continue
            if held and held[0]["bucket"].iloc[0] == frame["bucket"].iloc[0]:
                before, n = n, n + int(size[0])
                held.append(frame.iloc[: edge[1]])
                if n > BUCKET_MEMBERS:
                    yield (pd.concat(held) if before <= BUCKET_MEMBERS else held[-1]).assign(large=True)
                    held = held[-1:]
                if len(size) == 1:
                    continue
                edge, size = edge[1:], size[1:]
            yield from ended()
            # whole buckets of this frame, all but its last
            inner = frame.iloc[edge[0] : edge[-2]]
            if len(inner):
                own = np.repeat(size[:-1], size[:-1])
                yield inner[own > 1].assign(large=own[own > 1] > BUCKET_MEMBERS)
            held, n = [frame.iloc[edge[-2] :]], int(size[-1])
            if n > BUCKET_MEMBERS:
                yield held[0].assign(large=True)
        yield from ended()

    return buckets.repartition("bucket").sortWithinPartitions("bucket", "id").mapInPandas(tidy(run), "bucket long, id long, large boolean")


def _reach(start: int, left: np.ndarray, near) -> tuple[list[int], np.ndarray]:
    """Members of `left` that `start` reaches by steps of near(x, left) -> flags, and the others."""
    seen, queue = [start], [start]
    while queue and len(left):
        hit = near(queue.pop(), left)
        found = left[hit].tolist()
        seen += found
        queue += found
        left = left[~hit]
    return seen, left


def _candidate_edges(members: DataFrame, least: float) -> DataFrame:
    """a, b: the first and another member of each group that estimates of at least `least` link within a bucket."""
    error = np.sqrt(least * (1 - least) / REGISTERS)
    floor = least - SLACK * error

    def linked(registers: np.ndarray, n: np.ndarray, ids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        def near(x: int, left: np.ndarray) -> np.ndarray:
            out = np.zeros(len(left), bool)
            equal = (registers[left] == registers[x]).sum(1)
            some = np.flatnonzero(equal >= (floor - 0.1) * REGISTERS)
            if len(some):
                y = left[some]
                out[some] = estimate_reaches(registers[x][None], registers[y], np.full(len(y), n[x]), n[y], floor)
            return out

        left = np.arange(len(ids))
        while len(left) > 1:
            seen, left = _reach(int(left[0]), left[1:], near)
            if len(seen) > 1:
                own = np.sort(ids[seen])
                yield np.full(len(own) - 1, own[0]), own[1:]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in whole_groups(frames, ["bucket"]):
            registers = np.frombuffer(b"".join(frame["sketch"]), np.uint16).reshape(-1, REGISTERS)
            n, ids = frame["n_shingles"].to_numpy(float), frame["id"].to_numpy()
            edge = bounds(frame["bucket"].to_numpy())
            # most buckets hold two: all of these at once
            x = edge[:-1][np.diff(edge) == 2]
            good = x[estimate_reaches(registers[x], registers[x + 1], n[x], n[x + 1], floor)]
            found = [(ids[good], ids[good + 1])] if len(good) else []
            for a, b in zip(edge[:-1], edge[1:], strict=True):
                if b - a > 2:
                    found += linked(registers[a:b], n[a:b], ids[a:b])
            if found:
                yield pd.DataFrame({"a": np.concatenate([x for x, _ in found]), "b": np.concatenate([y for _, y in found])})

    return members.repartition("bucket").sortWithinPartitions("bucket", "id").mapInPandas(tidy(run), "a long, b long")


def _linked(sets: list[np.ndarray], percent: int) -> list[list[int]]:
    """Groups of sets (by number) that links of at least `percent` connect, exactly; single ones are left out."""
    sizes = np.array([len(s) for s in sets])
    state: dict = {}

    def index(members: np.ndarray) -> None:
        values = np.concatenate([sets[m] for m in members])
        owner = np.repeat(np.arange(len(members)), sizes[members])
        order = np.argsort(values, kind="stable")
        state.update(values=values[order], owner=owner[order], members=members, place=dict(zip(members.tolist(), range(len(members)), strict=True)))

    def near(x: int, left: np.ndarray) -> np.ndarray:
        if 2 * len(left) < len(state["members"]):
            index(left)
        lo, hi = np.searchsorted(state["values"], sets[x], "left"), np.searchsorted(state["values"], sets[x], "right")
        n = hi - lo
        spots = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        both = np.bincount(state["owner"][spots], minlength=len(state["members"]))
        full = np.zeros(len(sets), np.int64)
        full[state["members"]] = both
        both = full[left]
        return 100 * both >= percent * (sizes[x] + sizes[left] - both)

    index(np.arange(len(sets)))
    left, out = np.arange(len(sets)), []
    while len(left) > 1:
        seen, left = _reach(int(left[0]), left[1:], near)
        if len(seen) > 1:
            out.append(seen)
    return out


def _links(docs: DataFrame, members: DataFrame, k: int, percent: int) -> DataFrame:
    """a, b: links confirmed on full sets, a star for each connected group of a block."""
    blocks = members.groupBy("c").agg(F.greatest(F.ceil(F.count("*") / BLOCK_MEMBERS), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)).alias("blocks"))
    members = written(members.join(blocks, "c").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks"))))
    wanted = members.withColumnRenamed("doc_id", "_doc").withColumnRenamed("node", "_node")
    texts = docs.select("doc_id", "text").join(small(wanted), F.col("doc_id").eqNullSafe(F.col("_doc")))

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["c", "blocks", "own", "id", "items"]
        for batch in batches:
            for row, words in slabs(batch.column("text"), fold=True):
                sets, at = shingle_sets(words, k)
                part = batch.slice(row, len(at) - 1)
                # an id may name several texts: the one meant is that of the node
                meant = pa.array([x == y for x, y in zip(node_keys(sets, at), part.column("_node").to_pylist(), strict=True)], pa.bool_())
                items = pa.array([sets[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names[:-1]), items], names=names).filter(meant)

    sets = texts.select("c", "blocks", "own", "id", "_node", "text").mapInArrow(tidy(sets_of), "c long, blocks long, own long, id long, items binary")
    # block i meets block j once, in the task (i, j); a cluster of one block is one task
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    pairs = sets.withColumn("other", other).select("c", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "id", "items")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in whole_groups(frames, ["c", "i", "j"]):
            edge = bounds(*(frame[x].to_numpy() for x in ("c", "i", "j")))
            a, b = [], []
            for lo, hi in zip(edge[:-1], edge[1:], strict=True):
                part = frame.iloc[lo:hi].drop_duplicates("id")
                ids = part["id"].to_numpy()
                for group in _linked([np.frombuffer(x, np.uint64) for x in part["items"]], percent):
                    own = np.sort(ids[group])
                    a.append(np.full(len(own) - 1, own[0]))
                    b.append(own[1:])
            if a:
                yield pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b)})

    return pairs.repartition("c", "i", "j").sortWithinPartitions("c", "i", "j", "id").mapInPandas(tidy(run), "a long, b long")


def _classes(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """doc_id, text_key, n_shingles and component of every document."""
    rows = written(sketch(docs, k))
    sets = rows.filter("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.max("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch"))
    nodes = written(sets.withColumn("id", F.monotonically_increasing_id()))
    shared = written(_shared(_buckets(nodes)))
    # a bucket too large to compare links its members as they are; the sets decide later
    large = shared.filter("large")
    leads = large.groupBy("bucket").agg(F.min("id").alias("a"))
    stars = large.join(leads, "bucket").select("a", F.col("id").alias("b")).filter("a <> b")
    members = shared.filter("NOT large").select("bucket", "id").join(nodes.select("id", "n_shingles", "sketch"), "id")
    clusters = components(_candidate_edges(members, percent / 100).unionByName(stars))
    found = components(_links(docs, nodes.select("id", "doc_id", "node", "n_shingles").join(clusters, "id"), k, percent))

    named = nodes.select("id", "node", "doc_id").join(found, "id", "left").withColumn("c", F.coalesce("c", "id"))
    first = named.groupBy("c").agg(F.min("doc_id").alias("component_id"))
    by_node = named.join(first, "c").select("node", "component_id")
    joined = rows.select("doc_id", "text_key", "n_shingles", "node").join(by_node, "node", "left")
    return joined.select("doc_id", "text_key", "n_shingles", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def classes(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document."""
    component = F.col("component_id")
    return _classes(docs, k, percent).select("doc_id", "n_shingles", component, component.eqNullSafe(F.col("doc_id")).alias("kept"))


def deduplicate(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """docs without those whose component holds a smaller id. Of rows that share an id (or have none) only those whose own text is such a copy go."""
    gone = _classes(docs, k, percent).filter(~F.col("component_id").eqNullSafe(F.col("doc_id"))).select(F.col("doc_id").alias("_doc"), F.col("text_key").alias("_key")).distinct()
    return docs.join(small(written(gone)), F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.xxhash64("text") == F.col("_key")), "left_anti")
