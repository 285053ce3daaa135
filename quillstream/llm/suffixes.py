"""Repeated passages by sparse suffix arrays.

Positions are selected by content: each window of `least` words goes to the word sequence (`SEED` words) of
least hash in it, the first of equal ones, which is the same in all copies of the window. Suffixes at these
positions whose first `SEED` words occur elsewhere are sorted over the cluster by range, each with the
hashes of the windows that went to it. A window is repeated if two documents hold it, and the one of least
doc_id is its first. A seed whose suffixes lie within one block is settled there; the windows of all seeds
at a border of two blocks are counted over the cluster and joined back, so what is found does not follow
from where a block ends. The union of a document's repeated windows covers its passages whole.

Words are maximal runs without ASCII blanks, compared exactly, by 64-bit hashes of seeds and of windows.
A passage is repeated if it occurs in another document too; the occurrence in the smallest doc_id is the
first and stays, the others are repeats.

Defined results: null, empty and short texts have no passages; repeated rows (same id and text) are one
document, rows with the same id and different texts are told apart by their text, and are no others to
each other; null ids come first. A text without blanks is one word and has no passages.
Further columns are ignored by `repeats` and kept by `without_repeats`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstream.llm.common import bounds, small, tidy, whole_groups, written
from quillstream.llm.wordhash import U64, Words, mix, runs, slabs

LEAST = 50
SEED = 16
#: Suffixes of a block, which are settled together; the seeds at its ends are settled over the cluster.
RUN_ROWS = 50_000
#: Stands for a null doc_id: before all others.
NULL_ID = -(1 << 62)


class Selected:
    """Selected suffixes of a slab: `seed`, `start` (first window) and `count` of windows; `hash[item[i]:item[i + 1]]` are the windows of suffix i.

    Windows one after another that are equal (one word again and again) are one item of their own suffix."""

    def __init__(self, words: Words, least: int) -> None:
        n = len(words.hash)
        # a window begins where `least` words of one text follow
        opens = np.zeros(n + 1, np.int64)
        long = np.diff(words.first) >= least
        np.add.at(opens, words.first[:-1][long], 1)
        np.add.at(opens, words.first[1:][long] - least + 1, -1)
        at = np.flatnonzero(np.cumsum(opens[:-1]) > 0)
        if not len(at):
            self.seed, self.start, self.count, self.hash, self.item = np.zeros(0, U64), at, at, np.zeros(0, U64), np.zeros(1, np.int64)
            return
        seed = runs(words.hash, SEED)
        where = _first_least(seed, least - SEED + 1)[at]
        window = runs(words.hash, least)[at]
        text = np.searchsorted(words.first, at, "right")
        # items: runs of equal windows
        edge = bounds(text, window)
        start, count, where, text = at[edge[:-1]], np.diff(edge), where[edge[:-1]], text[edge[:-1]]
        self.hash = window[edge[:-1]]
        self.item = bounds(text, where, np.where(count > 1, np.arange(len(count)), -1))
        first = self.item[:-1]
        self.seed, self.start, self.count = seed[where[first]], start[first], np.add.reduceat(count, first)


def _first_least(values: np.ndarray, width: int) -> np.ndarray:
    """Where the least of `width` values from each position on is, the first of equal ones; the last width - 1 run past the end."""
    out, done = np.arange(len(values)), 1
    while done < width:
        step = min(done, width - done)
        if len(out) > step:
            here, ahead = out[:-step], out[step:]
            out = np.concatenate([np.where(values[ahead] < values[here], ahead, here), out[-step:]])
        done += step
    return out


def _text_keys(words: Words) -> np.ndarray:
    """A hash of each text's words in order."""
    n = np.diff(words.first)
    place = np.arange(len(words.hash)) - np.repeat(words.first[:-1], n)
    total = np.zeros(len(words.hash) + 1, U64)
    np.cumsum(mix(words.hash + mix(place.astype(U64))), out=total[1:])
    return (total[words.first[1:]] - total[words.first[:-1]]).view(np.int64)


def _seeds(docs: DataFrame, least: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            for row, words in slabs(batch.column("text"), fold=False):
                own = Selected(words, least)
                text = np.searchsorted(words.first, own.start, "right") - 1
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(row + text)), pa.array(_text_keys(words)[text]), pa.array((own.start - words.first[text]).astype(np.int32)), pa.array(own.seed.view(np.int64))],
                    names=["doc_id", "text_key", "pos", "seed"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(run), "doc_id long, text_key long, pos int, seed long")


def _repeated_seeds(seeds: DataFrame) -> DataFrame:
    """doc_id, text_key and the positions in each text whose seeds occur more than once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a row is kept if the one before or after it has its seed; the ends of a partition are kept as they are
        for batch in batches:
            seed = batch.column("seed").to_numpy()
            same = np.ones(len(seed) + 1, bool)
            same[1:-1] = seed[1:] == seed[:-1]
            yield batch.select(["doc_id", "text_key", "pos"]).filter(pa.array(same[1:] | same[:-1]))

    # by range of seed and place: a seed that many documents hold is spread over several partitions
    order = ["seed", "doc_id", "text_key", "pos"]
    several = seeds.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(tidy(run), "doc_id long, text_key long, pos int")
    return several.groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_set("pos")).alias("places"))


def _suffixes(docs: DataFrame, places: DataFrame, least: int) -> DataFrame:
    """A row for each suffix to sort: seed, where its windows are, and their hashes as bytes (a single one if all are equal)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, words in slabs(batch.column("text"), fold=False):
                part = batch.slice(row, len(words.offsets) - 1)
                keys = _text_keys(words)
                own = Selected(words, least)
                text = np.searchsorted(words.first, own.start, "right") - 1
                # the wanted places of the texts that are meant, not of another text of the same id
                spots = part.column("places")
                n = pc.list_value_length(spots).to_numpy(zero_copy_only=False)
                meant = part.column("text_key").to_numpy() == keys
                wanted = (words.first[:-1].repeat(n) + spots.flatten().to_numpy())[meant.repeat(n)]
                at = np.flatnonzero(np.isin(own.start, wanted))
                offsets = np.concatenate([[0], np.cumsum(8 * np.diff(own.item)[at])]).astype(np.int32)
                keep = np.zeros(len(own.seed), bool)
                keep[at] = True
                hashes = own.hash[keep.repeat(np.diff(own.item))]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(own.seed[at].view(np.int64)),
                        part.column("doc_id").take(pa.array(text[at])),
                        pa.array(keys[text[at]]),
                        pa.array((own.start[at] - words.first[text[at]]).astype(np.int32)),
                        pa.array(own.count[at].astype(np.int32)),
                        pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(hashes.tobytes())]),
                    ],
                    names=["seed", "doc_id", "text_key", "pos", "count", "windows"],
                )

    where = places.withColumnRenamed("doc_id", "_doc")
    joined = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(where, F.col("doc_id").eqNullSafe(F.col("_doc")))
    schema = "seed long, doc_id long, text_key long, pos int, count int, windows binary"
    return joined.select("doc_id", "text", "text_key", "places").mapInArrow(tidy(run), schema)


def _merged(frame: pd.DataFrame) -> pd.DataFrame:
    """Overlapping and touching spans of a text, earlier ones and others apart, as one; rows are sorted by doc_key, text_key, again and start."""
    edge = bounds(*(frame[x].to_numpy() for x in ("doc_key", "text_key", "again")))
    start, stop = frame["start"].to_numpy().astype(np.int64), frame["stop"].to_numpy().astype(np.int64)
    lift = np.repeat(np.arange(len(edge) - 1), np.diff(edge)) * (1 << 40)
    fresh = np.ones(len(start), bool)
    fresh[1:] = (start + lift)[1:] > np.maximum.accumulate(stop + lift)[:-1]
    at = np.flatnonzero(fresh)
    ends = np.maximum.reduceat(stop, at) if len(at) else stop
    return frame.iloc[at][["doc_id", "text_key", "start", "again"]].assign(stop=ends)[["doc_id", "text_key", "start", "stop", "again"]].astype({"doc_id": "Int64"})


def _windows(frame: pd.DataFrame, least: int) -> pd.DataFrame:
    """A row for each window of some suffixes, or for several that are equal: its hash, the words that they cover, and whether other blocks may hold it (open)."""
    n = frame["windows"].str.len().to_numpy(np.int64) // 8
    row = np.repeat(np.arange(len(frame)), n)
    place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    start = frame["pos"].to_numpy()[row] + place
    # a single hash stands for all windows of its suffix
    more = np.where(n == 1, frame["count"].to_numpy() - 1, 0)[row]
    ids = frame["doc_id"].astype("Int64")
    return pd.DataFrame(
        {
            "hash": np.frombuffer(b"".join(frame["windows"]), np.int64),
            "doc_id": ids.array.take(row),
            "doc_key": ids.fillna(NULL_ID).astype("int64").to_numpy()[row],
            "text_key": frame["text_key"].to_numpy()[row],
            "start": start,
            "stop": start + more + least,
            "open": frame["open"].to_numpy()[row],
        }
    )


def _settled(windows: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
    """doc_id, text_key, start, stop (words) and again (whether it occurs in a smaller id) of a block's repeated passages, and the windows to settle over all blocks.

    Whatever has a smaller id in the block is a repeat; of an open window, those of the block's least id are left, with its greatest (high)."""
    order = np.lexsort((windows["doc_key"].to_numpy(), windows["hash"].to_numpy()))
    windows = windows.iloc[order]
    doc, still = windows["doc_key"].to_numpy(), windows["open"].to_numpy(bool)
    edge = bounds(windows["hash"].to_numpy())
    n = np.diff(edge)
    low, high = (np.repeat(doc[x], n) for x in (edge[:-1], edge[1:] - 1)) if len(n) else (doc, doc)
    again = doc > low
    found = windows.assign(again=again)[again | ~still & (low < high)]
    found = _merged(found.sort_values(["doc_key", "text_key", "again", "start", "stop"], kind="stable", ignore_index=True))
    return found, windows.assign(high=high)[still & ~again]


def _passages(suffixes: DataFrame, least: int) -> DataFrame:
    """doc_id, text_key, start, stop (words) and again of the repeated passages, in pieces."""
    order = ["seed", "doc_id", "text_key", "pos"]
    schema = "doc_id long, text_key long, start int, stop int, again boolean, hash long, high long"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for a in range(0, len(frame), RUN_ROWS):
                block = frame.iloc[a : a + RUN_ROWS]
                seed = block["seed"].to_numpy()
                # the seeds at both ends may go on in other blocks
                found, rest = _settled(_windows(block.assign(open=(seed == seed[0]) | (seed == seed[-1])), least))
                yield found.assign(hash=pd.NA, high=pd.NA)[names].astype({"hash": "Int64", "high": "Int64"})
                yield rest.assign(again=pd.NA)[names].astype({"again": "boolean"})

    ranged = suffixes.repartitionByRange(*order).sortWithinPartitions("seed")
    found = written(ranged.mapInPandas(tidy(run), schema))
    # the windows of seeds that lie at an end of a block, over all blocks
    doc = F.coalesce("doc_id", F.lit(NULL_ID))
    rest = found.filter(F.col("hash").isNotNull())
    held = rest.groupBy("hash").agg(F.min(doc).alias("low"), F.max("high").alias("high")).filter(F.col("low") < F.col("high"))
    late = rest.drop("high").join(small(written(held.select("hash", "low"))), "hash").withColumn("again", doc > F.col("low"))
    columns = ["doc_id", "text_key", "start", "stop", "again"]
    return found.filter(F.col("hash").isNull()).select(*columns).unionByName(late.select(*columns))


def spans(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, text_key, and the merged passages (words, ends exclusive) that a document shares with others; `again`: those that a smaller doc_id has too."""
    places = _repeated_seeds(_seeds(docs, least))
    found = _passages(_suffixes(docs, written(places), least), least)

    def merge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in whole_groups((f.assign(doc_key=f["doc_id"].fillna(NULL_ID).astype("int64")) for f in frames), ["doc_key", "text_key", "again"]):
            yield _merged(frame)

    dealt = found.repartition("doc_id", "text_key").sortWithinPartitions("doc_id", "text_key", "again", "start", "stop")
    return dealt.mapInPandas(tidy(merge), "doc_id long, text_key long, start int, stop int, again boolean")


def repeats(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """A row for each passage that a document shares with another, or repeats from an earlier one: doc_id, start_word, end_word, n_words, first (it is not found in a smaller doc_id)."""
    found = spans(docs, least)
    return found.select("doc_id", F.col("start").cast("long").alias("start_word"), F.col("stop").cast("long").alias("end_word"), (F.col("stop") - F.col("start")).cast("long").alias("n_words"), (~F.col("again")).alias("first"))


def without_repeats(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """docs with each repeated passage cut from all documents but the first; n_chars, where there is one, follows. No document goes."""
    columns = docs.columns
    gone = written(spans(docs, least).filter("again").groupBy(F.col("doc_id").alias("_doc")).agg(F.sort_array(F.collect_list(F.struct("text_key", "start", "stop"))).alias("_gone")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, cuts = batch.column(batch.schema.get_field_index("text")).to_pylist(), batch.column(batch.schema.get_field_index("_gone")).to_pylist()
            for i, (text, own) in enumerate(zip(texts, cuts, strict=True)):
                if not own or not text:
                    continue
                _, words = next(slabs(pa.array([text], pa.string()), fold=False))
                key = int(_text_keys(words)[0])
                data, kept, done = text.encode(), [], 0
                for c in own:
                    if c["text_key"] == key:
                        a, b = int(words.start[c["start"]]), int(words.end[c["stop"] - 1])
                        kept.append(data[done : max(done, a)])
                        done = max(done, b)
                texts[i] = (b"".join(kept) + data[done:]).decode()
            out = {"text": pa.array(texts, pa.string())}
            if "n_chars" in columns:
                old = batch.column(batch.schema.get_field_index("n_chars"))
                out["n_chars"] = pa.array([len(t) if c and t is not None else n for t, c, n in zip(texts, cuts, old.to_pylist(), strict=True)], old.type)
            yield pa.RecordBatch.from_arrays([out[c] if c in out else batch.column(batch.schema.get_field_index(c)) for c in columns], names=columns)

    return docs.join(gone, F.col("doc_id").eqNullSafe(F.col("_doc")), "left").drop("_doc").mapInArrow(tidy(run), docs.schema)
