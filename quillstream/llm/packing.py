"""Packing documents into windows by Karmarkar-Karp multiway differencing.

Documents are tokenized once and cut: whole windows go out as they are, the rest of a document as one
piece, or as even pieces of at most `piece` ids. Pieces are dealt by a hash of their row into groups of
bounded size, and each group is differenced on its own: the two partial partitions with the largest
imbalances are merged so that large windows of one meet small windows of the other. A group starts with
as many windows as its ids need; while any window exceeds the capacity, the number rises by one.

Defined results: null and empty texts are a document of one id (the closing one); texts of any length are
encoded whole and cut; repeated rows are packed each; pieces of equal length go in the order of their rows; an
empty table has no rows; further columns, of whatever name, are ignored. Each id lies in exactly one piece.
"""

from __future__ import annotations

import heapq
import itertools
import json
import os
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstream.llm.common import tidy, written
from quillstream.llm.pretoken import ByteLetters, Splitter

WINDOW = 4096
#: A document's last part is cut into even pieces of at most so many ids.
PIECE = 1024
#: Pieces of a group, about.
GROUP_PIECES = 1000
CACHE_WORDS = 300_000
#: Texts are encoded in groups of about this many characters.
GROUP_CHARS = 1 << 20
CLOSING_ID = 2


class WordIds:
    """Ids by the tokenizers library, asked once for each new word; words are what the file's pattern makes of a text."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            self.splitter = Splitter(json.load(f))
        self.codec = Tokenizer.from_file(path)
        self.letters = ByteLetters()  # words are normalised and split already: the model alone is asked
        self.fixed = {t: array("I", [i]).tobytes() for t, i in self.splitter.special.items()}
        self.known = dict(self.fixed)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text; the cache holds the words of these texts and up to `CACHE_WORDS` others."""
        split = [self.splitter.split(t) for t in texts]
        words = set(itertools.chain.from_iterable(split))
        if len(self.known) > CACHE_WORDS:
            self.known = self.fixed | {w: self.known[w] for w in words if w in self.known}
        fresh = list(words.difference(self.known))
        tokenize, letters = self.codec.model.tokenize, self.letters
        for w in fresh:
            self.known[w] = array("I", [t.id for t in tokenize(w.translate(letters))]).tobytes()
        get = self.known.__getitem__
        return [b"".join(map(get, own)) for own in split]


_WORD_IDS: dict[str, WordIds] = {}


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _encoded(codec: WordIds, texts: Iterator[str]) -> Iterator[bytes]:
    """Ids of each text, taken in groups of bounded size."""
    group, chars = [], 0
    for text in texts:
        group.append(text)
        chars += len(text)
        if chars >= GROUP_CHARS:
            yield from codec.encode(group)
            group, chars = [], 0
    yield from codec.encode(group)


def pieces(docs: DataFrame, path: str | None = None, window: int = WINDOW, piece: int = PIECE) -> DataFrame:
    """The cut pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, and row, a number of the piece in the run."""
    path = path or vocabulary()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "row"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _WORD_IDS:
            _WORD_IDS[path] = WordIds(path)
        codec, counter = _WORD_IDS[path], itertools.count(TaskContext.get().partitionId() << 36)
        for batch in batches:
            out: list[list] = [[] for _ in names]
            texts = (x.as_py() or "" for x in batch.column("text"))
            for doc, ids in zip(batch.column("doc_id").to_pylist(), _encoded(codec, texts), strict=True):
                ids += CLOSING_ID.to_bytes(4, "little")
                n = len(ids) // 4
                whole = n // window * window
                tail = n - whole
                parts = -(-tail // piece)
                edges = [*range(0, whole, window), *(whole + tail * k // parts for k in range(parts)), n]
                for a, b in itertools.pairwise(edges):
                    for column, x in zip(out, (doc, a, b - a, zlib.crc32(ids[4 * a : 4 * b]), n, next(counter)), strict=True):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=names)

    # doc_id keeps its own type in the result; here it is a number or null
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(run), ", ".join(f"{c} long" for c in names))


def difference(sizes: np.ndarray, k: int) -> np.ndarray:
    """The window (0..k-1) of each size by multiway differencing.

    A partial partition is a list of windows in falling order of size, without the empty ones."""
    n = len(sizes)
    left, right = [], []  # of nodes from n on: the two windows that were merged
    order = itertools.count()
    heap = [(-int(s), next(order), np.array([s], np.int64), np.array([i])) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    while len(heap) > 1:
        _, _, a, ids_a = heapq.heappop(heap)
        _, _, b, ids_b = heapq.heappop(heap)
        over = len(a) + len(b) - k
        if over > 0:  # the smallest of a meet the smallest of b, turned round: largest with smallest
            if len(a) < len(b):
                a, b, ids_a, ids_b = b, a, ids_b, ids_a
            # windows of b in falling order go to the empty windows first, then to a's smallest
            free = k - len(a)
            merged = a[len(a) - over :] + b[free:][::-1]
            fresh = n + len(left) + np.arange(over)
            left += ids_a[len(a) - over :].tolist()
            right += ids_b[free:][::-1].tolist()
            sums = np.concatenate([a[: len(a) - over], b[:free], merged])
            ids = np.concatenate([ids_a[: len(a) - over], ids_b[:free], fresh])
        else:
            sums, ids = np.concatenate([a, b]), np.concatenate([ids_a, ids_b])
        at = np.argsort(-sums, kind="stable")
        sums, ids = sums[at], ids[at]
        low = sums[-1] if len(sums) == k else 0
        heapq.heappush(heap, (-int(sums[0] - low), next(order), sums, ids))
    window = np.zeros(n + len(left), np.int64)
    if heap:
        window[heap[0][3]] = np.arange(len(heap[0][3]))
    for i in range(len(left) - 1, -1, -1):
        window[left[i]] = window[right[i]] = window[n + i]
    return window[:n]


def balanced(sizes: np.ndarray, window: int) -> np.ndarray:
    """Windows of at most `window` ids, their number rising while any is exceeded."""
    k = max(1, -(-int(sizes.sum()) // window))
    while True:
        at = difference(sizes, k)
        if np.bincount(at, sizes, k).max() <= window:
            return at
        k += 1


def pack(docs: DataFrame, path: str | None = None, window: int = WINDOW, piece: int = PIECE, group: int = GROUP_PIECES) -> DataFrame:
    """Pieces with sequence_id and offset."""
    cut = written(pieces(docs, path, window, piece))
    parts = cut.filter(F.col("length") < window)
    groups = max(1, -(-parts.count() // group))
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("row", kind="stable").reset_index(drop=True)
        at = balanced(frame["length"].to_numpy(), window)
        frame["sequence_id"] = ((frame["group"].to_numpy() << 20) + at) * 2
        frame["offset"] = frame.groupby(at)["length"].cumsum() - frame["length"]
        return frame[columns].astype({"doc_id": "Int64"})

    dealt = parts.withColumn("group", F.pmod(F.xxhash64("row"), F.lit(groups)).cast("long"))
    schema = ", ".join(f"{c} long" for c in columns)
    packed = dealt.groupBy("group").applyInPandas(run, schema)
    whole = cut.filter(F.col("length") == window).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("row") * 2 + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return packed.unionByName(whole)
