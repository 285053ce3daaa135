"""Spelling variants: words one edit apart, found over a reduced alphabet.

Letters are hashed to `SYMBOLS` symbols. A word's reduced form is a polynomial over 2^64 in these symbols, so
every member of the form's one-edit neighbourhood follows from prefix sums in constant time, however long the
word is. A neighbourhood's insertions are its partners' deletions and a replacement is its partner's
replacement turned round, so of the full neighbourhood each word sends the form itself, all deletions, and the
replacements by a larger symbol; one of two near words always sends what the other is filed under. The
neighbourhoods are joined with the forms of the vocabulary, candidates whose letters differ in more than two
parities fall out in the join, and the rest are compared as strings. The larger of two words' counts makes it
the other's form; roots follow forms by pointer jumping, whose rounds grow with the logarithm of a path's length.

Words are counted within tasks before they are shuffled. All intermediate tables are written.

Defined results: null and empty texts hold no words; a null doc_id counts as an empty one; rows with one
doc_id are documents each, repeated rows count each time; words of any length are compared whole; ties go to
the smaller word by code points; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstream.llm.common import bounds, tidy, written

SYMBOLS = 8
#: A word counts if it has so many letters and occurs so often.
LEAST_LETTERS, LEAST_COUNT = 5, 3
#: A form occurs at least so many times as often as its variant.
TIMES = 2
#: Distinct words that a task counts before it hands them on, and letters whose neighbourhoods are made at once.
HELD, LETTERS = 500_000, 200_000

_BASE = 6364136223846793005
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Runs of letters, as Latin-1 in which A-Z are lower-cased; what Latin-1 lacks is no letter.
_RUN = re.compile(rb"[a-z\xC0-\xFF]+")
#: One run in so many, by hash, loses a letter.
_ONE_IN = 97


def _utf8(run: bytes) -> bytes:
    return run if run.isascii() else run.decode("latin-1").encode()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """word, n of a task's documents, where one run in 97 (by hash with its document) has lost a letter."""
    counts: Counter = Counter()

    def flush() -> pa.RecordBatch:
        batch = pa.record_batch({"word": pa.array([w.decode("latin-1") for w in counts], pa.string()), "n": pa.array(list(counts.values()), pa.int64())})
        counts.clear()
        return batch

    for batch in batches:
        for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
            if not (text := text.as_py()):
                continue
            start = zlib.crc32(f"{doc.as_py() if doc.is_valid else ''}:".encode())
            for run, n in Counter(_RUN.findall(text.encode("latin-1", "replace").lower())).items():
                h = zlib.crc32(_utf8(run), start)
                if h % _ONE_IN == 0:
                    at = h % len(run)
                    run = run[:at] + run[at + 1 :]
                counts[run] += n
            if len(counts) >= HELD:
                yield flush()
    if counts:
        yield flush()


def _letters(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All words' code points, and where each word begins (with the end of the last)."""
    texts = words.to_pylist()
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=starts[1:])
    return np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.int64), starts


def _symbols(points: np.ndarray) -> np.ndarray:
    """A symbol from 1 to SYMBOLS for each letter, by hash."""
    return ((points.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(SYMBOLS) + np.uint64(1)).astype(np.uint64)


def _powers(most: int) -> np.ndarray:
    """_BASE to the powers 0 to most, modulo 2^64."""
    out = np.ones(most + 1, np.uint64)
    out[1:] = np.multiply.accumulate(np.full(most, _BASE, np.uint64))
    return out


def _forms(points: np.ndarray, starts: np.ndarray):
    """For each word its form and letter parities; for each letter its place's power and the form of what precedes it."""
    sizes = np.diff(starts)
    place = np.arange(len(points)) - np.repeat(starts[:-1], sizes)
    symbols = _symbols(points)
    power = _powers(int(sizes.max(initial=0)))[place]
    terms = symbols * power
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)])
    before = sums[:-1] - np.repeat(sums[starts[:-1]], sizes)
    form = sums[starts[1:]] - sums[starts[:-1]]
    bit = np.uint64(1) << ((points.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(58))
    parity = np.bitwise_xor.reduceat(bit, starts[:-1]) if len(points) else np.zeros(0, np.uint64)
    return form, parity, symbols, power, before, sizes


def _file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The vocabulary with each word's form and letter parities."""
    for batch in batches:
        if batch.num_rows:
            form, parity, *_ = _forms(*_letters(batch["word"]))
            yield pa.record_batch({"id": batch["id"], "word": batch["word"], "n": batch["n"], "form": pa.array(form.view(np.int64)), "parity": pa.array(parity.view(np.int64))})


def _neighbourhood(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """form, id, parity, turned: the half of each word's one-edit neighbourhood that it sends."""
    for batch in batches:
        sizes = np.array([len(w) for w in batch["word"].to_pylist()], np.int64)
        edges = bounds(np.cumsum(sizes) // LETTERS)
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            part = batch.slice(lo, hi - lo)
            form, parity, symbols, power, before, sizes_ = _forms(*_letters(part["word"]))
            owner = np.repeat(np.arange(len(sizes_)), sizes_)
            after = form[owner] - before - symbols * power
            keys, owners = [form, before + after * np.uint64(_INVERSE)], [np.arange(len(sizes_)), owner]
            for symbol in range(2, SYMBOLS + 1):
                at = symbols < symbol
                keys.append(form[owner[at]] + (np.uint64(symbol) - symbols[at]) * power[at])
                owners.append(owner[at])
            key, owner = np.concatenate(keys), np.concatenate(owners)
            order = np.lexsort((key, owner))
            key, owner = key[order], owner[order]
            fresh = np.ones(len(key), bool)
            fresh[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
            key, owner = key[fresh], owner[fresh]
            for at in range(0, len(key), 1 << 20):
                rows = owner[at : at + (1 << 20)]
                yield pa.record_batch({"form": pa.array(key[at : at + (1 << 20)].view(np.int64)), "a": part["id"].take(pa.array(rows)), "a_parity": pa.array(parity[rows].view(np.int64))})


def vocabulary(docs: DataFrame) -> DataFrame:
    """id, word, n, form, parity of the words of at least 5 letters that occur 3 times or more. A written table."""
    counted = docs.select("doc_id", "text").mapInArrow(tidy(_count), "word string, n long")
    words = counted.groupBy("word").agg(F.sum("n").alias("n")).filter((F.length("word") >= LEAST_LETTERS) & (F.col("n") >= LEAST_COUNT))
    numbered = words.select(F.monotonically_increasing_id().alias("id"), "word", "n")
    return written(numbered.mapInArrow(tidy(_file), "id long, word string, n long, form long, parity long"))


def near_words(words: DataFrame) -> DataFrame:
    """a, b (ids), word_a, n_a, word_b, n_b: each two words of the vocabulary that are one edit apart, once. A written table."""
    sent = words.select("id", "word").mapInArrow(tidy(_neighbourhood), "form long, a long, a_parity long")
    filed = words.select("form", F.col("id").alias("b"), F.col("parity").alias("b_parity"))
    alike = sent.join(filed, "form").filter("a <> b AND bit_count(a_parity ^ b_parity) <= 2").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    texts = words.select("id", "word", "n")
    pairs = written(alike.distinct())
    for side in ("a", "b"):
        pairs = pairs.join(texts.select(F.col("id").alias(side), F.col("word").alias(f"word_{side}"), F.col("n").alias(f"n_{side}")), side)
    return written(pairs.filter(F.levenshtein("word_a", "word_b", 1) == 1))


def _roots(forms: DataFrame) -> DataFrame:
    """id, root of the words that have a form (id, to): pointers jump to their pointers' targets until none moves."""
    paths = written(forms.select("id", F.col("to").alias("root")))
    while True:
        further = paths.select(F.col("id").alias("root"), F.col("root").alias("next"))
        jumped = written(paths.join(further, "root", "left").select("id", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        paths = jumped.select("id", "root")
        if jumped.filter("moved").isEmpty():
            return paths


def variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n for each word of the vocabulary."""
    words = vocabulary(docs)
    near = near_words(words)
    ends = F.array(*(F.struct(F.col(x).alias("id"), F.col(y).alias("to"), F.col(f"word_{y}").alias("form"), F.col(f"n_{x}").alias("n"), F.col(f"n_{y}").alias("form_n")) for x, y in (("a", "b"), ("b", "a"))))
    both = near.select(F.inline(ends))
    best = F.min(F.when(F.col("form_n") >= TIMES * F.col("n"), F.struct((-F.col("form_n")).alias("less"), "form", "to", "form_n")))
    chosen = written(both.groupBy("id").agg(F.count("*").alias("n_near"), best.alias("best")).select("id", "n_near", "best.form", "best.form_n", "best.to"))
    roots = _roots(chosen.filter("to IS NOT NULL"))
    named = roots.join(words.select(F.col("id").alias("root"), F.col("word").alias("root_word")), "root").select("id", "root_word")
    full = words.select("id", "word", "n").join(chosen, "id", "left").join(named, "id", "left")
    return full.select("word", "form", F.coalesce("root_word", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
