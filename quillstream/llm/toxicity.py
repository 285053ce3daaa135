"""Toxicity by a weighted lexicon.

Texts are folded: lower case, homoglyphs to the Latin letter that they imitate, digits to the letter
that they replace, one class for i, l and 1, accents away, all else to blanks. The lexicon (whole words,
and word beginnings for inflected forms) is learned from labelled rows, at most about `MOST_LABELLED` of
them (those of least hash of their id): document counts of all folded words by label, their log odds being
the weights. Every word that enough documents hold is an entry. Words around an entry that make it harmless
are learned too, as exception phrases. An Aho-Corasick automaton finds all entries in a folded text at once;
the hits' weights without excepted ones, over the text's length, go through a logistic curve fitted to the
same labelled rows.

Defined results: null and empty texts have no hits and get the score of a rate of 0; a text or word of any
length is read whole; repeated rows get equal scores; of contradicting labels of an id 1 holds, and rows
without an id or a label teach nothing; without labelled rows of both kinds the lexicon is empty and every
score is 0; an empty table has no rows. Further columns are kept by `score`; clashing score and predicted
columns are replaced.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstream.llm.common import extended, tidy, written

#: Documents with label 1 that a lexicon entry is found in at least, and its least log odds.
LEAST_DOCS, LEAST_ODDS = 4, 2.5
#: Lengths of word beginnings.
STEMS = (4, 5, 6)
#: Labelled rows that are learned from, at most (about: the ids below a hash). It bounds the lexicon too.
MOST_LABELLED = 100_000
#: Distinct words that a task counts before it passes its counts on.
COUNTED_WORDS = 200_000
#: Words that a text counts as having at least, when hits are set against its length.
LEAST_WORDS = 20

#: Letters that look like a Latin one, and what digits and signs stand for.
HOMOGLYPHS = dict(
    zip(
        "абвгдеёзіїјкмнопрстухчьѕԁԛԝαβεηικνορτυχωɑɡıſ",
        "abbrdee3iijkmhonpctyx4bsdqwabenikvoptuxwagis",
        strict=True,
    )
)
DIGITS = dict(zip("013457@$", "oieastas", strict=True))
_TABLE: dict[int, str] = {}


class _Fold(dict):
    def __missing__(self, code: int) -> str:
        c = chr(code)
        base = unicodedata.normalize("NFKD", c)[0].lower()[:1] or " "
        base = HOMOGLYPHS.get(c, HOMOGLYPHS.get(base, base))
        base = DIGITS.get(base, base)
        base = "i" if base == "l" else base
        self[code] = out = base if base.isalpha() else " "
        return out


_FOLD = _Fold({ord("$"): " "})
_DOLLAR = re.compile(r"\$(?=[^\W\d_])")


def fold(text: str) -> str:
    if "$" in text:
        text = _DOLLAR.sub("s", text)
    return text.lower().translate(_FOLD)


def word_counts(rows: DataFrame) -> DataFrame:
    """word, pos, neg: documents of each label (columns text, label) that hold a folded word; partial counts, to be summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: tuple[Counter, Counter] = (Counter(), Counter())

        def out() -> pa.RecordBatch:
            words = list(counts[0].keys() | counts[1].keys())
            got = pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([counts[1][w] for w in words], pa.int64()), pa.array([counts[0][w] for w in words], pa.int64())], names=["word", "pos", "neg"])
            counts[0].clear()
            counts[1].clear()
            return got

        for batch in batches:
            for text, label in zip(batch.column("text"), batch.column("label").to_pylist(), strict=True):
                counts[label].update(set(fold(text.as_py() or "").split()))
                if len(counts[0]) + len(counts[1]) > COUNTED_WORDS:
                    yield out()
        if counts[0] or counts[1]:
            yield out()

    return rows.select("text", "label").mapInArrow(tidy(run), "word string, pos long, neg long").groupBy("word").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def _word_before(folded: str, at: int) -> list[str]:
    """The whole word before a blank, in a list; none at the beginning."""
    while at > 0 and folded[at - 1] == " ":
        at -= 1
    return [folded[folded.rfind(" ", 0, at) + 1 : at]] if at else []


def _word_after(folded: str, at: int) -> list[str]:
    while at < len(folded) and folded[at] == " ":
        at += 1
    return [folded[at : folded.find(" ", at)]] if at < len(folded) else []


class Lexicon:
    """Entries `' word '` or `' stem'` with weights, exceptions, and the logistic curve."""

    def __init__(self, weights: dict[str, float], exceptions: frozenset[str] = frozenset(), a: float = -30.0, b: float = 0.0) -> None:
        self.weights, self.exceptions, self.a, self.b = weights, exceptions, a, b
        self._machine = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_machine": None}

    @property
    def machine(self):
        if self._machine is None and self.weights:
            import ahocorasick

            self._machine = ahocorasick.Automaton()
            for entry, weight in self.weights.items():
                self._machine.add_word(entry, (entry, weight))
            self._machine.make_automaton()
        return self._machine

    def hits(self, folded: str) -> list[tuple[int, str, float]]:
        """(end, entry, weight) of the longest entry at each word, in a folded text with a blank at both ends."""
        if not self.weights:
            return []
        by_start: dict[int, tuple[int, str, float]] = {}
        for end, (entry, weight) in self.machine.iter(folded):
            start = end - len(entry) + 1
            old = by_start.get(start)
            if old is None or len(entry) > len(old[1]):
                by_start[start] = (end, entry, weight)
        return [by_start[s] for s in sorted(by_start)]

    def contexts(self, folded: str, hit: tuple[int, str, float]) -> list[str]:
        """The phrases of a hit with the word before and the word after."""
        end, entry, _ = hit
        start = end - len(entry) + 1
        stop = folded.find(" ", start + 1)
        word = folded[start + 1 : stop]
        return [f"{x} {word}" for x in _word_before(folded, start)] + [f"{word} {x}" for x in _word_after(folded, stop)]

    def rate(self, text: str) -> float:
        """Weight of hits over the square root of the number of words."""
        folded = f" {fold(text)} "
        total = 0.0
        for hit in self.hits(folded):
            if not (self.exceptions and any(c in self.exceptions for c in self.contexts(folded, hit))):
                total += hit[2]
        return total / math.sqrt(max(LEAST_WORDS, folded.count(" "))) if total else 0.0

    def score(self, rates: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.a + self.b * np.log1p(10 * rates), -40, 40)))


def _odds(pos, neg, n_pos, n_neg):
    return F.log(((pos + 0.5) / F.lit(n_pos + 1.0)) / ((neg + 0.5) / F.lit(n_neg + 1.0)))


def learn(rows: DataFrame) -> Lexicon:
    """A lexicon from labelled rows: text and label (0 or 1)."""
    totals = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n_pos, n_neg = totals.get(1, 0), totals.get(0, 0)
    if not n_pos or not n_neg:
        return Lexicon({})
    words = written(word_counts(rows))
    odds = _odds(F.col("pos"), F.col("neg"), n_pos, n_neg)
    good = words.withColumn("odds", odds).filter((F.col("pos") >= LEAST_DOCS) & (F.col("odds") >= LEAST_ODDS))
    # an entry for each word; for beginnings, a word counts under each of its own
    stems = words.select("pos", "neg", F.explode(F.array(*[F.when(F.length("word") > n, F.substring("word", 1, n)) for n in STEMS])).alias("stem")).filter(F.col("stem").isNotNull())
    stems = stems.groupBy("stem").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.count_if(F.col("pos") > 0).alias("forms"))
    stems = stems.withColumn("odds", _odds(F.col("pos"), F.col("neg"), n_pos, n_neg)).filter((F.col("pos") >= LEAST_DOCS) & (F.col("odds") >= LEAST_ODDS) & (F.col("forms") >= 3))
    best = good.select(F.concat(F.lit(" "), "word", F.lit(" ")).alias("entry"), "odds", "pos").unionByName(stems.select(F.concat(F.lit(" "), "stem").alias("entry"), "odds", "pos"))
    plain = Lexicon({r["entry"]: float(r["odds"]) for r in best.collect()})

    # one pass over the labelled rows: phrases around hits by label, and rates by label
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for text, label in zip(batch.column("text"), batch.column("label").to_pylist(), strict=True):
                text = text.as_py() or ""
                folded = f" {fold(text)} "
                counts["", round(plain.rate(text), 3), label] += 1
                for c in {c for hit in plain.hits(folded) for c in plain.contexts(folded, hit)}:
                    counts[c, 0.0, label] += 1
            if len(counts) > COUNTED_WORDS:
                yield _counted(counts)
                counts.clear()
        yield _counted(counts)

    def _counted(counts: Counter) -> pa.RecordBatch:
        keys = list(counts)
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.float64()), pa.array([k[2] for k in keys], pa.int32()), pa.array([counts[k] for k in keys], pa.int64())], names=["phrase", "rate", "label", "n"])

    seen = written(rows.select("text", "label").mapInArrow(tidy(run), "phrase string, rate double, label int, n long").groupBy("phrase", "rate", "label").agg(F.sum("n").alias("n")))
    phrases = seen.filter(F.col("phrase") != "").groupBy("phrase").agg(F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("pos"), F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).alias("neg"))
    harmless = phrases.filter((F.col("neg") >= LEAST_DOCS) & (F.col("neg") * n_pos > 4 * F.col("pos") * n_neg)).select("phrase").collect()
    # rates in bins: at most a few hundred for each label
    bins = seen.filter(F.col("phrase") == "").groupBy(F.least(F.floor(F.log1p(F.col("rate") * 10) * 20), F.lit(400)).alias("bin"), "label").agg(F.sum("n").alias("n")).collect()
    a, b = _fit(np.array([(r["bin"] / 20, r["label"], r["n"]) for r in bins], float))
    return Lexicon(plain.weights, frozenset(r["phrase"] for r in harmless), a, b)


def _fit(rows: np.ndarray) -> tuple[float, float]:
    """Logistic curve over weighted (x, label, count), with a small ridge, by Newton steps."""
    x, y, n = rows.T
    features = np.stack([np.ones_like(x), x], 1)
    w = np.zeros(2)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(features @ w, -40, 40)))
        slope = features.T @ (n * (y - p)) - 0.01 * w
        curve = (features * (n * p * (1 - p))[:, None]).T @ features + 0.01 * np.eye(2)
        step = np.linalg.solve(curve, slope)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def score(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """docs with score and predicted, over whole texts."""
    keep = [c for c in docs.columns if c not in ("score", "predicted")]
    schema = extended(docs.select(*keep), "score double, predicted int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("text"))
            scores = lexicon.score(np.array([lexicon.rate(x.as_py() or "") for x in column], float))
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in keep), pa.array(scores, pa.float64()), pa.array((scores >= 0.5).astype(np.int32))], names=[*keep, "score", "predicted"])

    return docs.select(*keep).mapInArrow(tidy(run), schema)


def held_out(doc_id):
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def labelled(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> DataFrame:
    """Training rows: text and label of the documents whose crc32(doc_id) mod 5 is not 0, about `most` of them, by hash of the id. Contradicting labels of an id count as 1."""
    known = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("label"))
    known = written(known.filter(~held_out(F.col("doc_id"))))
    n = known.count()
    if n > most:
        known = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * most / n))
    # at most so many ids and labels: bounded whatever the table's size
    return docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("text", F.col("label").cast("int").alias("label"))


def detect(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs with score and predicted, by a lexicon learned from the labelled ones of them."""
    return score(docs, learn(labelled(docs, labels)))
