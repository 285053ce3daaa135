"""What documents say of the products that they name: signals, sentences and mentions by product, found in one pass over each text, wherever it lies.

The results are those of `spans` and `proof`, which take places out of any tables; here all of them come from the text itself, so nothing is moved or sorted over the cluster.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstream.functions import phrases as ph
from quillstream.functions.columns import BLANK_SIGNS, settled
from quillstream.functions.phrases import clean_quote
from quillstream.operators import aliases, proof
from quillstream.operators import spans as sp
from quillstream.operators import text as tx
from quillstream.operators.tables import sliced

Span = tuple[int, int]


@dataclass(frozen=True)
class Rules:
    """Names and words by which texts are read: names with their product, words that bar them, a heading's pattern, signals (kind: direction, weight, pattern), flags of their context and risks, and single characters that end clauses and sentences."""

    names: dict[str, str]
    negative: tuple[str, ...]
    heading: str
    signals: dict[str, tuple[str, float, str]]
    flags: dict[str, tuple[int, float, tuple[str, ...]]]
    risks: tuple[int, tuple[str, ...]]
    clause: str
    sentence: str
    endings: str
    reach: int = 80


class Reader:
    def __init__(self, rules: Rules) -> None:
        self.rules = rules
        self.lexicon = aliases.Lexicon([(name, key, key, "lexicon", rules.negative) for name, key in rules.names.items()])
        compiled = lambda p: re.compile(p, re.ASCII)
        self.heading, self.clause, self.sentence = map(compiled, (rules.heading, rules.clause, rules.sentence))
        self.signals = [(compiled(p), direction, weight) for direction, weight, p in rules.signals.values()]
        self.ends = compiled(f"[{re.escape(rules.endings)}|]")

    def said(self, text: str) -> Iterator[tuple[str, bool, list[tuple], list[tuple]]]:
        """(product_key, related, signals, sentences) of each product that a text names."""
        found = [(a, b, self.lexicon.rows[i][1]) for a, b, i, _ in self.lexicon.matches(text)]
        if not found:
            return
        heads = [m.span() for m in self.heading.finditer(text)]
        owners = self._owners(found, heads)
        scopes = self._scopes(found, heads, owners, len(text))
        signals = self._signals(text, found, scopes)
        sentences = self._sentences(text, found, scopes)
        for key in sorted({k for *_, k in found}):
            own = [m for m in found if m[2] == key]
            yield key, all(self._foreign(a, key, heads, owners) for a, *_ in own), signals.get(key, []), sentences.get(key, [])

    @staticmethod
    def _head(heads: list[Span], start: int) -> int:
        """Number of the last heading at or before a place; -1 before the first."""
        return bisect_right(heads, (start, 1 << 62)) - 1

    def _owners(self, found: list[tuple], heads: list[Span]) -> dict[int, set[str]]:
        """Products named inside a heading, by its number."""
        out: dict[int, set[str]] = {}
        for start, _, key in found:
            i = self._head(heads, start)
            if i >= 0 and start < heads[i][1]:
                out.setdefault(i, set()).add(key)
        return out

    def _foreign(self, start: int, key: str, heads: list[Span], owners: dict[int, set[str]]) -> bool:
        """Whether a mention lies in a section that other, concrete products own."""
        i = self._head(heads, start)
        keys = owners.get(i, ()) if i >= 0 else ()
        return i >= 0 and start >= heads[i][1] and key not in keys and any(not k.startswith("GROUP.") for k in keys)

    def _scopes(self, found: list[tuple], heads: list[Span], owners: dict[int, set[str]], n: int) -> dict[str, list[tuple[int, int, int]]]:
        """Scopes (start, stop, number of concrete products that own it, 0 where none does) by product, in order: bodies of own sections; products without one get merged windows round their mentions, within their section."""
        body = lambda i: (heads[i][1], heads[i + 1][0] if i + 1 < len(heads) else n)
        out: dict[str, list[tuple[int, int, int]]] = {}
        for i in sorted(owners):
            concrete = sum(not k.startswith("GROUP.") for k in owners[i])
            for key in owners[i]:
                out.setdefault(key, []).append((*body(i), concrete))
        owned = set(out)
        for start, stop, key in found:
            if key in owned:
                continue
            i = self._head(heads, start)
            low, high = body(i) if i >= 0 else (0, n)
            a, b = max(start - self.rules.reach, low), min(stop + self.rules.reach, high)
            merged = out.setdefault(key, [])
            if a < b and merged and a <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(merged[-1][1], b), 0)
            elif a < b:
                merged.append((a, b, 0))
        return out

    def _signals(self, text: str, found: list[tuple], scopes: dict[str, list[tuple]]) -> dict[str, list[tuple]]:
        """(start, stop, direction, confidence, weight, factor) by product: signals in a scope that one product owns alone, or in another scope of the product that is their owner; then the longest first."""
        signals = sorted((*m.span(), direction, weight) for pattern, direction, weight in self.signals for m in pattern.finditer(text))
        if not signals:
            return {}
        begins, starts, stops = [s[0] for s in signals], [m[0] for m in found], [m[1] for m in found]
        units = []
        for marks in (self.clause, self.sentence):
            at = [m.start() for m in marks.finditer(text)]
            units.append((at, [bisect_left(at, a) for a in starts]))

        @cache
        def owner(at: int) -> str | None:
            """The nearest product of the clause, else of the sentence: one that ends before, else the nearest; none if two tie."""
            before, over = bisect_right(stops, at) - 1, bisect_right(starts, at) - 1
            for marks, unit in units:
                here = bisect_left(marks, at)
                there = lambda i: 0 <= i < len(found) and unit[i] == here  # noqa: B023, E731
                if there(before):
                    return found[before][2]
                left, right = (found[i][2] if there(i) else None for i in (over, over + 1))
                if left and right:
                    far = (at - starts[over]) - (starts[over + 1] - at)
                    near = left if far < 0 or (far == 0 and left == right) else right if far > 0 else None
                else:
                    near = left or right
                if near:
                    return near
            return None

        out: dict[str, list[tuple]] = {}
        for key, areas in scopes.items():
            best: dict[tuple, tuple] = {}
            for low, high, owned in areas:
                for i in range(bisect_left(begins, low), len(signals)):
                    start, stop, direction, weight = signals[i]
                    if start >= high:
                        break
                    if stop <= high and (owned == 1 or owner(start) == key):
                        factor, sure = self._context(text, start, stop)
                        best[start, stop, direction] = max(best.get((start, stop, direction), ()), (sure, weight, factor))
            if best:
                out[key] = [(*k, *best[k]) for k in _longest_first(sorted(best))]
        return out

    def _context(self, text: str, start: int, stop: int) -> tuple[float, float]:
        """What a signal counts in arbitration, and how sure it is itself, by what stands around it."""
        n, words = self.rules.risks
        before, after = text[max(start - n, 0) : start], text[stop : stop + n]
        flags = {name for name, (m, _, said) in self.rules.flags.items() if any(w in before[-m:] for w in said)}
        around = before + after
        flags |= {"risk_context"} if any(w in around for w in words) else set()
        return self._factors(frozenset(flags))

    @cache  # noqa: B019
    def _factors(self, flags: frozenset) -> tuple[float, float]:
        factor, sure = 1.0, 1.0
        for name, weight in ({name: weight for name, (_, weight, _) in self.rules.flags.items()} | {"risk_context": ph.RISK_FACTOR}).items():
            factor *= weight if name in flags else 1.0
        for name, weight in ph.SIGNAL_FACTORS.items():
            sure *= weight if name in flags else 1.0
        return round(factor, 9), min(max(round(sure, 9), 0.05), 1.0)

    def _sentences(self, text: str, found: list[tuple], scopes: dict[str, list[tuple]]) -> dict[str, list[tuple]]:
        """(start, stop, phrase, mentions (start, key), shared) by product: sentences that end in its scopes, cut to the scope's beginning and without blanks before it. What stands before a `|` belongs to none."""
        parts, at = [], 0
        for m in self.ends.finditer(text):
            if m[0] != "|":
                parts.append((at, m.end()))
            at = m.end()
        stops, starts = [b for _, b in parts], [m[0] for m in found]
        out: dict[str, list[tuple]] = {}
        for key, areas in scopes.items():
            for low, high, owned in areas:
                for i in range(bisect_right(stops, low), bisect_right(stops, high)):
                    begin, stop = parts[i]
                    phrase = text[max(begin, low) : stop].lstrip(BLANK_SIGNS)
                    if phrase:
                        mentions = [(a, k) for a, _, k in found[bisect_left(starts, stop - len(phrase)) : bisect_left(starts, stop)]]
                        out.setdefault(key, []).append((stop - len(phrase), stop, phrase, mentions, owned > 1))
        return out


def _longest_first(spans: list[tuple[int, int, str]]) -> Iterator[tuple[int, int, str]]:
    """Of spans in order those that stay if the longest is kept first, each unless it overlaps a kept one; decided island by island."""
    at = 0
    while at < len(spans):
        end, until = at + 1, spans[at][1]
        while end < len(spans) and spans[end][0] < until:
            until, end = max(until, spans[end][1]), end + 1
        kept: list[tuple[int, int, str]] = []
        for x in sorted(spans[at:end], key=lambda x: (x[0] - x[1], x[0], x[2])):
            if not any(x[0] < y[1] and y[0] < x[1] for y in kept):
                kept.append(x)
        yield from kept
        at = end


_SIGNAL = pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("direction", pa.string()), ("confidence", pa.float64()), ("weight", pa.float64()), ("factor", pa.float64())])
_SENTENCE = pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("phrase", pa.string()), ("target", pa.bool_()), ("free", pa.bool_()), ("other", pa.bool_()), ("at", pa.int64()), ("until", pa.int64()), ("alone_at", pa.int64()), ("alone_until", pa.int64())])
_SHAPES = "related boolean, signals array<struct<start: bigint, stop: bigint, direction: string, confidence: double, weight: double, factor: double>>, sentences array<struct<start: bigint, stop: bigint, phrase: string, target: boolean, free: boolean, other: boolean, at: bigint, until: bigint, alone_at: bigint, alone_until: bigint>>"


def _shown(key: str, sentences: list[tuple], signals: list[tuple], clauses: re.Pattern, every: bool) -> Iterator[dict]:
    """Sentences with what makes them evidence: whether they name the product (target), nobody in an unshared scope (free) or others; and the first signal that does not open them, and the first whose clause names the product alone."""
    ordered = sorted(signals)
    begins = [s[0] for s in ordered]
    for start, stop, phrase, mentions, shared in sentences:
        first = alone = (None, None)
        marks, named_in = None, {}
        for a, b, *_ in ordered[bisect_right(begins, start) : bisect_left(begins, stop)]:
            if b > stop:
                continue
            first = (a, b) if first[0] is None else first
            # ends of clauses, looked for once a sentence
            marks = [start, *(start + m.end() for m in clauses.finditer(phrase)), stop] if marks is None else marks
            low, high = marks[bisect_right(marks, a) - 1], marks[bisect_right(marks, b)] if b < stop else stop
            if (low, high) not in named_in:
                named_in[low, high] = {k for _, k in mentions[bisect_left(mentions, (low, "")) : bisect_left(mentions, (high, ""))]}
            if named_in[low, high] == {key}:
                alone = (a, b)
                break
        if every or first[0] is not None:
            named = {k for _, k in mentions}
            yield {"start": start, "stop": stop, "phrase": phrase, "target": key in named, "free": not named and not shared, "other": bool(named - {key}), "at": first[0], "until": first[1], "alone_at": alone[0], "alone_until": alone[1]}


def read(docs: DataFrame, rules: Rules, clauses: str, every: bool = True) -> DataFrame:
    """doc_id, product_key, related (whether every mention lies in a section that other, concrete products own alone), signals, sentences of each product that a text names; a null product for a text that names none.

    Sentences are those of the product's scopes that hold a signal of it, or every one of them; `clauses` are the characters that end a clause."""
    number = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, marks = Reader(rules), re.compile(f"[{re.escape(clauses)}]")
        for batch in sliced(batches, 64):
            rows, out = [], []
            for row, text in enumerate(batch.column("text").to_pylist()):
                before = len(out)
                for key, related, signals, sentences in reader.said(text) if text else ():
                    out.append((key, related, [dict(zip(("start", "stop", "direction", "confidence", "weight", "factor"), s, strict=True)) for s in signals], list(_shown(key, sentences, signals, marks, every))))
                if len(out) == before:
                    out.append((None, None, [], []))
                rows += [row] * (len(out) - before)
            kinds = (pa.string(), pa.bool_(), pa.list_(_SIGNAL), pa.list_(_SENTENCE))
            columns = [pa.array([x[i] for x in out], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(rows, pa.int64())), *columns], names=["doc_id", "product_key", "related", "signals", "sentences"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {number}, product_key string, {_SHAPES}")


def quoted(said: DataFrame) -> DataFrame:
    """Rows of `read` with their sentences as quotes."""
    return settled(said, sentences=F.transform("sentences", lambda x: x.withField("quote", clean_quote(x["phrase"])).dropFields("phrase")))


def _proofs(most: int, endings: str, comparisons: tuple[str, ...]) -> Column:
    """Of sentences with quotes those that prove, as `proof.proofs` has them."""
    compared = lambda x: x["quote"].rlike("|".join(map(re.escape, comparisons)))
    chosen = lambda x, n: F.when(~x["other"] | compared(x), x[n]).otherwise(x[f"alone_{n}"])
    sound = F.filter("sentences", lambda x: (F.length(x["quote"]) >= 8) & proof.whole(x["quote"], endings) & chosen(x, "at").isNotNull())
    return proof.apart(F.array_sort(F.transform(sound, lambda x: F.struct(chosen(x, "at").alias("at"), chosen(x, "until").alias("until"), x["start"].alias("start"), x["stop"].alias("stop"), x["quote"].alias("quote")))), most)


def proofs(docs: DataFrame, rules: Rules, clauses: str, comparisons: tuple[str, ...], most: int = 3) -> DataFrame:
    """doc_id, product_key, place, start, stop, quote, as `proof.proofs` has them."""
    rows = quoted(read(docs, rules, clauses, every=False).filter("size(sentences) > 0"))
    kept = rows.select("doc_id", "product_key", F.posexplode(_proofs(most, rules.endings, comparisons)).alias("place", "x"))
    return kept.select("doc_id", "product_key", "place", "x.start", "x.stop", "x.quote")


def routed(docs: DataFrame, rules: Rules, clauses: str, comparisons: tuple[str, ...], boilerplate: tuple[str, ...], most: int = 3) -> DataFrame:
    """doc_id, product_key, outcome, reason, direction, confidence, need_manual_review, as `spans.routed` has them."""
    rows = quoted(read(docs, rules, clauses))
    score = lambda d: F.round(F.aggregate("signals", F.lit(0.0), lambda a, x: a + F.when(x["direction"] == d, x["weight"] * x["confidence"] * x["factor"]).otherwise(0.0)), 9)
    offered = F.exists("sentences", lambda x: proof.offers(x["quote"], rules.endings, boilerplate) & (x["target"] | x["free"]))
    sums = rows.select("doc_id", "product_key", "related", (F.size("signals") > 0).alias("signalled"), (F.size(_proofs(most, rules.endings, comparisons)) > 0).alias("proven"), offered.alias("offered"), *[score(d).alias(n) for d, n in zip(tx.DIRECTIONS, ("up", "down", "flat"), strict=True)])
    known = [F.when(F.col("signalled"), F.col(c)).alias(c) for c in ("accepted", "direction", "confidence")]
    return sp.routes(tx.judged(sums).select("doc_id", "product_key", "related", "proven", "offered", *known))
