"""Byte-pair encoding by dynamic programming over prefixes, and decoding.

The vocabulary's tokens form a generalised suffix automaton. Text runs through it byte by byte; the
suffix links of the state reached hold every token that ends there. For each prefix of a word exactly
one token can be the last of its encoding: the one whose predecessor (the last token of the prefix
before it) is compatible with it, that is, whose common border no merge would have crossed earlier.
Back-pointers from the end give the ids. The encoder reads a tokenizer file's vocabulary and merges;
nothing is trained. Words are cached, as the words of a corpus repeat.

Defined results: null and empty texts give no ids; a text or word of any length is encoded whole; repeated
rows are encoded alike; an empty table has no rows. Further columns are ignored by `digests` and kept by
`encode`, where a clashing column of ids is replaced.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quillstream.llm.common import extended
from quillstream.llm.pretoken import Splitter, byte_letters

#: Bytes of each of the two generations of the word cache, about: words, ids, and what holds an entry.
CACHE_BYTES, ENTRY_BYTES = 48 << 20, 200
#: Texts are handed on in groups of about this many characters.
GROUP_CHARS = 4 << 20


class SuffixAutomaton:
    """All substrings of some sequences of symbols below `span`; `ends[state]`, the sequence that is the state's longest string."""

    def __init__(self, sequences: list[tuple[int, ...]], span: int) -> None:
        self.span = span
        self.go: dict[int, int] = {}
        self.link, self.length = [-1], [0]
        fresh: list[dict[int, int]] = [{}]  # transitions by state while building
        for seq in sequences:
            last = 0
            for c in seq:
                last = self._extend(fresh, last, c)
        for state, out in enumerate(fresh):
            base = state * span
            for c, to in out.items():
                self.go[base + c] = to
        where = []
        for seq in sequences:
            state = 0
            for c in seq:
                state = self.go[state * span + c]
            where.append(state)
        self.where = where

    def _clone(self, fresh: list[dict[int, int]], p: int, q: int, c: int) -> int:
        new = len(fresh)
        fresh.append(dict(fresh[q]))
        self.length.append(self.length[p] + 1)
        self.link.append(self.link[q])
        self.link[q] = new
        while p != -1 and fresh[p].get(c) == q:
            fresh[p][c] = new
            p = self.link[p]
        return new

    def _extend(self, fresh: list[dict[int, int]], last: int, c: int) -> int:
        known = fresh[last].get(c)
        if known is not None:
            return known if self.length[known] == self.length[last] + 1 else self._clone(fresh, last, known, c)
        new = len(fresh)
        fresh.append({})
        self.length.append(self.length[last] + 1)
        self.link.append(0)
        p = last
        while p != -1 and c not in fresh[p]:
            fresh[p][c] = new
            p = self.link[p]
        if p != -1:
            q = fresh[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(fresh, p, q, c)
        return new


class Encoder:
    """A word-end BPE: lower-cased words, the last byte of each being a symbol of its own."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model["end_of_word_suffix"]
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.letters = byte_letters()
        byte_of = {c: b for b, c in enumerate(self.letters)}
        self.splitter = Splitter(spec)

        def symbols(token: str) -> tuple[int, ...]:
            last = token.endswith(self.end) and token != self.end
            body = [byte_of[c] for c in (token[: -len(self.end)] if last else token)]
            if last:
                body[-1] += 256
            return tuple(body)

        n = len(self.vocab)
        self.rank = [-1] * n  # when a token is made: no earlier than its parts
        self.parts: list[tuple[int, int] | None] = [None] * n
        self.join: dict[tuple[int, int], int] = {}
        for r, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            a_id, b_id, made = self.vocab[a], self.vocab[b], self.vocab[a + b]
            self.join[a_id, b_id] = r
            if self.parts[made] is None:
                self.parts[made], self.rank[made] = (a_id, b_id), r
        self.symbols = {i: symbols(t) for t, i in self.vocab.items()}
        self.width = [len(self.symbols[i]) for i in range(n)]
        ids = [i for i in self.symbols if self.parts[i] is not None or self.width[i] == 1]
        ids = [i for i in ids if self._stands(i)]
        auto = SuffixAutomaton([self.symbols[i] for i in ids], 512)
        self.go, self.span = auto.go, auto.span
        token_at = dict(zip(auto.where, ids, strict=True))
        # of each state: the tokens that are suffixes of what leads there, longest first, as (token, length)
        self.link, self.length = auto.link, auto.length
        self.suffixes: list[tuple[tuple[int, int], ...]] = [()] * len(auto.link)
        for s in sorted(range(1, len(auto.link)), key=auto.length.__getitem__):
            above = self.suffixes[auto.link[s]]
            t = token_at.get(s)
            self.suffixes[s] = ((t, self.width[t]), *above) if t is not None and self.width[t] == auto.length[s] else above
        self.fits: dict[int, bool] = {}
        self.size = n
        self.fixed = {t: array("I", [i]).tobytes() for t, i in self.special.items()}
        self.young: dict[str, bytes] = dict(self.fixed)
        self.old: dict[str, bytes] = {}
        self.held = 0
        self._bytes = {i: bytes(b & 255 for b in s) + (b" " if s[-1] >= 256 else b"") for i, s in self.symbols.items()}
        self._bytes |= {i: t.encode() for t, i in self.special.items()}

    def _stands(self, token: int) -> bool:
        """Whether the token's own text is encoded as that token: its parts have to be compatible but for its own merge."""
        if self.parts[token] is None:
            return True
        a, b = self.parts[token]
        return self._compatible(a, b, self.rank[token]) and self._stands(a) and self._stands(b)

    def _compatible(self, a: int, b: int, limit: int) -> bool:
        """Whether no merge of rank below `limit` crosses the border of a and b, going back through their making."""
        while True:
            r = self.join.get((a, b))
            if r is not None and r < limit:
                return False
            ra, rb = self.rank[a], self.rank[b]
            if ra < 0 and rb < 0:
                return True
            # undo the later of the two; equal ranks are made from left to right, so the right one is undone first
            if ra > rb:
                limit, a = min(limit, ra), self.parts[a][1]
            else:
                # a merge across the border of the same rank comes first, as it lies further left
                limit, b = min(limit, rb + 1), self.parts[b][0]

    def compatible(self, a: int, b: int) -> bool:
        key = a * self.size + b
        known = self.fits.get(key)
        if known is None:
            if len(self.fits) > 2_000_000:
                self.fits.clear()
            known = self.fits[key] = self._compatible(a, b, 1 << 60)
        return known

    def word(self, data: bytes) -> list[int]:
        """Ids of one word's bytes."""
        n = len(data)
        last, back = [0] * (n + 1), [0] * (n + 1)
        state, matched, go, span, link, length, suffixes = 0, 0, self.go, self.span, self.link, self.length, self.suffixes
        fits, size = self.fits, self.size
        for i in range(n):
            c = data[i] + 256 if i == n - 1 else data[i]
            to = go.get(state * span + c)
            while to is None:
                state = link[state]
                matched = length[state]
                to = go.get(state * span + c)
            state, matched = to, matched + 1
            for t, width in suffixes[state]:
                if width > matched:  # the state's longest string reaches back further than what was read
                    continue
                j = i + 1 - width
                if j:
                    p = last[j]
                    if p < 0:
                        continue
                    ok = fits.get(p * size + t)
                    if not (self.compatible(p, t) if ok is None else ok):
                        continue
                last[i + 1], back[i + 1] = t, j
                break
            else:
                last[i + 1] = -1
        out = []
        while n:
            out.append(last[n])
            n = back[n]
        out.reverse()
        return out

    def _cached(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            ids = array("I", self.word(word.encode())).tobytes()
        if self.held >= CACHE_BYTES:
            self.old, self.young, self.held = self.young, dict(self.fixed), 0
        self.young[word] = ids
        self.held += 2 * len(word) + len(ids) + ENTRY_BYTES
        return ids

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        words = self.splitter.split(text)
        for w in set(words).difference(self.young):
            self._cached(w)
        try:
            return b"".join(map(self.young.__getitem__, words))
        except KeyError:  # the cache was renewed meanwhile
            return b"".join([self.young.get(w) or self._cached(w) for w in words])

    def decode(self, ids: bytes) -> str:
        """The text of ids: the words' bytes with a blank between words, as the file's (absent) decoder leaves it to `text_of`."""
        names = self._names
        return " ".join(names[i] for i in np.frombuffer(ids, "<u4"))

    @property
    def _names(self) -> list[str]:
        if not hasattr(self, "_names_"):
            names = [""] * (max([*self.vocab.values(), *self.special.values()]) + 1)
            for t, i in [*self.vocab.items(), *self.special.items()]:
                names[i] = t
            self._names_ = names
        return self._names_


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of a file, made once in each Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _groups(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, list[str]]]:
    start, group, chars = 0, [], 0
    for i, value in enumerate(batch.column(batch.schema.get_field_index(column))):
        text = value.as_py() or ""
        group.append(text)
        chars += len(text)
        if chars >= GROUP_CHARS:
            yield start, group
            start, group, chars = i + 1, [], 0
    if group:
        yield start, group


def encode(docs: DataFrame, text: str = "text", path: str | None = None, to: str = "ids") -> DataFrame:
    """docs with a binary column `to`: the ids of the text, little-endian unsigned 32-bit. A clashing column is replaced."""
    path = path or vocabulary()
    keep = [c for c in docs.columns if c != to]
    schema = extended(docs.select(*keep), f"{to} binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            for start, texts in _groups(batch, text):
                part = batch.slice(start, len(texts))
                ids = pa.array([enc.encode(t) for t in texts], pa.binary())
                yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(c)) for c in keep), ids], names=[*keep, to])

    return docs.mapInArrow(run, schema)


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every whole text."""
    path = path or vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            ids = batch.column("ids").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                    pa.array([hashlib.sha256(enc.decode(x).encode()).hexdigest() for x in ids], pa.string()),
                ],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    # Both steps are narrow: ids go from one Python step to the next without a shuffle.
    return encode(docs.select("doc_id", "text"), path=path).select("doc_id", "ids").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
