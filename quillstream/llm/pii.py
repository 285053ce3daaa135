"""Personal data: fixed patterns, and a character-level bidirectional LSTM with CRF transitions that adds to them.

The network is trained in numpy from labelled spans: windows of the corpus with what the patterns find in
them, at most `TRAINING_WINDOWS` (by hash, over all documents), and copies of these windows in which each
span is written another way that the patterns do not know: a mail address with "(at)" and "dot", an address
with blanks or brackets round its dots, a card with other separators, a telephone without its plus. So it learns the forms and what stands around them, and finds what no pattern does. Texts are read
in overlapping windows. Every kind needs a digit, a sign for "at", that word between brackets, or the words "at" and "dot"
in one window, so labels other than "outside" are ruled out in windows that hold none of these, and these are not run. The
others' Viterbi paths give spans, which are reconciled over the whole text: overlapping spans of a kind
become one, of different kinds the surer one stays, and those that a pattern's span overlaps give way to it.
What can be verified is: an address has four numbers up to 255, a card passes the check of its last digit.

Defined results: null and empty texts have no spans; a text of any length is read whole; repeated rows get
equal results, and windows that are equal count once in the sample's order, so that ties change nothing; a
corpus without labelled spans leaves the patterns alone, an empty one has no rows. Patterns are matched in time that
grows with the text's length, whatever runs of digits, letters or signs it holds. Further columns are ignored
by `find` (its own names clash with none) and kept by `redact`. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstream.llm.common import tidy

KINDS = ("email", "ip", "card", "phone")
WINDOW, STRIDE = 128, 64
#: Bound of the labelled sample, half of it windows with spans, half that might hold one but do not.
TRAINING_WINDOWS = 800
#: Parts of the sample by hash, so that no task ranks the candidates of all, and rewritten copies of a window.
STRATA, COPIES = 64, 8
EPOCHS, LEAST_STEPS, BATCH = 1, 250, 32
#: Windows that are read side by side, which bounds a task's memory.
GROUP = 192
#: Least mean margin (label against outside, per character) of an added span.
LEAST_MARGIN = 2.0

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_HOST = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
#: A match begins where a run of digits does: none begins within one, as digits are taken whole.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: How "at" and "dot" are spelled out.
AT_WORDS, DOT_WORDS = ("at", "arroba"), ("dot", "punto", "punkt")
_AT_WORD = re.compile(rf"(?i)(?<![A-Za-z0-9])(?:{'|'.join(AT_WORDS)})(?![A-Za-z0-9])")
_DOT_WORD = re.compile(rf"(?i)(?<![A-Za-z0-9])(?:{'|'.join(DOT_WORDS)})(?![A-Za-z0-9])")
#: A digit, a sign for "at", or the word between brackets.
_HINT = re.compile(rf"(?i)[0-9@０-９＠]|[(\[{{<]\s?(?:{'|'.join(AT_WORDS)})\s?[)\]}}>]")
_NO_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping mail addresses: from each sign the local part to its left, as far as nothing took it, and the host to its right."""
    out, done = [], 0
    at = text.find("@")
    while at >= 0:
        before = text[done:at]
        start = done + len(before.rstrip(_LOCAL))
        host = _HOST.match(text, at + 1) if start < at else None
        # what stands before this sign belongs to no later address
        done = host.end() if host else at + 1
        if host:
            out.append((start, done))
        at = text.find("@", max(done, at + 1))
    return out


def numbers(text: str) -> list[tuple[int, int]]:
    """All chains of digits that are as long as a card's."""
    return [m.span() for m in _CARD.finditer(text) if m.end() - m.start() >= 14 and 14 <= len(_NO_DIGIT.sub("", m.group())) <= 19]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of what the patterns find, in order of start, then kind."""
    out = [(a, 0, b) for a, b in emails(text)]
    if "." in text:
        out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m.group().split("."))]
    out += [(a, 2, b) for a, b in numbers(text) if luhn(_NO_DIGIT.sub("", text[a:b]))]
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= len(_NO_DIGIT.sub("", m.group())) <= 15]
    return sorted(out)


class Apart:
    """Spans (start, kind, end), asked which of them overlap another."""

    def __init__(self, spans: list[tuple[int, int, int]]) -> None:
        self.spans = sorted(spans)
        self.starts = [a for a, _, _ in self.spans]
        self.reach = list(itertools.accumulate((b for _, _, b in self.spans), max))

    def over(self, a: int, b: int) -> list[tuple[int, int, int]]:
        first = bisect_right(self.reach, a)
        return [s for s in self.spans[first : bisect_left(self.starts, b)] if s[2] > a]


def shaped_spans(text: str) -> list[tuple[int, int, int]]:
    """What the network is to learn: the patterns' spans, and numbers that only fail the check of a card. Shape is for it to tell, the check is made afterwards."""
    own = base_spans(text)
    known = Apart(own)
    return sorted(own + [(a, 2, b) for a, b in numbers(text) if not known.over(a, b)])


def windows(text: str) -> list[int]:
    """Starts of the windows that hold a hint."""
    last = max(0, -(-(len(text) - WINDOW) // STRIDE))
    places = [m.start() for m in _HINT.finditer(text)]
    dots = [m.start() for m in _DOT_WORD.finditer(text)]
    for m in _AT_WORD.finditer(text) if dots else ():
        near = bisect_left(dots, m.end())
        if near < len(dots) and dots[near] - m.start() < WINDOW:
            places += [m.start(), dots[near]]
    out: set[int] = set()
    for at in places:
        i = min(at // STRIDE, last)
        out.add(i)
        if i and at - (i - 1) * STRIDE < WINDOW:
            out.add(i - 1)
    return sorted(i * STRIDE for i in out)


#: Character classes: ASCII as it is, other letters, other signs; 0 is the filling.
LETTER, OTHER, CLASSES = 128, 129, 130
LABELS = 1 + 2 * len(KINDS)  # outside, then begin and inside of each kind


def _classes() -> np.ndarray:
    out = np.full(1 << 16, OTHER, np.uint8)
    out[1:128] = np.arange(1, 128)
    out[0xAA:0x250] = out[0x370:0x2000] = LETTER
    for x in (0xA0, *range(0x2000, 0x200B), 0x202F, 0x3000):  # blanks
        out[x] = 32
    out[0x2010:0x2016] = ord("-")
    out[0xFF01:0xFF5F] = np.arange(0x21, 0x7F)  # full width
    return out


_CLASS = _classes()
_WIDE = {x: int(_CLASS[x]) for x in range(128, 1 << 16) if _CLASS[x] < 128}


def codes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return _CLASS[np.minimum(points, 0xFFFF)].astype(np.int64)


def rewritten(piece: str, kind: int, rng: np.random.Generator) -> str:
    """A span's text in a form that the patterns do not find."""
    pick = lambda *x: x[int(rng.integers(len(x)))]
    if kind == 0:
        name, _, host = piece.partition("@")
        at = pick(" (at) ", "(at)", " [at] ", "[at]", " at ", " @ ", "＠", " AT ", " {at} ")
        dot = " dot " if at in (" at ", " AT ") else pick(".", ".", "(dot)", " (dot) ", " dot ", "[.]", " . ")
        return name + at + host.replace(".", dot)
    if kind == 1:
        return piece.replace(".", pick(" . ", "[.]", "(.)", ". ", "-", " dot ", "．"))
    if kind == 2:
        digits = _NO_DIGIT.sub("", piece)
        return pick(".", "/", "\u00a0", "  ", "_", " - ", "–").join(digits[i : i + 4] for i in range(0, len(digits), 4))
    digits = _NO_DIGIT.sub("", piece)
    a, b, c, d = digits[:-10], digits[-10:-7], digits[-7:-4], digits[-4:]
    return pick(f"({b}) {c}-{d}", f"{b}-{c}-{d}", f"{b}.{c}.{d}", f"{a} ({b}) {c}-{d}", f"00{a} {b} {c} {d}", f"+{a}/{b}/{c}{d}", f"{a}-{b}-{c}-{d}", f"+{a}\u00a0({b})\u00a0{c}–{d}", f"{b} {c} {d}")


def window_copy(text: str, spans: list[tuple[int, int, int]], rng: np.random.Generator) -> tuple[str, list[tuple[int, int, int]]]:
    """A window whose spans, where they lie inside whole, are rewritten."""
    out, fresh, done, n = [], [], 0, 0
    for a, kind, b in sorted(spans):
        if a < done:
            continue
        piece = text[a:b]
        whole = rewritten(piece, kind, rng) if a > 0 and b < len(text) else piece
        out += [text[done:a], whole]
        n += a - done
        fresh.append((n, kind, n + len(whole)))
        n, done = n + len(whole), b
    text = ("".join(out) + text[done:])[:WINDOW]
    return text, [(a, kind, min(b, WINDOW)) for a, kind, b in fresh if a < WINDOW]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Tagger:
    """Embedding, an LSTM in either direction, a linear layer, and CRF transitions."""

    def __init__(self, width: int = 32, embed: int = 16, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.width = width
        draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.weights = {"embed": draw(CLASSES, embed) * np.float32(3), "out": draw(2 * width, LABELS), "bias": np.zeros(LABELS, np.float32), "move": np.zeros((LABELS, LABELS), np.float32)}
        for d in "fb":
            self.weights |= {f"in_{d}": draw(embed, 4 * width), f"own_{d}": draw(width, 4 * width), f"add_{d}": np.zeros(4 * width, np.float32)}
            self.weights[f"add_{d}"][width : 2 * width] = 1  # forget gates begin open

    def _direction(self, x: np.ndarray, d: str, keep: bool) -> tuple[np.ndarray, tuple]:
        """Hidden states [time, batch, width] over class codes x [time, batch]."""
        w, n = self.weights, self.width
        given = (w["embed"] @ w[f"in_{d}"] + w[f"add_{d}"])[x]
        steps, batch = x.shape
        h = np.zeros((batch, n), np.float32)
        c = np.zeros((batch, n), np.float32)
        hs = np.empty((steps, batch, n), np.float32)
        gates = np.empty((steps, batch, 4 * n), np.float32) if keep else None
        cs = np.empty((steps, batch, n), np.float32) if keep else None
        own = w[f"own_{d}"]
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = given[t] + h @ own
            z[:, : 3 * n] = _sigmoid(z[:, : 3 * n])
            z[:, 3 * n :] = np.tanh(z[:, 3 * n :])
            c = z[:, n : 2 * n] * c + z[:, :n] * z[:, 3 * n :]
            h = z[:, 2 * n : 3 * n] * np.tanh(c)
            hs[t] = h
            if keep:
                gates[t], cs[t] = z, c
        return hs, (gates, cs)

    def emissions(self, x: np.ndarray, keep: bool = False) -> tuple[np.ndarray, tuple]:
        forward, a = self._direction(x, "f", keep)
        backward, b = self._direction(x, "b", keep)
        both = np.concatenate([forward, backward], 2)
        return both @ self.weights["out"] + self.weights["bias"], (both, a, b)

    def paths(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Viterbi labels [time, batch] and emissions."""
        e, _ = self.emissions(x)
        move = self.weights["move"]
        path = np.zeros(x.shape, np.int64)
        # where no other label comes near "outside" at any place, whatever transitions gain, all is outside
        gain = max(0.0, float(move.max() - move[0, 0]))
        some = np.flatnonzero((e[:, :, 1:].max(2) - e[:, :, 0]).max(0) > -2 * gain)
        if len(some):
            path[:, some] = self._viterbi(e[:, some], move)
        return path, e

    def _viterbi(self, e: np.ndarray, move: np.ndarray) -> np.ndarray:
        steps, batch, _ = e.shape
        best, back = e[0], np.empty((steps, batch, LABELS), np.int8)
        for t in range(1, steps):
            ways = best[:, :, None] + move
            back[t] = ways.argmax(1)
            best = ways.max(1) + e[t]
        path = np.empty((steps, batch), np.int64)
        path[-1] = best.argmax(1)
        rows = np.arange(batch)
        for t in range(steps - 1, 0, -1):
            path[t - 1] = back[t][rows, path[t]]
        return path

    def _loss_gradient(self, e: np.ndarray, y: np.ndarray, real: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradients of the CRF's negative log-likelihood by emissions and transitions; filling is labelled outside and weighs nothing."""
        steps, batch, _ = e.shape
        move, near = np.exp(self.weights["move"]), np.exp(e - e.max(2, keepdims=True))
        # forward and backward sums, scaled to 1 at each step
        alpha, beta, scale = np.empty_like(e), np.ones_like(e), np.empty((steps, batch, 1), np.float32)
        alpha[0] = near[0]
        for t in range(steps):
            if t:
                np.multiply(alpha[t - 1] @ move, near[t], out=alpha[t])
            scale[t] = alpha[t].sum(1, keepdims=True)
            alpha[t] /= scale[t]
        ahead = np.empty_like(e)
        for t in range(steps - 1, 0, -1):
            np.multiply(near[t], beta[t] / scale[t], out=ahead[t])
            np.matmul(ahead[t], move.T, out=beta[t - 1])
        by_emission = alpha * beta
        by_move = move * np.tensordot(alpha[:-1], ahead[1:], ((0, 1), (0, 1)))
        np.subtract.at(by_move, (y[:-1].ravel(), y[1:].ravel()), 1)
        by_emission -= np.eye(LABELS, dtype=np.float32)[y]
        return by_emission * real[:, :, None] / batch, by_move / batch

    def step(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients over a batch of windows [time, batch]."""
        w, n = self.weights, self.width
        e, (both, a, b) = self.emissions(x, keep=True)
        by_e, by_move = self._loss_gradient(e, y, x > 0)
        out = {"move": by_move.astype(np.float32), "out": np.tensordot(both, by_e, ((0, 1), (0, 1))), "bias": by_e.sum((0, 1))}
        by_class = np.zeros((x.size, w["embed"].shape[1]), np.float32)
        by_h = by_e @ w["out"].T
        for d, (gates, cs), piece in (("f", a, by_h[:, :, :n]), ("b", b, by_h[:, :, n:])):
            order = range(len(x)) if d == "f" else range(len(x) - 1, -1, -1)
            order = list(order)
            hs = both[:, :, :n] if d == "f" else both[:, :, n:]
            dz = np.empty_like(gates)
            dh = np.zeros_like(cs[0])
            dc = np.zeros_like(cs[0])
            for i in range(len(order) - 1, -1, -1):
                t = order[i]
                z, c = gates[t], cs[t]
                before = cs[order[i - 1]] if i else np.zeros_like(c)
                squashed = np.tanh(c)
                dh = dh + piece[t]
                dc = dc + dh * z[:, 2 * n : 3 * n] * (1 - squashed**2)
                dz[t, :, :n] = dc * z[:, 3 * n :] * z[:, :n] * (1 - z[:, :n])
                dz[t, :, n : 2 * n] = dc * before * z[:, n : 2 * n] * (1 - z[:, n : 2 * n])
                dz[t, :, 2 * n : 3 * n] = dh * squashed * z[:, 2 * n : 3 * n] * (1 - z[:, 2 * n : 3 * n])
                dz[t, :, 3 * n :] = dc * z[:, :n] * (1 - z[:, 3 * n :] ** 2)
                dh = dz[t] @ w[f"own_{d}"].T
                dc = dc * z[:, n : 2 * n]
            previous = np.zeros_like(hs)
            previous[order[1:]] = hs[order[:-1]]
            out[f"own_{d}"] = np.tensordot(previous, dz, ((0, 1), (0, 1)))
            out[f"add_{d}"] = dz.sum((0, 1))
            out[f"in_{d}"] = np.tensordot(w["embed"][x], dz, ((0, 1), (0, 1)))
            by_class += (dz @ w[f"in_{d}"].T).reshape(by_class.shape)
        out["embed"] = np.eye(CLASSES, dtype=np.float32)[x.ravel()].T @ by_class
        return out

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, batch: int = BATCH, rate: float = 0.015, seed: int = 7) -> Tagger:
        rng = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.weights.items()}
        second = {k: np.zeros_like(v) for k, v in self.weights.items()}
        each = max(1, -(-x.shape[1] // batch))
        epochs, k = max(epochs, -(-LEAST_STEPS // each)), 0
        for _ in range(epochs):
            order = rng.permutation(x.shape[1])
            for s in range(0, len(order), batch):
                k += 1
                pace = rate * min(1.0, 1 - 2.25 * (k / (epochs * each) - 0.6))  # slower from three fifths on
                for name, g in self.step(x[:, order[s : s + batch]], y[:, order[s : s + batch]]).items():
                    first[name] += 0.1 * (g - first[name])
                    second[name] += 0.01 * (g * g - second[name])
                    self.weights[name] -= (pace * (first[name] / (1 - 0.9**k)) / (np.sqrt(second[name] / (1 - 0.99**k)) + 1e-8)).astype(np.float32)
        return self


def labelled_windows(docs: DataFrame, most: int = TRAINING_WINDOWS, copies: int = COPIES) -> tuple[np.ndarray, np.ndarray] | None:
    """The labelled sample: codes and labels [time, window] of at most `most` windows of the corpus, and `copies` rewritten ones of each with spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[str, str, int]] = []
            for value in batch.column("text"):
                text = value.as_py() or ""
                starts = windows(text)
                spans = shaped_spans(text) if starts else []
                known = Apart(spans)
                for s in starts:
                    inside = [(max(a, s) - s, k, min(b, s + WINDOW) - s) for a, k, b in known.over(s, s + WINDOW)]
                    out.append((text[s : s + WINDOW], ",".join(f"{a}:{k}:{b}" for a, k, b in inside), int(bool(inside))))
            columns = zip(*out, strict=True) if out else ([], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int32()), strict=True)], names=["text", "spans", "has"])

    found = docs.select("text").mapInArrow(tidy(run), "text string, spans string, has int").withColumn("order", F.xxhash64("text"))
    # the windows of least hash of each stratum: every task that reads passes on a few, and many tasks rank them
    best = Window.partitionBy("has", F.pmod(F.xxhash64("order"), F.lit(STRATA))).orderBy("order", "text", "spans")
    ranked = found.select("*", F.row_number().over(best).alias("n")).filter(F.col("n") <= max(1, most // 2 // STRATA))
    rows = [(r["text"], [tuple(map(int, x.split(":"))) for x in r["spans"].split(",")] if r["spans"] else []) for r in ranked.select("text", "spans").collect()]
    rows = sorted(rows)
    if not any(spans for _, spans in rows):
        return None
    rng = np.random.default_rng(5)
    rows += [window_copy(text, spans, rng) for text, spans in rows if spans for _ in range(copies)]
    x, y = np.zeros((WINDOW, len(rows)), np.int64), np.zeros((WINDOW, len(rows)), np.int64)
    for i, (text, spans) in enumerate(rows):
        x[: len(text), i] = codes(text)
        for a, k, b in spans:
            y[a:b, i] = 2 + 2 * k
            y[a, i] = 1 + 2 * k
    return x, y


def train(docs: DataFrame) -> Tagger | None:
    sample = labelled_windows(docs)
    return Tagger().fit(*sample) if sample else None


def _path_spans(path: np.ndarray, e: np.ndarray) -> list[tuple[int, int, int, float]]:
    """(start, kind, end, margin) of one window's labels."""
    out, n = [], len(path)
    inside = np.flatnonzero(path)
    i = 0
    while i < len(inside):
        a = int(inside[i])
        kind = (int(path[a]) - 1) // 2
        b = a + 1
        while b < n and path[b] == 2 + 2 * kind:
            b += 1
        margin = float((e[np.arange(a, b), path[a:b]] - e[a:b, 0]).mean())
        out.append((a, kind, b, margin))
        i += b - a
    return out


_AT = re.compile(rf"(?i)@|(?<![A-Za-z0-9])(?:{'|'.join(AT_WORDS)})(?![A-Za-z0-9])")
_NUMBER = re.compile(r"[0-9]+")


def verified(piece: str, kind: int) -> bool:
    """Whether a span can be what it is taken for."""
    piece = piece.translate(_WIDE)
    numbers = _NUMBER.findall(piece)
    digits = "".join(numbers)
    if kind == 0:
        return bool(_AT.search(piece)) and len(piece) >= 6
    if kind == 1:
        return len(numbers) == 4 and all(len(x) <= 3 and int(x) <= 255 for x in numbers)
    if kind == 2:
        return 14 <= len(digits) <= 19 and luhn(digits)
    return 10 <= len(digits) <= 15


_WORD_RUN, _DIGIT_RUN = re.compile(r"[^\W_]+"), re.compile(r"\d+")


def _snapped(text: str, spans: list[list], kind: int) -> list[list]:
    """Spans (start, kind, end, margin) of one kind, in order, widened to the ends of the words or numbers that they cut; those that then overlap are one."""
    pattern, out = (_WORD_RUN if kind == 0 else _DIGIT_RUN), []
    of = (lambda c: c.isalnum()) if kind == 0 else (lambda c: c.isdecimal())
    for a, _, b, m in spans:
        if out and a < out[-1][2]:
            if b <= out[-1][2]:
                out[-1][3] = max(out[-1][3], m)
                continue
            a = out[-1][2]
        floor = out[-1][2] if out else 0
        while a > floor and of(text[a - 1]) and of(text[a]):
            a -= 1
        if of(text[b - 1]) and (more := pattern.match(text, b)):
            b = more.end()
        if out and a == out[-1][2] and a and of(text[a - 1]) and of(text[a]):
            out[-1][2], out[-1][3] = b, max(out[-1][3], m)
        else:
            out.append([a, kind, b, m])
    return out


def _outside(text: str, a: int, b: int, own: Apart) -> list[tuple[int, int]]:
    """What the spans of `own` leave of a span, without blanks at its ends."""
    out = []
    for y, _, z in own.over(a, b):
        if a < z:
            out.append((a, y))
            a = max(a, z)
    parts = [(i + len(text[i:j]) - len(text[i:j].lstrip()), i + len(text[i:j].rstrip())) for i, j in (*out, (a, b)) if i < j]
    return [(i, j) for i, j in parts if i < j]


class Taken:
    """Spans that do not overlap, put in one by one."""

    def __init__(self) -> None:
        self.spans: list[tuple[int, int, int]] = []

    def put(self, a: int, kind: int, b: int) -> None:
        i = bisect_left(self.spans, (a, kind, b))
        if not (i and self.spans[i - 1][2] > a) and not (i < len(self.spans) and self.spans[i][0] < b):
            self.spans.insert(i, (a, kind, b))


def added_spans(texts: list[str], base: list[list[tuple[int, int, int]]], tagger: Tagger) -> list[list[tuple[int, int, int]]]:
    """What the network adds to the patterns' spans of each text."""
    places = [(i, s) for i, t in enumerate(texts) for s in windows(t)]
    found: list[list[tuple[int, int, int, float]]] = [[] for _ in texts]
    for k in range(0, len(places), GROUP):
        group = places[k : k + GROUP]
        x = np.zeros((WINDOW, len(group)), np.int64)
        for j, (i, s) in enumerate(group):
            piece = codes(texts[i][s : s + WINDOW])
            x[: len(piece), j] = piece
        path, e = tagger.paths(x)
        path[x == 0] = 0
        for j in np.flatnonzero(path.any(0)):
            i, s = group[j]
            found[i] += [(s + a, kind, s + b, m) for a, kind, b, m in _path_spans(path[:, j], e[:, j])]
    out = []
    for text, spans, own in zip(texts, found, base, strict=True):
        merged: list[list] = []
        for kind in range(len(KINDS)):
            joined: list[list] = []
            for a, _, b, m in sorted(s for s in spans if s[1] == kind):
                if joined and a < joined[-1][2]:
                    joined[-1][2], joined[-1][3] = max(joined[-1][2], b), max(joined[-1][3], m)
                else:
                    joined.append([a, kind, b, m])
            merged += _snapped(text, [s for s in joined if s[3] >= LEAST_MARGIN], kind)
        known, kept = Apart(own), Taken()
        for a, kind, b, _ in sorted(merged, key=lambda s: (-s[3], s[0])):
            for x, y in _outside(text, a, b, known):
                if verified(text[x:y], kind):
                    kept.put(x, kind, y)
        out.append(kept.spans)
    return out


def _texts(batch: pa.RecordBatch) -> list[str]:
    return [x or "" for x in batch.column(batch.schema.get_field_index("text")).to_pylist()]


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def find(docs: DataFrame, tagger: Tagger | None) -> DataFrame:
    """doc_id, counts by kind and digest of the patterns' spans, all spans, how many the network adds, and how many there are."""
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, n_spans long"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = _texts(batch)
            base = [base_spans(t) for t in texts]
            more = added_spans(texts, base, tagger) if tagger else [[] for _ in texts]
            counts = [pa.array([sum(s[1] == k for s in own) for own in base], pa.int64()) for k in range(len(KINDS))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), *counts, pa.array([hashlib.sha256(_joined(x).encode()).hexdigest() for x in base]), pa.array([_joined(x + y) for x, y in zip(base, more, strict=True)], pa.string()), pa.array([len(x) for x in more], pa.int64()), pa.array([len(x) + len(y) for x, y in zip(base, more, strict=True)], pa.int64())],
                names=names,
            )

    return docs.select("doc_id", "text").mapInArrow(tidy(run), schema)


def redact(docs: DataFrame, tagger: Tagger | None) -> DataFrame:
    """docs whose texts have each span, overlapping ones together, replaced by its kind in brackets; n_chars, where there is one, follows."""
    columns = docs.columns

    def clean(text: str, spans: list[tuple[int, int, int]]) -> str:
        out, done = [], 0
        for a, k, b in sorted(spans):
            if a >= done:
                out += [text[done:a], f"[{KINDS[k].upper()}]"]
            done = max(done, b)
        return "".join([*out, text[done:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = _texts(batch)
            base = [base_spans(t) for t in texts]
            more = added_spans(texts, base, tagger) if tagger else [[] for _ in texts]
            fresh = [clean(t, x + y) if x or y else t for t, x, y in zip(texts, base, more, strict=True)]
            given = batch.column(batch.schema.get_field_index("text"))
            out = {"text": pa.array([f if g.is_valid else None for f, g in zip(fresh, given, strict=True)], pa.string())}
            if "n_chars" in columns:
                old = batch.column(batch.schema.get_field_index("n_chars"))
                out["n_chars"] = pa.array([len(f) if f != t else n for f, t, n in zip(fresh, texts, old.to_pylist(), strict=True)], old.type)
            yield pa.RecordBatch.from_arrays([out.get(c, batch.column(batch.schema.get_field_index(c))) for c in columns], names=columns)

    return docs.mapInArrow(tidy(run), docs.schema)
