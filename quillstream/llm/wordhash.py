"""Vectorised word, shingle and span hashing of whole Arrow batches.

Everything works on the UTF-8 bytes of a batch at once: no Python loop runs over words.
Words are maximal runs without the six ASCII blanks (space and 0x09-0x0D).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Odd multiplier of the position weights and its inverse modulo 2**64.
STEP = 0x9E3779B97F4A7C15
STEP_INVERSE = pow(STEP, -1, 1 << 64)
#: Bytes handled at once; bounds the memory of a batch (about 40 bytes for each byte of text).
SLAB_BYTES = 4 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> U64(31))
    x = x * U64(0x7FB5D329728EA185)
    x = x ^ (x >> U64(27))
    x = x * U64(0x81DADEF4BC2DD44D)
    return x ^ (x >> U64(33))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, U64)
    if n > 1:
        out[1:] = U64(base)
        with np.errstate(over="ignore"):
            out = np.multiply.accumulate(out)
    return out


class _Tables:
    def __init__(self) -> None:
        codes = np.arange(1, 257, dtype=np.uint64)
        self.exact = mix(codes * U64(0xD1B54A32D192ED03))
        self.folded = self.exact.copy()
        self.folded[65:91] = self.exact[97:123]
        self.blank = np.zeros(256, bool)
        self.blank[[9, 10, 11, 12, 13, 32]] = True
        self.up = self.down = np.ones(1, U64)

    def weights(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 16)
            self.up, self.down = _powers(STEP, size), _powers(STEP_INVERSE, size)
        return self.up, self.down


_TABLES = _Tables()


class Words:
    """Words of some texts: `hash`, byte `start` and `end` (in `data`), and `first[i]:first[i + 1]`, the words of text i."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, fold: bool) -> None:
        self.data, self.offsets = data, offsets
        table = _TABLES.folded if fold else _TABLES.exact
        blank = _TABLES.blank[data] if len(data) else np.zeros(0, bool)
        solid = ~blank
        begins = solid.copy()
        begins[1:] &= blank[:-1]
        edges = offsets[(offsets > 0) & (offsets < len(data))]
        begins[edges] = solid[edges]
        ends = solid.copy()
        ends[:-1] &= blank[1:]
        ends[edges - 1] = solid[edges - 1]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        up, down = _TABLES.weights(len(data) + 1)
        total = np.zeros(len(data) + 1, U64)
        np.cumsum(table[data] * up[: len(data)], out=total[1:])
        self.hash = mix((total[self.end] - total[self.start]) * down[self.start] + (self.end - self.start).astype(U64))
        self.first = np.searchsorted(self.start, offsets)


def slabs(text: pa.Array, fold: bool):
    """(first row, Words) of consecutive rows of a string array; null counts as empty. Rows are never cut."""
    text = text.combine_chunks() if isinstance(text, pa.ChunkedArray) else text
    text = text.cast(pa.large_string())
    if text.null_count:
        text = text.fill_null("")
    if not len(text):
        return
    _, at, data = text.buffers()
    offsets = np.frombuffer(at, np.int64)[text.offset : text.offset + len(text) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(text):
        stop = int(np.searchsorted(offsets, offsets[row] + SLAB_BYTES, "right")) - 1
        stop = min(max(stop, row + 1), len(text))
        yield row, Words(data[offsets[row] : offsets[stop]], offsets[row : stop + 1] - offsets[row], fold)
        row = stop


def runs(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each word on; the last k - 1 values run past the end and are not to be used."""
    out, width, base = hashes, 1, STEP
    bits = bin(k)[3:]
    for bit in bits:
        ahead = np.zeros_like(out)
        ahead[:-width] = out[width:] if width < len(out) else 0
        out, width = out * U64(base) + ahead, width * 2
        base = base * base % (1 << 64)
        if bit == "1":
            ahead = np.zeros_like(out)
            if width < len(out):
                ahead[:-width] = hashes[width:]
            out, width, base = out * U64(STEP) + ahead, width + 1, base * STEP % (1 << 64)
    return mix(out)


def char_offsets(data: np.ndarray) -> np.ndarray:
    """Code points before each byte, and in all at the end."""
    out = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=out[1:])
    return out
