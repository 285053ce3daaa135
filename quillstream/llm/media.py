"""Media columns: payloads kept losslessly in baseline JPEG files, and their features.

The JPEG's own unit is the quantised coefficient, so a payload byte is stored as one: each 64 bytes fill
a block (byte - 128 as its DC, byte + 1 as each AC coefficient) of a grey image whose quantisation table
is all ones. Nine blocks (576 bytes) make a restart interval. Reading parses the markers, removes byte
stuffing and Huffman-decodes all restart intervals of a batch side by side in numpy; it takes any
baseline image, with several components, run lengths and end-of-block codes too. DC coefficients alone
give the luminance thumbnail, from which the stored features come.

Defined results: null texts are empty; an empty payload is 576 bytes of 255; a text of any length is stored
whole (up to 65535 rows of samples, further ones side by side); equal texts and repeated rows give equal
files and features; an empty table has no rows. Further columns are kept by `store` and ignored by
`features`; a clashing file or n_bytes column is replaced. Damaged files raise an error.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quillstream.llm.common import extended

UNIT = 576
#: Restart intervals in a column of the image: 8 rows of samples each, and a JPEG has at most 65535.
MOST_ROWS = 8191
#: Payload bytes laid out or read side by side.
GROUP_BYTES = 2 << 20

#: Huffman codes of the files that `store` writes: symbols by falling frequency with code lengths.
DC_CODES = [(s, 4) for s in range(9)]
AC_CODES = [(7, 1), (6, 2), (8, 3), (5, 4), (9, 5), (4, 6), (3, 7), (2, 8), (1, 9)]


def _canonical(codes: list[tuple[int, int]]) -> tuple[bytes, dict[int, tuple[int, int]]]:
    """The DHT body (16 counts, then symbols) and the (code, length) of each symbol."""
    ordered = sorted(codes, key=lambda x: x[1])
    out, code, length = {}, 0, 0
    for symbol, n in ordered:
        code <<= n - length
        length = n
        out[symbol] = (code, n)
        code += 1
    counts = [sum(n == k for _, n in codes) for k in range(1, 17)]
    return bytes(counts) + bytes(s for s, _ in ordered), out


def _lookup(values: np.ndarray, codes: dict[int, tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Bits and their number for each coefficient of `values` (no run before it)."""
    bits, sizes = np.zeros(len(values), np.uint64), np.zeros(len(values), np.int64)
    for i, v in enumerate(values.tolist()):
        size = abs(v).bit_length()
        code, n = codes[size]
        bits[i] = code << size | (v if v > 0 else v + (1 << size) - 1 if v else 0)
        sizes[i] = n + size
    return bits, sizes


_DC_BODY, _DC = _canonical(DC_CODES)
_AC_BODY, _AC = _canonical(AC_CODES)
_DC_BITS, _DC_SIZES = _lookup(np.arange(-255, 256), _DC)
_AC_BITS, _AC_SIZES = _lookup(np.arange(1, 257), _AC)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _header(columns: int, rows: int, length: int) -> bytes:
    """All before the scan's data; the comment holds the payload's length."""
    return b"".join(
        [
            b"\xff\xd8",
            _segment(0xE0, b"JFIF\0\x01\x01\0\0\x01\0\x01\0\0"),
            _segment(0xFE, struct.pack(">Q", length)),
            _segment(0xDB, b"\0" + b"\x01" * 64),
            _segment(0xC0, struct.pack(">BHHBBBB", 8, 8 * rows, 72 * columns, 1, 1, 0x11, 0)),
            _segment(0xC4, b"\0" + _DC_BODY),
            _segment(0xC4, b"\x10" + _AC_BODY),
            _segment(0xDD, struct.pack(">H", 9)),
            _segment(0xDA, b"\x01\x01\0\0\x3f\0"),
        ]
    )


def write_all(payloads: list[bytes]) -> list[bytes]:
    """A file for each payload; lengths are positive multiples of 576."""
    shapes = [(-(-(n := len(p) // UNIT) // MOST_ROWS), n) for p in payloads]
    shapes = [(c, -(-n // c)) for c, n in shapes]
    cells = [c * r for c, r in shapes]
    data = np.frombuffer(b"".join(p + b"\xff" * (UNIT * n - len(p)) for p, n in zip(payloads, cells, strict=True)), np.uint8).reshape(-1, 9, 64)
    n = len(data)
    bits, sizes = _AC_BITS[data], _AC_SIZES[data]
    dc = data[:, :, 0].astype(np.int64) - 128
    steps = np.diff(dc, axis=1, prepend=0) + 255
    bits[:, :, 0], sizes[:, :, 0] = _DC_BITS[steps], _DC_SIZES[steps]
    bits, sizes = bits.reshape(n, UNIT), sizes.reshape(n, UNIT)
    ends = np.cumsum(sizes, axis=1)
    total = ends[:, -1]
    words = -(-total // 32) + 1
    base = np.concatenate([[0], np.cumsum(words)])
    at = (ends - sizes + base[:-1, None] * 32).ravel()
    word, shift = at >> 5, at & 31
    piece = bits.ravel() << (64 - shift - sizes.ravel()).astype(np.uint64)
    first = np.flatnonzero(np.diff(word, prepend=-1))
    both = np.bitwise_or.reduceat(piece, first)
    out = np.zeros(base[-1] + 1, np.uint32)
    out[word[first]] |= (both >> np.uint64(32)).astype(np.uint32)
    out[word[first] + 1] |= (both & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    raw = out.astype(">u4").view(np.uint8)
    size = -(-total // 8)
    raw[base[:-1] * 4 + size - 1] |= ((1 << (size * 8 - total)) - 1).astype(np.uint8)  # filled up with ones
    begin = np.concatenate([[0], np.cumsum(size)])
    kept = raw[np.repeat(base[:-1] * 4 - begin[:-1], size) + np.arange(begin[-1])]
    # a zero after each 255, and a restart marker after each interval
    more = (kept == 255).astype(np.int64)
    more[begin[1:] - 1] += 2
    place = np.arange(len(kept)) + np.cumsum(more) - more
    full = np.zeros(len(kept) + int(more.sum()), np.uint8)
    full[place] = kept
    stop = place[begin[1:] - 1] + 1 + (kept[begin[1:] - 1] == 255)
    number = np.concatenate([np.arange(c) for c in cells])
    full[stop], full[stop + 1] = 0xFF, 0xD0 + number % 8
    files, done, i = [], 0, 0
    for payload, (c, r) in zip(payloads, shapes, strict=True):
        i += c * r
        files.append(_header(c, r, len(payload)) + full[done : stop[i - 1]].tobytes() + b"\xff\xd9")
        done = int(stop[i - 1]) + 2
    return files


class Parsed:
    """Markers of one baseline file."""

    def __init__(self, data: bytes) -> None:
        if data[:2] != b"\xff\xd8":
            raise ValueError("no JPEG")
        self.quant: dict[int, np.ndarray] = {}
        self.tables: dict[int, bytes] = {}
        self.interval, self.length, at = 0, None, 2
        while True:
            if data[at] != 0xFF:
                raise ValueError("no marker")
            marker = data[at + 1]
            if marker == 0xFF:  # fill byte
                at += 1
                continue
            (n,) = struct.unpack_from(">H", data, at + 2)
            body = data[at + 4 : at + 2 + n]
            at += 2 + n
            if marker == 0xDB:
                while body:
                    wide, k = body[0] >> 4, body[0] & 15
                    self.quant[k] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else np.uint8).astype(np.int64)
                    body = body[65 + 64 * wide :]
            elif marker == 0xC0:
                _, self.height, self.width, parts = struct.unpack_from(">BHHB", body)
                self.parts = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(parts)]
            elif marker in (0xC1, 0xC2, 0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xD0)):
                raise ValueError("not a baseline JPEG")
            elif marker == 0xC4:
                while body:
                    k = 17 + sum(body[1:17])
                    self.tables[body[0]], body = body[1:k], body[k:]
            elif marker == 0xDD:
                (self.interval,) = struct.unpack(">H", body[:2])
            elif marker == 0xFE and len(body) == 8:
                (self.length,) = struct.unpack(">Q", body)
            elif marker == 0xDA:
                use = {body[1 + 2 * i]: body[2 + 2 * i] for i in range(body[0])}
                break
        if len(use) != len(self.parts):
            raise ValueError("one scan with all components is read")
        one = len(self.parts) == 1
        parts = [(c, 1 if one else h, 1 if one else v, q) for c, h, v, q in self.parts]
        high, wide = max(v for _, _, v, _ in parts), max(h for _, h, _, _ in parts)
        self.across, self.down = -(-self.width // (8 * wide)), -(-self.height // (8 * high))
        #: for each block of a unit: its component, DC table and AC table
        self.unit = tuple((i, use[c] >> 4, 16 | use[c] & 15) for i, (c, h, v, _) in enumerate(parts) for _ in range(h * v))
        self.lead = parts[0]
        self.units = self.across * self.down
        self.scan = data[at : data.rindex(b"\xff\xd9")]


def _decode_table(body: bytes) -> np.ndarray:
    """length << 8 | symbol by the next 16 bits; 0 where no code fits."""
    out = np.zeros(1 << 16, np.int64)
    code, k = 0, 16
    for n in range(1, 17):
        for _ in range(body[n - 1]):
            out[code << (16 - n) : (code + 1) << (16 - n)] = n << 8 | body[k]
            code, k = code + 1, k + 1
        code <<= 1
    return out


def _lanes(parsed: list[Parsed]) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Unstuffed bytes of all scans, where each restart interval begins in them, and the intervals of each image."""
    raw, begin, counts, done = [], [], [], 0
    for p in parsed:
        scan = np.frombuffer(p.scan, np.uint8)
        after = np.flatnonzero(scan[:-1] == 255) if len(scan) else np.zeros(0, np.int64)
        following = scan[after + 1]
        marks = after[(following >= 0xD0) & (following <= 0xD7)]
        keep = np.ones(len(scan), bool)
        keep[after[following == 0] + 1] = False
        keep[marks] = keep[marks + 1] = False
        starts = np.concatenate([[0], marks + 2])
        place = np.concatenate([[0], np.cumsum(keep)])
        begin.append(place[starts] + done)
        raw.append(scan[keep])
        counts.append(len(starts))
        done += len(raw[-1])
    return np.concatenate([*raw, np.zeros(16, np.uint8)]), np.concatenate(begin), counts


def coefficients(parsed: list[Parsed]) -> list[np.ndarray]:
    """Quantised coefficients in zigzag order, [blocks in scan order, 64], of files with the same tables and units."""
    lead = parsed[0]
    data, begin, counts = _lanes(parsed)
    wide = np.zeros(len(data), np.uint64)
    for i in range(8):
        wide[: len(data) - i] |= data[i:].astype(np.uint64) << np.uint64(56 - 8 * i)
    per = len(lead.unit)
    blocks = np.concatenate([np.minimum(p.interval, p.units - p.interval * np.arange(n)) * per if p.interval else np.array([p.units * per]) for p, n in zip(parsed, counts, strict=True)])
    used = sorted({t for _, d, a in lead.unit for t in (d, a)})
    table = np.concatenate([_decode_table(lead.tables[t]) for t in used])
    dc_base = np.array([used.index(d) << 16 for _, d, _ in lead.unit])
    ac_base = np.array([used.index(a) << 16 for _, _, a in lead.unit])
    part = np.array([c for c, _, _ in lead.unit])
    first = np.concatenate([[0], np.cumsum(blocks)])
    out = np.zeros((first[-1], 64), np.int32)
    flat = out.reshape(-1)
    lane = np.arange(len(begin))
    at, k, block = begin * 8, np.zeros(len(begin), np.int64), np.zeros(len(begin), np.int64)
    seen = np.zeros((len(begin), len(parsed[0].parts)), np.int64)
    while len(lane):
        window = wide[at >> 3] << (at & 7).astype(np.uint64)
        place = block % per if per > 1 else np.zeros(len(lane), np.int64)
        is_dc = k == 0
        hit = table[(window >> np.uint64(48)).astype(np.int64) + np.where(is_dc, dc_base[place], ac_base[place])]
        if not hit.all():
            raise ValueError("broken JPEG data")
        length, symbol = hit >> 8, hit & 255
        size, run = symbol & 15, symbol >> 4
        value = ((window << length.astype(np.uint64)) >> np.uint64(1) >> (63 - size).astype(np.uint64)).astype(np.int64)
        value -= np.where((size > 0) & (value < (1 << size >> 1)), (1 << size) - 1, 0)
        at += length + size
        if is_dc.any():
            mine = part[place[is_dc]]
            seen[lane[is_dc], mine] += value[is_dc]
            value[is_dc] = seen[lane[is_dc], mine]
        put = k + np.where(is_dc, 0, run)
        there = is_dc | (size > 0)
        spot = (first[lane] + block) * 64 + put
        flat[spot[there]] = value[there]
        k = np.where(there, put + 1, np.where(run == 15, k + 16, 64))
        over = k >= 64
        if over.any():
            block = block + over
            k[over] = 0
            live = block < blocks[lane]
            if not live.all():
                lane, at, k, block = lane[live], at[live], k[live], block[live]
    edges = np.cumsum([p.units * per for p in parsed])
    return np.split(out, edges[:-1])


def thumbnail(p: Parsed, blocks: np.ndarray) -> np.ndarray:
    """Luminance from DC alone, a sample for each block."""
    _, h, v, q = p.lead
    per = len(p.unit)
    dc = blocks.reshape(p.units, per, 64)[:, : h * v, 0] * int(p.quant[q][0])
    grid = dc.reshape(p.down, p.across, v, h).transpose(0, 2, 1, 3).reshape(p.down * v, p.across * h)
    return np.clip(grid / 8 + 128, 0, 255)


def thumb_hash(thumb: np.ndarray) -> str:
    """64 bits: whether the mean of each of 8 x 8 areas, which cover the thumbnail whole, is above their own mean."""
    rows, cols = (np.arange(8) * n // 8 for n in thumb.shape)
    # where a side has less than 8 samples, some areas are a sample that others have too
    sizes = [np.maximum(np.diff([*at, n]), 1) for at, n in zip((rows, cols), thumb.shape, strict=True)]
    cells = np.add.reduceat(np.add.reduceat(thumb, rows, 0), cols, 1) / np.outer(*sizes)
    return np.packbits(cells > cells.mean()).tobytes().hex()


def read_all(files: list[bytes]) -> list[tuple[Parsed, np.ndarray]]:
    """Markers and coefficients of each file; files with equal tables are decoded together."""
    parsed = [Parsed(f) for f in files]
    groups: dict[tuple, list[int]] = {}
    for i, p in enumerate(parsed):
        groups.setdefault((p.unit, tuple(sorted(p.tables.items())), len(p.parts)), []).append(i)
    out: list = [None] * len(files)
    for members in groups.values():
        for i, blocks in zip(members, coefficients([parsed[i] for i in members]), strict=True):
            out[i] = (parsed[i], blocks)
    return out


def payload_of(p: Parsed, blocks: np.ndarray) -> bytes:
    """The payload of a file that `store` wrote."""
    values = blocks - 1
    values[:, 0] += 1 + 128
    return values.astype(np.uint8).tobytes()[: p.length]


def padded(text: bytes) -> bytes:
    return text + b"\xff" * (max(1, -(-len(text) // UNIT)) * UNIT - len(text))


def _groups(sizes: list[int]) -> Iterator[slice]:
    start = total = 0
    for i, n in enumerate(sizes):
        total += n
        if total >= GROUP_BYTES or i == len(sizes) - 1:
            yield slice(start, i + 1)
            start, total = i + 1, 0


def store(docs: DataFrame, text: str = "text", to: str = "media") -> DataFrame:
    """docs with the file of each text in `to`, in place of the text; its bytes without padding are counted in n_bytes."""
    keep = [c for c in docs.columns if c not in (text, to, "n_bytes")]
    schema = extended(docs.select(*keep), f"n_bytes long, {to} binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [x or b"" for x in batch.column(batch.schema.get_field_index(text)).cast(pa.large_binary()).to_pylist()]
            for s in _groups([len(x) + UNIT for x in raw]):
                part = batch.slice(s.start, s.stop - s.start)
                files = write_all([padded(x) for x in raw[s]])
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(part.schema.get_field_index(c)) for c in keep), pa.array([len(x) for x in raw[s]], pa.int64()), pa.array(files, pa.binary())],
                    names=[*keep, "n_bytes", to],
                )

    return docs.select(*keep, text).mapInArrow(run, schema)


def features(stored: DataFrame) -> DataFrame:
    """doc_id, n_bytes, and what the stored files say when they are read back."""
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files = batch.column("media").to_pylist()
            ids, lengths = batch.column("doc_id").to_pylist(), batch.column("n_bytes").to_pylist()
            for s in _groups([len(x) for x in files]):
                rows = []
                for doc, n, file, (p, blocks) in zip(ids[s], lengths[s], files[s], read_all(files[s]), strict=True):
                    thumb = thumbnail(p, blocks)
                    data = payload_of(p, blocks)
                    rows.append((doc, n, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-32:]), len(file), hashlib.sha256(file).hexdigest(), f"{p.width}x{p.height}:{thumb_hash(thumb)}"))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if isinstance(c[0], str) else pa.int64()) for c in map(list, zip(*rows, strict=True))], names=names)

    return stored.select("doc_id", "n_bytes", "media").mapInArrow(run, schema)
