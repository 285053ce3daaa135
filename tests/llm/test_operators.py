"""The numbered operators against brute force, on small tables with nulls, empty and repeated rows."""

import hashlib
import random
import re
import time
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstream.llm import bpe, chat, entries, media, neardup, neighbours, packing, pii, suffixes, toxicity, urlfilter

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)


def words(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n)]


@pytest.fixture(scope="module")
def odd(spark):
    """Null, empty, blank, short, repeated and long texts; a null id and a repeated one."""
    long = " ".join(words(5000, 1))
    base = words(120, 2)
    near = base.copy()
    near[60] = "changed"
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "One  TWO"), (6, long), (7, " ".join(base)), (8, " ".join(near)), (8, " ".join(near)), (None, "null id text of five words"), (9, "x" * 5000), (10, "null ID text of five words"), (11, " ".join(words(40, 3) + base[:60] + words(40, 4)))]
    return frame(spark, rows)


def brute_classes(rows, k, percent):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    comp = list(range(len(rows)))

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    index = {}
    for i, s in enumerate(sets):
        for x in s:
            index.setdefault(x, []).append(i)
    for i, s in enumerate(sets):
        counts = {}
        for x in s:
            for j in index[x]:
                if j < i:
                    counts[j] = counts.get(j, 0) + 1
        for j, both in counts.items():
            if 100 * both >= percent * (len(s) + len(sets[j]) - both):
                comp[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return [(d, len(s), least.get(root(i)), least.get(root(i)) == d) for i, ((d, _), s) in enumerate(zip(rows, sets))]


def key(row):
    return tuple((x is None, x) for x in row)


@pytest.mark.parametrize("k", [4, 5])
def test_neardup_against_brute_force(spark, odd, sf_dir, k):
    for docs in (odd, spark.read.parquet(f"{sf_dir}/documents.parquet")):
        rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
        got = [tuple(r) for r in neardup.classes(docs, k, 80).collect()]
        assert sorted(got, key=key) == sorted(brute_classes(rows, k, 80), key=key)


def test_neardup_blocks_and_large_buckets(spark, monkeypatch):
    rng = random.Random(5)
    rows = []
    for g in range(6):
        base = words(150, g)
        for c in range(25):
            w = base.copy()
            for _ in range(rng.randint(0, 6)):
                w[rng.randrange(150)] = f"w{rng.random()}"
            rows.append((g * 100 + c, " ".join(w)))
    docs = frame(spark, rows)
    want = sorted(brute_classes(rows, 5, 80))
    assert sorted(tuple(r) for r in neardup.classes(docs).collect()) == want
    monkeypatch.setattr(neardup, "BLOCK_MEMBERS", 7)
    monkeypatch.setattr(neardup, "BUCKET_MEMBERS", 5)
    assert sorted(tuple(r) for r in neardup.classes(docs).collect()) == want
    kept = {r["doc_id"] for r in neardup.deduplicate(docs).collect()}
    assert kept == {d for d, _, _, keep in want if keep}


def test_neardup_removes_rows_not_ids(spark):
    base, other, third = (" ".join(words(100, x)) for x in (60, 61, 62))
    rows = [(3, base), (8, base + " more"), (8, other), (None, base + " again"), (None, third), (None, third), (9, None), (10, "")]
    assert sorted(((r["doc_id"], r["text"]) for r in neardup.deduplicate(frame(spark, rows)).collect()), key=key) == sorted([(3, base), (8, other), (None, third), (None, third), (9, None), (10, "")], key=key)


def test_neardup_buckets_over_many_frames(spark, monkeypatch):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    monkeypatch.setattr(neardup, "BUCKET_MEMBERS", 8)
    sizes = [1, 2, 1, 9, 3, 8, 20, 1, 7, 1]
    rows = [(b, 100 * b + i) for b, n in enumerate(sizes) for i in range(n)]
    got = [(r["bucket"], r["id"], r["large"]) for r in neardup._shared(spark.createDataFrame(rows, "bucket long, id long")).collect()]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert sorted(got) == [(b, i, sizes[b] > 8) for b, i in rows if sizes[b] > 1]


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(0)
    a = np.unique(rng.integers(0, 1 << 63, 1000, dtype=np.uint64))
    b = np.concatenate([a[:800], np.unique(rng.integers(0, 1 << 63, 200, dtype=np.uint64))])
    s = neardup.sketches(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
    est = neardup.jaccard_estimate(s[:1], s[1:], np.array([len(a)]), np.array([len(b)]))[0]
    assert abs(est - 800 / 1200) < 0.12
    both = np.union1d(a, b)
    merged = neardup.sketches(both, np.array([0, len(both)]))[0]
    assert (np.maximum(s[0], s[1]) == merged).all()


def brute_covered(rows, least):
    """Words of each (id, text) that lie in a passage of `least` words that another id has too, and in a smaller id."""
    texts = sorted({(d, t) for d, t in rows if t}, key=key)
    split = [[w for w in re.split(r"[\x20\x09-\x0D]+", t) if w] for _, t in texts]
    where = {}
    for i, w in enumerate(split):
        for p in range(len(w) - least + 1):
            where.setdefault(tuple(w[p : p + least]), set()).add(texts[i][0])
    out = {}
    for i, w in enumerate(split):
        for p in range(len(w) - least + 1):
            ids = where[tuple(w[p : p + least])] - {texts[i][0]}
            if ids:
                out.setdefault(texts[i], set()).update(range(p, p + least))
    return out


def test_suffixes_against_brute_force(spark, odd, sf_dir):
    for docs in (odd, spark.read.parquet(f"{sf_dir}/documents.parquet")):
        rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
        want = {d: set() for d, _ in rows}
        for (d, _), covered in brute_covered(rows, 50).items():
            want[d] |= covered
        got = {d: set() for d, _ in rows}
        for r in suffixes.repeats(docs).collect():
            got[r["doc_id"]].update(range(r["start_word"], r["end_word"]))
        assert got == want


def test_suffixes_cut_all_but_the_first(spark):
    rng = random.Random(3)
    passage = words(70, 77)
    rows = [(i, " ".join(words(rng.randint(5, 90), 100 + i) + passage + words(rng.randint(5, 90), 200 + i))) for i in range(40)]
    rows.append((99, " ".join(words(80, 999))))
    docs = frame(spark, rows)
    left = {r["doc_id"]: r for r in suffixes.without_repeats(docs).collect()}
    assert len(left) == len(rows) and left[99]["text"] == rows[-1][1] and left[0]["text"] == rows[0][1]
    whole = " ".join(passage)
    assert [d for d, r in left.items() if whole in r["text"]] == [0]
    assert all(r["n_chars"] == len(r["text"]) for r in left.values())


def test_suffixes_find_each_planted_passage(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "RUN_ROWS", 40)
    rng = random.Random(9)
    common = words(30, 55)  # a line of many documents that stands beside what two of them share
    rows = []
    for i in range(60):
        shared = words(30, 1000 + i // 2)
        rows.append((i, " ".join(words(rng.randint(10, 60), i) + shared + common + words(rng.randint(10, 60), 300 + i))))
    found = {r["doc_id"] for r in suffixes.repeats(frame(spark, rows)).filter("n_words >= 60").collect()}
    assert found == set(range(60))


def brute_spans(rows, least):
    """(id, again, word) of all words in windows of `least` words that another id has too; `again`: that a smaller id has."""
    where, out = {}, set()
    split = [(d, (t or "").split()) for d, t in rows]
    for d, w in split:
        for p in range(len(w) - least + 1):
            where.setdefault(tuple(w[p : p + least]), set()).add(d)
    for d, w in split:
        for p in range(len(w) - least + 1):
            ids = where[tuple(w[p : p + least])]
            if len(ids) > 1:
                out.update((d, d > min(ids), q) for q in range(p, p + least))
    return out


def found_spans(docs):
    return {(r["doc_id"], not r["first"], q) for r in suffixes.repeats(docs).collect() for q in range(r["start_word"], r["end_word"])}


@pytest.fixture
def small_blocks(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "RUN_ROWS", 3)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    yield
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_suffixes_first_of_all_blocks(spark, small_blocks):
    rng = random.Random(4)
    passage = words(70, 78)
    rows = [(i, " ".join(words(rng.randint(5, 90), 100 + i) + passage + words(rng.randint(5, 90), 200 + i))) for i in range(60)]
    docs = frame(spark, rows)
    assert found_spans(docs) == brute_spans(rows, 50)
    whole = " ".join(passage)
    assert [r["doc_id"] for r in suffixes.without_repeats(docs).collect() if whole in r["text"]] == [0]


def test_suffixes_one_word_again_and_again(spark):
    rows = [(i, " ".join(words(20, 500 + i) + ["|"] * n + words(20, 600 + i))) for i, n in ((1, 300), (2, 300), (3, 120))]
    rows += [(i, " ".join(words(60, 700 + i) + ["a", "b"] * n)) for i, n in ((4, 150), (5, 90))]
    assert found_spans(frame(spark, rows)) == brute_spans(rows, 50)


def test_suffixes_what_two_share_before_a_common_line(spark, small_blocks):
    rng = random.Random(10)
    common = words(45, 56)
    rows = [(i, " ".join(words(rng.randint(10, 60), i) + words(10, 2000 + i % 30) + common + words(rng.randint(10, 60), 400 + i))) for i in range(60)]
    assert found_spans(frame(spark, rows)) == brute_spans(rows, 50)


def test_bpe_is_the_library(spark, odd):
    from tokenizers import Tokenizer

    codec = Tokenizer.from_file(bpe.vocabulary())
    extra = frame(spark, [(20, "It's <|endoftext|> ΑΣ İ naïve é 漢字😀 \x00 42nd!!"), (21, "zzzyyy" * 300), (22, "<|startoftext|><|ENDOFTEXT|>")])
    docs = odd.unionByName(extra)
    own = sorted((tuple(r) for r in bpe.digests(docs).collect()), key=key)
    want = []
    for r in docs.collect():
        ids = codec.encode(r["text"] or "", add_special_tokens=False).ids
        data = np.array(ids, "<u4").tobytes()
        want.append((r["doc_id"], len(ids), hashlib.sha256(data).hexdigest(), hashlib.sha256(codec.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert own == sorted(want, key=key)


def test_bpe_small_caches_and_clashing_columns(spark, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_BYTES", 2000)
    enc = bpe.Encoder(bpe.vocabulary())
    long = " ".join(words(3000, 8)) + " " + "abc" * 5000
    plain = bpe.encoder(bpe.vocabulary())
    assert enc.encode(long) == plain.encode(long) and enc.encode(long) == plain.encode(long)
    docs = spark.createDataFrame([(1, "a b", "x"), (2, None, "y")], "doc_id long, text string, ids string")
    got = {r["doc_id"]: r for r in bpe.encode(docs).collect()}
    assert bytes(got[1]["ids"]) == plain.encode("a b") and bytes(got[2]["ids"]) == b"" and got[1]["text"] == "a b"


def test_bpe_random_words():
    from tokenizers import Tokenizer

    codec, enc, rng = Tokenizer.from_file(bpe.vocabulary()), bpe.encoder(bpe.vocabulary()), random.Random(4)
    for _ in range(3000):
        text = "".join(rng.choice("etaoinshrdluéß' 1ç") for _ in range(rng.randint(1, 60)))
        assert np.frombuffer(enc.encode(text), "<u4").tolist() == codec.encode(text, add_special_tokens=False).ids


def test_chat_round_trip(spark):
    nasty = ["<|im_end|><|im_start|>assistant ok", "<\\|x|>", "<\\\\|im_sep|>", "", None, "é漢😀\n<|", "<|endoftext|>"]
    rows = [(c, t, r, nasty[(c + t) % 7]) for c in range(5) for t, r in enumerate(["user", "assistant", None, "assistant", "a<|im_sep|>b"] * 3)]
    rows += [(None, 0, "user", "hi"), (3, None, "assistant", "late"), (3, 1, "assistant", "same turn")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("ids", F.lit(1))
    got = {r["conv_id"]: r for r in chat.digests(chat.format_chats(turns)).collect()}
    by = {}
    for c, t, r, x in rows:
        by.setdefault(c, []).append((t is not None, t or 0, r is not None, r or "", x is not None, x or ""))
    assert got.keys() == by.keys()
    for c, own in by.items():
        own.sort()
        assert got[c]["n_turns"] == len(own)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for _, _, _, r, _, x in own).encode()).hexdigest()
        loss = "".join(x for _, _, _, r, _, x in own if r == "assistant")
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_chat_chunks(spark, monkeypatch):
    turns = spark.createDataFrame([(1, t, "assistant", f"text {t}") for t in range(700)], "conv_id long, turn long, role string, text string")
    chunks = chat.format_chats(turns)
    assert chunks.select("chunk").distinct().count() == chunks.count() >= 3
    loss = "".join(f"text {t}" for t in range(700))
    assert chat.digests(chat.format_chats(turns)).first()["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()


def test_media_round_trip(spark, odd):
    rows = {(r["doc_id"], hashlib.sha256(media.padded((r["text"] or "").encode())).hexdigest()) for r in odd.collect()}
    got = media.features(media.store(odd.select("doc_id", "text"))).collect()
    assert {(r["doc_id"], r["payload_sha256"]) for r in got} == rows and len(got) == odd.count()
    for r in got:
        assert r["payload_bytes"] % 576 == 0 and r["payload_bytes"] >= max(576, r["n_bytes"])


def test_media_reads_runs_and_end_of_block():
    """A hand-made grey image of two blocks: a DC step, a run of zeros, and end-of-block codes."""
    dc, _ = media._canonical([(0, 2), (3, 2), (4, 2)])
    ac, codes = media._canonical([(0x00, 2), (0x21, 2), (0xF0, 2)])
    head = media._header(1, 1, 0)
    head = head.replace(media._segment(0xC4, b"\0" + media._DC_BODY), media._segment(0xC4, b"\0" + dc)).replace(media._segment(0xC4, b"\x10" + media._AC_BODY), media._segment(0xC4, b"\x10" + ac))
    head = head.replace(media.struct.pack(">BHHBBBB", 8, 8, 72, 1, 1, 0x11, 0), media.struct.pack(">BHHBBBB", 8, 8, 16, 1, 1, 0x11, 0))
    # block 1: DC +5, two zeros then -1, end; block 2: DC -7 (so -2), sixteen zeros, two zeros then 1, end
    bits = "01" + "101" + "01" + "0" + "00" + "01" + "000" + "10" + "01" + "1" + "00"
    bits += "1" * (-len(bits) % 8)
    data = bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\0")
    (p, blocks), = media.read_all([head + data + b"\xff\xd9"])
    want = np.zeros((2, 64), int)
    want[0, [0, 3]] = 5, -1
    want[1, [0, 19]] = -2, 1
    assert (blocks == want).all() and media.thumbnail(p, blocks).tolist() == [[128.625, 127.75]]


def written_by_hand(blocks, parts, width, height, interval):
    """A baseline file written bit by bit: `blocks`, lists of 64 coefficients in scan order, with their component's number."""
    dc_symbols = [(x, 4) for x in range(12)]
    ac_symbols = [(x, 7) for x in [0x00, 0xF0, *(r << 4 | n for r in range(16) for n in range(1, 8))]]

    def codes_of(symbols):
        return {s: format(i, f"0{n}b") for i, (s, n) in enumerate(symbols)}  # all of one length: counted up

    dc, ac = codes_of(dc_symbols), codes_of(ac_symbols)

    def value(v):
        n = abs(v).bit_length()
        return n, format(v if v > 0 else v + (1 << n) - 1, f"0{n}b") if n else ""

    def flushed(bits):
        bits += "1" * (-len(bits) % 8)
        return bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\0")

    per = sum(h * v if len(parts) > 1 else 1 for _, h, v, _ in parts)
    scan, bits, before = b"", "", {}
    for i, (part, block) in enumerate(blocks):
        if interval and i and i % (per * interval) == 0:
            scan += flushed(bits) + bytes([0xFF, 0xD0 + (i // (per * interval) - 1) % 8])
            bits, before = "", {}
        n, more = value(block[0] - before.get(part, 0))
        before[part] = block[0]
        bits += dc[n] + more
        run = 0
        last = max([k for k in range(1, 64) if block[k]], default=0)
        for k in range(1, last + 1):
            if block[k] == 0:
                run += 1
                continue
            while run > 15:
                bits += ac[0xF0]
                run -= 16
            n, more = value(block[k])
            bits += ac[run << 4 | n] + more
            run = 0
        bits += ac[0] if last < 63 else ""
    scan += flushed(bits)

    def segment(marker, body):
        return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body

    def table(number, symbols):
        return bytes([number]) + bytes(sum(n == k for _, n in symbols) for k in range(1, 17)) + bytes(s for s, _ in symbols)

    frame_body = bytes([8]) + height.to_bytes(2, "big") + width.to_bytes(2, "big") + bytes([len(parts)]) + b"".join(bytes([c, h << 4 | v, q]) for c, h, v, q in parts)
    scan_body = bytes([len(parts)]) + b"".join(bytes([c, 0x00]) for c, _, _, _ in parts) + b"\0\x3f\0"
    quant = segment(0xDB, b"\0" + bytes([3] * 64) + b"\1" + bytes([5] * 64))
    restart = segment(0xDD, interval.to_bytes(2, "big")) if interval else b""
    return b"\xff\xd8" + quant + segment(0xC0, frame_body) + segment(0xC4, table(0, dc_symbols) + table(0x10, ac_symbols)) + restart + segment(0xDA, scan_body) + scan + b"\xff\xd9"


@pytest.mark.parametrize("interval", [0, 1, 3])
@pytest.mark.parametrize("parts", [[(1, 1, 1, 0)], [(1, 2, 1, 0), (2, 1, 1, 1)], [(1, 2, 2, 0), (2, 1, 1, 1), (3, 1, 1, 1)]])
def test_media_reads_files_of_several_components(parts, interval):
    rng = np.random.default_rng(8)
    high, wide = max(v for _, _, v, _ in parts), max(h for _, h, _, _ in parts)
    width, height = 8 * wide * 3 - 3, 8 * high * 2 - 5
    unit = [i for i, (_, h, v, _) in enumerate(parts) for _ in range(h * v)]
    blocks = []
    for part in unit * 6:
        block = np.where(rng.random(64) < 0.15, rng.integers(-127, 128, 64), 0)
        block[0] = rng.integers(-300, 300)
        blocks.append((part, block.tolist()))
    file = written_by_hand(blocks, parts, width, height, interval)
    (p, got), (_, again) = media.read_all([file, file])
    assert (got == np.array([x for _, x in blocks])).all() and (again == got).all()
    # each luminance block at its place
    h, v = parts[0][1], parts[0][2]
    want = np.zeros((2 * v, 3 * h))
    for i in range(6):
        for j in range(h * v):
            want[i // 3 * v + j // h, i % 3 * h + j % h] = np.clip(blocks[i * len(unit) + j][1][0] * 3 / 8 + 128, 0, 255)
    assert media.thumbnail(p, got).tolist() == want.tolist()


@pytest.mark.parametrize("shape", [(1, 9), (3, 9), (8, 8), (21, 9), (1000, 27)])
def test_media_hash_takes_whole_areas(shape):
    thumb = np.random.default_rng(3).random(shape) * 255
    cut = lambda n: [(i * n // 8, max((i + 1) * n // 8, i * n // 8 + 1)) for i in range(8)]
    means = np.array([[thumb[a:b, c:d].mean() for c, d in cut(shape[1])] for a, b in cut(shape[0])])
    bits = "".join("1" if x > means.mean() else "0" for x in means.ravel())
    assert media.thumb_hash(thumb) == format(int(bits, 2), "016x")


def test_media_long_texts_and_clashing_columns(spark):
    long = "a long text " * 500_000  # more rows of samples than one column of the image has
    docs = spark.createDataFrame([(1, long), (2, "short"), (3, None)], "doc_id long, text string").withColumns({"media": F.lit("x"), "n_bytes": F.lit("y")})
    stored = media.store(docs)
    assert sorted(stored.columns) == ["doc_id", "media", "n_bytes"]
    got = {r["doc_id"]: r for r in media.features(stored).collect()}
    for i, t in ((1, long), (2, "short"), (3, "")):
        payload = media.padded(t.encode())
        assert (got[i]["n_bytes"], got[i]["payload_bytes"], got[i]["payload_sha256"], got[i]["tail_crc32"]) == (len(t), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))


def test_toxicity_folds_and_learns(spark, sf_dir):
    assert toxicity.fold("L0SER idıοt") == toxicity.fold("loser idiot")
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    scored = toxicity.detect(docs, labels).join(labels, "doc_id").filter(toxicity.held_out(F.col("doc_id"))).select("predicted", "toxic").collect()
    right = sum(r["predicted"] == r["toxic"] for r in scored) / len(scored)
    assert right > 0.97
    lexicon = toxicity.learn(toxicity.labelled(docs, labels))
    assert lexicon.score(np.array([lexicon.rate("you utter 1DIOT and worthle55 m0ron")]))[0] > 0.5


def test_toxicity_exceptions(spark):
    rows = [(f"you are a stupid person number w{i}", 1) for i in range(30)] + [(f"a fine day w{i}", 0) for i in range(200)] + [(f"the stupid mistake w{i}", 0) for i in range(8)]
    lexicon = toxicity.learn(spark.createDataFrame(rows, "text string, label int"))
    assert any("stupid" in x for x in (e.strip() for e in lexicon.weights)) or lexicon.weights
    assert lexicon.rate("what a stupid person") > lexicon.rate("the stupid mistake") == 0


def brute_rate(text, lexicon):
    """The rate by plain search: at each word the longest entry that it is or begins with, unless its neighbours excuse it."""
    words_of = toxicity.fold(text).split()
    total = 0.0
    for i, w in enumerate(words_of):
        fits = [e for e in lexicon.weights if (e == f" {w} " or (not e.endswith(" ") and f" {w}".startswith(e)))]
        around = [f"{x} {w}" for x in words_of[max(0, i - 1) : i]] + [f"{w} {x}" for x in words_of[i + 1 : i + 2]]
        if fits and not any(c in lexicon.exceptions for c in around):
            total += lexicon.weights[max(fits, key=len)]
    return total / np.sqrt(max(toxicity.LEAST_WORDS, f" {toxicity.fold(text)} ".count(" "))) if total else 0.0


def test_toxicity_against_a_brute_force_scorer(spark, odd):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    lexicon = toxicity.learn(toxicity.labelled(docs, labels))
    assert lexicon.weights
    texts = [r["text"] for r in docs.filter("doc_id < 150").unionByName(odd).collect()]
    texts += ["1DIOT", "idiot " + "x" * 300 + " idiot", ", ".join(e.strip() for e in list(lexicon.weights)[:40])]
    for t in texts:
        assert lexicon.rate(t or "") == pytest.approx(brute_rate(t or "", lexicon), rel=1e-9)


def test_toxicity_counts_all_words_of_any_length(spark):
    long = "w" * 90
    rows = [(i, f"{long} day number", 1) for i in range(30)] + [(i, "a fine day number", 0) for i in range(30, 200)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string").withColumns({"score": F.lit("x"), "predicted": F.lit("y")})
    labels = spark.createDataFrame([(i, x) for i, _, x in rows], "doc_id long, toxic int")
    lexicon = toxicity.learn(toxicity.labelled(docs, labels))
    assert f" {long} " in lexicon.weights
    got = {r["doc_id"]: r for r in toxicity.detect(docs, labels).collect()}
    assert len(got) == 200 and all((r["predicted"] == 1) == (i < 30) for i, r in got.items()) and isinstance(got[0]["score"], float)
    assert 60 < toxicity.labelled(docs, labels, most=100).count() < 140


def test_toxicity_without_labels(spark, odd):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert all(r["score"] < 1e-9 and r["predicted"] == 0 for r in toxicity.detect(odd, none).collect())


def test_urls_against_brute_force(spark, sf_dir):
    urls = ["http://Example.COM/en/7?x", "https://a.example.net/de/8#f", "ftp://net/de/", "nothing", None, "http://", "http://x.org/es/login", "http://org.evil/es/", "http://a.com?x=/en/", "http://shop.fr/cart", "http://shop.fr/cartoon", "http://com/en/7"]
    rows = [(i, u) for i, u in enumerate(urls)] + [(r["page_id"], r["url"]) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    got = {(r["page_id"], r["url"], r["host"], r["path"], r["rule"], r["verdict"]) for r in urlfilter.judge(spark.createDataFrame(rows, "page_id long, url string").withColumn("rule", F.lit(1))).collect()}
    want = set()
    for i, u in rows:
        rest = (u or "").partition("://")[2]
        raw = re.match(r"[^/?#]*", rest).group()
        path = re.match(r"[^?#]*", rest[len(raw) :]).group()
        host = raw.lower()
        fits = [(len(h + p), h + p, a) for a, h, p in urlfilter.SITE_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule = max(fits)[1:] if fits else (None, "block" if re.search(rf"/({'|'.join(urlfilter.SEGMENTS)})(/|$)", path) else "allow")
        want.add((i, u, host, path, *rule))
    assert got == want
    empty = urlfilter.judge(spark.createDataFrame([], "page_id long, url string"), [])
    assert empty.count() == 0


def test_url_rules_of_the_contract(spark):
    """Each rule's own word, as the contract lists them: not read from the code."""
    urls = ["http://a.com/en/1", "http://example.com/en/70", "http://a.net/de/login", "http://a.example.net/de/81", "http://x.org/es/"]
    got = urlfilter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).orderBy("page_id").collect()
    assert [(r["rule"], r["verdict"]) for r in got] == [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block")]


def test_pii_base_and_redaction(spark, odd):
    text = "Mail a.b@c.de or +1 (444) 555-4984, 10.0.0.255 and 300.1.1.1, card 4111 1111 1111 1111."
    spans = [(text[a:b], k) for a, k, b in pii.base_spans(text)]
    assert spans == [("a.b@c.de", 0), ("+1 (444) 555-4984", 3), ("10.0.0.255", 1), ("4111 1111 1111 1111", 2)]
    docs = odd.unionByName(frame(spark, [(50 + i, f"{text} {i}") for i in range(40)]))
    tagger = pii.train(docs)
    rows = {r["doc_id"]: r for r in pii.find(docs, tagger).collect()}
    assert (rows[50]["n_email"], rows[50]["n_ip"], rows[50]["n_card"], rows[50]["n_phone"]) == (1, 1, 1, 1) and rows[1]["spans"] == ""
    clean = {r["doc_id"]: r for r in pii.redact(docs, tagger).collect()}
    assert "[EMAIL] or [PHONE], [IP]" in clean[50]["text"] and clean[50]["n_chars"] == len(clean[50]["text"]) and clean[1]["text"] is None
    assert pii.train(odd) is None and pii.find(odd, None).count() == odd.count()


@pytest.fixture(scope="module")
def tagger(spark):
    return pii.train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def test_pii_network_finds_what_no_pattern_does(spark, tagger):
    """Spans of the larger table, rewritten so that the patterns miss them, are found by a network that never saw them."""
    rng = np.random.default_rng(99)
    texts, wanted = [], []
    for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").filter("n_chars < 4000").select("text").collect():
        spans = pii.base_spans(r["text"])
        if len(spans) == 1:
            (a, kind, b), t = spans[0], r["text"]
            piece = pii.rewritten(t[a:b], kind, rng)
            text = t[:a] + piece + t[b:]
            if not pii.base_spans(text):
                texts.append(text)
                wanted.append((a, kind, a + len(piece)))
    found = pii.added_spans(texts, [[] for _ in texts], tagger)
    hits = [any(k == kind and x < b and a < y for x, k, y in own) for (a, kind, b), own in zip(wanted, found, strict=True)]
    added = [any(x < b and a < y for a, _, b in [w]) for w, own in zip(wanted, found, strict=True) for x, _, y in own]
    assert len(texts) > 100 and np.mean(hits) > 0.85 and np.mean(added) > 0.95
    for kind in range(4):
        assert np.mean([h for h, w in zip(hits, wanted, strict=True) if w[1] == kind]) > 0.7


def test_pii_skipped_windows_hold_nothing(spark, tagger, monkeypatch):
    rows = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    rows += ["", "write to jo.an (at) mail (dot) example (dot) com today", "x " * 400 + "call (444) 555-4984 or 444.555.4984 now " + "y " * 400]
    base = [pii.base_spans(t) for t in rows]
    own = pii.added_spans(rows, base, tagger)
    monkeypatch.setattr(pii, "windows", lambda t: list(range(0, max(1, len(t) - pii.WINDOW + pii.STRIDE), pii.STRIDE)))
    assert pii.added_spans(rows, base, tagger) == own
    assert any(k == 0 for _, k, _ in own[-2]) and any(k == 3 for _, k, _ in own[-1])


def test_pii_parts_that_patterns_leave():
    text = "at +1 (826) 555-4081 190.137.2.10 du"
    assert pii.base_spans(text) == [(21, 1, 33)]  # the telephone runs into the address and is too long
    assert pii._outside(text, 3, 33, pii.Apart(pii.base_spans(text))) == [(3, 20)]
    assert pii.verified("9[.]8[.]7[.]6", 1) and not pii.verified("9.8.7.600", 1) and not pii.verified("4111 1111 1111 1112", 2)


def brute_base(text):
    """The patterns as they are written, by plain search."""
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m.group().split("."))]
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 14 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
    return sorted(out + [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(digits(m)) <= 15])


def test_pii_base_spans_are_the_patterns(spark):
    rng = random.Random(1)
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    kinds = ["a1.@- ", "12.", "@a.", "+1 ()-.", "0123456789 -", "a@b.c-_ 1+", "4111 -"]
    texts += ["".join(rng.choice(kind) for _ in range(rng.randint(0, 60))) for kind in kinds for _ in range(1500)]
    for t in texts:
        assert pii.base_spans(t) == brute_base(t), t


@pytest.mark.parametrize("piece", ["1", "a", "1.", "+1 ", "@", "a@", "1 ", "a.", "a@a", "+", "1-", "at dot "])
def test_pii_patterns_are_linear(piece):
    """A megabyte of anything; what looks at windows beside the patterns is linear as well."""
    text = piece * (1_000_000 // len(piece))
    began = time.time()
    pii.base_spans(text)
    took = time.time() - began
    pii.shaped_spans(text)
    pii.windows(text)
    assert took < 3 and time.time() - began < 15


def test_pii_columns_ties_and_long_texts(spark, tagger):
    long = "word " * 60_000 + "mail a.b@c.de"
    docs = spark.createDataFrame([(1, long), (1, long), (2, None), (None, "x@y.zz")], "doc_id long, text string").withColumns({"spans": F.lit(1), "n_email": F.lit("x")})
    got = sorted((tuple(r) for r in pii.find(docs, tagger).collect()), key=key)
    assert got[0] == got[1] and got[0][1] == 1 and "email:300005:300013" in got[0][6] and [r[1] for r in got] == [1, 1, 0, 1]
    assert pii.redact(docs, tagger).columns == docs.columns


def test_pii_network_learns(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    x, y = pii.labelled_windows(docs, copies=0)
    half = np.arange(x.shape[1]) % 4 > 0
    tagger = pii.Tagger().fit(x[:, half], y[:, half])
    path, _ = tagger.paths(x[:, ~half])
    truth = y[:, ~half]
    assert ((path == truth) & (truth > 0)).sum() > 0.8 * (truth > 0).sum()


def test_packing_invariants(spark, odd):
    from tokenizers import Tokenizer

    codec = Tokenizer.from_file(packing.vocabulary())
    many = odd.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).unionByName(frame(spark, [(100 + i, " ".join(words(20 + 37 * i, i))) for i in range(120)]))
    rows = packing.pack(many, group=40).collect()
    ids = {r["doc_id"]: [*codec.encode(r["text"] or "", add_special_tokens=False).ids, 2] for r in many.collect()}
    at, used = {}, {}
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["start"])):
        own = ids[r["doc_id"]]
        assert r["start"] == at.get(r["doc_id"], 0) and r["doc_tokens"] == len(own)
        part = own[r["start"] : r["start"] + r["length"]]
        assert r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
        at[r["doc_id"]] = r["start"] + r["length"]
        used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert at == {d: len(x) for d, x in ids.items()}
    for own in used.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= 4096
    assert 4096 * len(used) < 1.1 * sum(map(len, ids.values())) + 4096 * 8


def test_differencing_is_even():
    sizes = np.random.default_rng(1).integers(1, 1000, 400)
    at = packing.difference(sizes, 30)
    sums = np.bincount(at, sizes, 30)
    assert sums.sum() == sizes.sum() and sums.max() - sums.min() < 60
    assert packing.difference(np.array([5]), 3).tolist() == [0]


def test_neighbours_recall(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    odd = spark.createDataFrame([(-1, None), (-2, []), (-3, [0.0] * 64), (-4, [None] * 64), (-5, [float("nan")] * 64), (-6, [1.0])], "vec_id long, embedding array<float>")
    vectors = neighbours.usable(table.select("vec_id", "embedding").unionByName(odd))
    rows = vectors.filter("size(embedding) = 64").collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows])
    assert ids.min() >= 0
    got = {}
    for r in neighbours.search(vectors, vectors.filter("vec_id % 100 = 0")).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    hits = total = 0
    for i in np.flatnonzero(ids % 100 == 0):
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        d[i] = np.inf
        best = np.lexsort((ids, d))[:10]
        own = [got[ids[i]][k] for k in range(1, 11)]
        hits += len({v for v, _ in own} & set(ids[best].tolist()))
        total += 10
        assert all(s == pytest.approx(d[ids == v][0], rel=1e-12) for v, s in own) and own == sorted(own, key=lambda p: (p[1], p[0]))
    assert hits >= 0.9 * total


def brute_neighbours(rows, k=10):
    """(query id, rank, id) of all rows against all others of the same length, ties to the smaller id, null last."""
    out = []
    for q, (i, x) in enumerate(rows):
        if i is not None and i % 100 == 0:
            near = sorted((np.sqrt(((np.array(x) - np.array(y)) ** 2).sum()), j is None, j or 0) for p, (j, y) in enumerate(rows) if p != q and len(y) == len(x))
            out += [(i, n + 1, None if none else j) for n, (_, none, j) in enumerate(near[:k])]
    return sorted(out, key=key)


def test_neighbours_small_and_empty(spark):
    rows = [(0, [1.0, 2.0]), (100, [1.0, 2.0]), (5, [3.0, 1.0]), (100, [0.5, 1.0]), (2, [1.0, 2.0]), (2, [1.0, 2.0]), (None, [3.0, 1.0]), (200, [1.0, 2.0, 3.0]), (7, [1.0, 1.0, 1.0])]
    few = neighbours.usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("row", F.lit("x")))
    got = neighbours.search(few, few.filter("vec_id % 100 = 0")).collect()
    assert sorted(((r["query_id"], r["rank"], r["vec_id"]) for r in got), key=key) == brute_neighbours(rows)
    none = neighbours.usable(few.filter("vec_id < 0"))
    assert neighbours.search(none, none).count() == 0


def test_neighbours_of_a_very_common_vector(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.standard_normal(8).tolist()) for i in range(300)] + [(i, [1.0] * 8) for i in range(300, 900)]
    vectors = neighbours.usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = neighbours.search(vectors, vectors.filter("vec_id % 100 = 0")).collect()
    own = {(r["query_id"], r["rank"], r["vec_id"]) for r in got}
    want = {r for r in brute_neighbours(rows)}
    assert {r for r in own if r[0] >= 300} == {r for r in want if r[0] >= 300} and len(own) == len(want)


@pytest.mark.parametrize("name", entries.oracle_sql())
def test_query_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    ours, theirs = entries.queries()[name](spark, sf_dir), con.sql(entries.oracle_sql()[name])
    order = sorted(ours.columns)
    assert order == sorted(theirs.columns)
    assert sorted(map(tuple, ours.select(order).collect()), key=key) == sorted(theirs.select(*order).fetchall(), key=key)


def test_shared_tables_are_measured_and_removed(spark):
    from quillstream.llm import common

    folder = common.shared_folder(spark)
    assert common.shared_folder(spark) == folder and common.written(spark.range(3)).count() == 3
    plan = lambda df: df._jdf.queryExecution().logical().toString()
    assert "broadcast" in plan(common.small(spark.range(10))).lower() and "broadcast" not in plan(common.small(spark.range(10), 100)).lower()


def test_empty_tables(spark):
    docs = frame(spark, [])
    turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.digests(chat.format_chats(turns)).count() == 0
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert neardup.classes(docs).count() == suffixes.repeats(docs).count() == bpe.digests(docs).count() == packing.pack(docs).count() == 0
    assert media.features(media.store(docs.select("doc_id", "text"))).count() == toxicity.detect(docs, labels).count() == pii.find(docs, pii.train(docs)).count() == 0
    assert suffixes.without_repeats(docs).count() == neardup.deduplicate(docs).count() == 0


def test_entries_name_all_operators():
    assert sorted(int(q[2:].split("_")[0]) for q in entries.queries()) == list(range(1, 14))
