"""Spelling variants, license scans and phrases against brute force, on small tables with odd rows."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstream.llm import licenses, phrases, spelling
from tests.llm.test_operators import frame, key

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def edited(word, rng):
    """A word with one letter put in, left out or replaced."""
    at, how, letter = rng.randrange(len(word)), rng.randrange(3), rng.choice("abcdé")
    return word[:at] + ("" if how == 0 else letter) + word[at + (how != 1) :]


@pytest.fixture(scope="module")
def variants(spark):
    rng = random.Random(3)
    known = ["".join(rng.choice("abcdéß") for _ in range(rng.randint(4, 8))) for _ in range(60)]
    known += ["x" * 3000, "x" * 2999, "x" * 1500 + "y" + "x" * 1499]
    texts = [" ".join(edited(w, rng) if rng.random() < 0.4 else w for w in rng.choices(known, k=120)) for _ in range(40)]
    texts += [" ".join(known[-3:] + ["papaya"] * 40 + ["papays"] * 12 + ["paptys"] * 4)] * 4
    rows = [(i, t) for i, t in enumerate(texts)] + [(1, texts[1]), (None, texts[2].upper()), (90, None), (91, ""), (92, "中文 word中文word 123 Å Åßaaa_aaa")]
    return rows, frame(spark, rows).withColumns({"word": F.lit(1), "id": F.lit("x")})


def brute_variants(rows):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            counts[run if h % 97 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 5 and c >= 3}

    def near(a, b):
        if len(a) > len(b):
            a, b = b, a
        if len(b) - len(a) > 1 or a == b:
            return False
        i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
        return a[i:] == b[i + 1 :] if len(a) < len(b) else a[i + 1 :] == b[i + 1 :]

    out, form = [], {}
    by_word = {w: [v for v in n if near(w, v)] for w in n}
    for w, vs in by_word.items():
        fit = [v for v in vs if n[v] >= 2 * n[w]]
        form[w] = min(fit, key=lambda v: (-n[v], v)) if fit else None
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(by_word[w]), n.get(form[w])))
    return out


def test_spelling_against_brute_force(variants):
    rows, docs = variants
    want = brute_variants(rows)
    got = spelling.variants(docs).collect()
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert sum(x[1] is not None for x in want) > 20 and any(x[1] and x[1] != x[2] for x in want) and any(len(x[0]) > 2000 and x[4] for x in want)


def test_spelling_in_small_parts(variants, monkeypatch):
    rows, docs = variants
    monkeypatch.setattr(spelling, "HELD", 7)
    monkeypatch.setattr(spelling, "LETTERS", 20)
    assert sorted(map(tuple, spelling.variants(docs).collect()), key=key) == sorted(brute_variants(rows), key=key)


def test_neighbourhoods_hold_every_edit():
    """Of two words one edit apart one sends the form under which the other is filed."""
    import pyarrow as pa

    rng = random.Random(5)
    pairs = [(w, v) for w in ("".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 12))) for _ in range(300)) if (v := edited(w, rng)) and v != w]
    for w, v in pairs:
        batch = pa.record_batch({"id": pa.array([0, 1], pa.int64()), "word": pa.array([w, v]), "n": pa.array([1, 1], pa.int64())})
        forms = next(spelling._file([batch]))["form"].to_pylist()
        sent = {(f, a) for b in spelling._neighbourhood([batch]) for f, a in zip(b["form"].to_pylist(), b["a"].to_pylist(), strict=True)}
        assert (forms[1], 0) in sent or (forms[0], 1) in sent


@pytest.fixture(scope="module")
def notices(spark):
    mit = next(t for x, t in licenses.TEXTS if x == "mit" and t.startswith("permission"))
    words_ = mit.split()
    torn = " ".join(words_[:12] + ["really"] + words_[12:])
    few = " ".join(words_[:8])
    rows = [
        (1, None),
        (2, ""),
        (3, "The MIT License. Mit license! MIT  licensed; mit\nlicense"),
        (4, "GNU General Public License, GNU Lesser General Public License"),
        (5, torn.upper()),
        (6, few),
        (7, "CC-BY and cc by 4.0; Licensed under CC BY 4.0 Apache LicensÉ apache license"),
        (7, "CC-BY and cc by 4.0; Licensed under CC BY 4.0 Apache LicensÉ apache license"),
        (7, "other text of that id: cc by"),
        (None, "apache license"),
        (8, "KIT mit İ license mit license"),
        (9, "word " * 20000 + "mit license " * 3000 + mit),
        (10, "..."),
    ]
    return rows, frame(spark, rows).withColumns({"label": F.lit("x"), "n_words": F.lit("y")})


def brute_licenses(rows):
    out = []
    for doc, text in rows:
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER))
        places, labels, best = [], set(), 0.0
        for label, phrase in licenses.PHRASES:
            p = phrase.split()
            own = [i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
            places += [(i, label) for i in own]
        index = {}
        for i in range(len(w) - 3):
            index.setdefault(tuple(w[i : i + 4]), []).append(i)
        for label, t in licenses.TEXTS:
            p = t.split()
            n = len(p) - 3
            votes = sorted((i - at, at) for at in range(n) for i in index.get(tuple(p[at : at + 4]), ()))
            groups = []
            for d, at in votes:
                if groups and d - groups[-1][0] <= licenses.NEIGHBOURS:
                    groups[-1][0] = d
                    groups[-1][1].add(at)
                else:
                    groups.append([d, {at}])
            for _, seen in groups:
                if len(seen) / n >= licenses.SHARE:
                    labels.add(label)
                    best = max(best, len(seen) / n)
        base = sorted({x for _, x in places})
        starts = [i for i, _ in places]
        out.append((doc, len(w), len(places), min(starts, default=None), max(starts, default=None), ",".join(base), ",".join(sorted(labels | set(base))), max([best, *(1.0 for _ in places[:1])])))
    return out


def test_licenses_against_brute_force(notices):
    rows, docs = notices
    want = brute_licenses(rows)
    assert sorted(map(tuple, licenses.scan(docs).collect()), key=key) == sorted(want, key=key)
    by_id = {x[0]: x for x in want}
    assert by_id[3][2] == 3 and by_id[5][5:7] == ("", "mit") and 0.6 < by_id[5][7] < 1 and by_id[6][6] == "" and by_id[9][2] == 3000


def test_licenses_stay_native(notices):
    plan = licenses.scan(notices[1])._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan


def brute_phrases(rows, least, top=2000):
    f, total = {}, Counter()
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            w = re.findall("[^ \t]+", piece)
            total[lang] += len(w)
            for k in (1, 2, 3):
                for i in range(len(w) - k + 1):
                    f.setdefault(lang, Counter())[tuple(w[i : i + k])] += 1
    out = []
    for lang, c in f.items():
        rows_ = []
        for p, a in c.items():
            if len(p) < 2 or a < least:
                continue
            score, _, left, right = min((1_000_000 * a * a // (c[p[:k]] * c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
            if len(p) == 2 and any(len(q) == 3 and b >= least and p in (q[:2], q[1:]) and 2 * b >= a for q, b in c.items()):
                continue
            rows_.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, i + 1, p.decode(), -a, left, right, total[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(rows_)[:top])]
    return out


@pytest.fixture(scope="module")
def spoken(spark):
    rng = random.Random(8)
    pick = lambda n: "".join(rng.choice(["a", "b", "the", "Of", "é", "zu", "a b the"]) + rng.choice([" ", " ", "\t", "  ", ". ", ",", "\n", "\x0b", "　"]) for _ in range(n))
    rows = [(rng.choice(["en", "de", None, "und"]), pick(rng.randint(0, 300))) for _ in range(60)] + [("en", None), ("en", ""), ("fr", "...")] + [("en", "so it goes " * 2000)] + [("en", "so it goes, so it goes")] * 4
    docs = spark.createDataFrame([(i, t, x) for i, (x, t) in enumerate(rows)], "doc_id long, text string, lang string").withColumns({"w1": F.lit(1), "n": F.lit("x"), "rank": F.lit(0)})
    return rows, docs


@pytest.mark.parametrize("small", [False, True])
def test_phrases_against_brute_force(spoken, monkeypatch, small):
    rows, docs = spoken
    if small:
        monkeypatch.setattr(phrases, "HELD", 50)
        monkeypatch.setattr(phrases, "PARTS", 3)
    got = sorted(map(tuple, phrases.collocations(docs, least=4).collect()), key=key)
    want = brute_phrases(rows, 4)
    assert got == sorted(want, key=key) and len(want) > 50
    assert sorted(map(tuple, phrases.collocations(docs, least=4, top=3).collect()), key=key) == sorted(brute_phrases(rows, 4, 3), key=key)


def test_three_way_partitions_are_counts():
    rng = np.random.default_rng(4)
    for n, most in ((1, 2), (500, 3), (3000, 60)):
        keys = rng.integers(-1, most, (3, n)).astype(np.int32)
        keys[0] = np.abs(keys[0])
        keys[2, keys[1] < 0] = -1
        weights = rng.integers(1, 5, n)
        for least in (1, 7):
            got = {}
            for d, at, w in phrases.equal_partitions(keys, weights, least):
                for p, x in zip(at, w, strict=True):
                    got[tuple(keys[: d + 1, p])] = int(x)
            want = Counter()
            for j in range(n):
                for d in range(3):
                    if (keys[: d + 1, j] >= 0).all():
                        want[tuple(keys[: d + 1, j])] += int(weights[j])
            assert got == {k: v for k, v in want.items() if v >= least}


def test_phrase_scores_are_exact(spark, monkeypatch):
    """Products beyond 64 bits."""
    a, left, right = 7_654_321_987, 9_876_543_210, 8_765_432_109
    rows = [("en", "x", None, None, left), ("en", "y", None, None, right), ("en", "x", "y", None, a)]
    counted = spark.createDataFrame(rows, "lang string, w1 string, w2 string, w3 string, n long")
    totals = spark.createDataFrame([("en", 10**13)], "lang string, total long")
    monkeypatch.setattr(phrases, "counts", lambda docs, least: (counted, totals))
    (row,) = phrases.collocations(counted).collect()
    assert row["score"] == 10**6 * a * a // (left * right) and row["n"] == 10**13


def test_word_operators_on_empty_tables(spark):
    none = frame(spark, [])
    assert spelling.variants(none).count() == 0 and licenses.scan(none).count() == 0 and phrases.collocations(none).count() == 0
