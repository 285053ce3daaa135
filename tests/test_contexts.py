"""Words in their context: cut out in one pass over each text, equal to loops over odd texts."""

import random
import re

import __spark_entry__
from pyspark.sql import functions as F

from quillstream.operators import discovery as di

PREFIXES = ("the ", "of ", "de ")


def test_texts_are_not_joined_to_their_words(spark, sf_dir):
    plan = __spark_entry__.queries()["l2_foreign_context"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Window" not in plan


def test_contexts_as_by_loops(spark):
    rnd, signs = random.Random(5), ["with", "THE ", "the ", "of ", "x", "a@b.cc", "@", " ", "é", "\U0001f600", "\n", "Of ", "word", "2505", "deſ "]
    texts = {i: "".join(rnd.choice(signs) for _ in range(rnd.randrange(40))) for i in range(300)} | {1000: "", 1001: "with " * 5000}
    want = set()
    for i, text in texts.items():
        for m in re.finditer("[A-Za-z]+", text):
            if len(m[0]) == 4:
                before, after = text[max(m.start() - 12, 0) : m.start()], text[m.start() : m.start() + 32]
                mail = re.search(r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+", before + m[0] + after)
                want.add((i, m.start(), "@" in before or bool(mail) or bool(re.search(r"(?ai)(?:the |of |de )\Z", before))))
    docs = spark.createDataFrame([*texts.items(), (2000, None)], "doc_id long, text string")
    found = di.in_context(docs, "(?<![A-Za-z])[A-Za-z]{4}(?![A-Za-z])")
    got = found.select("doc_id", "start", di.foreign_context(F.col("before"), F.col("phrase"), F.col("after"), PREFIXES)).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_occurrences_take_one_pass(spark, sf_dir):
    """No text is joined to what was found in it, and nothing is sorted to count places."""
    plan = __spark_entry__.queries()["l1_occurrences"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Window" not in plan


def test_shapes_as_by_their_patterns(spark):
    rnd, signs = random.Random(7), ["with", "THE ", "the", "le ", "i ", "s", "is ", "It", " ", "\n", "k", "\u212a", "\u017f", "2505", "05 合约", "期货", "螺纹钢", "【", "[", "】", "/", "：", "品种", "a", "\U0001f600", "\u0130", "abcdefghijkl", "铜价上涨"]
    texts = {i: "".join(rnd.choice(signs) for _ in range(rnd.randrange(60))) for i in range(400)} | {1000: "", 1001: "the with is " * 3000}
    known, codes, market = ["the", "le", "螺纹钢", "铜价上涨", "abcdefghijkl", "k"], ["is", "it", "k", "sisis"], ("with", "上涨")
    exact = "(?i)" + "|".join(rf"(?<![A-Za-z0-9]){a}(?![A-Za-z0-9])" if a.isascii() else a for a in sorted(known, key=lambda a: (-len(a), a)))
    want = []
    for i, text in texts.items():
        for kind, pattern in {"catalog_alias": exact, **di.SHAPES}.items():
            for m in re.finditer(pattern, text, re.ASCII):
                raw = m[1] if m.re.groups else m[0]
                near = re.search("|".join(market), text[max(m.start() - 28, 0) : m.end() + 28])
                bare = re.sub(r"\s", "", raw).lower()
                held = {"contract_code": bare in codes, "symbol_context": bare in codes and near, "ocr_split_symbol": bare in codes and near, "market_context": len(raw) > 1 and raw.lower() in known and near}
                if held.get(kind, True):
                    want.append((i, kind, raw, m.start(), text[max(m.start() - 12, 0) : m.start()], text[m.start() : m.start() + 32]))
    docs = spark.createDataFrame([*texts.items(), (2000, None)], "doc_id long, text string")
    got = [tuple(r) for r in di.shaped(docs, known, codes, market).select("kind", "raw", F.inline("places")).select("doc_id", "kind", "raw", "start", "before", "after").collect()]
    assert len({w[1] for w in want}) == 8 and sorted(got) == sorted(want)
