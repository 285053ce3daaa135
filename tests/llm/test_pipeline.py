"""The corpus pipeline, stage by stage against brute force, and as a whole."""

import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillstream.llm import packing, pii, toxicity
from tests.llm.test_operators import DOCS, brute_classes, brute_rate, brute_spans, key, words

STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def folder(spark, sf_dir, tmp_path_factory):
    """The smallest tables with odd rows: null, empty and long texts, null and repeated ids, copies, passages, personal data."""
    out = tmp_path_factory.mktemp("corpus")
    passage, base = words(70, 31), words(120, 32)
    near = base.copy()
    near[50] = "changed"
    rows = [(9001, None), (9002, ""), (9003, " ".join(base)), (9004, " ".join(near)), (9004, " ".join(words(90, 33))), (None, " ".join(words(80, 34)))]
    rows += [(9010 + i, " ".join(words(60, 40 + i) + passage + words(60, 50 + i))) for i in range(3)]
    rows += [(9020, " ".join(words(30, 60)) + " a.b@mail.example.com " + " ".join(words(30, 61))), (9021, "x" * 3000), (9022, " ".join(words(20_000, 70)))]
    odd = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], DOCS)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*corpus_pipeline.COLUMNS).unionByName(odd)
    docs.withColumn("score", F.lit("clash")).write.parquet(f"{out}/documents.parquet")
    spark.read.parquet(f"{sf_dir}/labels.parquet").write.parquet(f"{out}/labels.parquet")
    return str(out)


@pytest.fixture(scope="module")
def docs(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")


def pairs(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()), key=key)


def test_toxicity_stage(spark, docs, folder):
    lexicon = toxicity.learn(toxicity.labelled(docs, spark.read.parquet(f"{folder}/labels.parquet")))
    want = [(d, t) for d, t in pairs(docs) if lexicon.score(np.array([brute_rate(t or "", lexicon)]))[0] < 0.5]
    got = STAGES["toxicity"](spark, docs, folder)
    assert got.columns == list(corpus_pipeline.COLUMNS) and pairs(got) == want


def test_near_duplicates_stage(spark, docs, folder):
    rows = pairs(docs)
    want = [r for r, (d, _, c, keep) in zip(rows, brute_classes(rows, 5, 80), strict=True) if keep]
    assert pairs(STAGES["near_duplicates"](spark, docs, folder)) == want


def test_suffix_array_stage(spark, docs, folder):
    got = STAGES["suffix_array"](spark, docs, folder)
    rows = [(d, t) for d, t in pairs(docs) if d is not None]
    cut = {}
    for d, again, at in brute_spans(rows, 50):
        if again:
            cut.setdefault(d, set()).add(at)
    kept = {(d, t) for d, t in pairs(got)}
    once = {d for d, _ in rows if sum(x == d for x, _ in rows) == 1}
    for d, t in rows:
        if d in once:
            left = [w for i, w in enumerate((t or "").split()) if i not in cut.get(d, ())]
            now = next(x for y, x in kept if y == d)
            assert (now or "").split() == left and (t is None) == (now is None)
    assert got.count() == docs.count()
    assert all(r["n_chars"] == len(r["text"]) for r in got.collect() if r["doc_id"] in cut and r["text"] is not None)


def test_personal_data_stage(spark, docs, folder):
    got = STAGES["personal_data"](spark, docs, folder)
    before, after = pairs(docs), pairs(got)
    assert len(before) == len(after)
    changed = {d: t for d, t in after if d is not None}
    for d, t in before:
        if d is not None and sum(x == d for x, _ in before) == 1 and t is not None:
            # a base span is gone with its kind in its place, a text without digits and signs is as it was
            for a, k, b in pii.base_spans(t):
                assert f"[{pii.KINDS[k].upper()}]" in changed[d] or any(y < a < z for y, _, z in pii.base_spans(t))
            if not pii.windows(t):
                assert changed[d] == t
    assert "[EMAIL]" in changed[9020] and changed[9001] is None and changed[9002] == ""


def test_packing_stage(spark, docs, folder):
    from tokenizers import Tokenizer

    codec = Tokenizer.from_file(packing.vocabulary())
    single = docs.filter("doc_id IS NOT NULL AND doc_id <> 9004")
    ids = {d: [*codec.encode(t or "", add_special_tokens=False).ids, 2] for d, t in pairs(single)}
    seen = {d: 0 for d in ids}
    for r in sorted(STAGES["packing"](spark, single, folder).collect(), key=lambda r: (r["doc_id"], r["start"])):
        own = ids[r["doc_id"]]
        assert r["start"] == seen[r["doc_id"]] and r["doc_tokens"] == len(own)
        seen[r["doc_id"]] += r["length"]
        assert r["ids_crc32"] == zlib.crc32(np.array(own[r["start"] : r["start"] + r["length"]], "<u4").tobytes())
    assert seen == {d: len(x) for d, x in ids.items()}


def test_all_stages_one_after_another(spark, folder):
    rows = corpus_pipeline.run(spark, folder).collect()
    ids = {r["doc_id"] for r in rows}
    assert {9001, 9002, 9003, 9021, 9022, None} <= ids and 9004 in ids  # of the two rows with this id one is no copy
    assert {9010, 9011, 9012} <= ids
    ends = {}
    for r in rows:
        ends.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in ends.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= packing.WINDOW


def test_empty_table(spark, folder, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stage_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "suffix_array", "personal_data", "packing"]
    assert re.match(r"\w+", corpus_pipeline.__doc__)
