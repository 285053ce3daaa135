"""Evidence and routing in one pass over each text, against the tables of places that it stands for."""

import dataclasses
import random

import __spark_entry__
import pytest
from pyspark.sql import functions as F

from quillstream.operators import proof, proven
from quillstream.operators import spans as sp
from quillstream.plans import spanned

SIGNS = ["the", "The", "of", "le", "and", "x", "word", "would", "with", "with the", "from", "this", "is", "mit", "that", "not ", "nicht", "no ", "if ", "but ", "risk", "cookie", ". A", ". The", "! Of", ". And the", ". X", ".", "!", ",", ";", "|", "\n", "　", "【x】", "\U0001f600", " 3 / 4 "]


def table(spark, folder, texts):
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_proofs_and_routes_as_by_tables(spark, tmp_path, monkeypatch):
    rnd, names = random.Random(11), {"the": "K.THE", "of": "K.OF", "le": "GROUP.LE", "and": "GROUP.AND"}
    texts = {i: " ".join(rnd.choice(SIGNS) for _ in range(rnd.randrange(160))) for i in range(300)} | {1000: "", 1001: None, 1002: "the with is of. " * 400, 1003: "word " * 50}
    d = table(spark, tmp_path / "t", texts)
    monkeypatch.setattr(spanned, "ALIASES", names)
    docs, rules = spanned._docs(spark, d), dataclasses.replace(spanned.RULES, names=names)
    places = spanned._places(spark, d)
    area, signals = spanned._area(spark, d, places), spanned.written(spanned._product_signals(spark, d, places))
    found = proof.proofs(docs, places[0], area, signals, endings=spanned.ENDS, clauses=spanned.CLAUSES, comparisons=spanned.COMPARED)
    want = rows(found.select("doc_id", "product_key", "place", "start", "stop", "quote"))
    assert want and rows(proven.proofs(docs, rules, spanned.CLAUSES, spanned.COMPARED)) == want
    said = proven.read(docs, rules, spanned.CLAUSES).select("doc_id", "product_key", F.inline("signals"))
    assert rows(said) == rows(signals.select(*said.columns))
    routed = sp.routed(docs, spanned._verdicts(spark, d), found, spanned._candidates(spark, d, places[0], area), sp.related_only(places[0]))
    want = rows(routed)
    assert len({(r[2], r[3]) for r in want}) > 5 and rows(proven.routed(docs, rules, spanned.CLAUSES, spanned.COMPARED, spanned.BOILER)) == want


@pytest.mark.parametrize("name", ["t11_evidence_sentences", "t14_routing"])
def test_nothing_is_moved_or_sorted(spark, sf_dir, name):
    plan = __spark_entry__.queries()[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in ("Join", "Window", "Aggregate", "Sort") if x in plan]


def test_sentences_of_a_text_without_marks(spark):
    """Each character was tried as a beginning, which grew with the square of such a text."""
    docs = spark.createDataFrame([(1, "a" * 1_000_000), (2, "a. b|c. d" + "e" * 1_000_000)], "doc_id long, text string")
    assert rows(proof.sentences(docs, ".!?").select("doc_id", "phrase")) == [(2, "a."), (2, "c.")]
