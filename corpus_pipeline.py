"""The corpus pipeline: toxic documents go, near copies go, repeated passages are cut, personal data is masked, the rest is packed.

For all stages: a null or empty text is a document like any other (never toxic, never a copy, nothing to cut or
mask, packed as its closing id); rows that repeat an id are documents each, told apart by their text; null ids
stay; an empty table gives an empty table; texts of any length are read whole; columns beyond those of
`documents` do not enter the first stage, so none can clash. Every stage but the last returns these columns,
and n_chars follows where a text is changed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.llm import neardup, packing, pii, suffixes, toxicity
from quillstream.llm.common import table, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents predicted toxic. The lexicon is learned from the labelled ones of docs; without labels all stay."""
    scored = toxicity.detect(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))
    return scored.filter(F.col("predicted") == 0).select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (5-word shingles, similarity 0.8): that of least id; equal ids of one text stay together."""
    return neardup.deduplicate(docs.select(*COLUMNS), k=5, percent=80).select(*COLUMNS)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each passage of 50 words or more that several documents hold stays in the one of least id (a null id comes first) and is cut from the others; no document goes."""
    return suffixes.without_repeats(docs.select(*COLUMNS)).select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mail and IP addresses, cards and telephones, in the fixed patterns or as the network finds them, become their kind in brackets."""
    docs = docs.select(*COLUMNS)
    return pii.redact(docs, pii.train(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of each document: which sequence it is in, where, and which ids it holds."""
    return packing.pack(docs.select("doc_id", "text"))


STAGES = [
    ("toxicity", toxic),
    ("near_duplicates", near_copies),
    ("suffix_array", passages),
    ("personal_data", personal_data),
    ("packing", packed),
]

#: SQL can express none of the learned stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
