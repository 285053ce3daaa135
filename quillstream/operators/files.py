"""Files in and out: texts in unknown encodings, reports, sinks of results and of the lexicon."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.operators.tables import sliced

ENCODINGS = ("utf-8-sig", "utf-8", "gb18030", "big5")


def decoded(files: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """key, text, encoding and title (the first heading line, else '') of files' bytes, in the first encoding that reads them whole; else UTF-8 with replacement marks."""
    schema = f"{key} {files.schema[key].dataType.simpleString()}, text string, encoding string, title string"

    def read(raw: bytes) -> tuple[str, str]:
        for name in ENCODINGS:
            try:
                return raw.decode(name), name
            except UnicodeDecodeError:
                continue
        return raw.decode("utf-8", "replace"), "replaced"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts = [read(x or b"") for x in batch.column(content).to_pylist()]
            titles = [next((line.lstrip("# ").strip() for line in t.splitlines() if line.startswith("#")), "") for t, _ in texts]
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array([t for t, _ in texts], pa.string()), pa.array([e for _, e in texts], pa.string()), pa.array(titles, pa.string())], names=[key, "text", "encoding", "title"])

    return files.select(key, content).mapInArrow(run, schema)


def text_files(spark: SparkSession, folder: str) -> DataFrame:
    """Text files of a folder and those below it, decoded."""
    return decoded(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "content"))


REPORT = ("path", "file_type", "status", "reason", "title", "company", "publish_time", "article_id")


def write_report(files: DataFrame, folder: str) -> None:
    """The report of a load as CSV with a head line."""
    files.select(*REPORT).write.mode("overwrite").option("header", True).csv(folder)


def read_report(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.option("header", True).schema(", ".join(f"{c} {'long' if c == 'article_id' else 'string'}" for c in REPORT)).csv(folder)


def write_results(folder: str, results: DataFrame, signals: DataFrame, reviews: DataFrame, canonical: DataFrame) -> None:
    """Results, evidence, review queue and canonical payloads, each as JSON lines."""
    for name, rows in (("results", results), ("evidence", signals), ("review_queue", reviews), ("canonical_results", canonical)):
        rows.write.mode("overwrite").json(f"{folder}/{name}")


def run_report(canonical: DataFrame, results: DataFrame, reviews: DataFrame, errors: DataFrame) -> DataFrame:
    """One row: documents, analyses, errors, reviews, results by rule and by a model (whatever is no rule)."""
    rules = F.count_if(F.col("method") == "rule")
    own = results.agg(F.count("*").alias("analyses"), rules.alias("rules"), (F.count("*") - rules).alias("llm"))
    # one row each
    return canonical.agg(F.count("*").alias("documents")).crossJoin(own).crossJoin(reviews.agg(F.count("*").alias("reviews"))).crossJoin(errors.agg(F.count("*").alias("errors")))


LEXICON = "product_key string, canonical string, aliases array<string>, evidence_count long, confidence double"


def read_lexicon(spark: SparkSession, folder: str) -> DataFrame:
    """The entries of a lexicon's artifact."""
    return spark.read.schema(LEXICON).json(folder)


LABELS = "source_id string, product_key string, direction string, evidence array<string>, ambiguous boolean, raw_text string"


def read_labels(spark: SparkSession, folder: str, docs: DataFrame) -> DataFrame:
    """Labels with their text: a label's own, else that of the document (source_id, text) that it names."""
    rows = spark.read.schema(LABELS).json(folder)
    joined = rows.join(docs.select("source_id", F.col("text").alias("_text")), "source_id", "left")
    return joined.withColumns({"raw_text": F.coalesce(F.nullif("raw_text", F.lit("")), "_text"), "ambiguous": F.coalesce("ambiguous", F.lit(False))}).drop("_text")
