"""Queries of names out of tables and of where reasons stand in texts. SQL has no automaton; loops over the smallest table test them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstream.operators import aliases, locate
from quillstream.sources import bindings as b

_QUERIES: dict = {}


def query(name: str):
    def add(f):
        _QUERIES[name] = f
        return f

    return add


def entries(s, d) -> DataFrame:
    """A lexicon of the driver's data: the words of the benchmark's texts, dealt to products by hash, each product with some of them as negative words."""
    words = b.table(s, d, "benchmark").select(F.explode(F.split("text", r"[^\p{L}]+")).alias("alias")).filter("length(alias) > 3").distinct()
    number = F.pmod(F.xxhash64("alias"), F.lit(200))
    barred = F.collect_list(F.when(F.pmod(F.xxhash64("alias"), F.lit(1009)) < 3, F.col("alias")))
    return words.groupBy(F.concat(F.lit("K"), number).alias("product_key")).agg(F.concat(F.lit("P"), F.first(number)).alias("display_name"), F.array_sort(F.collect_list("alias")).alias("aliases"), F.array_sort(barred).alias("negatives"))


def reviewed(s, d) -> DataFrame:
    """Aliases that a review has approved: the documents' languages and sources."""
    docs = b.table(s, d, "documents")
    return docs.select(F.explode(F.array("lang", "source")).alias("alias")).distinct().select("alias", F.concat(F.lit("K"), F.pmod(F.xxhash64("alias"), F.lit(200))).alias("product_key"))


@query("t1_table_matches")
def t1(s, d):
    docs = b.table(s, d, "documents").select("doc_id", "text", F.concat_ws(" ", "source", "lang").alias("title"))
    return aliases.table_matches(docs, entries(s, d), reviewed(s, d), "title")


CATALOG = "product_key string, display_name string, official_name string, symbol string, aliases array<string>"
KINDS = (("K0", "the", "der", "el", ["le", "la"]), ("K1", "of", "von", "de", ["del"]), ("K2", "and", "und", "y", ["et"]), ("K3", "with", "mit", "con", ["avec"]))
MARKS = locate.Marks(before=".!?", after=("a", "e", "i", "o", "t", "r"), ends=".!?\n", parts=".!?;,\n")


def catalog(s) -> DataFrame:
    rows = [F.struct(F.lit(k).alias("product_key"), F.lit(x).alias("display_name"), F.lit(o).alias("official_name"), F.lit(y).alias("symbol"), F.array(*map(F.lit, more)).alias("aliases")) for k, x, o, y, more in KINDS]
    return s.range(1).select(F.inline(F.array(*rows)))


def located(s, d) -> tuple[DataFrame, DataFrame]:
    """Results whose reasons are a sentence of their document (every fifth is a reason of its own), and the documents' texts: half of each as cleaned."""
    docs = b.table(s, d, "documents").select(F.col("doc_id").alias("article_id"), "text")
    texts = docs.select("article_id", F.when(F.col("article_id") % 3 > 0, F.left("text", F.expr("CAST(length(text) DIV 2 AS INT)"))).alias("cleaned_text"), F.col("text").alias("raw_text"))
    own = b.results(s, d).select(F.col("id").alias("result_id"), "article_id", "reason", "direction", "confidence", "contract_key")
    said = F.get(F.split("text", r"[.!?\n]"), (F.col("result_id") % 7).cast("int"))
    rows = own.join(docs, "article_id", "left").withColumn("reason", F.when(F.col("result_id") % 5 > 0, F.coalesce(said, "reason")).otherwise(F.col("reason")))
    key = F.col("result_id") % 4
    names = F.array(*[F.lit(k[1]) for k in KINDS])
    return rows.select("result_id", "article_id", F.concat(F.lit("K"), key).alias("product_key"), F.get(names, key.cast("int")).alias("product"), F.lit(None).cast("string").alias("contract"), "contract_key", "direction", "reason", "confidence"), texts


@query("t15_reason_evidence")
def t15(s, d):
    results, texts = located(s, d)
    return locate.evidence(results, texts, catalog(s), marks=MARKS)


def queries() -> dict:
    return _QUERIES


def oracle_sql() -> dict[str, str]:
    return {}
