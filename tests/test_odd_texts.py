"""Queries over texts that the driver's tables hold rarely or not at all, against their SQL."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

import __spark_entry__

TEXTS = ["", None, " ", "\n \n\t\n", "\n", "a", "# x", "##\nb", "##\x0bq\nz", "a\rb\nc", "a\r\nb\r\n\r\nc", "\xa0a\xa0\nb", "a\n\u3000\nb", "a\n\x0b\nb", "【a】b\nc\n【】d", "x. The y. The. The z", ". "]


def written(folder, texts):
    n = 3 * len(texts)
    pq.write_table(pa.table({"doc_id": pa.array(range(n), pa.int64()), "text": [texts[i // 3] for i in range(n)]}), folder / "documents.parquet")
    return str(folder)


def test_paragraphs_equal_sql(spark, tmp_path):
    d, name = written(tmp_path, TEXTS), "x26_paragraphs"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{d}/documents.parquet'")
    theirs = con.sql(f"SELECT doc_id, n, digest FROM ({__spark_entry__.oracle_sql()[name]}) ORDER BY doc_id").fetchall()
    assert [tuple(r) for r in __spark_entry__.queries()[name](spark, d).select("doc_id", "n", "digest").orderBy("doc_id").collect()] == theirs
