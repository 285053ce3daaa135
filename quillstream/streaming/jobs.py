"""Incremental forms: once-only rows, running trends, batches with a summary. Each runs what has arrived, then ends."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _folder(spark: SparkSession) -> str:
    """A new folder where the cluster shares one (spark.checkpoint.dir); it goes when the application ends.

    Where that is unset, a local session (tests) gets one of its own; on a cluster it is an error, for executors would write to their own disks."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
    folder = f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(path)
    files.deleteOnExit(path)
    return folder


def arrivals(spark: SparkSession, sf_dir: str, name: str, files: int = 20) -> DataFrame:
    """The files of a table as a stream, a bounded number at a time."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    # a file or a folder of that very name
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/{name}[.]parquet")


def as_stream(rows: DataFrame, files: int = 20) -> DataFrame:
    """Rows as a stream, by way of files in the shared folder."""
    folder = _folder(rows.sparkSession) + "/rows"
    rows.write.parquet(folder)
    return rows.sparkSession.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(folder)


def once_only(stream: DataFrame, keys: list[str], time: str | None = None, late: str | None = None) -> DataFrame:
    """The first row of each key, whatever comes again; a written table of what the stream holds.

    State is a row a key. With `late`, keys are forgotten when the watermark of `time` has passed them."""
    spark, folder = stream.sparkSession, _folder(stream.sparkSession)
    timed = stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys) if time and late else stream.dropDuplicates(keys)
    query = timed.select(keys).writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start(f"{folder}/rows")
    query.awaitTermination()
    return spark.read.schema(stream.select(keys).schema).parquet(f"{folder}/rows")


def running_trend(stream: DataFrame, time: str, value: str, late: str | None = None) -> DataFrame:
    """Mean by day of all rows that have come, in whatever order; state is a row a day. With `late`, rows behind this watermark are dropped and state of days that are over is let go."""
    spark, folder = stream.sparkSession, _folder(stream.sparkSession)
    timed = stream.withColumn("at", F.col(time).cast("timestamp"))
    timed = timed.withWatermark("at", late) if late else timed
    daily = timed.groupBy(F.window("at", "1 day")).agg(F.sum(value).alias("total"), F.count("*").alias("n"))

    def keep(batch: DataFrame, number: int) -> None:
        batch.select(F.col("window.start").alias("start"), "total", "n", F.lit(number).alias("batch")).write.mode("overwrite").parquet(f"{folder}/batch={number}-kept")

    query = daily.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    # the last update of each day holds
    rows = spark.read.schema("start timestamp, total double, n long, batch int").option("basePath", folder).option("recursiveFileLookup", True).option("pathGlobFilter", "part-*").parquet(f"{folder}/batch=*-kept")
    last = rows.groupBy("start").agg(F.max_by(F.struct("total", "n"), "batch").alias("x"))
    return last.select(F.to_date("start").cast("string").alias("day"), F.round(F.col("x.total") / F.col("x.n"), 4).alias("value"), F.col("x.n").alias("n"))


def in_batches(stream: DataFrame, work, ok: str | None = None):
    """work(batch) of each batch; a batch that is run again replaces its own rows. With `ok`, a flag of work's rows, also a summary: a row a batch of how many rows were scanned, kept and failed."""
    spark, folder = stream.sparkSession, _folder(stream.sparkSession)

    def run(batch: DataFrame, number: int) -> None:
        path = f"{folder}/rows/{number}"
        work(batch).write.mode("overwrite").parquet(path)
        if ok:
            kept = F.count_if(F.coalesce(F.col(ok), F.lit(False)))
            batch.sparkSession.read.parquet(path).agg(F.lit(number).alias("batch"), F.count("*").alias("scanned"), kept.alias("kept"), (F.count("*") - kept).alias("failed")).write.mode("overwrite").parquet(f"{folder}/summary/{number}")

    query = stream.writeStream.foreachBatch(run).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.option("recursiveFileLookup", True).parquet(f"{folder}/rows")
    return (rows, spark.read.option("recursiveFileLookup", True).parquet(f"{folder}/summary")) if ok else rows


def applied(stream: DataFrame, start: DataFrame, change) -> DataFrame:
    """The table that change(table, batch) makes of `start`, batch by batch. Each batch writes its own version, so one that is run again starts from the same table."""
    spark, folder = stream.sparkSession, _folder(stream.sparkSession)
    start.write.parquet(f"{folder}/version--1")
    last = [-1]

    def run(batch: DataFrame, number: int) -> None:
        before = batch.sparkSession.read.schema(start.schema).parquet(f"{folder}/version-{number - 1}")
        change(before, batch).select(start.columns).write.mode("overwrite").parquet(f"{folder}/version-{number}")
        last[0] = number

    query = stream.writeStream.foreachBatch(run).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(start.schema).parquet(f"{folder}/version-{last[0]}")


def isolated(rows: DataFrame, column: str, work, kind: str, key: str = "doc_id") -> DataFrame:
    """key, ok, value and error of work(value of a column) for each row: an exception is that row's error, and the others go on."""
    schema = f"{key} {rows.schema[key].dataType.simpleString()}, ok boolean, value {kind}, error string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for value in batch.column(column):
                try:
                    out.append((True, work(value.as_py()), None))
                except Exception as e:  # noqa: BLE001
                    out.append((False, None, f"{type(e).__name__}: {e}"))
            ok, values, errors = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(ok, pa.bool_()), pa.array(values, {"long": pa.int64(), "double": pa.float64(), "string": pa.string()}[kind]), pa.array(errors, pa.string())], names=[key, "ok", "value", "error"])

    return rows.select(key, column).mapInArrow(run, schema)
