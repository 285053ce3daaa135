"""What the operators share: written intermediate tables and checked broadcasts."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A side of a join is broadcast only if its rows hold at most so many bytes, as measured.
BROADCAST_BYTES = 64 << 20


def shared_folder(spark: SparkSession) -> str:
    """This application's folder below spark.checkpoint.dir, which driver and executors share; it goes when the application ends.

    Where that is unset, a local session (tests) gets a folder of its own; on a cluster it is an error, for executors would write to their own disks."""
    folder = getattr(spark, "_quillstream_folder", None)
    if not folder:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
            base = "file://" + tempfile.mkdtemp(prefix="spark-")
        folder = spark._quillstream_folder = f"{base.rstrip('/')}/quillstream-{uuid.uuid4().hex}"
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
    return folder


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage is cut, and the rows outlive lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _width(name: str, kind: T.DataType) -> Column:
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(name), F.lit(0)) + 16
    if isinstance(kind, T.ArrayType):
        return F.coalesce(F.octet_length(F.to_json(F.struct(name))), F.lit(0)) + 16
    return F.lit(8)


def small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """df, a written table, with a broadcast hint if its measured size is at most `most`; else Spark shuffles both sides."""
    width = sum((_width(f.name, f.dataType) for f in df.schema), F.lit(16))
    return F.broadcast(df) if (df.agg(F.sum(width).alias("n")).first()["n"] or 0) <= most else df


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, after which a task's freed memory goes back to the machine: workers live on, and each operator's peak would stay with them."""

    def tidied(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # the C library of Linux has it
            if trim:
                trim(0)

    return tidied


def extended(df: DataFrame, fields: str) -> T.StructType:
    """df's schema with further fields (DDL) that may be null."""
    more = T.StructType.fromDDL(fields)
    return T.StructType([*(T.StructField(f.name, f.dataType) for f in df.schema), *more])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_groups(frames, keys):
    """Frames of a partition that is sorted by `keys`, cut anew so that no group is split: each yields whole groups only.

    Memory is that of a frame and the longest group."""
    import numpy as np
    import pandas as pd

    held = []
    for frame in frames:
        if not len(frame):
            continue
        change = np.zeros(len(frame), bool)
        for k in keys:
            values = frame[k].to_numpy()
            change[1:] |= values[1:] != values[:-1]
        cuts = np.flatnonzero(change)
        same = held and all(held[-1][k].iloc[-1] == frame[k].iloc[0] for k in keys)
        if held and not same:
            yield pd.concat(held, ignore_index=True) if len(held) > 1 else held[0]
            held = []
        if len(cuts):
            head = frame.iloc[: cuts[-1]]
            yield pd.concat([*held, head], ignore_index=True) if held else head.reset_index(drop=True)
            held = [frame.iloc[cuts[-1] :].reset_index(drop=True)]
        else:
            held.append(frame)
    if held:
        yield pd.concat(held, ignore_index=True) if len(held) > 1 else held[0]


def bounds(*columns):
    """Edges of the runs of equal values in sorted columns, [0, ..., n]."""
    import numpy as np

    n = len(columns[0])
    change = np.ones(n + 1, bool)
    if n > 1:
        change[1:-1] = False
        for c in columns:
            change[1:-1] |= c[1:] != c[:-1]
    return np.flatnonzero(change) if n else np.zeros(1, np.int64)


def components(edges: DataFrame) -> DataFrame:
    """id, c: the smallest id that each end of some edges (a, b) reaches. A written table.

    Labels spread along edges and then jump to their own labels, so rounds grow with the logarithm of the longest path at most
    for the stars that the operators hand over."""
    edges = written(edges.select("a", "b").distinct())
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    labels = written(both.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("id"), F.least("u", "v").alias("c")))
    while True:
        near = both.join(labels, both["v"] == labels["id"]).groupBy("u").agg(F.min("c").alias("m"))
        spread = labels.join(near, labels["id"] == near["u"]).select("id", F.col("c").alias("old"), F.least("c", "m").alias("c"))
        target = labels.select(F.col("id").alias("c"), F.col("c").alias("next"))
        fresh = written(spread.join(target, "c").select("id", "old", F.least("c", "next").alias("c")))
        changed = not fresh.filter(F.col("c") != F.col("old")).isEmpty()
        labels = fresh.select("id", "c")
        if not changed:
            return labels
