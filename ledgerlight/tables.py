"""Intermediate tables in the folder that driver and executors share, and connected components that rest on them."""

from __future__ import annotations

import gc
import threading
import time
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlight.session import shared_folder

#: Edges that a file of a table of theirs holds.
EDGES = 500_000

_made = threading.local()
_freed = [0.0]


def free(spark: SparkSession, seconds: float = 2.0) -> None:
    """Lets Spark delete shuffle files of plans that nothing refers to: it does so when the driver collects garbage."""
    if time.monotonic() - _freed[0] >= seconds:
        _freed[0] = time.monotonic()
        gc.collect()
        spark._jvm.System.gc()


def _tables() -> list[str]:
    """Tables that this thread has written and not deleted."""
    if not hasattr(_made, "paths"):
        _made.paths = []
    return _made.paths


def written(df: DataFrame, *, partition_by: Iterable[str] = (), parts: int | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder: it cuts the lineage, and it survives lost executors. parts: files at most, where few rows are known to come.

    The table goes with ``drop``, or with the application that made it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/ledgerlight-{uuid.uuid4().hex}"
    (df.coalesce(parts) if parts else df).write.parquet(path, partitionBy=list(partition_by) or None)
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)
    _tables().append(path)
    schema = df.schema
    del df
    free(spark)
    out = spark.read.schema(schema).parquet(path)
    out.__dict__["_table"] = path
    return out


def drop(*frames: DataFrame) -> None:
    """Deletes tables made by ``written`` that nothing reads any more."""
    for df in frames:
        path = df.__dict__.pop("_table", None)
        if path:
            delete(df.sparkSession, [path])
            if path in _tables():
                _tables().remove(path)


def taken(since: int) -> list[str]:
    """Tables that ``written`` has made since it had made so many; the caller answers for them from now on."""
    out = _tables()[since:]
    del _tables()[since:]
    return out


def n_written() -> int:
    return len(_tables())


def _at(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, there as a whole or not at all."""
    fs, p = _at(spark, path)
    _, part = _at(spark, f"{path}.{uuid.uuid4().hex}.part")
    stream = fs.create(part, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    fs.delete(p, False)
    if not fs.rename(part, p):
        raise OSError(f"can't write {path}")


def get_text(spark: SparkSession, path: str) -> str | None:
    fs, p = _at(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in a folder."""
    fs, p = _at(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()] if fs.exists(p) else []


def delete(spark: SparkSession, paths: list[str]) -> None:
    """Deletes tables that nothing unread depends on."""
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): connected components of undirected edges by alternating large-star and small-star steps.

    component is the smallest node. Nodes without edges don't appear. Each round is an aggregation with map-side
    partial minima and a join of two written tables, which Spark can split where a node is hot. Tables have a file for each EDGES edges, so
    that rounds over few edges are few tasks, whatever the number of shuffle partitions.
    """

    def seen(rows: DataFrame):
        """Tells tables of different rows apart: their number, and a sum of hashes that their order doesn't change."""
        return tuple(rows.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first())

    pairs = written(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    before = seen(pairs)
    few = lambda df, n: written(df, parts=-(-2 * n // EDGES) or 1)  # noqa: E731  at most both ends of each edge
    while True:
        both = pairs.select("u", "v").union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = few(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), before[0])
        large = few(both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), before[0])
        drop(low, pairs)
        low = few(large.groupBy("u").agg(F.min("v").alias("m")), before[0])
        small = large.join(low, "u")
        small = few(small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), before[0])
        drop(low, large)
        now = seen(small)
        if now == before:
            break
        pairs, before = small, now
    low = small.groupBy("u").agg(F.min("v").alias("component"))
    out = few(low.select(F.col("u").alias("node"), "component").union(low.select(F.col("component").alias("node"), "component").distinct()), before[0])
    drop(small)
    return out
