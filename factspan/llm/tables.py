"""Shared storage for intermediate tables, and connected components.

Intermediate results are written as Parquet below ``spark.checkpoint.dir`` and
read back, so a lost executor never takes the only copy with it.
"""

from __future__ import annotations

import gc
import os
import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Whether a query's shuffle files are deleted as it ends.
_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _cleaning_up(spark: SparkSession):
    before = spark.conf.get(_CLEAN_UP, None)
    spark.conf.set(_CLEAN_UP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEAN_UP) if before is None else spark.conf.set(_CLEAN_UP, before)


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``; a temporary one only in local mode, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (found or os.path.join(tempfile.gettempdir(), "factspan-checkpoints")).rstrip("/")


def _hadoop(spark: SparkSession, where: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def written(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and return the table that was written; the shuffles of the write go with it.

    The table is deleted by ``discard``, or else when the driver's JVM ends,
    whether the write succeeded or not.
    """
    spark = df.sparkSession
    folder = f"{checkpoint_dir(spark)}/factspan-{tag}-{uuid.uuid4().hex}"
    fs, path = _hadoop(spark, folder)
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    with _cleaning_up(spark):
        df.write.parquet(f"{folder}/table")
    out = spark.read.schema(df.schema).parquet(f"{folder}/table")
    out._written_to = folder
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables made by ``written`` that nothing reads any more, and let finished shuffles be cleaned up."""
    for df in tables:
        fs, path = _hadoop(df.sparkSession, df._written_to)
        fs.delete(path, True)
        fs.cancelDeleteOnExit(path)
    if tables:
        release(tables[0].sparkSession)


def release(spark: SparkSession) -> None:
    """Let the driver clean up the shuffles of finished steps, which it does as their plans are collected."""
    gc.collect()
    spark._jvm.System.gc()


def settled(df: DataFrame) -> DataFrame:
    """Compute ``df`` into a table that a result still reads; it stays until the driver's JVM ends."""
    return written(df, "result")


def without(df: DataFrame, text: str, *names: str) -> DataFrame:
    """``df`` less the columns that a new column of one of ``names`` replaces; ``text`` cannot be one of them."""
    lost = [c for c in df.columns if c.lower() in {n.lower() for n in names}]
    if text in lost:
        raise ValueError(f"the new column would replace the text: {text}")
    return df.drop(*lost)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that ``df`` does not have, one for each of ``names``."""
    have = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in have:
            n = "_" + n
        have.add(n.lower())
        out.append(n)
    return out


def _mark(df: DataFrame, a: Column, b: Column) -> tuple:
    row = df.agg(F.count("*"), F.sum(F.xxhash64(a, b).cast("decimal(38,0)"))).first()
    return row[0], row[1]


def connected_components(edges: DataFrame, src: str = "a", dst: str = "b") -> DataFrame:
    """Components of an undirected graph as ``(node, component)``, component = smallest node id.

    Alternates large-star and small-star rounds until the edge set no longer
    changes; each round is two aggregations and two joins on node ids, and its
    result is a written table. Null ends and self loops are ignored; nodes
    without a link are not returned. An empty edge set gives an empty result.
    """
    e = (
        edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v"))
        .where("u > v")
        .distinct()
    )
    e = written(e, "cc")
    before = _mark(e, F.col("u"), F.col("v"))
    while before[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")).repartition("u")  # dealt anew, so that a hub's share of the join can be split
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m")).repartition("u")
        joined = large.join(low, "u")
        small = (
            joined.where("v <> m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low.select("u", F.col("m").alias("v")))
            .distinct()
        )
        old, e = e, written(small, "cc")
        discard(old)
        now = _mark(e, F.col("u"), F.col("v"))
        if now == before:
            break
        before = now
    stars = e.groupBy("u").agg(F.min("v").alias("component"))
    roots = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    out = settled(stars.select(F.col("u").alias("node"), "component").unionByName(roots))
    discard(e)
    return out
