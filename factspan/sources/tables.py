"""Tables: catalog, pages, hints, and the fact store."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(spark: SparkSession, sf_dir: str, names: list[str] | None = None) -> None:
    """Temporary views of the tables in a folder."""
    for n in names or TABLES:
        read(spark, sf_dir, n).createOrReplaceTempView(n)


def list_tables(spark: SparkSession) -> DataFrame:
    """Names of tables and views, in order."""
    names = sorted(t.name for t in spark.catalog.listTables())
    return spark.createDataFrame([(n,) for n in names], "table_name string")


def page(df: DataFrame, key: list[str], limit: int = 200, offset: int = 0) -> DataFrame:
    """A page of rows in the order of a key; limit from 1 to 1000, offset from 0."""
    return df.orderBy(*key).offset(max(0, offset)).limit(min(1000, max(1, limit)))


def value_hints(df: DataFrame, most: int = 30) -> DataFrame:
    """``(column, n_values, values)``: string columns with 1 to ``most`` distinct values. One scan for all columns."""
    names = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    if not names:
        return df.sparkSession.createDataFrame([], "`column` string, n_values bigint, `values` array<string>")
    long = df.select(F.explode(F.array(*[F.struct(F.lit(n).alias("column"), F.col(n).alias("value")) for n in names])).alias("x")).select("x.*").where("value is not null")
    counts = long.groupBy("column", "value").agg(F.lit(1).alias("one"))
    small = counts.groupBy("column").agg(F.count("*").alias("n_values")).where(F.col("n_values") <= most)
    return counts.join(small, "column").groupBy("column", "n_values").agg(F.array_sort(F.collect_list("value")).alias("values")).select("column", "n_values", "values")


def cooccurrence(df: DataFrame, columns: list[str], most: int = 60) -> DataFrame:
    """Distinct combinations of columns where there are at most ``most``; else none."""
    found = df.select(*columns).distinct().limit(most + 1)
    n = found.agg((F.count("*") <= most).alias("_few"))
    return found.join(F.broadcast(n)).where("_few").drop("_few")


def write_facts(facts: DataFrame, path: str) -> None:
    """Replace the partitions of the source files in ``facts`` and leave all others; each partition is replaced as a whole."""
    facts.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source_file").parquet(path)


def ingest_summary(facts: DataFrame) -> DataFrame:
    """Counts of facts for each source file and sheet."""
    return facts.groupBy("source_file", "sheet").agg(F.count("*").alias("n_facts"), F.count_if("is_aggregate").alias("n_aggregates"))


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def to_json(df: DataFrame) -> DataFrame:
    """One JSON text for each row."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("json"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def duplicate_ids(cases: DataFrame, key: str = "case_id") -> DataFrame:
    """Ids that occur more than once."""
    return cases.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def settled(df: DataFrame) -> DataFrame:
    """``df`` computed once for several readers: a checkpoint where the session names a folder for them, else persisted."""
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df.persist()
