"""Guarded read-only SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Functions that run code outside the engine.
FORBIDDEN_FUNCTIONS = ["reflect", "java_method", "try_reflect"]
#: Phrases of a claim that compares.
COMPARISONS = [
    "tertinggi", "terendah", "paling tinggi", "paling rendah", "paling besar", "paling kecil", "lebih tinggi", "lebih rendah", "lebih besar", "lebih kecil",
    "naik dari", "turun dari", "meningkat dari", "menurun dari", "dibandingkan", "dibanding", "ketimbang", "tren", "trend",
]


class NotReadOnly(ValueError):
    """The text is not one query, or its plan holds a command."""


def check(spark: SparkSession, query: str) -> None:
    """Raise unless every node of the parsed plan reads; a query with a write inside is a command wherever it stands."""
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(query)
    text = plan.toString()
    names = set(re.findall(r"^[\s:+\-|*()0-9]*'?([A-Z]\w+)", text, re.M))
    bad = [n for n in names if re.search(r"Command|Insert|Create|Drop|Replace|Alter|Truncate|Delete|Update|Merge|Overwrite|Append|Load|Set|Cache|Refresh|Analyze|Repair|Use|Script", n)]
    functions = [f for f in FORBIDDEN_FUNCTIONS if re.search(rf"(?i)\b{f}\s*\(", text)]
    if bad or functions:
        raise NotReadOnly(f"not a read-only query: {', '.join(sorted(bad) + functions)}")


def run(spark: SparkSession, query: str) -> DataFrame:
    """The rows of a read-only query."""
    check(spark, query)
    return spark.sql(query)


def looks_like_comparison(claim):
    return F.exists(F.array(*map(F.lit, COMPARISONS)), lambda k: F.contains(F.lower(claim), k))


def insufficient(result: DataFrame) -> DataFrame:
    """One row: whether a result has no rows, only nulls, or a single row with fewer than two values."""
    values = [F.count(c) for c in result.columns]
    total = values[0]
    for v in values[1:]:
        total = total + v
    n = result.agg(F.count("*").alias("n_rows"), total.alias("n_values"))
    return n.withColumn("insufficient", (F.col("n_rows") == 0) | (F.col("n_values") == 0) | ((F.col("n_rows") == 1) & (F.col("n_values") < 2)))
