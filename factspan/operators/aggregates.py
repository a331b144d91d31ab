"""Which rows of a grid are totals of the others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: wording that names a total or a mean.
NAMES = r"(?i)jumlah|grand\s*total|sub\s*-?\s*total|\btotal\b|rata-?rata|rata\s*2|average|\bmean\b"
KEYWORD, STYLE, NUMERIC, LAST = 0.5, 0.2, 0.6, 0.05
ABSOLUTE, RELATIVE = 0.01, 0.005


def sum_of_others(values: DataFrame) -> DataFrame:
    """``(source_id, row_label, is_sum)``: whether every column of a row is the sum of all other rows.

    ``values(source_id, row_label, col_label, value)``. A column counts where
    all rows of the sheet have a value; at least one must, and a sheet needs
    three rows.
    """
    rows = values.groupBy("source_id").agg(F.count_distinct("row_label").alias("n_rows"))
    col = Window.partitionBy("source_id", "col_label")
    v = values.join(rows, "source_id")
    v = v.withColumns({"others": F.sum("value").over(col) - F.col("value"), "whole": F.count("value").over(col) == F.col("n_rows")})
    near = F.abs(F.col("value") - F.col("others")) <= F.greatest(F.lit(ABSOLUTE), F.lit(RELATIVE) * F.abs("value"))
    hit = v.groupBy("source_id", "row_label").agg(F.bool_and(near | ~F.col("whole")).alias("near"), F.bool_or("whole").alias("any"), F.max("n_rows").alias("n_rows"))
    return hit.select("source_id", "row_label", (F.col("near") & F.col("any") & (F.col("n_rows") >= 3)).alias("is_sum"))


def has_keyword(label: Column) -> Column:
    return label.rlike(NAMES)


def score(keyword: Column, style: Column, numeric: Column, last: Column) -> Column:
    """How likely a row is an aggregate, from 0 to 1."""
    part = lambda flag, w: F.when(flag, w).otherwise(0.0)
    return F.round(F.least(F.lit(1.0), part(keyword, KEYWORD) + part(style, STYLE) + part(numeric, NUMERIC) + part(last, LAST)), 4)


def classify(value: Column) -> Column:
    return F.when(value >= 0.7, "aggregate").when(value < 0.3, "not_aggregate").otherwise("ambiguous")
