"""Claims that name matching left open, settled by coordinates into a sheet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factspan.functions import labels as L


def point_queries(claims: DataFrame) -> DataFrame:
    """``(claim_id, ord, metric_label, year, period, col_label, prior)``: the cells a claim needs, a year earlier too for growth.

    Claims whose points mix dates and columns need none.
    """
    placed = F.exists("points", lambda p: p["col_label"].isNotNull())
    dated = F.exists("points", lambda p: p["col_label"].isNull())
    q = claims.where(~(placed & dated)).select("claim_id", "operation", F.explode("points").alias("p")).select("claim_id", "operation", "p.*")
    cols = ["claim_id", "ord", "metric_label", "year", "period", "col_label"]
    now = q.select(*cols, F.lit(False).alias("prior"))
    before = q.where("operation = 'yoy_growth' and year is not null").withColumn("year", F.col("year") - 1).select(*cols, F.lit(True).alias("prior"))
    return now.unionByName(before)


def row_words(cells: DataFrame) -> DataFrame:
    """``(source_id, r, words)``: the significant words of each row."""
    words = F.array_distinct(F.flatten(F.collect_list(L.significant_words(F.col("s_val")))))
    return cells.where("kind = 'text'").groupBy("source_id", "r").agg(words.alias("words"))


def could_match(queries: DataFrame, cells: DataFrame, titles: DataFrame) -> DataFrame:
    """Queries ``(source_id, metric_label, ...)`` that share a word with some row or the title of their sheet; a semi-join on words.

    Metrics without a significant word are kept.
    """
    q = queries.withColumn("_id", F.monotonically_increasing_id()).withColumn("_words", L.significant_words(F.col("metric_label")))
    known = cells.where("kind = 'text'").select("source_id", F.explode(L.significant_words(F.col("s_val"))).alias("_word"))
    named = titles.select("source_id", F.explode(L.significant_words(F.col("title"))).alias("_word"))
    asked = q.select("source_id", "metric_label", F.explode("_words").alias("_word")).distinct()
    hit = asked.join(known.unionByName(named).distinct(), ["source_id", "_word"], "left_semi").select("source_id", "metric_label").distinct().withColumn("_hit", F.lit(True))
    return q.join(hit, ["source_id", "metric_label"], "left").where("_hit or size(_words) = 0").drop("_id", "_words", "_hit")


def plausible(metric: Column, words: Column, title: Column) -> Column:
    """Whether a pointed row or the title shares a significant word with the metric; metrics without one pass."""
    m = L.significant_words(metric)
    return (F.size(m) == 0) | F.arrays_overlap(m, F.coalesce(words, F.array().cast("array<string>"))) | F.arrays_overlap(m, L.significant_words(F.coalesce(title, F.lit(""))))


def dereference(pointers: DataFrame, cells: DataFrame) -> DataFrame:
    """Pointers ``(source_id, r, c, ...)`` with ``value``: the number there, or null."""
    numbers = cells.where("kind = 'num'").select("source_id", "r", "c", F.col("d_val").alias("value"))
    return pointers.join(numbers, ["source_id", "r", "c"], "left")


def settle(pointers: DataFrame, queries: DataFrame, cells: DataFrame, titles: DataFrame) -> DataFrame:
    """``(claim_id, source_id, found)`` of claims for which every cell pointed at in one sheet is a number in a plausible row.

    ``pointers(claim_id, ord, prior, source_id, source_ord, r, c)``; of several
    pointers to one point in a sheet the first counts; of several sheets the first in order.
    """
    once = pointers.groupBy("claim_id", "ord", "prior", "source_id", "source_ord").agg(F.min(F.struct("r", "c")).alias("at")).select("*", "at.*").drop("at")
    p = dereference(once, cells).join(queries.select("claim_id", "ord", "prior", "metric_label"), ["claim_id", "ord", "prior"])
    p = p.join(row_words(cells), ["source_id", "r"], "left").join(titles, "source_id", "left")
    fine = p.where(F.col("value").isNotNull() & plausible(F.col("metric_label"), F.col("words"), F.col("title")))
    need = queries.groupBy("claim_id").agg(F.count("*").alias("n"))
    item = F.struct("prior", "ord", "metric_label", "value")
    whole = fine.groupBy("claim_id", "source_id", "source_ord").agg(F.array_sort(F.collect_list(item)).alias("found")).join(need, "claim_id").where(F.size("found") == F.col("n"))
    best = whole.groupBy("claim_id").agg(F.min_by(F.struct("source_id", "found"), "source_ord").alias("b"))
    return best.select("claim_id", "b.source_id", "b.found")


def suggest_tables(results: DataFrame, families: DataFrame) -> DataFrame:
    """``(family, metrics)``: table families that may hold what no source answered.

    ``results(claim_ord, metric_label, verdict, matched_source)``;
    ``families(family_ord, family, keyword)``, a fixed table; the first family with a keyword in the metric counts.
    """
    open_ = results.where("verdict = 'Inconclusive' and matched_source is null").groupBy("metric_label").agg(F.min("claim_ord").alias("at"))
    hit = open_.join(F.broadcast(families), F.contains(F.lower("metric_label"), F.col("keyword")))
    first = hit.groupBy("metric_label", "at").agg(F.min_by(F.struct("family_ord", "family"), "family_ord").alias("f"))
    metrics = F.transform(F.array_sort(F.collect_list(F.struct("at", "metric_label"))), lambda x: x["metric_label"])
    return first.groupBy(F.col("f.family").alias("family")).agg(metrics.alias("metrics"))
