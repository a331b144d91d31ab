"""Claim operations over resolved points, ranked over sources.

Tables (all DataFrames):

* ``sources(source_id, source_ord, name, origin, title, unit, axis)`` with
  origin ``pdf`` or ``excel`` and axis ``temporal`` or ``categorical``;
* ``facts(source_id, row_label, row_ord, year, period, col_label, value)``;
* ``claims(claim_id, operation, claimed_value, unit, quote, points)`` with
  ``points array<struct<ord, metric_label, year, period, col_label>>``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factspan.functions import labels as L
from factspan.functions import numbers as N
from factspan.functions.periods import ordinal
from factspan.operators.resolve import lookup_cell, lookup_period

LEVEL = ["value", "average", "sum", "diff"]
TREND = ["is_increasing", "is_decreasing", "is_stable"]
THRESHOLD = ["above_threshold", "below_threshold"]
TEMPORAL_ONLY = ["yoy_growth", *TREND]
OPERATIONS = ["value", "yoy_growth", "average", "sum", "diff", "ratio", *TREND, *THRESHOLD]
#: Scores closer than this tie.
TIE = 1e-9
#: Fixed value: wording of an unnamed subset.
SUBSET = (
    r"(?iU)\b(?:beberapa|sejumlah|banyak|sebagian(?:\s+besar)?)\s+(?:\w+\s+)?(?:kota|daerah|wilayah|provinsi|kelompok|responden|komponen)\b"
    r"|\b(?:kota|daerah|wilayah|kelompok|golongan|tingkat\s+pendidikan)\s+(?:\w+\s+)?lain(?:nya)?\b"
)


def labels_of(facts: DataFrame, sources: DataFrame) -> DataFrame:
    """``(source_id, row_label, row_ord, title)``, one row for each label."""
    rows = facts.groupBy("source_id", "row_label").agg(F.min("row_ord").alias("row_ord"))
    return rows.join(sources.select("source_id", "title"), "source_id")


def deduplicate(claims: DataFrame, order: str = "claim_ord") -> DataFrame:
    """Of claims with one operation and the same points, the first; the claimed value is not compared."""
    w = Window.partitionBy("operation", "points").orderBy(order)
    return claims.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def guard(claims: DataFrame) -> DataFrame:
    """Add ``guard``: why a claim cannot be settled by reading rows, or null."""
    op, quote = F.col("operation"), F.coalesce(F.col("quote"), F.lit(""))
    categorical = op.isin(TEMPORAL_ONLY) & F.exists("points", lambda p: p["col_label"].isNotNull())
    named = F.exists("points", lambda p: L.quote_names_member(p["metric_label"], quote))
    subset = op.isin(TREND + THRESHOLD) & quote.rlike(SUBSET) & ~named
    metrics = F.size(F.array_distinct(F.transform("points", lambda p: F.lower(F.trim(p["metric_label"])))))
    return claims.withColumn("guard", F.when(categorical, "needs a time series").when(subset, "unnamed subset").when(op.isin(TREND) & (metrics > 1), "several metrics in a trend"))


def resolve(claims: DataFrame, sources: DataFrame, facts: DataFrame) -> DataFrame:
    """One row for each claim and source that answers all of its points: ``found`` in order of points, and ``score``."""
    some = answered(claims, sources, facts)
    return some.where(F.size("found") == F.col("n")).drop("n")


def answered(claims: DataFrame, sources: DataFrame, facts: DataFrame) -> DataFrame:
    """One row for each claim and source that answers some of its ``n`` points: ``found`` in order of points, and ``score``.

    Points with a column are looked up in categorical sources only, the others
    in temporal ones; equal points of different claims are looked up once.
    """
    labels = labels_of(facts, sources)
    points = claims.where("guard is null").select("claim_id", F.size("points").alias("n"), F.explode("points").alias("p")).select("claim_id", "n", "p.*")
    dated = points.where("col_label is null")
    placed = points.where("col_label is not null")
    of = lambda axis: labels.join(sources.where(F.col("axis") == axis).select("source_id"), "source_id", "left_semi")
    key = ["query", "year", "period"]
    by_period = lookup_period(dated.select(F.col("metric_label").alias("query"), "year", "period"), of("temporal"), facts)
    by_cell = lookup_cell(placed.select(F.col("metric_label").alias("query"), F.col("col_label").alias("col_query")), of("categorical"), facts)
    a = dated.withColumnRenamed("metric_label", "query").join(by_period, key)
    a = a.select("claim_id", "n", "ord", "source_id", "query", "label", "year", "period", F.lit(None).cast("string").alias("col_label"), "value")
    b = placed.select("claim_id", "n", "ord", F.col("metric_label").alias("query"), F.col("col_label").alias("col_query")).join(by_cell, ["query", "col_query"])
    b = b.select("claim_id", "n", "ord", "source_id", "query", F.concat_ws(" — ", "label", "col_label").alias("label"), F.lit(None).cast("int").alias("year"), F.lit(None).cast("string").alias("period"), "col_label", "value")
    every = a.unionByName(b).withColumn("score", L.label_score(F.col("query"), F.col("label")))
    item = F.struct("ord", "label", "year", "period", "col_label", "value")
    return every.groupBy("claim_id", "source_id").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(item)).alias("found"), F.avg("score").alias("score"))


def unanswered(claims: DataFrame, some: DataFrame, sources: DataFrame) -> DataFrame:
    """``(claim_id, missing)``: the points that no source answers in one, of the source that lacks the fewest, described.

    ``some`` as ``answered`` gives it; of equally good sources the first counts,
    and where no source answers any point all are missing.
    """
    near = some.join(sources.select("source_id", "source_ord"), "source_id").withColumn("lacks", F.col("n") - F.size("found"))
    near = near.groupBy("claim_id").agg(F.min_by(F.transform("found", lambda p: p["ord"]), F.struct("lacks", "source_ord")).alias("have"))
    said = lambda p: F.when(p["col_label"].isNotNull(), F.concat(p["metric_label"], F.lit(" ("), p["col_label"], F.lit(")"))).otherwise(F.concat_ws(" ", p["metric_label"], p["period"], p["year"].cast("string")))
    points = claims.select("claim_id", "points").join(near, "claim_id", "left")
    lack = F.filter("points", lambda p: ~F.coalesce(F.array_contains("have", p["ord"]), F.lit(False)))
    return points.select("claim_id", F.array_join(F.transform(lack, said), ", ").alias("missing"))


def with_units(answers: DataFrame, claims: DataFrame, sources: DataFrame) -> DataFrame:
    """Add claim, source, ``factor`` and ``comparable``; the factor is null where the unit cannot be converted."""
    df = answers.join(claims.select("claim_id", "operation", "claimed_value", "unit"), "claim_id").join(
        sources.select("source_id", "source_ord", "name", "origin", F.col("unit").alias("table_unit"), "axis"), "source_id"
    )
    column = F.get(F.filter(F.transform("found", lambda p: N.column_unit(p["col_label"])), lambda u: u.isNotNull()), F.lit(0))
    table = F.when(F.col("axis") == "categorical", F.coalesce(column, F.col("table_unit"))).otherwise(F.col("table_unit"))
    df = df.withColumn("level_unit", table)
    factor = N.unit_factor(F.col("unit"), F.col("level_unit"))
    scaleless = (F.coalesce(F.col("level_unit"), F.lit("")) == "") | N.parse_unit(F.col("level_unit")).isNull()
    own = N.parse_unit(F.col("unit"))
    level = F.col("operation").isin(LEVEL)
    df = df.withColumns({"_factor": factor, "_raw": factor.isNull() & scaleless, "_own": own})
    df = df.withColumn("factor", F.when(~level, 1.0).otherwise(F.coalesce("_factor", F.when(F.col("_raw"), F.coalesce(F.col("_own.scale"), F.lit(1.0))))))
    df = df.withColumn("comparable", ~(level & F.col("_raw")) | F.col("_own").isNull())
    return df.drop("_factor", "_raw", "_own")


def _monotone(values: Column, holds) -> Column:
    """Whether every value and the next satisfy ``holds``."""
    pairs = F.zip_with(F.slice(values, 1, F.size(values) - 1), F.slice(values, 2, F.size(values) - 1), holds)
    return F.forall(pairs, lambda x: x)


def compute(df: DataFrame, facts: DataFrame) -> DataFrame:
    """Add ``verdict``, ``computed_value``, ``delta`` and ``operation_out`` to answers with units.

    The year before, for growth, and the period before, for a trend that names
    one period, come from the very row that answered; no other row stands in. Values are rounded to four places before they are compared.
    """
    first = F.get(F.col("found"), F.lit(0))
    df = df.withColumns({"label0": first["label"], "year0": first["year"], "period0": first["period"], "value0": first["value"]})
    freq = F.when(F.col("period").startswith("Q"), "Q").otherwise("M")
    before = F.lag("value").over(Window.partitionBy("source_id", "row_label", freq).orderBy("year", ordinal(F.col("period"))))
    past = F.lag(F.struct("year", "value")).over(Window.partitionBy("source_id", "row_label", "period").orderBy("year"))
    held = facts.where("year is not null").withColumns({"before": before, "past": past})
    held = held.select("source_id", F.col("row_label").alias("label0"), F.col("year").alias("year0"), F.col("period").alias("period0"), "before", F.when(F.col("past.year") == F.col("year") - 1, F.col("past.value")).alias("prior"))
    df = df.join(held, ["source_id", "label0", "year0", "period0"], "left")

    op, claimed = F.col("operation"), F.col("claimed_value")
    values = F.transform("found", lambda p: p["value"])
    converted = F.transform("found", lambda p: p["value"] / F.col("factor"))
    df = df.withColumns({"values": F.when((F.size("found") == 1) & F.col("before").isNotNull() & op.isin(TREND), F.concat(F.array("before"), values)).otherwise(values), "converted": converted})
    total = F.aggregate("converted", F.lit(0.0), lambda a, x: a + x)
    last, start = F.element_at("converted", -1), F.get("converted", F.lit(0))
    a, b = F.get("values", F.lit(0)), F.get("values", F.lit(1))
    growth = F.when(N.is_growth_unit(F.col("table_unit")), F.col("value0")).otherwise(F.try_divide(F.col("value0") - F.col("prior"), F.abs("prior")) * 100)
    share = F.try_divide(a, b) * F.when(F.coalesce(F.contains(F.lower("unit"), F.lit("persen")), F.lit(False)), 100.0).otherwise(1.0)
    number = (
        F.when(op == "value", start)
        .when(op == "yoy_growth", growth)
        .when(op == "average", total / F.size("converted"))
        .when(op == "sum", total)
        .when(op == "diff", last - start)
        .when((op == "ratio") & (F.size("values") == 2), share)
        .when(op.isin(THRESHOLD), F.col("value0"))
    )
    df = df.withColumn("number", F.round(number, 4))
    level = F.get(F.filter("converted", lambda v: F.abs(claimed - v) <= N.TOLERANCE), F.lit(0))
    reread = (op == "diff") & (N.verdict(claimed, F.col("number")) == "Refuted") & level.isNotNull()
    df = df.withColumns({"reread": F.coalesce(reread, F.lit(False)), "level": F.round(level, 4)})
    df = df.withColumn("computed_value", F.when(op.isin(TREND), F.lit(None)).when(F.col("reread"), F.col("level")).otherwise(F.col("number")))
    trend = F.when(op == "is_increasing", _monotone(F.col("values"), lambda x, y: y >= x)).when(op == "is_decreasing", _monotone(F.col("values"), lambda x, y: y <= x)).otherwise(_monotone(F.col("values"), lambda x, y: F.abs(y - x) <= N.stable_band(x, y)))
    verdict = (
        F.when(op.isin(TREND), F.when(F.size("values") < 2, "Inconclusive").when(trend, "Entailed").otherwise("Refuted"))
        .when(F.col("computed_value").isNull() | claimed.isNull(), "Inconclusive")
        .when(op == "above_threshold", F.when(F.col("computed_value") > claimed, "Entailed").otherwise("Refuted"))
        .when(op == "below_threshold", F.when(F.col("computed_value") < claimed, "Entailed").otherwise("Refuted"))
        .otherwise(N.verdict(claimed, F.col("computed_value")))
    )
    return df.withColumns(
        {
            "verdict": verdict,
            "delta": F.when(~op.isin(TREND + THRESHOLD), N.delta(claimed, F.col("computed_value"))),
            "operation_out": F.when(F.col("reread"), "value").otherwise(op),
        }
    ).drop("label0", "year0", "period0", "value0", "prior", "before", "number", "reread", "level")


def choose(answers: DataFrame) -> DataFrame:
    """One row for each claim: its ``answers`` by score and then source order, those ``tied`` with the best, and the ``head``.

    The head is the first conclusive one of the tied answers, or else the
    best. A claim has at most one answer for each table, so the arrays are
    small, and all of it is one aggregation.
    """
    cols = ["name", "origin", "operation_out", "verdict", "computed_value", "delta", "score", "comparable", "table_unit"]
    item = F.struct((-F.col("score")).alias("k"), "source_ord", *cols)
    df = answers.groupBy("claim_id").agg(F.array_sort(F.collect_list(item)).alias("answers"))
    best = F.get("answers", F.lit(0))["score"]
    df = df.withColumn("tied", F.filter("answers", lambda a: a["score"] >= best - TIE))
    return df.withColumn("head", F.coalesce(F.get(F.filter("tied", lambda a: a["verdict"] != "Inconclusive"), F.lit(0)), F.get("answers", F.lit(0))))


def conflict(chosen: DataFrame) -> DataFrame:
    """Add ``conflict``: kind and source of the first tied answer that disagrees with the head, or null."""
    h = F.col("head")

    def disagrees(a: Column) -> Column:
        clear = (a["verdict"] != "Inconclusive") & (h["verdict"] != "Inconclusive") & a["comparable"] & h["comparable"]
        numbers = a["computed_value"].isNotNull() & h["computed_value"].isNotNull()
        differs = F.when(numbers, F.abs(a["computed_value"] - h["computed_value"]) > N.TOLERANCE).otherwise(a["verdict"] != h["verdict"])
        return (a["source_ord"] != h["source_ord"]) & clear & differs & N.units_comparable(h["table_unit"], a["table_unit"])

    kind = lambda a: F.when((a["origin"] == "pdf") & (h["origin"] == "pdf"), "internal").otherwise("cross")
    return chosen.withColumn("conflict", F.get(F.transform(F.filter("tied", disagrees), lambda a: F.struct(kind(a).alias("kind"), a["name"].alias("name"))), F.lit(0)))


def evaluate(claims: DataFrame, sources: DataFrame, facts: DataFrame) -> DataFrame:
    """One verdict for each claim: ``(claim_id, operation, verdict, computed_value, delta, matched_source, score, n_sources, source_conflict, conflict_source, reason)``.

    The reason of a claim without an answer is its guard, or that the first
    source with all its points has another unit, or the points that are missing.
    """
    guarded = guard(claims)
    some = answered(guarded, sources, facts)
    priced = with_units(some.where(F.size("found") == F.col("n")).drop("n"), guarded, sources)
    odd = F.concat_ws(" ", F.lit("unit"), F.coalesce("unit", F.lit("(none)")), F.lit("does not convert to"), F.coalesce("level_unit", F.lit("(none)")), F.lit("of"), "name")
    units = priced.where("factor is null").groupBy("claim_id").agg(F.min_by(odd, "source_ord").alias("unit_reason"))
    chosen = conflict(choose(compute(priced.where("factor is not null"), facts)))
    out = guarded.select("claim_id", "operation", "guard").join(chosen, "claim_id", "left")
    out = out.join(units, "claim_id", "left").join(unanswered(guarded, some, sources), "claim_id", "left")
    return out.select(
        "claim_id",
        F.coalesce("head.operation_out", "operation").alias("operation"),
        F.coalesce("head.verdict", F.lit("Inconclusive")).alias("verdict"),
        "head.computed_value",
        "head.delta",
        F.col("head.name").alias("matched_source"),
        "head.score",
        F.coalesce(F.size("tied"), F.lit(0)).alias("n_sources"),
        F.col("conflict.kind").alias("source_conflict"),
        F.col("conflict.name").alias("conflict_source"),
        F.coalesce("guard", F.when(F.col("head").isNull(), F.coalesce("unit_reason", F.concat(F.lit("no source answers: "), "missing")))).alias("reason"),
    )


def verdict_counts(results: DataFrame) -> DataFrame:
    return results.groupBy("verdict").agg(F.count("*").alias("n"))
