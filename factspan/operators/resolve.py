"""Resolving a metric name to the rows of a table: tiered, ranked, with data.

Candidates come from an inverted index of short character grams instead of a
nested loop: a string can only contain another one if it contains the other's
first three characters, so containment is an equi-join on these plus a check.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factspan.functions import labels as L
from factspan.functions.periods import ordinal

_GRAM = 3


def _grams(text: Column) -> Column:
    """Every string of one to three characters in a text."""
    n = F.length(text)
    at = lambda k: F.when(n >= k, F.transform(F.sequence(F.lit(1), n - (k - 1)), lambda i: F.substr(text, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(*[at(k) for k in range(1, _GRAM + 1)]))


def contained(needles: DataFrame, haystacks: DataFrame, needle: str, haystack: str, on: list[str] | None = None) -> DataFrame:
    """Pairs of rows where ``needle`` occurs in ``haystack`` (and ``on`` agrees), by equi-join on grams. Empty needles match nothing."""
    on = on or []
    n = needles.where(F.length(needle) > 0).withColumn("_gram", F.substr(F.col(needle), F.lit(1), F.lit(_GRAM)))
    h = haystacks.withColumn("_gram", F.explode(_grams(F.col(haystack))))
    return n.join(h, [*on, "_gram"]).where(F.contains(F.col(haystack), F.col(needle))).drop("_gram")


def _scope(queries: DataFrame) -> list[str]:
    return ["source_id"] if "source_id" in queries.columns else []


def match_tiers(queries: DataFrame, labels: DataFrame) -> DataFrame:
    """``(source_id, query, label, row_ord, tier, key1, key2)`` for every candidate of every query.

    ``queries``: ``(query)``, asked of every source, or ``(source_id, query)``;
    ``labels``: ``(source_id, row_label, row_ord, title)``, one row for each
    label of a source. Tiers: 1 canonical
    equality; 2 the label contains the query, shortest first; 3 the member of a
    qualified label occurs in the query, most shared words first, then longest
    member; 4 the query contains the label and is about it, longest first.
    Candidates that drop the qualifier of a qualified query are left out.
    """
    on = _scope(queries)
    q = queries.select(*on, "query").distinct().withColumn("q", L.canonical(F.col("query")))
    lab = labels.select("source_id", F.col("row_label").alias("label"), "row_ord", "title").withColumn("l", L.canonical(F.col("label")))
    none = F.lit(0)
    inside = contained(q, lab, "q", "l", on)
    size = F.length("label")
    same = F.col("q") == F.col("l")  # equality is containment too; only its better tier counts
    inside = inside.withColumns({"tier": F.when(same, 1).otherwise(2), "key1": F.when(same, 0).otherwise(size), "key2": none})
    members = lab.where(L.is_qualified(F.col("label"))).withColumn("m", L.canonical(L.leaf(F.col("label"))))
    shared = F.size(F.array_intersect(L.significant_words(F.col("label")), L.significant_words(F.col("query"))))
    member = contained(members, q, "m", "q", on).withColumns({"tier": F.lit(3), "key1": -shared, "key2": -F.length("m")})
    about = L.query_is_about(F.col("query"), F.col("label"), F.col("title"))
    within = contained(lab, q, "l", "q", on).where(about).withColumns({"tier": F.lit(4), "key1": -size, "key2": none})
    cols = ["source_id", "query", "label", "row_ord", "tier", "key1", "key2"]
    every = inside.select(*cols).unionByName(member.select(*cols)).unionByName(within.select(*cols))
    return every.where(L.qualifier_kept(F.col("query"), F.col("label")))


def total_rows(queries: DataFrame, labels: DataFrame) -> DataFrame:
    """The total rows of tables whose title names a query's subject, as candidates of the last tier.

    A title that covers every word of a query covers its first one, so the
    candidates come from an equi-join on that word.
    """
    on = _scope(queries)
    words = F.array_sort(L.subject_words(F.col("query")))
    q = queries.select(*on, "query").distinct().withColumn("_word", F.get(words, F.lit(0))).where("_word is not null")
    rows = labels.where(F.lower(F.trim("row_label")).isin(L.TOTAL_ROWS)).withColumn("_word", F.explode(L.covered_words(F.col("title"))))
    found = q.join(rows, [*on, "_word"]).where(L.query_names_subject(F.col("query"), F.col("title")))
    return found.select("source_id", "query", F.col("row_label").alias("label"), "row_ord", F.lit(5).alias("tier"), F.lit(0).alias("key1"), F.lit(0).alias("key2"))


def same_label(queries: DataFrame, labels: DataFrame) -> DataFrame:
    """The very label that is asked for, as a candidate before all others."""
    on = _scope(queries)
    same = queries.select(*on, "query").distinct().join(labels.select("source_id", F.col("row_label").alias("query"), "row_ord"), [*on, "query"])
    return same.select("source_id", "query", F.col("query").alias("label"), "row_ord", F.lit(0).alias("tier"), F.lit(0).alias("key1"), F.lit(0).alias("key2"))


def candidates(queries: DataFrame, labels: DataFrame) -> DataFrame:
    """All candidates in order of preference: the very label (tier 0), the tiers, and total rows."""
    return same_label(queries, labels).unionByName(match_tiers(queries, labels)).unionByName(total_rows(queries, labels))


def _best(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def first_wins(facts: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """Of rows with equal keys the first in order, by partial aggregation rather than a sort of each key."""
    rest = [c for c in facts.columns if c not in keys]
    return facts.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_row")).select(*keys, "_row.*")


def resolve_labels(queries: DataFrame, labels: DataFrame) -> DataFrame:
    """``(source_id, query, label, tier)``: the best label of each query in a source, whatever data it has."""
    best = _best(candidates(queries, labels), ["source_id", "query"], ["tier", "key1", "key2", "row_ord", "label"])
    return best.select("source_id", "query", "label", "tier")


def lookup_exact(points: DataFrame, facts: DataFrame) -> DataFrame:
    """Points with the value of their very label and period, or null: a left equi-join."""
    f = facts.select("source_id", F.col("row_label").alias("query"), "year", "period", "value")
    return points.join(f, ["source_id", "query", "year", "period"], "left")


def lookup_period(points: DataFrame, labels: DataFrame, facts: DataFrame) -> DataFrame:
    """``(source_id, query, year, period, label, value)`` of points that some label with data at the period answers.

    Points without a ``source_id`` are asked of every source.
    """
    keys = [*_scope(points), "query", "year", "period"]
    p = points.select(*keys).distinct()
    f = facts.where(F.col("year").isNotNull() & F.col("value").isNotNull()).select("source_id", F.col("row_label").alias("label"), "year", "period", "value")
    found = p.join(candidates(p, labels), [*_scope(points), "query"]).join(f, ["source_id", "label", "year", "period"])
    keys = ["source_id", "query", "year", "period"]
    return _best(found, keys, ["tier", "key1", "key2", "row_ord", "label"]).select(*keys, "label", "value")


def lookup_cell(points: DataFrame, labels: DataFrame, facts: DataFrame) -> DataFrame:
    """``(source_id, query, col_query, label, col_label, value)`` of categorical points, matched on both axes.

    Row candidates are tried in order of preference; a column only counts where
    the row has a value in it. There is no fallback to total rows, and columns
    have no qualifier rule. Points without a ``source_id`` are asked of every source.
    """
    on = _scope(points)
    p = points.select(*on, "query", "col_query").distinct()
    f = facts.where(F.col("col_label").isNotNull() & F.col("value").isNotNull()).select("source_id", F.col("row_label").alias("label"), "col_label", "value")
    title = labels.select("source_id", "title").distinct()
    cols = f.select("source_id", "col_label").distinct().join(title, "source_id")
    cols = cols.select("source_id", F.col("col_label").alias("row_label"), F.dense_rank().over(Window.partitionBy("source_id").orderBy("col_label")).alias("row_ord"), "title")
    rq = p.select(*on, "query").distinct()
    cq = p.select(*on, F.col("col_query").alias("query")).distinct()
    rows = same_label(rq, labels).unionByName(match_tiers(rq, labels))
    found_cols = same_label(cq, cols).unionByName(match_tiers(cq, cols))
    found_cols = found_cols.select("source_id", F.col("query").alias("col_query"), F.col("label").alias("col_label"), F.col("tier").alias("c_tier"), F.col("key1").alias("c1"), F.col("key2").alias("c2"), F.col("row_ord").alias("c_ord"))
    found = p.join(rows, [*on, "query"]).join(found_cols, ["source_id", "col_query"]).join(f, ["source_id", "label", "col_label"])
    exact_first = F.when((F.col("tier") == 0) & (F.col("c_tier") == 0), 0).otherwise(1)
    found = found.withColumn("_exact", exact_first)
    keys = ["source_id", "query", "col_query"]
    return _best(found, keys, ["_exact", "tier", "key1", "key2", "row_ord", "c_tier", "c1", "c2", "c_ord"]).select(*keys, "label", "col_label", "value")


def available_periods(queries: DataFrame, labels: DataFrame, facts: DataFrame) -> DataFrame:
    """``(source_id, query, label, year, period)``: periods of the label that best answers each query."""
    best = resolve_labels(queries, labels)
    f = facts.where("year is not null").select("source_id", F.col("row_label").alias("label"), "year", "period").distinct()
    return best.join(f, ["source_id", "label"]).select("source_id", "query", "label", "year", "period")


def previous_period(points: DataFrame, facts: DataFrame) -> DataFrame:
    """Points ``(source_id, label, year, period)`` with the value of the period before in the same series, months and quarters apart."""
    series = facts.where("year is not null").withColumn("freq", F.when(F.col("period").startswith("Q"), "Q").otherwise("M"))
    w = Window.partitionBy("source_id", "row_label", "freq").orderBy("year", ordinal(F.col("period")))
    held = series.select("source_id", F.col("row_label").alias("label"), "year", "period", *[F.lag(c).over(w).alias(f"prev_{c}") for c in ("year", "period", "value")])
    return points.join(held, ["source_id", "label", "year", "period"], "left")
