"""Scores of classifiers and extractors, and matching of labels to results."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def confusion_matrix(pairs: DataFrame) -> DataFrame:
    """``(expected, predicted, n)``."""
    return pairs.groupBy("expected", "predicted").agg(F.count("*").alias("n"))


def class_metrics(pairs: DataFrame) -> DataFrame:
    """``(label, tp, fp, fn, support, precision, recall, f1)`` for every label on either side; 0 for empty denominators."""
    m = confusion_matrix(pairs)
    rows = m.select(F.col("expected").alias("label"), F.when(F.col("expected") == F.col("predicted"), F.col("n")).otherwise(0).alias("tp"), F.col("n").alias("support"), F.lit(0).alias("seen"))
    cols = m.select(F.col("predicted").alias("label"), F.lit(0).alias("tp"), F.lit(0).alias("support"), F.col("n").alias("seen"))
    g = rows.unionByName(cols).groupBy("label").agg(*[F.sum(c).alias(c) for c in ("tp", "support", "seen")])
    share = lambda a, b: F.round(F.coalesce(F.try_divide(F.col(a).cast("double"), b), F.lit(0.0)), 6)
    g = g.withColumns({"fp": F.col("seen") - F.col("tp"), "fn": F.col("support") - F.col("tp")})
    return g.select("label", "tp", "fp", "fn", "support", share("tp", F.col("seen")).alias("precision"), share("tp", F.col("support")).alias("recall"), F.round(F.coalesce(F.try_divide(2.0 * F.col("tp"), F.col("seen") + F.col("support")), F.lit(0.0)), 6).alias("f1"))


def overall_metrics(pairs: DataFrame) -> DataFrame:
    """One row: ``n``, ``accuracy`` and the macro mean of F1."""
    per = class_metrics(pairs).agg(F.round(F.avg("f1"), 6).alias("macro_f1"))
    n = pairs.agg(F.count("*").alias("n"), F.round(F.avg((F.col("expected") == F.col("predicted")).cast("double")), 6).alias("accuracy"))
    return n.join(F.broadcast(per))


def extraction_recall(labels: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """One row: labels, found labels, ``recall``, and results that no label has."""
    hit = labels.join(found.select(*keys).distinct(), keys, "left_semi")
    spurious = found.join(labels.select(*keys).distinct(), keys, "left_anti")
    n = labels.agg(F.count("*").alias("n_labels")).join(hit.agg(F.count("*").alias("n_found"))).join(spurious.agg(F.count("*").alias("n_spurious")))
    return n.withColumn("recall", F.round(F.coalesce(F.try_divide(F.col("n_found").cast("double"), F.col("n_labels")), F.lit(0.0)), 6))


def pair_off(labels: DataFrame, results: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """``(case_id, claim_id, result_id)``: results given to labels one to one, in order of labels.

    ``labels(case_id, claim_id, operation, metric, periods, claimed_value)`` and
    ``results(case_id, result_id, operation, metric, periods, claimed_value)``.
    A result fits when the operation is equal, its periods include the label's,
    and one metric, letters and digits only, contains the other. The fits are a
    join; only the choice is sequential, as a used result is gone for later
    labels: of what fits and is free, one that states the claimed value goes
    first, then the one with the least id. A case is one task; cases are single
    documents. A label without a result has a null ``result_id``.
    """
    plain = F.regexp_replace(F.lower("metric"), "[^a-z0-9]", "")
    side = lambda df, key, p: df.select("case_id", F.col(key).cast("string").alias(key), "operation", plain.alias(f"{p}_metric"), F.col("periods").cast("array<string>").alias(f"{p}_periods"), F.col("claimed_value").alias(f"{p}_value"))
    a, b = side(labels, "claim_id", "a"), side(results, "result_id", "b")
    fits = a.join(b, ["case_id", "operation"]).where((F.size(F.array_except("a_periods", "b_periods")) == 0) & (F.contains("a_metric", "b_metric") | F.contains("b_metric", "a_metric")))
    states = F.coalesce(F.abs(F.col("a_value") - F.col("b_value")) <= tolerance, F.lit(False))
    wishes = fits.groupBy("case_id", "claim_id").agg(F.array_sort(F.collect_list(F.struct((~states).alias("k"), "result_id"))).alias("w"))
    wishes = wishes.select("case_id", "claim_id", F.transform("w", lambda x: x["result_id"]).alias("w"))

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        used: set[str] = set()
        got = []
        for wish in pdf.sort_values("claim_id")["w"]:
            got.append(next((r for r in wish if r not in used), None))
            used.add(got[-1])
        return pdf.sort_values("claim_id").assign(result_id=got)[["case_id", "claim_id", "result_id"]]

    kind = labels.schema["case_id"].dataType.simpleString()
    chosen = wishes.groupBy("case_id").applyInPandas(choose, f"case_id {kind}, claim_id string, result_id string")
    return a.select("case_id", "claim_id").join(chosen, ["case_id", "claim_id"], "left")


def longest_chain(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs that ascend on both sides, by patience sorting: piles of least ends, found by bisection."""
    from bisect import bisect_left

    tops: list[int] = []
    last: list[int] = []
    back: list[int] = []
    pairs = sorted(pairs, key=lambda p: (p[0], -p[1]))  # of one left place, at most one pair can be in a run
    for k, (_, j) in enumerate(pairs):
        pile = bisect_left(tops, j)
        tops[pile : pile + 1] = [j]
        last[pile : pile + 1] = [k]
        back.append(last[pile - 1] if pile else -1)
    out, k = [], last[-1] if last else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def sequence_pairs(rows: DataFrame, ratio: float = 0.85, prefix: int = 12) -> DataFrame:
    """``(page_id, a_ord, b_ord)``: the longest order-preserving matching of two row sequences of a page.

    ``rows(page_id, side, ord, label)`` with side ``a`` or ``b``. Labels are
    equal when their letters and digits are, or, where neither has an exact
    partner on the other side, when one begins with ``prefix`` characters of
    the other or their sequence ratio reaches ``ratio``. Pages are small, and
    each is one task.
    """
    from difflib import SequenceMatcher

    plain = F.regexp_replace(F.lower("label"), "[^a-z0-9]", "")
    kind = rows.schema["page_id"].dataType.simpleString()

    def alike(p: str, q: str) -> bool:
        short, long = sorted((p, q), key=len)
        return (len(short) >= prefix and long.startswith(short)) or SequenceMatcher(None, p, q).ratio() >= ratio

    def pair(pdf: pd.DataFrame) -> pd.DataFrame:
        places = pdf.groupby(["side", "label"])["ord"].apply(list)
        left, right = (places[s].to_dict() if s in places.index.get_level_values(0) else {} for s in "ab")
        found = [(i, j) for label in left.keys() & right.keys() for i in left[label] for j in right[label]]
        alone = [label for label in right if label not in left]
        found += [(i, j) for p in left if p not in right for q in alone if alike(p, q) for i in left[p] for j in right[q]]
        out = pd.DataFrame(longest_chain(found), columns=["a_ord", "b_ord"])
        return out.assign(page_id=pdf["page_id"].iloc[0])[["page_id", "a_ord", "b_ord"]]

    return rows.select("page_id", "side", F.col("ord").cast("int").alias("ord"), plain.alias("label")).groupBy("page_id").applyInPandas(pair, f"page_id {kind}, a_ord int, b_ord int")


def within(computed: Column, expected: Column, tolerance: float = 0.05) -> Column:
    """Whether a computed value is the expected one; null where none is expected, false where none was computed."""
    return F.when(expected.isNotNull(), F.coalesce(F.abs(computed - expected) <= tolerance, F.lit(False)))


def issue_scores(expected: DataFrame, found: DataFrame) -> DataFrame:
    """One row ``(tp, fp, fn, precision, recall, f1)`` of issues ``(case_id, word, category)``; words in lower case with single blanks."""
    key = lambda df: df.select("case_id", F.trim(F.regexp_replace(F.lower("word"), r"(?U)\s+", " ")).alias("word"), "category").distinct()
    both = key(expected).withColumn("e", F.lit(1)).join(key(found).withColumn("f", F.lit(1)), ["case_id", "word", "category"], "full")
    n = both.agg(F.count_if(F.col("e").isNotNull() & F.col("f").isNotNull()).alias("tp"), F.count_if(F.col("e").isNull()).alias("fp"), F.count_if(F.col("f").isNull()).alias("fn"))
    share = lambda a, b: F.round(F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0)), 6)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return n.select("tp", "fp", "fn", share(tp, tp + fp).alias("precision"), share(tp, tp + fn).alias("recall"), share(2 * tp, 2 * tp + fp + fn).alias("f1"))
