"""Raw extracted claims to claims, and the sentences they come from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factspan.functions import labels as L
from factspan.functions import numbers as N
from factspan.functions import periods as P
from factspan.operators.claims import TREND

#: Words of a window of an anchor that is not found as a whole, and how far it slides.
WINDOW = 6
SLIDES = 8
LONGEST = 600
#: Where a sentence ends, and what begins the next.
_END = r"(?:(?<=[,.]\d)|(?<!\b\w))[.!?]"
_START = r"\s+(?=[\"'“(\[*]*\s*[A-Z0-9])"


def finalize(raw: DataFrame) -> DataFrame:
    """Claims of ``raw(claim_id, operation, value_raw, unit, quote, points array<struct<metric_label, year, month, col_label>>)``.

    A point with a year and a readable month is dated, whatever column it
    names; else it needs a column. Claims with an unusable point are dropped, as
    are those without a readable number unless they only state a direction.
    """

    def point(p: Column, i: Column) -> Column:
        token = P.bare_token(p["month"])
        dated = p["year"].isNotNull() & token.isNotNull()
        column = F.nullif(F.trim(p["col_label"]), F.lit(""))
        return F.struct(i.alias("ord"), p["metric_label"].alias("metric_label"), F.when(dated, p["year"]).alias("year"), F.when(dated, token).alias("period"), F.when(~F.coalesce(dated, F.lit(False)), column).alias("col_label"))

    df = raw.withColumn("points", F.transform("points", point))
    usable = F.forall("points", lambda p: p["period"].isNotNull() | p["col_label"].isNotNull()) & (F.size("points") > 0)
    trend = F.col("operation").isin(TREND)
    df = df.withColumn("claimed_value", F.when(~trend, N.parse_number(F.col("value_raw"))))
    return df.where(usable & (trend | F.col("claimed_value").isNotNull())).select("claim_id", "operation", "claimed_value", "unit", "quote", "points")


def sentence_at(text: Column, start: Column, stop: Column) -> Column:
    """The sentence around characters ``start`` to ``stop`` (from 0), or null when it is empty or too long."""
    head = F.substr(text, F.lit(1), start)
    peek = F.substr(text, start + 1, F.lit(80))
    before = F.regexp_replace(F.concat(head, F.lit("\x01"), peek), rf"(?s)^.*{_END}{_START.replace('[A-Z0-9]', '[A-Z0-9\x01]')}(?=[^\x01]*\x01)", "")
    before = F.regexp_extract(before, r"(?s)^([^\x01]*)\x01", 1)
    middle = F.substr(text, start + 1, stop - start)
    rest = F.substr(text, stop + 1, F.length(text))
    tail = F.regexp_extract(rest, rf"(?s)^(.*?{_END})(?=\s|$)", 1)
    closed = middle.rlike(r"[.!?]$")
    out = F.trim(F.concat(before, middle, F.when(closed, "").when(tail != "", tail).otherwise(rest)))
    return F.when((out != "") & (F.length(out) <= LONGEST), out)


def locate(anchors: DataFrame, docs: DataFrame) -> DataFrame:
    """``(claim_id, start, stop, sentence)``: where a document states a claim's anchor.

    ``anchors(claim_id, doc_id, anchor, metric, value_raw)``, ``docs(doc_id,
    text)`` squeezed. The whole anchor counts if it has ten characters or more
    and occurs, else the first of its windows that does. Of several
    occurrences the one whose sentence shares most words with the metric, then
    has the number, then is first, counts. Anchors that do not occur are not returned.
    """
    a = anchors.withColumn("whole", L.squeezed(F.col("anchor")))
    words = F.split("whole", " ")
    n = F.greatest(F.lit(3), F.least(F.lit(WINDOW), F.size(words)))
    windows = F.filter(F.transform(F.sequence(F.lit(0), F.lit(SLIDES - 1)), lambda i: F.when(i + n <= F.size(words), F.array_join(F.slice(words, i + 1, n), " "))), lambda w: w.isNotNull() & (F.length(w) >= 15))
    a = a.withColumn("forms", F.concat(F.when(F.length("whole") >= 10, F.array("whole")).otherwise(F.array().cast("array<string>")), windows))
    both = a.join(docs, "doc_id").withColumn("form", F.get(F.filter("forms", lambda f: F.contains(F.col("text"), f)), F.lit(0))).where("form is not null")
    pieces = F.split("text", F.concat(F.lit("\\Q"), F.col("form"), F.lit("\\E")))
    both = both.select("claim_id", "metric", "value_raw", "text", "form", F.posexplode(F.slice(pieces, 1, F.size(pieces) - 1)).alias("k", "piece"))
    w = Window.partitionBy("claim_id").orderBy("k")
    stop = F.sum(F.length("piece") + F.length("form")).over(w)
    both = both.withColumn("stop", stop.cast("int")).withColumn("start", F.col("stop") - F.length("form"))
    both = both.withColumn("sentence", sentence_at(F.col("text"), F.col("start"), F.col("stop")))
    around = F.coalesce("sentence", F.col("form"))
    overlap = F.size(F.array_intersect(L.significant_words(F.col("metric")), L.significant_words(around)))
    stated = F.coalesce(F.contains(around, F.trim("value_raw")), F.lit(False))
    best = both.withColumn("fit", F.struct(overlap.alias("a"), stated.alias("b"), (-F.col("start")).alias("c"))).groupBy("claim_id").agg(F.max_by(F.struct("start", "stop", "sentence"), "fit").alias("x"))
    return best.select("claim_id", "x.*")
