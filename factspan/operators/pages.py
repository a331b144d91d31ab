"""Tables printed on pages: lines from glyphs, rows and headers from lines.

``lines(page_id, y, line)``; y grows upwards. Pages are the unit of grouping,
and hold a bounded number of lines.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factspan.functions import periods as P
from factspan.functions.core import let
from factspan.functions.numbers import parse_number
from factspan.operators.grid import drop_ambiguous_rows, unit_from_caption
from factspan.operators.text import tokens_of

#: Glyphs of one line differ by this much in height at most; a wider gap between glyphs parts words.
LINE_HEIGHT = 3.0
WORD_GAP = 1.2
ROW_CELLS = 3
_CELL = r"\(?-?[\d.,]+%?\)?"
#: Fixed value: what opens a table.
CAPTION = r"(?i)^(?:Tabel|Lampiran)\s*[IVX\d]+[.\s]"


def glyph_lines(glyphs: DataFrame) -> DataFrame:
    """``(page_id, y, line)`` from ``glyphs(page_id, top, lft, rgt, ch)``.

    A glyph belongs to a line when its height is near that of the line's first
    glyph, so a page is read in order; within a line, words part where a glyph
    begins beyond the rightmost edge so far.
    """

    def cluster(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["top", "lft"], ascending=[False, True])
        line, first, out = -1, None, []
        for top in pdf["top"]:
            if first is None or abs(first - top) > LINE_HEIGHT:
                line, first = line + 1, top
            out.append(line)
        return pdf.assign(line=out)

    kind = glyphs.schema["page_id"].dataType.simpleString()
    marked = glyphs.groupBy("page_id").applyInPandas(cluster, f"page_id {kind}, top double, lft double, rgt double, ch string, line int")
    w = Window.partitionBy("page_id", "line").orderBy("lft")
    edge = F.max("rgt").over(w.rowsBetween(Window.unboundedPreceding, -1))
    text = F.when(F.col("lft") - edge > WORD_GAP, F.concat(F.lit(" "), "ch")).otherwise(F.col("ch"))
    g = marked.withColumn("text", text).groupBy("page_id", "line")
    out = g.agg(F.median("top").alias("y"), F.array_sort(F.collect_list(F.struct("lft", "text"))).alias("parts"))
    return out.select("page_id", "y", F.array_join(F.transform("parts", lambda p: p["text"]), "").alias("line"))


def line_row(line: Column) -> Column:
    """``struct(label, values)`` of a line that ends in three cells or more after a label, or null."""
    t = F.trim(F.regexp_replace(line, r"\s+", " "))
    pattern = rf"^(.+?)((?: {_CELL}){{{ROW_CELLS},}})$"

    def read(s: Column) -> Column:
        values = F.transform(F.split(F.trim(F.regexp_extract(s, pattern, 2)), " "), parse_number)
        label = F.regexp_extract(s, pattern, 1)
        fine = s.rlike(pattern) & ~label.rlike(rf"^{_CELL}$") & F.forall(values, lambda v: v.isNotNull())
        return F.when(fine, F.struct(label.alias("label"), values.alias("values")))

    return let(t, read)


def line_periods(line: Column) -> Column:
    """The longest run of three period tokens or more on a line, the first of equal ones, or null."""
    empty = F.array().cast("array<string>")

    marked = F.transform(tokens_of(line), lambda t: F.struct(t.alias("token"), (P.bare_token(t).isNotNull() | P.parse_period(t).isNotNull()).alias("period")))

    def step(a: Column, t: Column) -> Column:
        now = F.when(t["period"], F.concat(a["now"], F.array(t["token"]))).otherwise(empty)
        return F.struct(now.alias("now"), F.when(F.size(now) > F.size(a["best"]), now).otherwise(a["best"]).alias("best"))

    best = F.aggregate(marked, F.struct(empty.alias("now"), empty.alias("best")), step)["best"]
    return F.when(F.size(best) >= 3, best)


def page_tables(lines: DataFrame) -> DataFrame:
    """``(page_id, caption, unit, label, ord, period, value)`` of the tables on pages.

    A table is a caption, the first line of periods below it, and the rows
    below that with as many values, down to the next caption. Rows whose label
    repeats in the table go; a table needs two rows.
    """
    read = lines.withColumns({"_caption": F.trim("line").rlike(CAPTION), "_periods": line_periods(F.col("line")), "_row": line_row(F.col("line"))})
    w = Window.partitionBy("page_id").orderBy(F.desc("y"))
    # the caption a line stands below, by one pass over the page
    read = read.withColumn("at", F.last(F.when(F.col("_caption"), F.struct("y", "line")), ignorenulls=True).over(w)).where("at is not null and not _caption")
    read = read.select("page_id", "y", F.col("at.y").alias("caption_y"), F.trim("at.line").alias("caption"), "_periods", "_row", unit_from_caption(F.col("line")).alias("_unit"))
    table = ["page_id", "caption_y", "caption"]
    heads = read.where("_periods is not null").groupBy(*table).agg(F.max("y").alias("head_y"), F.max_by("_periods", "y").alias("periods"))
    units = read.join(heads, table).where("y >= head_y and _unit is not null").groupBy(*table).agg(F.max_by("_unit", "y").alias("unit"))
    rows = read.join(heads, table).where("y < head_y and _row is not null").where(F.size("_row.values") == F.size("periods"))
    rows = rows.select(*table, "y", F.col("_row.label").alias("label"), F.col("_row.values").alias("values"), "periods")
    rows = drop_ambiguous_rows(rows.withColumn("source_id", F.struct(*table))).drop("source_id")
    rows = rows.withColumn("_n", F.count("*").over(Window.partitionBy(*table))).where("_n >= 2")
    rows = rows.join(units, table, "left").withColumn("unit", F.coalesce(unit_from_caption(F.col("caption")), "unit"))
    cells = rows.select("page_id", "caption", "unit", "label", F.posexplode(F.arrays_zip("periods", "values")).alias("ord", "cell"))
    return cells.select("page_id", "caption", "unit", "label", "ord", F.col("cell.periods").alias("period"), F.col("cell.values").alias("value"))


def answered_pages(lines: DataFrame) -> DataFrame:
    """``(page_id, captions, tables, answered)``: a page is answered when each of its captions gave a table."""
    captions = lines.where(F.trim("line").rlike(CAPTION)).groupBy("page_id").agg(F.count("*").alias("captions"))
    found = page_tables(lines).groupBy("page_id").agg(F.count_distinct("caption").alias("tables"))
    out = captions.join(found, "page_id", "left").withColumn("tables", F.coalesce("tables", F.lit(0)))
    return out.withColumn("answered", F.col("captions") == F.col("tables"))


def verify_rows(transcribed: DataFrame, printed: DataFrame, alignment: DataFrame) -> DataFrame:
    """Transcribed rows ``(page_id, ord, label, values)`` with the printed values of the row they align with.

    Rows without a partner, or with another number of values, are emptied.
    """
    a = alignment.select("page_id", F.col("a_ord").alias("ord"), "b_ord")
    p = printed.select("page_id", F.col("ord").alias("b_ord"), F.col("values").alias("_printed"))
    out = transcribed.join(a, ["page_id", "ord"], "left").join(p, ["page_id", "b_ord"], "left")
    return out.select("page_id", "ord", "label", F.when(F.size("values") == F.size("_printed"), F.col("_printed")).alias("values"))
