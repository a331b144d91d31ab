"""Grids of cells to tidy facts.

``cells(source_id, r, c, kind, s_val, d_val, ts_val, bold, fill, top_border)``
with kind ``text``, ``num``, ``bool`` or ``date``; an absent cell is empty.
Header rules look at the first ``HEADER_SCAN`` rows of a sheet, so their
windows hold a few rows of one sheet each.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factspan.functions import labels as L
from factspan.functions import periods as P
from factspan.functions.numbers import parse_number
from factspan.sources.tables import settled

HEADER_SCAN = 20
PROBE_ROWS = 6
HEADERISH = 0.8
LABEL_TEXT = 0.6
PERIOD_SHARE = 0.6


def is_empty() -> Column:
    return (F.col("kind") == "text") & (F.trim(F.coalesce("s_val", F.lit(""))) == "")


def cell_text() -> Column:
    """A cell as printed; whole numbers without a decimal point, times as date and time."""
    whole = F.col("d_val") == F.floor("d_val")
    number = F.when(whole, F.col("d_val").cast("long").cast("string")).otherwise(F.col("d_val").cast("string"))
    return F.when(F.col("kind") == "num", number).when(F.col("kind") == "date", F.date_format("ts_val", "yyyy-MM-dd HH:mm:ss")).otherwise(F.col("s_val"))


def cell_period() -> Column:
    """``struct(year, period)`` of a header cell: a date's month, or what its text says, or null."""
    year = F.year("ts_val")
    dated = F.struct(year.alias("year"), F.get(F.array(*map(F.lit, P.MONTHS)), F.month("ts_val") - 1).alias("period"))
    return F.when(F.col("kind") == "date", F.when(year.between(1990, 2100), dated)).otherwise(P.parse_period(cell_text()))


def merged_fill(cells: DataFrame, ranges: DataFrame) -> DataFrame:
    """Copy each merged range's anchor into all of its cells; ranges without an anchor value change nothing.

    ``ranges(source_id, r0, r1, c0, c1)`` are half-open.
    """
    spread = ranges.withColumns({"r": F.explode(F.sequence(F.col("r0"), F.col("r1") - 1))}).withColumn("c", F.explode(F.sequence(F.col("c0"), F.col("c1") - 1)))
    values = [c for c in cells.columns if c not in ("source_id", "r", "c")]
    anchor = cells.select("source_id", F.col("r").alias("r0"), F.col("c").alias("c0"), *values)
    filled = spread.join(anchor, ["source_id", "r0", "c0"]).select("source_id", "r", "c", *values)
    return cells.join(filled, ["source_id", "r", "c"], "left_anti").unionByName(filled)


def header_rows(cells: DataFrame) -> DataFrame:
    """``(source_id, header_row)``: the first row of mostly text or periods with two cells and numbers soon below."""
    full = cells.where(~is_empty() & (F.col("r") < HEADER_SCAN + PROBE_ROWS))
    headerish = (F.col("kind") == "text") | ((F.col("kind") == "date") & F.col("ts_val").isNotNull())
    rows = full.groupBy("source_id", "r").agg(F.count("*").alias("n"), F.count_if(headerish).alias("texts"), F.max(F.when(F.col("kind") == "num", F.col("r"))).alias("num_row"))
    below = Window.partitionBy("source_id").orderBy("r").rangeBetween(1, PROBE_ROWS)
    found = rows.withColumn("below", F.max("num_row").over(below)).where(f"r < {HEADER_SCAN} and n >= 2 and texts >= {HEADERISH} * n and below is not null")
    return found.groupBy("source_id").agg(F.min("r").alias("header_row"))


def label_columns(cells: DataFrame, headers: DataFrame) -> DataFrame:
    """``(source_id, label_col)``: the leftmost column of mostly text below the header."""
    body = cells.where(~is_empty()).join(headers, "source_id").where("r > header_row")
    share = body.groupBy("source_id", "c").agg(F.avg((F.col("kind") == "text").cast("int")).alias("text"))
    return share.where(F.col("text") >= LABEL_TEXT).groupBy("source_id").agg(F.min("c").alias("label_col"))


def titles(cells: DataFrame, headers: DataFrame) -> DataFrame:
    """``(source_id, title, unit)`` from the rows above the header; a fully parenthesised row is the unit."""
    above = cells.where(~is_empty()).join(headers, "source_id").where("r < header_row")
    rows = above.groupBy("source_id", "r").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c", F.trim(cell_text()).alias("s")))), lambda x: x["s"]), " ").alias("line"))
    unit = F.regexp_extract("line", r"^\((.+)\)$", 1)
    rows = rows.withColumn("unit", F.when(unit != "", F.trim(unit)))
    first_unit = F.min(F.when(F.col("unit").isNotNull(), F.col("r"))).over(Window.partitionBy("source_id"))
    rows = rows.withColumn("is_unit", F.coalesce(F.col("r") == first_unit, F.lit(False)))
    return rows.groupBy("source_id").agg(F.min_by("line", F.when(~F.col("is_unit"), F.col("r"))).alias("title"), F.max(F.when(F.col("is_unit"), F.col("unit"))).alias("unit"))


def single_header_facts(cells: DataFrame) -> DataFrame:
    """Facts of sheets with one header row: temporal where most data columns are periods, else categorical.

    ``(source_id, row_label, row_ord, year, period, col_label, value)``; of
    facts with equal keys the first in reading order counts.
    """
    headers = header_rows(cells)
    at = headers.join(label_columns(cells, headers), "source_id")
    full = cells.where(~is_empty()).join(at, "source_id")
    cols = full.where("r = header_row and c <> label_col").select("source_id", "c", F.trim(cell_text()).alias("head"), cell_period().alias("p"))
    share = F.avg(F.col("p").isNotNull().cast("int")).over(Window.partitionBy("source_id"))
    n = F.count_if(F.col("p").isNotNull()).over(Window.partitionBy("source_id"))
    cols = cols.withColumn("temporal", (n >= 2) & (share >= PERIOD_SHARE)).where("not temporal or p is not null")
    names = full.where("r > header_row and c = label_col and kind = 'text'").select("source_id", "r", L.squeezed(F.col("s_val")).alias("row_label"))
    values = full.where("r > header_row and kind = 'num'").select("source_id", "r", "c", "d_val")
    facts = values.join(cols, ["source_id", "c"]).join(names, ["source_id", "r"])
    facts = facts.select("source_id", "row_label", F.col("r").alias("row_ord"), "c", F.when(F.col("temporal"), F.col("p.year")).alias("year"), F.when(F.col("temporal"), F.col("p.period")).alias("period"), F.when(~F.col("temporal"), F.col("head")).alias("col_label"), F.col("d_val").alias("value"))
    kept = facts.groupBy("source_id", "row_label", "year", "period", "col_label").agg(F.min_by(F.struct("row_ord", "value"), F.struct("row_ord", "c")).alias("v"))
    return kept.select("source_id", "row_label", F.col("v.row_ord").alias("row_ord"), "year", "period", "col_label", F.col("v.value").alias("value"))


def year_runs(cells: DataFrame) -> DataFrame:
    """``(source_id, r, years, merged)``: year cells of each row, and whether every run of equal neighbours has two or more."""
    years = cells.where((F.col("kind") == "num") & P.is_year(F.col("d_val"))).select("source_id", "r", "c", F.col("d_val").cast("int").alias("year"))
    w = Window.partitionBy("source_id", "r").orderBy("c")
    new = (F.lag("c").over(w) + 1 != F.col("c")) | (F.lag("year").over(w) != F.col("year"))
    runs = years.withColumn("run", F.sum(F.coalesce(new, F.lit(True)).cast("int")).over(w)).groupBy("source_id", "r", "run").agg(F.count("*").alias("n"))
    return runs.groupBy("source_id", "r").agg(F.sum("n").alias("years"), F.bool_and(F.col("n") >= 2).alias("merged"))


def period_columns(cells: DataFrame) -> DataFrame:
    """``(source_id, r, c, year, period)``: columns with a year above a bare month or quarter; r is the year's row."""
    years = cells.where((F.col("kind") == "num") & P.is_year(F.col("d_val"))).select("source_id", "r", "c", F.col("d_val").cast("int").alias("year"))
    below = cells.select("source_id", (F.col("r") - 1).alias("r"), "c", P.bare_token(F.col("s_val")).alias("period")).where("period is not null")
    return years.join(below, ["source_id", "r", "c"])


def header_blocks(cells: DataFrame) -> DataFrame:
    """``(source_id, year_row)``: two-row headers: two year cells or more, mostly tokens below; months alone need merged years."""
    got = period_columns(cells).groupBy("source_id", "r").agg(F.count("*").alias("tokens"), F.bool_or(F.col("period").startswith("Q")).alias("quarters"))
    rows = got.join(year_runs(cells), ["source_id", "r"])
    return rows.where(f"years >= 2 and tokens >= 2 and tokens >= {PERIOD_SHARE} * years and (quarters or merged)").select("source_id", F.col("r").alias("year_row"))


def drop_colliding_periods(columns: DataFrame) -> DataFrame:
    """Columns whose period no other column of the block claims."""
    n = F.count("*").over(Window.partitionBy("source_id", "r", "year", "period"))
    return columns.withColumn("_n", n).where("_n = 1").drop("_n")


def reconstruct_years(columns: DataFrame, years: DataFrame) -> DataFrame:
    """Years of period columns without one: a period that does not come after the one before begins a new year.

    ``columns(source_id, c, period)``, ``years(source_id, year)`` distinct.
    Sources whose number of blocks differs from that of years are left out.
    """
    w = Window.partitionBy("source_id").orderBy("c")
    ord_ = P.ordinal(F.col("period"))
    wrap = F.coalesce((ord_ <= F.lag(ord_).over(w)).cast("int"), F.lit(0))
    blocks = columns.withColumn("_wrap", wrap).withColumn("block", F.sum("_wrap").over(w)).drop("_wrap")
    order = years.select("source_id", "year", (F.row_number().over(Window.partitionBy("source_id").orderBy("year")) - 1).alias("block"))
    n = blocks.groupBy("source_id").agg((F.max("block") + 1).alias("n")).join(years.groupBy("source_id").agg(F.count("*").alias("m")), "source_id").where("n = m")
    return blocks.join(n.select("source_id"), "source_id", "left_semi").join(order, ["source_id", "block"]).select("source_id", "c", "year", "period")


def sparse_year_columns(columns: DataFrame, anchors: DataFrame) -> DataFrame:
    """Years of month columns from a year printed once per block: ``columns(source_id, c, period)``, ``anchors(source_id, c, year)``.

    An anchor holds from the January at or before it to the next January.
    """
    w = Window.partitionBy("source_id").orderBy("c")
    january = F.last(F.when(F.col("period") == "Jan", F.col("c")), ignorenulls=True).over(w)
    cols = columns.withColumn("january", F.coalesce(january, F.lit(-1)))
    known = cols.join(anchors, ["source_id", "c"]).groupBy("source_id", "january").agg(F.min_by("year", "c").alias("year"))
    return cols.join(known, ["source_id", "january"]).select("source_id", "c", "year", "period")


def carry_labels(rows: DataFrame) -> DataFrame:
    """``(source_id, r, row_label, short)``: composite labels of rows with a block of label columns, names carried down.

    ``rows(source_id, r, parts array<string>)``, and ``stored`` whether the row
    has numbers (true where there is no such column). A name of its own at a
    level clears the levels below; a blank takes the name above unless the row
    has a name further left; markers are blanks, unless the row then has no
    label at all. ``short`` is the label without the names that come from rows
    without numbers. The carry depends on the order of rows, so each sheet is
    one task; sheets are bounded by their format.
    """

    def carry(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("r")
        held: list[tuple[str, bool]] = []  # the name at each level, and whether a row with numbers gave it
        whole, short = [], []
        for parts, stored in zip(pdf["parts"], pdf["stored"], strict=True):
            held += [("", True)] * (len(parts) - len(held))
            given = [k for k, part in enumerate(parts) if part]
            for k in given:
                held[k:] = [(parts[k], bool(stored))] + [("", True)] * (len(held) - k - 1)
            row = [held[k] if k in given or not given or k < given[0] else ("", True) for k in range(len(parts))]
            whole.append([name for name, _ in row])
            short.append([name if k in given or kept else "" for k, (name, kept) in enumerate(row)])
        return pdf.assign(whole=whole, short=short)[["source_id", "r", "raw", "whole", "short"]]

    stored = F.col("stored") if "stored" in rows.columns else F.lit(True)
    clean = F.transform("parts", lambda p: F.when(F.coalesce(L.is_marker(p), F.lit(True)), "").otherwise(L.squeezed(p)))
    kind = rows.schema["source_id"].dataType.simpleString()
    every = rows.select("source_id", F.col("r").cast("int").alias("r"), F.col("parts").alias("raw"), clean.alias("parts"), stored.alias("stored"))
    held = every.groupBy("source_id").applyInPandas(carry, f"source_id {kind}, r int, raw array<string>, whole array<string>, short array<string>")
    label, raw = L.composite(F.col("whole")), L.composite(F.transform("raw", L.squeezed))
    held = held.select("source_id", "r", F.when(label != "", label).otherwise(raw).alias("row_label"), L.composite(F.col("short")).alias("short"))
    return held.withColumn("short", F.when(F.col("short") != "", F.col("short")).otherwise(F.col("row_label")))


def drop_redundant_qualifiers(labels: DataFrame) -> DataFrame:
    """``label`` replaced by ``short`` where the label's member is unique in its source."""
    leaf = L.leaf(F.col("label"))
    n = F.count("*").over(Window.partitionBy("source_id", leaf))
    return labels.withColumn("label", F.when((n == 1) & F.col("short").isNotNull(), F.col("short")).otherwise(F.col("label")))


def qualify_by_parent(rows: DataFrame) -> DataFrame:
    """``(source_id, r, label)``: labels that repeat get the nearest row above with a smaller indent in front.

    ``rows(source_id, r, label, indent)``. Each row stands once for each deeper
    indent of its sheet, so that the last one above is found in one sorted pass
    over each indent.
    """
    n = F.count("*").over(Window.partitionBy("source_id", "label"))
    marked = rows.select("source_id", "r", "label", "indent", n.alias("_n"))
    again = marked.where("_n > 1")
    depths = again.groupBy("source_id").agg(F.collect_set("indent").alias("depths"))
    above = rows.join(depths, "source_id").select("source_id", F.explode(F.filter("depths", lambda d: d > F.col("indent"))).alias("depth"), "r", F.col("label").alias("_label"), F.lit(False).alias("_asks"))
    asks = again.select("source_id", F.col("indent").alias("depth"), "r", F.lit(None).cast("string").alias("_label"), F.lit(True).alias("_asks"))
    w = Window.partitionBy("source_id", "depth").orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
    parent = above.unionByName(asks).withColumn("parent", F.last("_label", ignorenulls=True).over(w)).where("_asks").select("source_id", "r", "parent")
    out = marked.join(parent, ["source_id", "r"], "left")
    return out.select("source_id", "r", F.when(F.col("parent").isNotNull(), F.concat("parent", F.lit(L.QUALIFIER), "label")).otherwise(F.col("label")).alias("label"))


def layout_fingerprint(cells: DataFrame, rows: int = 20, cols: int = 30) -> DataFrame:
    """``(source_id, fingerprint)``: a digest of where a sheet's first cells are numbers, text or empty, and of its width."""
    near = cells.where(~is_empty() & (F.col("r") < rows) & (F.col("c") < cols)).select("source_id", (F.col("r") * cols + F.col("c")).alias("at"), F.when(F.col("kind") == "num", "n").otherwise("t").alias("mark"))
    width = cells.groupBy("source_id").agg((F.max("c") + 1).alias("width"))
    marks = near.groupBy("source_id").agg(F.map_from_entries(F.collect_list(F.struct("at", "mark"))).alias("m"))
    text = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(rows * cols - 1)), lambda i: F.coalesce(F.col("m")[i], F.lit("."))), "")
    return width.join(marks, "source_id", "left").select("source_id", F.sha2(F.concat(F.coalesce(text, F.lit("")), F.lit("#"), F.col("width").cast("string")).cast("binary"), 256).alias("fingerprint"))


def printed_cell(text: Column) -> Column:
    """A printed table cell as a number, or null."""
    return F.when(F.trim(text).rlike(r"^\(?-?[\d.,\s]+%?\)?\**$"), parse_number(text))


def unit_from_caption(caption: Column) -> Column:
    """The unit in a caption's trailing parentheses: short, not beginning with a digit, with a unit word."""
    u = F.regexp_extract(caption, r"\(([^()]{1,40})\)\s*$", 1)
    return F.when(~u.rlike(r"^\s*\d") & u.rlike(r"(?i)(rp|rupiah|usd|dolar|triliun|miliar|juta|ribu|persen|%|indeks|yoy|unit|orang)"), F.trim(u))


def drop_ambiguous_rows(rows: DataFrame) -> DataFrame:
    """Rows whose label, letters and digits only, is the only such one in its table."""
    n = F.count("*").over(Window.partitionBy("source_id", L.alphanumeric(F.col("label"))))
    return rows.withColumn("_n", n).where("_n = 1").drop("_n")


def two_row_facts(cells: DataFrame) -> DataFrame:
    """``(source_id, row_label, row_ord, year, period, value)`` of sheets with years above months or quarters.

    Blocks may be stacked: a block's rows end where the next one's header
    begins. Periods that two columns of a block claim are dropped. The label
    columns are the last run of neighbouring text columns left of a block's
    first data column; their names are carried down, and names that come from
    rows without numbers go where the rest is unique in the sheet. Of facts
    with equal keys the first counts.
    """
    blocks = header_blocks(cells)
    end = F.coalesce(F.lead("year_row").over(Window.partitionBy("source_id").orderBy("year_row")), F.lit(1 << 30))
    blocks = blocks.withColumn("end_row", end)
    cols = period_columns(cells).join(blocks.select("source_id", F.col("year_row").alias("r")), ["source_id", "r"])
    cols = drop_colliding_periods(cols).withColumnRenamed("r", "year_row")
    first = cols.groupBy("source_id", "year_row").agg(F.min("c").alias("first_col"))
    body = cells.where(~is_empty()).join(blocks, "source_id").where("r > year_row + 1 and r < end_row").join(first, ["source_id", "year_row"])
    values = body.where("kind = 'num'").join(cols, ["source_id", "year_row", "c"]).select("source_id", "year_row", "r", "c", "year", "period", F.col("d_val").alias("value"))
    texts = body.where("kind = 'text' and c < first_col")
    w = Window.partitionBy("source_id", "year_row").orderBy(F.desc("c"))
    used = texts.select("source_id", "year_row", "c").distinct().withColumn("run", F.col("c") + F.row_number().over(w))
    used = used.withColumn("last", F.max("run").over(Window.partitionBy("source_id", "year_row"))).where("run = last")
    width = used.groupBy("source_id", "year_row").agg(F.min("c").alias("lo"), F.max("c").alias("hi"))
    texts = texts.join(used.select("source_id", "year_row", "c"), ["source_id", "year_row", "c"], "left_semi")
    parts = texts.join(width, ["source_id", "year_row"]).groupBy("source_id", "year_row", "r").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.map_from_entries(F.collect_list(F.struct("c", "s_val"))).alias("m"))
    stored = values.select("source_id", "year_row", "r").distinct().withColumn("stored", F.lit(True))
    parts = parts.join(stored, ["source_id", "year_row", "r"], "left").withColumn("stored", F.coalesce("stored", F.lit(False)))
    parts = parts.select(F.struct("source_id", "year_row").alias("source_id"), "r", F.transform(F.sequence("lo", "hi"), lambda c: F.col("m")[c]).alias("parts"), "stored")
    key = parts.select(F.to_json("source_id").alias("source_id"), "r", "parts", "stored")
    named = carry_labels(key).select(F.from_json("source_id", "source_id string, year_row int").alias("k"), "r", "row_label", "short")
    named = named.select(F.col("k.source_id").alias("source_id"), F.col("k.year_row").alias("year_row"), "r", "row_label", "short").where("row_label <> ''")
    named = named.join(stored, ["source_id", "year_row", "r"])
    labels = named.groupBy("source_id", "row_label").agg(F.min_by("short", "r").alias("short")).withColumn("label", F.col("row_label"))
    labels = drop_redundant_qualifiers(labels).select("source_id", "row_label", "label")
    facts = values.join(named, ["source_id", "year_row", "r"]).join(labels, ["source_id", "row_label"]).drop("row_label").withColumnRenamed("label", "row_label")
    kept = facts.groupBy("source_id", "row_label", "year", "period").agg(F.min_by(F.struct("r", "value"), F.struct("r", "c")).alias("v"))
    return kept.select("source_id", "row_label", F.col("v.r").alias("row_ord"), "year", "period", F.col("v.value").alias("value"))


def bands(cells: DataFrame) -> DataFrame:
    """``(source_id, first_header, first_data)``: the header band of a sheet; rows of one repeated value before it are titles.

    A header row is mostly text; the band ends at the first row that is not.
    """
    full = cells.where(~is_empty())
    width = full.groupBy("source_id").agg((F.max("c") + 1).alias("width"))
    rows = full.groupBy("source_id", "r").agg(F.count("*").alias("n"), F.avg((F.col("kind") == "text").cast("int")).alias("text"), F.count_distinct("s_val", "d_val").alias("kinds"))
    rows = rows.join(width, "source_id").withColumn("title", (F.col("text") == 1) & ((F.col("n") == 1) | ((F.col("kinds") == 1) & (2 * F.col("n") >= F.col("width")))))
    header = F.min(F.when(~F.col("title") & (F.col("text") > 0.5), F.col("r"))).over(Window.partitionBy("source_id"))
    rows = rows.withColumn("first_header", header)
    data = rows.where("r > first_header and text <= 0.5").groupBy("source_id", "first_header").agg(F.min("r").alias("first_data"))
    return data.select("source_id", "first_header", "first_data")


def tidy_facts(cells: DataFrame) -> DataFrame:
    """``(source_id, row_label, col_label, value, is_aggregate, cell)``: every number of a sheet under its header path.

    Columns of mostly numbers below the header band are values, the others
    labels; header parts are joined by the qualifier, label parts by a dash.
    ``is_aggregate`` is set where a row or a column scores as a total.
    """
    from factspan.operators import aggregates as A

    at = bands(cells)
    full = cells.where(~is_empty()).join(at, "source_id")
    data = full.where("r >= first_data")
    kind = data.groupBy("source_id", "c").agg((F.avg((F.col("kind") == "num").cast("int")) >= 0.5).alias("is_value"))
    head = full.where("r between first_header and first_data - 1").groupBy("source_id", "c").agg(F.array_sort(F.collect_list(F.struct("r", F.trim(cell_text()).alias("s")))).alias("p"))
    head = head.select("source_id", "c", F.array_join(F.array_distinct(F.transform("p", lambda x: x["s"])), L.QUALIFIER).alias("col_label"))
    data = data.join(kind, ["source_id", "c"])
    names = data.where("not is_value").groupBy("source_id", "r").agg(F.array_sort(F.collect_list(F.struct("c", F.trim(cell_text()).alias("s")))).alias("p"))
    names = names.select("source_id", "r", F.array_join(F.transform("p", lambda x: x["s"]), " - ").alias("row_label"))
    values = data.where("is_value and kind = 'num'").select("source_id", "r", "c", "d_val", "bold", "fill", "top_border")
    facts = values.join(names, ["source_id", "r"]).join(head, ["source_id", "c"])
    by_row = A.sum_of_others(facts.select("source_id", F.col("r").alias("row_label"), F.col("c").alias("col_label"), F.col("d_val").alias("value"))).select("source_id", F.col("row_label").alias("r"), F.col("is_sum").alias("row_sum"))
    by_col = A.sum_of_others(facts.select("source_id", F.col("c").alias("row_label"), F.col("r").alias("col_label"), F.col("d_val").alias("value"))).select("source_id", F.col("row_label").alias("c"), F.col("is_sum").alias("col_sum"))
    style = facts.groupBy("source_id", "r").agg((F.bool_and("bold") | F.bool_and("fill") | F.bool_and("top_border")).alias("style"))
    edge = facts.groupBy("source_id").agg(F.max("r").alias("last_r"), F.max("c").alias("last_c"))
    facts = facts.join(by_row, ["source_id", "r"]).join(by_col, ["source_id", "c"]).join(style, ["source_id", "r"]).join(edge, "source_id")
    row = A.score(A.has_keyword(F.col("row_label")), F.col("style"), F.col("row_sum"), F.col("r") == F.col("last_r"))
    col = A.score(A.has_keyword(F.col("col_label")), F.lit(False), F.col("col_sum"), F.col("c") == F.col("last_c"))
    total = (A.classify(row) == "aggregate") | (A.classify(col) == "aggregate")
    return facts.select("source_id", "row_label", "col_label", F.col("d_val").alias("value"), total.alias("is_aggregate"), F.struct("r", "c").alias("cell"))


def cascade(tiers: list[DataFrame]) -> DataFrame:
    """Facts of the first parser that found any in a sheet, parsers in order of trust; the tier is ``parser`` from 0."""
    every = None
    for k, t in enumerate(tiers):
        cols = ["source_id", "row_label", "row_ord", "year", "period", "col_label", "value"]
        t = t.select(*[F.col(c) if c in t.columns else F.lit(None).cast("int" if c in ("row_ord", "year") else "string").alias(c) for c in cols], F.lit(k).alias("parser"))
        every = t if every is None else every.unionByName(t)
    best = every.groupBy("source_id").agg(F.min("parser").alias("parser"))
    return every.join(best, ["source_id", "parser"])


def collapsed(facts: DataFrame) -> DataFrame:
    """``(source_id, collapsed)``: whether a parse gave one label to several rows."""
    rows = facts.select("source_id", "row_label", "row_ord").distinct()
    return rows.groupBy("source_id").agg((F.count_distinct("row_label") < F.count("*")).alias("collapsed"))


#: Where sheets of the statistical layout have labels and data, how far their header is looked for, and what ends their rows.
LABEL_COLUMN = 2
FIRST_DATA = 3
YEAR_SCAN = 10
FOOTNOTE = r"^\d+\)"
LONGEST_LABEL = 120


def anchored_columns(columns: DataFrame, anchors: DataFrame) -> DataFrame:
    """``(source_id, c, year, period)``: years of month columns from years printed anywhere in their block.

    ``columns(source_id, c, period)``, ``anchors(source_id, c, year)`` on month
    columns. A year's January is as many month columns to the left as its
    anchor's month says, by the leftmost anchor for which there is one; the year
    holds from there to the next such January.
    """
    w = Window.partitionBy("source_id").orderBy("c")
    placed = columns.withColumn("place", F.row_number().over(w))
    begins = placed.join(anchors, ["source_id", "c"]).withColumn("place", F.col("place") - P.ordinal(F.col("period")) + 1).where("place >= 1")
    begins = begins.groupBy("source_id", "year").agg(F.min_by("place", "c").alias("place")).groupBy("source_id", "place").agg(F.max("year").alias("begin"))
    known = placed.join(begins, ["source_id", "place"], "left").withColumn("year", F.last("begin", ignorenulls=True).over(w))
    return known.where("year is not null").select("source_id", "c", "year", "period")


def statistical_facts(cells: DataFrame) -> DataFrame:
    """``(source_id, row_label, row_ord, year, period, value)`` of sheets of the statistical layout.

    The first of the first rows with a year is the row of years, the next one
    that of months; labels stand in one column, indented under their parents.
    Rows end at a footnote or an overlong label. Labels that repeat get their
    parent in front; of facts with equal keys the first counts.
    """
    full = cells.where(~is_empty())
    years = full.where((F.col("kind") == "num") & F.col("d_val").between(1990, 2100) & (F.col("r") < YEAR_SCAN))
    head = years.groupBy("source_id").agg(F.min("r").alias("year_row"))
    at = full.join(head, "source_id")
    months = at.where(f"r = year_row + 1 and c >= {FIRST_DATA}").select("source_id", "c", P.month_token(F.col("s_val")).alias("period")).where("period is not null")
    anchors = at.where("r = year_row and kind = 'num' and d_val between 1990 and 2100").select("source_id", "c", F.col("d_val").cast("int").alias("year"))
    cols = anchored_columns(months, anchors)
    body = at.where("r > year_row + 1")
    names = body.where(f"c = {LABEL_COLUMN}").withColumn("label", F.trim(cell_text()))
    stop = names.where(F.col("label").rlike(FOOTNOTE) | (F.length("label") > LONGEST_LABEL)).groupBy("source_id").agg(F.min("r").alias("stop"))
    names = names.join(stop, "source_id", "left").where("stop is null or r < stop")
    named = qualify_by_parent(names.select("source_id", "r", "label", "indent")).withColumnRenamed("label", "row_label")
    facts = body.where("kind = 'num'").select("source_id", "r", "c", F.col("d_val").alias("value")).join(cols, ["source_id", "c"]).join(named, ["source_id", "r"])
    kept = facts.groupBy("source_id", "row_label", "year", "period").agg(F.min_by(F.struct("r", "value"), F.struct("r", "c")).alias("v"))
    return kept.select("source_id", "row_label", F.col("v.r").alias("row_ord"), "year", "period", F.col("v.value").alias("value"))


#: Parsers of a sheet in order of trust; the last is the first again, for sheets that nothing else reads.
PARSERS = ["statistical", "two_row", "single_header", "statistical_collapsed"]


def parse_sheets(cells: DataFrame, merges: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """``(sources, facts)`` of whole sheets: merged cells filled, then the first parser that reads a sheet.

    ``sources(source_id, title, unit, axis, parser)``, ``parser`` one of
    ``PARSERS`` or null where none reads the sheet and it can only be pointed
    into. A statistical parse that gives rows one label is only a last resort.
    Cells and the facts of each parser are computed once, as several steps read them.
    """
    cells = settled(cells)
    filled = settled(merged_fill(cells, merges.select("source_id", "r0", "r1", "c0", "c1"))) if merges is not None else cells
    plain = settled(statistical_facts(cells))
    flat = collapsed(plain).where("collapsed").select("source_id")
    two, one = settled(two_row_facts(filled)), settled(single_header_facts(filled))
    facts = settled(cascade([plain.join(flat, "source_id", "left_anti"), two, one, plain.join(flat, "source_id", "left_semi")]))
    blocks = header_blocks(filled).groupBy("source_id").agg(F.min("year_row").alias("two"))
    single = header_rows(filled).withColumnRenamed("header_row", "one")
    firsts = cells.where((F.col("kind") == "num") & F.col("d_val").between(1990, 2100) & (F.col("r") < YEAR_SCAN)).groupBy("source_id").agg(F.min("r").alias("year_row"))
    used = facts.groupBy("source_id").agg(F.first("parser").alias("parser"), F.bool_or(F.col("col_label").isNotNull()).alias("placed"))
    every = cells.select("source_id").distinct().join(used, "source_id", "left")
    top = every.join(blocks, "source_id", "left").join(single, "source_id", "left").join(firsts, "source_id", "left")
    top = top.select("source_id", F.when(F.col("parser") == 1, F.col("two")).when(F.col("parser") == 2, F.col("one")).otherwise(F.coalesce("year_row", "one", "two")).alias("header_row"))
    named = titles(cells, top.where("header_row is not null"))
    parser = F.get(F.array(*map(F.lit, PARSERS)), F.col("parser"))
    axis = F.when(F.col("placed"), "categorical").otherwise("temporal")
    return every.join(named, "source_id", "left").select("source_id", "title", "unit", axis.alias("axis"), parser.alias("parser")), facts


def pad_header(headers: DataFrame, body: DataFrame) -> DataFrame:
    """``(table_id, r, cells)``: header rows with a blank in front where the last one lacks the label column.

    ``headers(table_id, r, cells array<string>)`` and ``body`` the same. A
    blank is put before all of a table's header rows if the last of them is one
    cell narrower than most body rows (of equally common widths the one seen
    first), these have two cells or more, and some body row begins with text.
    """
    widths = body.groupBy("table_id", F.size("cells").alias("w")).agg(F.count("*").alias("n"), F.min("r").alias("at"))
    common = widths.groupBy("table_id").agg(F.min_by("w", F.struct(-F.col("n"), "at")).alias("w"))
    named = body.groupBy("table_id").agg(F.bool_or(F.coalesce((F.trim(F.get("cells", F.lit(0))) != "") & printed_cell(F.get("cells", F.lit(0))).isNull(), F.lit(False))).alias("named"))
    last = headers.groupBy("table_id").agg(F.max_by(F.size("cells"), "r").alias("h"))
    short = common.join(named, "table_id").join(last, "table_id").where("named and w >= 2 and h = w - 1").select("table_id", F.lit(True).alias("short"))
    blank = F.array(F.lit(None).cast("string"))
    return headers.join(short, "table_id", "left").select("table_id", "r", F.when(F.col("short"), F.concat(blank, "cells")).otherwise(F.col("cells")).alias("cells"))


def usable_tables(headers: DataFrame, body: DataFrame) -> DataFrame:
    """``(table_id)`` of printed tables with a header, two body rows or more, a number, and no body row that repeats the last header row."""
    plain = F.transform("cells", lambda x: F.trim(F.coalesce(x, F.lit(""))))
    last = headers.groupBy("table_id").agg(F.max_by(plain, "r").alias("head"))
    number = F.exists("cells", lambda x: F.coalesce(printed_cell(x).isNotNull(), F.lit(False)))
    rows = body.join(last, "table_id").groupBy("table_id").agg(F.count("*").alias("n"), F.bool_or(number).alias("numbers"), F.bool_or(plain == F.col("head")).alias("again"))
    return rows.where("n >= 2 and numbers and not again").select("table_id")


def spec_facts(cells: DataFrame, specs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(facts, problems)`` of sheets read by a given map of rows and columns.

    ``specs(source_id, axis, header_row, data_start_row, label_col, columns
    array<struct<col, kind, year, period, name>>)`` with kind ``period`` or
    ``attribute``. ``problems(source_id, problem)`` says why a map cannot be
    right for its sheet; such a sheet has no facts. Of columns of one name and
    of facts with equal keys the first counts.
    """
    full = cells.where(~is_empty())
    size = cells.groupBy("source_id").agg(F.max("r").alias("last_r"), (F.max("c") + 1).alias("width"))
    s = specs.join(size, "source_id")
    cols = F.transform("columns", lambda x: x["col"])
    tokens = F.array(*map(F.lit, [*P.MONTHS, *P.QUARTERS]))
    fine_period = lambda x: F.coalesce((F.col("axis") == "temporal") & x["year"].between(1990, 2100) & F.array_contains(tokens, x["period"]), F.lit(False))
    fine_name = lambda x: F.coalesce((F.col("axis") == "categorical") & (F.trim(x["name"]) != ""), F.lit(False))
    rules = [
        (~((F.col("header_row") >= 0) & (F.col("header_row") < F.col("data_start_row")) & (F.col("data_start_row") <= F.col("last_r"))), "rows out of order"),
        (~F.col("label_col").between(0, F.col("width") - 1), "no such label column"),
        (F.size("columns") == 0, "no columns"),
        (F.exists(cols, lambda c: (c < 0) | (c >= F.col("width"))), "no such column"),
        (F.array_contains(cols, F.col("label_col")) | (F.size(F.array_distinct(cols)) < F.size(cols)), "a column twice"),
        (~F.forall("columns", lambda x: F.when(x["kind"] == "period", fine_period(x)).otherwise(fine_name(x))), "a column that does not fit the axis"),
    ]
    problem = F.coalesce(*[F.when(F.coalesce(bad, F.lit(True)), F.lit(name)) for bad, name in rules])
    told = s.select("source_id", "axis", "data_start_row", "label_col", "columns", problem.alias("problem"))
    spread = told.where("problem is null").select("source_id", "data_start_row", "label_col", F.posexplode("columns").alias("k", "x")).select("source_id", "data_start_row", "label_col", "k", "x.*")
    name = F.trim("name")
    first = F.min("k").over(Window.partitionBy("source_id", "kind", "year", "period", name))
    spread = spread.withColumn("first", F.when(F.col("kind") == "period", F.col("k")).otherwise(first)).where("k = first")
    at = full.join(spread.select("source_id", "data_start_row", "label_col").distinct(), "source_id").where("r >= data_start_row")
    names = at.where("c = label_col").select("source_id", "r", F.trim(cell_text()).alias("row_label"))
    values = at.where("kind = 'num'").select("source_id", "r", F.col("c").alias("col"), F.col("d_val").alias("value"))
    dated = F.col("kind") == "period"
    f = values.join(spread.select("source_id", "col", "kind", "year", "period", name.alias("name")), ["source_id", "col"]).join(names, ["source_id", "r"])
    f = f.select("source_id", "row_label", "r", "col", F.when(dated, F.col("year")).alias("year"), F.when(dated, F.col("period")).alias("period"), F.when(~dated, F.col("name")).alias("col_label"), "value")
    kept = f.groupBy("source_id", "row_label", "year", "period", "col_label").agg(F.min_by(F.struct("r", "value"), F.struct("r", "col")).alias("v"))
    facts = kept.select("source_id", "row_label", F.col("v.r").alias("row_ord"), "year", "period", "col_label", F.col("v.value").alias("value"))
    empty = told.where("problem is null").select("source_id").join(facts.select("source_id").distinct(), "source_id", "left_anti").withColumn("problem", F.lit("no labelled numbers"))
    return facts, told.where("problem is not null").select("source_id", "problem").unionByName(empty)
