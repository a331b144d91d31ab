"""What a hook is shown of a sheet, and which of its answers count.

Sheets are ``cells(source_id, r, c, kind, s_val, d_val)``; what is asked of
them is ``asked(source_id, metric_label, year, col_label)``, a date or a column
or neither. A sheet reaches to its last cell. Every choice is made from sets of
rows and columns; only the cells on show, a bounded number, meet in one text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factspan.functions import labels as L

# Rows that hold headers, columns of a year's block, share from
# which a choice is not worth its risk, and bounds of what is shown.
HEADER_ROWS = 6
YEAR_BLOCK = 13
LEAST_GAIN = 0.6
MAX_ROWS = 120
MAX_COLS = 100
MAX_CHARS = 30
MAX_LABELS = 60


def _shown() -> Column:
    """A cell as text: whole numbers without a fraction."""
    whole = (F.col("d_val") == F.floor("d_val")) & (F.abs("d_val") < 1e15)
    return F.when(F.col("kind") == "num", F.when(whole, F.col("d_val").cast("long").cast("string")).otherwise(F.col("d_val").cast("string"))).otherwise(F.col("s_val"))


def _sizes(cells: DataFrame) -> DataFrame:
    return cells.groupBy("source_id").agg((F.max("r") + 1).alias("n_rows"), (F.max("c") + 1).alias("n_cols"))


def relevant_rows(cells: DataFrame, asked: DataFrame) -> DataFrame:
    """``(source_id, r)``: header rows, and rows that share a significant word with a metric asked of their sheet.

    A metric without such a word may be in any row: its sheet has no row here,
    which stands for all of them. Sheets that nothing is asked of have none.
    """
    words = asked.select("source_id", L.significant_words(F.col("metric_label")).alias("words"))
    free = words.where("words is null or size(words) = 0").select("source_id").distinct()
    wanted = words.select("source_id", F.explode("words").alias("word")).distinct().join(free, "source_id", "left_anti")
    named = cells.where("kind = 'text'").select("source_id", "r", F.explode(L.significant_words(F.col("s_val"))).alias("word"))
    hit = named.join(wanted, ["source_id", "word"], "left_semi").select("source_id", "r")
    top = wanted.select("source_id").distinct().join(_sizes(cells), "source_id")
    top = top.select("source_id", F.explode(F.sequence(F.lit(0), F.least(F.lit(HEADER_ROWS), F.col("n_rows")).cast("int") - 1)).alias("r"))
    return top.unionByName(hit).distinct()


def relevant_columns(cells: DataFrame, asked: DataFrame, rows: DataFrame) -> DataFrame:
    """``(source_id, c)``: label columns, and those under a year (with its block) or a column name that is asked for.

    A label column has text and no number in ``rows`` of its sheet, or in all
    rows where it has none there. Of over ``MAX_COLS`` the last ones stay, after
    the label columns. A sheet has no column here, which stands for all, where
    no header names what is asked or too few columns would go.
    """
    size = _sizes(cells)
    tokens = asked.groupBy("source_id").agg(F.collect_set(F.when(F.col("col_label").isNull(), F.col("year").cast("string"))).alias("years"), F.collect_set(F.lower("col_label")).alias("names"))
    heads = cells.where(F.col("r") < HEADER_ROWS).select("source_id", "c", F.lower(F.trim(_shown())).alias("head")).join(tokens, "source_id")
    hits = heads.where(F.exists("years", lambda y: F.contains("head", y)) | F.array_contains("names", F.col("head"))).select("source_id", "c").distinct()
    blocks = hits.join(size, "source_id").select("source_id", F.explode(F.sequence(F.col("c").cast("int"), F.least(F.col("c") + YEAR_BLOCK, F.col("n_cols")).cast("int") - 1)).alias("c")).distinct()

    chosen = rows.select("source_id").distinct()
    on_show = cells.join(rows, ["source_id", "r"], "left_semi").unionByName(cells.join(chosen, "source_id", "left_anti"))
    kinds = on_show.groupBy("source_id", "c").agg(F.max(F.col("kind") == "num").alias("number"), F.max((F.col("kind") == "text") & (F.trim("s_val") != "")).alias("text"))
    names = kinds.where("text and not number").select("source_id", F.col("c").cast("int").alias("c"))
    names = names.join(hits.select("source_id").distinct(), "source_id", "left_semi")

    both = names.select("source_id", "c", F.lit(True).alias("name")).unionByName(blocks.select("source_id", "c", F.lit(False).alias("name")))
    both = both.groupBy("source_id", "c").agg(F.max("name").alias("name"))
    counts = both.groupBy("source_id").agg(F.count("*").alias("n"), F.count_if("name").alias("n_names")).join(size, "source_id").where(F.col("n") < LEAST_GAIN * F.col("n_cols"))
    last = F.row_number().over(Window.partitionBy("source_id", "name").orderBy(F.desc("c")))
    ranked = both.join(counts, "source_id").withColumn("last", last)
    return ranked.where(F.col("name") | (F.col("last") <= F.greatest(MAX_COLS - F.col("n_names"), F.lit(0)))).select("source_id", "c")


def snapshots(cells: DataFrame, asked: DataFrame) -> DataFrame:
    """``(source_id, view, n_rows, n_cols, snapshot)``, one row for each sheet with cells that something is asked of.

    ``view`` is ``selected`` where rows or columns were chosen, else
    ``truncated`` or ``whole``. The text has a line for each row on show, with
    the sheet's own row and column numbers; longer cells are cut and marked.
    """
    cells = cells.join(asked.select("source_id").distinct(), "source_id", "left_semi")
    rows = relevant_rows(cells, asked)
    cols = relevant_columns(cells, asked, rows)
    by_rows = rows.groupBy("source_id").agg(F.count("*").alias("kept_rows"))
    by_cols = cols.groupBy("source_id").agg(F.count("*").alias("kept_cols"))
    sheets = _sizes(cells).join(by_rows, "source_id", "left").join(by_cols, "source_id", "left")
    selected = F.col("kept_cols").isNotNull() | F.coalesce(F.col("kept_rows") < LEAST_GAIN * F.col("n_rows"), F.lit(False))
    over = (F.col("n_rows") > MAX_ROWS) | (F.col("n_cols") > MAX_COLS)
    sheets = sheets.withColumn("view", F.when(selected, "selected").when(over, "truncated").otherwise("whole"))

    some_rows = (F.col("view") == "selected") & F.col("kept_rows").isNotNull()
    place = F.row_number().over(Window.partitionBy("source_id").orderBy("r"))
    few = rows.withColumn("place", place).where(F.col("place") <= MAX_ROWS).join(sheets.where(some_rows).select("source_id"), "source_id", "left_semi").select("source_id", "r")
    first = sheets.where(~some_rows).select("source_id", F.explode(F.sequence(F.lit(0), F.least(F.lit(MAX_ROWS), F.col("n_rows")).cast("int") - 1)).alias("r"))
    lines = few.unionByName(first)

    some_cols = F.col("kept_cols").isNotNull()
    place = F.row_number().over(Window.partitionBy("source_id").orderBy("c"))
    narrow = cols.withColumn("place", place).where(F.col("place") <= MAX_COLS).select("source_id", "c")
    wide = sheets.where(~some_cols).select("source_id")
    text = F.when(F.length("t") > MAX_CHARS, F.concat(F.substring("t", 1, MAX_CHARS), F.lit("…"))).otherwise(F.col("t"))
    seen = cells.select("source_id", "r", "c", _shown().alias("t")).where(F.trim("t") != "")
    seen = seen.join(narrow, ["source_id", "c"], "left_semi").unionByName(seen.where(F.col("c") < MAX_COLS).join(wide, "source_id", "left_semi"))
    seen = seen.select("source_id", "r", F.col("c").cast("int").alias("c"), F.concat(F.lit("["), F.col("c").cast("string"), F.lit("]='"), text, F.lit("'")).alias("t"))

    cell = F.when(F.col("t").isNotNull(), F.struct("c", "t"))
    shown = lines.join(seen, ["source_id", "r"], "left").groupBy("source_id", "r").agg(F.array_sort(F.collect_list(cell)).alias("x"))
    body = F.when(F.size("x") == 0, "(empty)").otherwise(F.array_join(F.transform("x", lambda v: v["t"]), " "))
    line = shown.select("source_id", F.struct(F.col("r").cast("long").alias("r"), F.concat(F.lit("row "), F.col("r").cast("string"), F.lit(": "), body).alias("line")).alias("l"))
    whole = line.groupBy("source_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("l")), lambda v: v["line"]), "\n").alias("snapshot"))
    return sheets.join(whole, "source_id").select("source_id", "view", "n_rows", "n_cols", "snapshot")


def advertised_labels(labels: DataFrame, most: int = MAX_LABELS) -> DataFrame:
    """``(source_id, block)``: a line with the description of a source, and below it its first ``most`` distinct labels.

    ``labels(source_id, description, ord, label)``; a label's place is its first one.
    """
    once = labels.where("label is not null").groupBy("source_id", "label").agg(F.min("ord").alias("ord"), F.min("description").alias("description"))
    place = F.row_number().over(Window.partitionBy("source_id").orderBy("ord", "label"))
    few = once.withColumn("place", place).where(F.col("place") <= most)
    lines = F.transform(F.array_sort(F.collect_list(F.struct("place", "label"))), lambda x: F.concat(F.lit("  - "), x["label"]))
    return few.groupBy("source_id").agg(F.concat_ws("\n", F.concat(F.lit("["), F.coalesce(F.min("description"), F.lit("")), F.lit("]")), lines).alias("block"))


def counted_answers(answers: DataFrame, queries: DataFrame) -> DataFrame:
    """``(source_id, query, r, c)``: the first answer to each known query that was found and has both coordinates.

    ``answers(source_id, query, ord, found, r, c)`` as a hook gave them,
    ``queries(source_id, query)`` as they were asked.
    """
    whole = answers.where("found and r is not null and c is not null").join(queries.select("source_id", "query").distinct(), ["source_id", "query"], "left_semi")
    return whole.groupBy("source_id", "query").agg(F.min_by(F.struct("r", "c"), F.struct("ord", "r", "c")).alias("at")).select("source_id", "query", "at.r", "at.c")
