"""Narrative filters and the deterministic text-quality pass."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Non-standard words and their standard forms.
STANDARD_FORMS = {
    "resiko": "risiko", "aktifitas": "aktivitas", "aktifitasnya": "aktivitasnya", "jaman": "zaman", "ijin": "izin", "kwalitas": "kualitas",
    "kwantitas": "kuantitas", "analisa": "analisis", "sistim": "sistem", "konsekwensi": "konsekuensi", "frekwensi": "frekuensi", "aktip": "aktif",
    "negatip": "negatif", "positip": "positif", "efektip": "efektif", "subyek": "subjek", "obyek": "objek", "komplit": "komplet",
    "nasehat": "nasihat", "hakekat": "hakikat", "praktek": "praktik", "karir": "karier", "standarisasi": "standardisasi", "sekedar": "sekadar",
    "terlanjur": "telanjur", "nafas": "napas", "trampil": "terampil", "jadual": "jadwal", "hirarki": "hierarki", "menejemen": "manajemen",
}
#: Month abbreviations that count as table cells.
CELL_MONTHS = ["jan", "feb", "mar", "apr", "mei", "may", "jun", "jul", "ags", "agu", "aug", "sep", "okt", "oct", "nov", "des", "dec"]
_NUMERIC = r"^-?[\d.,]+%?$"
_CELL = r"^\(?-?[\d.,]+%?\)?$"
_TOKEN = r"[A-Za-z]+(?:-[A-Za-z]+)*"


def tokens_of(line: Column) -> Column:
    return F.filter(F.split(F.trim(line), r"\s+"), lambda t: t != "")


def line_class(line: Column) -> Column:
    """``skip`` under six tokens, ``table`` where over 55 % are numbers, else ``narrative``."""
    t = tokens_of(line)
    numbers = F.size(F.filter(t, lambda x: x.rlike(r"^[\d.,%()\-]+$")))
    return F.when(F.size(t) < 6, "skip").when(numbers > 0.55 * F.size(t), "table").otherwise("narrative")


def trailing_cells(tokens: Column) -> Column:
    """How many tokens at the end of a line are table cells."""
    run = F.aggregate(F.reverse(tokens), F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda a, t: F.struct((a["n"] + F.when(a["on"] & t.rlike(_CELL), 1).otherwise(0)).alias("n"), (a["on"] & t.rlike(_CELL)).alias("on")))
    return run["n"]


def is_tabular(line: Column) -> Column:
    """Lines that are rows of a table: pipes, wide gaps, mostly numbers and months, or three cells at the end."""
    s, t = F.trim(line), tokens_of(line)
    cells = F.size(F.filter(t, lambda x: x.rlike(_NUMERIC) | F.lower(x).isin(CELL_MONTHS)))
    return s.startswith("|") | s.rlike(r"\S {4,}\S") | ((F.size(t) >= 8) & (cells >= 0.65 * F.size(t))) | ((F.size(t) >= 3) & (trailing_cells(t) >= 3))


def strip_tabular(lines: DataFrame, order: str = "line_no") -> DataFrame:
    """Lines ``(doc_id, line_no, line)`` without table rows, runs of blank lines collapsed to one."""
    kept = lines.where(~is_tabular(F.col("line")))
    blank = F.trim("line") == ""
    before = F.lag(blank).over(Window.partitionBy("doc_id").orderBy(order))
    return kept.withColumn("_blank", blank & F.coalesce(before, F.lit(False))).where("not _blank").drop("_blank")


def narrative_lines(lines: DataFrame) -> DataFrame:
    """Narrative lines of pages ``(doc_id, page, line_no, line)``.

    Pages whose first line of three words or more titles an appendix go, and
    so do pages where table lines are 70 % of table and kept lines. A starred
    line stays if it reads as narrative and has a digit; a line too short to
    tell stays where it continues a sentence that the line kept before it left
    open. That depends on what was kept, so each page is one small group.
    """
    import re

    appendix, opens, closed = re.compile(r"(?i)(Lampiran|Tabel\s+[IVX]+\.)"), re.compile(r"[\"'“(\[]*[a-z]"), re.compile(r"[.!?][\"'”)\]]*$")
    bare = F.regexp_replace(F.trim("line"), r"^\*+\s*", "")
    marked = lines.where(F.trim("line") != "").withColumns({"_kind": line_class(bare), "_star": F.trim("line").startswith("*"), "_digit": bare.rlike(r"\d"), "_words": F.size(tokens_of(F.col("line")))})
    names = lines.columns

    def keep(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("line_no")
        text = pdf["line"].str.strip()
        long = text[pdf["_words"] >= 3]
        rows, tables, last = [], 0, None
        for k, (t, kind, star, digit) in enumerate(zip(text, pdf["_kind"], pdf["_star"], pdf["_digit"], strict=True)):
            if star:
                stays = kind == "narrative" and digit
            else:
                tables += kind == "table"
                stays = kind == "narrative" or (kind == "skip" and last is not None and opens.match(t) is not None and closed.search(last) is None)
            if stays:
                rows.append(k)
                last = t
        drop = (len(long) and appendix.match(long.iloc[0])) or tables >= 0.7 * max(1, len(rows) + tables)
        return pdf.iloc[[] if drop else rows][names]

    return marked.groupBy("doc_id", "page").applyInPandas(keep, lines.schema)


def page_chunks(pages: DataFrame, size: int = 6000) -> DataFrame:
    """``(doc_id, page, chunk)``: pages filled greedily into chunks of at most ``size`` characters; a longer page stands alone."""

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("page")
        chunk, held, out = 0, 0, []
        for n in pdf["n"]:
            if held and held + n > size:
                chunk, held = chunk + 1, 0
            held += n
            out.append(chunk)
        return pdf.assign(chunk=out)[["doc_id", "page", "chunk"]]

    kind = pages.schema["doc_id"].dataType.simpleString()
    sizes = pages.select("doc_id", "page", F.length("text").alias("n"))
    return sizes.groupBy("doc_id").applyInPandas(fill, f"doc_id {kind}, page int, chunk int")


def page_of_offset(offsets: DataFrame, ranges: DataFrame) -> DataFrame:
    """``(doc_id, start, page)``: the page whose range holds an offset, the last page beyond all: an as-of join in one sorted pass.

    ``ranges(doc_id, begin, page)`` begin where the one before ends.
    """
    marks = ranges.select("doc_id", F.col("begin").alias("at"), "page", F.lit(0).alias("side"), F.lit(None).cast("long").alias("start"))
    asked = offsets.select("doc_id", F.col("start").alias("at"), F.lit(None).cast("int").alias("page"), F.lit(1).alias("side"), F.col("start").cast("long").alias("start"))
    w = Window.partitionBy("doc_id").orderBy("at", "side")
    both = marks.unionByName(asked).withColumn("page", F.last("page", ignorenulls=True).over(w))
    return both.where("side = 1").select("doc_id", "start", "page")


def word_tokens(docs: DataFrame, text: str = "text") -> DataFrame:
    """``(doc_id, pos, word, gap)``: words with inner hyphens, and what stands between each and the word before."""
    pairs = F.regexp_extract_all(text, F.lit(rf"(.*?)({_TOKEN})".replace(".*?", "[^A-Za-z]*")), F.lit(0))
    exploded = docs.select("doc_id", F.posexplode(pairs).alias("pos", "raw"))
    return exploded.select("doc_id", "pos", F.regexp_extract("raw", rf"({_TOKEN})$", 1).alias("word"), F.regexp_extract("raw", r"^([^A-Za-z]*)", 1).alias("gap"))


def reduplications(docs: DataFrame) -> DataFrame:
    """``(doc_id, pos, word, suggestion)``: a word written twice with white space between, the second in lower case.

    Pairs do not overlap: of a run of equal words every other one begins a pair.
    """
    w = Window.partitionBy("doc_id").orderBy("pos")
    t = word_tokens(docs).withColumns({"nxt": F.lead("word").over(w), "gap_after": F.lead("gap").over(w)})
    fits = F.col("gap_after").rlike(r"^\s+$") & (F.col("nxt") == F.lower("word")) & ~F.contains("word", F.lit("-")) & (F.length("word") >= 3)
    t = t.withColumn("pair", F.coalesce(fits, F.lit(False)))
    new = F.when(F.col("pair") & ~F.coalesce(F.lag("pair").over(w), F.lit(False)), 1).otherwise(0)
    t = t.withColumn("run", F.sum(new).over(w)).where("pair")
    place = F.row_number().over(Window.partitionBy("doc_id", "run").orderBy("pos"))
    return t.withColumn("_k", place).where("_k % 2 = 1").select("doc_id", "pos", F.concat_ws(" ", "word", "nxt").alias("word"), F.concat_ws("-", "word", "nxt").alias("suggestion"))


def nonstandard_words(docs: DataFrame, forms: DataFrame) -> DataFrame:
    """``(doc_id, pos, word, suggestion)`` of words that ``forms(form, suggestion)`` has, in any case."""
    t = word_tokens(docs).select("doc_id", "pos", "word", F.lower("word").alias("form"))
    return t.join(forms, "form").select("doc_id", "pos", "word", "suggestion")


def unknown_words(docs: DataFrame, dictionary: DataFrame) -> DataFrame:
    """``(word, n, n_docs)``: lower-case words that ``dictionary(word)`` lacks, each once with its uses.

    One-letter words, and two letters without a vowel, are not words; fragments
    that with a neighbour, one blank apart, are in the dictionary are not either.
    Neighbours are those in the same row, whatever its ``doc_id``; rows without
    one count in ``n`` but not in ``n_docs``. The dictionary is broadcast.
    """
    pairs = docs.select("doc_id", F.regexp_extract_all("text", F.lit(rf"([^A-Za-z]*)({_TOKEN})"), F.lit(0)).alias("pairs"))
    split = pairs.select("doc_id", F.transform("pairs", lambda x: F.regexp_extract(x, rf"({_TOKEN})$", 1)).alias("word"), F.transform("pairs", lambda x: F.regexp_extract(x, r"^([^A-Za-z]*)", 1)).alias("gap"))
    after = lambda c: F.slice(c, F.lit(2), F.size(c))
    near = {"prev": F.concat(F.array(F.lit(None).cast("string")), F.col("word")), "nxt": after(F.col("word")), "gap_after": after(F.col("gap"))}
    t = split.withColumns(near).select("doc_id", F.explode(F.arrays_zip("word", "gap", "prev", "nxt", "gap_after")).alias("x")).select("doc_id", "x.*")
    lower = t.where((F.col("word") == F.lower("word")) & (F.length("word") >= 2) & ~((F.length("word") == 2) & ~F.col("word").rlike("[aiueo]")))
    known = F.broadcast(dictionary.select(F.col("word").alias("_joined")))  # else every word of every text is shuffled
    open_ = lower.join(known, F.col("word") == F.col("_joined"), "left_anti")
    left = F.when(F.col("gap") == " ", F.lower(F.concat("prev", "word")))
    right = F.when(F.col("gap_after") == " ", F.lower(F.concat("word", "nxt")))
    for side in (left, right):
        open_ = open_.withColumn("_side", side).join(known, F.col("_side") == F.col("_joined"), "left_anti").drop("_side")
    return open_.groupBy("word").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("n_docs"))


def prefix_candidates(docs: DataFrame, dictionary: DataFrame) -> DataFrame:
    """``(doc_id, pos, display, joined)``: ``di`` or ``ke`` apart from a word with which it makes one of the dictionary."""
    w = Window.partitionBy("doc_id").orderBy("pos")
    t = word_tokens(docs).withColumns({"nxt": F.lead("word").over(w), "gap_after": F.lead("gap").over(w)})
    t = t.where(F.lower("word").isin("di", "ke") & F.col("gap_after").rlike(r"^\s+$")).withColumn("joined", F.lower(F.concat("word", "nxt")))
    return t.join(dictionary.select(F.col("word").alias("joined")), "joined", "left_semi").select("doc_id", "pos", F.concat_ws(" ", "word", "nxt").alias("display"), "joined")


def apply_verdicts(occurrences: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Occurrences ``(word, ...)`` with the category and suggestion of their word; without either they are dropped."""
    fine = verdicts.where("category is not null and suggestion is not null").select("word", "category", "suggestion")
    return occurrences.join(fine, "word")
