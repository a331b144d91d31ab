"""Documents as one text with page markers, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factspan.functions.core import let

#: A page's marker, as a pattern and as a text to fill in.
MARKER = r"\[== Halaman (\d+) ==\]"
MARKER_TEXT = "[== Halaman %d ==]"
#: A text layer of fewer characters, or with text on a smaller share of pages, is not used.
LEAST_CHARS = 200
LEAST_PAGES = 0.5


def mark(page: Column) -> Column:
    return F.format_string(MARKER_TEXT, page.cast("long"))


def marked_text(pages: DataFrame) -> DataFrame:
    """``(doc_id, text)`` of ``pages(doc_id, page, text)``: pages in order, each after its marker; blank pages are left out."""
    full = pages.where(F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"(?U)\s+", " ")) != "")
    each = F.array_sort(F.collect_list(F.struct("page", F.concat(mark(F.col("page")), F.lit("\n"), "text").alias("t"))))
    return full.groupBy("doc_id").agg(F.array_join(F.transform(each, lambda x: x["t"]), "\n\n").alias("text"))


def _blocks(text: Column) -> Column:
    """The text cut before each marker: ``(page, content)``, empty contents left out; text before all markers has no page."""
    cut = F.split(text, rf"(?={MARKER})")
    block = F.transform(cut, lambda b: F.struct(F.nullif(F.regexp_extract(b, f"^{MARKER}", 1), F.lit("")).cast("int").alias("page"), F.regexp_replace(b, MARKER, "").alias("content")))
    return F.filter(block, lambda b: b["content"] != "")


def split_pages(docs: DataFrame) -> DataFrame:
    """``(doc_id, text, ranges)``: texts without markers, and which page each stretch of them is from.

    ``ranges array<struct<begin, stop, page>>`` are half-open, in characters.
    """
    blocks = docs.select("doc_id", _blocks(F.col("text")).alias("b"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<begin:int,stop:int,page:int>>").alias("out"))
    add = lambda a, b: F.struct((a["at"] + F.length(b["content"])).alias("at"), F.concat(a["out"], F.array(F.struct(a["at"].alias("begin"), (a["at"] + F.length(b["content"])).alias("stop"), b["page"].alias("page")))).alias("out"))
    return blocks.select("doc_id", F.array_join(F.transform("b", lambda x: x["content"]), "").alias("text"), F.aggregate("b", start, add, lambda a: a["out"]).alias("ranges"))


def page_in(ranges: Column, offset: Column) -> Column:
    """The page whose range holds an offset, the last one beyond all."""
    hit = F.filter(ranges, lambda r: (r["begin"] <= offset) & (offset < r["stop"]))
    return F.coalesce(F.get(hit, F.lit(0))["page"], F.when(F.size(hit) == 0, F.get(ranges, F.size(ranges) - 1)["page"]))


def page_before(text: Column, offset: Column) -> Column:
    """The page of the last marker before an offset (from 0) of a marked text, or null."""
    found = F.regexp_extract_all(F.substr(text, F.lit(1), offset), F.lit(MARKER), F.lit(1))
    return let(found, lambda x: F.get(x, F.size(x) - 1).cast("int"))


def renumber(text: Column, pages: Column) -> Column:
    """A transcription of several pages with the right markers, by position.

    Where it has as many markers as ``pages``, the k-th gets the k-th page;
    else all text goes to the first page, and the others follow empty.
    """
    pieces = F.split(text, MARKER)
    right = F.array_join(F.zip_with(pieces, F.concat(F.transform(pages, mark), F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")
    body = F.trim(F.regexp_replace(text, MARKER, ""))
    marks = F.array_join(F.transform(pages, mark), "\n")
    rest = F.array_join(F.transform(F.slice(pages, F.lit(2), F.size(pages)), lambda p: F.concat(F.lit("\n"), mark(p))), "")
    return F.when(F.size(pieces) == F.size(pages) + 1, right).when(body == "", marks).otherwise(F.concat(mark(F.get(pages, F.lit(0))), F.lit("\n"), body, rest))


def text_layer_use(pages: DataFrame) -> DataFrame:
    """``(doc_id, n_pages, n_chars, layer)``: whether a document's text layer is used, or its pages are transcribed."""
    text = F.trim(F.coalesce("text", F.lit("")))
    g = pages.groupBy("doc_id").agg(F.max("page").alias("n_pages"), F.sum(F.length(text)).alias("n_chars"), F.count_if(text != "").alias("n_text"))
    poor = (F.col("n_chars") < LEAST_CHARS) | (F.col("n_text") < LEAST_PAGES * F.col("n_pages"))
    return g.select("doc_id", "n_pages", "n_chars", F.when(poor, "transcribe").otherwise("text").alias("layer"))
