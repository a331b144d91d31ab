"""Workbooks as cells: a reader of zipped sheets on the standard library.

Each file is read on an executor; a file is a unit, as its format needs its
shared strings and styles. Values of percent formats are multiplied by 100,
values of date formats become times. A sheet's ``source_id`` is its file's name,
a slash between blanks, and its own name.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

CELLS = "path string, source_id string, sheet string, r int, c int, kind string, s_val string, d_val double, ts_val timestamp_ntz, bold boolean, fill boolean, top_border boolean, indent int"
MERGES = "path string, source_id string, sheet string, r0 int, r1 int, c0 int, c1 int"
#: Numbers of the built-in percent and date formats.
_PERCENT_BUILTIN = {9, 10}
_DATE_BUILTIN = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _at(ref: str) -> tuple[int, int]:
    letters, digits = re.match(r"([A-Z]+)(\d+)", ref).groups()
    col = 0
    for ch in letters:
        col = col * 26 + ord(ch) - 64
    return int(digits) - 1, col - 1


def _xml(z: zipfile.ZipFile, name: str):
    return ElementTree.fromstring(z.read(name)) if name in z.namelist() else None


def _text(node) -> str:
    return "".join(t.text or "" for t in node.iter() if _local(t.tag) == "t")


class Workbook:
    """Sheets, shared strings and cell styles of one file."""

    def __init__(self, data: bytes):
        self.z = zipfile.ZipFile(io.BytesIO(data))
        shared = _xml(self.z, "xl/sharedStrings.xml")
        self.strings = [_text(si) for si in shared] if shared is not None else []
        rels = {r.get("Id"): r.get("Target") for r in _xml(self.z, "xl/_rels/workbook.xml.rels")}
        self.sheets = []
        self.epoch = datetime(1899, 12, 30)
        for node in _xml(self.z, "xl/workbook.xml").iter():
            if _local(node.tag) == "workbookPr" and node.get("date1904") in ("1", "true"):
                self.epoch = datetime(1904, 1, 1)
            if _local(node.tag) == "sheet":
                rid = next(v for k, v in node.attrib.items() if _local(k) == "id")
                target = rels[rid]
                self.sheets.append((node.get("name"), target.lstrip("/") if target.startswith("/") else "xl/" + target))
        self.styles = self._styles()

    def _styles(self) -> list[dict]:
        root = _xml(self.z, "xl/styles.xml")
        if root is None:
            return []
        part = {_local(x.tag): x for x in root}
        kids = lambda name: list(part[name]) if name in part else []
        formats = {int(x.get("numFmtId")): x.get("formatCode", "") for x in kids("numFmts")}
        bold = [any(_local(k.tag) == "b" and k.get("val", "1") != "0" for k in f) for f in kids("fonts")]
        fill = [any(_local(k.tag) == "patternFill" and k.get("patternType", "none") not in ("none", "gray125") for k in f) for f in kids("fills")]
        top = [any(_local(k.tag) == "top" and k.get("style") for k in b) for b in kids("borders")]
        get = lambda seq, i: bool(seq[i]) if i < len(seq) else False
        out = []
        for xf in kids("cellXfs"):
            fmt = int(xf.get("numFmtId", 0))
            code = re.sub(r'"[^"]*"|\\.', "", formats.get(fmt, ""))
            indent = next((int(k.get("indent", 0)) for k in xf if _local(k.tag) == "alignment"), 0)
            date = fmt in _DATE_BUILTIN or bool(re.search("[ymdhs]", re.sub(r"\[[^\]]*\]|General", "", code), re.I))
            out.append({"percent": fmt in _PERCENT_BUILTIN or "%" in code, "date": date, "bold": get(bold, int(xf.get("fontId", 0))), "fill": get(fill, int(xf.get("fillId", 0))), "top": get(top, int(xf.get("borderId", 0))), "indent": indent})
        return out

    def cells(self, target: str) -> Iterator[tuple]:
        for node in _xml(self.z, target).iter():
            if _local(node.tag) != "c":
                continue
            r, c = _at(node.get("r"))
            style = self.styles[int(node.get("s", 0))] if int(node.get("s", 0)) < len(self.styles) else {}
            kind, s, d, ts = node.get("t", "n"), None, None, None
            raw = next((k.text for k in node if _local(k.tag) == "v"), None)
            if kind == "inlineStr":
                s = _text(node)
            elif raw is None:
                continue
            elif kind == "s":
                s = self.strings[int(raw)]
            elif kind in ("str", "e"):
                s = raw
            elif kind == "d":
                ts = datetime.fromisoformat(raw.rstrip("Z"))
            elif kind == "n" and style.get("date"):
                ts = self.epoch + timedelta(days=float(raw))
            else:
                d = float(raw) * (100 if style.get("percent") and kind == "n" else 1)
            name = "text" if s is not None else "date" if ts is not None else "bool" if kind == "b" else "num"
            yield r, c, name, s, d, ts, style.get("bold", False), style.get("fill", False), style.get("top", False), style.get("indent", 0)

    def merges(self, target: str) -> Iterator[tuple[int, int, int, int]]:
        for node in _xml(self.z, target).iter():
            if _local(node.tag) == "mergeCell":
                a, _, b = node.get("ref").partition(":")
                (r0, c0), (r1, c1) = _at(a), _at(b or a)
                yield r0, r1 + 1, c0, c1 + 1


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def _each(rows):
    def run(batches):
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                book = Workbook(content)
                out = [(path, f"{path.rpartition('/')[2]} / {name}", name, *x) for name, target in book.sheets for x in rows(book, target)]
                if out:
                    yield pd.DataFrame(out)

    return run


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    """Cells of all sheets of the ``.xlsx`` files at a path, as ``operators.grid`` takes them."""
    names = [x.split()[0] for x in CELLS.split(", ")]
    rows = _each(lambda b, t: b.cells(t))
    times = lambda x: x.set_axis(names, axis=1).assign(ts_val=lambda df: pd.to_datetime(df["ts_val"]))
    return _files(spark, path).mapInPandas(lambda it: (times(x) for x in rows(it)), CELLS)


def read_merges(spark: SparkSession, path: str) -> DataFrame:
    """Merged ranges, half-open."""
    names = [x.split()[0] for x in MERGES.split(", ")]
    rows = _each(lambda b, t: b.merges(t))
    return _files(spark, path).mapInPandas(lambda it: (x.set_axis(names, axis=1) for x in rows(it)), MERGES)


def sheet_names(spark: SparkSession, path: str) -> DataFrame:
    """``(path, sheet, ord)``."""

    def run(batches):
        for pdf in batches:
            for p, content in zip(pdf["path"], pdf["content"], strict=True):
                yield pd.DataFrame([(p, n, i) for i, (n, _) in enumerate(Workbook(content).sheets)], columns=["path", "sheet", "ord"])

    return _files(spark, path).mapInPandas(run, "path string, sheet string, ord int")
