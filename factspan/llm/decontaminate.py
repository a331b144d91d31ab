"""Benchmark decontamination by a broadcast hash set of normalised word windows.

The windows of the benchmark are hashed and broadcast in blocks of bounded
size; each block scans every training text once, and each hash hit is verified
against the words of the window before it counts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factspan.llm.bytetext import ALNUM, U64, Words, chunks
from factspan.llm.tables import discard, fresh, without, written

#: Words of a window.
WINDOW = 10
#: Windows in one broadcast block, and bytes of their words; more are scanned in further blocks.
BLOCK = 500_000
BLOCK_BYTES = 100 << 20
#: Bits of the table that most hashes are turned away by.
_FILTER_BITS = 22


def _benchmark_windows(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, data, offsets in chunks(batch, "text"):
            words = Words(data, offsets, ALNUM)
            ids = rows.column("item").to_pylist()
            out: dict[str, list] = {"item": [], "n": [], "hash": [], "words": []}
            for n in sorted({min(window, int(c)) for c in words.count if c}):
                at, h = words.grams(n)
                for i, x in zip(at.tolist(), h.tolist(), strict=True):
                    t = words.text[i]
                    if n == window or words.count[t] == n:
                        for k, v in zip(out, (ids[t], n, x - (1 << 64) if x >> 63 else x, words.join(i, n)), strict=True):
                            out[k].append(v)
            yield pa.RecordBatch.from_pydict(out, pa.schema([("item", pa.string()), ("n", pa.int32()), ("hash", pa.int64()), ("words", pa.binary())]))


class WindowSet:
    """Windows of one block: by length, the words and items of each hash."""

    def __init__(self, rows: list):
        self.by_length: dict[int, dict[int, dict[bytes, set[str]]]] = {}
        for item, n, h, words in rows:
            self.by_length.setdefault(n, {}).setdefault(h % (1 << 64), {}).setdefault(bytes(words), set()).update(() if item is None else (item,))
        self.filters = {}
        for n, d in self.by_length.items():
            f = np.zeros(1 << _FILTER_BITS, bool)
            f[np.fromiter(d, U64, len(d)) >> U64(64 - _FILTER_BITS)] = True
            self.filters[n] = f

    def scan(self, words: Words, diff: np.ndarray, items: dict[int, set[str]]) -> None:
        """Mark the words that a window covers in ``diff`` (+1 at the first, -1 after the last)."""
        for n, known in self.by_length.items():
            at, h = words.grams(n)
            near = np.flatnonzero(self.filters[n][h >> U64(64 - _FILTER_BITS)])
            for i, x in zip(at[near].tolist(), h[near].tolist(), strict=True):
                if (same := known.get(x)) and (found := same.get(words.join(i, n))) is not None:
                    diff[i] += 1
                    diff[i + n] -= 1
                    items.setdefault(int(words.text[i]), set()).update(found)


def _scan(batches: Iterator[pa.RecordBatch], windows, text: str, names: list[str], first: bool) -> Iterator[pa.RecordBatch]:
    known = windows.value
    hits, items = names[:2]
    for batch in batches:
        for rows, data, offsets in chunks(batch, text):
            words = Words(data, offsets, ALNUM)
            diff, found = np.zeros(len(words.start) + 1, np.int64), {}
            n = rows.num_rows
            if not first:
                for t, (spans, ids) in enumerate(zip(rows.column(hits).to_pylist(), rows.column(items).to_pylist(), strict=True)):
                    for a, b in zip(spans[::2], spans[1::2], strict=True):
                        diff[words.first[t] + a] += 1
                        diff[words.first[t] + b] -= 1
                    if ids:
                        found[t] = set(ids)
            known.scan(words, diff, found)
            hit = np.cumsum(diff)[:-1] > 0
            spans = [[] for _ in range(n)]
            for t in np.unique(words.text[hit]).tolist():
                own = np.zeros(words.count[t] + 2, np.int8)
                own[1:-1] = hit[words.first[t] : words.first[t + 1]]
                spans[t] = np.flatnonzero(np.diff(own)).tolist()
            keep = [c for c in rows.schema.names if c not in names]
            cols = [rows.column(c) for c in keep] + [
                pa.array(spans, pa.list_(pa.int32())),
                pa.array([sorted(found.get(t, ())) for t in range(n)], pa.list_(pa.string())),
                pa.array(words.count, pa.int64()),
                pa.array(np.bincount(words.text[hit], minlength=n), pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(cols, names=[*keep, *names])


def find_windows(
    docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_text: str = "text", item_id: str = "item_id",
    names: tuple[str, ...] = ("hits", "items", "n_words", "n_hit"), window: int = WINDOW, block: int = BLOCK,
) -> DataFrame:
    """Add to each document the word spans that a benchmark window covers, and the items they come from.

    Adds four columns, called ``names``: word positions in pairs, first and one
    past the last, of maximal runs; the ids as sorted strings; the number of
    words; the number of covered words. Lower-cases A-Z; words
    are runs of digits, letters a-z and characters beyond ASCII. An item of
    fewer than ``window`` words is one window; items without words have none.
    Windows of items with a null id hit as others do, but no id is listed for
    them. A null or empty text has no words and no hits. Every row of ``docs``
    is kept as often as it occurs, with all its columns but those called like
    one of ``names``, which are replaced.
    """
    docs = without(docs, text, *names)
    spark = docs.sparkSession
    got = benchmark.select(F.col(item_id).cast("string").alias("item"), F.col(item_text).alias("text")).where("text is not null")
    windows = written(got.mapInArrow(partial(_benchmark_windows, window=window), "item string, n int, hash bigint, words binary").distinct(), "windows")
    total, size = windows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("words")), F.lit(0))).first()
    blocks = max(1, -(-total // block), -(-size // BLOCK_BYTES))
    types = {f.name: f.dataType for f in docs.schema}
    schema = ", ".join(f"`{c}` {types[c].simpleString()}" for c in docs.columns) + ", `{}` array<int>, `{}` array<string>, `{}` bigint, `{}` bigint".format(*names)
    out, held = docs, None
    for k in range(blocks):
        own = windows.where(F.pmod(F.xxhash64("hash", "n", "words", "item"), F.lit(blocks)) == k)
        known = spark.sparkContext.broadcast(WindowSet([tuple(r) for r in own.collect()]))
        out = out.mapInArrow(partial(_scan, windows=known, text=text, names=list(names), first=k == 0), schema)
        if k < blocks - 1:
            old, out = held, written(out, "scan")
            held = out
            if old is not None:
                discard(old)
    discard(windows)
    return out


def _without(batches: Iterator[pa.RecordBatch], text: str, hits: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(text).to_pylist()
        for t, spans in enumerate(batch.column(hits).to_pylist()):
            if not spans:
                continue
            raw = texts[t].encode()
            words = Words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), ALNUM)
            parts, at = [], 0
            for a, b in zip(spans[::2], spans[1::2], strict=True):
                parts.append(raw[at : words.start[a]])
                at = words.stop[b - 1]
            texts[t] = b"".join([*parts, raw[at:]]).decode()
        k = batch.schema.names.index(text)
        yield batch.set_column(k, text, pa.array(texts, pa.string()))


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, mode: str = "documents", text: str = "text", **options) -> DataFrame:
    """Documents without benchmark text, with the columns of ``docs``.

    ``mode`` "documents" drops every document with a verified window; "spans"
    keeps it and cuts the covered words, with the characters between them, out
    of its text. Null and empty texts are kept as they are.
    """
    names = fresh(docs, "hits", "items", "n_words", "n_hit")
    hits = names[0]
    found = find_windows(docs, benchmark, text=text, names=tuple(names), **options)
    if mode == "documents":
        found = found.where(F.size(hits) == 0)
    elif mode == "spans":
        found = found.mapInArrow(partial(_without, text=text, hits=hits), found.schema)
    else:
        raise ValueError(f"mode: {mode}")
    return found.drop(*names)


def decontamination_report(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Counts and an item digest for each document, one row for each row of ``docs``."""
    found = find_windows(docs.select("doc_id", "text"), benchmark, **options)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )
