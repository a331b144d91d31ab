"""Removal of repeated byte strings by a hash-compared suffix sort.

A string of ``length`` bytes is removed wherever it occurs if it occurs again
anywhere. Equal strings choose the same anchor in them (the smallest hash of a
``GRAM``-byte string), so strings can only be equal where anchors are:

1. Each text is cut into runs of string starts that share an anchor.
2. Runs whose anchor occurs once anywhere are done. A run whose whole span
   occurs twice, by a cryptographic digest of its bytes, repeats throughout and
   needs no sort.
3. Of the other spans with a shared anchor, one occurrence each is fetched and
   their suffixes are sorted: prefix polynomial hashes and binary search find
   the common extension of two suffixes, so a comparison in the mergesort
   takes a logarithmic number of steps. Neighbours that agree on ``length``
   bytes are compared byte by byte before they count.
   Anchors with very many spans are dealt out by a digest of each string instead.
4. The starts found go back to every occurrence of their span, and the bytes
   they cover are cut out of the texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factspan.llm.bytetext import U64, PrefixHash, chunks, mix
from factspan.llm.tables import discard, fresh, settled, written

LENGTH = 200
GRAM = 32
#: Spans that share an anchor and are sorted in one task; more go by the digest of each string instead.
SORTED_TOGETHER = 20_000
_BATCH = 4_000


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every ``w`` neighbours, by prefix and suffix minima of blocks."""
    n = len(x) - w + 1
    pad = np.full(-len(x) % w, np.iinfo(x.dtype).max, x.dtype)
    blocks = np.concatenate([x, pad]).reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[w - 1 : w - 1 + n])


def runs(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Runs of string starts with one anchor: text, first start, number of starts, hash of the anchor."""
    if len(data) < length:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, U64),)
    p = PrefixHash(data)
    at = np.arange(len(data) - gram + 1)
    g = mix(p.of(at, at + gram))
    least = sliding_min(g, length - gram + 1)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(least)]
    last = offsets[1:][text]
    fine = np.arange(len(least)) + length <= last
    # the leftmost of equal grams is the anchor, so a run ends where the anchor itself is a start
    ends = fine.copy()
    ends[:-1] &= ~fine[1:] | (least[1:] != least[:-1]) | (text[1:] != text[:-1]) | (g[: len(least) - 1] == least[:-1])
    first = fine.copy()
    first[1:] &= ~fine[:-1] | ends[:-1]
    s, e = np.flatnonzero(first), np.flatnonzero(ends)
    return text[s], s - offsets[text[s]], e - s + 1, least[s]


def digests(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> pa.Array:
    """A cryptographic digest of 128 bits for each string of bytes."""
    raw = memoryview(data.tobytes())
    return pa.array([hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(start.tolist(), stop.tolist(), strict=True)], pa.binary())


def suffix_sort(p: PrefixHash, data: np.ndarray, start: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes at ``start``, cut to ``limit`` bytes, and each one's extension shared with the one before.

    Suffixes are told apart by their first eight bytes where these differ;
    runs of equal ones are merged bottom-up, many runs at a time.
    """
    key = np.zeros(len(start), U64)
    for k in range(8):
        key = (key << U64(8)) | data[start + k].astype(U64)
    order = np.argsort(key, kind="stable")
    key = key[order]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    group = np.cumsum(new) - 1
    begin = np.flatnonzero(new)
    size = np.diff(np.append(begin, len(key)))
    width = 1
    while True:
        member = np.flatnonzero(size[group] > width)
        if not len(member):
            break
        base, total = begin[group[member]], size[group[member]]
        pos = member - base
        run = pos // width
        sib = run ^ 1
        lo = np.minimum(sib * width, total)
        hi = np.minimum(lo + width, total)
        at0, own, left = lo.copy(), order[member], (run & 1) == 0
        while True:  # how many of the sibling run go before
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                break
            mid = (lo[open_] + hi[open_]) >> 1
            other = order[base[open_] + mid]
            c = compare(p, data, start[other], start[own[open_]], limit)
            less = (c < 0) | ((c == 0) & ~left[open_])
            lo[open_] = np.where(less, mid + 1, lo[open_])
            hi[open_] = np.where(less, hi[open_], mid)
        to = base + (run >> 1) * (2 * width) + (pos - run * width) + (lo - at0)
        moved = order.copy()
        moved[to] = own
        order = moved
        width *= 2
    shared = np.zeros(len(order), np.int64)
    if len(order) > 1:
        shared[1:] = extension(p, start[order[:-1]], start[order[1:]], limit)
    return order, shared


def extension(p: PrefixHash, a: np.ndarray, b: np.ndarray, limit: int) -> np.ndarray:
    """Length of the common extension of suffixes, at most ``limit``, by binary search on prefix hashes."""
    lo, hi = np.zeros(len(a), np.int64), np.full(len(a), limit, np.int64)
    for _ in range(limit.bit_length()):
        mid = (lo + hi + 1) >> 1
        same = p.of(a, a + mid) == p.of(b, b + mid)
        lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
    return lo


def compare(p: PrefixHash, data: np.ndarray, a: np.ndarray, b: np.ndarray, limit: int) -> np.ndarray:
    n = extension(p, a, b, limit)
    k = np.minimum(n, limit - 1)
    return np.where(n == limit, 0, np.sign(data[a + k].astype(np.int16) - data[b + k].astype(np.int16)))


def _runs(batches: Iterator[pa.RecordBatch], length: int, gram: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, data, offsets in chunks(batch, "text", 1 << 20):
            text, s, n, anchor = runs(data, offsets, length, gram)
            at = offsets[text] + s
            yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), digests(data, at, at + n + length - 1), rows.column("key").take(pa.array(text)), pa.array(s.astype(np.int32)), pa.array(n.astype(np.int32))], names=["anchor", "span", "key", "s", "n"])


def _fetch(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """The bytes of the spans that are wanted from each text."""
    for batch in batches:
        for rows, data, offsets in chunks(batch, "text", 1 << 20):
            out: dict[str, list] = {"anchor": [], "span": [], "bytes": []}
            for t, want in enumerate(rows.column("want").to_pylist()):
                for x in want:
                    at = int(offsets[t]) + x["s"]
                    out["anchor"].append(x["anchor"])
                    out["span"].append(x["span"])
                    out["bytes"].append(data[at : at + x["n"] + length - 1].tobytes())
            yield pa.RecordBatch.from_pydict(out, pa.schema([("anchor", pa.int64()), ("span", pa.binary()), ("bytes", pa.binary())]))


def _repeats(spans: list[bytes], length: int) -> list[list[int]]:
    """For each span, the starts in it (as first, one past the last, ...) of strings that occur at another start of any span."""
    data = np.frombuffer(b"".join(spans), np.uint8)
    size = np.array([len(b) for b in spans], np.int64)
    base = np.cumsum(size) - size
    count = size - length + 1
    owner = np.repeat(np.arange(len(spans)), count)
    start = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + base[owner]
    order, shared = suffix_sort(PrefixHash(data), data, start, length)
    near = np.flatnonzero(shared >= length)
    a, b = start[order[near - 1]], start[order[near]]
    same = np.ones(len(near), bool)
    for k in range(0, length, 8):  # byte by byte, whatever the hashes said
        for j in range(k, min(k + 8, length)):
            same &= data[a + j] == data[b + j]
    hit = np.zeros(len(start), bool)
    hit[order[near[same] - 1]] = hit[order[near[same]]] = True
    first = np.cumsum(count) - count
    out = []
    for t, n in enumerate(count.tolist()):
        own = np.zeros(n + 2, np.int8)
        own[1:-1] = hit[first[t] : first[t] + n]
        out.append(np.flatnonzero(np.diff(own)).tolist())
    return out


def _sort_spans(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Batches arrive in order of anchor; anchors are handled whole, many at a time."""
    held: list[tuple[int, bytes, bytes]] = []

    def done(rows: list[tuple[int, bytes, bytes]]) -> pa.RecordBatch:
        found = _repeats([r[2] for r in rows], length)
        return pa.RecordBatch.from_pydict({"span": [r[1] for r in rows], "starts": found}, pa.schema([("span", pa.binary()), ("starts", pa.list_(pa.int32()))]))

    for batch in batches:
        for at in range(0, batch.num_rows, _BATCH):
            held += zip(*(batch.column(c).slice(at, _BATCH).to_pylist() for c in ("anchor", "span", "bytes")), strict=True)
            cut = len(held)
            while cut and held[cut - 1][0] == held[-1][0]:
                cut -= 1
            if cut >= _BATCH:
                yield done(held[:cut])
                held = held[cut:]
    if held:
        yield done(held)


def _explode_strings(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for anchor, span, raw in zip(*(batch.column(c).to_pylist() for c in ("anchor", "span", "bytes")), strict=True):
            data = np.frombuffer(raw, np.uint8)
            at = np.arange(len(data) - length + 1)
            yield pa.RecordBatch.from_arrays([digests(data, at, at + length), pa.array([span] * len(at), pa.binary()), pa.array(at.astype(np.int32))], names=["string", "span", "at"])


def _cut(batches: Iterator[pa.RecordBatch], length: int, kept: str | None) -> Iterator[pa.RecordBatch]:
    """Cut the covered bytes out of each text: counts and digest, or the text itself."""
    for batch in batches:
        for rows, data, offsets in chunks(batch, "text", 1 << 20):
            out = []
            for t, want in enumerate(rows.column("starts").to_pylist()):
                raw = data[offsets[t] : offsets[t + 1]]
                d = np.zeros(len(raw) + 1, np.int32)
                for r in want or ():
                    d[r["a"]] += 1
                    d[r["b"]] -= 1
                gone = np.cumsum(d)[:-1] > 0
                begins = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
                out.append((int(gone.sum()), begins, raw[~gone].tobytes()))
            last = pa.array([hashlib.sha256(x[2]).hexdigest() for x in out]) if kept is None else pa.array([x[2] for x in out], pa.binary())
            yield pa.RecordBatch.from_arrays([rows.column("key"), pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), last], names=["key", "n_removed", "n_spans", "kept"])


def _keyed(docs: DataFrame) -> DataFrame:
    """Adds the first 128 bits of the SHA-256 digest of the text."""
    return docs.withColumn("key", _key("text"))


def _key(text: str) -> Column:
    return F.substring(F.unhex(F.sha2(F.col(text).cast("binary"), 256)), 1, 16)


def _covered(docs: DataFrame, length: int, gram: int, kept: str | None) -> tuple[DataFrame, DataFrame]:
    """Distinct texts with bytes to cut, as ``_cut`` returns them, and ``(key)`` of texts that have copies."""
    keyed = _keyed(docs.select("text")).where(f"octet_length(text) >= {length}")
    copied = written(keyed.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key"), "copies")
    found = written(keyed.mapInArrow(partial(_runs, length=length, gram=gram), "anchor bigint, span binary, key binary, s int, n int"), "runs")
    shared = found.groupBy("anchor").agg(F.count("*").alias("c")).where("c > 1").select("anchor")
    held = written(found.join(shared, "anchor"), "shared")
    discard(found)

    place = F.struct("key", "s")
    spans = held.groupBy("anchor", "span").agg(F.min(F.struct("key", "s", "n")).alias("low"), F.max(place).alias("high"))
    spans = written(spans.select("anchor", "span", "low", (F.struct("low.key", "low.s") != F.col("high")).alias("twice")), "spans")
    kinds = spans.groupBy("anchor").agg(F.count("*").alias("kinds")).where("kinds > 1")
    edge = spans.join(kinds, "anchor")
    texts = written(keyed.join(held.select("key").distinct(), "key").dropDuplicates(["key"]).select("key", "text"), "texts")
    want = edge.groupBy("low.key").agg(F.collect_list(F.struct("anchor", "span", "low.s", "low.n")).alias("want"))
    fetched = written(texts.join(want, "key").select("text", "want").mapInArrow(partial(_fetch, length=length), "anchor bigint, span binary, bytes binary"), "fetched")

    many = kinds.where(F.col("kinds") > SORTED_TOGETHER).select("anchor")
    sorted_ = (
        fetched.join(many, "anchor", "left_anti").repartition("anchor").sortWithinPartitions("anchor").mapInArrow(partial(_sort_spans, length=length), "span binary, starts array<int>")
    )
    strings = fetched.join(many, "anchor").mapInArrow(partial(_explode_strings, length=length), "string binary, span binary, at int")
    again = strings.groupBy("string").agg(F.count("*").alias("c")).where("c > 1").select("string")
    hashed = strings.join(again, "string").select("span", F.array("at", F.col("at") + 1).alias("starts"))
    whole = spans.where("twice").select("span", F.array(F.lit(0), F.col("low.n")).alias("starts"))
    marks = sorted_.where(F.size("starts") > 0).unionByName(hashed).unionByName(whole)
    pair = F.explode(F.sequence(F.lit(0), F.size("starts") - 2, F.lit(2))).alias("i")
    ranges = (
        held.select("key", "span", "s").join(marks, "span").select("key", "s", "starts", pair)
        .select("key", F.struct((F.col("s") + F.get("starts", "i")).alias("a"), (F.col("s") + F.get("starts", F.col("i") + 1) - 1 + length).alias("b")).alias("r"))
        .groupBy("key").agg(F.collect_set("r").alias("starts"))
    )
    kind = "string" if kept is None else "binary"
    done = settled(texts.join(ranges, "key").mapInArrow(partial(_cut, length=length, kept=kept), f"key binary, n_removed bigint, n_spans bigint, kept {kind}"))
    copied, old = settled(copied), copied
    discard(held, spans, texts, fetched, old)
    return done, copied


def repeat_report(docs: DataFrame, *, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256; one row for each row of ``docs``.

    Texts are judged as UTF-8 bytes; a null text is empty. Every byte of a
    string of ``length`` bytes that starts anywhere else too, in the same text
    or another, goes, overlaps included; what is judged is the input, not what
    is left. A text shorter than ``length`` loses nothing; rows that repeat a
    text are copies of it. Texts, and spans that are not sorted, are told apart
    by cryptographic digests of 128 bits; sorted strings by their bytes.
    """
    done, copied = _covered(docs, length, gram, None)
    slim = _keyed(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))).select("doc_id", "key", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("sha"))
    out = slim.join(done, "key", "left").join(copied.withColumn("copy", F.lit(True)), "key", "left")
    gone = F.coalesce(F.col("copy"), F.lit(False))
    return out.select(
        "doc_id",
        "n_bytes",
        F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(gone, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(gone, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"),
    )


def remove_repeats(docs: DataFrame, *, text: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``docs`` with the repeated bytes cut out of ``text``; pieces of a character at a cut go with it. A null text stays null."""
    key, kept, copy = fresh(docs, "key", "kept", "copy")
    done, copied = _covered(docs.select(F.col(text).alias("text")), length, gram, "text")
    done = done.select(F.col("key").alias(key), F.col("kept").alias(kept))
    out = docs.withColumn(key, _key(text))
    out = out.join(done, key, "left").join(copied.select(F.col("key").alias(key), F.lit(True).alias(copy)), key, "left")
    return out.withColumn(text, F.when(F.col(copy), F.lit("")).when(F.col(kept).isNotNull(), F.regexp_replace(F.make_valid_utf8(F.col(kept).cast("string")), "\ufffd", "")).otherwise(F.col(text))).select(*docs.columns)
