"""MinHash near-dedup by an inverted join of signature coordinates.

1. Each text becomes a set of hashed word shingles and a signature of
   ``COORDINATES`` minima. Texts with equal sets are one class from here on.
2. A pair above the match threshold agrees on at least ``MATCHES``
   coordinates, hence on one of the first ``COORDINATES - MATCHES + 1``: only
   this prefix is posted under (coordinate, value). Postings with one class
   are dropped, and of postings with the same members all but one are skipped.
3. The members of a posting are posted under all their coordinates. Collisions
   are counted by merging a member's lists: the shortest ones are merged, one
   of which a pair at the threshold must share; the ``MATCHES`` - 1 longest are
   skipped, and only looked into for the candidates that the merge has found.
   Pairs at the threshold join a forest; what is connected already is skipped.
   The forests give groups of candidates.
4. In each group, whole shingle sets are compared, again skipping what is
   connected; only links confirmed on full sets remain.

A pair of Jaccard similarity 0.8 agrees on a coordinate with probability 0.8,
independently for each: it misses 26 of 64 matches with a probability under
1e-10. Groups beyond a bound are cut into blocks, and every pair of blocks is
one bounded task, so no task holds a whole group and no pair is left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factspan.llm.bytetext import NONSPACE, U64, Words, chunks, mix
from factspan.llm.tables import connected_components, discard, fresh, settled, written

COORDINATES = 64
MATCHES = 26
#: Members of a posting in one block; shingles of a group in one block.
POSTING_BLOCK = 4096
SHINGLE_BLOCK = 500_000
#: Members up to which a posting's lists are merged whole, all at once, which costs less than to build and skip them.
MERGE_WHOLE = 64

_MULTIPLY = mix(np.arange(1, COORDINATES + 1, dtype=U64)) | U64(1)
_ADD = mix(np.arange(1001, 1001 + COORDINATES, dtype=U64))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct ``n``-word shingles of each text, sorted, and where each text's begin.

    A text of fewer words, but not none, has its whole sequence as its only shingle.
    """
    words = Words(data, offsets, NONSPACE)
    at, h = words.grams(n)
    text = words.text[at]
    for m in range(1, n):
        if len(short := np.flatnonzero(words.count == m)):
            a, g = words.grams(m)
            own = np.isin(words.text[a], short)
            at, h, text = np.concatenate([at, a[own]]), np.concatenate([h, g[own]]), np.concatenate([text, words.text[a[own]]])
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    h, text = h[new], text[new]
    return h, np.searchsorted(text, np.arange(len(offsets)))


def signatures(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The minima of each set under every hash function; zeros for an empty set."""
    n = len(first) - 1
    out = np.zeros((n, COORDINATES), np.uint32)
    full = np.flatnonzero(np.diff(first))
    at = 0
    while at < len(full):  # blocks that stay in cache
        stop = max(at + 1, int(np.searchsorted(first[full], first[full[at]] + 32768)))
        lo, hi = first[full[at]], first[full[min(stop, len(full)) - 1] + 1]
        cuts = first[full[at:stop]] - lo
        own = h[lo:hi]
        for k in range(COORDINATES):
            out[full[at:stop], k] = np.minimum.reduceat((own * _MULTIPLY[k] + _ADD[k]) >> U64(32), cuts)
        at = stop
    return out


def _sign(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, data, offsets in chunks(batch, "text"):
            h, first = shingle_sets(data, offsets, n)
            size = np.diff(first)
            sig = signatures(h, first)
            sums = np.zeros((len(size), 2), U64)
            if len(h):
                full = np.flatnonzero(size)
                sums[full, 0] = np.add.reduceat(h, first[full])
                sums[full, 1] = np.add.reduceat(mix(h ^ U64(77)), first[full])
            raw = np.concatenate([sums, size.astype(U64)[:, None]], 1).tobytes()
            s = sig.tobytes()
            yield pa.RecordBatch.from_arrays(
                [rows.column("id"), pa.array(size, pa.int64()), pa.array([raw[i : i + 24] for i in range(0, len(raw), 24)], pa.binary()), pa.array([s[i : i + 4 * COORDINATES] for i in range(0, len(s), 4 * COORDINATES)], pa.binary())],
                names=["id", "n", "set", "sig"],
            )


def _post(batches: Iterator[pa.RecordBatch], prefix: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint32).reshape(-1, COORDINATES)[:, :prefix]
        key = mix(sig.astype(U64) + (np.arange(1, prefix + 1, dtype=U64) << U64(32)))
        ids = np.repeat(batch.column("id").to_numpy(zero_copy_only=False), prefix)
        yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), pa.array(ids)], names=["key", "id"])


def _forest(n: int, linked) -> list[tuple[int, int]]:
    """A spanning forest; ``linked(i, rest)`` says which of ``rest`` are linked with ``i``."""
    rest, out = np.arange(n), []
    while len(rest):
        todo, rest = [int(rest[0])], rest[1:]
        while todo and len(rest):
            i = todo.pop()
            hit = linked(i, rest)
            out += [(i, int(j)) for j in rest[hit]]
            todo += rest[hit].tolist()
            rest = rest[~hit]
    return out


class Postings:
    """The signatures of a block posted under (coordinate, value), for counting collisions."""

    def __init__(self, sig: np.ndarray):
        n = len(sig)
        key = (np.arange(COORDINATES, dtype=U64) << U64(32)) + sig
        self.order = np.argsort(key.ravel(), kind="stable")
        run = key.ravel()[self.order]
        new = np.ones(len(run), bool)
        new[1:] = run[1:] != run[:-1]
        self.first = np.append(np.flatnonzero(new), len(run))
        self.list = np.empty(len(run), np.int64)
        self.list[self.order] = np.cumsum(new) - 1
        self.list = self.list.reshape(n, COORDINATES)  # which list each coordinate of a member is in
        self.size = np.diff(self.first)
        self.member = self.order // COORDINATES
        self.n = n

    def collisions(self, i: int, least: int) -> np.ndarray:
        """How many lists each member shares with ``i``; at least what counts if that is ``least`` or more, else less than ``least``."""
        own = self.list[i]
        own = own[np.argsort(self.size[own], kind="stable")]
        merged, skipped = own[: COORDINATES - least + 1], own[COORDINATES - least + 1 :]
        merged = merged[self.size[merged] > 1]
        if not len(merged):
            return np.zeros(self.n, np.int64)
        count = np.bincount(np.concatenate([self.member[self.first[k] : self.first[k + 1]] for k in merged.tolist()]), minlength=self.n)
        near = np.flatnonzero((count > 0) & (count + len(skipped) >= least))
        count[near] += np.isin(self.list[near], skipped).sum(1)
        return count


def _collide(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.drop_duplicates("id")
    ids = pdf["id"].to_numpy()
    sig = np.frombuffer(b"".join(pdf["sig"]), np.uint32).reshape(-1, COORDINATES)
    if len(ids) <= MERGE_WHOLE:
        links = _forest(len(ids), lambda i, rest: (sig[rest] == sig[i]).sum(1) >= MATCHES)
    else:
        postings = Postings(sig)
        links = _forest(len(ids), lambda i, rest: postings.collisions(i, MATCHES)[rest] >= MATCHES)
    return pd.DataFrame({"a": [ids[i] for i, _ in links], "b": [ids[j] for _, j in links]}, dtype="int64")


def _confirm(pdf: pd.DataFrame, percent: int) -> pd.DataFrame:
    pdf = pdf.drop_duplicates("id")
    ids = pdf["id"].to_numpy()
    sets = [np.frombuffer(s, U64) for s in pdf["shingles"]]
    size = np.array([len(s) for s in sets], np.int64)
    every = np.concatenate(sets)
    values, code, freq = np.unique(every, return_inverse=True, return_counts=True)
    code = code.astype(np.int32)
    owner = np.repeat(np.arange(len(ids), dtype=np.int32), size)
    by_value = owner[np.argsort(code, kind="stable")]
    del every, values, owner
    first = np.concatenate([[0], np.cumsum(freq)])
    own = np.split(code, np.cumsum(size)[:-1])

    def linked(i: int, rest: np.ndarray) -> np.ndarray:
        mine = own[i][freq[own[i]] > 1]
        if not len(mine):
            return np.zeros(len(rest), bool)
        both = np.bincount(np.concatenate([by_value[first[c] : first[c + 1]] for c in mine.tolist()]), minlength=len(ids))[rest]
        return 100 * both >= percent * (size[rest] + size[i] - both)

    links = _forest(len(ids), linked)
    return pd.DataFrame({"a": [ids[i] for i, _ in links], "b": [ids[j] for _, j in links]}, dtype="int64")


def _sets(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, data, offsets in chunks(batch, "text"):
            h, first = shingle_sets(data, offsets, n)
            raw = h.tobytes()
            yield pa.RecordBatch.from_arrays([rows.column("id"), rows.column("grp"), rows.column("blocks"), pa.array([raw[8 * a : 8 * b] for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)], pa.binary())], names=["id", "grp", "blocks", "shingles"])


def _block_pairs(df: DataFrame) -> DataFrame:
    """One row for each pair of blocks that a member takes part in; ``lo`` and ``hi`` name the pair."""
    own = F.pmod(F.xxhash64("id"), F.col("blocks"))
    other = F.explode(F.when(F.col("blocks") == 1, F.array(F.lit(0).cast("long"))).otherwise(F.filter(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda x: x != own)))
    return df.withColumn("other", other).withColumn("lo", F.least(own, "other")).withColumn("hi", F.greatest(own, "other"))


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """``(id, n_shingles, component_id, kept)``, one row for each row of ``docs``.

    Lower-cases A-Z; words are separated by ASCII white space. Documents link
    when 100 * intersection >= ``percent`` * union of their distinct shingles
    of ``shingle`` words; fewer words are one shingle; a null or empty text has
    no shingles and links with nothing. ``component_id`` is the smallest id
    that links reach, ``kept`` whether it is the document's own. Rows that
    repeat an id are one document as far as links go, and each is returned. A
    row with a null id is returned as its own component with a null id, kept.
    """
    base = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    signed = written(base.mapInArrow(partial(_sign, n=shingle), "id bigint, n bigint, set binary, sig binary"), "signatures")
    named = signed.where("n > 0 and id is not null")
    classes = written(named.groupBy("set").agg(F.min("id").alias("id"), F.min("n").alias("n"), F.min("sig").alias("sig")).select("id", "n", "sig"), "classes")

    prefix = COORDINATES - MATCHES + 1
    posts = classes.select("id", "sig").mapInArrow(partial(_post, prefix=prefix), "key bigint, id bigint")
    shared = (
        posts.groupBy("key")
        .agg(F.count("*").alias("size"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("members"))
        .where("size > 1")
        .groupBy("size", "members")
        .agg(F.min("key").alias("key"))
        .select("key", F.ceil(F.col("size") / POSTING_BLOCK).alias("blocks"))
    )
    members = written(posts.join(shared, "key"), "postings")
    pairs = _block_pairs(members.join(classes.select("id", "sig"), "id"))
    candidates = pairs.select("key", "lo", "hi", "id", "sig").groupBy("key", "lo", "hi").applyInPandas(_collide, "a bigint, b bigint")
    groups = connected_components(candidates)
    discard(members)
    weight = groups.join(classes, groups.node == classes.id).groupBy("component").agg(F.ceil(F.sum("n") / SHINGLE_BLOCK).alias("blocks"))
    chosen = written(groups.join(weight, "component").select(F.col("node").alias("id"), F.col("component").alias("grp"), "blocks"), "groups")

    sets = base.join(chosen, "id").mapInArrow(partial(_sets, n=shingle), "id bigint, grp bigint, blocks bigint, shingles binary")
    links = _block_pairs(sets).select("grp", "lo", "hi", "id", "shingles").groupBy("grp", "lo", "hi").applyInPandas(partial(_confirm, percent=percent), "a bigint, b bigint")

    found = connected_components(links)
    top = named.groupBy("set").agg(F.min("id").alias("rep"))
    label = top.join(found, top.rep == found.node, "left").select("set", F.coalesce("component", "rep").alias("component"))
    out = signed.join(label, "set", "left")
    component = F.when(F.col("n") > 0, F.coalesce("component", "id")).otherwise(F.col("id"))
    out = out.select("id", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)))
    out = settled(out)
    discard(signed, classes, chosen)
    return out


def minhash_report(docs: DataFrame, **options) -> DataFrame:
    """One row for each document: doc_id, n_shingles, component_id, kept."""
    return near_duplicates(docs, **options).withColumnRenamed("id", "doc_id")


def drop_near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", **options) -> DataFrame:
    """The documents that are kept, with the columns of ``docs``; rows with a null id stay."""
    (name,) = fresh(docs, "lost")
    lost = near_duplicates(docs, doc_id=doc_id, **options).where("not kept").select(F.col("id").alias(name)).distinct()
    return docs.join(lost, docs[doc_id] == lost[name], "left_anti")
