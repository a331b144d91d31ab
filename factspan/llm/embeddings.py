"""Near-duplicate vectors by an exact metric range join.

Cosine at or above a threshold is Euclidean distance within a radius between
unit vectors. Pivots cut the vectors of each label into cells; a vector goes to
its own cell and, by the triangle inequality, to every cell whose border is
within the radius, so cells join independently. Cells beyond a bound are
joined block by block.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factspan.llm.tables import connected_components, discard, settled, written

THRESHOLD = 0.93
#: Vectors aimed at in a cell, pivots of one label, pivots that are broadcast.
CELL = 4000
PIVOTS = 32
ALL_PIVOTS = 4096
#: Vectors of one side in a block of the join.
BLOCK = 3000


def _unit(vectors: pd.Series) -> np.ndarray:
    x = np.stack(vectors.to_numpy()).astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)  # squares of very large or small components stay finite and above zero
    return x / np.sqrt((x * x).sum(1))[:, None]


def _cells(batches, pivots, radius: float):
    known = pivots.value
    for pdf in batches:
        parts = []
        for (label, dim), rows in pdf.groupby(["label", "dim"]):
            p = known.get((label, dim))
            if p is None:
                parts.append(rows.assign(cell=0, own=True))
                continue
            x = _unit(rows["vector"])
            d = np.sqrt(np.maximum(((x[:, None, :] - p[None]) ** 2).sum(2), 0))
            mine = d.argmin(1)
            near = d[np.arange(len(d)), mine]
            apart = np.sqrt(((p[:, None] - p[None]) ** 2).sum(2))[mine]
            border = (d**2 - near[:, None] ** 2) / (2 * np.maximum(apart, 1e-12))
            go = (d <= near[:, None] + 2 * radius + 1e-9) & (border <= radius + 1e-9)
            go[np.arange(len(d)), mine] = True
            i, c = np.nonzero(go)
            parts.append(rows.iloc[i].assign(cell=c, own=c == mine[i]))
        if parts:
            out = pd.concat(parts)
            yield out[["label", "dim", "cell", "own", "node", "copies", "vector"]]


def _join(pdf: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Links between the left and the right vectors of one block: a count for each left one, and a forest."""
    left, right = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]
    if not len(left) or not len(right):
        return pd.DataFrame({"node": [], "links": [], "other": []}).astype("int64")
    a, b = left["node"].to_numpy(), right["node"].to_numpy()
    i, j = np.nonzero(_unit(left["vector"]) @ _unit(right["vector"]).T >= threshold)
    real = a[i] != b[j]
    i, j = i[real], j[real]
    links = np.bincount(i, right["copies"].to_numpy()[j], len(a)).astype(np.int64)
    la, lb = a.copy(), b.copy()
    while len(i):  # the least node that links reach inside the block
        before = la.sum(dtype=object), lb.sum(dtype=object)
        np.minimum.at(la, i, lb[j])
        np.minimum.at(lb, j, la[i])
        if (la.sum(dtype=object), lb.sum(dtype=object)) == before:
            break
    touched = np.unique(j)
    return pd.DataFrame({"node": np.concatenate([a, b[touched]]), "links": np.concatenate([links, np.zeros(len(touched), np.int64)]), "other": np.concatenate([la, lb[touched]])})


def vector_links(vectors: DataFrame, *, threshold: float = THRESHOLD, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, n_links, component_id, kept; one row for each row of ``vectors``.

    Vectors link when their labels are equal and not null, they have equally
    many components, and their cosine, in double precision, reaches
    ``threshold`` (over 0). A vector that is null, empty or zero, or holds a
    null or non-finite component, links with nothing. Rows with equal label and
    vector are copies, collapsed before the join and counted in ``n_links``. A
    null id never is a component's smallest; a component of null ids has a null
    ``component_id`` and its rows are kept.
    """
    spark = vectors.sparkSession
    base = vectors.select(F.col(vec_id).alias("vec_id"), F.col(label).cast("long").alias("label"), F.col(embedding).cast("array<double>").alias("vector"))
    sound = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    base = base.withColumn("node", F.when(F.coalesce(F.col("label").isNotNull() & sound, F.lit(False)), F.xxhash64("label", "vector")))
    known = base.where("node is not null").groupBy("node").agg(F.min("label").alias("label"), F.min("vector").alias("vector"), F.count("*").alias("copies"), F.min("vec_id").alias("least"))
    known = written(known.withColumn("dim", F.size("vector")), "vectors")

    sizes = known.groupBy("label", "dim").agg(F.count("*").alias("n")).where(F.col("n") > CELL)
    sizes = sizes.orderBy(F.desc("n"), "label", "dim").limit(ALL_PIVOTS // PIVOTS)
    share = sizes.withColumn("cells", F.least(F.lit(PIVOTS), F.ceil(F.col("n") / CELL)).cast("int"))
    rank = F.row_number().over(Window.partitionBy("label", "dim").orderBy(F.xxhash64("node", F.lit(1))))
    few = known.join(F.broadcast(share), ["label", "dim"]).where(F.pmod(F.xxhash64("node", F.lit(1)), F.col("n")) < 8 * F.col("cells"))
    rows = few.withColumn("rank", rank).where("rank <= cells").select("label", "dim", "vector").collect()
    pivots: dict[tuple[int, int], list] = {}
    for r in rows:
        pivots.setdefault((r["label"], r["dim"]), []).append(r["vector"])
    units = spark.sparkContext.broadcast({k: _unit(pd.Series(list(map(np.array, v)))) for k, v in pivots.items()})

    radius = float(np.sqrt(max(0.0, 2 - 2 * threshold)))
    placed = known.select("label", "dim", "node", "copies", "vector").mapInPandas(partial(_cells, pivots=units, radius=radius), "label bigint, dim int, cell int, own boolean, node bigint, copies bigint, vector array<double>")
    cells = placed = written(placed, "cells")
    at = ["label", "dim", "cell"]
    counts = placed.groupBy(*at).agg(F.ceil(F.count_if("own") / BLOCK).alias("rows"), F.ceil(F.count("*") / BLOCK).alias("cols"))
    placed = placed.join(counts, at)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    spot = lambda n: F.pmod(F.xxhash64("node", F.lit(2)), F.col(n))
    lefts = placed.where("own").select(*at, spot("rows").alias("i"), every("cols").alias("j"), F.lit(0).alias("side"), "node", "copies", "vector")
    rights = placed.where("rows > 0").select(*at, every("rows").alias("i"), spot("cols").alias("j"), F.lit(1).alias("side"), "node", "copies", "vector")
    found = written(lefts.unionByName(rights).groupBy(*at, "i", "j").applyInPandas(partial(_join, threshold=threshold), "node bigint, links bigint, other bigint"), "links")

    degree = found.groupBy("node").agg(F.sum("links").alias("links"))
    group = connected_components(found.where("node <> other").select(F.col("node").alias("a"), F.col("other").alias("b")))
    named = known.select("node", "copies", "least").join(group, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    info = settled(named.join(least, "component").join(degree, "node", "left").select("node", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n"), "component_id"))
    discard(known, cells, found)
    out = base.select("vec_id", "node").join(info, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id")).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
