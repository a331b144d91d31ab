"""Language identification with a byte convolutional network.

Filters of several widths slide over the bytes of fixed-length windows; the
strongest response of each filter in a window feeds a softmax over languages.
The network is trained in numpy on labelled text and applied to every window of
a whole text; a text's logits are the mean over its windows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factspan.llm.bytetext import chunks
from factspan.llm.tables import without

WIDTHS = (2, 3, 4)
FILTERS = 8
WINDOW = 256
#: Bounds of the sample that the network is trained on: texts, texts of a language at least, their characters, and windows of each.
SAMPLE = 3000
SAMPLE_LEAST = 20
SAMPLE_CHARS = 10_000
SAMPLE_WINDOWS = 6
UNKNOWN = "und"


def windows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows of ``WINDOW`` bytes, the last of a text padded with zeros, and the text of each; an empty text has none."""
    size = np.diff(offsets)
    count = -(-size // WINDOW)
    text = np.repeat(np.arange(len(size)), count)
    out = np.zeros(len(text) * WINDOW, np.uint8)
    at = np.repeat(np.cumsum(count) - count, size) * WINDOW + np.arange(len(data)) - np.repeat(offsets[:-1], size)
    out[at] = data
    return out.reshape(-1, WINDOW), text


class Network:
    """Weights: for each width and place in the filter, a row of filter weights for each byte."""

    def __init__(self, languages: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.tables = [[(rng.standard_normal((256, FILTERS)) * 0.1).astype(np.float32) for _ in range(w)] for w in WIDTHS]
        self.out = (rng.standard_normal((FILTERS * len(WIDTHS), len(languages))) * 0.1).astype(np.float32)
        self.bias = np.zeros(len(languages), np.float32)

    def respond(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """The strongest response of each filter in each window, and where."""
        best, where = [], []
        for w, tables in zip(WIDTHS, self.tables, strict=True):
            n = WINDOW - w + 1
            r = tables[0][x[:, :n]]
            for k in range(1, w):
                r += tables[k][x[:, k : k + n]]
            at = r.argmax(1)
            where.append(at)
            best.append(np.take_along_axis(r, at[:, None, :], 1)[:, 0])
        return np.concatenate(best, 1), where

    def strongest(self, x: np.ndarray) -> np.ndarray:
        best = []
        for w, tables in zip(WIDTHS, self.tables, strict=True):
            n = WINDOW - w + 1
            r = tables[0].take(x[:, :n], 0)
            for k in range(1, w):
                r += tables[k].take(x[:, k : k + n], 0)
            best.append(r.max(1))
        return np.concatenate(best, 1)

    def logits(self, best: np.ndarray) -> np.ndarray:
        return np.tanh(best) @ self.out + self.bias

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = 12, batch: int = 64, rate: float = 0.01, seed: int = 11) -> None:
        """Adam on cross-entropy, classes weighted by the inverse root of their share."""
        rng = np.random.default_rng(seed)
        params = [t for ts in self.tables for t in ts] + [self.out, self.bias]
        m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        weight = 1 / np.sqrt(np.maximum(np.bincount(y, minlength=len(self.languages)), 1))
        weight /= weight[y].mean()
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(x), batch):
                own = order[at : at + batch]
                best, where = self.respond(x[own])
                h = np.tanh(best)
                z = h @ self.out + self.bias
                p = np.exp(z - z.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                p[np.arange(len(own)), y[own]] -= 1
                g = (p * weight[y[own]][:, None] / len(own)).astype(np.float32)
                grads = []
                back = (g @ self.out.T) * (1 - h * h)
                col = np.broadcast_to(np.arange(FILTERS), (len(own), FILTERS))
                for i, (w, pos) in enumerate(zip(WIDTHS, where, strict=True)):
                    b = back[:, i * FILTERS : (i + 1) * FILTERS]
                    for k in range(w):
                        d = np.zeros((256, FILTERS), np.float32)
                        np.add.at(d, (x[own][np.arange(len(own))[:, None], pos + k], col), b)
                        grads.append(d)
                grads += [h.T @ g, g.sum(0)]
                step += 1
                for q, d, a, b in zip(params, grads, m, v, strict=True):
                    a += 0.1 * (d - a)
                    b += 0.001 * (d * d - b)
                    q -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The likeliest language of each text, and its probability."""
        x, text = windows(data, offsets)
        n = len(offsets) - 1
        total = np.zeros((n, len(self.languages)))
        for at in range(0, len(x), 256):  # blocks that stay in cache
            np.add.at(total, text[at : at + 256], self.logits(self.strongest(x[at : at + 256])))
        z = total / np.maximum(np.bincount(text, minlength=n), 1)[:, None]
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        return p.argmax(1), p.max(1)


def fit(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> Network | None:
    """Train on about ``sample`` texts, equally many of each language, those whose ids have the smallest hashes.

    A language gives ``sample`` divided by the number of languages, but
    ``SAMPLE_LEAST`` at least; texts over ``SAMPLE_CHARS`` characters are not
    drawn, and ``SAMPLE_WINDOWS`` windows of each are used. The ids are drawn
    first, so only their texts are read to the driver; of rows that repeat an
    id and language, the least text counts. Rows with a null id or language, or
    a null or empty text, teach nothing; without any there is no network, and
    every language is unknown.
    """
    known = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("t"), F.col(lang).alias("y")).where(f"id is not null and y is not null and length(t) between 1 and {SAMPLE_CHARS}")
    some = known.select("id", "y").distinct()
    share = max(SAMPLE_LEAST, sample // max(1, some.select("y").distinct().count()))
    rank = F.row_number().over(Window.partitionBy("y").orderBy(F.xxhash64("id"), "id"))
    drawn = some.withColumn("rank", rank).where(F.col("rank") <= share).drop("rank")
    rows = known.join(F.broadcast(drawn), ["id", "y"]).groupBy("id", "y").agg(F.min("t").alias("t")).select("t", "y").collect()
    rows = sorted(rows, key=lambda r: (r["t"], r["y"]))
    if not rows:
        return None
    languages = sorted({r["y"] for r in rows})
    rng = np.random.default_rng(5)
    xs, ys = [], []
    for r in rows:
        raw = np.frombuffer(r["t"].encode(), np.uint8)
        x, _ = windows(raw, np.array([0, len(raw)]))
        x = x[rng.permutation(len(x))[:SAMPLE_WINDOWS]]
        xs.append(x)
        ys += [languages.index(r["y"])] * len(x)
    net = Network(languages)
    net.train(np.concatenate(xs), np.array(ys))
    return net


def _apply(batches: Iterator[pa.RecordBatch], network, text: str, lang: str, score: str) -> Iterator[pa.RecordBatch]:
    net = network.value
    for batch in batches:
        for rows, data, offsets in chunks(batch, text, 1 << 20):
            lettered = [any(map(str.isalpha, t or "")) for t in rows.column(text).to_pylist()]
            if net is None:
                names, p = [UNKNOWN] * rows.num_rows, np.zeros(rows.num_rows)
            else:
                k, p = net.predict(data, offsets)
                names = [net.languages[i] if ok else UNKNOWN for i, ok in zip(k.tolist(), lettered, strict=True)]
                p = np.where(lettered, p, 0.0)
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(names), pa.array(p, pa.float64())], names=[*rows.schema.names, lang, score])


def identify(docs: DataFrame, network: Network | None, *, text: str = "text", lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """Add the language of each whole text and its probability; ``und`` and 0 for a text that is null or has no letters.

    Every row stays, repeated ones too; columns called ``lang`` or ``score`` are replaced.
    """
    docs = without(docs, text, lang, score)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), f"`{lang}` string, `{score}` double"])
    return docs.mapInArrow(partial(_apply, network=docs.sparkSession.sparkContext.broadcast(network), text=text, lang=lang, score=score), schema)


def language_report(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score; one row for each row of ``docs``. A null id is not held out, and teaches."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    network = fit(docs.where(~held))
    return identify(docs.select("doc_id", "text"), network).select("doc_id", held.alias("held_out"), "lang_pred", "score")
