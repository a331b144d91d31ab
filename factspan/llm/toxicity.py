"""Toxicity scores from a learned lexicon that tolerates misspelling.

The lexicon (whole words and stems) is learned from labelled texts. A trie of
it, intersected with Levenshtein automata, is determinised once; every word of
every text then runs through that table, all words of a batch at a time. Hits
count by their weight and by the context window around them, so a quoted or
reported term counts less than an abusive one. A logistic model turns what a
text's hits add up to into a score.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from functools import cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factspan.llm.bytetext import chunks
from factspan.llm.tables import fresh, without

#: Bounds of the sample that the model is fitted on: texts of each label, and characters of a text.
SAMPLE = 2500
SAMPLE_CHARS = 10_000
#: Terms of the lexicon; all of them are matched within one edit.
TERMS = 400
#: Words on either side of a hit that decide whether it is quoted; what a quoted or reported hit counts.
CONTEXT = 8
QUOTED = 0.2
REPORTED = 0.5
#: The share of a term's uses that are taken to be misspelled where the sample shows none.
MISSPELLED = 0.02

_TOP = 0x3000
_LOWER = np.array([ord(c.lower()) if len(c.lower()) == 1 else i for i, c in enumerate(map(chr, range(_TOP)))], np.uint32)
_WORD = np.array([chr(i).isalnum() for i in range(_TOP)])
_OPEN, _CLOSE, _BOTH = (np.array([ord(c) for c in s], np.uint32) for s in ("“„«‹‘", "”»›’", '"'))
_REPORTING = ("said", "says", "called", "quote", "quoted", "quotes", "word", "term", "insult")


def words_of(text: str) -> list[str]:
    """Runs of letters and digits, lower-cased one character at a time where that gives one character, as ``Points`` does."""
    low = text.replace("Σ", "σ").lower() if "İ" not in text else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    return "".join(c if c.isalnum() else " " for c in low).split()


class Points:
    """Code points of a run of texts, with the words in them."""

    def __init__(self, texts: list[str | None]):
        size = np.array([0, *(len(t or "") for t in texts)], np.int64)
        self.first = np.cumsum(size)
        self.raw = np.frombuffer("".join(t or "" for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        low = self.raw < _TOP
        near = np.where(low, self.raw, 0)
        self.lower = _LOWER[near]
        inside = _WORD[near]
        if not low.all():
            high, at = np.unique(self.raw[~low], return_inverse=True)
            self.lower[~low] = np.array([ord(c.lower()) if len(c.lower()) == 1 else ord(c) for c in map(chr, high.tolist())], np.uint32)[at]
            inside[~low] = np.array([chr(c).isalnum() for c in high.tolist()])[at]
        n = len(self.raw)
        cut = np.zeros(n + 1, bool)
        cut[self.first] = True
        before, after = np.zeros(n, bool), np.zeros(n, bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        self.start = np.flatnonzero(inside & (~before | cut[:-1]))
        self.stop = np.flatnonzero(inside & (~after | cut[1:])) + 1
        self.text = np.searchsorted(self.first, self.start, "right") - 1
        self.words = np.bincount(self.text, minlength=len(texts))

    def context(self, hits: np.ndarray, reporting: frozenset[str]) -> np.ndarray:
        """What each hit (a word's number) counts: less inside quotes or beside a reporting word."""
        out = np.ones(len(hits))
        for k, w in enumerate(hits.tolist()):
            lo, hi = max(0, w - CONTEXT), min(len(self.start) - 1, w + CONTEXT)
            while self.text[lo] != self.text[w]:
                lo += 1
            while self.text[hi] != self.text[w]:
                hi -= 1
            begin = max(self.first[self.text[w]], self.start[lo] - 2)
            left = self.raw[begin : self.start[w]]
            right = self.raw[self.stop[w] : min(self.first[self.text[w] + 1], self.stop[hi] + 2)]
            if len(cut := np.flatnonzero(left == 10)):
                left = left[cut[-1] + 1 :]
            if len(cut := np.flatnonzero(right == 10)):
                right = right[: cut[0]]
            opened = np.isin(left, _OPEN).sum() > np.isin(left, _CLOSE).sum() and np.isin(right, _CLOSE).any()
            if opened or (np.isin(left, _BOTH).sum() % 2 and np.isin(right, _BOTH).any()):
                out[k] = QUOTED
            elif any(self.word(j) in reporting for j in range(max(lo, w - 3), w)):
                out[k] = REPORTED
        return out

    def word(self, w: int) -> str:
        return self.lower[self.start[w] : self.stop[w]].astype("<u4").tobytes().decode("utf-32-le", "replace")


def near_terms(terms: list[tuple[str, bool]]):
    """A function from a word to the terms it is within one edit of, or begins within one edit of where they are stems."""
    less = lambda w: {w, *(w[:k] + w[k + 1 :] for k in range(len(w)))}
    index: tuple[dict, dict] = ({}, {})
    for t, (term, stem) in enumerate(terms):
        for form in less(term):
            index[stem].setdefault(form, []).append(t)
    sizes = [len(w) for w, stem in terms if stem]

    @cache
    def near(part: str, stem: bool) -> frozenset[int]:
        found = {t for form in less(part) for t in index[stem].get(form, ())}
        return frozenset(t for t in found if len(terms[t][0]) != len(part) or sum(map(str.__ne__, part, terms[t][0])) <= 1)

    def of(word: str) -> set[int]:
        out = set(near(word, False))
        for k in range(min(sizes, default=1) - 1, min(len(word), max(sizes, default=-1) + 1) + 1):
            out |= near(word[:k], True)
        return out

    return of


class Automaton:
    """The lexicon's trie and its Levenshtein automata as one table of states.

    A word that is a term exactly gives that term; else one that begins with a
    stem gives the longest such stem; else one within one edit of a fuzzy term,
    or that begins within one edit of a fuzzy stem, gives that term, the one of
    most weight and then the first. Results are term numbers: exact and stem
    terms from 0, fuzzy ones from ``len(terms)``; -1 for none.
    """

    def __init__(self, terms: list[tuple[str, bool]], fuzzy: set[int], weight: np.ndarray | None = None):
        self.terms = terms
        letters = sorted({c for t, _ in terms for c in t})
        self.classes = np.zeros(max(map(ord, letters), default=0) + 2, np.uint8 if len(letters) < 255 else np.uint16)  # the last is of all beyond
        for k, c in enumerate(letters):
            self.classes[ord(c)] = k + 1
        child: list[dict[int, int]] = [{}]
        far = len(terms)
        order = sorted(fuzzy, key=lambda t: (0 if weight is None else -weight[t], t))
        rank = {t: k for k, t in enumerate(order)}
        bend: list[int] = [far]  # the first rank of the fuzzy terms beyond a node
        word_at, stem_at, near_word, near_stem = {}, {}, {}, {}
        number = {c: k + 1 for k, c in enumerate(letters)}
        for t, (term, stem) in enumerate(terms):
            node = 0
            bend[0] = min(bend[0], rank.get(t, far))
            for c in term:
                if number[c] not in child[node]:
                    child[node][number[c]] = len(child)
                    child.append({})
                    bend.append(far)
                node = child[node][number[c]]
                bend[node] = min(bend[node], rank.get(t, far))
            (stem_at if stem else word_at)[node] = t
            if t in fuzzy:
                (near_stem if stem else near_word)[node] = rank[t]

        def closed(nodes: set, stem: int, near: int) -> tuple:
            """A state without what can no longer decide the result: ``near`` is the first rank of the stems met so far."""
            if stem >= 0:
                return frozenset(x for x in nodes if not x[1]), stem, far
            nodes = nodes | {(m, 1) for n, e in nodes if not e for m in child[n].values()}
            near = min([near, *(near_stem[n] for n, e in nodes if e and n in near_stem)])
            return frozenset((n, e) for n, e in nodes if not e or (bend[n] < near and (n, 0) not in nodes)), stem, near

        def step(state: tuple, c: int) -> tuple:
            nodes, stem, near = state
            out = set()
            for n, e in nodes:
                m = child[n].get(c)
                if m is not None:
                    out.add((m, e))
                    if not e and m in stem_at:
                        stem = stem_at[m]
                if not e and stem < 0 and bend[n] < near:
                    out.add((n, 1))
                    out |= {(x, 1) for x in child[n].values()}
            return closed(out, stem, near)

        def result(state: tuple) -> int:
            nodes, stem, near = state
            exact = [word_at[n] for n, e in nodes if not e and n in word_at]
            near = min([near, *(near_word[n] for n, e in nodes if e and n in near_word)])
            return exact[0] if exact else stem if stem >= 0 else order[near] + len(terms) if near < far else -1

        begin = closed({(0, 0)}, -1, far)
        known, todo, rows, ends = {begin: 0}, [begin], [], []
        while todo:
            nxt = []
            for state in todo:
                row = []
                for c in range(len(letters) + 1):
                    to = step(state, c)
                    if to not in known:
                        known[to] = len(known)
                        nxt.append(to)
                    row.append(known[to])
                rows.append(row)
                ends.append(result(state))
            todo = nxt
        self.table = np.array(rows, np.int32)
        self.ends = np.array(ends, np.int32)
        self.sink = (self.table == np.arange(len(rows))[:, None]).all(1)

    def run(self, p: Points) -> np.ndarray:
        """The term of every word."""
        state = np.zeros(len(p.start), np.int32)
        live = np.arange(len(p.start))
        size = p.stop - p.start
        cls = self.classes[np.minimum(p.lower, len(self.classes) - 1)]
        k = 0
        while len(live):
            state[live] = self.table[state[live], cls[p.start[live] + k]]
            k += 1
            live = live[(size[live] > k) & ~self.sink[state[live]]]
        return self.ends[state]


class Model:
    """Lexicon, automaton and logistic weights."""

    def __init__(self, texts: list[str], labels: list[int]):
        y = np.array(labels, float)
        self.reporting = frozenset(_REPORTING)
        terms, self.weight = self._lexicon(texts, y) if 0 < y.sum() < len(y) else ([], np.zeros(0))
        self.automaton = Automaton(terms, set())
        self.rate = float(y.mean()) if len(y) else 0.0
        self.centre = self.scale = self.coef = None
        if terms:
            self.weight = np.concatenate([self.weight, np.zeros(len(terms))])
            self._weigh_fuzzy(texts, y)
            near = self.weight[len(terms) :]
            self.automaton = Automaton(terms, set(np.flatnonzero(near > 0).tolist()), near)  # a near miss without weight counts nowhere
            self._fit(np.concatenate([self.features(texts[k : k + 100]) for k in range(0, len(texts), 100)]), y)

    def _lexicon(self, texts: list[str], y: np.ndarray):
        n1, n0 = y.sum(), len(y) - y.sum()

        def candidates(words: set[str]) -> set[tuple[str, bool]]:
            out = {(w, False) for w in words if len(w) > 3}
            for w in words:
                out.update((w[:k], True) for k in range(3, min(len(w), 9)))
            return out

        least = max(5, 0.01 * n1)
        rough = np.zeros(1 << 22, np.int32)  # an upper bound of each candidate's count
        for t in (t for t, label in zip(texts, y, strict=True) if label):
            rough[np.fromiter({zlib.crc32(repr(c).encode()) >> 10 for c in candidates(set(words_of(t)))}, np.int64)] += 1
        pos: Counter = Counter()
        for t in (t for t, label in zip(texts, y, strict=True) if label):
            pos.update(c for c in candidates(set(words_of(t))) if rough[zlib.crc32(repr(c).encode()) >> 10] >= least)
        pos = Counter({c: n for c, n in pos.items() if n >= least})
        neg: Counter = Counter()
        for t in (t for t, label in zip(texts, y, strict=True) if not label):
            neg.update(candidates(set(words_of(t))) & pos.keys())
        odds = {c: float(np.log(((n + 0.5) / (n1 + 1)) / ((neg[c] + 0.5) / (n0 + 1)))) for c, n in pos.items()}
        good = {c for c, v in odds.items() if v > 2.0}
        for w, stem in sorted(good, key=lambda c: (-len(c[0]), not c[1])):  # a shorter form that says no more goes
            for shorter in [(w[:k], True) for k in range(3, len(w) + (not stem))]:
                if shorter in good and pos[shorter] <= 1.1 * pos[w, stem] and neg[shorter] >= neg[w, stem]:
                    good.discard(shorter)
        for c in sorted(good, key=lambda c: (len(c[0]), not c[1])):  # a longer form that a stem covers as well goes
            w, stem = c
            if any((w[:k], True) in good and odds[w[:k], True] >= odds[c] - 0.7 for k in range(3, len(w))):
                good.discard(c)
        best = sorted(good, key=lambda c: (-pos[c] * odds[c], c))[:TERMS]
        return best, np.array([odds[c] for c in best])

    def _weigh_fuzzy(self, texts: list[str], y: np.ndarray) -> None:
        """A near miss weighs what the sample says of it; one that clean texts use weighs nothing."""
        n, near, known = len(self.automaton.terms), near_terms(self.automaton.terms), {}
        seen = np.zeros((2, 2 * n))
        for at in range(0, len(texts), 100):
            sets = [set(words_of(t)) for t in texts[at : at + 100]]
            new = sorted(set().union(*sets) - known.keys())
            p = Points(new)
            first = dict(zip(p.text.tolist(), self.automaton.run(p).tolist(), strict=True))
            known.update((w, (first[k],) if first.get(k, -1) >= 0 else tuple(x + n for x in near(w))) for k, w in enumerate(new))
            for words, label in zip(sets, y[at : at + 100], strict=True):
                seen[int(label), list(set().union(*map(known.__getitem__, words)))] += 1
        n1, n0 = y.sum() + 1, len(y) - y.sum() + 1
        for t in range(n):
            w = np.log(((seen[1, n + t] + MISSPELLED * seen[1, t] + 0.05) / n1) / ((seen[0, n + t] + 0.05) / n0))
            self.weight[n + t] = np.clip(w if seen[0, n + t] <= 0.002 * n0 else 0.0, 0, self.weight[t])

    def features(self, texts: list[str | None]) -> np.ndarray:
        p = Points(texts)
        hit = self.automaton.run(p)
        at = np.flatnonzero(hit >= 0)
        at = at[self.weight[hit[at]] > 0]
        w = self.weight[hit[at]] * p.context(at, self.reporting)
        n, text = len(texts), p.text[at]
        total = np.bincount(text, w, n)
        most = np.zeros(n)
        np.maximum.at(most, text, w)
        pairs = np.unique(np.stack([text, hit[at]]), axis=1) if len(at) else np.zeros((2, 0), int)
        kinds = np.bincount(pairs[0], minlength=n)
        rate = 100 * total / np.maximum(p.words, 1)
        return np.stack([np.log1p(total), most, np.log1p(kinds), np.log1p(rate)], 1)

    def _fit(self, x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> None:
        self.centre, self.scale = x.mean(0), x.std(0) + 1e-9
        z = np.concatenate([(x - self.centre) / self.scale, np.ones((len(x), 1))], 1)
        coef = np.zeros(z.shape[1])
        hold = np.diag([ridge] * x.shape[1] + [1e-6])
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(z @ coef, -30, 30)))
            step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + hold, z.T @ (y - p) - hold @ coef)
            coef += step
            if abs(step).max() < 1e-8:
                break
        self.coef = coef

    def score(self, texts: list[str | None]) -> np.ndarray:
        if self.coef is None:
            return np.full(len(texts), self.rate)
        z = (self.features(texts) - self.centre) / self.scale
        return 1 / (1 + np.exp(-np.clip(z @ self.coef[:-1] + self.coef[-1], -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE) -> Model:
    """Fit on at most ``sample`` documents of each label, those whose ids have the smallest hashes.

    The ids are drawn first, so only their texts are read to the driver; a text
    of more than ``SAMPLE_CHARS`` characters, a null or an empty one teaches
    nothing, and of rows that repeat an id, the least text counts. Labels other
    than 0 and 1 are ignored; a document or text that repeats is toxic if any
    of its rows is. Without texts of both labels every
    score is the share of label 1.
    """
    known = labels.select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("y")).where("id is not null and y in (0, 1)").groupBy("id").agg(F.max("y").alias("y"))
    drawn = [known.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(sample) for y in (0, 1)]
    rows = (
        docs.select(F.col(doc_id).alias("id"), F.col(text).alias("t"))
        .where(f"length(t) between 1 and {SAMPLE_CHARS}")
        .join(F.broadcast(drawn[0].unionByName(drawn[1])), "id")  # at most 2 * sample ids
        .groupBy("id")
        .agg(F.min("t").alias("t"), F.max("y").alias("y"))
        .select("t", "y")
        .collect()
    )
    seen: dict[str, int] = {}
    for t, y in rows:
        seen[t] = max(y, seen.get(t, 0))
    texts = sorted(seen)
    return Model(texts, [seen[t] for t in texts])


def _score(batches: Iterator[pa.RecordBatch], model, text: str, name: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, _, _ in chunks(batch, text, 1 << 20):
            score = model.value.score(rows.column(text).to_pylist())
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(score)], names=[*rows.schema.names, name])


def score(docs: DataFrame, model: Model, *, text: str = "text", name: str = "score") -> DataFrame:
    """Add a score from 0 to 1 for each whole text; higher means toxic. Null and empty texts score as texts without hits.

    Every row stays, repeated ones too; a column called ``name`` is replaced.
    """
    docs = without(docs, text, name)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), f"`{name}` double"])
    return docs.mapInArrow(partial(_score, model=docs.sparkSession.sparkContext.broadcast(model), text=text, name=name), schema)


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string")) % 5 == 0


def fit_labels(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on ``labels.toxic`` of the documents that are not held out."""
    return fit(docs, labels.where(~held_out()))


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted; one row for each row of ``docs``. A null id is not held out."""
    scored = score(docs.select("doc_id", "text"), fit_labels(docs, labels))
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def drop_toxic(docs: DataFrame, model: Model, *, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The documents that score below ``threshold``, with the columns of ``docs``.

    Null and empty texts score as texts without hits; every kept row stays as often as it occurs.
    """
    (name,) = fresh(docs, "score")
    return score(docs, model, text=text, name=name).where(F.col(name) < threshold).drop(name)
