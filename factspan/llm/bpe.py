"""BPE encoding and decoding by speculation and verification.

Greedy longest match proposes tokens for every distinct word. A token sequence
is what merging gives exactly when every token is reachable and every adjacent
pair is compatible, so one vectorised check over the distinct pairs decides
which proposals stand; only the words that fail are merged exactly.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factspan.llm.bytetext import StepTable, chunks
from factspan.llm.tables import without

#: Marks the end of a word; no byte of UTF-8.
_END = b"\xff"
#: Words kept in a worker's table, and the longest that is kept.
CACHE = 300_000
CACHE_LENGTH = 64
#: Longest words, in bytes, that are handled many at a time.
TOGETHER = 40
_NONE = np.int64(1 << 40)


def default_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def _byte_chars() -> dict[str, int]:
    """The printable stand-in for each byte that byte-level vocabularies are written in."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """A byte-level BPE with word ends, read from a tokenizers file; lower-cases and splits as that file says."""

    def __init__(self, path: str | None = None):
        with open(path or default_path(), "rb") as f:
            raw_spec = f.read()
        self.key = hashlib.sha256(raw_spec).hexdigest()
        spec = json.loads(raw_spec)
        pattern = self._pattern(spec)
        model, suffix = spec["model"], spec["model"]["end_of_word_suffix"]
        byte = _byte_chars()
        raw = lambda t: bytes(byte[c] for c in t.removesuffix(suffix)) + (_END if t.endswith(suffix) else b"")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.shown = {i: t for t, i in (model["vocab"] | self.special).items()}
        self.id = {raw(t): i for t, i in model["vocab"].items() if t not in self.special}
        step: dict[tuple[int, int], int] = {}
        token = [-1]
        for t, i in self.id.items():
            node = 0
            for c in t:
                if (node, c) not in step:
                    step[node, c] = len(token)
                    token.append(-1)
                node = step[node, c]
            token[node] = i
        self.steps, self.token = StepTable(step, 256), np.array(token)
        self.single = np.array([[self.id[bytes([b])], self.id[bytes([b]) + _END]] for b in range(255)] + [[-1, -1]])
        n = max(self.shown) + 1
        self.rank, self.left, self.right = np.full(n, -1, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        for r, pair in enumerate(model["merges"]):
            x, y = pair if isinstance(pair, list) else pair.split(" ")
            a, b, c = model["vocab"][x], model["vocab"][y], model["vocab"][x + y]
            self.merge[a, b] = (r, c)
            if self.rank[c] < 0:
                self.rank[c], self.left[c], self.right[c] = r, a, b
        self.pairs = StepTable({k: r << 20 | c for k, (r, c) in self.merge.items()}, 1 << 20)
        made = np.flatnonzero(self.rank >= 0)
        fine = np.ones(n, bool)
        fine[made] = self.compatible(self.left[made], self.right[made], self.rank[made])
        for c in made[np.argsort(self.rank[made])].tolist():
            fine[c] &= fine[self.left[c]] and fine[self.right[c]]
        self.reachable = fine
        self.split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.words = regex.compile(pattern)

    @staticmethod
    def _pattern(spec: dict) -> str:
        """The file's pattern of words; a file that asks for steps other than those built here is refused."""
        steps = lambda part, names: spec[part][names] if spec[part] and spec[part]["type"] == "Sequence" else [spec[part]]
        first, *rest = steps("pre_tokenizer", "pretokenizers")
        fine = (
            steps("normalizer", "normalizers") == [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
            and (first or {}).get("type") == "Split" and first.get("invert") is True and first.get("behavior") == "Removed" and "Regex" in first["pattern"]
            and [(s["type"], s.get("add_prefix_space"), s.get("use_regex")) for s in rest] == [("ByteLevel", False, False)]
            and spec["post_processor"] is None and spec["decoder"] is None
            and all(not spec["model"].get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges"))
            and spec["model"].get("end_of_word_suffix")
            and not any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in spec["added_tokens"])
        )
        if not fine:
            raise ValueError("the vocabulary file asks for a normaliser, split, model or added tokens that are not supported")
        return first["pattern"]["Regex"]

    def compatible(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray | None = None) -> np.ndarray:
        """Whether no merge across the border of ``a`` and ``b`` comes (before rank ``limit``) while both are made.

        Goes back in time: the side that was made last is undone until both
        are single symbols, and at each step the merge across is looked up.
        At equal ranks the left one of two merges comes first.
        """
        n = len(a)
        ok = np.ones(n, bool)
        at, a, b = np.arange(n), a.copy(), b.copy()
        until_a = np.full(n, _NONE) if limit is None else limit.copy()
        until_b = until_a - 1
        while len(at):
            r = self.pairs.get(a, b)
            r = np.where(r >= 0, r >> 20, _NONE)
            bad = (r < until_a) & (r <= until_b)
            ok[at[bad]] = False
            go = ~bad & ((self.rank[a] >= 0) | (self.rank[b] >= 0))
            at, a, b, until_a, until_b = at[go], a[go], b[go], until_a[go], until_b[go]
            undo_b = self.rank[b] >= self.rank[a]
            until_a, until_b = np.where(undo_b, until_a, self.rank[a]), np.where(undo_b, self.rank[b], until_b)
            a, b = np.where(undo_b, a, self.right[a]), np.where(undo_b, self.left[b], b)
        return ok

    def propose(self, data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Longest match from the left, for many words at once: the word and the id of each token, in order.

        Words end with the end mark, which never stands alone.
        """
        words, ids, turns = [], [], []
        live, begin, at = np.arange(len(start)), start.copy(), start.copy()
        node = np.zeros(len(start), np.int64)
        best, best_at = np.full(len(start), -1, np.int64), start.copy()
        turn = 0
        while len(live):
            more = at < stop
            node = np.where(more, self.steps.get(node, data[np.minimum(at, len(data) - 1)].astype(np.int64)), -1)
            at = at + 1
            hit = np.where(node >= 0, self.token[node], -1)
            fine = (hit >= 0) & (at != stop - 1)
            best, best_at = np.where(fine, hit, best), np.where(fine, at, best_at)
            done = np.flatnonzero(node < 0)
            if len(done):
                words.append(live[done])
                ids.append(best[done])
                turns.append(np.full(len(done), turn))
                begin[done] = at[done] = best_at[done]
                node[done], best[done] = 0, -1
                go = begin < stop
                live, begin, at, node, best, best_at, start, stop = (x[go] for x in (live, begin, at, node, best, best_at, start, stop))
            turn += 1
        if not words:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        word, token = np.concatenate(words), np.concatenate(ids)
        order = np.lexsort((np.concatenate(turns), word))
        return word[order], token[order]

    def merge_together(self, raw: list[bytes]) -> list[list[int]]:
        """Merging by rank, leftmost first, one merge in each word at a time."""
        size = np.fromiter(map(len, raw), np.int64, len(raw)) - 1
        width = int(size.max(initial=1))
        data = np.frombuffer(b"".join(raw), np.uint8)
        first = np.cumsum(size + 1) - size - 1
        cols = np.arange(width)
        inside = cols < size[:, None]
        byte = np.where(inside, data[np.minimum(first[:, None] + cols, len(data) - 1)], 255)
        ids = self.single[byte, (cols == size[:, None] - 1).astype(int)]
        right = np.concatenate([ids[:, 1:], np.full((len(raw), 1), -1)], 1)
        found = self.pairs.get(ids.ravel(), right.ravel()).reshape(ids.shape)
        found = np.where(found >= 0, found, _NONE << 20)
        out = ids.copy()
        live = np.arange(len(raw))
        while len(live):
            k = found.argmin(1)
            least = found[np.arange(len(live)), k]
            go = least < _NONE << 20
            out[live[~go]] = ids[~go]
            live, ids, found, k, least = live[go], ids[go], found[go], k[go], least[go]
            if not len(live):
                break
            rows = np.arange(len(live))
            keep = np.minimum(cols + (cols > k[:, None]), width - 1)  # the symbol after k goes
            ids, found = np.take_along_axis(ids, keep, 1), np.take_along_axis(found, keep, 1)
            ids[:, -1], found[:, -1] = -1, _NONE << 20
            ids[rows, k] = least & ((1 << 20) - 1)
            for at in (k - 1, k):
                ok = (at >= 0) & (at < width - 1)
                left, after = ids[rows[ok], at[ok]], ids[rows[ok], at[ok] + 1]
                new = self.pairs.get(left, after)
                found[rows[ok], at[ok]] = np.where(new >= 0, new, _NONE << 20)
        return [row[: n].tolist() for row, n in zip(out, (out >= 0).sum(1).tolist(), strict=True)]

    def merged_exactly(self, word: bytes) -> list[int]:
        """Merging by rank, leftmost first, with a heap over a linked list of symbols."""
        cuts = [word[i : i + 1] for i in range(len(word) - 2)] + [word[-2:]]
        ids = [self.id[c] for c in cuts]
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m[0], i, ids[i], ids[i + 1], m[1]) for i in range(n - 1) if (m := self.merge.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, c = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = c, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                if m := self.merge.get((c, ids[after[i]])):
                    heapq.heappush(heap, (m[0], i, c, ids[after[i]], m[1]))
            if (p := before[i]) >= 0 and (m := self.merge.get((ids[p], c))):
                heapq.heappush(heap, (m[0], p, ids[p], c, m[1]))
        return [t for t in ids if t >= 0]

    def encode_words(self, words: list[str]) -> list[list[int]]:
        raw = [w.encode("utf-8", "surrogatepass") + _END for w in words]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        stop = np.cumsum(size)
        owner, flat = self.propose(np.frombuffer(b"".join(raw), np.uint8), stop - size, stop)
        bad = np.zeros(len(raw), bool)
        bad[owner[~self.reachable[flat]]] = True
        pair = np.flatnonzero(owner[1:] == owner[:-1])
        codes, back = np.unique(flat[pair] << 20 | flat[pair + 1], return_inverse=True)
        bad[owner[pair[~self.compatible(codes >> 20, codes & ((1 << 20) - 1))[back]]]] = True
        found = [x.tolist() for x in np.split(flat, np.cumsum(np.bincount(owner, minlength=len(raw)))[:-1])]
        short = np.flatnonzero(bad & (size <= TOGETHER))
        for at in range(0, len(short), 5_000):
            own = short[at : at + 5_000].tolist()
            for i, ids in zip(own, self.merge_together([raw[i] for i in own]), strict=True):
                found[i] = ids
        for i in np.flatnonzero(bad & (size > TOGETHER)).tolist():
            found[i] = self.merged_exactly(raw[i])
        return found

    def pieces(self, text: str) -> Iterator[tuple[str | None, list[str]]]:
        """Runs of words, each after a special token or None."""
        parts = self.split.split(text) if self.split and "<" in text else [text]
        for i in range(0, len(parts), 2):
            part = parts[i]
            if not part.isascii():
                part = unicodedata.normalize("NFC", part).replace("Σ", "σ")
            yield parts[i - 1] if i else None, self.words.findall(part.lower())


class Encoder:
    """Encodes texts with a table of the words met so far: their ids as bytes, or else ids and tokens as text."""

    def __init__(self, vocabulary: Vocabulary, as_text: bool):
        self.v, self.as_text = vocabulary, as_text
        self.ids: dict[str, bytes | str] = {}
        self.shown: dict[str, str] = {}
        for t, i in vocabulary.special.items():
            self._keep(t, [i])
        self.long = False

    def _keep(self, word: str, found: list[int]) -> None:
        if self.as_text:
            self.ids[word] = " ".join(map(str, found))
            self.shown[word] = " ".join(map(self.v.shown.__getitem__, found))
        else:
            self.ids[word] = np.array(found, np.int32).tobytes()

    def _words(self, text: str) -> list[str]:
        out: list[str] = []
        for mark, words in self.v.pieces(text):
            if mark is not None:
                out.append(mark)
            out += words
        return out

    def _know(self, docs: Iterable[list[str]]) -> None:
        new = set().union(*docs) - self.ids.keys()
        if new:
            words = list(new)
            for w, found in zip(words, self.v.encode_words(words), strict=True):
                self._keep(w, found)
                self.long |= len(w) > CACHE_LENGTH

    def _trim(self) -> None:
        """Forget every word beyond the bound, or else the very long ones."""
        full = len(self.ids) > CACHE
        for d in (self.ids, self.shown):
            for w in [w for w in d if w not in self.v.special and (full or len(w) > CACHE_LENGTH)]:
                del d[w]

    def texts(self, texts: list[str | None]) -> Iterator[list[str]]:
        docs = [self._words(t or "") for t in texts]
        self._know(docs)
        yield from docs
        if self.long or len(self.ids) > CACHE:
            self._trim()
            self.long = False


#: A worker's encoder, kept from task to task.
_encoders: dict[tuple[str, bool], Encoder] = {}


def _encoder(vocabulary, as_text: bool) -> Encoder:
    v = vocabulary.value
    if (v.key, as_text) not in _encoders:
        _encoders.clear()
        _encoders[v.key, as_text] = Encoder(v, as_text)
    return _encoders[v.key, as_text]


def _hex(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def _report(batches: Iterator[pa.RecordBatch], vocabulary) -> Iterator[pa.RecordBatch]:
    enc = _encoder(vocabulary, True)
    for batch in batches:
        for rows, _, _ in chunks(batch, "text", 1 << 20):
            n, ids, shown = [], [], []
            for words in enc.texts(rows.column("text").to_pylist()):
                said = " ".join(map(enc.ids.__getitem__, words))
                n.append(said.count(" ") + 1 if said else 0)
                ids.append(_hex(said))
                shown.append(_hex(" ".join(map(enc.shown.__getitem__, words))))
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids), pa.array(shown)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def _encode(batches: Iterator[pa.RecordBatch], vocabulary, text: str, ids: str, decoded: str | None) -> Iterator[pa.RecordBatch]:
    enc = _encoder(vocabulary, False)
    shown = vocabulary.value.shown
    for batch in batches:
        for rows, _, _ in chunks(batch, text, 1 << 19):
            found = [b"".join(map(enc.ids.__getitem__, words)) for words in enc.texts(rows.column(text).to_pylist())]
            ends = np.cumsum([0, *(len(x) // 4 for x in found)]).astype(np.int32)
            out = [*rows.columns, pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(found), np.int32)))]
            if decoded is not None:
                out.append(pa.array([" ".join(map(shown.__getitem__, np.frombuffer(x, np.int32).tolist())) for x in found], pa.string()))
            yield pa.RecordBatch.from_arrays(out, names=[*rows.schema.names, ids, *[decoded] * (decoded is not None)])


def _decode(batches: Iterator[pa.RecordBatch], vocabulary, ids: str, text: str) -> Iterator[pa.RecordBatch]:
    shown = vocabulary.value.shown
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            rows = batch.slice(at, 256)
            said = [None if x is None else " ".join(shown[i] for i in x if i in shown) for x in (v.as_py() for v in rows.column(ids))]
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(said, pa.string())], names=[*rows.schema.names, text])


def _schema(df: DataFrame, name: str, kind: str) -> str:
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), f"`{name}` {kind}"])


def encode(df: DataFrame, *, path: str | None = None, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """Add the token ids of each whole text as ``array<int>``; a null text counts as empty.

    ``path`` names the vocabulary file. Special tokens in a text are encoded
    as such. With ``decoded``, the text that the ids give back is added too, in
    the same pass. Columns of these names are replaced. Every row stays.
    """
    df = without(df, text, ids, *[decoded] * (decoded is not None))
    vocabulary = df.sparkSession.sparkContext.broadcast(Vocabulary(path))
    schema = _schema(df, ids, "array<int>") + (f", `{decoded}` string" if decoded is not None else "")
    return df.mapInArrow(partial(_encode, vocabulary=vocabulary, text=text, ids=ids, decoded=decoded), schema)


def decode(df: DataFrame, *, path: str | None = None, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Add the text of token ids: their strings joined by blanks. Unknown and null ids are skipped, null stays null.

    A column called ``text`` is replaced.
    """
    df = without(df, ids, text)
    vocabulary = df.sparkSession.sparkContext.broadcast(Vocabulary(path))
    return df.mapInArrow(partial(_decode, vocabulary=vocabulary, ids=ids, text=text), _schema(df, text, "string"))


def bpe_report(docs: DataFrame, *, path: str | None = None) -> DataFrame:
    """Token count and digests of ids and decoded text, one row for each row of ``docs``."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(Vocabulary(path))
    return docs.select(F.col("doc_id"), F.col("text")).mapInArrow(partial(_report, vocabulary=vocabulary), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
