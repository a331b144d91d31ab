"""Token counts by dynamic programming on a trie of pre-tokens.

The distinct words of a batch form a trie. For every node, i.e. once per shared
prefix, the best unigram score of the prefix is computed from the nodes above
it, level by level for all words at once; a word's count is stored where it
ends. Texts then add up the counts of their words.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factspan.llm.bytetext import StepTable, chunks
from factspan.llm.tables import without

#: Marks the beginning of a word in the vocabulary.
START = "▁"
#: What a character outside the vocabulary scores below its worst piece.
UNKNOWN_PENALTY = 10.0
#: Words kept in a worker's table, the longest that is kept, and levels that are handled at once.
CACHE = 300_000
CACHE_LENGTH = 64


def default_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


class Pieces:
    """The pieces of a vocabulary file and a trie of them, for one step at a time from many states."""

    def __init__(self, path: str | None = None, pieces: dict[str, float] | None = None):
        if pieces is None:
            from sentencepiece import SentencePieceProcessor

            sp = SentencePieceProcessor(model_file=path or default_path())
            pieces = {sp.id_to_piece(i): sp.get_score(i) for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))}
        self.score = pieces
        self.longest = max(map(len, pieces))
        self.unknown = min(pieces.values()) - UNKNOWN_PENALTY
        letters = sorted({c for p in pieces for c in p})
        self.letter = {c: i + 1 for i, c in enumerate(letters)}
        self.code = np.zeros(max(map(ord, letters)) + 1, np.int64)
        for c, i in self.letter.items():
            self.code[ord(c)] = i
        step: dict[tuple[int, int], int] = {}
        value = [-np.inf]
        for p, s in pieces.items():
            node = 0
            for c in p:
                k = (node, self.letter[c])
                if k not in step:
                    step[k] = len(value)
                    value.append(-np.inf)
                node = step[k]
            value[node] = s
        self.value = np.array(value)
        self.width = len(letters) + 1
        self.steps = StepTable(step, self.width)

    def next(self, state: np.ndarray, code: np.ndarray) -> np.ndarray:
        """The state after one more character, or -1; code 0 is a character of no piece."""
        return self.steps.get(state, code)


def count_words(pieces: Pieces, words: list[str]) -> np.ndarray:
    """Tokens of each word in its best segmentation; among equal scores, the fewest."""
    long = [k for k, w in enumerate(words) if len(w) > CACHE_LENGTH]
    if long and len(long) < len(words):  # a long word would make every row of the table as long
        out = np.zeros(len(words), np.int64)
        out[long] = [count_words(pieces, [words[k]])[0] for k in long]
        short = [k for k, w in enumerate(words) if len(w) <= CACHE_LENGTH]
        out[short] = count_words(pieces, [words[k] for k in short])
        return out
    words = [START + w for w in words]
    size = np.fromiter(map(len, words), np.int64, len(words))
    raw = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    deep = int(size.max(initial=0))
    grid = np.full((len(words), deep), -1, np.int64)
    grid[np.arange(deep)[None, :] < size[:, None]] = raw
    order = np.lexsort(grid.T[::-1]) if len(words) > 1 else np.arange(len(words))
    grid, size = grid[order], size[order]
    span = pieces.longest
    result = np.zeros(len(words), np.int64)
    new = np.zeros(len(words), bool)
    new[:1] = True
    # per node of the level above: states of the pieces that end here, and best (score, count) of the prefixes before them
    node = np.zeros(len(words), np.int64)
    states = np.zeros((1, 0), np.int64)
    best, tokens = np.zeros((1, 1)), np.zeros((1, 1), np.int64)
    for d in range(deep):
        on = size > d
        if d == 0:
            new[1:] = grid[1:, 0] != grid[:-1, 0]
        else:
            new[1:] |= grid[1:, d] != grid[:-1, d]
        rows = np.flatnonzero(on & new)
        at = np.cumsum(on & new) - 1
        parent, char = node[rows], grid[rows, d]
        code = np.where(char < len(pieces.code), pieces.code[np.minimum(char, len(pieces.code) - 1)], 0)
        above = np.concatenate([np.zeros((len(rows), 1), np.int64), states[parent]], 1)[:, :span]
        states = np.empty_like(above)
        for k in range(above.shape[1]):
            states[:, k] = pieces.next(above[:, k], code)
        score = np.where(states >= 0, pieces.value[np.maximum(states, 0)], -np.inf) + best[parent][:, : states.shape[1]]
        bytes_ = np.where(char < 0x80, 1, np.where(char < 0x800, 2, np.where(char < 0x10000, 3, 4)))
        lone = best[parent, 0] + pieces.unknown
        count = tokens[parent][:, : states.shape[1]] + 1
        top = score.max(1, initial=-np.inf)
        fewest = np.where(score == top[:, None], count, np.iinfo(np.int64).max).min(1, initial=np.iinfo(np.int64).max)
        spelt = tokens[parent, 0] + bytes_
        worse = lone > top
        least = np.where(worse, spelt, np.where(lone == top, np.minimum(fewest, spelt), fewest))
        top = np.where(worse, lone, top)
        best = np.concatenate([top[:, None], best[parent]], 1)[:, :span]
        tokens = np.concatenate([least[:, None], tokens[parent]], 1)[:, :span]
        node = np.where(on, at, node)
        ends = np.flatnonzero(size == d + 1)
        result[order[ends]] = least[at[ends]]
    return result


#: A worker's table of words, kept from task to task.
_tables: dict[str, tuple[Pieces, dict[str, int]]] = {}


def _count(batches: Iterator[pa.RecordBatch], pieces, key: str, text: str, name: str) -> Iterator[pa.RecordBatch]:
    if key not in _tables:
        _tables.clear()
        _tables[key] = pieces.value, {}
    known, table = _tables[key]
    for batch in batches:
        for rows, _, _ in chunks(batch, text, 1 << 20):
            docs = [(t or "").split() for t in rows.column(text).to_pylist()]
            fresh = list(set().union(*docs) - table.keys())
            if fresh:
                table.update(zip(fresh, count_words(known, fresh).tolist(), strict=True))
            counts = [sum(map(table.__getitem__, words)) for words in docs]
            if len(table) > CACHE:
                table.clear()
            for w in fresh:
                if len(w) > CACHE_LENGTH:
                    table.pop(w, None)
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(counts, pa.int64())], names=[*rows.schema.names, name])


def count_tokens(docs: DataFrame, *, path: str | None = None, text: str = "text", name: str = "n_tokens") -> DataFrame:
    """Add the number of unigram tokens of each whole text; null and empty texts have none.

    Words are separated by white space and begin with the start mark. A
    segmentation scores the sum of its pieces' scores in the vocabulary at
    ``path``; a character outside it costs a penalty and as many tokens as
    UTF-8 bytes. Every row stays, repeated ones too; a column called ``name``
    is replaced.
    """
    docs = without(docs, text, name)
    pieces = docs.sparkSession.sparkContext.broadcast(Pieces(path))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), f"`{name}` bigint"])
    return docs.mapInArrow(partial(_count, pieces=pieces, key=path or default_path(), text=text, name=name), schema)


def token_report(docs: DataFrame, *, path: str | None = None) -> DataFrame:
    """doc_id, n_words, n_tokens; one row for each row of ``docs``."""
    counted = count_tokens(docs.select("doc_id", "text"), path=path)
    words = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"(?U)[\s\x1c-\x1f]+"), lambda w: w != ""))
    return counted.select("doc_id", words.cast("long").alias("n_words"), "n_tokens")
