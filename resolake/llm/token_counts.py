"""Token counts by dynamic programming shared along a trie of pre-tokens.

Distinct pre-tokens (marked words) go into a trie. The best unigram score of a
prefix depends on the prefix alone, so forward scores and token counts are
computed once per trie node and read off at the nodes where pre-tokens end.

Contract for odd input
----------------------
Null and empty texts count 0 tokens. Null or repeated ids are carried along.
Other columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import quoted
from .pretoken import array_slices
from .unigram import LONG_UNIT, PieceTrie, best_path, piece_trie, units, utf8_lengths

#: Units that a worker remembers, each of at most so many characters.
MAX_UNITS, MAX_CHARS = 500_000, 64
_CHUNK = 65_536


def _long_count(trie: PieceTrie, unit: str) -> int:
    total, at = 0, 0
    for state, k in best_path(trie, unit):
        total += 1 if state else len(unit[at].encode("utf-8", "surrogatepass"))
        at += k
    return total


def trie_counts(trie: PieceTrie, found: list[str]) -> np.ndarray:
    """Tokens of each distinct unit.

    Level by level: a node is a distinct prefix. For each node and each start
    within a piece's length it keeps the piece trie's state, and the best score
    and count at that start; the best of the ending pieces, or of bytes for the
    last character, gives the node's own.
    """
    out = np.zeros(len(found), np.int64)
    size = np.array([len(u) for u in found], np.int64)
    for i in np.flatnonzero(size > LONG_UNIT):
        out[i] = _long_count(trie, found[i])
    at = np.flatnonzero((size <= LONG_UNIT) & (size > 0))
    if not len(at):
        return out
    size, width = size[at], int(size[at].max())
    points = np.zeros((len(at), width), np.uint32)
    points[np.arange(width) < size[:, None]] = trie.code_points("".join(found[i] for i in at))
    node, alive = np.zeros(len(at), np.int64), np.arange(len(at))
    states, scores, counts = np.zeros((1, 0), np.int32), np.zeros((1, 0)), np.zeros((1, 0), np.int64)
    best, count = np.zeros(1), np.zeros(1, np.int64)
    for depth in range(width):
        keep = size[alive] > depth
        alive, node = alive[keep], node[keep]
        keys, node = np.unique(node << 32 | points[alive, depth].astype(np.int64), return_inverse=True)
        parent, point = keys >> 32, (keys & 0xFFFFFFFF).astype(np.uint32)
        code = trie.encode_chars(point)
        old = slice(0, trie.longest - 1)
        # column 0 starts at this character, column k at the k-th before it
        states = np.concatenate([np.ones((len(keys), 1), np.int32), states[parent][:, old]], axis=1)
        scores = np.concatenate([best[parent, None], scores[parent][:, old]], axis=1)
        counts = np.concatenate([count[parent, None], counts[parent][:, old]], axis=1)
        states = trie.step(states, code[:, None]).astype(np.int32)
        total = np.where(trie.piece[states] >= 0, scores + trie.score[states], -np.inf)
        pick = total.shape[1] - 1 - total[:, ::-1].argmax(axis=1)  # ties: the earliest start
        rows = np.arange(len(keys))
        best, count = total[rows, pick], counts[rows, pick] + 1
        other = np.where(trie.piece[states[:, 0]] >= 0, -np.inf, scores[:, 0] + trie.unknown)
        bytes_win = other > best
        best, count = np.where(bytes_win, other, best), np.where(bytes_win, counts[:, 0] + utf8_lengths(point), count)
        done = size[alive] == depth + 1
        out[at[alive[done]]] = count[node[done]]
    return out


class _Counts:
    """A worker's counts of the units that it has met."""

    def __init__(self, path: str):
        self.trie = piece_trie(path)
        self.index: dict[str, int] = {}

    def of(self, texts: list[str]) -> np.ndarray:
        if len(self.index) > MAX_UNITS:
            self.index.clear()
        split = [units(t) for t in texts]
        every = {u for s in split for u in s} - self.index.keys()
        new, long = [u for u in every if len(u) <= MAX_CHARS], [u for u in every if len(u) > MAX_CHARS]
        for a in range(0, len(new), _CHUNK):
            part = new[a : a + _CHUNK]
            self.index.update(zip(part, trie_counts(self.trie, part).tolist(), strict=True))
        get = self.index.__getitem__
        if long:
            get = (self.index | dict(zip(long, trie_counts(self.trie, long).tolist(), strict=True))).__getitem__
        return np.array([sum(map(get, s)) for s in split], np.int64)


@lru_cache(maxsize=2)
def _counts(path: str) -> _Counts:
    return _Counts(path)


def _count(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _counts(path)
        for batch in batches:
            for a, b in array_slices(batch.column(1)):
                texts = [t or "" for t in batch.column(1).slice(a, b - a).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(own.of(texts))], names=["doc_id", "n_tokens"])

    return run


def count_tokens(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens) of every whole text.

    Each task builds tries of the pre-tokens of its own split, a slice of texts
    at a time, so memory is bounded and nothing is shuffled.
    """
    rows = docs.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), F.col(quoted(text_col)).alias("text"))
    return rows.mapInArrow(_count(model_path), "doc_id long, n_tokens long")
