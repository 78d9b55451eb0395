"""SentencePiece-style encoding and decoding: unigram Viterbi over a double-array trie, byte fallback, space marks.

A text becomes a space mark, then its characters with each space as the mark.
The best path under the pieces' log scores gives the ids; characters outside
all pieces become byte pieces. Decoding joins pieces and bytes, turns marks
into spaces and drops the first. (A text that itself holds the mark decodes it
as a space, as in SentencePiece.)

Contract for odd input
----------------------
Null and empty texts have no ids and decode to the empty text. Null or repeated
ids are carried along. Other columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import list_array, quoted
from .pretoken import UnitMemo, array_slices
from .unigram import LONG_UNIT, MARK, PieceTrie, best_path, piece_trie, units


def viterbi(trie: PieceTrie, points: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best paths of many units at once: per unit and end position the last piece's state (0: bytes) and its length.

    points: units x longest unit, as code points, padded. All units advance
    through the trie together, one character at a time; at each end position
    every start within a piece's length is a candidate, earliest first.
    """
    n, width = points.shape
    codes = trie.encode_chars(points)
    codes[np.arange(width) >= lengths[:, None]] = 0
    best = np.full((width + 1, n), -np.inf)
    best[0] = 0
    last, size = np.zeros((width + 1, n), np.int32), np.ones((width + 1, n), np.int16)
    open_states: list[np.ndarray] = []  # by start, oldest first: the states reached from there
    starts: list[int] = []
    for end in range(1, width + 1):
        open_states.append(np.ones(n, np.int32))
        starts.append(end - 1)
        code = codes[:, end - 1]
        open_states = [trie.step(s, code) for s in open_states]
        keep = [k for k, s in enumerate(open_states) if s.any()]
        single = trie.piece[open_states[-1]] >= 0 if open_states else np.zeros(n, bool)
        for k in keep:
            s = open_states[k]
            score = np.where(trie.piece[s] >= 0, best[starts[k]] + trie.score[s], -np.inf)
            better = score > best[end]
            best[end][better], last[end][better], size[end][better] = score[better], s[better], end - starts[k]
        score = np.where(single, -np.inf, best[end - 1] + trie.unknown)
        better = score > best[end]
        best[end][better], last[end][better], size[end][better] = score[better], 0, 1
        open_states, starts = [open_states[k] for k in keep], [starts[k] for k in keep]
    return last, size


def _ids_of(trie: PieceTrie, state: int, char: str) -> list[int]:
    return [int(trie.piece[state])] if state else trie.byte_ids[np.frombuffer(char.encode("utf-8", "surrogatepass"), np.uint8)].tolist()


def encode_units(trie: PieceTrie, found: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(all ids, number of ids of each unit)."""
    out: list[list[int]] = [[]] * len(found)
    size = np.array([len(u) for u in found], np.int64)
    for i in np.flatnonzero(size > LONG_UNIT):
        ids, at = [], 0
        for state, k in best_path(trie, found[i]):
            ids += _ids_of(trie, state, found[i][at])
            at += k
        out[i] = ids
    short = np.flatnonzero(size <= LONG_UNIT)
    short = short[np.argsort(size[short], kind="stable")]
    for part in np.split(short, range(8192, len(short), 8192)):
        if len(part):
            lengths, width = size[part], int(size[part].max())
            points = np.zeros((len(part), width), np.uint32)
            points[np.arange(width) < lengths[:, None]] = trie.code_points("".join(found[i] for i in part))
            last, step = viterbi(trie, points, lengths)
            at, rows = lengths.copy(), np.arange(len(part))
            states, ends = [], []
            while (at > 0).any():
                states.append(np.where(at > 0, last[at, rows], -1))
                ends.append(at.copy())
                at = np.where(at > 0, at - step[at, rows], 0)
            states, ends = np.array(states).T[:, ::-1], np.array(ends).T[:, ::-1]
            pieces = np.where(states > 0, trie.piece[np.maximum(states, 0)], -1)
            byte_rows = set(np.flatnonzero((states == 0).any(axis=1)).tolist())
            keep = states >= 0
            counts = keep.sum(axis=1)
            flat, at = pieces[keep].tolist(), 0
            for k, i in enumerate(part.tolist()):
                ids = flat[at : at + counts[k]]
                at += counts[k]
                if k in byte_rows:
                    ids = [x for s, e in zip(states[k][keep[k]].tolist(), ends[k][keep[k]].tolist(), strict=True) for x in _ids_of(trie, s, found[i][e - 1])]
                out[i] = ids
    lengths = np.array([len(x) for x in out], np.int64)
    return np.array([x for ids in out for x in ids], np.int32), lengths


@lru_cache(maxsize=2)
def _memo(path: str) -> UnitMemo:
    trie = piece_trie(path)
    return UnitMemo(units, lambda found: encode_units(trie, found))


@lru_cache(maxsize=2)
def _piece_bytes(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of all pieces by id with marks as spaces, start, length)."""
    trie = piece_trie(path)
    n = max([*trie.text, *trie.byte_ids.tolist()]) + 1
    own = [trie.text.get(i, "").replace(MARK, " ").encode() for i in range(n)]
    for b, i in enumerate(trie.byte_ids.tolist()):
        own[i] = bytes([b])
    lengths = np.array([len(x) for x in own], np.int64)
    return np.frombuffer(b"".join(own), np.uint8), np.cumsum(lengths) - lengths, lengths


def decode_ids(path: str, ids: np.ndarray) -> bytes:
    """The UTF-8 text of a sequence of ids, by gathering the pieces' bytes."""
    flat, starts, lengths = _piece_bytes(path)
    each = lengths[ids]
    ends = np.cumsum(each)
    out = flat[np.repeat(starts[ids] - (ends - each), each) + np.arange(int(ends[-1]) if len(ends) else 0)].tobytes()
    return out[1:] if out[:1] == b" " else out


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _memo(path)
        for batch in batches:
            for a, b in array_slices(batch.column(1)):
                texts = [t or "" for t in batch.column(1).slice(a, b - a).to_pylist()]
                ids, lengths = memo.encode(texts)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), list_array(ids, lengths)], names=["doc_id", "ids"])

    return run


def encode_pieces(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids) of every whole text; each task works alone on its split."""
    rows = docs.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), F.col(quoted(text_col)).alias("text"))
    return rows.mapInArrow(_encode(model_path), "doc_id long, ids array<int>")


def _decode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            flat, at = np.asarray(column.flatten()), np.concatenate([[0], np.cumsum(np.asarray(column.value_lengths().fill_null(0)))])
            texts = [decode_ids(path, flat[at[i] : at[i + 1]]).decode("utf-8", "replace") for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return run


def decode_pieces(encoded: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids)."""
    return encoded.select("doc_id", "ids").mapInArrow(_decode(model_path), "doc_id long, text string")


def _digest(path: str):
    encode = _encode(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in encode(batches):
            column = batch.column(1)
            flat, at = np.asarray(column.values).astype("<u4"), np.asarray(column.offsets)
            spans = [flat[at[i] : at[i + 1]] for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(x) for x in spans], pa.int64()), pa.array([zlib.crc32(x.tobytes()) for x in spans], pa.int64()), pa.array([zlib.crc32(decode_ids(path, x)) for x in spans], pa.int64())],
                names=["doc_id", "n_tokens", "ids_crc32", "text_crc32"],
            )

    return run


def pieces_digest(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_crc32 (little-endian unsigned 32-bit ids) and text_crc32 of the text decoded from the ids."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_digest(model_path), "doc_id long, n_tokens long, ids_crc32 long, text_crc32 long")
