"""Hierarchical multi-length packing of documents into training sequences.

Documents are cut into whole windows of the largest context size; what is left
of each is routed to the smallest tier (a power of two) that holds it. Each
tier is packed from the longest to the shortest: a window opens with one piece
of its tier, its gap is filled with whole pieces of shorter tiers, largest that
fits first, and at last with a cut piece, so that windows close exactly full.
Pieces that meet no more partners at the end of a task are joined and cut into
windows of powers of two. Finished sequences are dealt to step groups, largest
first and always to the lightest group, so that groups hold equal tokens.

Contract for odd input
----------------------
Null text counts as empty and holds the end id alone. Rows with a null id and
rows that repeat an id are packed like any other. Other columns are not read.
An empty table gives no pieces.
"""

from __future__ import annotations

import heapq
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import list_array, quoted
from .pretoken import array_slices, tokenizer

WINDOW = 2048
TIERS = (2048, 1024, 512, 256)
STEP_TOKENS = 16 * WINDOW


class Packer:
    """Packs pieces (length, document row, start) of one task; only unplaced pieces stay between calls."""

    def __init__(self, tiers: tuple[int, ...] = TIERS):
        self.tiers = tiers
        self.pools: dict[int, list[tuple[int, int, int]]] = {t: [] for t in tiers}
        self.done: list[list[tuple[int, int, int]]] = []

    def _route(self, length: int, doc: int, start: int) -> None:
        if length:
            insort(self.pools[min(t for t in self.tiers if t >= length)], (length, doc, start))

    def add(self, doc: int, n: int) -> None:
        top = self.tiers[0]
        for start in range(0, n - n % top, top):
            self.done.append([(top, doc, start)])
        self._route(n % top, doc, n - n % top)

    def _fill(self, at: int, row: list[tuple[int, int, int]], gap: int) -> bool:
        """Fill a gap from the tiers from number `at` on, else from this tier; False if no pieces are left for it."""
        below = self.tiers[at + 1 :] or self.tiers[at:]
        while gap:
            for t in below:  # whole pieces, largest that fits
                k = bisect_right(self.pools[t], (gap, 1 << 60, 0))
                if k:
                    piece = self.pools[t].pop(k - 1)
                    row.append(piece)
                    gap -= piece[0]
                    break
            else:
                t = next((t for t in (*reversed(below), self.tiers[at]) if self.pools[t]), None)
                if t is None:
                    return False
                length, doc, start = self.pools[t].pop(0)
                row.append((gap, doc, start))
                self._route(length - gap, doc, start + gap)
                gap = 0
        return True

    def pack(self, last: bool = False) -> list[list[tuple[int, int, int]]]:
        """The sequences that are full by now; with last, all that is left too."""
        for at, tier in enumerate(self.tiers):
            pool = self.pools[tier]
            while pool:
                row = [pool.pop()]
                if not self._fill(at, row, tier - row[0][0]):
                    for piece in row:
                        self._route(*piece)
                    break
                self.done.append(row)
        if last:
            left = [piece for t in self.tiers for piece in reversed(self.pools[t])]
            self.pools = {t: [] for t in self.tiers}
            room, row = 0, []
            total = sum(piece[0] for piece in left)
            for length, doc, start in left:
                while length:
                    if not room:
                        room = min(self.tiers[0], 1 << (total.bit_length() - 1))
                        row = []
                        self.done.append(row)
                    cut = min(length, room)
                    row.append((cut, doc, start))
                    length, start, room, total = length - cut, start + cut, room - cut, total - cut
        out, self.done = self.done, []
        return out

    def waiting(self) -> set[int]:
        return {piece[1] for pool in self.pools.values() for piece in pool}


def step_groups(sizes: list[int], step_tokens: int = STEP_TOKENS) -> list[int]:
    """A group number for each sequence; groups differ by less than the largest sequence."""
    n = max(1, -(-sum(sizes) // step_tokens))
    loads, out = [(0, g) for g in range(n)], [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        load, g = heapq.heappop(loads)
        out[i] = g
        heapq.heappush(loads, (load + sizes[i], g))
    return out


_PIECES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "context_size", "step_group"]
PIECE_SCHEMA = ", ".join(f"{c} long" for c in _PIECES)


def _pack(path: str, separator: str, keep_space: bool, end_id: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, packer = tokenizer(path, separator, keep_space), Packer()
        held: dict[int, tuple] = {}  # by row: document id, tokens
        base = TaskContext.get().partitionId() << 32
        rows, sequences, groups = 0, 0, 0

        def emit(done: list) -> Iterator[pa.RecordBatch]:
            nonlocal sequences, groups
            if not done:
                return
            sizes = [sum(p[0] for p in row) for row in done]
            steps = step_groups(sizes)
            out, ids = [], []
            for row, size, step in zip(done, sizes, steps, strict=True):
                offset = 0
                for length, doc, start in row:
                    doc_id, tokens = held[doc]
                    cut = tokens[start : start + length]
                    out.append((doc_id, start, length, zlib.crc32(cut.data), len(tokens), base + sequences, offset, 1 << (size - 1).bit_length(), base + groups + step))
                    offset += length
                    if with_ids:
                        ids.append(cut)
                sequences += 1
            groups += max(steps) + 1
            columns = [pa.array(c, pa.int64()) for c in zip(*out, strict=True)]
            if with_ids:
                columns.append(list_array(np.concatenate(ids).view(np.int32), np.array([len(x) for x in ids])))
            yield pa.RecordBatch.from_arrays(columns, names=_PIECES + ["ids"] * with_ids)

        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for a, b in array_slices(texts):
                flat, lengths = own.encode(texts.slice(a, b - a))
                ends = np.cumsum(lengths)
                flat = np.insert(flat, ends, end_id).astype("<u4")
                ends += np.arange(1, b - a + 1)
                at = 0
                for doc_id, end in zip(doc_ids[a:b], ends.tolist(), strict=True):
                    held[rows] = (doc_id, flat[at:end])
                    packer.add(rows, end - at)
                    rows, at = rows + 1, end
                yield from emit(packer.pack())
                held = {k: (held[k][0], held[k][1].copy()) for k in packer.waiting()}
        yield from emit(packer.pack(last=True))

    return run


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", separator: str = "<|endoftext|>", keep_space: bool = False, with_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, context_size, step_group (and ids).

    Each task packs the rows of its own input split, so nothing is shuffled; a
    task keeps at most the unplaced pieces, which are fewer than its shortest
    pool can absorb, and ends with a handful of short windows. Sequence ids
    join the split's number and a count, so a task that runs again after a lost
    executor gives the same rows where its input has a fixed order, as files have;
    what comes out of a shuffle should be written first (the pipeline does).
    """
    texts = docs.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), F.col(quoted(text_col)).alias("text"))
    schema = PIECE_SCHEMA + (", ids array<int>" if with_ids else "")
    return texts.mapInArrow(_pack(tokenizer_path, separator, keep_space, end_id, with_ids), schema)
