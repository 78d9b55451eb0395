"""Token-id files: frequency-ranked ids in byte-aligned variable-length coding with separate control bytes.

A file row holds one block of whole documents in ascending id order:

* `vocabulary`: the block's ids by falling frequency (ties by id), so that the
  commonest ids get the smallest ranks and the fewest bytes;
* `control`: two bits a token, four tokens a byte, the token's byte count less 1;
* `data`: the little-endian bytes of the ranks, without their leading zeros.

Every block carries its own ranks, so files are written in one pass over the
corpus, and any of them can be read, or rewritten after a lost executor, alone.

Contract for odd input
----------------------
Null text counts as empty and holds the end id alone. Rows with a null id come
first; rows that repeat an id each get a record. Other columns are not read. An
empty table gives no blocks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, list_array, quoted
from .pretoken import array_slices, tokenizer

BLOCK_TOKENS = 2_000_000
DOCS_PER_FILE = 8192
_SIZES = np.array([[(c >> s & 3) + 1 for s in (0, 2, 4, 6)] for c in range(256)], np.uint8)
_MASKS = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)


def encode_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """(control, data) of unsigned 32-bit values."""
    r = np.ascontiguousarray(ranks, "<u4")
    code = (r > 0xFF).astype(np.uint8) + (r > 0xFFFF) + (r > 0xFFFFFF)
    padded = np.zeros(-(-len(r) // 4) * 4, np.uint8)
    padded[: len(r)] = code
    quads = padded.reshape(-1, 4)
    control = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
    return control.astype(np.uint8).tobytes(), r.view(np.uint8).reshape(-1, 4)[np.arange(4) <= code[:, None]].tobytes()


def decode_ranks(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n values: sizes by table lookup of each control byte, then gathered bytes under a mask by size."""
    sizes = _SIZES[np.frombuffer(control, np.uint8)].ravel()[:n]
    at = np.cumsum(sizes, dtype=np.int64) - sizes
    raw = np.frombuffer(data + b"\0\0\0", np.uint8)
    out = raw[at].astype(np.uint32)
    for k in range(1, int(sizes.max(initial=1))):
        out |= raw[at + k].astype(np.uint32) << np.uint32(8 * k)
    return out & _MASKS[sizes]


def _block(part: int, block: int, ids: list, counts: list, tokens: list[np.ndarray], vocab: int) -> pa.RecordBatch:
    flat = np.concatenate(tokens)
    seen = np.bincount(flat, minlength=vocab)
    order = np.argsort(-seen, kind="stable")[: np.count_nonzero(seen)].astype(np.int32)
    rank = np.zeros(vocab, np.uint32)
    rank[order] = np.arange(len(order), dtype=np.uint32)
    control, data = encode_ranks(rank[flat])
    docs = pa.array([ids], pa.list_(pa.int64()))
    return pa.RecordBatch.from_arrays(
        [pa.array([part], pa.int32()), pa.array([block], pa.int32()), docs, list_array(np.array(counts, np.int64), np.array([len(counts)])), list_array(order, np.array([len(order)])), pa.array([control], pa.binary()), pa.array([data], pa.binary())],
        names=["part", "block", "doc_ids", "counts", "vocabulary", "control", "data"],
    )


BLOCK_SCHEMA = "part int, block int, doc_ids array<long>, counts array<long>, vocabulary array<int>, control binary, data binary"


def _encode(path: str, separator: str, keep_space: bool, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(path, separator, keep_space)
        vocab = max(own.plain.get_vocab_size(), end_id + 1)
        part, block, ids, counts, tokens, size = 0, 0, [], [], [], 0
        for batch in batches:
            doc_ids, texts, parts = batch.column(0).to_pylist(), batch.column(1), batch.column(2)
            part = parts[0].as_py() if batch.num_rows else part
            for a, b in array_slices(texts):
                flat, lengths = own.encode(texts.slice(a, b - a))
                ends = np.cumsum(lengths)
                tokens.append(np.insert(flat, ends, end_id).astype(np.int32))
                ids += doc_ids[a:b]
                counts += (lengths + 1).tolist()
                size += len(tokens[-1])
                if size >= BLOCK_TOKENS:
                    yield _block(part, block, ids, counts, tokens, vocab)
                    block, ids, counts, tokens, size = block + 1, [], [], [], 0
        if ids:
            yield _block(part, block, ids, counts, tokens, vocab)

    return run


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", separator: str = "<|endoftext|>", keep_space: bool = True) -> None:
    """Write every text's ids, each text ended by end_id, to files under path in ascending id order.

    One range shuffle of the texts puts them in order; tokens, ranks and codes
    are made where the file is written.
    """
    texts = docs.select(F.col(quoted(id_col)).cast("long").alias("id"), F.col(quoted(text_col)).alias("text"))
    files = max(1, -(-docs.select(F.col(quoted(id_col))).count() // DOCS_PER_FILE))
    ordered = texts.repartitionByRange(files, "id").sortWithinPartitions("id").withColumn("part", F.spark_partition_id())
    ordered.mapInArrow(_encode(tokenizer_path, separator, keep_space, end_id), BLOCK_SCHEMA).write.mode("overwrite").parquet(path)


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(batch.num_rows):
            part, block, ids, counts, vocabulary, control, data = (batch.column(i)[row] for i in range(7))
            counts = np.asarray(counts.values)
            ends = np.cumsum(counts)
            ranks = decode_ranks(control.as_py(), data.as_py(), int(ends[-1]))
            tokens = np.asarray(vocabulary.values).astype("<u4")[ranks]
            yield pa.RecordBatch.from_arrays(
                [pa.array([part.as_py()] * len(counts), pa.int32()), pa.array([block.as_py()] * len(counts), pa.int32()), ids.values, pa.array(ends - counts), pa.array(counts), list_array(tokens.view(np.int32), counts)],
                names=["part", "block", "doc_id", "local_start", "n_tokens", "ids"],
            )


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _decode(batches):
        ids, n = batch.column(5), batch.num_rows
        flat, at = np.asarray(ids.values).view(np.uint32), np.asarray(ids.offsets)
        crc = np.fromiter((zlib.crc32(flat[at[i] : at[i + 1]].data) for i in range(n)), np.int64, n)
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(5)), pa.array(crc)], names=["part", "block", "doc_id", "local_start", "n_tokens", "ids_crc32"])


_DOC = "part int, block int, doc_id long, local_start long, n_tokens long"


def _with_starts(found: DataFrame, blocks: DataFrame) -> DataFrame:
    """Global starts: within a file by block, and by file; both tables hold a row a block or file, not a document."""
    totals = blocks.select("part", "block", F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x).alias("tokens"))
    inner = totals.withColumn("before", F.sum("tokens").over(Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("tokens"))
    files = totals.groupBy("part").agg(F.sum("tokens").alias("all"))
    files = files.select("part", (F.sum("all").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("all")).alias("base"))
    starts = inner.join(files, "part").select("part", "block", (F.col("base") + F.col("before")).alias("base"))
    return found.join(starts, ["part", "block"]).withColumn("start", F.col("base") + F.col("local_start"))


def read_token_files(blocks: DataFrame, with_ids: bool = True) -> DataFrame:
    """Per document from the files: doc_id, start, n_tokens and either ids or their ids_crc32."""
    last = ("ids", "ids array<int>", _decode) if with_ids else ("ids_crc32", "ids_crc32 long", _digest)
    found = blocks.mapInArrow(last[2], f"{_DOC}, {last[1]}")
    return _with_starts(found, blocks).select("doc_id", "start", "n_tokens", last[0])


def token_file_digest(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """Write the files to the shared folder and describe each document as read back; the files go once the description is stored."""
    spark = docs.sparkSession
    with Scratch(spark) as scratch:
        path = scratch.folder()
        write_token_files(docs, path, tokenizer_path, end_id)
        return scratch.keep(read_token_files(spark.read.schema(BLOCK_SCHEMA).parquet(path), with_ids=False))
