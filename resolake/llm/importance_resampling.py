"""Importance resampling towards a target distribution, by external sort-count of hashed features.

Texts become packed streams of uint16 feature buckets with their documents'
offsets, written to the shared folder. The streams are read twice: sorted and
run-length encoded for the counts of the buckets, then to gather the buckets'
log-ratio gains, summed by document with np.add.reduceat. What is drawn are the
highest weights under Gumbel noise that is fixed by the document's id.

Contract for odd input
----------------------
Null and empty texts have no features and weight 0. A null id counts as the
empty text under the noise and comes last among equal scores. Each row is a
document: rows that repeat an id are scored, counted and ranked one by one.
Fewer than ten drawable documents draw none at 10 %; an empty target gives every
bucket the gain of no occurrence; an empty table gives no rows. Other columns
are not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, list_array, quoted
from .pretoken import texts_of
from .words import LETTERS_DIGITS, Memo, split_words

#: A stream block ends after so many features or documents; a longer document has a block to itself.
BLOCK_FEATURES, BLOCK_DOCS = 1 << 20, 1 << 15
#: What a bucket's number fits in.
MAX_BUCKETS = 1 << 16
STREAM = "ids array<long>, n_words array<long>, n_features array<long>, stream binary"

_crcs = Memo(zlib.crc32)


def text_buckets(text: str | None, longest: int, buckets: int) -> tuple[int, np.ndarray]:
    """(number of words, bucket of every run of 1 to `longest` words, repeats included)."""
    words = split_words(text, LETTERS_DIGITS)
    running = list(map(_crcs.__getitem__, words))
    found = [np.array(running, np.uint32)]
    if longest > 1:
        spaced = [b" " + w for w in words]
        for n in range(2, min(longest, len(words)) + 1):
            running = list(map(zlib.crc32, spaced[n - 1 :], running))  # of the run one word longer
            found.append(np.array(running, np.uint32))
    return len(words), (np.concatenate(found) % np.uint32(buckets)).astype(np.uint16)


def _block(ids: list, words: list[int], parts: list[np.ndarray]) -> pa.RecordBatch:
    one = np.array([len(ids)])
    sizes = np.array([len(p) for p in parts], np.int64)
    stream = np.concatenate(parts).astype("<u2").tobytes()
    return pa.RecordBatch.from_arrays([pa.array([ids], pa.list_(pa.int64())), list_array(np.array(words, np.int64), one), list_array(sizes, one), pa.array([stream], pa.binary())], names=["ids", "n_words", "n_features", "stream"])


def _streams(longest: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, words, parts, size = [], [], [], 0
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), strict=True):
                n, found = text_buckets(text, longest, buckets)
                ids.append(i)
                words.append(n)
                parts.append(found)
                size += len(found)
                if size >= BLOCK_FEATURES or len(ids) >= BLOCK_DOCS:
                    yield _block(ids, words, parts)
                    ids, words, parts, size = [], [], [], 0
        if ids:
            yield _block(ids, words, parts)

    return run


def feature_streams(texts: DataFrame, id_col: str, text_col: str, longest: int, buckets: int) -> DataFrame:
    """Blocks of documents: ids, words and features of each, and all their buckets as one packed uint16 stream."""
    if not 0 < buckets <= MAX_BUCKETS:
        raise ValueError(f"buckets must be from 1 to {MAX_BUCKETS}")
    rows = texts.select(F.col(quoted(id_col)).cast("long").alias("id"), F.col(quoted(text_col)).cast("string").alias("text"))
    return rows.mapInArrow(_streams(longest, buckets), STREAM)


def _run_lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sort each stream; a run's length is its bucket's count."""
    for batch in batches:
        for stream in batch.column(0):
            own = np.sort(np.frombuffer(stream.as_buffer(), "<u2"), kind="stable")
            starts = np.flatnonzero(np.diff(own, prepend=-1 if not len(own) else int(own[0]) - 1))
            yield pa.RecordBatch.from_arrays([pa.array(own[starts].astype(np.int32)), pa.array(np.diff(starts, append=len(own)).astype(np.int64))], names=["bucket", "n"])


def bucket_counts(streams: DataFrame, buckets: int) -> list[int]:
    """Occurrences of each bucket; at most one row a bucket reaches the driver, MAX_BUCKETS in all."""
    runs = streams.select("stream").mapInArrow(_run_lengths, "bucket int, n long")
    counts = [0] * buckets
    for row in runs.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        counts[row["bucket"]] = row["n"]
    return counts


def bucket_gains(source: list[int], target: list[int]) -> np.ndarray:
    """floor(1000 ln(smoothed share in target / smoothed share in source)) of each bucket."""
    k, s_all, t_all = len(source), sum(source), sum(target)
    return np.array([math.floor(1000 * math.log(float(t + 1) * float(s_all + k) / (float(s + 1) * float(t_all + k)))) for s, t in zip(source, target, strict=True)], np.int64)


def _weigh(gains: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, words, sizes, stream = (batch.column(k)[i] for k in range(4))
                sizes = np.asarray(sizes.values)
                weights, some = np.zeros(len(sizes), np.int64), np.flatnonzero(sizes)
                if len(some):  # reduceat knows no empty ranges
                    starts = (np.cumsum(sizes) - sizes)[some]
                    weights[some] = np.add.reduceat(gains[np.frombuffer(stream.as_buffer(), "<u2")], starts)
                yield pa.RecordBatch.from_arrays([ids.values, words.values, pa.array(sizes), pa.array(weights)], names=["doc_id", "n_words", "n_features", "weight"])

    return run


def gumbel_noise(doc_id: Column, seed: str) -> Column:
    """floor(-1000 ln(-ln u)), u from the first 32 bits of sha256 of seed:id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def resample(docs: DataFrame, target: DataFrame, longest: int = 1, buckets: int = 10_000, least_words: int = 20, percent: int = 10, seed: str = "2024", id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_features, weight, score, and rank among the drawn (null for the others).

    Each text is read once. Ranks come from a range shuffle of the scores (five
    numbers a document): a row's place in its range, and the sizes of the ranges
    before, of which there are as many as tasks.
    """
    if not 0 <= percent <= 100:
        raise ValueError("percent must be from 0 to 100")
    with Scratch(docs.sparkSession) as scratch:
        own = scratch.table(feature_streams(docs, id_col, text_col, longest, buckets))
        goal = feature_streams(target.withColumn("_no_id", F.lit(None)), "_no_id", target_text_col, longest, buckets)
        gains = bucket_gains(bucket_counts(own, buckets), bucket_counts(goal, buckets))
        weighed = own.mapInArrow(_weigh(gains), "doc_id long, n_words long, n_features long, weight long")
        scored = weighed.withColumn("score", F.col("weight") + gumbel_noise(F.col("doc_id"), seed)).withColumn("passed", F.col("n_words") < least_words)
        order = [F.col("passed"), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features")]
        placed = scored.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
        ranked = scratch.keep(placed.select("doc_id", "n_features", "weight", "score", "passed", F.shiftright("at", 33).alias("part"), F.col("at").bitwiseAND((1 << 33) - 1).alias("at")))
    sizes = ranked.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(~F.col("passed"), 1)).alias("can"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a task
    offsets = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"), F.sum("can").over(Window.partitionBy()).alias("can"))
    at = F.col("base") + F.col("at") + 1
    drawn = at <= F.floor(F.col("can") * percent / 100)
    return ranked.join(F.broadcast(offsets), "part").select("doc_id", "n_features", "weight", "score", F.when(drawn, at).alias("rank"))


def resample_sql(buckets: int = 10_000, least_words: int = 20, percent: int = 10, seed: str = "2024") -> str:
    """Runs of one word; crc32 is computed for distinct words, byte by byte over its table. rank, which has nulls, is a double, as pandas makes of Spark's long."""
    upper, word = "".join(map(chr, range(65, 91))), r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    found = f"regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '{word}')"
    return f"""
with crc_table as (select list(c order by i) as t from (select i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda a, x: case when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end) as c from range(256) r(i))),
d as (select doc_id, {found} as ws from documents),
b as (select {found} as ws from benchmark),
dw as (select doc_id, unnest(ws) as w from d),
bw as (select unnest(ws) as w from b),
v as (select w, hex(w) as h from (select w from dw union select w from bw)),
c as (select w, (xor(list_reduce(list_concat([4294967295::bigint], list_transform(range(length(h) // 2),
    lambda i: (strpos('0123456789ABCDEF', h[2 * i + 1]) * 16 + strpos('0123456789ABCDEF', h[2 * i + 2]) - 17)::bigint)),
    lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])), 4294967295) % {buckets})::bigint as bucket from v, crc_table),
s as (select bucket, count(*) as n from dw join c using (w) group by 1),
t as (select bucket, count(*) as n from bw join c using (w) group by 1),
g as (select k.bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::double * ((select coalesce(sum(n), 0) from s) + {buckets})::double
    / ((coalesce(s.n, 0) + 1)::double * ((select coalesce(sum(n), 0) from t) + {buckets})::double)))::bigint as gain
  from range({buckets}) k(bucket) left join s using (bucket) left join t using (bucket)),
w as (select doc_id, sum(gain)::bigint as weight from dw join c using (w) join g using (bucket) group by 1),
n as (select d.doc_id, len(ws)::bigint as n_features, coalesce(weight, 0)::bigint as weight,
    ('0x' || substr(sha256('{seed}:' || d.doc_id), 1, 8))::bigint as h from d left join w using (doc_id)),
p as (select *, weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296)))::bigint as score from n),
r as (select doc_id, row_number() over (order by score desc, doc_id) as rank, count(*) over () as can from p where n_features >= {least_words})
select p.doc_id, n_features, weight, score, (case when rank <= floor(can * {percent} / 100) then rank end)::double as rank
from p left join r using (doc_id)"""
