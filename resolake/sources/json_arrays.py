"""Records of JSON arrays, read in splits: a file of one large array is shared by many tasks.

Spark's text reader cuts files at every `{`, in any store and at any split size.
Whether a piece begins inside a string, and how deep, depends on all before it in
its file: each split is scanned once for what it does to either case, the splits
of a file are put in order, and a second scan with the known beginning cuts out
records. Records that cross splits are put together from their pieces.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_MARKS = re.compile(r'\\.|["{}\[\]]', re.DOTALL)


def scan(text: str, in_string: bool, depth: int) -> Iterator[tuple[int, bool, int]]:
    """(place, in_string, depth) after each mark of a text that begins so; depth counts open objects and arrays."""
    for mark in _MARKS.finditer(text):
        c = mark.group()
        if c == '"':
            in_string = not in_string
        elif in_string or len(c) > 1:
            continue
        else:
            depth += 1 if c in "{[" else -1
        yield mark.end(), in_string, depth


def _pieces(batch: pa.RecordBatch) -> Iterator[tuple[tuple[str, int], str]]:
    """((file, split), text) in order, each text with the `{` that it was cut at."""
    for file, split, first, text in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
        yield (file, split), text if first else "{" + text


def _fragments(spark: SparkSession, path: str) -> DataFrame:
    """(file, split, first, value): first marks what comes before a file's first `{`."""
    rows = spark.read.option("lineSep", "{").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = None
        for batch in batches:
            files, splits = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            first = []
            for at in zip(files, splits, strict=True):
                first.append(at != seen and at[1] == 0)
                seen = at
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(first), batch.column(0)], names=["file", "split", "first", "value"])

    return rows.mapInArrow(mark, "file string, split long, first boolean, value string")


def _effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a split does to a beginning outside (0) and inside (1) a string: inside at its end, and change of depth."""
    found: dict = {}
    for batch in batches:
        for at, text in _pieces(batch):
            states = found.setdefault(at, [(False, 0), (True, 0)])
            for k, (in_string, depth) in enumerate(states):
                for _, in_string, depth in scan(text, in_string, depth):  # noqa: B020
                    pass
                states[k] = in_string, depth
    if found:
        files, splits = zip(*found, strict=True)
        columns = [[s[k][p] for s in found.values()] for k in (0, 1) for p in (0, 1)]
        yield pa.RecordBatch.from_arrays([pa.array(files), pa.array(splits), *map(pa.array, columns)], names=["file", "split", "in0", "by0", "in1", "by1"])


def _beginnings(pdf: pd.DataFrame) -> pd.DataFrame:
    """State at the beginning of each split of a file; a row a split."""
    in_string, depth, rows = False, 0, []
    for r in pdf.sort_values("split").itertuples():
        rows.append((r.file, r.split, in_string, depth))
        in_string, depth = (r.in1, depth + r.by1) if in_string else (r.in0, depth + r.by0)
    return pd.DataFrame(rows, columns=["file", "split", "in_string", "depth"])


def _cut(record_depth: int):
    """(file, split, part, text): whole records, part 0; of others what stands at the end of a split (1), before an end (2), or fills a split (3)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, in_string, depth, open_, own = None, False, 0, [], False  # own: the open record began in this split

        def rest() -> list[tuple[str, int, int, str]]:
            return [(*seen, 1 if own else 3, "".join(open_))] if open_ else []

        for batch in batches:
            states = zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)
            out: list[tuple[str, int, int, str]] = []
            for (at, text), state in zip(_pieces(batch), states, strict=True):
                if at != seen:
                    out += rest()
                    seen, (in_string, depth), open_, own = at, state, [], False
                start = 0 if depth > record_depth else None
                for end, in_string, now in scan(text, in_string, depth):
                    if now > depth == record_depth and text[end - 1] == "{":
                        start, own = end - 1, True
                    if now < depth and now == record_depth and start is not None:
                        out.append((*at, 0 if own else 2, "".join(open_) + text[start:end]))
                        start, open_, own = None, [], False
                    depth = now
                if start is not None:
                    open_.append(text[start:])
            if out:
                yield _rows(out)
        if rest():
            yield _rows(rest())

    return run


def _rows(out: list[tuple[str, int, int, str]]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int32(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["file", "split", "part", "text"])


def record_texts(spark: SparkSession, path: str, depth: int = 1) -> DataFrame:
    """(text): the JSON text of each object that stands directly in an array with `depth` brackets and braces open around it.

    depth 1: a file is an array of records; 2: an object with arrays of records.
    Splits follow spark.sql.files.maxPartitionBytes; rows are the same at every
    size. The beginnings, a row a split, are sent to all tasks. A file that ends
    inside a record loses that record.
    """
    fragments = _fragments(spark, path)
    effects = fragments.mapInArrow(_effects, "file string, split long, in0 boolean, by0 long, in1 boolean, by1 long")
    beginnings = effects.groupBy("file").applyInPandas(_beginnings, "file string, split long, in_string boolean, depth long")
    placed = fragments.join(F.broadcast(beginnings), ["file", "split"]).select("file", "split", "first", "value", "in_string", "depth")
    parts = placed.mapInArrow(_cut(depth), "file string, split long, part int, text string")
    whole = parts.where("part = 0").select("text")
    # two pieces a split at most: an end belongs to the last beginning before it
    pieces = parts.where("part > 0").groupBy("file").agg(F.sort_array(F.collect_list(F.struct("split", (-F.col("part")).alias("order"), "part", "text"))).alias("p"))
    return whole.unionByName(pieces.select("p").mapInArrow(_joined, "text string"))


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for pieces in batch.column(0).to_pylist():
            done, open_ = [], []
            for p in pieces:
                if p["part"] == 1:
                    open_ = [p["text"]]
                else:
                    open_.append(p["text"])
                    if p["part"] == 2:
                        done.append("".join(open_))
                        open_ = []
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(done)], names=["text"])


def read_records(spark: SparkSession, path: str, schema: str, depth: int = 1) -> DataFrame:
    return record_texts(spark, path, depth).select(F.from_json("text", schema).alias("r")).select("r.*")


def write_arrays(records: DataFrame, path: str, wrap: str | None = None) -> None:
    """JSON files with one array each (under the name `wrap` in an object, if given), a file a task; a record a line."""
    head, tail = (f'{{"{wrap}": [', "]}") if wrap else ("[", "]")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun = False
        for batch in batches:
            lines = [f",{x}" for x in batch.column(0).to_pylist()]
            if lines and not begun:
                lines[0], begun = head + lines[0][1:], True
            yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], names=["value"])
        if begun:
            yield pa.RecordBatch.from_arrays([pa.array([tail])], names=["value"])

    records.select(F.to_json(F.struct(*records.columns)).alias("value")).mapInArrow(run, "value string").write.text(path)
