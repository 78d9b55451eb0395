"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from resolake.sources.tables import Scratch, shared_dir, table

__all__ = ["Scratch", "shared_dir", "table"]  # and what is defined here


#: A key is hot in a join when it has more rows than so many, and than two fair shares of a task.
HOT_ROWS = 1000


def skew_join(rows: DataFrame, lookup: DataFrame, on: list[str], spread: str, counts: DataFrame | None = None, how: str = "inner") -> DataFrame:
    """Join (inner or left) of rows with lookup, which holds each key once; hot keys of rows are dealt to several tasks.

    A key with more than two fair shares of the rows is salted: its rows by the
    hash of column `spread`, its lookup row by repeating it for each salt. There
    are fewer such keys than half the shuffle partitions, so their list is
    small at any size. Hot keys are found by on[0]; counts: (on[0], n), where
    known already.
    """
    spark, key = rows.sparkSession, on[0]
    if counts is None:
        counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
        total = rows.count()
    else:
        total = counts.agg(F.sum("n")).first()[0] or 0
    fair = max(HOT_ROWS, 2 * total // int(spark.conf.get("spark.sql.shuffle.partitions")))
    hot = counts.where(F.col("n") > fair).select(key, F.ceil(F.col("n") / fair).cast("int").alias("_parts"))
    found = hot.collect() if total > HOT_ROWS else []
    if not found:
        return rows.join(lookup, on, how)
    hot = F.broadcast(spark.createDataFrame(found, hot.schema))
    salted = rows.join(hot, key, "left").withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(spread), F.col("_parts")).cast("int"), F.lit(0))).drop("_parts")
    repeated = lookup.join(hot, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_parts"), F.lit(1)) - 1))).drop("_parts")
    return salted.join(repeated, [*on, "_salt"], how).drop("_salt")


#: Bytes of a batch on its way to Python that suit small executors: the JVM and both workers hold several at once.
BATCH_BYTES = 8 << 20


def tune_session(spark: SparkSession) -> None:
    """For applications, before they call operators: Arrow batches of at most BATCH_BYTES. Operators leave settings as they are."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    size = re.fullmatch(r"(\d+)b?", spark.conf.get(key) or "")
    if not size or int(size[1]) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def free_name(df: DataFrame, name: str) -> str:
    """The name, with underscores after it until no column has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def quoted(name: str) -> str:
    """A column name of any form, for F.col."""
    return "`" + name.replace("`", "``") + "`"


def list_array(values: np.ndarray, lengths: np.ndarray) -> pa.ListArray:
    """A list array over flat values; no per-row Python objects."""
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values))


def vector_matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column, all of length dim and without nulls, as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten()).reshape(-1, dim)


def is_usable(v: Column) -> Column:
    """Whether a vector can be compared: not null, no null or non-finite component, not zero."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return v.isNotNull() & F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False))


def usable_vectors(vectors: DataFrame, id_col: str, vec_col: str, *more: Column) -> DataFrame:
    """(vec_id, v, more ...) of the vectors that can be compared and have an id."""
    rows = vectors.select(F.col(quoted(id_col)).cast("long").alias("vec_id"), F.col(quoted(vec_col)).alias("v"), *more)
    return rows.where(F.col("vec_id").isNotNull() & is_usable(F.col("v")))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (murmur-style finaliser)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(33))
