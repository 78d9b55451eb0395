"""Checks of positions and records: what fails is reported beside what passes, never lost silently."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def _with_length(positions: DataFrame, lengths: DataFrame, name: str) -> DataFrame:
    return positions.join(lengths.select(name, F.col("length").alias("_length")), name, "left")


def _inside(i: str) -> Column:
    return F.coalesce((F.col(i) >= 0) & (F.col(i) < F.col("_length")), F.lit(False))


def valid_positions(positions: DataFrame, lengths: DataFrame, name: str = "name", i: str = "i") -> DataFrame:
    """The positions inside their sequence: 0 <= i < length; lengths: (name, length). Those of unknown sequences are invalid."""
    return _with_length(positions, lengths, name).where(_inside(i)).drop("_length")


def invalid_report(positions: DataFrame, lengths: DataFrame, name: str = "name", i: str = "i", first: int = 10) -> DataFrame:
    """(name, n_invalid, examples) of the sequences with positions outside them; examples: the smallest of them, `first` at most."""
    bad = _with_length(positions, lengths, name).where(~_inside(i))
    low = bad.groupBy(name, i).agg(F.count(F.lit(1)).alias("_c"))
    counts = low.groupBy(name).agg(F.sum("_c").alias("n_invalid"), F.count(F.lit(1)).alias("_d"))
    # only what may be an example is gathered: the k-th smallest distinct position bounds it
    cut = low.groupBy(name).agg(F.slice(F.array_sort(F.collect_set(i)), 1, first).alias("examples"))
    return counts.join(cut, name).select(name, "n_invalid", "examples")


def unpadded(df: DataFrame, label: str, padding: tuple[int, ...] = (-1, -100)) -> DataFrame:
    """Rows whose label is known and not a padding mark."""
    return df.where(F.col(label).isNotNull() & ~F.col(label).isin(*padding))


def numbering_checks(sites: DataFrame, sequences: DataFrame, keys: list[str], name: str = "name", i: str = "i", expected: str = "expected", other: str | None = None) -> DataFrame:
    """(keys, total, out_of_range, mismatch, mismatch_other, passed) of annotated sites against their sequences.

    sequences: (name, sequence[, other]). A site within a sequence mismatches
    where its letter there differs from the expected one; sites without an
    expected letter can only be out of range. A second sequence is checked
    likewise where its column is given, and counts 0 where it is not or is null.
    """
    joined = sites.join(sequences.select(name, F.col("sequence").alias("_a"), (F.col(other) if other else F.lit(None).cast("string")).alias("_b")), name, "left")
    inside = lambda s: F.coalesce((F.col(i) >= 0) & (F.col(i) < F.length(s)), F.lit(False))
    differs = lambda s: F.coalesce(inside(s) & (F.substring(F.col(s), F.col(i).cast("int") + 1, F.lit(1)) != F.col(expected)), F.lit(False))
    counted = joined.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(~inside("_a")).alias("out_of_range"), F.count_if(F.col("_b").isNotNull() & ~inside("_b")).alias("out_of_range_other"),
        F.count_if(differs("_a")).alias("mismatch"), F.count_if(differs("_b")).alias("mismatch_other"),
    )
    return counted.withColumn("passed", (F.col("out_of_range") + F.col("out_of_range_other") + F.col("mismatch") + F.col("mismatch_other")) == 0)


def strict_numbering(sites: DataFrame, sequences: DataFrame, name: str = "name", **columns: str) -> DataFrame:
    """The sites of those sequences that pass every numbering check."""
    good = numbering_checks(sites, sequences, [name], name=name, **columns).where("passed").select(name)
    return sites.join(good, name, "left_semi")


def captured(df: DataFrame, key: str, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: StructType) -> DataFrame:
    """The rows that fn makes of each record's rows, with `failed_key` and `error` null; of a record that fails, one row with its key and error.

    A record is the rows of one key (a sequence). Split the result with
    `succeeded` and `failures`; one bad record never ends the job.
    """
    names = [f.name for f in schema.fields]
    full = StructType([*(StructField(f.name, f.dataType) for f in schema.fields), StructField("failed_key", StringType()), StructField("error", StringType())])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        try:
            out = fn(pdf)[names].copy()
            return out.assign(failed_key=None, error=None)
        except Exception as e:  # whatever the record's own code raises is its result
            empty = {n: [None] for n in names}
            return pd.DataFrame(empty | {"failed_key": [str(pdf[key].iat[0])], "error": [f"{type(e).__name__}: {e}"]})

    return df.groupBy(key).applyInPandas(run, full)


def succeeded(rows: DataFrame) -> DataFrame:
    return rows.where("failed_key is null").drop("failed_key", "error")


def failures(rows: DataFrame) -> DataFrame:
    """(failed_key, error)."""
    return rows.where("failed_key is not null").select("failed_key", "error")
