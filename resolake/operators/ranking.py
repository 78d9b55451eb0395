"""Ranks and order statistics over whole tables: value counts first, then running sums by ranges of values.

No task orders all rows: distinct values are cut into ranges at approximate
quantiles, running sums are made inside a range and offset by the ranges before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import Scratch

#: Ranges of values; a group's offsets are a row a range.
RANGES = 64


def _cuts(df: DataFrame, x: str) -> list[float]:
    """Approximate quantiles of a numeric column."""
    shares = [k / RANGES for k in range(1, RANGES)]
    found = df.agg(F.percentile_approx(F.col(x).cast("double"), shares, 1000)).first()[0] or []
    return sorted(set(found))


def _range_of(x: Column, cuts: list[float]) -> Column:
    """Number of the range, by bisection: one comparison for each halving of the cuts."""
    if not cuts:
        return F.lit(0)
    mid = len(cuts) // 2
    below = _range_of(x, cuts[:mid])
    above = _range_of(x, cuts[mid + 1 :]) + F.lit(mid + 1)
    return F.when(x <= F.lit(cuts[mid]), below).otherwise(above)


def running_totals(counts: DataFrame, x: str, columns: list[str], keys: list[str] | None = None) -> DataFrame:
    """counts, which has each x of a group once, with `c`_upto for each column c: its sum over the values up to x, ascending.

    The counts are stored once: cuts, running sums and offsets read them there.
    """
    keys = keys or []
    counts = Scratch(counts.sparkSession).keep(counts)
    placed = counts.withColumn("_range", _range_of(F.col(x).cast("double"), _cuts(counts, x)))
    w = Window.partitionBy(*keys, "_range").orderBy(x).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inner = placed.withColumns({f"{c}_upto": F.sum(c).over(w) for c in columns})
    offsets = placed.groupBy(*keys, "_range").agg(*[F.sum(c).alias(f"_{c}_t") for c in columns])
    v = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    offsets = offsets.select(*keys, "_range", *[F.coalesce(F.sum(f"_{c}_t").over(v), F.lit(0)).alias(f"_{c}_base") for c in columns])
    joined = inner.join(F.broadcast(offsets) if not keys else offsets, [*keys, "_range"])
    return joined.withColumns({f"{c}_upto": F.col(f"{c}_upto") + F.col(f"_{c}_base") for c in columns}).drop("_range", *[f"_{c}_base" for c in columns])


def value_ranks(df: DataFrame, x: str, keys: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """(keys, x, ties, before): how many rows of the group have each distinct non-null value, and how many a smaller one.

    weight: column that says how many rows a row stands for.
    """
    keys = keys or []
    rows = F.count(F.lit(1)) if weight is None else F.sum(weight)
    counts = df.where(F.col(x).isNotNull()).groupBy(*keys, x).agg(rows.alias("ties"))
    return running_totals(counts, x, ["ties"], keys).withColumn("before", F.col("ties_upto") - F.col("ties")).drop("ties_upto")


def mid_rank() -> Column:
    """Average rank, from 1, of the rows with a value."""
    return F.col("before") + (F.col("ties") + 1) / 2.0


def holds(position: Column) -> Column:
    """Whether the row at a position, from 0, has this value."""
    return (F.col("before") <= position) & (position < F.col("before") + F.col("ties"))


def order_statistics(df: DataFrame, x: str, positions: dict[str, Column], keys: list[str] | None = None) -> DataFrame:
    """(keys, a column for each name): the values at positions from 0, as expressions over the group's number of rows `n`."""
    keys = keys or []
    ranks = value_ranks(df, x, keys)
    sizes = ranks.groupBy(*keys).agg(F.sum("ties").alias("n"))
    joined = ranks.join(sizes, keys) if keys else ranks.crossJoin(F.broadcast(sizes))  # one row
    return joined.groupBy(*keys).agg(*[F.max(F.when(holds(p), F.col(x))).alias(name) for name, p in positions.items()])
