"""Operators over the ordered positions of a group: neighbours, ranks, scaling, peaks, running sums.

All take a long table with a group column, an integer position column and a
value, and add columns. Ties in ranks are broken by position, so results don't
depend on the order of rows. Windows are partitioned by group throughout.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .ranking import order_statistics


def _by(name: str, *order: Column | str):
    w = Window.partitionBy(name)
    return w.orderBy(*order) if order else w


def neighbours(df: DataFrame, x: str, k: int = 1, fill=0.0, name: str = "name", i: str = "i") -> DataFrame:
    """prev_1..k and next_1..k of a column, `fill` beyond the ends (or a pair of fills for start and end)."""
    start, end = fill if isinstance(fill, tuple) else (fill, fill)
    w = _by(name, i)
    cols = {f"prev_{n}": F.lag(x, n, start).over(w) for n in range(1, k + 1)} | {f"next_{n}": F.lead(x, n, end).over(w) for n in range(1, k + 1)}
    return df.withColumns(cols)


def relative_position(df: DataFrame, name: str = "name", i: str = "i") -> DataFrame:
    return df.withColumn("rel_pos", F.col(i) / F.count(F.lit(1)).over(_by(name)))


@F.udf(DoubleType())
def _between(low, high, share):
    """low * (1 - share) + high * share with one rounding of the sum, as DuckDB computes it."""
    return None if low is None else math.fma(low, 1 - share, high * share)


def quantile(x: str, share: float, digits: int | None = None) -> Column:
    """Interpolated quantile of a group's non-null values, rounded half up on the value times 10^digits.

    To the last bit that of DuckDB's quantile_cont and round: where a quantile
    lies half-way between two rounded values, F.percentile and F.round (by
    decimal digits) may end on the other side. A group's values are held together.
    """
    values = F.sort_array(F.collect_list(F.col(x).cast("double")))
    at = (F.size(values) - 1) * F.lit(share)
    low, high = F.get(values, F.floor(at).cast("int")), F.get(values, F.ceil(at).cast("int"))
    found = _between(low, high, at - F.floor(at))
    if digits is None:
        return found
    scaled = found * F.lit(10.0**digits)
    down = F.floor(scaled)
    return (down + (scaled - down >= 0.5).cast("int")) / F.lit(10.0**digits)


def percentile_rank(df: DataFrame, x: str, single: float | None = 0.0, name: str = "name", i: str = "i", out: str = "pct_rank") -> DataFrame:
    """100 * rank / (n - 1) without shared ranks; `single` for a group of one."""
    rank = (F.row_number().over(_by(name, F.col(x).asc(), F.col(i).asc())) - 1).cast("double")
    n = F.count(F.lit(1)).over(_by(name))
    return df.withColumn(out, F.when(n > 1, 100 * rank / F.greatest(n - 1, F.lit(1))).otherwise(F.lit(single).cast("double")))


def mid_rank(df: DataFrame, x: str, name: str = "name", out: str = "mid_rank") -> DataFrame:
    """Average rank of ties, from 1."""
    ties = F.count(F.lit(1)).over(Window.partitionBy(name, x))
    return df.withColumn(out, F.rank().over(_by(name, F.col(x).asc())) + (ties - 1) / 2.0)


def scaled_rank(df: DataFrame, x: str, name: str = "name", out: str = "scaled_rank") -> DataFrame:
    """Mid-rank on [0, 1]; 0 for a group of one."""
    n = F.count(F.lit(1)).over(_by(name))
    return mid_rank(df, x, name, "_mid").withColumn(out, F.when(n > 1, (F.col("_mid") - 1) / F.greatest(n - 1, F.lit(1))).otherwise(0.0)).drop("_mid")


def z_score(df: DataFrame, x: str, name: str = "name", out: str = "z") -> DataFrame:
    """(x - mean) / population deviation by group; 0 where the deviation is at most 1e-12."""
    w = _by(name)
    sd = F.stddev_pop(x).over(w)
    return df.withColumn(out, F.when(sd > 1e-12, F.try_divide(F.col(x) - F.avg(x).over(w), sd)).otherwise(0.0))


def min_max(df: DataFrame, x: str, name: str = "name", out: str = "scaled", epsilon: float = 0.0) -> DataFrame:
    """(x - min) / (max - min + epsilon) by group; 0 where the range is at most 1e-12 and epsilon is 0."""
    w = _by(name)
    low = F.min(x).over(w)
    span = F.max(x).over(w) - low
    if epsilon:
        return df.withColumn(out, (F.col(x) - low) / (span + F.lit(epsilon)))
    return df.withColumn(out, F.when(span > 1e-12, F.try_divide(F.col(x) - low, span)).otherwise(0.0))


def quantile_clip(df: DataFrame, x: str, low: float = 0.05, high: float = 0.95, name: str = "name", out: str = "clipped") -> DataFrame:
    """Clip to two interpolated quantiles of the group, then min-max; plain min-max where they coincide."""
    q = df.groupBy(name).agg(F.percentile(x, low).alias("_a"), F.percentile(x, high).alias("_b"), F.min(x).alias("_lo"), F.max(x).alias("_hi"))
    span, full = F.col("_b") - F.col("_a"), F.col("_hi") - F.col("_lo")
    clipped = F.least(F.greatest(F.col(x), F.col("_a")), F.col("_b"))
    value = F.when(span > 1e-12, F.try_divide(clipped - F.col("_a"), span)).when(full > 1e-12, F.try_divide(F.col(x) - F.col("_lo"), full)).otherwise(0.0)
    return df.join(q, name).withColumn(out, value).drop("_a", "_b", "_lo", "_hi")


def quartile_label(df: DataFrame, x: str, name: str | None = None) -> DataFrame:
    """Q1..Q4 against the order statistics at n/4, n/2 and 3n/4 (not interpolated), <= inclusive."""
    keys = [name] if name else []
    cuts = order_statistics(df, x, {f"_q{k}": F.floor(F.col("n") * k / 4) for k in (1, 2, 3)}, keys)
    joined = df.join(cuts, keys, "left") if keys else df.crossJoin(F.broadcast(cuts))  # one row of cuts
    label = F.when(F.col(x) <= F.col("_q1"), "Q1").when(F.col(x) <= F.col("_q2"), "Q2").when(F.col(x) <= F.col("_q3"), "Q3").when(F.col(x).isNotNull(), "Q4")
    return joined.withColumn("quartile", label).drop("_q1", "_q2", "_q3")


def top_percent(df: DataFrame, x: str, percent: float, name: str = "name", out: str = "is_top", digits: int = 9) -> DataFrame:
    """Whether x reaches the group's interpolated (100 - percent) percentile; ties are kept."""
    cut = df.groupBy(name).agg(quantile(x, 1 - percent / 100, digits).alias("_cut"))
    return df.join(cut, name).withColumn(out, F.round(F.col(x), digits) >= F.col("_cut")).drop("_cut")


def index_cutoff(df: DataFrame, x: str, percent: float, name: str = "name", out: str = "is_peak") -> DataFrame:
    """Whether x reaches the group's order statistic at int(n * (1 - percent/100)), not interpolated."""
    w = _by(name)
    ranked = df.withColumn("_r", F.row_number().over(_by(name, x)) - 1).withColumn("_n", F.count(F.lit(1)).over(w))
    at = F.least(F.greatest(F.floor(F.col("_n") * (1 - percent / 100)), F.lit(0)), F.col("_n") - 1)
    cut = F.min(F.when(F.col("_r") == at, F.col(x))).over(w)
    return ranked.withColumn(out, F.col(x) >= cut).drop("_r", "_n")


def local_peaks(df: DataFrame, x: str, keys: list[str], i: str, edges: bool = True, strict_left: bool = False, least: Column | None = None) -> DataFrame:
    """Whether x is at least both neighbours (above the left one if strict); edge positions count only if `edges`."""
    w = Window.partitionBy(*keys).orderBy(i)
    left, right = F.lag(x).over(w), F.lead(x).over(w)
    up = F.col(x) > left if strict_left else F.col(x) >= left
    ok = F.coalesce(up, F.lit(edges)) & F.coalesce(F.col(x) >= right, F.lit(edges))
    return df.withColumn("is_peak", ok & (F.col(x) >= least) if least is not None else ok)


def running_totals(df: DataFrame, label: str, score: str, key: str, name: str = "name") -> DataFrame:
    """True and false positives so far, by falling score."""
    w = _by(name, F.col(score).desc(), F.col(key).asc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("tp", F.sum(label).over(w)).withColumn("fp", F.sum(1 - F.col(label)).over(w))


def context_counts(df: DataFrame, flag: Column, letter: str, half: int = 3, name: str = "name", i: str = "i") -> DataFrame:
    """How often each letter stands within `half` positions of a flagged one (the flagged one included).

    Flagged positions are expanded to their windows and met with positions by
    equality, so that nothing compares all pairs of a group.
    """
    near = df.where(flag).select(name, F.explode(F.sequence(F.col(i) - half, F.col(i) + half)).alias(i))
    return near.join(df.select(name, i, letter), [name, i]).groupBy(letter).agg(F.count(F.lit(1)).alias("n"))


def unit_histogram(df: DataFrame, x: str) -> DataFrame:
    """Counts of x = 1 and of (k, k + 1] for k = 1 .. ceil(max) - 1, empty bins included; smaller values are not counted."""
    bins = df.where(F.col(x) >= 1).groupBy(F.when(F.col(x) == 1, 0).otherwise(F.ceil(x) - 1).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    every = df.agg(F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.max(x)) - 1, F.lit(0)).cast("int"))).alias("bin"))
    return every.join(bins, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def fixed_histogram(df: DataFrame, x: str, width: float, low: float, high: float, keys: list[str] | None = None) -> DataFrame:
    """Counts and density by bins of one width over [low, high]; x is clipped and the last bin is closed."""
    keys = keys or []
    last = int(round((high - low) / width)) - 1
    clipped = F.least(F.greatest(F.col(x), F.lit(low)), F.lit(high))
    bin_no = F.least(F.floor((clipped - low) / width).cast("int"), F.lit(last))
    counts = df.where(F.col(x).isNotNull()).groupBy(*keys, bin_no.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("density", F.col("n") / (F.sum("n").over(Window.partitionBy(*keys)) * F.lit(width)))
