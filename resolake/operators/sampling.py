"""Reproducible samples and leak-free splits: random order is the md5 of a key and a seed, the same on every run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import hashed_order


def sample_rows(df: DataFrame, n: int, *keys: str, seed: int = 42) -> DataFrame:
    """n rows without replacement; ties in the hash by key."""
    return df.orderBy(hashed_order(*[F.col(k) for k in keys], seed=seed), *keys).limit(n)


def group_split(df: DataFrame, group: Column, test_share: float = 0.2, seed: int = 42) -> DataFrame:
    """Rows with split train or test; int(groups * share) groups go to test whole, so no group is on both sides."""
    keyed = df.withColumn("_group", group)
    groups = keyed.select("_group").distinct()
    n = groups.count()
    test = groups.orderBy(hashed_order(F.col("_group"), seed=seed), "_group").limit(int(n * test_share))
    marked = keyed.join(test.withColumn("_test", F.lit(True)), "_group", "left")
    return marked.withColumn("split", F.when(F.col("_test"), "test").otherwise("train")).drop("_test", "_group")


def row_split(df: DataFrame, *keys: str, valid_share: float = 0.2, seed: int = 42) -> DataFrame:
    """Rows with split by their own hash: each goes to valid with that chance, whatever other rows there are."""
    h = F.conv(F.substring(hashed_order(*[F.col(k) for k in keys], seed=seed), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    return df.withColumn("split", F.when(h < valid_share, "valid").otherwise("train"))


def shuffled_within(df: DataFrame, x: str, name: str = "name", i: str = "i", seed: int = 42) -> DataFrame:
    """x permuted among the positions of each sequence (a null model)."""
    w = Window.partitionBy(name)
    at = df.withColumn("_to", F.row_number().over(w.orderBy(i)))
    of = df.select(name, F.col(x).alias(f"{x}_shuffled"), F.row_number().over(w.orderBy(hashed_order(F.col(name), F.col(i), seed=seed), i)).alias("_to"))
    return at.join(of, [name, "_to"]).drop("_to")


def weighted_sample(df: DataFrame, weight: str, key: str, n: int, seed: int = 42) -> DataFrame:
    """n draws with replacement, chances in proportion to weight: uniforms looked up in the running sum.

    The running sum is made per hash bucket of keys, then offset by the buckets'
    totals, so no task orders all rows. Draws and the keys' intervals meet by
    equality on cells of the unit interval, as many as there are draws: keys and
    cells together bound what is joined.
    """
    buckets = max(64, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    b = df.where(F.col(weight) > 0).select(key, F.col(weight).cast("double").alias("_w"), F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int").alias("_b"))
    w = Window.partitionBy("_b").orderBy(key).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = b.groupBy("_b").agg(F.sum("_w").alias("_t"))
    rising = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # a row a bucket
    totals = totals.withColumn("_base", F.sum("_t").over(rising) - F.col("_t")).withColumn("_all", F.sum("_t").over(Window.partitionBy()))
    placed = b.withColumn("_in", F.sum("_w").over(w)).join(F.broadcast(totals), "_b")
    high = (F.col("_base") + F.col("_in")) / F.col("_all")
    ranges = placed.select(key, (F.col("_base") + F.col("_in") - F.col("_w")).alias("_lo0"), "_all", high.alias("_hi")).withColumn("_lo", F.col("_lo0") / F.col("_all"))
    cell = lambda c: F.least(F.floor(c * n), F.lit(max(n - 1, 0))).cast("long")
    ranges = ranges.select(key, "_lo", "_hi", F.explode(F.sequence(cell(F.col("_lo")), cell(F.col("_hi")))).alias("_cell"))
    u = F.conv(F.substring(hashed_order(F.col("id"), seed=seed), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))
    draws = df.sparkSession.range(n).select(F.col("id").alias("draw"), u.alias("_u")).withColumn("_cell", cell(F.col("_u")))
    hit = draws.join(ranges, "_cell").where((F.col("_u") >= F.col("_lo")) & (F.col("_u") < F.col("_hi")))
    # neighbouring buckets' bounds can differ in the last bit: of two keys at a seam the smaller counts
    return hit.groupBy("draw").agg(F.min(key).alias(key))
