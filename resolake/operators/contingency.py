"""Counts, enrichment and classification reports over two categories."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def counts(df: DataFrame, *keys: str, out: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(out))


def fractions(df: DataFrame, *keys: str) -> DataFrame:
    """Group counts and their share of all rows."""
    n = counts(df, *keys)
    return n.withColumn("fraction", F.col("n") / F.sum("n").over(Window.partitionBy()))


def contingency(df: DataFrame, row: str, col: str, cols: list[str]) -> DataFrame:
    """Long table of counts over all rows seen and the given column labels, zeros included."""
    wide = df.groupBy(row).pivot(col, cols).agg(F.count(F.lit(1)))
    return wide.unpivot([row], cols, col, "n").withColumn("n", F.coalesce("n", F.lit(0)))


def row_percent(table: DataFrame, row: str, n: str = "n") -> DataFrame:
    total = F.sum(n).over(Window.partitionBy(row))
    return table.withColumn("percent", F.coalesce(F.try_divide(100.0 * F.col(n), total), F.lit(0.0)))


def independence_enrichment(table: DataFrame, row: str, col: str, n: str = "n") -> DataFrame:
    """Observed over expected under independence; null where nothing is expected."""
    total = lambda *k: F.sum(n).over(Window.partitionBy(*k))
    expected = total(row) * total(col) / F.nullif(total(), F.lit(0))
    return table.withColumn("expected", expected).withColumn("enrichment", F.try_divide(F.col(n).cast("double"), F.col("expected")))


def background_enrichment(df: DataFrame, category: str, label: str, background: str) -> DataFrame:
    """P(label | category) / P(label | background category); null where the latter is at most 1e-9."""
    n = counts(df, category, label)
    p = n.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy(category)))
    base = p.where(F.col(category) == background).select(label, F.col("p").alias("p_background"))
    return p.join(base, label, "left").withColumn("enrichment", F.when(F.col("p_background") > 1e-9, F.try_divide(F.col("p"), F.col("p_background"))))


def overall_enrichment(df: DataFrame, category: str, label: str, epsilon: float = 1e-9) -> DataFrame:
    """Share in the category over share overall, with the small addends that keep denominators above 0."""
    n = counts(df, category, label)
    total = lambda *k: F.sum("n").over(Window.partitionBy(*k))
    own, base = F.col("n") / (total(category) + F.lit(epsilon)), total(label) / (total() + F.lit(epsilon))
    return n.withColumn("observed", own).withColumn("background", base).withColumn("enrichment", own / (base + F.lit(epsilon)))


def chi_square(table: DataFrame, row: str, col: str, n_rows: int, n_cols: int, n: str = "n") -> DataFrame:
    """One row: the statistic over cells with an expectation, nominal and effective degrees of freedom."""
    e = independence_enrichment(table, row, col, n)
    stat = F.sum(F.when(F.col("expected") > 0, F.try_divide(F.pow(F.col(n) - F.col("expected"), F.lit(2)), F.col("expected"))))
    used = (F.countDistinct(F.when(F.col(n) > 0, F.col(row))) - 1) * (F.countDistinct(F.when(F.col(n) > 0, F.col(col))) - 1)
    return e.agg(stat.alias("chi2"), F.lit((n_rows - 1) * (n_cols - 1)).alias("df"), used.alias("df_effective"))


def confusion(df: DataFrame, true: str, pred: str) -> DataFrame:
    return df.groupBy(F.col(true).alias("true"), F.col(pred).alias("pred")).agg(F.count(F.lit(1)).alias("n"))


def confusion_wide(df: DataFrame, true: str, pred: str, classes: list) -> DataFrame:
    """One row with a column cm_true_i_pred_j for every pair of classes."""
    return df.agg(*[F.count_if((F.col(true) == F.lit(a)) & (F.col(pred) == F.lit(b))).alias(f"cm_true_{a}_pred_{b}") for a in classes for b in classes])


def class_report(df: DataFrame, true: str, pred: str, null_f1: bool = False) -> DataFrame:
    """precision, recall, f1 and support by class; f1 without any true or predicted hit is 0, or null if `null_f1`."""
    cm = confusion(df, true, pred)
    sides = cm.select(F.explode(F.array(F.struct(F.col("true").alias("c"), F.lit("t").alias("side")), F.struct(F.col("pred").alias("c"), F.lit("p").alias("side")))).alias("x"), "n", (F.col("true") == F.col("pred")).alias("hit"))
    side = lambda s: F.sum(F.when(F.col("x.side") == s, F.col("n")).otherwise(0))
    by = sides.groupBy(F.col("x.c").alias("class")).agg(side("t").alias("support"), side("p").alias("predicted"), F.sum(F.when(F.col("hit") & (F.col("x.side") == "t"), F.col("n")).otherwise(0)).alias("tp"))
    p, r = F.coalesce(F.try_divide(F.col("tp"), F.col("predicted")), F.lit(0.0)), F.coalesce(F.try_divide(F.col("tp"), F.col("support")), F.lit(0.0))
    f1 = F.try_divide(2.0 * F.col("tp"), F.col("support") + F.col("predicted"))
    f1 = F.when(F.col("tp") > 0, f1) if null_f1 else F.coalesce(f1, F.lit(0.0))
    return by.select("class", p.alias("precision"), r.alias("recall"), f1.alias("f1"), "support", "tp")


def report_summary(report: DataFrame) -> DataFrame:
    """accuracy, macro and support-weighted means of a class report."""
    weighted = lambda c: (F.sum(F.col(c) * F.col("support")) / F.sum("support")).alias(f"weighted_{c}")
    return report.agg((F.sum("tp") / F.sum("support")).alias("accuracy"), *[F.avg(c).alias(f"macro_{c}") for c in ("precision", "recall", "f1")], *[weighted(c) for c in ("precision", "recall", "f1")])


def with_all_bucket(df: DataFrame, bucket: str, key: str, *aggs: Column) -> DataFrame:
    """Aggregates by (bucket, key) and by key over all buckets, the latter as bucket ALL, in one pass."""
    rolled = df.groupingSets([[F.col(bucket), F.col(key)], [F.col(key)]], F.col(bucket), F.col(key)).agg(F.grouping(bucket).alias("_all"), *aggs)
    return rolled.withColumn(bucket, F.when(F.col("_all") == 1, "ALL").otherwise(F.col(bucket))).drop("_all")


def agreement(a: DataFrame, b: DataFrame, label: str, keys: list[str], by_label: bool = False) -> DataFrame:
    """Share of aligned positions (an inner join) with equal labels, over all or for each label of the first."""
    both = a.select(*keys, F.col(label).alias("la")).join(b.select(*keys, F.col(label).alias("lb")), keys)
    same = F.avg((F.col("la") == F.col("lb")).cast("double")).alias("agreement")
    return both.groupBy(F.col("la").alias(label)).agg(same, F.count(F.lit(1)).alias("n")) if by_label else both.agg(same, F.count(F.lit(1)).alias("n"))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Balanced weight n / (K * n_c) and inverse square root weight by class."""
    n = counts(df, label)
    everything = Window.partitionBy()
    return n.withColumn("balanced", F.sum("n").over(everything) / (F.count(F.lit(1)).over(everything) * F.col("n"))).withColumn("inverse_sqrt", 1 / F.sqrt(F.greatest(F.col("n"), F.lit(1)).cast("double")))


def majority_baseline(train: DataFrame, test: DataFrame, label: str) -> DataFrame:
    """The commonest training class (the smallest of ties) and its accuracy on the test rows."""
    top = counts(train, label).orderBy(F.desc("n"), label).limit(1).select(F.col(label).alias("majority"))
    return test.crossJoin(F.broadcast(top)).groupBy("majority").agg(F.avg((F.col(label) == F.col("majority")).cast("double")).alias("accuracy"))


def pair_symmetry(pairs: DataFrame, a: str, b: str, w: str) -> DataFrame:
    """(M + M transposed) / 2, over its maximum."""
    both = pairs.select(a, b, w).union(pairs.select(F.col(b), F.col(a), w))
    half = both.groupBy(a, b).agg((F.sum(w) / 2).alias("w"))
    return half.withColumn("scaled", F.try_divide(F.col("w"), F.max("w").over(Window.partitionBy())))


def keyed_union(parts: list[DataFrame]) -> DataFrame:
    """Runs with differing columns under one another, missing ones null."""
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts)


def sequence_sampling_weights(df: DataFrame, label: str, name: str = "name", intensity: float = 0.5, floor: float = 0.001) -> DataFrame:
    """Weights by group that sum to the number of groups.

    Minority classes have fewer positions than the median class. A group all of
    minority classes weighs 1, one without any `floor`, others `intensity`.
    """
    n = counts(df, label)
    median = n.agg(F.median("n").alias("m"))
    minor = n.crossJoin(F.broadcast(median)).where(F.col("n") < F.col("m")).select(label, F.lit(1).alias("minor"))
    share = df.join(F.broadcast(minor), label, "left").groupBy(name).agg(F.avg(F.coalesce("minor", F.lit(0)).cast("double")).alias("share"))
    raw = F.when(F.col("share") == 0, floor).when(F.col("share") < 1, intensity).otherwise(1.0)
    weighed = share.withColumn("raw", raw)
    total = weighed.agg(F.sum("raw").alias("_sum"), F.count(F.lit(1)).alias("_n"))  # one row
    return weighed.crossJoin(F.broadcast(total)).withColumn("weight", F.col("raw") / F.col("_sum") * F.col("_n")).drop("_sum", "_n")
