"""Rank statistics and evaluation of scores, as windows and aggregates."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import mid_rank, order_statistics, running_totals, value_ranks


def pearson(df: DataFrame, x: str, y: str, keys: list[str] | None = None, least: int = 2) -> DataFrame:
    """r and n by group over rows with both values, in one aggregate; r is null below `least` rows or where a side is constant."""
    known = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    varies = (F.max(x) > F.min(x)) & (F.max(y) > F.min(y)) & (F.count(F.lit(1)) >= least)
    r = F.try_divide(F.covar_pop(x, y), F.sqrt(F.var_pop(x) * F.var_pop(y)))  # corr divides by zero in groups that don't vary
    return known.groupBy(*(keys or [])).agg(F.count(F.lit(1)).alias("n"), F.when(varies, r).alias("r"))


def spearman(df: DataFrame, x: str, y: str, keys: list[str], least: int = 5) -> DataFrame:
    """Correlation of mid-ranks by group."""
    known = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    w = Window.partitionBy(*keys)
    mid = lambda c: F.rank().over(w.orderBy(c)) + (F.count(F.lit(1)).over(Window.partitionBy(*keys, c)) - 1) / 2.0
    return pearson(known.withColumn("_rx", mid(x)).withColumn("_ry", mid(y)), "_rx", "_ry", keys, least)


def _weighted_inversions(y: np.ndarray, w: np.ndarray) -> float:
    """Sum of w[i] w[j] over the places i < j with y[i] > y[j], by a merge sort whose merges of one width are counted together."""
    _, y = np.unique(y, return_inverse=True)
    total, width, n = 0.0, 1, len(y)
    top = int(y.max(initial=0)) + 1
    while width < n:
        pair = np.arange(n) // (2 * width)
        left = (np.arange(n) // width) % 2 == 0
        keys = pair * top + y  # the lefts of a pair of runs lie together, in order, as the runs are sorted
        upto = np.concatenate([[0.0], np.cumsum(w[left])])
        greater = upto[np.searchsorted(keys[left], (pair[~left] + 1) * top)] - upto[np.searchsorted(keys[left], keys[~left], side="right")]
        total += float(greater @ w[~left])
        order = np.argsort(keys, kind="stable")
        y, w, width = y[order], w[order], 2 * width
    return total


def _pairs(n: np.ndarray) -> float:
    return float((n * (n - 1) / 2).sum())


def kendall_tau_b(df: DataFrame, x: str, y: str, keys: list[str] | None = None) -> DataFrame:
    """(C - D) / sqrt((n0 - n1)(n0 - n2)) of the rows of each group that have both values; null where a side is constant, no row below two rows.

    Knight's method: rows in order of x, then y; the discordant pairs are the
    inversions of y. Equal rows are counted first, so a task holds a group's
    distinct pairs of values, 24 bytes each, and takes n log n steps.
    """
    keys = keys or []
    known = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    counts = known.groupBy(*keys, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")).agg(F.count(F.lit(1)).alias("_n"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b, n = (pdf[c].to_numpy(float) for c in ("_x", "_y", "_n"))
        if n.sum() < 2:
            return pdf.iloc[:0][keys].assign(tau_b=[])
        order = np.lexsort((b, a))
        a, b, n = a[order], b[order], n[order]
        ties = lambda v: _pairs(np.bincount(np.unique(v, return_inverse=True)[1], weights=n))
        every, same_x, same_y = _pairs(n.sum(keepdims=True)), ties(a), ties(b)
        discordant = _weighted_inversions(b, n)
        spread = np.sqrt((every - same_x) * (every - same_y))
        tau = (every - same_x - same_y + _pairs(n) - 2 * discordant) / spread if spread > 0 else None
        return pdf.iloc[:1][keys].assign(tau_b=tau)

    fields = ", ".join([*[f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys], "tau_b double"])
    return counts.groupBy(*keys).applyInPandas(run, fields)


def _score_counts(df: DataFrame, score: str, label: str, keys: list[str]) -> DataFrame:
    """(keys, threshold, _p, _q, _p_upto, _q_upto): positives and negatives at each distinct score, and up to it."""
    known = df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    by = known.groupBy(*keys, F.col(score).alias("threshold")).agg(F.sum(F.col(label).cast("long")).alias("_p"), F.count(F.lit(1)).alias("_n"))
    return running_totals(by.select(*keys, "threshold", "_p", (F.col("_n") - F.col("_p")).alias("_q")), "threshold", ["_p", "_q"], keys)


def _totals(counts: DataFrame, keys: list[str], *more: Column) -> DataFrame:
    return counts.groupBy(*keys).agg(F.sum("_p").alias("n_pos"), F.sum("_q").alias("n_neg"), *more)


def roc_auc(df: DataFrame, score: str, label: str, keys: list[str] | None = None) -> DataFrame:
    """Tie-aware area under the ROC curve, from counts of each distinct score; null with one class."""
    keys = keys or []
    below = (F.col("_q_upto") - F.col("_q") / 2.0) * F.col("_p")  # negatives under the positives, half of those beside them
    agg = _totals(_score_counts(df, score, label, keys), keys, F.sum(below).alias("_s"))
    return agg.withColumn("auc", F.try_divide(F.col("_s"), F.col("n_pos").cast("double") * F.col("n_neg"))).drop("_s")


def curve_points(df: DataFrame, score: str, label: str, keys: list[str] | None = None) -> DataFrame:
    """At each distinct score as threshold: tp, fp, tpr, fpr, precision, recall, and tpr and fpr of the next higher score.

    Scores are grouped first, and summed by ranges of scores, so no task orders all of them.
    """
    keys = keys or []
    counts = _score_counts(df, score, label, keys)
    totals = _totals(counts, keys)
    c = counts.join(totals, keys) if keys else counts.crossJoin(F.broadcast(totals))  # one row
    before = {"tp": F.col("n_pos") - F.col("_p_upto"), "fp": F.col("n_neg") - F.col("_q_upto")}
    c = c.withColumns({"tp": before["tp"] + F.col("_p"), "fp": before["fp"] + F.col("_q")})
    c = c.withColumns({"tpr": F.try_divide("tp", "n_pos"), "fpr": F.try_divide("fp", "n_neg"), "tpr_before": F.try_divide(before["tp"], F.col("n_pos")), "fpr_before": F.try_divide(before["fp"], F.col("n_neg"))})
    return c.withColumn("precision", F.col("tp") / (F.col("tp") + F.col("fp"))).withColumn("recall", F.col("tpr")).drop("_p", "_q", "_p_upto", "_q_upto", "n_pos", "n_neg")


def trapezoid_auc(points: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Area under curve points by trapezoids from (0, 0)."""
    step = (F.col("fpr") - F.col("fpr_before")) * (F.col("tpr") + F.col("tpr_before")) / 2
    return points.groupBy(*(keys or [])).agg(F.sum(step).alias("auc"))


def average_precision(points: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Sum of recall steps times precision over distinct scores; null without positives."""
    return points.groupBy(*(keys or [])).agg(F.sum((F.col("recall") - F.col("tpr_before")) * F.col("precision")).alias("ap"))


def youden(points: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The threshold of largest tpr - fpr, the highest of ties."""
    keys = keys or []
    j = F.round(F.col("tpr") - F.col("fpr"), 12)
    best = points.where(j.isNotNull()).groupBy(*keys).agg(F.max(F.struct(j.alias("j"), F.col("threshold"))).alias("b"))
    return best.select(*keys, F.col("b.threshold").alias("threshold"), F.col("b.j").alias("j"))


def f1_mcc(df: DataFrame, predicted: Column, label: str, keys: list[str] | None = None) -> DataFrame:
    """F1 and Matthews correlation of a 0/1 prediction; 0 where undefined."""
    keys = keys or []
    y, p = F.col(label) == 1, predicted
    cells = df.groupBy(*keys).agg(*[F.count_if(c).cast("double").alias(n) for n, c in (("tp", y & p), ("fp", ~y & p), ("fn", y & ~p), ("tn", ~y & ~p))])
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    mcc = F.try_divide(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)))
    return cells.withColumn("f1", F.coalesce(F.try_divide(2 * tp, 2 * tp + fp + fn), F.lit(0.0))).withColumn("mcc", F.coalesce(mcc, F.lit(0.0)))


def evaluate_methods(wide: DataFrame, methods: list[str], label: str, name: str, least: int = 5) -> DataFrame:
    """AUC by method and group, null with one class or fewer than `least` rows that have a score."""
    long = wide.unpivot([name, label], methods, "method", "score").where("score is not null")
    auc = roc_auc(long, "score", label, ["method", name])
    return auc.withColumn("n", F.col("n_pos") + F.col("n_neg")).withColumn("auc", F.when(F.col("n") >= least, F.col("auc")))


def hub_overlap(df: DataFrame, hub: str, marked: str, keys: list[str]) -> DataFrame:
    """2 x 2 counts of hubs against marked positions, odds ratio and fold enrichment by group (null where undefined)."""
    h, m = F.col(hub), F.col(marked)
    t = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("length"), F.count_if(h).alias("n_hub"), F.count_if(m).alias("n_marked"), F.count_if(h & m).alias("overlap"))
    b, c = F.col("n_hub") - F.col("overlap"), F.col("n_marked") - F.col("overlap")
    d = F.col("length") - F.col("n_hub") - c
    t = t.withColumn("odds_ratio", F.try_divide(F.col("overlap") * d, b * c).cast("double"))
    return t.withColumn("expected", F.col("n_hub") * F.col("n_marked") / F.col("length")).withColumn("fold_enrichment", F.try_divide(F.col("overlap").cast("double"), F.col("expected")))


def kruskal_wallis(df: DataFrame, x: str, group: str, keys: list[str] | None = None, least: int = 5) -> DataFrame:
    """Tie-corrected H, k, n and eta squared over groups of at least that many rows; nulls with fewer than two.

    Rows are counted by group and value first; ranks are those of the values.
    """
    keys = keys or []
    by_value = df.where(F.col(x).isNotNull() & F.col(group).isNotNull()).groupBy(*keys, group, x).agg(F.count(F.lit(1)).alias("_w"))
    sizes = by_value.groupBy(*keys, group).agg(F.sum("_w").alias("_g")).where(F.col("_g") >= least)
    known = by_value.join(sizes.drop("_g"), [*keys, group])
    ranks = value_ranks(known, x, keys, weight="_w")
    by = known.join(ranks, [*keys, x]).groupBy(*keys, group).agg(F.sum("_w").cast("double").alias("_n"), (F.sum(F.col("_w") * mid_rank()) / F.sum("_w")).alias("_m"))
    t = F.col("ties").cast("double")
    ties = ranks.groupBy(*keys).agg(F.sum(t * (t * t - 1)).alias("_c"), F.sum("ties").cast("double").alias("_all"))
    by = by.join(ties, keys) if keys else by.crossJoin(F.broadcast(ties))  # one row
    h = by.groupBy(*keys).agg(F.max("_all").cast("long").alias("n"), F.count(F.lit(1)).alias("k"), F.sum(F.col("_n") * F.pow(F.col("_m") - (F.col("_all") + 1) / 2, F.lit(2))).alias("_s"), F.max("_c").alias("_c"))
    n = F.col("n").cast("double")
    value = F.try_divide(12 * F.col("_s") / (n * (n + 1)), 1 - F.col("_c") / (n * n * n - n))
    h = h.withColumn("h", F.when(F.col("k") >= 2, value))
    return h.withColumn("eta2", F.when(F.col("n") > F.col("k"), F.try_divide(F.col("h") - F.col("k") + 1, n - F.col("k")))).drop("_s", "_c")


def wilcoxon(df: DataFrame, delta: str, keys: list[str] | None = None, least: int = 11) -> DataFrame:
    """Signed-rank sums of the non-zero differences, the median difference of all rows, and the normal z of W+."""
    keys = keys or []
    known = df.where(F.col(delta).isNotNull())
    every = known.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    middle = order_statistics(known, delta, {"_lo": F.floor((F.col("n") - 1) / 2), "_hi": F.ceil((F.col("n") - 1) / 2)}, keys)
    both = lambda a, b: a.join(b, keys, "left") if keys else a.join(b, F.lit(True), "left")  # noqa: E731  (one row each without keys)
    d = known.where(F.col(delta) != 0).groupBy(*keys, F.abs(F.col(delta)).alias("_a"), (F.col(delta) > 0).alias("_up")).agg(F.count(F.lit(1)).alias("_w"))
    ranks = value_ranks(d, "_a", keys, weight="_w")
    s = d.join(ranks, [*keys, "_a"]).groupBy(*keys).agg(F.sum("_w").alias("m"), F.sum(F.when(F.col("_up"), F.col("_w") * mid_rank()).otherwise(0.0)).alias("w_plus"))
    t = F.col("ties").cast("double")
    s = both(s, ranks.groupBy(*keys).agg(F.sum(t * (t * t - 1)).alias("_c")))
    m = F.col("m").cast("double")
    s = s.withColumn("z", F.try_divide(F.col("w_plus") - m * (m + 1) / 4, F.sqrt(m * (m + 1) * (2 * m + 1) / 24 - F.col("_c") / 48))).drop("_c")
    joined = both(both(every, middle), s).withColumn("median", (F.col("_lo") + F.col("_hi")) / 2)
    enough = F.col("n") >= least
    return joined.select(*keys, "n", "median", F.when(enough, F.col("w_plus")).alias("w_plus"), F.when(enough, F.col("z")).alias("z"))


def regression_metrics(df: DataFrame, y: str, p: str, keys: list[str] | None = None) -> DataFrame:
    """mse, rmse, mae, r2 and n; r2 is null where y is constant."""
    keys = keys or []
    e = F.col(y) - F.col(p)
    m = df.where(F.col(y).isNotNull() & F.col(p).isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), F.var_pop(y).alias("_v"))
    return m.withColumn("rmse", F.sqrt("mse")).withColumn("r2", 1 - F.try_divide(F.col("mse"), F.nullif(F.col("_v"), F.lit(0.0)))).drop("_v")


def linear_trend(df: DataFrame, y: str, x: str, keys: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(keys or [])).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))


def qq_points(df: DataFrame, x: str, key: str) -> DataFrame:
    """Ordered values, ties by key, against normal quantiles at (rank - 0.5) / n; only rows of one value are ordered together."""
    from ..functions.pvalues import normal_ppf

    ranks = value_ranks(df, x)
    n = F.broadcast(ranks.agg(F.sum("ties").alias("_n")))  # one row
    within = F.row_number().over(Window.partitionBy(x).orderBy(key))
    ranked = df.where(F.col(x).isNotNull()).select(key, x).join(ranks, x).withColumn("r", (F.col("before") + within).cast("int"))
    placed = ranked.crossJoin(n).withColumn("p", (F.col("r") - 0.5) / F.col("_n"))
    return placed.withColumn("theoretical", normal_ppf("p")).select(key, x, "r", "p", "theoretical")


def summary(x: str) -> list[Column]:
    """count, min, max, mean, median, both deviations and quartiles, as aggregate columns."""
    q = lambda p: F.percentile(x, p)
    return [F.count(x).alias("n"), F.min(x).alias("min"), F.max(x).alias("max"), F.avg(x).alias("mean"), q(0.5).alias("median"), F.stddev_pop(x).alias("std_pop"), F.stddev_samp(x).alias("std"), q(0.25).alias("q25"), q(0.75).alias("q75")]


