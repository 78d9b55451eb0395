"""Attention (or similarity, or contact) matrices as long tables (name, i, j, w), and the graphs cut from them.

A matrix belongs to one sequence, so all work is keyed by the sequence's name
and position; a sequence's length bounds the rows of a key. Self joins are by
name and so shuffle each side once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .positions import quantile


#: Query positions of a sequence that a task takes together.
ROWS = 64


def similarity_attention(vectors: DataFrame, dim: int, name: str = "name", i: str = "i", v: str = "v", digits: int = 9) -> DataFrame:
    """Cosine of all position pairs of a sequence, shifted to [0, 1] and made to sum to 1 by row.

    A group is ROWS positions of a sequence with all its vectors, which are few
    bytes; their rows of the matrix are made whole there, so that cells are
    neither shuffled nor sorted. Weights round half up on the value times 10^digits.
    Zero vectors and those without `dim` components take no part.
    """
    kinds = vectors.select(name, i).schema
    own = vectors.select(F.col(name).alias("name"), F.col(i).alias("i"), F.transform(v, lambda x: x.cast("double")).alias("v")).where(F.col("name").isNotNull())
    own = own.where((F.size("v") == dim) & (F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x) > 0)).withColumn("block", F.floor(F.col("i") / ROWS))
    blocks = own.select(F.col("name").alias("_name"), F.col("block").alias("_block")).distinct()
    keys = own.select(F.col("name").alias("_name"), F.col("i").alias("j"), F.col("v").alias("_v")).join(blocks, "_name")

    def run(queries: pa.Table, keys: pa.Table) -> pa.Table:
        unit = [np.asarray(c.combine_chunks().flatten()).reshape(-1, dim) for c in (queries.column("v"), keys.column("_v"))]
        a, b = (x / np.sqrt((x * x).sum(1, keepdims=True)) for x in unit)
        s = (a @ b.T + 1) / 2
        _, row = np.unique(np.asarray(queries.column("i")), return_inverse=True)  # rows of one number sum together
        w = np.floor(s / np.bincount(row, s.sum(1))[row][:, None] * 10.0**digits + 0.5) / 10.0**digits
        each = pa.array(np.repeat(np.arange(len(a)), len(b)))
        cells = [queries.column("name").take(each), queries.column("i").take(each), keys.column("j").take(pa.array(np.tile(np.arange(len(b)), len(a)))), pa.array(w.ravel())]
        return pa.Table.from_arrays(cells, names=[name, i, "j", "w"])

    schema = StructType([kinds[name], kinds[i], StructField("j", kinds[i].dataType), StructField("w", DoubleType())])
    return own.groupBy("name", "block").cogroup(keys.groupBy("_name", "_block")).applyInArrow(run, schema)


def explode_matrix(records: DataFrame, matrix: str = "attention_weights", name: str = "name") -> DataFrame:
    """(name, i, j, w) of records that hold a square nested matrix; others are dropped."""
    n = F.size(matrix)
    square = records.where((n > 0) & F.forall(matrix, lambda r: F.size(r) == n))
    rows = square.select(name, F.posexplode(matrix).alias("i", "_row"))
    return rows.select(name, "i", F.posexplode("_row").alias("j", "w")).withColumn("w", F.col("w").cast("double"))


def row_normalised(attn: DataFrame) -> DataFrame:
    """Rows over their sums; rows that sum to 0 stay."""
    total = F.sum("w").over(Window.partitionBy("name", "i"))
    return attn.withColumn("w", F.when(total == 0, F.col("w")).otherwise(F.try_divide(F.col("w"), total)))


def head_mean(tensor: DataFrame, specials: Column) -> DataFrame:
    """Mean over heads of (name, head, i, j, w), without the special tokens' rows and columns, rows normalised again."""
    return row_normalised(tensor.where(~specials).groupBy("name", "i", "j").agg(F.avg("w").alias("w")))


def by_key_position(attn: DataFrame) -> DataFrame:
    """(name, i, max_in, sum_in, max_received, sum_received): attention received with and without the position's own, in one pass."""
    other = F.when(F.col("i") != F.col("j"), F.col("w"))
    return attn.groupBy("name", F.col("j").alias("i")).agg(F.max("w").alias("max_in"), F.sum("w").alias("sum_in"), F.coalesce(F.max(other), F.lit(0.0)).alias("max_received"), F.coalesce(F.sum(other), F.lit(0.0)).alias("sum_received"))


def received(attn: DataFrame) -> DataFrame:
    """By key position: attention received with and without itself, and given; lengths from the positions seen.

    Cells are read once by row and once by column; all else works on a row a position.
    """
    other = F.when(F.col("i") != F.col("j"), F.col("w"))
    col = by_key_position(attn)
    row = attn.groupBy("name", "i").agg(F.sum("w").alias("sum_out"), F.coalesce(F.max(other), F.lit(0.0)).alias("max_given"), F.coalesce(F.sum(other), F.lit(0.0)).alias("sum_given"))
    row = row.withColumn("length", F.max("i").over(Window.partitionBy("name")) + 1)
    both = col.join(row, ["name", "i"])
    less = F.nullif(F.col("length") - 1, F.lit(0))
    both = both.withColumn("avg_in", F.col("sum_in") / F.col("length"))
    both = both.withColumn("avg_received", F.coalesce(F.try_divide(F.col("sum_received"), less), F.lit(0.0))).withColumn("avg_given", F.coalesce(F.try_divide(F.col("sum_given"), less), F.lit(0.0)))
    return both.withColumn("energy", (F.col("sum_in") + F.col("sum_out")) / (2 * F.col("length")))


def entropy(least: float = 1e-12) -> Column:
    """Of the weights of a group, in bits; weights up to `least` don't count."""
    return F.coalesce(F.sum(F.when(F.col("w") > least, -F.col("w") * F.log2("w"))), F.lit(0.0))


def row_entropy(attn: DataFrame, least: float = 1e-12) -> DataFrame:
    return attn.groupBy("name", "i").agg(entropy(least).alias("entropy"))


def matrix_summary(attn: DataFrame, sparse: float = 0.01) -> DataFrame:
    """By sequence: mean, max, diagonal and off-diagonal mean, sparsity, and mean and deviation of row entropies and column maxima.

    Cells are read once by row and once by column; the sequence's figures come from those of its rows.
    """
    diag = F.when(F.col("i") == F.col("j"), F.col("w"))
    row = attn.groupBy("name", "i").agg(
        F.count("w").alias("n"), F.sum("w").alias("sum"), F.max("w").alias("max"), F.count(diag).alias("on_n"), F.sum(diag).alias("on"),
        F.sum(F.when(F.col("i") != F.col("j"), F.col("w"))).alias("off"), F.count_if(F.col("w") < sparse).alias("low"), entropy().alias("entropy"),
    )
    over = lambda a, n: F.try_divide(F.sum(a), F.sum(n))
    cells = row.groupBy("name").agg(
        over("sum", "n").alias("mean"), F.max("max").alias("max"), over("on", "on_n").alias("diag_mean"), over("off", F.col("n") - F.col("on_n")).alias("off_diag_mean"),
        over("low", "n").alias("sparsity"), F.avg("entropy").alias("entropy_mean"), F.stddev_pop("entropy").alias("entropy_std"),
    )
    cols = attn.groupBy("name", "j").agg(F.max("w").alias("m")).groupBy("name").agg(F.avg("m").alias("col_max_mean"), F.stddev_pop("m").alias("col_max_std"))
    return cells.join(cols, "name")


def homophily(attn: DataFrame, categories: DataFrame, labels: list[str], cat: str = "cat") -> DataFrame:
    """By query position: its category, the attention on each category (a_<label>), and on its own (same)."""
    key = attn.join(categories.select("name", F.col("i").alias("j"), F.col(cat).alias("key_cat")), ["name", "j"])
    both = key.join(categories.select("name", "i", F.col(cat).alias("query_cat")), ["name", "i"])
    on = [F.sum(F.when(F.col("key_cat") == x, F.col("w")).otherwise(0.0)).alias(f"a_{x}") for x in labels]
    return both.groupBy("name", "i", "query_cat").agg(*on, F.sum(F.when(F.col("key_cat") == F.col("query_cat"), F.col("w")).otherwise(0.0)).alias("same"))


def separation_bins(attn: DataFrame, percent: float = 5.0, digits: int = 9) -> DataFrame:
    """By sequence: how far apart the strongest off-diagonal pairs are: shares at most 5, 6 to 20, above 20, and the median."""
    off = attn.where("i <> j")
    cut = off.groupBy("name").agg(quantile("w", 1 - percent / 100, digits).alias("cut"))
    d = off.join(cut, "name").where("w >= cut").withColumn("d", F.abs(F.col("i") - F.col("j")))
    share = lambda c: F.avg(c.cast("double"))
    return d.groupBy("name").agg(share(F.col("d") <= 5).alias("short"), share((F.col("d") > 5) & (F.col("d") <= 20)).alias("medium"), share(F.col("d") > 20).alias("long"), F.median("d").alias("median_separation"), F.count(F.lit(1)).alias("pairs"))


def letter_pairs(attn: DataFrame, letters: DataFrame, percent: float = 0.5, letter: str = "cat", digits: int = 9) -> DataFrame:
    """Weight by (query letter, key letter) over pairs at or above the percentile; the diagonal counts as 0 in it and is left out."""
    zeroed = attn.withColumn("w", F.when(F.col("i") == F.col("j"), 0.0).otherwise(F.col("w")))
    cut = zeroed.groupBy("name").agg(quantile("w", 1 - percent / 100, digits).alias("cut"))
    top = zeroed.join(cut, "name").where("w >= cut and i <> j")
    top = top.join(letters.select("name", "i", F.col(letter).alias("a")), ["name", "i"]).join(letters.select("name", F.col("i").alias("j"), F.col(letter).alias("b")), ["name", "j"])
    return top.groupBy("a", "b").agg(F.sum("w").alias("w"), F.count(F.lit(1)).alias("n"))


def off_diagonal(attn: DataFrame, window: int = 0) -> DataFrame:
    return attn.where(F.abs(F.col("i") - F.col("j")) > window)


def top_interactions(attn: DataFrame, n: int, window: int = 0, keys: list[str] | None = None, by_size: bool = True) -> DataFrame:
    """The n strongest off-diagonal cells by key, ranked from 1; ties by position."""
    keys = ["name"] if keys is None else keys
    order = [F.desc(F.abs("w") if by_size else F.col("w")), *([] if "name" in keys else ["name"]), "i", "j"]
    cells = off_diagonal(attn, window)
    if not keys:
        cells = cells.orderBy(*order).limit(n)  # each task keeps n, so the one window below sees n rows
    return cells.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= n)


def sparse_graph(attn: DataFrame, strategy: str = "topk", k: int = 5, percent: float = 90.0, threshold: float = 0.0, top_mode: bool = False, digits: int = 9) -> DataFrame:
    """Directed edges (name, src, dst, w) kept by row: k strongest, at or above a percentile, local peaks, or all; then w >= threshold."""
    w = Window.partitionBy("name", "i")
    if strategy == "topk":
        kept = attn.withColumn("_r", F.row_number().over(w.orderBy(F.desc("w"), "j"))).where(F.col("_r") <= k)
    elif strategy == "percentile":
        cut = attn.groupBy("name", "i").agg(quantile("w", (1 - percent / 100) if top_mode else percent / 100, digits).alias("_cut"))
        kept = attn.join(cut, ["name", "i"]).where("w >= _cut")
    elif strategy == "local_peaks":
        near = w.orderBy("j")
        kept = attn.withColumn("_l", F.lag("w").over(near)).withColumn("_r", F.lead("w").over(near)).where("coalesce(w >= _l, true) and coalesce(w >= _r, true)")
    elif strategy == "all":
        kept = attn
    else:
        raise ValueError(f"no such strategy: {strategy}")
    return kept.where(F.col("w") >= threshold).select("name", F.col("i").alias("src"), F.col("j").alias("dst"), "w")


def degrees(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """In and out degree of every node (name, i), zeros included."""
    ends = edges.select("name", F.explode(F.array(F.struct(F.col("dst").alias("i"), F.lit(1).alias("d_in"), F.lit(0).alias("d_out")), F.struct(F.col("src").alias("i"), F.lit(0).alias("d_in"), F.lit(1).alias("d_out")))).alias("e"))
    d = ends.groupBy("name", F.col("e.i").alias("i")).agg(F.sum("e.d_in").alias("in_degree"), F.sum("e.d_out").alias("out_degree"))
    return nodes.select("name", "i").join(d, ["name", "i"], "left").fillna(0, ["in_degree", "out_degree"])


def clustering_coefficient(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Triangles over possible ones on the undirected graph without self-loops; 0 below degree 2."""
    e = edges.where("src <> dst").select("name", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    ab, bc, ac = (e.select("name", F.col("a").alias(x), F.col("b").alias(y)) for x, y in (("a", "b"), ("b", "c"), ("a", "c")))
    corners = ab.join(bc, ["name", "b"]).join(ac, ["name", "a", "c"]).select("name", F.explode(F.array("a", "b", "c")).alias("i"))
    t = corners.groupBy("name", "i").agg(F.count(F.lit(1)).alias("triangles"))
    d = e.select("name", F.explode(F.array("a", "b")).alias("i")).groupBy("name", "i").agg(F.count(F.lit(1)).alias("degree"))
    joined = nodes.select("name", "i").join(d, ["name", "i"], "left").join(t, ["name", "i"], "left").fillna(0, ["degree", "triangles"])
    return joined.withColumn("clustering", F.when(F.col("degree") > 1, F.try_divide(2.0 * F.col("triangles"), F.col("degree") * (F.col("degree") - 1))).otherwise(0.0))


def autocorrelation(rows: DataFrame, max_lag: int, keys: list[str], i: str, x: str) -> DataFrame:
    """(keys, lag, acf) for lags 0 to max_lag: correlation of the series with itself moved; null for constant or too short slices."""
    a = rows.select(*keys, F.col(i).alias("_i"), F.col(x).alias("_x"), F.explode(F.sequence(F.lit(1), F.lit(max_lag))).alias("lag"))
    b = rows.select(*keys, F.col(i).alias("_k"), F.col(x).alias("_y"))
    pairs = a.withColumn("_k", F.col("_i") + F.col("lag")).join(b, [*keys, "_k"])
    w = Window.partitionBy(*keys, "lag")
    ok = pairs.withColumn("_f", (F.max("_x").over(w) > F.min("_x").over(w)) & (F.max("_y").over(w) > F.min("_y").over(w))).where("_f")
    acf = ok.groupBy(*keys, "lag").agg(F.corr("_x", "_y").alias("acf"))
    grid = rows.select(*keys).distinct().withColumn("lag", F.explode(F.sequence(F.lit(0), F.lit(max_lag))))
    return grid.join(acf, [*keys, "lag"], "left").withColumn("acf", F.when(F.col("lag") == 0, 1.0).otherwise(F.col("acf")))


def dominant_lag(acf: DataFrame, keys: list[str], least: float = 0.1, digits: int = 9) -> DataFrame:
    """The lag of the highest strict interior peak at or above `least`; the smaller of ties, null without peaks."""
    w = Window.partitionBy(*keys).orderBy("lag")
    r = acf.where("lag > 0").withColumn("acf", F.round("acf", digits))
    r = r.withColumn("_l", F.lag("acf").over(w)).withColumn("_n", F.lead("acf").over(w))
    peak = (F.col("acf") > F.col("_l")) & (F.col("acf") > F.col("_n")) & (F.col("acf") >= least)
    best = F.max(F.when(peak, F.struct(F.col("acf"), (-F.col("lag")).alias("m"))))
    return r.groupBy(*keys).agg(best.alias("b")).select(*keys, (-F.col("b.m")).alias("lag"), F.col("b.acf").alias("acf"))


def periodicity(dominant: DataFrame) -> DataFrame:
    """By sequence: shares of positions whose dominant lag looks helix-like (3, 4), sheet-like (2), short, medium or long."""
    share = lambda c: F.coalesce(F.avg(F.coalesce(c, F.lit(False)).cast("double")), F.lit(0.0))
    d = F.col("lag")
    return dominant.groupBy("name").agg(share(d.isin(3, 4)).alias("helix_like"), share(d == 2).alias("sheet_like"), share(d.between(1, 6)).alias("short"), share(d.between(7, 15)).alias("medium"), share(d > 15).alias("long"))


def differential_categories(a: DataFrame, b: DataFrame, rank: str = "pct_rank", top: float = 25.0, bottom: float = 25.0) -> DataFrame:
    """Positions by percentile ranks in two models: peak in A only, in B only, in both, or background."""
    both = a.select("name", "i", F.col(rank).alias("rank_a")).join(b.select("name", "i", F.col(rank).alias("rank_b")), ["name", "i"])
    high, low = 100 - top, bottom
    x, y = F.col("rank_a"), F.col("rank_b")
    return both.withColumn("category", F.when((x >= high) & (y <= low), "A-specific").when((y >= high) & (x <= low), "B-specific").when((x >= high) & (y >= high), "Shared").otherwise("Background"))


def matrix_difference(attn: DataFrame, reference: DataFrame) -> DataFrame:
    """Cell-wise |A - reference| for every named matrix against one reference matrix (i, j, w), and the overall range."""
    own = reference.select("i", "j", F.col("w").alias("_ref"))
    d = attn.join(own, ["i", "j"]).select("name", "i", "j", F.abs(F.col("w") - F.col("_ref")).alias("diff"))
    span = d.agg(F.min("diff").alias("low"), F.max("diff").alias("high"))
    return d.crossJoin(F.broadcast(span))  # one row


def distances_below(points: DataFrame, cutoff: float, name: str = "name", i: str = "i", xyz: tuple[str, ...] = ("x", "y", "z")) -> DataFrame:
    """Contact pairs (name, i, j): distinct positions of a chain nearer than the cutoff.

    Positions are hashed to cells of the cutoff's size and met with the cells
    around, so that far pairs are never formed.
    """
    cell = [F.floor(F.col(c) / cutoff).alias(f"_c{n}") for n, c in enumerate(xyz)]
    keys = [f"_c{n}" for n in range(len(xyz))]
    a = points.select(name, F.col(i), *[F.col(c).alias(f"_a{n}") for n, c in enumerate(xyz)], *cell)
    b = points.select(name, F.col(i).alias("j"), *[F.col(c).alias(f"_b{n}") for n, c in enumerate(xyz)], *cell)
    for k in keys:
        b = b.withColumn(k, F.explode(F.array(F.col(k) - 1, F.col(k), F.col(k) + 1)))
    square = sum(((F.col(f"_a{n}") - F.col(f"_b{n}")) ** 2 for n in range(len(xyz))), F.lit(0.0))
    return a.join(b, [name, *keys]).where((F.col(i) != F.col("j")) & (square < cutoff * cutoff)).select(name, i, "j", F.sqrt(square).alias("distance"))
