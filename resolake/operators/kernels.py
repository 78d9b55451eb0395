"""Numeric kernels on one sequence's matrix: clustering, spectra, centrality, components, bootstrap.

Each group is one sequence, whose length bounds it; Spark deals the groups out.
Positions that don't occur count as zero rows of the matrix.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..sources.tables import Scratch


def dense(pdf: pd.DataFrame) -> np.ndarray:
    n = int(max(pdf["i"].max(), pdf["j"].max())) + 1
    out = np.zeros((n, n))
    out[pdf["i"].to_numpy(), pdf["j"].to_numpy()] = pdf["w"].to_numpy()
    return out


def kmeans(x: np.ndarray, k: int, starts: int = 10, rounds: int = 100, seed: int = 42) -> np.ndarray:
    """Labels of the best of several k-means++ runs."""
    rng, best, found = np.random.default_rng(seed), np.inf, np.zeros(len(x), int)
    squares = (x * x).sum(1)[:, None]

    def distances(centers: np.ndarray) -> np.ndarray:
        return np.maximum(squares - 2 * (x @ centers.T) + (centers * centers).sum(1), 0)

    for _ in range(starts):
        centers = x[[rng.integers(len(x))]]
        while len(centers) < k:
            d = distances(centers).min(1)
            centers = np.vstack([centers, x[rng.choice(len(x), p=d / d.sum()) if d.sum() > 0 else rng.integers(len(x))]])
        for _ in range(rounds):
            d = distances(centers)
            labels = d.argmin(1)
            new = np.array([x[labels == c].mean(0) if (labels == c).any() else centers[c] for c in range(k)])
            if np.allclose(new, centers):
                break
            centers = new
        inertia = d.min(1).sum()
        if inertia < best - 1e-12:
            best, found = inertia, labels
    return found


def cluster_profiles(attn: DataFrame, k: int = 3, seed: int = 42) -> DataFrame:
    """(name, i, cluster, energy): k-means of each position's scaled row and column profile; none below k positions."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a = dense(pdf)
        n = len(a)
        scale = lambda m: m / np.maximum(np.sqrt((m * m).sum(1, keepdims=True)), 1e-12)
        if n < k:
            return pd.DataFrame([], columns=["name", "i", "cluster", "energy"])
        x = scale(np.hstack([scale(a), scale(a.T)]))
        return pd.DataFrame({"name": str(pdf["name"].iat[0]), "i": np.arange(n), "cluster": kmeans(x, k, seed=seed), "energy": (a.sum(1) + a.sum(0)) / (2 * n)})

    return attn.groupBy("name").applyInPandas(run, "name string, i int, cluster int, energy double")


def ranked_clusters(clusters: DataFrame, names: tuple[str, ...] = ("PatA", "PatB", "Bg")) -> DataFrame:
    """Clusters named from high to low mean energy; ties by cluster number."""
    mean = clusters.groupBy("name", "cluster").agg(F.avg("energy").alias("_e"))
    w = Window.partitionBy("name").orderBy(F.desc("_e"), "cluster")
    label = F.element_at(F.array(*[F.lit(x) for x in names]), F.least(F.row_number().over(w), F.lit(len(names))))
    return clusters.join(mean.select("name", "cluster", label.alias("pattern")), ["name", "cluster"])


def demote_weak(patterns: DataFrame, strength: str, percent: float, background: str = "Bg") -> DataFrame:
    """Positions below the sequence's order statistic of strength become background."""
    from .positions import index_cutoff

    return index_cutoff(patterns, strength, percent, out="_keep").withColumn("pattern", F.when(F.col("_keep"), F.col("pattern")).otherwise(F.lit(background))).drop("_keep")


def subclusters(attn: DataFrame, patterns: DataFrame, k: int = 3, background: str = "Bg") -> DataFrame:
    """k-means again inside the background positions of each sequence, energies ranked again."""
    bg = patterns.where(F.col("pattern") == background).select("name", "i")
    inside = attn.withColumn("name", F.col("name").cast("string")).join(bg, ["name", "i"]).join(bg.withColumnRenamed("i", "j"), ["name", "j"])
    w = Window.partitionBy("name")
    renumbered = inside.withColumn("a", F.dense_rank().over(w.orderBy("i")) - 1).withColumn("b", F.dense_rank().over(w.orderBy("j")) - 1)
    found = cluster_profiles(renumbered.select("name", F.col("a").alias("i"), F.col("b").alias("j"), "w"), k)
    return ranked_clusters(found, tuple(f"{background}{n + 1}" for n in range(k)))


def svd_summary(attn: DataFrame, top_k: int = 20) -> DataFrame:
    """Effective and stable rank, ranks for 90, 95 and 99 % of the energy, norms and the leading singular values."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        s = np.linalg.svd(dense(pdf), compute_uv=False)
        total, energy = s.sum(), s * s
        p = s[s > 0] / total if total else np.empty(0)
        cum = np.cumsum(energy) / energy.sum() if energy.sum() else np.zeros(len(s))
        need = [int(np.searchsorted(cum, t - 1e-12) + 1) if energy.sum() else 0 for t in (0.9, 0.95, 0.99)]
        row = [str(pdf["name"].iat[0]), len(s), float(np.exp(-(p * np.log(p)).sum())) if len(p) else 0.0, float(energy.sum() / energy[0]) if energy[0] else 0.0, *need, float(np.sqrt(energy.sum())), float(s[0]), s[:top_k].tolist()]
        return pd.DataFrame([row], columns=["name", "length", "effective_rank", "stable_rank", "n90", "n95", "n99", "frobenius", "spectral", "singular"])

    schema = "name string, length int, effective_rank double, stable_rank double, n90 int, n95 int, n99 int, frobenius double, spectral double, singular array<double>"
    return attn.groupBy("name").applyInPandas(run, schema)


def pca_loadings(attn: DataFrame, components: int = 3) -> DataFrame:
    """(name, pc, i, loading, variance_ratio) of the centred rows; signs make each largest loading positive."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a = dense(pdf)
        x = a - a.mean(0)
        values, vectors = np.linalg.eigh(x.T @ x / max(len(a) - 1, 1))
        order = np.argsort(-values, kind="stable")[:components]
        values = np.maximum(values, 0)
        out = []
        for n, c in enumerate(order):
            v = vectors[:, c] * (np.sign(vectors[np.abs(vectors[:, c]).argmax(), c]) or 1)
            out.append(pd.DataFrame({"name": str(pdf["name"].iat[0]), "pc": n + 1, "i": np.arange(len(a)), "loading": v, "variance_ratio": values[c] / values.sum() if values.sum() else 0.0}))
        return pd.concat(out)

    return attn.groupBy("name").applyInPandas(run, "name string, pc int, i int, loading double, variance_ratio double")


def rank_k_signal(attn: DataFrame, k: int = 3) -> DataFrame:
    """(name, i, j, w): the centred matrix rebuilt from its first k principal components."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a = dense(pdf)
        x = a - a.mean(0)
        _, vectors = np.linalg.eigh(x.T @ x / max(len(a) - 1, 1))
        v = vectors[:, ::-1][:, :k]
        i, j = np.indices(a.shape)
        return pd.DataFrame({"name": str(pdf["name"].iat[0]), "i": i.ravel(), "j": j.ravel(), "w": (x @ v @ v.T).ravel()})

    return attn.groupBy("name").applyInPandas(run, "name string, i int, j int, w double")


def betweenness(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Normalised betweenness of an unweighted directed graph by one breadth-first pass a node."""

    def run(key: tuple, e: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        n = int(max([-1, *v["i"], *e["src"], *e["dst"]])) + 1
        out: list[list[int]] = [[] for _ in range(n)]
        for a, b in sorted(set(zip(e["src"].tolist(), e["dst"].tolist(), strict=True))):
            if a != b:
                out[a].append(b)
        score = np.zeros(n)
        for s in range(n):
            dist, paths, before, order, todo = [-1] * n, [0.0] * n, [[] for _ in range(n)], [], deque([s])
            dist[s], paths[s] = 0, 1.0
            while todo:
                u = todo.popleft()
                order.append(u)
                for w in out[u]:
                    if dist[w] < 0:
                        dist[w] = dist[u] + 1
                        todo.append(w)
                    if dist[w] == dist[u] + 1:
                        paths[w] += paths[u]
                        before[w].append(u)
            share = [0.0] * n
            for w in reversed(order):
                for u in before[w]:
                    share[u] += paths[u] / paths[w] * (1 + share[w])
                if w != s:
                    score[w] += share[w]
        norm = (len(v) - 1) * (len(v) - 2)
        at = v["i"].to_numpy()
        return pd.DataFrame({"name": str(key[0]), "i": at, "betweenness": score[at] / norm if norm > 0 else 0.0})

    return edges.groupBy("name").cogroup(nodes.select("name", "i").groupBy("name")).applyInPandas(run, "name string, i int, betweenness double")


#: Side of the squares of a matrix in which a task labels regions.
TILE = 256


def region_labels(i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each cell, the place in the input of the first cell, by (i, j), of its 8-connected region; a cell may occur twice."""
    width = int(j.max() - j.min()) + 3  # no row's end touches the next row's start
    key, first, at = np.unique((i - i.min()) * width + (j - j.min()), return_index=True, return_inverse=True)
    after = np.concatenate([key + 1, key + width - 1, key + width, key + width + 1])
    found = np.minimum(np.searchsorted(key, after), len(key) - 1)
    met = key[found] == after
    a, b = np.tile(np.arange(len(key)), 4)[met], found[met]
    label = np.arange(len(key))
    while True:
        least, low = np.minimum(label[a], label[b]), label.copy()
        np.minimum.at(low, label[a], least)
        np.minimum.at(low, label[b], least)
        low = low[low]
        if (low == label).all():
            return first[label][at]
        label = low


def _linked(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(name, hi, lo) for every label of links (name, u, v) but the smallest of its component, which is lo.

    Each round a label points at its smallest smaller neighbour, hands the others
    over to that one, and follows one pointer further.
    """
    u, v = F.col("u"), F.col("v")
    e = scratch.table(links.select("name", F.greatest(u, v).alias("hi"), F.least(u, v).alias("lo"), F.lit(True).alias("moved")).distinct())
    while e.agg(F.max("moved")).first()[0]:
        first = scratch.table(e.groupBy("name", "hi").agg(F.min("lo").alias("m")))
        handed = e.join(first, ["name", "hi"]).where("lo <> m").select("name", F.col("lo").alias("hi"), F.col("m").alias("lo"), F.lit(True).alias("moved"))
        further = first.select("name", F.col("hi").alias("m"), F.col("m").alias("mm"))
        jumped = first.join(further, ["name", "m"], "left").select("name", "hi", F.coalesce("mm", "m").alias("lo"), F.col("mm").isNotNull().alias("moved"))
        e = scratch.table(handed.unionByName(jumped).groupBy("name", "hi", "lo").agg(F.max("moved").alias("moved")))
    return e.drop("moved")


def bright_components(attn: DataFrame, percent: float = 1.0, least_size: int = 4, window: int = 0, tile: int = TILE) -> DataFrame:
    """(name, component, i, j, w): 8-connected regions of cells at or above the order-statistic cutoff, near-diagonal cells left out.

    The cutoff is among the cells given; cells that are not given belong to no
    region. A group is a square of `tile` positions a side, whatever a matrix's
    size: there regions are labelled by their first cell. Then only cells at
    squares' edges are met with their neighbours, and labels that touch are
    joined in rounds. Components are numbered by their first cell.
    """
    from .positions import index_cutoff

    far = attn.where(F.abs(F.col("i") - F.col("j")) > window).select(F.col("name").cast("string").alias("name"), F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), "w")
    bright = index_cutoff(far.where(F.col("name").isNotNull()), "w", percent, out="_bright").where("_bright").select("name", "i", "j", "w")

    def run(cells: pa.Table) -> pa.Table:
        i, j = cells.column("i"), cells.column("j")
        first = pa.array(region_labels(i.to_numpy().astype(np.int64), j.to_numpy().astype(np.int64)))
        return cells.append_column("_i", i.take(first)).append_column("_j", j.take(first))

    schema = StructType([*bright.schema, StructField("_i", IntegerType()), StructField("_j", IntegerType())])
    with Scratch(attn.sparkSession) as scratch:
        squares = bright.groupBy("name", F.floor(F.col("i") / tile).alias("_ti"), F.floor(F.col("j") / tile).alias("_tj"))
        cells = scratch.table(squares.applyInArrow(run, schema).select("name", "i", "j", "w", F.struct(F.col("_i").alias("i"), F.col("_j").alias("j")).alias("label")))
        at_edge = lambda c: F.pmod(F.col(c), F.lit(tile)).isin(0, tile - 1)
        edge = cells.where(at_edge("i") | at_edge("j")).select("name", "i", "j", "label")
        after = F.explode(F.array(*[F.struct((F.col("i") + x).alias("i"), (F.col("j") + y).alias("j")) for x, y in ((0, 1), (1, -1), (1, 0), (1, 1))])).alias("at")
        met = edge.select("name", F.col("label").alias("u"), after).select("name", "u", "at.i", "at.j").join(edge.withColumnRenamed("label", "v"), ["name", "i", "j"])
        lower = _linked(met.where("u <> v"), scratch).withColumnRenamed("hi", "label")
        whole = cells.join(lower, ["name", "label"], "left").select("name", "i", "j", "w", F.coalesce("lo", "label").alias("label"))
        sizes = whole.groupBy("name", "label").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_size)
        numbered = sizes.select("name", "label", (F.row_number().over(Window.partitionBy("name").orderBy("label")) - 1).alias("component"))
        return scratch.keep(whole.join(numbered, ["name", "label"]).select("name", "component", "i", "j", "w"))


def component_summary(regions: DataFrame) -> DataFrame:
    """Size, centre (means rounded half to even), spans and values of each region."""
    span = lambda c: (F.max(c) - F.min(c) + 1)
    return regions.groupBy("name", "component").agg(
        F.count(F.lit(1)).alias("size"), F.bround(F.avg("i")).cast("int").alias("center_i"), F.bround(F.avg("j")).cast("int").alias("center_j"),
        span("i").alias("span_i"), span("j").alias("span_j"), F.avg("w").alias("mean_w"), F.max("w").alias("max_w"),
    )


#: Up to this many times does a row count in a resample; chance of more than one in 10^11.
_MOST_DRAWS = 13


def _poisson_draws(rows: np.ndarray, resamples: int, seed: int) -> np.ndarray:
    """(rows, resamples): Poisson numbers of mean 1 that depend on a row's hash, the resample and the seed alone."""
    each = (np.arange(resamples, dtype=np.uint64) + np.uint64(seed) * np.uint64(1_000_003)) * np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        h = rows.view(np.uint64)[:, None] ^ each
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
        h ^= h >> np.uint64(31)
    upto = np.cumsum([math.exp(-1) / math.factorial(n) for n in range(_MOST_DRAWS)])
    return np.searchsorted(upto, (h >> np.uint64(11)) * 2.0**-53, side="right")


def bootstrap_mean(df: DataFrame, x: str, key: str, row: list[str], resamples: int = 1000, least: int = 10, seed: int = 42) -> DataFrame:
    """Mean and 2.5 and 97.5 % bootstrap percentiles of x over each key's rows; null below `least`.

    Each row counts in each resample as often as a Poisson draw of mean 1 says,
    which tends to drawing with replacement. A draw is a hash of the columns
    `row`, which tell rows apart, and of the resample, so no partitioning or
    retry changes it. Tasks sum their own rows by key and resample, so a key's
    rows are never gathered.
    """

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, part in pdf.groupby("key"):
                weight, total = np.zeros(resamples), np.zeros(resamples)
                v, h = part["x"].to_numpy(float), part["h"].to_numpy(np.int64)
                for at in range(0, len(v), 1024):
                    times = _poisson_draws(np.ascontiguousarray(h[at : at + 1024]), resamples, seed)
                    weight += times.sum(axis=0)
                    total += v[at : at + 1024] @ times
                yield pd.DataFrame({"key": name, "resample": np.arange(resamples), "weight": weight, "total": total})

    known = df.where(F.col(x).isNotNull()).select(F.col(key).cast("string").alias("key"), F.col(x).cast("double").alias("x"), F.xxhash64(*row).alias("h"))
    drawn = known.mapInPandas(draw, "key string, resample int, weight double, total double").groupBy("key", "resample").agg(F.sum("weight").alias("weight"), F.sum("total").alias("total"))
    means = drawn.groupBy("key").agg(F.percentile(F.try_divide("total", "weight"), F.array(F.lit(0.025), F.lit(0.975))).alias("q"))
    plain = df.groupBy(F.col(key).cast("string").alias("key")).agg(F.count(x).alias("n"), F.avg(x).alias("mean"))
    bound = lambda k: F.when(F.col("n") >= least, F.col("q")[k])
    return plain.join(means, "key", "left").select(F.col("key").alias(key), "n", "mean", bound(0).alias("low"), bound(1).alias("high"))


def stacked_pca(attn: DataFrame, components: int = 2) -> DataFrame:
    """(name, pc, score, variance_ratio): principal components of whole matrices as vectors of all their cells.

    Cells that a shorter matrix doesn't have count as zero. Cells are standardised
    over matrices and inner products of matrices summed a task at a time; only the
    small matrix of products (a row a sequence) is decomposed. Scores' largest
    entry is made positive.
    """
    cells = attn.select(F.col("name").cast("string").alias("name"), "i", "j", F.coalesce("w", F.lit(0.0)).alias("w"))
    names = sorted(r[0] for r in cells.select("name").distinct().collect())
    place = {n: k for k, n in enumerate(names)}

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = np.zeros((len(names), len(names)))
        for batch in batches:
            name, w = batch.column(0), batch.column(1)
            lengths = np.diff(name.offsets.to_numpy())
            who = name.flatten().dictionary_encode()
            column = np.array([place[n] for n in who.dictionary.to_pylist()], int)[who.indices.to_numpy()]
            x = np.zeros((len(lengths), len(names)))
            np.add.at(x, (np.repeat(np.arange(len(lengths)), lengths), column), w.flatten().to_numpy())
            x -= x.mean(1, keepdims=True)
            sd = np.sqrt((x * x).mean(1, keepdims=True))
            x = np.where(sd > 1e-12, x / np.where(sd > 1e-12, sd, 1), 0.0)
            g += x.T @ x
        a, b = np.indices(g.shape)
        label = pa.array(names, pa.string())
        yield pa.RecordBatch.from_arrays([label.take(pa.array(a.ravel())), label.take(pa.array(b.ravel())), pa.array(g.ravel())], names=["a", "b", "g"])

    stacks = cells.groupBy("i", "j").agg(F.collect_list(F.struct("name", "w")).alias("c")).select(F.col("c.name").alias("name"), F.col("c.w").alias("w"))
    gram = stacks.mapInArrow(products, "a string, b string, g double").groupBy("a", "b").agg(F.sum("g").alias("g"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        g = pdf.pivot(index="a", columns="b", values="g").fillna(0.0).sort_index().sort_index(axis=1)
        values, vectors = np.linalg.eigh(g.to_numpy())
        values = np.maximum(values[::-1], 0)
        out = []
        for c in range(min(components, len(values))):
            v = vectors[:, ::-1][:, c] * np.sqrt(values[c])
            v = v * (np.sign(v[np.abs(v).argmax()]) or 1)
            out.append(pd.DataFrame({"name": g.index, "pc": c + 1, "score": v, "variance_ratio": values[c] / values.sum() if values.sum() else 0.0}))
        return pd.concat(out)

    return gram.withColumn("_k", F.lit(0)).groupBy("_k").applyInPandas(run, "name string, pc int, score double, variance_ratio double")
