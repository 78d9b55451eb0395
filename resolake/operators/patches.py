"""Recurring square patches of matrices: every patch, scaled within its matrix, clustered over all matrices together."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import Scratch

SEED = 42
#: Rows of patch centres of a band, and patches that a task cuts at a time.
ROWS, TOGETHER = 64, 1 << 15


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cells that follow each other in one row of a matrix, as one: columns and weights in bytes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        name = np.asarray(batch.column(0).dictionary_encode().indices)
        i, j, w = (np.asarray(batch.column(k)) for k in (1, 2, 3))
        first = np.flatnonzero(np.r_[True, (name[1:] != name[:-1]) | (i[1:] != i[:-1])])
        ends = np.r_[first[1:], len(i)]
        top = np.maximum(i[first], np.maximum.reduceat(j, first))
        js, ws = ([c[x:y].tobytes() for x, y in zip(first, ends, strict=True)] for c in (j, w))
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(first)), pa.array(i[first]), pa.array(top), pa.array(js, pa.binary()), pa.array(ws, pa.binary())], names=["name", "i", "top", "js", "ws"])


def _bands(attn: DataFrame, size: int) -> DataFrame:
    """(name, n, first, cells): the rows of a matrix of n columns about ROWS rows of patch centres, the first of which is `first`; cells that are not given are 0.

    Cells are folded into pieces of rows before the shuffle; each band of each
    matrix is there, even without cells.
    """
    half, kind = size // 2, attn.schema["name"].dataType.simpleString()
    given = attn.where("name is not null and i >= 0 and j >= 0").select("name", F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), F.coalesce(F.col("w").cast("double"), F.lit(0.0)).alias("w"))
    pieces = given.mapInArrow(_pieces, f"name {kind}, i int, top int, js binary, ws binary")
    side = pieces.groupBy("name").agg((F.max("top") + 1).cast("int").alias("n")).where(F.col("n") >= size)
    block = lambda at: F.greatest(F.floor((F.col("i") + at) / ROWS), F.lit(0)).cast("int")
    dealt = pieces.select("name", F.lit(None).cast("int").alias("n"), F.explode(F.sequence(block(-half), block(half))).alias("block"), F.struct("i", "js", "ws").alias("piece"))
    every = side.select("name", "n", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / ROWS).cast("int"))).alias("block"), F.lit(None).cast(dealt.schema["piece"].dataType).alias("piece"))
    grouped = dealt.unionByName(every).groupBy("name", "block").agg(F.max("n").alias("n"), F.collect_list("piece").alias("pieces")).where("n is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                n, b = batch.column(1)[row].as_py(), batch.column(2)[row].as_py()
                first, last = max(b * ROWS, half), min((b + 1) * ROWS, n - half)
                if first >= last:
                    continue
                a = np.zeros((last - first + 2 * half, n))
                for piece in batch.column(3)[row].as_py():
                    at = piece["i"] - first + half
                    if 0 <= at < len(a):
                        a[at, np.frombuffer(piece["js"], np.int32)] = np.frombuffer(piece["ws"])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, 1), pa.array([n], pa.int32()), pa.array([first], pa.int32()), pa.array([a.tobytes()], pa.binary())], names=["name", "n", "first", "cells"])

    return grouped.select("name", "n", "block", "pieces").mapInArrow(run, f"name {kind}, n int, first int, cells binary")


def _cut(cells: bytes, n: int, size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row less the band's first, column, patch) of a band's patches, some at a time."""
    a, half = np.frombuffer(cells).reshape(-1, n), size // 2
    seen = np.lib.stride_tricks.sliding_window_view(a, (size, size))
    step = max(1, TOGETHER // n)
    for x in range(0, len(seen), step):
        part = seen[x : x + step]
        i, j = np.divmod(np.arange(part.shape[0] * part.shape[1]), part.shape[1])
        yield i + x, j + half, part.reshape(-1, size * size)


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))


def patches(attn: DataFrame, size: int = 5) -> DataFrame:
    """(name, i, j, patch): all size x size patches of each matrix by centre, row by row; cells that are not given count as 0. size must be odd."""
    if size % 2 == 0:
        raise ValueError("size must be odd")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                n, first = batch.column(1)[row].as_py(), batch.column(2)[row].as_py()
                for i, j, x in _cut(batch.column(3)[row].as_py(), n, size):
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.full(len(i), row))), pa.array((i + first).astype(np.int32)), pa.array(j.astype(np.int32)), _lists(x)], names=["name", "i", "j", "patch"])

    return _bands(attn, size).mapInArrow(run, f"name {attn.schema['name'].dataType.simpleString()}, i int, j int, patch array<double>")


def scaled_patches(found: DataFrame) -> DataFrame:
    """Each place of the patch with mean 0 and deviation 1 over its matrix's patches; places that don't vary are 0."""
    stats = found.groupBy("name").agg(Summarizer.metrics("mean", "std", "count").summary(array_to_vector("patch")).alias("s"))
    stats = stats.select("name", vector_to_array("s.mean").alias("mean"), vector_to_array("s.std").alias("std"), F.sqrt((F.col("s.count") - 1) / F.col("s.count")).alias("f"))
    z = F.zip_with(F.zip_with("patch", "mean", lambda x, m: x - m), "std", lambda x, s: F.when(s * F.col("f") > 1e-15, x / (s * F.col("f"))).otherwise(0.0))
    return found.join(stats, "name").select("name", "i", "j", z.alias("patch"))


def _scales(bands: DataFrame, size: int) -> DataFrame:
    """(name, mean, factor) of the places of a matrix's patches, of which bands give means and squared deviations; factor: 1 over the deviation, 0 where there is none."""
    kind = bands.schema["name"].dataType.simpleString()

    def of_band(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                parts = [x for _, _, x in _cut(batch.column(3)[row].as_py(), batch.column(1)[row].as_py(), size)]
                count, mean, square = _merged([(len(x), m := x.mean(0), ((x - m) ** 2).sum(0)) for x in parts])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, 1), pa.array([count]), _lists(mean[None]), _lists(square[None])], names=["name", "count", "mean", "square"])

    def of_matrix(table: pa.Table) -> pa.Table:
        count, mean, square = _merged([(r["count"], np.array(r["mean"]), np.array(r["square"])) for r in table.to_pylist()])
        sd = np.sqrt(square / count)
        return pa.Table.from_arrays([table.column(0).slice(0, 1), _lists(mean[None]), _lists(np.where(sd > 1e-15, 1 / np.where(sd > 1e-15, sd, 1), 0.0)[None])], names=["name", "mean", "factor"])

    own = bands.mapInArrow(of_band, f"name {kind}, count long, mean array<double>, square array<double>")
    return own.groupBy("name").applyInArrow(of_matrix, f"name {kind}, mean array<double>, factor array<double>")


def _merged(parts: list[tuple[int, np.ndarray, np.ndarray]]) -> tuple[int, np.ndarray, np.ndarray]:
    """Count, mean and squared deviations of several parts together."""
    counts, means, squares = (np.array(c) for c in zip(*parts, strict=True))
    mean = counts @ means / counts.sum()
    return int(counts.sum()), mean, squares.sum(0) + counts @ (means - mean) ** 2


def _uniform(h: int, count: int, step: int) -> np.ndarray:
    """Numbers in [0, 1) that depend on a band's hash, the patch's place in it and the step alone."""
    with np.errstate(over="ignore"):
        x = np.uint64(h & (2**64 - 1)) + (np.arange(count, dtype=np.uint64) + np.uint64(step) * np.uint64(0xD1342543DE82EF95)) * np.uint64(0x9E3779B97F4A7C15)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) * 2.0**-53


def _squares(z: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """(patches, centres): squared distances."""
    return np.maximum((z * z).sum(1)[:, None] - 2 * (z @ centers.T) + (centers * centers).sum(1), 0)


class _Passes:
    """Passes over the scaled patches of stored bands (name, n, first, cells, h, mean, factor). A task cuts and scales patches anew, so that none is stored."""

    def __init__(self, table: DataFrame, size: int):
        self.table, self.size = table, size

    def each(self, f: Callable, schema: str, gather: Callable | None = None) -> DataFrame:
        """f(name, first, h, parts) of each band gives record batches; parts: (place of the first patch in the band, row, column, scaled patches)."""
        size = self.size

        def scaled(batch: pa.RecordBatch, row: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
            mean, factor, at = (*(np.array(batch.column(k)[row].as_py()) for k in (5, 6)), 0)
            for i, j, x in _cut(batch.column(3)[row].as_py(), batch.column(1)[row].as_py(), size):
                yield at, i, j, (x - mean) * factor
                at += len(i)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in range(batch.num_rows):
                    yield from f(batch.column(0).slice(row, 1), batch.column(2)[row].as_py(), batch.column(4)[row].as_py(), scaled(batch, row))
            if gather:
                yield from gather()

        return self.table.mapInArrow(run, schema)

    def sums(self, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """By nearest centre: patches and their sums; and the sum of squared distances. Tasks sum their own, Spark sums tasks by place."""
        total = np.zeros((len(centers), centers.shape[1] + 2))

        def add(name, first, h, parts):
            for _, _, _, z in parts:
                d = _squares(z, centers)
                near = d.argmin(1)
                one = (near[:, None] == np.arange(len(centers))).astype(float)
                total[:, 2:] += one.T @ z
                total[:, 0] += one.sum(0)
                total[:, 1] += one.T @ d[np.arange(len(d)), near]
            return ()

        def give():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["place", "x"])

        found = np.zeros(total.size)
        for r in self.each(add, "place long, x double", give).groupBy("place").agg(F.sum("x").alias("x")).collect():  # a row a place of a centre
            found[r["place"]] = r["x"]
        found = found.reshape(total.shape)
        return found[:, 0], found[:, 2:], float(found[:, 1].sum())

    def drawn(self, step: int, seed: int, chance: Callable[[np.ndarray], np.ndarray] | None) -> np.ndarray:
        """Patches that are drawn with their own chances; without one, the patch of the least number."""

        def draw(name, first, h, parts):
            u, best = None, (2.0, None)
            for at, i, _, z in parts:
                u = _uniform(h ^ seed, at + len(i), step)[at:]
                if chance is None:
                    k = int(u.argmin())
                    best = min(best, (float(u[k]), z[k]), key=lambda x: x[0])
                elif len(some := np.flatnonzero(u < chance(z))):
                    yield pa.RecordBatch.from_arrays([pa.array(u[some]), _lists(z[some])], names=["u", "z"])
            if chance is None:
                yield pa.RecordBatch.from_arrays([pa.array([best[0]]), _lists(best[1][None])], names=["u", "z"])

        found = self.each(draw, "u double, z array<double>")
        rows = found.orderBy("u", "z").limit(1).collect() if chance is None else found.orderBy("u", "z").collect()  # a few rows a centre, by the chances
        return np.array([r["z"] for r in rows]).reshape(len(rows), self.size**2)

    def seeds(self, k: int, seed: int, steps: int = 2) -> np.ndarray:
        """k-means||: in each step 2 k patches or so are drawn in proportion to their squared distance; then k-means++ among them, weighted by the patches nearest to them."""
        found = self.drawn(0, seed, None)
        for step in range(1, steps + 1):
            cost = self.sums(found)[2]
            if cost <= 0:
                break
            found = np.vstack([found, self.drawn(step, seed, lambda z, c=found, cost=cost: 2 * k * _squares(z, c).min(1) / cost)])
        found = np.unique(found, axis=0)
        if len(found) <= k:
            return found
        weights = self.sums(found)[0]
        rng = np.random.default_rng(seed)
        centers = found[[rng.choice(len(found), p=weights / weights.sum())]]
        while len(centers) < k and (chance := weights * _squares(found, centers).min(1)).sum() > 0:
            centers = np.vstack([centers, found[rng.choice(len(found), p=chance / chance.sum())]])
        for _ in range(30):
            near = _squares(found, centers).argmin(1)
            new = np.array([weights[near == c] @ found[near == c] / weights[near == c].sum() if weights[near == c].sum() > 0 else centers[c] for c in range(len(centers))])
            if np.array_equal(new, centers):
                break
            centers = new
        return centers


def patch_motifs(attn: DataFrame, size: int = 5, motifs: int = 4, rounds: int = 30, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """((name, i, j, motif, distance) of every patch, (motif, row, column, value) of the prototypes), by k-means||.

    distance is the Euclidean one to the prototype, in scaled units. Motifs are
    numbered by size, the largest 0 (ties by the clusters' own numbers). Rows of
    matrices are stored, in bands; each pass cuts all patches from them, and
    draws depend on a patch's place in its matrix, not on partitions.
    """
    if size % 2 == 0:
        raise ValueError("size must be odd")
    kind = attn.schema["name"].dataType.simpleString()
    with Scratch(attn.sparkSession) as scratch:
        bands = scratch.table(_bands(attn, size))
        scaled = bands.withColumn("h", F.xxhash64("name", "first")).join(scratch.table(_scales(bands, size)), "name")
        table = scratch.keep(scaled.select("name", "n", "first", "cells", "h", "mean", "factor"))
    passes, centers = _Passes(table, size), np.empty((0, size * size))
    if not table.isEmpty():
        centers = passes.seeds(motifs, seed)
        for _ in range(rounds):
            count, total, _ = passes.sums(centers)
            new = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centers)
            moved, centers = np.sqrt(((new - centers) ** 2).sum(1)).max(), new
            if moved <= 1e-4:
                break
        centers = centers[np.argsort(-passes.sums(centers)[0], kind="stable")]

    def assign(name, first, h, parts):
        for _, i, j, z in parts:
            near = _squares(z, centers).argmin(1)
            distance = np.sqrt(((z - centers[near]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([name.take(pa.array(np.zeros(len(i), int))), pa.array((i + first).astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(near.astype(np.int32)), pa.array(distance)], names=["name", "i", "j", "motif", "distance"])

    values = [(m, p // size, p % size, float(v)) for m, c in enumerate(centers) for p, v in enumerate(c)]
    return passes.each(assign, f"name {kind}, i int, j int, motif int, distance double"), attn.sparkSession.createDataFrame(values, "motif int, row int, column int, value double")


def motif_classes(assigned: DataFrame, classes: DataFrame, category: str, keys: list[str] | None = None) -> DataFrame:
    """(keys, motif, category, patches, share, mean_distance): classes at the patches' first position, and the mean |i - j| of the motif.

    classes: (name, i, category). Patches without a class count in mean_distance and in no share.
    """
    by = [*(keys or []), "motif"]
    counts = assigned.join(classes.select("name", "i", F.col(category).alias("category")), ["name", "i"], "left").groupBy(*by, "category").agg(F.count(F.lit(1)).alias("patches"), F.sum(F.abs(F.col("i") - F.col("j"))).alias("_far"))
    w = Window.partitionBy(*by)  # a row a class
    known = F.sum(F.when(F.col("category").isNotNull(), F.col("patches"))).over(w)
    mean = F.sum("_far").over(w) / F.sum("patches").over(w)
    return counts.withColumn("share", F.when(F.col("category").isNotNull(), F.col("patches") / known)).withColumn("mean_distance", mean).drop("_far")
