"""Grid search of logistic regression: all points and folds advance together, a pass over the rows for each round.

Iteration limits and tolerances share a path: a point's model is where the path
of its penalty, C and class weights first meets its tolerance or limit.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import Scratch
from .minimise import Minimiser

#: The grid of the original analysis: 360 points.
FULL_GRID = {"max_iter": [100, 200, 300, 400, 500], "c": [0.001, 0.01, 0.1, 1.0, 10.0, 100.0], "penalty": ["l1", "l2"], "tol": [1e-4, 1e-3, 1e-2], "balanced": [True, False]}
#: Points that a pass evaluates where fewer paths than that are open: the open ones' next halvings of the step go along, up to MOST_TRIALS each.
WIDTH, MOST_TRIALS = 48, 12
#: Bytes of rows that are stored and worked on together: small enough for the processor's cache and for readers that take thousands of rows at once.
BLOCK = 1 << 15
#: Rows times points of a step; larger arrays get fresh pages from the system each time.
TOGETHER = 1 << 14
_FIELDS = "max_iter int, c double, penalty string, tol double, balanced boolean"


def _packed(rows: DataFrame) -> DataFrame:
    """(width, block): (fold, y, x) as blocks of some hundred rows, each of `width` doubles, x first, then y and fold; passes read them without unpacking arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.asarray(batch.column(2).flatten()).reshape(batch.num_rows, -1)
                all_ = np.column_stack([x, np.asarray(batch.column(1)), np.asarray(batch.column(0))])
                each = max(1, BLOCK // (8 * all_.shape[1]))
                blocks = [all_[k : k + each].tobytes() for k in range(0, len(all_), each)]
                yield pa.RecordBatch.from_arrays([pa.array([all_.shape[1]] * len(blocks), pa.int32()), pa.array(blocks, pa.binary())], names=["width", "block"])

    return rows.mapInArrow(run, "width int, block binary")


def _summed(blocks: DataFrame, make, shape: tuple[int, int]) -> np.ndarray:
    """Sum over tasks of make(x, y, fold), a matrix of `shape`; Spark adds it up by cell, of which the driver gets one row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, each = np.zeros(shape), max(16, TOGETHER // shape[0])
        for batch in batches:
            for width, block in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = np.frombuffer(block.as_buffer()).reshape(-1, width)
                for k in range(0, len(rows), each):
                    part = rows[k : k + each]
                    total += make(part[:, :-2], part[:, -2], part[:, -1])
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total.ravel()[some])], names=["cell", "v"])

    out = np.zeros(shape[0] * shape[1])
    for r in blocks.mapInArrow(run, "cell long, v double").groupBy("cell").agg(F.sum("v").alias("v")).collect():
        out[r["cell"]] = r["v"]
    return out.reshape(shape)


def _scaled(features: DataFrame, vector: str, label: str, fold: Column) -> DataFrame:
    """(fold, y, x): x has mean 0 and deviation 1 over all rows and ends with 1 for the intercept; y is -1 or 1."""
    stats = features.select(Summarizer.metrics("mean", "std").summary(F.col(vector)).alias("s")).select(vector_to_array("s.mean").alias("m"), vector_to_array("s.std").alias("d"))
    z = F.zip_with(F.zip_with("x", "m", lambda v, m: v - m), "d", lambda v, d: F.when(d > 0, v / d).otherwise(0.0))
    rows = features.select(fold.cast("int").alias("fold"), F.when(F.col(label) == 1, 1.0).otherwise(-1.0).alias("y"), vector_to_array(vector).alias("x"))
    return rows.crossJoin(F.broadcast(stats)).select("fold", "y", F.concat(z, F.array(F.lit(1.0))).alias("x"))  # one row of statistics


def logistic_grid(features: DataFrame, vector: str, label: str, row: list[str], grid: dict[str, list] | None = None, folds: int = 5, seed: int = 42) -> DataFrame:
    """(max_iter, c, penalty, tol, balanced, accuracy, iterations): mean held-out accuracy of each grid point over the folds.

    features: a vector column and a 0/1 label, both known; `row` names columns
    that tell rows apart, whose hash deals rows to folds. The loss is C times the
    weighted logistic loss with |w| (l1) or w^2 / 2 (l2), the intercept with the
    others. A path ends at a slope of `tol` times its first, or after max_iter
    steps. No rows: no points.
    """
    grid = grid or FULL_GRID
    points = [dict(zip(grid, p, strict=True)) for p in product(*grid.values())]
    spark = features.sparkSession
    schema = f"{_FIELDS}, accuracy double, iterations double"
    with Scratch(spark) as scratch:
        rows = scratch.table(_packed(_scaled(features, vector, label, F.pmod(F.xxhash64(F.lit(seed), *row), F.lit(folds)))))
        one = rows.first()
        if one is None:
            return spark.createDataFrame([], schema)
        size, sides = one["width"] - 2, np.array([-1.0, 1.0])
        sums = _summed(rows, lambda x, y, fold: ((fold == np.arange(folds)[:, None])[:, None] & (y == sides[:, None])).sum(-1, dtype=float), (folds, 2))
        counts = {(fold, y): sums[fold, k] for fold in range(folds) for k, y in enumerate((-1.0, 1.0))}
        kinds = sorted({(p["c"], p["penalty"], p["balanced"]) for p in points})
        paths = [(*kind, fold) for kind in kinds for fold in range(folds)]
        weights = np.ones((len(paths), 2))  # of the classes -1 and 1
        for n, (c, _, balanced, fold) in enumerate(paths):
            of = [sum(v for (f, y), v in counts.items() if f != fold and y == side) for side in (-1.0, 1.0)]
            weights[n] = [sum(of) / (2 * max(k, 1)) if balanced else 1.0 for k in of]
            weights[n] *= c
        searches = [Minimiser(size, 1.0 if kind[1] == "l1" else 0.0, tolerance=0.0) for kind in paths]
        tols, limits = sorted(set(grid["tol"]), reverse=True), sorted(set(grid["max_iter"]))
        first: list[float | None] = [None] * len(paths)
        found: list[dict] = [{} for _ in paths]  # by ("tol", t) or ("max_iter", m): steps and weights
        folds_of = np.array([p[3] for p in paths])
        while any(not m.done for m in searches):
            live = [n for n, m in enumerate(searches) if not m.done]
            trials = [(n, t) for n in live for t in searches[n].trials(min(MOST_TRIALS, max(1, WIDTH // len(live))))]
            of = [n for n, _ in trials]
            w, cost, out = np.array([t for _, t in trials]), weights[of], folds_of[of]

            def step(x, y, fold, w=w, cost=cost, out=out):
                margin = (x @ w.T) * y[:, None]
                use = np.where(y[:, None] > 0, cost[:, 1], cost[:, 0]) * (fold[:, None] != out)
                small = np.exp(-np.abs(margin))
                pull = np.where(margin > 0, small, 1.0) / (1 + small) * (use * -y[:, None])
                return np.column_stack([(use * (np.log(1 + small) - np.minimum(margin, 0))).sum(0), pull.T @ x])

            sums = _summed(rows, step, (len(trials), size + 1))
            taken = {n: searches[n].steps for n in live if searches[n].value is not None}
            for n, total in zip(of, sums, strict=True):
                m, l2 = searches[n], 1.0 if paths[n][1] == "l2" else 0.0
                if m.done or m.steps > taken.get(n, 0):
                    continue  # an earlier trial was taken, or ended the path
                m.tell(total[0] + l2 * float(m.trial @ m.trial) / 2, total[1:] + l2 * m.trial)
                slope = float(np.linalg.norm(m.slope))
                first[n] = slope if first[n] is None else first[n]
                for t in tols:
                    if slope <= t * first[n]:
                        found[n].setdefault(("tol", t), (m.steps, m.x))
                for limit in limits:
                    if m.steps >= limit:
                        found[n].setdefault(("max_iter", limit), (m.steps, m.x))
                m.done |= ("tol", tols[-1]) in found[n] or ("max_iter", limits[-1]) in found[n]
        place, models = {}, []
        for p in points:
            for fold in range(folds):
                n = paths.index((p["c"], p["penalty"], p["balanced"], fold))
                ends = [found[n][k] for k in (("tol", p["tol"]), ("max_iter", p["max_iter"])) if k in found[n]]
                steps, w = min(ends, key=lambda e: e[0]) if ends else (searches[n].steps, searches[n].x)
                models.append(place.setdefault((n, steps), (len(place), w))[0])
        w, out = np.array([w for _, w in place.values()]), np.array([folds_of[n] for n, _ in place])

        def right(x, y, fold):
            return (((x @ w.T > 0) == (y[:, None] > 0)) & (fold[:, None] == out)).sum(0, dtype=float)[:, None]

        held = np.array([sum(v for (f, _), v in counts.items() if f == fold) for fold in range(folds)])
        share = _summed(rows, right, (len(w), 1))[:, 0] / np.maximum(held[out], 1)
    steps = np.array([s for _, s in place])
    result = []
    for k, p in enumerate(points):
        own = models[k * folds : (k + 1) * folds]
        known = [m for m in own if held[out[m]]]
        result.append((p["max_iter"], p["c"], p["penalty"], p["tol"], p["balanced"], float(np.mean(share[known])), float(np.mean(steps[own]))))
    return spark.createDataFrame(result, schema)
