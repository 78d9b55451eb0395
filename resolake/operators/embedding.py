"""Two-dimensional embedding of points by t-SNE: perplexities by bisection, gradients by blocks of rows in Spark tasks.

No task or table holds all pairs: a task makes the affinities of its rows anew
from the points, in every round. The driver holds the points, their widths and
the embedding, so their number is bounded by MAX_POINTS; work is quadratic in it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: More points are an error: a sample, or their groups' means, can be embedded instead.
MAX_POINTS = 50_000
#: Cells of rows by points that a task works on together.
CELLS = 1 << 21


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1), 0)


def widths(d2: np.ndarray, own: np.ndarray, perplexity: float, steps: int = 60) -> np.ndarray:
    """For each row of squared distances, with its own column, the precision whose conditional distribution has the perplexity."""
    d2 = d2.copy()
    d2[np.arange(len(d2)), own] = np.inf
    d2 -= d2.min(1, keepdims=True)
    low, high, beta = np.zeros(len(d2)), np.full(len(d2), np.inf), np.ones(len(d2))
    for _ in range(steps):
        with np.errstate(invalid="ignore"):
            e = np.exp(-d2 * beta[:, None])
            sums = e.sum(1)
            entropy = np.log(sums) + beta * np.where(np.isinf(d2), 0, d2 * e).sum(1) / sums
        wide = entropy > np.log(perplexity)
        low, high = np.where(wide, beta, low), np.where(wide, high, beta)
        beta = np.where(np.isinf(high), beta * 2, (low + high) / 2)
    return beta


def log_norms(d2: np.ndarray, own: np.ndarray, beta: np.ndarray) -> np.ndarray:
    """Logarithms of the sums that make the rows' conditional distributions."""
    d2 = d2.copy()
    d2[np.arange(len(d2)), own] = np.inf
    least = d2.min(1)
    return np.log(np.exp(-(d2 - least[:, None]) * beta[:, None]).sum(1)) - beta * least


def conditionals(x: np.ndarray, rows: np.ndarray, beta: np.ndarray, norms: np.ndarray) -> np.ndarray:
    """Symmetric affinities of some rows with all points: the mean of both conditional probabilities, over the number of points."""
    d2 = _squares(x[rows], x)
    d2[np.arange(len(rows)), rows] = 0
    p = np.exp(np.minimum(-d2 * beta[rows, None] - norms[rows, None], 0)) + np.exp(np.minimum(-d2 * beta - norms, 0))
    p[np.arange(len(rows)), rows] = 0
    return p / (2 * len(x))


def forces(p: np.ndarray, y: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """(rows, 6): attraction (2), repulsion before division by the total (2), the rows' parts of that total, and of sum p ln(p / numerator)."""
    near = 1 / (1 + _squares(y[rows], y))
    near[np.arange(len(rows)), rows] = 0
    pull, push = p * near, near * near
    along = lambda w: w.sum(1, keepdims=True) * y[rows] - w @ y
    with np.errstate(divide="ignore", invalid="ignore"):
        cost = np.where(p > 0, p * np.log(p / near), 0).sum(1)
    return np.column_stack([along(pull), along(push), near.sum(1), cost])


def gradient(found: np.ndarray) -> tuple[float, np.ndarray]:
    """Kullback-Leibler divergence and its gradient from the forces of all rows."""
    total = found[:, 4].sum()
    return float(found[:, 5].sum() + np.log(total)), 4 * (found[:, :2] - found[:, 2:4] / total)


def _by_rows(spark: SparkSession, n: int, make: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """make(rows) for blocks of rows in tasks; a few numbers a row come back."""
    size = max(1, min(CELLS // n, -(-n // spark.sparkContext.defaultParallelism)))
    blocks = -(-n // size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.column(0).to_pylist():
                found = make(np.arange(block * size, min((block + 1) * size, n)))
                yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([found.astype(float).tobytes()], pa.binary())], names=["block", "found"])

    rows = spark.range(0, blocks, 1, blocks).mapInArrow(run, "block long, found binary").collect()
    return np.concatenate([np.frombuffer(r["found"]).reshape(min(size, n - r["block"] * size), -1) for r in sorted(rows)])


def tsne(points: DataFrame, perplexity: float = 30.0, rounds: int = 300, exaggeration: float = 12.0, name: str = "name", x: str = "x") -> DataFrame:
    """(name, a, b): t-SNE of points (name, x: array of numbers, all of one length), from their first principal components.

    The perplexity is a third of the other points at most. Points come in order
    of name, so that ties and signs don't depend on partitions; names must
    differ, and points that are null or hold nulls are left out. The first
    quarter of the rounds exaggerates affinities. Up to two points lie apart on
    one axis.
    """
    spark, kind = points.sparkSession, points.schema[name].dataType.simpleString()
    good = points.where(F.col(name).isNotNull() & F.coalesce(F.forall(x, lambda v: v.isNotNull()), F.lit(False))).select(name, x)
    rows = sorted(good.limit(MAX_POINTS + 1).collect())
    if len(rows) > MAX_POINTS:
        raise ValueError(f"more than {MAX_POINTS} points")
    names, schema = [r[0] for r in rows], f"`{name}` {kind}, a double, b double"
    n = len(rows)
    if n < 3:
        return spark.createDataFrame([(m, float(k), 0.0) for k, m in enumerate(names)], schema)
    points_ = np.array([r[1] for r in rows], float)
    points_ -= points_.mean(0)
    shared = spark.sparkContext.broadcast(points_)
    wanted = min(perplexity, (n - 1) / 3)

    def width(rows: np.ndarray) -> np.ndarray:
        d2 = _squares(shared.value[rows], shared.value)
        beta = widths(d2, rows, wanted)
        return np.column_stack([beta, log_norms(d2, rows, beta)])

    beta, norms = _by_rows(spark, n, width).T
    u, s, _ = np.linalg.svd(points_, full_matrices=False)
    y = np.zeros((n, 2))
    y[:, : min(2, len(s))] = (u * s)[:, :2]
    y *= np.sign(y[np.abs(y).argmax(0), [0, 1]]) + (y == 0).all(0)
    y *= 1e-4 / max(y[:, 0].std(), 1e-300)
    speed, gains, early = np.zeros_like(y), np.ones_like(y), rounds // 4
    rate = max(n / exaggeration / 4, 5.0)
    for k in range(rounds):
        factor, at = exaggeration if k < early else 1.0, y
        found = _by_rows(spark, n, lambda rows: forces(factor * conditionals(shared.value, rows, beta, norms), at, rows))  # noqa: B023
        _, g = gradient(found)
        same = np.sign(g) == np.sign(speed)
        gains = np.maximum(np.where(same, gains * 0.8, gains + 0.2), 0.01)
        speed = (0.5 if k < early else 0.8) * speed - rate * gains * g
        y = y + speed
        y -= y.mean(0)
    shared.destroy()
    return spark.createDataFrame([(m, float(a), float(b)) for m, (a, b) in zip(names, y, strict=True)], schema)
