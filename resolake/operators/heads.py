"""Linear heads on given embeddings: softmax, ordinal and regression, by AdamW over gradients summed in Spark tasks.

An epoch deals the rows to mini-batches by hash; a step sums the gradient of
`accumulate` of them in tasks. The learning rate falls on a plateau of the
validation loss, and training stops early when it no longer improves.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import Scratch


@dataclass
class Head:
    """kind: softmax, ordinal or regression; weights (features, outputs), bias (outputs); epochs: rows of what training saw."""

    kind: str
    weights: np.ndarray
    bias: np.ndarray
    epochs: list[dict] = field(default_factory=list)

    def flat(self) -> np.ndarray:
        return np.concatenate([self.weights.ravel(), self.bias])


def outputs(kind: str, classes: int) -> int:
    """Ordinal heads have one output a threshold between neighbouring classes."""
    return {"softmax": classes, "ordinal": classes - 1, "regression": 1}[kind]


def loss_and_gradient(kind: str, x: np.ndarray, y: np.ndarray, w: np.ndarray, b: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Sums over rows of the loss, and its gradients: cross-entropy, binary cross-entropies of y > k, or squared error."""
    z = x @ w + b
    if kind == "regression":
        d = z[:, 0] - y
        loss, dz = float((d * d).sum()), 2 * d[:, None]
    elif kind == "ordinal":
        above = (y[:, None] > np.arange(z.shape[1])).astype(float)
        loss, dz = float((np.logaddexp(0, z) - above * z).sum()), 1 / (1 + np.exp(-np.clip(z, -500, 500))) - above
    else:
        top = z.max(1, keepdims=True)
        p = np.exp(z - top)
        total = p.sum(1, keepdims=True)
        rows, labels = np.arange(len(y)), y.astype(int)
        loss = float((np.log(total[:, 0]) + top[:, 0] - z[rows, labels]).sum())
        dz = p / total
        dz[rows, labels] -= 1
    return loss, x.T @ dz, dz.sum(0)


def decode(kind: str, z: np.ndarray) -> np.ndarray:
    """The class of highest score, the number of thresholds passed, or the value."""
    return z[:, 0] if kind == "regression" else (z > 0).sum(1).astype(float) if kind == "ordinal" else z.argmax(1).astype(float)


class AdamW:
    """Decoupled weight decay; biases do not decay."""

    def __init__(self, size: int, decays: np.ndarray, rate: float, decay: float, betas: tuple[float, float] = (0.9, 0.999)):
        self.m, self.v, self.t = np.zeros(size), np.zeros(size), 0
        self.decays, self.rate, self.decay, self.betas = decays, rate, decay, betas

    def step(self, w: np.ndarray, g: np.ndarray) -> np.ndarray:
        self.t += 1
        a, c = self.betas
        self.m, self.v = a * self.m + (1 - a) * g, c * self.v + (1 - c) * g * g
        move = (self.m / (1 - a**self.t)) / (np.sqrt(self.v / (1 - c**self.t)) + 1e-8)
        return w * (1 - self.rate * self.decay * self.decays) - self.rate * move


def _sums(rows: DataFrame, head: Head) -> tuple[int, float, np.ndarray]:
    """Rows, loss and gradient; a row a task and parameter is summed by Spark."""
    kind, w, b = head.kind, head.weights, head.bias

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(w.size + b.size + 2)
        for batch in batches:
            if batch.num_rows:
                x = np.asarray(batch.column(0).flatten()).reshape(batch.num_rows, -1)
                loss, gw, gb = loss_and_gradient(kind, x, np.asarray(batch.column(1)), w, b)
                total += np.concatenate([gw.ravel(), gb, [loss, batch.num_rows]])
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["cell", "v"])

    out = np.zeros(w.size + b.size + 2)
    for r in rows.select("x", "y").mapInArrow(run, "cell long, v double").groupBy("cell").agg(F.sum("v").alias("v")).collect():
        out[r["cell"]] = r["v"]
    return int(out[-1]), out[-2], out[:-2]


def early_stop(losses: list[float], patience: int, least_gain: float = 1e-3) -> int | None:
    """The epoch, from 0, at which training stops: `patience` epochs in a row without a gain of more than least_gain on the best."""
    best, waited = np.inf, 0
    for epoch, loss in enumerate(losses):
        if best - loss > least_gain:
            best, waited = loss, 0
        else:
            waited += 1
            if waited >= patience:
                return epoch
    return None


def train_head(df: DataFrame, x: str, y: str, row: list[str], kind: str, classes: int = 0, epochs: int = 20, batches: int = 8, accumulate: int = 1, rate: float = 0.05, decay: float = 0.01, patience: int = 3, plateau: int = 2, factor: float = 0.5, valid_percent: int = 20, seed: int = 42) -> Head:
    """A head on embeddings x (arrays of one length) and labels y (classes from 0, or values), rows told apart by `row`.

    Rows go to validation and to mini-batches by hash, so no partitioning changes
    the split. `batches` mini-batches make an epoch; the order of batches turns
    with the epoch. Rows with nulls are left out; no rows give a head of zeros.
    The head of the best validation loss is returned.
    """
    good = df.where(F.col(y).isNotNull() & F.coalesce(F.forall(x, lambda v: v.isNotNull()), F.lit(False)))
    part = F.pmod(F.xxhash64(F.lit(seed), *row), F.lit(100))
    batch = F.pmod(F.xxhash64(F.lit(seed + 1), *row), F.lit(batches)).cast("int")
    rows = good.select(F.transform(x, lambda v: v.cast("double")).alias("x"), F.col(y).cast("double").alias("y"), F.when(part < valid_percent, -1).otherwise(batch).alias("batch"))
    with Scratch(df.sparkSession) as scratch:
        table = scratch.folder()
        rows.write.partitionBy("batch").parquet(table)  # a step reads its own batches only
        stored = df.sparkSession.read.schema("x array<double>, y double, batch int").parquet(table)
        first = stored.first()
        width = len(first["x"]) if first else 0
        k = outputs(kind, classes)
        head = best = Head(kind, np.zeros((width, k)), np.zeros(k))
        if not width:
            return head
        decays = np.concatenate([np.ones(width * k), np.zeros(k)])
        adam, log, lowest, since = AdamW(width * k + k, decays, rate, decay), [], np.inf, 0
        for epoch in range(epochs):
            seen, loss = 0, 0.0
            for at in range(0, batches, accumulate):
                some = [(at + n + epoch) % batches for n in range(min(accumulate, batches - at))]
                n, own, g = _sums(stored.where(F.col("batch").isin(some)), head)
                if n:
                    w = adam.step(head.flat(), g / n)
                    head = Head(kind, w[: width * k].reshape(width, k), w[width * k :])
                    seen, loss = seen + n, loss + own
            n, own, _ = _sums(stored.where("batch = -1"), head)
            train = float(loss) / max(seen, 1)
            log.append({"epoch": epoch, "train_loss": train, "valid_loss": float(own) / n if n else train, "rate": adam.rate})
            if log[-1]["valid_loss"] < lowest:
                lowest, best, since = log[-1]["valid_loss"], head, 0
            else:
                since += 1
                if since > plateau:
                    adam.rate, since = adam.rate * factor, 0
            if early_stop([e["valid_loss"] for e in log], patience) is not None:
                break
    return Head(kind, best.weights, best.bias, log)


def predict(df: DataFrame, head: Head, x: str) -> DataFrame:
    """All columns and `predicted`; null where x is null or holds nulls. Sums over components in the JVM."""
    score = lambda c: F.aggregate(F.zip_with(x, F.array(*[F.lit(float(v)) for v in head.weights[:, c]]), lambda a, b: a.cast("double") * b), F.lit(float(head.bias[c])), lambda a, v: a + v)
    scores = [score(c) for c in range(head.weights.shape[1])]
    if head.kind == "regression":
        found = scores[0]
    elif head.kind == "ordinal":
        found = sum(((s > 0).cast("double") for s in scores), F.lit(0.0))
    else:
        found = F.array_position(F.array(*scores), F.array_max(F.array(*scores))).cast("double") - 1
    return df.withColumn("predicted", F.when(F.coalesce(F.forall(x, lambda v: v.isNotNull()), F.lit(False)), found))
