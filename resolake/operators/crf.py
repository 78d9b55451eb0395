"""Linear-chain conditional random fields: gradients summed over Spark tasks, L-BFGS with L1 and L2 parts, Viterbi decoding.

A position has the same number of features, each a number in the model's
dictionary and a value: `column=text` with value 1 for categories, the column
with its value for numbers. What grows with the data stays in tasks; the driver
holds models (features times labels, and labels squared) and their gradients.
Many penalties are fitted side by side: one pass over the sequences serves the
next trial point of each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import Scratch
from .minimise import Minimiser

#: Features of a model; more are an error, as models are held by the driver and sent to every task.
MAX_FEATURES = 200_000
#: Positions of sequences that are worked on together.
TOGETHER = 1 << 15


@dataclass
class Crf:
    """unary: (features, labels); transitions: (from, to)."""

    features: list[str]
    labels: list[str]
    unary: np.ndarray
    transitions: np.ndarray

    def weights(self) -> np.ndarray:
        return np.concatenate([self.unary.ravel(), self.transitions.ravel()])


def _named(categorical: list[str], numeric: list[str]) -> Column:
    """A position's features: names and values."""
    one = [F.struct(F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit(""))).alias("f"), F.lit(1.0).alias("v")) for c in categorical]
    some = [F.struct(F.lit(c).alias("f"), F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias("v")) for c in numeric]
    return F.array(*one, *some)


def _sequences(df: DataFrame, label: str, categorical: list[str], numeric: list[str], name: str, i: str) -> DataFrame:
    """(name, i, labels, f, v) a sequence: positions in order, their labels, feature names and values one after another."""
    own = F.array_sort(F.collect_list(F.struct(F.col(i).cast("long").alias("i"), F.col(label).cast("string").alias("label"), _named(categorical, numeric).alias("x"))))
    flat = F.flatten("p.x")
    return df.groupBy(F.col(name).alias("name")).agg(own.alias("p")).select("name", F.col("p.i").alias("i"), F.col("p.label").alias("labels"), flat["f"].alias("f"), flat["v"].alias("v"))


@dataclass
class _Batch:
    """Sequences in falling order of length, padded: x (B, n, K) feature numbers, v their values, y labels (-1: none), lengths."""

    x: np.ndarray
    v: np.ndarray
    y: np.ndarray
    lengths: np.ndarray
    rows: np.ndarray


def _batches(batch: pa.RecordBatch, features: dict[str, int], labels: dict[str, int], k: int) -> Iterator[_Batch]:
    """Unknown features get the number after the last, which has no weight."""

    def numbers(column: pa.Array, known: dict[str, int], none: int) -> np.ndarray:
        coded = column.flatten().dictionary_encode()
        table = np.array([known.get(x, none) for x in coded.dictionary.to_pylist()] or [none], np.int64)
        return np.where(np.asarray(coded.indices.is_null()), none, table[np.asarray(coded.indices.fill_null(0))])

    y, x, v = numbers(batch.column(2), labels, -1), numbers(batch.column(3), features, len(features)), np.asarray(batch.column(4).flatten())
    lengths = np.asarray(batch.column(1).value_lengths()).astype(np.int64)
    starts = np.cumsum(lengths) - lengths
    order, at = np.argsort(-lengths, kind="stable"), 0
    while at < len(order):
        longest = int(lengths[order[at]])
        rows = order[at : at + max(1, TOGETHER // max(longest, 1))]
        at += len(rows)
        own = lengths[rows]
        inside = np.arange(longest) < own[:, None]
        place = np.where(inside, starts[rows][:, None] + np.arange(longest), 0)
        pick = lambda a, none: np.where(inside.reshape(inside.shape + (1,) * (a.ndim - 1)), a[place], none) if len(a) else np.full((len(rows), longest, *a.shape[1:]), none)  # noqa: B023, E731
        yield _Batch(pick(x.reshape(-1, k), len(features)), pick(v.reshape(-1, k), 0.0), pick(y, -1), own, rows)


def _log_sum(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(a - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def _scores(b: _Batch, unary: np.ndarray) -> np.ndarray:
    padded = np.vstack([unary, np.zeros((1, unary.shape[1]))])
    return (padded[b.x] * b.v[..., None]).sum(2)


def loss_and_gradient(b: _Batch, unary: np.ndarray, transitions: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Negative log-likelihood of the labels, and its gradients, by the forward-backward recursions. Every position must have a label."""
    s = _scores(b, unary)
    rows, n, _ = s.shape
    alpha, beta = np.empty_like(s), np.zeros_like(s)
    alpha[:, 0] = s[:, 0]
    live = [int((b.lengths > t).sum()) for t in range(n)]  # rows that reach a position come first
    for t in range(1, n):
        k = live[t]
        alpha[:k, t] = s[:k, t] + _log_sum(alpha[:k, t - 1, :, None] + transitions, 1)
    for t in range(n - 2, -1, -1):
        k = live[t + 1]
        beta[:k, t] = _log_sum(transitions + (s[:k, t + 1] + beta[:k, t + 1])[:, None, :], 2)
    last = alpha[np.arange(rows), b.lengths - 1]
    z = _log_sum(last, 1)
    inside = np.arange(n) < b.lengths[:, None]
    p = np.where(inside[..., None], np.exp(np.where(inside[..., None], alpha + beta - z[:, None, None], 0)), 0.0)
    y = np.maximum(b.y, 0)
    path = np.where(inside, np.take_along_axis(s, y[..., None], 2)[..., 0], 0.0).sum()
    diff = p.copy()
    at = np.nonzero(inside)
    diff[at[0], at[1], y[at]] -= 1
    g_unary = np.stack([np.bincount(b.x.ravel(), weights=(b.v * diff[..., c : c + 1]).ravel(), minlength=len(unary) + 1)[: len(unary)] for c in range(unary.shape[1])], 1)
    g_transitions = np.zeros_like(transitions)
    for t in range(1, n):
        k = live[t]
        pair = alpha[:k, t - 1, :, None] + transitions + (s[:k, t] + beta[:k, t])[:, None, :] - z[:k, None, None]
        g_transitions += np.exp(pair).sum(0)
    from_, to, both = y[:, :-1], y[:, 1:], inside[:, 1:]
    path += transitions[from_[both], to[both]].sum()
    np.add.at(g_transitions, (from_[both], to[both]), -1.0)
    return float(z.sum() - path), g_unary, g_transitions


#: Spread of a position's scores and of the transitions up to which losses of many points go by probabilities, not their logarithms.
_SPREAD = 250.0


def losses_and_gradients(b: _Batch, unary: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """loss_and_gradient at many points (points, features, labels), (points, from, to) at once: probabilities of a position sum to 1, the logarithms of their scales to the likelihood."""
    points, count, kinds = unary.shape
    rows, n, k = b.x.shape
    padded = np.concatenate([unary, np.zeros((points, 1, kinds))], 1).transpose(1, 0, 2).reshape(count + 1, -1)
    s = sum(padded[b.x[:, :, f].T] * b.v[:, :, f].T[..., None] for f in range(k)).reshape(n, rows, points, kinds).transpose(0, 2, 1, 3)
    top = s.max(3)
    if (top - s.min(3)).max(initial=0) > _SPREAD or (transitions.max() - transitions.min()) > _SPREAD:
        found = [loss_and_gradient(b, u, t) for u, t in zip(unary, transitions, strict=True)]
        return tuple(np.array(x) for x in zip(*found, strict=True))
    inside = np.arange(n)[:, None] < b.lengths
    live = inside.sum(1).tolist()  # rows that reach a position come first
    e = np.exp(s - top[..., None])
    high = transitions.max((1, 2))
    m = np.exp(transitions - high[:, None, None])
    back = m.transpose(0, 2, 1)
    alpha, beta, scale = np.zeros(e.shape), np.ones(e.shape), np.ones(top.shape)
    for t in range(n):
        own = e[t, :, : live[t]] if t == 0 else np.matmul(alpha[t - 1, :, : live[t]], m) * e[t, :, : live[t]]
        scale[t, :, : live[t]] = own.sum(2)
        alpha[t, :, : live[t]] = own / scale[t, :, : live[t], None]
    pairs = np.zeros(m.shape)
    for t in range(n - 1, 0, -1):
        r = live[t]
        next_ = e[t, :, :r] * beta[t, :, :r] / scale[t, :, :r, None]
        beta[t - 1, :, :r] = np.matmul(next_, back)
        pairs += np.matmul(alpha[t - 1, :, :r].transpose(0, 2, 1), next_)
    y = np.maximum(b.y, 0).T
    path = np.take_along_axis(s, np.broadcast_to(y[:, None, :, None], (n, points, rows, 1)), 3)[..., 0]
    loss = ((np.log(scale) + top - path) * inside[:, None]).sum((0, 2)) + high * np.maximum(b.lengths - 1, 0).sum()
    both = inside[1:]
    follow = np.bincount(y[:-1][both] * kinds + y[1:][both], minlength=kinds * kinds).reshape(kinds, kinds)
    at = np.nonzero(inside)
    diff = (alpha * beta)[at[0], :, at[1]]  # (positions, points, labels)
    diff[np.arange(len(diff)), :, y[at]] -= 1
    x, v, diff = b.x[at[1], at[0]], b.v[at[1], at[0]], diff.reshape(len(diff), -1).T.copy()
    sums = [sum(np.bincount(x[:, f], weights=v[:, f] * d, minlength=count + 1) for f in range(k))[:count] for d in diff]
    return loss - (transitions * follow).sum((1, 2)), np.stack(sums, 1).reshape(count, points, kinds).transpose(1, 0, 2), pairs * m - follow


def viterbi(b: _Batch, unary: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """Most probable labels (B, n); ties go to the smaller label."""
    s = _scores(b, unary)
    rows, n, _ = s.shape
    best, back = s[:, 0].copy(), np.zeros(s.shape, np.int64)
    for t in range(1, n):
        k = int((b.lengths > t).sum())
        step = best[:k, :, None] + transitions
        back[:k, t] = step.argmax(1)
        best[:k] = s[:k, t] + step.max(1)
    out = np.zeros((rows, n), np.int64)
    out[np.arange(rows), b.lengths - 1] = best.argmax(1)
    for t in range(n - 1, 0, -1):
        k = int((b.lengths > t).sum())
        out[:k, t - 1] = back[np.arange(k), t, out[:k, t]]
    return out


_CODED = "longest int, x binary, v binary, y binary, lengths binary"


def _coded(sequences: DataFrame, features: list[str], labels: list[str], k: int) -> DataFrame:
    """The sequences' batches with numbers for features and labels, so that passes need no names."""
    known, classes = {f: n for n, f in enumerate(features)}, {c: n for n, c in enumerate(labels)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in _batches(batch, known, classes, k):
                cells = [b.x.astype(np.int32), b.v.astype(float), b.y.astype(np.int32), b.lengths.astype(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array([b.x.shape[1]], pa.int32()), *[pa.array([c.tobytes()], pa.binary()) for c in cells]], names=["longest", "x", "v", "y", "lengths"])

    return sequences.mapInArrow(run, _CODED)


def _evaluate(coded: DataFrame, features: int, kinds: int, k: int, points: dict[int, np.ndarray]) -> dict[int, tuple[float, np.ndarray]]:
    """Loss and gradient at each point; tasks sum their own sequences, Spark sums tasks by weight."""
    size = features * kinds
    shared = coded.sparkSession.sparkContext.broadcast(points)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = np.array(list(shared.value.values()))
        unary, transitions, sums = w[:, :size].reshape(len(w), features, kinds), w[:, size:].reshape(len(w), kinds, kinds), np.zeros((len(w), w.shape[1] + 1))
        for batch in batches:
            for row in range(batch.num_rows):
                n, *cells = (batch.column(c)[row].as_py() for c in range(5))
                x, v, y, lengths = (np.frombuffer(c, t) for c, t in zip(cells, (np.int32, float, np.int32, np.int64), strict=True))
                b = _Batch(x.reshape(-1, n, k), v.reshape(-1, n, k), y.reshape(-1, n), lengths, np.arange(len(lengths)))
                loss, u, t = losses_and_gradients(b, unary, transitions)
                sums += np.concatenate([u.reshape(len(w), -1), t.reshape(len(w), -1), loss[:, None]], 1)
        for p, g in zip(shared.value, sums, strict=True):
            some = np.flatnonzero(g)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), p)), pa.array(some), pa.array(g[some])], names=["point", "weight", "g"])

    rows = coded.mapInArrow(run, "point long, weight long, g double").groupBy("point", "weight").agg(F.sum("g").alias("g")).collect()  # a row a weight
    shared.destroy()
    out = {p: np.zeros(len(w) + 1) for p, w in points.items()}
    for r in rows:
        out[r["point"]][r["weight"]] = r["g"]
    return {p: (g[-1], g[:-1]) for p, g in out.items()}


def fit_grid(df: DataFrame, label: str, categorical: list[str], numeric: list[str], grid: list[tuple[float, float]], rounds: int = 100, name: str = "name", i: str = "i") -> list[Crf]:
    """A model for each (c1, c2): the labels' likelihood less c1 |w| and c2 |w|^2, over the sequences in which every position has a label.

    rounds: passes over the sequences at most.
    """
    k = len(categorical) + len(numeric)
    with Scratch(df.sparkSession) as scratch:
        sequences = scratch.table(_sequences(df, label, categorical, numeric, name, i).where(~F.exists("labels", lambda x: x.isNull())))
        features = sorted(r[0] for r in sequences.select(F.explode("f")).distinct().limit(MAX_FEATURES + 1).collect())
        if len(features) > MAX_FEATURES:
            raise ValueError(f"more than {MAX_FEATURES} features")
        labels = sorted(r[0] for r in sequences.select(F.explode("labels")).distinct().collect())
        size = len(labels) * (len(features) + len(labels))
        coded = scratch.table(_coded(sequences, features, labels, k))
        searches = [Minimiser(size, c1) for c1, _ in grid]
        for _ in range(rounds):
            open_ = {n: m.trial for n, m in enumerate(searches) if not m.done}
            if not open_ or not size:
                break
            for n, (value, g) in _evaluate(coded, len(features), len(labels), k, open_).items():
                w, c2 = open_[n], grid[n][1]
                searches[n].tell(value + c2 * float(w @ w), g + 2 * c2 * w)
    cut = len(features) * len(labels)
    return [Crf(features, labels, m.x[:cut].reshape(len(features), len(labels)), m.x[cut:].reshape(len(labels), len(labels))) for m in searches]


def predict(df: DataFrame, models: list[Crf], label: str, categorical: list[str], numeric: list[str], name: str = "name", i: str = "i") -> DataFrame:
    """(model, name, i, label, predicted) of every position under each model, by its place in the list."""
    sequences = _sequences(df, label, categorical, numeric, name, i)
    shared, k = df.sparkSession.sparkContext.broadcast(models), len(categorical) + len(numeric)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for place, m in enumerate(shared.value):
                for b in _batches(batch, {f: n for n, f in enumerate(m.features)}, {c: n for n, c in enumerate(m.labels)}, k):
                    found = viterbi(b, m.unary, m.transitions)
                    inside = np.arange(found.shape[1]) < b.lengths[:, None]
                    own = batch.take(pa.array(b.rows))
                    names = own.column(0).take(pa.array(np.repeat(np.arange(len(b.rows)), b.lengths)))
                    chosen = pa.array(m.labels, pa.string()).take(pa.array(found[inside]))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(names), place, np.int32)), names, own.column(1).flatten(), own.column(2).flatten(), chosen], names=["model", "name", "i", "label", "predicted"])

    kind = sequences.schema["name"].dataType.simpleString()
    return sequences.mapInArrow(run, f"model int, name {kind}, i long, label string, predicted string")
