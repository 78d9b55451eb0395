"""Text quality by a linear SVM over n-gram indicators scaled by naive Bayes log-count ratios.

Features are indicators of n-grams (1 to 3) of token shapes: a token's letter
case, a length class and its last punctuation marks, and whether it repeats the
token before it. Shapes carry over to vocabularies and languages that the
labelled rows don't show. Labels, language, source and ids never enter a score.

Contract for odd input
----------------------
Null text counts as empty; empty texts get the score of their (boundary)
features. Labels that are null or not 0 or 1 count for nothing, and an id that is
labelled both 0 and 1 is not learned from. Of texts that share a labelled id, the
one whose features come first in byte order is learned from. Rows that repeat an
id, or have none, are each scored. Training data without
both classes gives every text the score of the only class seen (1.0 if there
are no labels at all). Extra columns are not read, and may have any name: score
gets an underscore where a column that is carried along is called so. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import free_name, mix64, quoted
from .pretoken import texts_of

#: At most so many labelled rows are learned from, the first by hash of their id.
MAX_TRAIN_ROWS = 20_000
BITS = 18
GRAMS = 3
_TAIL = re.compile(r"[^\w\s]+$")
#: Tokens that a worker keeps the shapes of, each of at most so many characters.
_CACHE_TOKENS, _CACHE_CHARS = 120_000, 48


def shape(token: str) -> str:
    """Case class, length class and trailing marks of a token."""
    tail = _TAIL.search(token)
    core = token[: tail.start()] if tail else token
    letters = [c for c in core if c.isalpha()]
    if not core:
        case = "symbol"
    elif not letters:
        case = "digit" if any(c.isdigit() for c in core) else "other"
    elif all(c.isupper() for c in letters):
        case = "upper" if len(letters) > 1 else "initial"
    elif all(c.islower() for c in letters):
        case = "lower"
    else:
        case = "title" if core[0].isupper() and sum(c.isupper() for c in letters) == 1 else "mixed"
    size = 0 if len(core) < 4 else 1 if len(core) < 12 else 2 if len(core) < 30 else 3
    return f"{case} {size} {tail.group()[-3:] if tail else ''}"


class _Shapes(dict):
    def __missing__(self, token: str) -> int:
        value = xxhash.xxh3_64_intdigest(shape(token))
        if len(self) < _CACHE_TOKENS and len(token) <= _CACHE_CHARS:  # what comes first is commonest
            self[token] = value
        return value


_shapes = _Shapes()
_EDGE = np.array([xxhash.xxh3_64_intdigest("<edge>")], np.uint64)


def features(text: str | None) -> np.ndarray:
    """Sorted distinct feature numbers of a whole text."""
    tokens = (text or "").split()
    with np.errstate(over="ignore"):
        s = np.fromiter(map(_shapes.__getitem__, tokens), np.uint64, len(tokens))
        if len(tokens) > 1:
            same = np.fromiter(map(str.__eq__, tokens[1:], tokens), bool, len(tokens) - 1)
            s[1:][same] = mix64(s[1:][same] + np.uint64(77))
        s = np.concatenate([_EDGE, s, _EDGE])
        grams, h = [], np.zeros(len(s), np.uint64)
        for n in range(1, min(GRAMS, len(s)) + 1):
            h = mix64(h[: len(s) - n + 1] * np.uint64(3) + s[n - 1 :] + np.uint64(n))
            grams.append(np.unique(h))
    return np.unique(np.concatenate(grams) >> np.uint64(64 - BITS)).astype(np.int64)


@dataclass
class NbSvm:
    """weights: by feature, already times its log-count ratio; offset and slope turn a margin into a probability."""

    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def score(self, found: np.ndarray) -> float:
        margin = self.weights[found].sum() / np.sqrt(max(len(found), 1)) + self.bias
        return float(1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -500, 500))))


def _dual_descent(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, size: int, c: float, epochs: int, tolerance: float = 1e-3) -> np.ndarray:
    """Hinge-loss SVM weights (bias last) by dual coordinate descent, one example's dual variable at a time."""
    w, alpha = np.zeros(size + 1), np.zeros(len(rows))
    norms = np.array([v @ v + 1 for v in values])
    rng = np.random.default_rng(7)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            at, v = rows[i], values[i]
            gradient = y[i] * (w[at] @ v + w[-1]) - 1
            new = min(max(alpha[i] - gradient / norms[i], 0.0), c)
            step = new - alpha[i]
            if step:
                alpha[i] = new
                w[at] += step * y[i] * v
                w[-1] += step * y[i]
                moved = max(moved, abs(step))
        if moved < tolerance * c:
            break
    return w


def _calibrate(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve over margins (Newton steps, smoothed targets)."""
    pos, neg = (y > 0).sum(), (y < 0).sum()
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        g = np.array([((p - t) * margins).sum(), (p - t).sum()]) + np.array([1e-3 * a, 0])
        k = p * (1 - p)
        h = np.array([[(k * margins * margins).sum() + 1e-3, (k * margins).sum()], [(k * margins).sum(), k.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-6:
            break
    return float(a), float(b)


def _weights(found: list[np.ndarray], y: np.ndarray, which: np.ndarray, smooth: float, c: float, blend: float, epochs: int) -> np.ndarray:
    """Weights by feature and the bias, learned from the rows `which`."""
    size = 1 << BITS
    p, q = np.full(size, smooth), np.full(size, smooth)
    for i in which:
        (p if y[i] > 0 else q)[found[i]] += 1
    ratio = np.log(p / p.sum()) - np.log(q / q.sum())
    values = [ratio[found[i]] / np.sqrt(max(len(found[i]), 1)) for i in which]
    w = _dual_descent([found[i] for i in which], values, y[which], size, c, epochs)
    mean = np.abs(w[:-1]).mean()
    return np.append(((1 - blend) * mean + blend * w[:-1]) * ratio, w[-1] * blend)


def _margins(w: np.ndarray, found: list[np.ndarray]) -> np.ndarray:
    return np.array([w[x].sum() / np.sqrt(max(len(x), 1)) + w[-1] for x in found])


def _part(found: list[np.ndarray], y: np.ndarray, f: int, folds: int, params: tuple) -> np.ndarray:
    """Part f of the work: margins of fold f under a model of the others, or, after the last fold, the model of all rows."""
    fold, every = np.arange(len(y)) % folds, np.arange(len(y))
    rest = np.flatnonzero(fold != f)
    w = _weights(found, y, rest if len(set(y[rest])) == 2 else every, *params)
    return w if f == folds else _margins(w, [found[i] for i in np.flatnonzero(fold == f)])


def _in_turn(part: Callable[[int], np.ndarray], n: int) -> list[np.ndarray]:
    return [part(f) for f in range(n)]


def fit(found: list[np.ndarray], labels: np.ndarray, smooth: float = 1.0, c: float = 1.0, blend: float = 0.25, epochs: int = 20, folds: int = 5, run_parts: Callable = _in_turn) -> NbSvm:
    """Learn from feature rows and 0/1 labels; margins are calibrated on rows of folds that their model had no part in.

    run_parts(part, n) computes part(0), ..., part(n - 1), which don't depend on each other.
    """
    if len(labels) == 0 or labels.min() == labels.max():
        only = 1.0 if len(labels) == 0 or labels[0] == 1 else 0.0
        return NbSvm(np.zeros(1 << BITS), 0.0, 0.0, 30.0 if only else -30.0)
    y = np.where(labels == 1, 1.0, -1.0)
    *by_fold, w = run_parts(lambda f: _part(found, y, f, folds, (smooth, c, blend, epochs)), folds + 1)
    fold, margins = np.arange(len(y)) % folds, np.zeros(len(y))
    for f, own in enumerate(by_fold):
        margins[fold == f] = own
    slope, offset = _calibrate(margins, y)
    return NbSvm(w[:-1], float(w[-1]), slope, offset)


def _in_tasks(spark: SparkSession) -> Callable:
    """Each part in a Spark task of its own; the bounded training rows go to the workers once."""

    def run_parts(part: Callable[[int], np.ndarray], n: int) -> list[np.ndarray]:
        shared = spark.sparkContext.broadcast(cloudpickle.dumps(part))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for f in batch.column(0).to_pylist():
                    yield pa.RecordBatch.from_arrays([pa.array([f]), pa.array([cloudpickle.loads(shared.value)(f).tobytes()], pa.binary())], names=["f", "result"])

        rows = spark.range(0, n, 1, n).mapInArrow(run, "f long, result binary").collect()
        shared.destroy()
        return [np.frombuffer(row["result"], np.float64) for row in sorted(rows)]

    return run_parts


def _feature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [features(t).astype(np.int32).tobytes() for t in texts_of(batch.column(1))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found, pa.binary())], names=["doc_id", "label", "found"])


def train_quality(docs: DataFrame, labels: DataFrame, usable: Column, max_rows: int = MAX_TRAIN_ROWS) -> NbSvm:
    """Fit on labelled documents for which `usable` (over doc_id) holds, at most max_rows of them by hash of the id.

    Features are made by tasks, and so are the folds' models; only the bounded sample's feature numbers, a row an id, reach the driver.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label")).where(F.col("label").isin(0, 1) & usable)
    agreed = known.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("other")).where("doc_id is not null and label = other")
    sample = agreed.select("doc_id", "label").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id").select("doc_id", "text", "label")
    found = texts.mapInArrow(_feature_batches, "doc_id long, label int, found binary")
    rows = found.groupBy("doc_id").agg(F.min("label").alias("label"), F.min("found").alias("found")).select("label", "found").collect()  # a row an id of the sample
    rows.sort(key=lambda row: (xxhash.xxh3_64_intdigest(row["found"]), row["label"]))
    return fit([np.frombuffer(row["found"], np.int32) for row in rows], np.array([row["label"] for row in rows], np.int64), run_parts=_in_tasks(docs.sparkSession))


def _score_batches(model, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model.value
        for batch in batches:
            scores = [own.score(features(t)) for t in texts_of(batch.column(0))]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(1, batch.num_columns)), pa.array(scores, pa.float64())], names=[*batch.schema.names[1:], name])

    return run


def score_quality(docs: DataFrame, model: NbSvm, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns `keep` and score, for every row; the model, of fixed size, goes to every worker once."""
    carried = docs.select(*[F.col(quoted(c)) for c in keep])
    text, score = free_name(carried, "text_in"), free_name(carried, "score")
    schema = StructType([*carried.schema.fields, StructField(score, DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(F.col(quoted(text_col)).alias(text), *[F.col(quoted(c)) for c in keep]).mapInArrow(_score_batches(shared, score), schema)


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from learning: crc32 of its id as text is divisible by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def quality_report(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted for every document."""
    model = train_quality(docs, labels, ~held_out(F.col("doc_id")))
    scored = score_quality(docs, model, ["doc_id"])
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
