"""Conditional random fields: gradients, optimiser, decoding, and a planted task that neighbours decide."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from resolake.operators import crf as C
from resolake.operators import estimators
from resolake.operators.minimise import Minimiser


def batch(rng, lengths, features, labels, k=2):
    lengths = np.array(sorted(lengths, reverse=True))
    n = lengths[0]
    inside = np.arange(n) < lengths[:, None]
    x = np.where(inside[..., None], rng.integers(0, features + 1, (len(lengths), n, k)), features)
    return C._Batch(x, np.where(inside[..., None], rng.normal(size=x.shape), 0.0), np.where(inside, rng.integers(0, labels, inside.shape), -1), lengths, np.arange(len(lengths)))


def path_score(b, row, y, unary, transitions):
    padded = np.vstack([unary, np.zeros(unary.shape[1])])
    s = sum((padded[b.x[row, t], y[t]] * b.v[row, t]).sum() for t in range(len(y)))
    return s + sum(transitions[a, c] for a, c in itertools.pairwise(y))


def test_loss_is_that_of_all_paths_and_gradients_are_finite_differences():
    rng = np.random.default_rng(1)
    b = batch(rng, [4, 1, 3], 5, 3)
    w = rng.normal(size=5 * 3 + 9)
    split = lambda w: (w[:15].reshape(5, 3), w[15:].reshape(3, 3))
    loss, u, t = C.loss_and_gradient(b, *split(w))
    want, best = 0.0, C.viterbi(b, *split(w))
    for row, n in enumerate(b.lengths):
        paths = list(itertools.product(range(3), repeat=int(n)))
        scores = np.array([path_score(b, row, p, *split(w)) for p in paths])
        want += np.log(np.exp(scores).sum()) - path_score(b, row, b.y[row, :n], *split(w))
        assert tuple(best[row, :n]) == paths[scores.argmax()]
    assert loss == pytest.approx(want)
    g = np.concatenate([u.ravel(), t.ravel()])
    for c in range(len(w)):
        e = np.zeros(len(w))
        e[c] = 1e-5
        assert g[c] == pytest.approx((C.loss_and_gradient(b, *split(w + e))[0] - C.loss_and_gradient(b, *split(w - e))[0]) / 2e-5, abs=1e-6)


@pytest.mark.parametrize("scale", [1.0, 12.0, 400.0])
def test_many_points_at_once_equal_single_ones(scale):
    """Losses and gradients by probabilities equal those by their logarithms, to which very large weights go back; lengths differ."""
    rng = np.random.default_rng(6)
    b = batch(rng, [7, 1, 1, 300, 12, 7], 6, 4, 3)
    unary, transitions = rng.normal(size=(5, 6, 4)) * scale, rng.normal(size=(5, 4, 4)) * scale
    got = C.losses_and_gradients(b, unary, transitions)
    for n in range(5):
        for mine, want in zip(got, C.loss_and_gradient(b, unary[n], transitions[n]), strict=True):
            assert mine[n] == pytest.approx(want, rel=1e-9, abs=1e-7)


@pytest.mark.parametrize("c1", [0.0, 0.5, 4.0])
def test_minimiser_finds_the_least(c1):
    """A quadratic whose least point is known by coordinate: soft thresholds."""
    rng = np.random.default_rng(2)
    scale, at = rng.uniform(0.5, 20, 30), rng.normal(size=30)
    m = Minimiser(30, c1, tolerance=1e-8)
    for _ in range(300):
        if m.done:
            break
        m.tell(float((scale * (m.trial - at) ** 2).sum() / 2), scale * (m.trial - at))
    want = np.sign(at) * np.maximum(np.abs(at) - c1 / scale, 0)
    assert m.x == pytest.approx(want, abs=1e-5)
    assert (m.x[want == 0] == 0).all()


def chains(spark, n, seed):
    """Hidden states that rarely change, each position's letter right in six of ten cases."""
    rng = np.random.default_rng(seed)
    rows = []
    for name in range(n):
        state = int(rng.integers(3))
        for i in range(int(rng.integers(1, 60))):
            state = int(rng.integers(3)) if rng.random() < 0.08 else state
            rows.append((name, i, "abc"[state if rng.random() < 0.6 else int(rng.integers(3))], float(i % 3), state))
    return spark.createDataFrame(rows, "name long, i int, cat string, x double, label int").repartition(4)


def test_chains_beat_position_models(spark):
    train, test = chains(spark, 120, 3), chains(spark, 60, 4)
    grid = [(0.01, 0.01), (0.0, 1.0), (1000.0, 0.1)]
    models = C.fit_grid(train, "label", ["cat"], ["x"], grid, rounds=60)
    got = C.predict(test, models, "label", ["cat"], ["x"])
    accuracy = {r.model: r.a for r in got.groupBy("model").agg(F.avg((F.col("label") == F.col("predicted")).cast("int")).alias("a")).collect()}
    assert got.count() == 3 * test.count()
    plain = estimators.feature_pipeline(["x"], ["cat"], estimators.logistic()).fit(train).transform(test)
    logistic = plain.agg(F.avg((F.col("prediction") == F.col("label")).cast("int"))).first()[0]
    assert accuracy[0] > logistic + 0.08 and accuracy[1] > logistic + 0.08
    assert (models[2].weights() == 0).mean() > 0.8  # the L1 part empties the model
    again = C.fit_grid(train.repartition(2), "label", ["cat"], ["x"], grid[1:2], rounds=60)
    assert again[0].weights() == pytest.approx(models[1].weights(), abs=1e-2)


def test_odd_sequences(spark):
    rows = [("a", 0, "x", None, "1"), ("a", 1, None, 2.0, "0"), ("b", 0, "y", 1.0, None), ("c", 5, "x", 0.0, "1")]
    df = spark.createDataFrame(rows, "name string, i int, cat string, v double, label string")
    (model,) = C.fit_grid(df, "label", ["cat"], ["v"], [(0.0, 0.1)])
    assert model.labels == ["0", "1"] and "cat=" in model.features and "cat=y" not in model.features
    got = {(r.name, r.i): (r.label, r.predicted) for r in C.predict(df, [model], "label", ["cat"], ["v"]).collect()}
    assert got["a", 0] == ("1", "1") and got["b", 0][0] is None and set(got) == {("a", 0), ("a", 1), ("b", 0), ("c", 5)}
    assert C.predict(df.limit(0), [model], "label", ["cat"], ["v"]).count() == 0
    (empty,) = C.fit_grid(df.limit(0), "label", ["cat"], ["v"], [(0.0, 0.1)])
    assert empty.labels == [] and len(empty.weights()) == 0
