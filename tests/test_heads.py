"""Linear heads: gradients by finite differences, optimiser and stopping rule, planted labels."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from resolake.operators import heads as H


@pytest.mark.parametrize("kind", ["softmax", "ordinal", "regression"])
def test_gradients_are_finite_differences(kind):
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(9, 4)), rng.integers(0, 3, 9).astype(float)
    k = H.outputs(kind, 3)
    w, b = rng.normal(size=(4, k)), rng.normal(size=k)
    _, gw, gb = H.loss_and_gradient(kind, x, y, w, b)
    value = lambda w, b: H.loss_and_gradient(kind, x, y, w, b)[0]
    for at in np.ndindex(w.shape):
        e = np.zeros_like(w)
        e[at] = 1e-6
        assert gw[at] == pytest.approx((value(w + e, b) - value(w - e, b)) / 2e-6, rel=1e-5, abs=1e-6)
    for c in range(k):
        e = np.zeros(k)
        e[c] = 1e-6
        assert gb[c] == pytest.approx((value(w, b + e) - value(w, b - e)) / 2e-6, rel=1e-5, abs=1e-6)


def test_adamw_first_steps():
    a = H.AdamW(2, np.array([1.0, 0.0]), 0.1, 0.5)
    w = a.step(np.array([2.0, 2.0]), np.array([4.0, -0.5]))
    assert w == pytest.approx([2 * 0.95 - 0.1, 2 + 0.1], abs=1e-6)


def test_early_stop_rule():
    assert H.early_stop([3, 2, 2.0005, 1.9995, 1.0], 3) is None
    assert H.early_stop([3, 2, 2.0005, 1.9995, 1.9992, 1.0], 3) == 4
    assert H.early_stop([], 3) is None


@pytest.mark.parametrize(("kind", "least"), [("softmax", 0.9), ("ordinal", 0.85), ("regression", 0.95)])
def test_heads_learn_planted_labels(spark, kind, least):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(900, 6))
    s = x @ [1.0, -2.0, 0.5, 0, 0, 0]
    y = s if kind == "regression" else np.digitize(s, [-1.0, 1.0]).astype(float) if kind == "ordinal" else (x @ rng.normal(size=(6, 3)) * 3).argmax(1).astype(float)
    rows = [(i, v.tolist(), float(c)) for i, (v, c) in enumerate(zip(x, y, strict=True))] + [(-1, None, 1.0), (-2, [None] * 6, 1.0), (-3, [1.0] * 6, None)]
    df = spark.createDataFrame(rows, "id int, x array<double>, y double").repartition(4)
    head = H.train_head(df, "x", "y", ["id"], kind, classes=3, epochs=25, batches=4, accumulate=2, rate=0.1)
    got = H.predict(df, head, "x")
    known = got.where("y is not null and predicted is not null")
    score = known.agg(F.corr("predicted", "y") if kind == "regression" else F.avg((F.col("predicted") == F.col("y")).cast("int"))).first()[0]
    assert score >= least
    assert got.where("id in (-1, -2) and predicted is not null").count() == 0
    losses = [e["valid_loss"] for e in head.epochs]
    assert losses[-1] < losses[0] and H.early_stop(losses[:-1], 3) is None
    if kind == "ordinal":
        again = H.train_head(df.repartition(2), "x", "y", ["id"], kind, classes=3, epochs=3, batches=4, accumulate=2, rate=0.1)
        assert [e["train_loss"] for e in again.epochs] == pytest.approx([e["train_loss"] for e in head.epochs[:3]])
        assert H.train_head(df.limit(0), "x", "y", ["id"], kind, classes=3).weights.size == 0
