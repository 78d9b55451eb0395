"""All grid points in shared passes against their own fits."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from resolake.operators import grid as G
from resolake.operators.minimise import Minimiser


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 4)) * [1, 5, 0.2, 1] + [0, 3, 0, 0]
    y = (x @ [1.5, -0.2, 0, 0] + rng.logistic(size=400) > 0.3).astype(int)
    frame = spark.createDataFrame([(i, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(x, y, strict=True))], "id int, x array<double>, label int")
    return frame.select("id", array_to_vector("x").alias("v"), "label").repartition(3)


GRID = {"max_iter": [2, 100], "c": [0.001, 0.1, 10.0], "penalty": ["l1", "l2"], "tol": [1e-4, 1e-1], "balanced": [True, False]}


def plain(x, y, fold, k, c, penalty, weights):
    """The least loss by many small proximal steps."""
    train = fold != k
    x, y = x[train], y[train]
    cost = c * np.where(y > 0, weights[1], weights[0])
    w, step = np.zeros(x.shape[1]), 1 / (c * max(weights) * np.linalg.norm(x, 2) ** 2 / 4 + 1)
    for _ in range(4000):
        g = -(cost * y / (1 + np.exp(y * (x @ w)))) @ x + (w if penalty == "l2" else 0)
        w = w - step * g
        if penalty == "l1":
            w = np.sign(w) * np.maximum(np.abs(w) - step, 0)
    return w


def test_points_equal_their_own_fits(spark, rows):
    found = {tuple(r)[:5]: tuple(r)[5:] for r in G.logistic_grid(rows, "v", "label", ["id"], GRID).collect()}
    assert len(found) == 48
    for point in [(2, 0.1, "l1", 1e-4, True), (100, 10.0, "l2", 1e-4, False), (100, 0.1, "l1", 1e-1, False), (100, 0.001, "l2", 1e-1, True)]:
        single = {k: [v] for k, v in zip(GRID, point, strict=True)}
        (own,) = G.logistic_grid(rows, "v", "label", ["id"], single).collect()
        assert tuple(own)[5:] == pytest.approx(found[point])
    assert all(steps <= 2 for p, (_, steps) in found.items() if p[0] == 2)
    table = G._scaled(rows, "v", "label", F.pmod(F.xxhash64(F.lit(42), "id"), F.lit(5))).toPandas()
    x, y, fold = np.array(table["x"].tolist()), table["y"].to_numpy(), table["fold"].to_numpy()
    for c, penalty, balanced in [(0.1, "l1", True), (10.0, "l2", False), (0.1, "l2", True)]:
        shares = []
        for k in range(5):
            n = [((y == s) & (fold != k)).sum() for s in (-1, 1)]
            w = plain(x, y, fold, k, c, penalty, [sum(n) / (2 * m) if balanced else 1.0 for m in n])
            shares.append(((x[fold == k] @ w > 0) == (y[fold == k] > 0)).mean())
        assert found[100, c, penalty, 1e-4, balanced][0] == pytest.approx(np.mean(shares), abs=0.006)


def test_nothing_and_one_class(spark, rows):
    assert G.logistic_grid(rows.limit(0), "v", "label", ["id"], GRID).count() == 0
    one = {r.accuracy for r in G.logistic_grid(rows.where("label = 1"), "v", "label", ["id"], GRID | {"max_iter": [100], "tol": [1e-4], "c": [10.0]}).collect()}
    assert one == {1.0}


def test_halvings_of_a_step_share_a_pass():
    """A path told its next halvings together takes the same steps as one told each alone, in fewer passes."""
    rng = np.random.default_rng(8)
    x, y = rng.normal(size=(300, 5)) * [1, 10, 0.1, 1, 3], rng.choice([-1.0, 1.0], 300)

    def loss(w):
        m = (x @ w) * y
        return float(np.logaddexp(0, -m).sum()), -(y / (1 + np.exp(m))) @ x

    def path(most):
        m, passes, seen = Minimiser(5, 1.0, tolerance=1e-6), 0, []
        while not m.done and passes < 500:
            passes, steps, started = passes + 1, m.steps, m.value is not None
            for w in m.trials(most):
                assert np.array_equal(w, m.trial)
                m.tell(*loss(w))
                seen.append(m.x.tolist())
                if m.done or not started or m.steps > steps:
                    break
        return passes, seen

    (alone, one), (together, other) = path(1), path(12)
    assert one == other and together < alone
