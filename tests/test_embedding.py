"""t-SNE: perplexities, gradients by finite differences, groups that stay apart."""

import numpy as np
import pytest

from resolake.operators import embedding as T


def affinities(x, perplexity):
    d2, every = T._squares(x, x), np.arange(len(x))
    beta = T.widths(d2, every, perplexity)
    e = np.exp(-d2 * beta[:, None])
    e[every, every] = 0
    return beta, T.log_norms(d2, every, beta), e / e.sum(1, keepdims=True)


def test_perplexities_and_symmetry():
    x = np.random.default_rng(1).normal(size=(40, 5)) * np.linspace(0.1, 9, 40)[:, None]
    beta, norms, p = affinities(x, 7.0)
    with np.errstate(divide="ignore", invalid="ignore"):
        assert np.exp(-np.where(p > 0, p * np.log(p), 0).sum(1)) == pytest.approx(np.full(40, 7.0), rel=1e-6)
    whole = T.conditionals(x, np.arange(40), beta, norms)
    assert whole == pytest.approx((p + p.T) / 80)
    parts = np.vstack([T.conditionals(x, rows, beta, norms) for rows in np.array_split(np.arange(40), 3)])
    assert parts == pytest.approx(whole)


def test_gradient_is_that_of_the_divergence():
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(12, 3)), rng.normal(size=(12, 2))
    beta, norms, _ = affinities(x, 3.0)
    p = T.conditionals(x, np.arange(12), beta, norms)

    def divergence(y):
        near = 1 / (1 + T._squares(y, y))
        np.fill_diagonal(near, 0)
        q = near / near.sum()
        return (p[p > 0] * np.log(p[p > 0] / q[p > 0])).sum()

    found = np.vstack([T.forces(p[rows], y, rows) for rows in np.array_split(np.arange(12), 5)])
    cost, g = T.gradient(found)
    assert cost == pytest.approx(divergence(y))
    for i, c in np.ndindex(y.shape):
        e = np.zeros_like(y)
        e[i, c] = 1e-6
        assert g[i, c] == pytest.approx((divergence(y + e) - divergence(y - e)) / 2e-6, abs=1e-7)


def test_groups_stay_apart(spark):
    rng = np.random.default_rng(3)
    x = np.repeat(rng.normal(size=(3, 8)) * 12, 12, axis=0) + rng.normal(size=(36, 8))
    frame = spark.createDataFrame([(f"p{k:02d}", v.tolist()) for k, v in enumerate(x)] + [("null", None), (None, [0.0] * 8)], "name string, x array<double>")
    got = {r.name: (r.a, r.b) for r in T.tsne(frame.repartition(5), perplexity=8, rounds=80).collect()}
    y = np.array([got[f"p{k:02d}"] for k in range(36)])
    assert len(got) == 36
    d = np.sqrt(T._squares(y, y))
    group = np.arange(36) // 12
    same = group[:, None] == group
    near = [group[np.argsort(row)[1:6]] for row in d]  # five nearest of each
    assert all((n == g).all() for n, g in zip(near, group, strict=True))
    assert d[~same].mean() > 2 * d[same].mean()
    assert T.tsne(frame.limit(0)).count() == 0
    assert T.tsne(frame.where("name in ('p00', 'p20')")).count() == 2
