"""Hand-computed fixtures, two-route and metamorphic checks of the analysis operators."""

import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from resolake.functions import pvalues, scalars
from resolake.operators import attention, contingency, estimators, joining, kernels, patches, positions, sampling, statistics
from resolake.sources.tables import Scratch

A = [[0.1, 0.2, 0.3, 0.4], [0.25] * 4, [0.4, 0.3, 0.2, 0.1], [0.0, 0.0, 0.0, 1.0]]
SS = "HHEC"
NEQ = [1.0, 1.5, 2.0, 4.0]


@pytest.fixture(scope="module")
def attn(spark):
    return spark.createDataFrame([("p1", i, j, A[i][j]) for i in range(4) for j in range(4)], "name string, i int, j int, w double").cache()


@pytest.fixture(scope="module")
def residues(spark):
    return spark.createDataFrame([("p1", i, SS[i], NEQ[i]) for i in range(4)], "name string, i int, cat string, neq double").cache()


def col(df, c, order="i"):
    return [r[c] for r in df.orderBy(order).collect()]


def test_received(attn):
    r = attention.received(attn)
    assert col(r, "sum_in") == pytest.approx([0.75, 0.75, 0.75, 1.75])
    assert col(r, "max_in") == pytest.approx([0.4, 0.3, 0.3, 1.0])
    assert col(r, "avg_received") == pytest.approx([0.65 / 3, 0.5 / 3, 0.55 / 3, 0.75 / 3])


def test_entropy_and_homophily(attn, residues):
    assert col(attention.row_entropy(attn), "entropy") == pytest.approx([1.8464393, 2.0, 1.8464393, 0.0])
    assert col(attention.homophily(attn, residues, ["H", "E", "C"]), "same") == pytest.approx([0.3, 0.5, 0.2, 1.0])


def test_percentile_rank_breaks_ties_by_position(attn):
    m = attn.groupBy("name", F.col("j").alias("i")).agg(F.max("w").alias("m"))
    assert col(positions.percentile_rank(m, "m"), "pct_rank") == pytest.approx([200 / 3, 0, 100 / 3, 100])


def test_rows_sum_to_one_and_zero_rows_stay(spark):
    t = spark.createDataFrame([("a", 0, 0, 2.0), ("a", 0, 1, 6.0), ("a", 1, 0, 0.0), ("a", 1, 1, 0.0)], "name string, i int, j int, w double")
    got = {(r.i, r.j): r.w for r in attention.row_normalised(t).collect()}
    assert got == {(0, 0): 0.25, (0, 1): 0.75, (1, 0): 0.0, (1, 1): 0.0}


def test_matrix_round_trip(spark, attn):
    records = spark.createDataFrame([("p1", A), ("bad", [[1.0], [2.0, 3.0]])], "name string, attention_weights array<array<double>>")
    assert attention.explode_matrix(records).exceptAll(attn).count() == 0
    assert attention.explode_matrix(records).count() == 16


def test_groups_of_one_and_constants(spark):
    t = spark.createDataFrame([("a", 0, 5.0), ("b", 0, 1.0), ("b", 1, 1.0)], "name string, i int, x double")
    assert {r.name: r.pct_rank for r in positions.percentile_rank(t.where("name = 'a'"), "x", 50.0).collect()} == {"a": 50.0}
    assert col(positions.z_score(t.where("name = 'b'"), "x"), "z") == [0.0, 0.0]
    assert col(positions.min_max(t.where("name = 'b'"), "x"), "scaled") == [0.0, 0.0]
    assert [r.r for r in statistics.pearson(t, "x", "i", ["name"]).collect()] == [None, None]


def test_labelers_differ_below_one(spark):
    t = spark.createDataFrame([(0.9,), (1.0,), (1.01,)], "x double")
    got = t.select("x", scalars.binned(F.col("x"), [1.0]).alias("a"), scalars.not_exactly(F.col("x")).alias("b")).orderBy("x").collect()
    assert [(r.a, r.b) for r in got] == [(0, 1), (0, 0), (1, 1)]


def test_auc_by_two_routes_and_negation(spark):
    rng = np.random.default_rng(3)
    rows = [(float(rng.integers(20)), int(rng.random() < 0.4)) for _ in range(300)]
    t = spark.createDataFrame(rows, "score double, label int")
    auc = statistics.roc_auc(t, "score", "label").first().auc
    curve = statistics.trapezoid_auc(statistics.curve_points(t, "score", "label")).first().auc
    negated = statistics.roc_auc(t.withColumn("score", -F.col("score")), "score", "label").first().auc
    pairs = [(a > b) + 0.5 * (a == b) for a, y in rows if y for b, z in rows if not z]
    assert auc == pytest.approx(np.mean(pairs)) and curve == pytest.approx(auc) and negated == pytest.approx(1 - auc)
    assert statistics.roc_auc(t.where("label = 1"), "score", "label").first().auc is None


def test_kendall_against_pairs(spark):
    rows = [("a", i, float((i * 7) % 5), float((i * 3) % 4)) for i in range(12)]
    t = spark.createDataFrame(rows, "name string, i int, x double, y double")
    s = nx = ny = 0
    for p in range(12):
        for q in range(p):
            dx, dy = np.sign(rows[p][2] - rows[q][2]), np.sign(rows[p][3] - rows[q][3])
            s, nx, ny = s + dx * dy, nx + (dx != 0), ny + (dy != 0)
    assert statistics.kendall_tau_b(t, "x", "y", ["name"]).first().tau_b == pytest.approx(s / math.sqrt(nx * ny))


def test_kendall_of_ties_nulls_and_many_rows(spark):
    rng = np.random.default_rng(2)
    for n, kinds in ((2, 2), (7, 3), (60, 5), (61, 1000)):
        x, y = rng.integers(0, kinds, n).astype(float), rng.integers(0, kinds, n).astype(float)
        t = spark.createDataFrame([("k", float(a), float(b)) for a, b in zip(x, y, strict=True)] + [("k", None, 1.0), ("one", 1.0, 1.0)], "name string, x double, y double")
        dx, dy = np.sign(np.subtract.outer(x, x)), np.sign(np.subtract.outer(y, y))
        under = math.sqrt(float((dx != 0).sum()) * float((dy != 0).sum()))
        (got,) = statistics.kendall_tau_b(t, "x", "y", ["name"]).collect()
        assert got.name == "k" and got.tau_b == (pytest.approx((dx * dy).sum() / under) if under else None)
    # a key of 300,000 rows without equal values: y falls in pairs of x, so one pair in (n - 1) is discordant
    n = 300_000
    swapped = F.col("id") + F.when(F.col("id") % 2 == 0, 1).otherwise(-1)
    got = statistics.kendall_tau_b(spark.range(n).select("id", swapped.alias("y")), "id", "y").first().tau_b
    assert got == pytest.approx(1 - 2 * (n / 2) / (n * (n - 1) / 2))


def test_quantile_points(spark):
    """Ranks with ties by key, and normal quantiles whose tails give the ranks back."""
    from resolake.functions.pvalues import normal_tail

    x = [3.0, 1.0, 2.0, 2.0, None, -7.5, 2.0]
    t = spark.createDataFrame([(k, v) for k, v in enumerate(x)], "key int, x double").repartition(3)
    got = sorted((r.r, r.key, r.x, r.p, r.theoretical) for r in statistics.qq_points(t, "x", "key").collect())
    assert [g[:3] for g in got] == [(1, 5, -7.5), (2, 1, 1.0), (3, 2, 2.0), (4, 3, 2.0), (5, 6, 2.0), (6, 0, 3.0)]
    assert [g[3] for g in got] == pytest.approx([(k + 0.5) / 6 for k in range(6)])
    assert [1 - normal_tail(g[4]) for g in got] == pytest.approx([(k + 0.5) / 6 for k in range(6)], abs=1e-12)
    assert statistics.qq_points(t.limit(0), "x", "key").count() == 0


def test_curves_over_many_scores(spark):
    """Sums by ranges of scores against plain sums, without keys."""
    rng = np.random.default_rng(6)
    label = rng.integers(0, 2, 3000)
    score = np.round(rng.normal(label, 2.0), 2)
    t = spark.createDataFrame([(float(s), int(c)) for s, c in zip(score, label, strict=True)] + [(None, 1), (1.0, None)], "score double, label int").repartition(5)
    points = {r.threshold: r for r in statistics.curve_points(t, "score", "label").collect()}
    assert sorted(points) == sorted(set(score.tolist()))
    for s, r in points.items():
        tp, fp = int(label[score >= s].sum()), int((1 - label)[score >= s].sum())
        assert (r.tp, r.fp, r.precision) == (tp, fp, pytest.approx(tp / (tp + fp)))
        assert r.tpr_before == pytest.approx(label[score > s].sum() / label.sum())
    above = np.subtract.outer(score[label == 1], score[label == 0])
    auc = ((above > 0) + 0.5 * (above == 0)).mean()
    assert statistics.roc_auc(t, "score", "label").first().auc == pytest.approx(auc)
    assert statistics.trapezoid_auc(statistics.curve_points(t, "score", "label")).first().auc == pytest.approx(auc)
    assert statistics.pearson(t, "score", "label").first().r == pytest.approx(np.corrcoef(score, label)[0, 1])
    assert tuple(statistics.pearson(t.limit(0), "score", "label").first()) == (0, None)


def test_tabulated_tails():
    assert pvalues.chi2_tail(3.841459, 1) == pytest.approx(0.05, abs=1e-6)
    assert pvalues.chi2_tail(18.307038, 10) == pytest.approx(0.05, abs=1e-6)
    assert pvalues.student_two_sided(2.228139, 10) == pytest.approx(0.05, abs=1e-6)
    assert pvalues.normal_tail(1.644854) == pytest.approx(0.05, abs=1e-6)
    assert pvalues.normal_quantile(0.975) == pytest.approx(1.959964, abs=1e-6)
    assert pvalues.hypergeometric_tail(3, 5, 4, 10) == pytest.approx((4 * 15 + 1 * 6) / 252)


def test_spectrum_keeps_the_frobenius_norm(attn):
    row = kernels.svd_summary(attn).first()
    assert row.frobenius == pytest.approx(np.linalg.norm(np.array(A)))
    assert row.stable_rank == pytest.approx(np.linalg.norm(A) ** 2 / np.linalg.norm(A, 2) ** 2)


def test_pca_variance_sums_to_one(attn):
    got = kernels.pca_loadings(attn, 4).select("pc", "variance_ratio").distinct()
    assert got.agg(F.sum("variance_ratio")).first()[0] == pytest.approx(1.0)


def test_betweenness_of_a_path(spark):
    edges = spark.createDataFrame([("g", 0, 1, 1.0), ("g", 1, 2, 1.0), ("g", 2, 3, 1.0)], "name string, src int, dst int, w double")
    nodes = spark.createDataFrame([("g", i) for i in range(4)], "name string, i int")
    assert col(kernels.betweenness(edges, nodes), "betweenness") == pytest.approx([0, 2 / 6, 2 / 6, 0])


def test_clusters_are_ranked_by_energy(spark):
    a = np.kron(np.diag([5.0, 3.0, 1.0]), np.ones((4, 4))) + 0.01
    t = spark.createDataFrame([("p", i, j, float(a[i, j])) for i in range(12) for j in range(12)], "name string, i int, j int, w double")
    got = col(kernels.ranked_clusters(kernels.cluster_profiles(t)), "pattern")
    assert got == ["PatA"] * 4 + ["PatB"] * 4 + ["Bg"] * 4


def test_diagonal_touching_cells_are_one_region(spark):
    m = np.zeros((6, 6))
    for i, j in ((0, 3), (1, 4), (2, 5), (0, 4)):
        m[i, j] = 1.0
    t = spark.createDataFrame([("p", i, j, float(m[i, j])) for i in range(6) for j in range(6)], "name string, i int, j int, w double")
    got = kernels.component_summary(kernels.bright_components(t, 4 / 36 * 100, 4)).collect()
    assert [(r.size, r.span_i, r.span_j) for r in got] == [(4, 3, 3)]


def test_intervals_across_buckets(spark):
    pos = spark.createDataFrame([("a", p) for p in range(1, 301)], "name string, pos int")
    iv = spark.createDataFrame([("a", 60, 130), ("a", 100, 140), ("a", 290, 290), ("b", 1, 300), ("a", 9, 3)], "name string, start int, end int")
    assert col(joining.in_intervals(pos, iv), "pos", "pos") == [*range(60, 141), 290]


def test_contacts_match_all_pairs(spark):
    rng = np.random.default_rng(5)
    x = rng.random((60, 3)) * 4
    t = spark.createDataFrame([("c", i, *map(float, x[i])) for i in range(60)], "name string, i int, x double, y double, z double")
    got = {(r.i, r.j) for r in attention.distances_below(t, 1.0).collect()}
    assert got == {(i, j) for i in range(60) for j in range(60) if i != j and np.linalg.norm(x[i] - x[j]) < 1}


def test_group_split_keeps_groups_whole(spark):
    t = spark.range(200).withColumn("g", F.col("id") % 13)
    s = sampling.group_split(t, F.col("g").cast("string"))
    assert s.groupBy("g").agg(F.countDistinct("split").alias("n")).where("n > 1").count() == 0
    assert s.where("split = 'test'").select("g").distinct().count() == int(13 * 0.2)


def test_weighted_sample_follows_weights(spark):
    t = spark.createDataFrame([(0, 0.0), (1, 1.0), (2, 3.0)], "key int, w double")
    n = {r.key: r["count"] for r in sampling.weighted_sample(t, "w", "key", 2000).groupBy("key").count().collect()}
    assert sum(n.values()) == 2000 and 0 not in n and 0.70 < n[2] / 2000 < 0.80


def test_pivot_refuses_repeated_keys(spark):
    t = spark.createDataFrame([("a", 1, 2.0), ("a", 1, 3.0)], "k string, t int, x double")
    with pytest.raises(Exception, match="twice"):
        joining.temperature_pivot(t, ["k"], "t", [1], "x").collect()


def test_contingency_shows_empty_labels(spark):
    t = spark.createDataFrame([("r", "a"), ("r", "a"), ("s", "b")], "row string, col string")
    got = {(r.row, r.col): r.n for r in contingency.contingency(t, "row", "col", ["a", "b", "c"]).collect()}
    assert got == {("r", "a"): 2, ("r", "b"): 0, ("r", "c"): 0, ("s", "a"): 0, ("s", "b"): 1, ("s", "c"): 0}


def test_row_order_does_not_matter(spark, attn):
    mixed = attn.orderBy(F.rand(7)).repartition(3)
    for f in (attention.matrix_summary, attention.row_entropy, lambda a: attention.sparse_graph(a, "topk", k=2)):
        a, b = (sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in f(x).collect()) for x in (attn, mixed))
        assert a == b


def test_stacked_pca_uses_all_cells(spark):
    """Matrices of 20, 18 and 3 positions against numpy on zero-filled matrices."""
    rng = np.random.default_rng(5)
    mats = {"a": rng.random((20, 20)), "b": rng.random((20, 20)), "c": rng.random((18, 18)), "d": rng.random((3, 3))}
    rows = [(n, i, j, float(m[i, j])) for n, m in mats.items() for i in range(len(m)) for j in range(len(m))]
    got = kernels.stacked_pca(spark.createDataFrame(rows, "name string, i int, j int, w double").repartition(3)).collect()
    x = np.array([np.pad(m, (0, 20 - len(m))).ravel() for m in mats.values()])
    sd = x.std(0)
    z = (x - x.mean(0)) / np.where(sd > 0, sd, 1)
    u, s, _ = np.linalg.svd(z, full_matrices=False)
    for pc in (1, 2):
        want = u[:, pc - 1] * s[pc - 1]
        want = want * np.sign(want[np.abs(want).argmax()])
        mine = {r.name: r for r in got if r.pc == pc}
        assert [mine[n].score for n in mats] == pytest.approx(want.tolist())
        assert mine["a"].variance_ratio == pytest.approx(s[pc - 1] ** 2 / (s**2).sum())


def test_value_ranks_over_ranges_equal_a_plain_order(spark):
    from resolake.operators import ranking

    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=900), np.repeat(0.25, 300), rng.integers(0, 5, 300)])
    frame = spark.createDataFrame([(int(i % 3), float(v)) for i, v in enumerate(x)] + [(0, None)], "g int, x double").repartition(5)
    got = {r.x: (r.before, r.ties) for r in ranking.value_ranks(frame, "x").collect()}
    assert got == {float(v): (int((x < v).sum()), int((x == v).sum())) for v in np.unique(x)}
    by_group = {(r.g, r.x): r.before for r in ranking.value_ranks(frame, "x", ["g"]).collect()}
    g = np.arange(len(x)) % 3
    assert by_group == {(k, float(v)): int((x[g == k] < v).sum()) for k in range(3) for v in np.unique(x[g == k])}
    cuts = ranking.order_statistics(frame, "x", {"lo": F.lit(0), "mid": F.floor(F.col("n") / 2), "hi": F.col("n") - 1}).first()
    assert tuple(cuts) == (x.min(), np.sort(x)[len(x) // 2], x.max())
    assert ranking.value_ranks(frame.limit(0), "x").count() == 0


def test_weighted_draws_follow_the_weights(spark):
    from resolake.operators import sampling

    frame = spark.createDataFrame([(i, w) for i, w in enumerate([5.0, 0.0, 1.0, 4.0] + [0.0] * 50)], "k long, w double")
    got = sampling.weighted_sample(frame, "w", "k", 4000).toPandas()
    assert sorted(got["draw"]) == list(range(4000))
    share = got["k"].value_counts(normalize=True)
    assert set(share.index) == {0, 2, 3} and abs(share[0] - 0.5) < 0.04 and abs(share[2] - 0.1) < 0.03


def test_bootstrap_interval_is_that_of_the_mean(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(3.0, 2.0, 400)
    frame = spark.createDataFrame([("a", float(v)) for v in x] + [("b", 1.0), ("b", None)], "key string, x double").repartition(3)
    frame = frame.withColumn("row", F.monotonically_increasing_id())
    frame = spark.createDataFrame(frame.collect(), frame.schema)
    found = [sorted(kernels.bootstrap_mean(frame.repartition(n), "x", "key", ["row"]).collect()) for n in (1, 7)]
    assert all(a[:3] == b[:3] and a[3:] == (pytest.approx(b[3:], rel=1e-12) if b.n > 9 else b[3:]) for a, b in zip(*found, strict=True))
    got = {r.key: r for r in found[0]}
    assert got["a"].n == 400 and got["a"].mean == pytest.approx(x.mean())
    half = 1.96 * x.std() / 20
    assert got["a"].low == pytest.approx(x.mean() - half, abs=0.06) and got["a"].high == pytest.approx(x.mean() + half, abs=0.06)
    assert (got["b"].n, got["b"].low, got["b"].high) == (1, None, None)


def test_checks_report_what_fails(spark):
    from pyspark.sql.types import LongType, StringType, StructField, StructType

    from resolake.operators import checks

    lengths = spark.createDataFrame([("p", 3)], "name string, length int")
    at = spark.createDataFrame([("p", i) for i in (0, 2, 3, -1, 9, 9)] + [("q", 0)], "name string, i int")
    assert sorted(r.i for r in checks.valid_positions(at, lengths).collect()) == [0, 2]
    report = {r.name: (r.n_invalid, r.examples) for r in checks.invalid_report(at, lengths, first=2).collect()}
    assert report == {"p": (4, [-1, 3]), "q": (1, [0])}
    marks = spark.createDataFrame([(0,), (-1,), (-100,), (None,), (2,)], "label int")
    assert sorted(r.label for r in checks.unpadded(marks, "label").collect()) == [0, 2]
    sites = spark.createDataFrame([("p", 0, "A"), ("p", 1, "X"), ("p", 5, "C"), ("r", 0, None)], "name string, i int, expected string")
    seqs = spark.createDataFrame([("p", "ACD", "AXD"), ("r", "K", None)], "name string, sequence string, second string")
    got = {r.name: tuple(r)[1:] for r in checks.numbering_checks(sites, seqs, ["name"], other="second").collect()}
    assert got == {"p": (3, 1, 1, 1, 0, False), "r": (1, 0, 0, 0, 0, True)}
    assert [r.name for r in checks.strict_numbering(sites, seqs).collect()] == ["r"]

    def fails_on_b(pdf):
        if pdf["k"].iat[0] == "b":
            raise KeyError("b")
        return pdf.groupby("k", as_index=False).agg(n=("v", "size"))

    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "k string, v int")
    done = checks.captured(rows, "k", fails_on_b, StructType([StructField("k", StringType()), StructField("n", LongType())]))
    assert [tuple(r) for r in checks.succeeded(done).collect()] == [("a", 2)]
    assert [tuple(r) for r in checks.failures(done).collect()] == [("b", "KeyError: 'b'")]


def test_rank_k_signal_and_loadings_equal_numpy(spark):
    """A matrix's principal parts against a plain decomposition of it."""
    rng = np.random.default_rng(12)
    a = rng.random((8, 8))
    frame = spark.createDataFrame([("m", i, j, float(a[i, j])) for i in range(8) for j in range(8)], "name string, i int, j int, w double")
    centred = a - a.mean(axis=0)
    _, s, vt = np.linalg.svd(centred, full_matrices=False)
    got = kernels.pca_loadings(frame).toPandas()
    for pc, part in got.groupby("pc"):
        part = part.sort_values("i")
        own, want = part["loading"].to_numpy(), vt[int(pc) - 1]
        assert min(np.abs(own - want).max(), np.abs(own + want).max()) < 1e-6
        assert part["variance_ratio"].iat[0] == pytest.approx(s[int(pc) - 1] ** 2 / (s * s).sum())


def test_segments_around_a_letter(spark):
    from resolake.operators import motifs

    seqs = spark.createDataFrame([(1, "wabcdefgw"), (2, "aw"), (3, ""), (4, None), (5, "abc"), (6, "abcwwdefgh")], "name long, seq string")
    cut = sorted(tuple(r) for r in motifs.segments_around(seqs, "w", 3).collect())
    assert cut == [(1, "efgw", 3), (1, "wabc", 0), (2, "aw", 1), (6, "abcwwde", 3), (6, "bcwwdef", 3)]
    moved = sorted(tuple(r) for r in motifs.segments_around(seqs, "w", 3, shifted=True).collect())
    assert moved == [(1, "bcdefgw", 6), (1, "wabcdef", 0), (2, "aw", 1), (6, "abcwwde", 3), (6, "bcwwdef", 3)]


def _frame(spark, matrices):
    return spark.createDataFrame([(n, i, j, float(a[i, j])) for n, a in matrices.items() for i in range(len(a)) for j in range(len(a))], "name string, i int, j int, w double")


def test_stacked_pca_equals_numpy(spark):
    """Components of whole matrices of unlike sizes, against a decomposition of the standardised stack."""
    rng = np.random.default_rng(21)
    matrices = {n: rng.random((k, k)) for n, k in (("a", 6), ("b", 6), ("c", 4), ("d", 5))}
    stack = np.zeros((4, 36))
    for r, a in enumerate(matrices.values()):
        padded = np.zeros((6, 6))
        padded[: len(a), : len(a)] = a
        stack[r] = padded.ravel()
    x = (stack - stack.mean(0)) / stack.std(0)
    u, s, _ = np.linalg.svd(x, full_matrices=False)
    got = kernels.stacked_pca(_frame(spark, matrices)).toPandas().sort_values("name")
    for pc, part in got.groupby("pc"):
        own, want = part["score"].to_numpy(), u[:, pc - 1] * s[pc - 1]
        assert min(np.abs(own - want).max(), np.abs(own + want).max()) < 1e-6
        assert part["variance_ratio"].iat[0] == pytest.approx(s[pc - 1] ** 2 / (s * s).sum())


def test_patch_motifs_find_planted_patches(spark):
    """A matrix tiled with two kinds of patches: each kind is one motif, with the patches' own mean."""
    rng = np.random.default_rng(5)
    kinds = np.array([[0, 1, 0], [1, 1, 0], [0, 0, 1]])
    a = np.kron(kinds, np.ones((4, 4))) * 4 + rng.random((12, 12)) * 1e-3
    assigned, prototypes = patches.patch_motifs(_frame(spark, {"m": a}), size=1, motifs=2)
    cells = [(a[r.i, r.j] > 2, r.motif) for r in assigned.collect()]
    assert len(cells) == 144 and set(cells) == {(False, 0), (True, 1)} and sum(high for high, _ in cells) == 64
    z = (a - a.mean()) / a.std()
    assert [r.value for r in prototypes.orderBy("motif").collect()] == pytest.approx([z[a < 2].mean(), z[a > 2].mean()])
    assigned, prototypes = patches.patch_motifs(_frame(spark, {"m": a[:3, :3]}), size=5)
    assert assigned.count() == prototypes.count() == 0

def test_patch_motifs_whatever_the_partitions(spark):
    """Patches of a matrix of several bands, cells shuffled, some not given: motifs are those of a plain nearest prototype, prototypes their patches' means, and no dealing of rows changes them."""
    rng = np.random.default_rng(14)
    a = rng.random((150, 150)) + np.kron(rng.random((15, 15)) > 0.7, np.ones((10, 10))) * 3
    a[70:140] = 0.0  # bands without a cell
    frame = _frame(spark, {"m": a, "k": np.full((8, 8), 0.1)}).where("name = 'k' or i not between 70 and 139")
    found = {}
    for parts in (1, 5):
        assigned, prototypes = patches.patch_motifs(frame.repartition(parts), motifs=3)
        found[parts] = {(r.name, r.i, r.j): (r.motif, r.distance) for r in assigned.collect()}
        c = np.zeros((3, 25))
        for r in prototypes.collect():
            c[r.motif, r.row * 5 + r.column] = r.value
        x = np.array([a[i - 2 : i + 3, j - 2 : j + 3].ravel() for i in range(2, 148) for j in range(2, 148)])
        z = np.vstack([(x - x.mean(0)) / x.std(0), np.zeros((16, 25))])
        d = np.sqrt(((z[:, None] - c) ** 2).sum(2))
        keys = [("m", i, j) for i in range(2, 148) for j in range(2, 148)] + [("k", i, j) for i in range(2, 6) for j in range(2, 6)]
        assert set(keys) == found[parts].keys()
        assert [found[parts][k][0] for k in keys] == d.argmin(1).tolist()
        assert [found[parts][k][1] for k in keys] == pytest.approx(d.min(1).tolist(), abs=1e-9)
        sizes = np.bincount(d.argmin(1), minlength=3)
        assert (np.diff(sizes) <= 0).all()
        assert np.abs(c - [z[d.argmin(1) == m].mean(0) for m in range(3)]).max() < 2e-2
    assert {k: v[0] for k, v in found[1].items()} == {k: v[0] for k, v in found[5].items()}


def test_every_patch_is_there(spark):
    """Whole patches of two matrices, one with cells left out, against plain slices; scaled places against plain deviations."""
    rng = np.random.default_rng(8)
    a, b = rng.random((9, 9)), rng.random((6, 6))
    b[2, 3] = b[5, 5] = 0.0
    frame = _frame(spark, {"a": a, "b": b}).where("not (name = 'b' and (i, j) in ((2, 3)))")
    got = {(r.name, r.i, r.j): r.patch for r in patches.patches(frame, 5).collect()}
    want = {(n, i, j): m[i - 2 : i + 3, j - 2 : j + 3].ravel().tolist() for n, m in (("a", a), ("b", b)) for i in range(2, len(m) - 2) for j in range(2, len(m) - 2)}
    assert got == want
    scaled = {(r.name, r.i, r.j): r.patch for r in patches.scaled_patches(patches.patches(frame, 5)).collect()}
    for name in "ab":
        x = np.array([v for k, v in sorted(want.items()) if k[0] == name])
        z = np.array([v for k, v in sorted(scaled.items()) if k[0] == name])
        assert z == pytest.approx((x - x.mean(0)) / x.std(0))
    with pytest.raises(ValueError, match="odd"):
        patches.patches(frame, 4)


def test_background_subclusters_split_blocks(spark):
    """Background positions in three blocks: the blocks are found from the background's own cells, ranked by energy."""
    a = np.full((14, 14), 0.01)
    for low, high, w in ((0, 4, 1.0), (4, 8, 3.0), (8, 12, 2.0)):
        a[low:high, low:high] = w
    a[12:, :] = a[:, 12:] = 50.0
    patterns = spark.createDataFrame([("m", i, "Bg" if i < 12 else "PatA") for i in range(14)], "name string, i int, pattern string")
    got = kernels.subclusters(_frame(spark, {"m": a}), patterns).orderBy("i").collect()
    assert [r.pattern for r in got] == ["Bg3"] * 4 + ["Bg1"] * 4 + ["Bg2"] * 4
    assert kernels.cluster_profiles(_frame(spark, {"m": a[:2, :2]})).count() == 0
    assert kernels.bright_components(_frame(spark, {"m": a[:1, :1]})).count() == 0


def _bright_regions(m, percent, least_size):
    """Regions as sets of cells by a walk over each, in the order of their first cells."""
    off = {(i, j): m[i, j] for i in range(len(m)) for j in range(len(m)) if i != j}
    cut = sorted(off.values())[min(max(int(np.floor(len(off) * (1 - percent / 100))), 0), len(off) - 1)]
    left, found = {c for c, w in off.items() if w >= cut}, []
    for start in sorted(left):
        region, todo = set(), [start] if start in left else []
        while todo:
            i, j = todo.pop()
            if (i, j) in left:
                left.remove((i, j))
                region.add((i, j))
                todo += [(i + x, j + y) for x in (-1, 0, 1) for y in (-1, 0, 1)]
        if len(region) >= least_size:
            found.append(region)
    return found


def test_bright_regions_across_squares(spark):
    """Regions that wind through many squares are those of a walk, and numbered alike."""
    rng = np.random.default_rng(6)
    for percent, least_size in ((12.0, 2), (38.0, 3)):
        m = {f"m{n}": rng.random((n, n)) for n in (3, 22, 31)}
        got = defaultdict(set)
        for r in kernels.bright_components(_frame(spark, m), percent, least_size, tile=4).collect():
            got[r.name, r.component].add((r.i, r.j))
        want = {(name, k): region for name, x in m.items() for k, region in enumerate(_bright_regions(x, percent, least_size))}
        assert got == want and max(map(len, want.values())) > 5


def test_bright_regions_take_no_rounds_within_squares(spark, monkeypatch):
    """Arms that meet far from their first cells are joined where they are read; before, each round moved a step along an arm."""
    m = np.zeros((48, 48))
    for k in range(40):
        m[k, [47 if k < 39 else 46, 41]] = 1.0
    m[39, 41:47] = 1.0
    stored, table = [], Scratch.table
    monkeypatch.setattr(Scratch, "table", lambda self, df: stored.append(1) or table(self, df))
    got = kernels.bright_components(_frame(spark, {"m": m}), 100 * ((m > 0).sum() - 0.5) / (48 * 47), 2)
    assert got.count() == (m > 0).sum() and got.select("component").distinct().count() == 1
    assert len(stored) <= 2


def test_neighbour_features_share_one_shuffle(spark):
    """One shuffle and no join; rows without a name stay, as in the SQL of m4_neighbour_features."""
    t = spark.createDataFrame([("a", 0, 1.0, "p"), ("a", 1, 2.0, "q"), (None, 0, 3.0, "r"), (None, 1, 4.0, "p")], "name string, i int, value double, cat string")
    x = estimators.neighbour_features(t, "value", "cat")
    plan = x._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1
    got = sorted((str(r.name), r.i, r.prev_1, r.next_1, r.prev_1_cat, r.next_1_cat, r.rel_pos) for r in x.collect())
    assert got == [("None", 0, 0.0, 4.0, "START", "p", 0.0), ("None", 1, 3.0, 0.0, "r", "END", 0.5), ("a", 0, 0.0, 2.0, "START", "q", 0.0), ("a", 1, 1.0, 0.0, "p", "END", 0.5)]


def test_classifiers_on_held_out_rows(spark):
    """Logistic regression is right about a linear rule, the forest about one that no line tells, the grid prefers the light penalty."""
    rng = np.random.default_rng(9)
    x = rng.uniform(-1, 1, (600, 2))
    cat = rng.choice(["p", "q"], 600)
    rows = [(float(a), float(b), str(c), float(a + b + (0.5 if c == "p" else -0.5) > 0), float(a * b > 0)) for (a, b), c in zip(x, cat, strict=True)]
    t = spark.createDataFrame(rows, "a double, b double, c string, line double, cross double")
    train, test = t.limit(400).cache(), t.subtract(t.limit(400)).cache()

    def right(estimator, label):
        p = estimators.feature_pipeline(["a", "b"], ["c"], estimator).fit(train).transform(test)
        return p.agg(F.avg((F.col("prediction") == F.col(label)).cast("int"))).first()[0]

    assert right(estimators.logistic("line", regParam=0.001), "line") > 0.95
    assert right(estimators.logistic("cross"), "cross") < 0.7 < 0.9 < right(estimators.forest("cross"), "cross")
    lr = estimators.logistic("line", maxIter=20)
    found = estimators.grid_search(estimators.feature_pipeline(["a", "b"], ["c"], lr), lr, {"regParam": [0.001, 1000.0]}, label="line", folds=2).fit(train)
    assert found.avgMetrics[0] > 0.9 > found.avgMetrics[1] - 0.2 and found.avgMetrics[0] > found.avgMetrics[1]


def test_quantile_cuts_equal_sql_at_ties(spark):
    """Values of nine digits, so many quantiles lie half-way between two rounded ones."""
    import duckdb

    rng = np.random.default_rng(1)
    name = np.repeat(np.arange(400), rng.integers(2, 60, 400))
    w = (4_800_000 + rng.integers(0, 400, len(name))) / 1e9
    rows = spark.createDataFrame([*zip(name.tolist(), w.tolist(), strict=True), (-1, None)], "name long, w double")
    duck = duckdb.connect()
    duck.execute("create table t (name bigint, w double)")
    duck.executemany("insert into t values (?, ?)", [tuple(r) for r in rows.collect()])
    shares = [0.9, 0.95, 0.995]
    got = rows.groupBy("name").agg(*[positions.quantile("w", q, 9).alias(f"q{k}") for k, q in enumerate(shares)]).orderBy("name").collect()
    want = duck.execute(f"select name, {', '.join(f'round(quantile_cont(w, {q}), 9)' for q in shares)} from t group by 1 order by 1").fetchall()
    assert [tuple(r) for r in got] == want


def test_one_hot_sums_equal_rows_of_letters(spark):
    texts = spark.createDataFrame([(0, "ACCAZ"), (1, ""), (2, "BJOUXZ"), (3, "É\U0001d49cA a.*"), (4, None)], "name long, seq string")
    sums = scalars.one_hot_sums(F.col("seq"), list(scalars.AA20))
    got = {r.name: r.h for r in texts.select("name", sums.alias("h")).collect()}
    for name, seq in [(0, "ACCAZ"), (1, ""), (2, "BJOUXZ"), (3, "É\U0001d49cA a.*")]:
        assert got[name] == [*[seq.count(c) for c in scalars.AA20], sum(c not in scalars.AA20 for c in seq)]
    from resolake.plans import registry

    plan = registry.queries()["f1_f7_one_hot_letters"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode" not in plan  # no row a letter


def test_attention_rows_are_made_whole(spark):
    """Over sequences of more than one block, with a zero, a null and a short vector: plain cosines, and no window over cells."""
    rng = np.random.default_rng(5)
    rows = [(n, i, rng.normal(size=8).tolist()) for n, size in ((1, 150), (2, 64), (3, 1)) for i in range(size)]
    odd = [(1, 150, [0.0] * 8), (1, 151, None), (1, 152, [1.0] * 3), (None, 0, [1.0] * 8)]
    a = attention.similarity_attention(spark.createDataFrame(rows + odd, "name long, i int, v array<double>").repartition(5), 8)
    assert a.dtypes == [("name", "bigint"), ("i", "int"), ("j", "int"), ("w", "double")]
    assert "Window" not in a._jdf.queryExecution().optimizedPlan().toString()
    got = {(r.name, r.i, r.j): r.w for r in a.collect()}
    want = {}
    for n in (1, 2, 3):
        x = np.array([v for m, _, v in rows if m == n])
        x /= np.sqrt((x * x).sum(1, keepdims=True))
        s = (x @ x.T + 1) / 2
        want |= {(n, i, j): w for (i, j), w in np.ndenumerate(s / s.sum(1, keepdims=True))}
    assert got.keys() == want.keys()
    assert max(abs(got[k] - want[k]) for k in want) <= 0.6e-9 and all(w == round(w, 9) for w in got.values())
