"""MinHash, pivot and line deduplication against brute force, with odd inputs."""

import numpy as np
import pytest
from brute import boilerplate, cosine_links, near_duplicates
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from resolake.llm import common, components, pivot_dedup
from resolake.llm import minhash_dedup as M
from resolake.llm.components import connected_components
from resolake.llm.line_dedup import drop_boilerplate_lines
from resolake.llm.pivot_dedup import pivot_components

SCHEMA = "doc_id long, text string, lang string, id string, bucket string, label string"


def families(seed=1):
    """Copies, near copies at many similarities, short and odd texts."""
    rng = np.random.default_rng(seed)
    vocab = [f"w{i}" for i in range(400)]
    docs = []
    for family in range(8):
        base = list(rng.choice(vocab, 60 + 20 * family))
        docs.append(" ".join(base))
        for edits in (0, 0, 1, 1, 2, 2, 3, 4, 6, 9):
            words = base.copy()
            for at in rng.choice(len(words), edits, replace=False):
                words[at] = rng.choice(vocab)
            docs.append(" ".join(words))
    docs += ["", None, "one", "one", "ONE", "one two", "one two", "a b c", "a b c d", "A  B\tc\nd", "é É", "é é", "x " * 5000, " ", " \n\t "]
    return list(enumerate(docs))


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_minhash_equals_brute_force(spark, k, percent):
    docs = families()
    sizes, want = near_duplicates(docs, k, percent)
    frame = spark.createDataFrame([(i, t, "en", "x", "y", "z") for i, t in docs], SCHEMA).repartition(3)
    got = {r.doc_id: r for r in M.minhash_components(frame, words_each=k, percent=percent).collect()}
    assert {i: r.component_id for i, r in got.items()} == want
    assert {i: r.n_shingles for i, r in got.items()} == sizes
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())


def test_buckets_with_several_components_are_whole(spark, monkeypatch):
    """Chains whose ends don't meet the threshold, cut into tiny blocks."""
    monkeypatch.setattr(M, "BLOCK", 2)
    rng = np.random.default_rng(4)
    base, docs = [f"w{i}" for i in rng.integers(0, 9999, 120)], []
    for step in range(12):
        base = base.copy()
        base[(step * 9) % 120] = f"new{step}"
        docs.append((100 - step, " ".join(base)))
    _, want = near_duplicates(docs, 3, 85)
    got = M.minhash_components(spark.createDataFrame(docs, "doc_id long, text string"), words_each=3, percent=85)
    assert {r.doc_id: r.component_id for r in got.collect()} == want


def test_minhash_odd_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert M.minhash_components(empty).collect() == []
    rows = spark.createDataFrame([(None, "a b c d e"), (1, "a b c d e"), (1, "a b c d e"), (2, None)], "doc_id long, text string")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id, r.kept) for r in M.minhash_components(rows).collect())
    assert got == [(False, 1, 1, 1, True), (False, 1, 1, 1, True), (False, 2, 0, 2, True), (True, 0, None, None, True)]


def test_densified_bins_agree_with_similarity():
    rng = np.random.default_rng(0)
    pool = rng.integers(0, 2**63, 4000).astype(np.uint64)
    for size in (20, 100, 1000):
        a = np.unique(pool[:size])
        b = np.unique(np.concatenate([pool[: size * 9 // 10], pool[size : size + size // 10]]))
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs((M.sketch(a) == M.sketch(b)).mean() - true) < 0.25
    assert M.sketch(np.array([5], np.uint64)).tolist() == [5] * M.BINS


def test_repeated_ids_with_different_texts(spark):
    """Rows are documents: a text links by what it holds, whatever else its id names."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(50)) for x in "abc")
    near = b.replace("b7 ", "b7x ")
    rows = [(5, a), (5, b), (3, b), (5, None), (9, near), (9, c), (2, c + " more")]
    want = {(5, a): 5, (5, b): 3, (3, b): 3, (5, None): 5, (9, near): 3, (9, c): 2, (2, c + " more"): 2}
    got = M.minhash_components(spark.createDataFrame(rows, "doc_id long, text string"), words_each=3, percent=85).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in got) == sorted((i, x, i == x) for (i, _), x in want.items())


def test_near_unique_keeps_whole_rows_and_different_texts(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(50)) for x in "ab")
    rows = [(5, a, 1, "k"), (5, b, 2, "k"), (3, b + " end", 3, None), (None, a, 4, "k"), (None, "alone here", 5, "k"), (None, "alone here", 6, "k"), (4, "", 7, "k"), (4, None, 7, "k"), (8, "twice", 8, "k"), (8, "twice", 8, "k")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, row int, row_key string").repartition(3)
    got = M.near_unique(frame)
    assert got.columns == frame.columns
    kept = sorted(r.row for r in got.collect())
    assert kept in ([1, 3, 5, 7, 7, 8], [1, 3, 6, 7, 7, 8])
    assert sorted(r.row for r in M.near_unique(frame).collect()) == kept
    assert M.near_unique(frame.limit(0)).count() == 0


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 25), st.integers(0, 25)), max_size=40), st.booleans())
def test_components(spark, edges, salted):
    from brute import components as brute_components

    real = [(a, b) for a, b in edges if a != b]
    with pytest.MonkeyPatch.context() as m, common.Scratch(spark) as scratch:
        if salted:
            m.setattr(common, "HOT_ROWS", 1)
            m.setattr(components, "FEW_EDGES", 0)
        got = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long"), scratch).collect()}
    assert got == brute_components({x for e in real for x in e}, real)


def test_hot_keys_are_salted_and_joined_whole(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 3)
    rows = spark.createDataFrame([(i, 7 if i % 3 else i) for i in range(90)] + [(99, None)], "i long, key long")
    lookup = spark.createDataFrame([(k, k * 10) for k in range(60)], "key long, x long")
    joined = common.skew_join(rows, lookup, ["key"], "i")
    assert "explode" in joined._jdf.queryExecution().toString() and "_salt" not in joined.columns
    assert sorted(map(tuple, joined.collect())) == sorted(map(tuple, rows.join(lookup, "key").collect()))
    left = common.skew_join(rows, lookup.where("key <> 7"), ["key"], "i", how="left")
    assert sorted(map(str, left.collect())) == sorted(map(str, rows.join(lookup.where("key <> 7"), "key", "left").collect()))


def test_intermediate_tables_are_removed_and_settings_stay(spark, tmp_path):
    import os

    before = {k: v for k, v in spark.sparkContext.getConf().getAll()}, spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    folder = spark.conf.get("spark.checkpoint.dir")
    old = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    M.minhash_components(spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f")], "doc_id long, text string")).collect()
    assert all("-kept-" in x for x in set(os.listdir(folder)) - old)
    assert before == ({k: v for k, v in spark.sparkContext.getConf().getAll()}, spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch"))


def vectors(seed=2):
    rng = np.random.default_rng(seed)
    rows, n = [], 0
    for _ in range(30):
        base = rng.normal(size=16)
        for spread in (0, 0, 0.02, 0.05, 0.08, 0.3):
            rows.append((n, [float(x) for x in (base + spread * rng.normal(size=16)).astype(np.float32)]))
            n += 1
    rows += [(n, None), (n + 1, [0.0] * 16), (n + 2, [float("nan")] * 16), (n + 3, [None] * 16), (n + 4, [float("inf")] * 16), (n + 5, [2 * x for x in rows[0][1]])]
    return rows


def test_pivots_equal_brute_force(spark):
    rows = vectors()
    degree, want = cosine_links(rows, 0.95)
    frame = spark.createDataFrame([(i, v, 0, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, label int, rep string, pivot int")
    got = {r.vec_id: r for r in pivot_components(frame).collect()}
    assert len(got) == len(rows)
    missed = sum(got[i].n_links != degree[i] for i in got)
    assert missed <= 0.02 * len(rows)
    assert sum(got[i].component_id != want[i] for i in got) <= 0.02 * len(rows)
    assert all(got[i].n_links <= degree[i] for i in got)  # nothing below the threshold


def test_pivots_find_all_links_of_dense_groups(spark):
    """One near-copy group holds a third of 20,000 rows; the rest is loose, with some pairs about the threshold."""
    rng = np.random.default_rng(5)
    n, dim = 20000, 64
    x = rng.normal(size=(n, dim))
    x[: n // 3] = rng.normal(size=dim) + np.sqrt(0.03 / 0.97) * x[: n // 3]
    x[-2000:] = x[-4000:-2000] + 0.3 * x[-2000:]
    x = x[rng.permutation(n)].astype(np.float32)
    u = x.astype(np.float64) / np.sqrt((x.astype(np.float64) ** 2).sum(1))[:, None]
    want = np.concatenate([(u[at : at + 2000] @ u.T >= 0.95).sum(1) for at in range(0, n, 2000)]) - 1
    frame = spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<float>")
    got = pivot_components(frame.repartition(8)).toPandas().sort_values("vec_id")
    assert want.max() > 6000
    assert (got["n_links"].to_numpy() == want).all()
    assert (got["component_id"] == got["component_id"].iloc[want.argmax()]).sum() >= n // 3


def test_pivots_odd_tables(spark):
    schema = "vec_id long, embedding array<float>"
    assert pivot_components(spark.createDataFrame([], schema)).collect() == []
    got = sorted(map(tuple, pivot_components(spark.createDataFrame([(3, None), (4, [0.0, 0.0])], schema)).collect()))
    assert got == [(3, 0, 3, True), (4, 0, 4, True)]
    got = sorted(map(tuple, pivot_components(spark.createDataFrame([(7, [1.0, 2.0]), (5, [1.0, 2.0]), (6, [2.0, 4.0])], schema)).collect()))
    assert got == [(5, 2, 5, True), (6, 2, 5, False), (7, 2, 5, False)]


def test_pivots_where_ids_repeat(spark):
    """One row a row: usable and unusable vectors under one id, and different vectors under one id."""
    x, y, z = [1.0, 0.0, 0.0, 0.1], [0.0, 1.0, 0.5, 0.0], [-0.0, 1.0, 0.5, 0.01]
    rows = [(1, x), (1, None), (2, x), (1, [0.0] * 4), (7, y), (2, y), (9, z), (None, x), (4, [1.0, 2.0]), (9, [float("nan")] * 4)]
    got = pivot_components(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    want = [(1, 1, 1), (1, 0, 1), (2, 1, 1), (1, 0, 1), (7, 2, 2), (2, 2, 2), (9, 2, 2), (None, 0, None), (4, 0, 4), (9, 0, 9)]
    assert sorted((str(r.vec_id), r.n_links, r.component_id) for r in got if r.vec_id) == sorted((str(i), n, c) for i, n, c in want if i)
    assert len(got) == len(rows) and all(r.kept == (r.vec_id == r.component_id) for r in got if r.vec_id)


@pytest.mark.parametrize("n", [1000, 8000])
def test_pivots_recall_on_planted_copies(spark, monkeypatch, n):
    """Loose copies about the threshold beside vectors without structure, with small blocks: at least 0.99 of the links."""
    monkeypatch.setattr(pivot_dedup, "BLOCK_BYTES", 256 * 64 * 4)
    rng = np.random.default_rng(n)
    base = rng.normal(size=(n // 2, 64))
    x = np.concatenate([base, base + rng.choice([0.1, 0.2, 0.3, 0.32], (n // 2, 1)) * rng.normal(size=base.shape)]).astype(np.float32)
    u = x.astype(np.float64)
    u /= np.sqrt((u * u).sum(axis=1))[:, None]
    want = (u @ u.T >= 0.95).sum(axis=1) - 1
    got = pivot_components(spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<float>")).toPandas().sort_values("vec_id")
    links = got["n_links"].to_numpy()
    assert (links <= want).all() and links.sum() >= 0.99 * want.sum() > 0.3 * n


def test_lines_keep_columns_of_any_name(spark):
    names = "doc_id long, text string, source string, page_host string, host_drops int, page_salt int, kept_lines int, n_lines int, n_dropped int, `a.b` int"
    frame = spark.createDataFrame([(i, f"menu\nbody {i}", "h", "mine", 1, 2, 3, 4, 5, 6) for i in range(4)], names)
    got = drop_boilerplate_lines(frame, least_pages=2)
    assert got.columns == [*frame.columns, "n_lines_", "n_dropped_"]
    assert all(r.page_host == "mine" and r.n_lines == 4 and r.n_lines_ == 2 and r.n_dropped_ == 1 and r.text == f"body {r.doc_id}" for r in got.collect())


def test_lines_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    lines = [f"line {i}" for i in range(40)] + ["", "  ", " menu "]
    rows = []
    for i in range(120):
        own = list(rng.choice(lines, 6)) + (["menu"] if i % 3 == 0 else [])
        rows.append((i, "\n".join(own), ["a", "b", None, "tiny"][min(int(rng.integers(0, 40)) // 10, 3)]))
    rows += [(200, None, "a"), (201, "", "a"), (202, "menu", "solo"), (203, "menu\nmenu", "solo")]
    frame = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, source string, host string, line_hash string")
    for least in (2, 1):
        kept = drop_boilerplate_lines(frame, least_pages=least).collect()
        assert {r.doc_id: r.text for r in kept} == boilerplate(rows, 0.1, least)
    assert set(frame.columns) <= set(kept[0].asDict())
    assert drop_boilerplate_lines(frame.limit(0)).count() == 0


def test_lines_by_shuffle_equal_lines_by_broadcast(spark, monkeypatch):
    from resolake.llm import line_dedup

    frame = spark.createDataFrame([(i, f"head\nbody {i}\nhead", f"h{i % 3}") for i in range(60)], "doc_id long, text string, source string")
    want = sorted(map(str, drop_boilerplate_lines(frame).select("doc_id", "text", "n_dropped").collect()))
    monkeypatch.setattr(line_dedup, "BROADCAST_LINES", -1)
    assert sorted(map(str, drop_boilerplate_lines(frame).select("doc_id", "text", "n_dropped").collect())) == want
    assert drop_boilerplate_lines(frame).agg(F.sum("n_dropped")).first()[0] == 120
