"""Banded alignment against plain dynamic programming, and sequence clusters against all pairs."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from resolake.operators import alignment as A
from resolake.operators import clustering as C

LETTERS = list("ACDEFGHIKLMNPQRSTVWY")


def plain_alignment(q, t, diagonal, band):
    """(score, identical, query span, target span, columns) cell by cell, with the operator's preferences."""
    match, mismatch, gap = A.Scoring()
    cells, best = {}, ((0, 0), None, None)
    for i in range(len(q)):
        for j in range(max(0, i + diagonal - band), min(len(t), i + diagonal + band + 1)):
            (score, same), begin = cells.get((i - 1, j - 1), ((0, 0), (i, j)))
            found = ((score + match, same + 1) if q[i] == t[j] else (score + mismatch, same)), begin
            for before in ((i - 1, j), (i, j - 1)):
                if before in cells:
                    (score, same), begin = cells[before]
                    if (score + gap, same) > max(found[0], (0, 0)):
                        found = (score + gap, same), begin
            if found[0] > (0, 0):
                cells[i, j] = found
                if found[0] > best[0]:
                    best = (*found, (i, j))
    (score, same), begin, end = best
    spans = (end[0] - begin[0] + 1, end[1] - begin[1] + 1) if end else (0, 0)
    return score, same, *spans


SEQUENCE = st.lists(st.integers(0, 3), min_size=1, max_size=25)


@given(st.lists(st.tuples(SEQUENCE, SEQUENCE, st.integers(-4, 4)), min_size=1, max_size=5), st.integers(0, 6))
@settings(max_examples=150, deadline=None)
def test_alignment_equals_plain_cells(pairs, band):
    q, t, d = ([np.array(x, np.int32) for x in side] if n < 2 else np.array(side) for n, side in enumerate(zip(*pairs, strict=True)))
    got = A.banded_alignments(q, t, d, band)
    want = [plain_alignment(a, b, x, band) for a, b, x in pairs]
    assert list(zip(*(got[c].tolist() for c in ("score", "identical", "query_span", "target_span")), strict=True)) == want
    pairs_and_gaps = A.columns_of(got)
    assert (pairs_and_gaps >= np.maximum(got["query_span"], got["target_span"])).all() and (pairs_and_gaps <= got["query_span"] + got["target_span"]).all()
    n, m = np.array([len(x) for x in q]), np.array([len(x) for x in t])
    covering = np.flatnonzero((got["query_span"] >= 0.8 * n) & (got["target_span"] >= 0.8 * m))
    assert set(covering) <= set(A.may_cover(q, t, d, band, 0.8))


def test_alignment_of_nothing():
    assert len(A.banded_alignments([], [], np.array([]), 3)["score"]) == 0
    assert A.banded_alignments([A.codes("")], [A.codes("")], np.array([0]), 3)["query_span"].tolist() == [0]


def mutated(rng, base, changes, indels):
    out = list(base)
    for at in rng.choice(len(out), int(changes * len(out)), replace=False):
        out[at] = LETTERS[int(rng.integers(20))]
    for _ in range(indels):
        at = int(rng.integers(len(out)))
        if rng.random() < 0.5:
            del out[at]
        else:
            out.insert(at, LETTERS[int(rng.integers(20))])
    return "".join(out)


def families(rng, n, each, most):
    rows = []
    for _ in range(n):
        base = "".join(rng.choice(LETTERS, int(rng.integers(80, 160))))
        rows += [base] + [mutated(rng, base, rng.uniform(0, most), int(rng.integers(0, 4))) for _ in range(each - 1)]
    return rows


def all_pairs(seqs, identity=0.3, coverage=0.8, band=40):
    """Links of every pair, a to a longer (or equal, earlier) b."""
    order = sorted(range(len(seqs)), key=lambda i: (-len(seqs[i]), i))
    pairs = [(order[x], order[y]) for x in range(len(order)) for y in range(x) if len(seqs[order[x]]) >= coverage * len(seqs[order[y]])]
    coded, links = [A.codes(s) for s in seqs], {}
    for i in range(0, len(pairs), 4000):
        a, b = ([coded[p[k]] for p in pairs[i : i + 4000]] for k in (0, 1))
        zero = np.zeros(len(a), np.int64)
        good = A.may_cover(a, b, zero, band, coverage)
        found = A.banded_alignments([a[x] for x in good], [b[x] for x in good], zero[good], band)
        same = found["identical"] / np.maximum(A.columns_of(found), 1)
        for k, x in enumerate(good):
            if same[k] >= identity and found["query_span"][k] >= coverage * len(a[x]) and found["target_span"][k] >= coverage * len(b[x]):
                links[pairs[i + x]] = same[k]
    return links


def greedy(n, seqs, links):
    rep = {}
    for i in sorted(range(n), key=lambda i: (-len(seqs[i]), i)):
        best = sorted((-s, b) for (a, b), s in links.items() if a == i and rep[b] == b)
        rep[i] = best[0][1] if best else i
    return rep


def test_clusters_equal_all_pairs(spark):
    """500 sequences of 50 families, up to a quarter of their letters drawn anew, so pairs have from half of them in common."""
    seqs = families(np.random.default_rng(11), 50, 10, 0.25)
    want = greedy(len(seqs), seqs, all_pairs(seqs))
    got = {r.name: r.representative for r in C.sequence_clusters(spark.createDataFrame(list(enumerate(seqs)), "name long, seq string")).collect()}
    assert got == want
    assert len(set(want.values())) <= 60


def test_candidates_find_nine_of_ten_links(spark):
    """Recall of the index alone, two hits on a diagonal, where three letters in ten and more are drawn anew on both sides."""
    seqs = families(np.random.default_rng(12), 60, 5, 0.35)
    links = all_pairs(seqs)
    base = spark.createDataFrame(list(enumerate(seqs)), "name long, seq string")
    k = C.word_length(base)
    index = C.kmer_index(base, k, 1, 0.8)
    pairs = {(r.a, r.b) for r in C.candidate_pairs(index, C._tops(index), 0.8, 2, k).collect()}
    assert len(pairs & links.keys()) / len(links) >= 0.9


@pytest.mark.parametrize("every", [1, 3])
def test_odd_sequences(spark, every):
    rng = np.random.default_rng(3)
    word = lambda n: "".join(rng.choice(list("abcdefghij"), n))
    a, b, long = word(200), word(190), word(4000)
    texts = [(1, a + b + long), (2, a), (3, a), (4, a[:198]), (6, b), (7, b), (8, "ab"), (9, "ab"), (10, None), (11, ""), (12, "x" * 3000), (13, "x" * 2900), (None, b), (14, long), (14, long), (15, long[:3500] + word(30))]
    got = C.sequence_clusters(spark.createDataFrame(texts, "name long, seq string"), every=every).collect()
    rep = {r.name: r.representative for r in got}
    assert len(got) == len(texts)
    # 14 lies in nine tenths of 1, and 15 in too little of it; words of one letter all have one place
    assert rep == {1: 1, 2: 2, 3: 2, 4: 2, 6: 6, 7: 6, None: None, 8: 8, 9: 9, 10: 10, 11: 11, 12: 12, 13: 13, 14: 1, 15: 15}
    assert C.sequence_clusters(spark.createDataFrame([], "name long, seq string")).collect() == []


def test_one_word_that_all_share(spark):
    """A posting of every sequence: each meets the longest only, and families still meet by their own words."""
    rng = np.random.default_rng(9)
    rows = ["COMMONWORDCOMMON" + s for s in families(rng, 20, 3, 0.1)]
    got = {r.name: r.representative for r in C.sequence_clusters(spark.createDataFrame(list(enumerate(rows)), "name long, seq string")).collect()}
    assert got == greedy(len(rows), rows, all_pairs(rows))


@pytest.mark.parametrize("coverage", [0.8, 0.0])
def test_packed_index_equals_rows(spark, coverage):
    """Pairs, long postings and their words of the packed index against those of an index of rows; a name of two texts, a word that all share."""
    rng = np.random.default_rng(21)
    seqs = ["COMMONWORDCOMMON" + s for s in families(rng, 12, 4, 0.2)]
    base = spark.createDataFrame([(f"s{n % 45}", s) for n, s in enumerate(seqs)], "name string, seq string")
    rows, packed = C.kmer_index(base, 4, 2, coverage), C.packed_index(base, 4, 2, coverage, 7).cache()
    tops = C._tops(rows)
    pairs = {tuple(r) for r in C.packed_pairs(packed, coverage, 2, 4).collect()}
    assert pairs == {tuple(r) for r in C.candidate_pairs(rows, tops, coverage, 2, 4).where("a <> b").collect()} and len(pairs) > 40
    kept = lambda t: {(r["kmer"], r["class"], r["n"], r["top"]["name"]) for r in t.where(f"n > {C.FULL_POSTING}").collect()}
    long = kept(C.packed_tops(packed, coverage))
    assert long == kept(tops) and long
    asked = tops.where(f"n > {C.FULL_POSTING}").select("kmer", "class")
    words = lambda t: sorted((r["name"], r["neg"], r["at"], tuple(r["classes"]), r["kmer"], r["class"]) for r in t.collect())
    assert words(C.packed_words(packed, asked, coverage, 7)) == words(rows.join(asked, ["kmer", "class"], "left_semi"))
    stored = sum(len(r["kmer"]) // 8 for r in packed.select("kmer").collect())
    assert stored == rows.join(tops, ["kmer", "class"], "left_semi").select("name", "neg", "kmer", "at").distinct().count() < rows.count()


@given(st.lists(st.tuples(SEQUENCE, SEQUENCE, st.integers(-9, 9)), min_size=1, max_size=8), st.integers(0, 4), st.sampled_from([0.3, 0.6, 0.8, 1.0]))
@settings(max_examples=150, deadline=None)
def test_room_holds_every_covering_alignment(pairs, band, coverage):
    """Few columns and steps, so that pairs are looked at several times and hand on their places."""
    q, t, d = ([np.array(x, np.int32) for x in side] if n < 2 else np.array(side) for n, side in enumerate(zip(*pairs, strict=True)))
    n, m = np.array([len(x) for x in q]), np.array([len(x) for x in t])
    got = A.banded_alignments(q, t, d, band)
    covering = set(np.flatnonzero((got["score"] > 0) & (got["query_span"] / n >= coverage) & (got["target_span"] / m >= coverage)).tolist())
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(A, "COLUMNS", 2)
        patch.setattr(A, "STEPS", 3)
        may = set(A.may_cover(q, t, d, band, coverage).tolist())
    assert covering <= may <= set(np.flatnonzero(A.room(n, m, d, band, coverage).enough).tolist())


def test_unrelated_pairs_end_early():
    """Long pairs that share no family: none is left to align, and of a family each is."""
    rng = np.random.default_rng(8)
    word = lambda n: "".join(rng.choice(LETTERS, n))
    a, b = [word(3000) for _ in range(40)], [word(3200) for _ in range(40)]
    a[7] = mutated(rng, b[7], 0.3, 5)
    coded = [[A.codes(s) for s in side] for side in (a, b)]
    assert A.may_cover(*coded, np.zeros(40, np.int64), 16, 0.8).tolist() == [7]
    far = A.may_cover(*coded, np.full(40, 1500), 16, 0.8)
    assert len(far) == 0 and not A.room(np.full(40, 3000), np.full(40, 3200), np.full(40, 1500), 16, 0.8).enough.any()


def test_pairs_without_room_get_no_sequences(spark):
    rng = np.random.default_rng(5)
    sizes = [(int(x), int(n)) for x, n in enumerate(rng.integers(20, 120, 60))]
    pairs = [(int(a), int(b), int(d)) for a, b, d in zip(rng.integers(60, size=400), rng.integers(60, size=400), rng.integers(-90, 90, 400), strict=True)]
    frame, table = spark.createDataFrame(pairs, "a long, b long, diagonal int"), spark.createDataFrame([*sizes, (0, 500)], "name long, len int")
    length = dict(sizes)
    a, b, d = (np.array(x) for x in zip(*pairs, strict=True))
    enough = A.room(np.array([length[x] for x in a]), np.array([length[x] for x in b]), d, 4, 0.8).enough | (a == 0) | (b == 0)  # 0 names two sequences
    assert sorted(tuple(r) for r in C.with_room(frame, table, 4, 0.8).collect()) == sorted(p for p, x in zip(pairs, enough, strict=True) if x)
    assert 0 < enough.sum() < 200
