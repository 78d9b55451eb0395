"""Importance resampling, robust outliers and the divergence audit against brute force, with odd inputs."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from resolake.llm import divergence_audit as D
from resolake.llm import importance_resampling as R
from resolake.llm import queries
from resolake.llm import robust_outliers as O
from resolake.llm.common import table
from resolake.llm.radix_trie import RadixTrie

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, weight string, g string, part int, n_words int, spread int"


def frame(spark, rows):
    """Rows (doc_id, text, lang, source) with further columns whose names clash."""
    return spark.createDataFrame([(*r, "w", "g", 1, 2, 3) for r in rows], SCHEMA)


def ascii_lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def odd_documents():
    rng = np.random.default_rng(5)
    words = [f"{a}{b}" for a in "aé中b" for b in ("x", "yz", "ßq", "10")]
    docs = []
    for i in range(120):
        n = int(rng.integers(0, 60))
        docs.append((i, " ".join(rng.choice(words, n, p=np.arange(1, 17) / 136)), ["en", "de", None][i % 3], ["s1", "s2", "s3", None][int(rng.integers(0, 4))]))
    docs += [(200, None, "en", "s1"), (201, "", "en", "s9"), (202, " \n\t 12 ---", "xx", None), (203, "lonely words", "yy", "z"), (3, docs[3][1], docs[3][2], docs[3][3]), (None, "no id " * 20, "en", "s1")]
    docs += [(300 + i, "Same Text é " * 30, "en", "s2") for i in range(5)]
    return [*docs, (400, "long " * 200_000 + "x" * 300_000, "en", "s1")]


# importance resampling


def resampled(docs, target, longest, buckets, least, percent):
    def grams(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(text))
        return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, longest + 1) for i in range(len(w) - n + 1)]

    own = [(i, *grams(t)) for i, t, *_ in docs]
    s, t = Counter(b for _, _, g in own for b in g), Counter(b for x in target for b in grams(x)[1])
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets)))) for b in range(buckets)]
    out = []
    for i, n, g in own:
        weight = sum(gain[b] for b in g)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n >= least])
    can = sorted((x for x in out if x[4]), key=lambda x: (-x[3], math.inf if x[0] is None else x[0]))
    ranks = {id(x): k + 1 for k, x in enumerate(can[: percent * len(can) // 100])}
    return [(*x[:4], ranks.get(id(x))) for x in out]


def ordered(rows):
    return sorted(map(tuple, rows), key=str)


@pytest.mark.parametrize(("longest", "buckets", "percent"), [(1, 10_000, 10), (3, 97, 50), (2, 1 << 16, 100)])
def test_resampling_equals_brute_force(spark, longest, buckets, percent):
    docs, target = odd_documents(), ["ayz b10 Ax", None, "éx éx中", ""]
    goal = spark.createDataFrame([(t, 1) for t in target], "text string, id int")
    got = R.resample(frame(spark, docs).repartition(5), goal, longest=longest, buckets=buckets, percent=percent)
    assert ordered(got.collect()) == ordered(resampled(docs, target, longest, buckets, 20, percent))
    assert dict(got.dtypes) == dict.fromkeys(["doc_id", "n_features", "weight", "score", "rank"], "bigint")


def test_resampling_of_empty_tables(spark):
    docs = frame(spark, odd_documents())
    none = docs.limit(0)
    assert R.resample(none, docs).collect() == []
    got = R.resample(docs, none)
    assert ordered(got.collect()) == ordered(resampled(odd_documents(), [], 1, 10_000, 20, 10))
    with pytest.raises(ValueError, match="buckets"):
        R.resample(docs, docs, buckets=1 << 17)


@given(st.lists(st.lists(st.integers(0, 65535), max_size=30), min_size=1, max_size=20))
@settings(max_examples=50, deadline=None)
def test_streams_count_and_gather(lists):
    block = R._block(list(range(len(lists))), [0] * len(lists), [np.array(x, np.uint16) for x in lists])
    counts = Counter()
    for b in R._run_lengths(iter([block.select(["stream"])])):
        counts.update(dict(zip(*(c.to_pylist() for c in b.columns), strict=True)))
    assert counts == Counter(v for x in lists for v in x)
    gains = np.arange(65536, dtype=np.int64) * 7 - 100_000
    (out,) = R._weigh(gains)(iter([block]))
    assert out.column(3).to_pylist() == [int(gains[x].sum()) if x else 0 for x in lists]


# robust outliers


def statistics(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    covered = {j for i, w in enumerate(windows) if often[w] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), len(lines)


@given(st.text("ab é\n\t#|  \r中", max_size=80))
@settings(max_examples=300, deadline=None)
def test_statistics_of_texts(text):
    assert O.text_statistics(text) == statistics(text)


def test_statistics_of_long_texts():
    text = ("some words in a row that come back\n" * 3 + "# % & other line\n") * 40_000  # 4 MB
    n, chars, symbols, repeated, covered, lines = O.text_statistics(text)
    assert (n, symbols, repeated, covered, lines) == (len(text.split()), 120_000, 159_998, len(text.split()), 160_000)
    assert O.text_statistics("x" * 5_000_000 + "é中") == (1, 5_000_002, 0, 0, 0, 1)
    assert O.text_statistics(None) == O.text_statistics("") == (0,) * 6


def distances(vectors, share=0.75):
    """Plain concentration steps of one group, with the operator's bins."""
    x = np.array(vectors, float)
    n, dims, least = len(x), O.DIMS, np.array(O.LEAST_SCALE) * O.UNITS

    def median(v):
        return np.sort(v)[(len(v) - 1) // 2]

    def bins(d2):
        return np.floor(O.BINS * np.log2(np.clip(d2, 2.0**O.LOW, 2.0**O.HIGH)))

    def step(d2, part):
        b = bins(d2)
        order = np.sort(b)
        near = x[b <= order[math.ceil(n * part) - 1]]
        factor = part / (1 - O.chi2_tail(O.chi2_quantile(part, dims), dims + 2))
        cov = factor * (near.T @ near / len(near) - np.outer(near.mean(0), near.mean(0))) + np.diag(least**2)
        d = x - near.mean(0)
        return np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d), np.linalg.slogdet(cov)[1]

    v = np.floor(x / 16)
    m = np.array([median(c) for c in v.T])
    mad = np.array([median(np.abs(c - k)) for c, k in zip(v.T, m, strict=True)])
    z = ((x / 16 - m) / np.maximum(mad * 1.4826, least / 16)) ** 2
    found = []
    for first in (z.sum(1), z.max(1) * dims):
        before, (d2, det) = first, step(first, 0.5)
        dets = [det]
        for _ in range(O.STEPS):
            before, (d2, det) = d2, step(d2, share)
            dets.append(det)
        found.append((det, d2, before))
    det, d2, before = min(found, key=lambda f: f[0])
    scale = max(1.0, 2 ** ((median(bins(before)) + 0.5) / O.BINS) / O.chi2_quantile(0.5, dims))
    return d2 / scale


def prose(rng, n, symbols=0, length=5):
    return " ".join("".join(rng.choice(list("abcdefghij"), max(1, int(rng.normal(length, 1))))) + "#" * symbols for _ in range(n))


def test_verdicts_equal_plain_steps(spark):
    rng = np.random.default_rng(3)
    docs = [(i, prose(rng, int(rng.integers(12, 300)), symbols=i % 5 == 0, length=8 if i % 7 == 0 else 5), "en", "src") for i in range(300)]
    got = {r.doc_id: r for r in O.quality_rules(frame(spark, docs).repartition(4)).collect()}
    vectors = []
    for _, text, *_ in docs:
        n, chars, symbols, dup, rep, lines = statistics(text)
        values = [math.log1p(n), math.log((chars + 25) / (n + 5)), math.sqrt(symbols / (chars + 50)), math.sqrt(dup / (lines + 10)), math.sqrt(rep / (n + 20))]
        vectors.append([round(O.UNITS * v) for v in values])
    want = distances(vectors)
    assert [got[i].distance for i in range(300)] == pytest.approx(want, rel=0.02)  # ends when determinants rest
    assert all(got[i].kept == (want[i] <= O.chi2_quantile(0.9999, 5)) for i in range(300))
    assert {i for i in got if not got[i].kept} == {i for i in range(300) if i % 5 == 0}


def test_groups_odd_rows_and_partitions(spark):
    rng = np.random.default_rng(4)
    docs = [(i, prose(rng, 40), "en", "a") for i in range(150)] + [(1000 + i, prose(rng, 40), "de", f"s{i % 9}") for i in range(120)]
    docs += [(2000 + i, prose(rng, 40), f"l{i % 50}", None) for i in range(110)] + [(1, prose(rng, 40), "en", "a"), (None, prose(rng, 40), "en", "a")]
    docs += [(3000, None, None, None), (3001, "", "en", "a"), (3002, "one two three four five " * 30, "en", "a"), (3003, prose(rng, 60, 2), "en", "a"), (3004, prose(rng, 60, 2), "de", "s1"), (3005, prose(rng, 60, 2), "l3", None)]
    a = O.quality_rules(frame(spark, docs).repartition(1)).collect()
    b = O.quality_rules(frame(spark, docs[::-1]).repartition(7)).collect()
    assert ordered(a) == ordered(b) and len(a) == len(docs)  # sums are exact: no result depends on the dealing
    for r, (_, text, *_) in zip(sorted(a, key=lambda r: (r.doc_id is None, r.doc_id or 0, r.word_chars)), sorted(docs, key=lambda d: (d[0] is None, d[0] or 0, statistics(d[1])[1])), strict=True):
        n, chars, symbols, dup, rep, _ = statistics(text)
        assert tuple(r)[1:6] == (n, chars, symbols, dup, rep)
        assert r.base_failed == (n < 10 or 100 * rep > 20 * n)
    assert {r.doc_id for r in a if not r.kept} == {3000, 3001, 3002, 3003, 3004, 3005}
    few = O.quality_rules(frame(spark, docs[:20])).collect()
    assert all(r.distance is None and r.kept for r in few)
    assert O.quality_rules(frame(spark, docs).limit(0)).collect() == []


def test_many_groups_are_joined_by_shuffle(spark, monkeypatch):
    rng = np.random.default_rng(6)
    docs = [(i, prose(rng, int(rng.integers(15, 60)), symbols=i % 9 == 0), ["en", "de"][i % 2], "ab"[i % 3 == 0]) for i in range(420)]
    docs += [(None, "few words", None, None)]
    want = ordered(O.quality_rules(frame(spark, docs), least_rows=50).collect())
    audit = ordered(D.divergence_audit(frame(spark, docs)).collect())
    monkeypatch.setattr(O, "BROADCAST_GROUPS", -1)
    monkeypatch.setattr(D, "BROADCAST_GROUPS", -1)
    assert ordered(O.quality_rules(frame(spark, docs), least_rows=50).collect()) == want
    assert ordered(D.divergence_audit(frame(spark, docs)).collect()) == audit


def test_labelled_documents(spark):
    """Clean documents stay, and most of what the fixed limits leave of the others goes."""
    got = O.quality_rules(table(spark, "/root/testdata/sf0.01", "documents")).where(~F.col("base_failed"))
    rows = got.join(table(spark, "/root/testdata/sf0.01", "labels"), "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()
    kept = {r.quality: r.kept for r in rows}
    assert kept[1] >= 0.995 and kept[0] <= 0.1


# divergence audit

@given(st.lists(st.text("abé中", max_size=14), max_size=80))
@settings(max_examples=200, deadline=None)
def test_trie_numbers_terms_in_byte_order(terms):
    trie, numbers = RadixTrie(), {}
    for term in terms:
        assert trie.leaf(term.encode()) == numbers.setdefault(term.encode(), len(numbers))
    assert list(trie) == sorted(numbers.items())


@given(st.lists(st.one_of(st.none(), st.text("aZé中9 -", max_size=12)), max_size=12), st.integers(0, 3))
@settings(max_examples=200, deadline=None)
def test_words_of_columns(texts, skip):
    words, rows = D.words_of(pa.array([None] * skip + texts, pa.string()).slice(skip), D.LETTERS)
    want = [(w.encode(), i) for i, t in enumerate(texts) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", ascii_lower(t))]
    assert list(zip(words.to_pylist(), rows.tolist(), strict=True)) == want


def audited(docs, least, top):
    out, by_lang = [], defaultdict(lambda: defaultdict(Counter))
    documents = defaultdict(Counter)
    for _, text, lang, source in docs:
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", ascii_lower(text))
        by_lang[lang or ""][source or ""].update(words)
        documents[lang or ""].update(set(words))
    for lang, sources in by_lang.items():
        kept = [t for t, n in documents[lang].items() if n >= least]
        p = {}
        for s, c in [*sources.items(), (None, sum(sources.values(), Counter()))]:
            n = sum(c[t] for t in kept)
            p[s] = {t: 1 + 10**9 * (c[t] + 1) // (n + len(kept)) for t in kept}
        f = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            pairs = sorted((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in sources if o != s)
            terms = sorted((-f(p[s][t], p[None][t]), t.encode()) for t in kept if sources[s][t] and p[s][t] > p[None][t])[:top]
            for part, found in (("pair", pairs), ("term", terms)):
                out += [(lang, s, part, item.decode(), -v, k + 1) for k, (v, item) in enumerate(found)]
    return out


@pytest.mark.parametrize(("least", "top"), [(3, 200), (1, 2), (1000, 5)])
def test_audit_equals_brute_force(spark, least, top):
    docs = odd_documents()
    got = D.divergence_audit(frame(spark, docs).repartition(6), least_documents=least, top=top)
    assert ordered(got.collect()) == ordered(audited(docs, least, top))
    assert dict(got.dtypes)["value"] == "bigint" and dict(got.dtypes)["rank"] == "int"


def test_audit_of_empty_and_single(spark):
    docs = frame(spark, odd_documents())
    assert D.divergence_audit(docs.limit(0)).collect() == []
    assert D.divergence_audit(docs.where("doc_id = 203")).collect() == []


def test_tries_that_overflow(monkeypatch):
    """Leaves of tries that were streamed out and begun anew add up."""
    monkeypatch.setattr(D, "TRIE_SIZE", 5)
    docs = [d for d in odd_documents() if d[0] != 400]
    columns = [pa.array([(d[k] or "") if k > 1 else d[1] for d in docs], pa.string()) for k in (2, 3, 1)]
    whole = pa.RecordBatch.from_arrays(columns, names=["lang", "source", "text"])
    parts = list(D._count_terms(iter([whole.slice(i, 10) for i in range(0, len(docs), 10)])))
    assert len(parts) > 3
    leaves = pa.Table.from_batches(parts).sort_by([("lang", "ascending"), ("term", "ascending")]).combine_chunks().to_batches(max_chunksize=7)
    merged = pa.Table.from_batches(D._merge_leaves(iter(leaves))).to_pylist()
    got = {(r["lang"], r["term"]): (r["documents"], dict(zip(r["sources"], r["counts"], strict=True))) for r in merged}
    assert len(got) == len(merged)
    want = {}
    for _, text, lang, source in docs:
        for term, n in Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", ascii_lower(text))).items():
            k, c = want.setdefault((lang or "", term), (0, Counter()))
            c[source or ""] += n
            want[lang or "", term] = (k + 1, c)
    assert got == {k: (n, dict(c)) for k, (n, c) in want.items()}


def test_shares_of_very_large_counts():
    totals, counts = np.array([10**15 + 7, 9 * 10**15, 12]), np.array([[10**15, 123456789012345, 0], [0, 8999999999999998, 11]])
    assert D.shares(counts, totals).tolist() == [[1 + 10**9 * (int(c) + 1) // int(t) for c, t in zip(row, totals, strict=True)] for row in counts]


def test_queries_on_whole_tables(spark):
    docs = [tuple(r) for r in table(spark, DATA, "documents").select("doc_id", "text", "lang", "source").collect()]
    target = [r.text for r in table(spark, DATA, "benchmark").collect()]
    assert ordered(queries.op11_importance_resampling(spark, DATA).collect()) == ordered(resampled(docs, target, 1, 10_000, 20, 10))
    assert ordered(queries.op13_divergence_audit(spark, DATA).collect()) == ordered(audited(docs, 3, 200))
    rules = {r.doc_id: r for r in queries.op12_robust_outliers(spark, DATA).collect()}
    assert all(tuple(rules[i])[1:6] == statistics(t)[:5] for i, t, *_ in docs) and len(rules) == len(docs)
