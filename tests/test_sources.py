"""Readers, writers and resumable processing on small files."""

import json
from urllib.parse import unquote
from xml.etree import ElementTree

import numpy as np
import pytest
from pyspark.sql import functions as F

from resolake.operators import attention
from resolake.sources import json_arrays, readers, sinks, tables
from resolake.streaming import resume


def write(path, text):
    path.write_text(text)
    return str(path)


def test_neq_table_drops_bad_rows(spark, tmp_path):
    p = write(tmp_path / "a.csv", 'name,sequence,neq\np1,ACD,"[1.0, 1.5, 2.0]"\np2,AC,"[1.0]"\np3,AC,"[1.0, nan]"\np4,,"[1.0]"\n')
    assert [(r.name, r.neq) for r in readers.neq_table(spark, p).collect()] == [("p1", [1.0, 1.5, 2.0])]
    assert readers.neq_table(spark, p, max_len=2).count() == 0


def test_neq_long_truncates_and_labels(spark, tmp_path):
    p = write(tmp_path / "a.tsv", "protein\tsequence\tneq\np1\tACD\t[1.0, 1.5]\np2\tA\t2.5\n")
    got = readers.neq_long(spark, p, threshold=1.2).orderBy("name", "res_idx").collect()
    assert [(r.name, r.res_idx, r.aa, r.neq, r.label) for r in got] == [("p1", 1, "A", 1.0, 0), ("p1", 2, "C", 1.5, 1), ("p2", 1, "A", 2.5, 1)]


def test_annotations_and_arrays(spark, tmp_path):
    p = write(tmp_path / "n.csv", "id, seq, n, rsa, q3\n>p1,C,2,0.5,E\n>p1,A,1,0.25,H\n>p2,A,1,0.1,C\n")
    known = spark.createDataFrame([("p1",)], "name string")
    long = readers.annotations(spark, p, known)
    got = readers.annotation_arrays(long, ["q3", "rsa"]).collect()
    assert [(r.name, r.q3, r.rsa) for r in got] == [("p1", ["H", "E"], [0.25, 0.5])]


def test_fasta_round_trip(spark, tmp_path):
    p = write(tmp_path / "x.fasta", ">1ABC_A some text\nACD\nEFG\n\n>2XYZ_B\nKK\n")
    assert sorted(map(tuple, readers.fasta(spark, p, True).collect())) == [("1ABC_A", "ACDEFG"), ("2XYZ_B", "KK")]
    assert "1ABC_A some text" in [r.id for r in readers.fasta(spark, p).collect()]
    sinks.write_fasta(readers.fasta(spark, p, True).withColumnRenamed("id", "domain"), str(tmp_path / "out"))
    assert sorted(map(tuple, readers.fasta(spark, str(tmp_path / "out")).collect())) == [("1ABC_A", "ACDEFG"), ("2XYZ_B", "KK")]


def test_attention_records(spark, tmp_path):
    p = write(tmp_path / "a.json", json.dumps([{"name": "p", "attention_weights": [[1.0]]}, {"sequence": "A"}]))
    assert [(r.name, r.sequence) for r in readers.attention_records(spark, p).collect()] == [("p", "")]
    with pytest.raises(Exception, match="without name"):
        readers.attention_records(spark, p, tolerant=False).collect()


def test_interpro(spark, tmp_path):
    sites = [{"description": "s", "siteLocations": [{"start": 3, "end": 4, "residue": "C"}, {"start": 7, "residue": "D"}]}]
    doc = {"results": [{"md5": "m", "xref": [{"id": "p1"}], "matches": [{"locations": [{"start": 2, "end": 5, "sites": sites}]}]}, {"md5": "m2", "xref": [], "matches": [{"locations": [{"start": 1, "end": 2, "sites": None}]}]}]}
    p = write(tmp_path / "i.json", json.dumps(doc))
    assert sorted((r.name, r.i) for r in readers.functional_positions(spark, p).collect()) == [("p1", 2), ("p1", 3), ("p1", 6)]
    assert [tuple(r) for r in readers.interpro_intervals(spark, p).collect()] == [("p1", 2, 5)]
    t = write(tmp_path / "i.tsv", "Accession\tStart\tEnd\np1\t2\t3\np1\tx\t3\n")
    assert sorted(map(tuple, readers.functional_positions(spark, t).collect())) == [("p1", 1), ("p1", 2)]


def test_run_directory(spark, tmp_path):
    write(tmp_path / "1abc_A_Neq.tsv", "aa\tNeq_R1\tNeq_R2\tNeq_R3\nA\t1.0\t2.0\t3.0\n")
    assert [tuple(r) for r in readers.run_directory(spark, str(tmp_path / "*_Neq.tsv")).collect()] == [("1abc_A", "A", 2.0)]


def test_rmsf_and_aliases(spark, tmp_path):
    p = write(tmp_path / "r.tsv", "sequence_name\tsequence\tavg_per_residue_rmsf\na\tAC\t[0.5, 1]\nb\tAC\tbad\n")
    assert [(r.name, r.rmsf) for r in readers.rmsf_table(spark, p).collect()] == [("a", [0.5, 1.0])]
    with pytest.raises(ValueError, match="none of"):
        readers.resolve_alias(["x"], ["y"])


def test_graph_writers(spark, tmp_path):
    edges = spark.createDataFrame([("g/<&", 0, 1, 0.5), ("g/<&", 1, 0, None)], "name string, src int, dst int, w double")
    nodes = spark.createDataFrame([("g/<&", 0), ("g/<&", 1), ("h", 0)], "name string, i int")
    for _ in range(2):  # earlier files are replaced
        sinks.write_graphml(edges, nodes, str(tmp_path / "g"))
    files = {unquote(f.stem): ElementTree.parse(f).getroot() for f in (tmp_path / "g").iterdir()}
    tag = "{http://graphml.graphdrawing.org/xmlns}"
    assert {n: (len(x.findall(f".//{tag}node")), [(e.get("source"), e.get("target"), e.findtext(f"{tag}data")) for e in x.findall(f".//{tag}edge")]) for n, x in files.items()} == {"g/<&": (2, [("0", "1", "0.5"), ("1", "0", None)]), "h": (1, [])}
    rec = sinks.graph_records(edges, spark.createDataFrame([("g/<&", "AC")], "name string, sequence string")).first()
    assert rec.length == 2 and rec.edges[0].weight == 0.5
    assert attention.degrees(edges, nodes).agg(F.sum("in_degree")).first()[0] == 2


def test_matrix_files(spark, tmp_path):
    rng = np.random.default_rng(1)
    want = {f"m{k}": rng.random((k + 1, 2 * k + 1)) for k in range(6)}
    cells = [(n, i, j, float(m[i, j])) for n, m in want.items() for i, j in np.ndindex(m.shape)]
    frame = spark.createDataFrame(cells[::-1], "name string, i int, j int, w double").repartition(5)
    out = tmp_path / "npy"
    sinks.write_npy(frame, str(out))
    assert {f.stem: np.load(f).tolist() for f in out.iterdir()} == {n: m.tolist() for n, m in want.items()}

    fails = F.when((F.col("name") == "m5") & (F.col("i") == 4), F.raise_error(F.lit("broken cell")).cast("double")).otherwise(F.col("w"))
    with pytest.raises(Exception, match="broken cell"):
        sinks.write_npy(frame.withColumn("w", fails), str(tmp_path / "failed"))
    assert list((tmp_path / "failed").rglob("*")) == [] or not (tmp_path / "failed").exists()
    sinks.write_npy(frame.limit(0), str(tmp_path / "none"))
    assert not list((tmp_path / "none").rglob("*.npy"))


RECORDS = [{"id": k, "note": 'quote " brace { bracket ] back\\slash \\" é{', "m": [[k, 1.5], [2, {"deep": "}]"}]], "o": {"a": {"b": []}}} for k in range(40)] + [{}, {"id": None, "note": "{" * 50}]


@pytest.mark.parametrize("split", [60, 200, 1000, 1 << 20])
@pytest.mark.parametrize(("wrap", "depth"), [(False, 1), (True, 2)])
def test_json_arrays_at_any_split_size(spark, tmp_path, split, wrap, depth):
    """Strings full of marks, nested objects and records longer than a split; three files."""
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for n, indent in enumerate((None, 1, 3)):
        doc = {"before": "[{", "results": RECORDS, "n": 1} if wrap else RECORDS
        (tmp_path / f"{n}.json").write_text(json.dumps(doc, indent=indent, ensure_ascii=n == 1))
    (tmp_path / "empty.json").write_text("[]")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    try:
        frame = json_arrays.record_texts(spark, str(tmp_path), depth)
        got = [r.text for r in frame.collect()]
        tasks = json_arrays._fragments(spark, str(tmp_path)).rdd.getNumPartitions()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted(json.dumps(json.loads(x)) for x in got) == sorted(json.dumps(x) for x in RECORDS * 3)
    assert tasks > 10 or split > 1000


def test_json_arrays_round_trip(spark, tmp_path):
    frame = spark.createDataFrame([(k, f"x{k}{{", [[1.0, k * 0.5]]) for k in range(50)], "k int, s string, m array<array<double>>").repartition(3)
    for wrap, depth in ((None, 1), ("results", 2)):
        path = tmp_path / str(wrap)
        json_arrays.write_arrays(frame, str(path), wrap)
        for f in path.glob("part-*"):
            json.loads(f.read_text())
        back = json_arrays.read_records(spark, str(path), "k int, s string, m array<array<double>>", depth)
        assert sorted(back.collect()) == sorted(frame.collect())


def test_summaries_and_reports(spark):
    a = spark.createDataFrame([(0.9, "x")], "`macro f1` double, note string")
    b = spark.createDataFrame([(1.5,)], "mse double")
    got = sinks.collect_summaries({"a": a, "b": b}).orderBy("run").collect()
    assert [(r.run, r.macro_f1, r.mse) for r in got] == [("a", 0.9, None), ("b", None, 1.5)]
    assert sinks.text_report([{"a": 1, "b": 22}]) == "a  b\n1  22" and "tabular" in sinks.text_report([{"a": 1}], latex=True)
    f = sinks.with_fallback(spark.createDataFrame([("x", None)], "k string, m double"), spark.createDataFrame([("x", 2.0), ("y", 3.0)], "k string, m double"), "k")
    assert sorted(map(tuple, f.collect())) == [("x", 2.0), ("y", 3.0)]


def test_resume_appends_once(spark, tmp_path):
    out = str(tmp_path / "out")
    batch = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "key string, v int")
    for _ in range(2):
        resume.append_new(batch, out, "key", ["v"])
    assert sorted(map(tuple, spark.read.parquet(out).collect())) == [("a", 1), ("b", 3)]


def test_stream_resumes(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    for n in range(2):
        spark.createDataFrame([("a", n), (f"k{n}", n)], "key string, v int").write.mode("append").parquet(src)
        resume.stream_new(spark, src, "key string, v int", out, ck, "key", ["v"]).awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(out).collect())) == [("a", 0), ("k0", 0), ("k1", 1)]


def test_stream_resumes_after_a_failed_batch(spark, tmp_path):
    """A batch that fails half way and runs again gives what an undisturbed run gives; done keys are state, not read from the output."""
    rows = [[(f"k{(7 * n + m) % 25}", 100 * n + m) for m in range(20)] for n in range(4)]

    def feed(name, n):
        spark.createDataFrame(rows[n], "key string, v int").repartition(3).write.mode("append").parquet(str(tmp_path / name))

    def run(name, process=lambda x: x):
        resume.stream_new(spark, str(tmp_path / name), "key string, v int", str(tmp_path / f"{name}-out"), str(tmp_path / f"{name}-ck"), "key", ["v"], process).awaitTermination()

    def breaks(df):
        return df.withColumn("v", F.when(F.col("v") % 100 > 9, F.raise_error(F.lit("half way")).cast("int")).otherwise(F.col("v")))

    for n in range(4):
        feed("plain", n)
        run("plain")
        feed("broken", n)
        if n == 1:
            with pytest.raises(Exception, match="half way"):
                run("broken", breaks)
        run("broken")
    out = {name: sorted(map(tuple, spark.read.parquet(str(tmp_path / f"{name}-out")).collect())) for name in ("plain", "broken")}
    first = {}
    for batch in rows:
        for k, v in sorted(batch, key=lambda r: r[1]):
            first.setdefault(k, v)
    assert out["plain"] == out["broken"] == sorted(first.items())


def test_scratch_tables_go_and_kept_ones_are_released(spark, tmp_path):
    from pathlib import Path

    with tables.Scratch(spark) as scratch:
        one, two = scratch.table(spark.range(3)), scratch.table(spark.range(4))
        root = Path(tables.shared_dir(spark).removeprefix("file:")) / scratch.root.rsplit("/", 1)[1]
        scratch.drop(one)
        assert two.count() == 4 and [x.name for x in root.iterdir()] == ["2"]
        kept, other = scratch.keep(two), scratch.keep(spark.range(5))
    assert not root.exists() and kept.count() == 4
    mine = spark.range(2)
    mine.write.parquet(str(tmp_path / "mine"))
    result = kept.join(spark.read.parquet(str(tmp_path / "mine")), "id")
    assert result.count() == 2
    tables.release(result)
    assert other.count() == 5 and spark.read.parquet(str(tmp_path / "mine")).count() == 2
    assert not [x for x in root.parent.iterdir() if x.name == f"{root.name}-kept-2"]


def test_cache_is_read_through(spark, tmp_path):
    calls = []
    make = lambda: calls.append(1) or spark.range(3)
    for _ in range(2):
        assert resume.cached(spark, str(tmp_path / "c"), make).count() == 3
    assert calls == [1]


def test_neq_from_uniform_counts(spark):
    c = spark.createDataFrame([("d", 320, 0, x, 5) for x in "abcd"] + [("d", 320, 1, "a", 9)], "domain string, temp int, i int, letter string, n int")
    assert {r.i: round(r.neq, 9) for r in readers.neq_from_counts(c).collect()} == {0: 4.0, 1: 1.0}
