"""Readers, sinks and resumption: the driver's tables written in each format to the shared folder and read back through the reader."""

from __future__ import annotations

import io
from xml.etree import ElementTree

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import clean_header
from ..operators import attention
from ..sources import json_arrays, readers, sinks
from ..sources.tables import scratch_path, table
from ..streaming import resume
from .bindings import attn, query, series, vecs


def _texts(spark: SparkSession, d: str) -> DataFrame:
    """(name, sequence, neq): each user's event letters and the bracketed list of values."""
    x = F.struct("i", F.upper(F.substring("cat", 1, 1)).alias("a"), F.format_string("%.3f", F.round("value", 3)).alias("v"))
    g = series(spark, d).select("name", x.alias("x")).groupBy("name").agg(F.array_sort(F.collect_list("x")).alias("x"))
    neq = F.concat(F.lit("["), F.array_join(F.transform("x", lambda r: r["v"]), ", "), F.lit("]"))
    return g.select("name", F.array_join(F.transform("x", lambda r: r["a"]), "").alias("sequence"), neq.alias("neq"))


def _tsv(df: DataFrame, path: str) -> str:
    df.write.csv(path, sep="\t", header=True)
    return path


def _json_arrays(records: DataFrame, path: str, wrap: str | None = None) -> str:
    json_arrays.write_arrays(records, path, wrap)
    return path


@query("s2_regression_csv", "name:l n:l total:d", """
select name, count(*) as n, sum(case when round(value, 3) > 0 then ln(round(value, 3)) end) as total from series group by 1 having count(*) <= 1024""", "series")  # fmt: skip
def _(spark, d):
    path = scratch_path(spark, "s2")
    sinks.write_csv(_texts(spark, d), path, single=False)
    v = readers.neq_table(spark, path, log=True).select("name", F.explode("neq").alias("v"))
    return v.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("total"))


@query("p2_length_filter", "n:l", "select count(*) filter (name % 7 <> 0) as n from (select name, count(*) as c from series group by 1) where c <= 1024", "series")
def _(spark, d):
    path = scratch_path(spark, "p2")
    t = _texts(spark, d).withColumn("sequence", F.when(F.col("name") % 7 == 0, F.concat("sequence", F.lit("X"))).otherwise(F.col("sequence")))
    sinks.write_csv(t, path, single=False)
    return readers.neq_table(spark, path).agg(F.count(F.lit(1)).alias("n"))


@query("s4_s5_s6_long_tsv", "name:l n:l label:l total:m", "select name, count(*) as n, sum((round(value, 3) > 50)::int) as label, sum(round(value, 3)) as total from series group by 1", "series")
def _(spark, d):
    t = readers.neq_long(spark, _tsv(_texts(spark, d), scratch_path(spark, "s5")), threshold=50.0)
    return t.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("label"), F.sum("neq").alias("total"))


def _annotated(spark: SparkSession, d: str) -> DataFrame:
    q3 = F.element_at(F.array(*map(F.lit, "HEC?")), (F.col("event_id") % 4 + 1).cast("int"))
    return series(spark, d).select(F.concat(F.lit(">"), "name").alias("id"), F.substring("cat", 1, 1).alias("seq"), (F.col("i") + 1).alias("n"), F.round(F.col("value") / 100, 3).alias("rsa"), F.lit(1.5).alias("asa"), q3.alias("q3"))


@query("s7_p11_annotations", "q3:s n:l last:l", """
select ['H', 'E', 'C', '?'][event_id % 4 + 1] as q3, count(*) as n, max(i) + 1 as last from series where name % 2 = 0 and event_id % 4 < 3 group by 1""", "series")  # fmt: skip
def _(spark, d):
    path = scratch_path(spark, "s7")
    sinks.write_csv(_annotated(spark, d), path, single=False)
    known = series(spark, d).where("name % 2 = 0").select("name")
    return readers.annotations(spark, path, known).where(F.col("q3").isin("H", "E", "C")).groupBy("q3").agg(F.count(F.lit(1)).alias("n"), F.max("n").alias("last"))


@query("s9_positional_annotations", "name:l n:l", "select name, count(*) as n from series where event_id % 4 = 0 group by 1", "series")
def _(spark, d):
    path = scratch_path(spark, "s9")
    sinks.write_csv(_annotated(spark, d), path, single=False)
    return readers.annotations(spark, path, by_position=True).where("q3 = 'H'").groupBy("name").agg(F.count(F.lit(1)).alias("n"))


@query("s10_sniffed_annotations", "q3:s n:l", "select ['H', 'E', 'C', '?'][event_id % 4 + 1] as q3, count(*) as n from series group by 1", "series")
def _(spark, d):
    return readers.annotations(spark, _tsv(_annotated(spark, d), scratch_path(spark, "s10"))).groupBy("q3").agg(F.count(F.lit(1)).alias("n"))


@query("s11_rmsf_tsv", "name:l n:l total:m", "select name, count(*) as n, sum(round(value, 3)) as total from series where name % 5 <> 0 group by 1", "series")
def _(spark, d):
    bad = F.when(F.col("name") % 5 == 0, F.lit("[bad")).otherwise(F.col("neq"))
    path = _tsv(_texts(spark, d).select(F.col("name").alias("sequence_name"), "sequence", bad.alias("avg_per_residue_rmsf")), scratch_path(spark, "s11"))
    v = readers.rmsf_table(spark, path).select("name", F.explode("rmsf").alias("v"))
    return v.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("total"))


@query("s12_s13_attention_json", "name:l sequence:s n:l total:d", """
select name, case when name % 3 = 0 then '' else 'SEQ' end as sequence, count(*) as n, sum(w) as total from attn where name % 4 <> 1 group by 1, 2""", "attn")  # fmt: skip
def _(spark, d):
    a = attn(spark, d)
    rows = a.groupBy("name", "i").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "w"))), lambda r: r["w"]).alias("row"))
    m = rows.groupBy("name").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "row"))), lambda r: r["row"]).alias("attention_weights"))
    n = F.col("name")
    records = m.select(n.cast("string").alias("name"), F.when(n % 3 != 0, F.lit("SEQ")).alias("sequence"), F.when(n % 4 != 1, F.col("attention_weights")).alias("attention_weights"))
    t = readers.attention_records(spark, _json_arrays(records, scratch_path(spark, "s12")))
    cells = t.select("name", "sequence", F.explode(F.flatten("attention_weights")).alias("w"))
    return cells.groupBy("name", "sequence").agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("total"))


def _interpro(spark: SparkSession, d: str, name: str) -> str:
    """Suppliers as entries with one location and one site each; some without end, some without xref."""
    k = F.col("s_suppkey").cast("int")
    start, end = (k % 40 + 1).alias("start"), F.when(k % 5 != 0, k % 40 + 1 + k % 7).alias("end")
    site = F.struct(F.lit("site").alias("description"), F.array(F.struct(start, end, F.lit("C").alias("residue"))).alias("siteLocations"))
    location = F.struct(start, end, F.array(site).alias("sites"))
    xref = F.when(k % 4 != 0, F.array(F.struct(F.concat(F.lit("p"), k).alias("id"), F.lit("n").alias("name"))))
    r = table(spark, d, "supplier").select(F.concat(F.lit("m"), k).alias("md5"), xref.alias("xref"), F.array(F.struct(F.array(location).alias("locations"))).alias("matches"))
    return _json_arrays(r, scratch_path(spark, name), wrap="results")


_SITES = "with x as (select s_suppkey as k, s_suppkey % 40 + 1 as s, case when s_suppkey % 5 <> 0 then s_suppkey % 40 + 1 + s_suppkey % 7 else s_suppkey % 40 + 1 end as e from supplier)"


@query("s15_interpro_intervals", "name:s start:l end_:l", _SITES + " select 'p' || k as name, s as start, e as end_ from x where k % 4 <> 0")
def _(spark, d):
    return readers.interpro_intervals(spark, _interpro(spark, d, "s15")).withColumnRenamed("end", "end_")


@query("s17_positions_by_extension", "name:s i:l", _SITES + " select case when k % 4 <> 0 then 'p' else 'm' end || k as name, unnest(range(s - 1, e)) as i from x")
def _(spark, d):
    return readers.functional_positions(spark, _interpro(spark, d, "s17"))


@query("s16_interpro_table", "name:s i:l", _SITES + " select 'p' || k as name, unnest(range(s - 1, e)) as i from x where k % 6 <> 0")
def _(spark, d):
    k = F.col("s_suppkey").cast("int")
    start = k % 40 + 1
    t = table(spark, d, "supplier").select(F.concat(F.lit("p"), k).alias("Accession"), F.when(k % 6 != 0, start.cast("string")).otherwise("x").alias("Start"), F.when(k % 5 != 0, start + k % 7).alias("End"))
    return readers.functional_positions(spark, _tsv(t, scratch_path(spark, "s16") + ".tsv"))


_LETTERS = "string_agg(upper(substr(cat, 1, 1)), '' order by i)"


@query("s18_fasta", "id:s sequence:s", f"select name || ' user' as id, {_LETTERS} as sequence from series group by name", "series")
def _(spark, d):
    path = scratch_path(spark, "s18")
    sinks.write_fasta(_texts(spark, d).withColumn("domain", F.concat("name", F.lit(" user"))), path)
    return readers.fasta(spark, path)


@query("s19_s20_fasta_first_token", "id:l sequence:s", f"select name as id, {_LETTERS} as sequence from series group by name", "series")
def _(spark, d):
    path = scratch_path(spark, "s19")
    sinks.write_fasta(_texts(spark, d).withColumn("domain", F.concat("name", F.lit(" user"))), path)
    return readers.fasta(spark, path, first_token=True)


@query("s21_run_directory", "name:s n:l total:m", "select event_type as name, count(*) as n, sum(value + 1) as total from events group by 1")
def _(spark, d):
    root, e = scratch_path(spark, "s21"), table(spark, d, "events")
    for (kind,) in e.select("event_type").distinct().collect():  # a file an event type, of which there are a handful
        rows = e.where(F.col("event_type") == kind).select(F.lit("A").alias("aa"), *[(F.col("value") + k).alias(f"Neq_R{k + 1}") for k in range(3)])
        _tsv(rows, f"{root}/{kind}_Neq.tsv")
    return readers.run_directory(spark, f"{root}/*_Neq.tsv").groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.sum("neq").alias("total"))


@query("s26_resumable_append", "user_id:l event_id:l", """
select user_id, event_id from (select user_id, event_id, row_number() over (partition by user_id order by event_id % 3, event_id) as r from events) where r = 1""")  # fmt: skip
def _(spark, d):
    path, e = scratch_path(spark, "s26"), table(spark, d, "events").select("user_id", "event_id")
    for part in (0, 0, 1, 2, 1):  # batches that come again add nothing
        resume.append_new(e.where(F.col("event_id") % 3 == part), path, "user_id", ["event_id"])
    return spark.read.parquet(path)


@query("s26_resumable_stream", "users:l n:l", "select count(distinct user_id) as users, count(distinct user_id) as n from events")
def _(spark, d):
    root = scratch_path(spark, "s26-stream")
    e = table(spark, d, "events").select("user_id", "event_id")
    for part in range(2):
        e.where(F.col("event_id") % 2 == part).write.mode("append").parquet(f"{root}/in")
        resume.stream_new(spark, f"{root}/in", "user_id long, event_id long", f"{root}/out", f"{root}/progress", "user_id", ["event_id"]).awaitTermination()
    return spark.read.parquet(f"{root}/out").agg(F.count_distinct("user_id").alias("users"), F.count(F.lit(1)).alias("n"))


@query("s27_read_through_cache", "key:l n:l", "select n_regionkey as key, count(*) as n from nation group by 1")
def _(spark, d):
    path = scratch_path(spark, "s27")
    resume.cached(spark, path, lambda: table(spark, d, "nation").groupBy(F.col("n_regionkey").alias("key")).agg(F.count(F.lit(1)).alias("n")))
    return resume.cached(spark, path, lambda: spark.range(0))  # found, so not made again


@query("s29_csv_sink", "k:l name:s", "select n_nationkey as k, n_name || ', \"x\"' as name from nation")
def _(spark, d):
    path = scratch_path(spark, "s29")
    sinks.write_csv(table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.concat("n_name", F.lit(', "x"')).alias("name")), path)
    return readers.delimited(spark, path)


@query("s30_json_sink", "k:l name:s region:l", "select n_nationkey as k, n_name as name, n_regionkey as region from nation")
def _(spark, d):
    path = scratch_path(spark, "s30")
    sinks.write_json(table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region")), path, by="region")
    return spark.read.json(path)


def _graph_counts(pdfs):
    """Nodes, edges and weights that an XML parser finds in each file."""
    for pdf in pdfs:
        rows = []
        for path, content in zip(pdf["path"], pdf["content"], strict=True):
            graph = ElementTree.fromstring(content)
            tag = "{http://graphml.graphdrawing.org/xmlns}"
            rows.append((int(path.rsplit("/", 1)[1].split(".")[0]), len(graph.findall(f".//{tag}node")), len(graph.findall(f".//{tag}edge")), sum(float(x.text) for x in graph.findall(f".//{tag}data"))))
        yield pd.DataFrame(rows, columns=["name", "nodes", "edges", "total"])


@query("s31_graphml_sink", "name:l nodes:l edges:l total:d", """
with n as (select name, count(*) as nodes from vecs group by 1), e as (select name, count(*) as edges, sum(w) as total from (select *, row_number() over (partition by name, i order by w desc, j) as r from attn) where r <= 5 group by 1)
select n.name, nodes, edges, total from n join e on e.name = n.name""", "vecs", "attn")  # fmt: skip
def _(spark, d):
    path = scratch_path(spark, "s31")
    sinks.write_graphml(attention.sparse_graph(attn(spark, d), "topk", k=5), vecs(spark, d), path)
    return spark.read.format("binaryFile").load(f"{path}/*.graphml").mapInPandas(_graph_counts, "name long, nodes long, edges long, total double")


def _matrix_sums(pdfs):
    for pdf in pdfs:
        matrices = [np.load(io.BytesIO(x)) for x in pdf["content"]]
        names = [int(p.rsplit("/", 1)[1].split(".")[0]) for p in pdf["path"]]
        yield pd.DataFrame({"name": names, "n": [m.size for m in matrices], "total": [m.sum() for m in matrices], "corner": [m[0, -1] for m in matrices]})


@query("s32_matrix_sink", "name:l n:l total:d corner:d", "select name, count(*) as n, sum(w) as total, arg_max(w, j) filter (i = 0) as corner from attn group by 1", "attn")
def _(spark, d):
    path = scratch_path(spark, "s32")
    sinks.write_npy(attn(spark, d), path)
    return spark.read.format("binaryFile").load(f"{path}/*.npy").mapInPandas(_matrix_sums, "name long, n long, total double, corner double")


@query("s33_text_report", "line:l text:s", """
select 0 as line, 'key  name' as text union all select r_regionkey + 1, rpad(r_regionkey::varchar, 5, ' ') || r_name from region""")  # fmt: skip
def _(spark, d):
    rows = [r.asDict() for r in table(spark, d, "region").select(F.col("r_regionkey").alias("key"), F.col("r_name").alias("name")).orderBy("key").collect()]  # a small result table
    return spark.createDataFrame(list(enumerate(sinks.text_report(rows).split("\n"))), "line long, text string")


@query("s35_f35_metrics_with_fallback", "k:l macro_f1:d mse:d", """
select coalesce(n.k, s.k) as k, coalesce(n.m, s.m) as macro_f1, s.e as mse from (select n_nationkey as k, case when n_nationkey % 2 = 0 then n_regionkey / 10 end as m from nation) n
full join (select s_suppkey as k, 0.5 as m, s_acctbal as e from supplier where s_suppkey % 3 = 0) s on n.k = s.k""")  # fmt: skip
def _(spark, d):
    k = F.col("n_nationkey")
    first = table(spark, d, "nation").select(k.alias("k"), F.when(k % 2 == 0, F.col("n_regionkey") / 10).alias("macro f1"))
    first = first.withColumnsRenamed(sinks.metric_columns(first.columns))
    second = table(spark, d, "supplier").where("s_suppkey % 3 = 0").select(F.col("s_suppkey").alias("k"), F.lit(0.5).alias("macro_f1"), F.col("s_acctbal").cast("double").alias("mse"))
    return sinks.with_fallback(first, second, "k")


@query("f5_clean_header", "k:l name:s", "select s_suppkey as k, s_name as name from supplier")
def _(spark, d):
    s = table(spark, d, "supplier")
    return s.select(F.col("s_suppkey").alias("k"), clean_header(F.concat(F.lit(">>"), "s_name", F.lit(" "))).alias("name"))
