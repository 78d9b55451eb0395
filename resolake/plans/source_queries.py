"""Queries that exercise parsing on the driver's tables: nested JSON, list texts, replicas, temperatures."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.joining import temperature_pivot
from ..sources import readers
from ..sources.tables import table
from .bindings import query, series


@query("s14_nested_json", "k:l n:l total:m", "select json_extract_string(props, '$.k')::bigint as k, count(*) as n, sum(value) as total from events group by 1")
def _(spark, d):
    p = F.from_json("props", "k long")
    return table(spark, d, "events").groupBy(p.getField("k").alias("k")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


@query("s1_s3_list_texts", "name:l n:l total:m", "select name, count(*) as n, sum(round(value, 3)) as total from series group by 1", "series")
def _(spark, d):
    s = series(spark, d).select("name", F.struct("i", F.format_string("%.3f", F.round("value", 3)).alias("v")).alias("x"))
    text = s.groupBy("name").agg(F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda r: r["v"]), ", "), F.lit("]")).alias("neq"))
    v = text.select("name", F.explode(readers.parse_list(F.col("neq"))).alias("v"))
    return v.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("total"))


@query("s25_replica_mean", "domain:l temp:l neq:d", "select user_id as domain, extract(hour from ts)::int // 6 as temp, avg(value) as neq from events group by 1, 2")
def _(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("domain"), F.floor(F.hour("ts") / 6).cast("int").alias("temp"), F.lit(0).alias("i"), F.col("value").alias("neq"))
    return readers.replica_mean(e)


@query("s25_neq_from_counts", "domain:l temp:l neq:d", """
with c as (select user_id as domain, extract(hour from ts)::int // 12 as temp, event_type as letter, count(*) as n from events group by 1, 2, 3), p as (select domain, temp, n / sum(n) over (partition by domain, temp) as p from c)
select domain, temp, exp(-sum(p * ln(p))) as neq from p group by 1, 2""")  # fmt: skip
def _(spark, d):
    c = table(spark, d, "events").groupBy(F.col("user_id").alias("domain"), F.floor(F.hour("ts") / 12).cast("int").alias("temp"), F.lit(0).alias("i"), F.col("event_type").alias("letter")).agg(F.count(F.lit(1)).alias("n"))
    return readers.neq_from_counts(c)


@query("p5_per_temperature", "domain:l temp:l neq:d", """
select user_id as domain, case event_type when 'click' then 320 when 'purchase' then 348 when 'view' then 379 else 413 end as temp, max(value) as neq from events group by 1, 2""")  # fmt: skip
def _(spark, d):
    kind, temps = F.col("event_type"), [320, 348, 379, 413]
    t = F.when(kind == "click", 320).when(kind == "purchase", 348).when(kind == "view", 379).otherwise(413)
    e = table(spark, d, "events").groupBy(F.col("user_id").alias("domain"), F.lit("x").alias("sequence"), t.alias("t")).agg(F.max("value").alias("v"))
    wide = temperature_pivot(e, ["domain", "sequence"], "t", temps, "v").withColumnsRenamed({str(x): f"neq_{x}" for x in temps})
    return readers.per_temperature(wide, temps)


@query("p4_nan_filter", "n:l", "select count(*) as n from documents where not contains(lower(text), 'nan')")
def _(spark, d):
    return readers.without_nan(table(spark, d, "documents"), ["text"]).agg(F.count(F.lit(1)).alias("n"))
