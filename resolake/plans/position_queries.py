"""Queries over ordered positions: binning, neighbours, ranks, scaling, peaks, histograms."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import attention, motifs, positions, statistics
from ..sources.tables import table
from .bindings import query, series


@query("p1_p3_clean_sequences", "kept:l dropped_null:l dropped_long:l", """
select count(*) filter (value is not null and n <= 80) as kept, count(*) filter (value is null) as dropped_null, count(*) filter (value is not null and n > 80) as dropped_long
from (select value, count(*) over (partition by name) as n from series)""", "series")  # fmt: skip
def _(spark, d):
    s = series(spark, d).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("name")))
    ok = F.col("value").isNotNull()
    return s.agg(F.count_if(ok & (F.col("n") <= 80)).alias("kept"), F.count_if(~ok).alias("dropped_null"), F.count_if(ok & (F.col("n") > 80)).alias("dropped_long"))


@query("p6_threshold_bins", "bin:l n:l", "select case when value <= 10 then 0 when value <= 25 then 1 when value <= 50 then 2 else 3 end as bin, count(*) as n from events where value is not null group by 1")
def _(spark, d):
    e = table(spark, d, "events").where("value is not null")
    return e.groupBy(scalars.binned(F.col("value"), [10, 25, 50]).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query("p7_exact_label", "cat:s label:l n:l", "select event_type as cat, case when floor(value / 10) = 1 then 0 else 1 end as label, count(*) as n from events group by 1, 2")
def _(spark, d):
    return table(spark, d, "events").groupBy(F.col("event_type").alias("cat"), scalars.not_exactly(F.floor(F.col("value") / 10).cast("double"), 1.0).alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query("p8_unit_histogram", "bin:l n:l", """
with x as (select value / 20 as x from events), m as (select greatest(ceil(max(x)) - 1, 0) as m from x),
b as (select unnest(range(0, (select m::bigint + 1 from m))) as bin), c as (select case when x = 1 then 0 else ceil(x) - 1 end as bin, count(*) as n from x where x >= 1 group by 1)
select b.bin, coalesce(n, 0) as n from b left join c on b.bin = c.bin""")  # fmt: skip
def _(spark, d):
    return positions.unit_histogram(table(spark, d, "events").select((F.col("value") / 20).alias("x")), "x")


@query("p12_top_percent", "name:l i:l value:d", """
with c as (select name, round(quantile_cont(value, 0.9), 9) as cut from series group by 1)
select s.name, s.i, s.value from series s join c on s.name = c.name where round(s.value, 9) >= c.cut""", "series")  # fmt: skip
def _(spark, d):
    return positions.top_percent(series(spark, d), "value", 10.0).where("is_top")


@query("p13_index_cutoff", "name:l i:l value:d", """
with r as (select *, row_number() over (partition by name order by value) - 1 as r, count(*) over (partition by name) as n from series),
c as (select name, min(value) as cut from r where r = least(greatest(floor(n * 0.9), 0), n - 1) group by 1)
select s.name, s.i, s.value from series s join c on s.name = c.name where s.value >= c.cut""", "series")  # fmt: skip
def _(spark, d):
    return positions.index_cutoff(series(spark, d), "value", 10.0).where("is_peak")


@query("w1_value_neighbours", "name:l i:l prev_1:d next_1:d", "select name, i, lag(value, 1, 0.0) over w as prev_1, lead(value, 1, 0.0) over w as next_1 from series window w as (partition by name order by i)", "series")
def _(spark, d):
    return positions.neighbours(series(spark, d), "value")


@query("w2_category_neighbours_onehot", "name:l i:l p_click:l p_purchase:l n_click:l n_purchase:l", """
select name, i, coalesce((p = 'click')::int, 0) as p_click, coalesce((p = 'purchase')::int, 0) as p_purchase, coalesce((x = 'click')::int, 0) as n_click, coalesce((x = 'purchase')::int, 0) as n_purchase
from (select name, i, lag(cat) over w as p, lead(cat) over w as x from series window w as (partition by name order by i))""", "series")  # fmt: skip
def _(spark, d):
    s = positions.neighbours(series(spark, d), "cat", fill=None)
    hot = {side: scalars.one_hot(F.col(c), ["click", "purchase"]) for side, c in (("p", "prev_1"), ("n", "next_1"))}
    return s.select("name", "i", *[hot[x][k].alias(f"{x}_{label}") for x in "pn" for k, label in enumerate(["click", "purchase"])])


@query("w3_context_fill", "name:l i:l prev_2:s next_2:s", "select name, i, lag(cat, 2, 'START') over w as prev_2, lead(cat, 2, 'END') over w as next_2 from series window w as (partition by name order by i)", "series")
def _(spark, d):
    return positions.neighbours(series(spark, d), "cat", 2, ("START", "END"))


@query("w4_relative_position", "name:l i:l rel_pos:d", "select name, i, i::double / count(*) over (partition by name) as rel_pos from series", "series")
def _(spark, d):
    return positions.relative_position(series(spark, d))


@query("w5_percentile_rank", "name:l i:l pct_rank:d", "select name, i, coalesce(100.0 * (row_number() over (partition by name order by value, i) - 1) / nullif(count(*) over (partition by name) - 1, 0), 0) as pct_rank from series", "series")
def _(spark, d):
    return positions.percentile_rank(series(spark, d), "value")


@query("w6_percentile_rank_single", "name:s i:l pct_rank:d", "select props as name, 0 as i, coalesce(100.0 * (row_number() over (partition by props order by value, event_id) - 1) / nullif(count(*) over (partition by props) - 1, 0), 50) as pct_rank from events")
def _(spark, d):
    e = table(spark, d, "events").select(F.col("props").alias("name"), F.col("event_id").alias("k"), "value", F.lit(0).alias("i"))
    return positions.percentile_rank(e, "value", 50.0, i="k")


@query("w7_mid_rank", "name:l i:l mid_rank:d", "select name, i, rank() over (partition by name order by floor(value)) + (count(*) over (partition by name, floor(value)) - 1) / 2 as mid_rank from series", "series")
def _(spark, d):
    return positions.mid_rank(series(spark, d).withColumn("v", F.floor("value")), "v")


@query("w8_scaled_rank", "name:l i:l scaled_rank:d", """
select name, i, coalesce((m - 1) / nullif(n - 1, 0), 0) as scaled_rank
from (select name, i, count(*) over (partition by name) as n, rank() over (partition by name order by floor(value)) + (count(*) over (partition by name, floor(value)) - 1) / 2 as m from series)""", "series")  # fmt: skip
def _(spark, d):
    return positions.scaled_rank(series(spark, d).withColumn("v", F.floor("value")), "v")


@query("w9_z_score", "name:l i:l z:d", "select name, i, case when sd > 1e-12 then (value - a) / sd else 0 end as z from (select *, stddev_pop(value) over (partition by name) as sd, avg(value) over (partition by name) as a from series)", "series")
def _(spark, d):
    return positions.z_score(series(spark, d), "value")


@query("w10_min_max", "name:l i:l scaled:d", "select name, i, case when hi - lo > 1e-12 then (value - lo) / (hi - lo) else 0 end as scaled from (select *, min(value) over (partition by name) as lo, max(value) over (partition by name) as hi from series)", "series")
def _(spark, d):
    return positions.min_max(series(spark, d), "value")


@query("w11_quantile_clip", "name:l i:l clipped:d", """
with q as (select name, quantile_cont(value, 0.05) as a, quantile_cont(value, 0.95) as b, min(value) as lo, max(value) as hi from series group by 1)
select s.name, s.i, case when b - a > 1e-12 then (least(greatest(value, a), b) - a) / (b - a) when hi - lo > 1e-12 then (value - lo) / (hi - lo) else 0 end as clipped from series s join q on s.name = q.name""", "series")  # fmt: skip
def _(spark, d):
    return positions.quantile_clip(series(spark, d), "value")


@query("w16_strict_local_peaks", "name:l i:l value:d", """
with c as (select name, quantile_cont(value, 0.8) as q from series group by 1), n as (select *, lag(value) over w as l, lead(value) over w as r from series window w as (partition by name order by i))
select n.name, n.i, n.value from n join c on n.name = c.name where value > l and value >= r and value >= q""", "series")  # fmt: skip
def _(spark, d):
    s = series(spark, d)
    cut = s.groupBy("name").agg(F.percentile("value", 0.8).alias("q"))
    return positions.local_peaks(s.join(cut, "name"), "value", ["name"], "i", edges=False, strict_left=True, least=F.col("q")).where("is_peak")


@query("w17_global_local_peaks", "name:l i:l value:d", """
with c as (select quantile_cont(value, 0.9) as q from series), n as (select *, lag(value) over w as l, lead(value) over w as r from series window w as (partition by name order by i))
select n.name, n.i, n.value from n, c where value >= l and value >= r and value >= q""", "series")  # fmt: skip
def _(spark, d):
    s = series(spark, d)
    cut = s.agg(F.percentile("value", 0.9).alias("q"))  # one row
    return positions.local_peaks(s.crossJoin(F.broadcast(cut)), "value", ["name"], "i", edges=False, least=F.col("q")).where("is_peak")


@query("w20_running_hits", "name:l i:l tp:l fp:l", """
select name, i, sum((cat = 'purchase')::int) over w as tp, sum((cat <> 'purchase')::int) over w as fp from series window w as (partition by name order by value desc, i rows unbounded preceding)""", "series")  # fmt: skip
def _(spark, d):
    return positions.running_totals(series(spark, d).withColumn("y", (F.col("cat") == "purchase").cast("int")), "y", "value", "i")


@query("w22_context_counts", "cat:s n:l", "select s.cat, count(*) as n from series c join series s on s.name = c.name and s.i between c.i - 3 and c.i + 3 where c.value >= 100 group by 1", "series")
def _(spark, d):
    return positions.context_counts(series(spark, d), F.col("value") >= 100, "cat", 3)


@query("w28_quartile_label", "quartile:s n:l total:m", """
with r as (select value, row_number() over (order by value) - 1 as r, count(*) over () as n from events where value is not null),
c as (select max(value) filter (r = n // 4) as q1, max(value) filter (r = n // 2) as q2, max(value) filter (r = 3 * n // 4) as q3 from r)
select case when value <= q1 then 'Q1' when value <= q2 then 'Q2' when value <= q3 then 'Q3' else 'Q4' end as quartile, count(*) as n, sum(value) as total from events, c where value is not null group by 1""")  # fmt: skip
def _(spark, d):
    e = table(spark, d, "events").where("value is not null")
    return positions.quartile_label(e, "value").groupBy("quartile").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


@query("f26_fixed_histogram", "cat:s bin:l n:l density:d", """
with b as (select event_type as cat, least(floor((least(greatest(value, 0), 100) - 0) / 2), 49) as bin, count(*) as n from events where value is not null group by 1, 2)
select cat, bin, n, n / (sum(n) over (partition by cat) * 2.0) as density from b""")  # fmt: skip
def _(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("cat"), "value")
    return positions.fixed_histogram(e, "value", 2.0, 0.0, 100.0, ["cat"])


@query("a7_a8_describe", "cat:s n:l min:d max:d mean:d median:d std_pop:d std:d q25:d q75:d", """
select event_type as cat, count(value) as n, min(value) as min, max(value) as max, avg(value) as mean, median(value) as median, stddev_pop(value) as std_pop, stddev_samp(value) as std,
quantile_cont(value, 0.25) as q25, quantile_cont(value, 0.75) as q75 from events group by 1""")  # fmt: skip
def _(spark, d):
    return table(spark, d, "events").groupBy(F.col("event_type").alias("cat")).agg(*statistics.summary("value"))


@query("a9_overall_summary", "groups:l n:l mean:d median:d high:l high_share:d", """
select count(distinct user_id) as groups, count(*) as n, avg(value) as mean, median(value) as median, count(*) filter (value > 50) as high, avg((value > 50)::int) as high_share from events""")  # fmt: skip
def _(spark, d):
    hi = F.col("value") > 50
    return table(spark, d, "events").agg(F.countDistinct("user_id").alias("groups"), F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.median("value").alias("median"), F.count_if(hi).alias("high"), F.avg(hi.cast("double")).alias("high_share"))


@query("a10_mean_sem", "cat:s mean:d sem:d n:l", "select event_type as cat, avg(value) as mean, stddev_samp(value) / sqrt(count(value)) as sem, count(value) as n from events group by 1")
def _(spark, d):
    return table(spark, d, "events").groupBy(F.col("event_type").alias("cat")).agg(F.avg("value").alias("mean"), (F.stddev_samp("value") / F.sqrt(F.count("value").cast("double"))).alias("sem"), F.count("value").alias("n"))


@query("a11_mean_of_group_stats", "cat:s mean:d std:d groups:l", "select cat, avg(m) as mean, stddev_pop(m) as std, count(*) as groups from (select cat, name, avg(value) as m from series group by 1, 2) group by 1", "series")
def _(spark, d):
    m = series(spark, d).groupBy("cat", "name").agg(F.avg("value").alias("m"))
    return m.groupBy("cat").agg(F.avg("m").alias("mean"), F.stddev_pop("m").alias("std"), F.count(F.lit(1)).alias("groups"))


@query("a6_zero_filled_group_means", "cat:s mean:d", """
with c as (select distinct cat from series), u as (select distinct name from series), m as (select name, cat, avg(value) as m from series group by 1, 2)
select c.cat, avg(coalesce(m, 0)) as mean from c cross join u left join m on m.name = u.name and m.cat = c.cat group by 1""", "series")  # fmt: skip
def _(spark, d):
    s = series(spark, d)
    n = s.agg(F.countDistinct("name").alias("n"))
    means = s.groupBy("name", "cat").agg(F.avg("value").alias("m")).groupBy("cat").agg(F.sum("m").alias("t"))
    return means.crossJoin(F.broadcast(n)).select("cat", (F.col("t") / F.col("n")).alias("mean"))  # an absent category adds 0


@query("a5_ratio_of_sums", "cat:s ratio:d", "select cat, sum(value) / count(*) as ratio from series group by 1", "series")
def _(spark, d):
    return series(spark, d).groupBy("cat").agg(F.try_divide(F.sum("value"), F.count(F.lit(1))).alias("ratio"))


@query("w18_autocorrelation", "name:l lag:l acf:d", """
with k as (select unnest(range(0, 11)) as lag), g as (select distinct name, lag from series, k),
p as (select a.name, k.lag, a.value as x, b.value as y from series a join k on k.lag > 0 join series b on b.name = a.name and b.i = a.i + k.lag),
c as (select name, lag, case when min(x) < max(x) and min(y) < max(y) then corr(x, y) end as acf from p group by 1, 2)
select g.name, g.lag, case when g.lag = 0 then 1.0 else acf end as acf from g left join c on c.name = g.name and c.lag = g.lag""", "series")  # fmt: skip
def _(spark, d):
    return attention.autocorrelation(series(spark, d), 10, ["name"], "i", "value")


_ACF = """with k as (select unnest(range(1, 16)) as lag), g as (select distinct name, lag from series, k),
p as (select a.name, k.lag, a.value as x, b.value as y from series a join k on true join series b on b.name = a.name and b.i = a.i + k.lag),
c as (select name, lag, round(case when min(x) < max(x) and min(y) < max(y) then corr(x, y) end, 9) as acf from p group by 1, 2),
n as (select g.name, g.lag, acf, lag(acf) over w as l, lead(acf) over w as r from g left join c on c.name = g.name and c.lag = g.lag window w as (partition by g.name order by g.lag)),
best as (select name, lag, acf, row_number() over (partition by name order by (case when acf > l and acf > r and acf >= 0.1 then acf end) desc nulls last, lag) as o, acf > l and acf > r and acf >= 0.1 as ok from n),
dom as (select name, case when ok then lag end as lag, case when ok then acf end as acf from best where o = 1)"""


@query("w19_dominant_lag", "name:l lag:d acf:d", _ACF + " select * from dom", "series")
def _(spark, d):
    return attention.dominant_lag(attention.autocorrelation(series(spark, d), 15, ["name"], "i", "value"), ["name"])


@query("g18_periodicity", "groups:l helix_like:d sheet_like:d short:d medium:d", _ACF + """
select count(*) as groups, avg(coalesce(lag in (3, 4), false)::int) as helix_like, avg(coalesce(lag = 2, false)::int) as sheet_like, avg(coalesce(lag between 1 and 6, false)::int) as short, avg(coalesce(lag between 7 and 15, false)::int) as medium from dom""", "series")  # fmt: skip
def _(spark, d):
    dom = attention.dominant_lag(attention.autocorrelation(series(spark, d), 15, ["name"], "i", "value"), ["name"])
    per = attention.periodicity(dom)
    return per.agg(F.count(F.lit(1)).alias("groups"), *[F.avg(c).alias(c) for c in ("helix_like", "sheet_like", "short", "medium")])


@query("w27_ranked_residues", "name:l residues:s", """
select name, string_agg(cat || (i + 1)::varchar, ',' order by r) as residues from (select *, row_number() over (partition by name order by value desc, i) as r from series) where r <= 5 group by 1""", "series")  # fmt: skip
def _(spark, d):
    return motifs.residue_list(series(spark, d), "value", "cat", 5)


@query("o1_worst_rows", "name:l mae:d", "select name, avg(abs(value - 50)) as mae from series group by 1 order by mae desc, name limit 20", "series")
def _(spark, d):
    return series(spark, d).groupBy("name").agg(F.avg(F.abs(F.col("value") - 50)).alias("mae")).orderBy(F.desc("mae"), "name").limit(20)


@query("e20_box_stats", "cat:s q25:d median:d q75:d", "select event_type as cat, quantile_cont(value, 0.25) as q25, median(value) as median, quantile_cont(value, 0.75) as q75 from events group by 1")
def _(spark, d):
    q = F.percentile("value", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return table(spark, d, "events").groupBy(F.col("event_type").alias("cat")).agg(q.alias("q")).select("cat", F.col("q")[0].alias("q25"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q75"))
