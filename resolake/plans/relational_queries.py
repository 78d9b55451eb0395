"""Queries over joins, contingency and enrichment tables, reports, set operations and splits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import contingency as ct
from ..operators import joining, sampling
from ..sources.tables import table
from .bindings import attn, half, query, res, series


@query("j1_three_way_join", "orderkey:l part:s supplier:s quantity:d", """
select l_orderkey as orderkey, p_name as part, s_name as supplier, l_quantity as quantity from lineitem join part on p_partkey = l_partkey join supplier on s_suppkey = l_suppkey""")  # fmt: skip
def _(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity")
    p = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name")
    return li.join(p, "l_partkey").join(s, "l_suppkey").select(F.col("l_orderkey").alias("orderkey"), F.col("p_name").alias("part"), F.col("s_name").alias("supplier"), F.col("l_quantity").alias("quantity"))


_METHODS = """with b as (select name, i, cat, value from series), m as (select name, i, value / 100 as s from series where value > 20), z as (select name, i, 1.0 / (1 + i) as s from series where cat <> 'view')"""


@query("j2_methods_left_joins", "name:l i:l by_value:d by_place:d", _METHODS + " select b.name, b.i, m.s as by_value, z.s as by_place from b left join m on m.name = b.name and m.i = b.i left join z on z.name = b.name and z.i = b.i", "series")
def _(spark, d):
    s = series(spark, d)
    preds = {"by_value": s.where("value > 20").select("name", "i", (F.col("value") / 100).alias("s")), "by_place": s.where("cat <> 'view'").select("name", "i", (1.0 / (1 + F.col("i"))).alias("s"))}
    return joining.methods_wide(s.select("name", "i"), preds, ["name", "i"], "s")


@query("j3_o5_common_keys", "name:l", "select distinct user_id as name from events where event_type = 'purchase' and value > 100 intersect select user_id from events where event_type = 'click' and value > 100 intersect select user_id from events where event_type = 'view' and value > 100")
def _(spark, d):
    e = table(spark, d, "events").where("value > 100").withColumnRenamed("user_id", "name")
    return joining.common_keys([e.where(F.col("event_type") == t) for t in ("purchase", "click", "view")], "name")


@query("j4_a38_lookup_status", "status:s n:l", """
select case when l.doc_id is null then 'missing' when d.doc_id % 3 <> l.quality then 'mismatch' else 'added' end as status, count(*) as n from documents d left join (select doc_id, max(quality) as quality from labels group by 1) l on l.doc_id = d.doc_id group by 1""")  # fmt: skip
def _(spark, d):
    docs = table(spark, d, "documents").select("doc_id", (F.col("doc_id") % 3).alias("length"))
    ref = table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("ref_length"))
    return joining.lookup_status(docs, ref, "doc_id", "length", "ref_length").groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("j5_join_on_text", "doc_id:l last_id:l", "select d.doc_id, l.m as last_id from documents d join (select text, max(doc_id) as m from documents group by 1) l on l.text = d.text")
def _(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    return joining.join_on_text(docs, docs.select("text", F.col("doc_id").alias("last_id")), "text", ["last_id"])


@query("j6_join_id_or_text", "doc_id:l quality:l", """
with p as (select l.doc_id, d.text, l.quality from (select doc_id, max(quality) as quality from labels group by 1) l join documents d on d.doc_id = l.doc_id), t as (select text, arg_min(quality, doc_id) as quality from p group by 1)
select d.doc_id, case when p.doc_id is not null then p.quality else t.quality end as quality from documents d left join p on p.doc_id = d.doc_id left join t on t.text = d.text where p.doc_id is not null or t.text is not null""")  # fmt: skip
def _(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    lab = table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    return joining.join_id_or_text(docs, lab.join(docs, "doc_id"), "doc_id", "text", ["quality"])


@query("j7_representative_map", "custkey:l region:s", "select c_custkey as custkey, r_name as region from customer left join nation on n_nationkey = c_nationkey left join region on r_regionkey = n_regionkey")
def _(spark, d):
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("c_nationkey"), F.col("r_name").alias("region"))
    return table(spark, d, "customer").join(n, "c_nationkey", "left").select(F.col("c_custkey").alias("custkey"), "region")


@query("j8_semi_join", "orderkey:l", "select o_orderkey as orderkey from orders where o_custkey in (select c_custkey from customer where c_mktsegment = 'BUILDING')")
def _(spark, d):
    c = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, d, "orders").join(c, "o_custkey", "left_semi").select(F.col("o_orderkey").alias("orderkey"))


@query("j9_o6_anti_join", "custkey:l", "select c_custkey as custkey from customer where c_custkey not in (select o_custkey from orders where o_orderpriority = '1-URGENT')")
def _(spark, d):
    o = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").join(o, "c_custkey", "left_anti").select(F.col("c_custkey").alias("custkey"))


@query("j10_dimension_join", "cat:s weight:d n:l", """
with dim as (select * from (values ('click', 1.0), ('view', 0.5), ('purchase', 3.0)) t(cat, weight)) select e.event_type as cat, max(weight) as weight, count(*) as n from events e left join dim on dim.cat = e.event_type group by 1""")  # fmt: skip
def _(spark, d):
    dim = spark.createDataFrame([("click", 1.0), ("view", 0.5), ("purchase", 3.0)], "cat string, weight double")
    return table(spark, d, "events").select(F.col("event_type").alias("cat")).join(F.broadcast(dim), "cat", "left").groupBy("cat").agg(F.max("weight").alias("weight"), F.count(F.lit(1)).alias("n"))


@query("j11_p15_interval_join", "name:l pos:l", """
with iv as (select user_id as name, min(i) + 1 as s, max(i) + 1 as e from (select *, name as user_id from series) where cat = 'purchase' group by user_id, i // 10)
select s.name, s.i + 1 as pos from series s where exists (select 1 from iv where iv.name = s.name and s.i + 1 between iv.s and iv.e)""", "series")  # fmt: skip
def _(spark, d):
    s = series(spark, d)
    iv = s.where("cat = 'purchase'").groupBy("name", F.floor(F.col("i") / 10)).agg((F.min("i") + 1).alias("start"), (F.max("i") + 1).alias("end")).select("name", "start", "end")
    return joining.in_intervals(s.select("name", (F.col("i") + 1).alias("pos")), iv)


@query("j13_model_pairs", "model_a:s model_b:s n:l mean_gap:d", """
with r as (select 'm' || (event_id % 3) as model, user_id as name, event_type as cat, avg(value) as v from events group by 1, 2, 3)
select a.model as model_a, b.model as model_b, count(*) as n, avg(abs(a.v - b.v)) as mean_gap from r a join r b on a.name = b.name and a.cat = b.cat and a.model < b.model group by 1, 2""")  # fmt: skip
def _(spark, d):
    e = table(spark, d, "events")
    r = e.groupBy(F.concat(F.lit("m"), (F.col("event_id") % 3).cast("string")).alias("model"), F.col("user_id").alias("name"), F.col("event_type").alias("cat")).agg(F.avg("value").alias("v"))
    return joining.all_pairs_of_models(r, ["name", "cat"], "v").groupBy("model_a", "model_b").agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(F.col("value_a") - F.col("value_b"))).alias("mean_gap"))


@query("j14_truncated_alignment", "name:l n:l", "select a.name, count(*) as n from series a join (select name, row_number() over (partition by name order by i) - 1 as i from series where cat <> 'view') b on a.name = b.name and a.i = b.i group by 1", "series")
def _(spark, d):
    s = series(spark, d)
    shorter = s.where("cat <> 'view'").select("name", (F.row_number().over(Window.partitionBy("name").orderBy("i")) - 1).alias("i"))
    return s.select("name", "i").join(shorter, ["name", "i"]).groupBy("name").agg(F.count(F.lit(1)).alias("n"))


@query("a1_a2_fraction_of_total", "cat:s n:l fraction:d", "select event_type as cat, count(*) as n, count(*) / sum(count(*)) over () as fraction from events group by 1")
def _(spark, d):
    return ct.fractions(table(spark, d, "events").select(F.col("event_type").alias("cat")), "cat")


@query("a3_group_means", "model:s cluster:s mean:d", "select l_returnflag as model, l_linestatus as cluster, avg(l_quantity) as mean from lineitem group by 1, 2")
def _(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("model"), F.col("l_linestatus").alias("cluster")).agg(F.avg("l_quantity").alias("mean"))


_CONT = "with t as (select r.row, c.col, count(l.l_orderkey) as n from (select distinct l_returnflag as row from lineitem) r cross join (values ('O'), ('F'), ('X')) c(col) left join lineitem l on l.l_returnflag = r.row and l.l_linestatus = c.col group by 1, 2)"


def _flags(spark, d):
    return ct.contingency(table(spark, d, "lineitem").select(F.col("l_returnflag").alias("row"), F.col("l_linestatus").alias("col")), "row", "col", ["O", "F", "X"])


@query("a12_a13_contingency_percent", "row:s col:s n:l percent:d", _CONT + " select row, col, n, coalesce(100.0 * n / nullif(sum(n) over (partition by row), 0), 0) as percent from t")
def _(spark, d):
    return ct.row_percent(_flags(spark, d), "row")


@query("a14_independence_enrichment", "row:s col:s n:l expected:d enrichment:d", _CONT + """, e as (select *, (sum(n) over (partition by row))::double * sum(n) over (partition by col) / sum(n) over () as expected from t)
select row, col, n, expected, n / nullif(expected, 0) as enrichment from e""")  # fmt: skip
def _(spark, d):
    return ct.independence_enrichment(_flags(spark, d), "row", "col")


@query("a15_background_enrichment", "cat:s label:s enrichment:d", """
with n as (select o_orderpriority as cat, o_orderstatus as label, count(*) as n from orders group by 1, 2), p as (select *, n / sum(n) over (partition by cat) as p from n)
select p.cat, p.label, case when b.p > 1e-9 then p.p / b.p end as enrichment from p left join (select label, p from p where cat = '5-LOW') b on b.label = p.label""")  # fmt: skip
def _(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderpriority").alias("cat"), F.col("o_orderstatus").alias("label"))
    return ct.background_enrichment(o, "cat", "label", "5-LOW")


@query("a16_overall_enrichment", "cat:s label:s observed:d background:d enrichment:d", """
with n as (select o_orderpriority as cat, o_orderstatus as label, count(*) as n from orders group by 1, 2),
p as (select cat, label, n / (sum(n) over (partition by cat) + 1e-9) as observed, sum(n) over (partition by label) / (sum(n) over () + 1e-9) as background from n)
select *, observed / (background + 1e-9) as enrichment from p""")  # fmt: skip
def _(spark, d):
    return ct.overall_enrichment(table(spark, d, "orders").select(F.col("o_orderpriority").alias("cat"), F.col("o_orderstatus").alias("label")), "cat", "label")


@query("e14_chi_square", "chi2:d df:l df_effective:l", _CONT + """, e as (select *, (sum(n) over (partition by row))::double * sum(n) over (partition by col) / sum(n) over () as e from t)
select sum(case when e > 0 then (n - e) * (n - e) / e end) as chi2, (3 - 1) * (3 - 1) as df, (count(distinct row) filter (n > 0) - 1) * (count(distinct col) filter (n > 0) - 1) as df_effective from e""")  # fmt: skip
def _(spark, d):
    return ct.chi_square(_flags(spark, d), "row", "col", 3, 3)


@query("a17_pivot", "name:l click:d purchase:d view:d", "select user_id as name, max(value) filter (event_type = 'click') as click, max(value) filter (event_type = 'purchase') as purchase, max(value) filter (event_type = 'view') as view from events group by 1")
def _(spark, d):
    best = table(spark, d, "events").groupBy(F.col("user_id").alias("name"), F.col("event_type").alias("cat")).agg(F.max("value").alias("v"))
    return joining.temperature_pivot(best, ["name"], "cat", ["click", "purchase", "view"], "v")


@query("a18_a19_crosstab", "lang:s quality:l share:d", "select lang, quality, count(*) / sum(count(*)) over (partition by lang) as share from documents d join labels l on l.doc_id = d.doc_id group by 1, 2")
def _(spark, d):
    x = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    return ct.counts(x, "lang", "quality").withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("lang")))


@query("a20_distinct", "docs:l sources:l langs:l", "select count(distinct doc_id) as docs, count(distinct source) as sources, count(distinct lang) as langs from documents")
def _(spark, d):
    return table(spark, d, "documents").agg(F.countDistinct("doc_id").alias("docs"), F.countDistinct("source").alias("sources"), F.countDistinct("lang").alias("langs"))


@query("a21_keep_first", "orderkey:l linenumber:l partkey:l", """
select l_orderkey as orderkey, l_linenumber as linenumber, l_partkey as partkey from (select *, row_number() over (partition by l_orderkey, l_linenumber order by l_shipdate, l_partkey) as n from lineitem) where n = 1""")  # fmt: skip
def _(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("orderkey"), F.col("l_linenumber").alias("linenumber"), F.col("l_partkey").alias("partkey"), "l_shipdate")
    return joining.first_wins(li, ["orderkey", "linenumber"], ["l_shipdate", "partkey"])


@query("a22_s8_sorted_lists", "name:l cats:s", "select name, string_agg(cat, '|' order by i) as cats from series group by 1", "series")
def _(spark, d):
    lists = series(spark, d).groupBy("name").agg(F.array_sort(F.collect_list(F.struct("i", "cat"))).alias("x"))  # one sequence's positions
    return lists.select("name", F.array_join(F.transform("x", lambda r: r["cat"]), "|").alias("cats"))


@query("a23_max_per_key", "name:l cat:s best:d", "select user_id as name, event_type as cat, max(value) as best from events group by 1, 2")
def _(spark, d):
    return table(spark, d, "events").groupBy(F.col("user_id").alias("name"), F.col("event_type").alias("cat")).agg(F.max("value").alias("best"))


_PRED = "with t as (select floor(value / 60)::int % 3 as y, floor(value / 50)::int % 3 as p from events where value is not null)"


def _predictions(spark, d):
    k = lambda w: F.floor(F.col("value") / w).cast("int") % 3
    return table(spark, d, "events").where("value is not null").select(k(60).alias("y"), k(50).alias("p"))


@query("a24_confusion", "true:l pred:l n:l", _PRED + " select y as true, p as pred, count(*) as n from t group by 1, 2")
def _(spark, d):
    return ct.confusion(_predictions(spark, d), "y", "p")


@query("a24_confusion_wide", "cm_true_0_pred_0:l cm_true_0_pred_1:l cm_true_1_pred_0:l cm_true_1_pred_1:l", _PRED + " select " + ", ".join(f"count(*) filter (y = {a} and p = {b}) as cm_true_{a}_pred_{b}" for a in (0, 1) for b in (0, 1)) + " from t")
def _(spark, d):
    return ct.confusion_wide(_predictions(spark, d), "y", "p", [0, 1])


_REPORT = _PRED + """, c as (select unnest([0, 1, 2]) as class), r as (select class, count(*) filter (y = class) as support, count(*) filter (p = class) as predicted, count(*) filter (y = class and p = class) as tp from t, c group by 1),
s as (select class, coalesce(tp / nullif(predicted, 0), 0) as precision, coalesce(tp / nullif(support, 0), 0) as recall, coalesce(2.0 * tp / nullif(support + predicted, 0), 0) as f1, support, tp from r)"""


@query("a25_class_report", "class:l precision:d recall:d f1:d support:l", _REPORT + " select * from s")
def _(spark, d):
    return ct.class_report(_predictions(spark, d), "y", "p")


@query("a25_report_summary", "accuracy:d macro_precision:d macro_recall:d macro_f1:d weighted_precision:d weighted_recall:d weighted_f1:d", _REPORT + " select sum(tp) / sum(support) as accuracy, " + ", ".join(f"avg({c}) as macro_{c}, sum({c} * support) / sum(support) as weighted_{c}" for c in ("precision", "recall", "f1")) + " from s")
def _(spark, d):
    return ct.report_summary(ct.class_report(_predictions(spark, d), "y", "p"))


@query("a26_fixed_map_report", "class:s precision:d recall:d f1:d support:l", """
with t as (select o_orderstatus as y, case o_orderpriority when '1-URGENT' then 'F' when '2-HIGH' then 'O' else 'P' end as p from orders), c as (select distinct y as class from t union select distinct p from t),
r as (select class, count(*) filter (y = class) as support, count(*) filter (p = class) as predicted, count(*) filter (y = class and p = class) as tp from t, c group by 1)
select class, coalesce(tp / nullif(predicted, 0), 0) as precision, coalesce(tp / nullif(support, 0), 0) as recall, case when tp > 0 then 2.0 * tp / (support + predicted) end as f1, support from r""")  # fmt: skip
def _(spark, d):
    p = F.when(F.col("o_orderpriority") == "1-URGENT", "F").when(F.col("o_orderpriority") == "2-HIGH", "O").otherwise("P")
    return ct.class_report(table(spark, d, "orders").select(F.col("o_orderstatus").alias("y"), p.alias("p")), "y", "p", null_f1=True)


@query("a29_ordinal_distance", "distance:d", _PRED + " select avg(abs(p - y)) as distance from t")
def _(spark, d):
    return _predictions(spark, d).agg(F.avg(F.abs(F.col("p") - F.col("y")).cast("double")).alias("distance"))


@query("a30_a31_class_weights", "cat:s n:l balanced:d inverse_sqrt:d", "select event_type as cat, count(*) as n, sum(count(*)) over () / (count(*) over () * count(*)) as balanced, 1 / sqrt(count(*)) as inverse_sqrt from events group by 1")
def _(spark, d):
    return ct.class_weights(table(spark, d, "events").select(F.col("event_type").alias("cat")), "cat")


@query("a32_majority_baseline", "majority:s accuracy:d", """
with m as (select event_type as majority from events where extract(day from ts) <= 20 group by 1 order by count(*) desc, 1 limit 1) select majority, avg((event_type = majority)::int) as accuracy from events, m where extract(day from ts) > 20 group by 1""")  # fmt: skip
def _(spark, d):
    e = table(spark, d, "events")
    return ct.majority_baseline(e.where("dayofmonth(ts) <= 20"), e.where("dayofmonth(ts) > 20"), "event_type")


_AGREE = "with a as (select name, j as i, floor(max(w) * 1000)::int % 3 as c from attn group by 1, 2), b as (select name, j as i, floor(max(w) * 1000)::int % 3 as c from half group by 1, 2)"


def _two_labelings(spark, d):
    make = lambda m: m.groupBy("name", F.col("j").alias("i")).agg((F.floor(F.max("w") * 1000).cast("int") % 3).alias("c"))
    return make(attn(spark, d)), make(half(spark, d))


@query("a33_cluster_agreement", "c:l agreement:d n:l", _AGREE + " select a.c, avg((a.c = b.c)::int) as agreement, count(*) as n from a join b on a.name = b.name and a.i = b.i group by 1", "attn", "half")
def _(spark, d):
    return ct.agreement(*_two_labelings(spark, d), "c", ["name", "i"], by_label=True)


@query("a34_cluster_fractions", "c:l mean:d std:d", _AGREE + """, g as (select n.name, k.c, coalesce(f, 0) as f from (select distinct name from a) n cross join (values (0), (1), (2)) k(c)
left join (select name, c, count(*) / sum(count(*)) over (partition by name) as f from a group by 1, 2) x on x.name = n.name and x.c = k.c) select c, avg(f) as mean, stddev_pop(f) as std from g group by 1""", "attn", "half")  # fmt: skip
def _(spark, d):
    a, _ = _two_labelings(spark, d)
    wide = a.groupBy("name").agg(*[F.avg((F.col("c") == k).cast("double")).alias(str(k)) for k in range(3)])
    return wide.unpivot(["name"], ["0", "1", "2"], "c", "f").groupBy("c").agg(F.avg("f").alias("mean"), F.stddev_pop("f").alias("std"))


@query("a35_a36_pair_table", "a:s b:s w:d scaled:d", """
with p as (select x.cat as a, y.cat as b, sum(w) as w from attn t join res x on x.name = t.name and x.i = t.i join res y on y.name = t.name and y.i = t.j where t.i <> t.j group by 1, 2),
s as (select a, b, sum(w) / 2 as w from (select a, b, w from p union all select b, a, w from p) group by 1, 2) select a, b, w, w / max(w) over () as scaled from s""", "attn", "res")  # fmt: skip
def _(spark, d):
    r = res(spark, d).select("name", "i", "cat")
    t = attn(spark, d).where("i <> j").join(r.withColumnRenamed("cat", "a"), ["name", "i"]).join(r.select("name", F.col("i").alias("j"), F.col("cat").alias("b")), ["name", "j"])
    return ct.pair_symmetry(t.groupBy("a", "b").agg(F.sum("w").alias("w")), "a", "b", "w")


@query("a39_sequence_identity", "n:l mean:d", """
with x as (select a.c_name as a, b.c_name as b from customer a join customer b on b.c_custkey = a.c_custkey + 1)
select count(*) as n, avg(list_sum(list_transform(range(1, len(a) + 1), lambda k: (substr(a, k, 1) = substr(b, k, 1))::int)) / len(a)::double) as mean from x where length(a) = length(b)""")  # fmt: skip
def _(spark, d):
    from ..functions.scalars import identity

    c = table(spark, d, "customer")
    x = c.select("c_custkey", F.col("c_name").alias("a")).join(c.select((F.col("c_custkey") - 1).alias("c_custkey"), F.col("c_name").alias("b")), "c_custkey")
    return x.select(identity(F.col("a"), F.col("b")).alias("x")).agg(F.count("x").alias("n"), F.avg("x").alias("mean"))


@query("a40_numbering_checks", "total:l out_of_range:l mismatch:l passed:b", """
with s as (select e.name, e.i, e.cat, n.len from series e join (select name, max(i) + 1 - 5 as len from series group by 1) n on n.name = e.name), c as (select count(*) as total, count(*) filter (i >= len) as out_of_range, count(*) filter (i < len and cat = 'view' and i % 7 = 0) as mismatch from s)
select *, out_of_range = 0 and mismatch = 0 as passed from c""", "series")  # fmt: skip
def _(spark, d):
    s = series(spark, d).withColumn("len", F.max("i").over(Window.partitionBy("name")) + 1 - 5)
    out = F.col("i") >= F.col("len")
    c = s.agg(F.count(F.lit(1)).alias("total"), F.count_if(out).alias("out_of_range"), F.count_if(~out & (F.col("cat") == "view") & (F.col("i") % 7 == 0)).alias("mismatch"))
    return c.withColumn("passed", (F.col("out_of_range") == 0) & (F.col("mismatch") == 0))


@query("a41_all_bucket", "cat:s flag:l n:l total:m", """
select case when grouping(cat) = 1 then 'ALL' else cat end as cat, flag, count(*) as n, sum(value) as total from (select event_type as cat, user_id % 4 as flag, value from events) group by grouping sets ((cat, flag), (flag))""")  # fmt: skip
def _(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("cat"), (F.col("user_id") % 4).alias("flag"), "value")
    return ct.with_all_bucket(e, "cat", "flag", F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


@query("o7_s34_union_by_name", "run:s a:d b:d", "select 'x' as run, n_nationkey as a, null::double as b from nation union all select 'y', null, s_acctbal from supplier")
def _(spark, d):
    x = table(spark, d, "nation").select(F.lit("x").alias("run"), F.col("n_nationkey").cast("long").alias("a"))
    y = table(spark, d, "supplier").select(F.lit("y").alias("run"), F.col("s_acctbal").alias("b"))
    return ct.keyed_union([x, y])


@query("o3_head_cap", "custkey:l", "select c_custkey as custkey from customer order by c_custkey limit 25")
def _(spark, d):
    return table(spark, d, "customer").orderBy("c_custkey").limit(25).select(F.col("c_custkey").alias("custkey"))


@query("o4_top_per_group", "segment:s custkey:l", "select c_mktsegment as segment, c_custkey as custkey from (select *, row_number() over (partition by c_mktsegment order by c_acctbal desc, c_custkey) as r from customer) where r <= 3")
def _(spark, d):
    r = F.row_number().over(Window.partitionBy("c_mktsegment").orderBy(F.desc("c_acctbal"), "c_custkey"))
    return table(spark, d, "customer").withColumn("r", r).where("r <= 3").select(F.col("c_mktsegment").alias("segment"), F.col("c_custkey").alias("custkey"))


@query("o8_seeded_sample", "custkey:l", "select c_custkey as custkey from customer order by md5(c_custkey::varchar || '|42'), c_custkey limit 50")
def _(spark, d):
    return sampling.sample_rows(table(spark, d, "customer").select(F.col("c_custkey").alias("custkey")), 50, "custkey")


@query("o10_o11_group_split", "doc_id:l split:s", """
with g as (select distinct source as g from documents), t as (select g from g order by md5(g || '|42'), g limit (select floor(count(*) * 0.2)::bigint from g))
select doc_id, case when source in (select g from t) then 'test' else 'train' end as split from documents""")  # fmt: skip
def _(spark, d):
    return sampling.group_split(table(spark, d, "documents").select("doc_id", "source"), F.col("source"))


@query("o13_row_split", "orderkey:l split:s", "select o_orderkey as orderkey, case when ('0x' || left(md5(o_orderkey::varchar || '|42'), 8))::bigint / 4294967296.0 < 0.2 then 'valid' else 'train' end as split from orders")
def _(spark, d):
    return sampling.row_split(table(spark, d, "orders").select(F.col("o_orderkey").alias("orderkey")), "orderkey")


@query("o14_shuffle_within", "name:l i:l value_shuffled:d", """
with a as (select name, i, row_number() over (partition by name order by i) as r from series), b as (select name, value, row_number() over (partition by name order by md5(name::varchar || '|' || i::varchar || '|42'), i) as r from series)
select a.name, a.i, b.value as value_shuffled from a join b on a.name = b.name and a.r = b.r""", "series")  # fmt: skip
def _(spark, d):
    return sampling.shuffled_within(series(spark, d), "value")


@query("o15_weighted_sample", "draw:l key:l")
def _(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.greatest(F.col("c_acctbal"), F.lit(0.0)).alias("w"))
    return sampling.weighted_sample(c, "w", "key", 500)


@query("o16_sampling_weights", "name:l weight:d", """
with n as (select cat, count(*) as n from series group by 1), m as (select median(n) as m from n), s as (select name, avg((n.n < m)::int) as share from series s join n on n.cat = s.cat, m group by 1),
r as (select name, case when share = 0 then 0.001 when share < 1 then 0.5 else 1 end as raw from s) select name, raw::double / sum(raw) over () * count(*) over () as weight from r""", "series")  # fmt: skip
def _(spark, d):
    return ct.sequence_sampling_weights(series(spark, d), "cat")
