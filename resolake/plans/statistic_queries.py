"""Queries over rank statistics, score evaluation, tests, losses and model outputs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import pvalues, scalars
from ..operators import attention, statistics
from ..sources.tables import table
from .bindings import attn, query, res, series

_RANKS = "with r as (select name, {x} as x, {y} as y, rank() over (partition by name order by {x}) + (count(*) over (partition by name, {x}) - 1) / 2 as rx, rank() over (partition by name order by {y}) + (count(*) over (partition by name, {y}) - 1) / 2 as ry from series)"


@query("e1_pearson", "n:l r:d", "select count(*) as n, corr(l_quantity, l_extendedprice) as r from lineitem")
def _(spark, d):
    return statistics.pearson(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice")


@query("e2_e3_spearman_by_group", "name:l n:l r:d", _RANKS.format(x="floor(value)", y="i % 7") + " select name, count(*) as n, case when count(*) >= 5 and min(rx) < max(rx) and min(ry) < max(ry) then corr(rx, ry) end as r from r group by 1", "series")
def _(spark, d):
    s = series(spark, d).select("name", F.floor("value").alias("x"), (F.col("i") % 7).alias("y"))
    return statistics.spearman(s, "x", "y", ["name"])


@query("e4_kendall_tau_b", "name:l tau_b:d", """
with s as (select name, i, floor(value / 20) as x, i % 5 as y from series), p as (select a.name, sign(a.x - b.x) as sx, sign(a.y - b.y) as sy from s a join s b on a.name = b.name and a.i < b.i)
select name, sum(sx * sy) / nullif(sqrt(sum(abs(sx)) * sum(abs(sy))), 0) as tau_b from p group by 1""", "series")  # fmt: skip
def _(spark, d):
    s = series(spark, d).select("name", F.floor(F.col("value") / 20).alias("x"), (F.col("i") % 5).alias("y"))
    return statistics.kendall_tau_b(s, "x", "y", ["name"])


@query("e5_point_biserial", "n:l r:d", "select count(*) as n, corr(n_chars, quality) as r from documents d join labels l on l.doc_id = d.doc_id")
def _(spark, d):
    x = table(spark, d, "documents").select("doc_id", "n_chars").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id")
    return statistics.pearson(x, "n_chars", "quality")


def _scored(spark, d):
    e = table(spark, d, "events").where("value is not null")
    return e.select(F.col("user_id").alias("name"), F.floor("value").alias("score"), (F.col("event_type") == "purchase").cast("int").alias("label"))


_SCORED = "with t as (select user_id as name, floor(value) as score, (event_type = 'purchase')::int as label from events where value is not null)"
_AUC = "(sum(r) filter (label = 1) - p * (p + 1) / 2) / nullif(p * n, 0)"


@query("e6_roc_auc_by_group", "name:l n_pos:l n_neg:l auc:d", _SCORED + """, r as (select *, rank() over (partition by name order by score) + (count(*) over (partition by name, score) - 1) / 2 as r from t)
select name, p as n_pos, n as n_neg, (s - p::double * (p + 1) / 2) / nullif(p::double * n, 0) as auc from (select name, sum(label) as p, sum(1 - label) as n, sum(r) filter (label = 1) as s from r group by 1)""")  # fmt: skip
def _(spark, d):
    return statistics.roc_auc(_scored(spark, d), "score", "label", ["name"])


_CURVE = _SCORED + """, b as (select score as threshold, sum(label) as p, count(*) as n from t group by 1),
c as (select threshold, sum(p) over w as tp, sum(n - p) over w as fp, sum(p) over () as pos, sum(n - p) over () as neg from b window w as (order by threshold desc rows unbounded preceding)),
k as (select threshold, tp, fp, tp / pos as tpr, fp / neg as fpr, tp / (tp + fp) as precision from c)"""


@query("e8_roc_curve_points", "threshold:d tp:l fp:l tpr:d fpr:d", _CURVE + " select * from k")
def _(spark, d):
    return statistics.curve_points(_scored(spark, d), "score", "label")


@query("e7_trapezoid_auc", "auc:d", _CURVE + " select sum((fpr - l) * (tpr + m) / 2) as auc from (select fpr, tpr, coalesce(lag(fpr) over (order by threshold desc), 0) as l, coalesce(lag(tpr) over (order by threshold desc), 0) as m from k)")
def _(spark, d):
    return statistics.trapezoid_auc(statistics.curve_points(_scored(spark, d), "score", "label"))


@query("e9_average_precision", "ap:d", _CURVE + " select sum((tpr - l) * precision) as ap from (select tpr, precision, coalesce(lag(tpr) over (order by threshold desc), 0) as l from k)")
def _(spark, d):
    return statistics.average_precision(statistics.curve_points(_scored(spark, d), "score", "label"))


@query("e10_youden", "threshold:d j:d", _CURVE + " select threshold, j from (select threshold, round(tpr - fpr, 12) as j from k) order by j desc, threshold desc limit 1")
def _(spark, d):
    return statistics.youden(statistics.curve_points(_scored(spark, d), "score", "label"))


@query("e11_f1_mcc", "tp:l fp:l fn:l tn:l f1:d mcc:d", _SCORED + """, c as (select count(*) filter (label = 1 and score >= 50)::double as tp, count(*) filter (label = 0 and score >= 50)::double as fp, count(*) filter (label = 1 and score < 50)::double as fn, count(*) filter (label = 0 and score < 50)::double as tn from t)
select *, 2 * tp / (2 * tp + fp + fn) as f1, (tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)) as mcc from c""")  # fmt: skip
def _(spark, d):
    return statistics.f1_mcc(_scored(spark, d), F.col("score") >= 50, "label")


_EVAL = """with w as (select name, (cat = 'purchase')::int as label, value as by_value, case when i % 3 <> 0 then (i % 11)::double end as by_place from series),
t as (select name, label, 'by_value' as method, by_value as score from w union all select name, label, 'by_place', by_place from w where by_place is not null),
r as (select *, rank() over (partition by method, name order by score) + (count(*) over (partition by method, name, score) - 1) / 2 as r from t),
a as (select method, name, sum(label) as p, sum(1 - label) as n, sum(r) filter (label = 1) as s from r group by 1, 2),
e as (select method, name, p + n as n, case when p + n >= 5 then (s - p::double * (p + 1) / 2) / nullif(p::double * n, 0) end as auc from a)"""


def _evaluated(spark, d):
    s = series(spark, d)
    wide = s.select("name", (F.col("cat") == "purchase").cast("int").alias("label"), F.col("value").alias("by_value"), F.when(F.col("i") % 3 != 0, (F.col("i") % 11).cast("double")).alias("by_place"))
    return statistics.evaluate_methods(wide, ["by_value", "by_place"], "label", "name")


@query("e12_evaluate_methods", "method:s name:l n:l auc:d", _EVAL + " select * from e", "series")
def _(spark, d):
    return _evaluated(spark, d)


@query("e16_wilcoxon", "n:l median:d w_plus:d z:d", _EVAL + """, d as (select round(a.auc - b.auc, 9) as d from e a join e b on a.name = b.name and a.method = 'by_value' and b.method = 'by_place' where a.auc is not null and b.auc is not null),
x as (select d, rank() over (order by abs(d)) + (count(*) over (partition by abs(d)) - 1) / 2 as r, count(*) over (partition by abs(d)) as t from d where d <> 0),
s as (select count(*)::double as m, sum(r) filter (d > 0) as w, sum(t::double * t - 1) as c from x)
select (select count(*) from d) as n, (select quantile_cont(d, 0.5) from d) as median, w as w_plus, (w - m * (m + 1) / 4) / sqrt(m * (m + 1) * (2 * m + 1) / 24 - c / 48) as z from s""", "series")  # fmt: skip
def _(spark, d):
    e = _evaluated(spark, d).where("auc is not null")
    wide = e.groupBy("name").pivot("method", ["by_value", "by_place"]).agg(F.first("auc")).where("by_value is not null and by_place is not null")
    return statistics.wilcoxon(wide.withColumn("delta", F.round(F.col("by_value") - F.col("by_place"), 9)), "delta")


@query("e16_wilcoxon_p", "n:l p:d")
def _(spark, d):
    e = _evaluated(spark, d).where("auc is not null")
    wide = e.groupBy("name").pivot("method", ["by_value", "by_place"]).agg(F.first("auc"))
    w = statistics.wilcoxon(wide.withColumn("delta", F.round(F.col("by_value") - F.col("by_place"), 9)), "delta")
    return w.withColumn("p", pvalues.normal_upper_p("z"))


_HUBS = """with h as (select name, j as i, coalesce(max(w) filter (i <> j), 0) as m from attn group by 1, 2), c as (select name, round(quantile_cont(m, 0.9), 9) as cut from h group by 1),
t as (select h.name, h.i, round(m, 9) >= cut as hub, r.value > 3000 as marked from h join c on c.name = h.name join res r on r.name = h.name and r.i = h.i),
k as (select name, count(*) as length, count(*) filter (hub) as n_hub, count(*) filter (marked) as n_marked, count(*) filter (hub and marked) as overlap from t group by 1)"""


def _hubs(spark, d):
    from ..operators.positions import top_percent

    hubs = top_percent(attention.by_key_position(attn(spark, d)), "max_received", 10.0, out="hub")
    marked = res(spark, d).select("name", "i", (F.col("value") > 3000).alias("marked"))
    return statistics.hub_overlap(hubs.join(marked, ["name", "i"]), "hub", "marked", ["name"])


@query("e13_hub_overlap", "name:l length:l n_hub:l n_marked:l overlap:l odds_ratio:d expected:d fold_enrichment:d", _HUBS + """
select *, (overlap * (length - n_hub - n_marked + overlap))::double / nullif((n_hub - overlap) * (n_marked - overlap), 0) as odds_ratio, n_hub * n_marked / length as expected, overlap / nullif(n_hub * n_marked / length, 0) as fold_enrichment from k""", "attn", "res")  # fmt: skip
def _(spark, d):
    return _hubs(spark, d)


@query("e13_fisher_p", "name:l overlap:l p:d stars:s")
def _(spark, d):
    p = _hubs(spark, d).withColumn("p", pvalues.fisher_greater_p("overlap", "n_hub", "n_marked", "length"))
    return p.withColumn("stars", scalars.stars(F.col("p")))


_KW = """with t as (select event_type as g, floor(value) as x from events where value is not null), r as (select g, rank() over (order by x) + (count(*) over (partition by x) - 1) / 2 as r, count(*) over (partition by x) as t from t),
b as (select g, count(*)::double as n, avg(r) as m, sum(t::double * t - 1) as c from r group by 1), a as (select sum(n) as n, count(*) as k, sum(c) as c from b),
h as (select a.n, a.k, 12 * sum(b.n * (b.m - (a.n + 1) / 2) ** 2) / (a.n * (a.n + 1)) / (1 - max(a.c) / (a.n ** 3 - a.n)) as h from b, a group by a.n, a.k)"""


@query("e15_kruskal_wallis", "n:l k:l h:d eta2:d", _KW + " select n, k, h, (h - k + 1) / (n - k) as eta2 from h")
def _(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("g"), F.floor("value").alias("x"))
    return statistics.kruskal_wallis(e, "x", "g")


@query("e15_kruskal_wallis_p", "h:d p:d stars:s")
def _(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("g"), F.floor("value").alias("x"))
    k = statistics.kruskal_wallis(e, "x", "g").withColumn("p", pvalues.chi2_p(F.col("h"), (F.col("k") - 1).cast("double")))
    return k.withColumn("stars", scalars.stars(F.col("p")))


@query("e17_significance_stars", "stars:s n:l", "select case when x < 0.001 then '***' when x < 0.01 then '**' when x < 0.05 then '*' else '' end as stars, count(*) as n from (select l_discount / 5 as x from lineitem) group by 1")
def _(spark, d):
    return table(spark, d, "lineitem").groupBy(scalars.stars(F.col("l_discount") / 5).alias("stars")).agg(F.count(F.lit(1)).alias("n"))


@query("e18_linear_trend", "flag:s slope:d intercept:m", "select l_returnflag as flag, regr_slope(l_extendedprice, l_quantity) / 1000 as slope, regr_intercept(l_extendedprice, l_quantity) as intercept from lineitem group by 1")
def _(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("flag"), "l_extendedprice", "l_quantity")
    return statistics.linear_trend(li, "l_extendedprice", "l_quantity", ["flag"]).withColumn("slope", F.col("slope") / 1000)


@query("e19_qq_points", "doc_id:l r:l p:d theoretical:d")
def _(spark, d):
    return statistics.qq_points(table(spark, d, "documents").select("doc_id", F.ln(F.col("n_chars").cast("double")).alias("x")), "x", "doc_id")


_EFFECT = "(with " + _KW.removeprefix("with ") + " select (h - k + 1) / (n - k) as eta2 from h)"


@query("e21_effect_verdict", "a:d b:d verdict:s", f"""
select a, b, case when a > 1.2 * b then 'first' when b > 1.2 * a then 'second' else 'similar' end as verdict from (select {_EFFECT} as a, {_EFFECT.replace("event_type as g", "extract(hour from ts) as g")} as b)""")  # fmt: skip
def _(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("g"), F.hour("ts").cast("string").alias("hour"), F.floor("value").alias("x"))
    a, b = (statistics.kruskal_wallis(e, "x", g).select(F.col("eta2").alias(n)) for g, n in (("g", "a"), ("hour", "b")))
    both = a.crossJoin(b)  # a row each
    return both.select("a", "b", F.when(F.col("a") > 1.2 * F.col("b"), "first").when(F.col("b") > 1.2 * F.col("a"), "second").otherwise("similar").alias("verdict"))


@query("e22_strongest_delta", "label:s cat:s delta:d", """
with n as (select o_orderstatus as label, o_orderpriority as cat, count(*) / sum(count(*)) over (partition by o_orderstatus) as p from orders group by 1, 2), b as (select o_orderpriority as cat, count(*) / sum(count(*)) over () as p from orders group by 1),
x as (select n.label, n.cat, n.p - b.p as delta from n join b on b.cat = n.cat) select label, cat, delta from (select *, row_number() over (partition by label order by round(abs(delta), 12) desc, cat) as r from x) where r = 1""")  # fmt: skip
def _(spark, d):
    o = table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("label"), F.col("o_orderpriority").alias("cat")).agg(F.count(F.lit(1)).alias("n"))
    everything = Window.partitionBy()
    x = o.withColumn("delta", F.col("n") / F.sum("n").over(Window.partitionBy("label")) - F.sum("n").over(Window.partitionBy("cat")) / F.sum("n").over(everything))
    w = Window.partitionBy("label").orderBy(F.round(F.abs("delta"), 12).desc(), "cat")
    return x.withColumn("r", F.row_number().over(w)).where("r = 1")


_PREDICTED = "with t as (select l_returnflag as flag, l_orderkey as name, ln(l_quantity) as y, l_quantity / 20 as p from lineitem where l_quantity > 0)"


def _predicted(spark, d):
    return table(spark, d, "lineitem").where("l_quantity > 0").select(F.col("l_returnflag").alias("flag"), F.col("l_orderkey").alias("name"), scalars.safe_ln(F.col("l_quantity")).alias("y"), (F.col("l_quantity") / 20).alias("p"))


@query("a27_regression_metrics", "flag:s n:l mse:d rmse:d mae:d r2:d", _PREDICTED + " select flag, count(*) as n, avg((y - p) ** 2) as mse, sqrt(avg((y - p) ** 2)) as rmse, avg(abs(y - p)) as mae, 1 - avg((y - p) ** 2) / var_pop(y) as r2 from t group by 1")
def _(spark, d):
    return statistics.regression_metrics(_predicted(spark, d), "y", "p", ["flag"])


@query("a28_sequence_errors", "name:l mse:d mae:d mean_true:d mean_pred:d length:l", _PREDICTED + " select name, avg((y - p) ** 2) as mse, avg(abs(y - p)) as mae, avg(y) as mean_true, avg(p) as mean_pred, count(*) as length from t group by 1")
def _(spark, d):
    e = F.col("y") - F.col("p")
    return _predicted(spark, d).groupBy("name").agg(F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), F.avg("y").alias("mean_true"), F.avg("p").alias("mean_pred"), F.count(F.lit(1)).alias("length"))


_LOGITS = "with t as (select event_id, [value / 50 - 1, (event_id % 7)::double - 3, 0.5::double] as z, event_id % 3 as y, event_id % 10 <> 0 as valid from events where value is not null)"


def _logits(spark, d):
    z = F.array(F.col("value") / 50 - 1, (F.col("event_id") % 7).cast("double") - 3, F.lit(0.5))
    return table(spark, d, "events").where("value is not null").select("event_id", z.alias("z"), (F.col("event_id") % 3).cast("int").alias("y"), (F.col("event_id") % 10 != 0).alias("valid"))


_SOFT = _LOGITS + ", m as (select *, list_max(z) as m from t), e as (select *, list_transform(z, lambda x: exp(x - m)) as e from m), s as (select *, list_transform(e, lambda x: x / list_sum(e)) as p from e)"


@query("f9_softmax_argmax", "event_id:l p0:d p1:d p2:d best:l", _SOFT + " select event_id, p[1] as p0, p[2] as p1, p[3] as p2, list_position(z, list_max(z)) - 1 as best from s")
def _(spark, d):
    p = scalars.softmax(F.col("z"))
    x = _logits(spark, d).withColumn("p", p)
    return x.select("event_id", *[F.col("p")[k].alias(f"p{k}") for k in range(3)], scalars.argmax(F.col("z")).alias("best"))


@query("f13_f14_classification_losses", "focal_valid:d focal_all:d cross_entropy:d", _SOFT + """, q as (select valid, p[y + 1] as p from s)
select avg(-((1 - p) ** 2) * ln(p)) filter (valid) as focal_valid, sum(case when valid then -((1 - p) ** 2) * ln(p) else 0 end) / count(*) as focal_all, avg(-ln(p)) filter (valid) as cross_entropy from q""")  # fmt: skip
def _(spark, d):
    x = _logits(spark, d).withColumn("p", F.element_at(scalars.softmax(F.col("z")), F.col("y") + 1))
    focal = scalars.focal_loss(F.col("p"))
    return x.agg(F.avg(F.when(F.col("valid"), focal)).alias("focal_valid"), (F.sum(F.when(F.col("valid"), focal).otherwise(0.0)) / F.count(F.lit(1))).alias("focal_all"), F.avg(F.when(F.col("valid"), -F.ln("p"))).alias("cross_entropy"))


@query("f10_ordinal_probabilities", "event_id:l p0:d p1:d p2:d", _LOGITS + ", s as (select event_id, 1 / (1 + exp(-z[1])) as a, 1 / (1 + exp(-z[2])) as b from t) select event_id, greatest(1 - a, 0) as p0, greatest(a - b, 0) as p1, greatest(b, 0) as p2 from s")
def _(spark, d):
    x = _logits(spark, d).withColumn("p", scalars.ordinal_probabilities([F.col("z")[0], F.col("z")[1]]))
    return x.select("event_id", *[F.col("p")[k].alias(f"p{k}") for k in range(3)])


@query("f11_bounded_heads", "event_id:l wide:d narrow:d", _LOGITS + " select event_id, 1 + 7 / (1 + exp(-z[1])) as wide, 2.23 / (1 + exp(-z[2])) as narrow from t")
def _(spark, d):
    x = _logits(spark, d)
    return x.select("event_id", scalars.bounded_head(F.col("z")[0], 1.0, 7.0).alias("wide"), scalars.bounded_head(F.col("z")[1], 0.0, 2.23).alias("narrow"))


@query("f12_positional_encoding", "pos:l dim:l value:d", "select p.r as pos, k.r as dim, case when k.r % 2 = 0 then sin(p.r / 10000.0::double ** ((k.r - k.r % 2) / 16.0::double)) else cos(p.r / 10000.0::double ** ((k.r - k.r % 2) / 16.0::double)) end as value from (select unnest(range(50)) as r) p, (select unnest(range(16)) as r) k")
def _(spark, d):
    grid = spark.range(50).select(F.col("id").alias("pos"), F.explode(F.sequence(F.lit(0), F.lit(15))).alias("dim"))
    return grid.withColumn("value", scalars.positional_encoding(F.col("pos"), F.col("dim"), 16))


@query("f15_f16_masked_losses", "mse:d mae:d huber:d", _PREDICTED + """, m as (select y - p as e, name % 4 <> 0 as ok from t)
select sum(case when ok then e * e else 0 end) / greatest(count(*) filter (ok), 1) as mse, avg(abs(e)) filter (ok) as mae, avg(case when abs(e) <= 1 then 0.5 * e * e else abs(e) - 0.5 end) filter (ok) as huber from m""")  # fmt: skip
def _(spark, d):
    e, ok = F.col("y") - F.col("p"), F.col("name") % 4 != 0
    return _predicted(spark, d).agg((F.sum(F.when(ok, e * e).otherwise(0.0)) / F.greatest(F.count_if(ok), F.lit(1))).alias("mse"), F.avg(F.when(ok, F.abs(e))).alias("mae"), F.avg(F.when(ok, scalars.huber(e))).alias("huber"))


@query("f17_coral_loss", "loss:d", _LOGITS + """, k as (select z[k + 1] as x, (y > k)::int as t from t, (select unnest([0, 1]) as k) where valid) select avg(greatest(x, 0) - x * t + ln(1 + exp(-abs(x)))) * 2 as loss from k""")
def _(spark, d):
    k = _logits(spark, d).where("valid").withColumn("k", F.explode(F.array(F.lit(0), F.lit(1))))
    loss = scalars.bce_with_logits(F.element_at("z", F.col("k") + 1), (F.col("y") > F.col("k")).cast("double"))
    return k.agg((F.avg(loss) * 2).alias("loss"))


@query("m7_early_stopping", "epoch:l loss:d best:d waited:l stopped:b", """
with l as (select extract(day from ts) as epoch, avg(value) as loss from events group by 1), b as (select epoch, loss, min(loss) over (order by epoch rows unbounded preceding) as best, min(loss) over (order by epoch rows between unbounded preceding and 1 preceding) as before from l),
i as (select *, before is null or loss < before - 0.001 as better from b), g as (select *, max(case when better then epoch end) over (order by epoch rows unbounded preceding) as last from i)
select epoch, loss, best, epoch - last as waited, epoch - last >= 5 as stopped from g""")  # fmt: skip
def _(spark, d):
    losses = table(spark, d, "events").groupBy(F.dayofmonth("ts").alias("epoch")).agg(F.avg("value").alias("loss"))  # a row an epoch
    w = Window.orderBy("epoch").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = F.min("loss").over(Window.orderBy("epoch").rowsBetween(Window.unboundedPreceding, -1))
    x = losses.withColumn("best", F.min("loss").over(w)).withColumn("better", before.isNull() | (F.col("loss") < before - 0.001))
    x = x.withColumn("waited", F.col("epoch") - F.max(F.when(F.col("better"), F.col("epoch"))).over(w))
    return x.withColumn("stopped", F.col("waited") >= 5)
