"""Queries over per-sequence numeric kernels and classifiers; most have no SQL counterpart."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..functions import scalars
from ..operators import attention as at
from ..operators import checks, clustering, crf, embedding, estimators, grid, heads, kernels, patches, sampling
from ..sources.tables import Scratch, table
from .attention_queries import _seqs
from .bindings import attn, query, res, series, vecs


@query("g7_cluster_profiles", "name:s i:l pattern:s energy:d")
def _(spark, d):
    return kernels.ranked_clusters(kernels.cluster_profiles(attn(spark, d)))


@query("g8_energy_ranked_clusters", "name:l c:l pattern:s", """
with e as (select name, i % 3 as c, avg(e) as e from (select name, i, sum(w) as e from (select name, i, w from attn union all select name, j, w from attn) group by 1, 2) group by 1, 2),
r as (select *, row_number() over (partition by name order by round(e, 9) desc, c) as r from e) select name, c, ['PatA', 'PatB', 'Bg'][r] as pattern from r""", "attn")  # fmt: skip
def _(spark, d):
    rec = at.received(attn(spark, d)).select("name", (F.col("i") % 3).alias("cluster"), (F.col("sum_in") + F.col("sum_out")).alias("energy"))
    mean = rec.groupBy("name", "cluster").agg(F.round(F.avg("energy"), 9).alias("energy"))
    return kernels.ranked_clusters(mean).withColumnRenamed("cluster", "c")


@query("g9_peak_demotion", "name:l i:l pattern:s", """
with m as (select name, j as i, max(w) as m from attn group by 1, 2), r as (select *, row_number() over (partition by name order by m) - 1 as r, count(*) over (partition by name) as n from m), c as (select name, min(m) as cut from r where r = least(greatest(floor(n * 0.8), 0), n - 1) group by 1)
select m.name, m.i, case when m.m >= cut then ['PatA', 'PatB', 'Bg'][m.i % 3 + 1] else 'Bg' end as pattern from m join c on c.name = m.name""", "attn")  # fmt: skip
def _(spark, d):
    m = attn(spark, d).groupBy("name", F.col("j").alias("i")).agg(F.max("w").alias("m"))
    p = m.withColumn("pattern", F.element_at(F.array(F.lit("PatA"), F.lit("PatB"), F.lit("Bg")), (F.col("i") % 3 + 1).cast("int")))
    return kernels.demote_weak(p, "m", 20.0)


@query("g10_background_subclusters", "name:s i:l pattern:s")
def _(spark, d):
    a = attn(spark, d)
    return kernels.subclusters(a, kernels.ranked_clusters(kernels.cluster_profiles(a)))


@query("g13_svd_summary", "name:s length:l effective_rank:d stable_rank:d n90:l n95:l n99:l frobenius:d spectral:d")
def _(spark, d):
    return kernels.svd_summary(attn(spark, d))


@query("g13_frobenius", "name:s frobenius:d", "select name, sqrt(sum(w * w)) as frobenius from attn group by 1", "attn")
def _(spark, d):
    return attn(spark, d).groupBy("name").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("frobenius"))


@query("w21_energy_ranks", "name:s n90:l n95:l n99:l")
def _(spark, d):
    return kernels.svd_summary(attn(spark, d))


@query("g14_g15_pc_features", "name:s pc:l i:l rank:l variance_ratio:d")
def _(spark, d):
    p = kernels.pca_loadings(attn(spark, d)).select("name", "pc", "i", F.lit(-1).alias("j"), F.col("loading").alias("w"), "variance_ratio")
    return at.top_interactions(p, 20, keys=["name", "pc"])


@query("g14_rank_k_interactions", "name:s i:l j:l rank:l w:d")
def _(spark, d):
    return at.top_interactions(kernels.rank_k_signal(attn(spark, d)), 20)


@query("g3_betweenness", "name:s i:l betweenness:d", """
with recursive u as (select name, i as src, j as dst from (select *, row_number() over (partition by name, i order by w desc, j) as r from attn) where r <= 5 and i <> j), n as (select name, count(*) as n from vecs group by 1),
walk as (select name, i as s, i as v, 0 as d from vecs union select walk.name, s, dst, d + 1 from walk join n on n.name = walk.name join u on u.name = walk.name and u.src = v where d < n),
near as (select name, s, v, min(d) as d from walk group by 1, 2, 3),
path as (select name, i as s, i as v, 0 as d, 1.0::double as c from vecs union all select path.name, path.s, u.dst, path.d + 1, sum(c) from path join u on u.name = path.name and u.src = path.v join near on near.name = path.name and near.s = path.s and near.v = u.dst and near.d = path.d + 1 group by 1, 2, 3, 4),
b as (select x.name, x.v as i, sum(x.c * y.c / z.c) as b from path x join path y on y.name = x.name and y.s = x.v join path z on z.name = x.name and z.s = x.s and z.v = y.v and z.d = x.d + y.d where x.d > 0 and y.d > 0 group by 1, 2)
select vecs.name, vecs.i, case when n > 2 then coalesce(b, 0) / ((n - 1) * (n - 2)) else 0 end as betweenness from vecs join n on n.name = vecs.name left join b on b.name = vecs.name and b.i = vecs.i""", "vecs", "attn")  # fmt: skip
def _(spark, d):
    return kernels.betweenness(at.sparse_graph(attn(spark, d), "topk", k=5), vecs(spark, d))


@query("g5_g6_bright_regions", "name:s component:l size:l center_i:l center_j:l span_i:l span_j:l mean_w:d max_w:d", """
with recursive o as (select *, row_number() over (partition by name order by w) - 1 as r, count(*) over (partition by name) as n from attn where i <> j), cut as (select name, w as cut from o where r = least(greatest(floor(n * (1 - 10.0::double / 100)), 0), n - 1)),
m as (select o.name, i, j, w from o join cut on cut.name = o.name where w >= cut), reach as (select name, i, j, i as a, j as b from m union select m.name, m.i, m.j, a, b from reach join m on m.name = reach.name and abs(m.i - reach.i) <= 1 and abs(m.j - reach.j) <= 1),
f as (select name, i, j, min([a, b]) as first from reach group by 1, 2, 3), c as (select name, first, row_number() over (partition by name order by first) - 1 as component from f group by 1, 2 having count(*) >= 2)
select m.name, component, count(*) as size, round_even(avg(m.i), 0) as center_i, round_even(avg(m.j), 0) as center_j, max(m.i) - min(m.i) + 1 as span_i, max(m.j) - min(m.j) + 1 as span_j, avg(w) as mean_w, max(w) as max_w
from m join f on f.name = m.name and f.i = m.i and f.j = m.j join c on c.name = f.name and c.first = f.first group by 1, 2""", "attn")  # fmt: skip
def _(spark, d):
    return kernels.component_summary(kernels.bright_components(attn(spark, d), 10.0, 2))


@query("g6_component_summary", "name:l size:l center_i:l center_j:l span_i:l span_j:l mean_w:d max_w:d", """
with t as (select name, i, j, w from attn where w >= 0.023) select name, count(*) as size, round_even(avg(i), 0) as center_i, round_even(avg(j), 0) as center_j, max(i) - min(i) + 1 as span_i, max(j) - min(j) + 1 as span_j, avg(w) as mean_w, max(w) as max_w from t group by 1""", "attn")  # fmt: skip
def _(spark, d):
    return kernels.component_summary(attn(spark, d).where("w >= 0.023").withColumn("component", F.lit(0)))


@query("g17_patch_motifs", "name:s motif:l patches:l distance:d")
def _(spark, d):
    assigned, _ = patches.patch_motifs(attn(spark, d))
    return assigned.groupBy("name", "motif").agg(F.count(F.lit(1)).alias("patches"), F.avg("distance").alias("distance"))


@query("g17_patch_prototypes", "motif:l row:l column:l value:d")
def _(spark, d):
    return patches.patch_motifs(attn(spark, d))[1]


@query("g17_patch_totals", "name:l patches:l mean_distance:d", """
with n as (select name, max(i) + 1 as n from attn group by 1) select n.name, (n - 4) * (n - 4) as patches, s.m as mean_distance from n join (select a.name, avg(abs(a.i - a.j)) as m from attn a join n on n.name = a.name where a.i between 2 and n - 3 and a.j between 2 and n - 3 group by 1) s on s.name = n.name""", "attn")  # fmt: skip
def _(spark, d):
    assigned, _ = patches.patch_motifs(attn(spark, d))
    return assigned.groupBy("name").agg(F.count(F.lit(1)).alias("patches"), F.avg(F.abs(F.col("i") - F.col("j"))).alias("mean_distance"))


@query("g17_motif_classes", "motif:l category:s patches:l share:d mean_distance:d", """
with n as (select name, max(i) + 1 as n from attn group by 1), p as (select a.name, a.i, a.j, (a.i + 2 * a.j) % 3 as motif, a.w from attn a join n on n.name = a.name where a.i between 2 and n - 3 and a.j between 2 and n - 3),
c as (select motif, r.cat as category, count(*) as patches, sum(abs(p.i - p.j)) as far from p left join res r on r.name = p.name and r.i = p.i group by 1, 2)
select motif, category, patches, case when category is not null then patches / sum(patches) filter (category is not null) over (partition by motif) end as share, sum(far) over (partition by motif) / sum(patches) over (partition by motif) as mean_distance from c""", "attn", "res")  # fmt: skip
def _(spark, d):
    p = patches.patches(attn(spark, d)).select("name", "i", "j", ((F.col("i") + 2 * F.col("j")) % 3).alias("motif"))
    return patches.motif_classes(p, res(spark, d), "cat")


@query("g16_stacked_pca", "name:s pc:l score:d variance_ratio:d")
def _(spark, d):
    return kernels.stacked_pca(attn(spark, d))


@query("g16_stacked_tsne", "name:s a:d b:d")
def _(spark, d):
    scores = kernels.stacked_pca(attn(spark, d), components=8).groupBy("name").agg(F.array_sort(F.collect_list(F.struct("pc", "score"))).alias("p"))
    return embedding.tsne(scores.select("name", F.col("p.score").alias("x")), rounds=60)


@query("a37_bootstrap_mean", "key:s n:l mean:d low:d high:d")
def _(spark, d):
    m = series(spark, d).groupBy("name", F.col("cat").alias("key")).agg(F.avg("value").alias("x"))
    return kernels.bootstrap_mean(m, "x", "key", ["name", "key"])


@query("f33_f34_encoded_labels", "name:l i:l code:l tick:s", """
select name, i, case cat when 'en' then 0 when 'fr' then 1 when 'de' then 2 else 3 end as code, case when i % 10 = 0 then (i + 1)::varchar || cat end as tick from res""", "res")  # fmt: skip
def _(spark, d):
    r = res(spark, d)
    code = scalars.mapped(F.col("cat"), {"en": "0", "fr": "1", "de": "2"}, "3")
    return r.select("name", "i", code.cast("int").alias("code"), F.when(F.col("i") % 10 == 0, F.concat((F.col("i") + 1).cast("string"), F.col("cat"))).alias("tick"))


def _features(spark, d):
    s = series(spark, d).withColumn("label", (F.col("value") > 50).cast("double"))
    return estimators.neighbour_features(s, "value", "cat")


@query("m4_neighbour_features", "name:l i:l value:d prev_1:d next_1:d prev_1_cat:s next_1_cat:s rel_pos:d", """
select name, i, value, lag(value, 1, 0.0) over w as prev_1, lead(value, 1, 0.0) over w as next_1, lag(cat, 1, 'START') over w as prev_1_cat, lead(cat, 1, 'END') over w as next_1_cat, i::double / count(*) over (partition by name) as rel_pos from series window w as (partition by name order by i)""", "series")  # fmt: skip
def _(spark, d):
    return _features(spark, d)


def _split_features(spark, d):
    """Positions with features and split, stored once: fits read them many times."""
    x = _features(spark, d).select("name", "i", "label", "cat", "prev_1", "next_1", "rel_pos", "prev_1_cat", "next_1_cat")
    with Scratch(spark) as scratch:
        return scratch.keep(sampling.group_split(scratch.table(x), F.col("name").cast("string")))


def _fitted(spark, d, estimator):
    x = _split_features(spark, d)
    model = estimators.feature_pipeline(["prev_1", "next_1", "rel_pos"], ["cat", "prev_1_cat", "next_1_cat"], estimator).fit(x.where("split = 'train'"))
    p = model.transform(x.where("split = 'test'"))
    return p.groupBy("label", "prediction").agg(F.count(F.lit(1)).alias("n"))


@query("m1_logistic_regression", "label:d prediction:d n:l")
def _(spark, d):
    return _fitted(spark, d, estimators.logistic())


@query("m2_random_forest", "label:d prediction:d n:l")
def _(spark, d):
    return _fitted(spark, d, estimators.forest())


@query("m3_grid_search", "max_iter:l c:d penalty:s tol:d balanced:b accuracy:d")
def _(spark, d):
    x = _features(spark, d)
    pipe = estimators.feature_pipeline(["prev_1", "next_1", "rel_pos"], ["cat"])
    return grid.logistic_grid(pipe.fit(x).transform(x), "features", "label", ["name", "i"])


@query("m5_crf_grid", "c1:d c2:d n:l accuracy:d")
def _(spark, d):
    x, c, v = _split_features(spark, d), ["cat", "prev_1_cat", "next_1_cat"], ["rel_pos"]
    penalties = [(c1, c2) for c1 in (0.01, 1.0, 100.0) for c2 in (0.01, 1.0, 100.0)]
    models = crf.fit_grid(x.where("split = 'train'"), "label", c, v, penalties, rounds=40)
    points = F.broadcast(spark.createDataFrame([(n, *p) for n, p in enumerate(penalties)], "model int, c1 double, c2 double"))
    found = crf.predict(x.where("split = 'test'"), models, "label", c, v).where("label is not null")
    return found.join(points, "model").groupBy("c1", "c2").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("label") == F.col("predicted")).cast("int")).alias("accuracy"))


@query("m6_m7_linear_heads", "kind:s epoch:l train_loss:d valid_loss:d rate:d")
def _(spark, d):
    e, log = table(spark, d, "embeddings"), []
    for kind in ("softmax", "ordinal"):
        head = heads.train_head(e, "embedding", "label", ["vec_id"], kind, classes=10, epochs=6, batches=4, accumulate=2)
        log += [(kind, *epoch.values()) for epoch in head.epochs]
    return spark.createDataFrame(log, "kind string, epoch long, train_loss double, valid_loss double, rate double")


@query("m6_head_predictions", "label:l predicted:l n:l")
def _(spark, d):
    e = table(spark, d, "embeddings")
    head = heads.train_head(e, "embedding", "label", ["vec_id"], "softmax", classes=10, epochs=4, batches=4)
    return heads.predict(e, head, "embedding").groupBy("label", "predicted").agg(F.count(F.lit(1)).alias("n"))


@query("o12_sequence_clusters", "representative:l name:l")
def _(spark, d):
    return clustering.sequence_clusters(_seqs(spark, d), every=4)


def _checked(pdf):
    """A record's own work, which fails on some."""
    if (pdf["value"] < 1).any():
        raise ValueError("value below 1")
    return pdf.groupby("name", as_index=False).agg(n=("value", "size"))


@query("p19_failure_table", "status:s n:l rows:l", """
with r as (select user_id, min(value) < 1 as bad, count(*) as c from events group by 1) select case when bad then 'ValueError: value below 1' else 'ok' end as status, count(*) as n, sum(case when bad then 0 else c end) as rows from r group by 1""")  # fmt: skip
def _(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("name"), "value")
    done = checks.captured(e, "name", _checked, StructType([StructField("name", LongType()), StructField("n", LongType())]))
    return done.groupBy(F.coalesce("error", F.lit("ok")).alias("status")).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"))


def _lengths(spark, d):
    return series(spark, d).groupBy("name").agg((F.max("i") + 1 - F.col("name") % 3).alias("length"))


_LENGTHS = "with n as (select name, max(i) + 1 - name % 3 as length from series group by 1)"


@query("p16_valid_positions", "name:l n:l", _LENGTHS + " select s.name, count(*) as n from series s join n on n.name = s.name where s.i < n.length group by 1", "series")
def _(spark, d):
    return checks.valid_positions(series(spark, d), _lengths(spark, d)).groupBy("name").agg(F.count(F.lit(1)).alias("n"))


@query("p16_invalid_report", "name:l n_invalid:l examples:s", _LENGTHS + " select s.name, count(*) as n_invalid, string_agg(s.i::varchar, ',' order by s.i) as examples from series s join n on n.name = s.name where s.i >= n.length group by 1", "series")
def _(spark, d):
    r = checks.invalid_report(series(spark, d), _lengths(spark, d))
    return r.withColumn("examples", F.array_join(F.transform("examples", lambda x: x.cast("string")), ","))


@query("p17_unpadded", "cat:s n:l", "select cat, count(*) as n from res where quality is not null group by 1", "res")
def _(spark, d):
    return checks.unpadded(res(spark, d).withColumn("label", F.coalesce("quality", F.lit(-1))), "label").groupBy("cat").agg(F.count(F.lit(1)).alias("n"))


def _sites(spark, d):
    """Sites that expect their event's letter; some are numbered one too high."""
    letter = F.upper(F.substring("cat", 1, 1))
    s = series(spark, d)
    sequences = s.groupBy("name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", letter.alias("a")))), lambda r: r["a"]), "").alias("sequence"))
    return s.select("name", (F.col("i") + (F.col("value") > 99).cast("int")).alias("i"), letter.alias("expected")), sequences


_NUMBERED = """with t as (select name, i, upper(substr(cat, 1, 1)) as a, value > 99 as up, upper(substr(lead(cat) over (partition by name order by i), 1, 1)) as b from series),
c as (select name, count(*) as total, count(*) filter (up and b is null) as out_of_range, count(*) filter (up and b <> a) as mismatch from t group by 1)"""


@query("a40_site_numbering", "name:l total:l out_of_range:l mismatch:l passed:b", _NUMBERED + " select *, out_of_range + mismatch = 0 as passed from c", "series")
def _(spark, d):
    return checks.numbering_checks(*_sites(spark, d), ["name"])


@query("p18_strict_numbering", "name:l n:l", _NUMBERED + " select name, total as n from c where out_of_range + mismatch = 0", "series")
def _(spark, d):
    return checks.strict_numbering(*_sites(spark, d)).groupBy("name").agg(F.count(F.lit(1)).alias("n"))


@query("f3_three_letter_codes", "letter:s n:l", """
select ['A', 'U', 'O', 'H', 'H', 'C', 'D', 'X', 'W'][p_partkey % 9 + 1] as letter, count(*) as n from part group by 1""")  # fmt: skip
def _(spark, d):
    codes = F.array(*map(F.lit, ["ALA", "sec", " PYL", "HIS", "HSD", "CYX", "ASH", "UNK", "TRP"]))
    letter = scalars.residue_letter(F.element_at(codes, (F.col("p_partkey") % 9 + 1).cast("int")))
    return table(spark, d, "part").groupBy(letter.alias("letter")).agg(F.count(F.lit(1)).alias("n"))
