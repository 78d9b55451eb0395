"""What the general operators' tables are bound to on the driver's tables, on both sides of the comparison.

A query is registered with the columns that it returns and their kinds: l
(long), d (double at 6 decimals), m (double at 2 decimals), s (string), b
(boolean). The same casts go around the DataFrame and around its SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import attention
from ..sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Vectors of one label whose ids fall into a span of so many form a sequence, so that sequences and their matrices are bounded at any size.
SPAN = 2048

# SQL sides of the bound tables below, by name; each may use those before it.
CTES = {
    "series": "series as (select user_id as name, row_number() over (partition by user_id order by ts, event_id) - 1 as i, event_id, event_type as cat, value, ts from events)",
    "vecs": f"vecs as (select label + 1000 * (vec_id // {SPAN}) as name, row_number() over (partition by label, vec_id // {SPAN} order by vec_id) - 1 as i, vec_id, embedding::double[] as v from embeddings)",
    "attn": "attn as (select name, i, j, round(s / sum(s) over (partition by name, i), 9) as w from (select a.name, a.i, b.i as j, (list_cosine_similarity(a.v, b.v) + 1) / 2 as s from vecs a join vecs b on a.name = b.name))",
    "half": "half as (select name, i, j, round(s / sum(s) over (partition by name, i), 9) as w from (select a.name, a.i, b.i as j, (list_cosine_similarity(a.v[1:32], b.v[1:32]) + 1) / 2 as s from vecs a join vecs b on a.name = b.name))",
    "res": "res as (select v.name, v.i, v.vec_id, d.lang as cat, d.source, d.n_chars::double as value, d.text, l.quality from vecs v join documents d on d.doc_id = v.vec_id left join (select doc_id, max(quality) as quality from labels group by 1) l on l.doc_id = v.vec_id)",
}
_NEEDS = {"attn": ["vecs"], "half": ["vecs"], "res": ["vecs"]}
_SPARK = {"l": lambda c: c.cast("long"), "d": lambda c: F.round(c.cast("double"), 6) + 0.0, "m": lambda c: F.round(c.cast("double"), 2) + 0.0, "s": lambda c: c.cast("string"), "b": lambda c: c.cast("boolean")}
_DUCK = {"l": "{0}::bigint", "d": "round({0}::double, 6) + 0.0", "m": "round({0}::double, 2) + 0.0", "s": "{0}::varchar", "b": "{0}::boolean"}


def query(name: str, columns: str, sql: str | None = None, *ctes: str):
    """Register a function as a query; its SQL may use the named tables above."""
    kinds = [c.split(":") for c in columns.split()]

    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: f(spark, sf_dir).select(*[_SPARK[k](F.col(c)).alias(c) for c, k in kinds])
        if sql is not None:
            need = list(dict.fromkeys(x for c in ctes for x in [*_NEEDS.get(c, []), c]))
            body = sql.strip()
            pre = ", ".join(CTES[c] for c in need)
            head = "with recursive " if body.startswith("with recursive ") else "with "
            inner = f"{head}{pre}, {body[len(head):]}" if pre and body.startswith("with ") else f"with {pre} {body}" if pre else body
            SQL[name] = f"select {', '.join(_DUCK[k].format(f'q.{c}') + f' as {c}' for c, k in kinds)} from ({inner}) q"
        return f

    return register


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions of a sequence: each user's events in time order."""
    e = table(spark, sf_dir, "events")
    i = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return e.select(F.col("user_id").alias("name"), i.alias("i"), "event_id", F.col("event_type").alias("cat"), "value", "ts")


def vecs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions with vectors: each label's embeddings by id, a sequence a span of ids."""
    e = table(spark, sf_dir, "embeddings")
    name = F.col("label") + 1000 * F.floor(F.col("vec_id") / SPAN)
    i = F.row_number().over(Window.partitionBy(name).orderBy("vec_id")) - 1
    return e.select(name.alias("name"), i.alias("i"), "vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))


def attn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attention.similarity_attention(vecs(spark, sf_dir), 64)


def half(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second model: the first half of the dimensions."""
    return attention.similarity_attention(vecs(spark, sf_dir).withColumn("v", F.slice("v", 1, 32)), 32)


def res(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotations of the vectors' positions, from the document of the same number."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), F.col("lang").alias("cat"), "source", F.col("n_chars").cast("double").alias("value"), "text")
    q = table(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("vec_id")).agg(F.max("quality").alias("quality"))
    return vecs(spark, sf_dir).drop("v").join(d, "vec_id").join(q, "vec_id", "left")
