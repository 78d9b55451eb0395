"""Joins between annotation sources, by parameters rather than fixed keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def align(base: DataFrame, others: list[DataFrame], keys: list[str], how: str = "inner") -> DataFrame:
    """The base joined with each other source on the keys, in turn."""
    return reduce(lambda a, b: a.join(b, keys, how), others, base)


def methods_wide(base: DataFrame, predictions: dict[str, DataFrame], keys: list[str], value: str) -> DataFrame:
    """Base rows with one column a method, null where it has no prediction."""
    return align(base, [p.select(*keys, F.col(value).alias(m)) for m, p in predictions.items()], keys, "left")


def common_keys(frames: list[DataFrame], key: str) -> DataFrame:
    """Keys that all frames hold."""
    return reduce(lambda a, b: a.intersect(b.select(key)), frames[1:], frames[0].select(key).distinct())


def lookup_status(records: DataFrame, reference: DataFrame, key: str, length: str, ref_length: str) -> DataFrame:
    """Records with the reference's columns and a status: added, missing, or mismatch of lengths."""
    marked = records.join(reference.withColumn("_found", F.lit(True)), key, "left")
    status = F.when(F.col("_found").isNull(), "missing").when(F.col(length) != F.col(ref_length), "mismatch").otherwise("added")
    return marked.withColumn("status", status).drop("_found")


def last_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def first_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def _text_key(text: str):
    """What texts meet by: a digest, so that no shuffle is keyed by whole texts and none of the other side travels."""
    return F.sha2(F.col(text), 256)


def join_on_text(a: DataFrame, b: DataFrame, text: str, order: list[str]) -> DataFrame:
    """Equal texts meet; of several rows of b with one text, the last counts. Null texts meet nothing."""
    rest = [c for c in b.columns if c != text]
    last = b.select(_text_key(text).alias("_key"), *rest).groupBy("_key").agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_b")).select("_key", "_b.*")
    return a.withColumn("_key", _text_key(text)).join(last, "_key").drop("_key")


def join_id_or_text(a: DataFrame, b: DataFrame, key: str, text: str, values: list[str]) -> DataFrame:
    """Rows of a with b's values by id, else by text: two equi joins, never one with OR."""
    by_id = b.select(F.col(key), *[F.col(v).alias(f"_i_{v}") for v in values], F.lit(True).alias("_by_id"))
    first = b.groupBy(_text_key(text).alias("_key")).agg(F.min_by(F.struct(*values), key).alias("_t"), F.lit(True).alias("_by_text"))
    both = a.join(by_id, key, "left").withColumn("_key", _text_key(text)).join(first, "_key", "left").where("_by_id or _by_text")
    pick = [F.when(F.col("_by_id"), F.col(f"_i_{v}")).otherwise(F.col("_t")[v]).alias(v) for v in values]
    return both.select(*a.columns, *pick)


def in_intervals(positions: DataFrame, intervals: DataFrame, name: str = "name", pos: str = "pos", width: int = 64) -> DataFrame:
    """Positions inside any inclusive interval (name, start, end) of their sequence.

    Intervals and positions meet by equality on (name, bucket of `width`
    positions), so long intervals cost a row a bucket and nothing is compared
    across buckets.
    """
    cut = intervals.where("start <= end").select(name, "start", "end", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.col("end") / width))).alias("_b"))
    at = positions.withColumn("_b", F.floor(F.col(pos) / width))
    inside = F.col(pos).between(F.col("start"), F.col("end"))
    return at.alias("p").join(cut.alias("c"), (F.col(f"p.{name}") == F.col(f"c.{name}")) & (F.col("p._b") == F.col("c._b")) & inside, "left_semi").drop("_b")


def all_pairs_of_models(long: DataFrame, keys: list[str], value: str, model: str = "model") -> DataFrame:
    """(model_a, model_b, keys, value_a, value_b) for every pair of models, each once."""
    a = long.select(*keys, F.col(model).alias("model_a"), F.col(value).alias("value_a"))
    b = long.select(*keys, F.col(model).alias("model_b"), F.col(value).alias("value_b"))
    return a.join(b, keys).where("model_a < model_b")


def temperature_pivot(long: DataFrame, keys: list[str], column: str, values: list, x: str) -> DataFrame:
    """One row a key with a column a value of `column`; a repeated (key, value) is an error."""
    one = F.when(F.count(F.lit(1)) > 1, F.raise_error(F.lit("a key holds a value twice"))).otherwise(F.first(x))
    return long.groupBy(*keys).pivot(column, values).agg(one)
