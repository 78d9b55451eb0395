"""Writers: tables, records, graphs and summaries. Each writes through Spark, in parallel, to a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .file_writer import write_grouped


def write_csv(df: DataFrame, path: str, single: bool = True) -> None:
    """A headed CSV, quotes doubled as readers expect; `single` puts small result tables into one file."""
    (df.coalesce(1) if single else df).write.mode("overwrite").csv(path, header=True, escape='"')


def write_json(df: DataFrame, path: str, by: str | None = None) -> None:
    """JSON records, in a folder a value of `by` if given."""
    w = df.write.mode("overwrite")
    (w.partitionBy(by) if by else w).json(path)


def write_fasta(df: DataFrame, path: str, name: str = "domain", seq: str = "sequence") -> None:
    df.select(F.concat(F.lit(">"), F.col(name), F.lit("\n"), F.col(seq)).alias("value")).write.mode("overwrite").text(path)


def write_graphml(edges: DataFrame, nodes: DataFrame, path: str) -> None:
    """One directed weighted GraphML file a graph: <name>.graphml, nodes by number, then edges."""
    none = F.lit(None)
    n = nodes.select(F.col("name").cast("string").alias("name"), F.lit(0).alias("kind"), F.col("i").cast("long").alias("a"), none.cast("long").alias("b"), none.cast("double").alias("w"))
    e = edges.select(F.col("name").cast("string").alias("name"), F.lit(1).alias("kind"), F.col("src").cast("long").alias("a"), F.col("dst").cast("long").alias("b"), F.col("w").cast("double").alias("w"))
    write_grouped(n.unionByName(e), path, "graphml", ["kind", "a", "b"])


def write_npy(matrix: DataFrame, path: str) -> None:
    """One .npy file a matrix of (name, i, j, w): <name>.npy, float64; cells that are not given are 0."""
    cells = matrix.select(F.col("name").cast("string").alias("name"), F.col("i").cast("long").alias("a"), F.col("j").cast("long").alias("b"), F.coalesce(F.col("w").cast("double"), F.lit(0.0)).alias("w"))
    write_grouped(cells, path, "npy", ["a", "b"])


def graph_records(edges: DataFrame, proteins: DataFrame) -> DataFrame:
    """(id, sequence, length, edges) records, edges ordered by source and target."""
    e = edges.groupBy("name").agg(F.array_sort(F.collect_list(F.struct(F.col("src").alias("source"), F.col("dst").alias("target"), F.col("w").alias("weight")))).alias("edges"))
    return proteins.join(e, "name", "left").select(F.col("name").alias("id"), "sequence", F.length("sequence").alias("length"), F.coalesce("edges", F.array().cast("array<struct<source:int,target:int,weight:double>>")).alias("edges"))


def text_report(rows: list[dict], latex: bool = False) -> str:
    """A small result table, already on the driver, as plain text or a LaTeX tabular."""
    if not rows:
        return ""
    cols = list(rows[0])
    lines = [[str(r[c]) for c in cols] for r in rows]
    if latex:
        body = " \\\\\n".join(" & ".join(x) for x in [cols, *lines])
        return f"\\begin{{tabular}}{{{'l' * len(cols)}}}\n{body} \\\\\n\\end{{tabular}}"
    widths = [max(map(len, column)) for column in zip(cols, *lines, strict=True)]
    return "\n".join("  ".join(v.ljust(w) for v, w in zip(x, widths, strict=True)).rstrip() for x in [cols, *lines])


def metric_columns(columns: list[str]) -> dict[str, str]:
    """New names for metric columns: blanks and hyphens become underscores."""
    return {c: c.replace(" ", "_").replace("-", "_") for c in columns}


def collect_summaries(runs: dict[str, DataFrame], keep: str = r"accuracy|f1|mse|mae|r2|time") -> DataFrame:
    """Run summaries under one another with their run's name first, and only metric columns after it."""
    import re
    from functools import reduce

    parts = [df.withColumnsRenamed(metric_columns(df.columns)).withColumn("run", F.lit(name)) for name, df in runs.items()]
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return every.select("run", *[c for c in every.columns if c != "run" and re.search(keep, c)])


def with_fallback(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """The first source's metrics by key, and where they are missing the second's."""
    own = [c for c in first.columns if c != key]
    b = second.select(key, *[F.col(c).alias(f"_{c}") for c in second.columns if c != key])
    both = first.join(b, key, "full")
    more = [c for c in second.columns if c != key and c not in own]
    return both.select(key, *[F.coalesce(c, f"_{c}").alias(c) if f"_{c}" in both.columns else F.col(c) for c in own], *[F.col(f"_{c}").alias(c) for c in more])
