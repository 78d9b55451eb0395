"""Connected components by smallest id, as repeated DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, skew_join

FEW_EDGES = 50_000


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, component) for every id that occurs in edges (u, v); component is the smallest id reachable.

    Each round points every id at its smallest smaller neighbour, hands the
    other neighbours over to that one, and follows one pointer further. All
    aggregation is by the larger end with map-side minima, and rounds shrink the
    edge set. A hub shows up as the pointer of many rows, and as a hot key of
    that join it is salted (a few edges fit one task, whatever their keys). Self-links and nulls are ignored; no edges give no
    rows. The result reads a table of the scratch folder.
    """
    u, v = F.col("u"), F.col("v")
    e = scratch.table(edges.where(u != v).select(F.greatest(u, v).alias("hi"), F.least(u, v).alias("lo")).distinct())
    while True:
        first = e.groupBy("hi").agg(F.min("lo").alias("m"))
        handed = e.join(first, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"), F.lit(1).alias("moved"))
        small = e.count() <= FEW_EDGES
        pointers = first if small else scratch.table(first)
        up = pointers.select(F.col("hi").alias("m"), F.col("m").alias("mm"))
        above = pointers.join(up, "m", "left") if small else skew_join(pointers, up, ["m"], "hi", how="left")
        jumped = above.select("hi", F.coalesce("mm", "m").alias("lo"), F.col("mm").isNotNull().cast("int").alias("moved"))
        e = scratch.table(handed.unionByName(jumped).groupBy("hi", "lo").agg(F.max("moved").alias("moved")))
        if not e.agg(F.max("moved")).first()[0]:
            break
        e = e.select("hi", "lo")
    roots = e.select(F.col("lo").alias("id"), F.col("lo").alias("component")).distinct()
    return e.select(F.col("hi").alias("id"), F.col("lo").alias("component")).unionByName(roots)


def smallest_names(tree: DataFrame, names: DataFrame) -> DataFrame:
    """(node, component, least) for the nodes of a tree of components: least is the smallest `rep` among names (node, rep) of the component."""
    named = tree.withColumnRenamed("id", "node").join(names.select("node", "rep"), "node")
    return skew_join(named.select("node", "component"), named.groupBy("component").agg(F.min("rep").alias("least")), ["component"], "node")
