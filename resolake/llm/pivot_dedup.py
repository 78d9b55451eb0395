"""Embedding near-duplicates through a pivot-permutation index.

Every vector is described by its nearest reference points (pivots). Vectors
meet in inverted pivot lists; those that share enough pivots are verified by
cosine, and verified links are counted and joined to components.

Pivots are random directions rather than vectors of the table. How many pivots
two vectors share then depends on their angle alone, whatever the data: a dense
group owns no pivots of its own, among which its members would choose at random.

Contract for odd input
----------------------
A vector that is null, zero or holds a null or non-finite component, and one
whose length differs from most, links with nothing: 0 links, its own component,
kept. Each row gets a result row, and is a vector of its own where ids repeat: a
component's id is the smallest of its rows' ids. A row with a null id links with
nothing, has a null component and is kept. Only id and vector columns are read;
an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, is_usable, list_array, quoted, skew_join, vector_matrix
from .components import connected_components, smallest_names

NEAREST, SHARED = 16, 3
#: Bytes of a block of vectors in single precision.
BLOCK_BYTES = 4 << 20
LEAST_PIVOTS, PIVOT_BYTES = 64, 64 << 20
#: Vectors that one task describes.
TASK_ROWS = 8192
#: Rows that are posted at a time.
POST_ROWS = 65_536


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


@lru_cache(maxsize=1)
def _pivots(n: int, dim: int) -> np.ndarray:
    """The same n random directions in every worker."""
    return _unit(np.random.default_rng(17).normal(size=(n, dim))).astype(np.float32)


def _describe(n_pivots: int, dim: int):
    """The nearest pivots of each vector, by angle."""
    k = min(NEAREST, n_pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, step = _pivots(n_pivots, dim), max(16, (16 << 20) // (4 * n_pivots))
        for batch in batches:
            x = _unit(vector_matrix(batch.column(1), dim)).astype(np.float32)
            near = [np.argpartition(-(x[at : at + step] @ pivots.T), k - 1, axis=1)[:, :k] for at in range(0, len(x), step)]
            flat = np.concatenate(near or [np.empty((0, k))]).astype(np.int32).ravel()
            yield pa.RecordBatch.from_arrays([*batch.columns, list_array(flat, np.full(len(x), k))], names=[*batch.schema.names, "near"])

    return run


def _post(rank: np.ndarray, blocks: np.ndarray, prefix: int):
    """A row for each list that a vector enters and each block of that list that it meets.

    Lists are named by their rank in order of length. Vectors that share `shared`
    of k pivots share one of the first k - shared + 1 of each, so it is enough to
    enter those lists.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = np.sort(rank[np.asarray(batch.column(3).flatten()).reshape(batch.num_rows, -1)], axis=1)
            ends = np.cumsum(blocks[every[:, :prefix]].sum(axis=1))
            at = 0
            while at < len(every):
                upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + POST_ROWS, side="right")))
                rows, ranked = batch.slice(at, upto - at), every[at:upto]
                lists = ranked[:, :prefix].ravel()
                own = (np.asarray(rows.column(0)).astype(np.int64)[:, None] % blocks[ranked[:, :prefix]]).ravel()
                times = blocks[lists]
                which = np.repeat(np.arange(len(lists)), times)
                other, mine = np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times), own[which]
                taken = rows.select(["node", "v", "copies"]).take(pa.array(which // prefix))
                ranks = list_array(ranked[which // prefix].astype(np.int32).ravel(), np.full(len(which), ranked.shape[1]))
                cells = [lists[which], np.minimum(mine, other), np.maximum(mine, other), mine]
                yield pa.RecordBatch.from_arrays([*(pa.array(c.astype(np.int32)) for c in cells), *taken.columns, ranks], names=["list", "b1", "b2", "b", "node", "v", "copies", "ranked"])
                at = upto

    return run


def _masks(lists: np.ndarray, words: int) -> np.ndarray:
    """Sets of small numbers as bit masks."""
    out = np.zeros((len(lists), words), np.uint64)
    rows = np.arange(len(lists))
    for col in lists.T:
        out[rows, col >> 6] |= np.uint64(1) << (col & 63).astype(np.uint64)
    return out


def _exact_cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * b).sum(axis=1) / np.sqrt((a * a).sum(axis=1) * (b * b).sum(axis=1))


def _joined(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Roots after joining the sets of each i and j."""
    while True:
        a, b = parent[i], parent[j]
        apart = a != b
        if not apart.any():
            return parent
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up


def _verify(shared: int, least: float):
    """Links and a pointer of each vector of two blocks of a list: pairs that share enough pivots and reach the cosine.

    Both tests must hold, so the cheaper one, a matrix product, comes first. A
    pair that shares an earlier list's pivot is left to that list.
    """

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        this, b1, b2 = (int(x) for x in key)
        pdf = pdf.sort_values("node")
        sides = [pdf[pdf["b"] == b] for b in dict.fromkeys((b1, b2))]
        if not all(map(len, sides)):
            return pd.DataFrame({"node": np.empty(0, np.int64), "links": np.empty(0, np.int64), "root": np.empty(0, np.int64)})
        ids = np.concatenate([x["node"].to_numpy() for x in sides])
        v = np.concatenate([np.stack(x["v"].to_list()) for x in sides])
        copies = np.concatenate([x["copies"].to_numpy(np.float64) for x in sides])
        ranked = np.concatenate([np.stack(x["ranked"].to_list()) for x in sides])
        local, codes = np.unique(ranked, return_inverse=True)
        words = -(-len(local) // 64)
        sets, unit = _masks(codes.reshape(ranked.shape), words), _unit(v).astype(np.float32)
        before = _masks(np.arange(np.searchsorted(local, this))[None, :], words)[0]
        n, shift = len(sides[0]), 0 if b1 == b2 else len(sides[0])
        links, parent = np.zeros(len(ids)), np.arange(len(ids))
        for at in range(0, n, 256):
            sim = unit[at : min(at + 256, n)] @ unit[shift:].T
            i, j = np.nonzero(sim >= least - 1e-5)
            if b1 == b2:
                i, j = i[i + at < j], j[i + at < j]
            good = np.zeros(len(i), bool)
            for part in np.array_split(np.arange(len(i)), len(i) // 65536 + 1):
                p, q = i[part] + at, j[part] + shift
                both = sets[p] & sets[q]
                ok = (np.bitwise_count(both).sum(axis=1) >= shared) & ~(both & before).any(axis=1)
                close = np.flatnonzero(ok & (sim[i[part], j[part]] < least + 1e-5))  # too near the threshold for single precision
                ok[close] = _exact_cosine(v[p[close]].astype(np.float64), v[q[close]].astype(np.float64)) >= least
                good[part] = ok
            i, j = i[good] + at, j[good] + shift
            links += np.bincount(i, copies[j], len(ids)) + np.bincount(j, copies[i], len(ids))
            parent = _joined(parent, i, j)
        hit = np.flatnonzero(links)
        return pd.DataFrame({"node": ids[hit], "links": links[hit].astype(np.int64), "root": ids[parent[hit]]})

    return run


def _linked(reps: DataFrame, dim: int, least: float, pivot_factor: float, scratch: Scratch) -> DataFrame:
    """(node, links, root): verified links of the vectors in reps, per pair of blocks."""
    n, kind = reps.count(), reps.schema["v"].dataType.simpleString()
    n_pivots = int(max(LEAST_PIVOTS, min(pivot_factor * n**0.5, PIVOT_BYTES / (4 * dim))))
    k = min(NEAREST, n_pivots)
    prefix = k - SHARED + 1
    row = f"node long, v {kind}, copies long"
    tasks = max(reps.sparkSession.sparkContext.defaultParallelism, -(-n // TASK_ROWS))
    described = scratch.table(reps.select("node", "v", "copies").repartition(tasks).mapInArrow(_describe(n_pivots, dim), f"{row}, near array<int>"))
    sizes = np.zeros(n_pivots, np.int64)
    for pivot, c in described.select(F.explode("near").alias("p")).groupBy("p").count().collect():  # a row a pivot
        sizes[pivot] = c
    order = np.argsort(sizes, kind="stable")
    rank = np.empty(n_pivots, np.int64)
    rank[order] = np.arange(n_pivots)
    blocks = np.maximum(-(-sizes[order] // max(256, BLOCK_BYTES // (4 * dim))), 1)
    met = described.mapInArrow(_post(rank, blocks, prefix), f"list int, b1 int, b2 int, b int, {row}, ranked array<int>")
    return scratch.table(met.groupBy("list", "b1", "b2").applyInPandas(_verify(SHARED, least), "node long, links long, root long"))


def pivot_components(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", least: float = 0.95, pivot_factor: float = 8.0) -> DataFrame:
    """One row per vector: id, n_links, component_id (smallest id reachable), kept.

    Equal vectors collapse to one with a count. Among pivot_factor * sqrt(n)
    pivots lists hold about 2 sqrt(n) vectors, and the pairs that meet grow as
    n^1.5. (The pivots' matrix takes PIVOT_BYTES at most; where that bounds their
    number, lists grow with n instead.) Pairs must share SHARED of their NEAREST
    pivots. Long lists are cut into blocks and each task meets two blocks; it
    returns link counts and one pointer per vector, never the pairs. In a large
    group of near copies that is quadratic work, as each link is counted, but
    spread over tasks. What is missed is a matter of chance: well under one link
    in a thousand at the default numbers.
    """
    rows = vectors.select(F.col(quoted(id_col)).cast("long").alias("vec_id"), F.col(quoted(vec_col)).alias("v"))
    rows = rows.withColumn("ok", is_usable(F.col("v")) & F.col("vec_id").isNotNull())
    dims = rows.where("ok").groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    dim = int(dims[0]) if dims is not None else -1
    rows = rows.withColumn("ok", F.col("ok") & (F.size("v") == dim))
    own = rows.where("not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    if dims is not None:
        with Scratch(vectors.sparkSession) as scratch:
            hashed = rows.where("ok").select("vec_id", F.xxhash64("v").alias("h"), "v")
            grouped = hashed.groupBy("h", "v").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
            reps = scratch.table(grouped.withColumn("node", F.monotonically_increasing_id()))
            found = _linked(reps, dim, least, pivot_factor, scratch)
            tree = connected_components(found.select(F.col("node").alias("u"), F.col("root").alias("v")), scratch)
            counts = found.groupBy("node").agg(F.sum("links").alias("links"))
            state = reps.select("node", "h", "v", "rep", "copies").join(counts, "node", "left").join(smallest_names(tree, reps), "node", "left")
            state = state.select("h", "v", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("least", "rep").alias("component_id"))
            own = scratch.keep(skew_join(hashed, state, ["h", "v"], "vec_id").select("vec_id", "n_links", "component_id").unionByName(own))
    return own.select(F.col("vec_id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))
