"""Approximate nearest neighbours by an inverted multi-index.

Vectors are cut into two halves, each quantised by its own centroids; a cell is
a pair of centroids. A query visits cells by the summed distance of its halves
(negative inner product with the centroids) with a heap, until the cells hold a
given share of all vectors, and all vectors in them are ranked again by their
exact inner product.

Contract for odd input
----------------------
Vectors that are null, zero, of another length than most, or hold null or
non-finite components take no part, neither do rows without an id. Rows that
repeat an id count once for each distinct vector: each distinct vector of a query
id has a list of its own, without any row of that id (and shorter by as many of
them as would have stood in it, but one). Equal scores rank by id. With fewer
candidates than asked for, all are returned. Other columns are not read.
An empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, free_name, list_array, skew_join, usable_vectors, vector_matrix

#: Centroids are fitted on at most so many vectors, the first by hash of their id.
MAX_TRAIN_ROWS = 20_000
#: Centroids of each half: six times the fourth root of the number of vectors, within these bounds.
LEAST_CENTROIDS, MOST_CENTROIDS = 64, 256
ENTRY_BLOCK, QUERY_BLOCK = 50_000, 20_000
#: Products of queries and entries that a task holds at a time.
SIM_CELLS = 2_000_000


def _kmeans(x: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    rng = np.random.default_rng(11)
    centers = x[np.sort(rng.choice(len(x), min(k, len(x)), replace=False))].copy()
    for _ in range(rounds):
        near = _nearest(x, centers)
        sums = np.zeros_like(centers)
        np.add.at(sums, near, x)
        counts = np.bincount(near, minlength=len(centers))
        centers[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return centers


def _nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    half = (centers * centers).sum(axis=1) / 2
    return np.concatenate([(x[i : i + 4096] @ centers.T - half).argmax(axis=1) for i in range(0, len(x), 4096)] or [np.empty(0, np.int64)])


def cells_by_distance(d1: np.ndarray, d2: np.ndarray, sizes: np.ndarray, wanted: int) -> list[tuple[int, int]]:
    """Centroid pairs in order of d1[i] + d2[j] until their non-empty cells hold `wanted` entries.

    A pair enters the heap once its neighbours before it in either order have
    left it, so no more pairs are looked at than needed.
    """
    o1, o2 = np.argsort(d1, kind="stable"), np.argsort(d2, kind="stable")
    s1, s2, own = d1[o1].tolist(), d2[o2].tolist(), sizes[np.ix_(o1, o2)].tolist()
    heap, gone, out, have = [(s1[0] + s2[0], 0, 0)], [-1] * len(s1), [], 0  # gone: the last column that left each row
    while heap and have < wanted:
        _, i, j = heapq.heappop(heap)
        gone[i] = j
        if own[i][j]:
            out.append((i, j))
            have += own[i][j]
        if i + 1 < len(s1) and (j == 0 or gone[i + 1] >= j - 1) and gone[i + 1] < j:
            heapq.heappush(heap, (s1[i + 1] + s2[j], i + 1, j))
        if j + 1 < len(s2) and (i == 0 or gone[i - 1] >= j + 1):
            heapq.heappush(heap, (s1[i] + s2[j + 1], i, j + 1))
    return [(int(o1[i]), int(o2[j])) for i, j in out]


def _assign(c1: np.ndarray, c2: np.ndarray, dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = vector_matrix(batch.column(0), dim).astype(np.float64)
            h = len(c1[0])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(_nearest(x[:, :h], c1).astype(np.int32)), pa.array(_nearest(x[:, h:], c2).astype(np.int32))], names=[*batch.schema.names, "c1", "c2"])

    return run


def _probe(c1: np.ndarray, c2: np.ndarray, sizes: np.ndarray, wanted: int, dim: int):
    """(query, v, first centroid, second centroids to visit) for each query and first centroid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, h = vector_matrix(batch.column(1), dim).astype(np.float64), len(c1[0])
            d1, d2 = -(x[:, :h] @ c1.T), -(x[:, h:] @ c2.T)
            at, firsts, seconds = [], [], []
            for i in range(len(x)):
                by_first: dict[int, list[int]] = {}
                for a, b in cells_by_distance(d1[i], d2[i], sizes, wanted):
                    by_first.setdefault(a, []).append(b)
                at += [i] * len(by_first)
                firsts += by_first.keys()
                seconds += by_first.values()
            take = pa.array(at, pa.int64())
            flat = np.array([b for s in seconds for b in s], np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(firsts, pa.int32()), list_array(flat, np.array([len(s) for s in seconds], np.int64))], names=["query", "v", "c1", "c2s"])

    return run


def _first_k(who: np.ndarray, score: np.ndarray, rep: np.ndarray, k: int) -> np.ndarray:
    """Positions of each query's first k by score, the largest first, ties to the smaller rep."""
    order = np.lexsort((rep, -score, who))
    who = who[order]
    if not len(who):
        return order
    starts = np.flatnonzero(np.concatenate([[True], who[1:] != who[:-1]]))
    return order[np.arange(len(who)) - np.repeat(starts, np.diff(np.append(starts, len(who)))) < k]


def _rerank(k: int):
    """The best entries of a block for each query of a block: [(score, id), ...], over the cells that the query visits.

    A matrix product only screens: whatever may reach a query's k-th product but
    for rounding is scored by one exact sum, so that equal vectors tie, and
    ordered by score and id before it is cut.
    """

    def run(key: tuple, queries: pd.DataFrame, entries: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(queries) and len(entries):
            x, q = (np.stack(d["v"].to_list()).astype(np.float64) for d in (entries, queries))
            cell, ids, names = entries["c2"].to_numpy(), entries["ids"].to_numpy(), queries["query"].to_numpy()
            own = np.array([i[0] for i in ids], np.int64)
            slack = 1e-12 * np.sqrt((x * x).sum(axis=1).max() * (q * q).sum(axis=1))
            step = max(16, SIM_CELLS // len(x))
            for at in range(0, len(q), step):
                part = slice(at, min(at + step, len(q)))
                visits = np.zeros((part.stop - at, int(cell.max()) + 1), bool)
                for row, cells in enumerate(queries["c2s"].iloc[part]):
                    visits[row, cells[cells < visits.shape[1]]] = True
                sims = np.where(visits[:, cell], q[part] @ x.T, -np.inf)
                least = np.partition(sims, len(x) - k, axis=1)[:, len(x) - k] - slack[part] if len(x) > k else np.full(len(sims), -np.inf)
                i, j = np.nonzero((sims >= least[:, None]) & (sims > -np.inf))
                found = []
                for cut in np.array_split(np.arange(len(i)), len(i) // 65536 + 1):
                    exact = (q[at + i[cut]] * x[j[cut]]).sum(axis=1)
                    best = _first_k(i[cut], exact, own[j[cut]], k)
                    found.append((i[cut][best], exact[best], j[cut][best]))
                who, exact, where = (np.concatenate(c) for c in zip(*found, strict=True))
                best = _first_k(who, exact, own[where], k)
                by_query: dict[int, list] = {}
                for i, s, p in zip(who[best].tolist(), exact[best].tolist(), where[best].tolist(), strict=True):
                    by_query.setdefault(at + i, []).extend((-s, v) for v in ids[p].tolist())
                for i, pairs in by_query.items():
                    pairs = sorted(pairs)[:k]
                    rows.append((names[i], [-s for s, _ in pairs], [v for _, v in pairs]))
        return pd.DataFrame(rows, columns=["query", "scores", "ids"])

    return run


def nearest_by_inner_product(vectors: DataFrame, is_query: Column, k: int = 20, share: float = 0.5, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k largest inner products among all other rows.

    Equal vectors collapse to one entry with its k + 1 smallest ids, and equal
    queries to one search. Entries are dealt out by their first centroid and
    blocks of it, so that a cell with most of the data is still many tasks;
    queries come to a block once, with the list of its cells to visit.

    share: part of all vectors in the cells that a query visits, k + 1 vectors at
    least, so that small tables are searched whole. Vectors
    without structure need about half for 0.95 of the true neighbours; clustered
    ones far less.
    """
    spark = vectors.sparkSession
    good = usable_vectors(vectors.withColumn(flag := free_name(vectors, "is_query"), F.coalesce(is_query, F.lit(False))), id_col, vec_col, F.col(flag).alias("is_query"))
    none = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dims = good.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if dims is None or dims[0] < 2:
        return none
    dim, kind = int(dims[0]), good.schema["v"].dataType.simpleString()
    with Scratch(spark) as scratch:
        good = scratch.table(good.where(F.size("v") == dim).distinct().withColumn("h", F.xxhash64("v")))
        n = good.count()
        first_ids = good.withColumn("n", F.row_number().over(Window.partitionBy("h", "v").orderBy("vec_id"))).where(F.col("n") <= k + 1)
        entries = first_ids.groupBy("h", "v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
        queries = scratch.table(good.where("is_query").select("h", "v").distinct().withColumn("query", F.monotonically_increasing_id()))
        n_queries = queries.count()
        if not n_queries:
            return none
        sample = good.select("v", "h", "vec_id").orderBy(F.xxhash64("vec_id"), "vec_id", "h").limit(MAX_TRAIN_ROWS).select("v").collect()
        points, half = np.array([r[0] for r in sample], np.float64), dim // 2
        kept = int(min(MOST_CENTROIDS, max(LEAST_CENTROIDS, 6 * n**0.25)))
        c1, c2 = _kmeans(points[:, :half], kept), _kmeans(points[:, half:], kept)
        index = scratch.table(entries.select("v", "ids").mapInArrow(_assign(c1, c2, dim), f"v {kind}, ids array<long>, c1 int, c2 int"))
        sizes = np.zeros((len(c1), len(c2)), np.int64)
        for a, b, size in index.groupBy("c1", "c2").count().collect():  # at most MOST_CENTROIDS squared
            sizes[a, b] = size
        wanted = max(k + 1, int(np.ceil(share * sizes.sum())))
        tasks = max(2 * spark.sparkContext.defaultParallelism, -(-n_queries // 2000))
        probes = queries.select("query", "v").repartition(tasks).mapInArrow(_probe(c1, c2, sizes, wanted, dim), f"query long, v {kind}, c1 int, c2s array<int>")
        q_blocks = -(-n_queries // QUERY_BLOCK)
        e_blocks = F.element_at(F.array(*[F.lit(int(-(-size // ENTRY_BLOCK)) or 1) for size in sizes.sum(axis=1)]), F.col("c1") + 1)
        probes = probes.withColumn("qb", F.pmod(F.xxhash64("query"), F.lit(q_blocks)).cast("int")).withColumn("eb", F.explode(F.sequence(F.lit(0), e_blocks - 1)))
        dealt = index.withColumn("eb", F.pmod(F.xxhash64("v"), e_blocks).cast("int")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))))
        by = ["c1", "eb", "qb"]
        found = probes.groupBy(by).cogroup(dealt.select(*by, "c2", "v", "ids").groupBy(by)).applyInPandas(_rerank(k + 1), "query long, scores array<double>, ids array<long>")
        near = found.select("query", F.arrays_zip(F.transform("scores", lambda s: -s).alias("s"), F.col("ids").alias("i")).alias("found")).groupBy("query").agg(F.flatten(F.collect_list("found")).alias("found"))
        answers = queries.join(near.select("query", F.slice(F.array_sort("found"), 1, k + 1).alias("found")), "query").select("h", "v", "found")
        asked = good.where("is_query").select("h", "v", F.col("vec_id").alias("query_id"))
        others = F.slice(F.filter("found", lambda x: x["i"] != F.col("query_id")), 1, k)
        rows = skew_join(asked, answers, ["h", "v"], "query_id").select("query_id", F.posexplode(others).alias("at", "x"))
        return scratch.keep(rows.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.i").alias("vec_id"), (-F.col("x.s")).alias("score")))
