"""MinHash near-duplicate detection: one-permutation hashing, optimal densification, banded buckets, star edges.

Contract for odd input
----------------------
Null text counts as empty. An empty document has no shingles, links with
nothing and is its own component. Each row gets a result row, and is a document
of its own where ids repeat: two texts under one id link only through what they
hold, and a component's id is the smallest of its rows' ids. In
minhash_components a row with a null id takes no part: its count and component
are null and it is kept. near_unique treats rows with null ids like others, but
keeps them last. Columns other than id, text and those asked for are never read.
An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, free_name, list_array, mix64, quoted, skew_join
from .components import connected_components, smallest_names
from .pretoken import texts_of

BINS = 128
BANDS, BAND_ROWS = 21, 6
BLOCK, BLOCK_SHINGLES = 2048, 1_000_000
_BIN_SHIFT = np.uint64(64 - 7)
#: Words that a worker keeps the hashes of, each of at most so many bytes.
_CACHE_WORDS, _CACHE_BYTES = 100_000, 48


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < _CACHE_WORDS and len(word) <= _CACHE_BYTES:  # what comes first is commonest
            self[word] = value
        return value


_words = _WordHashes()
#: For an empty bin i, the bins to borrow from in order: the same for every document.
_BORROW = (mix64(np.arange(4096 * BINS, dtype=np.uint64) + np.uint64(0x9E3779B97F4A7C15)) % np.uint64(BINS)).astype(np.int16).reshape(4096, BINS)
_BAND_MULT = mix64(np.arange(1, BAND_ROWS + 1, dtype=np.uint64)) | np.uint64(1)
_BAND_SALT = mix64(np.arange(101, 101 + BANDS, dtype=np.uint64))


def shingle_set(text: str | None, words_each: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text.

    A-Z are lower-cased and words are the runs between ASCII white space. A text
    of fewer words than a shingle has one shingle, its whole word sequence.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    k = min(words_each, len(w))
    with np.errstate(over="ignore"):
        h = np.full(len(w) - k + 1, 7 * k, np.uint64)
        for i in range(k):
            h = mix64(h + w[i : len(w) - k + 1 + i]) + np.uint64(i)
    return np.unique(mix64(h))


def sketch(shingles: np.ndarray) -> np.ndarray:
    """One-permutation sketch: the smallest hash of each bin; empty bins borrow from bins chosen by a shared hash."""
    bins = (shingles >> _BIN_SHIFT).astype(np.intp)
    at, first = np.unique(bins, return_index=True)
    out = np.zeros(BINS, np.uint64)
    out[at] = shingles[first]
    if len(at) < BINS:
        full = np.zeros(BINS, bool)
        full[at] = True
        todo = np.flatnonzero(~full)
        step, seen = 8, 0
        while len(todo) and seen < len(_BORROW):
            picks = _BORROW[seen : seen + step][:, todo]
            ok = full[picks]
            hit = ok.any(axis=0)
            out[todo[hit]] = out[picks[ok.argmax(axis=0)[hit], np.flatnonzero(hit)]]
            todo = todo[~hit]
            seen, step = seen + step, min(4 * step, 1024)
        out[todo] = shingles[0]
    return out


def band_keys(sketches: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        rows = sketches[:, : BANDS * BAND_ROWS].reshape(len(sketches), BANDS, BAND_ROWS)
        return mix64((mix64(rows) * _BAND_MULT).sum(axis=2, dtype=np.uint64) + _BAND_SALT).view(np.int64)


def _sketch_batches(words_each: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, keys, sketches, sizes = batch.num_rows, [], [], []
            for text in texts_of(batch.column(0)):
                s = shingle_set(text, words_each)
                n_s = len(s)
                sizes.append(n_s)
                keys.append(hashlib.md5(s.tobytes()).digest() if n_s else None)
                if n_s:
                    sketches.append(sketch(s))
            full = np.array(sizes, np.int64) > 0
            sk = np.array(sketches, np.uint64).reshape(-1, BINS)
            bands = list_array(band_keys(sk).ravel(), np.where(full, BANDS, 0))
            low = iter(sk.astype(np.uint16))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), bands, pa.array([next(low).tobytes() if f else None for f in full], pa.binary())],
                names=[*batch.schema.names[1:], "n_shingles", "set_key", "bands", "sig"],
            )

    return run


def _set_batches(words_each: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t, words_each) for t in texts_of(batch.column(0))]
            sizes = np.array([len(s) for s in sets], np.int64)
            flat = np.concatenate(sets).view(np.int64) if sets else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(1), list_array(flat, sizes)], names=["node", "shingles"])

    return run


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the distinct pairs (a, b) whose full shingle sets reach the similarity; an a has few pairs, a b may have many."""
    sa, sb = (sets.select(F.col("node").alias(c), F.col("shingles").alias(f"s{c}")) for c in "ab")
    both = skew_join(pairs, sb, ["b"], "a").join(sa, "a")
    both = both.withColumn("na", F.size("sa")).withColumn("nb", F.size("sb")).where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    inter = F.size(F.array_intersect("sa", "sb"))
    return both.where(100 * inter >= percent * (F.col("na") + F.col("nb") - inter)).select(F.col("a").alias("u"), F.col("b").alias("v")).distinct()


def _rest_links(percent: int):
    """Links that stars left open: each minor member against the block's members of other labels, on full sets.

    Sketches only screen pairs whose estimate is below the threshold by five
    deviations or more; sets with fewer shingles than bins, whose sketches
    repeat much, are screened by size alone. A minor's first
    link to each label is enough.
    """
    floor = max(0.0, percent / 100 - 0.25)

    def run(key: tuple, minor: pd.DataFrame, rest: pd.DataFrame) -> pd.DataFrame:
        u, v = [], []
        if len(minor) and len(rest):
            a, b = (np.frombuffer(b"".join(x["sig"]), np.uint16).reshape(-1, BINS) for x in (minor, rest))
            sa, sb = ([np.asarray(s).view(np.uint64) for s in x["shingles"]] for x in (minor, rest))
            na, nb = (np.array([len(s) for s in x]) for x in (sa, sb))
            la, lb, ids = minor["label"].to_numpy(), rest["label"].to_numpy(), rest["node"].to_numpy()
            for i, own in enumerate(sa):
                at = np.flatnonzero((lb != la[i]) & (100 * np.minimum(nb, na[i]) >= percent * np.maximum(nb, na[i])))
                at = at[((b[at] == a[i]).mean(axis=1) >= floor) | (np.minimum(nb[at], na[i]) < BINS)]
                for part in np.split(at, range(256, len(at), 256)):
                    if len(part):
                        flat = np.concatenate([sb[j] for j in part])
                        hit = own[np.minimum(np.searchsorted(own, flat), len(own) - 1)] == flat
                        inter = np.add.reduceat(hit, np.concatenate([[0], np.cumsum(nb[part])[:-1]]), dtype=np.int64)
                        linked = part[100 * inter >= percent * (na[i] + nb[part] - inter)]
                        linked = linked[np.unique(lb[linked], return_index=True)[1]]
                        u += [minor["node"].iat[i]] * len(linked)
                        v += ids[linked].tolist()
        return pd.DataFrame({"u": np.array(u, np.int64), "v": np.array(v, np.int64)})

    return run


def _links(reps: DataFrame, texts: DataFrame, words_each: int, percent: int, scratch: Scratch) -> DataFrame:
    """The tree of components over the distinct sets in reps (node, set_key, n, bands, sig)."""
    members = reps.select("node", F.explode("bands").alias("bucket"))
    buckets = scratch.table(members.groupBy("bucket").agg(F.min("node").alias("center"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    shared = scratch.table(skew_join(members, buckets.select("bucket", "center"), ["bucket"], "node", buckets.select("bucket", "n")))
    stars = scratch.table(shared.where("node <> center").select(F.col("node").alias("a"), F.col("center").alias("b")).distinct())
    wanted = reps.join(stars.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "node").select("node", "row")
    sets = scratch.table(texts.join(wanted, "row").dropDuplicates(["row"]).select("text", "node").mapInArrow(_set_batches(words_each), "node long, shingles array<long>"))
    links = scratch.table(_confirm(stars, sets, percent))
    labels = connected_components(links, scratch)

    named = shared.select("node", "bucket").join(labels.withColumnRenamed("id", "node"), "node", "left")
    labelled = scratch.table(named.select("node", "bucket", F.coalesce("component", "node").alias("label")))
    per = labelled.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("c"))
    tops = per.groupBy("bucket").agg(F.max(F.struct("c", "label")).alias("most"), F.count(F.lit(1)).alias("labels"), F.sum("c").alias("n")).where("labels > 1")
    tops = scratch.table(tops.select("bucket", F.col("most.label").alias("top"), "n"))
    rest = skew_join(labelled, tops.select("bucket", "top"), ["bucket"], "node", tops.select("bucket", "n")).select("top", "node", "label").distinct()
    rest = scratch.table(rest.join(reps.select("node", "n", "sig"), "node"))
    blocks = lambda c, n: F.ceil(F.greatest(c / F.lit(BLOCK), n / F.lit(BLOCK_SHINGLES))).cast("int")
    is_minor = F.col("label") != F.col("top")
    sizes = rest.groupBy("top").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("n"), F.count_if(is_minor).alias("mc"), F.sum(F.when(is_minor, F.col("n"))).alias("mn"))
    cut = skew_join(rest, sizes.select("top", blocks(F.col("c"), F.col("n")).alias("abs"), blocks(F.col("mc"), F.col("mn")).alias("mbs")), ["top"], "node").join(sets, "node")
    spread = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    minor = cut.where(is_minor).withColumn("mb", spread(F.col("mbs"))).withColumn("ab", F.explode(F.sequence(F.lit(0), F.col("abs") - 1)))
    every = cut.withColumn("ab", spread(F.col("abs"))).withColumn("mb", F.explode(F.sequence(F.lit(0), F.col("mbs") - 1)))
    cols, by = ["top", "mb", "ab", "node", "label", "sig", "shingles"], ["top", "mb", "ab"]
    more = minor.select(cols).groupBy(by).cogroup(every.select(cols).toDF(*cols).groupBy(by)).applyInPandas(_rest_links(percent), "u long, v long")
    return connected_components(labels.select(F.col("id").alias("u"), F.col("component").alias("v")).unionByName(more), scratch)


def _groups(texts: DataFrame, words_each: int, percent: int, scratch: Scratch) -> DataFrame:
    """(id, row, n_shingles, component_id, node) for texts (id, row, text); node is one of the group's, null without words.

    `row` tells rows with different ids or texts apart.
    """
    row_type = texts.schema["row"].dataType.simpleString()
    rows = scratch.table(texts.select("text", "id", "row").mapInArrow(_sketch_batches(words_each), f"id long, row {row_type}, n_shingles long, set_key binary, bands array<long>, sig binary"))
    alike = [F.first(c).alias(a) for c, a in (("row", "row"), ("n_shingles", "n"), ("bands", "bands"), ("sig", "sig"))]  # any of the equal sets
    grouped = rows.where("set_key is not null").groupBy("set_key").agg(F.min("id").alias("rep"), *alike)
    reps = scratch.table(grouped.withColumn("node", F.monotonically_increasing_id()))
    tree = _links(reps, texts.select("row", "text"), words_each, percent, scratch)
    by_set = reps.select("set_key", "rep", "node").join(smallest_names(tree, reps), "node", "left")
    by_set = by_set.select("set_key", F.coalesce("least", "rep").alias("component_id"), F.coalesce("component", "node").alias("node"))
    slim = rows.select("id", "row", "n_shingles", "set_key")
    found = skew_join(slim.where("set_key is not null"), by_set, ["set_key"], "row").select("id", "row", "n_shingles", "component_id", "node")
    return found.unionByName(slim.where("set_key is null").select("id", "row", "n_shingles", F.col("id").alias("component_id"), F.lit(None).cast("long").alias("node")))


def minhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_each: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: id, n_shingles, component_id (smallest id reachable), kept (id = component_id).

    Documents link when 100 * |A and B| >= percent * |A or B| over their whole
    sets of word shingles. Equal sets collapse to one first, which is a node.
    In every band bucket the nodes are compared with the bucket's smallest node
    only (a star), so candidate pairs grow with the members, not their square.
    Where buckets then still hold several components, the members outside their
    largest one are compared with all members of the buckets of that largest
    component, in blocks inside tasks, so that no bucket is capped or dropped
    and no pairs are written out. Texts of candidates are read and cut to
    shingles a second time, as sets of all documents would be larger than they.
    """
    texts = docs.select(F.col(quoted(id_col)).cast("long").alias("id"), F.col(quoted(text_col)).alias("text"))
    known = texts.where("id is not null").withColumn("row", F.xxhash64("id", "text"))
    with Scratch(docs.sparkSession) as scratch:
        own = scratch.keep(_groups(known, words_each, percent, scratch).select("id", "n_shingles", "component_id"))
    lost = texts.where("id is null").select("id", F.lit(None).cast("long").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"))
    return own.unionByName(lost).select(F.col("id").alias(id_col), "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def near_unique(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_each: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs without near copies: of each group the row with the smallest id stays, whole.

    Null ids come after all others, and among rows of one id the smallest hash of
    all columns decides. Documents without words all stay. Of rows that are equal
    in every column one stays.
    """
    key = free_name(docs, "row_key")
    columns = [F.col(quoted(c)) for c in docs.columns]
    whole = F.xxhash64(*[c.isNull() for c in columns], *columns)
    keyed = docs.withColumn(key, F.struct(whole.alias("a"), F.xxhash64(whole, F.lit(1), *reversed(columns)).alias("b")))
    texts = keyed.select(F.col(quoted(id_col)).cast("long").alias("id"), F.col(quoted(text_col)).alias("text"), F.col(key).alias("row"))
    with Scratch(docs.sparkSession) as scratch:
        groups = scratch.table(_groups(texts, words_each, percent, scratch).select("id", "row", "node"))
        first = groups.where("node is not null").groupBy("node").agg(F.min(F.struct(F.col("id").isNull().alias("n"), "id", "row")).alias("x"))
        rows = first.select(F.col("x.row").alias(key)).unionByName(groups.where("node is null").select(F.col("row").alias(key)).distinct())
        rows = scratch.keep(rows)
    return keyed.join(rows, key).dropDuplicates([key]).select(docs.columns)
