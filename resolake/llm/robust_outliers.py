"""Quality rules: fixed limits, and multivariate outliers of a document's statistics within its language and source.

Whole texts give counts; transformed counts give a vector of five numbers. Each
group (a language and a source) has a minimum-covariance-determinant estimate of
centre and scatter, and a document is rejected when its squared Mahalanobis
distance exceeds a chi-square quantile.

The estimate is found by concentration steps over all rows, as aggregations:
distances are counted in bins with the bins' sums of products, the bins that hold
the nearest `share` of a group give the next centre and scatter, and of two
starts the one that ends with the smaller determinant stays. Vectors are whole
numbers (1/UNITS), so that sums are exact and no result depends on how rows are
dealt out. A scatter has `least_scale` added to each spread, so that statistics
which most documents share exactly (no symbols at all) don't make every other
document an outlier.

Groups of fewer than `least_rows` documents are estimated together by language,
what is still fewer over all languages; a rest that is fewer yet is not judged
by distance.

Contract for odd input
----------------------
Null text has no words and fails the fixed limits, like an empty one. Null
language and source count as ''. Rows with null or repeated ids are documents
each. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, quoted, skew_join
from .pretoken import texts_of

SYMBOLS = b"#*$%&|<>"
WINDOW = 5
#: Vectors are counted in such parts of one.
UNITS = 1024
#: Least spread of each number of the vector: log words, log letters a word, roots of the shares of symbols, repeated lines and repeated words.
LEAST_SCALE = (1.0, 0.15, 0.05, 0.2, 0.2)
DIMS = len(LEAST_SCALE)
_PAIRS = [(i, j) for i in range(DIMS) for j in range(i, DIMS)]
#: Groups up to this many go to every executor with two starts each, at some 200 bytes a start; more are joined by shuffle.
BROADCAST_GROUPS = 10_000
#: Bins of distances: so many a doubling, between these powers of two.
BINS, LOW, HIGH = 16, -10, 60
#: Concentration steps end when no determinant's logarithm moves by more, and after so many at most.
TOLERANCE, STEPS = 1e-3, 12


def repeated_words(words: list[bytes], size: int = WINDOW) -> int:
    """Words that lie in a window of `size` words found twice or more in the text."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    index: dict[bytes, int] = {}
    ids = np.fromiter((index.setdefault(w, len(index)) for w in words), np.int64, len(words))
    if len(index) == len(words):
        return 0
    own = ids
    for k in range(1, size):  # number the distinct runs of k + 1 words
        _, own = np.unique(own[:-1] * np.int64(len(words)) + ids[k:], return_inverse=True)
    often = np.bincount(own)[own] > 1
    steps = np.zeros(len(words) + 1, np.int64)
    steps[:n] += often
    steps[size : size + n] -= often
    return int(np.count_nonzero(np.cumsum(steps[:-1])))


def text_statistics(text: str | None) -> tuple[int, int, int, int, int, int]:
    """(words, code points in words, symbols, repeated lines, repeated words, lines with a word) of a whole text."""
    raw = (text or "").encode()
    words = raw.split()
    seen = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    inner = len(raw) - int(seen[0x80:0xC0].sum())  # bytes that begin a code point
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    return len(words), inner - int(seen[9:14].sum()) - int(seen[32]), int(seen[list(SYMBOLS)].sum()), len(lines) - len(set(lines)), repeated_words(words), len(lines)


_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.array([text_statistics(t) for t in texts_of(batch.column(3))], np.int64).reshape(-1, len(_COUNTS))
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), *(pa.array(c) for c in found.T.copy())], names=["doc_id", "lang", "source", *_COUNTS])


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """doc_id, lang, source and the counts of every document."""
    label = lambda c: F.coalesce(F.col(quoted(c)).cast("string"), F.lit(""))
    rows = docs.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), label(lang_col).alias("lang"), label(source_col).alias("source"), F.col(quoted(text_col)).cast("string").alias("text"))
    return rows.mapInArrow(_statistics, "doc_id long, lang string, source string, " + ", ".join(f"{c} long" for c in _COUNTS))


def statistic_vector() -> list[Column]:
    """The transformed statistics; shares of short texts are drawn towards the usual."""
    n, chars = F.col("n_words").cast("double"), F.col("word_chars").cast("double")
    x = [F.log1p(n), F.log((chars + 25) / (n + 5)), F.sqrt(F.col("n_symbols") / (chars + 50)), F.sqrt(F.col("n_dup_lines") / (F.col("n_lines") + 10.0)), F.sqrt(F.col("n_repeat_words") / (n + 20))]
    return [F.round(UNITS * c).cast("long").alias(f"x{i}") for i, c in enumerate(x)]


def _attach(rows: DataFrame, lookup: DataFrame, on: list[str], n_lookup: int) -> DataFrame:
    """Join with a table that holds each key once (or once a start): sent to all tasks where it is small, else by shuffle with hot keys split."""
    return rows.join(F.broadcast(lookup), on) if n_lookup <= BROADCAST_GROUPS else skew_join(rows, lookup, on, "spread")


def assign_groups(stats: DataFrame, least_rows: int) -> DataFrame:
    """(lang, source, g): the group that each language and source is estimated in; null where nothing is left to pool."""
    own = stats.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))
    few = F.when(F.col("n") < least_rows, F.col("n"))
    by_lang = own.groupBy("lang").agg(F.sum(few).alias("pooled"))
    rest = by_lang.agg(F.sum(F.when(F.col("pooled") < least_rows, F.col("pooled"))).alias("rest"))  # one row
    level = F.when(F.col("n") >= least_rows, 0).when(F.col("pooled") >= least_rows, 1).when(F.col("rest") >= least_rows, 2)
    joined = own.join(by_lang, "lang").crossJoin(F.broadcast(rest)).withColumn("level", level)
    lang, source = F.when(F.col("level") < 2, F.col("lang")).otherwise(""), F.when(F.col("level") < 1, F.col("source")).otherwise("")
    g = F.concat(F.col("level").cast("string"), F.lit(" "), F.length(lang).cast("string"), F.lit(" "), lang, source)  # no two groups have one name
    return joined.select("lang", "source", F.when(F.col("level").isNotNull(), g).alias("g"))


def _lower_medians(counts: DataFrame, value: str) -> DataFrame:
    """(g, i, median) of the values in (g, i, value, n); a group and coordinate has a few thousand distinct values at most."""
    w = Window.partitionBy("g", "i")
    placed = counts.withColumn("upto", F.sum("n").over(w.orderBy(value))).withColumn("all", F.sum("n").over(w))
    return placed.where(F.col("upto") * 2 >= F.col("all")).groupBy("g", "i").agg(F.min(value).alias("median"))


def _starting_points(vectors: DataFrame, scratch: Scratch) -> DataFrame:
    """(g, m0.., d0..): medians and the median distances from them, in vector units of 16 parts."""
    values = vectors.select("g", F.posexplode(F.array(*[F.floor(F.col(f"x{i}") / 16) for i in range(DIMS)])).alias("i", "v"))
    counts = scratch.table(values.groupBy("g", "i", "v").agg(F.count(F.lit(1)).alias("n")))
    medians = scratch.table(_lower_medians(counts, "v"))
    off = counts.join(medians, ["g", "i"]).groupBy("g", "i", F.abs(F.col("v") - F.col("median")).alias("d")).agg(F.sum("n").alias("n"))
    both = medians.join(_lower_medians(off, "d").withColumnRenamed("median", "mad"), ["g", "i"])
    at = [F.max(F.when(F.col("i") == i, F.col(c))) for c in ("median", "mad") for i in range(DIMS)]
    return both.groupBy("g").agg(*[c.alias(f"{'md'[k // DIMS]}{k % DIMS}") for k, c in enumerate(at)])


def _first_distances() -> Column:
    """By start: the sum and the greatest of the squared distances from the medians, each in its median distances."""
    z = [(F.col(f"x{i}") / 16.0 - F.col(f"m{i}")) / F.greatest(F.col(f"d{i}") * 1.4826, F.lit(LEAST_SCALE[i] * UNITS / 16)) for i in range(DIMS)]
    squares = [c * c for c in z]
    return F.array(sum(squares[1:], squares[0]), F.greatest(*squares) * DIMS)


def squared_distance() -> Column:
    """Of x0.. from the centre m0.. under the inverse scatter p00.."""
    d = [F.col(f"x{i}") - F.col(f"m{i}") for i in range(DIMS)]
    terms = [d[i] * d[j] * F.col(f"p{i}{j}") * (1 if i == j else 2) for i, j in _PAIRS]
    return sum(terms[1:], terms[0])


def _bin(d2: Column) -> Column:
    return F.floor(BINS * F.log2(F.greatest(F.least(d2, F.lit(2.0**HIGH)), F.lit(2.0**LOW)))).cast("int")


def _sums() -> list[Column]:
    return [F.count(F.lit(1)).alias("n"), *[F.sum(f"x{i}").alias(f"s{i}") for i in range(DIMS)], *[F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"c{i}{j}") for i, j in _PAIRS]]


_SUM_NAMES = ["n", *[f"s{i}" for i in range(DIMS)], *[f"c{i}{j}" for i, j in _PAIRS]]


def _nearest(binned: DataFrame, share: float) -> DataFrame:
    """(g, starts): for each start the sums over the bins, from the nearest, that hold `share` of the group, the middle row's bin, and the last determinant.

    A group has at most 2 BINS (HIGH - LOW) bins; one shuffle brings them together.
    """
    w = Window.partitionBy("g", "start")
    placed = binned.repartition("g").withColumn("upto", F.sum("n").over(w.orderBy("bin"))).withColumn("all", F.sum("n").over(w))
    near = F.col("upto") - F.col("n") < F.ceil(F.col("all") * share)
    middle = F.min(F.when(F.col("upto") * 2 >= F.col("all"), F.col("bin"))).alias("middle")
    summed = placed.groupBy("g", "start").agg(*[F.sum(F.when(near, F.col(c))).alias(c) for c in _SUM_NAMES], middle, F.max("was").alias("was"))
    return summed.groupBy("g").agg(F.sort_array(F.collect_list(F.struct("start", *_SUM_NAMES, "middle", "was"))).alias("starts"))


_FITTED = ["start", *[f"m{i}" for i in range(DIMS)], *[f"p{i}{j}" for i, j in _PAIRS], "logdet", "was", "middle"]
_PARAMS = "g string, starts array<struct<" + ", ".join(f"{c}: {'int' if c in ('start', 'middle') else 'double'}" for c in _FITTED) + ">>"


def _scatter(share: float):
    """Centre, inverse scatter and its determinant from sums; consistency for normal data by the usual factor."""
    cut = chi2_quantile(share, DIMS)
    factor = share / (1 - chi2_tail(cut, DIMS + 2))
    least = np.diag([(s * UNITS) ** 2 for s in LEAST_SCALE])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            flat = lists.flatten()
            get = lambda c: np.asarray(flat.field(c)).astype(float)  # noqa: B023, E731
            n = get("n")
            mean = np.stack([get(f"s{i}") / n for i in range(DIMS)], 1)
            cov = np.empty((len(n), DIMS, DIMS))
            for i, j in _PAIRS:
                cov[:, i, j] = cov[:, j, i] = get(f"c{i}{j}") / n - mean[:, i] * mean[:, j]
            cov = factor * cov + least
            inverse = np.linalg.inv(cov)
            columns = [*mean.T.copy(), *[inverse[:, i, j] for i, j in _PAIRS], np.linalg.slogdet(cov)[1]]
            fitted = pa.StructArray.from_arrays([flat.field("start"), *map(pa.array, columns), flat.field("was"), flat.field("middle")], names=_FITTED)
            offsets = pa.array(np.concatenate([[0], np.cumsum(np.asarray(lists.value_lengths()))]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, fitted)], names=["g", "starts"])

    return run


def chi2_tail(x: float, df: int) -> float:
    """Probability above x, by the finite sums for whole degrees of freedom."""
    if df % 2:
        first, term, total = math.erfc(math.sqrt(x / 2)), math.sqrt(2 * x / math.pi) * math.exp(-x / 2), 0.0
        for k in range(1, df // 2 + 1):
            total, term = total + term, term * x / (2 * k + 1)
        return first + total
    return math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(df // 2))


def chi2_quantile(p: float, df: int) -> float:
    """By bisection of the tail."""
    low, high = 0.0, 1000.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_tail(mid, df) > 1 - p else (low, mid)
    return (low + high) / 2


def robust_scatter(vectors: DataFrame, scratch: Scratch, share: float = 0.75) -> DataFrame:
    """(g, m0.., p00.., scale) of each group in vectors (g, x0.., spread): minimum-covariance-determinant estimates.

    scale: how far the median distance is above that of normal data; 1 at least.
    """
    first = scratch.table(_starting_points(vectors, scratch))
    n_groups = first.count()
    x = [f"x{i}" for i in range(DIMS)]
    near = _attach(vectors, first, ["g"], n_groups).select("g", *x, F.lit(None).cast("double").alias("was"), F.posexplode(_first_distances()).alias("start", "d2"))
    last = None
    for step in range(STEPS + 1):
        part = 0.5 if step == 0 else share
        binned = near.groupBy("g", "start", _bin(F.col("d2")).alias("bin")).agg(*_sums(), F.max("was").alias("was"))
        params = scratch.table(_nearest(binned, part).mapInArrow(_scatter(part), _PARAMS))
        if last is not None:
            scratch.drop(last)
        moved = params.agg(F.max(F.array_max(F.transform("starts", lambda s: F.abs(s["logdet"] - s["was"]))))).first()[0]
        if step > 0 and (moved is None or step > 1 and moved <= TOLERANCE):  # none moved: there is no group
            break
        last = params
        each = _attach(vectors, params, ["g"], n_groups).select("g", *x, F.explode("starts").alias("s"))
        near = each.select("g", *x, "s.*").select("g", "start", *x, F.col("logdet").alias("was"), squared_distance().alias("d2"))
    best = params.select("g", F.array_min(F.transform("starts", lambda s: F.struct(s["logdet"].alias("logdet"), s["start"].alias("start"), *[s[c].alias(c) for c in _FITTED if c[0] in "mp"]))).alias("s"))
    median = F.pow(F.lit(2.0), (F.col("s.middle") + 0.5) / BINS)
    return best.select("g", *[F.col(f"s.{c}").alias(c) for c in _FITTED if c[0] in "mp" and c != "middle"], F.greatest(F.lit(1.0), median / chi2_quantile(0.5, DIMS)).alias("scale"))


def quality_rules(docs: DataFrame, least_words: int = 10, repeat_percent: int = 20, share: float = 0.75, quantile: float = 0.9999, least_rows: int = 100, **columns: str) -> DataFrame:
    """Per document: doc_id, the counts, base_failed, kept, and the squared distance by which it was judged (null where none was)."""
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))
    with Scratch(docs.sparkSession) as scratch:
        stats = scratch.table(document_statistics(docs, **columns).select("*", *statistic_vector(), F.monotonically_increasing_id().alias("spread")))
        groups = scratch.table(assign_groups(stats, least_rows))
        grouped = scratch.table(_attach(stats, groups, ["lang", "source"], groups.count()))
        params = scratch.table(robust_scatter(grouped.where(F.col("g").isNotNull()), scratch, share))
        n_groups = params.count()
        none = grouped.where(F.col("g").isNull()).withColumn("distance", F.lit(None).cast("double"))
        measured = _attach(grouped.where(F.col("g").isNotNull()), params, ["g"], n_groups).withColumn("distance", squared_distance() / F.col("scale"))
        found = scratch.keep(measured.select(*none.columns).unionByName(none).select("doc_id", *_COUNTS[:-1], failed.alias("base_failed"), "distance"))
    limit = chi2_quantile(quantile, DIMS)
    return found.select("doc_id", *_COUNTS[:-1], "base_failed", (~F.col("base_failed") & F.coalesce(F.col("distance") <= limit, F.lit(True))).alias("kept"), "distance")
