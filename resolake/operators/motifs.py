"""Segments, k-mers, position weight matrices and their enrichment."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import kmers, letters


def segments_around(seqs: DataFrame, letter: str, half: int, shifted: bool = False, name: str = "name", seq: str = "seq") -> DataFrame:
    """(name, segment, left): the window of half letters on either side of each occurrence of a letter in whole sequences.

    Windows are cut off at the ends, or moved to stay inside with `shifted` (the
    whole sequence, where it is shorter). `left` counts the letters before the centre.
    """
    width, n = 2 * half + 1, F.length(seq)
    hits = F.filter(F.transform(letters(F.col(seq)), lambda c, i: F.when(c == letter, i)), lambda i: i.isNotNull())
    # all windows in one pass; a substring by position would walk the text anew for each
    text = F.col(seq) if shifted else F.concat(F.repeat(F.lit(" "), half), seq, F.repeat(F.lit(" "), half))
    t = seqs.where(n > 0).select(name, seq, hits.alias("_hits"), kmers(text, width).alias("_all"))
    if shifted:
        start = lambda i: F.greatest(F.least(i - half, n - width), F.lit(0))
        found = lambda i: F.struct(F.when(n >= width, F.get("_all", start(i))).otherwise(F.col(seq)).alias("segment"), (i - start(i)).alias("left"))
    else:
        found = lambda i: F.struct(F.trim(F.get("_all", i)).alias("segment"), F.least(i, F.lit(half)).alias("left"))
    return t.select(name, F.explode(F.transform("_hits", found)).alias("_w")).select(name, "_w.segment", "_w.left")


def position_weights(segments: DataFrame, half: int, segment: str = "segment", centred: bool = True, offset: str = "left") -> DataFrame:
    """(pos, letter, n, p) over segments. With `centred`, `offset` holds how many letters stand left of the centre;
    otherwise a truncated segment is put at half - length // 2."""
    start = F.lit(half) - F.col(offset) if centred else F.lit(half) - F.floor(F.length(segment) / 2)
    chars = segments.select(start.cast("int").alias("_s"), F.posexplode(letters(F.col(segment))).alias("_k", "letter"))
    n = chars.groupBy((F.col("_s") + F.col("_k")).alias("pos"), "letter").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("p", F.col("n") / F.greatest(F.sum("n").over(Window.partitionBy("pos")), F.lit(1)))


def weighted_profile(centres: DataFrame, residues: DataFrame, half: int, weight: str = "weight", letter: str = "letter") -> DataFrame:
    """(pos, letter, w, p, enrichment) around centres (name, i, weight), against the letters of all positions."""
    near = centres.select("name", F.col(weight).alias("_w"), F.col("i").alias("_c"), F.explode(F.sequence(F.lit(-half), F.lit(half))).alias("pos")).withColumn("i", F.col("_c") + F.col("pos"))
    seen = near.join(residues.select("name", "i", letter), ["name", "i"]).groupBy("pos", letter).agg(F.sum("_w").alias("w"))
    base = residues.groupBy(letter).agg(F.count(F.lit(1)).alias("_n")).withColumn("background", F.col("_n") / F.sum("_n").over(Window.partitionBy())).drop("_n")
    p = seen.withColumn("p", F.try_divide(F.col("w"), F.sum("w").over(Window.partitionBy("pos"))))
    return p.join(F.broadcast(base), letter).withColumn("enrichment", F.try_divide(F.col("p"), F.col("background")))


def heights(profile: DataFrame) -> DataFrame:
    """Enrichment and depletion heights above and below 1."""
    return profile.withColumn("up", F.greatest(F.col("enrichment") - 1, F.lit(0.0))).withColumn("down", F.greatest(1 - F.col("enrichment"), F.lit(0.0)))


def top_letters(profile: DataFrame, n: int = 3, value: str = "p", letter: str = "letter") -> DataFrame:
    w = Window.partitionBy("pos").orderBy(F.desc(value), letter)
    return profile.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def kmer_counts(texts: DataFrame, k: int, text: str = "seq", *keys: str) -> DataFrame:
    return texts.select(*keys, F.explode(kmers(F.col(text), k)).alias("kmer")).groupBy(*keys, "kmer").agg(F.count(F.lit(1)).alias("n"))


def kmer_enrichment(hits: DataFrame, background: DataFrame, brightness: str = "brightness") -> DataFrame:
    """(kmer, hits, fraction, bg_fraction, ratio, brightness sum and mean) of hit k-mers against background counts (kmer, n)."""
    h = hits.groupBy("kmer").agg(F.count(F.lit(1)).alias("hits"), F.sum(brightness).alias("brightness_sum"), F.avg(brightness).alias("brightness_mean"))
    total = lambda df, c: F.broadcast(df.agg(F.sum(c).alias("_all")))  # noqa: E731  (one row)
    h = h.crossJoin(total(h, "hits")).withColumn("fraction", F.col("hits") / F.col("_all")).drop("_all")
    b = background.crossJoin(total(background, "n")).select("kmer", (F.col("n") / F.col("_all")).alias("bg_fraction"))
    return h.join(b, "kmer", "left").withColumn("ratio", F.try_divide(F.col("fraction"), F.col("bg_fraction")))


def residue_list(df: DataFrame, score: str, letter: str, n: int, name: str = "name", i: str = "i") -> DataFrame:
    """By sequence, the n best positions as `letter` + 1-based position, joined by commas."""
    w = Window.partitionBy(name).orderBy(F.desc(score), i)
    top = df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n)
    item = F.struct("_r", F.concat(F.col(letter), (F.col(i) + 1).cast("string")).alias("s"))
    return top.groupBy(name).agg(F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["s"]), ",").alias("residues"))
