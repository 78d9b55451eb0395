"""The corpus pipeline: quality filter, line dedup, near dedup, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before
it kept; all but the last return the columns of documents. Rows with null ids
and rows that repeat an id are documents like others; of rows that are equal in
every column, near dedup keeps one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from resolake.llm.common import Scratch, table, tune_session
from resolake.llm.line_dedup import drop_boilerplate_lines
from resolake.llm.minhash_dedup import near_unique
from resolake.llm.packing import pack_documents
from resolake.llm.quality_nbsvm import held_out, score_quality, train_quality
from resolake.llm.queries import public_tokenizer

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores at 0.3 or more."""
    tune_session(spark)
    model = train_quality(docs, table(spark, sf_dir, "labels"), ~held_out(F.col("doc_id")))
    rest = [c for c in COLUMNS if c != "text"]
    scored = score_quality(docs, model, [*rest, "text"])
    return scored.where("score >= 0.3").select(COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without their source's boilerplate lines; what one page alone holds stays, however few pages a source has."""
    kept = drop_boilerplate_lines(docs.select(COLUMNS), least_pages=2)
    n_chars = F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return kept.withColumn("n_chars", n_chars).select(COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8 or more."""
    tune_session(spark)
    return near_unique(docs.select(COLUMNS))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all remaining documents in sequences of at most 2048 tokens."""
    tune_session(spark)
    return pack_documents(docs, public_tokenizer("word_bpe_49k.json"), end_id=1)


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("packing", packing)]
#: SQL cannot express the classifier, MinHash buckets or packing; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written once and read again by the next."""
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark)
    for _, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
