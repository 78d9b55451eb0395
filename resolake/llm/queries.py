"""The registered queries of the training-data operators, with their production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import divergence_audit, importance_resampling, line_dedup, multi_index, packing, quality_nbsvm, robust_outliers, sentencepiece_codec, shard_table, token_counts, token_files
from .common import table, tune_session
from .minhash_dedup import minhash_components
from .pivot_dedup import pivot_components

SHARDS = [f"shard-{i:02d}" for i in range(32)]


def public_tokenizer(name: str) -> str:
    """A file of the public tokenizers that are installed beside Spark; operators take any path."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_inverted_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.nearest_by_inner_product(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup_report(table(spark, sf_dir, "documents"))


def op3_shard_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_table.assign_shards(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", SHARDS)


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_file_digest(table(spark, sf_dir, "documents"), public_tokenizer("byte_bpe_50k.json"), end_id=2)


def op5_quality_nbsvm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_nbsvm.quality_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_components(table(spark, sf_dir, "documents"), words_each=3, percent=85)


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivot_components(table(spark, sf_dir, "embeddings"), least=0.95)


def op8_sentencepiece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.pieces_digest(table(spark, sf_dir, "documents"), public_tokenizer("piece_bpe_32k.model"))


def op9_sequence_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizer("word_bpe_49k.json"), end_id=1, with_ids=False)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizer("piece_bpe_32k.model"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return robust_outliers.quality_rules(table(spark, sf_dir, "documents"))


def op13_divergence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence_audit.divergence_audit(table(spark, sf_dir, "documents"))


def _tuned(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """A registered query is an application: it sets up its session, which the operators do not touch."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        tune_session(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict:
    found = [op1_inverted_multi_index, op2_line_dedup, op3_shard_lookup, op4_token_files, op5_quality_nbsvm, op6_minhash_near_dedup, op7_embedding_near_dedup, op8_sentencepiece_codec, op9_sequence_packing, op10_token_counts, op11_importance_resampling, op12_robust_outliers, op13_divergence_audit]
    return {f.__name__: _tuned(f) for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op2_line_dedup": line_dedup.line_dedup_sql(), "op3_shard_lookup": shard_table.shard_sql(SHARDS), "op11_importance_resampling": importance_resampling.resample_sql(), "op13_divergence_audit": divergence_audit.divergence_sql()}
