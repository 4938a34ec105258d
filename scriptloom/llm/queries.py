"""The registered queries of the operators: each over the whole `documents` table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptloom.llm.best_fit import best_fit_packing
from scriptloom.llm.bond_search import hard_negatives
from scriptloom.llm.collocations import collocations
from scriptloom.llm.common import documents
from scriptloom.llm.exact_dedup import exact_dedup, sha256
from scriptloom.llm.fair_mix import fair_mix, word_count
from scriptloom.llm.host_rules import judge_hosts
from scriptloom.llm.kneser_ney import lm_scores
from scriptloom.llm.prefix_counts import count_tokens
from scriptloom.llm.rank_order import identify_language
from scriptloom.llm.secret_scan import digest, scan_secrets
from scriptloom.llm.simhash import near_duplicates
from scriptloom.llm.suffix_index import remove_repeats
from scriptloom.llm.token_codes import token_codes


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir)).drop("_file", "_row")


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(documents(spark, sf_dir))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(scan_secrets(documents(spark, sf_dir)))


def op4_token_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_codes(documents(spark, sf_dir))


def op5_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_hosts(documents(spark, sf_dir)).drop("host_rate")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by words into bins of 2048; equal texts are one cluster."""
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = documents(spark, sf_dir).select(
        "doc_id", "source", (word_count(text) + 1).alias("length"), sha256(text).alias("cluster")
    )
    return best_fit_packing(docs)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_language(documents(spark, sf_dir))


def op10_fair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fair_mix(documents(spark, sf_dir)).drop("source")


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(documents(spark, sf_dir))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(documents(spark, sf_dir))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some labels moved on; every hundredth vector is an anchor."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(
        F.col("vec_id").alias("id"),
        F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"),
        F.col("embedding").alias("vector"),
    )
    return hard_negatives(vectors, F.col("id") % 100 == 0, scale=256)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_lm_score": op2_lm_score,
    "op3_secret_scan": op3_secret_scan,
    "op4_token_codes": op4_token_codes,
    "op5_host_rules": op5_host_rules,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_simhash": op8_simhash,
    "op9_language_id": op9_language_id,
    "op10_fair_mix": op10_fair_mix,
    "op11_token_counts": op11_token_counts,
    "op12_collocations": op12_collocations,
    "op13_hard_negatives": op13_hard_negatives,
}
