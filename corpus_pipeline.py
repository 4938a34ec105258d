"""The document pipeline: stages in order, each written and read back before the next.

Every stage keeps the columns of `documents`, whatever their names, but for the last, which
returns the packed pieces. Stage results go to the shared folder.

Defined results: text that is null, empty or without a letter goes in the first stage. A table
without any label loses nothing else there. Of equal texts the row with the largest doc_id
stays, of near copies the row with the smallest; a null doc_id is smaller than all in the
first case and greater than all in the second, and ties go by place in the table. Null sources
are one source to the mix, and conflict with nothing in a bin. An empty table gives an empty
result. Texts are read whole, however long.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptloom.llm.best_fit import best_fit_packing
from scriptloom.llm.common import durable, new_folder, remove_folder
from scriptloom.llm.exact_dedup import as_table, exact_dedup, located, sha256
from scriptloom.llm.fair_mix import fair_mix, word_count
from scriptloom.llm.rank_order import accepted, learn, least_scores
from scriptloom.llm.simhash import near_duplicates

CAPACITY = 2048
WIDTH = 3


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language. Text without a letter goes, and text that is farther from the
    profile it is nearest to than every document that is labelled with that language and found
    to be in it. Where nothing could be learned, every text with a letter stays."""
    profiles = learn(docs)
    if not profiles.names:
        return docs.filter(F.coalesce(F.regexp_like("text", F.lit(r"\p{L}")), F.lit(False)))
    return docs.filter(accepted(F.col("text"), profiles, least_scores(docs, profiles)))


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The table `docs` without the rows at the locators (_file, _row) of `gone`."""
    rows = located(docs, "")
    return rows.join(gone.select("_file", "_row"), ["_file", "_row"], "left_anti").select("doc.*")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each set of equal texts, the one with the largest doc_id."""
    docs = as_table(docs, new_folder(spark, "stage"))
    return _without(docs, exact_dedup(docs).filter("NOT kept"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each component of texts whose fingerprints over shingles of WIDTH words link at
    two or fewer differing bits, the one with the smallest doc_id."""
    docs = as_table(docs, new_folder(spark, "stage"))
    rows = located(docs, "").select("doc.doc_id", "doc.text", "_file", "_row")
    found = durable(near_duplicates(rows, width=WIDTH, carry=["_file", "_row"]))
    me = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "carried._file", "carried._row")
    stays = durable(found.groupBy("component").agg(F.min(me).alias("stays")))
    # grouped before the join, which Spark can then split where a component has very many rows
    gone = found.join(stays, "component").filter(me != F.col("stays")).select("carried.*")
    return _without(docs, durable(gone))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, once for each time they are taken. A document without
    words has nothing to take and goes. Rows that share doc_id, source and size are taken
    equally often, as near as that comes."""
    mixed = durable(
        fair_mix(docs)
        .filter("size > 0")
        .groupBy("doc_id", "source", "size")
        .agg(F.round(F.avg("taken") / F.first("size")).cast("int").alias("times"))
        .filter("times > 0")
    )
    rows = docs.select(F.struct("*").alias("doc"), "doc_id", "source", word_count(F.col("text")).alias("size"))
    same = [
        rows.doc_id.eqNullSafe(mixed.doc_id),
        rows.source.eqNullSafe(mixed.source),
        rows["size"] == mixed["size"],
    ]
    return rows.join(mixed, same).select(
        "doc", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("nth")
    ).select("doc.*")


def pack_bins(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in bins of CAPACITY words, an end mark counted with each document.
    Copies that the mix repeats are one cluster, so they never share a bin."""
    return best_fit_packing(
        docs.select(
            "doc_id",
            "source",
            (word_count(F.col("text")) + 1).alias("length"),
            sha256(F.coalesce("text", F.lit(""))).alias("cluster"),
        ),
        capacity=CAPACITY,
    )


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", drop_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("fair_mix", mix_sources),
    ("best_fit_packing", pack_bins),
]

#: Rank profiles, fingerprints and packing have no SQL; tests compare the run with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder, before = new_folder(spark, "pipeline"), None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            remove_folder(spark, f"{folder}/{before}")
        before = name
    return docs
