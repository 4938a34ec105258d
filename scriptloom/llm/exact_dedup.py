"""Exact deduplication as a stream with keyed state that never expires.

Documents arrive as (digest, identifier, content locator). A streaming aggregation keeps for
each digest, in a RocksDB state store on disk, the row that stays, where its content is, and
how many rows came. The state has no watermark; a later run over the same checkpoint goes on
from it. Every hit is then checked: the full bytes at the locator of the row that stays are
compared with those of each other row of the digest. Rows that differ, which takes two texts
with one digest, are grouped by their bytes instead.

A locator is the file and row of a Parquet table, so a frame that is no plain table is written
to the shared folder first.

Defined results: null text counts as empty; of equal texts the row with the largest doc_id
stays, and of rows that share that doc_id the last by locator; a null doc_id is the smallest;
very long texts are hashed and compared whole; an empty table gives an empty result. Other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptloom.llm.common import durable, maybe_members, new_folder, remove_folder, settings

STATE = {
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # else each state partition reserves megabytes of disk for logs it does not fill
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    # an executor's state partitions share this memory, however many they are
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "128",
}
ARRIVAL = "doc_id {id}, digest string, file string, row long"


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def as_table(docs: DataFrame, folder: str) -> DataFrame:
    """`docs`, or where it is no plain table what was written of it to `folder`."""
    try:
        docs.select(docs.metadataColumn("_metadata").row_index)
        return docs
    except AnalysisException:
        docs.write.parquet(folder)
        return docs.sparkSession.read.parquet(folder)


def located(docs: DataFrame, folder: str) -> DataFrame:
    """Each row of `docs` as the struct `doc`, which no name in it can clash with, and its
    locator columns _file and _row."""
    table = as_table(docs, folder)
    where = table.metadataColumn("_metadata")
    return table.select(
        F.struct("*").alias("doc"), where.file_path.alias("_file"), where.row_index.alias("_row")
    )


def absorb(spark: SparkSession, landing: str, checkpoint: str, id_type: str, files: int) -> None:
    """Take in what has landed since the last run, `files` files at a time."""
    arrivals = (
        spark.readStream.schema(ARRIVAL.format(id=id_type))
        .option("maxFilesPerTrigger", files)
        .parquet(landing)
    )
    state = arrivals.groupBy("digest").agg(
        F.max(F.struct("doc_id", "file", "row")).alias("stays"), F.count("*").alias("n")
    )
    with settings(spark, STATE):
        (
            state.writeStream.format("noop")
            .outputMode("update")
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
            .awaitTermination()
        )


def kept_state(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(digest, stays, n) as the state store has it after the last batch."""
    with settings(spark, STATE):
        raw = spark.read.format("statestore").load(checkpoint)
    stays, n = raw.schema["value"].dataType.names[:2]
    return raw.select(
        F.col("key.digest"), F.col(f"value.{stays}").alias("stays"), F.col(f"value.{n}").alias("n")
    )


def exact_dedup(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
    digest: Callable[[Column], Column] = sha256, files_per_batch: int = 16, bits: int = 23,
) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 and the locator _file, _row of every row."""
    spark = docs.sparkSession
    work = new_folder(spark, "exact-dedup")
    text = F.coalesce(F.col(text_col), F.lit("")).alias("text")
    rows = located(docs.select(F.col(id_col).alias("doc_id"), text), f"{work}/content").select(
        "doc.*", "_file", "_row"
    )
    rows = rows.withColumn("digest", digest(F.col("text")))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    rows.select("doc_id", "digest", F.col("_file").alias("file"), F.col("_row").alias("row")).write.parquet(
        f"{work}/landing"
    )
    absorb(spark, f"{work}/landing", f"{work}/checkpoint", id_type, files_per_batch)
    state = kept_state(spark, f"{work}/checkpoint")

    # hits: full bytes of every row of a digest against those of the row that stays
    several = durable(state.filter("n > 1").select("digest", "stays"))
    hits, _ = maybe_members(rows, several, "digest", bits)
    stay = several.select(
        "digest", F.col("stays.file").alias("_file"), F.col("stays.row").alias("_row")
    )
    held = hits.join(stay, ["digest", "_file", "_row"]).select("digest", F.col("text").alias("held"))
    # grouped only after the join, which can then split a digest that many rows have
    differ = durable(hits.join(held, "digest").filter("text <> held").select("digest"))
    unequal = differ.distinct()

    arrivals = spark.read.schema(ARRIVAL.format(id=id_type)).parquet(f"{work}/landing")
    me = F.struct("doc_id", "file", "row")
    columns = ["doc_id", "file", "row", "digest", "stays", "n"]
    groups = arrivals.join(state, "digest").select(*columns)
    if not differ.isEmpty():
        clash = rows.join(unequal, "digest").select(
            "doc_id", F.col("_file").alias("file"), F.col("_row").alias("row"), "digest", "text"
        )
        by_text = clash.groupBy("digest", "text").agg(F.max(me).alias("stays"), F.count("*").alias("n"))
        groups = groups.join(unequal, "digest", "left_anti").unionByName(
            clash.join(by_text, ["digest", "text"]).select(*columns)
        )
    whole = F.col("digest") if digest is sha256 else F.lit(None).cast("string")
    result = durable(
        groups.select(
            "doc_id",
            F.col("stays.doc_id").alias("keep_id"),
            F.col("n").alias("group_size"),
            me.eqNullSafe(F.col("stays")).alias("kept"),
            whole.alias("text_sha256"),
            F.col("file").alias("_file"),
            F.col("row").alias("_row"),
        )
    )
    remove_folder(spark, work)
    return result
