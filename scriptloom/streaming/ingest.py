"""Incremental chunking of a landing directory as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from scriptloom.functions import fixed_values as fixed
from scriptloom.operators.split import structured_chunks
from scriptloom.sources.listing import can_list, read_files, stream_files
from scriptloom.sources.scripts import FILE_GLOB, FILE_NAME, from_files

SALTS = 64


def new_scripts(
    scripts: DataFrame, *, id_col: str = "script_id", time_col: str | None = None,
    within: str | None = None,
) -> DataFrame:
    """One script per text over the life of the stream.

    The state holds hashes. A text that arrives a million times would send all its
    copies to one state partition; so copies are first dropped per (hash, salt), which
    spreads them, and then per hash, where each text arrives at most SALTS times.

    With `time_col` and `within` (such as "30 days") a text is remembered for that long by the
    event time, so the state is bounded; a copy that arrives later counts as new.
    """
    salted = scripts.withColumn("_salt", F.pmod(F.xxhash64(id_col), F.lit(SALTS)))
    if not within:
        return (
            salted.dropDuplicates(["content_hash", "_salt"])
            .drop("_salt")
            .dropDuplicates(["content_hash"])
        )
    return (
        salted.withWatermark(time_col, within)
        .dropDuplicatesWithinWatermark(["content_hash", "_salt"])
        .drop("_salt")
        .dropDuplicatesWithinWatermark(["content_hash"])
    )


def stream_scripts(
    spark: SparkSession, path: str, *, on_invalid: str = "raise",
    files_per_trigger: int | None = None, listing: str = "executors",
) -> DataFrame:
    """Scripts as they land in a directory, empty ones left out.

    Executors list the directory in each batch, and what paths batches had is state; a batch has
    all that has landed, so set the pace with the trigger. `listing="driver"` leaves both to
    Spark's own file source, whose listing and seen paths are the driver's; so does a number of
    `files_per_trigger`, or a path that is a pattern or in a store that only Spark opens.
    """
    if listing not in ("executors", "driver"):
        raise ValueError("listing is 'executors' or 'driver'")
    if listing == "executors" and not files_per_trigger and can_list(path):
        return from_files(read_files(stream_files(spark, path, FILE_NAME)), on_invalid)
    reader = (
        spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length long, content binary")
        .option("pathGlobFilter", FILE_GLOB)
        .option("recursiveFileLookup", "true")
    )
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return from_files(reader.load(path), on_invalid)


def stream_chunks(scripts: DataFrame, max_lines: int = fixed.MAX_LINES_PER_CHUNK) -> DataFrame:
    """Structured chunks of the scripts of a stream that are new."""
    return structured_chunks(new_scripts(scripts), max_lines, keys=("script_id", "content_hash"))


def run_available(chunks: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Process what has landed since the last run and stop. The file sink and the
    checkpoint make a rerun after a failure neither lose nor repeat a chunk."""
    return (
        chunks.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
