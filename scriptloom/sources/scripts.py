"""Scripts from files and from text columns."""

from __future__ import annotations

import re
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptloom.sources.listing import can_list, list_files, read_files

FILE_GLOB = "*.{[sS][qQ][lL],[tT][xX][tT]}"
FILE_NAME = r"(?i)\.(sql|txt)\z"


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def _decoded(text: Column, on_invalid: str) -> Column:
    if on_invalid == "raise":
        return F.validate_utf8(text)
    if on_invalid in ("repair", "flag"):
        return F.make_valid_utf8(text)
    raise ValueError("on_invalid is 'raise', 'repair' or 'flag'")


def from_files(files: DataFrame, on_invalid: str) -> DataFrame:
    """Script rows of a binary file frame, batch or streaming. The id is the path. With
    `on_invalid="flag"` a column `is_utf8` names the files that had to be repaired."""
    raw = F.col("content").cast("string")
    flag = [F.is_valid_utf8(raw).alias("is_utf8")] if on_invalid == "flag" else []
    return files.select(
        F.col("path").alias("script_id"),
        F.col("path"),
        _decoded(raw, on_invalid).alias("source"),
        *flag,
    ).select("*", content_hash(F.col("source")).alias("content_hash"))


def read_scripts(
    spark: SparkSession, path: str, *, on_invalid: str = "raise", listing: str = "executors"
) -> DataFrame:
    """One row per `.sql` or `.txt` file below `path`, suffix in any case, read whole as UTF-8;
    an empty file is an empty script. (A stream of script files does not see empty ones.)

    Folders are listed and files read by executors, a level of the tree at a time, when this is
    called. `listing="driver"` leaves both to Spark's binary source, whose listing is the
    driver's; so does a path that is a pattern or in a store that only Spark opens. A file
    is never split, as a script is one cell. Bytes that are not UTF-8 raise, or are repaired
    with `on_invalid="repair"`, or repaired and flagged with `on_invalid="flag"`.
    """
    if listing not in ("executors", "driver"):
        raise ValueError("listing is 'executors' or 'driver'")
    if listing == "executors" and can_list(path):
        return from_files(read_files(list_files(spark, path, FILE_NAME)), on_invalid)
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", FILE_GLOB)
        .option("recursiveFileLookup", "true")
        .load(path)
    )
    scripts = from_files(files, on_invalid)
    # Spark lists empty files but does not read them; the listing is the driver's already
    named = [(re.sub("^([^/:]+):///", r"\1:/", unquote(p)),) for p in files.inputFiles()]
    empty = spark.createDataFrame(named, "path string").join(files.select("path"), "path", "left_anti")
    none = {"script_id": F.col("path"), "source": F.lit(""), "is_utf8": F.lit(True)}
    none["content_hash"] = content_hash(none["source"])
    return scripts.unionByName(empty.withColumns(none).select(*scripts.columns))


def scripts_from(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Scripts held in a text column. The hash is computed only if it is used."""
    text = F.col(text_col)
    return df.select(
        F.col(id_col).cast("string").alias("script_id"),
        F.lit(None).cast("string").alias("path"),
        text.alias("source"),
        content_hash(text).alias("content_hash"),
    )
