"""Outputs: mapping tables as CSV and one text document per script."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

from scriptloom.sources.records import read_records

# Options under which outer spaces, newlines, quotes, backslashes, empty text and NULL
# all come back as they were written. Text that is the mark of NULL, after any number of
# backslashes, is written with one backslash more.
NULL_TEXT = r"\A(\\*)(\\N)\z"
CSV_OPTIONS = {
    "header": "true",
    "quoteAll": "true",
    "escape": '"',
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
    "nullValue": "\\N",
    "emptyValue": "",
}


FOLDER_CHARS = 128 << 20
MOST_FOLDERS = 100_000


def write_mapping_csv(
    df: DataFrame, path: str, *, mode: str = "errorifexists", rows_per_file: int = 20_000
) -> None:
    """Write a mapping with a header and no index. Arrays of text become lines.

    Spark's own reader takes a file whose text has newlines as a whole, so files are kept to
    `rows_per_file` rows to leave readers something to share out; larger ones are shared out by
    a `record_index`.
    """
    flat = []
    for f in df.schema.fields:
        column = F.col(f"`{f.name}`")
        if isinstance(f.dataType, ArrayType):
            column = F.array_join(column, "\n")
        if isinstance(f.dataType, ArrayType | StringType):
            column = F.regexp_replace(column, NULL_TEXT, r"\\$1$2")
        flat.append(column.alias(f.name))
    df.select(*flat).write.mode(mode).options(maxRecordsPerFile=rows_per_file, **CSV_OPTIONS).csv(path)


def read_mapping_csv(
    spark: SparkSession, path: str, schema: StructType | str, *, index: DataFrame | None = None
) -> DataFrame:
    """Read back what `write_mapping_csv` wrote. With the `record_index` of `path`, each file is
    read by as many tasks as it has ranges."""
    if index is None:
        rows = spark.read.options(multiLine="true", **CSV_OPTIONS).schema(schema).csv(path)
    else:
        rows = read_records(index, schema, CSV_OPTIONS)
    texts = [f.name for f in rows.schema.fields if isinstance(f.dataType, StringType)]
    return rows.withColumns(
        {c: F.regexp_replace(F.col(f"`{c}`"), r"\A\\(\\*\\N)\z", "$1") for c in texts}
    )


def write_scripts(
    df: DataFrame, path: str, *, code_col: str = "code", id_col: str = "script_id",
    mode: str = "errorifexists", folders: int | None = None, folder_per_script: bool = False,
) -> None:
    """The text documents of scripts, as rows of id and text in at most `folders` folders by a
    hash of the id, which `read_written_scripts` reads back. Without a number there are as many
    folders as the characters of all scripts ask for, FOLDER_CHARS each, MOST_FOLDERS at most;
    they are added up in a pass of its own. Each folder is written by one task.

    `folder_per_script=True` gives each script a folder with one plain text file instead, for
    tools that want files; the driver lists and commits every folder, so that is for
    thousands of scripts. The text format ends each document with a newline.
    """
    rows = df.select(F.col(id_col).alias("script_id"), F.col(code_col).alias("value"))
    if folder_per_script:
        rows.write.mode(mode).partitionBy("script_id").text(path)
        return
    if folders is None:
        chars = rows.agg(F.coalesce(F.sum(F.length("value")), F.lit(0))).first()[0]
        folders = max(1, min(MOST_FOLDERS, -(-chars // FOLDER_CHARS)))
    folder = F.pmod(F.xxhash64("script_id"), F.lit(folders))
    rows.withColumn("folder", folder).repartition(folders, "folder").write.mode(mode).option(
        "maxRecordsPerFile", 100_000
    ).partitionBy("folder").json(path)


def read_written_scripts(spark: SparkSession, path: str, *, code_col: str = "code") -> DataFrame:
    """What `write_scripts` wrote, in whichever layout has no folder per script."""
    rows = spark.read.schema("script_id string, value string, folder int").json(path)
    return rows.select("script_id", F.col("value").alias(code_col))
