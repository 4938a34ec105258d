"""Helpers that several operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed by the contracts: a word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as `spark.checkpoint.dir` names it. Only
    a local session, whose executors are the driver, gets a temporary folder instead."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = spark.sparkContext.getCheckpointDir()
    if not own:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="scriptloom-llm-"))
        own = spark.sparkContext.getCheckpointDir()
    return own


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of this library's own, wherever the shared store is."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings for the length of a block."""
    before = {key: spark.conf.get(key, None) for key in values}
    for key, value in values.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


#: Rows that a task hands to Python at once; texts may be long.
BATCH_ROWS = 1000


def durable(df: DataFrame, batch_rows: int = BATCH_ROWS) -> DataFrame:
    """`df` computed once and kept in the shared folder, so that a lost executor costs
    nothing and later steps do not run the work again. Spark removes the files when the
    frame is gone, if spark.cleaner.referenceTracking.cleanCheckpoints is set."""
    shared_folder(df.sparkSession)
    with settings(df.sparkSession, {"spark.sql.execution.arrow.maxRecordsPerBatch": str(batch_rows)}):
        return df.checkpoint()


def id_text(id_col: str) -> Column:
    """The identifier as text; a null identifier is the empty text."""
    return F.coalesce(F.col(id_col).cast("string"), F.lit(""))


def remainder(id_col: str, n: int) -> Column:
    """crc32 of the identifier's text modulo n, as the contracts split documents."""
    return F.crc32(id_text(id_col).cast("binary")) % n


def utf8(array) -> list[bytes]:
    """The texts of an Arrow string array as UTF-8; null is the empty text."""
    import pyarrow as pa

    return [x or b"" for x in array.cast(pa.large_binary()).to_pylist()]


def maybe_members(
    rows: DataFrame, members: DataFrame, name: str, bits: int = 23
) -> tuple[DataFrame, DataFrame]:
    """`rows` in two parts: those whose column `name` may be in `members`, and those where it
    is not. A bitmap of 2^bits hashed values decides; it is broadcast in pieces of 4 KB and is
    no larger than 2^bits / 8 bytes whatever the data."""
    at = F.pmod(F.xxhash64(name), F.lit(1 << bits))
    piece = F.bitmap_bucket_number(at).alias("_piece")
    bitmap = members.groupBy(piece).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("_bitmap")
    )
    bit = F.bitmap_bit_position(at)
    byte = F.substring("_bitmap", (bit / 8).cast("int") + 1, F.lit(1))
    is_set = F.getbit(F.conv(F.hex(byte), 16, 10).cast("int"), (bit % 8).cast("int")) == 1
    probed = rows.withColumn("_piece", F.bitmap_bucket_number(at)).join(
        F.broadcast(bitmap), "_piece", "left"
    )
    maybe = F.coalesce(is_set, F.lit(False))
    return probed.filter(maybe).select(*rows.columns), probed.filter(~maybe).select(*rows.columns)
