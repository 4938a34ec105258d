"""Batch processing of scripts that were not seen before."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scriptloom.operators.audit import first_of_each


def only_new(
    scripts: DataFrame, seen: DataFrame, *, within_batch: str = "all", id_col: str = "script_id"
) -> DataFrame:
    """Scripts whose text is not in `seen`. A script without text is never a copy.

    `within_batch="first"` also keeps a single script per new text. `seen` may repeat a hash,
    but `extend_seen` keeps it distinct. It is joined as it is, not grouped: so Spark itself
    can split the partition of a hash that many scripts have, and reads the texts once.
    """
    if within_batch not in ("all", "first"):
        raise ValueError("within_batch is 'all' or 'first'")
    columns = scripts.columns
    if within_batch == "first":
        scripts = first_of_each(scripts, "content_hash", [id_col], "_copies")
    return scripts.join(seen.select("content_hash"), "content_hash", "left_anti").select(*columns)


def extend_seen(seen: DataFrame, scripts: DataFrame) -> DataFrame:
    """The seen hashes after `scripts` have been processed."""
    return seen.select("content_hash").union(scripts.select("content_hash")).distinct()


def create_seen(spark: SparkSession, table: str, *, buckets: int = 200, path: str | None = None) -> None:
    """An empty table of seen hashes, bucketed and sorted by hash. `buckets` should be no less
    than spark.sql.shuffle.partitions, or Spark shuffles the table for a join after all."""
    rows = spark.createDataFrame([], "content_hash string")
    _bucketed(rows, buckets, path).mode("errorifexists").saveAsTable(table)


def _bucketed(rows: DataFrame, buckets: int, path: str | None):
    writer = rows.write.format("parquet").bucketBy(buckets, "content_hash").sortBy("content_hash")
    return writer.option("path", path) if path else writer


def _unseen(scripts: DataFrame, table: str) -> DataFrame:
    """The hashes of a batch that the table lacks. One row per hash meets the table, so a hash
    that many scripts have is one row there, and the table itself is not shuffled."""
    hashes = scripts.select("content_hash").filter("content_hash IS NOT NULL").distinct()
    return hashes.join(scripts.sparkSession.table(table), "content_hash", "left_anti")


def only_new_to(scripts: DataFrame, table: str, *, within_batch: str = "all", id_col: str = "script_id") -> DataFrame:
    """What `only_new` gives, of a table that `create_seen` made: the batch is shuffled, the table
    is read bucket by bucket. Only the batch's hashes meet the table, not its texts."""
    if within_batch not in ("all", "first"):
        raise ValueError("within_batch is 'all' or 'first'")
    columns = scripts.columns
    if within_batch == "first":
        scripts = first_of_each(scripts, "content_hash", [id_col], "_copies").select(*columns)
    no_text = scripts.filter("content_hash IS NULL")
    new = scripts.join(_unseen(scripts, table), "content_hash", "left_semi").select(*columns)
    return new.unionByName(no_text)


def add_seen(scripts: DataFrame, table: str) -> None:
    """Append the hashes of a batch that the table lacks, one file a bucket at most. A batch that
    is added again adds nothing."""
    spark = scripts.sparkSession
    detail = {r.col_name: r.data_type for r in spark.sql(f"DESCRIBE EXTENDED {table}").collect()}
    buckets = int(detail["Num Buckets"])
    new = _unseen(scripts, table).repartition(buckets, "content_hash")
    _bucketed(new, buckets, detail["Location"]).mode("append").saveAsTable(table)
