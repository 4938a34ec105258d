"""Multi-line CSV files read by several tasks each.

A newline may be text or the end of a record, and which one only the number of quotes before it
tells. So each range of a file counts its quotes and finds the first newline that would end a
record if the range began outside a text, and the first if it began inside. Adding up the counts
says which of the two holds. A record belongs to the range in which the record before it ends.
The index has one row per range: file, first (where its first record begins, NULL where none
does), stop (its end) and length of the file.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from scriptloom.operators.keyed import running
from scriptloom.sources.listing import BATCH_BYTES, _opened, list_files

PART_BYTES = 32 << 20
TASKS_MOST = 20_000
QUOTE, NEWLINE = 0x22, 0x0A
SCANNED = "file string, start long, stop long, length long, odd int, if_out long, if_in long"


def _record_ends(data: bytes, inside: bool) -> tuple[np.ndarray, bool]:
    """Places of the newlines of `data` that end a record, and whether its end is in a text."""
    seen = np.frombuffer(data, np.uint8)
    quotes = np.flatnonzero(seen == QUOTE)
    lines = np.flatnonzero(seen == NEWLINE)
    before = np.searchsorted(quotes, lines) + inside
    return lines[before % 2 == 0], bool((len(quotes) + inside) % 2)


def _scanner(batch_bytes: int):
    """Parity of the quotes of each range, and where its first record begins in either case."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for row in batch.to_pylist():
                store, inside, _ = _opened(row["file"])
                firsts: list[int | None] = [None, None]
                odd = False
                with store.open_input_file(inside) as file:
                    file.seek(row["start"])
                    at = row["start"]
                    while at < row["stop"]:
                        data = file.read(min(batch_bytes, row["stop"] - at))
                        if not data:
                            raise OSError(f"{row['file']} is shorter than it was when listed")
                        for began_inside in (0, 1):
                            if firsts[began_inside] is None:
                                ends, _ = _record_ends(data, bool(began_inside) ^ odd)
                                if len(ends):
                                    firsts[began_inside] = at + int(ends[0]) + 1
                        odd ^= bool(data.count(b'"') % 2)
                        at += len(data)
                found.append({**row, "odd": int(odd), "if_out": firsts[0], "if_in": firsts[1]})
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
            names = [x.split(" ")[0] for x in SCANNED.split(", ")]
            yield pa.RecordBatch.from_pylist(found, pa.schema(list(zip(names, kinds, strict=True))))

    return scan


def _dealt(ranges: DataFrame) -> DataFrame:
    """The ranges in as many tasks as their bytes ask for, and two for each core if they are few."""
    n, size = ranges.agg(F.count("*"), F.coalesce(F.sum(F.col("stop") - F.col("start")), F.lit(0))).first()
    most = max(2 * ranges.sparkSession.sparkContext.defaultParallelism, -(-size // PART_BYTES))
    return ranges.repartition(max(1, min(n, most, TASKS_MOST)))


def record_index(
    spark: SparkSession, path: str, *, part_bytes: int = PART_BYTES, batch_bytes: int = BATCH_BYTES
) -> DataFrame:
    """Where the records of the CSV files at or below `path` begin, a row for each `part_bytes`.

    The files are those of `write_mapping_csv`: quotes inside a text are doubled, and records end
    with a newline. Each is read once, by as many tasks as it has ranges. The index may be kept
    as a table, and read again for as long as the files stay as they are.
    """
    files = list_files(spark, path, r"(?i)\.csv$").filter("length > 0")
    starts = F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(part_bytes).cast("long"))
    ranges = files.select(F.col("path").alias("file"), F.explode(starts).alias("start"), "length").select(
        "file", "start", F.least(F.col("start") + part_bytes, "length").alias("stop"), "length"
    )
    scanned = _dealt(ranges).mapInArrow(_scanner(batch_bytes), SCANNED)
    placed = running(scanned, ["file"], "start", F.col("odd").cast("long"), "_odds")
    before = (F.col("_odds") - F.col("odd")) % 2
    first = F.when(F.col("start") == 0, F.lit(0)).when(before == 0, F.col("if_out")).otherwise(F.col("if_in"))
    return placed.select("file", first.cast("long").alias("first"), "stop", "length")


def _reader(batch_bytes: int):
    """The records of each range, without the newlines after them and without headers."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                store, inside, _ = _opened(row["file"])
                with store.open_input_file(inside) as file:
                    file.seek(row["first"])
                    at, within, header = row["first"], False, row["first"] == 0
                    pieces: list[bytes] = []
                    while True:
                        data = file.read(batch_bytes)
                        ends, within = _record_ends(data, within)
                        out, begin, done = [], 0, not data
                        for end in ends.tolist():
                            out.append(b"".join([*pieces, data[begin:end]]))
                            pieces, begin = [], end + 1
                            if at + end >= row["stop"]:
                                done = True
                                break
                        else:
                            pieces.append(data[begin:])
                            if not data and any(pieces):
                                out.append(b"".join(pieces))
                        at += len(data)
                        if header and out:
                            out, header = out[1:], False
                        if out:
                            yield pa.RecordBatch.from_arrays([pa.array([x.decode() for x in out])], ["record"])
                        if done:
                            break

    return read


def read_records(
    index: DataFrame, schema: StructType | str, options: dict[str, str], *, batch_bytes: int = BATCH_BYTES
) -> DataFrame:
    """The rows of indexed CSV files. Tasks hand on the text of records, some `batch_bytes` at
    once; Spark parses them."""
    spark = index.sparkSession
    fields = spark.createDataFrame([], schema).schema.fields
    ddl = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in fields)
    # a range whose last record ends with the file has none after it
    ranges = index.filter("first < length").withColumn("start", F.col("first"))
    records = _dealt(ranges).mapInArrow(_reader(batch_bytes), "record string")
    parsed = records.select(F.from_csv("record", ddl, {**options, "header": "false", "multiLine": "true"}).alias("_row"))
    return parsed.select("_row.*")
