"""Scripts of any size written from their chunks, and read back.

Chunks are sorted by script and number, and tasks write them one after another into pack files,
so no script is ever held as a whole, and a pack holds many small scripts. The spans of a script
that many rows belong to are written by different tasks. Each run of bytes of a script is a row
of the manifest: script, its place among the script's runs, file, offset and length. Tasks write
under names that no other attempt uses and report their runs when they end, so what a lost
attempt wrote is in no manifest and is never read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptloom.operators.keyed import in_spans, numbered
from scriptloom.session import kept
from scriptloom.sources.listing import _opened

PACK_BYTES = 128 << 20
PIECE_BYTES = 8 << 20
TASKS_MOST = 20_000
#: What a task writes, where packs are smaller, and reads; a run to read counts as RUN_BYTES more.
TASK_BYTES = 16 << 20
RUN_BYTES = 1024
#: Bytes and rows of pieces that a task hands on at once.
BATCH_BYTES = 8 << 20
BATCH_ROWS = 10_000
RUNS = "script_id string, span long, seq long, file string, offset long, length long"


def _writer(path: str, sep: bytes, pack_bytes: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder, _ = _opened(path)
        out, name, at = None, "", 0
        runs: list[dict] = []
        now: tuple | None = None
        seq = 0
        store.create_dir(folder, recursive=True)

        def begin() -> None:
            runs.append(
                {"script_id": now[0], "span": now[1], "seq": seq, "file": name, "offset": at, "length": 0}
            )

        for batch in batches:
            for script, span, first, code in zip(
                *(batch[c].to_pylist() for c in ("script_id", "span", "first")),
                batch["code"].cast(pa.large_binary()).to_pylist(),
                strict=True,
            ):
                if out is None or at >= pack_bytes:
                    if out is not None:
                        out.close()
                    name, at = f"{uuid.uuid4().hex}.pack", 0
                    out = store.open_output_stream(f"{folder}/{name}")
                    if now == (script, span):
                        seq += 1
                        begin()
                if now != (script, span):
                    now, seq = (script, span), 0
                    begin()
                data = code if first else sep + code
                out.write(data)
                at += len(data)
                runs[-1]["length"] += len(data)
        if out is not None:
            out.close()
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        names = [x.split(" ")[0] for x in RUNS.split(", ")]
        schema = pa.schema(list(zip(names, kinds, strict=True)))
        for i in range(0, len(runs), 10_000):
            yield pa.RecordBatch.from_pylist(runs[i : i + 10_000], schema)

    return write


def write_packs(
    df: DataFrame, path: str, *, id_col: str = "script_id", order: str = "chunk_no", code_col: str = "code",
    sep: str = "\n", pack_bytes: int = PACK_BYTES,
) -> DataFrame:
    """Write scripts, their chunks joined in order, into pack files below `path`, and return the
    manifest: script_id, run, file, offset, length. It is also kept below `path`.

    A chunk without code, id or number raises. As many tasks write as the characters of all
    chunks ask for, a task several packs where these are small, so the numbers of files and tasks
    grow with the data and not with the scripts. Text is shuffled once.
    """
    missing = F.raise_error(F.lit("a chunk to write has no code"))
    rows = df.select(
        F.col(id_col).cast("string").alias("script_id"),
        F.col(order).cast("long").alias("place"),
        F.coalesce(F.col(code_col), missing).alias("code"),
    )
    chars = rows.agg(F.coalesce(F.sum(F.length("code") + len(sep)), F.lit(0))).first()[0]
    tasks = max(1, min(TASKS_MOST, -(-chars // max(pack_bytes, TASK_BYTES))))
    placed = numbered(in_spans(rows, ["script_id"], "place"), ["script_id"], "place", "nth", tasks=tasks)
    runs = kept(
        # the first chunk of a script has no separator before it
        placed.sortWithinPartitions("script_id", "_span", "place")
        .select(
            "script_id",
            F.coalesce("_span", F.lit(0)).cast("long").alias("span"),
            (F.col("nth") == 1).alias("first"),
            "code",
        )
        .mapInArrow(_writer(path, sep.encode(), pack_bytes), RUNS)
    )
    manifest = runs.select(
        "script_id",
        F.struct("span", "seq").alias("run"),
        F.concat(F.lit(f"{path.rstrip('/')}/"), "file").alias("file"),
        "offset",
        "length",
    )
    manifest.write.parquet(f"{path.rstrip('/')}/manifest")
    return df.sparkSession.read.parquet(f"{path.rstrip('/')}/manifest")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The manifest of what `write_packs` wrote to `path`."""
    return spark.read.parquet(f"{path.rstrip('/')}/manifest")


def _reader(piece_bytes: int):
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
    schema = pa.schema(list(zip(["script_id", "span", "seq", "piece", "text"], kinds, strict=True)))

    def pieces(rows: Iterator[dict]) -> Iterator[tuple[str, int, int, int, bytes]]:
        """Runs of one file that come one after another are read through one handle."""
        name, file = None, None
        try:
            for row in rows:
                if row["file"] != name:
                    if file is not None:
                        file.close()
                    store, inside, _ = _opened(row["file"])
                    name, file = row["file"], store.open_input_file(inside)
                left, piece, cut = row["length"], 0, b""
                file.seek(row["offset"])
                while left or cut or not piece:
                    data = cut + file.read(min(piece_bytes, left))
                    left -= len(data) - len(cut)
                    # a character is not cut; its bytes begin the next piece
                    end = len(data)
                    while left and end and data[end - 1] & 0xC0 == 0x80:
                        end -= 1
                    end -= bool(left and end and data[end - 1] >= 0xC0)
                    yield row["script_id"], row["span"], row["seq"], piece, data[:end]
                    cut, piece = data[end:], piece + 1
        finally:
            if file is not None:
                file.close()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def handed() -> pa.RecordBatch:
            columns = zip(*held, strict=True) if held else [()] * len(kinds)
            return pa.RecordBatch.from_arrays(
                [pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], schema=schema
            )

        for script, span, seq, piece, data in pieces(row for batch in batches for row in batch.to_pylist()):
            if held and (size + len(data) > BATCH_BYTES or len(held) >= BATCH_ROWS):
                yield handed()
                held, size = [], 0
            held.append((script, span, seq, piece, data.decode()))
            size += len(data)
        yield handed()

    return read


def read_pieces(manifest: DataFrame, *, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """The text of packed scripts in rows of some `piece_bytes`: script_id, piece (a struct that
    orders the pieces of a script) and text. Pieces joined without a separator are the script.

    As many tasks read as the bytes and runs ask for. Runs that lie close together in a file are
    read by one task, one after another, and handed on many at a time."""
    work = F.coalesce(F.sum(F.col("length") + RUN_BYTES), F.lit(0))
    runs, size = manifest.agg(F.count("*"), work).first()
    tasks = max(1, min(TASKS_MOST, runs, -(-size // TASK_BYTES)))
    stretch = F.floor(F.col("offset") / TASK_BYTES)
    rows = (
        manifest.select("script_id", "run.span", "run.seq", "file", "offset", "length")
        .repartition(tasks, "file", stretch)
        .sortWithinPartitions("file", "offset")
    )
    return rows.mapInArrow(
        _reader(max(8, piece_bytes)), "script_id string, span long, seq long, piece long, text string"
    ).select("script_id", F.struct("span", "seq", "piece").alias("piece"), "text")


def read_packed_scripts(manifest: DataFrame, *, code_col: str = "code") -> DataFrame:
    """Packed scripts as cells, each of which fits one."""
    ordered: Column = F.array_sort(F.collect_list(F.struct("piece", "text")))
    whole = F.array_join(F.transform(ordered, lambda p: p["text"]), "").alias(code_col)
    return read_pieces(manifest).groupBy("script_id").agg(whole)
