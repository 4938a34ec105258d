"""Serial numbers, ids, types, counts, depth and position of chunks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptloom.functions import metadata
from scriptloom.functions import splitting as sp
from scriptloom.functions.sql import name
from scriptloom.functions.text import line_count
from scriptloom.operators.keyed import numbered
from scriptloom.operators.split import KEYS


def with_chunk_id(
    df: DataFrame, *, keys: Sequence[str] = KEYS, order: str = "chunk_no", dense: bool = False
) -> DataFrame:
    """Serial per script and the id made of it.

    `dense=True` says `order` already runs 1, 2, 3 .. per script, as every splitter
    numbers its chunks; then nothing is shuffled. Else chunks are numbered anew.
    """
    if dense:
        out = df.withColumn("serial", F.col(order).cast("bigint"))
    else:
        out = numbered(df, keys, order, "serial")
    return out.withColumn("chunk_id", F.expr(metadata.chunk_id("serial")))


def with_block_type(df: DataFrame, *, code_col: str = "code") -> DataFrame:
    return df.withColumn("block_type", F.expr(metadata.block_type(name(code_col))))


def with_counts(df: DataFrame, *, code_col: str = "code") -> DataFrame:
    """Lines and characters (code points) of each chunk."""
    return df.withColumns(
        {"line_count": F.expr(line_count(name(code_col))), "n_chars": F.length(code_col)}
    )


def line_depth(
    df: DataFrame, *, text_col: str = "source", keys: Sequence[str] = KEYS
) -> DataFrame:
    """One row per line with the nesting depth after it; worked out inside the script's
    row, so no window and no shuffle."""
    rows = F.expr(sp.lines_with_depth(name(text_col)))
    return df.select(*keys, F.posexplode(rows).alias("_pos", "_line")).select(
        *keys, (F.col("_pos") + 1).alias("line_no"), "_line.line", "_line.depth"
    )


def with_progress(
    df: DataFrame, *, keys: Sequence[str] = KEYS, order: str = "chunk_no",
    total_col: str | None = None,
) -> DataFrame:
    """Position, chunks in the script, and their ratio.

    With `total_col`, which splitters fill under the name given as their `total_as`, `order`
    runs 1, 2, 3 .. per script and nothing is shuffled. Else chunks are numbered anew.
    """
    if total_col:
        placed = df.withColumns(
            {"position": F.col(order).cast("bigint"), "n_chunks": F.col(total_col).cast("bigint")}
        )
    else:
        placed = numbered(df, keys, order, "position", "n_chunks")
    return placed.withColumn("fraction", F.col("position") / F.col("n_chunks"))
