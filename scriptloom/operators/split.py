"""Splitting scripts into chunk rows.

Input: a frame with key columns and a text column. Output: the keys, a dense 1-based
number per input row in text order, `code`, and what the splitter adds; with `total_as` also
the number of chunks of the row. The text column
itself is dropped, so a script is not copied next to each of its chunks. Every operator
is a narrow projection; the unit of work is one script cell.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptloom.functions import fixed_values as fixed
from scriptloom.functions import metadata
from scriptloom.functions import splitting as sp
from scriptloom.functions.sql import each, let, name
from scriptloom.functions.text import line_count, without_comments

KEYS = ("script_id",)


def _rows(
    df: DataFrame, chunks: str, keys: Sequence[str], number_as: str, item_as: str = "code",
    total_as: str | None = None,
) -> DataFrame:
    """A row per chunk; with `total_as` each also has the number of its script's chunks."""
    if not total_as:
        return df.select(*keys, F.posexplode(F.expr(chunks)).alias("_pos", item_as)).select(
            *keys, (F.col("_pos") + 1).alias(number_as), item_as
        )
    return (
        df.select(*keys, F.expr(chunks).alias("_chunks"))
        .select(*keys, F.size("_chunks").alias(total_as), F.posexplode("_chunks").alias("_pos", item_as))
        .select(*keys, (F.col("_pos") + 1).alias(number_as), total_as, item_as)
    )


def split_delimiter(
    df: DataFrame, delimiter: str = fixed.BLOCK_DELIMITER, *, text_col: str = "source",
    keys: Sequence[str] = KEYS, number_as: str = "chunk_no", total_as: str | None = None,
) -> DataFrame:
    """A line that holds only the delimiter closes a block and is dropped."""
    return _rows(df, sp.by_delimiter(name(text_col), delimiter), keys, number_as, total_as=total_as)


def split_lines(
    df: DataFrame, n: int = fixed.LINES_PER_CHUNK, *, text_col: str = "source",
    keys: Sequence[str] = KEYS, number_as: str = "chunk_no", total_as: str | None = None,
) -> DataFrame:
    """Chunks of `n` lines; an empty text gives one empty chunk."""
    return _rows(df, sp.by_lines(name(text_col), n), keys, number_as, total_as=total_as)


def split_pattern(
    df: DataFrame, leading_ws: str = "skip", tail: str = "keep", *, text_col: str = "source",
    keys: Sequence[str] = KEYS, number_as: str = "chunk_no",
) -> DataFrame:
    """Blocks by opening word up to the first `END;`, other text up to a semicolon.

    `leading_ws="literal"` sees an opening word only right at the scan position;
    `tail="drop"` loses the text after the last semicolon.
    """
    blocks = sp.by_pattern(name(text_col), leading_ws, tail)
    return _rows(df, blocks, keys, number_as).withColumn(
        "is_terminated", F.expr(sp.is_terminated("code"))
    )


def split_statements(
    df: DataFrame, *, text_col: str = "source", keys: Sequence[str] = KEYS,
    number_as: str = "chunk_no", total_as: str | None = None,
) -> DataFrame:
    """Statements that end with a semicolon; a text headed by a block word stays whole."""
    return _rows(df, sp.by_statement(name(text_col)), keys, number_as, total_as=total_as)


def split_before_begin(
    df: DataFrame, max_chars: int = fixed.MAX_CHUNK_CHARS, *, text_col: str = "source",
    keys: Sequence[str] = KEYS, number_as: str = "chunk_no", total_as: str | None = None,
) -> DataFrame:
    """Cut texts over `max_chars` in front of each BEGIN."""
    return _rows(df, sp.before_begin(name(text_col), max_chars), keys, number_as, total_as=total_as)


def rechunk_by_size(
    df: DataFrame, max_chars: int = fixed.MAX_CHUNK_CHARS, *, text_col: str = "source",
    keys: Sequence[str] = KEYS, number_as: str = "chunk_no", total_as: str | None = None,
) -> DataFrame:
    """Cut texts over `max_chars` at semicolons into runs that just exceed `max_chars`."""
    return _rows(df, sp.by_size(name(text_col), max_chars), keys, number_as, total_as=total_as)


def split_top_level(
    df: DataFrame, *, text_col: str = "source", keys: Sequence[str] = KEYS,
    number_as: str = "chunk_no", total_as: str | None = None,
) -> DataFrame:
    """Blocks closed by a lone slash outside BEGIN .. END; the slash stays in its block."""
    return _rows(df, sp.by_top_level(name(text_col)), keys, number_as, total_as=total_as)


def split_safe(
    df: DataFrame, max_lines: int = fixed.MAX_LINES_PER_CHUNK, *, text_col: str = "source",
    keys: Sequence[str] = KEYS, number_as: str = "chunk_no",
) -> DataFrame:
    """Cut blocks over `max_lines` lines at safe lines; `oversized` marks chunks that had
    no safe line in time."""
    return _rows(df, sp.by_safe_lines(name(text_col), max_lines), keys, number_as).withColumn(
        "oversized", F.expr(f"{line_count('code')} > {max_lines}")
    )


def batch_small(
    df: DataFrame, small: int = fixed.SMALL_FRAGMENT_CHARS, cap: int = fixed.BATCH_FLUSH_CHARS,
    *, fragments_col: str = "fragments", keys: Sequence[str] = KEYS,
    number_as: str = "chunk_no", total_as: str | None = None,
) -> DataFrame:
    """Join neighbouring small fragments of an ordered array column."""
    return _rows(df, sp.batched(name(fragments_col), small, cap), keys, number_as, total_as=total_as)


def chunk_scripts(
    df: DataFrame, max_chars: int = fixed.MAX_CHUNK_CHARS, lines: int = fixed.LINES_PER_CHUNK,
    delimiter: str = fixed.BLOCK_DELIMITER, leading_ws: str = "skip", tail: str = "keep", *,
    text_col: str = "source", keys: Sequence[str] = KEYS, number_as: str = "chunk_no",
) -> DataFrame:
    """Delimiter split if it finds more than one block, else pattern split with refining
    and batching, else fixed line counts of the untouched text."""
    picked = sp.cascade(name(text_col), max_chars, lines, delimiter, leading_ws, tail)
    tagged = let(
        picked,
        lambda p: each(
            f"{p}.chunks", lambda c: f"named_struct('strategy', {p}.strategy, 'code', {c})"
        ),
        "picked",
    )
    return _rows(df, tagged, keys, number_as, "chunk").select(
        *keys, number_as, "chunk.strategy", "chunk.code"
    )


def structured_chunks(
    df: DataFrame, max_lines: int = fixed.MAX_LINES_PER_CHUNK, *, text_col: str = "source",
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Remove comments, split at top level, sub-chunk long blocks, number and classify."""
    chunks = let(
        without_comments(name(text_col)), lambda t: sp.structured(t, max_lines), "clean"
    )
    return _rows(df, chunks, keys, "chunk_no").select(
        *keys,
        "chunk_no",
        F.expr(metadata.chunk_id("chunk_no")).alias("chunk_id"),
        F.expr(metadata.block_type("code")).alias("block_type"),
        F.expr(line_count("code")).alias("line_count"),
        F.length("code").alias("n_chars"),
        F.expr(f"{line_count('code')} > {max_lines}").alias("oversized"),
        "code",
    )
