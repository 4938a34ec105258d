"""End-to-end flows over tables of scripts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptloom.functions import fixed_values as fixed
from scriptloom.operators.audit import assemble, audit_table, map_chunks
from scriptloom.operators.incremental import only_new
from scriptloom.operators.lint import annotate, with_conversion_status, with_verdict
from scriptloom.operators.metadata import with_block_type, with_chunk_id, with_counts
from scriptloom.operators.split import chunk_scripts, structured_chunks


def chunk_preview(scripts: DataFrame, **cascade_options) -> DataFrame:
    """Chunks by the strategy cascade with serial, id, type and counts."""
    chunks = chunk_scripts(scripts, **cascade_options)
    return with_counts(with_block_type(with_chunk_id(chunks, dense=True)))


def block_mapping(scripts: DataFrame, conv: DataFrame, **cascade_options) -> DataFrame:
    """Chunk, pair with converted text, check and annotate. `conv` holds
    (script_id, chunk_no, converted)."""
    return with_conversion_status(map_chunks(chunk_preview(scripts, **cascade_options), conv))


def audit_report(scripts: DataFrame, conv: DataFrame, **cascade_options) -> DataFrame:
    """The mapping in report columns."""
    return audit_table(block_mapping(scripts, conv, **cascade_options))


def final_scripts(converted_chunks: DataFrame, *, code_col: str = "converted") -> DataFrame:
    """One checked and annotated script per script id, from its converted chunks. A script
    that lacks a chunk has `n_missing` above 0 and is not valid."""
    whole = assemble(converted_chunks, code_col=code_col, missing_as="n_missing")
    checked = annotate(with_verdict(whole.withColumnRenamed(code_col, "code")), out_col="annotated")
    return checked.withColumn("is_valid", F.col("is_valid") & (F.col("n_missing") == 0))


def structured_new(
    scripts: DataFrame, seen: DataFrame, max_lines: int = fixed.MAX_LINES_PER_CHUNK
) -> DataFrame:
    """Structured chunks of the scripts that are not in `seen`."""
    return structured_chunks(only_new(scripts, seen), max_lines)


def line_totals(chunks: DataFrame) -> DataFrame:
    """Chunks and lines per number of lines in a chunk."""
    return with_counts(chunks).groupBy("line_count").agg(
        F.count("*").alias("n_chunks"), F.sum("n_chars").alias("n_chars")
    )
