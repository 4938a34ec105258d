"""Projections and filters on one text column."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptloom.functions import text as tx
from scriptloom.functions.sql import name


def normalize_newlines(df: DataFrame, col: str = "source") -> DataFrame:
    """CRLF and CR become LF."""
    return df.withColumn(col, F.expr(tx.unix_newlines(name(col))))


def strip_comments(df: DataFrame, col: str = "source") -> DataFrame:
    """Remove block and line comments."""
    return df.withColumn(col, F.expr(tx.without_comments(name(col))))


def drop_blank(df: DataFrame, col: str = "code") -> DataFrame:
    """Trim the text and drop rows that have none."""
    return df.withColumn(col, F.expr(tx.strip(name(col)))).filter(F.col(col) != "")


def drop_comment_only(df: DataFrame, col: str = "code") -> DataFrame:
    """Drop rows whose every line is blank or a line comment."""
    return df.filter(F.expr(f"NOT {tx.is_comment_only(name(col))}"))
