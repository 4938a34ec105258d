"""Static checks as operators: verdicts, annotation, findings and conversion errors."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptloom.functions import fixed_values as fixed
from scriptloom.functions import lint
from scriptloom.functions.sql import name

CHUNK_KEYS = ("script_id", "chunk_no")


def with_rule_flags(df: DataFrame, *, code_col: str = "code") -> DataFrame:
    """One boolean column per rule, true where the rule is broken."""
    return df.withColumns(
        {rule: F.expr(check(name(code_col))) for rule, (check, _, _) in lint.RULES.items()}
    )


def with_verdict(df: DataFrame, *, code_col: str = "code") -> DataFrame:
    """`is_valid` and the ordered `comments`."""
    code = name(code_col)
    return df.withColumns(
        {"is_valid": F.expr(lint.is_valid(code)), "comments": F.expr(lint.comments(code))}
    )


def annotate(df: DataFrame, *, code_col: str = "code", out_col: str = "annotated") -> DataFrame:
    """Comments, one per line, above the code."""
    return df.withColumn(out_col, F.expr(lint.annotated(name(code_col))))


def findings(
    df: DataFrame, *, code_col: str = "code", keys: Sequence[str] = CHUNK_KEYS
) -> DataFrame:
    """One row per chunk and broken rule."""
    return (
        df.select(*keys, F.explode(F.expr(lint.findings(name(code_col)))).alias("_hit"))
        .filter(F.col("_hit").isNotNull())
        .select(*keys, "_hit.rule", "_hit.invalidates", "_hit.message")
    )


def with_conversion_status(
    df: DataFrame, prefixes: Sequence[str] = fixed.ERROR_PREFIXES, *, code_col: str = "converted"
) -> DataFrame:
    """`status` and `error` from converted text that starts with an error prefix."""
    starts = "|".join(re.escape(prefix) for prefix in prefixes)
    code = F.col(code_col)
    failed = code.rlike(rf"\A(?:{starts})")
    message = F.regexp_extract(code, rf"(?s)\A(?:{starts}) ?(.*)\z", 1)
    return df.withColumns(
        {
            "status": F.when(code.isNull(), "missing").when(failed, "error").otherwise("ok"),
            "error": F.when(failed, message),
        }
    )
