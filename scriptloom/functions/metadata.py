"""SQL expressions for chunk metadata."""

from __future__ import annotations

from scriptloom.functions import fixed_values as fixed
from scriptloom.functions.sql import literal
from scriptloom.functions.text import lstrip


def chunk_id(number: str) -> str:
    return f"format_string('{fixed.CHUNK_ID_FORMAT}', {number})"


def header_pattern() -> str:
    ws = f"[{fixed.WS}]+"
    types = "|".join(t.replace(" ", ws) for t in fixed.HEADER_TYPES)
    return rf"(?i)\bCREATE{ws}(?:OR{ws}REPLACE{ws})?({types})\b"


def block_type(code: str) -> str:
    """Type of the first header anywhere in the code; else by the first word."""
    header = f"regexp_extract({code}, {literal(header_pattern())}, 1)"
    return (
        f"CASE WHEN {header} <> '' THEN"
        f" regexp_replace(upper({header}), {literal(f'[{fixed.WS}]+')}, '_')"
        f" WHEN upper(substring({lstrip(code)}, 1, 5)) = 'BEGIN' THEN '{fixed.ANONYMOUS_BLOCK}'"
        f" ELSE '{fixed.UNKNOWN_BLOCK}' END"
    )
