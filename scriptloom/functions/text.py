"""SQL expressions on one text cell."""

from __future__ import annotations

from scriptloom.functions.fixed_values import WHITESPACE
from scriptloom.functions.sql import case, let, literal

_WHITESPACE = literal(WHITESPACE)


def strip(text: str) -> str:
    """Trim every kind of white space, not only spaces."""
    return f"trim(BOTH {_WHITESPACE} FROM {text})"


def rstrip(text: str) -> str:
    return f"trim(TRAILING {_WHITESPACE} FROM {text})"


def lstrip(text: str) -> str:
    return f"trim(LEADING {_WHITESPACE} FROM {text})"


def is_blank(text: str) -> str:
    return f"({strip(text)} = '')"


def unix_newlines(text: str) -> str:
    """CRLF and CR become LF. The pattern runs only on texts that hold a CR."""
    return case(
        rf"contains({text}, '\r')", rf"regexp_replace({text}, r'\r\n?', '\n')", text
    )


def without_comments(text: str) -> str:
    """Drop block comments, then line comments. Blind to string literals; an unclosed
    block comment stays."""
    # Up to the last closing mark each opening mark finds its end; beyond it none would,
    # and each would search the whole rest for one.
    no_blocks = case(
        f"contains({text}, '/*')",
        let(
            rf"regexp_extract({text}, r'(?s)\A.*\*/', 0)",
            lambda closed: rf"concat(regexp_replace({closed}, r'(?s)/\*.*?\*/', ''),"
            f" substring({text}, length({closed}) + 1))",
            "closed",
        ),
        text,
    )
    return rf"regexp_replace({no_blocks}, r'--[^\n]*', '')"


def is_comment_only(text: str) -> str:
    """Every line is blank or starts, after trimming, with two dashes."""
    line = lstrip("line")
    return rf"forall(split({text}, '\n'), line -> ({line} = '' OR startswith({line}, '--')))"


def count_of(text: str, char: str) -> str:
    """Occurrences of one ASCII character."""
    return f"(octet_length({text}) - octet_length(replace({text}, '{char}', '')))"


def line_count(text: str) -> str:
    return f"({count_of(text, chr(92) + 'n')} + 1)"
