"""Static checks over a code column as SQL expressions: substring tests, no parsing.

Everything here compiles into whole-stage code: no higher-order function is involved.
"""

from __future__ import annotations

from scriptloom.functions import fixed_values as fixed
from scriptloom.functions.sql import literal
from scriptloom.functions.text import count_of


def _holds_any(code: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({code}, {literal(word)})" for word in words) + ")"


def no_session(code: str) -> str:
    return f"(NOT {_holds_any(code, fixed.SESSION_MARKERS)})"


def no_dataframe_api(code: str) -> str:
    return f"(NOT {_holds_any(code, fixed.DATAFRAME_MARKERS)})"


def legacy_api(code: str) -> str:
    return _holds_any(code, fixed.LEGACY_MARKERS)


def paren_mismatch(code: str) -> str:
    return f"({count_of(code, '(')} <> {count_of(code, ')')})"


def no_import(code: str) -> str:
    return f"(NOT rlike({code}, {literal(fixed.IMPORT_PATTERN)}))"


# rule name -> (check, fails the verdict, comment)
RULES = {
    "no_session": (no_session, True, fixed.MSG_NO_SESSION),
    "no_dataframe_api": (no_dataframe_api, True, fixed.MSG_NO_DATAFRAME),
    "legacy_api": (legacy_api, False, fixed.MSG_LEGACY),
    "paren_mismatch": (paren_mismatch, True, fixed.MSG_PARENS),
    "no_import": (no_import, True, fixed.MSG_NO_IMPORT),
}


def is_valid(code: str) -> str:
    return "(NOT (" + " OR ".join(c(code) for c, fails, _ in RULES.values() if fails) + "))"


def comment_text(code: str) -> str:
    """Comments of the broken rules in rule order, one per line; the passed line if none."""
    hits = ", ".join(
        f"CASE WHEN {check(code)} THEN {literal(msg)} END" for check, _, msg in RULES.values()
    )
    return rf"coalesce(nullif(concat_ws('\n', {hits}), ''), {literal(fixed.MSG_PASSED)})"


def comments(code: str) -> str:
    """The comments as an array; NULL for missing code."""
    return rf"CASE WHEN {code} IS NOT NULL THEN split({comment_text(code)}, '\n') END"


def annotated(code: str) -> str:
    return rf"concat({comment_text(code)}, '\n', {code})"


def findings(code: str) -> str:
    """Array with one (rule, invalidates, message) per rule, NULL where the rule holds."""
    hits = ", ".join(
        f"CASE WHEN {check(code)} THEN named_struct('rule', '{rule}',"
        f" 'invalidates', {str(fails).lower()}, 'message', {literal(msg)}) END"
        for rule, (check, fails, msg) in RULES.items()
    )
    return f"array({hits})"
