"""Small vocabulary for SQL expressions over arrays.

The functions of this package take SQL expressions as text and return one. Long
expressions reach Spark in one piece that way; put together from column objects they take
thousands of calls and a second or more before a query starts.

A script is one cell, so order inside it is array order: the splitters work on arrays in
place and need no shuffle, window or collected group.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import count

_serial = count()


def fresh(hint: str) -> str:
    """Name of a lambda variable that no other expression uses."""
    return f"{hint}_{next(_serial)}"


def literal(text: str) -> str:
    """Raw SQL string literal, so patterns need no further escaping."""
    if "'" not in text:
        return f"r'{text}'"
    if '"' not in text:
        return f'r"{text}"'
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def name(column: str) -> str:
    return ".".join(f"`{part}`" for part in column.split("."))


def let(value: str, body: Callable[[str], str], hint: str = "x") -> str:
    """Evaluate `value` once per row and use it many times in `body`."""
    v = fresh(hint)
    return f"transform(array({value}), {v} -> {body(v)})[0]"


def each(items: str, body: Callable[[str], str], hint: str = "item") -> str:
    v = fresh(hint)
    return f"transform({items}, {v} -> {body(v)})"


def keep(items: str, body: Callable[[str], str], hint: str = "item") -> str:
    v = fresh(hint)
    return f"filter({items}, {v} -> {body(v)})"


def case(cond: str, then: str, otherwise: str) -> str:
    """Only the branch that applies is evaluated."""
    return f"CASE WHEN {cond} THEN {then} ELSE {otherwise} END"


def positions(items: str) -> str:
    """1-based positions of an array; empty for an empty array."""
    return case(f"size({items}) > 0", f"sequence(1, size({items}))", "CAST(array() AS array<int>)")


def groups_ending_at(items: str, ends: str) -> str:
    """Cut `items` after each 1-based position in the ascending array `ends`."""
    end, k = fresh("end"), fresh("k")
    before = f"coalesce(get({ends}, {k} - 1), 0)"
    return f"transform({ends}, ({end}, {k}) -> slice({items}, {before} + 1, {end} - {before}))"


def scan(items: str, zero: str, step: Callable[[str, str], str], state_type: str) -> str:
    """State after each element, as an array as long as `items`.

    `aggregate` copies its accumulator at every element, so one flat accumulator would
    cost n * n. Here the states are gathered on three levels: runs of about cbrt(n)
    elements, groups of runs, and all groups. Every level appends about cbrt(n) times, so
    the copying grows with n * cbrt(n). States should be plain numbers, which are cheap
    to copy.
    """

    def runs_of(part: str, span: str) -> str:
        firsts = f"sequence(1, size({part}), {span})"
        return each(firsts, lambda first: f"slice({part}, {first}, {span})", "first")

    def states_from(state: str, part: str, spans: list[str]) -> str:
        """The given state, then the state after each element of `part`."""
        acc, item = fresh("acc"), fresh("item")
        if not spans:
            after = f"CAST({step(f'element_at({acc}, -1)', item)} AS {state_type})"
            return f"aggregate({part}, array({state}), ({acc}, {item}) -> array_append({acc}, {after}))"
        last = f"element_at(element_at({acc}, -1), -1)"
        further = f"slice({states_from(last, item, spans[1:])}, 2, {spans[0]})"
        return (
            f"aggregate({runs_of(part, spans[0])}, array(array({state})),"
            f" ({acc}, {item}) -> array_append({acc}, {further}), {acc} -> flatten({acc}))"
        )

    def sized(whole: str) -> str:
        start = f"CAST({zero} AS {state_type})"
        states = let(
            f"greatest(16, CAST(ceil(cbrt(size({whole}))) AS int))",
            lambda n: f"slice({states_from(start, whole, [f'{n} * {n}', n])}, 2, size({whole}))",
            "span",
        )
        return case(f"size({whole}) = 0", f"CAST(array() AS array<{state_type}>)", states)

    return let(items, sized, "whole")
