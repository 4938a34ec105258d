"""Splitters as SQL expressions: one text cell in, an ordered array out.

All of them are linear in the text and stay inside the row, so a job that uses them is a
scan and a projection: no exchange, and a script never waits for another.
"""

from __future__ import annotations

import re

from scriptloom.functions import fixed_values as fixed
from scriptloom.functions.sql import (
    case,
    each,
    groups_ending_at,
    keep,
    let,
    literal,
    positions,
    scan,
)
from scriptloom.functions.text import (
    is_blank,
    is_comment_only,
    line_count,
    rstrip,
    strip,
    unix_newlines,
)


def _stripped(pieces: str) -> str:
    return keep(each(pieces, strip, "piece"), lambda piece: f"{piece} <> ''", "piece")


def _joined(runs: str) -> str:
    return each(runs, lambda run: rf"array_join({run}, '\n')", "run")


def by_delimiter(text: str, delimiter: str = fixed.BLOCK_DELIMITER) -> str:
    """Blocks between lines that hold nothing but the delimiter."""
    gap = f"[{fixed.WS_IN_LINE}]*+"
    line = literal(rf"\n{gap}{re.escape(delimiter)}{gap}(?=\n|\z)")
    pieces = let(
        unix_newlines(text),
        lambda unix: case(
            f"contains({unix}, {literal(delimiter)})",
            rf"split(concat('\n', {unix}), {line})",
            f"array({unix})",
        ),
        "unix",
    )
    return _stripped(pieces)


def by_lines(text: str, n: int = fixed.LINES_PER_CHUNK) -> str:
    """`n` lines each, the last may be shorter; nothing is trimmed or normalised."""
    return let(
        rf"split({text}, '\n')",
        lambda lines: each(
            f"sequence(0, size({lines}) - 1, {n})",
            lambda first: rf"array_join(slice({lines}, {first} + 1, {n}), '\n')",
            "first",
        ),
        "lines",
    )


def block_pattern(leading_ws: str = "skip") -> str:
    """Alternatives in order: created object, DECLARE block, BEGIN block, any text up to
    a semicolon, and the unterminated rest."""
    if leading_ws not in ("skip", "literal"):
        raise ValueError("leading_ws is 'skip' or 'literal'")
    ws = f"[{fixed.WS}]"
    objects = "|".join(fixed.CREATED_OBJECTS)
    openers = "|".join(
        [rf"CREATE{ws}+(?:OR{ws}+REPLACE{ws}+)?(?:{objects})", "DECLARE", "BEGIN"]
    )
    skipped = f"{ws}*+" if leading_ws == "skip" else ""
    return rf"(?ius){skipped}(?:{openers}).*?END{ws}*;|[^;]+;|[^;]+\z"


def is_terminated(block: str) -> str:
    return f"endswith({block}, ';')"


def by_pattern(text: str, leading_ws: str = "skip", tail: str = "keep") -> str:
    """Blocks found from left to right; `tail` says what becomes of the text after the
    last semicolon."""
    if tail not in ("keep", "drop"):
        raise ValueError("tail is 'keep' or 'drop'")
    pattern = literal(block_pattern(leading_ws))
    last_end = literal(rf"(?is)\A.*END[{fixed.WS}]*;")

    def matches(unix: str) -> str:
        # Up to the last END; each block word finds its end. Beyond it none would, and
        # each would search the whole rest for one; only statements are left there.
        return let(
            f"regexp_extract({unix}, {last_end}, 0)",
            lambda head: f"concat(regexp_extract_all({head}, {pattern}, 0), regexp_extract_all("
            rf"substring({unix}, length({head}) + 1), r'[^;]+;|[^;]+\z', 0))",
            "head",
        )

    found = _stripped(let(unix_newlines(text), matches, "unix"))
    blocks = keep(found, lambda block: f"{block} <> {literal(fixed.BLOCK_DELIMITER)}", "block")
    return keep(blocks, is_terminated, "block") if tail == "drop" else blocks


def opens_block(text: str) -> str:
    head = f"upper(substring({text}, 1, {max(map(len, fixed.BLOCK_OPENERS))}))"
    return "(" + " OR ".join(f"startswith({head}, '{w}')" for w in fixed.BLOCK_OPENERS) + ")"


def by_statement(text: str) -> str:
    """A block that opens with a block word stays whole; other text is cut after each
    semicolon. Parts without text are left out."""

    def cut(block: str) -> str:
        parts = _stripped(rf"regexp_extract_all({block}, r'[^;]*;|[^;]+\z', 0)")
        full = keep(parts, lambda part: f"NOT {is_blank(f'rtrim({chr(39)};{chr(39)}, {part})')}")
        return case(opens_block(block), f"array({block})", full)

    return let(strip(text), cut, "block")


def before_begin(text: str, max_chars: int = fixed.MAX_CHUNK_CHARS) -> str:
    """Cut in front of each BEGIN, only where the text is longer than `max_chars`."""
    return let(
        strip(text),
        lambda block: case(
            f"length({block}) > {max_chars}",
            _stripped(f"split({block}, r'(?iu)(?=BEGIN)')"),
            keep(f"array({block})", lambda b: f"{b} <> ''"),
        ),
        "block",
    )


def by_size(text: str, max_chars: int = fixed.MAX_CHUNK_CHARS) -> str:
    """Texts over `max_chars` become runs of semicolon parts; a run closes with the part
    that takes it over `max_chars`."""

    def total(before: str, length: str) -> str:
        grown = f"{before} + {length} + 1"
        return case(f"{grown} > {max_chars}", "0", grown)

    def regrouped(parts: str) -> str:
        def cut(totals: str) -> str:
            ends = keep(
                positions(totals), lambda i: f"(get({totals}, {i} - 1) = 0 OR {i} = size({totals}))"
            )

            def chunk(run: str) -> str:
                closed = each(run, lambda part: f"concat({part}, ';')", "part")
                return strip(rf"array_join({closed}, '\n')")

            return let(ends, lambda at: each(groups_ending_at(parts, at), chunk, "run"), "at")

        lengths = each(parts, lambda part: f"length({part})", "part")
        return let(scan(lengths, "0", total, "int"), cut, "totals")

    parts = keep(f"split({text}, ';')", lambda part: f"NOT {is_blank(part)}", "part")
    return case(f"length({text}) > {max_chars}", let(parts, regrouped, "parts"), f"array({text})")


def refined(block: str, max_chars: int = fixed.MAX_CHUNK_CHARS) -> str:
    """Statements, cut before BEGIN, then by size; chunks made of comments only go."""
    pieces = f"flatten({each(by_statement(block), lambda s: before_begin(s, max_chars))})"
    chunks = f"flatten({each(pieces, lambda p: by_size(p, max_chars))})"
    return keep(chunks, lambda c: f"NOT {is_blank(c)} AND NOT {is_comment_only(c)}", "chunk")


def batched(
    fragments: str,
    small: int = fixed.SMALL_FRAGMENT_CHARS,
    cap: int = fixed.BATCH_FLUSH_CHARS,
) -> str:
    """Join neighbouring fragments shorter than `small` until they exceed `cap` chars;
    longer fragments stand alone."""
    alone, closed = -1, 0

    def buffered(state: str, length: str) -> str:
        grown = f"greatest({state}, 0) + {length}"
        return case(
            f"{length} >= {small}", str(alone), case(f"{grown} > {cap}", str(closed), grown)
        )

    def join_runs(kept: str) -> str:
        def cut(states: str) -> str:
            ends = keep(
                positions(states),
                lambda i: f"(get({states}, {i} - 1) <= 0"
                f" OR coalesce(get({states}, {i}), {alone}) = {alone})",
            )
            return let(ends, lambda at: _joined(groups_ending_at(kept, at)), "at")

        lengths = each(kept, lambda fragment: f"length({fragment})")
        return let(scan(lengths, "0", buffered, "int"), cut, "states")

    return let(keep(fragments, lambda f: f"NOT {is_blank(f)}", "fragment"), join_runs, "kept")


def cascade(
    text: str,
    max_chars: int = fixed.MAX_CHUNK_CHARS,
    lines: int = fixed.LINES_PER_CHUNK,
    delimiter: str = fixed.BLOCK_DELIMITER,
    leading_ws: str = "skip",
    tail: str = "keep",
) -> str:
    """Struct of the strategy that applied and its chunks.

    CASE branches are evaluated on demand, so the pattern runs only on scripts that the
    delimiter left whole, and the line count only where both did.
    """

    def tagged(strategy: str, chunks: str) -> str:
        return f"named_struct('strategy', '{strategy}', 'chunks', {chunks})"

    def batched_blocks(blocks: str) -> str:
        def fine(block: str) -> str:
            coarse = f"length({block}) > {max_chars} OR {opens_block(block)}"
            return case(coarse, refined(block, max_chars), f"array({block})")

        return batched(f"flatten({each(blocks, fine, 'block')})")

    def by_other_means(found: str) -> str:
        return case(
            f"size({found}) > 1",
            tagged("pattern", batched_blocks(found)),
            tagged("lines", by_lines(text, lines)),
        )

    return let(
        by_delimiter(text, delimiter),
        lambda blocks: case(
            f"size({blocks}) > 1",
            tagged("delimiter", blocks),
            let(by_pattern(text, leading_ws, tail), by_other_means, "found"),
        ),
        "blocks",
    )


def text_lines(text: str) -> str:
    """Lines at any line boundary; a boundary at the end opens no further line.

    The pattern of all boundaries runs only on texts that hold a rare one.
    """

    def lines(whole: str) -> str:
        rare = " OR ".join(
            f"contains({whole}, {literal(mark)})" for mark in fixed.RARE_LINE_BOUNDARIES
        )
        return case(
            rare,
            f"split({whole}, {literal(fixed.LINE_BOUNDARY)})",
            rf"split({unix_newlines(whole)}, '\n')",
        )

    return let(
        let(text, lines, "whole"),
        lambda ls: case(f"element_at({ls}, -1) = ''", f"slice({ls}, 1, size({ls}) - 1)", ls),
        "lines",
    )


def depth_step(line: str) -> str:
    """Change of depth: one up if the line holds BEGIN, one down if it holds END."""
    return (
        f"(CAST(contains(upper({line}), 'BEGIN') AS int)"
        f" - CAST(contains(upper({line}), 'END') AS int))"
    )


def next_depth(depth: str, step: str) -> str:
    return f"greatest({depth} + {step}, 0)"


def depths(lines: str) -> str:
    """Nesting depth after each line, never below 0."""
    return scan(each(lines, depth_step, "line"), "0", next_depth, "int")


def lines_with_depth(text: str) -> str:
    """Array of (line, depth)."""

    def zipped(lines: str) -> str:
        return let(
            depths(lines),
            lambda depth: f"transform({lines}, (line, i) ->"
            f" named_struct('line', line, 'depth', get({depth}, i)))",
            "depths",
        )

    return let(text_lines(text), zipped, "lines")


def by_top_level(text: str) -> str:
    """Blocks that end with a lone slash outside any nesting; the slash stays."""
    mark = literal(fixed.BLOCK_DELIMITER)

    def whole(lines: str) -> str:
        return rstrip(rf"array_join({lines}, '\n')")

    def cut(lines: str) -> str:
        slashes = keep(
            positions(lines),
            lambda i: f"contains(get({lines}, {i} - 1), {mark})"
            f" AND {strip(f'get({lines}, {i} - 1)')} = {mark}",
        )

        def at_depth_0(marks: str) -> str:
            outer = let(
                depths(lines),
                lambda depth: keep(marks, lambda i: f"get({depth}, {i} - 1) = 0"),
                "depth",
            )
            ends = f"array_distinct(concat({outer}, array(size({lines}))))"
            return let(ends, lambda at: each(groups_ending_at(lines, at), whole, "run"), "at")

        # depth matters only where there is a slash to judge
        return let(
            slashes,
            lambda marks: case(
                f"size({lines}) = 0",
                "CAST(array() AS array<string>)",
                case(f"size({marks}) = 0", f"array({whole(lines)})", at_depth_0(marks)),
            ),
            "marks",
        )

    return let(text_lines(text), cut, "lines")


def by_safe_lines(block: str, max_lines: int = fixed.MAX_LINES_PER_CHUNK) -> str:
    """A block of up to `max_lines` stays; else it is cut at the first safe line once the
    open chunk has `max_lines` lines. Safe: depth 0, line ends with `;` or `/`."""

    # Line and state are numbers: 2 * (change of depth) + (line ends a statement), and
    # depth * 2^32 + (lines held).
    held = "4294967296"

    def traits(line: str) -> str:
        ends = f"CAST(substring({rstrip(line)}, -1, 1) IN (';', '/') AS int)"
        return f"(2 * {depth_step(line)} + {ends})"

    def next_state(state: str, line: str) -> str:
        depth = next_depth(f"shiftright({state}, 32)", f"shiftright({line}, 1)")
        grown = f"{state} % {held} + 1"
        full = f"{depth} = 0 AND {line} & 1 = 1 AND {grown} >= {max_lines}"
        return f"({depth} * {held} + {case(full, '0', grown)})"

    def cut(lines: str) -> str:
        def chunks(states: str) -> str:
            ends = keep(
                positions(lines),
                lambda i: f"(get({states}, {i} - 1) % {held} = 0 OR {i} = size({lines}))",
            )
            return let(ends, lambda at: _joined(groups_ending_at(lines, at)), "at")

        states = scan(each(lines, traits, "line"), "0", next_state, "bigint")
        return let(states, chunks, "states")

    return case(
        f"{line_count(block)} <= {max_lines}",
        f"array({block})",
        let(rf"split({block}, '\n')", cut, "lines"),
    )


def structured(text: str, max_lines: int = fixed.MAX_LINES_PER_CHUNK) -> str:
    """Top-level blocks, the long ones cut at safe lines."""
    chunks = each(by_top_level(text), lambda block: by_safe_lines(block, max_lines), "block")
    return f"flatten({chunks})"
