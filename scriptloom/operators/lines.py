"""Splitting scripts that are larger than one cell: a row for each line or part.

Input: rows with key columns, an integer `order` that is unique within the key, and a text. The
rows of one script spread over all tasks, and no text is collected: results are numbers beside
the rows, such as the chunk that a row belongs to. Row by row they are what the splitters of
`split` find in a cell that holds the same lines. A NULL key, number or text raises.

Depth is a running sum that never falls below 0, and so comes from running sums and their least
values, which combine over spans of rows. A rule that carries a state from row to row is worked
out for runs of rows from every state there is; a run is then a map from state to state, maps
combine, and once the state before each run is known its rows follow.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptloom.functions import fixed_values as fixed
from scriptloom.functions import splitting as sp
from scriptloom.functions.sql import each, fresh, let, literal, name, scan
from scriptloom.functions.text import is_blank, rstrip, strip
from scriptloom.operators.keyed import in_spans, numbered, present, running
from scriptloom.operators.split import KEYS
from scriptloom.session import kept

#: Rows of a run, rows of a run that are folded at once, and runs that are combined at once.
RUN_ROWS = 2048
BLOCK_ROWS = 64
RUNS = 512


def depth_of_lines(
    df: DataFrame, *, keys: Sequence[str] = KEYS, order: str = "line_no", text_col: str = "line",
    depth_as: str = "depth",
) -> DataFrame:
    """Nesting depth after each line, never below 0."""
    step = F.expr(sp.depth_step(name(text_col)))
    out = running(present(df, [text_col]), keys, order, step, "_up", "_least")
    depth = (F.col("_up") - F.least("_least", F.lit(0))).cast("int")
    return out.withColumn(depth_as, depth).drop("_up", "_least")


def top_level_of_lines(
    df: DataFrame, *, keys: Sequence[str] = KEYS, order: str = "line_no", text_col: str = "line",
    block_as: str = "block_no",
) -> DataFrame:
    """The block of each line; a lone slash outside any nesting is its block's last line."""
    mark = f"({strip(name(text_col))} = {literal(fixed.BLOCK_DELIMITER)} AND _depth = 0)"
    rows = in_spans(df, keys, order)
    deep = depth_of_lines(rows, keys=keys, order=order, text_col=text_col, depth_as="_depth")
    closes = deep.withColumn("_closes", F.expr(f"CAST({mark} AS int)")).drop("_depth")
    out = running(closes, keys, order, F.col("_closes"), "_marks")
    return out.withColumn(block_as, F.col("_marks") - F.col("_closes") + 1).drop("_marks", "_closes", "_span")


def _state_map(values: str, states: str, step: Callable[[str, str], str]) -> str:
    """The state after `values` from each of `states`. After some rows few different states are
    left, so each block of rows starts from the different ones only."""
    acc, item = fresh("acc"), fresh("item")

    def over_block(now: str, block: str) -> str:
        def moved(different: str) -> str:
            fold = lambda s: f"aggregate({block}, {s}, ({acc}, {item}) -> CAST({step(acc, item)} AS int))"
            return let(
                each(different, fold, "state"),
                lambda after: each(now, lambda s: f"element_at({after}, CAST(array_position({different}, {s}) AS int))", "s"),
                "after",
            )

        return let(f"array_distinct({now})", moved, "different")

    firsts = f"sequence(1, size({values}), {BLOCK_ROWS})"
    blocks = each(firsts, lambda first: f"slice({values}, {first}, {BLOCK_ROWS})", "first")
    now, block = fresh("now"), fresh("block")
    return f"aggregate({blocks}, {states}, ({now}, {block}) -> {over_block(now, block)})"


def _states_before(maps: str, start: str) -> str:
    """The state before each of `maps`, which are applied one after another."""
    after = scan(maps, start, lambda state, m: f"element_at({m}, {state} + 1)", "int")
    return let(after, lambda a: f"concat(array({start}), slice({a}, 1, size({a}) - 1))", "states")


def _ordered(place: str, value: str) -> str:
    return f"transform(array_sort(collect_list(struct({place}, {value}))), p -> p.{value})"


def _grouped_rows(
    df: DataFrame, keys: Sequence[str], order: str, value: str, n_states: int,
    step: Callable[[str, str], str], starts: Callable[[str, str], str], group_as: str,
) -> DataFrame:
    """Number of the group of each row. States are 0 to n_states - 1 and begin with 0;
    `step(state, value)` is the state after a row, and `starts(state before, value)` says whether
    the row begins a group."""
    keys = list(keys)
    # used three times, so worked out once
    placed = kept(numbered(df, keys, order, "_row"))
    zero_up = f"sequence(0, {n_states - 1})"
    runs = (
        placed.select(*keys, "_row", F.expr(f"CAST({value} AS int)").alias("_value"))
        .withColumn("_run", F.floor((F.col("_row") - 1) / RUN_ROWS))
        .groupBy(*keys, "_run")
        .agg(F.expr(_ordered("_row", "_value")).alias("_values"))
    )
    mapped = runs.select(
        *keys, "_run", F.expr("_run DIV " + str(RUNS)).alias("_lot"),
        F.expr(_state_map("_values", zero_up, step)).alias("_map"),
    )
    # a lot of runs is one map as well, and a script's lots meet as arrays of numbers
    lots = mapped.groupBy(*keys, "_lot").agg(F.expr(_ordered("_run", "_map")).alias("_maps"))
    acc, m = fresh("acc"), fresh("m")
    through = f"aggregate(_maps, s, ({acc}, {m}) -> element_at({m}, {acc} + 1))"
    whole = lots.select(*keys, "_lot", F.expr(f"transform({zero_up}, s -> {through})").alias("_map"))
    before_lots = (
        whole.groupBy(*keys)
        .agg(F.expr(_ordered("_lot", "_map")).alias("_maps"))
        .select(*keys, F.posexplode(F.expr(_states_before("_maps", "0"))).alias("_lot", "_start"))
    )
    before_runs = (
        lots.join(before_lots.withColumn("_lot", F.col("_lot").cast("long")), [*keys, "_lot"])
        .select(*keys, "_lot", F.posexplode(F.expr(_states_before("_maps", "_start"))).alias("_nth", "_start"))
        .select(*keys, (F.col("_lot") * RUNS + F.col("_nth")).alias("_run"), "_start")
    )
    after = scan("_values", "_start", step, "int")
    before = let(after, lambda a: f"concat(array(_start), slice({a}, 1, size({a}) - 1))", "after")
    flags = f"transform(zip_with({before}, _values, (b, v) -> {starts('b', 'v')}), f -> CAST(f AS int))"
    begun = kept(runs.join(before_runs, [*keys, "_run"]).select(*keys, "_run", F.expr(flags).alias("_flags")))
    # a window over the key sees one number of a run, not its rows
    counted = begun.select(*keys, "_run", F.expr("aggregate(_flags, 0, (a, f) -> a + f)").alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    before_groups = counted.select(*keys, "_run", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    groups = begun.join(before_groups, [*keys, "_run"]).select(
        *keys,
        "_run",
        F.posexplode(F.expr(scan("_flags", "_before", lambda s, f: f"{s} + {f}", "bigint"))).alias("_nth", group_as),
    )
    numbers = groups.select(*keys, (F.col("_run") * RUN_ROWS + F.col("_nth") + 1).alias("_row"), group_as)
    return placed.join(numbers, [*keys, "_row"]).drop("_row")


def safe_chunks_of_lines(
    df: DataFrame, max_lines: int = fixed.MAX_LINES_PER_CHUNK, *, keys: Sequence[str] = KEYS,
    order: str = "line_no", text_col: str = "line", chunk_as: str = "chunk_no",
) -> DataFrame:
    """The chunk of each line of a block: a chunk ends at the first safe line once it has
    `max_lines` lines. Safe: depth 0, line ends with `;` or `/`."""
    rows = in_spans(df, keys, order)
    deep = depth_of_lines(rows, keys=keys, order=order, text_col=text_col, depth_as="_depth")
    safe = f"(_depth = 0 AND substring({rstrip(name(text_col))}, -1, 1) IN (';', '/'))"
    return _grouped_rows(
        deep.withColumn("_safe", F.expr(f"CAST({safe} AS int)")).drop("_depth"), keys, order, "_safe",
        max_lines + 1,
        lambda held, is_safe: f"CASE WHEN {is_safe} = 1 AND {held} + 1 >= {max_lines} THEN 0"
        f" ELSE least({held} + 1, {max_lines}) END",
        lambda held, is_safe: f"{held} = 0",
        chunk_as,
    ).drop("_safe", "_span")


def batch_rows(
    df: DataFrame, small: int = fixed.SMALL_FRAGMENT_CHARS, cap: int = fixed.BATCH_FLUSH_CHARS, *,
    keys: Sequence[str] = KEYS, order: str = "line_no", text_col: str = "line", batch_as: str = "batch_no",
) -> DataFrame:
    """The batch of each fragment that is not blank: neighbours shorter than `small` share one
    until they exceed `cap` characters; longer fragments stand alone."""
    text = name(text_col)
    full = present(df, [text_col]).filter(F.expr(f"NOT {is_blank(text)}"))
    grown = lambda held, n: f"{held} + {n}"
    return _grouped_rows(
        full, keys, order, f"least(length({text}), {max(small, cap + 1)})", cap + 1,
        lambda held, n: f"CASE WHEN {n} >= {small} OR {grown(held, n)} > {cap} THEN 0 ELSE {grown(held, n)} END",
        lambda held, n: f"({held} = 0 OR {n} >= {small})",
        batch_as,
    )


def size_runs(
    df: DataFrame, max_chars: int = fixed.MAX_CHUNK_CHARS, *, keys: Sequence[str] = KEYS,
    order: str = "line_no", text_col: str = "line", run_as: str = "run_no",
) -> DataFrame:
    """The run of each part that is not blank, of a text cut at its semicolons; a run closes
    with the part that takes it over `max_chars`."""
    text = name(text_col)
    full = present(df, [text_col]).filter(F.expr(f"NOT {is_blank(text)}"))
    grown = lambda held, n: f"{held} + {n} + 1"
    return _grouped_rows(
        full, keys, order, f"least(length({text}), {max_chars})", max_chars + 1,
        lambda held, n: f"CASE WHEN {grown(held, n)} > {max_chars} THEN 0 ELSE {grown(held, n)} END",
        lambda held, n: f"{held} = 0",
        run_as,
    )
