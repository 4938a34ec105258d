"""Keyed work that holds up when one key owns a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# A key is hot when it holds more than one row in HOT_SHARE; so at most HOT_SHARE keys are.
HOT_SHARE = 1000
SALTS = 64
# A key is cut into spans of its order of about 1/HOT_SHARE of all rows, and of SPAN_ROWS rows
# at least; bounds of spans are quantiles of SPAN_SAMPLE numbers a span.
SPAN_ROWS = 4096
SPAN_SAMPLE = 64
# Bits of the bitmap that says which keys a row may be one of: 4 MB whatever the data.
BITMAP_BITS = 25


def hot_keys(df: DataFrame, keys: Sequence[str], counted: bool = False) -> DataFrame:
    """Keys with more than 1/HOT_SHARE of all rows. By counting there are fewer than
    HOT_SHARE of them whatever the data, which is the size bound for broadcasting them.
    The count is combined on the map side, so the hot key itself costs nothing here. With
    `counted` the key's rows `_n` and all rows `_total` come along.

    NULL keys are left out, as every join would do. The filter is the one that a join adds by
    itself, so counts and total have one plan and share one exchange."""
    keyed = df.select(*keys).filter(reduce(and_, [F.col(key).isNotNull() for key in keys]))
    counts = keyed.groupBy(*keys).agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum("_n").alias("_total")).scalar()
    hot = counts.filter(F.col("_n") * HOT_SHARE > total)
    return hot.withColumn("_total", total) if counted else hot.select(*keys)


def join_unique(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str, spread_by: Sequence[str]
) -> DataFrame:
    """Join `left` to a frame with at most one row per key ('left', 'inner', 'left_semi'
    or 'left_anti').

    Rows of hot keys are spread over SALTS tasks by a hash of the `spread_by` columns,
    and the few matching rows of `right` are repeated once per salt. Rows with a NULL key
    match nothing and are spread as well. Other keys keep salt 0. Where `right` is small, Spark's own size check turns this into a broadcast.
    """
    keys = list(keys)
    hot = F.broadcast(hot_keys(left, keys).withColumn("_hot", F.lit(True)))
    no_key = reduce(or_, [F.col(key).isNull() for key in keys])
    salt = F.pmod(F.xxhash64(*spread_by), F.lit(SALTS)).cast("int")
    salted_left = left.join(hot, keys, "left").withColumn(
        "_salt", F.when(F.col("_hot") | no_key, salt).otherwise(F.lit(0))
    )
    salted_right = right.join(hot, keys, "left").withColumn(
        "_salt",
        F.explode(
            F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(
                F.array(F.lit(0))
            )
        ),
    )
    joined = salted_left.drop("_hot").join(
        salted_right.drop("_hot"), [*keys, "_salt"], how
    )
    added = [] if how in ("left_semi", "left_anti") else [c for c in right.columns if c not in keys]
    return joined.select(*left.columns, *added)


def present(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """`df`, which raises where one of the columns is NULL; a filter that a join adds meets it too."""
    types = dict(df.dtypes)

    def checked(c: str) -> Column:
        error = F.raise_error(F.lit(f"{c} is NULL: the row has no place")).cast(types[c])
        return F.coalesce(F.col(c), error)

    return df.withColumns({c: checked(c) for c in columns})


def spanned(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """`df` with `_span`: the place of the row's span among those of its key, and NULL for a key
    that is not hot and so is a single span.

    The bounds of a hot key's spans are quantiles of its numbers, however they lie. They come
    from the numbers whose hash a modulus picks, so they are the same however often Spark works
    them out. There are fewer than 2 * HOT_SHARE bounds over all keys, which is the size bound
    of the broadcast.
    """
    keys = list(keys)
    hot = hot_keys(df, keys, counted=True).filter(F.col("_n") > SPAN_ROWS)
    share = F.ceil(F.col("_n") * HOT_SHARE / F.col("_total"))
    sized = hot.withColumn("_spans", F.least(share, F.ceil(F.col("_n") / SPAN_ROWS)))
    each = F.greatest(F.floor(F.col("_n") / (F.col("_spans") * SPAN_SAMPLE)), F.lit(1))
    picked = (
        df.select(*keys, order)
        .join(F.broadcast(sized), keys)
        .filter(F.pmod(F.xxhash64(order), each) == 0)
        .groupBy(*keys, "_spans")
        .agg(F.sort_array(F.collect_list(order)).alias("_seen"))
    )
    quantile = F.transform(
        F.sequence(F.lit(1).cast("long"), F.col("_spans")),
        lambda i: F.get("_seen", F.floor(F.size("_seen") * (i - 1) / F.col("_spans")).cast("int")),
    )
    bounds = picked.select(*keys, quantile.alias("_bounds"))
    # by halves, as a hot key has up to HOT_SHARE bounds; beyond the last one `get` is NULL
    halves = F.array(*[F.lit(1 << i) for i in reversed(range(HOT_SHARE.bit_length()))])
    behind = F.aggregate(
        halves, F.lit(0), lambda at, half: F.when(F.get("_bounds", at + half - 1) <= F.col(order), at + half).otherwise(at)
    )
    return (
        df.join(F.broadcast(bounds), keys, "left")
        .withColumn("_span", F.when(F.col("_bounds").isNotNull(), behind))
        .drop("_bounds")
    )


def in_spans(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """`df` with `_span`, as it is if it has one, so that several scans share the spans."""
    return df if "_span" in df.columns else spanned(present(df, [*keys, order]), keys, order)


def numbered(
    df: DataFrame, keys: Sequence[str], order: str, number_as: str, total_as: str | None = None,
    tasks: int | None = None,
) -> DataFrame:
    """1-based dense number of each row within its key, in the order of the integer column
    `order`, which is unique within the key; with `total_as` the rows per key too. A NULL
    key or number raises, as such a row has no place.

    A window over the key alone puts a hot key into one task. Here the window runs over
    (key, span of order values), and hot keys get the rows of their earlier spans added, from
    one row per span. So rows are shuffled once, with `tasks` to that many tasks. There they lie in
    the order of key, span and number.
    """
    keys = list(keys)
    rows = in_spans(df, keys, order)
    within = Window.partitionBy(*keys).orderBy("_span")
    offsets = (
        rows.filter("_span IS NOT NULL")
        .groupBy(*keys, "_span")
        .agg(F.count("*").alias("_rows"))
        .select(
            *keys,
            "_span",
            (F.sum("_rows").over(within) - F.col("_rows")).alias("_before"),
            F.sum("_rows").over(Window.partitionBy(*keys)).alias("_all"),
        )
    )
    span = Window.partitionBy(*keys, "_span")
    dealt = rows.repartition(tasks, *keys, "_span") if tasks else rows
    placed = dealt.withColumn("_place", F.row_number().over(span.orderBy(order)))
    if total_as:
        placed = placed.withColumn("_here", F.count("*").over(span))
    joined = placed.join(F.broadcast(offsets), [*keys, "_span"], "left")
    out = joined.withColumn(number_as, F.coalesce("_before", F.lit(0)) + F.col("_place"))
    if total_as:
        out = out.withColumn(total_as, F.coalesce("_all", "_here"))
    return out.select(*df.columns, number_as, *([total_as] if total_as else []))


def running(
    df: DataFrame, keys: Sequence[str], order: str, step: Column, sum_as: str, least_as: str | None = None
) -> DataFrame:
    """Sum of `step` over the key's rows up to and with each row, in the order of the integer
    column `order`; with `least_as` also the least such sum so far.

    A span of rows counts as a pair, its sum and its least running sum, and pairs of spans one
    after another combine to one of that kind. So windows run within spans, and rows of hot
    keys get what the spans before theirs come to, from one row per span.
    """
    keys = list(keys)
    rows = in_spans(df, keys, order).withColumn("_step", step)
    span = Window.partitionBy(*keys, "_span").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_sum", F.sum("_step").over(span))
    if least_as:
        rows = rows.withColumn("_low", F.min("_sum").over(span))
    earlier = Window.partitionBy(*keys).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    spans = (
        rows.filter("_span IS NOT NULL")
        .groupBy(*keys, "_span")
        .agg(F.sum("_step").alias("_all"), *([F.min("_low").alias("_lowest")] if least_as else []))
        .withColumn("_before", F.coalesce(F.sum("_all").over(earlier), F.lit(0)))
    )
    if least_as:
        spans = spans.withColumn("_low_before", F.min(F.col("_before") + F.col("_lowest")).over(earlier))
    joined = rows.join(F.broadcast(spans.drop("_all", "_lowest")), [*keys, "_span"], "left")
    before = F.coalesce("_before", F.lit(0))
    out = joined.withColumn(sum_as, before + F.col("_sum"))
    if least_as:
        out = out.withColumn(least_as, F.least("_low_before", before + F.col("_low")))
    return out.select(*df.columns, sum_as, *([least_as] if least_as else []))


def may_match(rows: DataFrame, members: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The rows of `rows` with a flag `_may`: false only where `members` surely lacks the row's
    values of `columns`; a few others are let through, the more the fuller the bitmap is.

    The members' hashes set bits of a bitmap of 2^BITMAP_BITS bits, which is broadcast in pieces
    of 4 KB: its size does not grow with the data, so no row is shuffled to find this out.
    """
    at = F.pmod(F.xxhash64(*columns), F.lit(1 << BITMAP_BITS))
    bit = F.bitmap_bit_position(at)
    bitmap = members.groupBy(F.bitmap_bucket_number(at).alias("_piece")).agg(
        F.bitmap_construct_agg(bit).alias("_bitmap")
    )
    byte = F.conv(F.hex(F.substring("_bitmap", F.shiftright(bit, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    is_set = F.getbit(byte, F.pmod(bit, F.lit(8)).cast("int")) == 1
    return (
        rows.withColumn("_piece", F.bitmap_bucket_number(at))
        .join(F.broadcast(bitmap), "_piece", "left")
        .withColumn("_may", F.coalesce(is_set, F.lit(False)))
        .select(*rows.columns, "_may")
    )
