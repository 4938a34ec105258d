"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only.

Documents of a source queue in a shuffled order that depends on their identifiers alone. Each
copy of a document gets a virtual finish time: the words of its source up to and with it,
divided by the source's target. At time 1 every source has delivered its target. The copies
that start by time 1 are range-sorted by finish time over all sources, and the mix is the
longest prefix within the word budget.

Defined results: null text has size 0 and is never taken; null sources are one source, the
last; repeated rows queue one after another; ties in finish time go by source, shuffle
position and copy; with no words at all every target is 0. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptloom.llm.common import WORD, durable, id_text


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(
    sizes: DataFrame, *, weights: Sequence[int] = (1, 2, 3), max_repeats: int = 3
) -> DataFrame:
    """One row per source of (source, size): its place, words, rows and target.

    Targets share all words by weight and stop at `max_repeats` times the source's words.
    In ascending order of cap / weight the capped sources come first; the level of the rest is
    what the caps leave over, divided by the weights that are left, and is largest where the
    first uncapped source stands. Works on one row per source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ahead = Window.orderBy("ratio", "place").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    weight = F.element_at(
        F.array(*[F.lit(w) for w in weights]), (F.col("place") - 1) % len(weights) + 1
    )
    stats = (
        sizes.groupBy("source")
        .agg(F.sum("size").alias("source_size"), F.count("*").alias("source_rows"))
        .withColumn("place", F.row_number().over(by_name))
        .withColumn("weight", weight)
        .withColumn("cap", F.col("source_size") * max_repeats)
        .withColumn("ratio", F.col("cap").cast("double") / F.col("weight"))
    )
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(ahead), F.lit(0))
    share = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(ahead), F.lit(0))
    return (
        stats.withColumn("level", left.cast("double") / share)
        .withColumn("top", F.max("level").over(everything))
        .select(
            "source",
            "place",
            "source_size",
            "source_rows",
            F.when(F.col("ratio") <= F.col("level"), F.col("cap").cast("double"))
            .otherwise(F.col("weight") * F.col("top"))
            .alias("target"),
        )
    )


def fair_mix(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
    source_col: str = "source", weights: Sequence[int] = (1, 2, 3), max_repeats: int = 3,
) -> DataFrame:
    """One row per row of `docs`: doc_id, source, size, source_size, target, taken.

    The running sum within a source is taken in slices, which are ranges of sources and their
    shuffle order down to the single row, plus the sums of the source's slices ahead. So a
    source, or an identifier, that holds a third of all rows spreads over tasks. Text is read
    once, for the sizes.
    """
    sizes = durable(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.col(source_col).alias("source"),
            word_count(F.col(text_col)).alias("size"),
        )
    ).withColumn("row", F.monotonically_increasing_id())
    targets = durable(
        source_targets(sizes, weights=weights, max_repeats=max_repeats)
    ).withColumnRenamed("source", "own")
    shuffle = F.md5(id_text("doc_id").cast("binary"))
    own_turn = ["place", "shuffle", "doc_id", "size", "row"]
    queued = durable(
        sizes.join(targets, F.col("source").eqNullSafe(F.col("own")))
        .drop("own")
        .withColumn("shuffle", shuffle)
        .repartitionByRange(*own_turn)
        .withColumn("slice", F.spark_partition_id())
    )
    sums = queued.groupBy("place", "slice").agg(F.sum("size").alias("words"))
    before = F.sum("words").over(Window.partitionBy("place").orderBy("slice")) - F.col("words")
    ahead = durable(sums.select("place", "slice", before.alias("before")))
    order = Window.partitionBy("place", "slice").orderBy(*own_turn[1:])
    running = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))
    placed = (
        queued.withColumn("within", running)
        .join(ahead, ["place", "slice"])
        .withColumn("upto", F.col("before") + F.col("within"))
    )
    starts = (F.col("copy") * F.col("source_size") + F.col("upto") - F.col("size")) <= F.col(
        "target"
    )
    finish = (F.col("copy") * F.col("source_size") + F.col("upto")) / F.nullif(
        F.col("target"), F.lit(0.0)
    )
    copies = (
        placed.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(max_repeats - 1))))
        .withColumn("starts", starts)
        .filter(F.col("starts") | (F.col("copy") == 0))
        .withColumn("finish", F.when(F.col("starts"), finish))
        .withColumn("words", F.when(F.col("starts"), F.col("size")).otherwise(F.lit(0)))
    )
    turn = [F.col("finish").asc_nulls_last(), "place", "shuffle", "doc_id", "size", "copy", "row"]
    in_order = durable(
        copies.repartitionByRange(*turn)
        .sortWithinPartitions(*turn)
        .withColumn("part", F.spark_partition_id())
    )
    parts = in_order.groupBy("part").agg(F.sum("words").alias("in_part"))
    ahead_of = F.sum("in_part").over(Window.orderBy("part")) - F.col("in_part")
    budget = sizes.agg(F.sum("size").alias("n")).scalar()
    offsets = durable(parts.select("part", ahead_of.alias("earlier"), budget.alias("budget")))
    reach = F.sum("words").over(
        Window.partitionBy("part").orderBy(*turn).rowsBetween(Window.unboundedPreceding, 0)
    )
    taken = F.col("starts") & (F.col("earlier") + F.col("reach") <= F.col("budget"))
    rows = ["row", "doc_id", "source", "size", "source_size", "target"]
    return (
        in_order.withColumn("reach", reach)
        .join(offsets, "part")
        .groupBy(*rows)
        .agg(F.sum(F.when(taken, F.col("size")).otherwise(F.lit(0))).alias("taken"))
        .select("doc_id", "source", "size", "source_size", "target", "taken")
    )
