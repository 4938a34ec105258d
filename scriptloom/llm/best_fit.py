"""Packing documents into fixed-length bins by best fit under conflicts.

A bin holds at most `capacity` tokens and never two documents of one source or one cluster of
copies; it carries a bitmap of each. Bins are ordered by what is left in them. A document,
longest first, goes to the bin that it fills most tightly among those it does not conflict
with: the search starts at the least residual that holds it and goes on to the next residual
with a bin free of its source, until one is free of its cluster too. A document longer than
a bin fills whole bins first, and only its rest is packed with others.

Rows are dealt to groups of about `rows_per_group` by a hash of their identifier and place in
the table, and each group is packed on its own, so a source, a cluster or an identifier (null,
say) with a third of all rows is spread like any other. Identifiers, lengths and numbers for source and cluster travel, never text.

Defined results: null length and 0 give one piece of 0 tokens that still takes a place; a null
source or cluster conflicts with nothing; repeated rows are packed each; ties go to the bin
opened first, and equal lengths are packed in order of identifier.
"""

from __future__ import annotations

from bisect import insort
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptloom.llm.common import durable, id_text


class OpenBins:
    """Bins by residual, with a tree over residuals that finds the next residual at which some
    bin lacks a source.

    Each node of the tree holds the AND of the source bitmaps of all bins below it; a set bit
    says that every bin there has the source, so the search passes the node by. Empty
    residuals count as having every source.
    """

    def __init__(self, capacity: int, all_sources: int):
        self.leaves = 1
        while self.leaves < capacity + 1:
            self.leaves *= 2
        self.full = all_sources
        self.tree = [all_sources] * (2 * self.leaves)
        self.at: list[dict[int, list[int]]] = [{} for _ in range(capacity + 1)]

    def _renew(self, residual: int) -> None:
        masks = self.at[residual]
        value = self.full
        for mask in masks:
            value &= mask
        i = residual + self.leaves
        self.tree[i] = value
        while i > 1:
            i //= 2
            value = self.tree[2 * i] & self.tree[2 * i + 1]
            if self.tree[i] == value:
                return
            self.tree[i] = value

    def put(self, residual: int, mask: int, number: int) -> None:
        insort(self.at[residual].setdefault(mask, []), number)
        self._renew(residual)

    def take(self, residual: int, mask: int, number: int) -> None:
        same = self.at[residual][mask]
        same.remove(number)
        if not same:
            del self.at[residual][mask]
        self._renew(residual)

    def next_residual(self, least: int, source: int) -> int:
        """Least residual of at least `least` with a bin that lacks `source`; -1 if none."""
        i = least + self.leaves
        while self.tree[i] & source == source:
            while i & 1:  # climb from right children
                i //= 2
                if i <= 1:
                    return -1
            i += 1
        while i < self.leaves:
            i *= 2
            if self.tree[i] & source == source:
                i += 1
        return i - self.leaves


def pack(
    lengths: Iterable[int], sources: Iterable[int], clusters: Iterable[int], capacity: int
) -> list[int]:
    """Bin number of each piece, in the order given. Sources and clusters are small numbers,
    -1 for none. Bit 0 stands for no source: an open bin never has it."""
    lengths, sources, clusters = list(lengths), list(sources), list(clusters)
    everything = (1 << (max(sources, default=-1) + 2)) - 1
    bins = OpenBins(capacity, everything)
    source_of: list[int] = []
    cluster_of: list[int] = []
    out = []
    for length, source, cluster in zip(lengths, sources, clusters, strict=True):
        bit = 1 << (source + 1)
        twin = 1 << cluster if cluster >= 0 else 0
        found, residual = None, length
        while found is None and residual <= capacity:
            residual = bins.next_residual(residual, bit)
            if residual < 0:
                break
            free = [
                n
                for mask, same in bins.at[residual].items()
                if not mask & bit
                for n in ([same[0]] if not twin else same)
                if not cluster_of[n] & twin
            ]
            found = min(free, default=None)
            residual += found is None
        if found is None:
            found, residual = len(source_of), capacity
            source_of.append(0)
            cluster_of.append(0)
        else:
            bins.take(residual, source_of[found], found)
        if source >= 0:
            source_of[found] |= bit
        cluster_of[found] |= twin
        bins.put(residual - length, source_of[found], found)
        out.append(found)
    return out


def best_fit_packing(
    docs: DataFrame, *, id_col: str = "doc_id", length_col: str = "length",
    source_col: str = "source", cluster_col: str = "cluster", capacity: int = 2048,
    rows_per_group: int = 20_000,
) -> DataFrame:
    """One row per piece of a document: doc_id, piece, n_pieces, length, bin_id, bin_start.

    `bin_id` is g, group and number within it, or w, row and piece for a bin that one document
    fills; `bin_start` is the place of the piece in its bin.
    """
    id_type = docs.schema[id_col].dataType
    narrow = durable(
        docs.select(
            id_text(id_col).alias("doc_id"),
            F.col(id_col).isNull().alias("no_id"),
            F.coalesce(F.col(length_col).cast("long"), F.lit(0)).alias("total"),
            F.xxhash64(source_col).alias("source"),
            F.col(source_col).isNull().alias("no_source"),
            F.xxhash64(cluster_col).alias("cluster"),
            F.col(cluster_col).isNull().alias("no_cluster"),
        )
    ).withColumn("row", F.monotonically_increasing_id())
    groups = max(1, -(-narrow.count() // rows_per_group))
    whole = F.floor(F.col("total") / capacity)
    each = F.explode(F.sequence(F.lit(0).cast("long"), whole - 1)).alias("piece")
    full = narrow.filter(whole > 0).select("doc_id", "no_id", "total", "row", each)
    rest = F.col("total") % capacity
    pieces = F.greatest(F.ceil(F.col("total") / capacity), F.lit(1)).cast("long")
    alone = full.select(
        "doc_id",
        "no_id",
        "piece",
        pieces.alias("n_pieces"),
        F.lit(capacity).cast("long").alias("length"),
        F.concat_ws("-", F.lit("w"), "row", "piece").alias("bin_id"),
        F.lit(0).cast("long").alias("bin_start"),
    )

    def pack_group(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(
            ["length", "doc_id", "source", "cluster"], ascending=[False, True, True, True], kind="stable"
        ).reset_index(drop=True)

        def numbers(hashes: pd.Series, absent: pd.Series) -> pd.Series:
            return pd.Series(pd.factorize(hashes)[0]).where(~absent, -1)

        rows["bin"] = pack(
            rows["length"],
            numbers(rows["source"], rows["no_source"]),
            numbers(rows["cluster"], rows["no_cluster"]),
            capacity,
        )
        rows["bin_start"] = rows.groupby("bin")["length"].cumsum() - rows["length"]
        return rows[["grp", "doc_id", "no_id", "total", "length", "bin", "bin_start"]]

    packed = (
        narrow.filter((rest > 0) | (F.col("total") == 0))
        .withColumn("length", rest)
        .withColumn("grp", F.pmod(F.xxhash64("doc_id", "row"), F.lit(groups)))
        .groupBy("grp")
        .applyInPandas(
            pack_group,
            "grp long, doc_id string, no_id boolean, total long, length long, bin long, bin_start long",
        )
        .select(
            "doc_id",
            "no_id",
            whole.cast("long").alias("piece"),
            pieces.alias("n_pieces"),
            "length",
            F.concat_ws("-", F.lit("g"), "grp", "bin").alias("bin_id"),
            "bin_start",
        )
    )
    return alone.unionByName(packed).select(
        F.when(~F.col("no_id"), F.col("doc_id")).cast(id_type).alias("doc_id"),
        "piece", "n_pieces", "length", "bin_id", "bin_start",
    )
