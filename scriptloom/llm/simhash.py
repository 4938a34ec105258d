"""Near-duplicates by SimHash, joined on a grid of per-segment bit counts.

A fingerprint is embedded as the bit counts of its segments. Two fingerprints that differ in d
bits have embeddings at Manhattan distance d or less, so a grid join on embeddings finds every
link; the bits are then compared exactly. For two differing bits, each fingerprint enters its
own cell and the cells one step away, and linked fingerprints meet in a cell; which steps are
needed follows from how their bit counts differ, so a pair meets in one kind of cell.

Defined results: null text is empty; text of fewer words than a shingle is one shingle; text
without words has fingerprint zero and links like any other; equal fingerprints are one node,
so copies cost nothing; repeated rows each get a row; a null doc_id is never the smallest
unless all are null. Other columns are ignored, but for those asked for by name.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptloom.llm.common import durable, utf8
from scriptloom.llm.components import components

SEED = 42
SEGMENT_BITS = 4
SEGMENTS = 64 // SEGMENT_BITS
BLOCK = 1 << 16


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """XXH64 of each run of `width` words, space-joined; of all words if there are fewer."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) < width:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = (ends - np.fromiter(map(len, words), np.int64, len(words)) - 1).tolist()
    stops = (ends - 1).tolist()[width - 1 :]
    digest = xxhash.xxh64_intdigest
    return np.fromiter(
        (digest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=False)), np.uint64, len(stops)
    )


def fingerprint(hashes: np.ndarray) -> int:
    """Bit i is set if it is set in more than half of the hashes."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), BLOCK):
        block = hashes[at : at + BLOCK].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(sum(1 << i for i in np.flatnonzero(2 * ones > len(hashes)).tolist()))


def fingerprints(text: Column, width: int = 3) -> Column:
    """Fingerprint of a text column as a signed long."""

    @F.arrow_udf("long")
    def simhash(texts: pa.Array) -> pa.Array:
        found = [fingerprint(shingle_hashes(t, width)) for t in utf8(texts)]
        return pa.array(np.array(found, np.uint64).view(np.int64))

    return simhash(text)


def embedding(fp: Column) -> list[Column]:
    """Bits set in each segment."""
    mask = (1 << SEGMENT_BITS) - 1
    return [
        F.bit_count(F.shiftright(fp, SEGMENT_BITS * i).bitwiseAND(F.lit(mask)))
        for i in range(SEGMENTS)
    ]


def links(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints `fp` that differ in one or two bits.

    A cell is written as one long, four bits a segment. Embeddings at distance 0 share their
    own cell; at distance 1 one's own cell is a step up from the other; at distance 2 a step
    up from both, or a step up from one and down from the other. The comparison of bits is
    part of the join condition, so only links leave the join.
    """
    own = F.lit(0).cast("long")
    counts = embedding(F.col("fp"))
    for i, count in enumerate(counts):
        own = own.bitwiseOR(F.shiftleft(count.cast("long"), SEGMENT_BITS * i))
    one = [F.lit(1).cast("long") * (1 << (SEGMENT_BITS * i)) for i in range(SEGMENTS - 1)]
    one.append(F.lit(1 << (SEGMENT_BITS * (SEGMENTS - 1))).cast("long"))
    step = lambda kind, cell, possible: F.when(
        possible, F.struct(F.lit(kind).alias("kind"), cell.alias("cell"))
    )
    cells = [F.struct(F.lit("own").alias("kind"), F.col("own").alias("cell"))]
    for i in range(SEGMENTS):
        value = F.shiftright(F.col("own"), SEGMENT_BITS * i).bitwiseAND(F.lit(15))
        cells.append(step("up", F.col("own") + one[i], value < SEGMENT_BITS))
        cells.append(step("down", F.col("own") - one[i], value > 0))
    placed = (
        nodes.select("fp")
        .withColumn("own", own)
        .select("fp", F.explode(F.array_compact(F.array(*cells))).alias("c"))
        .select("fp", "c.kind", "c.cell")
    )
    left = placed.filter("kind <> 'down'").select(
        "cell", F.col("fp").alias("a"), F.col("kind").alias("ka")
    )
    right = placed.select("cell", F.col("fp").alias("b"), F.col("kind").alias("kb"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2
    # own-own and up-up are symmetric, so one order of the pair is enough
    meet = F.expr(
        "(ka = 'own' AND kb = 'own' AND a < b) OR (ka = 'up' AND kb = 'up' AND a < b)"
        " OR (ka = 'up' AND kb = 'own') OR (ka = 'up' AND kb = 'down' AND a <> b)"
    )
    return left.join(right, (left.cell == right.cell) & near & meet).select("a", "b").distinct()


def near_duplicates(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 3,
    carry: Sequence[str] = (),
) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row: the smallest doc_id
    that can be reached over links of at most two differing bits. `carry` names columns of
    `docs` that come along as the struct `carried`, and then so does `component`, a fingerprint
    that tells components apart even where their doc_ids are null or repeated."""
    prints = durable(
        docs.select(
            F.col(id_col).alias("doc_id"),
            fingerprints(F.col(text_col), width).alias("fp"),
            F.struct(*carry).alias("carried") if carry else F.lit(None).alias("carried"),
        )
    )
    nodes = durable(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(nodes))
    member = durable(
        nodes.join(roots, nodes.fp == roots.node, "left").select(
            "fp", "least", F.coalesce("root", "fp").alias("root")
        )
    )
    named = durable(member.groupBy("root").agg(F.min("least").alias("component_id")))
    classes = durable(member.join(named, "root").select("fp", "root", "component_id"))
    return prints.join(classes, "fp").select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
        *([F.col("root").alias("component"), "carried"] if carry else []),
    )
