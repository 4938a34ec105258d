"""Hard negatives of anchors by a vertical scan with branch and bound.

Vectors are kept in blocks, column by column. For each anchor a block's columns are read in the
descending order of the anchor's magnitudes. After some columns a row's score lies between
bounds: the part summed so far plus the least and the greatest that the columns left can add,
which the columns' minima and maxima in the block give. A bitmap of candidates shrinks by these
bounds until the scores that matter are exact: for positives, rows below the k-th best lower
bound go; for negatives, rows go that lie outside all windows of the anchor's positives, or
below the k-th best row that is surely inside.

Anchors are a stated set of queries: blocks of anchors go to every block of rows, which a task
holds once while the anchors pass. What leaves a task is k rows for each anchor and window.

Defined results: rows with a null label or vector, or with a null or non-finite component, take
no part; vectors of different lengths are compared as if zeros followed the shorter; a null
identifier is no anchor and is last among ties; rows that share an identifier are different
rows, and each is an anchor if one is; an anchor with no positive, and a positive with no
negative in its window, have no rows. Scores are exact; vectors whose scores might not fit 64
bits after a multiplication by 100 raise. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptloom.llm.common import durable

#: Values of a block of rows, and of one of anchors, at most.
BLOCK_VALUES = 1 << 21
BLOCK_ROWS = 4096
ANCHOR_ROWS = 512
#: Columns between two looks at the bounds.
STEP = 8
#: Blocks that a task hands to Python at once.
BLOCKS_AT_ONCE = 4
PAYLOAD = "n long, dims long, ids binary, no_id binary, labels binary, nth binary, data binary, goals binary"


class Block:
    """Rows of a block: identifiers, labels, row numbers and the columns of their vectors."""

    def __init__(self, row: dict):
        read = lambda name, kind: np.frombuffer(row[name], kind)
        self.ids, self.no_id = read("ids", "<i8"), read("no_id", "?")
        self.labels, self.nth = read("labels", "<i8"), read("nth", "<i8")
        self.columns = read("data", "<i8").reshape(row["dims"], row["n"])
        self.least, self.most = self.columns.min(axis=1), self.columns.max(axis=1)
        #: The place of each row in the order of identifiers, for ties.
        self.turn = np.empty(row["n"], np.int64)
        self.turn[np.lexsort((self.nth, self.ids, self.no_id))] = np.arange(row["n"])
        self.of_label = {x: np.flatnonzero(self.labels == x) for x in np.unique(self.labels).tolist()}
        self.not_of: dict[int, np.ndarray] = {}

    def with_label(self, label: int) -> np.ndarray:
        return self.of_label.get(label, np.zeros(0, np.int64))

    def without_label(self, label: int) -> np.ndarray:
        if label not in self.not_of:
            self.not_of[label] = np.flatnonzero(self.labels != label)
        return self.not_of[label]

    def first(self, rows: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
        """Places of the k best of some rows: higher scores first, ties by identifier."""
        if len(rows) > 4 * k:
            some = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
        else:
            some = np.arange(len(rows))
        return some[np.lexsort((self.turn[rows[some]], -scores[some]))[:k]]

    def scan(self, anchor: np.ndarray, rows: np.ndarray, stays) -> tuple[np.ndarray, np.ndarray]:
        """The rows that `stays`, given lower and upper bounds, never drops, and their scores."""
        order = np.argsort(-np.abs(anchor), kind="stable")
        weights = anchor[order]
        low = np.minimum(weights * self.least[order], weights * self.most[order])
        high = np.maximum(weights * self.least[order], weights * self.most[order])
        # what the columns from the i-th on can add
        low_left = np.append(np.cumsum(low[::-1])[::-1], 0)
        high_left = np.append(np.cumsum(high[::-1])[::-1], 0)
        score = np.zeros(len(rows), np.int64)
        whole = len(rows) == self.columns.shape[1]
        for i, (column, weight) in enumerate(zip(order.tolist(), weights.tolist(), strict=True)):
            if i and i % STEP == 0 and len(rows):
                keep = stays(score + low_left[i], score + high_left[i])
                if not keep.all():
                    rows, score, whole = rows[keep], score[keep], False
            if weight and len(rows):
                values = self.columns[column]
                score += weight * (values if whole else values[rows])
        return rows, score

    def positives(self, anchor: np.ndarray, label: int, nth: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        rows = self.with_label(label)
        rows = rows[self.nth[rows] != nth]

        def stays(low: np.ndarray, high: np.ndarray) -> np.ndarray:
            if len(low) <= k:
                return np.ones(len(low), bool)
            return high >= np.partition(low, len(low) - k)[len(low) - k]

        rows, scores = self.scan(anchor, rows, stays)
        best = self.first(rows, scores, k)
        return rows[best], scores[best]

    def negatives(
        self, anchor: np.ndarray, label: int, windows: list[tuple[int, int]], k: int
    ) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each window (from, to) the k best rows of another label with a score in it."""

        def stays(low: np.ndarray, high: np.ndarray) -> np.ndarray:
            keep = np.zeros(len(low), bool)
            for begin, end in windows:
                maybe = (high >= begin) & (low <= end)
                surely = low[(low >= begin) & (high <= end)]
                if len(surely) >= k:
                    maybe &= high >= np.partition(surely, len(surely) - k)[len(surely) - k]
                keep |= maybe
            return keep

        rows, scores = self.scan(anchor, self.without_label(label), stays)
        out = []
        for begin, end in windows:
            inside = np.flatnonzero((scores >= begin) & (scores <= end))
            best = inside[self.first(rows[inside], scores[inside], k)]
            out.append((rows[best], scores[best]))
        return out


def _integers(vectors: pa.Array, dims: int) -> np.ndarray:
    """Vectors rounded down, as rows; zeros follow a shorter one."""
    values = np.floor(np.asarray(vectors.flatten().to_numpy(zero_copy_only=False), np.float64))
    if len(values) and np.abs(values).max() >= 2.0**62:
        raise ValueError("components of this size have no exact 64-bit scores")
    sizes = np.asarray(pa.compute.list_value_length(vectors).to_numpy(zero_copy_only=False), np.int64)
    out = np.zeros((len(sizes), dims), np.int64)
    out[np.arange(dims) < sizes[:, None]] = values.astype(np.int64)
    return out


def _packer(dims: int, most: int):
    """Turns rows (id, label, nth, vector, goals) into blocks of at most `most` rows."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [("n", pa.int64()), ("dims", pa.int64())]
            + [(x, pa.binary()) for x in ("ids", "no_id", "labels", "nth", "data", "goals")]
        )
        held: list[pa.RecordBatch] = []
        rows = 0

        def block(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            table = pa.Table.from_batches(parts).combine_chunks()
            column = lambda name: table[name].combine_chunks()
            goals = column("goals").to_pylist()
            one = {
                "n": len(table),
                "dims": dims,
                "ids": column("id").fill_null(0).to_numpy().astype("<i8").tobytes(),
                "no_id": column("id").is_null().to_numpy(zero_copy_only=False).tobytes(),
                "labels": column("label").to_numpy().astype("<i8").tobytes(),
                "nth": column("nth").to_numpy().astype("<i8").tobytes(),
                "data": np.ascontiguousarray(_integers(column("vector"), dims).T).astype("<i8").tobytes(),
                "goals": pa.array(goals, pa.list_(pa.int64())).flatten().to_numpy().tobytes()
                if goals[0] is not None
                else b"",
            }
            return pa.RecordBatch.from_pylist([one], schema)

        for batch in batches:
            at = 0
            while at < batch.num_rows:
                some = batch.slice(at, most - rows)
                held.append(some)
                rows += some.num_rows
                at += some.num_rows
                if rows == most:
                    yield block(held)
                    held, rows = [], 0
        if rows:
            yield block(held)

    return pack


def _goals_of(row: dict, k: int) -> np.ndarray:
    """k scores of positives for each anchor of a block, -1 for none."""
    return np.frombuffer(row["goals"], "<i8").reshape(row["n"], k)


def _searcher(k_pos: int, k_neg: int, low: int, high: int, mine: bool):
    """Reads a block of rows, then the blocks of anchors that search it, and so on."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Block | None = None
        at = -1
        for batch in batches:
            for row in batch.to_pylist():
                if row["tag"] == 0:
                    block, at = Block(row), row["block"]
                    continue
                assert block is not None and at == row["block"]
                anchors = Block(row)
                top = np.maximum(np.abs(block.least), np.abs(block.most)).tolist()
                if len(anchors.ids):
                    greatest = np.abs(anchors.columns).max(axis=1).tolist()
                    if 100 * sum(a * b for a, b in zip(top, greatest, strict=True)) >= 2**63:
                        raise ValueError("scores of these vectors may not fit 64 bits")
                goals = _goals_of(row, k_pos) if mine else None
                out: list[tuple] = []
                for i in range(row["n"]):
                    vector = np.ascontiguousarray(anchors.columns[:, i])
                    label, nth = int(anchors.labels[i]), int(anchors.nth[i])
                    if goals is None:
                        found = [block.positives(vector, label, nth, k_pos)]
                    else:
                        windows = [
                            (-(-low * s // 100), high * s // 100) if s >= 0 else (1, 0)
                            for s in goals[i].tolist()
                        ]
                        found = block.negatives(vector, label, windows, k_neg)
                    for j, (rows, scores) in enumerate(found):
                        out += zip(
                            [nth] * len(rows), [j] * len(rows), block.nth[rows].tolist(),
                            [None if n else v for v, n in zip(block.ids[rows].tolist(), block.no_id[rows].tolist(), strict=True)],
                            scores.tolist(), strict=True,
                        )
                if out:
                    columns = list(zip(*out, strict=True))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, pa.int64()) for c in columns], ["anchor", "goal", "nth", "id", "score"]
                    )

    return search


FOUND = "anchor long, goal long, nth long, id long, score long"


def _search(blocks: DataFrame, n_blocks: int, anchors: DataFrame, search) -> DataFrame:
    """What the anchors find in each block; anchors travel to every block, rows to one."""
    columns = ["n", "dims", "ids", "no_id", "labels", "nth", "data", "goals"]
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long")))
    both = blocks.select("block", F.lit(0).alias("tag"), *columns).unionByName(
        anchors.select(every.alias("block"), F.lit(1).alias("tag"), *columns)
    )
    dealt = both.repartition(2 * n_blocks, "block").sortWithinPartitions("block", "tag")
    return durable(dealt.mapInArrow(search, FOUND), BLOCKS_AT_ONCE)


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, *, id_col: str = "id", label_col: str = "label",
    vector_col: str = "vector", scale: float = 1, positives: int = 5, negatives: int = 5,
    low: int = 80, high: int = 100, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score: for each
    anchor its first `positives` other rows of the same label, and for each of these the first
    `negatives` rows of another label whose score is from `low` to `high` hundredths of the
    positive's. A score is the inner product of the components times `scale`, rounded down."""
    rows = durable(
        vectors.select(
            F.col(id_col).cast("long").alias("id"),
            F.col(label_col).cast("long").alias("label"),
            F.col(vector_col).cast("array<double>").alias("vector"),
            F.coalesce(is_anchor & F.col(id_col).isNotNull(), F.lit(False)).alias("asks"),
        )
        .filter(F.col("label").isNotNull() & F.col("vector").isNotNull())
        .filter(
            F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        )
        .withColumn("vector", F.transform("vector", lambda x: x * float(scale)))
        .withColumn("nth", F.monotonically_increasing_id())
    )
    total, asking, dims = rows.agg(
        F.count("*"), F.count_if("asks"), F.coalesce(F.max(F.size("vector")), F.lit(1))
    ).first()
    dims = max(1, dims)
    each = max(1, min(block_rows, BLOCK_VALUES // dims))
    parts = max(1, -(-total // each))
    no_goals = F.lit(None).cast("array<long>").alias("goals")
    payload = ["id", "label", "nth", "vector"]
    # a partition may be larger than a block and then gives two
    packed = durable(
        rows.select(*payload, no_goals)
        .repartition(parts, "nth")
        .mapInArrow(_packer(dims, each), PAYLOAD)
        .withColumn("block", F.monotonically_increasing_id()),
        BLOCKS_AT_ONCE * 1000,
    )
    numbers = durable(
        packed.select(F.col("block").alias("at")).withColumn(
            "number", F.row_number().over(Window.orderBy("at")) - 1
        )
    )
    n_blocks = max(1, numbers.count())
    blocks = packed.join(F.broadcast(numbers), packed.block == numbers.at).drop("block", "at").select(
        F.col("number").cast("long").alias("block"), "*"
    )
    ask_parts = max(1, -(-asking // ANCHOR_ROWS))

    def in_blocks(asking_rows: DataFrame) -> DataFrame:
        dealt = asking_rows.repartition(ask_parts, "nth")
        return durable(dealt.mapInArrow(_packer(dims, ANCHOR_ROWS), PAYLOAD))

    anchors = rows.filter("asks").select(*payload)
    best = [F.desc("score"), F.col("id").asc_nulls_last(), F.col("nth")]
    found = _search(
        blocks, n_blocks, in_blocks(anchors.withColumn("goals", no_goals)),
        _searcher(positives, negatives, low, high, False),
    )
    place = F.row_number().over(Window.partitionBy("anchor").orderBy(*best))
    pairs = durable(
        found.withColumn("place", place).filter(F.col("place") <= positives).select(
            "anchor", "place", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")
        )
    )
    scores = pairs.groupBy("anchor").agg(
        F.map_from_entries(F.collect_list(F.struct("place", "positive_score"))).alias("m")
    )
    goals = F.array(*[F.coalesce(F.col("m")[i + 1], F.lit(-1)) for i in range(positives)])
    asked = anchors.join(scores, anchors.nth == scores.anchor).select(*payload, goals.alias("goals"))
    inside = _search(
        blocks, n_blocks, in_blocks(asked), _searcher(positives, negatives, low, high, True)
    )
    rank = F.row_number().over(Window.partitionBy("anchor", "goal").orderBy(*best))
    ranked = inside.withColumn("rank", rank).filter(F.col("rank") <= negatives).select(
        "anchor", (F.col("goal") + 1).alias("place"), "rank",
        F.col("id").alias("negative_id"), F.col("score").alias("negative_score"),
    )
    names = anchors.select(F.col("nth").alias("anchor"), F.col("id").alias("anchor_id"))
    return durable(
        ranked.join(pairs, ["anchor", "place"]).join(names, "anchor").select(
            "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
        )
    )
