import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptloom.llm.bond_search import Block, hard_negatives
from scriptloom.llm.queries import op13_hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int, n long, ids string, block long, goals int"


def brute(rows, every=100):
    """(anchor, positive, rank, negative, scores) by a plain loop over all rows."""
    known = []
    for i, (vec_id, vector, label) in enumerate(rows):
        if label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        if vec_id is not None and vec_id % 7 == 0:
            label = (label + 1) % 10
        known.append((i, vec_id, label, [math.floor(256 * float(np.float32(x))) for x in vector]))
    turn = lambda r: (-r[0], r[1] is None, r[1] or 0)
    out = []
    for i, vec_id, label, q in known:
        if vec_id is None or vec_id % every:
            continue
        scored = [
            (sum(a * b for a, b in zip(q, x, strict=False)), v, lab) for j, v, lab, x in known if j != i
        ]
        for ps, pid, _ in sorted((s for s in scored if s[2] == label), key=turn)[:5]:
            inside = [s for s in scored if s[2] != label and 80 * ps <= 100 * s[0] <= 100 * ps]
            for rank, (ns, nid, _) in enumerate(sorted(inside, key=turn)[:5], 1):
                out.append((vec_id, pid, rank, nid, ps, ns))
    return sorted(out, key=str)


def mined(spark, folder, rows):
    full = [(*r, 1, "x", 2, 3) for r in rows]
    spark.createDataFrame(full, SCHEMA).repartition(3).write.parquet(f"{folder}/embeddings.parquet")
    return sorted((tuple(r) for r in op13_hard_negatives(spark, str(folder)).collect()), key=str)


def test_brute_force_with_ties_nulls_and_clashing_names(spark, tmp_path):
    rng = random.Random(2)
    vector = lambda: [round(rng.gauss(0.2, 0.3), 1) for _ in range(6)]
    same = vector()
    rows = [(i, vector(), rng.randrange(3)) for i in range(260)]
    rows += [(300 + i, same, i % 2) for i in range(60)]  # one vector many times
    rows += [(400, None, 1), (500, vector(), None), (600, [0.1, None, 0.2, 0.0, 0.0, 0.0], 1)]
    rows += [(700, [float("nan")] * 6, 1), (800, [float("inf")] + [0.0] * 5, 1), (None, same, 1), (None, vector(), None)]
    rows += [(900, [], 1), (1000, [0.5, 0.5], 1), (1100, [0.0] * 6, 2), (1200, [-1.0] * 6, 9)]
    want = brute(rows)
    assert len(want) > 40
    assert mined(spark, tmp_path, rows) == want


def test_repeated_anchor_rows_each_count(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, [rng.random() for _ in range(4)], i % 2) for i in range(1, 60)]
    rows += [(0, [0.5, 0.5, 0.5, 0.5], 0)] * 2
    assert mined(spark, tmp_path, rows) == brute(rows)


def test_empty_and_alone(spark, tmp_path):
    assert mined(spark, tmp_path / "a", []) == []
    assert mined(spark, tmp_path / "b", [(100, [1.0, 2.0], 3)]) == []
    assert mined(spark, tmp_path / "c", [(100, [1.0], 3), (101, [1.0], 3), (102, [1.0], None)]) == []


def test_many_blocks_give_the_same(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in np.floor(rng.normal(0, 40, 24))], int(rng.integers(4))) for i in range(900)]
    df = spark.createDataFrame(rows, "id long, vector array<double>, label int")
    small = hard_negatives(df, F.col("id") % 50 == 0, block_rows=64, positives=3, negatives=7, low=50)
    large = hard_negatives(df, F.col("id") % 50 == 0, positives=3, negatives=7, low=50)
    assert sorted(map(tuple, small.collect())) == sorted(map(tuple, large.collect()))
    assert small.count() > 100


def test_scan_drops_rows_early_and_stays_exact():
    """Clustered vectors: most rows are gone before the last columns are read."""
    rng = np.random.default_rng(1)
    centres = rng.normal(0, 60, (20, 64))
    data = np.floor(centres[rng.integers(0, 20, 2000)] + rng.normal(0, 4, (2000, 64))).astype("<i8")
    n = len(data)
    block = Block(
        {"n": n, "dims": 64, "ids": np.arange(n).tobytes(), "no_id": np.zeros(n, bool).tobytes(),
         "labels": np.zeros(n, "<i8").tobytes(), "nth": np.arange(n).tobytes(),
         "data": np.ascontiguousarray(data.T).tobytes(), "goals": b""}
    )
    seen = []
    scan = block.scan

    def counted(anchor, rows, stays):
        def look(low, high):
            seen.append(len(low))
            return stays(low, high)

        return scan(anchor, rows, look)

    block.scan = counted
    rows, scores = block.positives(data[7], 0, 7, 5)
    every = data @ data[7]
    every[7] = -(1 << 50)
    want = np.lexsort((np.arange(n), -every))[:5]
    assert rows.tolist() == want.tolist() and scores.tolist() == every[want].tolist()
    assert seen[-1] < n / 4


@pytest.mark.parametrize("size", [1e17, 3e18, 1e30])
def test_scores_beyond_64_bits_raise(spark, size):
    df = spark.createDataFrame([(0, [size, 1.0], 1), (1, [size, 1.0], 1)], "id long, vector array<double>, label int")
    with pytest.raises(Exception, match="64"):
        hard_negatives(df, F.col("id") == 0)
