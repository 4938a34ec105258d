import hashlib
import random
import re

import pytest

from scriptloom.llm.common import settings
from scriptloom.llm.fair_mix import fair_mix


def brute(rows, weights=(1, 2, 3), times=3):
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, *_ in rows]
    sources = sorted({s for *_, s in rows}, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(sources)}
    total = {s: sum(z for z, r in zip(size, rows, strict=True) if r[3] == s) for s in sources}
    target, open_ = {}, set(sources)
    left = sum(total.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if times * total[s] <= weight[s] * level]
        if not over:
            target |= {s: weight[s] * level for s in open_}
            break
        for s in over:
            target[s] = times * total[s]
            left -= target[s]
            open_.remove(s)
    shuffle = lambda d: hashlib.md5(("" if d is None else str(d)).encode()).hexdigest()
    copies = []
    for nth, s in enumerate(sources):
        mine = sorted(
            (i for i, r in enumerate(rows) if r[3] == s),
            key=lambda i: (shuffle(rows[i][0]), -1 if rows[i][0] is None else rows[i][0], size[i]),
        )
        upto = 0
        for i in mine:
            upto += size[i]
            for copy in range(times):
                begin = copy * total[s] + upto - size[i]
                if begin <= target[s]:
                    finish = (copy * total[s] + upto) / target[s] if target[s] else float("inf")
                    copies.append((finish, nth, shuffle(rows[i][0]), -1 if rows[i][0] is None else rows[i][0], size[i], copy, i))
    taken, spent, budget = [0] * len(rows), 0, sum(size)
    for *_, z, _, i in sorted(copies):
        spent += z
        if spent > budget:
            break
        taken[i] += z
    return size, total, target, taken


@pytest.mark.parametrize("slices", [1, 23])
def test_brute_force(spark, frame, edge_rows, slices):
    rng = random.Random(1)
    rows = edge_rows + [(500 + i, "w " * rng.randrange(40), "en", rng.choice("abcde")) for i in range(120)]
    # a third of all rows share an identifier, or have none
    rows += [(77, "w " * rng.randrange(9), "en", "a") for _ in range(60)] + [(None, "v " * i, "en", "b") for i in range(40)]
    size, total, target, taken = brute(rows)
    with settings(spark, {"spark.sql.shuffle.partitions": str(slices), "spark.sql.adaptive.enabled": "false"}):
        out = fair_mix(frame(rows)).collect()
    got = sorted(((r.doc_id, r.source, r["size"], r.source_size, r.taken) for r in out), key=str)
    want = sorted(((r[0], r[3], z, total[r[3]], t) for r, z, t in zip(rows, size, taken, strict=True)), key=str)
    assert got == want
    assert all(r.target == pytest.approx(target[r.source], rel=1e-12) for r in out)


def test_targets_are_met(frame):
    rng = random.Random(2)
    rows = [(i, "w " * rng.randrange(1, 30), "en", rng.choice("aaaaaaabcdef")) for i in range(3000)]
    out = fair_mix(frame(rows)).collect()
    for source in "abcdef":
        mine = [r for r in out if r.source == source]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 60
        assert all(r.taken % r["size"] == 0 and r.taken <= 3 * r["size"] for r in mine)


def test_no_words_and_empty(frame):
    assert [(r.target, r.taken) for r in fair_mix(frame([(1, None, None, None)])).collect()] == [(0.0, 0)]
    assert fair_mix(frame([])).count() == 0
