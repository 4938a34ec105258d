import random

import numpy as np
import pytest
import xxhash

from scriptloom.llm.components import components
from scriptloom.llm.simhash import links, near_duplicates


def fingerprint(text, width=3):
    words = (text or "").encode().lower().split()
    runs = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << i for i in range(64) if sum(h >> i & 1 for h in hashes) * 2 > len(hashes))


def roots(n, pairs):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_links_are_all_pairs_within_two_bits(spark, seed):
    rng = random.Random(seed)
    prints = {0, (1 << 64) - 1, 1, 3, 7, 1 << 63}
    for _ in range(12):
        x = rng.getrandbits(64)
        for _ in range(12):
            prints.add(x)
            for _ in range(rng.randrange(4)):
                x ^= 1 << rng.randrange(64)
    values = np.array(sorted(prints), np.uint64).view(np.int64).tolist()
    got = {frozenset((r.a, r.b)) for r in links(spark.createDataFrame([(v,) for v in values], "fp long")).collect()}
    want = {
        frozenset((a, b)) for a in values for b in values if a != b and ((a ^ b) & (2**64 - 1)).bit_count() <= 2
    }
    assert got == want


def test_components_of_chains_and_stars(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(30)] + [(200, 200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)}


def test_table_against_brute_force(frame, edge_rows):
    rng = random.Random(4)
    rows = [r for r in edge_rows if r[0] is not None]
    long = next(t for d, t, *_ in rows if d == 7).split()
    for i in range(10):
        words = long[:3000]
        words[rng.randrange(3000)] = "edited"
        rows.append((300 + i, " ".join(words), "en", "s"))
    prints = [fingerprint(t) for _, t, *_ in rows]
    near = [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2]
    groups = roots(len(rows), near)
    least = {}
    for (d, *_), g in zip(rows, groups, strict=True):
        least[g] = min(least.get(g, d), d)
    want = sorted((r[0], f"{p:016x}", least[g]) for r, p, g in zip(rows, prints, groups, strict=True))
    got = sorted((r.doc_id, r.fingerprint, r.component_id) for r in near_duplicates(frame(rows)).collect())
    assert got == want


def test_nulls_and_empty(frame):
    out = near_duplicates(frame([(None, None, None, None), (5, "", None, None)])).collect()
    assert [(r.fingerprint, r.component_id) for r in out] == [("0" * 16, 5)] * 2
    assert near_duplicates(frame([])).count() == 0


def test_carried_columns_and_components_without_ids(frame):
    docs = frame([(None, "a b c d", None, None), (None, "a b c d", None, "x"), (None, "q r s t u", None, None)])
    out = near_duplicates(docs, carry=["text", "source", "node"]).collect()
    assert [r.component_id for r in out] == [None] * 3
    named = {(r.carried.text, r.carried.source): r.component for r in out}
    assert len(named) == 3 and len(set(named.values())) == 2
    assert named["a b c d", None] == named["a b c d", "x"]
