import random
from collections import defaultdict

from scriptloom.llm.best_fit import best_fit_packing, pack


def brute(lengths, sources, clusters, capacity):
    bins, out = [], []
    for length, source, cluster in zip(lengths, sources, clusters, strict=True):
        fits = [
            (left, i)
            for i, (left, s, c) in enumerate(bins)
            if left >= length and (source < 0 or source not in s) and (cluster < 0 or cluster not in c)
        ]
        if fits:
            at = min(fits)[1]
        else:
            at = len(bins)
            bins.append([capacity, set(), set()])
        bins[at][0] -= length
        bins[at][1].update({source} - {-1})
        bins[at][2].update({cluster} - {-1})
        out.append(at)
    return out


def test_pack_is_tightest_compatible_bin():
    rng = random.Random(6)
    for _ in range(300):
        n, capacity = rng.randrange(60), rng.choice([1, 5, 20, 64])
        lengths = sorted((rng.randrange(capacity + 1) for _ in range(n)), reverse=True)
        sources = [rng.randrange(-1, 4) for _ in range(n)]
        clusters = [rng.randrange(-1, 5) for _ in range(n)]
        assert pack(lengths, sources, clusters, capacity) == brute(lengths, sources, clusters, capacity)


def test_table(frame):
    rng = random.Random(7)
    rows = [(i % 390 if i % 50 else None, "t", "en", rng.choice(["a", "b", "c", None])) for i in range(400)]
    docs = frame(rows).selectExpr(
        "doc_id", "source", "text", "CASE WHEN doc_id % 7 = 0 THEN NULL ELSE doc_id * 37 % 400 END AS length",
        "CASE WHEN doc_id % 3 = 0 THEN 'twin' END AS cluster", "'x' AS bin_id", "1 AS grp",
    )
    out = best_fit_packing(docs, capacity=100, rows_per_group=150).collect()
    facts = defaultdict(list)
    for r in docs.collect():
        facts[r.doc_id].append(r)
    total = sum(r.length or 0 for rows in facts.values() for r in rows)
    assert sum(r.length for r in out) == total
    bins = defaultdict(list)
    for r in out:
        bins[r.bin_id].append(r)
    for pieces in bins.values():
        assert sum(p.length for p in pieces) <= 100
        spans = sorted((p.bin_start, p.bin_start + p.length) for p in pieces)
        assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False))
        own = [facts[p.doc_id][0] for p in pieces if len(facts[p.doc_id]) == 1]
        for column in ("source", "cluster"):
            values = [getattr(f, column) for f in own if getattr(f, column) is not None]
            assert len(values) == len(set(values))
    again = best_fit_packing(docs, capacity=100, rows_per_group=150).collect()
    assert sorted(map(str, again)) == sorted(map(str, out))
    assert best_fit_packing(docs.limit(0)).count() == 0
