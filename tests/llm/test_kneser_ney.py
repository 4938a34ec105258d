import math
import zlib
from collections import Counter, defaultdict

import pytest

from scriptloom.llm.kneser_ney import discounts, lm_scores, pack_arrays, unpack_arrays

import numpy as np


def brute(rows):
    held = {d: zlib.crc32(str("" if d is None else d).encode()) % 7 == 2 for d, *_ in rows}
    tokens = lambda t: [*(t or "").encode().lower().split(), b"\0end"]
    pair, one = Counter(), Counter()
    for d, t, *_ in rows:
        if not held[d]:
            seq = tokens(t)
            one.update(seq)
            pair.update(zip([b"\0start", *seq[:-1]], seq, strict=True))
    n, v = sum(one.values()), len(one)
    before = Counter(b for _, b in pair)
    count_counts = lambda c: [sum(x == i for x in c.values()) for i in (1, 2, 3, 4)]
    d2, d1 = discounts(count_counts(pair)), discounts(count_counts(before))
    after, total = defaultdict(Counter), Counter()
    for (a, b), c in pair.items():
        after[a][min(c, 3)] += 1
        total[a] += c
    weight1 = sum(d1[min(c, 3)] for c in before.values())

    def low(b):
        if not pair:
            return 1 / (v + 1)
        c = before[b]
        return max(c - d1[min(c, 3)], 0) / len(pair) + weight1 / len(pair) / (v + 1)

    def p(a, b):
        if a not in total:
            return low(b)
        c = pair[a, b]
        back = sum(d2[i] * k for i, k in after[a].items()) / total[a]
        return max(c - d2[min(c, 3)], 0) / total[a] + back * low(b)

    out = []
    for d, t, *_ in rows:
        seq = tokens(t)
        score = sum(math.log10(p(a, b)) for a, b in zip([b"\0start", *seq[:-1]], seq, strict=True))
        base = sum(math.log10((one[b] + 1) / (n + v + 1)) for b in seq)
        out.append((d, held[d], len(seq), sum(one[b] > 0 for b in seq), n, base, score))
    mass = sum(p(a, b) for a in [next(iter(total), b"")] for b in one) + p(next(iter(total), b""), b"?")
    assert not pair or abs(mass - 1) < 1e-9
    return out


@pytest.mark.parametrize("shard_bytes", [1 << 24, 1 << 12])
def test_brute_force(frame, edge_rows, shard_bytes, monkeypatch):
    from scriptloom.llm import kneser_ney

    real = kneser_ney.count_model
    monkeypatch.setattr(
        kneser_ney, "count_model", lambda *a, **k: real(*a, **k, shard_bytes=shard_bytes)
    )
    got = sorted(
        ((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score)
         for r in lm_scores(frame(edge_rows)).collect()),
        key=str,
    )
    want = sorted(brute(edge_rows), key=str)
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert g[:5] == w[:5]
        assert g[5:] == pytest.approx(w[5:], rel=1e-9)


def test_empty_and_untrained(frame):
    assert lm_scores(frame([])).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    row = lm_scores(frame([(held, "a b", "en", "s")])).first()
    assert (row.held_out, row.n_known, row.train_tokens, row.score) == (True, 0, 0, 0.0)


def test_arrays_round_trip():
    arrays = [np.array([1, 255]), np.array([], np.int64), np.array([2**63], np.uint64)]
    back = unpack_arrays(pack_arrays(*arrays))
    assert all((a == b).all() and len(a) == len(b) for a, b in zip(arrays, back, strict=True))
