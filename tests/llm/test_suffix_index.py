import hashlib
import random
from collections import Counter

import pytest

from scriptloom.llm.suffix_index import anchors, numbered, remove_repeats, removed_spans


def brute(texts, length):
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("files,batches,limit", [(1, 4, 10**6), (7, 7, 10**6), (5, 2, 2)])
def test_brute_force(spark, frame, edge_rows, tmp_path, files, batches, limit):
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("abcdé \n") for _ in range(n))
    passages = [word(n) for n in (150, 199, 200, 201, 300, 900)]
    rows = [r for r in edge_rows if len(r[1] or "") < 5000]
    for i in range(80):
        parts = [word(rng.randrange(200)) + rng.choice(passages) for _ in range(rng.randrange(4))]
        rows.append((1000 + i, "".join(parts) + word(rng.randrange(300)), "en", "s"))
    rows += [(2000, "a" * 700, "en", "s"), (2001, "ab" * 150, "en", "s"), (2002, "z" * 200, "en", "s")]
    frame(rows).repartition(files).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    out = remove_repeats(docs, batches=batches, contexts_per_task=limit, shard_bytes=1 << 13).collect()
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out), key=str)
    want = brute([(t or "").encode() for _, t, *_ in rows], 200)
    assert got == sorted(((r[0], *w) for r, w in zip(rows, want, strict=True)), key=str)


def test_frames_that_are_no_table_and_empty(frame):
    rng = random.Random(1)
    text = "".join(rng.choice("xyz") for _ in range(400))
    docs = frame([(1, text, None, None), (2, text[100:350], None, None)])
    out = {r.doc_id: r.n_removed for r in remove_repeats(docs).collect()}
    assert out == {1: 250, 2: 250}
    assert remove_repeats(frame([])).count() == 0


def test_long_text_has_the_anchors_of_its_parts(monkeypatch):
    from scriptloom.llm import suffix_index

    rng = random.Random(3)
    text = bytes(rng.choice(b"abcd") for _ in range(20_000))
    whole = anchors(text, 200)
    monkeypatch.setattr(suffix_index, "SEGMENT", 1500)
    parts = anchors(text, 200)
    assert set(whole[1].tolist()) == set(parts[1].tolist())
    assert removed_spans([(5, 9), (0, 3), (3, 4), (8, 12)]) == [(0, 4), (5, 12)]


def test_rows_keep_their_columns_beside_their_number(spark, frame, tmp_path):
    frame([(1, "a", "en", "s"), (2, None, "en", "s")]).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d")).select("doc_id", "text")
    rows, files = numbered(docs, str(tmp_path / "unused"))
    assert {"doc_id", "text", "row"} <= set(rows.columns) and files
    got = rows.collect()
    assert {(r.doc_id, r.text) for r in got} == {(1, "a"), (2, None)} and len({r.row for r in got}) == 2
