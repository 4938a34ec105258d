import hashlib

import pytest
from pyspark.sql import functions as F

from scriptloom.llm.common import new_folder
from scriptloom.llm.exact_dedup import absorb, exact_dedup, kept_state


def brute(rows):
    texts = {}
    for d, t, *_ in rows:
        texts.setdefault(t or "", []).append(-1 if d is None else d)
    out = []
    for d, t, *_ in rows:
        ids = texts[t or ""]
        keep = max(ids)
        out.append((d, None if keep < 0 else keep, len(ids), hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=str)


def found(df):
    return sorted(
        [(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in df.collect()], key=str
    )


def test_brute_force_and_one_row_stays(frame, edge_rows):
    df = exact_dedup(frame(edge_rows), files_per_batch=1)
    assert found(df) == brute(edge_rows)
    kept = [r for r in df.collect() if r.kept]
    assert len(kept) == len({t or "" for _, t, *_ in edge_rows})
    assert all(r.doc_id == r.keep_id for r in kept)


@pytest.mark.parametrize("digest", [lambda t: F.lit("same"), lambda t: F.substring(F.md5(t), 1, 1)])
def test_equal_digests_of_unequal_texts_are_told_apart(frame, edge_rows, digest):
    df = exact_dedup(frame(edge_rows), digest=digest, files_per_batch=2)
    assert [x[:3] for x in found(df)] == [x[:3] for x in brute(edge_rows)]


def test_state_goes_on_over_runs(spark, tmp_path):
    landing, checkpoint = str(tmp_path / "in"), new_folder(spark, "state")
    schema = "doc_id long, digest string, file string, row long"
    for ids in ([1, 2], [3], [9, 4]):
        rows = [(i, "d" if i != 2 else "e", "f", i) for i in ids]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(landing)
        absorb(spark, landing, checkpoint, "bigint", 1)
    state = {r.digest: (r.stays.doc_id, r.n) for r in kept_state(spark, checkpoint).collect()}
    assert state == {"d": (9, 4), "e": (2, 1)}


def test_empty(frame):
    assert exact_dedup(frame([])).count() == 0
