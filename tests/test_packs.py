import random

import pytest
from pyspark.sql import functions as F

import scriptloom as sl
from scriptloom.sources import packs


@pytest.mark.parametrize("pack_bytes", [50, 1 << 20])
def test_packed_scripts_are_the_assembled_ones(spark, tmp_path, pack_bytes):
    rng = random.Random(5)
    rows = [(f"s{i % 37}", i * 7, "é漢x\n"[: rng.randrange(5)] * rng.randrange(30)) for i in range(700)]
    df = spark.createDataFrame(rows, "script_id string, chunk_no int, code string").repartition(5)
    manifest = sl.write_packs(df, str(tmp_path / "p"), sep="-|-", pack_bytes=pack_bytes)
    want = {r.script_id: r.code for r in sl.assemble(df, sep="-|-").collect()}
    assert {r.script_id: r.code for r in sl.read_packed_scripts(manifest).collect()} == want
    again = sl.read_manifest(spark, str(tmp_path / "p"))
    for size in (8, 1000):
        pieces = sorted(sl.read_pieces(again, piece_bytes=size).collect(), key=lambda r: (r.script_id, r.piece))
        got = {}
        for r in pieces:
            got[r.script_id] = got.get(r.script_id, "") + r.text
            assert len(r.text.encode()) <= size + 3
        assert got == want
    files = list((tmp_path / "p").glob("*.pack"))
    assert len(files) == 1 if pack_bytes > 50 else len(files) > 37


def test_a_hot_script_is_written_by_many_tasks(spark, tmp_path):
    """One script of 10 MB beside many small ones: its spans are in different files, which no
    script adds to."""
    df = spark.range(40_000).select(
        F.when(F.col("id") % 10 > 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id"))).alias("script_id"),
        (F.col("id") * 3 + 5).alias("chunk_no"),
        F.concat(F.col("id").cast("string"), F.lit(" "), F.repeat(F.lit("é"), 150)).alias("code"),
    )
    manifest = sl.write_packs(df, str(tmp_path / "p"), pack_bytes=1 << 20)
    runs = manifest.filter("script_id = 'hot'").collect()
    assert len({r.file for r in runs}) >= 8
    assert max(r.length for r in runs) < 0.2 * sum(r.length for r in runs)
    assert len(list((tmp_path / "p").glob("*.pack"))) < 100
    text = "".join(r.text for r in sorted(sl.read_pieces(manifest).filter("script_id = 'hot'").collect(), key=lambda r: r.piece))
    assert text == "\n".join(f"{i} " + "é" * 150 for i in range(40_000) if i % 10)
    assert manifest.select("script_id").distinct().count() == 4_001


def test_tasks_grow_with_the_text_and_not_with_the_scripts(spark, tmp_path, monkeypatch):
    """Reading dealt each run to a task of its own, writing each pack, as far as 20,000 of them."""
    df = spark.range(24_000).select(
        F.concat(F.lit("s"), F.floor(F.col("id") / 2)).alias("script_id"),
        F.col("id").alias("chunk_no"),
        F.repeat(F.lit("é"), (F.col("id") % 5).cast("int")).alias("code"),
    )
    want = {f"s{i}": "é" * (2 * i % 5) + "\n" + "é" * ((2 * i + 1) % 5) for i in range(12_000)}
    for task_bytes, tasks in (packs.TASK_BYTES, 1), (1 << 20, 12):
        monkeypatch.setattr(packs, "TASK_BYTES", task_bytes)
        manifest = sl.write_packs(df, str(tmp_path / str(tasks)), pack_bytes=1 << 12)
        assert len(list((tmp_path / str(tasks)).glob("*.pack"))) >= 20
        assert sl.read_pieces(manifest).rdd.getNumPartitions() == tasks
        got = sl.read_packed_scripts(manifest).collect()
        assert len(got) == len(want) and {r.script_id: r.code for r in got} == want


def test_empty_and_missing(spark, tmp_path):
    none = spark.createDataFrame([], "script_id string, chunk_no int, code string")
    assert sl.read_packed_scripts(sl.write_packs(none, str(tmp_path / "a"))).count() == 0
    for row, why in (("s", 1, None), "no code"), (("s", None, "x"), "no place"), ((None, 1, "x"), "no place"):
        with pytest.raises(Exception, match=why):
            sl.write_packs(spark.createDataFrame([row], none.schema), str(tmp_path / why.replace(" ", "") / str(row)))
    one = spark.createDataFrame([("s", 1, "")], none.schema)
    assert [tuple(r) for r in sl.read_packed_scripts(sl.write_packs(one, str(tmp_path / "b"))).collect()] == [("s", "")]


def test_files_of_lost_attempts_are_not_read(spark, tmp_path):
    df = spark.createDataFrame([("s", 1, "x")], "script_id string, chunk_no int, code string")
    manifest = sl.write_packs(df, str(tmp_path / "p"))
    (tmp_path / "p" / "0123.pack").write_text("left behind")
    assert [tuple(r) for r in sl.read_packed_scripts(manifest).collect()] == [("s", "x")]
    assert packs.RUNS.startswith("script_id")
