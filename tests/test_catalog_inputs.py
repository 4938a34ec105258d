"""Inputs of the registered queries: tasks and files that they are made by."""

from pathlib import Path

from pyspark.sql import functions as F

from catalog import inputs, queries

CUSTOMER = "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"


def test_scripts_of_one_small_file_are_made_by_many_tasks(spark, tmp_path):
    rows = [(i, f"c{i}", 1, i / 3, "M") for i in range(400)] + [(None, None, None, None, None), (5, "c5", 1, 5 / 3, "M")]
    spark.createDataFrame(rows, CUSTOMER).coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    scripts = inputs.scripts(spark, str(tmp_path))
    sizes = scripts.select("script_id").rdd.glom().map(len).collect()
    assert sum(sizes) == len(rows) and sum(n > 0 for n in sizes) >= 4 * 8 and max(sizes) < 50


def test_landed_files(spark, tmp_path):
    df = spark.createDataFrame(
        [("1", "a\nb"), ("2", "é"), ("2", "é"), ("3", None), (None, "x")], "script_id string, source string"
    )
    folder = tmp_path / "in"
    for times in (1, 2):
        queries._landed(df, str(folder))
        files = [p for p in Path(folder).rglob("*") if p.is_file()]
        got = sorted((p.parent.name, p.read_text()) for p in files)
        assert all(p.suffix == ".txt" for p in files)
        want = [("1", "a\nb\n"), ("2", "é\né\n"), ("3", "\n"), (queries.NO_SCRIPT, "x\n")]
        assert got == sorted([(f"script_id={k}", text) for k, text in want] * times)


def test_landed_files_in_fewer_folders(spark, tmp_path):
    rows = [(str(i), f"text {i}") for i in range(1000)] + [("1", "text 1"), (None, "x")]
    df = spark.createDataFrame(rows, "script_id string, source string")
    folder = tmp_path / "in"
    for times in (1, 2):
        queries._landed(df, str(folder), files_a_folder=10)
        files = [p for p in Path(folder).rglob("*") if p.is_file()]
        want = [(str(i), f"text {i}\n" * (1 + (i == 1))) for i in range(1000)] + [(queries.NO_SCRIPT, "x\n")]
        got = sorted((p.name, p.read_text()) for p in files)
        assert got == sorted([(f"script_id={k}.txt", text) for k, text in want] * times)
        homes = [len(list(p.iterdir())) for p in Path(folder).iterdir()]
        assert max(homes) <= 10 and len(homes) <= times * 150


def test_stream_of_script_files_is_listed_by_executors(spark, tmp_path, monkeypatch):
    """Each run of the stream has the scripts of its half, by no source that keeps paths."""
    rows = [(i, f"c{i}", 1, i / 3, "M") for i in range(40)] + [(None, None, None, None, None), (6, "c6", 1, 2.0, "M")]
    spark.createDataFrame(rows, CUSTOMER).write.parquet(str(tmp_path / "customer.parquet"))
    ran, run = [], queries.sl.run_available
    monkeypatch.setattr(queries.sl, "run_available", lambda *a: ran.append(run(*a)) or ran[-1])
    got = queries.stream_script_files(spark, str(tmp_path))
    assert len(ran) == 2 and not any("FileStream" in s.description for q in ran for s in q.lastProgress.sources)
    scripts = inputs.scripts(spark, str(tmp_path)).filter("source IS NOT NULL").groupBy("script_id")
    texts = scripts.agg(F.concat(F.array_join(F.collect_list("source"), "\n"), F.lit("\n")).alias("text"))
    want = {r[0] for r in texts.select(F.sha2("text", 256)).collect()}
    assert {r.content_hash for r in got.select("content_hash").collect()} == want
    assert got.count() == got.select("content_hash", "chunk_no").distinct().count()
