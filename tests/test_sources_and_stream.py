import pytest
from pyspark.sql import functions as F

import scriptloom as sl
from scriptloom.session import scratch, work_folder
from scriptloom.sources.records import read_records
from scriptloom.sources.sinks import CSV_OPTIONS
from scriptloom.streaming.ingest import new_scripts

ODD = [" a \n", "q\"q", "back\\slash\\", "", None, "\\N x", "\\N", "\\\\N", "\\\\\\N", "l1\r\nl2\n\n", "é,;'", '"', "\ttab\t"]


def test_csv_round_trip(spark, tmp_path):
    rows = [(str(i), i, text, text) for i, text in enumerate(ODD)]
    df = spark.createDataFrame(rows, "script_id string, chunk_no int, original string, converted string")
    sl.write_mapping_csv(df, str(tmp_path / "csv"))
    back = sl.read_mapping_csv(spark, str(tmp_path / "csv"), df.schema)
    assert sorted(map(tuple, back.collect()), key=lambda r: r[1]) == rows


def test_csv_takes_arrays_and_spaced_names(spark, tmp_path):
    df = spark.createDataFrame([(1, ["a", "b"])], "`Sr No` int, comments array<string>")
    sl.write_mapping_csv(df, str(tmp_path / "csv"))
    back = sl.read_mapping_csv(spark, str(tmp_path / "csv"), "`Sr No` int, comments string")
    assert tuple(back.first()) == (1, "a\nb")


@pytest.mark.parametrize("part_bytes", [1, 7, 64, 1000, 1 << 20])
def test_csv_in_ranges(spark, tmp_path, part_bytes):
    rows = [(str(i), i, text, text) for i, text in enumerate(ODD + ["x\ny" * 50, '"\n"' * 40])]
    schema = "script_id string, `chunk no` int, original string, converted string"
    df = spark.createDataFrame(rows, schema)
    path = str(tmp_path / "csv")
    sl.write_mapping_csv(df.coalesce(1), path)
    index = sl.record_index(spark, path, part_bytes=part_bytes)
    back = sl.read_mapping_csv(spark, path, df.schema, index=index)
    assert back.schema.simpleString() == df.schema.simpleString()
    assert sorted(map(tuple, back.collect()), key=lambda r: r[1]) == rows
    # where records begin, by reading the file a character at a time
    file = next((tmp_path / "csv").glob("*.csv")).read_bytes()
    begins, within = [0], False
    for at, byte in enumerate(file):
        within ^= byte == 0x22
        if byte == 0x0A and not within:
            begins.append(at + 1)
    want = {}
    for begin in begins:
        want.setdefault(max(begin - 1, 0) // part_bytes * part_bytes, begin)
    got = {(r.stop - 1) // part_bytes * part_bytes: r.first for r in index.collect()}
    assert {k: v for k, v in got.items() if v is not None} == want
    assert len(got) == -(-len(file) // part_bytes)


def test_one_csv_file_is_read_by_many_tasks(spark, tmp_path):
    """Records longer than what is read at once, too, and a file without records."""
    path = str(tmp_path / "csv")
    text = "concat('a\n\"', repeat('line\n', CAST(id % 90 AS int)))"
    df = spark.range(2000).selectExpr("id", f"{text} AS original")
    sl.write_mapping_csv(df.coalesce(1), path, rows_per_file=0)
    assert len(list((tmp_path / "csv").glob("*.csv"))) == 1
    index = sl.record_index(spark, path, part_bytes=20_000, batch_bytes=100)
    back = read_records(index, df.schema, CSV_OPTIONS, batch_bytes=100)
    by_task = back.groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert len(by_task) > 8 and max(r["count"] for r in by_task) < 1000
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    empty = str(tmp_path / "none")
    sl.write_mapping_csv(df.limit(0), empty)
    assert sl.read_mapping_csv(spark, empty, df.schema, index=sl.record_index(spark, empty)).count() == 0


def test_script_files(spark, tmp_path):
    rows = [("a", "x\n\ny"), ("b/c=d %", "z"), ("007", ""), ("n", None)]
    df = spark.createDataFrame(rows, "script_id string, code string")
    sl.write_scripts(df, str(tmp_path / "few"), folders=2)
    assert len([f for f in (tmp_path / "few").iterdir() if f.is_dir()]) <= 2
    back = sl.read_written_scripts(spark, str(tmp_path / "few"))
    assert sorted(map(tuple, back.collect())) == sorted(rows)
    out = str(tmp_path / "out")
    sl.write_scripts(df.filter("code IS NOT NULL"), out, folder_per_script=True)
    back = sl.read_scripts(spark, out).collect()
    assert sorted(r.source for r in back) == sorted(text + "\n" for _, text in rows[:3])
    assert all(r.path == r.script_id and len(r.content_hash) == 64 for r in back)


def test_read_only_script_files(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "a.SQL").write_bytes("é;\r\n/\r\n".encode())
    (tmp_path / "deep" / "b.txt").write_bytes(b"")
    (tmp_path / "c.py").write_bytes(b"no")
    (tmp_path / "d é%20 +.Sql").write_bytes(b"odd name")
    (tmp_path / "e é%20 +.sql").write_bytes(b"")
    got = {r.path.rsplit("/", 1)[1]: r.source for r in sl.read_scripts(spark, str(tmp_path)).collect()}
    assert got == {"a.SQL": "é;\r\n/\r\n", "b.txt": "", "d é%20 +.Sql": "odd name", "e é%20 +.sql": ""}


def test_bytes_that_are_not_utf8(spark, tmp_path):
    (tmp_path / "a.sql").write_bytes(b"a\xffb")
    with pytest.raises(Exception, match="(?i)utf"):
        sl.read_scripts(spark, str(tmp_path)).collect()
    assert sl.read_scripts(spark, str(tmp_path), on_invalid="repair").first().source == "a�b"
    (tmp_path / "b.sql").write_bytes(b"fine")
    flags = sl.read_scripts(spark, str(tmp_path), on_invalid="flag").collect()
    assert {r.path[-5:]: r.is_utf8 for r in flags} == {"a.sql": False, "b.sql": True}


def test_stream_forgets_after_the_time_given(spark, tmp_path):
    land = tmp_path / "land"
    land.mkdir()
    schema = "script_id string, content_hash string, at timestamp"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(land))

    def run(rows):
        spark.createDataFrame(rows, "script_id string, content_hash string, at string").selectExpr(
            "script_id", "content_hash", "CAST(at AS TIMESTAMP) AS at"
        ).coalesce(1).write.mode("append").parquet(str(land))
        sl.run_available(
            new_scripts(stream, time_col="at", within="1 day"), str(tmp_path / "o"), str(tmp_path / "s")
        ).awaitTermination()

    run([("a", "h", "2024-01-01 00:00:00")])
    run([("b", "h", "2024-01-01 05:00:00"), ("c", "k", "2024-02-01 00:00:00")])
    run([("d", "h", "2024-02-01 01:00:00")])
    got = spark.read.parquet(str(tmp_path / "o")).select("script_id").collect()
    assert sorted(r.script_id for r in got) == ["a", "c", "d"]


def test_stream_equals_batch_over_restarts(spark, tmp_path):
    land, out, state = tmp_path / "land", str(tmp_path / "out"), str(tmp_path / "state")
    land.mkdir()

    def run():
        chunks = sl.stream_chunks(sl.stream_scripts(spark, str(land)))
        sl.run_available(chunks, out, state).awaitTermination()
        return spark.read.parquet(out)

    (land / "a.sql").write_text("begin x; end;\n/\nselect 1;")
    (land / "b.sql").write_text("create procedure p is begin null; end;")
    assert run().select("content_hash").distinct().count() == 2
    (land / "copy.sql").write_text("begin x; end;\n/\nselect 1;")
    (land / "c.txt").write_text("update t set a = 1;")
    got = run()
    assert got.select("content_hash").distinct().count() == 3

    scripts = sl.read_scripts(spark, str(land))
    nothing = scripts.filter("false")
    batch = sl.structured_chunks(sl.only_new(scripts, nothing, within_batch="first"),
                                 keys=("content_hash",))
    assert sorted(map(tuple, got.drop("script_id").collect())) == sorted(map(tuple, batch.collect()))


def test_stream_drops_copies_within_a_batch(spark, tmp_path):
    land = tmp_path / "land"
    land.mkdir()
    for i in range(120):
        (land / f"{i}.sql").write_text("same;" if i % 3 else f"own {i};")
    chunks = sl.stream_chunks(sl.stream_scripts(spark, str(land), files_per_trigger=50))
    sl.run_available(chunks, str(tmp_path / "o"), str(tmp_path / "s")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "o")).count() == 41


class Session:
    """Only what the work folder asks of a session."""

    def __init__(self, master, shared=None):
        self.conf = {"spark.checkpoint.dir": shared}
        self.sparkContext = self
        self.master = master


def test_work_folder_is_below_the_shared_one():
    cluster = Session("yarn", "/shared/place")
    assert work_folder(cluster, "x").startswith("/shared/place/x-")
    assert work_folder(cluster, "x") != work_folder(cluster, "x")
    assert work_folder(Session("local[2]"), "x")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        work_folder(Session("yarn"), "x")


def test_scratch_leaves_nothing(spark, tmp_path):
    with scratch(spark, "x") as folder:
        spark.range(3).write.parquet(folder)
        assert spark.read.parquet(folder).count() == 3
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(folder)


def tree(root):
    """Files at several depths: empty, hidden, oddly named, and other than scripts."""
    files = {
        "a.sql": "one", "x/b.TXT": "", "x/y/z/c.Sql": "drei é", "x/y/d é%20 +.sql": "", "p=1/e.txt": "5",
        "_p=2/f.sql": "6", "_tmp/g.sql": "no", ".h/i.sql": "no", "j.sql.bak": "no", "_k.sql": "no", "x/l.py": "no",
    }
    for name, text in files.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    (root / "nothing").mkdir()
    return {f"file:{root}/{n}": t for n, t in files.items() if t != "no"}


@pytest.mark.parametrize("form", ["{}", "{}/", "file:{}", "file://{}"])
def test_executors_list_what_the_driver_lists(spark, tmp_path, form):
    want = tree(tmp_path)
    for listing in ("executors", "driver"):
        got = sl.read_scripts(spark, form.format(tmp_path), listing=listing).collect()
        assert {r.path: r.source for r in got} == want and len(got) == len(want)
        assert all(r.script_id == r.path and len(r.content_hash) == 64 for r in got)


def test_no_path_in_the_plan(spark, tmp_path):
    for i in range(300):
        (tmp_path / f"script{i}.sql").write_text(f"text {i}" if i % 3 else "")
    scripts = sl.read_scripts(spark, str(tmp_path))
    plan = scripts._jdf.queryExecution().toString()
    assert "script1" not in plan and "LocalTableScan" not in plan and "LocalRelation" not in plan
    assert scripts.count() == 300 and scripts.filter("source = ''").count() == 100
    assert scripts.rdd.getNumPartitions() >= 8


def streamed(spark, path, tmp_path, **how):
    """path and text of the scripts of a stream, run until nothing is left, and its last progress."""
    out, state = str(tmp_path / "stream-out"), str(tmp_path / "stream-state")
    query = sl.run_available(sl.stream_scripts(spark, path, **how), out, state)
    query.awaitTermination()
    rows = spark.read.parquet(out).collect()
    assert all(r.script_id == r.path and len(r.content_hash) == 64 for r in rows)
    assert len({r.path for r in rows}) == len(rows)
    return {r.path: r.source for r in rows}, query.lastProgress


@pytest.mark.parametrize("listing", ["executors", "driver"])
def test_stream_has_what_the_driver_lists(spark, tmp_path, listing):
    land = tmp_path / "land"
    land.mkdir()
    want = tree(land)
    deep = land / "1/2/3/4/5/6"
    deep.mkdir(parents=True)
    (deep / "deep.sql").write_text("deep")
    want = {k: v for k, v in want.items() if v} | {f"file:{deep}/deep.sql": "deep"}
    assert streamed(spark, str(land), tmp_path, listing=listing)[0] == want
    (land / "x" / "later.sql").write_text("later")
    (land / "a.sql").write_text("seen by its path")
    want |= {f"file:{land}/x/later.sql": "later"}
    assert streamed(spark, str(land), tmp_path, listing=listing)[0] == want


def test_stream_is_listed_by_executors(spark, tmp_path):
    """A folder for each script, and no path in the sources that the driver keeps."""
    land = tmp_path / "land"
    for i in range(300):
        (land / f"id={i}").mkdir(parents=True)
        (land / f"id={i}" / "part.txt").write_text(f"text {i}")
    got, progress = streamed(spark, str(land), tmp_path)
    assert sorted(got.values()) == sorted(f"text {i}" for i in range(300))
    assert [s.description for s in progress.sources if "FileStream" in s.description] == []
    assert not list((tmp_path / "stream-state").glob("sources/*/*"))


def test_stream_waits_for_empty_files(spark, tmp_path):
    land = tmp_path / "land"
    with pytest.raises(FileNotFoundError):
        sl.stream_scripts(spark, str(land))
    land.mkdir()
    (land / "a.sql").write_text("")
    (land / "b.sql").write_text("b")
    assert streamed(spark, str(land), tmp_path)[0] == {f"file:{land}/b.sql": "b"}
    (land / "a.sql").write_text("a")
    assert streamed(spark, str(land), tmp_path)[0] == {f"file:{land}/b.sql": "b", f"file:{land}/a.sql": "a"}


def test_stream_goes_on_after_a_failed_batch(spark, tmp_path):
    land = tmp_path / "land"
    land.mkdir()
    (land / "a.sql").write_text("a")
    (land / "b.sql").write_bytes(b"b\xff")
    with pytest.raises(Exception, match="(?i)utf"):
        streamed(spark, str(land), tmp_path)
    (land / "b.sql").write_text("b")
    (land / "c.sql").write_text("c")
    want = {f"file:{land}/{c}.sql": c for c in "abc"}
    assert streamed(spark, str(land), tmp_path)[0] == want
    with pytest.raises(ValueError, match="listing"):
        sl.stream_scripts(spark, str(land), listing="other")


def test_stream_of_one_file(spark, tmp_path):
    (tmp_path / "one.sql").write_text("one")
    (tmp_path / "two.sql").write_text("two")
    for form in ("{}", "file:{}", "file://{}"):
        got, _ = streamed(spark, form.format(tmp_path / "one.sql"), tmp_path)
        assert got == {f"file:{tmp_path}/one.sql": "one"}


def test_one_file_a_pattern_and_nothing(spark, tmp_path):
    tree(tmp_path)
    assert [r.source for r in sl.read_scripts(spark, str(tmp_path / "a.sql")).collect()] == ["one"]
    assert {r.source for r in sl.read_scripts(spark, f"{tmp_path}/x/*").collect()} == {"", "drei é"}
    (tmp_path / "empty").mkdir()
    assert sl.read_scripts(spark, str(tmp_path / "empty")).count() == 0
    with pytest.raises(FileNotFoundError):
        sl.read_scripts(spark, str(tmp_path / "absent"))


def test_folders_by_size(spark, tmp_path, monkeypatch):
    from scriptloom.sources import sinks

    df = spark.range(200).selectExpr("CAST(id AS string) AS script_id", "repeat('x', 50) AS code")
    for chars, most in ((1 << 20, 1), (1000, 10)):
        monkeypatch.setattr(sinks, "FOLDER_CHARS", chars)
        sl.write_scripts(df, str(tmp_path / str(chars)))
        assert len([f for f in (tmp_path / str(chars)).iterdir() if f.is_dir()]) == most
        assert sl.read_written_scripts(spark, str(tmp_path / str(chars))).count() == 200
