from collections import Counter

import pytest
from pyspark.sql import functions as F

import scriptloom as sl
from scriptloom.operators import keyed
from scriptloom.operators.keyed import hot_keys, join_unique
from scriptloom.plans import flows


def chunks(spark, rows):
    return spark.createDataFrame(rows, "script_id string, chunk_no int, code string")


def test_map_chunks_keeps_unmatched(spark):
    orig = chunks(spark, [("a", 1, "x"), ("a", 2, "y")])
    conv = spark.createDataFrame([("a", 1, "(")], "script_id string, chunk_no int, converted string")
    got = {r.chunk_no: r for r in sl.map_chunks(orig, conv).collect()}
    assert got[1].converted == "(" and got[1].is_valid is False
    assert (got[2].original, got[2].converted, got[2].is_valid, got[2].comments) == ("y", None, None, None)


def test_report_columns(spark, scripts):
    conv = spark.createDataFrame([("0", 1, "z")], "script_id string, chunk_no int, converted string")
    report = flows.audit_report(scripts("A;\n/\nbegin b; end;"), conv)
    assert report.columns == [
        "script_id", "Sr No", "Chunk ID", "Block Type", "Line Count", "Original", "Converted",
    ]
    rows = sorted(report.collect(), key=lambda r: r["Sr No"])
    assert [r["Block Type"] for r in rows] == ["UNKNOWN", "ANONYMOUS_BLOCK"]
    assert rows[0]["Converted"].endswith("\nz") and rows[1]["Converted"] is None


def test_summary_totals(spark):
    df = spark.createDataFrame(
        [("a", "X", True, 2), ("a", "X", False, 3), ("a", "Y", True, 1), ("b", "X", None, 4)],
        "script_id string, block_type string, is_valid boolean, line_count int",
    )
    got = {
        (r.script_id, r.block_type): (r.level, r.n_chunks, r.n_valid, r.n_lines)
        for r in sl.audit_summary(df).collect()
    }
    assert got == {
        ("a", "X"): (0, 2, 1, 5),
        ("a", "Y"): (0, 1, 1, 1),
        ("b", "X"): (0, 1, 0, 4),
        ("a", None): (1, 3, 2, 6),
        ("b", None): (1, 1, 0, 4),
        (None, None): (3, 4, 2, 10),
    }


def copies(spark):
    """One content holds a third of all rows."""
    return (
        spark.range(3000)
        .selectExpr(
            "CAST(id % 50 AS string) AS script_id",
            "CAST(id AS int) AS chunk_no",
            "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 3 = 1 THEN CAST(id % 40 AS string)"
            " ELSE CAST(id AS string) || 'u' END AS code",
        )
        .repartition(7)
    )


@pytest.mark.parametrize("late", [False, True])
@pytest.mark.parametrize("bits", [15, 25])
def test_dedup_and_copies(spark, monkeypatch, late, bits):
    monkeypatch.setattr(keyed, "BITMAP_BITS", bits)
    rows = copies(spark).collect()
    first = {}
    for r in sorted(rows, key=lambda r: (r.script_id, r.chunk_no)):
        first.setdefault(r.code, (r.script_id, r.chunk_no))
    n = Counter(r.code for r in rows)

    kept = sl.dedup_chunks(copies(spark), late=late).collect()
    assert {r.code: (r.script_id, r.chunk_no) for r in kept} == first
    assert {r.code: r.n_copies for r in kept} == dict(n)

    labelled = sl.label_copies(copies(spark), late=late).collect()
    assert len(labelled) == len(rows) - len(first)
    for r in labelled:
        assert (r.first_script_id, r.first_chunk_no) == first[r.code]
        assert r.n_copies == n[r.code]
        assert (r.script_id, r.chunk_no) != first[r.code]


def test_late_rows_without_code_and_of_one_place(spark, monkeypatch):
    rows = [("a", 1, None), ("a", 1, None), ("a", 2, "x"), ("a", 2, "x"), (None, 1, "y"), ("b", 1, "y"), ("c", 1, "")]
    df = chunks(spark, rows)
    for bits in (3, 25):
        monkeypatch.setattr(keyed, "BITMAP_BITS", bits)
        got = sl.dedup_chunks(df, late=True)
        assert got.columns == sl.dedup_chunks(df).columns
        found = sorted((str(r.script_id), r.chunk_no, str(r.code), r.n_copies) for r in got.collect())
        assert found == [
            ("None", 1, "y", 2), ("a", 1, "None", 1), ("a", 1, "None", 1), ("a", 2, "x", 2), ("c", 1, "", 1)
        ]
        labelled = sl.label_copies(df, late=True).collect()
        assert [(r.script_id, r.first_script_id, r.first_chunk_no) for r in labelled] == [("b", None, 1)]
        assert sl.dedup_chunks(df.limit(0), late=True).count() == 0


def nodes(plan):
    children = plan.children()
    yield plan
    for i in range(children.size()):
        yield from nodes(children.apply(i))


def test_text_fetched_late_is_shuffled_only_behind_a_bitmap(spark, tmp_path):
    path = str(tmp_path / "rows")
    copies(spark).write.parquet(path)
    df = spark.read.parquet(path)
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        for late, holders in ((sl.dedup_chunks(df, late=True), 1), (sl.label_copies(df, late=True), 1)):
            moved = 0
            for node in nodes(late._jdf.queryExecution().executedPlan()):
                output = node.output()
                has_text = any(output.apply(i).name() == "code" for i in range(output.size()))
                assert not (has_text and "Aggregate" in node.nodeName())
                if has_text and node.nodeName() == "Exchange":
                    moved += 1
                    below = [x.simpleString(1000) for x in nodes(node.children().apply(0))]
                    assert any(x.startswith("Filter") and "getbit" in x for x in below)
            assert moved == holders
        plain = nodes(sl.dedup_chunks(df)._jdf.queryExecution().executedPlan())
        assert any("Aggregate" in node.nodeName() and "code#" in node.simpleString(1000) for node in plain)
    finally:
        for key in settings:
            spark.conf.unset(key)


def test_hot_keys_and_salted_join(spark):
    # disable broadcasting, so the salted shuffle itself is what runs
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        left = spark.range(30000).selectExpr(
            "id", "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 3 = 1 THEN CAST(id AS string) END AS k"
        )
        right = spark.createDataFrame([("hot", 1), ("4", 2), ("no", 3)], "k string, v int")
        assert [r.k for r in hot_keys(left, ["k"]).collect()] == ["hot"]
        joined = join_unique(left, right, ["k"], "left", ["id"])
        assert joined.count() == 30000
        assert joined.filter("v = 1").count() == 10000 and joined.filter("v = 2").count() == 1
        rest = join_unique(left, right, ["k"], "left_anti", ["id"])
        assert rest.count() == 19999
        assert join_unique(left, right, ["k"], "inner", ["id"]).count() == 10001
        assert join_unique(left, right, ["k"], "left_semi", ["id"]).columns == ["id", "k"]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")


def test_assemble_orders_by_number(spark):
    rows = [("a", i, f"line {i}") for i in range(1, 3500)] + [("b", 2, "y"), ("b", 1, "")]
    got = {r.script_id: r.code for r in sl.assemble(chunks(spark, rows).repartition(6)).collect()}
    assert got["a"] == "\n".join(f"line {i}" for i in range(1, 3500)) and got["b"] == "\ny"


def test_final_scripts(spark):
    conv = spark.createDataFrame(
        [("a", 2, "df.select('x')"), ("a", 1, "from pyspark.sql import SparkSession")],
        "script_id string, chunk_no int, converted string",
    )
    row = flows.final_scripts(conv).first()
    assert row.is_valid
    assert row.annotated.endswith("\nfrom pyspark.sql import SparkSession\ndf.select('x')")


def test_only_new(spark, scripts):
    batch = sl.scripts_from(scripts("a", "b", "b", "c"), "script_id", "source")
    seen = sl.scripts_from(scripts("c", "c"), "script_id", "source")
    assert {r.script_id for r in sl.only_new(batch, seen).collect()} == {"0", "1", "2"}
    first = sl.only_new(batch, seen, within_batch="first")
    assert first.columns == batch.columns
    assert {(r.script_id, r.source) for r in first.collect()} == {("0", "a"), ("1", "b")}
    known = sl.extend_seen(seen, batch)
    assert known.count() == 3 and sl.only_new(batch, known).count() == 0
    assert flows.structured_new(batch, seen).count() == 3


def test_summaries_of_batches(spark, tmp_path):
    rows = [(f"s{i % 5}", i, "XY"[i % 2], i % 3 == 0, i) for i in range(60)]
    df = spark.createDataFrame(rows, "script_id string, chunk_no int, block_type string, is_valid boolean, line_count int")
    for batch in ("a", "b", "c", "b"):
        mine = df.filter(F.element_at(F.array(*map(F.lit, "abc")), F.col("chunk_no") % 3 + 1) == batch)
        sl.keep_partials(sl.audit_partials(mine), str(tmp_path), batch)
    kept = spark.read.parquet(str(tmp_path))
    assert kept.count() <= 30
    whole = sl.audit_summary(df)
    assert sorted(map(str, sl.summary_of(kept).collect())) == sorted(map(str, whole.collect()))


def test_seen_table(spark, tmp_path, scripts):
    """Batches one after another: as with frames, and the table is never shuffled."""
    name = "seen_hashes_of_test"
    sl.create_seen(spark, name, buckets=8, path=str(tmp_path / "seen"))
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        hot = ["same text"] * 500
        batches = [["a", "b", "b", None], [*hot, "b", "c", None], [*hot, "a"], []]
        seen = spark.createDataFrame([], "content_hash string")
        for texts in batches:
            df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
            batch = sl.scripts_from(df, "id", "t")
            for within in ("all", "first"):
                new = sl.only_new_to(batch, name, within_batch=within)
                want = sl.only_new(batch, seen, within_batch=within)
                assert sorted(map(tuple, new.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
                assert new.columns == batch.columns
            plan = new._jdf.queryExecution().executedPlan().toString()
            sl.add_seen(batch, name)
            sl.add_seen(batch, name)
            seen = sl.extend_seen(seen, batch).filter("content_hash IS NOT NULL")
            assert spark.table(name).count() == seen.count()
        # an exchange below a scan of the table would stand between the two in the plan's text
        at = next(i for i, x in enumerate(plan.splitlines()) if "seen_hashes_of_test" in x)
        above = [x for x in plan.splitlines()[:at] if x.index(x.strip(" :+-")[0]) < plan.splitlines()[at].index("FileScan")]
        nearest = [x for x in above[::-1] if "Join" in x or "Exchange" in x][0]
        assert "Join" in nearest
    finally:
        for key in settings:
            spark.conf.unset(key)
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_conversions_are_not_broadcast(spark):
    """A table of few rows, each exploded into many conversions, has a small size on paper."""
    orig = spark.range(40).selectExpr("'s' AS script_id", "CAST(id AS int) AS chunk_no", "'x' AS code")
    conv = spark.range(1).selectExpr("'s' AS script_id", "explode(sequence(0, 29)) AS chunk_no", "'y' AS converted")
    found = sl.map_chunks(orig, conv)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == 40 and found.filter("converted = 'y'").count() == 30
