"""Scripts as rows of lines: the same as in a cell, and as a plain loop over many rows."""

import random

import pytest
from pyspark.sql import functions as F

import scriptloom as sl
from scriptloom.operators import keyed, lines


def rows_of(df, text_col="line"):
    """Lines of scripts as rows with numbers that have gaps."""
    cells = F.posexplode(F.split("source", "\n")).alias("i", text_col)
    return df.select("script_id", cells).select("script_id", (F.col("i") * 10 + 3).alias("line_no"), text_col)


def some_scripts(rng, n):
    words = ["BEGIN", "END;", "/", " / ", "x;", "if x then", "begin y; end", "", "  ", "select 1", "end if;", "a/"]
    return ["\n".join(rng.choice(words) for _ in range(rng.randrange(1, 90))) + "\nlast" for _ in range(n)]


@pytest.fixture
def many(scripts):
    return scripts(*some_scripts(random.Random(4), 40))


def test_depth_is_that_of_a_cell(many):
    got = {(r.script_id, r.line_no): (r.line, r.depth) for r in lines.depth_of_lines(rows_of(many)).collect()}
    want = {(r.script_id, r.line_no * 10 - 7): (r.line, r.depth) for r in sl.line_depth(many).collect()}
    assert got == want


def joined(df, number, chunk_col, clean=lambda text: text):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.script_id, r.line_no)):
        out.setdefault((r.script_id, r[number]), []).append(r[chunk_col])
    return {k: clean("\n".join(v)) for k, v in out.items()}


def test_blocks_are_those_of_a_cell(many):
    got = joined(lines.top_level_of_lines(rows_of(many)), "block_no", "line", str.rstrip)
    want = {(r.script_id, r.chunk_no): r.code for r in sl.split_top_level(many).collect()}
    assert got == want and len(want) > 60


@pytest.mark.parametrize("most", [1, 4, 25])
def test_safe_chunks_are_those_of_a_cell(many, most):
    got = joined(lines.safe_chunks_of_lines(rows_of(many), most), "chunk_no", "line")
    want = {(r.script_id, r.chunk_no): r.code for r in sl.split_safe(many, most).collect()}
    assert got == want and len(want) > 60


@pytest.mark.parametrize(("small", "cap"), [(180, 300), (5, 9), (6, 3), (1, 0)])
def test_batches_are_those_of_a_cell(many, small, cap):
    got = joined(lines.batch_rows(rows_of(many), small, cap), "batch_no", "line")
    cells = many.withColumn("fragments", F.split("source", "\n"))
    want = {(r.script_id, r.chunk_no): r.code for r in sl.batch_small(cells, small, cap).collect()}
    assert got == want


@pytest.mark.parametrize("most", [5, 30])
def test_size_runs_are_those_of_a_cell(many, most):
    parts = many.select("script_id", F.posexplode(F.split("source", ";")).alias("line_no", "line"))
    got = {}
    for r in sorted(lines.size_runs(parts, most).collect(), key=lambda r: (r.script_id, r.line_no)):
        got.setdefault((r.script_id, r.run_no), []).append(r.line + ";")
    want = {(r.script_id, r.chunk_no): r.code for r in sl.rechunk_by_size(many, most).collect()}
    strip = str.maketrans("", "", " \n")
    long = {i for i, t in ((r.script_id, r.source) for r in many.collect()) if len(t) > most}
    assert {k: "\n".join(v).translate(strip) for k, v in got.items() if k[0] in long} == {
        k: v.translate(strip) for k, v in want.items() if k[0] in long
    }


def test_one_script_of_many_rows_is_split_over_tasks(spark, monkeypatch):
    """A hot script next to small ones; the fold by a plain loop."""
    monkeypatch.setattr(lines, "RUNS", 16)
    n = 300_000
    text = F.expr("repeat('x', CAST(1 + pmod(hash(id), 40) + CASE WHEN id % 97 = 0 THEN 200 ELSE 0 END AS int))")
    df = spark.range(n).select(F.when(F.col("id") % 50 > 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 700)).alias("script_id"),
                               (F.col("id") * 3).alias("line_no"), text.alias("line"))
    out = lines.batch_rows(df)
    got = {(r.script_id, r.line_no): r.batch_no for r in out.select("script_id", "line_no", "batch_no").collect()}
    assert len(got) == n
    state = {}
    for r in df.select("script_id", "line_no", F.length("line").alias("n")).orderBy("line_no").collect():
        held, batch = state.get(r.script_id, (0, 0))
        if held == 0 or r.n >= 180:
            batch += 1
        held = 0 if r.n >= 180 or held + r.n > 300 else held + r.n
        state[r.script_id] = held, batch
        assert got[r.script_id, r.line_no] == batch
    spans = keyed.spanned(df, ["script_id"], "line_no").groupBy("script_id", "_span").count()
    assert spans.agg(F.max("count")).first()[0] < 0.05 * n


def test_texts_are_not_collected(spark, tmp_path):
    spark.range(10).selectExpr("'s' AS script_id", "id AS line_no", "'x' AS line").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    for out in (lines.batch_rows(df), lines.safe_chunks_of_lines(df, 3), lines.top_level_of_lines(df)):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert not any("line#" in x for x in plan.splitlines() if "collect_list" in x)


def test_empty_and_null(spark):
    none = spark.createDataFrame([], "script_id string, line_no long, line string")
    bad = spark.createDataFrame([("s", 1, None)], none.schema)
    for fn in (lines.depth_of_lines, lines.top_level_of_lines, lines.batch_rows, lines.size_runs, lines.safe_chunks_of_lines):
        assert fn(none).count() == 0
        with pytest.raises(Exception, match="no place"):
            fn(bad).collect()


def test_span_of_a_row_among_many_bounds(spark, monkeypatch):
    """The bounds of a hot key are searched by halves, not one by one."""
    monkeypatch.setattr(keyed, "SPAN_ROWS", 4)
    rows = spark.range(5000).selectExpr("0 AS script_id", "id * 7 - 900 AS line_no")
    out = keyed.spanned(rows, ["script_id"], "line_no")
    assert "filter(_bounds" not in out._jdf.queryExecution().optimizedPlan().toString()
    spans = [(r.line_no, r["_span"]) for r in out.collect()]
    ordered = [s for _, s in sorted(spans)]
    assert ordered == sorted(ordered) and len(set(ordered)) > 500
    assert max(ordered.count(s) for s in set(ordered)) < 100
