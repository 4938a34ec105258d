import pytest

import scriptloom as sl


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("x := 'a--b'; -- c", "x := 'a"),
        ("a /* b\n*/c/**/d", "a cd"),
        ("a /* b", "a /* b"),
        ("/* -- */a", "a"),
        ("-- /* x\n*/\ny", "\ny"),
        ("a -- b\r\nc", "a \nc"),
        ("a --b\u2028c\nd", "a \nd"),
    ],
)
def test_strip_comments(scripts, text, expected):
    assert sl.strip_comments(scripts(text)).first().source == expected


def test_newlines(scripts):
    assert sl.normalize_newlines(scripts("a\r\nb\rc\n\r")).first().source == "a\nb\nc\n\n"


def test_drop_blank(scripts):
    rows = sl.drop_blank(scripts(" \xa0\n\t", "\u3000a b\x1f", ""), "source").collect()
    assert [r.source for r in rows] == ["a b"]


def test_drop_comment_only(scripts):
    kept = sl.drop_comment_only(scripts("-- a\n\n  --b", "-- a\nb", " - - a", ""), "source")
    assert {r.source for r in kept.collect()} == {"-- a\nb", " - - a"}


@pytest.mark.parametrize(
    ("code", "expected"),
    [
        ("create package body p", "PACKAGE_BODY"),
        ("x;\nCREATE  OR\nREPLACE\tPackage  Body p", "PACKAGE_BODY"),
        ("create package p", "PACKAGE"),
        ("create function f; create procedure p", "FUNCTION"),
        ("create trigger t", "TRIGGER"),
        ("create table t; create procedure p", "PROCEDURE"),
        ("\n begin null; end;", "ANONYMOUS_BLOCK"),
        ("declare x number;", "UNKNOWN"),
        ("create functional", "UNKNOWN"),
        ("", "UNKNOWN"),
    ],
)
def test_block_type(spark, code, expected):
    df = spark.createDataFrame([(code,)], "code string")
    assert sl.with_block_type(df).first().block_type == expected


def test_counts_are_in_code_points(spark):
    df = spark.createDataFrame([("é\n😀\n",), ("",)], "code string")
    assert [(r.line_count, r.n_chars) for r in sl.with_counts(df).collect()] == [(3, 4), (1, 0)]


def test_ids_grow_past_three_digits(spark):
    df = spark.range(1, 1235).selectExpr("'s' AS script_id", "CAST(id AS int) AS chunk_no")
    for dense in (True, False):
        ids = {r.serial: r.chunk_id for r in sl.with_chunk_id(df, dense=dense).collect()}
        assert ids[7] == "blk_007" and ids[1234] == "blk_1234"


def test_serials_with_gaps_and_a_hot_script(spark):
    """One script owns most rows and its numbers span many windows."""
    hot = spark.range(0, 60000, 3).selectExpr("'hot' AS script_id", "id * 7 AS chunk_no")
    rest = spark.range(300).selectExpr("CAST(id % 100 AS string) AS script_id", "id AS chunk_no")
    df = hot.union(rest).repartition(5)
    rows = sl.with_progress(df).collect()
    assert len(rows) == 20300
    by_script = {}
    for r in rows:
        by_script.setdefault(r.script_id, []).append(r)
    for found in by_script.values():
        found.sort(key=lambda r: r.chunk_no)
        n = len(found)
        assert [r.position for r in found] == list(range(1, n + 1))
        assert {r.n_chunks for r in found} == {n}
        assert [r.fraction for r in found] == [i / n for i in range(1, n + 1)]
