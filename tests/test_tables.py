import pytest
from pyspark.sql import functions as F

import scriptloom as sl


@pytest.fixture
def staff(spark):
    return spark.createDataFrame(
        [(1, 10, 100.0), (2, 10, None), (3, 20, 50.0), (4, None, 70.0)],
        "id int, department_id int, salary double",
    )


def salaries(df):
    return {r.id: r.salary for r in df.collect()}


def test_count(staff):
    assert sl.count_where(staff, F.col("department_id") == 10).first().n == 2
    assert sl.count_where(staff, F.col("department_id") == 99).first().n == 0


def test_update_where(staff):
    cond = F.col("department_id") != 20  # NULL department is no match
    got = sl.update_where(staff, cond, {"salary": F.col("salary") * 2})
    assert salaries(got) == {1: 200.0, 2: None, 3: 50.0, 4: 70.0}
    assert got.dtypes == staff.dtypes


def test_update_reads_old_values(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    row = sl.update_where(df, F.lit(True), {"a": F.col("b"), "b": F.col("a")}).first()
    assert (row.a, row.b) == (2, 1)


@pytest.mark.parametrize(("guard", "raised"), [(20, True), (99, False)])
def test_update_if(staff, guard, raised):
    got = sl.update_if(
        staff,
        F.col("department_id") == guard,
        F.col("department_id") == 10,
        {"salary": F.col("salary") * 2},
    )
    assert salaries(got) == {1: 200.0 if raised else 100.0, 2: None, 3: 50.0, 4: 70.0}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_lookup(spark, staff):
    ref = spark.createDataFrame(
        [(10, "ten"), (20, "x"), (20, "x"), (30, "y")], "dept int, name string"
    )
    kwargs = {"ref_key": "dept", "row_id": "id"}
    got = {
        r.id: (r.name, r.status)
        for r in sl.lookup(staff, ref, "department_id", "name", **kwargs).collect()
    }
    assert got == {
        1: ("ten", "OK"),
        2: ("ten", "OK"),
        3: (None, "TOO_MANY_ROWS"),
        4: (None, "NO_DATA_FOUND"),
    }
    ok = sl.lookup(staff.filter("id < 3"), ref, "department_id", "name", strict=True, **kwargs)
    assert ok.count() == 2 and {r.name for r in ok.collect()} == {"ten"}
    with pytest.raises(Exception, match="TOO_MANY_ROWS for department_id 20"):
        sl.lookup(staff.filter("id = 3"), ref, "department_id", "name", strict=True, **kwargs).collect()
