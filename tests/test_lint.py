import pytest

import scriptloom as sl
from scriptloom.functions import fixed_values as fixed

GOOD = "from pyspark.sql import SparkSession\nspark.read.parquet('x').select('a')"


def coded(spark, *texts):
    rows = [(str(i), 1, t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "script_id string, chunk_no int, code string")


@pytest.mark.parametrize(
    ("code", "broken"),
    [
        (GOOD, []),
        (GOOD + ".rdd", ["legacy_api"]),
        ("SQLContext", ["no_session", "no_dataframe_api", "legacy_api", "no_import"]),
        (GOOD + ")(", []),
        (GOOD + "(", ["paren_mismatch"]),
        (GOOD.replace("from pyspark", "import pyspark"), ["no_import"]),
        (GOOD.replace("from pyspark", "import\t spark"), []),
        (GOOD.replace(".select", ".where"), ["no_dataframe_api"]),
        (GOOD.replace(".select", ".selectExpr"), []),
        (GOOD.replace("SparkSession", "sparksession").replace("spark.read", "Spark.read"), ["no_session"]),
        ("", ["no_session", "no_dataframe_api", "no_import"]),
    ],
)
def test_rules(spark, code, broken):
    df = coded(spark, code)
    found = [r.rule for r in sl.findings(df).collect()]
    assert found == broken
    flags = sl.with_rule_flags(df).drop("script_id", "chunk_no", "code").first().asDict()
    assert [rule for rule, hit in flags.items() if hit] == broken
    verdict = sl.annotate(sl.with_verdict(df)).first()
    assert verdict.is_valid == (not set(broken) - {"legacy_api"})
    assert len(verdict.comments) == max(len(broken), 1)
    if not broken:
        assert verdict.comments == [fixed.MSG_PASSED]
    assert verdict.annotated == "\n".join(verdict.comments) + "\n" + code


def test_legacy_only_is_valid_with_a_warning(spark):
    row = sl.with_verdict(coded(spark, GOOD + ".rdd")).first()
    assert row.is_valid and row.comments == [fixed.MSG_LEGACY]


def test_conversion_status(spark):
    df = coded(spark, "# Gemini Error: no\nmore", "x # OpenAI Error: y", "# OpenAI Error:", None)
    got = {r.script_id: (r.status, r.error) for r in sl.with_conversion_status(df, code_col="code").collect()}
    assert got == {
        "0": ("error", "no\nmore"),
        "1": ("ok", None),
        "2": ("error", ""),
        "3": ("missing", None),
    }
    own = sl.with_conversion_status(coded(spark, "ERR(1)*"), ["ERR(1)"], code_col="code").first()
    assert (own.status, own.error) == ("error", "*")


def test_rule_summary(spark):
    df = coded(spark, "(", "(", GOOD)
    got = {r.rule: (r.n_findings, r.n_chunks) for r in sl.rule_summary(sl.findings(df)).collect()}
    assert got["paren_mismatch"] == (2, 2) and "legacy_api" not in got
