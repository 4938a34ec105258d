"""NULLs, unknown names, doubled rows and far-apart numbers: nothing is lost without a word."""

import random

import pytest
from pyspark.sql import functions as F

import scriptloom as sl
from scriptloom.operators.keyed import hot_keys, numbered, running, spanned
from scriptloom.plans import flows


def test_numbering_raises_on_null(spark):
    for rows in ([("k", 1), (None, 2)], [("k", 1), ("k", None)]):
        df = spark.createDataFrame(rows, "script_id string, chunk_no int")
        with pytest.raises(Exception, match="the row has no place"):
            numbered(df, ["script_id"], "chunk_no", "n").collect()


def test_far_apart_numbers_share_spans(spark):
    df = spark.range(60_000).select(
        F.when(F.col("id") % 10 > 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 70)).alias("script_id"),
        (F.col("id") * 1_000_003).alias("chunk_no"),
    )
    out = numbered(df, ["script_id"], "chunk_no", "n", "total")
    hot = out.filter("script_id = 'hot'").orderBy("chunk_no").collect()
    assert [r.n for r in hot] == list(range(1, 54_001)) and hot[0].total == 54_000
    assert out.count() == 60_000
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "_span" in plan
    least = df.filter("script_id = 'hot'").agg(F.min("chunk_no"), F.max("chunk_no"), F.count("*")).first()
    width = (least[1] - least[0] + 1) * 4096 / least[2]
    spans = df.filter("script_id = 'hot'").groupBy(F.floor((F.col("chunk_no") - least[0]) / width)).count()
    assert 10 <= spans.count() <= 20 and spans.agg(F.max("count")).first()[0] < 0.1 * 54_000


def test_progress_of_splitter_output_has_no_exchange(spark, scripts):
    chunks = sl.split_lines(scripts("a\nb\nc", "d"), 1, total_as="n")
    out = sl.with_progress(chunks, total_col="n")
    assert sorted((r.script_id, r.position, r.n_chunks, r.fraction) for r in out.collect()) == [
        ("0", 1, 3, 1 / 3), ("0", 2, 3, 2 / 3), ("0", 3, 3, 1.0), ("1", 1, 1, 1.0),
    ]
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()


def test_a_missing_chunk_shows(spark):
    df = spark.createDataFrame([("s", 1, "x"), ("s", 2, None), ("s", 3, "z"), ("t", 1, "y")],
                               "script_id string, chunk_no int, code string")
    with pytest.raises(Exception, match="has no code"):
        sl.assemble(df).collect()
    got = {r.script_id: (r.code, r.missing) for r in sl.assemble(df, missing_as="missing").collect()}
    assert got == {"s": ("x\nz", 1), "t": ("y", 0)}
    good = "from pyspark.sql import SparkSession\ndf.select()"
    df = df.withColumn("code", F.when(F.col("code").isNotNull(), F.lit(good)))
    valid = {r.script_id: (r.is_valid, r.n_missing) for r in flows.final_scripts(df, code_col="code").collect()}
    assert valid == {"s": (False, 1), "t": (True, 0)}


def test_null_code_is_no_content(spark):
    df = spark.createDataFrame([("s", 1, None), ("s", 2, None), ("s", 3, "x"), ("s", 4, "x")],
                               "script_id string, chunk_no int, code string")
    got = sorted((r.chunk_no, r.code, r.n_copies) for r in sl.dedup_chunks(df).collect())
    assert got == [(1, None, 1), (2, None, 1), (3, "x", 2)]
    assert [r.chunk_no for r in sl.label_copies(df).collect()] == [4]


@pytest.mark.parametrize("within", ["all", "first"])
def test_null_text_is_never_a_copy(spark, within):
    new = sl.scripts_from(spark.createDataFrame([(1, None), (2, None), (3, "old"), (4, "n"), (5, "n")],
                                                "id int, t string"), "id", "t")
    seen = sl.scripts_from(spark.createDataFrame([(9, "old"), (8, None)], "id int, t string"), "id", "t")
    got = sorted(r.script_id for r in sl.only_new(new, seen, within_batch=within).collect())
    assert got == (["1", "2", "4", "5"] if within == "all" else ["1", "2", "4"])


def test_only_new_reads_texts_once_and_splits_a_hot_hash(spark):
    rows = spark.range(200_000).select(
        F.col("id").cast("string").alias("script_id"),
        F.when(F.col("id") % 2 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("content_hash"),
        F.sha2(F.col("id").cast("string"), 256).alias("source"),
    )
    seen = spark.range(100).select(F.col("id").cast("string").alias("content_hash"))
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        out = sl.only_new(rows, seen)
        assert out.count() == 200_000 - 50
        counted = out.groupBy().agg(F.sum(F.length("source")), F.max("script_id"))
        counted.collect()
        plan = counted._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert "skew=true" in plan
    assert plan.count("Range (0, 200000") == 1


def test_hot_keys_count_and_total_share_a_plan(spark, tmp_path):
    spark.range(1000).selectExpr("id % 7 AS k", "id").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    found = hot_keys(df, ["k"])
    assert found.count() == 7
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange" in plan or plan.count("FileScan") <= 2


def test_unknown_and_other_case_columns(spark):
    df = spark.createDataFrame([(1, 10.0)], "id int, salary double")
    up = {"Salary": F.col("salary") * 2}
    assert sl.update_where(df, F.lit(True), up).first().salary == 20.0
    assert sl.update_if(df, F.col("id") == 1, F.lit(True), up).first().salary == 20.0
    with pytest.raises(ValueError, match="salry"):
        sl.update_where(df, F.lit(True), {"salry": F.lit(1)})
    with pytest.raises(ValueError, match="twice"):
        sl.update_where(df, F.lit(True), {"salary": F.lit(1), "SALARY": F.lit(2)})


def test_doubled_conversion_raises(spark):
    orig = spark.createDataFrame([("s", 1, "a"), ("s", 2, "b")], "script_id string, chunk_no int, code string")
    conv = spark.createDataFrame([("s", 1, "x"), ("s", 1, "y")], "script_id string, chunk_no int, converted string")
    with pytest.raises(Exception, match="more than one conversion"):
        sl.map_chunks(orig, conv).collect()
    assert sl.map_chunks(orig, conv, checked=False).count() == 3


def test_messages_and_white_space_stand_alone(spark):
    """Written out here, not taken from the code under test."""
    rows = [
        ("", "no_session,no_dataframe_api,no_import"),
        ("import spark\nspark.read.x().select(", "paren_mismatch"),
        ("from\u00a0pyspark import x\nSparkSession df.filter() .rdd", "legacy_api"),
        ("from \t\x1c pyspark\nspark.read.csv().groupBy()", ""),
        ("frompyspark\nspark.read.csv().groupBy()", "no_import"),
    ]
    df = spark.createDataFrame([(i, 1, c) for i, (c, _) in enumerate(rows)], "script_id int, chunk_no int, code string")
    got = {}
    for r in sl.findings(df).collect():
        got.setdefault(r.script_id, []).append(r.rule)
    assert [",".join(got.get(i, [])) for i in range(len(rows))] == [want for _, want in rows]
    said = {
        "no_session": "# ⚠️ No SparkSession usage detected. Did you forget to initialize Spark?",
        "no_dataframe_api": "# ⚠️ No DataFrame API patterns found. Ensure you are using DataFrame operations.",
        "legacy_api": "# ⚠️ SQLContext or RDD usage detected. Prefer DataFrame API for better optimization.",
        "paren_mismatch": "# ⚠️ Unmatched parentheses detected.",
        "no_import": "# ⚠️ No PySpark import detected. Add necessary imports.",
    }
    assert {r.rule: r.message for r in sl.findings(df).collect()} == said
    assert sl.annotate(df.filter("script_id = 3")).first().annotated.startswith(
        "# ✅ PySpark code passed static validation.\n"
    )


def test_one_far_number_leaves_a_hot_key_split(spark):
    """Numbers 1 to a million and one of 10^15: no span holds more than a small share."""
    near = spark.range(1, 1_000_001).select(F.lit("hot").alias("k"), F.col("id").alias("n"), F.lit("t").alias("text"))
    df = near.union(spark.createDataFrame([("hot", 10**15, "t"), ("other", 5, "t")], near.schema))
    spans = spanned(df, ["k"], "n").groupBy("k", "_span").count().collect()
    assert max(r["count"] for r in spans) < 0.01 * 1_000_002 and len(spans) > 200
    assert [r for r in spans if r.k == "other"][0]._span is None
    out = numbered(df, ["k"], "n", "place", "total")
    wrong = out.filter((F.col("k") == "hot") & (F.col("place") != F.least("n", F.lit(1_000_001))))
    assert wrong.count() == 0 and out.count() == 1_000_002
    assert {(r.k, r.total) for r in out.select("k", "total").distinct().collect()} == {("hot", 1_000_001), ("other", 1)}


def test_numbering_shuffles_rows_once(spark, tmp_path):
    spark.range(50_000).selectExpr("id % 3 AS k", "id * id AS n", "uuid() AS text").write.parquet(str(tmp_path / "t"))
    out = numbered(spark.read.parquet(str(tmp_path / "t")), ["k"], "n", "place")
    plan = out._jdf.queryExecution().executedPlan().toString()
    # text is in no shuffle but the one in front of the window, and in no broadcast
    assert plan.count("text#") and sum("text" in line and "Exchange" in line for line in plan.splitlines()) <= 1
    rows = sorted(out.collect(), key=lambda r: (r.k, r.n))
    assert [r.place for r in rows if r.k == 1] == list(range(1, 16_668))


@pytest.mark.parametrize("spread", [1, 10**6])
def test_running_sums_and_their_least(spark, spread):
    rng = random.Random(3)
    steps = [("hot", i * spread, rng.choice([-1, 0, 1])) for i in range(30_000)]
    steps += [(f"k{i % 40}", i, rng.choice([-1, 1])) for i in range(2_000)]
    df = spark.createDataFrame(steps, "k string, n long, step int").repartition(5)
    got = {(r.k, r.n): (r.total, r.least) for r in running(df, ["k"], "n", F.col("step"), "total", "least").collect()}
    state = {}
    for k, n, step in sorted(steps):
        total, least = state.get(k, (0, 10**9))
        state[k] = (total + step, min(least, total + step))
        assert got[k, n] == state[k]
    assert len(got) == len(steps)


def test_summary_of_a_mapping_moves_no_text(spark, tmp_path):
    orig = spark.range(100).selectExpr("'s' AS script_id", "id AS chunk_no", "'a' AS code", "'X' AS block_type", "1 AS line_count")
    spark.range(100).selectExpr("'s' AS script_id", "id AS chunk_no", "'df.select(1)' AS converted").write.parquet(str(tmp_path / "c"))
    out = sl.audit_summary(sl.map_chunks(orig, spark.read.parquet(str(tmp_path / "c"))))
    plan = out._jdf.queryExecution().executedPlan().toString()
    grouped = [x for x in plan.splitlines() if "Aggregate" in x or "Exchange" in x]
    assert grouped and not any("converted" in x for x in grouped) and "SortAggregate" not in plan
    assert out.filter("level = 3").first().n_chunks == 100
