"""Inputs of the registered queries: the given tables and text that is derived from them.

Scripts and converted code are built row by row from `customer` and `orders` with one SQL
expression that both Spark and DuckDB can run, so both sides see the same text. No row is
grouped with another, so their number grows with the tables and their size does not.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptloom.sources.scripts import scripts_from

MOST_CHUNKS = 30
#: Tasks for each core, and the most rows of a task, where rows become long texts.
TASKS_A_CORE = 4
TASK_ROWS = 20_000
LF = "chr(10)"
N = "(3 + c_custkey * 7 % 40)"
K = "CAST(c_custkey AS STRING)"
STEP = "CAST(i AS STRING)"
UPDATE = (
    "'UPDATE customer SET c_acctbal = c_acctbal + ' || " + STEP
    + " || ' WHERE c_custkey = ' || " + K + " || ' AND c_mktsegment = ''' || c_mktsegment || ''';'"
)


def _lines(*parts: str) -> str:
    return f" || {LF} || ".join(parts)


def _script_expression(repeat) -> str:
    """`repeat(n, body)` joins body for i = 1 .. n with LF, in the dialect at hand."""
    procedure = _lines(
        f"'CREATE OR REPLACE PROCEDURE settle_account_' || {K}",
        "'AS'",
        "'BEGIN'",
        repeat(N, UPDATE),
        "'END;'",
        "'  / '",
        "''",
        "'-- accounts that wait for the next run'",
        "'/'",
        "'/'",
        repeat("(c_custkey % 5 + 1)", "'DELETE FROM pending WHERE run = ' || " + STEP + " || ';'"),
        "'/'",
        f"'Create Trigger watch_' || {K} || ' BEFORE INSERT ON pending'",
        "'BEGIN'",
        "'  CHECK_LIMIT(' || CAST(CAST(floor(c_acctbal) AS BIGINT) AS STRING) || ');'",
        "'END;'",
        "'/'",
        "''",
    )
    blocks = _lines(
        repeat(
            "(c_custkey % 6 + 2)",
            _lines("'BEGIN'", UPDATE, f"'delete from t where a = ' || {STEP} || ';'", "'END ;'"),
        ),
        "'commit'",
    )
    nested = _lines(
        "'DECLARE'",
        "'  v NUMBER;'",
        "'BEGIN'",
        repeat(
            N,
            _lines(
                f"'IF v > ' || {STEP} || ' THEN'", "'  BEGIN'", UPDATE, "'  END'", "'END IF;'"
            ),
        ),
        "'END;'",
        repeat(N, UPDATE),
        "'COMMIT;'",
    )
    commented = _lines(
        "'/* header'",
        "'/'",
        "'BEGIN; */'",
        "'-- note with ; and BEGIN'",
        f"'CREATE TRIGGER t_' || {K} || ' AFTER INSERT ON orders'",
        "'BEGIN'",
        repeat(N, f"{UPDATE} || ' -- step ' || {STEP} || ' ; /'"),
        "'END;'",
        "'/'",
        "'-- only'",
        "'  -- comments'",
        "''",
        "'/'",
        repeat("3", UPDATE),
    )
    unmarked = repeat(
        "(60 + c_custkey % 150)", f"'line ' || {STEP} || ' of ' || c_mktsegment || chr(13)"
    )
    package = _lines(
        f"'create package  body pkg_' || {K} || ' is'",
        "'  total number;'",
        "'end;'",
        repeat(N, f"'COMMIT; -- ' || {STEP}"),
        "'INSERT INTO log VALUES ('",
        repeat("(80 + c_custkey % 40)", f"'  ''' || c_mktsegment || ''', ' || {STEP} || ','"),
        "'  0);'",
        "'begin'",
        repeat("(c_custkey % 30 + 1)", f"'-- step ' || {STEP}"),
        "'end;'",
        "'select ' || c_name || ' from dual'",
    )
    return f"""CASE c_custkey % 6 WHEN 0 THEN {procedure} WHEN 1 THEN {blocks}
        WHEN 2 THEN {nested} WHEN 3 THEN {commented} WHEN 4 THEN {unmarked}
        ELSE {package} END"""


CODE_EXPRESSION = f"""
    CASE WHEN o_orderkey % 11 = 0 THEN '# Gemini Error: quota ' || CAST(o_custkey AS STRING) || {LF} || 'retry'
         WHEN o_orderkey % 13 = 0 THEN '# OpenAI Error: ' || o_orderpriority
    ELSE
      CASE o_orderkey % 3 WHEN 0 THEN 'from pyspark.sql import functions as F' || {LF}
           WHEN 1 THEN 'import pyspark' || {LF} ELSE 'import  spark' || {LF} END
      || CASE o_orderkey % 4 WHEN 0 THEN 'spark = SparkSession.builder.getOrCreate()' || {LF}
           WHEN 1 THEN 'df = spark.read.table("orders")' || {LF}
           WHEN 2 THEN 'df = spark.table("orders")' || {LF} ELSE '' END
      || CASE o_orderkey % 5 WHEN 0 THEN 'df.select("o_orderkey")'
           WHEN 1 THEN 'df.withColumn("k", F.lit(' || CAST(o_custkey AS STRING) || ')'
           WHEN 2 THEN 'df.where(df.o_orderstatus == "' || o_orderstatus || '")'
           WHEN 3 THEN 'df.selectExpr("o_custkey").rdd' ELSE 'df.groupBy("o_custkey").agg()' END
      || CASE WHEN o_orderkey % 17 = 0 THEN {LF} || 'SQLContext(sc)' ELSE '' END
    END"""

SPARK_SCRIPT = _script_expression(
    lambda n, body: f"array_join(transform(sequence(1, {n}), i -> {body}), {LF})"
)
DUCKDB_SCRIPT = _script_expression(
    lambda n, body: f"array_to_string(list_transform(range(1, {n} + 1), lambda i: {body}), {LF})"
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _dealt(rows: DataFrame) -> DataFrame:
    """`rows` dealt over the tasks that the text made of them asks for. A file of narrow rows is
    read by one task, however much text each row becomes."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(max(TASKS_A_CORE * cores, -(-rows.count() // TASK_ROWS)))


def _texts(spark: SparkSession, sf_dir: str, name: str, id_col: str, text_col: str) -> DataFrame:
    return scripts_from(table(spark, sf_dir, name), id_col, text_col)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir, "documents", "doc_id", "text")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir, "pages", "page_id", "html")


def scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One procedural script per customer, in six shapes."""
    customers = _dealt(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment"))
    return scripts_from(
        customers.select("c_custkey", F.expr(SPARK_SCRIPT).alias("source")),
        "c_custkey",
        "source",
    )


def code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One piece of converted code per order."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").cast("string").alias("script_id"),
        F.col("o_orderkey").alias("chunk_no"),
        F.expr(CODE_EXPRESSION).alias("code"),
    )


def turns(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """User turns as originals, the assistant turns that follow as converted text."""
    said = table(spark, sf_dir, "conversations").withColumn(
        "script_id", F.col("conv_id").cast("string")
    )
    originals = said.filter("role = 'user'").select(
        "script_id", F.col("turn").alias("chunk_no"), F.col("text").alias("code")
    )
    converted = said.filter("role = 'assistant'").select(
        "script_id", (F.col("turn") - 1).alias("chunk_no"), F.col("text").alias("converted")
    )
    return originals, converted


def conversions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Converted text for chunks 1 to MOST_CHUNKS of each customer's script, which is as many as
    any has; one number in seven is left out, by a rule of key and number."""
    text = F.concat(
        F.lit("from pyspark.sql import SparkSession\ndf.filter('"), "c_mktsegment", F.lit("')")
    )
    return (
        table(spark, sf_dir, "customer")
        .select(
            "c_custkey",
            F.explode(F.sequence(F.lit(1), F.lit(MOST_CHUNKS))).alias("chunk_no"),
            text.alias("converted"),
        )
        .filter("(c_custkey + chunk_no) % 7 <> 0")
        .select(F.col("c_custkey").cast("string").alias("script_id"), "chunk_no", "converted")
    )
