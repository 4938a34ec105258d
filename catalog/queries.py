"""Registered queries: each operator over whole given tables or text derived from them."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import scriptloom as sl
from catalog import inputs
from scriptloom.functions import lint, splitting
from scriptloom.plans import flows
from scriptloom.session import kept, scratch
from scriptloom.sources.listing import _opened, can_list
from scriptloom.sources.scripts import scripts_from

#: The folder of rows without a key, as Spark names it.
NO_SCRIPT = "__HIVE_DEFAULT_PARTITION__"

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


# --- sources and sinks ---------------------------------------------------------------


def _landed(scripts: DataFrame, folder: str, files_a_folder: int | None = None) -> None:
    """Script files: one folder per customer, one text file in each, whose lines are the rows of
    that customer. Tasks write them through Arrow, as there are many and Hadoop's local store
    takes milliseconds for each. A file appears under its name when it is whole, and another
    attempt of its task writes the same one; each call adds files of its own.

    With `files_a_folder` each task fills one folder after the other with so many of these files:
    a folder takes as much disk as a short file, and as long to make and to delete."""
    rows = scripts.select("script_id", F.col("source").alias("value")).repartition(32, "script_id")
    if not can_list(folder):
        rows.write.mode("append").option(
            "mapreduce.fileoutputcommitter.algorithm.version", "2"
        ).partitionBy("script_id").text(folder)
        return
    call = uuid.uuid4().hex

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, inside, _ = _opened(folder)
        cells = (c for b in batches for c in zip(b["script_id"].to_pylist(), b["value"].to_pylist(), strict=True))
        n, task = 0, TaskContext.get().partitionId()
        for script, same in groupby(cells, itemgetter(0)):
            key = f"script_id={NO_SCRIPT if script is None else script}"
            home, name = f"{inside}/{key}", f"part-{call}.txt"
            if files_a_folder:
                home, name = f"{inside}/{call}-{task}-{n // files_a_folder}", f"{key}.txt"
            store.create_dir(home, recursive=True)
            hidden = f"{home}/.{uuid.uuid4().hex}"
            with store.open_output_stream(hidden) as file:
                for _, value in same:
                    file.write((value or "").encode() + b"\n")
            store.move(hidden, f"{home}/{name}")
            n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    written = rows.sortWithinPartitions("script_id").mapInArrow(write, "n long")
    written.write.format("noop").mode("overwrite").save()


SCRIPT_OF_PATH = "regexp_extract(path, 'script_id=([^/]*)/', 1) AS script_id"


@query
def read_script_files(spark, sf_dir):
    with scratch(spark, "scripts") as folder:
        _landed(inputs.scripts(spark, sf_dir), folder)
        files = sl.read_scripts(spark, folder)
        return kept(files.selectExpr(SCRIPT_OF_PATH, "source", "content_hash"))


@query
def scripts_from_column(spark, sf_dir):
    return inputs.documents(spark, sf_dir).select("script_id", "source", "content_hash")


@query
def mapping_csv(spark, sf_dir):
    mapping = sl.map_chunks(*inputs.turns(spark, sf_dir)).select(
        "script_id", "chunk_no", "original", "converted", "annotated"
    )
    with scratch(spark, "mapping") as folder:
        sl.write_mapping_csv(mapping, folder)
        return kept(sl.read_mapping_csv(spark, folder, mapping.schema))


@query
def mapping_csv_indexed(spark, sf_dir):
    """The same files as one task each writes them, read in ranges."""
    mapping = sl.map_chunks(*inputs.turns(spark, sf_dir)).select(
        "script_id", "chunk_no", "original", "converted", "annotated"
    )
    with scratch(spark, "mapping") as folder:
        sl.write_mapping_csv(mapping, folder, rows_per_file=0)
        index = sl.record_index(spark, folder, part_bytes=1 << 18)
        return kept(sl.read_mapping_csv(spark, folder, mapping.schema, index=index))


@query
def write_script_files(spark, sf_dir):
    with scratch(spark, "documents") as folder:
        sl.write_scripts(inputs.documents(spark, sf_dir), folder, code_col="source")
        return kept(sl.read_written_scripts(spark, folder))


@query
def write_packed_scripts(spark, sf_dir):
    """Documents from their lines, in a few pack files."""
    lines = sl.split_lines(inputs.documents(spark, sf_dir), 1)
    with scratch(spark, "packs") as folder:
        manifest = sl.write_packs(lines, folder, pack_bytes=1 << 20)
        return kept(sl.read_packed_scripts(manifest))


# --- text ----------------------------------------------------------------------------


@query
def normalize_newlines(spark, sf_dir):
    return sl.normalize_newlines(inputs.scripts(spark, sf_dir)).select("script_id", "source")


@query
def strip_comments(spark, sf_dir):
    return sl.strip_comments(inputs.scripts(spark, sf_dir)).select("script_id", "source")


@query
def strip_comments_pages(spark, sf_dir):
    return sl.strip_comments(inputs.pages(spark, sf_dir)).select("script_id", "source")


@query
def drop_blank(spark, sf_dir):
    return sl.drop_blank(sl.split_lines(inputs.documents(spark, sf_dir), 1))


@query
def drop_comment_only(spark, sf_dir):
    return sl.drop_comment_only(sl.split_lines(inputs.scripts(spark, sf_dir), 2))


# --- splitters -----------------------------------------------------------------------


@query
def split_delimiter(spark, sf_dir):
    return sl.split_delimiter(inputs.scripts(spark, sf_dir))


@query
def split_lines(spark, sf_dir):
    return sl.split_lines(inputs.documents(spark, sf_dir))


@query
def split_pattern(spark, sf_dir):
    return sl.split_pattern(inputs.scripts(spark, sf_dir))


@query
def split_pattern_literal(spark, sf_dir):
    return sl.split_pattern(inputs.scripts(spark, sf_dir), "literal", "drop")


@query
def split_pattern_pages(spark, sf_dir):
    return sl.split_pattern(inputs.pages(spark, sf_dir))


@query
def split_statements(spark, sf_dir):
    return sl.split_statements(inputs.pages(spark, sf_dir))


@query
def split_statements_scripts(spark, sf_dir):
    return sl.split_statements(inputs.scripts(spark, sf_dir))


@query
def split_before_begin(spark, sf_dir):
    return sl.split_before_begin(inputs.scripts(spark, sf_dir))


@query
def rechunk_by_size(spark, sf_dir):
    return sl.rechunk_by_size(inputs.pages(spark, sf_dir))


@query
def split_top_level(spark, sf_dir):
    return sl.split_top_level(inputs.scripts(spark, sf_dir))


@query
def split_safe(spark, sf_dir):
    return sl.split_safe(inputs.scripts(spark, sf_dir), 25)


@query
def batch_small_lines(spark, sf_dir):
    lines = inputs.documents(spark, sf_dir).withColumn("fragments", F.split("source", "\n"))
    return sl.batch_small(lines)


@query
def batch_small_statements(spark, sf_dir):
    pages = inputs.pages(spark, sf_dir)
    return sl.batch_small(
        pages.withColumn("fragments", F.expr(splitting.by_statement("source")))
    )


@query
def chunk_scripts(spark, sf_dir):
    return sl.chunk_scripts(inputs.scripts(spark, sf_dir))


@query
def chunk_scripts_literal(spark, sf_dir):
    return sl.chunk_scripts(inputs.scripts(spark, sf_dir), leading_ws="literal", tail="drop")


@query
def chunk_pages(spark, sf_dir):
    return sl.chunk_scripts(inputs.pages(spark, sf_dir))


@query
def chunk_documents(spark, sf_dir):
    return sl.chunk_scripts(inputs.documents(spark, sf_dir))


@query
def structured_chunks(spark, sf_dir):
    return sl.structured_chunks(inputs.scripts(spark, sf_dir))


@query
def structured_chunks_short(spark, sf_dir):
    return sl.structured_chunks(inputs.scripts(spark, sf_dir), 20)


# --- metadata ------------------------------------------------------------------------


@query
def with_chunk_id(spark, sf_dir):
    kept = sl.drop_blank(sl.split_lines(inputs.documents(spark, sf_dir), 1))
    return sl.with_chunk_id(kept).select("script_id", "chunk_no", "serial", "chunk_id")


@query
def with_chunk_id_per_source(spark, sf_dir):
    """A few keys own all rows."""
    docs = inputs.table(spark, sf_dir, "documents").select("source", "lang", "doc_id")
    return sl.with_chunk_id(docs, keys=("source", "lang"), order="doc_id")


@query
def with_block_type(spark, sf_dir):
    blocks = sl.split_delimiter(inputs.scripts(spark, sf_dir))
    return sl.with_block_type(blocks).select("script_id", "chunk_no", "block_type")


@query
def with_counts(spark, sf_dir):
    return sl.with_counts(sl.split_lines(inputs.documents(spark, sf_dir), 9)).select(
        "script_id", "chunk_no", "line_count", "n_chars"
    )


@query
def line_depth(spark, sf_dir):
    return sl.line_depth(inputs.scripts(spark, sf_dir))


@query
def with_progress(spark, sf_dir):
    chunks = sl.split_lines(inputs.documents(spark, sf_dir), 5, total_as="n_chunks")
    return sl.with_progress(chunks, total_col="n_chunks").drop("code")


@query
def with_progress_anew(spark, sf_dir):
    """Chunks that were filtered, so their numbers have gaps."""
    chunks = sl.split_lines(inputs.documents(spark, sf_dir), 5).filter("chunk_no % 3 <> 1")
    return sl.with_progress(chunks).drop("code")


# --- scripts as rows of lines --------------------------------------------------------


def _script_lines(spark, sf_dir, script):
    """Lines of the customers' scripts as rows of larger scripts, which `script` names by the
    customer's number."""
    lines = sl.split_lines(inputs.scripts(spark, sf_dir), 1)
    place = F.col("script_id").cast("long") * 100_000 + F.col("chunk_no")
    return lines.select(
        script(F.col("script_id").cast("long")).alias("script_id"), place.alias("line_no"), F.col("code").alias("line")
    )


@query
def depth_of_lines(spark, sf_dir):
    """All scripts as one."""
    lines = _script_lines(spark, sf_dir, lambda number: F.lit(0).cast("long"))
    return sl.depth_of_lines(lines)


@query
def top_level_of_lines(spark, sf_dir):
    """All scripts as one."""
    lines = _script_lines(spark, sf_dir, lambda number: F.lit(0).cast("long"))
    return sl.top_level_of_lines(lines).drop("line")


@query
def safe_chunks_of_lines(spark, sf_dir):
    lines = _script_lines(spark, sf_dir, lambda number: number % 83)
    return sl.safe_chunks_of_lines(lines, 25).drop("line")


def _document_rows(spark, sf_dir, cut):
    """Parts of the documents as rows of larger scripts, a third of them of one script."""
    parts = F.posexplode(F.split("text", cut)).alias("pos", "line")
    number = F.col("doc_id")
    script = F.when(number % 3 == 0, F.lit(0).cast("long")).otherwise(number % 61 + 1)
    docs = inputs.table(spark, sf_dir, "documents").select(number, script.alias("script_id"), "text")
    place = number * 1_000_000 + F.col("pos")
    return docs.select("doc_id", "script_id", parts).select("script_id", place.alias("line_no"), "line")


@query
def batch_rows(spark, sf_dir):
    return sl.batch_rows(_document_rows(spark, sf_dir, "\n")).drop("line")


@query
def size_runs(spark, sf_dir):
    return sl.size_runs(_document_rows(spark, sf_dir, "[.]")).drop("line")


# --- static checks -------------------------------------------------------------------


def _rule_query(rule: str) -> None:
    def run(spark, sf_dir):
        flag = F.expr(lint.RULES[rule][0]("code")).cast("int").alias("broken")
        return inputs.code(spark, sf_dir).select("script_id", "chunk_no", flag)

    QUERIES[f"lint_{rule}"] = run


for _rule in lint.RULES:
    _rule_query(_rule)


@query
def lint_verdict(spark, sf_dir):
    return sl.with_verdict(inputs.code(spark, sf_dir)).select(
        "script_id",
        "chunk_no",
        F.col("is_valid").cast("int").alias("is_valid"),
        F.size("comments").alias("n_comments"),
        F.array_join("comments", "|").alias("comments"),
    )


@query
def lint_annotate(spark, sf_dir):
    return sl.annotate(inputs.code(spark, sf_dir)).drop("code")


@query
def lint_findings(spark, sf_dir):
    found = sl.findings(inputs.code(spark, sf_dir))
    return found.withColumn("invalidates", F.col("invalidates").cast("int"))


@query
def lint_findings_pages(spark, sf_dir):
    page = inputs.pages(spark, sf_dir)
    return sl.findings(page, code_col="source", keys=("script_id",)).select("script_id", "rule")


@query
def conversion_errors(spark, sf_dir):
    return sl.with_conversion_status(inputs.code(spark, sf_dir), code_col="code").drop("code")


# --- mapping and audit ---------------------------------------------------------------


@query
def map_chunks(spark, sf_dir):
    return sl.map_chunks(*inputs.turns(spark, sf_dir)).select(
        "script_id",
        "chunk_no",
        "original",
        "converted",
        F.col("is_valid").cast("int").alias("is_valid"),
        F.array_join("comments", "|").alias("comments"),
        "annotated",
    )


@query
def audit_table(spark, sf_dir):
    return flows.audit_report(inputs.scripts(spark, sf_dir), inputs.conversions(spark, sf_dir))


@query
def audit_summary(spark, sf_dir):
    return sl.audit_summary(
        flows.block_mapping(inputs.scripts(spark, sf_dir), inputs.conversions(spark, sf_dir))
    )


@query
def audit_summary_batches(spark, sf_dir):
    """Three batches of scripts, each summed up on its own and one of them twice; the whole is
    read from what was kept of them."""
    scripts, said = inputs.scripts(spark, sf_dir), inputs.conversions(spark, sf_dir)
    with scratch(spark, "partials") as folder:
        for batch in (0, 1, 2, 1):
            mine = F.col("script_id").cast("long") % 3 == batch
            mapping = flows.block_mapping(scripts.filter(mine), said.filter(mine))
            sl.keep_partials(sl.audit_partials(mapping), folder, str(batch))
        return kept(sl.summary_of(spark.read.parquet(folder)))


@query
def rule_summary_batches(spark, sf_dir):
    code = inputs.code(spark, sf_dir)
    with scratch(spark, "partials") as folder:
        for batch in (0, 1, 2):
            found = sl.findings(code.filter(F.col("chunk_no") % 3 == batch))
            sl.keep_partials(sl.rule_partials(found), folder, str(batch))
        return kept(sl.rules_of(spark.read.parquet(folder)))


@query
def rule_summary(spark, sf_dir):
    return sl.rule_summary(sl.findings(inputs.code(spark, sf_dir)))


@query
def dedup_chunks(spark, sf_dir):
    return sl.dedup_chunks(sl.split_lines(inputs.documents(spark, sf_dir), 1))


@query
def dedup_null_code(spark, sf_dir):
    """Every fifth document's lines have no code; they are nobody's copies."""
    lines = sl.split_lines(inputs.documents(spark, sf_dir), 1)
    code = F.when(F.col("script_id").cast("long") % 5 != 0, F.col("code"))
    return sl.dedup_chunks(lines.withColumn("code", code))


@query
def label_copies(spark, sf_dir):
    lines = sl.split_lines(inputs.documents(spark, sf_dir), 1)
    return sl.label_copies(lines).drop("code")


@query
def dedup_documents(spark, sf_dir):
    """Whole texts are long: rows are fetched once it is known which stay."""
    documents = inputs.documents(spark, sf_dir).select("script_id", "source")
    return sl.dedup_chunks(documents, code_col="source", order=["script_id"], late=True)


@query
def label_document_copies(spark, sf_dir):
    documents = inputs.documents(spark, sf_dir).select("script_id", "source")
    return sl.label_copies(documents, code_col="source", order=["script_id"], late=True).drop("source")


@query
def assemble(spark, sf_dir):
    return sl.assemble(sl.split_lines(inputs.documents(spark, sf_dir), 3))


@query
def final_scripts(spark, sf_dir):
    whole = flows.final_scripts(inputs.code(spark, sf_dir), code_col="code")
    return whole.select("script_id", F.col("is_valid").cast("int").alias("is_valid"), "annotated")


@query
def final_scripts_missing(spark, sf_dir):
    """Every ninth conversion is not there."""
    code = F.when(F.col("chunk_no") % 9 != 0, F.col("code")).alias("code")
    whole = flows.final_scripts(
        inputs.code(spark, sf_dir).select("script_id", "chunk_no", code), code_col="code"
    )
    return whole.select("script_id", F.col("is_valid").cast("int").alias("is_valid"), "n_missing")


@query
def only_new(spark, sf_dir):
    docs = inputs.table(spark, sf_dir, "documents")
    seen = scripts_from(docs.filter("lang = 'fr'"), "doc_id", "text")
    return sl.only_new(inputs.documents(spark, sf_dir), seen).select("script_id", "content_hash")


@query
def only_new_first(spark, sf_dir):
    docs = inputs.table(spark, sf_dir, "documents")
    seen = scripts_from(docs.filter("lang = 'fr'"), "doc_id", "text")
    new = sl.only_new(inputs.documents(spark, sf_dir), seen, within_batch="first")
    return new.select("script_id", "content_hash")


def _with_seen_table(spark, sf_dir, run):
    """What `run` makes of the documents and a table of seen hashes, which goes afterwards."""
    docs = inputs.table(spark, sf_dir, "documents")
    with scratch(spark, "seen") as folder:
        table = "seen_" + folder.rsplit("-", 1)[1]
        sl.create_seen(spark, table, buckets=16, path=folder)
        try:
            for lang in ("fr", "fr", "de"):
                batch = docs.filter((F.col("lang") == lang) & (F.col("doc_id") % 2 == 0))
                sl.add_seen(scripts_from(batch, "doc_id", "text"), table)
            return kept(run(inputs.documents(spark, sf_dir), table))
        finally:
            spark.sql(f"DROP TABLE IF EXISTS {table}")


@query
def only_new_to_table(spark, sf_dir):
    """Three batches have been seen, one of them twice."""
    new = lambda docs, table: sl.only_new_to(docs, table).select("script_id", "content_hash")
    return _with_seen_table(spark, sf_dir, new)


@query
def only_new_to_table_first(spark, sf_dir):
    return _with_seen_table(
        spark, sf_dir,
        lambda docs, table: sl.only_new_to(docs, table, within_batch="first").select("script_id", "content_hash"),
    )


@query
def extend_seen(spark, sf_dir):
    docs = inputs.table(spark, sf_dir, "documents")
    seen = scripts_from(docs.filter("lang = 'fr'"), "doc_id", "text")
    return sl.extend_seen(seen, inputs.documents(spark, sf_dir))


@query
def stream_chunks(spark, sf_dir):
    table = inputs.table(spark, sf_dir, "documents")
    landed = spark.readStream.schema(table.schema).parquet(f"{sf_dir}/documents.parquet*")
    with scratch(spark, "stream") as folder:
        chunks = sl.stream_chunks(scripts_from(landed, "doc_id", "text"))
        sl.run_available(chunks, f"{folder}/out", f"{folder}/state").awaitTermination()
        return kept(spark.read.schema(chunks.schema).parquet(f"{folder}/out").drop("script_id"))


@query
def stream_script_files(spark, sf_dir):
    """Script files in a growing folder; half land before the first run, all before the second,
    and some land twice."""
    scripts = inputs.scripts(spark, sf_dir)
    number = F.col("script_id").cast("long")
    with scratch(spark, "landing") as folder:
        landing = f"{folder}/in"
        for half in (scripts.filter(number % 2 == 0), scripts.filter((number % 2 == 1) | (number % 10 == 0))):
            _landed(half, landing, files_a_folder=1000)
            chunks = sl.stream_chunks(sl.stream_scripts(spark, landing))
            sl.run_available(chunks, f"{folder}/out", f"{folder}/state").awaitTermination()
        out = spark.read.schema(chunks.schema).parquet(f"{folder}/out")
        return kept(out.drop("script_id"))


@query
def line_totals(spark, sf_dir):
    return flows.line_totals(sl.split_lines(inputs.documents(spark, sf_dir)))


# --- table operations ----------------------------------------------------------------


@query
def count_where(spark, sf_dir):
    return sl.count_where(inputs.table(spark, sf_dir, "customer"), F.col("c_nationkey") == 10)


@query
def update_if(spark, sf_dir):
    customers = inputs.table(spark, sf_dir, "customer")
    here = F.col("c_nationkey") == 10
    return sl.update_if(customers, here, here, {"c_acctbal": F.col("c_acctbal") * 1.1})


@query
def update_if_unmet(spark, sf_dir):
    """Guard over another table; no row meets it, so nothing changes."""
    return sl.update_if(
        inputs.table(spark, sf_dir, "customer"),
        F.col("o_totalprice") < 0,
        F.col("c_nationkey") == 10,
        {"c_acctbal": F.col("c_acctbal") * 1.1},
        guard_df=inputs.table(spark, sf_dir, "orders"),
    )


@query
def update_where(spark, sf_dir):
    return sl.update_where(
        inputs.table(spark, sf_dir, "customer"),
        F.when(F.col("c_nationkey") > 5, F.col("c_acctbal") < 0),
        {"c_nationkey": F.lit(2000), "c_mktsegment": F.concat_ws("-", "c_mktsegment", "c_nationkey")},
    )


@query
def lookup_one(spark, sf_dir):
    """Nation name of each customer."""
    return sl.lookup(
        inputs.table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"),
        inputs.table(spark, sf_dir, "nation"),
        "c_nationkey",
        "n_name",
        ref_key="n_nationkey",
        row_id="c_custkey",
    )


@query
def lookup_many(spark, sf_dir):
    """Order of each customer: none or too many."""
    return sl.lookup(
        inputs.table(spark, sf_dir, "customer").select("c_custkey", "c_name"),
        inputs.table(spark, sf_dir, "orders"),
        "c_custkey",
        "o_orderkey",
        ref_key="o_custkey",
        row_id="c_custkey",
    )


@query
def lookup_key(spark, sf_dir):
    """Order whose key is twice the customer's: at most one."""
    return sl.lookup(
        inputs.table(spark, sf_dir, "customer").selectExpr("c_custkey", "c_custkey * 2 AS wanted"),
        inputs.table(spark, sf_dir, "orders"),
        "wanted",
        "o_totalprice",
        ref_key="o_orderkey",
        row_id="c_custkey",
    )


# --- linted verbs --------------------------------------------------------------------


@query
def select_columns(spark, sf_dir):
    cents = (F.col("l_extendedprice") * 100).cast("decimal(18,0)")
    return (
        inputs.table(spark, sf_dir, "lineitem")
        .select("l_orderkey", "l_linenumber", "l_extendedprice", "l_discount")
        .withColumn("discounted", F.col("l_extendedprice") * (1 - F.col("l_discount")))
        .withColumn("cents", cents.cast("bigint"))
    )


@query
def filter_rows(spark, sf_dir):
    return (
        inputs.table(spark, sf_dir, "orders")
        .filter((F.col("o_totalprice") > 100000) & (F.col("o_orderstatus") == "F"))
        .select("o_orderkey", "o_custkey", "o_totalprice")
    )


@query
def group_by(spark, sf_dir):
    money = F.col("l_extendedprice").cast("decimal(18,2)")
    return (
        inputs.table(spark, sf_dir, "lineitem")
        .groupBy("l_returnflag", "l_linestatus")
        .agg(
            F.count("*").alias("n"),
            F.sum(F.col("l_quantity").cast("bigint")).alias("quantity"),
            F.sum(money).cast("double").alias("price"),
            F.min("l_discount").alias("least_discount"),
        )
    )
