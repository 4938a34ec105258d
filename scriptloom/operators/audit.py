"""Pairing of original and converted chunks, audit tables, copies and reassembly."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptloom.functions import lint
from scriptloom.operators.keyed import SALTS, may_match
from scriptloom.operators.lint import CHUNK_KEYS

RUN = 1000


def map_chunks(
    orig: DataFrame, conv: DataFrame, *, keys: Sequence[str] = CHUNK_KEYS,
    original_col: str = "code", converted_col: str = "converted", checked: bool = True,
) -> DataFrame:
    """Each original chunk beside its converted text with verdict and annotation.

    The key includes the chunk number, so the chunks of one large script spread over all
    tasks. Chunks without a conversion stay, with NULLs. Two conversions of one chunk raise;
    `checked=False` leaves that to the caller and saves the grouping. The verdict is found
    before the grouping, so where only figures are asked for a boolean travels and no text.
    The join is never a broadcast: there are as many conversions as chunks, and Spark guesses
    their size from a table that may hold far fewer rows.
    """
    said = conv.select(*keys, F.col(converted_col).alias("converted")).withColumns(
        {"is_valid": F.expr(lint.is_valid("converted")), "comments": F.expr(lint.comments("converted"))}
    )
    if checked:
        error = F.raise_error(F.lit("more than one conversion of a chunk"))
        only = lambda c: F.when(F.count("*") == 1, F.first(c)).otherwise(error).alias(c)
        said = said.groupBy(*keys).agg(only("converted"), only("is_valid"), only("comments"))
    said = said.withColumn("annotated", F.expr(lint.annotated("converted")))
    return orig.withColumnRenamed(original_col, "original").join(said.hint("merge"), list(keys), "left")


def audit_table(df: DataFrame) -> DataFrame:
    """Report columns of a mapping that carries serial, id, type and line count."""
    return df.select(
        "script_id",
        F.col("serial").alias("Sr No"),
        F.col("chunk_id").alias("Chunk ID"),
        F.col("block_type").alias("Block Type"),
        F.col("line_count").alias("Line Count"),
        F.col("original").alias("Original"),
        F.col("annotated").alias("Converted"),
    )


def audit_partials(df: DataFrame) -> DataFrame:
    """Chunks, valid chunks and lines per script and block type of a batch: rows that are added
    up with those of other batches, however a script's chunks are dealt to batches."""
    return df.groupBy("script_id", "block_type").agg(
        F.count("*").alias("c"),
        F.count(F.when(F.col("is_valid"), 1)).alias("v"),
        F.sum("line_count").alias("l"),
    )


def summary_of(partials: DataFrame) -> DataFrame:
    """The summary of all batches whose `audit_partials` are given. The rollup runs over the
    grouped rows, not over every chunk thrice."""
    return partials.rollup("script_id", "block_type").agg(
        F.grouping_id().cast("int").alias("level"),
        F.sum("c").alias("n_chunks"),
        F.sum("v").alias("n_valid"),
        F.sum("l").alias("n_lines"),
    )


def audit_summary(df: DataFrame) -> DataFrame:
    """Chunks, valid chunks and lines per script and block type, with totals per script
    and overall."""
    return summary_of(audit_partials(df))


def keep_partials(partials: DataFrame, path: str, batch: str) -> None:
    """Keep the partial figures of a batch beside those of others; a batch that is kept again
    replaces itself."""
    partials.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def rule_partials(findings: DataFrame, *, keys: Sequence[str] = CHUNK_KEYS) -> DataFrame:
    """Findings and distinct chunks per rule of a batch; a chunk is in one batch. The first
    grouping is by rule and chunk, so a rule that most chunks break is not counted in one task."""
    per_chunk = findings.groupBy("rule", *keys).agg(F.count("*").alias("n"))
    return per_chunk.groupBy("rule").agg(F.sum("n").alias("f"), F.count("*").alias("c"))


def rules_of(partials: DataFrame) -> DataFrame:
    """The rule summary of all batches whose `rule_partials` are given."""
    return partials.groupBy("rule").agg(F.sum("f").alias("n_findings"), F.sum("c").alias("n_chunks"))


def rule_summary(findings: DataFrame, *, keys: Sequence[str] = CHUNK_KEYS) -> DataFrame:
    """Findings and distinct chunks per rule. The first grouping is by rule and chunk, so
    a rule that most chunks break is not counted in one task."""
    per_chunk = findings.groupBy("rule", *keys).agg(F.count("*").alias("n"))
    return per_chunk.groupBy("rule").agg(
        F.sum("n").alias("n_findings"), F.count("*").alias("n_chunks")
    )


def _hashed(df: DataFrame, code_col: str) -> DataFrame:
    return df.withColumn("content_hash", F.sha2(F.col(code_col), 256))


def first_of_each(df: DataFrame, hash_col: str, order: Sequence[str], count_as: str) -> DataFrame:
    """Of the rows with one hash the first, and how many there are; rows without a hash are no
    copies of each other and all stay, with a count of 1.

    One aggregation keyed on the hash: each map task sends at most one row per content,
    so a content that fills a third of the table still reaches its reducer as a few rows.
    """
    first = F.min_by(F.struct(*df.columns), F.struct(*order))
    copies = (
        df.filter(F.col(hash_col).isNotNull())
        .groupBy(hash_col)
        .agg(first.alias("_first"), F.count("*").alias(count_as))
        .select("_first.*", count_as)
    )
    alone = df.filter(F.col(hash_col).isNull())
    return copies.unionByName(alone.withColumn(count_as, F.lit(1).cast("long")))


def dedup_chunks(
    df: DataFrame, *, code_col: str = "code", order: Sequence[str] = CHUNK_KEYS, late: bool = False
) -> DataFrame:
    """First row of each content, with the number of copies. A NULL code is no content: such
    rows all stay. Of first rows with the same place one stays.

    `late=True` is for long texts, such as whole documents: rows are then fetched by their place
    after only hashes and places were grouped, so hardly any text is shuffled or sorted; in
    return `df` is worked out three times. Texts of a few lines are cheaper grouped at once.
    """
    hashed = _hashed(df, code_col)
    if late:
        return _first_fetched_late(hashed, "content_hash", order, "n_copies")
    return first_of_each(hashed, "content_hash", order, "n_copies")


def _first_fetched_late(hashed: DataFrame, hash_col: str, order: Sequence[str], count_as: str) -> DataFrame:
    """What `first_of_each` gives, where a row is fetched by its place in `order`.

    A bitmap of the repeated hashes lets rows without a copy go out as they are, and a second
    one, of the first places, drops later copies. What is shuffled with its text are the first
    rows of repeated contents, and the few rows that a bitmap wrongly lets through; the join
    decides on those.
    """
    key = [hash_col, "_place"]
    placed = hashed.withColumn("_place", F.struct(*order))
    firsts = (
        placed.filter(F.col(hash_col).isNotNull())
        .groupBy(hash_col)
        .agg(F.min("_place").alias("_place"), F.count("*").alias("_n"))
    )
    repeated = firsts.filter("_n > 1").select(hash_col)
    told = may_match(placed, repeated, [hash_col])
    doubted = may_match(firsts, repeated, [hash_col]).filter("_may").drop("_may")
    maybe_first = may_match(told.filter("_may").drop("_may"), doubted.select(*key), key).filter("_may")
    first = (
        maybe_first.join(doubted, key)
        .withColumn("_nth", F.row_number().over(Window.partitionBy(*key).orderBy("_place")))
        .filter("_nth = 1")
        .select(*hashed.columns, F.col("_n").alias(count_as))
    )
    alone = told.filter("NOT _may").select(*hashed.columns, F.lit(1).cast("long").alias(count_as))
    return alone.unionByName(first)


def label_copies(
    df: DataFrame, *, code_col: str = "code", order: Sequence[str] = CHUNK_KEYS, late: bool = False
) -> DataFrame:
    """Every row that repeats the content of an earlier row, with the place of the first. A
    NULL code repeats nothing.

    First row and count are worked out per (hash, salt), merged per hash from at most
    SALTS partial rows, and joined back by (hash, salt), so the copies of one content are
    never in one task together. With `late=True`, for long texts, a bitmap of the repeated
    hashes holds back the rows that have no copy, so their text is not shuffled.
    """
    salt = F.pmod(F.xxhash64(*order), F.lit(SALTS)).cast("int")
    hashed = _hashed(df, code_col).withColumn("_salt", salt)
    same = Window.partitionBy("content_hash")
    labels = (
        hashed.select("content_hash", "_salt", *order)
        .groupBy("content_hash", "_salt")
        .agg(F.min(F.struct(*order)).alias("_least"), F.count("*").alias("_n"))
        .select(
            "content_hash",
            "_salt",
            F.min("_least").over(same).alias("_first"),
            F.sum("_n").over(same).alias("n_copies"),
        )
        .filter("n_copies > 1")
    )
    if late:
        hashed = may_match(hashed, labels.select("content_hash"), ["content_hash"]).filter("_may")
    return (
        hashed.join(labels, ["content_hash", "_salt"])
        .filter(F.struct(*order) != F.col("_first"))
        .select(
            *df.columns,
            "content_hash",
            "n_copies",
            *[F.col("_first")[c].alias(f"first_{c}") for c in order],
        )
    )


def assemble(
    df: DataFrame, *, keys: Sequence[str] = ("script_id",), order: str = "chunk_no",
    code_col: str = "code", sep: str = "\n", missing_as: str | None = None,
) -> DataFrame:
    """Chunks of a script joined in order. With `missing_as`, also the number of chunks whose
    code is NULL, which the joined text lacks; without it such a chunk raises.

    Runs of RUN chunk numbers are sorted and joined first, each in its own group, so only
    ready-made runs meet in the last group, whose result is the script's own text cell.
    """
    keys = list(keys)
    code = F.col(code_col)
    if not missing_as:
        code = F.coalesce(code, F.raise_error(F.lit("a chunk to assemble has no code")))

    def joined(frame: DataFrame, by: list[str], place: str) -> DataFrame:
        ordered = F.array_sort(F.collect_list(F.struct(place, "_text")))
        return frame.groupBy(*by).agg(
            F.array_join(F.transform(ordered, lambda p: p["_text"]), sep).alias("_text"),
            F.sum("_missing").alias("_missing"),
        )

    runs = df.select(
        *keys,
        F.floor(F.col(order) / RUN).alias("_run"),
        order,
        code.alias("_text"),
        F.col(code_col).isNull().cast("long").alias("_missing"),
    )
    whole = joined(joined(runs, [*keys, "_run"], order), keys, "_run")
    missing = [F.col("_missing").alias(missing_as)] if missing_as else []
    return whole.select(*keys, F.col("_text").alias(code_col), *missing)
