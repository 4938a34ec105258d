"""Quality rules of documents, judged with the record of the host they come from.

Each document is measured and checked against rules. Failures are counted by host; a host's
rate is shrunk towards the rate of all hosts with a beta prior that is fitted to the hosts by
moments; hosts whose shrunk rate is above a limit are rejected, and the verdict is joined back
to their documents.

Defined results: null and empty text has no words and fails the base rule; rows of a null host
are judged on their own, as they share no origin; repeated rows count as often as they come;
an empty table gives an empty result. Columns other than id, text and host are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptloom.llm.common import durable, utf8
from scriptloom.operators.keyed import join_unique

WINDOW = 8
SYMBOLS = b"#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words covered by a run of `window` words that occurs at least twice.

    Runs are told apart by a hash first; runs with equal hashes are compared word by word.
    """
    n = len(words) - window + 1
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    seq = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.uint64, len(words))
    mixed = (seq + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    run = np.zeros(n, np.uint64)
    for i in range(window):
        run = run * np.uint64(0xBF58476D1CE4E5B9) + mixed[i : i + n]
    order = np.argsort(run, kind="stable")
    same = run[order[1:]] == run[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    cut = np.flatnonzero(~same)
    for group in np.split(order, cut + 1):
        if len(group) > 1:
            runs = np.stack([seq[group + i] for i in range(window)], axis=1)
            _, where, counts = np.unique(runs, axis=0, return_inverse=True, return_counts=True)
            twice[group[counts[where.reshape(-1)] > 1]] = True
    edge = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def measure_text(text: bytes) -> tuple[int, int, int, int, int]:
    """The five measures of one whole text in UTF-8."""
    words = text.split()
    raw = np.frombuffer(text, np.uint8)
    points = (raw & 0xC0) != 0x80
    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    word_chars = int(points.sum() - space.sum())
    n_symbols = sum(text.count(SYMBOLS[i : i + 1]) for i in range(len(SYMBOLS)))
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    return len(words), word_chars, n_symbols, len(lines) - len(set(lines)), repeated_words(words)


def measured_text(text: Column) -> Column:
    """Struct of the five measures of a text column."""

    @F.arrow_udf("struct<" + ", ".join(f"{m}: long" for m in MEASURES) + ">")
    def measure(texts: pa.Array) -> pa.Array:
        columns = list(zip(*map(measure_text, utf8(texts)), strict=True)) or [()] * len(MEASURES)
        return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], list(MEASURES))

    return measure(text)


def base_failed() -> Column:
    """Fixed by the contract."""
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def soft_failed() -> Column:
    """Rules that count against the host only: symbols and repeated lines."""
    return (10 * F.col("n_symbols") > F.col("n_words")) | (F.col("n_dup_lines") >= 10)


def host_rates(measured: DataFrame) -> DataFrame:
    """Rows, failures and shrunk failure rate per host of (host, failed).

    Prior by moments: with mean m and variance v of the hosts' rates, less the variance that
    counting alone gives, the prior weighs m (1 - m) / v - 1 documents; without spread
    between hosts it weighs as much as the largest host. A single row of five sums gives it.
    """
    hosts = durable(
        measured.filter(F.col("host").isNotNull())
        .groupBy("host")
        .agg(F.count("*").alias("n"), F.sum(F.col("failed").cast("long")).alias("bad"))
    )
    rate = F.col("bad") / F.col("n")
    s = hosts.agg(
        F.count("*").alias("k"),
        F.avg(rate).alias("m"),
        F.var_samp(rate).alias("v"),
        F.avg(1 / F.col("n")).alias("i"),
        F.max("n").alias("most"),
    ).first()
    m = s.m or 0.0
    spread = max(0.0, (s.v or 0.0) - m * (1 - m) * (s.i or 0.0))
    most = float(s.most or 1)
    weight = min(most, max(1.0, m * (1 - m) / spread - 1)) if spread > 0 else most
    return hosts.withColumn("rate", (F.col("bad") + m * weight) / (F.col("n") + weight))


def judge_hosts(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
    max_rate: float = 0.5,
) -> DataFrame:
    """doc_id, the measures, base_failed, host_rate and kept of every row.

    A document is kept if it meets the base rules and its host's shrunk rate of failures is
    at most `max_rate`. Texts are measured once; failures are combined on the map side, and
    the join back spreads hosts that hold a large share of the rows.
    """
    measured = durable(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.col(host_col).cast("string").alias("host"),
            measured_text(F.col(text_col)).alias("m"),
        )
        .select("doc_id", "host", "m.*")
        .withColumn("base_failed", base_failed())
        .withColumn("failed", F.col("base_failed") | soft_failed())
    )
    rates = host_rates(measured).select("host", F.col("rate").alias("host_rate"))
    joined = join_unique(measured, rates, ["host"], "left", ["doc_id"])
    good_host = F.coalesce(F.col("host_rate") <= max_rate, F.lit(True))
    return joined.select(
        "doc_id", *MEASURES, "base_failed", (~F.col("base_failed") & good_host).alias("kept"),
        "host_rate",
    )
