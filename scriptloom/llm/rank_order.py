"""Language identification by rank-order profiles of character n-grams.

A profile is the ranking of the most frequent n-grams of one to three letters, blanks at word
ends included. A text is given the language whose profile is nearest by out-of-place
distance: for each of the text's most frequent n-grams the difference of its ranks, and the
profile's length where the profile lacks it.

Defined results: null text and text without a letter is `und` with score 0; so is any text if
nothing was learned; ties in frequency go by the n-gram's code, ties in distance by the
language's name; a null doc_id counts as the empty text for the split; rows repeat as they
come; whole texts count, however long. Columns other than the id, text and label are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptloom.llm.common import remainder

UNKNOWN = "und"
AT_ONCE = 200
RESULT = "struct<lang_pred: string, score: double>"


@functools.cache
def _letters() -> np.ndarray:
    """For each code point the lower-case letter, 0 for anything that is no letter."""
    table = np.zeros(0x110000, np.uint64)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            table[i] = ord(low) if len(low) == 1 else i
    return table


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the n-grams of a whole text with their counts.

    Three code points of 21 bits each; the two top bits tell the lengths apart.
    """
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    chars = np.zeros(len(points) + 2, np.uint64)
    chars[1:-1] = _letters()[points]
    is_letter = chars > 0
    one = chars[is_letter]
    a, b, c = chars[:-2], chars[1:-1], chars[2:]
    two = ((chars[:-1] << np.uint64(21)) | chars[1:] | np.uint64(1 << 62))[
        is_letter[:-1] | is_letter[1:]
    ]
    three = ((a << np.uint64(42)) | (b << np.uint64(21)) | c | np.uint64(1 << 63))[is_letter[1:-1]]
    return np.unique(np.concatenate([one, two, three]), return_counts=True)


def ranked(codes: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The `size` most frequent codes, most frequent first; ties by code."""
    return codes[np.argsort(-counts, kind="stable")[:size]]


class Profiles:
    """Ranks of every known n-gram in the languages that have it: for the n-gram `codes[i]` the
    entries from `starts[i]` on hold a language and the rank there."""

    def __init__(self, profiles: dict[str, list[int]], size: int):
        self.size = size
        self.names = sorted(profiles)
        known = [np.array(profiles[n], np.int64).view(np.uint64) for n in self.names]
        every = np.concatenate([*known, np.zeros(0, np.uint64)])
        lang = np.repeat(np.arange(len(known)), [len(k) for k in known])
        rank = np.concatenate([*[np.arange(len(k)) for k in known], np.zeros(0, np.int64)])
        order = np.argsort(every, kind="stable")
        self.codes, first = np.unique(every[order], return_index=True)
        self.starts = np.append(first, len(every)).astype(np.int64)
        self.lang, self.rank = lang[order].astype(np.int32), rank[order].astype(np.int32)

    def nearest(self, text: str | None) -> tuple[str, float]:
        if not text or not self.names:
            return UNKNOWN, 0.0
        own = ranked(*grams(text), self.size)
        if not len(own):
            return UNKNOWN, 0.0
        at = np.minimum(np.searchsorted(self.codes, own), len(self.codes) - 1)
        place = np.flatnonzero(self.codes[at] == own)
        begin, n = self.starts[at[place]], np.diff(self.starts)[at[place]]
        entry = np.repeat(begin - np.cumsum(n) + n, n) + np.arange(n.sum())
        # every n-gram counts as absent, and what a profile has is put right
        nearer = np.abs(self.rank[entry] - np.repeat(place, n)) - self.size
        total = len(own) * self.size + np.bincount(self.lang[entry], nearer, len(self.names))
        best = int(total.argmin())
        return self.names[best], float(1 - total[best] / (len(own) * self.size))


def learn(
    labelled: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
    lang_col: str = "lang", size: int = 400, docs_per_lang: int = 3000, max_langs: int = 10_000,
) -> Profiles:
    """Profiles from a share of each language's documents, picked by a hash of their id, that is
    `docs_per_lang` documents on average. More than `max_langs` languages raise, so what reaches
    the driver and the workers is at most max_langs * size codes."""
    rows = labelled.select(
        F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")
    ).filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    spark = labelled.sparkSession
    langs = (
        rows.groupBy("lang")
        .agg(F.count("*").alias("n"))
        .limit(max_langs + 1)
        .collect()
    )
    if len(langs) > max_langs:
        raise ValueError(f"{lang_col} has more than max_langs = {max_langs} values")
    if not langs:
        return Profiles({}, size)
    shares = [(r.lang, min(1.0, docs_per_lang / r.n)) for r in langs]
    share = spark.createDataFrame(shares, "lang string, share double")
    place01 = F.pmod(F.xxhash64("id"), F.lit(1 << 31)) / float(1 << 31)
    sample = rows.join(F.broadcast(share), "lang").filter(place01 < F.col("share"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by_lang: dict[str, list] = {}
            for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist(), strict=True):
                by_lang.setdefault(lang, []).append(grams(text))
            for lang, found in by_lang.items():
                codes, where = np.unique(np.concatenate([x for x, _ in found]), return_inverse=True)
                n = np.bincount(where, np.concatenate([n for _, n in found])).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(codes)), pa.array(codes.view(np.int64)), pa.array(n)],
                    ["lang", "code", "n"],
                )

    counted = sample.select("lang", "text").mapInArrow(count, "lang string, code long, n long")
    top = Window.partitionBy("lang").orderBy(F.desc("n"), "unsigned")
    rank = (
        counted.groupBy("lang", "code")
        .agg(F.sum("n").alias("n"))
        .withColumn("unsigned", F.col("code").bitwiseXOR(F.lit(-(2**63)).cast("long")))
        .withColumn("rank", F.row_number().over(top))
        .filter(F.col("rank") <= size)
    )
    profiles: dict[str, list[int]] = {}
    for row in rank.select("lang", "code", "rank").orderBy("lang", "rank").collect():
        profiles.setdefault(row.lang, []).append(row.code)
    return Profiles(profiles, size)


def _each_text(texts: pa.Array) -> Iterator[str | None]:
    """The texts of a batch, some at a time, as texts may be long."""
    for at in range(0, len(texts), AT_ONCE):
        yield from texts.slice(at, AT_ONCE).to_pylist()


def predicted(text: Column, profiles: Profiles) -> Column:
    """Struct of lang_pred and score for a text column."""

    @F.arrow_udf(RESULT)
    def identify(texts: pa.Array) -> pa.Array:
        found = [profiles.nearest(t) for t in _each_text(texts)]
        return pa.StructArray.from_arrays(
            [pa.array([x for x, _ in found], pa.string()), pa.array([y for _, y in found], pa.float64())],
            ["lang_pred", "score"],
        )

    return identify(text)


def least_scores(labelled: DataFrame, profiles: Profiles, *, text_col: str = "text", lang_col: str = "lang") -> dict[str, float]:
    """For each language the least score of the documents labelled with it and found to be in
    it: one number for each of at most as many languages as there are profiles."""
    agreed = F.when(F.col("found.lang_pred") == F.col("lang"), F.col("found.score"))
    rows = labelled.filter(F.col(lang_col).isNotNull()).select(
        F.col(lang_col).alias("lang"), predicted(F.col(text_col), profiles).alias("found")
    )
    least = rows.groupBy("lang").agg(F.min(agreed).alias("least")).filter("least IS NOT NULL")
    return {r.lang: r.least for r in least.collect()}


def accepted(text: Column, profiles: Profiles, least: dict[str, float]) -> Column:
    """Whether a text is in a learned language, with a score of at least its language's least."""

    @F.arrow_udf("boolean")
    def accept(texts: pa.Array) -> pa.Array:
        found = [profiles.nearest(t) for t in _each_text(texts)]
        return pa.array([lang != UNKNOWN and score >= least.get(lang, 0.0) for lang, score in found], pa.bool_())

    return accept(text)


def identify_language(
    docs: DataFrame, profiles: Profiles | None = None, *, id_col: str = "doc_id",
    text_col: str = "text", lang_col: str = "lang", hold_out: int = 5,
) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row. Without `profiles`, they are
    learned from the rows that are not held out."""
    held_out = remainder(id_col, hold_out) == 0
    if profiles is None:
        profiles = learn(docs.filter(~held_out), id_col=id_col, text_col=text_col, lang_col=lang_col)
    return docs.select(
        F.col(id_col).alias("doc_id"),
        held_out.alias("held_out"),
        predicted(F.col(text_col), profiles).alias("found"),
    ).select("doc_id", "held_out", "found.lang_pred", "found.score")
