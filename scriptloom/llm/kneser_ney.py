"""Interpolated modified Kneser-Ney bigram model, counted in Spark and scored from mapped files.

Words are 64-bit hashes. Map tasks count the bigrams of their texts and send, for each shard of
the first word's hash, one block of sorted distinct bigrams; the task of a shard merges its
blocks and writes a file of sorted arrays: contexts with their totals, and hashes of bigrams
with their counts. From the same merge come, per word, its count and its number of distinct
predecessors; these go to shards of the word's own hash and to files in the same way. Only
counts of counts and totals reach the driver.

Workers map the files into memory and look up the distinct words and bigrams of many texts at
once, in hash order. Let c be counts, D the discounts of a count of 1, 2 and 3 or more:
  p(b | a) = max(c(ab) - D, 0) / c(a) + g(a) p(b),  g(a) = sum D_i N_i(a) / c(a)
  p(b) = max(n(b) - D', 0) / n + g / (V + 1),  n(b) the number of distinct words before b
and p(b | a) = p(b) for an unseen context a. A text begins after a start mark and ends with an
end mark, which is a token.

Defined results: null and empty text is the end mark alone; repeated rows count as often as
they come; without training text every score is 0; discounts fall back to 0.5, 1 and 1.5 where
a count of counts is 0. Two words with one 64-bit hash would count as one: for a vocabulary of
10^8 words the chance of one such pair is 3 in 10,000. A context's distinct successors, at most
the vocabulary, are merged in one task.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptloom.llm.common import durable, new_folder, remainder, remove_folder, utf8

START, END = np.uint64(1), np.uint64(2)
CACHED = 500_000
BLOCK_TOKENS = 2_000_000
SCORE_TOKENS = 500_000


class WordHashes(dict):
    """Hash of a word, worked out once while it is remembered."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_hashes = WordHashes()


def token_hashes(text: bytes) -> np.ndarray:
    """Hashes of the words of a text and of the end mark."""
    words = text.lower().split()
    if len(_hashes) > CACHED:
        _hashes.clear()
    out = np.empty(len(words) + 1, np.uint64)
    out[:-1] = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    out[-1] = END
    return out


def bigram_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * np.uint64(0x9E3779B97F4A7C15) + b
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shard_of(hashes: np.ndarray, bits: int) -> np.ndarray:
    if not bits:
        return np.zeros(len(hashes), np.int64)
    return (hashes >> np.uint64(64 - bits)).astype(np.int64)


def summed(keys: list[np.ndarray], values: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Distinct keys in order, with the sums of each value."""
    order = np.lexsort(keys[::-1])
    keys = [k[order] for k in keys]
    new = np.zeros(len(order), bool)
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    new[:1] = True
    first = np.flatnonzero(new)
    return [k[first] for k in keys], [np.add.reduceat(v[order], first) if len(first) else v for v in values]


def pack_arrays(*arrays: np.ndarray) -> bytes:
    """Arrays one after another, each in the least unsigned type that holds it."""
    head, body = [len(arrays)], []
    for a in arrays:
        top = int(a.max()) if len(a) else 0
        size = next(s for s in (1, 2, 4, 8) if top < 1 << (8 * s))
        data = a.astype(f"<u{size}").tobytes()
        head += [size, len(a)]
        body.append(data + bytes(-len(data) % 8))
    return np.array(head, "<i8").tobytes() + b"".join(body)


def unpack_arrays(raw) -> list[np.ndarray]:
    raw = np.frombuffer(raw, np.uint8)
    n = int(raw[:8].view("<i8")[0])
    head = raw[8 : 8 + 16 * n].view("<i8").reshape(n, 2).tolist()
    at, out = 8 + 16 * n, []
    for size, length in head:
        out.append(raw[at : at + size * length].view(f"<u{size}"))
        at += size * length + -(size * length) % 8
    return out


def bigram_blocks(texts: Iterator[bytes], bits: int) -> Iterator[tuple[int, bytes]]:
    """(shard, block) of the bigrams of texts, BLOCK_TOKENS at a time."""
    held: list[np.ndarray] = []
    n = 0

    def flush() -> Iterator[tuple[int, bytes]]:
        b = np.concatenate(held)
        ends = np.cumsum([len(h) for h in held])
        a = np.empty_like(b)
        a[1:] = b[:-1]
        a[np.r_[0, ends[:-1]]] = START
        (a, b), (c,) = summed([a, b], [np.ones(len(b), np.int64)])
        shards = shard_of(a, bits)
        at = np.flatnonzero(np.diff(shards, prepend=-1))
        for i, j in zip(at, [*at[1:], len(a)], strict=True):
            first = np.flatnonzero(np.diff(a[i:j], prepend=~a[i : i + 1]) != 0)
            length = np.diff(np.r_[first, j - i])
            yield int(shards[i]), pack_arrays(a[i:j][first], length, b[i:j], c[i:j])

    for text in texts:
        held.append(token_hashes(text))
        n += len(held[-1])
        if n >= BLOCK_TOKENS:
            yield from flush()
            held, n = [], 0
    if held:
        yield from flush()


def write_file(folder: str, data: bytes) -> str:
    from pyarrow import fs

    path = f"{folder}/{uuid.uuid4().hex}.arrays"
    store, place = fs.FileSystem.from_uri(path)
    store.create_dir(os.path.dirname(place), recursive=True)
    with store.open_output_stream(place) as file:
        file.write(data)
    return path


def map_file(path: str) -> list[np.ndarray]:
    """Arrays of a file mapped into memory; a file of a remote store is fetched first."""
    from pyarrow import fs

    store, place = fs.FileSystem.from_uri(path)
    if not isinstance(store, fs.LocalFileSystem):
        with store.open_input_file(place) as remote, tempfile.NamedTemporaryFile(delete=False) as own:
            own.write(remote.read())
        place = own.name
    mapped = unpack_arrays(np.memmap(place, np.uint8, "r"))
    if place != path.removeprefix("file://") and not isinstance(store, fs.LocalFileSystem):
        os.unlink(place)  # the mapping keeps it
    return mapped


def counts_of(c: np.ndarray) -> list[int]:
    return [int((c == i).sum()) for i in (1, 2, 3, 4)]


class Merged:
    """Blocks of one shard, merged whenever they hold more than twice the merged rows."""

    def __init__(self, keys: int):
        self.n_keys, self.parts, self.held, self.size = keys, [], 0, 1_000_000

    def add(self, arrays: list[np.ndarray]) -> None:
        self.parts.append(arrays)
        self.held += len(arrays[0])
        if self.held > 2 * self.size:
            self.parts = [self.arrays()]
            self.held = len(self.parts[0][0])
            self.size = max(self.size, self.held)

    def arrays(self) -> list[np.ndarray]:
        columns = [np.concatenate(c) for c in zip(*self.parts, strict=True)]
        keys, values = summed(columns[: self.n_keys], columns[self.n_keys :])
        return [*keys, *values]


BLOCK = "shard long, block binary"
MADE = "kind string, shard long, file string, block binary, stats array<long>"
_MADE = pa.schema(
    [("kind", pa.string()), ("shard", pa.int64()), ("file", pa.string()),
     ("block", pa.binary()), ("stats", pa.list_(pa.int64()))]
)


def _by_shard(batches: Iterator[pa.RecordBatch], make) -> Iterator[pa.RecordBatch]:
    """Call make(shard, blocks) for each run of rows of one shard."""

    def rows():
        for batch in batches:
            yield from zip(batch["shard"].to_pylist(), batch["block"], strict=True)

    shard, merged = None, None
    for number, block in rows():
        if number != shard:
            if merged:
                yield from make(shard, merged)
            shard, merged = number, None
        merged = make.fold(merged, unpack_arrays(block.as_buffer()))
    if merged:
        yield from make(shard, merged)


class BigramShard:
    """Merges bigram blocks; writes contexts and bigrams; passes words on."""

    def __init__(self, folder: str, bits: int):
        self.folder, self.bits = folder, bits

    def fold(self, merged: Merged | None, block: list[np.ndarray]) -> Merged:
        merged = merged or Merged(2)
        contexts, length, b, c = block
        a = np.repeat(contexts.astype(np.uint64), length.astype(np.int64))
        merged.add([a, b.astype(np.uint64), c.astype(np.int64)])
        return merged

    def __call__(self, shard: int, merged: Merged) -> Iterator[pa.RecordBatch]:
        a, b, c = merged.arrays()
        (contexts,), sums = summed([a], [c, (c == 1) * 1, (c == 2) * 1, (c > 2) * 1])
        keys, key_counts = bigram_hash(a, b), c
        order = np.argsort(keys)
        path = write_file(
            self.folder, pack_arrays(contexts, *sums, keys[order], key_counts[order])
        )
        made = [{"kind": "bigrams", "shard": shard, "file": path, "stats": [len(c), *counts_of(c)]}]
        (words,), (count, before) = summed([b], [c, np.ones(len(c), np.int64)])
        shards = shard_of(words, self.bits)
        at = np.flatnonzero(np.diff(shards, prepend=-1))
        for i, j in zip(at, [*at[1:], len(words)], strict=True):
            block = pack_arrays(words[i:j], count[i:j], before[i:j])
            made.append({"kind": "block", "shard": int(shards[i]), "block": block})
        yield pa.RecordBatch.from_pylist(made, _MADE)


class WordShard:
    """Merges word blocks; writes words with count and distinct predecessors."""

    def __init__(self, folder: str):
        self.folder = folder

    def fold(self, merged: Merged | None, block: list[np.ndarray]) -> Merged:
        merged = merged or Merged(1)
        words, count, before = block
        merged.add([words.astype(np.uint64), count.astype(np.int64), before.astype(np.int64)])
        return merged

    def __call__(self, shard: int, merged: Merged) -> Iterator[pa.RecordBatch]:
        words, count, before = merged.arrays()
        path = write_file(self.folder, pack_arrays(words, count, before))
        stats = [len(words), int(count.sum()), int(before.sum()), *counts_of(before)]
        made = [{"kind": "words", "shard": shard, "file": path, "stats": stats}]
        yield pa.RecordBatch.from_pylist(made, _MADE)


def discounts(n: list[int]) -> np.ndarray:
    """Discounts of counts 0, 1, 2 and 3 or more from the counts of counts 1 to 4."""
    if min(n, default=0) <= 0:
        return np.array([0, 0.5, 1, 1.5])
    y = n[0] / (n[0] + 2 * n[1])
    d = [0, 1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2]]
    return np.clip(d, 0, [0, 1, 2, 3])


class Model:
    """Files and totals of a counted model. Files open when they are first needed."""

    def __init__(self, bits: int, bigrams: dict[int, str], words: dict[int, str], bigram_stats, word_stats):
        self.bits, self.files = bits, {"bigrams": bigrams, "words": words}
        self.vocabulary, self.tokens, self.pairs, *word_counts = word_stats
        self.pair_discounts = discounts(bigram_stats[1:])
        self.word_discounts = discounts(word_counts)
        d = self.word_discounts
        self.word_weight = (
            d[1] * word_counts[0]
            + d[2] * word_counts[1]
            + d[3] * (self.vocabulary - word_counts[0] - word_counts[1])
        )
        self.open: dict[tuple[str, int], list[np.ndarray]] = {}

    def _file(self, kind: str, shard: int) -> list[np.ndarray] | None:
        path = self.files[kind].get(shard)
        if path and (kind, shard) not in self.open:
            self.open[kind, shard] = map_file(path)
        return self.open.get((kind, shard))

    def _each_shard(self, kind: str, shards: np.ndarray):
        """(slice, arrays) for runs of equal shards in ascending order."""
        at = np.flatnonzero(np.diff(shards, prepend=-1))
        for i, j in zip(at, [*at[1:], len(shards)], strict=True):
            arrays = self._file(kind, int(shards[i]))
            if arrays:
                yield slice(i, j), arrays

    @staticmethod
    def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return at, keys[at] == wanted

    def words(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Count and p(b) of sorted distinct word hashes."""
        count, before = np.zeros(len(wanted), np.int64), np.zeros(len(wanted), np.int64)
        for part, (keys, counts, befores) in self._each_shard("words", shard_of(wanted, self.bits)):
            at, found = self._find(keys, wanted[part])
            count[part] = np.where(found, counts[at], 0)
            before[part] = np.where(found, befores[at], 0)
        uniform = 1 / (self.vocabulary + 1)
        if not self.pairs:
            return count, np.full(len(wanted), uniform)
        d = self.word_discounts[np.minimum(before, 3)]
        own = np.maximum(before - d, 0) / self.pairs
        return count, own + self.word_weight / self.pairs * uniform

    def contexts(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Total and backoff weight of sorted distinct contexts; 0 and 1 for unseen ones."""
        total, weight = np.zeros(len(wanted)), np.ones(len(wanted))
        d = self.pair_discounts
        for part, arrays in self._each_shard("bigrams", shard_of(wanted, self.bits)):
            keys, totals, one, two, more = arrays[:5]
            at, found = self._find(keys, wanted[part])
            n = np.where(found, totals[at], 0).astype(float)
            mass = d[1] * one[at] + d[2] * two[at] + d[3] * more[at]
            total[part] = n
            weight[part] = np.where(found, mass / np.maximum(n, 1), 1.0)
        return total, weight

    def pair_counts(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Counts of bigrams."""
        keys, shards = bigram_hash(a, b), shard_of(a, self.bits)
        order = np.lexsort([keys, shards])
        count = np.zeros(len(a), np.int64)
        for part, arrays in self._each_shard("bigrams", shards[order]):
            at, found = self._find(arrays[5], keys[order[part]])
            count[order[part]] = np.where(found, arrays[6][at], 0)
        return count

    def score(self, texts: list[np.ndarray]) -> list[np.ndarray]:
        """For texts as token hashes: tokens, known tokens, base score and score of each."""
        b = np.concatenate(texts)
        first = np.r_[0, np.cumsum([len(t) for t in texts])[:-1]]
        words, word_at = np.unique(np.r_[START, b], return_inverse=True)
        start_at, b_at = word_at[0], word_at[1:]
        a_at = np.r_[0, b_at[:-1]]
        a_at[first] = start_at
        count, low = self.words(words)
        total, weight = self.contexts(words)
        code = a_at * len(words) + b_at
        pairs, pair_at = np.unique(code, return_inverse=True)
        x, y = pairs // len(words), pairs % len(words)
        c = self.pair_counts(words[x], words[y])
        d = self.pair_discounts[np.minimum(c, 3)]
        own = np.maximum(c - d, 0) / np.maximum(total[x], 1)
        log = np.log10(own + weight[x] * low[y])[pair_at]
        base = np.log10((count + 1) / (self.tokens + self.vocabulary + 1))[b_at]
        return [
            np.array([len(t) for t in texts]),
            np.add.reduceat((count[b_at] > 0).astype(np.int64), first),
            np.add.reduceat(base, first),
            np.add.reduceat(log, first),
        ]


def count_model(
    texts: DataFrame, folder: str, *, text_col: str = "text", shard_bytes: int = 1 << 24
) -> Model:
    """Count the column `text_col` and write the model's files to `folder`. There are as many
    shards as the text fills `shard_bytes`, in a power of two."""
    folder = folder if folder.startswith("file:") or "://" in folder else f"file://{folder}"
    size = texts.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    bits = max(0, (size // shard_bytes).bit_length())

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines = (t for batch in batches for t in utf8(batch.column(0)))
        for shard, block in bigram_blocks(lines, bits):
            yield pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int64()), pa.array([block], pa.binary())], ["shard", "block"]
            )

    def bigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _by_shard(batches, BigramShard(folder, bits))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _by_shard(batches, WordShard(folder))

    tasks = min(1 << bits, 20_000)
    made = durable(
        texts.select(text_col)
        .mapInArrow(blocks, BLOCK)
        .repartition(tasks, "shard")
        .sortWithinPartitions("shard")
        .mapInArrow(bigrams, MADE)
    )
    known = durable(
        made.filter("kind = 'block'")
        .select("shard", "block")
        .repartition(tasks, "shard")
        .sortWithinPartitions("shard")
        .mapInArrow(words, MADE)
    )
    sums = lambda df, n: [
        x or 0 for x in df.agg(*[F.sum(F.col("stats")[i]) for i in range(n)]).first()
    ]
    pair_rows = made.filter("kind = 'bigrams'")
    files = lambda df: {r.shard: r.file for r in df.select("shard", "file").collect()}
    return Model(bits, files(pair_rows), files(known), sums(pair_rows, 5), sums(known, 7))


SCORED = "doc_id string, n_tokens long, n_known long, base_score double, score double"


def score_texts(rows: DataFrame, model: Model) -> DataFrame:
    """Scores of the rows (doc_id string, text)."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: list = []
        texts: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), *map(pa.array, model.score(texts))],
                ["doc_id", "n_tokens", "n_known", "base_score", "score"],
            )

        for batch in batches:
            for name, text in zip(batch["doc_id"].to_pylist(), utf8(batch["text"]), strict=True):
                names.append(name)
                texts.append(token_hashes(text))
                held += len(texts[-1])
                if held >= SCORE_TOKENS:
                    yield flush()
                    names, texts, held = [], [], 0
        if names:
            yield flush()

    return rows.mapInArrow(score, SCORED)


def lm_scores(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", parts: int = 7, held: int = 2
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and perplexity of
    every row, by a model of the rows that are not held out."""
    folder = new_folder(docs.sparkSession, "kneser-ney")
    model = count_model(
        docs.filter(remainder(id_col, parts) != held), folder, text_col=text_col
    )
    rows = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).alias("text"))
    scored = durable(score_texts(rows, model))
    remove_folder(docs.sparkSession, folder)
    return scored.select(
        F.col("doc_id").cast(docs.schema[id_col].dataType).alias("doc_id"),
        (remainder("doc_id", parts) == held).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        "base_score",
        "score",
        F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"),
    )
