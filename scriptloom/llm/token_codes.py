"""Token ids in files of directly addressable codes.

An id is split into 8-bit chunks, low chunk first. Level k holds chunk k of every id that has
one, a bitmap that says which of these ids go on to level k + 1, and a directory with the
number of set bits before each block of 512. The place of an id's next chunk is the rank of
its bit, so any token is read without decoding a block before it.

One shard file, all numbers little-endian 64-bit:
  magic, tokens, documents, levels; document starts (documents + 1); end of each document's
  identifier in the text that follows them; then for each level its entries and bitmap words,
  the chunks, the bitmap and the directory. The last level has no bitmap. Every part is
  padded to 8 bytes.

Documents are range-partitioned by identifier; each task writes shards of bounded size in
order, under names that no other attempt uses, and returns their manifest rows. Readers go by
the manifest, so files of lost attempts are never read.

Defined results: null and empty text is the end id alone; a null identifier comes first;
repeated identifiers are ordered by a hash of the text, and equal rows are each written; whole texts are
encoded, however long; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptloom.llm.common import durable, new_folder, remove_folder

MAGIC = 0x3143_4144_4E4B_5431
BLOCK_WORDS = 8
END_ID = 0
CACHED = 1_200_000
#: Characters of the longest piece that is kept; longer ones hardly recur.
CACHED_CHARS = 32
READ_TOKENS = 100_000
LETTER = "A-Za-zÀ-ÖØ-öø-ɏ"
#: Pieces that begin and end where the tokenizer's own pre-tokens do: a word, a full stop or
#: comma after one, a line end before one, and anything else up to a space before visible text.
PIECE = re.compile(
    rf" ?[{LETTER}]+(?=[ \n.,]|\Z)|[.,](?= [{LETTER}]|\n|\Z)|\n(?=[{LETTER}])"
    rf"|[\s\S]+?(?= [!-~{LETTER}]|\Z)"
)


class Encoder:
    """Ids of whole texts, from the tokenizers library. Words recur, so the ids of a piece of up
    to CACHED_CHARS characters are kept; the cache is started anew when it has CACHED pieces."""

    _open: dict[str | None, Encoder] = {}

    def __init__(self, file: str | None):
        import public_tokenizers
        from tokenizers import Tokenizer, pre_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        file = file or public_tokenizers.path("byte_bpe_50k.json")
        self.tokenizer = Tokenizer.from_file(file)
        # a piece that is one pre-token needs no split
        self.unsplit = Tokenizer.from_file(file)
        self.unsplit.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.known: dict[str, bytes] = {}

    @classmethod
    def of(cls, file: str | None) -> Encoder:
        """One per worker process."""
        if file not in cls._open:
            cls._open[file] = cls(file)
        return cls._open[file]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        split = [PIECE.findall(t) for t in texts]
        if len(self.known) > CACHED:
            self.known.clear()
        new = list(set().union(*split).difference(self.known))
        word = [(p[1:] if p[0] == " " else p).isalpha() for p in new]
        for tokenizer, kind in ((self.unsplit, True), (self.tokenizer, False)):
            some = [p for p, w in zip(new, word, strict=True) if w == kind]
            for piece, found in zip(
                some, tokenizer.encode_batch_fast(some, add_special_tokens=False), strict=True
            ):
                self.known[piece] = array("I", found.ids).tobytes()
        ids = self.known.__getitem__
        out = [np.frombuffer(b"".join(map(ids, pieces)), "<u4") for pieces in split]
        for piece in new:
            if len(piece) > CACHED_CHARS:
                del self.known[piece]
        return out


def _padded(data: bytes) -> bytes:
    return data + bytes(-len(data) % 8)


def _levels(ids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Chunks, bitmap words and directory of each level."""
    rest = ids.astype(np.uint32)
    while True:
        more = rest > 0xFF
        chunks = (rest & 0xFF).astype(np.uint8)
        if not more.any():
            yield chunks, np.zeros(0, np.uint64), np.zeros(1, np.int64)
            return
        bits = np.packbits(more, bitorder="little")
        words = np.frombuffer(_padded(bits.tobytes()), "<u8")
        ones = np.r_[0, np.cumsum(np.bitwise_count(words).astype(np.int64))]
        yield chunks, words, ones[: len(words) + 1 : BLOCK_WORDS]
        rest = rest[more] >> 8


def shard_bytes(names: list[str | None], documents: list[np.ndarray]) -> bytes:
    """One shard with all documents' ids, end ids included. A null name has no mark before it."""
    lengths = np.array([len(d) for d in documents], np.int64)
    ids = np.concatenate([*documents, np.zeros(0, np.uint32)])
    marks = [b"" if n is None else b"+" + n.encode() for n in names]
    levels = list(_levels(ids))
    parts = [
        np.array([MAGIC, len(ids), len(documents), len(levels)], "<i8").tobytes(),
        np.r_[0, np.cumsum(lengths)].astype("<i8").tobytes(),
        np.cumsum([len(m) for m in marks] or [0])[: len(marks)].astype("<i8").tobytes(),
        _padded(b"".join(marks)),
    ]
    for chunks, words, directory in levels:
        parts += [
            np.array([len(chunks), len(words)], "<i8").tobytes(),
            _padded(chunks.tobytes()),
            words.tobytes(),
            directory.astype("<i8").tobytes(),
        ]
    return b"".join(parts)


class Shard:
    """Random access to the tokens of a shard in memory or mapped into it."""

    def __init__(self, buffer):
        self.raw = np.frombuffer(buffer, np.uint8)
        self.at = 0
        magic, self.n_tokens, self.n_docs, levels = self._take("<i8", 4).tolist()
        if magic != MAGIC:
            raise ValueError("not a shard of token codes")
        self.starts = self._take("<i8", self.n_docs + 1)
        self.name_ends = self._take("<i8", self.n_docs)
        self.names = self._take("u1", int(self.name_ends[-1]) if self.n_docs else 0)
        self.levels = []
        for _ in range(levels):
            n, n_words = self._take("<i8", 2).tolist()
            chunks = self._take("u1", n)
            words = self._take("<u8", n_words)
            self.levels.append((chunks, words, self._take("<i8", len(words) // BLOCK_WORDS + 1)))

    def _take(self, kind: str, n: int) -> np.ndarray:
        size = np.dtype(kind).itemsize * n
        out = self.raw[self.at : self.at + size].view(kind)
        self.at += size + -size % 8
        return out

    def name(self, doc: int) -> str | None:
        begin = int(self.name_ends[doc - 1]) if doc else 0
        mark = self.names[begin : int(self.name_ends[doc])].tobytes()
        return mark[1:].decode() if mark else None

    def tokens(self, places: np.ndarray) -> np.ndarray:
        """Ids at any places, level by level."""
        ids = np.zeros(len(places), np.uint32)
        who, at = np.arange(len(places)), np.asarray(places, np.int64)
        for k, (chunks, words, directory) in enumerate(self.levels):
            ids[who] |= chunks[at].astype(np.uint32) << np.uint32(8 * k)
            if not len(words):
                break
            word, bit = at >> 6, (at & 63).astype(np.uint64)
            more = (words[word] >> bit) & np.uint64(1) == 1
            who, at, word, bit = who[more], at[more], word[more], bit[more]
            if not len(who):
                break
            block = word // BLOCK_WORDS
            rank = directory[block].copy()
            for i in range(BLOCK_WORDS):
                before = block * BLOCK_WORDS + i
                inside = before < word
                rank[inside] += np.bitwise_count(words[before[inside]])
            rank += np.bitwise_count(words[word] & ((np.uint64(1) << bit) - np.uint64(1)))
            at = rank
        return ids

    def document(self, doc: int) -> np.ndarray:
        return self.tokens(np.arange(self.starts[doc], self.starts[doc + 1]))

    def documents(self) -> Iterator[np.ndarray]:
        """All documents in order, about READ_TOKENS tokens at a time."""
        doc = 0
        while doc < self.n_docs:
            begin = self.starts[doc]
            stop = max(doc + 1, int(np.searchsorted(self.starts, begin + READ_TOKENS, "right")) - 1)
            ids = self.tokens(np.arange(begin, self.starts[stop]))
            yield from np.split(ids, self.starts[doc + 1 : stop] - begin)
            doc = stop


def open_shard(path: str) -> Shard:
    """A shard of the shared folder; mapped where that is a mounted folder."""
    from pyarrow import fs

    store, place = fs.FileSystem.from_uri(path)
    if isinstance(store, fs.LocalFileSystem):
        return Shard(np.memmap(place, np.uint8, "r"))
    with store.open_input_file(place) as file:
        return Shard(file.read())


def _uri(folder: str) -> str:
    return folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"


def write_token_codes(
    docs: DataFrame, folder: str, *, id_col: str = "doc_id", text_col: str = "text",
    tokenizer_file: str | None = None, shard_tokens: int = 4_000_000,
) -> DataFrame:
    """Write the shards of `docs` in ascending identifier order; returns their manifest:
    nth, file, n_docs, n_tokens and start, the tokens of all shards before."""
    folder = _uri(folder)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        encoder = Encoder.of(tokenizer_file)
        part = TaskContext.get().partitionId()
        names: list[str | None] = []
        documents: list[np.ndarray] = []
        held, nth = 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal names, documents, held, nth
            path = f"{folder}/{part:06d}-{nth:06d}-{uuid.uuid4().hex}.dac"
            store, place = fs.FileSystem.from_uri(path)
            store.create_dir(os.path.dirname(place), recursive=True)
            with store.open_output_stream(place) as file:
                file.write(shard_bytes(names, documents))
            row = pa.RecordBatch.from_pylist(
                [{"part": part, "seq": nth, "file": path, "n_docs": len(names), "n_tokens": held}],
                pa.schema([("part", pa.int64()), ("seq", pa.int64()), ("file", pa.string()),
                           ("n_docs", pa.int64()), ("n_tokens", pa.int64())]),
            )
            names, documents, held, nth = [], [], 0, nth + 1
            return row

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                for name, ids in zip(
                    some["name"].to_pylist(), encoder.encode(some["text"].to_pylist()), strict=True
                ):
                    names.append(name)
                    documents.append(np.append(ids, np.uint32(END_ID)))
                    held += len(ids) + 1
                    if held >= shard_tokens:
                        yield flush()
        if names:
            yield flush()

    order = ["doc_id", F.xxhash64("text")]
    shards = durable(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.col(id_col).cast("string").alias("name"),
            F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        )
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select("name", "text")
        .mapInArrow(write, "part long, seq long, file string, n_docs long, n_tokens long")
    )
    upto = F.sum("n_tokens").over(Window.orderBy("part", "seq"))
    nth = F.row_number().over(Window.orderBy("part", "seq"))
    return shards.select(
        nth.alias("nth"), "file", "n_docs", "n_tokens", (upto - F.col("n_tokens")).alias("start")
    )


def read_token_codes(manifest: DataFrame, id_type: str = "long") -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document in the files of `manifest`."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shard = open_shard(row["file"])
                docs = range(shard.n_docs)
                crcs = [zlib.crc32(ids.astype("<u4").tobytes()) for ids in shard.documents()]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([shard.name(i) for i in docs], pa.string()),
                        pa.array(row["start"] + shard.starts[:-1], pa.int64()),
                        pa.array(np.diff(shard.starts), pa.int64()),
                        pa.array(crcs, pa.int64()),
                    ],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    kept = durable(manifest)
    tasks = max(1, min(kept.count(), 20_000))
    return (
        kept.repartition(tasks, "nth")
        .mapInArrow(read, "doc_id string, start long, n_tokens long, ids_crc32 long")
        .withColumn("doc_id", F.col("doc_id").cast(id_type))
    )


def token_codes(docs: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """Write `docs` as token codes in the shared folder and read them back, per document."""
    folder = new_folder(docs.sparkSession, "token-codes")
    manifest = write_token_codes(docs, folder, id_col=id_col, **options)
    id_type = docs.schema[id_col].dataType.simpleString()
    out = durable(read_token_codes(manifest, id_type))
    remove_folder(docs.sparkSession, folder)
    return out
