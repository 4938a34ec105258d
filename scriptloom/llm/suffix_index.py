"""Repeated passages, found with a logarithmic family of hashed anchor indexes.

This is a logarithmic index family as suffix arrays would form it, but its entries are in the
order of a hash, not of suffix bytes: a scan against a level finds entries with equal hashes of
K bytes, and match lengths come from the exact comparison after it. A suffix array of every byte
would take 8 bytes a byte of text.

Every string of `length` bytes has an anchor: the position in it whose K bytes have the least
hash, the leftmost of equals. Equal strings have their anchors at the same place, so it is
enough to index the suffixes that begin at anchors, about one in 70. A batch of files gets a
sorted array of its anchors, in the order of the hash of their first K bytes and dealt to shards by
that hash. It is merge-scanned with the levels that are there; anchors of either side that
share K bytes with another are candidates. Then the batch and the newest levels of equal size
are merged into one level, so there are logarithmically many.

Candidates are then compared exactly. The strings that have a candidate as their anchor are
consecutive and cover one context of bytes. A context that occurs twice is repeated as a whole.
A context that occurs once is compared, string by string, with the other contexts of its
anchor. Equality of contexts and strings is equality of 128 bits of hashes.

Levels are files of sorted arrays in the shared folder, under names that no other attempt uses.

Defined results: null and empty text has 0 bytes; texts shorter than `length` lose nothing;
a repeat within one text counts; repeated rows lose everything if they are long enough; texts
of one repeated character have an anchor at every byte, which is slower and right; an empty
table gives an empty result. Columns other than id and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptloom.llm.common import durable, maybe_members, new_folder, remove_folder, utf8
from scriptloom.llm.exact_dedup import located
from scriptloom.llm.kneser_ney import map_file, pack_arrays, shard_of, unpack_arrays, write_file

K = 64
SEGMENT = 1 << 22
PLACE = np.uint64((1 << 24) - 1)
FLUSH_ANCHORS = 400_000
COMPARE_CONTEXTS = 4_000


def rolling(raw: np.ndarray, width: int, base: int) -> np.ndarray:
    """Polynomial hash modulo 2^64 of every run of `width` mixed bytes."""
    with np.errstate(over="ignore"):
        byte = np.arange(1, 257, dtype=np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
        byte ^= byte >> np.uint64(31)
        byte *= np.uint64((0x94D049BB133111EB + 2 * base) % (1 << 64))
        level = byte[raw]
        factor = np.uint64(base | 1)
        have, out, n = 0, None, 1
        while n <= width:
            if width & n:
                if out is None:
                    out, have = level, n
                else:
                    size = len(raw) - have - n + 1
                    out = out[:size] * factor + level[have : have + size]
                    have += n
            if 2 * n <= width:
                level = level[:-n] * factor + level[n:]
                factor = factor * factor
            n *= 2
        out = out ^ (out >> np.uint64(29))
        out = out * np.uint64(0xD6E8FEB86659FD93)
        return out ^ (out >> np.uint64(32))


def least_in_window(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` consecutive values, from minima towards both block ends."""
    n = len(values) - width + 1
    full = np.full(-(-len(values) // width) * width, ~np.uint64(0))
    full[: len(values)] = values
    blocks = full.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def dealt(keys: np.ndarray) -> np.ndarray:
    """Hashes of anchors, which are least hashes, spread evenly over all values."""
    with np.errstate(over="ignore"):
        keys = keys * np.uint64(0x9E3779B97F4A7C15)
        keys = (keys ^ (keys >> np.uint64(32))) * np.uint64(0xC2B2AE3D27D4EB4F)
        return keys ^ (keys >> np.uint64(29))


def anchors(text: bytes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each run of strings with one anchor: first start, anchor's place, anchor's hash.
    A last entry holds the number of strings."""
    starts, places, keys = [], [], []
    total = len(text) - length + 1
    width = length - K + 1
    for at in range(0, max(total, 0), SEGMENT):
        raw = np.frombuffer(text, np.uint8)[at : at + SEGMENT + length - 1]
        key = rolling(raw, K, 0x9E3779B97F4A7C15)
        coded = (key & ~PLACE) | np.arange(len(key), dtype=np.uint64)
        place = (least_in_window(coded, width) & PLACE).astype(np.int64)
        first = np.flatnonzero(np.diff(place, prepend=-1))
        starts.append(first + at)
        places.append(place[first] + at)
        keys.append(dealt(key[place[first]]))
    starts.append(np.array([max(total, 0)]))
    empty = np.zeros(0, np.int64)
    return (
        np.concatenate(starts),
        np.concatenate([*places, empty]),
        np.concatenate([*keys, empty.astype(np.uint64)]),
    )


# --- the index -----------------------------------------------------------------------------


def anchor_blocks(rows: Iterator[tuple[int, bytes]], length: int, bits: int) -> Iterator[tuple[int, bytes]]:
    """(shard, block) of the sorted anchors of texts."""
    held: list[tuple[np.ndarray, ...]] = []
    n = 0

    def flush() -> Iterator[tuple[int, bytes]]:
        key, row, place = (np.concatenate(c) for c in zip(*held, strict=True))
        order = np.argsort(key)
        key, row, place = key[order], row[order], place[order]
        shards = shard_of(key, bits)
        at = np.flatnonzero(np.diff(shards, prepend=-1))
        for i, j in zip(at, [*at[1:], len(key)], strict=True):
            yield int(shards[i]), pack_arrays(key[i:j], row[i:j], place[i:j])

    for row, text in rows:
        _, place, key = anchors(text, length)
        if len(key):
            held.append((key, np.full(len(key), row), place))
            n += len(key)
        if n >= FLUSH_ANCHORS:
            yield from flush()
            held, n = [], 0
    if held:
        yield from flush()


def merge_scan(
    batch: list[np.ndarray], levels: list[list[np.ndarray]]
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, place) of the suffixes of a sorted batch and of sorted levels that agree in their
    first K bytes with another suffix of the batch or between batch and level."""
    key = batch[0]
    same = key[1:] == key[:-1]
    hit = np.zeros(len(key), bool)
    hit[1:] |= same
    hit[:-1] |= same
    distinct = key[np.r_[True, ~same]] if len(key) else key
    for keys, rows, places in levels:
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        hit |= keys[at] == key
        back = np.minimum(np.searchsorted(distinct, keys), len(distinct) - 1)
        other = distinct[back] == keys
        yield rows[other], places[other]
    yield batch[1][hit], batch[2][hit]


MADE = "shard long, size long, file string, merged array<string>, row long, place long"
_MADE = pa.schema(
    [("shard", pa.int64()), ("size", pa.int64()), ("file", pa.string()),
     ("merged", pa.list_(pa.string())), ("row", pa.int64()), ("place", pa.int64())]
)


def take_in(
    folder: str, shard: int, blocks: list[list[np.ndarray]], stack: list[tuple[int, str]]
) -> Iterator[pa.RecordBatch]:
    """Scan one shard of a batch against its levels, newest last, and write the level that
    the batch and the newest levels of equal size merge into."""
    types = (np.uint64, np.int64, np.int64)
    columns = [np.concatenate([b[i].astype(t) for b in blocks]) for i, t in enumerate(types)]
    order = np.argsort(columns[0], kind="stable")
    batch = [c[order] for c in columns]
    levels = [[a.astype(t, copy=False) for a, t in zip(map_file(p), types, strict=True)] for _, p in stack]
    for row, place in merge_scan(batch, levels):
        n = len(row)
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(n, f.type) for f in _MADE][:4] + [pa.array(row), pa.array(place)], schema=_MADE
        )
    size, merged, parts = 1, [], [batch]
    while stack and stack[-1][0] == size:
        _, path = stack.pop()
        merged.append(path)
        parts.append(levels[len(stack)])
        size *= 2
    columns = [np.concatenate(c) for c in zip(*parts, strict=True)]
    order = np.argsort(columns[0], kind="stable")
    path = write_file(folder, pack_arrays(*[c[order] for c in columns]))
    yield pa.RecordBatch.from_pylist(
        [{"shard": shard, "size": size, "file": path, "merged": merged}], _MADE
    )


def index_batches(rows: DataFrame, folder: str, length: int, files: list[str], batches: int, bits: int):
    """Take in `rows` (_file, row, text) in batches of files; returns the candidates (row, place)
    of every batch, repeats included."""
    spark = rows.sparkSession
    stacks: dict[int, list[tuple[int, str]]] = {}
    found = []
    step = max(1, -(-len(files) // batches))
    tasks = min(1 << bits, 20_000)

    for at in range(0, len(files), step):
        names = files[at : at + step]
        known = {shard: list(stack) for shard, stack in stacks.items()}

        def block(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            texts = (x for p in parts for x in zip(p["row"].to_pylist(), utf8(p["text"]), strict=True))
            for shard, data in anchor_blocks(texts, length, bits):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard], pa.int64()), pa.array([data], pa.binary())], ["shard", "block"]
                )

        def scan(parts: Iterator[pa.RecordBatch], known=known) -> Iterator[pa.RecordBatch]:
            shard, blocks = None, []
            for part in parts:
                for number, data in zip(part["shard"].to_pylist(), part["block"], strict=True):
                    if blocks and number != shard:
                        yield from take_in(folder, shard, blocks, list(known.get(shard, [])))
                        blocks = []
                    shard = number
                    blocks.append(unpack_arrays(data.as_buffer()))
            if blocks:
                yield from take_in(folder, shard, blocks, list(known.get(shard, [])))

        made = durable(
            rows.filter(F.col("_file").isin(names))
            .select("row", "text")
            .mapInArrow(block, "shard long, block binary")
            .repartition(tasks, "shard")
            .sortWithinPartitions("shard")
            .mapInArrow(scan, MADE)
        )
        found.append(made.filter("row IS NOT NULL").select("row", "place"))
        for new in made.filter("file IS NOT NULL").select("shard", "size", "file", "merged").collect():
            stack = stacks.setdefault(new.shard, [])
            del stack[len(stack) - len(new.merged) :]
            stack.append((new.size, new.file))
            for path in new.merged:
                remove_folder(spark, path)
    return found


# --- exact comparison ----------------------------------------------------------------------


def contexts(text: bytes, places: list[int], length: int) -> list[np.ndarray]:
    """Start, offset of the anchor, number of strings, key and hash of the contexts whose
    anchor is one of `places`."""
    starts, place, key = anchors(text, length)
    wanted = np.flatnonzero(np.isin(place, np.array(places, np.int64)))
    start, n = starts[wanted], np.diff(starts)[wanted]
    offset = place[wanted] - start
    digest = np.fromiter(
        (
            xxhash.xxh64_intdigest(text[a : a + m + length - 1], o)
            for a, m, o in zip(start.tolist(), n.tolist(), offset.tolist(), strict=True)
        ),
        np.uint64,
        len(wanted),
    )
    return [start, offset, n, key[wanted].view(np.int64), digest.view(np.int64)]


def string_hashes(data: list[bytes], offsets: np.ndarray, length: int):
    """For all strings of contexts: number of the context, place from the anchor, two hashes."""
    raw = np.frombuffer(b"".join(data), np.uint8)
    sizes = np.array([len(d) for d in data])
    counts = sizes - length + 1
    begin = np.cumsum(sizes) - sizes
    which = np.repeat(np.arange(len(data)), counts)
    inside = np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts)
    at = begin[which] + inside
    hashes = [rolling(raw, length, base)[at] for base in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]
    return which, inside, inside - offsets[which], hashes


def repeated_strings(keys: np.ndarray, data: list[bytes], offsets: np.ndarray, length: int):
    """(context, string) for each string that another context of its key has at the same place
    from the anchor. A context has one string at a place, so equal strings are of two."""
    which, inside, place, (one, two) = string_hashes(data, offsets, length)
    with np.errstate(over="ignore"):
        mixed = one + keys.view(np.uint64)[which] * np.uint64(0xFF51AFD7ED558CCD)
        mixed ^= place.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25)
    order = np.lexsort([two, mixed])
    same = (mixed[order][1:] == mixed[order][:-1]) & (two[order][1:] == two[order][:-1])
    hit = np.zeros(len(order), bool)
    hit[order[1:]] |= same
    hit[order[:-1]] |= same
    return which[hit], inside[hit]


def runs_of(which: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Context, first and last string of each run of consecutive strings."""
    if not len(which):
        return which, inside, inside
    new = np.r_[True, (np.diff(which) != 0) | (np.diff(inside) != 1)]
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(which)] - 1
    return which[first], inside[first], inside[last]


def removed_spans(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of bytes in any of the ranges."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


RANGE = "row long, begin long, stop long"
RESULT = "n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _compare(length: int):
    def compare(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Contexts in order of their key; whole keys, many at once."""
        held: list[dict] = []

        def flush() -> pa.RecordBatch:
            keys = np.array([h["key"] for h in held], np.int64)
            offsets = np.array([h["off"] for h in held], np.int64)
            context, first, last = runs_of(
                *repeated_strings(keys, [h["data"] for h in held], offsets, length)
            )
            single = np.array([h["n"] == 1 for h in held], bool)[context]
            row = np.array([h["row"] for h in held], np.int64)[context[single]]
            start = np.array([h["s0"] for h in held], np.int64)[context[single]]
            return pa.RecordBatch.from_arrays(
                [pa.array(row), pa.array(start + first[single]), pa.array(start + last[single] + length)],
                ["row", "begin", "stop"],
            )

        for part in parts:
            for item in part.to_pylist():
                if len(held) >= COMPARE_CONTEXTS and item["key"] != held[-1]["key"]:
                    yield flush()
                    held = []
                held.append(item)
        if held:
            yield flush()

    return compare


def repeated_ranges(
    rows: DataFrame, candidates: DataFrame, length: int, contexts_per_task: int
) -> DataFrame:
    """(row, begin, stop) of byte ranges made of repeated strings."""
    places = durable(
        candidates.groupBy("row").agg(F.collect_set("place").alias("places"))
    )

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for row, text, at in zip(
                part["row"].to_pylist(), utf8(part["text"]), part["places"].to_pylist(), strict=True
            ):
                columns = contexts(text, at, length)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(columns[0]), row)), *map(pa.array, columns)],
                    ["row", "s0", "off", "strings", "key", "digest"],
                )

    maybe, _ = maybe_members(rows.select("row", "text"), places, "row")
    found = durable(
        maybe.join(places, "row").mapInArrow(
            cut, "row long, s0 long, off long, strings long, key long, digest long"
        )
    )
    kinds = durable(
        found.groupBy("key", "digest", "off", "strings").agg(
            F.count("*").alias("n"), F.min(F.struct("row", "s0")).alias("one")
        )
    )
    keys = durable(
        kinds.groupBy("key")
        .agg(F.count("*").alias("kinds"), F.count_if(F.col("n") == 1).alias("single"))
        .filter("kinds > 1 AND single > 0")
        .select("key", "kinds")
    )
    whole = found.join(
        kinds.filter("n > 1").select("key", "digest", "off", "strings"), ["key", "digest", "off", "strings"]
    ).select("row", F.col("s0").alias("begin"), (F.col("s0") + F.col("strings") + length - 1).alias("stop"))

    asked = durable(
        kinds.join(keys, "key")
        .select(
            F.col("one.row").alias("row"),
            F.struct(F.col("one.s0").alias("s0"), "off", "strings", "key", "n", "kinds").alias("c"),
        )
        .groupBy("row")
        .agg(F.collect_list("c").alias("asked"))
    )

    def fetch(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            out = []
            for row, text, some in zip(
                part["row"].to_pylist(), utf8(part["text"]), part["asked"].to_pylist(), strict=True
            ):
                for c in some:
                    data = text[c["s0"] : c["s0"] + c["strings"] + length - 1]
                    out.append(
                        {"key": c["key"], "off": c["off"], "n": c["n"], "row": row, "s0": c["s0"],
                         "kinds": c["kinds"], "data": data}
                    )
            if out:
                yield pa.RecordBatch.from_pylist(out)

    maybe, _ = maybe_members(rows.select("row", "text"), asked, "row")
    fetched = durable(
        maybe.join(asked, "row").mapInArrow(
            fetch, "key long, off long, n long, row long, s0 long, kinds long, data binary"
        )
    )
    part = (
        fetched.filter(F.col("kinds") <= contexts_per_task)
        .repartition("key")
        .sortWithinPartitions("key")
        .mapInArrow(_compare(length), RANGE)
    )
    return whole.unionByName(part).unionByName(
        wide_keys(fetched.filter(F.col("kinds") > contexts_per_task), length)
    )


def wide_keys(fetched: DataFrame, length: int) -> DataFrame:
    """As `_compare` for keys with too many contexts for one task: every string travels as its
    place and two hashes, and equal ones are counted over all tasks."""

    def strings(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for at in range(0, part.num_rows, 2000):
                some = part.slice(at, 2000).to_pylist()
                offsets = np.array([s["off"] for s in some], np.int64)
                which, inside, place, (one, two) = string_hashes([s["data"] for s in some], offsets, length)
                pick = lambda name: np.array([s[name] for s in some], np.int64)[which]  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays(
                    [pa.array(pick("key")), pa.array(place), pa.array(one.view(np.int64)),
                     pa.array(two.view(np.int64)), pa.array(pick("row")),
                     pa.array(pick("s0") + inside), pa.array(pick("n"))],
                    ["key", "place", "one", "two", "row", "begin", "n"],
                )

    each = fetched.mapInArrow(
        strings, "key long, place long, one long, two long, row long, begin long, n long"
    )
    same = ["key", "place", "one", "two"]
    twice = each.groupBy(*same).agg(F.count("*").alias("times")).filter("times > 1").select(*same)
    return (
        each.filter("n = 1")
        .join(twice, same)
        .select("row", "begin", (F.col("begin") + length).alias("stop"))
    )


def _kept(texts, ranges) -> Iterator[tuple[int, int, int, str]]:
    for text, own in zip(texts, ranges, strict=True):
        spans = removed_spans([(r["begin"], r["stop"]) for r in own or ()])
        digest, at = hashlib.sha256(), 0
        for a, b in spans:
            digest.update(text[at:a])
            at = b
        digest.update(text[at:])
        yield len(text), sum(b - a for a, b in spans), len(spans), digest.hexdigest()


def numbered(docs: DataFrame, folder: str) -> tuple[DataFrame, list[str]]:
    """`docs` with `row`, a number for each row from its file's number and its place there. The
    list of file names, which is what is broadcast, is as long as the table has files."""
    spark: SparkSession = docs.sparkSession
    rows = located(docs, folder).select("doc.*", "_file", "_row")
    files = sorted(r[0] for r in rows.select("_file").distinct().collect())
    names = spark.createDataFrame(list(enumerate(files)), "nth long, _file string")
    row = F.shiftleft("nth", 32).bitwiseOR(F.col("_row"))
    return rows.join(F.broadcast(names), "_file").withColumn("row", row).drop("nth", "_row"), files


def remove_repeats(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 200,
    batches: int = 4, shard_bytes: int = 1 << 25, contexts_per_task: int = 200_000,
) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row: bytes in any string of
    `length` bytes that also starts elsewhere are removed, judged on the input."""
    if length < K:
        raise ValueError(f"length is at least {K}")
    folder = new_folder(docs.sparkSession, "suffix-index")
    uri = folder if folder.startswith("file:") or "://" in folder else f"file://{folder}"
    text = F.coalesce(F.col(text_col), F.lit("")).alias("text")
    rows, files = numbered(docs.select(F.col(id_col).alias("doc_id"), text), f"{folder}/content")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(0, (size // shard_bytes).bit_length())
    spans = rows.select("doc_id", "row", "text")
    found = index_batches(rows, f"{uri}/levels", length, files, batches, bits)
    remove_folder(docs.sparkSession, f"{folder}/levels")
    if found:
        candidates = found[0]
        for more in found[1:]:
            candidates = candidates.unionByName(more)
        ranges = durable(
            repeated_ranges(rows, candidates, length, contexts_per_task)
            .groupBy("row")
            .agg(F.collect_set(F.struct("begin", "stop")).alias("ranges"))
        )
        maybe, never = maybe_members(spans, ranges, "row")
        spans = maybe.join(ranges, "row", "left").select("doc_id", "text", "ranges").unionByName(
            never.select("doc_id", "text", F.lit(None).cast(ranges.schema["ranges"].dataType).alias("ranges"))
        )
    else:
        none = F.lit(None).cast("array<struct<begin: long, stop: long>>")
        spans = spans.select("doc_id", "text", none.alias("ranges"))

    @F.arrow_udf(f"struct<{', '.join(c.replace(' ', ': ') for c in RESULT.split(', '))}>")
    def kept(texts: pa.Array, ranges: pa.Array) -> pa.Array:
        rows = list(_kept(utf8(texts), ranges.to_pylist()))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
        columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
        return pa.StructArray.from_arrays(columns, [c.split()[0] for c in RESULT.split(", ")])

    return durable(spans.select("doc_id", kept("text", "ranges").alias("k")).select("doc_id", "k.*"))
