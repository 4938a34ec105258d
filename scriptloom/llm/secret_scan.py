"""Secrets in texts: fixed rules, and a character convolutional network over what they miss.

Every text is scanned once, whole. The rules' matches are findings as they are. Every other run
of 16 or more characters that keys are made of is a candidate. A network sees the candidate and
the text around it, byte by byte; it is trained on labelled findings: the rules' values are
positive, candidates outside any match negative. Training takes all of them, each as often as it
occurs: windows lie in shards, every shard trains the network on its own windows, and after each
round the shards' networks are averaged. On a held-out fifth, with its own and other text before the value, the
network's scores are calibrated by a logistic fit, and the threshold is the highest that keeps
`recall` of the positives, however low that is. It comes from counts of all held-out scores in steps of 1/GRID.

Defined results: null and empty text has no spans; equal starts are ordered by kind; without
labelled findings of both kinds no span is added; repeated rows are each scanned; an empty table
gives an empty result. Columns other than id and text are ignored.
"""

from __future__ import annotations

import re
import warnings
from collections.abc import Iterator
from copy import deepcopy
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptloom.llm.common import BATCH_ROWS, durable, settings, utf8
from scriptloom.operators.keyed import numbered

# Fixed values of the contract.
ASSIGN = re.compile(
    rb"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
KINDS = ("assign", "access", "hex", "net")
LEAST_VALUE, LEAST_ACCESS, LEAST_HEX = 6, 20, 24

CANDIDATE = 16
BEFORE, INSIDE, AFTER = 24, 48, 8
WINDOW = BEFORE + INSIDE + AFTER
#: From one place of the window to the next: any run of so many bytes is whole in one of them.
STEP = INSIDE // 2
#: Rounds of training, each over all windows.
ROUNDS = 20
#: Windows of a shard, counted as often as they occur. Beyond MOST_SHARDS, which is what reaches the
#: driver in a round, shards grow. They are read in blocks of so many bytes.
SHARD, MOST_SHARDS, BLOCK = 8192, 128, 2 << 20
#: Held-out scores are counted in steps of 1/GRID, up to so far from zero.
GRID, FARTHEST = 4096, 64


def _table(chars: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[np.frombuffer(chars, np.uint8)] = True
    return table


LETTERS = bytes(range(65, 91)) + bytes(range(97, 123))
HEX = _table(b"0123456789abcdef")
KEY = _table(LETTERS + b"0123456789+/_.=-")


def runs(raw: np.ndarray, table: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Maximal runs of at least `least` bytes of a class."""
    edge = np.diff(table[raw].view(np.int8), prepend=0, append=0)
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    long = end - begin >= least
    return list(zip(begin[long].tolist(), end[long].tolist(), strict=True))


def rule_matches(text: bytes, raw: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(start, kind, end, start of value, end of value) in bytes, in order."""
    found = []
    if b"=" in text or b":" in text:
        for m in ASSIGN.finditer(text):
            if m.end(2) - m.start(2) >= LEAST_VALUE:
                found.append((m.start(), 0, m.end(), m.start(2), m.end(2)))
    if b"AKIA" in text:
        for m in ACCESS.finditer(text):
            if m.end() - m.start() >= LEAST_ACCESS:
                found.append((m.start(), 1, m.end(), m.start(), m.end()))
    found += [(a, 2, b, a, b) for a, b in runs(raw, HEX, LEAST_HEX)]
    return sorted(found)


def window(text: bytes, start: int, end: int) -> bytes:
    """A value's bytes with the text around them, at fixed places; for a value longer than
    INSIDE that of each place in turn, the last one at the value's end."""
    out = []
    for at in [*range(start, end - INSIDE, STEP), max(start, end - INSIDE)]:
        stop = min(end, at + INSIDE)
        before = text[max(0, at - BEFORE) : at].rjust(BEFORE, b"\0")
        inside = text[at:stop].ljust(INSIDE, b"\0")
        out.append(before + inside + text[stop : stop + AFTER].ljust(AFTER, b"\0"))
    return b"".join(out)


def scan_text(text: bytes) -> tuple[list[dict], list[dict]]:
    """Rule spans in code points, and labelled windows of rule values and candidates."""
    raw = np.frombuffer(text, np.uint8)
    matches = rule_matches(text, raw)
    others, nth, reach = [], 0, 0
    for a, b in runs(raw, KEY, CANDIDATE):  # in order, as the matches are
        while nth < len(matches) and matches[nth][0] < b:
            reach = max(reach, matches[nth][2])
            nth += 1
        if reach <= a:
            others.append((a, b))
    if not matches and not others:
        return [], []
    point = np.r_[0, np.cumsum((raw & 0xC0) != 0x80)]
    spans = [
        {"kind": k, "start": int(point[a]), "end": int(point[b])} for a, k, b, _, _ in matches
    ]
    seen = [(v, w, 1) for _, _, _, v, w in matches] + [(a, b, 0) for a, b in others]
    values = [
        {"start": int(point[a]), "end": int(point[b]), "label": y, "window": window(text, a, b)}
        for a, b, y in seen
    ]
    return spans, values


SPANS = "array<struct<kind: int, start: long, end: long>>"
VALUES = "array<struct<start: long, end: long, label: int, window: binary>>"
_SPANS = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]))
_VALUES = pa.list_(
    pa.struct(
        [("start", pa.int64()), ("end", pa.int64()), ("label", pa.int32()), ("window", pa.binary())]
    )
)


def scanned(text: Column) -> Column:
    @F.arrow_udf(f"struct<base: {SPANS}, found: {VALUES}>")
    def scan(texts: pa.Array) -> pa.Array:
        rows = [scan_text(t) for t in utf8(texts)]
        return pa.StructArray.from_arrays(
            [pa.array([x for x, _ in rows], _SPANS), pa.array([y for _, y in rows], _VALUES)],
            ["base", "found"],
        )

    return scan(text)


def _places(windows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All places of all values, and where those of each value begin, with the end."""
    x = np.frombuffer(b"".join(windows), np.uint8).reshape(-1, WINDOW)
    return x, np.cumsum([0] + [len(w) // WINDOW for w in windows])


class CharConv:
    """Byte embedding, one convolution, maximum over the window, one logistic unit."""

    def __init__(self, seed: int = 7, embed: int = 8, filters: int = 32, width: int = 5):
        rng = np.random.default_rng(seed)
        self.width = width
        self.p = {
            "e": rng.normal(0, 0.3, (256, embed)),
            "w": rng.normal(0, (2 / (embed * width)) ** 0.5, (embed * width, filters)),
            "b": np.zeros(filters),
            "v": rng.normal(0, 0.3, filters),
            "c": np.zeros(1),
        }
        self.m = {k: np.zeros_like(v) for k, v in self.p.items()}
        self.s = {k: np.zeros_like(v) for k, v in self.p.items()}
        self.steps = 0
        self.scale, self.shift, self.threshold = 1.0, 0.0, 1.1
        #: Labelled windows of label 0 and 1 that it learned from, and that its threshold comes from.
        self.trained, self.judged = [0, 0], [0, 0]

    def _forward(self, x: np.ndarray):
        emb = self.p["e"][x]
        cols = sliding_window_view(emb, self.width, axis=1).transpose(0, 1, 3, 2)
        cols = cols.reshape(len(x), -1, self.p["w"].shape[0])
        act = cols @ self.p["w"] + self.p["b"]
        top = act.argmax(axis=1)
        best = np.take_along_axis(act, top[:, None, :], axis=1)[:, 0, :]
        out = np.maximum(best, 0)
        return cols, top, best, out, out @ self.p["v"] + self.p["c"][0]

    def _each(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self._forward(x[i : i + 512])[-1] for i in range(0, len(x), 512)])

    def logits(self, windows: list[bytes]) -> np.ndarray:
        """The greatest over the places of each value."""
        if not windows:
            return np.zeros(0)
        x, first = _places(windows)
        return np.maximum.reduceat(self._each(x), first[:-1])

    def _chance(self, z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * z + self.shift, -40, 40)))

    def probability(self, windows: list[bytes]) -> np.ndarray:
        return self._chance(self.logits(windows))

    def train(
        self, windows: list[bytes], labels: np.ndarray, times: np.ndarray, weights: tuple[float, float],
        rng: np.random.Generator, rate: float = 0.004,
    ) -> None:
        """One visit of each window, `times` over; `weights` are those of label 0 and 1."""
        x, first = _places(windows)
        weight = np.where(labels == 1, weights[1], weights[0])
        m, s = self.m, self.s
        order = rng.permutation(np.repeat(np.arange(len(windows)), times))
        for at in range(0, len(order), 64):
            i = order[at : at + 64]
            place = first[i]
            for k in np.flatnonzero(first[i + 1] - first[i] > 1):
                place[k] += self._each(x[first[i[k]] : first[i[k] + 1]]).argmax()
            batch = x[place].copy()
            # half of the values get the text before another value, so the value counts too
            other = rng.random(len(i)) < 0.5
            lead = first[rng.integers(0, len(windows), other.sum())]
            at_start = place[other] == first[i[other]]
            batch[np.flatnonzero(other)[at_start], :BEFORE] = x[lead[at_start], :BEFORE]
            cols, top, best, out, z = self._forward(batch)
            dz = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - labels[i]) * weight[i] / len(i)
            dbest = dz[:, None] * self.p["v"] * (best > 0)
            rows = np.arange(len(i))[:, None]
            picked = cols[rows, top]  # row, filter, weight
            back = (dbest[:, :, None] * self.p["w"].T).reshape(*dbest.shape, self.width, -1)
            # the bytes that each filter's greatest place saw, and what goes back to each of them
            saw = batch[rows[:, :, None], top[:, :, None] + np.arange(self.width)].reshape(-1)
            back = back.reshape(len(saw), -1)
            grad = {
                "v": out.T @ dz,
                "c": dz.sum(keepdims=True),
                "b": dbest.sum(0),
                "w": np.einsum("rf,rfw->wf", dbest, picked),
                "e": np.stack([np.bincount(saw, b, len(self.p["e"])) for b in back.T], axis=1),
            }
            self.steps += 1
            for k, g in grad.items():
                m[k] = 0.9 * m[k] + 0.1 * g
                s[k] = 0.999 * s[k] + 0.001 * g * g
                self.p[k] -= rate * (m[k] / (1 - 0.9**self.steps)) / (np.sqrt(s[k] / (1 - 0.999**self.steps)) + 1e-8)

    def state(self) -> bytes:
        return b"".join(x[k].tobytes() for x in (self.p, self.m, self.s) for k in self.p)

    def average(self, states: list[bytes], shares: list[float], steps: list[int]) -> None:
        """Become the average of networks that were trained from this one on."""
        flat = sum(np.frombuffer(x) * share for x, share in zip(states, shares, strict=True)) / sum(shares)
        at = 0
        for x in (self.p, self.m, self.s):
            for k in self.p:
                x[k] = flat[at : at + x[k].size].reshape(x[k].shape)
                at += x[k].size
        self.steps = max(steps)

    def calibrate(self, windows: list[bytes], labels: np.ndarray, recall: float) -> None:
        """Logistic fit of the held-out labels, then the threshold."""
        self.calibrate_scores(self.logits(windows), labels, np.ones(len(labels), int), recall)

    def calibrate_scores(
        self, z: np.ndarray, labels: np.ndarray, times: np.ndarray, recall: float, within: float = 0.0
    ) -> None:
        """`calibrate` from scores with the times each occurs; a score may be up to `within` greater
        than given."""
        share = times / times.sum()
        self.scale, self.shift = 1.0, 0.0
        for _ in range(200):
            p = self._chance(z)
            # a little pull to scale 1 keeps separable labels finite
            self.scale -= 0.05 * (float(((p - labels) * z * share).sum()) + 0.01 * (self.scale - 1))
            self.shift -= 0.05 * float(((p - labels) * share).sum())
        p = np.minimum(self._chance(z), self._chance(z + within))[labels == 1]
        order = np.argsort(p, kind="stable")
        reached = np.cumsum(times[labels == 1][order])
        self.threshold = float(p[order[np.searchsorted(reached, int((1 - recall) * reached[-1] + 1e-9), "right")]])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes], np.ndarray, np.ndarray]]:
    """Shard, windows, labels and times of some BLOCK bytes of windows, as they lie."""
    names = ("shard", "label", "n", "window")
    cells = (c for b in batches for c in zip(*(b[k].to_pylist() for k in names), strict=True))
    for shard, rows in groupby(cells, itemgetter(0)):
        block, size = [], 0
        for row in rows:
            if size >= BLOCK:
                yield shard, [r[3] for r in block], np.array([r[1] for r in block], float), np.array([r[2] for r in block])
                block, size = [], 0
            block.append(row)
            size += len(row[3])
        yield shard, [r[3] for r in block], np.array([r[1] for r in block], float), np.array([r[2] for r in block])


def _round(windows: DataFrame, net: CharConv, nth: int, weights: tuple[float, float]) -> None:
    """Train `net` on all windows once."""

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, blocks in groupby(_blocks(batches), itemgetter(0)):
            own, share = deepcopy(net), 0
            for k, (_, texts, labels, times) in enumerate(blocks):
                rng = np.random.default_rng([11, nth, shard, k])
                own.train(texts, labels, times, weights, rng)
                share += int(times.sum())
            row = {"shard": shard, "share": share, "steps": own.steps, "state": own.state()}
            yield pa.RecordBatch.from_pylist([row])

    rows = windows.mapInArrow(learn, "shard long, share long, steps long, state binary").collect()
    rows.sort(key=lambda r: r.shard)
    net.average([bytes(r.state) for r in rows], [r.share for r in rows], [r.steps for r in rows])


def _held_scores(held: DataFrame, net: CharConv) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scores of the held-out windows in steps of 1/GRID, their labels and the times each occurs, of
    each window as it is and with the text before another one."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts, labels, times in _blocks(batches):
            moved = [o[:BEFORE] + w[BEFORE:] for w, o in zip(texts, texts[1:] + texts[:1], strict=True)]
            z = np.clip(net.logits(texts + moved), -FARTHEST, FARTHEST)
            cells = [np.floor(z * GRID).astype(np.int64), np.tile(labels, 2).astype(np.int64), np.tile(times, 2)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cells], ["step", "label", "n"])

    counts = held.mapInArrow(score, "step long, label long, n long").groupBy("step", "label").agg(F.sum("n").alias("n"))
    rows = np.array(sorted(counts.collect()), dtype=np.int64).reshape(-1, 3)
    return rows[:, 0] / GRID, rows[:, 1].astype(float), rows[:, 2]


def fit(found: DataFrame, *, sample: int | None = None, recall: float = 0.98) -> CharConv | None:
    """Network trained on all labelled windows, but for every fifth distinct one by hash, which
    is held out for the threshold; with `sample` only on so many distinct windows of each label,
    those with the least hash. Where a label has fewer than two windows nothing can be learned: a
    warning is given, there is no network, and the rules stand alone."""
    windows = durable(
        found.select(F.explode("found").alias("f"))
        .groupBy("f.label", "f.window")
        .agg(F.count("*").alias("n"))
        .withColumn("hash", F.xxhash64("window"))
    )
    if sample is not None:
        some = [windows.filter(F.col("label") == y).orderBy("hash", "window").limit(sample) for y in (0, 1)]
        windows = durable(some[0].unionByName(some[1]))
    sizes = windows.groupBy("label").agg(F.count("*").alias("distinct"), F.sum("n").alias("n"))
    by_label = {r.label: r for r in sizes.collect()}
    if any(y not in by_label or by_label[y].distinct < 2 for y in (0, 1)):
        warnings.warn("too few labelled windows to train on: no spans are added to the rules'", stacklevel=2)
        return None
    shards = min(MOST_SHARDS, -(-sum(r.n for r in by_label.values()) // SHARD))
    # a window that occurs often is dealt over the shards
    among = F.when(F.col("held"), F.lit(1)).otherwise(F.least("n", F.lit(shards)))
    parts = (
        numbered(windows, ["label"], "hash", "place")
        .withColumn("held", F.col("place") % 5 == 1)
        .withColumn("among", among)
        .withColumn("nth", F.explode(F.sequence(F.lit(0).cast("long"), F.col("among") - 1)))
        .withColumn("shard", F.pmod(F.pmod("hash", F.lit(shards)) + F.col("nth"), F.lit(shards)))
        .withColumn("n", F.floor((F.col("n") + F.col("nth")) / F.col("among")))
        .select("shard", "hash", "window", "label", "n", "held")
    )
    dealt = durable(parts.repartition(shards, "shard").sortWithinPartitions("shard", "hash", "window", "label"))
    net = CharConv()
    for held, label, n in dealt.groupBy("held", "label").agg(F.sum("n")).collect():
        (net.judged if held else net.trained)[label] = n
    total = sum(net.trained)
    weights = (0.5 * total / net.trained[0], 0.5 * total / net.trained[1])
    with settings(found.sparkSession, {"spark.sql.execution.arrow.maxRecordsPerBatch": str(BATCH_ROWS)}):
        for nth in range(ROUNDS):
            _round(dealt.filter("NOT held"), net, nth, weights)
        net.calibrate_scores(*_held_scores(dealt.filter("held"), net), recall, 1 / GRID)
    return net


def _added(found: Column, net: CharConv | None) -> Column:
    """Candidates that the network takes for secrets, as spans of kind `net`."""

    @F.arrow_udf(SPANS)
    def add(rows: pa.Array) -> pa.Array:
        values = rows.to_pylist()
        ask = [v for found in values for v in found if not v["label"]] if net else []
        yes = iter(net.probability([v["window"] for v in ask]) >= net.threshold if ask else ())
        out = [
            [
                {"kind": 3, "start": v["start"], "end": v["end"]}
                for v in found
                if net and not v["label"] and next(yes)
            ]
            for found in values
        ]
        return pa.array(out, _SPANS)

    return add(found)


def _written(spans: Column) -> Column:
    kind = F.array(*[F.lit(k) for k in KINDS])
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], s["kind"], s["end"])))
    return F.array_join(
        F.transform(
            ordered,
            lambda s: F.concat_ws(":", F.element_at(kind, s["kind"] + 1), s["start"], s["end"]),
        ),
        ",",
    )


def scan_secrets(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", sample: int | None = None,
    recall: float = 0.98, net: CharConv | None = None,
) -> DataFrame:
    """doc_id, base (rule spans) and added (the network's spans) of every row; spans have kind
    number, start and end in code points, end exclusive. Without `net`, one is trained on the
    findings in `docs`."""
    found = durable(
        docs.select(F.col(id_col).alias("doc_id"), scanned(F.col(text_col)).alias("s")).select(
            "doc_id", "s.base", "s.found"
        )
    )
    net = net or fit(found, sample=sample, recall=recall)
    return found.select("doc_id", "base", _added(F.col("found"), net).alias("added"))


def findings(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """Labelled windows of `docs`, for `fit`."""
    return docs.select(scanned(F.col(text_col)).alias("s")).select("s.found")


def digest(scanned_rows: DataFrame) -> DataFrame:
    """The contract's columns of what `scan_secrets` returns."""
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return scanned_rows.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(_written(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        _written(F.concat("base", "added")).alias("spans"),
    )
