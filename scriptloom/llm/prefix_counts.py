"""Exact token counts of every prefix of a text, by dynamic programming over its bytes.

In byte-pair encoding the encoding of a prefix is that of a shorter prefix and one token more:
of all tokens that end at a byte exactly one is the last token there, the one that may follow
the last token where it begins. Two tokens may follow each other if no merge over their seam
comes before the merges that make them, which only the parts at the seam decide. So one pass
over a pre-token gives the count at each of its bytes, and no prefix is encoded.

A prefix can be cut into pre-tokens otherwise than the whole text, and its count is that of the
library for the prefix by itself: white space at its end is one pre-token, a contraction cut
short is two, and a special string cut short is plain text. Counts can fall from one prefix to
the next, as when the last letter completes a word that is one token.

Stored are the differences from prefix to prefix, 16 bits a character. They answer how many
tokens a prefix has and which prefix fits a budget, without encoding again.

Defined results: null text is empty, with no tokens; special strings are one token, as the
library takes them by default; whole texts count, however long; rows repeat as they come, with
null identifiers too; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import json
import math
import re
from array import array
from collections.abc import Iterator
from operator import sub

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptloom.llm.token_codes import CACHED_CHARS, PIECE

#: White space as the tokenizer's pattern has it.
BLANK = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
RUN = re.compile(f"[{BLANK}]{{2,}}")
#: Runs that a piece of text may have cut before their last space.
CROSSING = re.compile(f"(?<![{BLANK}])[{BLANK}]+ (?=[^{BLANK}])")
#: Pre-tokens that are no pre-tokens before their last letter: apostrophe and letter part.
CONTRACTIONS = ("'re", "'ve", "'ll")
KEPT_PAIRS = 1_000_000
KEPT_PIECES = 800_000


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if it is visible,
    else the next one from 256 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b if b in visible else next(hidden)) for b in range(256)]


class Merges:
    """Which tokens may follow each other. Tokens are texts of byte letters."""

    def __init__(self, merges: list[tuple[str, str]]):
        self.rank = {pair: i for i, pair in enumerate(merges)}
        self.made_of = {a + b: (a, b) for a, b in merges}
        self.spines: tuple[dict, dict] = ({}, {})
        self.pairs: dict[tuple[str, str], bool] = {}
        self.whole: dict[str, bool] = {}

    def encode(self, word: str) -> list[str]:
        """By definition: the merge of least rank first, leftmost first."""
        parts = list(word)
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.rank.get((parts[i], parts[i + 1]), math.inf))
            if (parts[best], parts[best + 1]) not in self.rank:
                break
            pair = (parts[best], parts[best + 1])
            out, i = [], 0
            while i < len(parts):
                if tuple(parts[i : i + 2]) == pair:
                    out.append(parts[i] + parts[i + 1])
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return parts

    def _spine(self, token: str, side: int) -> list[tuple[str, float]]:
        """The parts of a token that stand at its first (0) or last (1) byte, shortest first,
        each with the rank of the merge that takes it up."""
        known = self.spines[side]
        if token not in known:
            parts, taken, part = [], math.inf, token
            while True:
                parts.append((part, taken))
                if part not in self.made_of:
                    break
                taken = self.rank[self.made_of[part]]
                part = self.made_of[part][side]
            known[token] = parts[::-1]
        return known[token]

    def _over(self, left: str, right: str) -> tuple[str, str] | None:
        """The parts of two tokens that the first merge over their seam joins, if one does."""
        ends, begins = self._spine(left, 1), self._spine(right, 0)
        i = j = 0
        while True:
            (a, a_taken), (b, b_taken) = ends[i], begins[j]
            over = self.rank.get((a, b), math.inf)
            # at equal ranks the merge to the left comes first
            if over < a_taken and over <= b_taken:
                return a, b
            if a_taken == b_taken == math.inf:
                return None
            if a_taken <= b_taken:
                i += 1
            else:
                j += 1

    def stands(self, token: str) -> bool:
        """Whether the token's text is encoded as the token."""
        if token not in self.whole:
            parts = self.made_of.get(token)
            self.whole[token] = len(token) == 1 or (
                parts is not None and all(map(self.stands, parts)) and self._over(*parts) == parts
            )
        return self.whole[token]

    def follows(self, left: str, right: str) -> bool:
        """Whether left + right is encoded as these two tokens."""
        if len(self.pairs) > KEPT_PAIRS:
            self.pairs.clear()
        known = self.pairs[left, right] = self._over(left, right) is None
        return known


class _Pieces(dict):
    """Differences of a piece of text, kept while short pieces are few enough."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, piece: str) -> bytes:
        found = self.make(piece)
        if len(piece) <= CACHED_CHARS:
            if len(self) >= KEPT_PIECES:
                self.clear()
            self[piece] = found
        return found


class PrefixCounter:
    """Counts of all prefixes for one byte-level vocabulary file."""

    _open: dict[str | None, PrefixCounter] = {}

    def __init__(self, file: str | None):
        import public_tokenizers
        from tokenizers import Tokenizer

        file = file or public_tokenizers.path("byte_bpe_50k.json")
        with open(file, encoding="utf-8") as text:
            model = json.load(text)["model"]
        self.tokenizer = Tokenizer.from_file(file)
        self.merges = Merges([tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]])
        self.letters = byte_letters()
        self.ending = ahocorasick.Automaton()
        for token in filter(self.merges.stands, model["vocab"]):
            self.ending.add_word(token, token)
        self.ending.make_automaton()
        special = sorted((t.content for t in self.tokenizer.get_added_tokens_decoder().values()), reverse=True)
        self.special = re.compile("|".join(map(re.escape, special)) or r"(?!)")
        self.pieces = _Pieces(self._piece)

    @classmethod
    def of(cls, file: str | None) -> PrefixCounter:
        """One per worker process."""
        if file not in cls._open:
            cls._open[file] = cls(file)
        return cls._open[file]

    def byte_counts(self, word: str) -> list[int]:
        """Tokens of each prefix of a pre-token in byte letters, the empty one included."""
        known, follows = self.merges.pairs.get, self.merges.follows
        count = [0] * (len(word) + 1)
        last = [""] * (len(word) + 1)
        for end, token in self.ending.iter(word):
            end += 1
            if count[end]:
                continue
            begin = end - len(token)
            if begin:
                fits = known((last[begin], token))
                if not (follows(last[begin], token) if fits is None else fits):
                    continue
            count[end], last[end] = count[begin] + 1, token
        return count

    def _char_counts(self, text: str) -> list[int]:
        """Tokens of each prefix of a pre-token, in characters, the empty one included."""
        raw = text.encode()
        count = self.byte_counts("".join(map(self.letters.__getitem__, raw)))
        if len(raw) == len(text):
            return count
        return [n for n, b in zip(count, raw, strict=False) if b & 0xC0 != 0x80] + count[-1:]

    def _piece(self, piece: str) -> bytes:
        if (piece[1:] if piece[0] == " " else piece).isalpha():  # one pre-token
            count = self._char_counts(piece)
            return array("h", map(sub, count[1:], count)).tobytes()
        count = [0]
        for _, (begin, end) in self.tokenizer.pre_tokenizer.pre_tokenize_str(piece):
            own = self._char_counts(piece[begin:end])
            if piece[begin:end] in CONTRACTIONS:
                own[2] = own[1] + self._char_counts(piece[begin + 1])[1]
            before = count[begin]
            count += [before + n for n in own[1:]]
        for run in RUN.finditer(piece):
            begin, end = run.span()
            before = count[begin]
            count[begin : end + 1] = [before + n for n in self._char_counts(run[0])]
        return array("h", map(sub, count[1:], count)).tobytes()

    def _plain(self, text: str) -> np.ndarray:
        steps = np.frombuffer(b"".join(map(self.pieces.__getitem__, PIECE.findall(text))), "<i2")
        count = np.zeros(len(text) + 1, np.int32)
        np.cumsum(steps, dtype=np.int32, out=count[1:])
        for run in CROSSING.finditer(text):
            begin, end = run.span()
            if end - begin > 1:
                count[end] = count[begin] + self._char_counts(run[0])[-1]
        return count

    def counts(self, text: str) -> np.ndarray:
        """Tokens of each prefix of a whole text: entry i is for its first i characters."""
        first = self.special.search(text)
        if not first:
            return self._plain(text)
        out = np.zeros(len(text) + 1, np.int32)
        start = before = 0
        for special in self.special.finditer(text):
            begin, end = special.span()
            out[start:end] = before + self._plain(text[start : end - 1])
            before = out[begin] + 1
            start = end
        out[start:] = before + self._plain(text[start:])
        return out


def longest_within(counts: np.ndarray, budget: int) -> int:
    """Characters of the longest prefix of at most `budget` tokens, -1 if there is none."""
    fits = np.flatnonzero(counts <= budget)
    return int(fits[-1]) if len(fits) else -1


def _unpacked(stored: bytes) -> np.ndarray:
    steps = np.frombuffer(stored, "<i2")
    return np.concatenate([[0], np.cumsum(steps, dtype=np.int64)])


def prefix_counts(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tokenizer_file: str | None = None
) -> DataFrame:
    """doc_id, n_tokens and `steps`, the differences between the counts of successive prefixes.
    Write it as a table; `tokens_before` and `cut_to` answer from its `steps`."""

    @F.arrow_udf("struct<n_tokens: long, steps: binary>")
    def count(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counter = PrefixCounter.of(tokenizer_file)
        for batch in texts:
            found = [counter.counts(t or "") for t in batch.to_pylist()]
            total = pa.array([int(c[-1]) for c in found], pa.int64())
            steps = pa.array([np.diff(c).astype("<i2").tobytes() for c in found], pa.binary())
            yield pa.StructArray.from_arrays([total, steps], ["n_tokens", "steps"])

    return docs.select(F.col(id_col).alias("doc_id"), count(F.col(text_col)).alias("c")).select(
        "doc_id", "c.n_tokens", "c.steps"
    )


def tokens_before(steps: Column, chars: Column) -> Column:
    """Tokens of the first `chars` characters; of the whole text if it has fewer. Null is null."""

    @F.arrow_udf("long")
    def look(stored: pa.Array, places: pa.Array) -> pa.Array:
        out = []
        for s, n in zip(stored.to_pylist(), places.to_pylist(), strict=True):
            known = s is not None and n is not None
            out.append(int(np.frombuffer(s, "<i2")[: max(n, 0)].sum(dtype=np.int64)) if known else None)
        return pa.array(out, pa.int64())

    return look(steps, chars.cast("long"))


def cut_to(steps: Column, budget: Column) -> Column:
    """Struct of chars and tokens of the longest prefix of at most `budget` tokens. Null is
    null, and so is a budget below zero."""

    @F.arrow_udf("struct<chars: long, tokens: long>")
    def cut(stored: pa.Array, budgets: pa.Array) -> pa.Array:
        out = []
        for s, n in zip(stored.to_pylist(), budgets.to_pylist(), strict=True):
            if s is None or n is None or n < 0:
                out.append(None)
                continue
            counts = _unpacked(s)
            chars = longest_within(counts, n)
            out.append({"chars": chars, "tokens": int(counts[chars])})
        return pa.array(out, pa.struct([("chars", pa.int64()), ("tokens", pa.int64())]))

    return cut(steps, budget.cast("long"))


def count_tokens(
    docs: DataFrame, *, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text",
    tokenizer_file: str | None = None,
) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit and `cut_chars`, the characters of the longest
    prefix within the limit, of every row; counts of prefixes stay in the task."""

    @F.arrow_udf("struct<n_tokens: long, cut_chars: long>")
    def count(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counter = PrefixCounter.of(tokenizer_file)
        for batch in texts:
            total, cut = [], []
            for text in batch.to_pylist():
                counts = counter.counts(text or "")
                total.append(int(counts[-1]))
                cut.append(longest_within(counts, limit))
            yield pa.StructArray.from_arrays(
                [pa.array(total, pa.int64()), pa.array(cut, pa.int64())], ["n_tokens", "cut_chars"]
            )

    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"),
        count(F.col(text_col)).alias("c"),
    ).select(
        "doc_id", "n_bytes", "c.n_tokens", (F.col("c.n_tokens") > limit).alias("over_limit"), "c.cut_chars"
    )
