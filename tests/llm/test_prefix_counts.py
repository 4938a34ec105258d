import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from scriptloom.llm.common import documents
from scriptloom.llm.prefix_counts import (
    Merges,
    PrefixCounter,
    count_tokens,
    cut_to,
    prefix_counts,
    tokens_before,
)

PLAIN = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
COUNTER = PrefixCounter(None)
ODD = "ab éS't're've'll'd'm.,\n\t ’123²Ⅷ_-!?<>|  日ё\x1c\r\x85\xa0 　​漢字🙂"


def by_library(text):
    every = PLAIN.encode_batch([text[:i] for i in range(len(text) + 1)], add_special_tokens=False)
    return [len(e.ids) for e in every]


def test_every_prefix_of_odd_texts():
    rng = random.Random(4)
    texts = ["".join(rng.choice(ODD) for _ in range(rng.randrange(50))) for _ in range(600)]
    texts += ["it's we'll they've 'tis 're", "a <|endoftext|> b<|endoftext|><|endoftext|>\n  x <|endof", "-" * 200]
    texts += [" " * 150 + "x" + "\n" * 30 + " y", "the quick  brown   fox\n\n  jumps", "'" * 20 + "ll", "x'", ""]
    texts += ["aaaaaaaaaaaaaaaaaaaaaa" * 4, "ab" * 60, "!!!'re !'ll"]
    for text in texts:
        assert COUNTER.counts(text).tolist() == by_library(text), repr(text)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=40))
def test_every_prefix_of_any_text(text):
    text = text.encode("utf-8", "replace").decode()
    assert COUNTER.counts(text).tolist() == by_library(text)


def test_white_space_is_the_library_s():
    """Each code point between letters, after and before a blank."""
    points = [chr(i) for i in [*range(1, 0x3100), *range(0xFE00, 0x10000), 0xE0020] if not 0xD800 <= i < 0xE000]
    texts = [f"a {c} b" for c in points]
    want = [len(e.ids) for e in PLAIN.encode_batch(texts, add_special_tokens=False)]
    short = [len(e.ids) for e in PLAIN.encode_batch([t[:4] for t in texts], add_special_tokens=False)]
    found = [COUNTER.counts(t) for t in texts]
    assert [int(c[-1]) for c in found] == want
    assert [int(c[4]) for c in found] == short


def test_following_tokens_by_definition():
    rng = random.Random(1)
    merges = COUNTER.merges
    tokens = [t for t in list(merges.made_of)[::7]] + list("abcdefgĠ")
    for _ in range(20_000):
        a, b = rng.choice(tokens), rng.choice(tokens)
        if merges.stands(a) and merges.stands(b):
            assert merges.follows(a, b) == (merges.encode(a + b) == [a, b])


def test_standing_tokens_by_definition():
    merges = COUNTER.merges
    for token in list(merges.made_of)[::11]:
        assert merges.stands(token) == (merges.encode(token) == [token])


def test_small_alphabet_by_definition():
    """Vocabularies of few letters, where merges over seams and equal ranks abound."""
    rng = random.Random(9)
    for _ in range(60):
        vocab, merges = ["a", "b"], []
        for _ in range(rng.randrange(1, 9)):
            pair = (rng.choice(vocab), rng.choice(vocab))
            if "".join(pair) not in vocab:
                merges.append(pair)
                vocab.append("".join(pair))
        m = Merges(merges)
        assert all(m.stands(t) == (m.encode(t) == [t]) for t in vocab), merges
        for a in vocab:
            for b in vocab:
                if m.stands(a) and m.stands(b):
                    assert m.follows(a, b) == (m.encode(a + b) == [a, b]), (merges, a, b)


def test_table(frame, edge_rows):
    rows = edge_rows + [(11, "<|endoftext|> it's 漢字" * 400, None, None)]
    got = sorted((tuple(r) for r in count_tokens(frame(rows)).collect()), key=str)
    want = []
    for d, t, *_ in rows:
        counts = by_library(t or "") if len(t or "") < 2000 else None
        n = counts[-1] if counts else len(PLAIN.encode(t or "", add_special_tokens=False).ids)
        cut = len(t or "") if n <= 1024 else COUNTER.counts(t).searchsorted(1025) - 1
        want.append((d, len((t or "").encode()), n, n > 1024, cut))
    assert [g[:4] for g in got] == [w[:4] for w in sorted(want, key=str)]
    for d, *_, over, cut in got:
        if over:
            text = next(t for i, t, *_ in rows if i == d)
            assert len(PLAIN.encode(text[:cut]).ids) <= 1024 < len(PLAIN.encode(text[: cut + 1]).ids)
    assert count_tokens(frame([])).count() == 0


def test_questions_are_answered_from_the_table(frame, edge_rows, tmp_path, spark):
    texts = {d: t for d, t, *_ in edge_rows if d is not None and len(t or "") < 3000}
    texts |= {500: "it's  we'll\n\n <|endoftext|> 漢字 and more words " * 5}
    docs = frame([(d, t, None, None) for d, t in texts.items()])
    prefix_counts(docs).write.parquet(f"{tmp_path}/counts")
    stored = spark.read.parquet(f"{tmp_path}/counts")
    for ask in (0, 1, 7, 60):
        for r in stored.select(
            "doc_id", "n_tokens", tokens_before(F.col("steps"), F.lit(ask)).alias("n"),
            cut_to(F.col("steps"), F.lit(ask)).alias("cut"),
        ).collect():
            text = texts[r.doc_id] or ""
            counts = by_library(text)
            assert r.n_tokens == counts[-1] and r.n == counts[min(ask, len(text))]
            fits = max(i for i, n in enumerate(counts) if n <= ask)
            assert (r.cut.chars, r.cut.tokens) == (fits, counts[fits])
    row = stored.select(cut_to(F.col("steps"), F.lit(-1)).alias("c"), tokens_before(F.lit(None).cast("binary"), F.lit(1)).alias("n")).first()
    assert row.c is None and row.n is None


def test_long_texts_take_time_by_length():
    signs = [chr(0x4E00 + i) for i in range(2000)]
    rng = random.Random(3)
    for text in ["".join(rng.choice(signs) for _ in range(60_000)), "x" * 100_000, " " * 100_000, "'" * 50_000]:
        assert COUNTER.counts(text)[-1] == len(PLAIN.encode(text, add_special_tokens=False).ids)
    assert np.all([len(p) <= 32 for p in COUNTER.pieces])


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.01"])
def test_documents(spark, folder):
    docs = documents(spark, folder)
    got = {r.doc_id: (r.n_tokens, r.over_limit) for r in count_tokens(docs).collect()}
    texts = [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]
    want = [len(e.ids) for e in PLAIN.encode_batch([t for _, t in texts], add_special_tokens=False)]
    assert got == {d: (n, n > 1024) for (d, _), n in zip(texts, want, strict=True)}
