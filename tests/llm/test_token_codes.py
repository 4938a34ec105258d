import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from scriptloom.llm.common import new_folder
from scriptloom.llm.token_codes import Encoder, Shard, open_shard, shard_bytes, token_codes, write_token_codes


def plain():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_pieces_give_the_tokenizers_own_ids():
    rng = random.Random(1)
    alphabet = "ab é.,\n\t '’sStreé12²Ⅷ_-!?<>|  日ё\x1c\r"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(3000)]
    texts += ["", "<|endoftext|> a <|endoftext|>.", "x" * 5000, " " * 300, "it's we'll 'tis ca n't"]
    want = [e.ids for e in plain().encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in Encoder(None).encode(texts)] == want


def test_any_token_is_read_directly():
    rng = np.random.default_rng(2)
    docs = [rng.integers(0, 2 ** rng.integers(1, 33), n, dtype=np.uint32) for n in (0, 1, 5000, 63, 64, 513)]
    shard = Shard(shard_bytes([None, "1", "", "x\ny", "é", "5"], docs))
    assert [shard.name(i) for i in range(6)] == [None, "1", "", "x\ny", "é", "5"]
    assert all((shard.document(i) == d).all() for i, d in enumerate(docs))
    assert all((a == b).all() for a, b in zip(shard.documents(), docs, strict=True))
    flat = np.concatenate(docs)
    places = rng.integers(0, len(flat), 2000)
    assert (shard.tokens(places) == flat[places]).all()
    assert Shard(shard_bytes([], [])).n_tokens == 0


def test_table_against_plain_encoding(frame, edge_rows):
    tokenizer, at = plain(), 0
    want = []
    order = sorted(edge_rows, key=lambda r: -1 if r[0] is None else r[0])
    for d, t, *_ in order:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        want.append((d, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    got = sorted(token_codes(frame(edge_rows), shard_tokens=500).collect(), key=lambda r: r.start)
    assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in got), key=str) == sorted(want, key=str)
    assert [r.doc_id for r in got] == [d for d, *_ in order]
    for r in got:
        assert r.start == at
        at += r.n_tokens


def test_files_hold_the_stream_in_order(spark, frame):
    docs = frame([(i, f"word {i} " * i, "en", "s") for i in range(40)])
    manifest = write_token_codes(docs, new_folder(spark, "codes"), shard_tokens=300).orderBy("nth").collect()
    assert len(manifest) > 3
    names = [open_shard(m.file).name(i) for m in manifest for i in range(m.n_docs)]
    assert names == [str(i) for i in range(40)]
    assert token_codes(frame([])).count() == 0


def test_long_pieces_are_not_kept():
    """Text without blanks is one piece a text; 2,000 such texts leave nothing in the cache."""
    rng = random.Random(7)
    signs = [chr(0x4E00 + i) for i in range(3000)]
    texts = ["".join(rng.choice(signs) for _ in range(200)) for _ in range(2000)]
    encoder = Encoder(None)
    want = [e.ids for e in plain().encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in encoder.encode(texts)] == want
    assert not encoder.known
    encoder.encode(["common words"])
    assert encoder.known
