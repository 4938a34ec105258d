import hashlib
import random
import re
import time

import numpy as np
import pytest

from scriptloom.llm.secret_scan import WINDOW, CharConv, digest, findings, fit, scan_secrets, scan_text

RULES = [
    ("assign", r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6),
    ("access", r"(AKIA[A-Z0-9]+)", 20),
    ("hex", r"([0-9a-f]+)", 24),
]


def brute(text):
    spans = []
    for nth, (_, rule, least) in enumerate(RULES):
        for m in re.finditer(rule, text or ""):
            if len(m[1]) >= least:
                spans.append((m.start(), nth, m.end()))
    return [f"{RULES[k][0]}:{a}:{b}" for a, k, b in sorted(spans)]


def key(rng, n=40):
    return "".join(rng.choice("0123456789abcdef") for _ in range(n))


def test_rules_against_brute_force(frame, edge_rows):
    rng = random.Random(3)
    texts = [
        f'é token = "{key(rng)}" ok', f"PassWord:{key(rng, 18)} x", "secret='abc'", "api_key=abcdef api-key=abcdef",
        f"AKIA{key(rng, 10).upper()}ABCDEFGHIJ AKIASHORT", key(rng, 23), key(rng, 24) + "g" + key(rng, 30),
        "token=token=abcdefgh password: password", f"{key(rng)}\n" * 3, "tokenſecret=abcdefg toKen = a.b-c_d/e+f=",
    ]
    rows = edge_rows + [(1000 + i, t, "en", "s") for i, t in enumerate(texts)]
    got = {(r.doc_id, r.base_sha256) for r in digest(scan_secrets(frame(rows))).collect()}
    want = {(d, hashlib.sha256(",".join(brute(t)).encode()).hexdigest()) for d, t, *_ in rows}
    assert got == want


def test_network_adds_like_values_and_keeps_base(frame):
    rng = random.Random(4)
    words = lambda n: " ".join(rng.choice(["some", "words", "hereandthereagain123", "user.name42@mail.example.com"]) for _ in range(n))
    rows = [(i, f"{words(5)} token = {key(rng)} {words(5)}", "en", "s") for i in range(300)]
    net = fit(findings(frame(rows)))
    # keys that no rule knows
    rows += [(1000 + i, f"{words(8)} {key(rng, 20)}z{key(rng, 19)} {words(8)}", "en", "s") for i in range(40)]
    out = digest(scan_secrets(frame(rows), net=net)).collect()
    added = {r.doc_id: [x for x in r.spans.split(",") if x.startswith("net")] for r in out}
    base = {r.doc_id: [x for x in r.spans.split(",") if x and not x.startswith("net")] for r in out}
    assert all(base[d] == brute(t) for d, t, *_ in rows)
    hits = sum(bool(added[1000 + i]) for i in range(40))
    assert hits >= 32 and sum(map(len, added.values())) - hits <= 5


def test_a_text_full_of_tokens_takes_time_by_length():
    rng = random.Random(12)
    line = lambda: f"token={key(rng, 30)} {key(rng, 17)}x {key(rng, 26)}\n"
    text = "".join(line() for _ in range(40_000)).encode()
    begin = time.process_time()
    spans, values = scan_text(text)
    assert len(text) > 3_000_000 and len(spans) >= 80_000 and len(values) >= 120_000
    assert time.process_time() - begin < 60
    some = text[:3000]
    matches = [(m["start"], m["end"]) for m in scan_text(some)[0]]
    found = [(v["start"], v["end"]) for v in scan_text(some)[1] if not v["label"]]
    runs = [(m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9+/_.=-]{16,}", some.decode())]
    assert found == [(a, b) for a, b in runs if not any(a < y and x < b for x, y in matches)] and found


def test_repeated_windows_do_not_empty_the_sample(frame):
    """A few windows, each thousands of times: all of them are in the sample, whatever their hash."""
    rng = random.Random(13)
    texts = [f"some words token = {key(rng)} then" for _ in range(6)] + [f"some wordsandwords{i}again here" for i in range(6)]
    rows = [(i, texts[i % 12], "en", "s") for i in range(6000)]
    net = fit(findings(frame(rows)), sample=50)
    again = fit(findings(frame(rows[::-1])).repartition(7), sample=50)
    assert net is not None and net.threshold == again.threshold
    assert all((net.p[k] == again.p[k]).all() for k in net.p)


def test_without_labels_nothing_is_added(frame):
    with pytest.warns(UserWarning, match="no spans are added"):
        assert fit(findings(frame([(1, "token=abcdef", None, None)]))) is None
    assert digest(scan_secrets(frame([]))).count() == 0
    row = digest(scan_secrets(frame([(1, "token=abcdef", None, None)]))).first()
    assert (row.n_assign, row.n_access, row.n_hex, row.spans) == (1, 0, 0, "assign:0:12")
    assert CharConv().threshold > 1


def test_all_of_a_long_value_is_seen():
    rng = random.Random(8)
    head = "/hooks.example.com/services/" + "some-benign-path/" * 5
    for lead in range(40):
        for n in (16, 24):
            k = "".join(rng.choice("ABCDEFGHJKLMNPQRSTUVWXYZ23456789") for _ in range(n))
            text = f"see {head[:lead + 60]}{k}/end of it"
            values = scan_text(text.encode())[1]
            assert len(values) == 1 and len(values[0]["window"]) % WINDOW == 0
            seen = values[0]["window"]
            assert any(k.encode() in seen[at : at + WINDOW] for at in range(0, len(seen), WINDOW))
    net = CharConv()
    one, two = (bytes([c]) * WINDOW for c in b"ab")
    assert net.logits([one + two, one, two]).tolist() == [net.logits([one, two]).max(), *net.logits([one, two])]


def test_key_behind_a_benign_head_scores_like_the_key(frame):
    rng = random.Random(9)
    words = lambda n: " ".join(rng.choice(["some", "words", "hereandthereagain123", "user.name42@mail.example.com"]) for _ in range(n))
    path = "hereandthereagain/user.name/" * 3
    rows = [(i, f"{words(5)} token = {key(rng)} {words(5)} {path} {words(2)}", "en", "s") for i in range(300)]
    net = fit(findings(frame(rows)))
    rows = [(i, f"{words(4)} {path}{key(rng, 20)}z{key(rng, 19)} {words(4)}", "en", "s") for i in range(40)]
    benign, hidden = [scan_text(f"a {path} b".encode())[1], [scan_text(r[1].encode())[1] for r in rows]]
    score = lambda values: net.probability([max((v["window"] for v in values), key=len)])[0]
    assert sum(score(h) > score(benign) for h in hidden) >= 36


def test_threshold_keeps_the_recall_of_labels_that_overlap():
    rng = np.random.default_rng(10)
    labels = (np.arange(2000) % 10 == 0).astype(float)
    windows = [bytes(rng.integers(97, 110 + 4 * int(y), WINDOW).astype(np.uint8)) for y in labels]
    for recall in (0.9, 0.98, 1.0):
        net = CharConv()
        net.calibrate(windows, labels, recall)
        reached = (net.probability(windows) >= net.threshold)[labels == 1].mean()
        assert recall <= reached < recall + 0.01


def test_all_labelled_windows_train_and_judge_the_network(frame, monkeypatch):
    """More distinct windows than the 4,000 that training once stopped at, and one that occurs often."""
    monkeypatch.setattr("scriptloom.llm.secret_scan.ROUNDS", 1)
    rng = random.Random(14)
    one = f"some words token = {key(rng)} and so on hereandthereagain123 and so on"
    rows = [(i, "\n".join(f"{i} {n} token = {key(rng, 20)} {i * 45 + n:016}-abc" for n in range(45)), "en", "s") for i in range(100)]
    found = findings(frame(rows + [(1000 + i, one, "en", "s") for i in range(60)]))
    labels = [v["label"] for _, text, *_ in rows for v in scan_text(text.encode())[1]]
    labels += 60 * [v["label"] for v in scan_text(one.encode())[1]]
    net = fit(found)
    assert [a + b for a, b in zip(net.trained, net.judged)] == [labels.count(0), labels.count(1)]
    assert min(net.trained) > 3200 and min(net.judged) > 800
    assert sum(fit(found, sample=100).trained) < 400
