from scriptloom.llm.host_rules import MEASURES, judge_hosts, measure_text, repeated_words

import random
import re


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    twice = {w for w in windows if windows.count(w) > 1}
    covered = {j for i, w in enumerate(windows) if w in twice for j in range(i, i + 8)}
    lines, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in lines
            lines.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def test_measures_against_brute_force():
    rng = random.Random(2)
    for _ in range(300):
        text = "".join(rng.choice("ab \n\té#$<\x0b") for _ in range(rng.randrange(120)))
        assert measure_text(text.encode()) == brute(text)
    words = [b"x"] * 50
    assert repeated_words(words) == 50
    assert repeated_words(words[:8]) == 0


def test_table(frame, edge_rows):
    rows = [r for r in edge_rows if len(r[1] or "") < 5000]
    bad = [(500 + i, "# $ % & word", "en", "bad") for i in range(40)] + [(600, " ".join(map(str, range(40))), "en", "bad")]
    out = judge_hosts(frame(rows + bad)).collect()
    want = sorted(((d, *brute(t)) for d, t, *_ in rows + bad), key=str)
    assert sorted(((r.doc_id, *[r[m] for m in MEASURES]) for r in out), key=str) == want
    for r in out:
        failed = r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words
        assert r.base_failed == failed and not (failed and r.kept)
    by_id = {r.doc_id: r for r in out}
    assert not by_id[600].base_failed and not by_id[600].kept and by_id[600].host_rate > 0.5
    good = [r for r in out if not r.base_failed and r.doc_id is not None and 100 <= r.doc_id < 200]
    assert good and all(r.kept for r in good)


def test_prior_pulls_small_hosts(frame):
    rng = random.Random(9)
    text = lambda n: " ".join(str(rng.random()) for _ in range(n))
    rows = [(i, text(30), "en", f"h{i % 10}") for i in range(200)]
    rows += [(300, text(3), "en", "tiny"), (301, text(30), "en", "tiny")]
    out = {r.doc_id: r for r in judge_hosts(frame(rows)).collect()}
    assert 0 < out[301].host_rate < 0.5 and out[301].kept and not out[300].kept
    assert judge_hosts(frame([])).count() == 0
