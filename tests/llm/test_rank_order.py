import random
import zlib

import pytest

from scriptloom.llm.common import documents
from scriptloom.llm.rank_order import Profiles, grams, identify_language, learn, ranked

TEXTS = {
    "en": "the quick brown fox jumps over the lazy dog and then the dog sleeps in the sun",
    "de": "der schnelle braune Fuchs springt über den faulen Hund und dann schläft der Hund",
    "fr": "le renard brun rapide saute par dessus le chien paresseux et puis le chien dort",
}


def test_small_table(frame, edge_rows):
    rows = [(i, TEXTS[k], k, "s") for i, k in enumerate(list(TEXTS) * 10, start=1000)]
    out = identify_language(frame(rows)).collect()
    want = {d: lang for d, _, lang, _ in rows}
    assert all(r.lang_pred == want[r.doc_id] and 0 < r.score <= 1 for r in out)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    out = identify_language(frame(rows + edge_rows)).collect()
    assert len(out) == len(rows) + len(edge_rows)
    by_id = {r.doc_id: r for r in out if r.doc_id is not None}
    assert all((by_id[d].lang_pred, by_id[d].score) == ("und", 0.0) for d in (1, 2, 3, 9))
    assert all(0 <= r.score <= 1 for r in out)


def test_nothing_learned_and_empty(frame):
    row = identify_language(frame([(1, "some text", None, None)])).first()
    assert (row.lang_pred, row.score) == ("und", 0.0)
    assert identify_language(frame([])).count() == 0


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.01"])
def test_held_out_accuracy(spark, folder):
    docs = documents(spark, folder)
    out = identify_language(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    known = [r for r in out if r.lang_pred != "und"]
    assert len(known) > 150
    assert sum(r.lang == r.lang_pred for r in known) >= 0.98 * len(known)


def out_of_place(text, profiles, size):
    """Distance to each profile by a plain loop."""
    own = ranked(*grams(text), size).view("int64").tolist()
    return {
        name: sum(abs(i - known.index(g)) if g in known else size for i, g in enumerate(own))
        for name, known in profiles.items()
    }, len(own)


def test_nearest_against_a_plain_loop():
    rng = random.Random(2)
    text = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    for size in (5, 40):
        profiles = {
            name: ranked(*grams(text(letters, 300)), size).view("int64").tolist()
            for name, letters in {"a": "abcd ef", "b": "defg h\u00e9", "c": "xyz \u6f22a", "twin": "abcd ef"}.items()
        }
        profiles["same"] = profiles["twin"]
        found = Profiles(profiles, size)
        for letters in ("abcd ef", "defgh \u00e9", "xyza \u6f22", "qrst ", "ab"):
            for n in (1, 3, 30, 200):
                t = text(letters, n) + "a"
                away, n_own = out_of_place(t, profiles, size)
                best = min(sorted(away), key=away.get)
                assert found.nearest(t) == (best, 1 - away[best] / (n_own * size))


def test_more_languages_than_the_bound_raise(frame):
    rows = [(i, TEXTS["en"], f"l{i}", "s") for i in range(1500)]
    assert len(learn(frame(rows), size=20).names) == 1500
    with pytest.raises(ValueError, match="max_langs"):
        learn(frame(rows), max_langs=1000)
