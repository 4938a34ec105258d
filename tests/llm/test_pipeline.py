import random
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from scriptloom.llm.fair_mix import fair_mix
from test_simhash import fingerprint, roots

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SYLLABLES = {"en": "the ing er th on tion", "de": "ein sch ung keit er ü", "fr": "eau ment tion é ai oi"}


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Rows after each stage, written and read back as the pipeline does."""
    rng = random.Random(12)

    def text(lang, n):
        word = lambda: "".join(rng.choice(SYLLABLES[lang].split()) for _ in range(rng.randrange(1, 4)))
        return " ".join(word() for _ in range(n))

    rows = [(1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, "12 34", "en", "b", 5), (4, " - ", None, None, 3)]
    for i in range(80):
        lang = rng.choice(list(SYLLABLES))
        t = text(lang, rng.randrange(30, 200))
        rows.append((100 + i, t, lang, rng.choice("aaabcd"), len(t)))
        if i % 8 == 0:
            rows.append((1000 + i, t, lang, "c", len(t)))
            words = t.split()
            words[len(words) // 2 : len(words) // 2 + 1] = ["edited"]
            if i % 16 == 0:
                words = t.split() + [words[0]]
            rows.append((2000 + i, " ".join(words), lang, None, len(t)))
    rows.append((5000, text("en", 5000), "en", "d", 1))
    folder = tmp_path_factory.mktemp("pipeline")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), {"documents": rows}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(folder)).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        out[name] = [tuple(r) for r in docs.collect()]
        if name != "best_fit_packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    out["whole run"] = corpus_pipeline.run(spark, str(folder)).count()
    return out


def test_language(stages):
    want = [r for r in stages["documents"] if any(c.isalpha() for c in r[1] or "")]
    assert sorted(stages["language_id"]) == sorted(want, key=lambda r: r[0])


def test_exact_copies(stages):
    last = {}
    for r in stages["language_id"]:
        last[r[1]] = max(last.get(r[1], r), r, key=lambda x: x[0])
    assert sorted(stages["exact_dedup"], key=str) == sorted(last.values(), key=str)


def test_near_copies(stages):
    rows = sorted(stages["exact_dedup"], key=lambda r: r[0])
    prints = [fingerprint(r[1], corpus_pipeline.WIDTH) for r in rows]
    near = [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2]
    assert near
    want = [r for i, (r, g) in enumerate(zip(rows, roots(len(rows), near), strict=True)) if g == i]
    assert sorted(stages["simhash_near_dedup"], key=str) == sorted(want, key=str)


def test_mix(spark, stages):
    docs = spark.createDataFrame(stages["simhash_near_dedup"], SCHEMA)
    want = Counter({r.doc_id: r.taken // r["size"] for r in fair_mix(docs).collect() if r.taken})
    assert Counter(r[0] for r in stages["fair_mix"]) == want


def test_packing(stages):
    words = {r[0]: len(r[1].split()) + 1 for r in stages["fair_mix"]}
    source = {r[0]: r[3] for r in stages["fair_mix"]}
    times = Counter(r[0] for r in stages["fair_mix"])
    bins, held = defaultdict(list), Counter()
    for doc, _, _, length, bin_id, start in stages["best_fit_packing"]:
        bins[bin_id].append((start, start + length, doc))
        held[doc] += length
    assert held == {d: n * times[d] for d, n in words.items()}
    for pieces in bins.values():
        pieces.sort()
        assert pieces[-1][1] <= corpus_pipeline.CAPACITY
        assert all(a[1] <= b[0] for a, b in zip(pieces, pieces[1:], strict=False))
        assert len({p[2] for p in pieces}) == len(pieces)
        own = [source[p[2]] for p in pieces if source[p[2]] is not None]
        assert len(own) == len(set(own))
    assert stages["whole run"] == len(stages["best_fit_packing"])


def through(spark, folder, df):
    """Rows after each stage of the pipeline over `df`."""
    df.write.parquet(f"{folder}/documents.parquet")
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(folder)).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if name != "best_fit_packing":
            assert docs.columns == df.columns
        out.append(docs.collect())
    return out


def test_empty_table(spark, tmp_path):
    assert through(spark, tmp_path, spark.createDataFrame([], SCHEMA)) == [[]] * 5


def test_no_label_loses_nothing(spark, tmp_path):
    texts = ["plain words in a row", "ein paar Worte", "1 2 3", "", None, "\u6f22\u5b57"]
    rows = [(i, t, None, "s", 0) for i, t in enumerate(texts)]
    out = through(spark, tmp_path, spark.createDataFrame(rows, SCHEMA))
    assert sorted(r.doc_id for r in out[0]) == [0, 1, 5]
    assert sorted(r.doc_id for r in out[2]) == [0, 1, 5]


def test_text_like_no_labelled_document_goes(spark, tmp_path):
    words = "the other thing is that all these words are there and then they go on".split()
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice(words) for _ in range(60)), "en", "s", 0) for i in range(40)]
    rows += [(100, " ".join(rng.choice(words) for _ in range(60)), None, "s", 0)]
    rows += [(101, "zqxj " * 50, None, "s", 0)]
    out = through(spark, tmp_path, spark.createDataFrame(rows, SCHEMA))
    assert sorted(r.doc_id for r in out[0]) == [*range(40), 100]


def test_null_ids_and_clashing_names(spark, tmp_path):
    """Columns named like the locators and helpers; null and repeated ids; null sources."""
    extra = "_file string, _row long, doc string, found string, size long, times int, component long, " \
        "carried string, stays string, nth int, least double, _metadata string"
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("aeioubcdfg") for _ in range(5))
    texts = [" ".join(word() for _ in range(80)) for _ in range(6)]
    more = ("f", 1, "d", "x", 2, 3, 4, "c", "s", 5, 0.5, "m")
    rows = [(None, t, "en", None, 0, *more) for t in texts * 2] + [(7, t + " " + word(), "en", "s", 0, *more) for t in texts]
    rows += [(None, None, None, None, None) + (None,) * 12]
    out = through(spark, tmp_path, spark.createDataFrame(rows, SCHEMA + ", " + extra))
    assert [len(x) for x in out[:2]] == [18, 12]
    prints = {fingerprint(r.text) for r in out[1]}
    near = [(a, b) for a in prints for b in prints if a < b and (a ^ b).bit_count() <= 2]
    assert len(out[2]) == len(prints) - len(near)
    assert {r.text for r in out[3]} == {r.text for r in out[2]} and len(out[4]) >= len(out[2])


def test_third_of_ids_null_is_dealt_to_all_groups(spark):
    from pyspark.sql import functions as F

    from scriptloom.llm.best_fit import best_fit_packing

    docs = spark.range(900).select(
        F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"), F.lit(10).alias("length"),
        F.lit(None).cast("string").alias("source"), F.lit(None).cast("string").alias("cluster"),
    )
    out = best_fit_packing(docs, capacity=100, rows_per_group=100).collect()
    groups = Counter(r.bin_id.split("-")[1] for r in out if r.doc_id is None)
    assert sum(groups.values()) == 300 and len(groups) == 9 and max(groups.values()) < 60
