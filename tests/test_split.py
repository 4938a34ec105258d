import random

import pytest
from pyspark.sql import functions as F

import scriptloom as sl
from scriptloom.functions import fixed_values as fixed

BLOCKS = "BEGIN a; b; END;\nBEGIN c; d; END;BEGIN e; f; END; tail"


def test_whitespace_class_is_complete():
    assert set(fixed.WHITESPACE) == {chr(i) for i in range(0x110000) if chr(i).isspace()}


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("A;\n/\n/\n\nB;\n", ["A;", "B;"]),
        ("/\nA\n /\t\nB\n/", ["A", "B"]),
        ("A / B\n//\nC", ["A / B\n//\nC"]),
        ("A\r\n/\r\nB\r/\rC", ["A", "B", "C"]),
        (" A \n / \nB", ["A", "B"]),
        ("", []),
        ("/\n/\n", []),
        ("A\n\n\n/\n  \n/\nB", ["A", "B"]),
    ],
)
def test_delimiter(scripts, codes, text, expected):
    assert codes(sl.split_delimiter(scripts(text))).get("0", []) == expected


def test_delimiter_other_mark(scripts, codes):
    assert codes(sl.split_delimiter(scripts("A\nGO.\nB\nGOx\nC"), "GO."))["0"] == ["A", "B\nGOx\nC"]


def test_lines(scripts, codes):
    got = codes(sl.split_lines(scripts("", "a\n b \r\n\nc\n", "x"), 2))
    assert got == {"0": [""], "1": ["a\n b \r", "\nc", ""], "2": ["x"]}


def test_pattern_literal_drop(scripts, codes):
    got = codes(sl.split_pattern(scripts(BLOCKS), "literal", "drop"))["0"]
    assert got == ["BEGIN a; b; END;", "BEGIN c;", "d;", "END;", "BEGIN e; f; END;"]


def test_pattern_skip_keep(scripts):
    rows = sl.split_pattern(scripts(BLOCKS)).orderBy("chunk_no").collect()
    assert [(r.code, r.is_terminated) for r in rows] == [
        ("BEGIN a; b; END;", True),
        ("BEGIN c; d; END;", True),
        ("BEGIN e; f; END;", True),
        ("tail", False),
    ]


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        # only END directly before the semicolon closes; inner END IF; does not
        ("BEGIN IF x THEN y; END IF; z; END ;w;", ["BEGIN IF x THEN y; END IF; z; END ;", "w;"]),
        # no word boundary in front of END
        ("BEGIN a; WEEKEND; b; END;", ["BEGIN a; WEEKEND;", "b;", "END;"]),
        # nested block closes at the first inner END;
        ("BEGIN BEGIN a; END; b; END;", ["BEGIN BEGIN a; END;", "b;", "END;"]),
        (";;a;;b;", ["a;", "b;"]),
        ("x; END;\n/\n", ["x;", "END;"]),
        (
            "create or\n replace function f is begin null; end;\ndeclare x int; begin y; end;",
            [
                "create or\n replace function f is begin null; end;",
                "declare x int; begin y; end;",
            ],
        ),
        ("create table t (a int); drop table t;", ["create table t (a int);", "drop table t;"]),
    ],
)
def test_pattern_quirks(scripts, codes, text, expected):
    assert codes(sl.split_pattern(scripts(text)))["0"] == expected


def test_unclosed_blocks_stay_fast(scripts, codes):
    """Without END; a block word must not search the rest of the script each time."""
    text = "BEGIN a; END;\n" + "BEGIN x; END p;\n" * 30000 + "/* open " * 30000
    df = scripts(text)
    got = codes(sl.split_pattern(df))["0"]
    assert got[:4] == ["BEGIN a; END;", "BEGIN x;", "END p;", "BEGIN x;"]
    assert len(got) == 60002
    assert sl.strip_comments(df).first().source == text


def test_statements(scripts, codes):
    got = codes(sl.split_statements(scripts("a;;\n b ; c", " begin x; y; end;", ";", "  ")))
    assert got == {"0": ["a;", "b ;", "c"], "1": ["begin x; y; end;"]}


def test_before_begin(scripts, codes):
    got = codes(sl.split_before_begin(scripts("x beginning; Begin y", "begin a begin b"), 15))
    assert got == {"0": ["x", "beginning;", "Begin y"], "1": ["begin a begin b"]}


def test_by_size(scripts, codes):
    text = ";".join(["aaaa", " ", "bbbb", "cc", "", "dd\n", "e"])
    got = codes(sl.rechunk_by_size(scripts(text, "short;"), 9))
    # 5, then 10 > 9 closes; 3 + 4 + 2 = 9 does not; the tail gets a semicolon
    assert got == {"0": ["aaaa;\nbbbb;", "cc;\ndd\n;\ne;"], "1": ["short;"]}


def fragments(spark, lengths):
    rows = [("0", [chr(97 + i % 26) * n for i, n in enumerate(lengths)])]
    return spark.createDataFrame(rows, "script_id string, fragments array<string>")


@pytest.mark.parametrize(
    ("lengths", "expected"),
    [
        ([100, 150, 60, 10, 200, 5], [312, 10, 200, 5]),
        ([179, 121, 1], [179 + 121 + 1 + 2]),
        ([180, 180], [180, 180]),
        ([170, 131, 5], [302, 5]),
        ([5, 500], [5, 500]),
        ([], []),
        ([0, 3, 0], [3]),
    ],
)
def test_batching(spark, codes, lengths, expected):
    got = codes(sl.batch_small(fragments(spark, lengths)))
    assert [len(c) for c in got.get("0", [])] == expected


def test_scan_crosses_runs(spark, codes):
    """More fragments than one run of the scan holds."""
    lengths = [(i * 37) % 200 + 1 for i in range(5000)]
    got = [len(c) for c in codes(sl.batch_small(fragments(spark, lengths)))["0"]]
    want, open_ = [], []
    for n in [*lengths, None]:
        if n is None or n >= 180 or sum(open_) > 300:
            if open_:
                want.append(sum(open_) + len(open_) - 1)
            open_ = []
        if n is not None and n >= 180:
            want.append(n)
        elif n is not None:
            open_.append(n)
    assert got == want


def test_depth(spark, scripts):
    words = {1: "begin", 0: "x", -1: "end"}
    deltas = [1, 0, -1, -1, -1, 1, 1, -1, 0, -1, -1, 1]
    text = "\n".join(words[d] for d in deltas)
    rows = sl.line_depth(scripts(text)).orderBy("line_no").collect()
    assert [r.depth for r in rows] == [1, 1, 0, 0, 0, 1, 2, 1, 1, 0, 0, 1]
    assert [r.line_no for r in rows] == list(range(1, 13))


def test_depth_of_mixed_line(scripts):
    rows = sl.line_depth(scripts("begin end\nEND IF; BEGIN\nbegin begin\nend")).collect()
    assert [r.depth for r in sorted(rows, key=lambda r: r.line_no)] == [0, 0, 1, 0]


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("BEGIN\n/\nEND;\n/\nA;\n / \nrest  \n", ["BEGIN\n/\nEND;\n/", "A;\n /", "rest"]),
        ("A\n/\n\n\n", ["A\n/", ""]),
        ("A\n/\n", ["A\n/"]),
        ("", []),
        ("a\x0b/\x85b\u2028/", ["a\n/", "b\n/"]),
        ("END;\n/\nBEGIN x\n/", ["END;\n/", "BEGIN x\n/"]),
    ],
)
def test_top_level(scripts, codes, text, expected):
    assert codes(sl.split_top_level(scripts(text))).get("0", []) == expected


def test_safe(scripts):
    text = "a;\nb;\nc;\nbegin\nd;\ne;\nend;\nf\ng;\nh;"
    rows = sl.split_safe(scripts(text, "a;\nb;"), 2).orderBy("script_id", "chunk_no").collect()
    assert [(r.script_id, r.code, r.oversized) for r in rows] == [
        ("0", "a;\nb;", False),
        ("0", "c;\nbegin\nd;\ne;\nend;", True),
        ("0", "f\ng;", False),
        ("0", "h;", False),
        ("1", "a;\nb;", False),
    ]


def test_cascade_strategies(scripts):
    long_stmt = "select " + "x, " * 500 + "y;"
    block = "begin\n" + "\n".join(f"  update t set a = {i} where b = {i};" for i in range(60)) + "\nend;"
    df = sl.chunk_scripts(
        scripts(
            "A;\n/\nB;",
            "a;\n-- note\nb;\nc;",
            "no marks\r\nat all",
            f"a;\n{long_stmt}\nb;",
            f"{block}\nx;",
            "begin\n-- only\nend;",
        )
    )
    got = {}
    for r in df.orderBy("script_id", "chunk_no").collect():
        got.setdefault(r.script_id, []).append((r.strategy, r.code))
    assert got["0"] == [("delimiter", "A;"), ("delimiter", "B;")]
    assert got["1"] == [("pattern", "a;\n-- note\nb;\nc;")]
    assert got["2"] == [("lines", "no marks\r\nat all")]
    assert got["3"] == [("pattern", "a;"), ("pattern", long_stmt), ("pattern", "b;")]
    assert got["5"] == [("lines", "begin\n-- only\nend;")]
    sizes = [len(c) for _, c in got["4"]]
    assert len(sizes) == 3 and sizes[0] > 1200 and {s for s, _ in got["4"]} == {"pattern"}


def test_structured(scripts):
    text = (
        "/* head\n/\n*/create or replace package  body p is -- begin\nbegin null;\nend;\n/\n"
        "begin\nx;\nend;\n/\nselect 1;"
    )
    rows = sl.structured_chunks(scripts(text)).orderBy("chunk_no").collect()
    assert [(r.chunk_id, r.block_type, r.line_count) for r in rows] == [
        ("blk_001", "PACKAGE_BODY", 4),
        ("blk_002", "ANONYMOUS_BLOCK", 4),
        ("blk_003", "UNKNOWN", 1),
    ]


def test_splitters_do_not_shuffle(scripts):
    df = scripts("a;\n/\nb;")
    for chunks in [
        sl.chunk_scripts(df),
        sl.structured_chunks(df),
        sl.with_chunk_id(sl.split_lines(df), dense=True),
        sl.line_depth(df),
    ]:
        plan = chunks._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan
        assert "Window" not in plan


def test_partitioning_does_not_matter(spark, scripts):
    texts = [f"begin\n{'a;' * (i % 7)}\nend;\n" * (i % 5 + 1) + "/\n" * (i % 3) for i in range(60)]
    df = scripts(*texts)
    for op in (sl.chunk_scripts, sl.structured_chunks, sl.line_depth):
        one = sorted(map(str, op(df.repartition(1)).collect()))
        many = sorted(map(str, op(df.repartition(16)).collect()))
        assert one == many


def test_random_texts(spark, scripts, codes):
    """Nothing but delimiters and outer white space is lost, and order is kept."""
    rng = random.Random(7)
    words = ["a", "b;", "\n", " ", "/", "\n/\n", "BEGIN", "END;", "--x", "x" * 90, "\n\n", ";"]
    texts = ["".join(rng.choices(words, k=rng.randint(0, 60))) for _ in range(200)]
    df = scripts(*texts)

    def squeezed(text):
        return "".join(text.split())

    delimited, counted = codes(sl.split_delimiter(df)), codes(sl.split_lines(df, 3))
    pattern, top = codes(sl.split_pattern(df)), codes(sl.split_top_level(df))
    lined = df.withColumn("fragments", F.split("source", "\n"))
    batched = codes(sl.batch_small(lined))
    depth = {}
    for r in sl.line_depth(df).collect():
        depth.setdefault(r.script_id, []).append((r.line_no, r.line, r.depth))
    for i, text in enumerate(texts):
        key = str(i)
        kept = "\n".join(line for line in text.split("\n") if line.strip() != "/")
        assert squeezed("".join(delimited.get(key, []))) == squeezed(kept)
        assert "\n".join(counted[key]) == text
        assert squeezed("".join(batched.get(key, []))) == squeezed(text)
        assert squeezed("".join(top.get(key, []))) == squeezed(text)
        found = "".join(pattern.get(key, []))
        assert squeezed(found).replace(";", "") in (
            squeezed(text).replace(";", ""),
            squeezed(text).replace(";", "").removesuffix("/"),
        )
        level = 0
        for no, (line_no, line, got) in enumerate(sorted(depth.get(key, [])), 1):
            level = max(level + ("BEGIN" in line) - ("END" in line), 0)
            assert (no, level) == (line_no, got)
