import random

from pyspark.sql import functions as F

from leanspan.functions import text as T
from leanspan.functions.tokens import estimate, estimate_py
from leanspan.operators.derive import chunk_files, chunk_spans, import_candidates


def col(spark, values, name="t"):
    return spark.createDataFrame([(v,) for v in values], f"{name} string")


def test_estimate_is_the_same_in_both_engines(spark):
    cases = [None, "", " ", "a", "abcd", "a b c", "héllo wörld", "x" * 17, "a b\x85c\xa0d", "\n", "👍 👍"]
    got = [r["n"] for r in col(spark, cases).select(estimate("t").alias("n")).collect()]
    assert got == [estimate_py(c) for c in cases]
    assert estimate_py("") == 0 and estimate_py(" ") == 1 and estimate_py("a b c") == 3


def test_line_starts_and_counts(spark):
    cases = ["", "a", "a\n", "a\nb", "é\nb\n", "\n\n"]
    rows = col(spark, cases).select(T.line_count("t").alias("n"), T.line_starts("t").alias("s")).collect()
    assert [r["n"] for r in rows] == [0, 1, 1, 2, 2, 2]
    assert [r["s"] for r in rows] == [[], [0], [0], [0, 2], [0, 3], [0, 1]]


def test_chunks_add_up_whatever_the_text():
    rng = random.Random(3)
    for _ in range(200):
        text = "".join(rng.choice(["a", "é", "\n", "👍", "bc ", "\r\n"]) for _ in range(rng.randrange(0, 120)))
        for lines, size in ((1, 4), (3, 7), (80, 1000), (2, 1)):
            spans = chunk_spans(text, lines, size)
            assert "".join(s[4] for s in spans) == text
            assert [s[2] for s in spans[1:]] == [s[3] for s in spans[:-1]]
            assert all(s[1] - s[0] < lines for s in spans)
            assert all(len(s[4].encode()) <= size or len(s[4]) == 1 for s in spans)


def test_chunking_null_empty_binary_and_extra_columns(spark):
    f = spark.createDataFrame([(1, "a\nb\n", "x"), (2, "", "x"), (3, None, "x"), (None, "a", "x"), (4, "a\0b", "x")], "id long, content string, ordinal string")
    assert {r["file_id"] for r in chunk_files(f).collect()} == {1}


def test_path_class_values(spark):
    cases = {
        "src/services/context.rs": "production", "tests/a.py": "test", "src/foo_test.go": "test", "src/a.test.ts": "test", "pkg/FooTest.java": "test", "fixtures/a.rs": "auxiliary", "notes.md": "auxiliary", "README.md": "supporting",
        "docs/a.py": "supporting", "benches/x.rs": "supporting", "src/data.bin": "supporting", "a/snapshots/b.rs": "auxiliary", "conftest.py": "test", "src/contest.py": "production",
    }
    got = {r["t"]: r["c"] for r in col(spark, list(cases)).withColumn("c", T.path_class("t")).collect()}
    assert got == cases


def test_globs(spark):
    paths = ["src/a.py", "src/b/c.py", "lib/x.rs", "src", "srcx/a.py", "a/vendor/b/c.go"]
    run = lambda inc, exc=(): {r["t"] for r in col(spark, paths).filter(T.path_filter("t", inc, list(exc))).collect()}
    assert run(["src"]) == {"src/a.py", "src/b/c.py", "src"}
    assert run(["src/*.py"]) == {"src/a.py"}
    assert run(["**/*.{py,rs}"], ["srcx"]) == {"src/a.py", "src/b/c.py", "lib/x.rs"}
    assert run([], ["**/vendor/**"]) == set(paths) - {"a/vendor/b/c.go"}


def test_identifier_words_agree(spark):
    cases = ["fooBar", "HTTPServer2x", "snake_case", "__x__", "A", "getURLFor10Items", ""]
    rows = col(spark, cases).select("t", T.identifier_words("t").alias("w")).collect()
    assert {r["t"]: r["w"] for r in rows} == {c: T.identifier_words_py(c) for c in cases}
    assert T.identifier_words_py("HTTPServer2x") == ["HTTP", "Server", "2", "x"]
    assert T.expand_identifier("fooBar") == ["foobar", "foo_bar", "foo", "bar", "Bar"]


def test_source_stem(spark):
    cases = {"a/test_foo.py": "foo", "a/foo_test.go": "foo", "a/foo.spec.ts": "foo", "a/FooTest.java": "foo", "a/foo.py": "foo"}
    assert {r["t"]: r["s"] for r in col(spark, list(cases)).withColumn("s", T.source_stem("t")).collect()} == cases


def test_import_candidates():
    assert import_candidates("r/a/b.py", ".c", "python")[0] == "r/a/c/__init__.py"
    assert "r/x/y.py" in import_candidates("r/a/b.py", "x.y", "python")
    assert import_candidates("r/a/b.ts", "./c", "typescript")[0] == "r/a/c.ts"
    assert import_candidates("r/a/b.ts", "./c.js", "typescript")[0] == "r/a/c.ts"
    assert "r/src/x/y.rs" in import_candidates("r/src/a/b.rs", "crate::x::y", "rust")
    assert len(import_candidates("/".join("abcdefghijklmnopqrstuvwxyz" * 3) + "/f.py", "m", "python")) <= 64


def test_text_kind(spark):
    rows = col(spark, ["abc", "a\0", "\x01\x02a", "", None]).select(T.text_kind("t").alias("k")).collect()
    assert [r["k"] for r in rows] == ["text", "binary", "binary", "text", None]
    assert F is not None


def test_white_space_is_the_same_set_in_the_jvm_and_in_python(spark):
    from leanspan.functions.tokens import estimate, estimate_py, word_count

    points = [c for c in range(1, 0x11000) if not 0xD800 <= c <= 0xDFFF]
    df = spark.createDataFrame([(c, f"a{chr(c)}b") for c in points], "c int, t string").select("c", word_count("t").alias("n"), estimate("t").alias("e"), "t")
    rows = df.collect()
    assert [r["e"] for r in rows] == [estimate_py(r["t"]) for r in rows] and sum(r["n"] == 2 for r in rows) == 25
