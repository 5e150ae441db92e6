"""The stored index against plain scans, and search in its modes."""

import random
import re

import pytest
from pyspark.sql import functions as F

from leanspan.operators import retrieval as R
from leanspan.operators import search as H
from leanspan.sources import index as N


def ids(df, key="id"):
    return sorted(r[key] for r in df.select(key).collect())


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    rng = random.Random(2)
    words = ["cursor", "Ledger", "straße", "überlauf", "lock_table", "A", "of", "эхо", "I'm", "x=1", "\U0001F600", "run(", "  ", "\n"]
    rows = [(n * 5000 if n % 7 == 0 else n, n % 9, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 40))), 1 + n, 10 * n) for n in range(1, 160)]
    d = str(tmp_path_factory.mktemp("index"))
    schema = "id long, file_id long, content string, start_line long, start_byte long"
    spark.createDataFrame([*rows, rows[3], (None, 1, "cursor", 1, 0), (9999, 1, None, 1, 0), (10000, 1, "", 1, 0)], schema).write.parquet(f"{d}/chunks.parquet")
    files = spark.createDataFrame([(n, f"r{n % 2}/src/f{n}.py") for n in range(9)], "id long, path string")
    chunks = spark.read.parquet(f"{d}/chunks.parquet").filter("id is not null and content is not null").dropDuplicates(["id"])
    return N.index_of(spark, d, f"file://{d}/index"), chunks, files, d


def test_buckets_are_those_of_the_column(spark):
    terms = ["", "a", "straße", "эхо", "x" * 100, "\U0001F600"]
    df = spark.createDataFrame([(t,) for t in terms], "t string").select("t", N._bucket("t").alias("b"))
    assert all(N.buckets_of([r["t"]]) == [r["b"]] for r in df.collect())


def test_index_answers_as_a_scan(made, monkeypatch):
    index, chunks, _, _ = made
    for few, scan in ((N.FEW, 0), (3, 0), (3, 1 << 40)):  # by literals, by a join, and by reading all
        monkeypatch.setattr(N, "FEW", few)
        monkeypatch.setattr(N, "SCAN_BYTES", scan)
        for needle in ("cursor Ledger", "STRASSE", "Straße ü", "x=1 ", "\U0001F600", "эхо э", "no such text", "of", "I'm\n"):
            assert ids(R.substring_search(index, needle)) == ids(R.substring_search(chunks, needle)), needle
        for pattern in (r"cursor\s+(of|A)", r"(Ledger|lock_table) x", r"\d+", r"[a-z]+_table", "nothing here"):
            for case in (True, False):
                assert ids(R.regex_search(index, pattern, case)) == ids(R.regex_search(chunks, pattern, case)), pattern
        for phrase in ("cursor Ledger", "of", "lock_table run", "эхо cursor", "missing word", ""):
            assert ids(R.phrase_search(index, phrase)) == ids(R.phrase_search(chunks, phrase)), phrase


def test_bm25_of_the_index_equals_that_of_the_texts(spark, made):
    index, chunks, _, _ = made
    q = spark.createDataFrame([("a", ["cursor", "ledger"]), ("b", ["straße"]), ("c", ["missing"])], "query_id string, terms array<string>")
    key = lambda df: sorted((r["query_id"], r["position"], r["key"], r["score"]) for r in df.collect())
    assert key(R.bm25(index, q)) == key(R.bm25(chunks, q))


def test_an_index_is_built_once_for_the_same_files(spark, made):
    _, _, _, d = made
    before = N.index_of(spark, d, f"file://{d}/index")
    assert sorted(before.texts.inputFiles()) == sorted(N.index_of(spark, d, f"file://{d}/index").texts.inputFiles())


def test_few_ids_are_pushed_into_the_scan(made):
    index = made[0]
    plan = index.fetch(index.holding("überlauf эхо cursor"))._jdf.queryExecution().toString()
    assert "In(id" in plan or "EqualTo(id" in plan or "LocalTableScan" in plan


def test_routes():
    assert H.route("run") == ("identifier", "word") and H.route("PathStore.run") == ("identifier", "word") and H.route("two words") == ("text", "trigram")
    assert H.route("ab", "text") == ("text", "scan") and H.route(r"\d+", "regex") == ("regex", "scan") and H.route(r"abc\d", "regex") == ("regex", "trigram")
    assert H.route("x", "symbol") == ("symbol", "none")
    with pytest.raises(ValueError):
        H.route("x", "other")


def test_text_hits_equal_brute_force(spark, made):
    index, chunks, files, _ = made
    symbols = spark.createDataFrame([], "id long, file_id long, name string, parent string, kind string, start_line long, end_line long, start_byte long, end_byte long")
    for query, mode, pattern in (("ledger", "text", r"(?i)ledger"), ("x=1", "auto", r"(?i)x=1"), (r"run\(\s", "regex", r"run\(\s"), ("of", "text", "(?i)of")):
        case = mode == "regex"
        want = set()
        for r in chunks.collect():
            found = list(re.finditer(pattern, r["content"]))
            if found and r["file_id"] < 9:
                before = r["content"][: found[0].start()]
                want.add((f"r{r['file_id'] % 2}/src/f{r['file_id']}.py", r["start_line"] + before.count("\n"), r["start_byte"] + len(before.encode()), round(3 + len(found) / (len(found) + 3), 6)))
        got = {(h["path"], h["start_line"], h["start_byte"], round(h["score"], 6)) for h in H.search(index, symbols, files, query, mode, case_sensitive=case).collect()}
        assert got == want, query


def test_hits_merge_order_and_counts(spark, made):
    index, _, files, _ = made
    symbols = spark.createDataFrame([(1, 1, "cursor", "Store", "method", 3, 9, 20, 90), (1, 1, "cursor", "Store", "method", 3, 9, 20, 90), (2, 2, "my_cursor", None, "function", 1, 2, 0, 9)], "id long, file_id long, name string, parent string, kind string, start_line long, end_line long, start_byte long, end_byte long")
    refs = spark.createDataFrame([(1, 3, "cursor"), (1, 50, "cursor"), (2, 7, "cursor_of")], "file_id long, line long, name string")
    hits = H.search(index, symbols, files, "cursor", "identifier", references=refs, focus=["r1/**"])
    rows = {(h["path"], h["start_line"], h["kind"]): h for h in hits.collect()}
    d = rows["r1/src/f1.py", 3, "definition"]
    # the reference on the definition's line is the definition; focus adds two
    assert d["score"] == 12.0 and "reference" in d["kinds"] and ("r1/src/f1.py", 50, "reference") in rows and not any(k[2] == "definition" and k[0].endswith("f2.py") for k in rows)
    page = H.ordered(hits, 5)
    got = [(r["score"], r["path"], r["start_line"]) for r in page.orderBy("position").collect()]
    assert len(got) == 5 and got == sorted(got, key=lambda x: (-x[0], x[1], x[2])) and page.agg(F.max("relative")).first()[0] == 1.0
    cover = {r["kind"]: (r["total"], r["returned"], r["truncated"]) for r in H.coverage(hits, page).collect()}
    assert sum(t for t, _, _ in cover.values()) == hits.count() and sum(n for _, n, _ in cover.values()) == 5 and cover["text"][2]
    loose = {h["name"]: h["score"] for h in H.search(index, symbols, files, "cursor", "symbol").collect()}
    assert loose == {"cursor": 10.0, "my_cursor": 7.0}
    assert H.search(index, symbols, files, "Store.cursor", "symbol", include=["r0/**"]).count() == 0
