import json

import pytest
from pyspark.sql import functions as F

from leanspan.functions.text import token_terms
from leanspan.operators import aggregates as A
from leanspan.operators import derive as D
from leanspan.operators import diff as X
from leanspan.operators import joins as J
from leanspan.operators import jsonops as S
from leanspan.operators import receipts as P
from leanspan.operators import retrieval as R
from leanspan.sources import discovery, generation
from leanspan.streaming import changes as C


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols or df.columns) for r in df.collect())


def test_overlap_join_over_many_bands(spark):
    left = spark.createDataFrame([("f", 1, 1000), ("f", 500, 500), ("g", 1, 2)], "file string, a long, b long")
    right = spark.createDataFrame([("f", 300, 700), ("f", 1000, 1200), ("g", 3, 9)], "file string, c long, d long")
    got = rows(J.overlap_join(left, right, "file", band=64), "file", "a", "c")
    assert got == [("f", 1, 300), ("f", 1, 1000), ("f", 500, 300)]


def test_near_signatures_equals_brute_force(spark):
    import random

    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(30)]
    sigs = list({b ^ sum(1 << k for k in rng.sample(range(64), n)) for b in base for n in (0, 1, 4, 8, 9, 12)})
    signed = [s - (1 << 64) if s >> 63 else s for s in sigs]
    df = spark.createDataFrame([(k, s) for k, s in enumerate(signed)] + [(10**6, signed[0]), (10**6 + 1, None)], "id long, s long")
    want = sorted((min(a, b), max(a, b)) for n, a in enumerate(signed) for b in signed[:n] if bin((a ^ b) & (2**64 - 1)).count("1") <= 8)
    assert rows(J.near_signatures(df, "s")) == want
    classes = {r["id"]: r for r in J.near_duplicate_classes(df, "id", "s").collect()}
    assert classes[0]["members"] == 2 and classes[10**6 + 1]["class"] is None and len(classes) == len(signed) + 2


def test_simhash_needs_three_tokens(spark):
    df = spark.createDataFrame([("alpha beta",), ("alpha beta gamma",), (None,), ("",)], "t string").select(J.simhash(token_terms("t")).alias("s"))
    got = [r["s"] for r in df.collect()]
    assert got[0] is None and got[1] is not None and got[3] is None


def test_prefilter_never_changes_a_result(spark, data):
    from leanspan.sources.tables import table

    chunks = table(spark, data, "chunks")
    for pattern in (r"return (None|null)", r"(alpha|cursor)\w*", r"x{3,}", r"[a-z]+_core", r"(?:abc)?def", r"Reads? the \w+", r"K"):
        for case in (True, False):
            on = rows(R.regex_search(chunks, pattern, case, True).select("id"))
            assert on == rows(R.regex_search(chunks, pattern, case, False).select("id"))
    assert R.required_literals("foo(bar|quux)+q?") == [["foo"], ["bar", "quux"]]
    assert R.required_literals("a?b*") is None


def test_occurrences_positions(spark):
    c = spark.createDataFrame([(1, 9, "é foo\nfoo bar", 5, 100)], "id long, file_id long, content string, start_line long, start_byte long")
    assert rows(R.occurrences(c, "foo"), "line", "column", "start_byte", "end_byte") == [(5, 3, 103, 106), (6, 1, 107, 110)]


def test_page_and_fuzzy():
    assert R.page_hits([5, 6, 1], 10, 10) == ([0], 1)
    assert R.page_hits([50, 4, 4], 10, 10) == ([1, 2], 3)
    assert R.page_hits([1, 1, 1], 2, 10) == ([0, 1], 2)
    assert R.fuzzy_score("abc", "xyz") is None and R.fuzzy_score("", "x") == 0
    assert R.fuzzy_score("ctx", "src/ctx.rs") > R.fuzzy_score("ctx", "src/caterx.rs")


def test_headings_ranges_and_fences(spark):
    text = "# A\nx\n## B\n```\n# not\n```\ny\n# C\n"
    f = spark.createDataFrame([(1, "r/a.md", text), (2, "r/b.md", None), (3, "r/c.md", "")], "id long, path string, content string")
    assert rows(D.headings(f), "name", "start_line", "end_line") == [("A", 1, 7), ("B", 3, 7), ("C", 8, 8)]


def test_imports_resolve_by_priority(spark):
    f = spark.createDataFrame([(1, "r/a.py", "import m\nfrom .n import x\n"), (2, "r/m.py", ""), (3, "r/m/__init__.py", ""), (4, "r/n.py", ""), (5, None, None)], "id long, path string, content string")
    got = {r["raw_target"]: r["resolved_path"] for r in D.resolve_imports(f).collect()}
    assert got == {"m": "r/m/__init__.py", ".n": "r/n.py"}


def test_containment(spark):
    s = spark.createDataFrame([(1, 1, "C", "class", 0, 10000), (2, 1, "m", "method", 10, 9000), (3, 1, "f", "function", 5000, 6000), (4, 1, "g", "function", 20000, 20001), (5, None, "x", "class", 1, 2)], "id long, file_id long, name string, kind string, start_byte long, end_byte long")
    assert {r["id"]: r["container_id"] for r in D.parents_by_containment(s).collect()} == {1: None, 2: 1, 3: 2, 4: None}


def test_facets_remainder(spark):
    df = spark.createDataFrame([(c,) for n, c in enumerate("abcdefghijklmno") for _ in range(20 - n)], "v string")
    got = dict(rows(A.facets(df, "v")))
    assert len(got) == 12 and sum(got.values()) == df.count() and got["[other]"] == sum(20 - n for n in range(11, 15))
    assert dict(rows(A.facets(df.filter("v in ('a', 'b')"), "v"))) == {"a": 20, "b": 19}


def test_counters_and_delta(spark):
    log = spark.createDataFrame([("a", 2**62), ("a", 2**62), ("a", None), ("b", 1)], "k string, v long")
    assert rows(A.counters(log, ["k"], ["v"])) == [("a", 3, 2**63 - 1), ("b", 1, 1)]
    d = A.counter_delta(spark.createDataFrame([("a", 1)], "k string, v long"), spark.createDataFrame([("a", 3), ("b", 0)], "k string, v long"), ["k"], ["v"])
    assert rows(d) == [("a", -2, True), ("b", 0, False)]


def test_digest_ignores_order(spark):
    a = spark.createDataFrame([("r", "x", "1"), ("r", "y", "2"), ("q", "x", None)], "r string, p string, h string")
    assert rows(A.ordered_digest(a, "r", "p", "h")) == rows(A.ordered_digest(a.orderBy(F.desc("p")).union(a), "r", "p", "h"))


def test_json():
    doc = {"a/b": {"~": [1, "x", None]}, "n": None}
    assert S.select_pointer(doc, "/a~1b/~0/1") == "x" and S.select_pointer(doc, "/n") is None
    assert S.select_pointer(doc, "/zz") is S.MISSING and S.select_pointer(doc, "") == doc
    assert [k["pointer"] for k in S.keys(doc)] == ["", "/a~1b", "/a~1b/~0", "/a~1b/~0/*", "/n"]
    assert next(k for k in S.keys(doc) if k["pointer"].endswith("*"))["type"] == "number"
    assert S.select_path({"a": [{"b": 1}, {"b": 2}, {}]}, "a[*].b") == [1, 2]
    assert S.select_path({"a": [[1], [2]]}, "a[]") == [1, 2] and S.select_path({}, "x.y") is None
    assert S.numeric_summary([1, 2, 3, 10, "x", None]) == {"count": 4, "non_numeric_count": 2, "min": 1.0, "median": 2.5, "p95": 10.0, "max": 10.0}
    assert S.numeric_summary([])["median"] is None
    assert S.collapse([1, 2, 3, 4], 10, 2) == ({"$array": {"count": 4, "sample": [1, 2], "omitted": 2}}, True)
    assert S.collapse({"a": 1, "b": 2}, 2, 2)[1] is False
    s = S.schema([1, "a", 2], 10)
    assert s == {"type": "array", "count": 3, "items": {"anyOf": [{"type": "number"}, {"type": "string"}]}}
    assert "x-incomplete" in S.schema({"a": {"b": 1, "c": 2}}, 2)
    assert S.load("{")[1].startswith("invalid JSON at byte") and S.load(None)[1]
    assert S.node_count({"a": [1, 2]}) == 4


def test_changes_relocations_and_renames(spark):
    a = spark.createDataFrame([("x", "1"), ("y", "2"), ("z", None)], "p string, h string")
    b = spark.createDataFrame([("y", "3"), ("z", None), ("w", "1")], "p string, h string")
    assert rows(X.change_set(a, b, "p", ["h"])) == [("w", "created"), ("x", "deleted"), ("y", "modified"), ("z", "unchanged")]
    gone = spark.createDataFrame([("old", "h", None), ("d1", "g", "l"), ("d2", "g", "l")], "path string, hash string, lang string")
    come = spark.createDataFrame([("new", "h", None), ("e", "g", "l")], "path string, hash string, lang string")
    assert rows(X.relocations(gone, come, ["hash", "lang"]), "before", "after") == [("old", "new")]
    old = spark.createDataFrame([("p", "f", "function", "sig", "B1"), ("p", "g", "function", "s", "B2"), ("p", "d", "function", "s", "B3"), ("p", "d", "function", "s", "B4")], "path string, name string, kind string, signature string, body string")
    new = spark.createDataFrame([("p", "f2", "function", "sig", "B1"), ("p", "g", "function", "s2", "B9"), ("p", "d", "function", "s", "B3")], "path string, name string, kind string, signature string, body string")
    ch = X.symbol_changes(old, new, ["path", "name", "kind"])
    assert {r["name"]: r["change"] for r in ch.collect()} == {"f": "removed", "f2": "added", "g": "modified_signature", "d": "ambiguous"}
    assert rows(X.renames(ch), "old_name", "new_name") == [("f", "f2")]


def test_hunks(spark):
    diff = "diff --git a/x.py b/x.py\n--- a/x.py\n+++ b/x.py\n@@ -1,2 +3,4 @@\n+a\n@@ -9 +20 @@\n-b\ndiff --git a/m b/m\n--- a/m\n+++ b/m\n"
    h = X.hunks_of(spark.createDataFrame([(diff,)], "diff string"))
    assert sorted(((r["path"], r["a"], r["b"]) for r in h.collect()), key=str) == [("m", None, None), ("x.py", 20, 20), ("x.py", 3, 6)]
    s = spark.createDataFrame([("x.py", "f", "function", 1, 3), ("x.py", "g", "function", 7, 9), ("m", "k", "function", 1, 2)], "path string, name string, kind string, start_line long, end_line long")
    assert rows(X.hunk_symbols(h, s), "name") == [("f",), ("k",)]


def test_read_delta_applies():
    old = "".join(f"line {k}\n" for k in range(100))
    new = old.replace("line 50\n", "changed\n").replace("line 7\n", "")
    kind, delta = X.read_delta(old, new)
    assert kind == "delta" and X.apply_delta(old, delta) == new
    assert X.read_delta(old, old) == ("not_modified", "") and X.read_delta(None, new)[0] == "full" and X.read_delta("a\n", "b\n")[0] == "full"


def test_receipts(spark):
    r = spark.createDataFrame([("s", 1, "p", 1, 10, "h1"), ("s", 2, "q", 1, 10, "h1"), ("s", 3, "p", 10, 20, "h2"), ("s", 4, "p", 30, 40, ""), ("t", 5, "p", 1, 10, "h1"), ("s", 6, None, None, None, None)], "session string, position long, path string, a long, b long, content_hash string")
    assert {x["position"]: x["decision"] for x in P.decisions(r).collect()} == {1: "return", 2: "exact", 3: "overlap", 4: "return", 5: "return", 6: "return"}
    rec = spark.sql("select 's' session, id receipt, timestamp '2024-01-02 00:00:00' - make_interval(0, 0, 0, 0, id) ts from range(0, 40) t(id)")
    assert P.retained(rec, "2024-01-02 00:00:00", most=10).count() == 10 and P.retained(rec, "2024-01-02 00:00:00").count() == 24
    base = {"predicate": "p", "partition": "d", "generation": 1, "scope": ["a"], "matches": 0}
    assert P.reusable(base, base) == "exact" and P.reusable(base | {"scope": ["a", "b"]}, base) == "subset"
    assert P.reusable(base | {"scope": ["a", "b"]}, base | {"matches": 1}) == "none"
    assert P.reusable(base | {"partition": "e", "generation": 2}, base) == "none"


def test_generations(spark, tmp_path):
    root = f"file://{tmp_path}/g"
    t = spark.range(5)
    assert generation.publish(spark, root, {"t": t}, 0) == (1, True)
    assert generation.publish(spark, root, {"t": t.orderBy(F.desc("id"))}, 1) == (1, False)
    with pytest.raises(generation.StaleBaseline):
        generation.publish(spark, root, {"t": spark.range(6)}, 0)
    pinned = generation.read(spark, root, "t", 1)
    assert generation.publish(spark, root, {"t": spark.range(6)}, 1) == (2, True)
    assert pinned.count() == 5 and generation.read(spark, root, "t").count() == 6


def test_two_writers_with_one_base(spark, tmp_path, monkeypatch):
    root = f"file://{tmp_path}/g"
    generation.publish(spark, root, {"t": spark.range(3)}, 0)
    before = generation.manifest(spark, root)
    assert generation.publish(spark, root, {"t": spark.range(4)}, 1) == (2, True)
    # a second writer that read the manifest before the first one published
    monkeypatch.setattr(generation, "manifest", lambda *a: before)
    with pytest.raises(generation.StaleBaseline):
        generation.publish(spark, root, {"t": spark.range(5)}, 1)
    monkeypatch.undo()
    assert generation.manifest(spark, root)["generation"] == 2
    assert [generation.read(spark, root, "t", g).count() for g in (1, 2)] == [3, 4]
    # a writer that died before the rename blocks nobody
    spark.range(9).write.parquet(f"{root}/tables-dead/t")
    assert generation.publish(spark, root, {"t": spark.range(6)}, 2) == (3, True)


def test_discovery(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "src/a.py").write_text("x = 1\n")
    (tmp_path / "src/b.bin").write_bytes(b"\0\1")
    (tmp_path / "node_modules/c.js").write_text("1")
    (tmp_path / "src/big.txt").write_text("y" * 100)
    got = {r["path"]: r for r in discovery.discover(spark, str(tmp_path), max_bytes=50).collect()}
    assert {p: r["status"] for p, r in got.items()} == {"src/a.py": "indexed", "src/b.bin": "binary", "node_modules/c.js": "pruned", "src/big.txt": "oversized"}
    assert got["src/a.py"]["language"] == "python" and got["src/b.bin"]["content"] is None
    df = spark.createDataFrame([("a|b", 1)], "x string, y long")
    assert "a\\|b" in discovery.to_markdown(df) and json.loads(discovery.to_json(df)) == [{"x": "a|b", "y": 1}]


def test_stream_equals_batch(spark, data):
    from leanspan.sources.tables import table

    assert rows(C.stream_bursts(spark, data)) == rows(C.bursts(table(spark, data, "changes")))


def test_incremental_state(spark):
    cur = spark.sql("select 'r/a' path, 'created' kind, timestamp '2024-01-01' ts")
    batch = spark.sql("select 'r/a' path, ' Deleted' kind, timestamp '2024-01-02' ts union all select 'r/b', 'created', timestamp '2024-01-01' union all select null, 'created', timestamp '2024-01-01'")
    assert rows(C.apply_batch(cur, batch), "path", "kind") == [("r/a", "deleted"), ("r/b", "created")]
