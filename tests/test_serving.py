"""What answers need: cursors, caps, accounting, fitting, manifests; and what changes bring along."""

import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from leanspan.functions.tokens import estimate_py
from leanspan.operators import evidence as E
from leanspan.operators import serving as V
from leanspan.operators.diff import owner_tests


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols or df.columns) for r in df.collect())


def test_cursors_are_bound():
    token = V.cursor({"id": 7}, 3, "q")
    assert V.position_of(token, 3, "q") == {"id": 7}
    for bad in (lambda: V.position_of(token, 4, "q"), lambda: V.position_of(token, 3, "r"), lambda: V.position_of("xx", 3, "q"), lambda: V.position_of(token[:-4] + "AAAA", 3, "q")):
        with pytest.raises(V.StaleCursor):
            bad()


def test_caps_fail_loudly(spark):
    assert V.capped(spark.range(5), 5, "rows").count() == 5
    with pytest.raises(V.TooMany):
        V.capped(spark.range(6), 5, "rows")
    assert [V.clamp(x, 10, 50) for x in (None, 0, 7, 99)] == [10, 1, 7, 50]


def test_lines_and_bytes():
    text = "é\nbb\n\nc"
    starts, size = V.line_starts_py(text), len(text.encode())
    assert starts == [0, 3, 6, 7] and [V.line_of_byte(starts, size, b) for b in (0, 2, 3, 6, 7, 99)] == [1, 1, 2, 3, 4, 4]
    cut = lambda a, b: text.encode()[slice(*V.bytes_of_lines(starts, size, a, b))].decode()
    assert cut(1, 2) == "é\nbb\n" and cut(4, 2) == "bb\n\nc" and cut(0, 99) == text and V.bytes_of_lines([], 0, 1, 2) == (0, 0) and V.line_starts_py("") == []


def test_truncate_is_the_longest_prefix():
    text = "one two three four five six"
    for most in range(0, 9):
        got, n = V.truncate(text, most)
        assert n <= most and (got == text or estimate_py(text[: len(got) + 1]) > most)


@pytest.mark.skipif(not os.path.exists("/opt/tokenizers/byte_bpe_50k.tiktoken"), reason="no vocabulary here")
def test_bpe_tokens_in_a_plan(spark):
    pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    df = spark.createDataFrame([("hello world",), ("",), (None,), ("a b c",)], "t string").select("t", E.bpe_tokens("t", "/opt/tokenizers/byte_bpe_50k.tiktoken", pattern).alias("n"))
    assert {r["t"]: r["n"] for r in df.collect()} == {"hello world": 2, "": 0, None: None, "a b c": 3}
    count = V.bpe_counter("/opt/tokenizers/byte_bpe_50k.tiktoken", pattern)
    assert V.truncate("hello world again", 2, count) == ("hello world", 2)


def test_accounting_settles_and_adds_up():
    body = V.response_accounting({"hits": ["x" * 400], "meta": {"a": 1}}, ["x" * 400])
    t = body["tokens"]
    assert t["total"] == estimate_py(json.dumps(body, sort_keys=True, ensure_ascii=False)) and t["source"] == 100 and t["metadata"] == max(0, t["total"] - t["source"] - t["protocol"])


def test_fitting_drops_parts_then_fragments():
    body = {"details": "d" * 400, "reasons": "r" * 400, "fragments": ["f" * 200] * 5}
    cost = lambda r: estimate_py(json.dumps(r, sort_keys=True, ensure_ascii=False))
    assert V.fit_response(body, ["details", "reasons"], "fragments", 1000) == body
    mid = V.fit_response(body, ["details", "reasons"], "fragments", cost(body) - 50)
    assert "details" not in mid and "reasons" in mid and len(mid["fragments"]) == 5
    low = V.fit_response(body, ["details", "reasons"], "fragments", 120)
    assert set(low) == {"fragments"} and len(low["fragments"]) == 2 and cost(low) <= 120 < cost({"fragments": body["fragments"][:3]})


def test_focus_diagnostics(spark):
    c = spark.createDataFrame([("a/x.py", 1, "eligible"), ("a/y.py", 1, "eligible"), ("b/z.py", 1, "path_excluded"), ("c/k.py", 1, "known_hash")], "path string, start_line int, status string")
    got = {r["pattern"]: r for r in V.focus_diagnostics(c, c.limit(1), ["a/**", "b/**", "c/**", "d/**"]).collect()}
    assert (got["a/**"]["generated"], got["a/**"]["selected"], got["a/**"]["first_blocker"]) == (2, 1, "budget_or_limit")
    assert [got[p]["first_blocker"] for p in ("b/**", "c/**", "d/**")] == ["path_excluded", "known_hash", "not_generated"]


def test_handoff_and_history(spark):
    m = V.handoff("é" * 2000, [f"p{k}" for k in range(40)], ["s", "s"], [], most=32, bytes_most=11)
    assert m["task"] == "é" * 5 and m["task_truncated"] and len(m["paths"]) == 32 and m["symbols"] == ["s"] and m["omitted"] == {"paths": 8, "symbols": 0, "receipts": 0}
    blobs = spark.createDataFrame([("r1", "a", "1\n2\n3"), ("r2", "a", "1\nX\n3"), ("r3", "a", "1\nX\nY"), ("r1", "b", "q")], "revision string, path string, content string")
    revisions = spark.createDataFrame([("r1", 1), ("r2", 2), ("r3", 3)], "revision string, ts int")
    assert [r["revision"] for r in V.line_history(blobs, revisions, "a", 2, 2).collect()] == ["r2", "r1"]
    assert rows(V.at_revision(blobs, "a", "r2"), "content") == [("1\nX\n3",)]


def test_config_diff(spark):
    s = "path string, content string"
    before = spark.createDataFrame([("a.json", '{"x": {"y": 1, "z": [1, 2]}, "k~/": true}'), ("b.toml", "[t]\nv = 1\n"), ("c.env", "export A=1\nB='2'\n# C=3\n"), ("d.json", "{"), ("e.py", "x = 1"), ("f.ini", "[s]\na: 1\n"), ("g.json", None)], s)
    after = spark.createDataFrame([("a.json", '{"x": {"y": 2, "z": [1]}, "k~/": true}'), ("b.toml", "[t]\nv = 1\nw = 2024-01-01\n"), ("c.env", "A=1\nB=3\n"), ("d.json", "{}"), ("f.ini", "[s]\n[o]\na=1\n")], s)
    assert rows(E.config_diff(before, after), "path", "key", "status") == [
        ("a.json", "/x/y", "changed"), ("a.json", "/x/z/1", "removed"), ("b.toml", "/t/w", "added"), ("c.env", "/B", "changed"), ("d.json", "!", "unparsed"), ("d.json", "/", "added"), ("f.ini", "/o/a", "added"), ("f.ini", "/s/a", "removed"),
    ]
    assert E.config_diff(before, before).filter("key <> '!'").count() == 0 and E.config_diff(before.limit(0), after.limit(0)).count() == 0


def test_diff_evidence_coverage_and_batches(spark):
    files = spark.createDataFrame([(p,) for p in ("r/src/store.py", "r/src/lone.py", "r/tests/test_store.py", "r/src/use.py")], "path string")
    tests = owner_tests(files)
    changed = spark.createDataFrame([("r/src/store.py",), ("r/src/lone.py",), ("r/tests/test_store.py",), ("r/src/store.py",)], "path string")
    assert rows(E.owner_coverage(changed, tests)) == [("r/src/lone.py", "missing", 0), ("r/src/store.py", "found", 1), ("r/tests/test_store.py", "unknown", 0)]
    hunks = spark.createDataFrame([("r/src/store.py", 5, 6), ("r/src/lone.py", None, None)], "path string, a long, b long")
    symbols = spark.createDataFrame([("r/src/store.py", "page", "function", 1, 5), ("r/src/store.py", "other", "function", 9, 12)], "path string, name string, kind string, start_line long, end_line long")
    refs = spark.createDataFrame([("r/src/use.py", 3, "page"), ("r/src/use.py", 4, "other"), ("r/src/store.py", 8, "page")], "path string, line long, name string")
    edges = spark.createDataFrame([("r/src/use.py", "r/src/store.py", 1)], "path string, resolved_path string, line long")
    got = rows(E.diff_evidence(hunks, symbols, refs, edges, tests, files).select("path", "relation", F.coalesce("evidence_path", F.lit("-")).alias("e"), F.coalesce("name", F.lit("-")).alias("n")))
    assert got == [
        ("r/src/lone.py", "importer", "-", "-"), ("r/src/lone.py", "reference", "-", "-"), ("r/src/lone.py", "test_name_match", "-", "-"),
        ("r/src/store.py", "importer", "r/src/use.py", "-"), ("r/src/store.py", "reference", "r/src/use.py", "page"), ("r/src/store.py", "symbol", "r/src/store.py", "page"), ("r/src/store.py", "test_name_match", "r/tests/test_store.py", "-"),
    ]
    changes = spark.createDataFrame([(f"n{k:02d}", "modified_body") for k in range(40)], "name string, change string")
    targets = changes.select("name").unionByName(spark.createDataFrame([("zz",)], "name string"))
    pages = [rows(E.batch(changes, targets, ["name"], p)) for p in (0, 1, 2)]
    assert [len(p) for p in pages] == [32, 9, 0] and pages[1][-1] == ("zz", "not_found") and len({r for p in pages for r in p}) == 41
    with pytest.raises(V.TooMany):
        E.batch(changes, spark.range(65).select(F.col("id").cast("string").alias("name")), ["name"])


def test_structural_match(spark):
    s = spark.createDataFrame([("a", 1, 5, "h1"), ("b", 1, 2, "h2")], "path string, start_line int, end_line int, hash string")
    i = spark.createDataFrame([("a", 1, 5, "h9")] + [("c", 1, 1, "h")] * 65, s.schema)
    r = spark.createDataFrame([(1, "a", 1, 5, "h1"), (2, "b", 1, 2, "old"), (3, "b", 1, 3, "h2"), (4, "c", 1, 1, "h"), (5, "a", 1, 5, "h9")], "request_id int, path string, start_line int, end_line int, hash string")
    assert rows(E.structural_match(s, i, r)) == [(1, "same"), (2, "changed"), (3, "unknown"), (4, "unknown"), (5, "same")]


def test_waits(spark):
    assert [E.wait(n) for n in range(9)] == [0.0, 0.5, 1.0, 2.0, 4.0, 8.0, 16.0, 30.0, 30.0] and E.wait(10_000, E.COOLDOWN) == 30.0
    t = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    p = spark.createDataFrame([("a", t(0), False, True), ("a", t(1), False, True), ("a", t(2), True, False), ("a", t(3), False, False), ("a", t(70), False, True), ("b", t(0), True, True)], "source string, ts timestamp, ok boolean, full boolean")
    got = [(r["source"], r["retry_after"], r["full_after"]) for r in E.waits(p).orderBy("source", "ts").collect()]
    assert got == [("a", 0.5, 1.0), ("a", 1.0, 2.0), ("a", 0.0, 0.0), ("a", 0.5, 0.0), ("a", 0.5, 1.0), ("b", 0.0, 1.0)]
