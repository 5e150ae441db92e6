"""Cases in which the operators once did less than the whole job."""

import random

from leanspan.operators import joins as J
from leanspan.operators import receipts as P
from leanspan.plans import queries as Q
from leanspan.streaming import changes as C


def test_near_duplicates_of_a_session_equal_brute_force(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(4)]
    flip = lambda x, n: x ^ sum(1 << b for b in rng.sample(range(64), n))
    signed = lambda x: x - (1 << 64) if x >= 1 << 63 else x
    data = []
    for n in range(160):
        x = None if n % 13 == 0 else signed(flip(base[rng.randrange(4)], rng.choice([0, 3, 8, 9, 12])))
        data.append(("s%d" % rng.randrange(2), n, f"p{n if n % 5 else n // 2}", 1, 10, f"h{n if n % 7 else n // 3}", x))
    r = spark.createDataFrame(data, "session string, position int, path string, a int, b int, content_hash string, signature long")
    want = {}
    for s, n, path, _, _, h, x in data:
        before = [y for y in data if y[0] == s and y[1] < n]
        near = x is not None and any(y[6] is not None and ((x ^ y[6]) & (1 << 64) - 1).bit_count() <= 8 for y in before)
        want[n] = "exact" if any(y[5] == h for y in before) else "overlap" if any(y[2] == path for y in before) else "near_duplicate" if near else "return"
    assert {x["position"]: x["decision"] for x in P.decisions(r).collect()} == want and set(want.values()) == {"exact", "overlap", "near_duplicate", "return"}


def test_bodies_change_and_symbols_are_renamed(spark, tmp_path):
    def text(*functions):
        return "# é\n" + "".join(f"def {n}():\n    return {v}\n" for n, v in functions)

    files = [(1, "r", 1, text(("same", 1), ("body", 2), ("old", 3))), (2, "r", 2, text(("same", 1), ("body", 20), ("new", 3)))]
    symbols = []
    for f, _, _, content in files:
        for name in ("same", "body", "old", "new"):
            at = content.encode().find(f"def {name}(".encode())
            if at >= 0:
                end = content.encode().find(b"def ", at + 1)
                symbols.append((len(symbols), f, name, "function", None, f"def {name}():", at, end if end >= 0 else len(content.encode())))
    spark.createDataFrame(files, "id long, repository string, generation long, content string").write.parquet(f"{tmp_path}/files.parquet")
    spark.createDataFrame(symbols, "id long, file_id long, name string, kind string, parent string, signature string, start_byte long, end_byte long").write.parquet(f"{tmp_path}/symbols.parquet")
    q = Q.queries()
    assert {r["name"]: r["change"] for r in q["symbol_body_changes"](spark, str(tmp_path)).collect()} == {"same": "unchanged", "body": "modified_body", "old": "removed", "new": "added"}
    assert [(r["old_name"], r["new_name"]) for r in q["rename_detection"](spark, str(tmp_path)).collect()] == [("old", "new")]


def test_excerpts_come_from_all_repositories(spark, data):
    f = spark.read.parquet(f"{data}/files.parquet")
    long = {r["id"] for r in f.filter("size(split(content, '\\n')) > 75").collect()}
    got = {r["request_id"] for r in Q.queries()["stored_excerpts"](spark, data).collect()}
    assert long <= got and f.filter(f.id.isin(list(got))).select("repository").distinct().count() > 1


def test_bursts_count_deliveries_once_and_paths_exactly(spark):
    c = spark.sql("select concat('r/p', id) path, 'Modified' kind, timestamp '2024-01-01 00:00:00' ts from range(1000)")
    (r,) = C.bursts(c.unionByName(c), most=1000, once=True).collect()
    assert (r["events"], r["action"]) == (1000, "paths")
    for most, action in ((999, "full"), (1000, "paths"), (1001, "paths")):
        assert [(x["events"], x["action"]) for x in C.bursts(c.unionByName(c), most=most).collect()] == [(2000, action)]


def test_near_classes_are_counted_without_a_row_for_each_pair(spark):
    rng = random.Random(7)
    flip = lambda x, n: x ^ sum(1 << b for b in rng.sample(range(64), n))
    signed = lambda x: x - (1 << 64) if x >= 1 << 63 else x
    base = [rng.getrandbits(64) for _ in range(3)]
    words = list({flip(b, rng.choice([1, 2, 3, 4, 5, 6])) for b in base for _ in range(500)} | {rng.getrandbits(64) for _ in range(100)})
    want = {signed(x): sum(0 < (x ^ y).bit_count() <= 8 for y in words) for x in words}
    assert sum(want.values()) > 150 * len(words)
    d = spark.createDataFrame([(n, signed(x)) for n, x in enumerate(words + words[:9])] + [(-1, None)], "id long, s long").repartition(3)
    sc, store = spark.sparkContext, spark.sparkContext._jsc.sc().statusStore()

    def shuffled():
        sc._jsc.sc().listenerBus().waitUntilEmpty()
        stages = store.stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
        return sum(stages.apply(n).shuffleWriteRecords() for n in range(stages.size()))

    before = shuffled()
    got = J.near_duplicate_classes(d, "id", "s").collect()
    assert len(got) == len(words) + 10 and all(r["near_classes"] == want.get(r["class"], 0) and r["members"] == 1 + (r["class"] in map(signed, words[:9])) for r in got)
    assert shuffled() - before < 60 * len(words)
    in_parts = J.near_counts(d, "s", most=120).collect()
    assert {r["s"]: r["near"] for r in in_parts} == {x: n for x, n in want.items() if n} and len(in_parts) == len({r["s"] for r in in_parts})
