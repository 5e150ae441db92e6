from leanspan.operators import ranking as K
from leanspan.plans.planner import atoms_of, clauses_of, plan, roles_of

ZERO = dict.fromkeys(K.SIGNALS, 0.0)


def item(path="src/a.rs", start=1, end=10, tokens=100, score=1.0, kinds=(), concepts=(), weight=1.0, view="text", cls="production", stem=None, text=None, **signals):
    text = text or f"{path}:{start}-{end}"
    return K.Item(path, start, end, text, text, tokens, score, list(kinds), list(concepts), weight, view, cls, stem or path.rsplit("/", 1)[-1].split(".")[0], None, ZERO | signals)


def test_budget_is_never_exceeded_and_later_smaller_ones_fit():
    items = [item(path=f"src/f{k}.rs", tokens=t, score=1 - k / 100, concepts=[f"c{k}"]) for k, t in enumerate((400, 900, 300, 50))]
    chosen, omitted = K.pack_items(items, 800)
    assert sum(x.tokens for x in chosen) <= 800
    assert [x.tokens for x in omitted] == [900]
    assert {x.tokens for x in chosen} == {400, 300, 50}


def test_per_file_and_fragment_caps():
    items = [item(start=20 * k + 1, end=20 * k + 5, tokens=10, concepts=[f"c{k}"]) for k in range(6)]
    assert len(K.pack_items(items, 500)[0]) == 1
    assert len(K.pack_items(items, 1200)[0]) == 2
    assert len(K.pack_items([item(path=f"src/{k}.rs", tokens=1, concepts=[str(k)]) for k in range(20)], 5000)[0]) == 8


def test_owner_then_its_test():
    owner = item("src/parser.rs", score=0.6, kinds=["facet:primary_change:x"], concepts=["x"])
    test = item("tests/parser_test.rs", score=0.2, cls="test", stem="parser", concepts=["y"])
    other = item("src/other.rs", score=0.9, concepts=["z"])
    chosen, _ = K.pack_items([other, test, owner], 1000)
    assert [x.path for x in chosen[:2]] == ["src/parser.rs", "tests/parser_test.rs"]


def test_auxiliary_quota():
    items = [item(f"fixtures/{k}.rs", cls="auxiliary", concepts=[str(k)], tokens=1) for k in range(4)]
    assert len(K.pack_items(items, 5000)[0]) == 1


def test_low_scores_without_weight_are_left_out():
    items = [item("src/a.rs", score=1.0, concepts=["a"]), item("src/b.rs", score=0.1, weight=0.2, concepts=["b"])]
    chosen, omitted = K.pack_items(items, 5000)
    assert [x.path for x in omitted] == ["src/b.rs"] and len(chosen) == 1


def test_dedup_at_exactly_half_of_the_shorter():
    a, b = item(start=1, end=10, score=0.9), item(start=6, end=15, score=0.5)
    assert len(K.deduplicate([a, b])) == 1
    a, b = item(start=1, end=10, score=0.9), item(start=7, end=16, score=0.5)
    assert len(K.deduplicate([a, b])) == 2
    same = [item(path="src/a.rs", text="t"), item(path="src/b.rs", text="t")]
    assert len(K.deduplicate(same)) == 2


def test_dedup_keeps_the_exact_one_and_merges_signals():
    strong, exact = item(score=0.9, bm25=2.0), item(score=0.1, exact=1.0, kinds=["k"])
    (kept,) = K.deduplicate([strong, exact])
    assert kept.signals["exact"] == 1.0 and kept.signals["bm25"] == 2.0 and kept.score > 1


def test_evidence_is_not_given_up_to_an_overlap():
    a, b = item(start=1, end=10, score=0.9), item(start=2, end=10, score=0.5, kinds=[K.EVIDENCE + "0:1"])
    assert len(K.deduplicate([a, b])) == 2


def test_required_come_first():
    items = [item("src/a.rs", score=0.9), item("docs/x.md", score=0.1, cls="supporting"), item("src/e.rs", score=0.2, kinds=[K.EVIDENCE + "0:0"])]
    chosen, _ = K.pack_items(items, 1000, must_paths=["docs"], evidence=[(0, 1)])
    assert [x.path for x in chosen[:2]] == ["src/e.rs", "docs/x.md"]


def test_excerpts():
    lines = [f"line {k}\n" for k in range(1, 201)]
    count = lambda t: max(1, len(t) // 4)
    a, b = K.fit_excerpt(lines, 1, 100, 60, count)
    assert a <= 100 <= b and count("".join(lines[a - 1: b])) <= 60
    assert K.fit_excerpt(lines, 1, 300, 60, count) is None
    assert K.fit_excerpt(["x" * 1000], 1, 1, 10, count) is None
    assert K.adaptive_window(10, 20, 20, 5) == (16, 20)
    assert K.largest_prefix(10, lambda n: n * 3, 10) == 3


def test_plan():
    q = plan("Fix the cursor overflow in resolve_path while keeping the journal format unchanged and add a test")
    values = [x.value for x in q]
    assert values[0] == "resolve_path" and q[0].exact and len(q) <= 12 and values[-1] == "test"
    assert len({v.lower() for v in values}) == len(values)
    assert "primary_change" in q[0].facets
    assert any("preserve_constraint" in x.facets for x in q)
    assert plan("anything", 0) == [] and plan("") == []
    assert atoms_of("call foo_bar(x) in src/a.rs with HTTP") == ["foo_bar", "src/a.rs", "HTTP"]
    assert len(clauses_of("Fix it while keeping that; do more")) == 3
    assert roles_of("the error must remain", True) == {"failure_trace", "preserve_constraint"}


def test_pack_is_the_same_for_any_partitioning(spark, data):
    from leanspan.plans.queries import TASKS
    from leanspan.plans.context import context
    from leanspan.sources.tables import table

    def run(n):
        t = lambda x: table(spark, data, x).repartition(n)
        rows = context(spark, TASKS, t("files"), t("chunks"), t("symbols"), 1500).collect()
        assert all(sum(r["token_count"] for r in rows if r["task_id"] == k) <= 1500 for k in (1, 2, 3))
        return sorted((r["task_id"], r["ordinal"], r["path"], r["start_line"]) for r in rows)

    assert run(1) == run(3) == run(7)
