"""The channels and boosts of context, from tables and from the index alike."""

import pytest

from leanspan.plans.context import Demand, candidates, context, path_score, seed_paths, task_queries
from leanspan.sources import index as N

TASKS = [(1, "Fix the cursor overflow in resolve_path")]
FILES = {
    "r/src/resolve.py": "def resolve_path(p):\n    return cursor(p)  # overflow\n", "r/src/use.py": "from resolve import resolve_path\nx = resolve_path(1)\n", "r/src/prose.py": "# resolve_path is only spoken of here\n",
    "r/src/deep.py": "def helper():\n    return 1\n", "r/docs/note.md": "Nothing of it, but a Marker Phrase.\n", "r/docs/other.md": "Something else.\n",
}


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("context"))
    ids = {p: n for n, p in enumerate(FILES, 1)}
    spark.createDataFrame([(n, p, FILES[p]) for p, n in ids.items()], "id long, path string, content string").write.parquet(f"{d}/files.parquet")
    chunks = [(n * 10, n, FILES[p], 1, FILES[p].count("\n"), 0) for p, n in ids.items()]
    spark.createDataFrame([*chunks, chunks[0]], "id long, file_id long, content string, start_line long, end_line long, start_byte long").write.parquet(f"{d}/chunks.parquet")
    symbols = spark.createDataFrame([(1, ids["r/src/resolve.py"], "resolve_path", 1), (1, ids["r/src/resolve.py"], "resolve_path", 1), (2, ids["r/src/deep.py"], "helper", 1)], "id long, file_id long, name string, start_line long")
    edges = spark.createDataFrame([("r/src/use.py", "r/src/resolve.py", 1), ("r/src/resolve.py", "r/src/deep.py", 1)], "path string, resolved_path string, line long")
    return spark.read.parquet(f"{d}/files.parquet"), spark.read.parquet(f"{d}/chunks.parquet"), symbols, edges, N.index_of(spark, d, f"file://{d}/index")


DEMANDS = {1: Demand(paths=("r/docs/other.md",), symbols=("helper",), evidence=("marker phrase",), focus=("r/src/use*",))}


def found(spark, made, by_index, **more):
    files, chunks, symbols, _, index = made
    c = candidates(task_queries(spark, TASKS), files, index if by_index else chunks, symbols, **more)
    return {r["path"]: r for r in c.collect()}


@pytest.mark.parametrize("by_index", [False, True])
def test_channels(spark, made, by_index):
    got = found(spark, made, by_index)
    assert got["r/src/resolve.py"]["symbol"] > 0 and got["r/src/resolve.py"]["representation"] == "definition" and got["r/src/resolve.py"]["exact"] == 1.0
    # a call is a reference; a text that only speaks of the name is none
    assert got["r/src/use.py"]["reference"] > 0 and got["r/src/use.py"]["representation"] == "reference"
    assert got["r/src/prose.py"]["reference"] == 0 and got["r/src/prose.py"]["bm25"] > 0
    assert "r/src/deep.py" not in got and "r/docs/other.md" not in got and all(r["import_boost"] == r["change_boost"] == r["focus_boost"] == 0 for r in got.values())


def test_demands_edges_and_changes(spark, made):
    changed = spark.createDataFrame([("r/src/resolve.py",)], "path string")
    got = found(spark, made, True, demands=DEMANDS, edges=made[3], changed=changed)
    assert got == found(spark, made, False, demands=DEMANDS, edges=made[3], changed=changed)
    assert got["r/docs/other.md"]["representation"] == "required" and any("required-evidence:0" in k for k in got["r/docs/note.md"]["match_kinds"])
    assert got["r/src/use.py"]["focus_boost"] == 1.0 and got["r/src/resolve.py"]["focus_boost"] == 0.0
    assert got["r/src/use.py"]["import_boost"] == 1.0 and got["r/src/deep.py"]["import_boost"] == 1.0
    # changed itself, and importing what changed
    assert got["r/src/resolve.py"]["change_boost"] == 1.0 and got["r/src/use.py"]["change_boost"] == 1.0 and got["r/src/prose.py"]["change_boost"] == 0.0


def test_import_channel_without_a_demand(spark, made):
    got = found(spark, made, True, edges=made[3])
    assert got["r/src/deep.py"]["representation"] == "import" and got["r/src/deep.py"]["symbol_name"] == "helper"


def test_demands_are_packed_first(spark, made):
    files, _, symbols, edges, index = made
    rows = context(spark, TASKS, files, index, symbols, demands=DEMANDS, edges=edges).orderBy("ordinal").collect()
    assert [r["path"] for r in rows][:3] == ["r/docs/note.md", "r/docs/other.md", "r/src/deep.py"] and "r/src/resolve.py" in {r["path"] for r in rows}


def test_seed_paths_and_path_score(spark, made):
    files, chunks, symbols, _, _ = made
    seeds = seed_paths(candidates(task_queries(spark, TASKS), files, chunks, symbols), 2).collect()
    assert len(seeds) == 2 and "r/src/resolve.py" in {s["path"] for s in seeds} and all(s["concepts"] for s in seeds)
    from pyspark.sql import functions as F

    terms = F.array(F.lit("resolve"), F.lit("path"), F.lit("python"))
    score = lambda p: spark.range(1).select(path_score(F.lit(p), terms, terms).alias("s")).first()["s"]
    assert score("r/src/resolve_path.py") > score("r/src/resolve.py") > score("r/src/other.rs") > score("r/fixtures/other.rs")
