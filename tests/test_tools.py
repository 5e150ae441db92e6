"""The tools and the command line over tables made from a source tree."""

import json

import pytest

from leanspan.__main__ import arguments_of, main
from leanspan.plans.context import Demand
from leanspan.plans.tools import Tools, answer, make_tables

TREE = {
    "app/src/store.py": "import os\n\n\nclass Store:\n    def read_page(self, n):\n        # the cursor overflows here\n        return self.pages[n]\n", "app/src/use.py": "from store import Store\n\n\ndef run():\n    return Store().read_page(1)\n",
    "app/conf.json": '{"a": {"b": [1, 2, 3]}, "name": "x"}\n', "app/README.md": "# App\n\nReads pages.\n", "node_modules/x/y.js": "function z() {}\n", "app/blob.bin": "\0\1",
}


@pytest.fixture(scope="module")
def tools(spark, tmp_path_factory):
    root, out = tmp_path_factory.mktemp("tree"), str(tmp_path_factory.mktemp("tables"))
    for p, text in TREE.items():
        (root / p).parent.mkdir(parents=True, exist_ok=True)
        (root / p).write_text(text)
    made = make_tables(spark, str(root), out)
    assert made == {"seen": 6, "files": 4, "chunks": 4, "symbols": 3}
    return Tools(spark, out)


def test_files_and_status(tools):
    assert [r["path"] for r in tools.files(["**/*.py"])["rows"]] == ["app/src/store.py", "app/src/use.py"]
    page = tools.files(limit=2)
    assert page["total"] == 4 and page["truncated"] and [r["path"] for r in tools.files(after=page["rows"][-1]["path"])["rows"]] == ["app/src/store.py", "app/src/use.py"]
    assert tools.files(like="strpy")["rows"][0]["path"] == "app/src/store.py"
    assert tools.status()["languages"] == {"python": 2, "markdown": 1, "none": 1}


def test_search_read_outline(tools):
    got = tools.search("read_page")
    assert got["mode"] == "identifier" and got["rows"][0]["kind"] == "definition" and got["rows"][0]["path"] == "app/src/store.py" and got["coverage"]["reference"]["total"] == 1
    assert [r["path"] for r in tools.search("cursor overflows")["rows"]] == ["app/src/store.py"] and tools.search("no such text at all")["rows"] == []
    assert tools.read("app/src/store.py", 5, 6)["content"] == "    def read_page(self, n):\n        # the cursor overflows here"
    short = tools.read("app/src/store.py", tokens=8)
    assert short["tokens"] <= 8 and TREE["app/src/store.py"].startswith(short["content"]) and short["next"] is not None and not tools.read("none")["found"]
    names = [r["name"] for r in tools.outline(["app/src/store.py", "app/src/use.py"])["rows"]]
    assert names == ["Store", "read_page", "run"]
    tight = tools.outline(["app/src/store.py", "app/src/use.py"], tokens=5)
    assert tight["skipped"] >= 1 and tight["tokens_left"] >= 0


def test_json_context_rebase(tools):
    assert tools.json("app/conf.json", pointer="/a/b/1")["value"] == 2 and tools.json("app/conf.json", select="a.b[*]")["value"] == [1, 2, 3]
    assert tools.json("app/conf.json", pointer="/none")["missing"] == "/none" and "error" in tools.json("app/README.md") and {"pointer": "/name", "type": "string"} in tools.json("app/conf.json", view="keys")["keys"]
    made = tools.context("Fix the cursor overflow in read_page", demand=Demand(paths=("app/README.md",)))
    paths = [f["path"] for f in made["fragments"]]
    assert paths[0] == "app/README.md" and "app/src/store.py" in paths and made["tokens"]["source"] == sum(f["token_count"] for f in made["fragments"])
    e = [{"evidence_id": 1, "path": "app/README.md", "a": 1, "b": 1, "content": "# App\n"}, {"evidence_id": 2, "path": "app/README.md", "a": 1, "b": 1, "content": "# Old\n"}, {"evidence_id": 3, "path": "gone", "a": 1, "b": 1, "content": "x"}]
    assert tools.receipt_rebase(e)["outcomes"] == {1: "carried", 2: "changed", 3: "missing"}


def test_history_and_savings(spark, tools):
    rows = [("p", "Modified ", "2024-01-02 00:00:00"), ("p", "modified", "2024-01-02 00:00:00"), ("p", "created", "2024-01-01 00:00:00"), ("q", "created", "2024-01-01 00:00:00")]
    spark.createDataFrame(rows, "path string, kind string, ts string").selectExpr("path", "kind", "to_timestamp(ts) ts").write.parquet(f"{tools.directory}/changes.parquet")
    assert [r["kind"] for r in tools.history("p")["rows"]] == ["modified", "created"]
    usage = spark.createDataFrame([("search", 5), ("search", 7), ("read", 1)], "tool string, tokens long")
    assert {r["tool"]: r["tokens"] for r in tools.savings(usage, ["tool"], ["tokens"])["rows"]} == {"search": 12, "read": 1}


def test_answers_and_command_line(spark, tools, capsys):
    assert json.loads(answer(tools, "read", {"path": "app/README.md"}))["found"] and "error" in json.loads(answer(tools, "rm", {})) and "error" in json.loads(answer(tools, "read", {"no": 1})) and "error" in json.loads(answer(tools, "search", {"query": "x", "mode": "no"}))
    assert arguments_of(["a=1", 'b=["x"]', "c=plain text"]) == {"a": 1, "b": ["x"], "c": "plain text"}
    assert main(["ask", tools.directory, "files", 'include=["**/*.md"]'], spark) == 0 and json.loads(capsys.readouterr().out)["total"] == 1
    assert main(["query", tools.directory, "symbol_kinds"], spark) == 0 and {r["kind"] for r in json.loads(capsys.readouterr().out)} == {"class", "method", "function"}
    assert main(["query", tools.directory, "none"], spark) == 2
