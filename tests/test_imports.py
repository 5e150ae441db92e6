"""Imports whose targets exist, in every language, through the registered queries."""

import pytest

from leanspan.plans import queries as Q

FILES = {
    "r/go.mod": "module example.com/r\n\ngo 1.22\n", "r/tools/go.mod": "module example.com/r/tools\n",
    "r/cmd/main.go": 'package main\n\nimport (\n\t"fmt"\n\tst "example.com/r/pkg/store"\n\t"example.com/r/tools/gen"\n\t"example.com/rother/x"\n)\n',
    "r/pkg/store/b.go": "package store\n", "r/pkg/store/a.go": "package store\n", "r/pkg/store/a_test.go": "package store\n", "r/tools/gen/g.go": 'package gen\n\nimport "example.com/r/tools/gen"\n',
    "r/py/app.py": "import os\nfrom .lib import helper\nfrom py.pack import x\n    import lib.deep\n", "r/py/lib.py": "", "r/py/pack/__init__.py": "", "r/py/pack.py": "",
    "r/web/a.ts": 'import { x } from "./b.js";\nexport * from "./dir";\nimport y from "react";\n', "r/web/b.ts": "", "r/web/b.js": "", "r/web/dir/index.ts": "", "r/web/c.js": "const q = require('./b.js');\nimport './dir';\n", "r/web/dir.js": "",
    "r/src/lib.rs": "mod store;\nuse crate::store::Page;\n", "r/src/store.rs": "", "r/java/a/B.java": "import a.C;\nimport java.util.List;\n", "r/java/a/C.java": "",
    "r/cc/m.cc": '#include "util/h.h"\n#include <vector>\n', "r/cc/util/h.h": "", "r/doc/p.html": '<script src="./s.js"></script><a href="./s.js">\n<link href="./s.js?x=1">', "r/doc/s.js": "", "r/doc/t.tex": "\\input{part}\n", "r/doc/part.tex": "",
}
RESOLVED = {
    ("r/cmd/main.go", "example.com/r/pkg/store"): "r/pkg/store/a.go", ("r/cmd/main.go", "example.com/r/tools/gen"): "r/tools/gen/g.go", ("r/tools/gen/g.go", "example.com/r/tools/gen"): "r/tools/gen/g.go",
    ("r/py/app.py", ".lib"): "r/py/lib.py", ("r/py/app.py", "py.pack"): "r/py/pack/__init__.py",
    ("r/web/a.ts", "./b.js"): "r/web/b.ts", ("r/web/a.ts", "./dir"): "r/web/dir.js", ("r/web/c.js", "./b.js"): "r/web/b.js", ("r/web/c.js", "./dir"): "r/web/dir.js",
    ("r/src/lib.rs", "store"): "r/src/store.rs", ("r/src/lib.rs", "crate::store::Page"): "r/src/store.rs", ("r/java/a/B.java", "a.C"): "r/java/a/C.java", ("r/cc/m.cc", "util/h.h"): "r/cc/util/h.h",
    ("r/doc/p.html", "./s.js"): "r/doc/s.js", ("r/doc/t.tex", "part"): "r/doc/part.tex",
}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("imports"))
    rows = [(n, p, t) for n, (p, t) in enumerate(FILES.items())]
    spark.createDataFrame(rows, "id long, path string, content string").write.parquet(f"{d}/files.parquet")
    ids = {p: n for n, p, _ in rows}
    symbols = [(1, ids["r/py/lib.py"], "helper", "function", 0), (2, ids["r/py/lib.py"], "other", "function", 50), (3, ids["r/py/lib.py"], "third", "function", 90), (4, ids["r/src/store.rs"], "Page", "struct", 0), (4, ids["r/src/store.rs"], "Page", "struct", 0)]
    spark.createDataFrame(symbols, "id long, file_id long, name string, kind string, start_byte long").write.parquet(f"{d}/symbols.parquet")
    return d


def test_targets_that_exist_resolve(spark, tables):
    got = {(r["path"], r["raw_target"]): (r["resolved_path"], r["candidates"]) for r in Q.queries()["imports_resolved"](spark, tables).collect()}
    assert {k: got[k][0] for k in RESOLVED} == RESOLVED
    outside = {k for k, (p, _) in got.items() if p is None}
    assert outside >= {("r/cmd/main.go", "fmt"), ("r/cmd/main.go", "example.com/rother/x"), ("r/web/a.ts", "react"), ("r/java/a/B.java", "java.util.List")}
    assert got["r/cmd/main.go", "example.com/r/pkg/store"][1] == ["r/pkg/store/a.go", "r/pkg/store/b.go"]
    assert got["r/web/a.ts", "./b.js"][1][:2] == ["r/web/b.ts", "r/web/b.tsx"]


def test_reverse_imports_and_neighbours(spark, tables):
    q = Q.queries()
    reverse = {r["changed"]: r["importers"] for r in q["reverse_imports"](spark, tables).collect()}
    assert reverse["r/src/store.rs"] == 1 and reverse["r/py/lib.py"] == 1 and reverse["r/web/dir.js"] == 2
    near = sorted((r["path"], r["resolved_path"], r["name"]) for r in q["import_neighbours"](spark, tables).collect())
    assert near == [("r/py/app.py", "r/py/lib.py", "helper"), ("r/py/app.py", "r/py/lib.py", "other"), ("r/src/lib.rs", "r/src/store.rs", "Page"), ("r/src/lib.rs", "r/src/store.rs", "Page")]


def test_owner_tests(spark, tmp_path):
    paths = ["r/src/store.py", "r/src/test_store.py", "r/tests/test_store.py", "r/tests/test_store_cache_limits.py", "r/src/cache.py", "r/src/io.py", "r/tests/test_io.py", "s/tests/test_store.py", "r/tests/test_restored.py"]
    spark.createDataFrame([(p,) for p in paths], "path string").write.parquet(f"{tmp_path}/files.parquet")
    got = sorted((r["path"], r["test"], r["affinity"]) for r in Q.queries()["owner_tests"](spark, str(tmp_path)).collect())
    assert got == [("r/src/cache.py", "r/tests/test_store_cache_limits.py", 1), ("r/src/store.py", "r/src/test_store.py", 4), ("r/src/store.py", "r/tests/test_store.py", 2), ("r/src/store.py", "r/tests/test_store_cache_limits.py", 1)]
