"""The engine as tools: one call a question, bounded answers with their totals; and tables made from a source tree.

Tables live in a directory: files, chunks and symbols, and where there are some, changes
and usage.  Answers are plain dictionaries.  Lists are cut to a page on purpose, and every
answer says how much there is in all; what is above a hard limit is an error.
"""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leanspan.functions.text import language_of, path_filter
from leanspan.functions.tokens import estimate_py
from leanspan.operators import aggregates, derive, jsonops, ranking, receipts, search, serving, symbols
from leanspan.sources import discovery
from leanspan.sources.index import index_of
from leanspan.sources.tables import table

from .context import BUDGET, Demand, context

# Results of a page and at most, tokens of a reading, of a context and at most.
RESULTS, RESULTS_MOST, READ_TOKENS, TOKENS_MOST = 20, 100, 8000, 32_000


def make_tables(spark: SparkSession, root: str, out: str, include: list[str] = (), exclude: list[str] = ()) -> dict[str, int]:
    """Files, chunks and symbols of a source tree, written below ``out``; ids are hashes, so the same tree gives the same rows."""
    positive = lambda *c: F.xxhash64(*c).bitwiseAND(F.lit((1 << 63) - 1))
    found = discovery.discover(spark, root, list(include), list(exclude))
    files = found.filter("status = 'indexed'").select(positive("path").alias("id"), F.split("path", "/")[0].alias("repository"), "path", "language", F.lit(True).alias("structurally_complete"), F.col("size_bytes").cast("long").alias("size_bytes"), "content", "content_hash", F.lit(1).cast("long").alias("generation"))
    files.write.mode("overwrite").parquet(f"{out}/files.parquet")
    stored = spark.read.parquet(f"{out}/files.parquet")
    derive.chunk_files(stored).withColumn("id", positive("file_id", "ordinal")).drop("ordinal").write.mode("overwrite").parquet(f"{out}/chunks.parquet")
    s = symbols.extract_symbols(stored).withColumn("id", positive("file_id", "start_byte", "kind", "name"))
    owners = derive.parents_by_containment(s).select("id", F.col("container").alias("parent"))
    s.join(owners, "id", "left").write.mode("overwrite").parquet(f"{out}/symbols.parquet")
    return {"seen": found.count(), **{n: spark.read.parquet(f"{out}/{n}.parquet").count() for n in ("files", "chunks", "symbols")}}


class Tools:
    """Nine tools over the tables of a directory, and what is known of it."""

    def __init__(self, spark: SparkSession, directory: str):
        self.spark, self.directory = spark, directory.rstrip("/")

    def _table(self, name: str) -> DataFrame:
        return table(self.spark, self.directory, name)

    def _page(self, df: DataFrame, limit: int | None) -> dict[str, Any]:
        n = serving.clamp(limit, RESULTS, RESULTS_MOST)
        rows = [r.asDict(recursive=True) for r in df.limit(n).collect()]
        total = df.count()
        return {"rows": rows, "total": total, "truncated": total > len(rows)}

    def files(self, include: list[str] = (), exclude: list[str] = (), like: str | None = None, after: str | None = None, limit: int | None = None) -> dict[str, Any]:
        """Paths by globs, or the nearest to a few letters of one; further pages begin after a path."""
        if like:
            from leanspan.operators.retrieval import fuzzy_find

            return self._page(fuzzy_find(self._table("files"), like, RESULTS_MOST), limit)
        f = self._table("files").filter(path_filter("path", list(include), list(exclude))).select("path", "language", "size_bytes")
        if after is not None:
            f = f.filter(F.col("path") > after)
        return self._page(f.orderBy("path"), limit)

    def search(self, query: str, mode: str = "auto", include: list[str] = (), exclude: list[str] = (), focus: list[str] = (), case_sensitive: bool = False, limit: int | None = None) -> dict[str, Any]:
        """Ordered hits, with the totals of each kind."""
        refs = symbols.references(self._table("files")) if search.route(query, mode)[0] in ("identifier", "reference") else None
        hits = search.search(index_of(self.spark, self.directory), self._table("symbols"), self._table("files"), query, mode, list(include), list(exclude), list(focus), case_sensitive, refs)
        page = search.ordered(hits, serving.clamp(limit, RESULTS, RESULTS_MOST))
        rows = [r.asDict(recursive=True) for r in page.orderBy("position").collect()]
        got: dict[str, int] = {}
        for r in rows:
            got[r["kind"]] = got.get(r["kind"], 0) + 1
        totals = {r["kind"]: r["count"] for r in hits.groupBy("kind").count().collect()}
        return {"mode": search.route(query, mode)[0], "rows": rows, "coverage": {k: {"total": n, "returned": got.get(k, 0), "truncated": got.get(k, 0) < n} for k, n in sorted(totals.items())}}

    def outline(self, paths: list[str], tokens: int | None = None) -> dict[str, Any]:
        """Symbols of files in order, all files sharing one budget; what does not fit is skipped and counted."""
        left = serving.clamp(tokens, READ_TOKENS, TOKENS_MOST)
        f = self._table("files").filter(F.col("path").isin(list(paths))).select(F.col("id").alias("file_id"), "path")
        s = self._table("symbols").dropDuplicates(["id"]).join(F.broadcast(f), "file_id").orderBy("path", "start_line", "id").select("path", "name", "kind", "signature", "start_line", "end_line")
        rows, skipped = [], 0
        for r in s.toLocalIterator():
            cost = estimate_py(f"{r['kind']} {r['signature'] or r['name']}")
            if cost <= left:
                left -= cost
                rows.append(r.asDict())
            else:
                skipped += 1
        return {"rows": rows, "skipped": skipped, "tokens_left": left}

    def read(self, path: str, first: int = 1, last: int = 1 << 30, tokens: int | None = None) -> dict[str, Any]:
        """Lines of a file within a token budget; ``next`` is where a further reading begins."""
        got = discovery.read_lines(self._table("files"), path, first, last).collect()
        if not got:
            return {"path": path, "found": False}
        text, used = serving.truncate(got[0]["content"], serving.clamp(tokens, READ_TOKENS, TOKENS_MOST))
        whole = text == got[0]["content"]
        lines = text.count("\n")
        return {"path": path, "found": True, "first": got[0]["first"], "last": got[0]["last"] if whole else got[0]["first"] + lines, "content": text, "tokens": used, "next": None if whole else got[0]["first"] + lines}

    def history(self, path: str, limit: int | None = None) -> dict[str, Any]:
        """The changes of a path, the latest first; equal deliveries count once."""
        c = self._table("changes").filter(F.col("path") == path).select(F.lower(F.trim("kind")).alias("kind"), F.col("ts").cast("string").alias("ts")).distinct()
        return self._page(c.orderBy(F.desc("ts"), "kind"), limit)

    def json(self, path: str, pointer: str | None = None, select: str | None = None, view: str = "value", items: int = 200) -> dict[str, Any]:
        """A JSON file, or what a pointer or path expression selects of it: its value, keys, schema, a collapsed view or a numeric summary."""
        got = self._table("files").filter(F.col("path") == path).select("content").collect()
        if not got:
            return {"path": path, "found": False}
        value, error = jsonops.load(got[0]["content"])
        if error:
            return {"path": path, "found": True, "error": error}
        if pointer is not None:
            value = jsonops.select_pointer(value, pointer)
            if value is jsonops.MISSING:
                return {"path": path, "found": True, "missing": pointer}
        if select is not None:
            value = jsonops.select_path(value, select)
        views = {"value": lambda: value, "keys": lambda: jsonops.keys(value), "schema": lambda: jsonops.schema(value, items), "collapsed": lambda: jsonops.collapse(value, items, 3)[0], "summary": lambda: jsonops.numeric_summary(value)}
        if view not in views:
            raise ValueError(f"view must be one of {', '.join(views)}")
        return {"path": path, "found": True, view: views[view]()}

    def context(self, task: str, tokens: int | None = None, demand: Demand | None = None) -> dict[str, Any]:
        """The packed context of a task, with its tokens accounted for."""
        x = index_of(self.spark, self.directory)
        rows = context(self.spark, [(1, task)], self._table("files"), x, self._table("symbols"), serving.clamp(tokens, BUDGET, TOKENS_MOST), {1: demand} if demand else None, x.edges).orderBy("ordinal").collect()
        fragments = [{k: r[k] for k in ("path", "start_line", "end_line", "token_count", "score", "content")} for r in rows]
        return serving.response_accounting({"task": task, "fragments": fragments}, [f["content"] for f in fragments])

    def receipt_rebase(self, evidence: list[dict[str, Any]]) -> dict[str, Any]:
        """Of evidence shown earlier (evidence_id, path, a, b, content): carried, changed or missing now."""
        e = self.spark.createDataFrame([(x["evidence_id"], x["path"], x["a"], x["b"], x["content"]) for x in evidence], "evidence_id long, path string, a long, b long, content string")
        return {"outcomes": {r["evidence_id"]: r["outcome"] for r in receipts.rebase(e, self._table("files")).collect()}}

    def savings(self, usage: DataFrame, keys: list[str], sums: list[str]) -> dict[str, Any]:
        """Usage rows rolled up."""
        return {"rows": [r.asDict() for r in aggregates.counters(usage, keys, sums).orderBy(*keys).collect()]}

    def status(self) -> dict[str, Any]:
        """How much there is, and what the parser covered."""
        counts = aggregates.corpus_counts(self._table("files"), self._table("chunks"), self._table("symbols")).first().asDict()
        return counts | {"languages": {r["language"] or "none": r["count"] for r in self._table("files").groupBy(language_of("path").alias("language")).count().collect()}}


def answer(tools: Tools, name: str, arguments: dict[str, Any]) -> str:
    """A tool's answer as JSON; unknown tools and wrong arguments are answers too."""
    known = ("files", "search", "outline", "read", "history", "json", "context", "receipt_rebase", "savings", "status")
    if name not in known:
        return json.dumps({"error": f"no tool {name}", "tools": known})
    try:
        return json.dumps(getattr(tools, name)(**arguments), ensure_ascii=False, default=str, sort_keys=True)
    except (TypeError, ValueError, serving.TooMany, serving.StaleCursor) as e:
        return json.dumps({"error": str(e)})
