"""What a change brings along: configuration keys, the tests of its owners, related places, and bounded batches."""

from __future__ import annotations

import json
import re
import tomllib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leanspan.functions.text import path_class
from leanspan.operators.joins import overlap_join
from leanspan.operators.serving import capped

TARGETS_MOST, TARGETS_PAGE = 64, 32
RELATIONS = ("reference", "importer", "test_name_match")
#: seconds: the first and the longest wait after failures, after full passes, and what counts as stable
RETRY, COOLDOWN, STABLE = (0.5, 30.0), (1.0, 30.0), 60.0


def flatten(value, at: str = "") -> Iterator[tuple[str, str]]:
    """(key path, value as JSON) of every leaf; empty containers are leaves."""
    items = value.items() if isinstance(value, dict) else enumerate(value) if isinstance(value, list) else ()
    if not isinstance(value, (dict, list)) or not value:
        yield at or "/", json.dumps(value, sort_keys=True, default=str, ensure_ascii=False)
        return
    for k, v in items:
        yield from flatten(v, f"{at}/{str(k).replace('~', '~0').replace('/', '~1')}")


def settings_of(text: str, path: str) -> list[tuple[str, str]] | None:
    """The settings of a configuration text, or None if it does not parse or is of no known form."""
    low = path.lower()
    try:
        if low.endswith(".json"):
            return list(flatten(json.loads(text)))
        if low.endswith(".toml"):
            return list(flatten(tomllib.loads(text)))
    except (ValueError, RecursionError):
        return None
    if not re.search(r"\.(?:ini|cfg|properties|env|conf)$|(?:^|/)\.env[\w.]*$", low):
        return None
    out, section = {}, ""
    for line in text.splitlines():
        bare = line.strip()
        if m := re.fullmatch(r"\[([^\]]+)\]", bare):
            section = "/" + m[1].strip()
        elif bare and bare[0] not in "#;!" and (m := re.match(r"(?:export\s+)?([^=:\s]+)\s*[=:]\s*(.*)$", bare)):
            out[f"{section}/{m[1]}"] = json.dumps(m[2].strip().strip("\"'"), ensure_ascii=False)
    return list(out.items())


def settings(files: DataFrame) -> DataFrame:
    """path, key, value of configuration files; one that does not parse gives the key ``!`` and no value."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, text in zip(batch["path"], batch["content"]):
                found = settings_of(text, path)
                rows += [(path, k, v) for k, v in found] if found is not None else [(path, "!", None)]
            yield pd.DataFrame(rows, columns=["path", "key", "value"])

    likely = files.filter(F.col("path").rlike(r"(?i)\.(json|toml|ini|cfg|properties|env|conf)$|(^|/)\.env[\w.]*$") & F.col("content").isNotNull())
    return likely.select("path", "content").mapInPandas(run, "path string, key string, value string")


def config_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """path, key, status (added, removed, changed, unparsed), old, new; equal settings give no row."""
    a = settings(before).select("path", "key", F.col("value").alias("old"), F.lit(True).alias("had"))
    b = settings(after).select("path", "key", F.col("value").alias("new"), F.lit(True).alias("has"))
    j = a.join(b, ["path", "key"], "full").filter(~(F.col("old").eqNullSafe(F.col("new")) & (F.col("key") != "!")))
    status = F.when(F.col("key") == "!", "unparsed").when(F.col("had").isNull(), "added").when(F.col("has").isNull(), "removed").otherwise("changed")
    return j.select("path", "key", status.alias("status"), "old", "new")


def owner_coverage(changed: DataFrame, tests: DataFrame) -> DataFrame:
    """path, status (found, missing, unknown), tests of changed paths; what is no production code has no owner test to miss.

    tests: path, test, affinity as :func:`leanspan.operators.diff.owner_tests` gives them.
    """
    n = tests.groupBy("path").agg(F.countDistinct("test").alias("tests"))
    j = changed.select("path").distinct().join(n, "path", "left").withColumn("tests", F.coalesce("tests", F.lit(0)))
    return j.select("path", F.when(path_class("path") != "production", "unknown").when(F.col("tests") > 0, "found").otherwise("missing").alias("status"), "tests")


def diff_evidence(hunks: DataFrame, symbols: DataFrame, references: DataFrame, edges: DataFrame, tests: DataFrame, files: DataFrame) -> DataFrame:
    """path, relation, evidence_path, line, name: symbols that hunks touch and the places related to them; gaps have no evidence_path.

    hunks: path, a, b; symbols: path, name, kind, lines; references: path, line, name of
    calls; edges: path, resolved_path, line; tests: path, test.
    """
    s = symbols.select("path", "name", F.col("start_line").alias("c"), F.col("end_line").alias("d"))
    touched = overlap_join(hunks.filter("a is not null and b is not null"), s, "path").select("path", "name", F.col("c").alias("line")).distinct()
    none = F.lit(None).cast("string")
    own = touched.select("path", F.lit("symbol").alias("relation"), F.col("path").alias("evidence_path"), F.col("line").cast("long").alias("line"), "name")
    calls = touched.select("path", "name").join(references.select(F.col("path").alias("evidence_path"), F.col("line").cast("long").alias("line"), "name"), "name").filter("evidence_path <> path").select("path", F.lit("reference").alias("relation"), "evidence_path", "line", "name")
    changed = hunks.select("path").distinct()
    importers = changed.join(edges.select(F.col("resolved_path").alias("path"), F.col("path").alias("evidence_path"), F.col("line").cast("long").alias("line")), "path").select("path", F.lit("importer").alias("relation"), "evidence_path", "line", none.alias("name"))
    named = changed.join(tests.select("path", F.col("test").alias("evidence_path")), "path").select("path", F.lit("test_name_match").alias("relation"), "evidence_path", F.lit(None).cast("long").alias("line"), none.alias("name"))
    found = own.unionByName(calls).unionByName(importers).unionByName(named).distinct()
    wanted = changed.join(files.select("path").distinct(), "path", "left_semi").select("path", F.explode(F.array(*map(F.lit, RELATIONS))).alias("relation"))
    gaps = wanted.join(found.select("path", "relation").distinct(), ["path", "relation"], "left_anti").select("path", "relation", none.alias("evidence_path"), F.lit(None).cast("long").alias("line"), none.alias("name"))
    return found.unionByName(gaps)


def batch(changes: DataFrame, targets: DataFrame, keys: list[str], page: int = 0) -> DataFrame:
    """The changes of a page of at most TARGETS_PAGE targets; more than TARGETS_MOST targets are an error, not a cut."""
    whole = capped(targets.select(*keys).distinct(), TARGETS_MOST, "targets")
    # at most TARGETS_MOST rows
    numbered = whole.orderBy(*keys).limit(TARGETS_PAGE * (page + 1)).exceptAll(whole.orderBy(*keys).limit(TARGETS_PAGE * page))
    return numbered.join(changes, keys, "left").withColumn("change", F.coalesce("change", F.lit("not_found")))


def structural_match(symbols: DataFrame, imports: DataFrame, requests: DataFrame, most: int = 64) -> DataFrame:
    """request_id, status (same, changed, unknown): whether the symbols and imports of exact ranges have the recorded hash.

    symbols and imports: path, start_line, end_line, hash; requests: request_id, path,
    start_line, end_line, hash.  More than ``most`` rows at a range are unknown.
    """
    key = ["path", "start_line", "end_line"]
    both = symbols.select(*key, "hash").unionByName(imports.select(*key, "hash"))
    at = requests.select("request_id", *key, F.col("hash").alias("recorded")).join(both, key, "left")
    g = at.groupBy("request_id").agg(F.count("hash").alias("n"), F.max((F.col("hash") == F.col("recorded")).cast("int")).alias("same"))
    return g.select("request_id", F.when((F.col("n") > most) | (F.col("n") == 0), "unknown").when(F.col("same") == 1, "same").otherwise("changed").alias("status"))


def wait(attempts: int, bounds: tuple[float, float] = RETRY) -> float:
    """Seconds to wait after so many attempts in a row: doubled each time, within the bounds."""
    return 0.0 if attempts <= 0 else min(bounds[1], bounds[0] * 2.0 ** min(attempts - 1, 60))


def waits(passes: DataFrame) -> DataFrame:
    """source, ts, ok, full, retry_after, full_after: how long each pass over a source has the next one wait.

    passes: source, ts, ok, full.  Failures in a row double the retry; full passes in a
    row double the cooldown; STABLE quiet seconds, or a good targeted pass, begin anew.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        rows, failed, full, last = [], 0, 0, None
        for r in frame.sort_values(["ts", "ok", "full"]).itertuples(index=False):
            if last is not None and (r.ts - last).total_seconds() >= STABLE:
                failed = full = 0
            failed = 0 if r.ok else failed + 1
            full = full + 1 if r.full else 0
            rows.append((r.source, r.ts, r.ok, r.full, wait(failed), wait(full, COOLDOWN)))
            last = r.ts
        return pd.DataFrame(rows, columns=["source", "ts", "ok", "full", "retry_after", "full_after"])

    return passes.groupBy("source").applyInPandas(run, "source string, ts timestamp, ok boolean, full boolean, retry_after double, full_after double")


def bpe_tokens(text: str | Column, ranks_file: str, pattern: str) -> Column:
    """Exact token counts by a vocabulary of ranks; the file's place is the caller's and must be readable on every executor."""

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        from leanspan.operators.serving import bpe_counter

        n = bpe_counter(ranks_file, pattern)
        return pd.Series([None if t is None else n(t) for t in texts], dtype="Int64")

    return count(F.col(text) if isinstance(text, str) else text)
