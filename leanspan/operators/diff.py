"""Change sets, relocations, symbol changes and text deltas."""

from __future__ import annotations

import difflib
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leanspan.functions.text import fingerprint, path_class, source_stem
from leanspan.functions.tokens import estimate_py

from .derive import latest
from .joins import overlap_join, unique_key_join


def change_set(before: DataFrame, after: DataFrame, key: str, state: list[str]) -> DataFrame:
    """key, status: created, deleted, modified or unchanged, by comparing the state columns null-safely."""
    a = before.select(key, F.struct(*state).alias("old"), F.lit(True).alias("had"))
    b = after.select(key, F.struct(*state).alias("new"), F.lit(True).alias("has"))
    j = a.join(b, key, "full")
    status = F.when(F.col("had").isNull(), "created").when(F.col("has").isNull(), "deleted").when(F.col("old").eqNullSafe(F.col("new")), "unchanged").otherwise("modified")
    return j.select(key, status.alias("status"))


def relocations(deleted: DataFrame, created: DataFrame, keys: list[str], path: str = "path") -> DataFrame:
    """before, after: paths whose (hash, size, language) is unique on both sides."""
    return unique_key_join(deleted, created, keys, path)


def latest_changes(changes: DataFrame) -> DataFrame:
    """path, kind, ts: the last change of each path; kinds are spelled alike and equal rows count once."""
    c = changes.filter("path is not null and ts is not null").select("path", F.lower(F.trim("kind")).alias("kind"), "ts").distinct()
    return latest(c, ["path"], [F.col("ts"), F.col("kind")])


def symbol_changes(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Symbols by identity: added, removed, modified (signature or body), unchanged; identities that occur twice on a side are ambiguous.

    Both sides: keys, signature, body.
    """
    def side(df: DataFrame, p: str) -> DataFrame:
        return df.groupBy(*keys).agg(F.count("*").alias(f"{p}_n"), F.min("signature").alias(f"{p}_signature"), F.min("body").alias(f"{p}_body"))

    j = side(before, "old").join(side(after, "new"), keys, "full")
    norm = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " ")
    change = (
        F.when((F.coalesce("old_n", F.lit(0)) > 1) | (F.coalesce("new_n", F.lit(0)) > 1), "ambiguous").when(F.col("old_n").isNull(), "added").when(F.col("new_n").isNull(), "removed")
        .when(norm(F.col("old_signature")) != norm(F.col("new_signature")), "modified_signature").when(~F.col("old_body").eqNullSafe(F.col("new_body")), "modified_body").otherwise("unchanged")
    )
    return j.select(*keys, "old_signature", "new_signature", "old_body", "new_body", change.alias("change"))


def body_fingerprint(content: F.Column, signature: F.Column) -> F.Column:
    """The fingerprint of a symbol's code with blanks made one, without its signature if it begins with that; null for an empty body."""
    one = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    text, head = one(content), F.coalesce(one(signature), F.lit(""))
    body = F.trim(F.when(F.startswith(text, head), F.substring(text, F.length(head) + 1, F.length(text))).otherwise(text))
    return F.when(body != "", fingerprint(body))


def renames(changes: DataFrame, kind: str | list[str] = "kind", name: str = "name") -> DataFrame:
    """old_name, new_name of removed and added symbols whose (kind, body) is unique on both sides; kind may be several columns."""
    kinds = [kind] if isinstance(kind, str) else kind
    gone = changes.filter("change = 'removed' and old_body is not null").select(*kinds, F.col("old_body").alias("body"), name)
    come = changes.filter("change = 'added' and new_body is not null").select(*kinds, F.col("new_body").alias("body"), name)
    return unique_key_join(gone, come, [*kinds, "body"], name).filter("before <> after").select(*kinds, F.col("before").alias("old_name"), F.col("after").alias("new_name"))


def is_public(signature: str) -> F.Column:
    """Whether a signature declares something public in its own words."""
    return F.coalesce(F.col(signature).rlike(r"^\s*(pub\b(?!\()|public\b|export\b)"), F.lit(False))


def hunk_symbols(hunks: DataFrame, symbols: DataFrame) -> DataFrame:
    """Symbols that a hunk (path, a, b lines) touches; a path without hunks touches all its symbols."""
    s = symbols.withColumnRenamed("start_line", "c").withColumnRenamed("end_line", "d")
    ranged = overlap_join(hunks.filter("a is not null and b is not null"), s, "path").select("path", "name", "kind")
    whole = hunks.groupBy("path").agg(F.count("a").alias("n")).filter("n = 0").select("path").join(s, "path").select("path", "name", "kind")
    return ranged.unionByName(whole).distinct()


def hunks_of(diffs: DataFrame, text: str = "diff") -> DataFrame:
    """path, a, b: the changed line ranges of the new side of unified diffs, in the JVM."""
    # one part per file of the diff, then its hunk headers
    parts = diffs.select(F.explode(F.split(text, r"(?m)^diff --git ")).alias("part")).filter(F.col("part") != "")
    path = F.regexp_extract("part", r"(?m)^\+\+\+ (?:b/)?([^\t\r\n]+)", 1)
    heads = parts.select(path.alias("path"), F.explode_outer(F.expr(r"regexp_extract_all(part, '(?m)^@@ -\\d+(?:,\\d+)? \\+(\\d+(?:,\\d+)?) @@', 1)")).alias("h")).filter("path <> '' and path <> '/dev/null'")
    start = F.split("h", ",")[0].cast("long")
    count = F.coalesce(F.get(F.split("h", ","), F.lit(1)).cast("long"), F.when(F.col("h").isNotNull(), F.lit(1)))
    return heads.select("path", start.alias("a"), (start + F.greatest(count, F.lit(1)) - 1).alias("b"))


def owner_tests(files: DataFrame) -> DataFrame:
    """path, test, affinity: production files and the tests of their repository that name them.

    4: the same stem in the same folder; 2: the same stem elsewhere (of four letters or
    more); 1: the owner's stem, of three letters or more, stands in the test's as whole
    words.  Tests offer every run of the words of their stems, so both sides meet by
    equality of repository and run.
    """
    f = files.filter("path is not null").select("path", F.split("path", "/")[0].alias("repository"), F.regexp_replace("path", r"/[^/]*$", "").alias("directory"), source_stem("path").alias("stem"), path_class("path").alias("class"))
    owners = f.filter((F.col("class") == "production") & (F.length("stem") > 0))
    words = F.filter(F.split("stem", r"[_.\-]+"), lambda w: w != "")
    n = F.size("words")
    starts = F.sequence(F.lit(1), F.greatest(n, F.lit(1)))
    runs = F.flatten(F.transform(starts, lambda a: F.transform(F.sequence(a, F.greatest(n, F.lit(1))), lambda b: F.array_join(F.slice("words", a, b - a + 1), "_"))))
    tests = f.filter("class = 'test'").select(F.col("path").alias("test"), "repository", F.col("directory").alias("test_directory"), F.col("stem").alias("test_stem"), words.alias("words"))
    offers = tests.select("test", "repository", "test_directory", "test_stem", F.explode(F.array_distinct(F.concat(F.array("test_stem"), runs))).alias("key"))
    j = owners.withColumn("key", F.when(F.col("stem").rlike(r"[_.\-]"), F.regexp_replace("stem", r"[_.\-]+", "_")).otherwise(F.col("stem"))).join(offers, ["repository", "key"])
    same = F.col("stem") == F.col("test_stem")
    affinity = F.when(same & (F.col("directory") == F.col("test_directory")), 4).when(same & (F.length("stem") >= 4), 2).when(~same & (F.length("stem") >= 3), 1).otherwise(0)
    return j.groupBy("path", "test").agg(F.max(affinity).alias("affinity")).filter("affinity > 0")


def read_delta(old: str | None, new: str, name: str = "file", context: int = 3) -> tuple[str, str]:
    """(kind, text): not_modified, a unified delta if it is smaller in tokens, or the full text."""
    if old is not None and old == new:
        return "not_modified", ""
    if old is not None:
        delta = "".join(difflib.unified_diff(old.splitlines(True), new.splitlines(True), name, name, n=context))
        if estimate_py(delta) < estimate_py(new):
            return "delta", delta
    return "full", new


def apply_delta(old: str, delta: str) -> str:
    """The new text that a unified delta makes of the old."""
    lines, out, at = old.splitlines(True), [], 0
    rows = delta.splitlines(True)[2:]
    for row in rows:
        if m := re.match(r"@@ -(\d+)(?:,(\d+))? ", row):
            start = int(m[1]) - (0 if m[2] == "0" else 1)
            out += lines[at:start]
            at = start
        elif row.startswith("-"):
            at += 1
        elif row.startswith("+"):
            out.append(row[1:])
        else:
            out.append(lines[at])
            at += 1
    return "".join(out + lines[at:])
