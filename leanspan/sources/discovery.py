"""Reading source trees and writing responses."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leanspan.functions.text import extension, fingerprint, language_of, path_filter

# Directories that hold generated or foreign files.
PRUNED = ("node_modules", "target", "dist", "build", "vendor", ".git", "__pycache__", ".venv", "venv", "coverage", ".next", "out")
MAX_FILE_BYTES = 2 * 1024 * 1024


def discover(spark: SparkSession, root: str, include: list[str] = (), exclude: list[str] = (), pruned: tuple[str, ...] = PRUNED, max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """path, size_bytes, status (indexed, oversized, binary, pruned), language, content, content_hash of every file below a directory.

    The listing carries sizes, so content that is not wanted is not kept; pruning and
    scope are predicates on the path.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/")
    path = F.regexp_replace(F.regexp_replace("path", r"^file:/*", "/"), "^" + base.replace("\\", "\\\\") + "/", "")
    f = files.select(path.alias("path"), F.col("length").alias("size_bytes"), "content").filter(path_filter("path", include, exclude))
    cut = F.col("path").rlike(r"(^|/)(" + "|".join(x.replace(".", r"\.") for x in pruned) + r")/")
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string"))
    control = F.regexp_count(text, F.lit(r"[\x01-\x08\x0b\x0c\x0e-\x1f\x7f]"))
    binary = text.isNull() | text.contains("\0") | (control * 10 > F.col("size_bytes") * 3)
    status = F.when(cut, "pruned").when(F.col("size_bytes") > max_bytes, "oversized").when(binary, "binary").otherwise("indexed")
    out = f.withColumn("status", status).withColumn("text", F.when(F.col("status") == "indexed", text))
    return out.select("path", "size_bytes", "status", language_of("path").alias("language"), extension("path").alias("extension"), F.col("text").alias("content"), fingerprint("text").alias("content_hash"))


def read_lines(files: DataFrame, path: str, first: int, last: int) -> DataFrame:
    """path, first, last, content of a range of lines, both ends included and clamped to the file."""
    lines = F.split("content", "\n")
    n = F.size(lines) - F.when(F.col("content").endswith("\n"), 1).otherwise(0)
    a, b = F.least(F.lit(max(1, first)), n), F.least(F.lit(max(first, last, 1)), n)
    return files.filter(F.col("path") == path).select("path", a.alias("first"), b.alias("last"), F.array_join(F.slice(lines, a, b - a + 1), "\n").alias("content"))


def page_after(df: DataFrame, key: str, after, size: int) -> DataFrame:
    """Keyset page: rows with a greater key, in order."""
    return (df if after is None else df.filter(F.col(key) > F.lit(after))).orderBy(key).limit(size)


def to_markdown(df: DataFrame, most: int = 100) -> str:
    """A small result as a Markdown table."""
    rows = df.limit(most).collect()
    cell = lambda v: str(v).replace("|", "\\|").replace("\n", " ")
    return "\n".join(["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns), *("| " + " | ".join(map(cell, r)) + " |" for r in rows)])


def to_json(df: DataFrame, most: int = 100) -> str:
    """A small result as a JSON list."""
    return json.dumps([json.loads(x) for x in df.limit(most).toJSON().collect()], sort_keys=True)
