"""Source files that do not parse (problem 4).

Each file with a known programming language is recognised by the generalised LL parser
of :mod:`gll` under the grammar of its language, in which the dialects stand side by
side and are followed together; for C++ the preprocessor's alternatives are tried as
dialects too (all branches, then only the first or the last of each).  A file that
every dialect rejects does not parse.  A leading byte order mark is no part of it.

Defined results: null ids, null contents, null and other languages are not judged;
empty and blank files parse where the language allows an empty unit (a Go file needs
its package clause); very long files are judged whole; equal rows count once; extra
columns are ignored.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .languages import LANGUAGES, language

VERDICT_SCHEMA = "file_id long, parses boolean"

_DIRECTIVE = re.compile(r"^[ \t]*#[ \t]*(ifdef|ifndef|if|elif|else|endif)\b")


def _branches(text: str, last: bool) -> str:
    """A C++ text with only the first (or last) branch of every preprocessor conditional."""
    out: list[str] = []
    stack: list[list[int]] = []  # for each open conditional: where its branches begin in out
    for line in text.split("\n"):
        m = _DIRECTIVE.match(line)
        if not m:
            out.append(line)
            continue
        if m[1] in ("if", "ifdef", "ifndef"):
            stack.append([len(out)])
        elif m[1] in ("elif", "else"):
            if stack:
                stack[-1].append(len(out))
        elif stack:
            starts = stack.pop()
            if len(starts) > 1:
                keep = out[starts[-1]:] if last else out[starts[0]: starts[1]]
                del out[starts[0]:]
                out += keep
    return "\n".join(out)


def parses(text: str, name: str) -> bool:
    """Whether some dialect of the language derives the whole text."""
    lang = language(name)
    text = text.removeprefix("﻿")
    if lang.parses(text):
        return True
    if name == "cpp" and re.search(r"(?m)^[ \t]*#[ \t]*el(?:se|if)", text):
        return lang.parses(_branches(text, False)) or lang.parses(_branches(text, True))
    return False


def judge(files: DataFrame) -> DataFrame:
    """VERDICT_SCHEMA for every file that is judged; no shuffle, one row in and one out."""
    known = files.filter(F.col("id").isNotNull() & F.col("content").isNotNull() & F.col("language").isin(*LANGUAGES)).select("id", "language", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sys.setrecursionlimit(20_000)
        for batch in batches:
            yield pd.DataFrame({"file_id": batch["id"], "parses": [parses(t, n) for t, n in zip(batch["content"], batch["language"])]})

    return known.mapInPandas(run, VERDICT_SCHEMA)


def unparsed(files: DataFrame) -> DataFrame:
    """file_id of the files that every dialect rejects, once each."""
    return judge(files).filter(~F.col("parses")).select("file_id").distinct()


def rates(files: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """By repository and language: files judged, rejected and their rate, beside the older
    indexer's flag and its totals.

    Verdicts join the files' small columns by id; the totals are deduplicated and summed
    over source shapes first.  A pair that only one side has is kept, with nulls.
    """
    ok = judge(files).groupBy("file_id").agg(F.max("parses").alias("parses"))
    meta = files.filter(F.col("language").isin(*LANGUAGES)).select(F.col("id").alias("file_id"), "repository", "language", "structurally_complete").dropDuplicates(["file_id"])
    ours = meta.join(ok, "file_id").groupBy("repository", "language").agg(
        F.count("*").alias("files"), F.sum((~F.col("parses")).cast("long")).alias("unparsed"), F.sum((~F.col("structurally_complete")).cast("long")).alias("recorded_incomplete"),
        F.sum((~F.col("parses") & ~F.col("structurally_complete")).cast("long")).alias("both"),
    )
    old = diagnostics.select("revision", "repository", "language", "source_shape", "counts.*").distinct().filter(F.col("language").isin(*LANGUAGES)).groupBy("repository", "language").agg(
        F.sum("files").alias("diagnosed_files"), F.sum("incomplete_files").alias("diagnosed_incomplete"), F.sum("error_nodes").alias("error_nodes"), F.sum("missing_nodes").alias("missing_nodes"))
    both = ours.join(old, ["repository", "language"], "full")
    return both.withColumn("unparsed_rate", F.round(F.col("unparsed") / F.col("files"), 6)).withColumn("diagnosed_rate", F.when(F.col("diagnosed_files") > 0, F.round(F.col("diagnosed_incomplete") / F.col("diagnosed_files"), 6)))
