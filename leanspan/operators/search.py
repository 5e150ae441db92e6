"""Search in its modes: routed to the index, scored, merged, ordered, counted and paged.

A hit is a place: path, start_line, end_line, start_byte of the occurrence, kind
(definition, reference or text), kinds (all of a merged hit's), score, name.  Modes:

* symbol: definitions by bare or qualified name; reference: calls of a name;
* identifier: definitions, calls, and texts that hold the word; regex: texts by pattern;
* text: texts by literal; auto: as identifier for one word, else as text.

Literals of three characters or more are looked up by their trigrams, single words by
their postings, shorter ones and patterns without a sure literal by a scan; what is
found is verified on the texts.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leanspan.functions.text import path_filter
from leanspan.sources.index import Index

from .retrieval import required_literals
from .symbols import _CONTROL

MODES = ("auto", "text", "regex", "identifier", "symbol", "reference")
# Scores of the kinds of hits, exact and loose, and what a focus adds.
DEFINITION, REFERENCE, TEXT, FOCUS = (10.0, 7.0), (8.0, 5.0), 3.0, 2.0
HIT = ["path", "start_line", "end_line", "start_byte", "end_byte", "kind", "score", "name"]


def route(query: str, mode: str = "auto") -> tuple[str, str]:
    """(mode, how texts are looked up: none, word, trigram or scan)."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {', '.join(MODES)}")
    word = re.fullmatch(r"[^\W\d]\w*(?:\.[^\W\d]\w*)?", query) is not None
    if mode == "auto":
        mode = "identifier" if word else "text"
    if mode in ("symbol", "reference"):
        return mode, "none"
    if mode == "identifier":
        return mode, "word"
    if mode == "regex":
        return mode, "trigram" if required_literals(query) else "scan"
    return mode, "trigram" if len(query) >= 3 else "scan"


def text_hits(index: Index, query: str, mode: str, how: str, case_sensitive: bool) -> DataFrame:
    """One row for each text that matches: the chunk's columns, occurrences, and bm (between 0 and 1)."""
    if how == "word":
        word = query.rsplit(".", 1)[-1]
        pattern = rf"(?<![\p{{L}}\p{{N}}_]){re.escape(word)}(?![\p{{L}}\p{{N}}_])"
        texts = index.fetch(index.postings([word.lower()]).select("key"))
    elif mode == "regex":
        pattern = query
        plan = required_literals(query, case_sensitive)
        texts = index.fetch(index.matching(plan) if plan and not index.small else None)
    else:
        pattern = r"\Q" + query.replace(r"\E", r"\E\\E\Q") + r"\E"
        texts = index.fetch(index.holding(query) if how == "trigram" and not index.small else None)
    pattern = pattern if case_sensitive else f"(?iu){pattern}"
    n = F.regexp_count("content", F.lit(pattern))
    # the text before the first match; offsets of matches would count UTF-16 units
    hit = texts.withColumn("occurrences", n).filter("occurrences > 0").withColumn("before", F.split("content", pattern, 2)[0])
    # the fourth part of a point at most tells how often a text matches
    return hit.withColumn("bm", F.col("occurrences") / (F.col("occurrences") + 3.0))


def _lines(text: Column) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, "\n", ""))


def search(index: Index, symbols: DataFrame, files: DataFrame, query: str, mode: str = "auto", include: list[str] = (), exclude: list[str] = (), focus: list[str] = (), case_sensitive: bool = False, references: DataFrame | None = None) -> DataFrame:
    """Hits of one query, merged and scored; ordered by the caller's page (:func:`ordered`).

    symbols: id, file_id, name, parent, kind, lines and bytes; files: id, path; references:
    file_id, line, name of calls, only needed in the modes that look for them.
    """
    mode, how = route(query, mode)
    paths = files.filter("id is not null and path is not null").select(F.col("id").alias("file_id"), "path").filter(path_filter("path", list(include), list(exclude))) if include or exclude else files.filter("id is not null and path is not null").select(F.col("id").alias("file_id"), "path")
    bare, _, parent = (query.rpartition(".")[2], *query.rpartition(".")[1::-1])
    found: list[DataFrame] = []
    if mode in ("symbol", "identifier"):
        s = symbols.filter("id is not null").dropDuplicates(["id"])
        exact = (F.col("name") == bare) & (F.col("parent").eqNullSafe(parent) if parent else F.lit(True))
        loose = F.lower("name").contains(bare.lower()) & (F.lower(F.coalesce("parent", F.lit(""))).contains(parent.lower()) if parent else F.lit(True))
        s = s.filter(exact | loose if mode == "symbol" else exact)
        found.append(s.join(paths, "file_id").select("path", "start_line", "end_line", "start_byte", "end_byte", F.lit("definition").alias("kind"), F.when(exact, DEFINITION[0]).otherwise(DEFINITION[1]).alias("score"), "name"))
    if mode in ("reference", "identifier") and references is not None:
        exact = F.col("name") == bare
        r = references.filter(exact | F.lower("name").contains(bare.lower()) if mode == "reference" else exact).distinct()
        none = F.lit(None).cast("long")
        found.append(r.join(paths, "file_id").select("path", F.col("line").alias("start_line"), F.col("line").alias("end_line"), none.alias("start_byte"), none.alias("end_byte"), F.lit("reference").alias("kind"), F.when(exact, REFERENCE[0]).otherwise(REFERENCE[1]).alias("score"), "name"))
    if how != "none":
        t = text_hits(index, query, mode, how, case_sensitive).join(paths, "file_id")
        line = F.col("start_line") + _lines(F.col("before"))
        byte = F.col("start_byte") + F.octet_length("before")
        found.append(t.select("path", line.alias("start_line"), line.alias("end_line"), byte.alias("start_byte"), F.lit(None).cast("long").alias("end_byte"), F.lit("text").alias("kind"), (TEXT + F.col("bm")).alias("score"), F.lit(query).alias("name")))
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    if focus:
        out = out.withColumn("score", F.col("score") + F.when(path_filter("path", list(focus)), FOCUS).otherwise(0.0))
    merged = merge_equal(out)
    return merge_definitions(merged) if mode == "identifier" else merged


def merge_equal(hits: DataFrame) -> DataFrame:
    """Hits of the same place once: the kinds of all, the best score."""
    key = ["path", "start_line", "end_line", "start_byte", "end_byte"]
    return hits.groupBy(*key).agg(F.max_by(F.struct("kind", "name"), "score").alias("best"), F.max("score").alias("score"), F.sort_array(F.collect_set("kind")).alias("kinds")).select(*key, "best.kind", "score", "best.name", "kinds")


def merge_definitions(hits: DataFrame) -> DataFrame:
    """References and texts that begin in the first line of a definition of the same path are that definition."""
    d = hits.filter("kind = 'definition'").groupBy("path", "start_line").agg(F.min_by(F.struct("end_line", "start_byte", "end_byte", "name"), F.struct("end_line", "start_byte")).alias("d"))
    j = hits.filter("kind <> 'definition'").join(d, ["path", "start_line"], "left")
    there = F.col("d").isNotNull()
    moved = j.select("path", "start_line", F.when(there, F.col("d.end_line")).otherwise(F.col("end_line")).alias("end_line"), F.when(there, F.col("d.start_byte")).otherwise(F.col("start_byte")).alias("start_byte"), F.when(there, F.col("d.end_byte")).otherwise(F.col("end_byte")).alias("end_byte"), "kind", "score", "name", "kinds")
    key = ["path", "start_line", "end_line", "start_byte", "end_byte"]
    both = hits.filter("kind = 'definition'").unionByName(moved)
    return both.groupBy(*key).agg(F.max_by(F.struct("kind", "name"), "score").alias("best"), F.max("score").alias("score"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("kinds")))).alias("kinds")).select(*key, "best.kind", "score", "best.name", "kinds")


ORDER = (F.desc, "score"), (F.asc, "path"), (F.asc, "start_line"), (F.asc, "start_byte")


def ordered(hits: DataFrame, limit: int) -> DataFrame:
    """The first hits by score, path, line and place, with their positions and their scores as parts of the best."""
    top = hits.orderBy(*[f(c) for f, c in ORDER]).limit(limit)  # a page is a feature; totals are counted by coverage
    w = Window.orderBy(*[f(c) for f, c in ORDER])
    best = F.max("score").over(Window.partitionBy(F.lit(1)))
    return top.withColumn("position", F.row_number().over(w)).withColumn("relative", F.round(F.when(best > 0, F.col("score") / best).otherwise(0.0), 6))


def coverage(hits: DataFrame, page: DataFrame) -> DataFrame:
    """kind, total, returned, truncated: what all hits and a page of them hold."""
    total = hits.groupBy("kind").agg(F.count("*").alias("total"))
    got = page.groupBy("kind").agg(F.count("*").alias("returned"))
    j = total.join(got, "kind", "left").withColumn("returned", F.coalesce("returned", F.lit(0)))
    return j.select("kind", "total", "returned", (F.col("returned") < F.col("total")).alias("truncated"))
