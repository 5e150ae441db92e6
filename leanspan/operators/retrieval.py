"""Postings, BM25, substring and regular-expression search, occurrences, excerpts, hit grouping."""

from __future__ import annotations

import re
from re import _parser
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leanspan.functions.text import token_terms
from leanspan.sources.index import Index

K1, B = 1.2, 0.75


def term_statistics(chunks: DataFrame | Index, key: str = "id", text: str = "content") -> DataFrame:
    """term, df, tf over all texts; partial sums are made before the shuffle."""
    if isinstance(chunks, Index):
        return chunks.words.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))
    words = chunks.select(F.col(key).alias("key"), F.explode(token_terms(text)).alias("term"))
    return words.groupBy("term", "key").agg(F.count("*").alias("n")).groupBy("term").agg(F.count("*").alias("df"), F.sum("n").alias("tf"))


def bm25(chunks: DataFrame | Index, queries: DataFrame, key: str = "id", text: str = "content", k: int = 20, k1: float = K1, b: float = B) -> DataFrame:
    """query_id, key, score, position: the k best texts of each query (query_id, terms array).

    Only the terms of the queries are counted: texts are reduced to their length and
    the query terms they hold in the scan, so the shuffle carries matches, not texts.
    Queries are request parameters, broadcast only because the caller passes them in.
    """
    wanted = queries.select("query_id", F.explode(F.array_distinct("terms")).alias("term"))
    if isinstance(chunks, Index):
        # the index holds counts and lengths: only the postings of the queries' terms are read
        tf, size = chunks.postings([r["term"] for r in wanted.select("term").distinct().collect()]), chunks.sizes
    else:
        docs = chunks.select(F.col(key).alias("key"), token_terms(text).alias("words")).withColumn("length", F.size("words"))
        size = docs.agg(F.count("*").alias("n"), F.avg("length").alias("mean"))
        terms = F.broadcast(wanted.select("term").distinct())
        tf = docs.select("key", "length", F.explode("words").alias("term")).join(terms, "term").groupBy("key", "term").agg(F.count("*").alias("tf"), F.first("length").alias("length"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    # df has at most one row a query term
    weighted = tf.join(F.broadcast(df), "term").crossJoin(F.broadcast(size)).withColumn("w", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)) * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("mean"))))
    scores = weighted.join(F.broadcast(wanted), "term").groupBy("query_id", "key").agg(F.round(F.sum("w"), 6).alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "key")
    return scores.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= k)


# --- regular expressions -----------------------------------------------------
def required_literals(pattern: str, case_sensitive: bool = True) -> list[list[str]] | None:
    """A conjunction of disjunctions of literals (three characters or more) that every match holds, or None.

    Sequences require all their parts, alternatives one of theirs, repeats at least
    once what they repeat; classes and optional parts require nothing.  Folding of
    characters beyond ASCII is not followed, so such literals are left out.
    """
    try:
        tree = _parser.parse(pattern)
    except re.error:
        return None

    def walk(items) -> list[list[str]]:
        out, run = [], ""

        def flush() -> None:
            nonlocal run
            if len(run) >= 3:
                out.append([run])
            run = ""

        for op, value in items:
            name = str(op)
            if name == "LITERAL" and (case_sensitive or value < 128 and chr(value) not in "ksKS"):
                run += chr(value)
                continue
            flush()
            if name == "SUBPATTERN":
                out += walk(value[-1])
            elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and value[0] >= 1:
                out += walk(value[2])
            elif name == "BRANCH":
                parts = [walk(x) for x in value[1]]
                if all(parts):
                    # the longest requirement of each branch
                    out.append([lit for p in parts for lit in max(p, key=lambda alts: min(map(len, alts)))])
        flush()
        return out

    return walk(tree) or None


def prefilter(text: Column, pattern: str, case_sensitive: bool = True) -> Column:
    """A sound condition that every match of the pattern meets; true where none can be derived."""
    plan = required_literals(pattern, case_sensitive)
    out = F.lit(True)
    subject = text if case_sensitive else F.lower(text)
    for alternatives in plan or []:
        any_of = F.lit(False)
        for x in alternatives:
            any_of = any_of | subject.contains(x if case_sensitive else x.lower())
        out = out & any_of
    return out


def regex_search(chunks: DataFrame | Index, pattern: str, case_sensitive: bool = True, use_prefilter: bool = True, text: str = "content") -> DataFrame:
    """Texts that match; the literal condition runs before the expression and is always verified."""
    c = F.col(text)
    if isinstance(chunks, Index):
        plan = required_literals(pattern, case_sensitive)
        chunks = chunks.fetch(chunks.matching(plan) if plan and not chunks.small else None)
    hit = chunks.filter(prefilter(c, pattern, case_sensitive)) if use_prefilter else chunks
    return hit.filter(c.rlike(pattern if case_sensitive else f"(?i){pattern}"))


def substring_search(chunks: DataFrame | Index, needle: str, case_sensitive: bool = False, text: str = "content") -> DataFrame:
    """Texts that hold the needle; fewer than three characters match nothing, as with a trigram index."""
    if isinstance(chunks, Index):
        chunks = chunks.fetch(chunks.holding(needle)) if len(needle) >= 3 and not chunks.small else chunks.texts
    if len(needle) < 3:
        return chunks.limit(0)
    c = F.col(text)
    return chunks.filter(c.contains(needle) if case_sensitive else F.lower(c).contains(needle.lower()))


def phrase_search(chunks: DataFrame | Index, phrase: str, text: str = "content") -> DataFrame:
    """Texts that hold the words of the phrase one after another."""
    words = [w for w in re.split(r"[^\w]+", phrase.lower()) if w]
    if isinstance(chunks, Index):
        held = chunks.postings(sorted(set(words))).groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") == len(set(words))).select("key")
        chunks = chunks.fetch(held)
    if not words:
        return chunks.limit(0)
    joined = F.concat(F.lit(" "), F.array_join(token_terms(text), " "), F.lit(" "))
    return chunks.filter(F.lower(F.col(text)).contains(words[0]) & joined.contains(f" {' '.join(words)} "))


def occurrences(chunks: DataFrame, pattern: str, case_sensitive: bool = True) -> DataFrame:
    """Every match: id, file_id, line, column (code points, from 1), start_byte, end_byte (in the file), text."""
    schema = "id long, file_id long, line long, column long, start_byte long, end_byte long, match string"
    flags = 0 if case_sensitive else re.IGNORECASE

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        finder = re.compile(pattern, flags)
        for batch in batches:
            out = []
            for i, f, t, line, byte in zip(batch["id"], batch["file_id"], batch["content"], batch["start_line"], batch["start_byte"]):
                at, at_byte = 0, 0
                for m in finder.finditer(t):
                    at_byte += len(t[at: m.start()].encode())
                    at = m.start()
                    before = t.count("\n", 0, at)
                    out.append((i, f, line + before, at - t.rfind("\n", 0, at), byte + at_byte, byte + at_byte + len(m.group().encode()), m.group()))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])

    hit = regex_search(chunks.filter("id is not null and start_line is not null and start_byte is not null"), pattern, case_sensitive).select("id", "file_id", "content", "start_line", "start_byte")
    return hit.mapInPandas(run, schema)


def window_around(start: str, end: str, first: str, last: str, context: int, most: int) -> tuple[Column, Column]:
    """Lines around a match: ``context`` on both sides within [first, last], cut to ``most`` but never into the match."""
    a, b = F.col(start), F.col(end)
    lo, hi = F.greatest(a - context, F.col(first)), F.least(b + context, F.col(last))
    extra = F.greatest(F.lit(most) - (b - a + 1), F.lit(0))
    before = F.least(a - lo, F.ceil(extra / 2))
    after = F.least(hi - b, extra - before)
    before = before + F.least(a - lo - before, extra - before - after)
    after = after + F.least(hi - b - after, extra - before - after)
    fits = hi - lo + 1 <= most
    return F.when(fits, lo).otherwise(a - before).cast("long"), F.when(fits, hi).otherwise(b + after).cast("long")


def group_hits(hits: DataFrame, key: str) -> DataFrame:
    """Hits (kind definition/reference/text, path, line, role) by key: first definition, references, roles, text matches, total."""
    return hits.groupBy(key).agg(
        F.min_by(F.when(F.col("kind") == "definition", F.struct("path", "line")), F.when(F.col("kind") == "definition", F.struct("path", "line"))).alias("definition"),
        F.count(F.when(F.col("kind") == "reference", 1)).alias("references"), F.count(F.when(F.col("kind") == "text", 1)).alias("text_matches"),
        F.min(F.when(F.col("kind") != "definition", F.col("line"))).alias("first_line"), F.max(F.when(F.col("kind") != "definition", F.col("line"))).alias("last_line"),
        F.sort_array(F.collect_set("role")).alias("roles"), F.count("*").alias("total"),
    )


def symbol_matches(symbols: DataFrame, name: str) -> DataFrame:
    """Symbols by bare or qualified (parent.name) name, exact first, then shorter names, then place."""
    bare = name.rsplit(".", 1)[-1]
    parent = name.rsplit(".", 1)[0] if "." in name else None
    exact = (F.col("name") == bare) & (F.col("parent") == parent if parent else F.lit(True))
    loose = F.lower("name").contains(bare.lower()) & (F.lower(F.coalesce("parent", F.lit(""))).contains(parent.lower()) if parent else F.lit(True))
    return symbols.filter(exact | loose).withColumn("exact", exact).orderBy(F.desc("exact"), F.length("name"), "name", "file_id", "start_byte", "id")


def fusion(hits: DataFrame) -> DataFrame:
    """Reciprocal-rank fusion of hits (path, fusion_key, weight, rank): boost of each path that several keys reach."""
    per_key = hits.filter("weight >= 0.25").groupBy("path", "fusion_key").agg(F.max(F.col("weight") * 60 / (60 + F.col("rank") + 1)).alias("s"))
    return per_key.groupBy("path").agg(F.count("*").alias("keys"), F.sum("s").alias("total"), F.max("s").alias("strongest")).withColumn("boost", F.when(F.col("keys") > 1, F.least(F.col("total") - F.col("strongest"), F.lit(0.2))).otherwise(0.0))


def page_hits(sizes: list[int], limit: int, budget: int) -> tuple[list[int], int]:
    """Positions of a page and how many were consumed: the first that doesn't fit ends it, unless nothing fits before it, which is skipped."""
    taken, used = [], 0
    for k, n in enumerate(sizes):
        if len(taken) == limit:
            return taken, k
        if used + n > budget:
            if taken:
                return taken, k
            continue
        taken.append(k)
        used += n
    return taken, len(sizes)


def fuzzy_score(query: str, path: str) -> int | None:
    """Score of a query as a subsequence of a path, ignoring case, or None.

    Sixteen points a matched character; a bonus of eight at the start of a path
    component or word, of four when it follows the previous match directly; the best
    alignment counts.
    """
    q, p = query.lower(), path.lower()
    if not q:
        return 0
    if len(q) > len(p):
        return None
    worst = -(10**9)
    best_end = [worst] * len(p)  # best score with the current character matched at each place
    for n, c in enumerate(q):
        now, best_before = [worst] * len(p), worst
        for k, x in enumerate(p):
            if x == c:
                bonus = 8 if k == 0 or p[k - 1] in "/_-. " or path[k].isupper() and path[k - 1].islower() else 0
                base = 0 if n == 0 else max(best_before, (best_end[k - 1] + 4) if k else worst)
                if base > worst:
                    now[k] = base + 16 + bonus
            if k < len(p) and n:
                best_before = max(best_before, best_end[k])
        best_end = now
    top = max(best_end)
    return None if top <= 0 else top


def fuzzy_find(files: DataFrame, query: str, k: int = 20) -> DataFrame:
    """path, score, position: best subsequence matches, then source before other before fixtures, then depth, then path."""

    @F.pandas_udf("int")
    def score(path: pd.Series) -> pd.Series:
        return pd.Series([fuzzy_score(query, p) for p in path], dtype="Int32")

    # a subsequence test in the JVM leaves few paths for Python
    likely = files.filter(F.lower("path").rlike(".*".join(re.escape(c) for c in query.lower()))).select("path").distinct()
    p = F.lower("path")
    rank = F.when(p.rlike(r"(^|/)(bench|benches|benchmark|benchmarks|fixture|fixtures|testdata)/"), 2).when(~p.contains("/") | p.rlike(r"(^|/)(app|cmd|internal|lib|src)/"), 0).otherwise(1)
    scored = likely.withColumn("score", score("path")).filter("score is not null").withColumn("class", rank).withColumn("depth", F.size(F.split("path", "/")))
    return scored.orderBy(F.desc("score"), "class", "depth", "path").limit(k).select("path", "score", "class")
