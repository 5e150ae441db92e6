"""The flagship plan: tasks -> queries -> candidates -> scores -> packed context.

Channels propose chunks, a bounded number for each query or demand:

* symbol: definitions whose name is the query; text: texts that hold all its words, by BM25;
* reference: texts that call a name that the query is, and do not define it;
* must, evidence: what a request demands by path, symbol or literal;
* import: the first symbols of the files that the best files import.

Boosts follow: for files that the request focuses on, for neighbours of the best files
over imports, for files that changed lately and those that import them.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leanspan.functions.text import language_of, path_filter, path_prior, token_terms
from leanspan.operators.derive import top_n
from leanspan.operators.ranking import EVIDENCE, FACET, pack
from leanspan.sources.index import Index

from .planner import plan

BUDGET, PER_QUERY, PER_NAME, SEEDS, PER_DEMAND = 3000, 30, 20, 24, 10
QUERY_SCHEMA = "task_id long, query int, value string, low string, weight double, concept_weight double, fusion_key string, fuse boolean, exact boolean, facets array<string>"
#: what a channel proposes
_HIT = ["task_id", "query", "id", "bm25", "occurrences", "symbol", "reference", "symbol_name", "mark"]


@dataclass(frozen=True)
class Demand:
    """What one task of a request demands besides its words."""

    paths: tuple[str, ...] = ()
    symbols: tuple[str, ...] = ()
    evidence: tuple[str, ...] = ()
    focus: tuple[str, ...] = ()


def task_queries(spark: SparkSession, tasks: list[tuple[int, str]]) -> DataFrame:
    """The queries of the tasks of one request (a bounded list of parameters)."""
    rows = [(t, n, q.value, q.value.lower(), q.weight, q.concept_weight, q.fusion_key, q.fuse, q.exact, sorted(q.facets)) for t, text in tasks for n, q in enumerate(plan(text))]
    return spark.createDataFrame(rows, QUERY_SCHEMA)


def _hits(df: DataFrame, **columns: Column) -> DataFrame:
    default = {"query": F.lit(None).cast("int"), "bm25": F.lit(0.0), "occurrences": F.lit(1).cast("long"), "symbol": F.lit(0.0), "reference": F.lit(0.0), "symbol_name": F.lit(None).cast("string"), "mark": F.lit(None).cast("string")}
    made = default | columns
    return df.select(*[made[c].alias(c) if c in made else F.col(c) for c in _HIT])


def seed_paths(candidates: DataFrame, n: int = SEEDS) -> DataFrame:
    """task_id, path, score, concepts: the best paths of each task, with all that their candidates are about."""
    per = candidates.groupBy("task_id", "path").agg(F.max(F.col("symbol") + F.col("reference") + F.col("bm25") / (1 + F.col("bm25"))).alias("score"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("concepts")))).alias("concepts"))
    return top_n(per, ["task_id"], [F.desc("score"), F.asc("path")], n).select("task_id", "path", "score", "concepts")


def path_score(path: str | Column, terms: Column, languages: Column) -> Column:
    """How much of a task's words a path holds: the words, squared those that share a part, the language, and the path's prior; over 16, within -1 and 2."""
    p = F.col(path) if isinstance(path, str) else path
    parts = F.split(F.lower(p), "/")
    hits = F.size(F.filter(terms, lambda t: F.contains(F.lower(p), t)))
    most = F.coalesce(F.array_max(F.transform(parts, lambda part: F.size(F.filter(terms, lambda t: F.contains(part, t))))), F.lit(0))
    several = F.when(most > 1, most * most).otherwise(0)
    spoken = F.when(F.array_contains(languages, language_of(path)), 12).otherwise(0)
    return F.greatest(F.least((hits + several + spoken + path_prior(path)) / 16, F.lit(2.0)), F.lit(-1.0))


def candidates(
    queries: DataFrame, files: DataFrame, chunks: DataFrame | Index, symbols: DataFrame, per_query: int = PER_QUERY, demands: dict[int, Demand] | None = None, edges: DataFrame | None = None, changed: DataFrame | None = None
) -> DataFrame:
    """Candidates (task_id, path, lines, content, signals) of all channels.

    Queries and demands are a request's parameters and are broadcast.  With an index the
    words' postings are read, and of the texts only those of the few chunks that stay in
    the first of each query; chunks as a table are exploded into words instead.
    edges: path, resolved_path, line of imports; changed: path of files that changed lately.
    """
    demands = demands or {}
    spark = queries.sparkSession
    q = F.broadcast(queries)
    words = queries.select("task_id", "query", "weight", F.explode(token_terms("low")).alias("term")).distinct()
    if isinstance(chunks, Index):
        c = chunks.texts.filter("file_id is not null")
        terms = [r["term"] for r in words.select("term").distinct().collect()]
        counted = chunks.postings(terms).select(F.col("key").alias("id"), "term", "tf").join(F.broadcast(words), "term")
    else:
        c = chunks.filter("id is not null and file_id is not null and content is not null").dropDuplicates(["id"])
        hit = c.select("id", F.explode(token_terms("content")).alias("term")).join(F.broadcast(words), "term")
        counted = hit.groupBy("task_id", "query", "id", "term").agg(F.count("*").alias("tf"), F.first("weight").alias("weight"))
    lines = c.select("id", "file_id", F.col("start_line").alias("a"), F.col("end_line").alias("b"))
    need = words.groupBy("task_id", "query").agg(F.countDistinct("term").alias("need"))
    text = counted.groupBy("task_id", "query", "id").agg(F.sum(F.col("tf") / (F.col("tf") + 1.2)).alias("bm25"), F.sum("tf").alias("occurrences"), F.countDistinct("term").alias("got")).join(F.broadcast(need), ["task_id", "query"]).filter("got = need")
    found = [_hits(top_n(text, ["task_id", "query"], [F.desc("bm25"), F.asc("id")], per_query), query=F.col("query"), bm25=F.col("bm25"), occurrences=F.col("occurrences"))]

    s = symbols.filter("id is not null and name is not null").select(F.col("id").alias("symbol_id"), "file_id", "name", "start_line").dropDuplicates(["symbol_id"])

    def defining(named: DataFrame, **more: Column) -> DataFrame:
        """The chunks in which symbols (with task_id, query) begin."""
        return _hits(named.join(lines, "file_id").filter("a <= start_line and start_line <= b"), symbol=F.lit(1.0), symbol_name=F.col("name"), **more)

    asked = s.withColumn("low", F.lower("name")).join(q.select("task_id", "query", "low"), "low")
    definitions = defining(top_n(asked, ["task_id", "query"], [F.length("name"), F.asc("symbol_id")], PER_NAME), query=F.col("query"))
    found.append(definitions)
    # calls of names that are asked for; whether a text calls one is seen when it is fetched
    names = asked.select("task_id", "query", "low", "name").distinct()
    single = counted.join(F.broadcast(need.filter("need = 1").select("task_id", "query")), ["task_id", "query"]).join(names.select("task_id", "query").distinct(), ["task_id", "query"])
    calls = top_n(single.join(definitions.select("task_id", "query", "id").distinct(), ["task_id", "query", "id"], "left_anti"), ["task_id", "query"], [F.desc("tf"), F.asc("id")], PER_NAME)
    found.append(_hits(calls, query=F.col("query"), occurrences=F.col("tf"), reference=F.lit(1.0)))
    found += _demanded(spark, demands, s, lines, files, chunks, c, defining)

    # each channel gives a bounded number of ids for each query or demand of the request, so they are few whatever the texts
    proposals = reduce(DataFrame.unionByName, found)
    proposed = proposals.collect()
    both = spark.createDataFrame(proposed, proposals.schema).coalesce(1)
    ranked = both.join(q.select("task_id", "query", "weight", "concept_weight", "fusion_key", "exact", "facets", "value", "low"), ["task_id", "query"], "left")
    ids = sorted({r["id"] for r in proposed})
    content = (chunks.pick(ids) if isinstance(chunks, Index) else c.join(both.select("id").distinct(), "id", "left_semi")).select("id", "file_id", "content", "start_line", "end_line")
    full = ranked.join(content, "id")
    called = F.contains(F.lower("content"), F.concat("low", F.lit("(")))
    full = full.filter((F.col("reference") == 0) | called)
    weight = F.coalesce("weight", F.lit(1.0))
    facets = F.when(F.col("facets").isNull(), F.array().cast("array<string>")).otherwise(F.transform("facets", lambda x: F.concat(F.lit(FACET), x, F.lit(":"), F.col("fusion_key"))))
    kinds = F.concat(facets, F.when(F.col("exact"), F.array(F.concat(F.lit("exact-atom:"), "value"))).otherwise(F.array()), F.when(F.col("mark").isNotNull(), F.array("mark")).otherwise(F.array()))
    merged = full.groupBy("task_id", "id").agg(
        F.max(F.col("symbol") * weight).alias("symbol"), F.max(F.col("reference") * weight).alias("reference"), F.max(F.col("bm25") * weight).alias("bm25"), F.max("occurrences").alias("occurrences"), F.max(F.when(F.col("exact"), 1.0).otherwise(0.0)).alias("exact"),
        F.array_distinct(F.flatten(F.collect_list(kinds))).alias("match_kinds"), F.collect_set("fusion_key").alias("concepts"), F.max(F.coalesce("concept_weight", F.lit(1.0))).alias("concept_weight"), F.max("symbol_name").alias("symbol_name"),
        *[F.first(x).alias(x) for x in ("file_id", "content", "start_line", "end_line")],
    )
    texts = content.select("id", "content")
    task_words = words.groupBy("task_id").agg(F.collect_set(F.when(F.length("term") > 2, F.col("term"))).alias("task_words"))
    paths = files.filter("id is not null and path is not null").select(F.col("id").alias("file_id"), "path")
    # as few rows as there were proposals, and without their texts: what follows looks at them several times
    few = merged.drop("content").join(paths, "file_id").join(F.broadcast(task_words), "task_id", "left")
    rows = _boosted(spark.createDataFrame(few.collect(), few.schema).coalesce(1), demands, edges, changed)
    plain = rows.join(texts, "id")
    imported = _imported(rows, edges, paths, s, lines, c, chunks) if edges is not None else None
    rows = plain
    if imported is not None:
        rows = plain.unionByName(imported, allowMissingColumns=True).withColumn("focus_boost", F.coalesce("focus_boost", F.lit(0.0))).withColumn("change_boost", F.coalesce("change_boost", F.lit(0.0)))
    kind = F.when(F.col("symbol") > 0, "definition").when(F.col("reference") > 0, "reference").when(F.col("bm25") > 0, "text").when(F.col("import_boost") > 0, "import").otherwise("required")
    words_of_task = F.coalesce("task_words", F.array().cast("array<string>"))
    return rows.select(
        "task_id", "path", "start_line", "end_line", "content", F.sort_array("match_kinds").alias("match_kinds"), F.sort_array("concepts").alias("concepts"), "concept_weight", kind.alias("representation"), "symbol_name",
        "exact", "symbol", "reference", "bm25", path_score("path", words_of_task, words_of_task).alias("path_score"), F.least((F.greatest(F.col("occurrences") - 5, F.lit(0)) / 20), F.lit(1.0)).alias("lexical_frequency_penalty"),
        F.lit(0.0).alias("size_score"),  # 0: the score takes the size of the content itself
        "focus_boost", "import_boost", "change_boost",
    )


def _demanded(spark: SparkSession, demands: dict[int, Demand], s: DataFrame, lines: DataFrame, files: DataFrame, chunks: DataFrame | Index, c: DataFrame, defining) -> list[DataFrame]:
    """The must and evidence channels: a few chunks for each path, symbol and literal that a task demands."""
    out = []
    if names := [(t, n, n.rpartition(".")[2]) for t, d in demands.items() for n in d.symbols]:
        wanted = F.broadcast(spark.createDataFrame(names, "task_id long, demand string, name string"))
        out.append(defining(top_n(s.join(wanted, "name"), ["task_id", "demand"], [F.asc("symbol_id")], PER_DEMAND)))
    if places := [(t, p.rstrip("/")) for t, d in demands.items() for p in d.paths]:
        wanted = F.broadcast(spark.createDataFrame(places, "task_id long, demand string"))
        p = files.filter("id is not null and path is not null").select(F.col("id").alias("file_id"), "path")
        under = p.join(wanted, (F.col("path") == F.col("demand")) | F.col("path").startswith(F.concat("demand", F.lit("/"))))
        first = top_n(under.join(lines, "file_id"), ["task_id", "demand"], [F.asc("path"), F.asc("a"), F.asc("id")], PER_DEMAND)
        out.append(_hits(first))
    for t, d in demands.items():
        for n, literal in enumerate(d.evidence):
            if isinstance(chunks, Index):
                texts = (chunks.texts if chunks.small else chunks.fetch(chunks.holding(literal))).filter("file_id is not null")
            else:
                texts = c
            held = texts.filter(F.contains(F.lower("content"), F.lit(literal.lower()))).select("id").orderBy("id").limit(PER_DEMAND)  # a demand is met by the first
            out.append(_hits(held.withColumn("task_id", F.lit(t).cast("long")), mark=F.lit(f"{EVIDENCE}{n}:0")))
    return out


def _boosted(rows: DataFrame, demands: dict[int, Demand], edges: DataFrame | None, changed: DataFrame | None) -> DataFrame:
    focus = F.lit(0.0)
    for t, d in demands.items():
        if d.focus:
            focus = F.when((F.col("task_id") == t) & path_filter("path", list(d.focus)), 1.0).otherwise(focus)
    rows = rows.withColumn("focus_boost", focus)
    if edges is None:
        rows = rows.withColumn("import_boost", F.lit(0.0))
    else:
        seeds = seed_paths(rows).select("task_id", F.col("path").alias("seed"))
        e = edges.filter("resolved_path is not null").select("path", "resolved_path").distinct()
        near = seeds.join(e.select(F.col("path").alias("seed"), F.col("resolved_path").alias("path")), "seed").unionByName(seeds.join(e.select(F.col("resolved_path").alias("seed"), "path"), "seed")).select("task_id", "path").distinct()
        rows = rows.join(near.withColumn("import_boost", F.lit(1.0)), ["task_id", "path"], "left").withColumn("import_boost", F.coalesce("import_boost", F.lit(0.0)))
    if changed is None:
        return rows.withColumn("change_boost", F.lit(0.0))
    direct = changed.select("path").distinct().withColumn("is_changed", F.lit(1.0))
    rows = rows.join(direct, "path", "left")
    if edges is not None:
        importers = direct.join(edges.select(F.col("resolved_path").alias("path"), F.col("path").alias("importer")).distinct(), "path").select(F.col("importer").alias("path"), F.lit(1.0).alias("imports_changed")).distinct()
        rows = rows.join(importers, "path", "left")
    else:
        rows = rows.withColumn("imports_changed", F.lit(None).cast("double"))
    return rows.withColumn("change_boost", F.coalesce("is_changed", F.lit(0.0)) + F.coalesce("imports_changed", F.lit(0.0))).drop("is_changed", "imports_changed")


def _imported(rows: DataFrame, edges: DataFrame, paths: DataFrame, s: DataFrame, lines: DataFrame, c: DataFrame, chunks: DataFrame | Index) -> DataFrame | None:
    """The import channel: of the first three imports of each seed the chunks of the first two symbols; None if there are none."""
    seeds = seed_paths(rows)
    e = edges.filter("resolved_path is not null").select(F.col("path").alias("from"), "resolved_path", "line")
    first = top_n(e.join(seeds.select(F.col("path").alias("from")).distinct(), "from", "left_semi"), ["from"], [F.asc("line"), F.asc("resolved_path")], 3).select("from", F.col("resolved_path").alias("path"))
    target = seeds.select("task_id", F.col("path").alias("from"), "concepts").join(first, "from").join(paths, "path")
    heads = top_n(s.join(target.select("file_id").distinct(), "file_id", "left_semi"), ["file_id"], [F.asc("start_line"), F.asc("symbol_id")], 2).select("file_id", "name", "start_line")
    hit = target.join(heads, "file_id").join(lines, "file_id").filter("a <= start_line and start_line <= b")
    hit = top_n(hit, ["task_id"], [F.asc("path"), F.asc("start_line")], SEEDS).groupBy("task_id", "id", "path").agg(F.first("name").alias("symbol_name"), F.flatten(F.collect_list("concepts")).alias("concepts"))
    hit = hit.join(rows.select("task_id", "id"), ["task_id", "id"], "left_anti")
    got = hit.collect()  # at most SEEDS a task
    if not got:
        return None
    hit = rows.sparkSession.createDataFrame(got, hit.schema).coalesce(1)
    texts = chunks.pick(sorted({r["id"] for r in got})) if isinstance(chunks, Index) else c
    full = hit.join(texts.select("id", "content", "start_line", "end_line"), "id")
    zero = F.lit(0.0)
    return full.select(
        "task_id", "id", "path", "content", "start_line", "end_line", "symbol_name", F.array_distinct("concepts").alias("concepts"), F.array().cast("array<string>").alias("match_kinds"), F.lit(0.25).alias("concept_weight"), F.lit(1).cast("long").alias("occurrences"),
        zero.alias("symbol"), zero.alias("reference"), zero.alias("bm25"), zero.alias("exact"), F.lit(1.0).alias("import_boost"),
    )


def context(
    spark: SparkSession, tasks: list[tuple[int, str]], files: DataFrame, chunks: DataFrame | Index, symbols: DataFrame, budget: int = BUDGET, demands: dict[int, Demand] | None = None, edges: DataFrame | None = None, changed: DataFrame | None = None
) -> DataFrame:
    """The packed context of every task of a request; what it demands comes first."""
    found = candidates(task_queries(spark, tasks), files, chunks, symbols, demands=demands, edges=edges, changed=changed)
    must = {t: (list(d.paths), list(d.symbols), [(n, 1) for n in range(len(d.evidence))]) for t, d in (demands or {}).items()}
    return pack(found, budget, demands=must)
