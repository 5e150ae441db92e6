"""Aggregates: corpus counts, coverage, facets with a remainder, digests, counters and their differences."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leanspan.functions.text import extension, fingerprint, language_of

FACETS = 12


def corpus_counts(files: DataFrame, chunks: DataFrame, symbols: DataFrame) -> DataFrame:
    """files, bytes, chunks, symbols of distinct ids; one row."""
    f = files.agg(F.countDistinct("id").alias("files"), F.sum("size_bytes").alias("bytes"))
    c = chunks.agg(F.countDistinct("id").alias("chunks"))
    s = symbols.agg(F.countDistinct("id").alias("symbols"))
    return f.crossJoin(c).crossJoin(s)  # three rows of one


def parser_coverage(files: DataFrame) -> DataFrame:
    """language, complete, files, bytes; files without a language by extension family, the smaller families as ``other``."""
    family = F.coalesce(language_of("path"), F.concat(F.lit("."), extension("path")), F.lit("[none]"))
    counts = files.groupBy(family.alias("family"), F.col("structurally_complete").alias("complete")).agg(F.count("*").alias("files"), F.sum("size_bytes").alias("bytes"))
    totals = counts.groupBy("family").agg(F.sum("files").alias("n"))
    # one row a family; the rest of the families beyond the first twenty become one
    place = totals.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "family")))
    named = counts.join(place, "family").withColumn("family", F.when(F.col("place") <= 20, F.col("family")).otherwise("other"))
    return named.groupBy("family", "complete").agg(F.sum("files").alias("files"), F.sum("bytes").alias("bytes"))


def facets(df: DataFrame, value: str | Column, most: int = FACETS) -> DataFrame:
    """value, n: the most frequent values; beyond ``most`` the rest is one ``[other]``."""
    counts = df.groupBy((F.col(value) if isinstance(value, str) else value).alias("value")).agg(F.count("*").alias("n"))
    top = counts.orderBy(F.desc("n"), F.asc("value")).limit(most)  # a bounded list, not a sort of all values
    total = counts.agg(F.sum("n").alias("all"), F.count("*").alias("values"))
    ranked = top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), F.asc("value")))).crossJoin(F.broadcast(total))
    kept = ranked.withColumn("value", F.when((F.col("values") > most) & (F.col("place") >= most), F.lit("[other]")).otherwise(F.col("value")))
    before = F.sum(F.when(F.col("place") < most, F.col("n"))).over(Window.orderBy("place").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return kept.withColumn("n", F.when(F.col("value") == "[other]", F.col("all") - before).otherwise(F.col("n"))).select("value", "n")


def score_band(score: Column) -> Column:
    return F.when(score >= 1.0, "score >= 1.0").when(score >= 0.5, "0.5 <= score < 1.0").when(score > 0, "0 < score < 0.5").otherwise("score = 0")


def ordered_digest(df: DataFrame, key: str, path: str, value: str, buckets: int = 3) -> DataFrame:
    """key, entries, digest: of all (path, value) of a key, in two levels.

    Entries are hashed in buckets by the first hex digits of their path's md5, in order
    of path; the buckets' digests are hashed in order.  No task holds a whole key.
    """
    entry = df.filter(F.col(path).isNotNull()).select(F.col(key).alias("key"), F.substring(F.md5(path), 1, buckets).alias("bucket"), F.concat_ws(":", path, F.coalesce(value, F.lit("")) if isinstance(value, str) else value).alias("entry")).distinct()
    low = entry.groupBy("key", "bucket").agg(F.count("*").alias("n"), F.sha2(F.array_join(F.sort_array(F.collect_list("entry")), "\n"), 256).alias("d"))
    return low.groupBy("key").agg(F.sum("n").alias("entries"), F.substring(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("bucket", "d"))), lambda x: x["d"]), "\n"), 256), 1, 32).alias("digest")).withColumnRenamed("key", key)


def counters(log: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Sums of a log by its keys; nulls count as zero and sums stop at the largest long."""
    cap = F.lit(9223372036854775807).cast("decimal(38,0)")
    return log.groupBy(*keys).agg(F.count("*").alias("requests"), *[F.least(F.sum(F.coalesce(F.col(v), F.lit(0)).cast("decimal(38,0)")), cap).cast("long").alias(v) for v in values])


def counter_delta(now: DataFrame, base: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """now - base by key, with ``regressed`` where a counter fell."""
    a = now.select(*keys, *[F.col(v).alias(f"{v}_now") for v in values])
    b = base.select(*keys, *[F.col(v).alias(f"{v}_base") for v in values])
    j = a.join(b, keys, "full")
    diff = {v: F.coalesce(f"{v}_now", F.lit(0)) - F.coalesce(f"{v}_base", F.lit(0)) for v in values}
    fell = reduce(lambda x, y: x | y, [d < 0 for d in diff.values()], F.lit(False))
    return j.select(*keys, *[d.alias(v) for v, d in diff.items()], fell.alias("regressed"))


def baseline_tokens(df: DataFrame, key: str, tokenizer: str, tokens: str) -> DataFrame:
    """Sum of token counts by key if all rows share one tokenizer, else null."""
    return df.groupBy(key).agg(F.when((F.countDistinct(tokenizer) == 1) & (F.count(tokenizer) == F.count("*")) & (F.count(tokens) == F.count("*")), F.sum(tokens)).alias("baseline_tokens"))


def numeric_summary(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """count, non_numeric, min, median (midpoint), p95 (nearest rank), max of values given as strings."""
    n = F.expr(f"try_cast({value} as double)")
    return df.groupBy(*keys).agg(F.count(n).alias("count"), F.sum((F.col(value).isNotNull() & n.isNull()).cast("long")).alias("non_numeric"), F.min(n).alias("min"), F.percentile(n, 0.5).alias("median"), F.expr(f"percentile_disc(0.95) within group (order by try_cast({value} as double))").alias("p95"), F.max(n).alias("max"))


def routing_groups(changed: DataFrame, path: str, paths_at_least: int = 32, groups_at_least: int = 3, concentration: float = 0.5) -> DataFrame:
    """group (first two path components), paths, routed: only for many paths in several groups of which one dominates."""
    parts = F.split(path, "/")
    g = F.when(F.size(parts) > 2, F.array_join(F.slice(parts, 1, 2), "/")).when(F.size(parts) == 2, parts[0]).otherwise(".")
    counts = changed.select(path).distinct().groupBy(g.alias("path_group")).agg(F.count("*").alias("paths"))
    total = counts.agg(F.sum("paths").alias("all_paths"), F.count("*").alias("all_groups"), F.max("paths").alias("largest"))
    return counts.crossJoin(F.broadcast(total)).select("path_group", "paths", ((F.col("all_paths") >= paths_at_least) & (F.col("all_groups") >= groups_at_least) & (F.col("largest") >= concentration * F.col("all_paths"))).alias("routed"))


__all__ = ["corpus_counts", "parser_coverage", "facets", "score_band", "ordered_digest", "counters", "counter_delta", "baseline_tokens", "numeric_summary", "routing_groups", "fingerprint"]
