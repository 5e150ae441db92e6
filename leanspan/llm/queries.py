"""Queries of the training-data operators and the SQL that some of them equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leanspan.sources.tables import table

from . import credentials, docpairs, encoding, leakage, mixing, parsecheck, provenance, splitting

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return docpairs.extract_pairs(table(spark, d, "symbols"), table(spark, d, "chunks"), table(spark, d, "files")).select("symbol_id").distinct()


def p1_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Valid functions only, those of broken files among them, without templates."""
    return docpairs.drop_templates(docpairs.extract_pairs(table(spark, d, "symbols"), table(spark, d, "chunks"), table(spark, d, "files")).filter("parses"))


def p1_functions(spark: SparkSession, d: str) -> DataFrame:
    """Documented functions by parsing the files alone, those among them that no indexer has seen."""
    return docpairs.extract_functions(table(spark, d, "files")).distinct()


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return provenance.find_not_handwritten(table(spark, d, "files")).select("file_id").distinct()


def p2_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Files that are not hand-written, by repository and kind, beside all files of the repository."""
    files = table(spark, d, "files")
    found = provenance.find_not_handwritten(files).select("file_id", "kind").dropDuplicates(["file_id"])
    return files.select("repository", F.col("id").alias("file_id")).join(found, "file_id", "left").groupBy("repository", F.coalesce("kind", F.lit("handwritten")).alias("kind")).agg(F.count("*").alias("files"))


def p2_validation(spark: SparkSession, d: str) -> DataFrame:
    return provenance.validation(table(spark, d, "files"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return credentials.find_secrets(table(spark, d, "chunks"), table(spark, d, "files")).select("chunk_id", "line_no").distinct()


def p3_redacted(spark: SparkSession, d: str) -> DataFrame:
    return credentials.redact(table(spark, d, "chunks"), table(spark, d, "files"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return parsecheck.unparsed(table(spark, d, "files"))


def p4_rates(spark: SparkSession, d: str) -> DataFrame:
    return parsecheck.rates(table(spark, d, "files"), table(spark, d, "parse_diagnostics"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_oversized(table(spark, d, "chunks")).filter(F.col("piece") == 0).select("chunk_id")


def p5_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_oversized(table(spark, d, "chunks"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.find_leaks(table(spark, d, "documents"), table(spark, d, "benchmark")).select("doc_id", "item_id").distinct()


def p6_items(spark: SparkSession, d: str) -> DataFrame:
    """Which test items leaked, and into how many documents."""
    found = leakage.find_leaks(table(spark, d, "documents"), table(spark, d, "benchmark"))
    return found.groupBy("item_id").agg(F.countDistinct("doc_id").alias("documents"), F.max(F.round(F.col("covered_words") / F.col("item_words"), 4)).alias("most_covered"), F.max("longest_run").alias("longest_run"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixture_plan(table(spark, d, "documents"), table(spark, d, "mix_targets")).filter("short").select("source")


def p7_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mixing.sample_mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    s = mixing.actual_shares(table(spark, d, "documents"), table(spark, d, "mix_targets"))
    return s.select("source", F.round("share", 6).alias("share"), "short", "chosen_tokens", "chosen_documents", "most_copies", F.round("actual_share", 6).alias("actual_share"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return encoding.find_garbled(table(spark, d, "documents")).select("doc_id").distinct()


def p8_restored(spark: SparkSession, d: str) -> DataFrame:
    return encoding.find_garbled(table(spark, d, "documents"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (p1_found, p1_pairs, p1_functions, p2_found, p2_kinds, p2_validation, p3_found, p3_redacted, p4_found, p4_rates, p5_found, p5_pieces, p6_found, p6_items, p7_found, p7_mixture, p7_shares, p8_found, p8_restored)}


_WS = r"\x{9}-\x{d}\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def _estimate(c: str) -> str:
    return f"(case when length({c}) = 0 then 0 else greatest(cast(ceil(length({c}) / 4.0) as bigint), len(regexp_extract_all({c}, '[^{_WS}]+')), 1) end)"


_PLAN = f"""
with docs as (select doc_id, lower(trim(source)) as key, coalesce({_estimate('text')}, 0) as tokens from documents where doc_id is not null and source is not null),
sums as (select key, sum(tokens) as tokens from docs group by key),
targets as (select lower(trim(source)) as key, min(source) as source, sum(weight) as weight, max(max_repeats) as max_repeats from mix_targets group by 1),
base as (select t.key, t.source, t.weight / sum(t.weight) over () as share, coalesce(s.tokens, 0) as tokens, t.max_repeats * coalesce(s.tokens, 0) as cap from targets t left join sums s on s.key = t.key),
wants as (select *, share * sum(tokens) over () as wanted, sum(tokens) over () as total from base)"""
_WATER = (
    _PLAN
    + """,
levels as (select *, (total - coalesce(sum(cap) over (order by cap / share, key rows between unbounded preceding and 1 preceding), 0)) / sum(share) over (order by cap / share, key rows between current row and unbounded following) as level from wants),
water as (select level from levels where level * share <= cap order by cap / share, key limit 1),
plan as (select key, source, share, wanted > cap as short, tokens, case when (select count(*) from water) = 0 then cap else least(cap, share * (select level from water)) end as allotted from wants),
rates as (select *, case when tokens > 0 then allotted / tokens else 0 end as rate from plan),
parts as (select *, floor(rate) as whole, (rate - floor(rate)) * tokens as extra from rates),
runs as (select d.doc_id, p.source, d.tokens, p.whole, p.extra, sum(d.tokens) over (partition by d.key order by md5('0:' || d.doc_id), d.doc_id rows between unbounded preceding and current row) as upto from docs d join parts p on p.key = d.key),
chosen as (select doc_id, source, tokens, cast(whole + case when upto <= extra then 1 else 0 end as bigint) as copies from runs)"""
)


def oracle_sql() -> dict[str, str]:
    return {
        "p5_found": f"select distinct id as chunk_id from chunks where {_estimate('content')} > 1024",
        "p7_found": _PLAN + " select source from wants where wanted > cap",
        "p7_mixture": _WATER + " select doc_id, source, tokens, copies from chosen where copies > 0",
        "p7_shares": _WATER
        + """, got as (select source, sum(tokens * copies) as chosen_tokens, count(*) as chosen_documents, max(copies) as most_copies from chosen where copies > 0 group by source)
select p.source, round(p.share, 6) as share, p.short, cast(coalesce(g.chosen_tokens, 0) as bigint) as chosen_tokens, coalesce(g.chosen_documents, 0) as chosen_documents, coalesce(g.most_copies, 0) as most_copies,
round(coalesce(g.chosen_tokens, 0) / sum(g.chosen_tokens) over (), 6) as actual_share from plan p left join got g on g.source = p.source""",
    }
