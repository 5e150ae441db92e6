"""Mixing sources to target weights (problem 7).

Capped water-filling: each listed source wants weight x T tokens, T being the tokens
of all documents of all listed sources; a source gives at most max_repeats times its
tokens, and what it cannot give is spread over the others in proportion to their
weights until nobody is above its cap.  The fixed point is found in closed form: with
the sources in order of cap / weight, the water level of the first source that is not
clamped follows from running sums, so no iteration and no driver loop is needed.

Each source then repeats all its documents a whole number of times and a seeded part
of them once more.  The part is taken in order of a hash of the seed and the id until
its tokens are reached: hash bins are summed first, whole bins are taken by their
running sum, and only the one bin on the edge is ordered row by row, so that a source
with a third of all rows never meets in one task.

Defined results: sources compare after trimming and lower-casing and are reported as
the targets spell them; null sources and sources that are not listed are left out;
null, empty and zero-token documents take part with no tokens; rows without id are
left out; null or negative weights and repeats count as zero; a source listed twice
counts once with its weights added and the larger repeats; no documents or no targets
give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leanspan.functions.tokens import estimate

BIN_DIGITS = 3  # hash bins of a source: 16 ** BIN_DIGITS


#: The Unicode space separators, which are what the SQL's trim takes away; Spark's takes the plain blank alone.
_BLANKS = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"


def _norm(c: str | Column) -> Column:
    """Trimmed and in lower case, letter by letter as in the SQL: Java's rule for the last sigma of a word and its two characters for one of İ would part equal names."""
    return F.lower(F.translate(F.btrim(c, F.lit(_BLANKS)), "Σİ", "σi"))


def source_tokens(documents: DataFrame) -> DataFrame:
    """doc_id, key (normalised source), tokens."""
    return documents.filter(F.col("doc_id").isNotNull() & F.col("source").isNotNull()).select("doc_id", _norm(F.col("source")).alias("key"), F.coalesce(estimate("text"), F.lit(0)).alias("tokens"))


def targets_of(mix_targets: DataFrame) -> DataFrame:
    t = mix_targets.filter(F.col("source").isNotNull()).select("source", _norm(F.col("source")).alias("key"), F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(0.0)).alias("weight"), F.greatest(F.coalesce("max_repeats", F.lit(0)), F.lit(0)).alias("max_repeats"))
    return t.groupBy("key").agg(F.min("source").alias("source"), F.sum("weight").alias("weight"), F.max("max_repeats").alias("max_repeats"))


def hash_bins(documents: DataFrame, seed: int) -> tuple[DataFrame, DataFrame]:
    """The documents with their tokens, hash and bin, and the sums of (key, bin); the plan and the choice both come from these sums."""
    rows = source_tokens(documents).withColumn("h", F.md5(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")))).withColumn("bin", F.substring("h", 1, BIN_DIGITS))
    return rows, rows.groupBy("key", "bin").agg(F.sum("tokens").alias("n"), F.count("*").alias("documents"))


def mixture_plan(documents: DataFrame, mix_targets: DataFrame) -> DataFrame:
    """One row for each target: source, key, share, tokens, documents, cap, wanted, short, allotted, rate, whole, fraction.

    ``short`` says that the source cannot reach its share at its cap.  The windows run
    over the target rows only.
    """
    return _plan(source_tokens(documents).groupBy("key").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("documents")), mix_targets)


def _plan(sums: DataFrame, mix_targets: DataFrame) -> DataFrame:
    one = Window.partitionBy(F.lit(1))
    t = targets_of(mix_targets).join(sums, "key", "left").fillna(0, ["tokens", "documents"])
    t = t.withColumn("total_weight", F.sum("weight").over(one)).withColumn("share", F.when(F.col("total_weight") > 0, F.col("weight") / F.col("total_weight")).otherwise(0.0))
    t = t.withColumn("total", F.sum("tokens").over(one)).withColumn("cap", F.col("max_repeats") * F.col("tokens")).withColumn("wanted", F.col("share") * F.col("total"))
    t = t.withColumn("short", F.col("wanted") > F.col("cap"))
    ordered = one.orderBy(F.when(F.col("share") > 0, F.col("cap") / F.col("share")).otherwise(F.lit(float("inf"))), "key")
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    after = ordered.rowsBetween(0, Window.unboundedFollowing)
    t = t.withColumn("level", F.try_divide(F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0)), F.sum("share").over(after)))
    # the first source, in this order, whose cap is not below its part at its level, sets the level
    t = t.withColumn("water", F.min(F.when((F.col("share") > 0) & (F.col("level") * F.col("share") <= F.col("cap")), F.struct(F.col("cap") / F.col("share"), F.col("key"), F.col("level")))).over(one)["level"])
    t = t.withColumn("allotted", F.when(F.col("share") <= 0, 0.0).when(F.col("water").isNull(), F.col("cap").cast("double")).otherwise(F.least(F.col("cap").cast("double"), F.col("share") * F.col("water"))))
    t = t.withColumn("rate", F.when(F.col("tokens") > 0, F.col("allotted") / F.col("tokens")).otherwise(0.0))
    t = t.withColumn("whole", F.floor("rate")).withColumn("fraction", F.col("rate") - F.col("whole"))
    return t.select("source", "key", "share", "tokens", "documents", "cap", "wanted", "short", "allotted", "rate", "whole", "fraction")


def sample_mixture(documents: DataFrame, mix_targets: DataFrame, seed: int = 0) -> DataFrame:
    """Chosen records: doc_id, source, tokens, copies."""
    return _choose(*hash_bins(documents, seed), mix_targets)


def _bin_plan(bins: DataFrame, mix_targets: DataFrame) -> DataFrame:
    return _plan(bins.groupBy("key").agg(F.sum("n").alias("tokens"), F.sum("documents").alias("documents")), mix_targets)


def _choose(rows: DataFrame, bins: DataFrame, mix_targets: DataFrame) -> DataFrame:
    plan = _bin_plan(bins, mix_targets).select("key", "source", "whole", (F.col("fraction") * F.col("tokens")).alias("extra"))
    upto = Window.partitionBy("key").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    # at most 16 ** BIN_DIGITS rows a target, whatever the documents: small enough to be sent to every task
    places = bins.join(plan, "key").withColumn("upto", F.sum("n").over(upto)).select("key", "bin", "source", "whole", "extra", "upto", (F.col("upto") - F.col("n")).alias("below"))
    chosen = rows.join(places, ["key", "bin"])
    whole_bin = F.col("upto") <= F.col("extra")
    edge = ~whole_bin & (F.col("below") < F.col("extra"))
    # rows of the one bin on a source's edge are ordered among themselves, each other row is a window of its own hash
    run = Window.partitionBy("key", "bin", F.when(edge, F.lit("")).otherwise(F.col("h"))).orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    more = F.when(whole_bin, 1).when(edge & (F.col("below") + F.sum("tokens").over(run) <= F.col("extra")), 1).otherwise(0)
    return chosen.withColumn("copies", (F.col("whole") + more).cast("long")).filter("copies > 0").select("doc_id", "source", "tokens", "copies")


def actual_shares(documents: DataFrame, mix_targets: DataFrame, seed: int = 0) -> DataFrame:
    """For each target: wanted share, tokens chosen, documents chosen, actual share, whether it is short."""
    rows, bins = hash_bins(documents, seed)
    chosen = _choose(rows, bins, mix_targets).groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("chosen_tokens"), F.count("*").alias("chosen_documents"), F.max("copies").alias("most_copies"))
    plan = _bin_plan(bins, mix_targets).select("source", "share", "short", "allotted")
    out = plan.join(chosen, "source", "left").fillna(0, ["chosen_tokens", "chosen_documents", "most_copies"])
    return out.withColumn("actual_share", F.when(F.sum("chosen_tokens").over(Window.partitionBy(F.lit(1))) > 0, F.col("chosen_tokens") / F.sum("chosen_tokens").over(Window.partitionBy(F.lit(1)))).otherwise(0.0))
