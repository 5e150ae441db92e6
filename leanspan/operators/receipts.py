"""What a session has already seen: suppression, eviction, rebasing, reuse of counted queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .joins import near_signatures, overlap_join

EVIDENCE_MOST, RECEIPTS_MOST, TTL_HOURS = 2048, 128, 24
NEAR_BITS = 8


def decisions(requests: DataFrame) -> DataFrame:
    """session, position, decision: exact, overlap, near_duplicate or return, against everything earlier in the session.

    requests: session, position, path, a, b (lines), content_hash, and signature (64 bits)
    if near duplicates are to be told.  An equal hash is suppressed whatever its path; an
    overlapping range in the same path after that; what then has a signature within 8 bits
    of an earlier one is a near duplicate.  Near signatures meet within a session, each
    once, with the earliest position of each.
    The first position of a hash is an aggregate that is joined back, and ranges meet in
    bands of a path, so a session that holds a third of all rows is spread over tasks.
    """
    r = requests.filter("session is not null and position is not null")
    first = r.filter("content_hash is not null and content_hash <> ''").groupBy("session", "content_hash").agg(F.min("position").alias("first_position"))
    exact = r.join(first, ["session", "content_hash"], "left").withColumn("exact", F.coalesce(F.col("first_position") < F.col("position"), F.lit(False)))
    left = r.filter("path is not null and a is not null and b is not null").select(F.struct("session", "path").alias("place"), "position", "a", "b")
    right = left.select("place", F.col("position").alias("earlier"), F.col("a").alias("c"), F.col("b").alias("d")).groupBy("place", "c", "d").agg(F.min("earlier").alias("earlier"))
    seen = overlap_join(left, right, "place").filter("earlier < position").select(F.col("place.session").alias("session"), "position").distinct().withColumn("overlap", F.lit(True))
    out = exact.join(seen, ["session", "position"], "left")
    known = F.when(F.col("exact"), "exact").when(F.col("overlap"), "overlap")
    if "signature" not in requests.columns:
        return out.select("session", "position", known.otherwise("return").alias("decision"))
    signed = r.filter("signature is not null").groupBy("session", "signature").agg(F.min("position").alias("at"))
    pairs = near_signatures(signed, "signature", NEAR_BITS, ["session"])
    ends = F.explode(F.array(F.struct(F.col("left").alias("signature"), F.col("right").alias("other")), F.struct(F.col("right").alias("signature"), F.col("left").alias("other"))))
    both = pairs.select("session", ends.alias("e")).select("session", "e.signature", "e.other")
    near = both.join(signed.select("session", F.col("signature").alias("other"), "at"), ["session", "other"]).select("session", "signature", "at").unionByName(signed).groupBy("session", "signature").agg(F.min("at").alias("near_position"))
    return out.join(near, ["session", "signature"], "left").select("session", "position", known.when(F.col("near_position") < F.col("position"), "near_duplicate").otherwise("return").alias("decision"))


def retained(receipts: DataFrame, now: str, most: int = RECEIPTS_MOST, hours: int = TTL_HOURS) -> DataFrame:
    """receipts (session, receipt, ts) that are not past their time and among the last ``most`` of their session."""
    live = receipts.filter(F.col("ts") > F.to_timestamp(F.lit(now)) - F.expr(f"interval {hours} hours"))
    w = Window.partitionBy("session").orderBy(F.desc("ts"), F.desc("receipt"))
    return live.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= most).drop("n")


def rebase(evidence: DataFrame, files: DataFrame) -> DataFrame:
    """evidence_id, outcome: carried (its lines are as they were), changed, missing (no such file).

    evidence: evidence_id, path, a, b, content.  The content of a file is cut by lines in the JVM.
    """
    now = files.select("path", F.col("content").alias("current"))
    j = evidence.join(now, "path", "left")
    lines = F.slice(F.split("current", "\n"), F.col("a").cast("int"), (F.col("b") - F.col("a") + 1).cast("int"))
    cut = F.array_join(lines, "\n")
    same = F.col("content").isin("") | (cut == F.regexp_replace("content", r"\n\z", ""))
    return j.select("evidence_id", F.when(F.col("current").isNull(), "missing").when(same, "carried").otherwise("changed").alias("outcome"))


def reusable(requested: dict, recorded: dict) -> str:
    """exact, subset or none: whether a recorded exhaustive query answers a requested one.

    Equal predicate, scope and partition digest answer exactly; a narrower scope is
    answered only by a record without any match.
    """
    if requested["predicate"] != recorded["predicate"] or requested["partition"] != recorded["partition"] and requested["generation"] != recorded["generation"]:
        return "none"
    if requested["scope"] == recorded["scope"]:
        return "exact"
    return "subset" if set(recorded["scope"]) <= set(requested["scope"]) and recorded["matches"] == 0 else "none"
