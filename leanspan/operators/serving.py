"""What a request's answer needs: stored excerpts, eligibility, cursors, caps, accounting, manifests."""

from __future__ import annotations

import base64
import hashlib
import json
from bisect import bisect_right
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leanspan.functions.text import path_filter
from leanspan.functions.tokens import estimate_py


class TooMany(Exception):
    """A bound was exceeded; the answer would not be whole."""


class StaleCursor(Exception):
    """A cursor of another generation or query, or one that was changed."""


def capped(df: DataFrame, most: int, what: str) -> DataFrame:
    """The rows, or an error if there are more than ``most``; never a silent cut."""
    if df.limit(most + 1).count() > most:
        raise TooMany(f"more than {most} {what}")
    return df


def clamp(value: int | None, default: int, most: int) -> int:
    return default if value is None else max(1, min(value, most))


def cursor(position: dict, generation: int, query: str) -> str:
    """An opaque token of a position, bound to a generation and a query."""
    body = json.dumps([position, generation, query], sort_keys=True, separators=(",", ":"))
    return base64.urlsafe_b64encode((hashlib.sha256(body.encode()).hexdigest()[:16] + body).encode()).decode()


def position_of(token: str, generation: int, query: str) -> dict:
    try:
        raw = base64.urlsafe_b64decode(token.encode()).decode()
        position, made, of = json.loads(raw[16:])
    except ValueError as e:
        raise StaleCursor("no cursor") from e
    if hashlib.sha256(raw[16:].encode()).hexdigest()[:16] != raw[:16] or made != generation or of != query:
        raise StaleCursor("another generation or query")
    return position


def eligibility(path: str | Column, content_hash: str | Column, include: Sequence[str] = (), exclude: Sequence[str] = (), context_exclude: Sequence[str] = (), focus: Sequence[str] = (), changed: Sequence[str] = (), known: Sequence[str] = ()) -> Column:
    """path_excluded, known_hash or eligible.

    Context exclusions give way to an explicit include; a focus or a list of changed
    paths, where given, is strict.
    """
    p = F.col(path) if isinstance(path, str) else path
    h = F.col(content_hash) if isinstance(content_hash, str) else content_hash
    out = ~path_filter(p, list(include), list(exclude))
    if context_exclude and not include:
        out = out | ~path_filter(p, [], list(context_exclude))
    if focus:
        out = out | ~path_filter(p, list(focus), [])
    if changed:
        out = out | ~p.isin(*changed)
    return F.when(out, "path_excluded").when(h.isin(*known) if known else F.lit(False), "known_hash").otherwise("eligible")


def stored_excerpts(chunks: DataFrame, requests: DataFrame) -> DataFrame:
    """request_id, file_id, first, last, content of requested lines (request_id, file_id, a, b), put together from chunks.

    Requests may be as many as the files; of each chunk only the wanted lines are kept.
    """
    c = chunks.filter("id is not null").dropDuplicates(["id"])
    j = c.join(requests, "file_id").filter("start_line <= b and a <= end_line")
    # cut the lines inside the chunk; parts of one line stay in order of their bytes
    lo, hi = F.greatest("a", "start_line"), F.least("b", "end_line")
    lines = F.split("content", "\n")
    n = F.size(lines)
    picked = F.slice(lines, (lo - F.col("start_line") + 1).cast("int"), F.greatest((hi - lo + 1).cast("int"), F.lit(0)))
    ends = (F.col("start_line") + n - 1 > hi) | F.col("content").endswith("\n")
    text = F.concat(F.array_join(picked, "\n"), F.when(ends & (hi < F.col("end_line")), "\n").when(F.col("content").endswith("\n") & (hi == F.col("end_line")), "\n").otherwise(""))
    parts = j.select("request_id", "file_id", lo.alias("lo"), hi.alias("hi"), F.struct("start_byte", text.alias("t")).alias("part"))
    g = parts.groupBy("request_id", "file_id").agg(F.min("lo").alias("first"), F.max("hi").alias("last"), F.sort_array(F.collect_list("part")).alias("parts"))
    return g.select("request_id", "file_id", "first", "last", F.array_join(F.transform("parts", lambda x: x["t"]), "").alias("content"))


def line_starts_py(text: str) -> list[int]:
    data = text.encode("utf-8", "surrogatepass")
    return [0, *(k + 1 for k, c in enumerate(data[:-1]) if c == 10)] if data else []


def line_of_byte(starts: list[int], size: int, at: int) -> int:
    """1-based line of a byte; bytes beyond the text are on the last line."""
    return bisect_right(starts, min(at, size)) or 1


def bytes_of_lines(starts: list[int], size: int, first: int, last: int) -> tuple[int, int]:
    """Half-open bytes of closed lines; reversed and outer lines are put right."""
    if not starts:
        return 0, size
    first, last = sorted((max(1, first), max(1, last)))
    first, last = min(first, len(starts)), min(last, len(starts))
    return starts[first - 1], starts[last] if last < len(starts) else size


def truncate(text: str, most: int, count: Callable[[str], int] = estimate_py) -> tuple[str, int]:
    """The longest prefix within so many tokens, and its tokens; never inside a character."""
    lo, hi = 0, len(text)
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if count(text[:mid]) <= most else (lo, mid - 1)
    return text[:lo], count(text[:lo])


def bpe_counter(ranks_file: str, pattern: str) -> Callable[[str], int]:
    """An exact token counter over a vocabulary file of ranks, named by the caller."""
    import base64 as b

    import tiktoken

    with open(ranks_file, "rb") as f:
        ranks = {b.b64decode(a): int(n) for a, n in map(bytes.split, f)}
    encoding = tiktoken.Encoding("given", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return lambda text: len(encoding.encode_ordinary(text))


def response_accounting(response: dict, source: Sequence[str], count: Callable[[str], int] = estimate_py, rounds: int = 64) -> dict:
    """Tokens of a response: source, protocol (its skeleton), metadata, total; written into it until the numbers stop changing."""
    body = dict(response)
    source_tokens = sum(map(count, source))
    for _ in range(rounds):
        total = count(json.dumps(body, sort_keys=True, ensure_ascii=False))
        protocol = min(total, count(json.dumps(dict.fromkeys(body))))
        numbers = {"total": total, "source": source_tokens, "protocol": protocol, "metadata": max(0, total - source_tokens - protocol)}
        if body.get("tokens") == numbers:
            return body
        body["tokens"] = numbers
    return body


def fit_response(response: dict, optional: Sequence[str], fragments: str, budget: int, count: Callable[[str], int] = estimate_py) -> dict:
    """Drops optional parts in order, then keeps the largest prefix of fragments that fits."""
    from .ranking import largest_prefix

    body = dict(response)
    cost = lambda r: count(json.dumps(r, sort_keys=True, ensure_ascii=False))
    for name in optional:
        if cost(body) <= budget:
            return body
        body.pop(name, None)
    n = largest_prefix(len(body.get(fragments, [])), lambda k: cost(body | {fragments: body[fragments][:k]}), budget)
    return body | {fragments: body.get(fragments, [])[:n]}


def focus_diagnostics(candidates: DataFrame, selected: DataFrame, patterns: Sequence[str]) -> DataFrame:
    """For each focus pattern: generated, selected, and what stopped the rest first (path, known, budget, none).

    candidates: path, start_line, status (eligible, path_excluded, known_hash); selected: path, start_line.
    """
    chosen = selected.select("path", "start_line", F.lit(True).alias("chosen")).distinct()
    c = candidates.join(chosen, ["path", "start_line"], "left")
    counts = [
        c.filter(path_filter("path", [p])).agg(
            F.lit(p).alias("pattern"), F.count("*").alias("generated"), F.count(F.when(F.col("chosen"), 1)).alias("selected"), F.count(F.when(F.col("status") == "path_excluded", 1)).alias("by_path"), F.count(F.when(F.col("status") == "known_hash", 1)).alias("by_known"),
            F.count(F.when((F.col("status") == "eligible") & F.col("chosen").isNull(), 1)).alias("by_budget"),
        )
        for p in patterns
    ]
    out = counts[0]
    for x in counts[1:]:
        out = out.unionByName(x)
    first = F.when(F.col("generated") == 0, "not_generated").when(F.col("by_path") > 0, "path_excluded").when(F.col("by_known") > 0, "known_hash").when(F.col("by_budget") > 0, "budget_or_limit")
    return out.withColumn("first_blocker", first)


def handoff(task: str, paths: Sequence[str], symbols: Sequence[str], receipts: Sequence[str], most: int = 32, bytes_most: int = 2048) -> dict:
    """A manifest for the next worker: sorted, cut lists and a UTF-8 safe task text."""
    cut = task.encode()[:bytes_most].decode("utf-8", "ignore")
    lists = {"paths": paths, "symbols": symbols, "receipts": receipts}
    return {"task": cut, "task_truncated": cut != task, **{k: sorted(set(v))[:most] for k, v in lists.items()}, "omitted": {k: max(0, len(set(v)) - most) for k, v in lists.items()}}


def at_revision(blobs: DataFrame, path: str, revision: str) -> DataFrame:
    """The content of a path at a revision, from a table of blobs (revision, path, content)."""
    return blobs.filter((F.col("revision") == revision) & (F.col("path") == path)).select("revision", "path", "content")


def line_history(blobs: DataFrame, revisions: DataFrame, path: str, first: int, last: int) -> DataFrame:
    """Revisions (revision, ts) at which the lines of a path differ from the revision before, newest first."""
    from pyspark.sql import Window

    lines = F.array_join(F.slice(F.split("content", "\n"), first, last - first + 1), "\n")
    at = blobs.filter(F.col("path") == path).select("revision", lines.alias("lines")).join(revisions, "revision")
    w = Window.partitionBy(F.lit(path)).orderBy("ts", "revision")
    return at.withColumn("before", F.lag("lines").over(w)).filter(~F.col("lines").eqNullSafe(F.col("before"))).select("revision", "ts", "lines").orderBy(F.desc("ts"), F.desc("revision"))
