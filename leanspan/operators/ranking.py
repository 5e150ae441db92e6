"""Scoring, deduplication and packing of candidates under a token budget.

Scores are native columns.  Deduplication and packing depend on order and run as
Python over one task's candidates (a few hundred rows by construction: each channel
gives a bounded number per query), all tasks in parallel.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leanspan.functions.text import fingerprint, path_class, source_stem
from leanspan.functions.tokens import estimate

# Linear weights of the signals.
WEIGHTS = {"exact": 1.0, "symbol": 0.8, "reference": 0.5, "bm25": 0.4, "path_score": 0.25, "size": 0.15, "focus_boost": 0.35, "import_boost": 0.25, "change_boost": 0.2, "lexical_frequency_penalty": 0.25}
SIGNALS = ("exact", "symbol", "reference", "bm25", "path_score", "lexical_frequency_penalty", "size_score", "focus_boost", "import_boost", "change_boost")
FRAGMENTS, DIVERSITY, FLOOR = 8, 600, 0.25
EVIDENCE = "required-evidence:"
FACET = "facet:"

CANDIDATE_SCHEMA = (
    "task_id long, path string, start_line long, end_line long, content string, match_kinds array<string>, concepts array<string>, concept_weight double, representation string, symbol_name string, "
    "exact double, symbol double, reference double, bm25 double, path_score double, lexical_frequency_penalty double, size_score double, focus_boost double, import_boost double, change_boost double"
)
PACKED_SCHEMA = "task_id long, ordinal int, path string, start_line long, end_line long, token_count long, score double, content string, match_kinds array<string>, concepts array<string>"


def linear_score(weights: dict[str, float] = WEIGHTS, tokens: str = "token_count") -> Column:
    """The combined score of a row of signals; never negative."""
    c = lambda n: F.coalesce(F.col(n), F.lit(0.0))
    size = F.when(c("size_score") == 0, 1 / (1 + F.col(tokens) / 150.0)).otherwise(c("size_score"))
    base = c("exact") * weights["exact"] + c("symbol") * weights["symbol"] + c("reference") * weights["reference"] + c("bm25") / (1 + c("bm25")) * weights["bm25"] + c("path_score") * weights["path_score"] + size * weights["size"]
    boost = c("focus_boost") * weights["focus_boost"] + c("import_boost") * weights["import_boost"] + c("change_boost") * weights["change_boost"]
    return F.greatest(base + boost - c("lexical_frequency_penalty") * weights["lexical_frequency_penalty"], F.lit(0.0))


def scored(candidates: DataFrame, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """Candidates with token_count, content_hash, score, marginal, path_class and stem, as native columns."""
    c = candidates.withColumn("token_count", F.greatest(estimate("content"), F.lit(1))).withColumn("content_hash", fingerprint("content")).withColumn("path_class", path_class("path")).withColumn("stem", source_stem("path"))
    return c.withColumn("score", linear_score(weights)).withColumn("marginal", F.col("score") / F.col("token_count"))


@dataclass
class Item:
    """One scored candidate in a packing task."""

    path: str
    start: int
    end: int
    content: str
    hash: str
    tokens: int
    score: float
    kinds: list[str]
    concepts: list[str]
    weight: float
    view: str
    cls: str
    stem: str
    symbol_name: str | None = None
    signals: dict[str, float] = field(default_factory=dict)

    def rescore(self) -> None:
        s, w = self.signals, WEIGHTS
        size = s["size_score"] or 1 / (1 + self.tokens / 150.0)
        base = s["exact"] * w["exact"] + s["symbol"] * w["symbol"] + s["reference"] * w["reference"] + s["bm25"] / (1 + s["bm25"]) * w["bm25"] + s["path_score"] * w["path_score"] + size * w["size"]
        self.score = max(0.0, base + s["focus_boost"] * w["focus_boost"] + s["import_boost"] * w["import_boost"] + s["change_boost"] * w["change_boost"] - s["lexical_frequency_penalty"] * w["lexical_frequency_penalty"])

    def absorb(self, other: Item) -> None:
        self.kinds = list(dict.fromkeys(self.kinds + other.kinds))
        self.concepts = list(dict.fromkeys(self.concepts + other.concepts))
        self.weight = max(self.weight, other.weight)
        self.symbol_name = self.symbol_name or other.symbol_name
        for k in self.signals:
            self.signals[k] = (min if k == "lexical_frequency_penalty" else max)(self.signals[k], other.signals[k])
        self.rescore()

    def has(self, facet: str, exact: bool = False) -> bool:
        return any(k == FACET + facet or k.startswith(f"{FACET}{facet}:") for k in self.kinds) and (not exact or self.exact_atom)

    @property
    def exact_atom(self) -> bool:
        return any(k.startswith("exact-atom:") for k in self.kinds)

    def facet_values(self, facet: str) -> set[str]:
        return {k for k in self.kinds if k.startswith(f"{FACET}{facet}:")}

    @property
    def utility(self) -> tuple:
        return (-self.score, -self.score / self.tokens, self.tokens, self.path, self.start)


def deduplicate(items: list[Item]) -> list[Item]:
    """Keeps one of equal contents in a file, and one of ranges that share half of the shorter; signals merge.

    A fragment that carries required evidence is not given up to one that lacks it.
    """
    kept: list[Item] = []
    by_hash: dict[tuple[str, str], Item] = {}
    by_path: dict[str, list[Item]] = {}
    for item in sorted(items, key=lambda x: (-x.signals["exact"], -x.score, x.path, x.start)):
        twin = by_hash.get((item.path, item.hash))
        if twin is None:
            for other in by_path.get(item.path, ()):
                shared = min(item.end, other.end) - max(item.start, other.start) + 1
                shorter = min(item.end - item.start, other.end - other.start) + 1
                if shared > 0 and 2 * shared >= shorter and all(k in other.kinds for k in item.kinds if k.startswith(EVIDENCE)):
                    twin = other
                    break
        if twin is not None:
            twin.absorb(item)
            continue
        by_hash[item.path, item.hash] = item
        by_path.setdefault(item.path, []).append(item)
        kept.append(item)
    return sorted(kept, key=lambda x: (-x.score, x.path, x.start))


def affinity(owner: Item, test: Item) -> int:
    """How surely a test belongs to an owner by their paths: 4, 2, 1 or 0."""
    a, b = owner.path.rpartition("/")[0], test.path.rpartition("/")[0]
    if (owner.stem == test.stem and a == b) or (a and a == b and a.rpartition("/")[2].lower() == test.stem):
        return 4
    if min(len(owner.stem), len(test.stem)) < 4:
        return 0
    if owner.stem.startswith(test.stem) or test.stem.startswith(owner.stem):
        return 2
    parts = {p for p in re.split(r"[^a-z0-9]", owner.stem) if len(p) >= 4}
    return int(bool(parts & set(re.split(r"[^a-z0-9]", test.stem))))


class Packer:
    """Greedy selection under a token budget, per-file cap, fragment cap and class quotas.

    Phases, each over what is left in order of utility: the owner of the primary
    change, its test, a constraint to preserve, fragments with new strong concepts,
    further views of decisive concepts, further concepts with confidence, filling.  A
    fragment that does not fit is passed over, and later smaller ones may still fit.
    """

    def __init__(self, budget: int, per_file: int, fragments: int, used_files: Counter | None = None):
        self.budget, self.per_file, self.fragments = budget, per_file, fragments
        self.files: Counter = Counter(used_files or {})
        self.chosen: list[Item] = []
        self.used = 0
        self.quota: Counter = Counter()
        self.concepts: set[str] = set()
        self.views: set[tuple[str, str]] = set()
        self.first_path: dict[str, str] = {}

    def _marks(self, x: Item) -> list[tuple[str, int]]:
        two = min(2, self.fragments)
        out = []
        if x.cls == "auxiliary":
            out.append(("auxiliary", min(1, self.fragments)))
        if x.cls == "test":
            out.append(("test", two))
        for facet in ("failure_trace", "preserve_constraint"):
            if x.has(facet):
                out.append((facet, two))
        return out

    def fits(self, x: Item) -> bool:
        return x.tokens <= self.budget - self.used and self.files[x.path] < self.per_file and len(self.chosen) < self.fragments and all(self.quota[m] < n for m, n in self._marks(x))

    def take(self, x: Item, views: bool = True, concepts: bool = True, paths: bool = True) -> None:
        for m, _ in self._marks(x):
            self.quota[m] += 1
        self.used += x.tokens
        self.files[x.path] += 1
        self.chosen.append(x)
        if concepts:
            self.concepts.update(x.concepts)
        if views:
            self.views.update((c, x.view) for c in x.concepts)
        if paths:
            for c in x.concepts:
                self.first_path.setdefault(c, x.path)

    def _owner(self, pool: list[Item], cls: str) -> Item | None:
        """The item that the change is most likely in: named exactly, or else of the leading view the one that meets most of what the change names."""
        named = lambda x: x.facet_values("primary_change")
        fitting = [x for x in pool if x.cls == cls and self.fits(x) and x.has("primary_change")]
        if not fitting:
            return None
        lead = min(fitting, key=lambda x: (not x.exact_atom, not named(x)))
        if lead.exact_atom:
            return lead
        return max((x for x in fitting if x.view == lead.view and named(lead) <= named(x)), key=lambda x: len(named(x)))

    def run(self, items: list[Item]) -> tuple[list[Item], list[Item]]:
        pool = sorted(items, key=lambda x: x.utility)
        floor = pool[0].score * FLOOR if pool else 0.0
        owner = self._owner(pool, "production") or self._owner(pool, "supporting")
        if owner is not None:
            pool.remove(owner)
            self.take(owner)
        tests = [(n, x) for n, x in enumerate(pool) if x.cls == "test" and self.fits(x) and (x.exact_atom or owner is not None and affinity(owner, x) or self.concepts & set(x.concepts))]
        if tests:
            near = {n: affinity(owner, x) if owner is not None else 0 for n, x in tests}
            best = max(tests, key=lambda t: (near[t[0]] >= 3, t[1].exact_atom, near[t[0]], -t[0]))[1]
            pool.remove(best)
            self.take(best)
        preserve = next((x for x in pool if x.cls != "auxiliary" and x.has("preserve_constraint") and self.fits(x)), None)
        if preserve is not None:
            pool.remove(preserve)
            self.take(preserve)

        def sweep(left: list[Item], want, **how: bool) -> list[Item]:
            rest = []
            for x in left:
                if want(x) and self.fits(x):
                    self.take(x, **how)
                else:
                    rest.append(x)
            return rest

        fresh = lambda x: any(c not in self.concepts for c in x.concepts)
        left = sweep(pool, lambda x: fresh(x) and x.weight >= 1.0)
        left.sort(key=lambda x: (not any(self.first_path.get(c) == x.path for c in x.concepts), x.utility))
        left = sweep(left, lambda x: x.weight >= 1.8 and any(c in self.concepts and (c, x.view) not in self.views for c in x.concepts), concepts=False, paths=False)
        sure = lambda x: x.weight >= 1.0 or x.score >= floor
        left = sweep(left, lambda x: fresh(x) and sure(x), views=False, paths=False)
        left = sweep(left, sure, views=False, concepts=False, paths=False)
        return self.chosen, left


def required_first(items: list[Item], budget: int, fragments: int, must_paths: list[str] = (), must_symbols: list[str] = (), evidence: list[tuple[int, int]] = ()) -> tuple[list[Item], list[Item]]:
    """Fragments that a request demands, in order: evidence (index, how many queries of it), paths, symbols."""
    pool, chosen, used = list(items), [], 0

    def pick(want) -> bool:
        nonlocal used
        x = next((x for x in pool if want(x) and x.tokens <= budget - used), None)
        if x is None or len(chosen) >= fragments:
            return False
        pool.remove(x)
        chosen.append(x)
        used += x.tokens
        return True

    for index, needed in evidence:
        mark = f"{EVIDENCE}{index}:"
        while True:
            got = {k for x in chosen for k in x.kinds if k.startswith(mark)}
            if len(got) >= needed or not pick(lambda x, got=got, mark=mark: any(k.startswith(mark) and k not in got for k in x.kinds)):
                break
    for path in must_paths:
        ok = lambda x, p=path: x.path == p or x.path.startswith(p.rstrip("/") + "/")
        if not any(map(ok, chosen)):
            pick(ok)
    for name in must_symbols:
        ok = lambda x, n=name: x.symbol_name == n or (x.symbol_name or "").rpartition(".")[2] == n
        if not any(map(ok, chosen)):
            pick(ok)
    return chosen, pool


def pack_items(items: list[Item], budget: int, fragments: int = FRAGMENTS, must_paths: list[str] = (), must_symbols: list[str] = (), evidence: list[tuple[int, int]] = ()) -> tuple[list[Item], list[Item]]:
    """(selected, omitted) of one task's candidates."""
    ranked = deduplicate(items)
    first, rest = required_first(ranked, budget, fragments, must_paths, must_symbols, evidence)
    packer = Packer(budget - sum(x.tokens for x in first), max(1, min(3, budget // DIVERSITY)), fragments - len(first), Counter(x.path for x in first))
    more, omitted = packer.run(rest)
    return first + more, omitted


def items_of(frame: pd.DataFrame) -> list[Item]:
    num = lambda v: 0.0 if pd.isna(v) else float(v)
    out = []
    for r in frame.to_dict("records"):
        out.append(Item(r["path"], int(r["start_line"]), int(r["end_line"]), r["content"], r["content_hash"], int(r["token_count"]), float(r["score"]), [*(r["match_kinds"] if r["match_kinds"] is not None else ())], [*(r["concepts"] if r["concepts"] is not None else ())], num(r["concept_weight"]), r["representation"] or "", r["path_class"], r["stem"], r["symbol_name"], {k: num(r[k]) for k in SIGNALS}))
    return out


def pack(candidates: DataFrame, budget: int, fragments: int = FRAGMENTS, demands: dict[int, tuple] | None = None) -> DataFrame:
    """PACKED_SCHEMA: the selected fragments of every task, in order, within the budget; demands: task -> (paths, symbols, evidence)."""
    demands = demands or {}

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        task = int(frame["task_id"].iloc[0])
        chosen, _ = pack_items(items_of(frame), budget, fragments, *demands.get(task, ()))
        return pd.DataFrame([(task, k, x.path, x.start, x.end, x.tokens, round(x.score, 4), x.content, x.kinds, x.concepts) for k, x in enumerate(chosen)], columns=[c.split()[0] for c in PACKED_SCHEMA.split(", ")])

    return scored(candidates).groupBy("task_id").applyInPandas(run, PACKED_SCHEMA)


def dedup(candidates: DataFrame) -> DataFrame:
    """Deduplicated candidates of every task: ranges never meet across files, so a file of a task is a group."""
    schema = "task_id long, path string, start_line long, end_line long, score double, match_kinds array<string>"

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(int(frame["task_id"].iloc[0]), x.path, x.start, x.end, round(x.score, 4), x.kinds) for x in deduplicate(items_of(frame))], columns=[c.split()[0] for c in schema.split(", ")])

    return scored(candidates).groupBy("task_id", "path").applyInPandas(run, schema)


def adaptive_window(first: int, last: int, matched: int, lines: int) -> tuple[int, int]:
    """A window of so many lines of a declaration, a third of them before the match, moved inside the declaration."""
    lines = min(max(lines, 1), last - first + 1)
    start = max(first, min(matched - lines // 3, last - lines + 1))
    return start, start + lines - 1


def fit_excerpt(lines: list[str], first: int, matched: int, budget: int, count, low: int = 12, high: int = 128) -> tuple[int, int] | None:
    """The widest window of a declaration's lines around the match within a token budget, or None if its line alone is above it."""
    last = first + len(lines) - 1
    if not first <= matched <= last:
        return None
    cost = lambda w: count("".join(lines[w[0] - first: w[1] - first + 1]))
    full = max(1, count("".join(lines)))
    if full <= budget:
        return first, last
    size = min(max(low, min(high, len(lines) * budget // full)), len(lines))
    if cost(adaptive_window(first, last, matched, size)) <= budget:
        return adaptive_window(first, last, matched, size)
    if cost((matched, matched)) > budget:
        return None
    lo, hi = 1, size - 1
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if cost(adaptive_window(first, last, matched, mid)) <= budget else (lo, mid - 1)
    return adaptive_window(first, last, matched, lo)


def largest_prefix(n: int, cost, budget: int) -> int:
    """The most of n parts whose prefix costs no more than the budget; cost grows with the prefix."""
    lo, hi = 0, n
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if cost(mid) <= budget else (lo, mid - 1)
    return lo


def outline(symbols: DataFrame, budget: int) -> DataFrame:
    """Symbols of every file in order of place, within a token budget; rows that do not fit are skipped, later ones may fit."""
    schema = "file_id long, symbol_id long, name string, kind string, start_line long, end_line long, tokens long"
    s = symbols.filter("id is not null and file_id is not null").dropDuplicates(["id"]).select("file_id", "id", "name", "kind", "start_line", "end_line", estimate(F.concat_ws(" ", "kind", F.coalesce("signature", "name"))).alias("tokens"))
    grouped = s.groupBy("file_id").agg(F.sort_array(F.collect_list(F.struct("start_line", "id", "name", "kind", "end_line", "tokens"))).alias("rows"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for file, rows in zip(batch["file_id"], batch["rows"]):
                left = budget
                for r in rows:
                    if r["tokens"] <= left:
                        left -= r["tokens"]
                        out.append((file, r["id"], r["name"], r["kind"], r["start_line"], r["end_line"], r["tokens"]))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])

    return grouped.mapInPandas(run, schema)


def coverage(selected: DataFrame, requirements: DataFrame) -> DataFrame:
    """For each required path or evidence text of a task whether the selection covers it: covered, partial or uncovered.

    requirements: task_id, kind (path or evidence), value.  Both sides are per task and small.
    """
    j = requirements.join(selected.select("task_id", "path", "content"), "task_id", "left")
    full = F.when(F.col("kind") == "path", (F.col("path") == F.col("value")) | F.col("path").startswith(F.concat("value", F.lit("/")))).otherwise(F.col("content").contains(F.col("value")))
    part = F.when(F.col("kind") == "path", F.lit(False)).otherwise(F.lower("content").contains(F.lower("value")))
    g = j.groupBy("task_id", "kind", "value").agg(F.max(F.coalesce(full, F.lit(False))).alias("full"), F.max(F.coalesce(part, F.lit(False))).alias("part"))
    return g.select("task_id", "kind", "value", F.when(F.col("full"), "covered").when(F.col("part"), "partial").otherwise("uncovered").alias("status"))
