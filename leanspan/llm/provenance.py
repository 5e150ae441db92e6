"""Generated, minified, vendored and data files among source files (problem 2).

Linear support-vector classifiers read hashed character n-grams of a file's body,
character n-grams of the comment that it begins with, and the components of its path.
One of them decides whether a file is hand-written; one for each kind names the kind of
a file that is not.  They learn from files that say of themselves what they are (a
tool's header, a notice of a copied library, the entries of a lock file) or are plainly
so by their shape.  The words that such a label rests on are masked out of the head's
n-grams, in training and in use, and no measure of shape is a feature, so that the
score does not repeat the rules that made the labels.  Training and validation are
split by repository.

A file is named when its score is above the threshold; the rules name none.  One exact
check follows: a file whose head says that it is kept by hand is not named.

Defined results: null ids and null, empty or blank contents, Markdown and HTML are
never named; null paths count as no path; null languages are judged by path and
content; very long texts are read whole; equal rows count once; with too few labelled
files of either kind nothing can be learned, and the rules stand in for the score;
extra columns are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Files to train and validate on, at most; those whose ids have the smallest hashes.
SAMPLE = 3000
GRAM, BODY_BITS, HEAD_BITS, PATH_BITS = 4, 13, 12, 11
WIDTH = (1 << BODY_BITS) + (1 << HEAD_BITS) + (1 << PATH_BITS) + 1
KINDS = ("generated", "minified", "vendored", "data", "lock")
EPOCHS, LAMBDA = 12, 1e-4
SHAPE_LEAST = 800  # code points that a text needs for its shape to be a label; the score has no such bound
FOUND_SCHEMA = "file_id long, kind string, score double"

_COMMENT_LINE = re.compile(r"^\s*(?://|#(?!include|define|pragma|\[)|/?\*|<!--|--|;|@|[rRuU]?(?:\"\"\"|'''))")
_DOCSTRING = re.compile(r"[rRuU]?(\"\"\"|''')")
_LINE = re.compile(r"[^\n]*\n|[^\n]+")
_GENERATED = re.compile(
    r"(?i)\bcode generated\b.*\bdo not (?:edit|modify)\b|@generated\b|\bauto-?generated\b(?!\s+method)|<auto-generated|\bautomatically (?:generated|created)\b|\bmachine[- ](?:written|generated|made)\b|\bgenerated (?:on|by|from|at|with|using|automatically)\b|\bthis file (?:is|was) (?:generated|produced|created) (?:by|from|automatically)|\bdo not (?:edit|modify)\b.*\b(?:generated|regenerate|overwritten)\b|\bgenerated (?:file|code|source)s?\b.*\bdo not\b"
)
_BY_HAND = re.compile(r"(?i)\bnot (?:auto-?)?generated\b|\bscaffolded once\b|\b(?:maintained|kept|edited|written|updated) by hand\b|\bwrites? (?:files?|code)\b|\bhand-?(?:written|maintained)\b|\bused to be generated\b|\bno longer generated\b|\bgenerator (?:for|of|that)\b|\bfiles that (?:start|begin)\b")
_NOTICE = re.compile(r"(?i)\bsee upstream\b|\bupstream for the (?:full )?(?:text|licen[cs]e)|\bvendored (?:from|copy)|\bcopied from (?:https?://|upstream)|\bthird[- ]party (?:code|library|copy)\b|\bimported from upstream\b|^\W*[\w.\-]+ v?\d+\.\d+(?:\.\d+)?\S* - .*\b(?:library|package|module|framework)\b")
_VENDOR_DIR = re.compile(r"(?i)(?:^|/)(?:node_modules|vendor|third[_-]?party|external|externals|Godeps|_workspace|deps|contrib|copied|bower_components|Pods|extern|subprojects)/")
_LOCK = re.compile(r"(?:^|/)(?:[\w.\-]*\.lock|go\.sum|package-lock\.json|npm-shrinkwrap\.json|pnpm-lock\.yaml|[\w\-]*\.lockfile|packages\.lock\.json|flake\.lock|gradle\.lockfile|Package\.resolved)$", re.I)
_LOCK_LINE = re.compile(r"(?im)\bh1:[\w+/=]{40,}|\"?(?:integrity|resolved|checksum|content-hash|hash|sha256|version)\"?\s*[:=]\s*\"|^\[\[package\]\]|\bsha\d{3}-[\w+/=]{20,}")


def head_of(text: str) -> tuple[list[str], int]:
    """The comment lines that a file begins with, whole, and where they end."""
    body = text.lstrip("\ufeff")
    at = len(text) - len(body)
    out = []
    inside = ""  # what ends the comment or docstring that is open
    for m in _LINE.finditer(body):
        line = m.group()
        s = line.strip()
        if not (inside or not s or _COMMENT_LINE.match(line) or s.startswith(("<?", "#!", "/*!"))):
            break
        end = len(line)
        if not inside:
            after = line.find(s)
            if s.startswith("/*"):
                inside, after = "*/", after + 2
            elif d := _DOCSTRING.match(s):
                inside, after = d[1], after + d.end()
        else:
            after = 0
        if inside and (close := line.find(inside, after)) >= 0:
            end, inside = close + len(inside), ""
            if not line[end:].strip():
                end = len(line)
        said = line[:end].strip()
        if said:
            out.append(said)
        at += end
        if end < len(line):  # code stands behind the comment's end
            break
    return out, at


def notes(text: str, path: str) -> str:
    """What a file says of itself: lock, generated, vendored, or nothing."""
    if _LOCK.search(path) and len(_LOCK_LINE.findall(text)) >= 2:
        return "lock"
    head, _ = head_of(text)
    said = " ".join(head)
    if _BY_HAND.search(said):
        return ""
    if any(_GENERATED.search(x) for x in head):
        return "generated"
    if any(_NOTICE.search(x) for x in head):
        return "vendored"
    return ""


_LITERAL = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\[\s\S])*`|(?<![\w.])-?(?:0[xX][\da-fA-F]+|\d[\d_]*\.?\d*(?:[eE][+-]?\d+)?)\b")
_SEPARATORS = {ord(c): None for c in " \t\r\n,;:(){}[]"}
_CLASSES = bytes(ord("0") if chr(c).isdigit() and c < 128 else ord("w") if c > 127 or chr(c).isalpha() or c == ord("_") else c for c in range(256))
_RUNS = re.compile(rb"[w0]{2,}")
_SPACES = re.compile(r"[^\S\n\r\t ]")
_ROWS = re.compile(rb"(?:0[ \t,]*){2,}")
_CODE_EXT = re.compile(r"\.(?:[cm]?[jt]sx?|css|py|rs|go|java|cc|cpp|cxx|c|h|hpp|json)$", re.I)


def shape(text: str) -> dict[str, float]:
    """Measures of a text's lines and literals.

    One line that is far longer than the rest says nothing about a file of many lines,
    so it is left out of the measures of such a file.
    """
    if not text.isascii():
        text = _SPACES.sub(" ", text)
    full = [x for x in text.split("\n") if x.strip()] or [""]
    if len(full) > 10:
        longest = max(range(len(full)), key=lambda k: len(full[k]))
        if len(full[longest]) > 300:
            full = full[:longest] + full[longest + 1:]
            text = "\n".join(full)
    n = max(len(text), 1)
    long_part = sum(len(x) for x in full if len(x) > 300) / n
    # of what is neither blank nor a separator, the part that stands in literals
    rest = _LITERAL.sub("", text).translate(_SEPARATORS)
    literal = 1 - len(rest) / max(len(text.translate(_SEPARATORS)), 1)
    # letters and digits by class, then runs of them, then rows of numbers
    classes = text.encode("utf-8", "replace").translate(_CLASSES)
    numbered = sum(b"w0" in x for x in classes.split(b"\n")) / len(full)
    runs = _ROWS.sub(b"0*", _RUNS.sub(lambda m: m.group()[:1], classes))
    shapes = {x.strip() for x in runs.split(b"\n") if x.strip()}
    white = sum(text.count(c) for c in " \n\t") / n
    return {"long": long_part, "literal": literal, "variety": len(shapes) / len(full), "white": white, "numbered": numbered, "lines": len(full), "mean": n / len(full), "size": n}


RECORDS = 20  # of like form, that make a JSON text a dump


def _dump(text: str) -> bool:
    """Whether a JSON text is mainly one long list of records or values."""
    try:
        value = json.loads(text)
    except (ValueError, RecursionError):
        records = re.findall(r"\{[^{}]*\}", text)
        keys = Counter(tuple(re.findall(r'"(\w+)"\s*:', r)) for r in records)
        return len(records) >= RECORDS and max(keys.values()) > 0.9 * len(records) and sum(map(len, records)) > 0.7 * len(text)
    while isinstance(value, dict) and value:
        value = max(value.values(), key=lambda v: len(v) if isinstance(v, (list, dict)) else 0)
    if not isinstance(value, list) or len(value) < RECORDS:
        return False
    kinds = Counter(tuple(sorted(v)) if isinstance(v, dict) else type(v).__name__ for v in value)
    return max(kinds.values()) > 0.9 * len(value)


def shaped_as(text: str, path: str, language: str | None, s: dict[str, float] | None = None) -> str:
    """minified, data or numbered, judged by the text's shape alone."""
    p = path.lower()
    if not _CODE_EXT.search(p):
        return ""
    if p.endswith(".json"):
        return "data" if _dump(text) else ""
    s = s or shape(text)
    if s["white"] < 0.12 and s["long"] > 0.7 and s["literal"] < 0.6 and p.endswith((".js", ".mjs", ".cjs", ".css", ".jsx", ".ts")):
        return "minified"
    if s["literal"] > 0.75 and (s["variety"] < 0.25 or s["long"] > 0.6 or s["lines"] <= 6):
        return "data"
    body = [x for x in text.split("\n") if x.strip()]
    if s["lines"] >= 8 and s["variety"] < 0.35 and s["numbered"] > 0.3 and _counts_up(body):
        return "numbered"
    return ""


def _counts_up(lines: list[str]) -> bool:
    """Whether names with running numbers follow each other through the text."""
    numbers = [int(m[1]) for x in lines for m in [re.search(r"[A-Za-z_](\d{1,5})\b", x)] if m]
    steps = [b - a for a, b in zip(numbers, numbers[1:])]
    return len(steps) >= 5 and sum(d in (0, 1) for d in steps) > 0.8 * len(steps) and sum(d == 1 for d in steps) >= 4


def _buckets(codes: np.ndarray, bits: int) -> np.ndarray:
    return ((codes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


def _grams(text: str, bits: int) -> np.ndarray:
    """Damped counts of hashed n-grams, of length one; digits are one character."""
    data = np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8)
    if len(data) < GRAM:
        return np.zeros(1 << bits, dtype=np.float32)
    table = _TABLE[data].astype(np.uint64)
    codes = table[: len(table) - GRAM + 1].copy()
    for k in range(1, GRAM):
        codes = codes * np.uint64(257) + table[k: len(table) - GRAM + 1 + k]
    out = np.log1p(np.bincount(_buckets(codes, bits), minlength=1 << bits).astype(np.float32))
    return out / float(np.linalg.norm(out))


def masked(head: list[str]) -> str:
    """A head without the words that labels rest on."""
    return "\n".join(_NOTICE.sub(" ", _GENERATED.sub(" ", x)) for x in head)


def features(text: str, path: str) -> np.ndarray:
    """The hashed features of a file: body, masked head, path, and a constant."""
    out = np.zeros(WIDTH, dtype=np.float32)
    head, at = head_of(text)
    out[: 1 << BODY_BITS] = _grams(text[at:], BODY_BITS)
    if head:
        out[1 << BODY_BITS: (1 << BODY_BITS) + (1 << HEAD_BITS)] = _grams(masked(head), HEAD_BITS)
    parts = [x for x in path.lower().split("/")[1:] if x]
    names = [f"d:{x}" for x in parts[:-1]] + ([f"f:{x}" for x in re.split(r"[._\-]", parts[-1]) if x] + ["e:" + parts[-1].rpartition(".")[2]] if parts else [])
    for x in names:
        out[(1 << BODY_BITS) + (1 << HEAD_BITS) + zlib.crc32(x.encode()) % (1 << PATH_BITS)] += 0.25
    out[-1] = 0.3
    return out


_TABLE = np.arange(256, dtype=np.uint16)
_TABLE[ord("0"): ord("9") + 1] = ord("0")


class Classifier:
    """Weights of the deciding machine and of one for each kind, the threshold, and figures of the validation."""

    def __init__(self, weights: np.ndarray, threshold: float, report: dict[str, float], kinds: dict[str, np.ndarray] | None = None):
        self.weights, self.threshold, self.report, self.kinds = weights, threshold, report, kinds or {}

    def score(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weights

    def kind(self, x: np.ndarray) -> str:
        """The kind whose machine gives the highest score."""
        return max(self.kinds, key=lambda k: float(x @ self.kinds[k]), default="classified")


def hinge(x: np.ndarray, y: np.ndarray, seed: int) -> np.ndarray:
    """Hinge loss with L2, by averaged stochastic subgradients; both classes weigh the same."""
    rng = np.random.default_rng(seed)
    w = np.zeros(x.shape[1], dtype=np.float64)
    mean = np.zeros_like(w)
    balance = np.where(y > 0, len(y) / (2 * max((y > 0).sum(), 1)), len(y) / (2 * max((y < 0).sum(), 1)))
    step, batch = 0, 32
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for at in range(0, len(order), batch):
            k = order[at: at + batch]
            step += 1
            rate = 2.0 / (1 + 0.01 * step)
            wrong = y[k] * (x[k] @ w) < 1
            grad = -(x[k][wrong] * (y[k] * balance[k])[wrong, None]).sum(0) / len(k) if wrong.any() else 0
            w = (1 - rate * LAMBDA) * w - rate * grad
            mean += w
    return (mean / max(step, 1)).astype(np.float32)


def fit(x: np.ndarray, y: np.ndarray, groups: np.ndarray, kinds: np.ndarray | None = None, seed: int = 7) -> Classifier | None:
    """Fits on four fifths of the groups (repositories) and validates on the rest.

    The threshold lies between the lower margin, -1, and the boundary, 0, where the
    validation files are told apart best (F1); of equally good places it takes the one
    nearest to the boundary.  It does not rise above that: the rules miss files that are
    not hand-written much more often than they name one that is, so what they call
    hand-written beyond the boundary is no reason to move it.
    """
    held = groups % 5 == 0
    if min((y > 0).sum(), (y < 0).sum()) < 5 or not (~held).any():
        return None
    tx, ty, tk = x[~held], y[~held], None if kinds is None else kinds[~held]
    if len(set(ty.tolist())) < 2:
        tx, ty, tk = x, y, kinds
    w = hinge(tx, ty, seed)
    judge = held if held.any() and (y[held] > 0).any() else np.ones(len(y), dtype=bool)
    score, truth = x[judge] @ w, y[judge] > 0
    places = np.unique(np.concatenate([[0.0], np.clip(np.sort(score), -1, 0)]))
    places = np.concatenate([places, (places[1:] + places[:-1]) / 2])

    def f1(t: float) -> float:
        hit = score > t
        return 2 * float((hit & truth).sum()) / max(1, int(hit.sum()) + int(truth.sum()))

    threshold = float(max(places, key=lambda t: (round(f1(t), 9), -abs(t))))
    hit = score > threshold
    report = {
        "validation": float(len(truth)), "positives": float(truth.sum()), "accuracy": float((hit == truth).mean()), "recall": float((hit & truth).sum() / max(1, truth.sum())),
        "precision": float((hit & truth).sum() / max(1, hit.sum())),
    }
    named = {}
    if tk is not None:
        of = ty > 0
        for k in KINDS:
            if (tk[of] == k).sum() >= 3:
                named[k] = hinge(tx[of], np.where(tk[of] == k, 1, -1), seed)
    return Classifier(w, threshold, report, named)


def label(text: str, path: str, language: str | None) -> tuple[int, str]:
    """(1, kind) for a file that says or plainly shows that it is not hand-written, -1 for others, 0 for doubtful."""
    if by_hand(text):
        return -1, ""
    if kind := notes(text, path):
        return 1, kind
    if kind := shaped_as(text, path, language):
        # the shape of a few lines proves nothing, so such a file teaches nothing
        return (1, "generated" if kind == "numbered" else kind) if len(text) >= SHAPE_LEAST else (0, "")
    return (0, "") if _VENDOR_DIR.search(path) else (-1, "")


def by_hand(text: str) -> bool:
    """Whether the head says that the file is kept by hand."""
    return bool(_BY_HAND.search(" ".join(head_of(text)[0])))


def evidence(text: str, path: str, language: str | None) -> str:
    """What a label rests on: the head's words, lock entries or the text's shape, which a few lines don't show."""
    return notes(text, path) or (shaped_as(text, path, language) if len(text) >= SHAPE_LEAST else "")


def _usable(files: DataFrame) -> DataFrame:
    return files.filter(F.col("id").isNotNull() & ~F.coalesce("language", F.lit("")).isin("markdown", "html"))


def train(files: DataFrame, sample: int = SAMPLE) -> Classifier | None:
    """Fits the classifiers on at most ``sample`` files.

    The sample is drawn from the id column alone; labels and features are made on the
    executors, and the driver receives at most ``sample`` sparse rows (a few KB each).
    """
    h = F.xxhash64("id")
    top = _usable(files).select(h.alias("h")).orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    if top is None:
        return None
    repository = F.col("repository") if "repository" in files.columns else F.split("path", "/")[0]
    drawn = _usable(files).filter(h <= top).select("path", "language", "content", F.crc32(F.coalesce(repository, F.lit(""))).alias("crc"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, lang, text, crc in zip(batch["path"], batch["language"], batch["content"], batch["crc"]):
                if not text or not text.strip():
                    continue
                y, kind = label(text, path or "", lang)
                if y:
                    x = features(text, path or "")
                    at = np.flatnonzero(x)
                    out.append((y, kind, int(crc), zlib.crc32(text.encode("utf-8", "replace")), at.astype(np.uint16).tobytes(), x[at].astype(np.float16).tobytes()))
            yield pd.DataFrame(out, columns=["y", "kind", "crc", "text", "at", "x"])

    rows = drawn.mapInPandas(run, "y int, kind string, crc long, text long, at binary, x binary").toPandas()
    if not len(rows):
        return None
    # one order for any partitioning
    rows = rows.sort_values(["crc", "text", "y", "kind", "at"], kind="stable")
    x = np.zeros((len(rows), WIDTH), dtype=np.float32)
    for k, (at, value) in enumerate(zip(rows["at"], rows["x"])):
        x[k, np.frombuffer(at, dtype=np.uint16)] = np.frombuffer(value, dtype=np.float16)
    return fit(x, rows["y"].to_numpy(), rows["crc"].to_numpy(), rows["kind"].to_numpy(dtype=str))


def find_not_handwritten(files: DataFrame, sample: int = SAMPLE, classifier: Classifier | None = None) -> DataFrame:
    """FOUND_SCHEMA: the files that a tool made, a minifier packed, somebody else wrote, or that hold data.

    One scan draws and labels the sample, another scores every file; nothing is
    shuffled but the sample's ids.  The weights have a fixed size (six times WIDTH).
    """
    model = classifier or train(files, sample)
    shared = files.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = shared.value
        for batch in batches:
            out = []
            for file, path, lang, text in zip(batch["id"], batch["path"], batch["language"], batch["content"]):
                if not text or not text.strip():
                    continue
                path = path or ""
                if c is None:
                    if kind := evidence(text, path, lang):
                        out.append((file, kind, 0.0))
                    continue
                x = features(text, path)
                score = float(x @ c.weights)
                if score > c.threshold and not by_hand(text):
                    out.append((file, c.kind(x), round(score, 4)))
            yield pd.DataFrame(out, columns=["file_id", "kind", "score"])

    return _usable(files).select("id", "path", "language", "content").mapInPandas(run, FOUND_SCHEMA)


def validation(files: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """One row with the classifier's figures on the held-out repositories."""
    c = train(files, sample)
    r = c.report if c else {}
    schema = "validation long, positives long, accuracy double, recall double, precision double, threshold double"
    return files.sparkSession.createDataFrame([(int(r["validation"]), int(r["positives"]), r["accuracy"], r["recall"], r["precision"], c.threshold)] if c else [], schema)
