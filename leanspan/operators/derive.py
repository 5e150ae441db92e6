"""Index-time derivation: chunks, headings, imports, containment, path entries."""

from __future__ import annotations

import posixpath
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leanspan.functions.text import fingerprint, language_of, parent_directories, text_kind
from leanspan.functions.tokens import estimate

MAX_LINES, MAX_BYTES = 80, 32 * 1024
MAX_CANDIDATES = 64
CHUNK_SCHEMA = "file_id long, ordinal int, content string, start_line long, end_line long, start_byte long, end_byte long"


def chunk_spans(text: str, max_lines: int = MAX_LINES, max_bytes: int = MAX_BYTES) -> list[tuple[int, int, int, int, str]]:
    """(start line, end line, start byte, end byte, content) of consecutive chunks that add up to the text.

    Whole lines are added while both limits hold; a line above the byte limit is cut
    alone, between characters.
    """
    if max_lines <= 0 or max_bytes <= 0:
        raise ValueError("limits must be positive")
    out: list[tuple[int, int, int, int, str]] = []
    held: list[str] = []
    held_bytes, byte = 0, 0

    def close(last_line: int) -> None:
        nonlocal held, held_bytes
        if held:
            out.append((last_line - len(held) + 1, last_line, byte - held_bytes, byte, "".join(held)))
            held, held_bytes = [], 0

    lines = text.split("\n")
    lines = [x + "\n" for x in lines[:-1]] + ([lines[-1]] if lines[-1] else [])
    for number, line in enumerate(lines, 1):
        size = len(line) if line.isascii() else len(line.encode("utf-8", "surrogatepass"))
        if held and (len(held) == max_lines or held_bytes + size > max_bytes):
            close(number - 1)
        if size > max_bytes:
            data = line.encode("utf-8", "surrogatepass")
            at = 0
            while at < size:
                end = min(at + max_bytes, size)
                while end < size and data[end] & 0xC0 == 0x80:
                    end -= 1
                if end <= at:  # a character wider than the limit
                    end = at + 1
                    while end < size and data[end] & 0xC0 == 0x80:
                        end += 1
                out.append((number, number, byte + at, byte + end, data[at:end].decode("utf-8", "surrogatepass")))
                at = end
        else:
            held.append(line)
            held_bytes += size
        byte += size
    close(len(lines))
    return out


def chunk_files(files: DataFrame, max_lines: int = MAX_LINES, max_bytes: int = MAX_BYTES, text: str = "content") -> DataFrame:
    """Chunks of every text file, without a shuffle: one row in, many out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(i, k, s[4], *s[:4]) for i, t in zip(batch["id"], batch[text]) for k, s in enumerate(chunk_spans(t, max_lines, max_bytes))]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in CHUNK_SCHEMA.split(", ")])

    usable = files.filter(F.col("id").isNotNull() & (text_kind(text) == "text")).select("id", text)
    out = usable.mapInPandas(run, CHUNK_SCHEMA)
    return out.withColumn("token_count", estimate("content")).withColumn("content_hash", fingerprint("content"))


def headings(files: DataFrame) -> DataFrame:
    """Markdown headings outside fences; a heading's range ends before the next of its level or above."""
    schema = "file_id long, ordinal int, level int, name string, signature string, start_line long, end_line long"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for file, text in zip(batch["id"], batch["content"]):
                found, fence = [], ""
                lines = text.split("\n")
                total = len(lines) - (lines[-1] == "")
                for n, line in enumerate(lines, 1):
                    mark = re.match(r" {0,3}(`{3,}|~{3,})", line)
                    if mark and (not fence or mark[1].startswith(fence) and not line.strip().strip("`~")):
                        fence = "" if fence else mark[1][:3]
                    elif not fence and (m := re.match(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*\r?$", line)) and m[2]:
                        found.append((len(m[1]), m[2], n))
                for k, (level, name, n) in enumerate(found):
                    end = next((f[2] - 1 for f in found[k + 1:] if f[0] <= level), total)
                    out.append((file, k, level, name, f"{'#' * level} {name}", n, max(n, end)))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])

    return files.filter(language_of("path") == "markdown").filter(F.col("content").isNotNull()).select("id", "content").mapInPandas(run, schema)


#: language -> a pattern whose first group is an import's target
_IMPORTS = {
    "python": r"(?m)^[ \t]*(?:from[ \t]+([.\w]+)[ \t]+import\b|import[ \t]+([\w.]+))",
    "javascript": r"(?m)^[ \t]*(?:import|export)\b[^'\"\n]*?['\"]([^'\"\n]+)['\"]|\brequire\(\s*['\"]([^'\"\n]+)['\"]",
    "rust": r"(?m)^[ \t]*(?:pub[ \t]+)?(?:use[ \t]+([\w:]+)|mod[ \t]+(\w+)[ \t]*;)",
    "go": r"(?m)^(?:import[ \t]+|[ \t]+)(?:[\w.]+[ \t]+)?\"([\w./\-]+)\"[ \t]*\r?$",
    "java": r"(?m)^[ \t]*import[ \t]+(?:static[ \t]+)?([\w.]+)(?:\.\*)?[ \t]*;",
    "cpp": r"(?m)^[ \t]*#[ \t]*include[ \t]*[\"<]([^\">\n]+)[\">]",
    "html": r"(?i)<(?:script|link|img)\b[^>]*?\b(?:src|href)=[\"']([^\"'>]+)[\"']",
    "latex": r"\\(?:input|include|subfile)\{([^}]+)\}",
}
_IMPORTS["typescript"] = _IMPORTS["tsx"] = _IMPORTS["javascript"]


def raw_imports(files: DataFrame) -> DataFrame:
    """file_id, path, language, raw_target, line: import statements by line, in the JVM."""
    lang = language_of("path")
    pattern = F.lit(None).cast("string")
    for name, p in _IMPORTS.items():
        pattern = F.when(lang == name, F.lit(p.replace("(?m)", ""))).otherwise(pattern)
    lines = files.filter(lang.isin(*_IMPORTS) & F.col("content").isNotNull()).select(F.col("id").alias("file_id"), "path", lang.alias("language"), pattern.alias("pattern"), F.posexplode(F.split("content", "\n")).alias("at", "text"))
    # the line must look like an import before the regular expression runs
    likely = lines.filter(F.col("text").rlike(r"import|from|require|use |mod |include|^\s+[\w.]*\s*\"|export|src=|href=|\\input|\\subfile"))
    hit = likely.filter(F.expr("text rlike pattern")).withColumn("groups", F.expr("coalesce(nullif(regexp_extract(text, pattern, 1), ''), case when language in ('python', 'javascript', 'typescript', 'tsx', 'rust') then regexp_extract(text, pattern, 2) end)"))
    return hit.filter(F.coalesce("groups", F.lit("")) != "").select("file_id", "path", "language", F.col("groups").alias("raw_target"), (F.col("at") + 1).cast("long").alias("line"))


# What a compiler of TypeScript puts in the place of a written extension, in this order.
_SUBSTITUTES = {"": ["ts", "tsx", "d.ts", "js", "jsx"], "js": ["ts", "tsx", "d.ts", "js", "jsx"], "jsx": ["tsx", "d.ts", "jsx"], "mjs": ["mts", "d.mts", "mjs"], "cjs": ["cts", "d.cts", "cjs"]}


def import_candidates(path: str, target: str, language: str, root_packages: tuple[str, ...] = ()) -> list[str]:
    """Ordered paths that an import may mean, at most MAX_CANDIDATES."""
    here = posixpath.dirname(path)
    out: list[str] = []

    def put(p: str) -> None:
        p = posixpath.normpath(p)
        if p and not p.startswith(("..", "/")) and p not in out and p != ".":
            out.append(p)

    if language == "python":
        dots = len(target) - len(target.lstrip("."))
        parts = [x for x in target[dots:].split(".") if x]
        bases = ["/".join(here.split("/")[: len(here.split("/")) - dots + 1])] if dots else list(dict.fromkeys([here, *_ancestors(here), ""]))
        for base in bases:
            stem = posixpath.join(base, *parts) if parts else base
            for suffix in ("/__init__.py", "/__init__.pyi", ".py", ".pyi"):
                put(stem + suffix)
    elif language in ("javascript", "typescript", "tsx"):
        if target.startswith("."):
            stem = posixpath.join(here, target)
            written = posixpath.splitext(stem)[1][1:]
            if language == "javascript":
                ends = [] if written else ["js", "mjs", "cjs", "jsx"]
            else:
                ends = _SUBSTITUTES.get(written, []) if not (written == "" and path.endswith(".mts")) else None
            if ends == []:
                put(stem)
            for e in ends or ():
                put((posixpath.splitext(stem)[0] if written else stem) + "." + e)
            for e in (ends or ()) if not written else ():
                put(f"{stem}/index.{e}")
    elif language == "html":
        if target.startswith(".") and "?" not in target and "#" not in target:
            put(posixpath.join(here, target))
    elif language == "latex":
        stem = posixpath.join(here, target)
        for e in [""] if posixpath.splitext(stem)[1] else [".tex", ".ltx"]:
            put(stem + e)
    elif language == "rust":
        parts = [x for x in target.split("::") if x]
        base = here if posixpath.basename(path) in ("mod.rs", "lib.rs", "main.rs") else path[:-3]
        root = next((a for a in [here, *_ancestors(here)] if posixpath.basename(a) == "src"), here)
        if parts and parts[0] in ("crate", "self", "super"):
            base = {"crate": root, "self": base, "super": posixpath.dirname(base)}[parts[0]]
            parts = parts[1:]
        for n in range(len(parts), 0, -1):
            stem = posixpath.join(base, *parts[:n])
            put(stem + ".rs")
            put(stem + "/mod.rs")
    elif language == "java":
        parts = target.split(".")
        for base in [here, *_ancestors(here), ""]:
            put(posixpath.join(base, *parts) + ".java")
    elif language == "cpp":
        put(posixpath.join(here, target))
        for base in [*_ancestors(here), ""]:
            put(posixpath.join(base, target))
            put(posixpath.join(base, "include", target))
    return out[:MAX_CANDIDATES]


def _ancestors(directory: str) -> list[str]:
    out = []
    while directory:
        directory = posixpath.dirname(directory)
        if directory:
            out.append(directory)
    return out


def go_packages(files: DataFrame, imports: DataFrame) -> DataFrame:
    """file_id, raw_target, candidates: the source files of the packages that Go imports name, by the innermost module around the importer.

    A module is a folder with a go.mod and the path that it declares.  Importers offer
    their ancestors, modules meet them by folder, packages meet the files by folder; the
    files of a folder are cut to MAX_CANDIDATES, first by name, as every import's are.
    """
    folder = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    modules = files.filter(F.col("path").rlike(r"(^|/)go\.mod$") & F.col("content").isNotNull()).select(folder.alias("root"), F.regexp_extract("content", r"(?m)^[ \t]*module[ \t]+\"?([^\s\"]+)", 1).alias("module")).filter("module <> ''").distinct()
    up = imports.filter("language = 'go'").select("file_id", "raw_target", F.explode(F.array_union(F.array(F.lit("")), parent_directories("path"))).alias("root")).distinct()
    inside = up.join(modules, "root").filter((F.col("raw_target") == F.col("module")) | F.col("raw_target").startswith(F.concat("module", F.lit("/"))))
    package = inside.groupBy("file_id", "raw_target").agg(F.max_by(F.struct("root", "module"), F.length("root")).alias("m"))
    rest = F.expr("substring(raw_target, length(m.module) + 2)")
    package = package.select("file_id", "raw_target", F.array_join(F.filter(F.array(F.col("m.root"), rest), lambda x: x != ""), "/").alias("folder"))
    wanted = package.select("folder").distinct()
    sources = files.filter(F.col("path").endswith(".go") & ~F.col("path").endswith("_test.go")).select(folder.alias("folder"), "path").distinct().join(wanted, "folder")
    first = top_n(sources, ["folder"], [F.asc("path")], MAX_CANDIDATES).groupBy("folder").agg(F.sort_array(F.collect_list("path")).alias("candidates"))
    return package.join(first, "folder").select("file_id", "raw_target", "candidates")


def resolve_imports(files: DataFrame) -> DataFrame:
    """file_id, path, raw_target, line, candidates, resolved_path: the first candidate that exists.

    Candidates are exploded and joined on path, which shuffles paths only; an import
    without an existing candidate keeps a null.
    """
    raw = raw_imports(files)

    @F.pandas_udf("array<string>")
    def candidates(path: pd.Series, target: pd.Series, language: pd.Series) -> pd.Series:
        return pd.Series([import_candidates(p, t, x) for p, t, x in zip(path, target, language)])

    packages = go_packages(files, raw).withColumnRenamed("candidates", "of_package")
    made = raw.withColumn("candidates", candidates("path", "raw_target", "language")).join(packages, ["file_id", "raw_target"], "left").withColumn("candidates", F.coalesce("of_package", "candidates")).drop("of_package")
    known = files.filter(F.col("path").isNotNull()).select(F.col("path").alias("candidate"), F.lit(True).alias("there")).distinct()
    key = ["file_id", "path", "language", "raw_target", "line"]
    # one pass: every candidate, then all of an import's together with the first that exists
    each = made.select(*key, F.posexplode_outer("candidates").alias("priority", "candidate")).join(known, "candidate", "left")
    return each.groupBy(*key).agg(
        F.array_compact(F.transform(F.sort_array(F.collect_list(F.struct("priority", "candidate"))), lambda x: x["candidate"])).alias("candidates"), F.min_by("candidate", F.when(F.col("there"), F.col("priority"))).alias("resolved_path"), F.max(F.coalesce("there", F.lit(False))).alias("found")
    ).select(*key, "candidates", F.when(F.col("found"), F.col("resolved_path")).alias("resolved_path"))


def parents_by_containment(symbols: DataFrame) -> DataFrame:
    """id, container_id, container: the tightest symbol of the same file that strictly contains each.

    Both sides meet by file and by coarse byte bands of the container, so that a file
    with very many symbols is spread; the narrowest is a min_by, not a sort.
    """
    s = symbols.filter("id is not null and file_id is not null and start_byte is not null and end_byte is not null").select("id", "file_id", "name", "kind", "start_byte", "end_byte").dropDuplicates(["id"])
    outer = s.filter(F.col("kind").isin("class", "struct", "impl", "function", "method", "module", "trait", "interface", "enum"))
    band = 4096
    left = s.select("file_id", "id", "start_byte", "end_byte", F.floor(F.col("start_byte") / band).alias("band"))
    right = outer.select("file_id", F.col("id").alias("container_id"), F.col("name").alias("container"), F.col("start_byte").alias("a"), F.col("end_byte").alias("b"), F.explode(F.sequence(F.floor(F.col("start_byte") / band), F.floor(F.greatest("start_byte", F.col("end_byte") - 1) / band))).alias("band"))
    hit = left.join(right, ["file_id", "band"]).filter("a <= start_byte and end_byte <= b and b - a > end_byte - start_byte")
    best = hit.groupBy("id").agg(F.min_by(F.struct("container_id", "container"), F.struct(F.col("b") - F.col("a"), -F.col("a"), F.col("container_id"))).alias("c"))
    return s.join(best, "id", "left").select("id", F.col("c.container_id").alias("container_id"), F.col("c.container").alias("container"))


def path_entries(files: DataFrame) -> DataFrame:
    """Every file and directory once: path, depth, kind (0 directory, 1 file)."""
    p = files.filter("path is not null").select("path").distinct()
    dirs = p.filter(F.col("path").contains("/")).select(F.explode(parent_directories("path")).alias("path")).distinct().withColumn("kind", F.lit(0))
    return dirs.unionByName(p.withColumn("kind", F.lit(1))).withColumn("depth", (F.size(F.split("path", "/"))).cast("int")).select("path", "depth", "kind")


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of either side that the other lacks, with the side that has them."""
    return a.subtract(b).withColumn("side", F.lit("left")).unionByName(b.subtract(a).withColumn("side", F.lit("right")))


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each key: the greatest by the order, pre-aggregated before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r"))
    return best.select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])


def top_n(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each key (group-limited before the shuffle)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= n)
