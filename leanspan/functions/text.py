"""Text and path functions as native column expressions, with plain Python twins where tests need them."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Language names by file extension.
EXTENSION_LANGUAGES = {
    "c": "c", "cs": "csharp", "cc": "cpp", "cpp": "cpp", "cxx": "cpp", "h": "cpp", "hh": "cpp", "hpp": "cpp", "hxx": "cpp", "inl": "cpp", "ipp": "cpp", "tpp": "cpp",
    "java": "java", "rs": "rust", "py": "python", "pyi": "python", "php": "php", "rb": "ruby", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript",
    "ts": "typescript", "mts": "typescript", "cts": "typescript", "tsx": "tsx", "go": "go", "html": "html", "htm": "html", "css": "css", "md": "markdown", "markdown": "markdown", "tex": "latex", "ltx": "latex",
}
# Languages whose files count as production code.
PROGRAMMING = ("c", "csharp", "cpp", "java", "rust", "python", "php", "ruby", "javascript", "typescript", "tsx", "go", "html", "css")
# Patterns of the path classes, matched on lower-case paths in this order.
AUXILIARY_PATH = r"^fixtures/|/fixtures/|(^|/)testdata(/|$)|/snapshots/|\.snap$|/requests/|/schema/"
TEST_PATH = (
    r"(^|/)conftest\.py$|^tests?/|^spec/|/tests?/|/spec/|(^|/)__tests__(/|$)|(^|/)test_[^/]*(/|$)|\.(test|spec)(-d)?(\.[^./]*)?$"
    r"|(^|/)tests?(\.[^/]*)?$|_spec\.rb$|\.spec\.rb$|(^|/)[^/.]*_tests?(\.[^/]*)?$"
)
SUPPORTING_PATH = r"(^|/)docs/|(^|/)examples?/|(^|/)benches/|(^|/)benchmarks/|^scripts/|^tools/"
CLASS_TEST_PATH = r"Tests?\.(java|cs)$"
PATH_PRIORS = {"production": 4.0, "test": 0.0, "auxiliary": -8.0, "supporting": 0.0}


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def fingerprint(c: Column | str) -> Column:
    """128-bit fingerprint of a text, 32 hex digits; an opaque equality key."""
    return F.substring(F.sha2(_col(c), 256), 1, 32)


def extension(path: Column | str) -> Column:
    """Lower-case extension of the file name, or null; a leading dot begins no extension."""
    e = F.regexp_extract(_col(path), r"[^/]\.([^./]*)$", 1)
    return F.when(e == "", F.lit(None)).otherwise(F.lower(e))


def language_of(path: Column | str) -> Column:
    """Language by extension, or null."""
    table = F.create_map(*[F.lit(x) for kv in EXTENSION_LANGUAGES.items() for x in kv])
    return table[extension(path)]


def path_class(path: Column | str) -> Column:
    """production, test, auxiliary or supporting."""
    p = F.lower(_col(path))
    root_markdown = ~p.contains("/") & p.rlike(r"\.mdx?$") & ~p.isin("readme.md", "contributing.md")
    csharp_project = language_of(path).isin("java", "csharp") & (_col(path).rlike(CLASS_TEST_PATH) | p.rlike(r"\.tests(/|$)"))
    return (
        F.when(p.rlike(AUXILIARY_PATH) | root_markdown, "auxiliary").when(csharp_project | p.rlike(TEST_PATH), "test").when(p.rlike(SUPPORTING_PATH), "supporting")
        .when(language_of(path).isin(*PROGRAMMING), "production").otherwise("supporting")
    )


def path_prior(path: Column | str) -> Column:
    c = path_class(path)
    out = F.lit(0.0)
    for name, prior in PATH_PRIORS.items():
        out = F.when(c == name, F.lit(prior)).otherwise(out)
    return out


def text_kind(c: Column | str) -> Column:
    """binary for a NUL or more than 30 % control bytes, else text; null for null."""
    t = _col(c)
    control = F.regexp_count(t, F.lit(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"))
    return F.when(t.isNull(), F.lit(None)).when(t.contains("\0") | (control * 10 > F.octet_length(t) * 3), "binary").otherwise("text")


def line_count(c: Column | str) -> Column:
    """Lines of a text; a final line end begins no line."""
    t = _col(c)
    ends = F.length(t) - F.length(F.replace(t, F.lit("\n")))
    return F.when(t == "", 0).otherwise(ends + F.when(t.endswith("\n"), 0).otherwise(1)).cast("long")


def line_starts(c: Column | str) -> Column:
    """Byte offset of every line, as an array; empty for the empty text."""
    t = _col(c)
    parts = F.split(t, "\n")
    lengths = F.transform(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), lambda x: F.octet_length(x).cast("long") + 1)
    starts = F.aggregate(lengths, F.array(F.lit(0).cast("long")), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))
    return F.when(t == "", F.array().cast("array<bigint>")).when(t.endswith("\n"), F.slice(starts, 1, F.size(starts) - 1)).otherwise(starts)


def identifier_words(c: Column | str) -> Column:
    """Sub-words of an identifier: camel case, acronyms, letters and digits, underscores."""
    s = F.regexp_replace(_col(c), r"([a-z])([A-Z])", "$1_$2")
    s = F.regexp_replace(s, r"([A-Z])([A-Z][a-z])", "$1_$2")
    s = F.regexp_replace(s, r"([A-Za-z])([0-9])", "$1_$2")
    s = F.regexp_replace(s, r"([0-9])([A-Za-z])", "$1_$2")
    return F.filter(F.split(s, "_+"), lambda x: x != "")


def identifier_words_py(identifier: str) -> list[str]:
    for a, b in ((r"([a-z])([A-Z])", r"\1_\2"), (r"([A-Z])([A-Z][a-z])", r"\1_\2"), (r"([A-Za-z])([0-9])", r"\1_\2"), (r"([0-9])([A-Za-z])", r"\1_\2")):
        identifier = re.sub(a, b, identifier)
    return [x for x in identifier.split("_") if x]


def expand_identifier(identifier: str) -> list[str]:
    """Search terms of an identifier: joined, snake case, and each word lowered and as written."""
    words = identifier_words_py(identifier)
    terms = [identifier.replace("_", "").lower(), "_".join(w.lower() for w in words), *(x for w in words for x in (w.lower(), w))]
    return list(dict.fromkeys(t for t in terms if t))


def glob_regex(pattern: str) -> str:
    """A path glob as an anchored regular expression: ``*`` and ``?`` stay in a directory, ``**`` crosses them, ``{a,b}`` and ``[..]`` choose."""
    out, k, depth = "", 0, 0
    while k < len(pattern):
        c = pattern[k]
        if pattern.startswith("**/", k):
            out, k = out + "(?:.*/)?", k + 3
            continue
        if pattern.startswith("**", k):
            out, k = out + ".*", k + 2
            continue
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[" and "]" in pattern[k + 1:]:
            end = pattern.index("]", k + 1)
            inner = pattern[k + 1: end]
            out += "[" + ("^" + inner[1:] if inner.startswith("!") else inner) + "]"
            k = end
        elif c == "{":
            out, depth = out + "(?:", depth + 1
        elif c == "}" and depth:
            out, depth = out + ")", depth - 1
        elif c == "," and depth:
            out += "|"
        else:
            out += re.escape(c)
        k += 1
    return f"^{out}$"


def path_matches(path: Column | str, pattern: str) -> Column:
    """Whether a path is the literal or in its subtree, or matches the glob."""
    p = _col(path)
    if not re.search(r"[*?\[{]", pattern):
        literal = pattern.rstrip("/")
        return (p == literal) | p.startswith(literal + "/")
    return p.rlike(glob_regex(pattern))


def path_filter(path: Column | str, include: list[str] = (), exclude: list[str] = ()) -> Column:
    """(no include, or any matches) and no exclude matches."""
    ok = F.lit(True)
    if include:
        ok = F.lit(False)
        for x in include:
            ok = ok | path_matches(path, x)
    for x in exclude:
        ok = ok & ~path_matches(path, x)
    return ok


def token_terms(c: Column | str) -> Column:
    """Lower-case words of letters, digits and underscores."""
    return F.filter(F.split(F.lower(_col(c)), r"[^\p{L}\p{N}_]+"), lambda x: x != "")


def parent_directories(path: Column | str) -> Column:
    """All proper ancestors of a path, outermost first."""
    parts = F.split(_col(path), "/")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def source_stem(path: Column | str) -> Column:
    """The file's stem without test markers, lower-case: what an owner and its test share."""
    stem = F.regexp_replace(F.regexp_extract(_col(path), r"([^/]+)$", 1), r"\.[^.]*$", "")
    stem = F.regexp_replace(stem, r"\.(test|spec)(-d)?$", "")
    bare = F.when(stem.rlike(r"(_tests|_test|_spec)$"), F.regexp_replace(stem, r"(_tests|_test|_spec)$", "")).otherwise(F.regexp_replace(stem, r"^test_", ""))
    java = language_of(path).isin("java", "csharp")
    return F.lower(F.when(java, F.regexp_replace(bare, r"Tests?$", "")).otherwise(bare))
