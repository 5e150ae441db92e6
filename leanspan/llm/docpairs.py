"""Functions paired with their documentation (problem 1).

Functions are found by parsing: :mod:`islands` mends a file's brackets and asks the
generalised LL parser of :mod:`gll`, on its graph-structured stacks, for every function
that the language's grammar derives, so that the sound functions of broken files are
found too.  The file's lexer finds the comments; the parser also decides whether what
stands between a comment and the declaration is nothing but attributes, annotations,
decorators or template heads.  Pairs are made for the symbols of an index (a symbol that
no parse reaches, as it is damaged inside, is cut by its recorded range and marked as not
parsing) and, for files that an indexer skipped, from the files alone.

Defined results for odd input: rows without id, file or byte range, and files that
have no chunks, give nothing; equal deliveries count once (rows are told apart by id);
ranges that lie outside the content are cut to it; an empty body gives no docstring;
languages without a parser give nothing; extra columns are ignored.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leanspan.streaming.changes import shared_folder

from . import islands
from .languages import LANGUAGES, Language, Unbalanced, language

#: Words of prose that a documentation needs not to be trivial.
MIN_WORDS = 5
#: A description is a template when functions of different code share its hash that are at least this part of all pairs, and several.
TEMPLATE_SHARE, SEVERAL = 0.0005, 3

PAIR_SCHEMA = "symbol_id long, file_id long, name string, kind string, language string, signature string, code string, description string, prose_words int, parses boolean"

# Comments that steer a tool and document nothing.
_DIRECTIVE = re.compile(
    r"^\s*(?://[/!]?|/\*+!?|#)?\s*(?:\+build\b|go:|nolint\b|lint:|NOLINT|NOSONAR|clang-format\b|clang-tidy|cppcheck-|cppcheck:|IWYU|eslint\b|eslint-|tslint:|jslint|jshint|prettier-ignore|biome-ignore|deno-|dprint-ignore"
    r"|@ts-|@formatter:|@flow|istanbul\b|c8\b|v8\b|webpackChunkName|#__PURE__|@__PURE__|rustfmt|rustfmt::|clippy|tarpaulin|checkstyle|CHECKSTYLE|noinspection|spotless:|noqa\b|type:\s*ignore|pylint:|mypy:|pyright:|fmt:|yapf:|isort:|ruff:|pragma:|coverage:|export\s+\w+\s*$|line\s|LCOV_|GCOV_|swiftlint|ktlint|coverity|lizard|nosec|nosemgrep|stylelint|sourceMappingURL|sourceURL|region\b|endregion\b)"
)
_TAGS = [
    (re.compile(r"\{@(?:link|linkplain|see|code|literal|value)\s+([^}]*)\}"), r" \1 "),
    (re.compile(r"\{@\w+[^}]*\}"), " "),
    (re.compile(r"[@\\]t?param(?:\[[\w, ]*\])?\s+(?:\{[^}]*\}\s*)?(?:<\w+>|\[[^\]]*\]|[\w$.]+)?"), " "),
    (re.compile(r"[@\\](?:throws|exception|throw|raises|retval|see|property|prop|arg|argument|template|typedef|callback|type|link|ref|c|p|a|b|e)\s+(?:\{[^}]*\}|[\w$.:#<>()]+)?"), " "),
    (re.compile(r"[@\\](?:returns?|result|return)\s+\{[^}]*\}"), " "),
    (re.compile(r"(?<![\w/])[@\\][A-Za-z]\w*"), " "),
    (re.compile(r"(?m)^\s*:(?:param|type|raises?|return|returns|rtype|arg|keyword|var|ivar|cvar)\b[^:\n]*:"), " "),
    (re.compile(r"(?m)^[ \t]*#+[ \t]*(?:Arguments|Args|Parameters|Returns?|Errors?|Panics|Safety|Examples?|Notes?|See also)[ \t]*$"), " "),
    (re.compile(r"(?m)^[ \t]*(?:Args|Arguments|Parameters|Params|Returns?|Yields?|Raises|Throws|Attributes|Examples?|Notes?|Todo)[ \t]*:?[ \t]*$"), " "),
    (re.compile(r"(?m)^[ \t]*-{3,}[ \t]*$"), " "),
    (re.compile(r"</?[A-Za-z][^>\n]*>"), " "),
]
_PARAM_LINE = re.compile(r"(?m)^[ \t]*\*{0,2}[A-Za-z_]\w*[ \t]*(?:\([^)\n]*\))?[ \t]*:(?=[ \t])")
_WORD = re.compile(r"[^\W\d_][\w'’\-]*", re.U)
_DOC_ATTR = re.compile(r'#\s*\[\s*doc\s*=\s*(?:r(?P<h>#*)"(?P<raw>.*?)"(?P=h)|"(?P<s>(?:[^"\\]|\\[\s\S])*)")\s*\]', re.S)
_PY_STRING = re.compile(r'([A-Za-z]{0,2})("""|\'\'\'|"|\')')
_BLANK = re.compile(r"\n[ \t]*\r?\n")


def prose(doc: str, params: frozenset[str] = frozenset(), python: bool = False) -> str:
    """What remains of a documentation without markers, tags, parameter names and tool directives."""
    lines = []
    for line in doc.replace("\r", "").split("\n"):
        if _DIRECTIVE.match(line):
            continue
        lines.append(line)
    text = "\n".join(lines)
    for pattern, by in _TAGS:
        text = pattern.sub(by, text)
    text = _PARAM_LINE.sub(lambda m: " " if python or re.match(r"\s*\*{0,2}(\w+)", m[0])[1] in params else m[0], text)
    return text


def words(doc: str, params: frozenset[str] = frozenset(), python: bool = False) -> int:
    """Words of prose; names of parameters that stand alone as code don't count."""
    return len(_WORD.findall(prose(doc, params, python)))


def _clean_block(comment: str) -> str:
    body = re.sub(r"^/\*+!?<?|\*+/$", "", comment)
    return "\n".join(re.sub(r"^[ \t]*\*(?!\*)[ \t]?|^[ \t]*\*+$", "", x) for x in body.replace("\r", "").split("\n")).strip()


def _clean_line(comment: str) -> str:
    return re.sub(r"^//[/!]?<?[ \t]?", "", comment.replace("\r", ""))


class SourceFile:
    """A file's text with its comments, for looking up what belongs to a declaration."""

    def __init__(self, text: str, lang: Language):
        self.text, self.lang = text, lang
        self.comments: list[tuple[int, int]] = []
        if lang.name != "python":
            kinds = lang.kinds
            for m in lang.regex.finditer(text):
                k = m.lastindex
                if kinds[k] is None or kinds[k] == "newline":
                    a = m.start(k)
                    if text.startswith(("//", "/*"), a):
                        self.comments.append((a, m.end(k)))

    def documents(self) -> bool:
        """Whether anything in the file can be a documentation."""
        name, text = self.lang.name, self.text
        if name == "python":
            return '"' in text or "'" in text
        if name == "go":
            return bool(self.comments)
        marks = {"rust": ("///", "/**"), "cpp": ("/**", "/*!", "///", "//!")}.get(name, ("/**",))
        return any(text.startswith(marks, a) for a, _ in self.comments) or name == "rust" and bool(_DOC_ATTR.search(text))

    def _alone(self, at: int) -> bool:
        return not self.text[self.text.rfind("\n", 0, at) + 1: at].strip(" \t\f﻿")

    def _between(self, a: int, b: int) -> bool:
        """Whether only attributes and the like stand in text[a:b], without an empty line."""
        s = self.text[a:b]
        if not s.strip():
            return s.count("\n") <= 1
        if _BLANK.search(s):
            return False
        lang = self.lang
        try:
            level = lang.level(s)
        except Unbalanced:
            return False
        return lang.grammar.error not in level and lang.grammar.derives("prefix", level)

    def before(self, start: int) -> str | None:
        """The documentation comment that ends on the line before the declaration."""
        from bisect import bisect_right

        name, text, cs = self.lang.name, self.text, self.comments
        k = bisect_right(cs, (start, 0)) - 1
        end, found = start, []
        attrs_from = start
        while k >= 0:
            a, b = cs[k]
            if not self._alone(a) or not self._between(b, end):
                break
            comment = text[a:b]
            if name == "rust":
                found[:0] = self._doc_attrs(b, end)
            block = comment.startswith("/*")
            if _DIRECTIVE.match(comment) and not (block and "\n" in comment):
                end, k = a, k - 1
                continue
            if name == "rust":
                if comment.startswith("///") and not comment.startswith("////"):
                    found.insert(0, _clean_line(comment))
                elif comment.startswith("/**") and not comment.startswith(("/***", "/**/")):
                    found.insert(0, _clean_block(comment))
                else:
                    break
                attrs_from = a
                end, k = a, k - 1
                continue
            if name == "go":
                if block:
                    return _clean_block(comment)
                found.insert(0, _clean_line(comment))
                end, k = a, k - 1
                if k < 0 or cs[k][0] < 0 or text[cs[k][1]: end].count("\n") != 1 or text[cs[k][1]: end].strip() or text[cs[k][0]: cs[k][0] + 2] != "//" or not self._alone(cs[k][0]):
                    break
                continue
            if name in ("javascript", "typescript", "java"):
                return _clean_block(comment) if comment.startswith("/**") and not comment.startswith("/**/") else None
            # Doxygen
            if block:
                return _clean_block(comment) if re.match(r"/\*[*!](?![*/])", comment) else None
            if re.match(r"//[/!](?!/)", comment):
                found.insert(0, _clean_line(comment))
                end, k = a, k - 1
                continue
            break
        if name == "rust" and not found:
            # attributes alone: those on the lines directly above
            at = start
            while True:
                up = text.rfind("#", 0, at)
                if up < 0 or not self._between(up, start):
                    break
                if self._alone(up):
                    attrs_from = up
                at = up
            found = self._doc_attrs(attrs_from, start)
        return "\n".join(found).strip() if found else None

    def _doc_attrs(self, a: int, b: int) -> list[str]:
        return [m["raw"] if m["raw"] is not None else m["s"].replace('\\"', '"').replace("\\n", "\n") for m in _DOC_ATTR.finditer(self.text[a:b])]

    def docstring(self, start: int, end: int) -> str | None:
        """The string that is the first statement of a Python function's body."""
        text, depth = self.text, 0
        at = None
        for m in self.lang.regex.finditer(text, start, end):
            kind = self.lang.kinds[m.lastindex]
            if kind == "open":
                depth += 1
            elif kind == "close":
                depth -= 1
            elif kind == "op" and m[m.lastindex] == ":" and not depth:
                at = m.end()
                break
        if at is None:
            return None
        for m in self.lang.regex.finditer(text, at, end):
            kind = self.lang.kinds[m.lastindex]
            if kind is None or kind == "newline":
                continue
            token = m[m.lastindex]
            s = _PY_STRING.match(token)
            if kind != self.lang.grammar.classes["STR"] or not s or set(s[1].lower()) - {"r", "u"}:
                return None
            rest = text[m.end(): text.find("\n", m.end()) if text.find("\n", m.end()) >= 0 else len(text)]
            if rest.strip() and not rest.strip().startswith(("#", ";")):
                return None
            body = token[len(s[1]) + len(s[2]): -len(s[2])]
            return body.strip()
        return None

    def documentation(self, start: int, end: int) -> str | None:
        return self.docstring(start, end) if self.lang.name == "python" else self.before(start)


def _parameters(lang: str, head: str) -> frozenset[str]:
    m = re.search(r"\((.*?)\)\s*(?:[{:\-=]|$|\w)", head, re.S)
    return frozenset(re.findall(r"[A-Za-z_$][\w$]*", m[1])) if m else frozenset()


def pairs_of_file(text: str, lang: Language, symbols: list) -> Iterator[tuple]:
    """(symbol, code, description or None, words of prose, parses) for one file's symbols."""
    data = text.encode("utf-8", "surrogatepass")
    plain = len(data) == len(text)
    source = SourceFile(text, lang)
    found: set[tuple[int, int]] | None = None

    def place(at: int) -> int:
        at = max(0, min(at, len(data)))
        return at if plain else len(data[:at].decode("utf-8", "ignore"))

    for s in symbols:
        a, b = place(s["start_byte"]), place(s["end_byte"])
        if b < a:
            b = a
        doc = source.documentation(a, b)
        head = s["signature"] or text[a: text.find("{", a) if text.find("{", a) > 0 else b]
        n = words(doc, _parameters(lang.name, head), lang.name == "python") if doc else 0
        if doc and found is None:
            found = {(x, y) for x, y, _ in islands.functions(lang, text)}
        inner = text[a:b]
        whole = bool(doc) and (a + len(inner) - len(inner.lstrip()), a + len(inner.rstrip())) in found
        yield s, inner, doc, n, whole


#: what every function of a language has somewhere
_HEAD = {"python": re.compile(r"\bdef\b[^\n]"), "go": re.compile(r"\bfunc\b"), "rust": re.compile(r"\bfn\b"), **{k: re.compile(r"\)[^;{}()]*\{") for k in ("java", "cpp")}, **{k: re.compile(r"\(") for k in ("javascript", "typescript")}}


def functions_of_file(text: str, lang: Language) -> Iterator[tuple]:
    """(name, start byte, end byte, code, description, words of prose) of the documented functions that a file's parse finds."""
    if not _HEAD[lang.name].search(text):
        return
    source = SourceFile(text, lang)
    if not source.documents():
        return
    for a, b, name in islands.functions(lang, text):
        doc = source.documentation(a, b)
        if doc:
            head = text[a: text.find("{", a) if text.find("{", a) > 0 else b]
            begin = len(text[:a].encode("utf-8", "surrogatepass"))
            yield name, begin, begin + len(text[a:b].encode("utf-8", "surrogatepass")), text[a:b], doc, words(doc, _parameters(lang.name, head), lang.name == "python")


def extract_pairs(symbols: DataFrame, chunks: DataFrame, files: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """One row for each documented function or method (PAIR_SCHEMA).

    Chunks and symbols meet by file in one shuffle each; the content of a file is
    never in more than one place at a time.  Rows whose documentation is missing or
    has fewer than ``min_words`` words of prose are left out.
    """
    wanted = files.filter(F.col("language").isin(*LANGUAGES) & F.col("id").isNotNull()).select(F.col("id").alias("file_id"), F.col("language").alias("lang"))
    syms = (
        symbols.filter(F.col("kind").isin("function", "method") & F.col("id").isNotNull() & F.col("file_id").isNotNull() & F.col("start_byte").isNotNull() & F.col("end_byte").isNotNull())
        .groupBy("file_id").agg(F.collect_set(F.struct("id", "name", "kind", "signature", "start_byte", "end_byte")).alias("symbols"))
    )
    text = chunks.filter(F.col("file_id").isNotNull() & F.col("content").isNotNull()).groupBy("file_id").agg(F.sort_array(F.collect_list(F.struct("start_byte", "id", "content"))).alias("parts"))
    joined = syms.join(wanted, "file_id").join(text, "file_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sys.setrecursionlimit(20_000)
        for batch in batches:
            out = []
            for file_id, found, lang, parts in zip(batch["file_id"], batch["symbols"], batch["lang"], batch["parts"]):
                seen, pieces = set(), []
                for p in parts:
                    if p["id"] not in seen:
                        seen.add(p["id"])
                        pieces.append(p["content"])
                done = set()
                for s, code, doc, n, ok in pairs_of_file("".join(pieces), language(lang), sorted(found, key=lambda s: s["start_byte"])):
                    if doc and n >= min_words and s["id"] not in done:
                        done.add(s["id"])
                        out.append((s["id"], file_id, s["name"], s["kind"], lang, s["signature"], code, doc, n, ok))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in PAIR_SCHEMA.split(", ")])

    return joined.mapInPandas(run, PAIR_SCHEMA)


FUNCTION_SCHEMA = "file_id long, name string, language string, start_byte long, end_byte long, code string, description string, prose_words int"


def extract_functions(files: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """FUNCTION_SCHEMA: documented functions of files by parsing alone, symbols or none; no shuffle."""
    known = files.filter(F.col("id").isNotNull() & F.col("content").isNotNull() & F.col("language").isin(*LANGUAGES)).select("id", "language", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sys.setrecursionlimit(20_000)
        for batch in batches:
            out = []
            for file, lang, text in zip(batch["id"], batch["language"], batch["content"]):
                out += [(file, name, lang, a, b, code, doc, n) for name, a, b, code, doc, n in functions_of_file(text, language(lang)) if n >= min_words]
            yield pd.DataFrame(out, columns=[c.split()[0] for c in FUNCTION_SCHEMA.split(", ")])

    return known.mapInPandas(run, FUNCTION_SCHEMA)


def template_hash(description: str) -> F.Column:
    """A hash of a description with its numbers, code words and case taken out."""
    return F.xxhash64(F.regexp_replace(F.regexp_replace(F.lower(F.col(description)), r"`[^`]*`|\b\w*[0-9_]\w*\b", "#"), r"[^\p{L}#]+", " "))


def drop_templates(pairs: DataFrame, share: float = TEMPLATE_SHARE, several: int = SEVERAL) -> DataFrame:
    """Without the pairs whose description is a template of the corpus.

    A description is a template when functions of different code share its hash and they
    are at least ``share`` of all different (description, code) pairs, whatever the size of
    the corpus; ``several`` keeps a corpus of a few functions from being its own template.
    Copies of the same code count once, and one that is frequent by copies only keeps one
    pair of each code, that of the least symbol_id.  Counts are taken over all pairs
    before any is dropped; only hashes, counts and ids are shuffled, pre-aggregated, so
    that a hash that many share is one row for each code.
    """
    spark = pairs.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    pairs = pairs.checkpoint()  # the pairs are made once, and survive an executor
    code = F.xxhash64(F.regexp_replace("code", r"\s+", " ")) if "code" in pairs.columns else F.col("symbol_id")
    hashed = pairs.withColumn("template", template_hash("description")).withColumn("fingerprint", code)
    counts = hashed.groupBy("template", "fingerprint").agg(F.count("*").alias("n"), F.min("symbol_id").alias("first"))
    sizes = counts.groupBy("template").agg(F.count("*").alias("codes"), F.sum("n").alias("members"))
    total = sizes.agg(F.sum("codes").alias("total"))
    bound = F.greatest(F.lit(float(several)), F.col("total") * share)
    often = sizes.crossJoin(F.broadcast(total)).filter(F.col("members") >= bound).select("template", (F.col("codes") >= bound).alias("is_template"))
    marked = counts.join(often, "template").select("template", "fingerprint", F.when(~F.col("is_template"), F.col("first")).alias("kept"), F.lit(True).alias("often"))
    return hashed.join(marked, ["template", "fingerprint"], "left").filter("often is null or symbol_id = kept").select(*pairs.columns)
