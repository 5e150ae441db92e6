"""Symbols, references and outlines taken from source text, one line or one file at a time.

Declarations are found by one pass over a file's tokens: strings and comments are
skipped, and the words since the last statement say, when a block opens, what the block
is.  Every token is looked at once, so the time grows with the text whatever it holds.
Python's blocks are its indents.  Rows say ``structurally_complete = false`` where the
end of a block was not found.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leanspan.functions.text import language_of

SYMBOL_SCHEMA = "file_id long, name string, kind string, signature string, start_line long, end_line long, start_byte long, end_byte long, structurally_complete boolean"
MAX_SIGNATURE = 512
LANGUAGES = ("python", "rust", "go", "java", "cpp", "javascript", "typescript", "tsx")

_COMMENT = r"//[^\n]*+|/\*(?:[^*]|\*(?!/))*+(?:\*/)?"
_QUOTED = r"\"(?:[^\"\\\n]|\\[\s\S])*+\"?"
_TICKS = r"`(?:[^`\\]|\\[\s\S])*+`?"
_WORD_OR_SIGN = r"(?P<word>[^\W\d][\w$]*+|[$#][\w$]++)|(?P<sign>=>|[{}()\[\];:=<>@,\n])"
#: what is no code, by language; each alternative ends where it must, so nothing is read twice
_NO_CODE = {
    "go": _COMMENT + "|" + _QUOTED + "|`[^`]*+`?|'(?:[^'\\\\\n]|\\\\.)*+'?",
    "java": _COMMENT + r"|\"\"\"(?:[^\"\\]|\\[\s\S]|\"(?!\"\"))*+(?:\"\"\")?|" + _QUOTED + r"|'(?:[^'\\\n]|\\.)*+'?",
    "rust": r"//[^\n]*+|/\*(?:[^*]|\*(?!/))*+(?:\*/)?|b?r(?P<hashes>#*)\"[\s\S]*?(?:\"(?P=hashes)|\Z)|" + r"\"(?:[^\"\\]|\\[\s\S])*+\"?|b?'(?:[^'\\\n]|\\(?:u\{[^}\n]*\}|x..|.))'|'[^\W\d]\w*",
    "cpp": _COMMENT + r"|(?m:^)[ \t]*#(?:[^\n\\]|\\[\s\S])*+|\bR\"(?P<hashes>[^()\\\s]{0,16})\([\s\S]*?(?:\)(?P=hashes)\"|\Z)|" + _QUOTED + r"|(?<!\w)'(?:[^'\\\n]|\\.)*+'?",
    "javascript": _COMMENT + "|" + _QUOTED + r"|'(?:[^'\\\n]|\\[\s\S])*+'?|" + _TICKS + r"|(?<=[=(,:\[!&|?{};\n])[ \t]*/(?![/*])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*+\])++/",
}
_TOKENS = {k: re.compile(f"(?:{v})|" + _WORD_OR_SIGN) for k, v in _NO_CODE.items()}
_TOKENS["typescript"] = _TOKENS["tsx"] = _TOKENS["javascript"]
_PY_TOKEN = re.compile(r"#[^\n]*+|[rRbBuUfFtT]{0,2}(?:\"\"\"(?:[^\"\\]|\\[\s\S]|\"(?!\"\"))*+(?:\"\"\")?|\'\'\'(?:[^\'\\]|\\[\s\S]|\'(?!\'\'))*+(?:\'\'\')?|\"(?:[^\"\\\n]|\\[\s\S])*+\"?|'(?:[^'\\\n]|\\[\s\S])*+'?)|(?P<open>[(\[{])|(?P<close>[)\]}])|(?P<join>\\\r?\n)|(?P<line>\n[ \t]*+)")
_PY_HEAD = re.compile(r"(?:async[ \t]+)?def[ \t]+(?P<function>\w+)|class[ \t]+(?P<class>\w+)")
_CONTROL = frozenset("if for while switch catch return else do try match loop with new throw typeof sizeof".split())
#: words that begin a type, with the kind they make
_TYPES = {
    "go": {"struct": "struct", "interface": "struct"}, "rust": {"struct": "struct", "enum": "class", "union": "class", "trait": "class", "impl": "impl"},
    "java": {"class": "class", "interface": "class", "enum": "class", "record": "class"}, "cpp": {"class": "class", "struct": "class", "union": "class", "enum": "class"},
    "javascript": {"class": "class"},
}
_TYPES["typescript"] = _TYPES["tsx"] = _TYPES["javascript"]
_NEW_STATEMENT = re.compile(r"[ \t]*(?:export|function|async[ \t]+function|class|abstract[ \t]+class|import|const|let|var)\b")
_ACCESS = frozenset(("public", "private", "protected", "signals", "slots"))


def _python_symbols(text: str) -> list[tuple[str, str, int, int, int, bool]]:
    """(name, kind, start, head end, end, complete): definitions end with the last line that is indented more."""
    out, open_ = [], []  # open_: (width, index in out)
    depth, last = 0, 0  # last: where the last code so far ends

    def close(width: int, at: int) -> None:
        while open_ and open_[-1][0] >= width:
            k = open_.pop()[1]
            out[k][4] = at

    def line(at: int) -> None:
        """A logical line begins at its first character."""
        nonlocal last
        m = re.compile(r"[ \t]*").match(text, at)
        start = m.end()
        if start >= len(text) or text[start] in "#\r\n":
            return
        width = len(m[0].expandtabs(8))
        close(width, last)
        head = _PY_HEAD.match(text, start)
        if head:
            kind = "class" if head["class"] else "function"
            if kind == "function" and open_ and out[open_[-1][1]][1] == "class":
                kind = "method"
            out.append([head[head.lastgroup], kind, at, start, -1, True])
            open_.append((width, len(out) - 1))

    line(0)
    begin, comment = 0, -1  # of the logical line
    for m in _PY_TOKEN.finditer(text):
        if m.lastgroup == "open":
            depth += 1
        elif m.lastgroup == "close":
            depth = max(0, depth - 1)
        elif m.lastgroup == "line" and not depth:
            code = len(text[begin: comment if comment >= 0 else m.start()].rstrip())
            if text[begin: begin + code].strip():
                last = begin + code
            begin, comment = m.start() + 1, -1
            line(begin)
        elif text.startswith("#", m.start()) and not depth:
            comment = m.start()
    code = len(text[begin: comment if comment >= 0 else len(text)].rstrip())
    if text[begin: begin + code].strip():
        last = begin + code
    for _, k in open_:
        out[k][4], out[k][5] = last, depth == 0
    return [tuple(x) for x in out]


def _block_symbols(text: str, language: str) -> list[tuple[str, str, int, int, int, bool]]:
    """(name, kind, start, head end, end, complete) of declarations whose blocks are in braces."""
    types = _TYPES[language]
    out: list[list] = []
    blocks: list[int | None] = []  # for each open brace, the symbol it is the block of
    head: list[tuple[str, int, int, int]] = []  # (token, start, end, depth of round and square brackets) since the last statement
    depth = 0
    levels: list[tuple[int, list]] = []  # depth and statement around each open brace
    script = language in ("javascript", "typescript", "tsx")
    closed = -1  # a type of C++ that has just ended takes the semicolon behind it along

    def holder() -> str:
        """The kind of the symbol whose block is the innermost, block for one that is no symbol's, nothing outside of all."""
        return "" if not blocks else "block" if blocks[-1] is None else out[blocks[-1]][1]

    def declare(at: int, by_block: bool) -> int | None:
        found = _classify(head, language, types, holder())
        if not found:
            return None
        name, kind, start = found
        begin = text.rfind("\n", 0, start) + 1
        out.append([name, kind, begin if not text[begin:start].strip() else start, at, -1 if by_block else at + 1, by_block is False])
        return len(out) - 1

    for m in _TOKENS[language].finditer(text):
        token = m["word"] or m["sign"]
        if not token:
            continue
        a, b = m.start("word" if m["word"] else "sign"), m.end()
        if token == "\n":
            # a line's end ends a statement in Go, and in scripts where a new one plainly begins
            if not depth and (language == "go" or script and head and (_NEW_STATEMENT.match(text, b) or holder() == "class" and any(t == "=" for t, *_ in head))):
                head = []
            continue
        if token in "([":
            head.append((token, a, b, depth))
            depth += 1
        elif token in ")]":
            depth = max(0, depth - 1)
            head.append((token, a, b, depth))
        elif token == "{":
            blocks.append(None if depth else declare(a, True))
            levels.append((depth, head))
            head, depth = [], 0
        elif token == "}":
            around: list = []
            if blocks:
                k = blocks.pop()
                depth, around = levels.pop()
                if k is not None:
                    out[k][4], out[k][5] = b, True
                    closed = k
            head = around if depth else []  # inside brackets the statement goes on
            continue
        elif token == ";":
            if closed >= 0 and language == "cpp" and out[closed][1] == "class" and not text[out[closed][4]: a].strip():
                out[closed][4] = b
            elif not depth and language == "rust" and any(t == "struct" for t, *_ in head[:6]):
                declare(a, False)
            if not depth:
                head = []
        elif token == ":" and language == "cpp" and head and head[-1][0] in _ACCESS and len(head) == 1:
            head = []
        else:
            head.append((token, a, b, depth))
        closed = -1 if token != "}" else closed
    for k in blocks:
        if k is not None:
            out[k][4], out[k][5] = len(text.rstrip()), False
    return [tuple(x) for x in out]


def _classify(head: list[tuple[str, int, int, int]], language: str, types: dict[str, str], inside: str) -> tuple[str, str, int] | None:
    """(name, kind, start) of the declaration that the tokens before a block make, or nothing."""
    k = _skip_marks(head, language)
    words = head[k:]
    flat = [(n, t) for n, (t, _, _, d) in enumerate(words) if d == 0]
    if not flat or words[0][0] in _CONTROL and words[0][0] != "new":
        return None
    start = words[0][1]
    names = [t for _, t in flat]
    is_name = lambda t: (t[0].isalpha() or t[0] in "_$#") and t not in _CONTROL
    if language == "go":
        if names[0] == "type" and len(names) > 2 and is_name(names[1]) and names[-1] in types:
            return names[1], "struct", start
        if names[0] == "func":
            receiver = len(words) > 1 and words[1][0] == "("
            after = [t for n, t in flat if is_name(t) and t != "func"]
            named = len(flat) > 1 and (is_name(flat[1][1]) if not receiver else True)
            if named and after:
                return after[0], "method" if receiver else "function", start
        return None
    keyword = next((t for t in names if t in types or t in ("fn", "function", "namespace", "mod", "module", "extern")), None)
    if language == "rust":
        if keyword == "fn":
            name = names[names.index("fn") + 1: names.index("fn") + 2]
            return (name[0], "method" if inside in ("impl", "class") else "function", start) if name and is_name(name[0]) else None
        if keyword == "impl":
            rest = _outside_angles(names[names.index("impl") + 1:])
            if "where" in rest:
                rest = rest[: rest.index("where")]
            rest = rest[rest.index("for") + 1:] if "for" in rest else rest
            rest = [t for t in rest if is_name(t) and t not in ("dyn", "mut", "const", "crate", "self", "super")]
            return (rest[-1], "impl", start) if rest else None
        if keyword in types:
            name = names[names.index(keyword) + 1: names.index(keyword) + 2]
            return (name[0], types[keyword], start) if name and is_name(name[0]) else None
        return None
    if "=" in names or "=>" in names:
        cut = names.index("=") if "=" in names else names.index("=>")
        if keyword not in ("function", "class") or language in ("java", "cpp") or cut > names.index(keyword):
            return None
    if keyword in types and (language != "cpp" or "(" not in names[names.index(keyword):] or names[0] == keyword and ":" in names):
        name = [t for t in names[names.index(keyword) + 1:] if is_name(t)]
        # the name is the last word before the bases
        if language == "cpp":
            upto = names[names.index(keyword) + 1:]
            upto = upto[: next((i for i, t in enumerate(upto) if t in (":", "<")), len(upto))]
            name = [t for t in upto if is_name(t) and t not in ("class", "struct", "final")][-1:]
        return (name[0], types[keyword], start) if name else None
    if language not in ("java", "cpp"):
        if keyword == "function":
            at = names.index("function")
            if any(t == "(" for t in names[:at]):
                return None
            name = names[at + 1: at + 2]
            return (name[0], "function", start) if name and is_name(name[0]) else None
        if inside != "class" or "(" not in names:
            return None
        name = names[: names.index("(")]
        if "<" in name:
            name = name[: name.index("<")]
        return (name[-1], "method", start) if name and is_name(name[-1]) else None
    if keyword in ("namespace", "module", "extern") or "(" not in names or inside == "block":
        return None
    before = _outside_angles(names[: names.index("(")])
    if not before or not is_name(before[-1]):
        return None
    if language == "java":
        return (before[-1], "method", start) if inside == "class" and before[-1] not in ("synchronized", "super", "this") else None
    qualified = len(before) > 2 and before[-2] == ":" and before[-3] == ":"
    if inside in ("function", "method"):
        return None
    return before[-1], "method" if inside == "class" or qualified else "function", start


def _outside_angles(names: list[str]) -> list[str]:
    out, depth = [], 0
    for t in names:
        if t == "<":
            depth += 1
        elif t == ">":
            depth = max(0, depth - 1)
        elif not depth:
            out.append(t)
    return out


def _skip_marks(head: list[tuple[str, int, int, int]], language: str) -> int:
    """How many tokens annotations, attributes and template heads take before a declaration."""
    k = 0
    while k < len(head):
        t = head[k][0]
        if t == "@" and k + 1 < len(head) and head[k + 1][0] != "interface":
            k += 2
            if k < len(head) and head[k][0] == "(":
                k = _behind(head, k)
        elif t == "[" and language in ("cpp", "rust") and head[k][3] == 0:
            k = _behind(head, k)
        elif t == "template" and language == "cpp":
            depth, k = 0, k + 1
            while k < len(head):
                depth += {"<": 1, ">": -1}.get(head[k][0], 0)
                k += 1
                if depth <= 0:
                    break
        else:
            break
    return k


def _behind(head: list[tuple[str, int, int, int]], k: int) -> int:
    """The place behind the bracket that opens at a token."""
    depth = head[k][3]
    k += 1
    while k < len(head) and head[k][3] > depth:
        k += 1
    return k + 1


def symbols_of(text: str, language: str) -> list[tuple]:
    """(name, kind, signature, start line, end line, start byte, end byte, complete), the first of equal ones."""
    if language not in LANGUAGES:
        return []
    found = _python_symbols(text) if language == "python" else _block_symbols(text, language)
    lines = [m.start() for m in re.finditer("\n", text)]
    plain = text.isascii()
    out, seen = [], set()
    at, byte = 0, 0
    places = sorted({p for x in found for p in (x[2], x[4])})
    bytes_of = {}
    for p in places:
        byte = p if plain else byte + len(text[at:p].encode("utf-8", "surrogatepass"))
        bytes_of[p], at = byte, p
    for name, kind, start, head_end, end, whole in sorted(found, key=lambda x: (x[2], -x[4])):
        key = (kind, name, start, end)
        if key in seen or end < start:
            continue
        seen.add(key)
        if language == "python":
            stop = text.find("\n", head_end)
            head = re.sub(r":\s*(?:#.*)?$", "", text[head_end: stop if stop >= 0 else len(text)])
        else:
            head = text[start:head_end]
        out.append((name, kind, head.strip()[:MAX_SIGNATURE], bisect_right(lines, start - 1) + 1, bisect_right(lines, max(start, end - 1) - 1) + 1, bytes_of[start], bytes_of[end], whole))
    return out


def extract_symbols(files: DataFrame) -> DataFrame:
    """SYMBOL_SCHEMA of every file in a language with patterns; no shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(i, *s) for i, t, x in zip(batch["id"], batch["content"], batch["language"]) for s in symbols_of(t, x)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SYMBOL_SCHEMA.split(", ")])

    usable = files.filter(F.col("id").isNotNull() & F.col("content").isNotNull()).select("id", "content", language_of("path").alias("language")).filter(F.col("language").isin(*LANGUAGES))
    return usable.mapInPandas(run, SYMBOL_SCHEMA)


def references(files: DataFrame) -> DataFrame:
    """file_id, line, name: names that are called, by line, in the JVM."""
    lines = files.filter("id is not null and content is not null").select(F.col("id").alias("file_id"), F.posexplode(F.split("content", "\n")).alias("at", "text")).filter(F.col("text").contains("("))
    calls = lines.select("file_id", (F.col("at") + 1).cast("long").alias("line"), F.explode(F.expr(r"regexp_extract_all(text, '([A-Za-z_][A-Za-z0-9_]*)\\(', 1)")).alias("name"))
    return calls.filter(~F.col("name").isin(*sorted(_CONTROL)))


class _Outline(HTMLParser):
    """Elements with an id or of an outline tag, references to anchors, and resources."""

    TAGS = frozenset("h1 h2 h3 h4 h5 h6 section article nav main header footer form table template dialog".split())

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[tuple[str, str, int]] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        a, line = dict(attrs), self.getpos()[0]
        if a.get("id"):
            self.rows.append(("symbol", f"#{a['id']}", line))
        elif tag in self.TAGS:
            name = a.get("data-name") or a.get("name") or a.get("href") or tag
            self.rows.append(("symbol", name, line))
        for k, v in attrs:
            if v and (k.startswith("data-") or k == "for"):
                self.rows.append(("reference", v, line))
            elif v and k == "href" and v.startswith("#") and len(v) > 1:
                self.rows.append(("reference", v, line))
        if tag == "script" and a.get("src"):
            self.rows.append(("import", a["src"], line))
        if tag == "link" and a.get("href") and set((a.get("rel") or "").lower().split()) & {"stylesheet", "preload", "modulepreload"}:
            self.rows.append(("import", a["href"], line))


def html_outline_of(text: str) -> list[tuple[str, str, int]]:
    p = _Outline()
    p.feed(text)
    return p.rows


def css_outline_of(text: str) -> list[tuple[str, str, int]]:
    """Selectors and at-rules of a style sheet with their lines."""
    bare = re.sub(r"/\*[\s\S]*?\*/", lambda m: re.sub(r"[^\n]", " ", m.group()), text)
    out = []
    for m in re.finditer(r"(?:^|[{};])\s*([^{};]+?)\s*\{", bare):
        line = bare.count("\n", 0, m.start(1)) + 1
        out += [("symbol", s.strip(), line) for s in m[1].split(",") if s.strip()]
    out += [("import", m[1] or m[2], bare.count("\n", 0, m.start()) + 1) for m in re.finditer(r"@import\s+(?:url\(\s*)?(?:\"([^\"]+)\"|'([^']+)')", bare)]
    return sorted(out, key=lambda r: r[2])


def web_outline(files: DataFrame) -> DataFrame:
    """file_id, role (symbol, reference, import), name, line of HTML and CSS files."""
    schema = "file_id long, role string, name string, line long"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(i, *r) for i, t, x in zip(batch["id"], batch["content"], batch["language"]) for r in (html_outline_of(t) if x == "html" else css_outline_of(t))]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    usable = files.filter("id is not null and content is not null").select("id", "content", language_of("path").alias("language")).filter(F.col("language").isin("html", "css"))
    return usable.mapInPandas(run, schema)


def resolve_symbol(symbols: DataFrame, names: DataFrame) -> DataFrame:
    """name, status (unique, ambiguous, not_found), symbol_id of requested names, bare or parent.name.

    names: name, a request's parameters.
    """
    bare = F.regexp_extract("wanted", r"([^.]+)$", 1)
    parent = F.when(F.col("wanted").contains("."), F.regexp_replace("wanted", r"\.[^.]+$", ""))
    n = names.select(F.col("name").alias("wanted")).distinct().withColumn("name", bare).withColumn("owner", parent)
    s = symbols.select("id", "name", "parent")
    j = n.join(s, "name", "left").withColumn("ok", F.col("id").isNotNull() & (F.col("owner").isNull() | F.col("owner").eqNullSafe(F.col("parent"))))
    g = j.groupBy("wanted").agg(F.countDistinct(F.when(F.col("ok"), F.col("id"))).alias("n"), F.min(F.when(F.col("ok"), F.col("id"))).alias("first"))
    return g.select(F.col("wanted").alias("name"), F.when(F.col("n") == 0, "not_found").when(F.col("n") == 1, "unique").otherwise("ambiguous").alias("status"), F.when(F.col("n") == 1, F.col("first")).alias("symbol_id"))
