"""Lexers that turn source text into levels for :mod:`gll`, one for each language.

A lexer is one compiled regular expression; brackets are matched while it runs, and
a closed bracket pair is handed to the grammar at once, so that a file needs one
pass and memory for its open brackets only.  What is interpolated in a template literal
or an f-string is lexed as a level of its own and has to derive an expression (in a
template of types, a type); the whole literal is then one token.
"""

from __future__ import annotations

import re
from functools import lru_cache

from . import grammars
from .gll import Grammar

_W = r"[^\W\d]\w*"
_NUM_C = r"(?:0[xX][\da-fA-F_']+(?:\.[\da-fA-F_']*)?(?:[pP][+-]?\d+)?|0[bB][01_']+|0[oO][0-7_]+|(?:\d[\d_']*\.?(?:\d[\d_']*)?|\.\d[\d_']*)(?:[eE][+-]?[\d_]+)?)"
_DQ, _SQ = r'"(?:[^"\\\n\r]|\\(?:\r\n|[\s\S]))*"', r"'(?:[^'\\\n\r]|\\(?:\r\n|[\s\S]))*'"
_TEMPLATE = r"`(?:[^`\\$]|\\[\s\S]|\$(?!\{)|\$\{(?:[^`{}\"']|" + _DQ + "|" + _SQ + r"|`(?:[^`\\]|\\[\s\S])*`|\{(?:[^`{}]|`(?:[^`\\]|\\[\s\S])*`|\{[^{}]*\})*\})*\})*`"
_PY_QUOTED = r'"""(?:[^"\\]|\\[\s\S]|"(?!""))*"""|\'\'\'(?:[^\'\\]|\\[\s\S]|\'(?!\'\'))*\'\'\'|' + _DQ + "|" + _SQ
_F_PREFIX = r"(?:[rR]?[fFtT]|[fFtT][rR])"
_F_OPEN = re.compile("(" + _F_PREFIX + r")(\"{3}|'{3}|[\"'])")
_F_CLOSED = re.compile(_F_PREFIX + "(?:" + _PY_QUOTED + r")\Z")
_F_SPECIAL = re.compile(r"[\\{}\n\"']")
_TPL_SPECIAL = re.compile(r"\\[\s\S]|`|\$\{")
_CONVERSION = re.compile(r"![rsa]\s*(?=[:}])")
_DEBUG = re.compile(r"=\s*(?=[:}]|!(?!=))")
_KNOWN_MOST = 100_000
_C_COMMENT = r"//[^\n]*|/\*(?:[^*]|\*(?!/))*\*/"
#: class names of the grammar, by the group of the lexer that finds them
_SPECS = {
    "script": dict(
        blank=r"[ \t\f\v\r\xa0\u2028\u2029\ufeff]*", skip=_C_COMMENT, hash=r"\A#![^\n]*",
        regex=r"(?:\A|(?<=[=(,:\[!&|?{};+\-*%~^<>\n])|(?<=return)|(?<=typeof)|(?<=case))[ \t]*/(?![/*])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[A-Za-z]*",
        name=r"(?:[^\W\d]|[$\\])[\w$\\]*", number=r"(?:" + _NUM_C.replace("'", "") + r")n?(?![\w$])",
        strings=[("STR", _DQ + "|" + _SQ), ("TPL", _TEMPLATE + "|`"), ("PRIVATE", r"#(?:[^\W\d]|\$)[\w$]*")], newline=True,
    ),
    "go": dict(blank=r"[ \t\f\r]*", skip=r"//[^\n]*|/\*(?:[^*\n]|\*(?!/))*\*/", name=_W, number=r"(?:" + _NUM_C.replace("'", "") + r")i?(?!\w)", strings=[("STR", _DQ + r"|`[^`]*`"), ("NUM", r"'(?:[^'\\\n]|\\[^\n]+?)'")], newline=True, long=r"/\*(?:[^*]|\*(?!/))*\*/"),
    "java": dict(blank=r"\s*", skip=_C_COMMENT, name=r"(?:[^\W\d]|\$)[\w$]*", number=r"(?:" + _NUM_C.replace("'", "") + r")[lLfFdD]?(?![\w$])", strings=[("STR", r'"""(?:[^"\\]|\\[\s\S]|"(?!""))*"""|' + _DQ), ("CHAR", r"'(?:[^'\\\n]|\\[^\n]+?)'")]),
    "rust": dict(
        blank=r"\s*", skip=r"//[^\n]*|/\*(?:[^*/]|\*(?!/)|/(?!\*)|/\*(?:[^*/]|\*(?!/)|/(?!\*)|/\*(?:[^*]|\*(?!/))*\*/)*\*/)*\*/", hash=r"\A#!(?!\s*\[)[^\n]*", name=r"(?:r#)?" + _W,
        number=r"(?:0[xX][\da-fA-F_]+(?:[iu](?:8|16|32|64|128|size))?|0[bB][01_]+(?:[iu](?:8|16|32|64|128|size))?|0[oO][0-7_]+(?:[iu](?:8|16|32|64|128|size))?|\d[\d_]*(?:\.(?![.\w])|(?:\.\d[\d_]*)?(?:[eE][+-]?[\d_]+)?(?:[iuf](?:8|16|32|64|128|size))?))(?!\w)",
        strings=[("STR", r'(?:br|cr|r)(?P<h>#*)"(?:(?!"(?P=h))[\s\S])*"(?P=h)|[bc]?"(?:[^"\\]|\\[\s\S])*"'), ("CHAR", r"b?'(?:[^'\\\n]|\\(?:u\{[\da-fA-F_]+\}|x[\da-fA-F]{2}|.))'"), ("LIFETIME", r"'[^\W\d]\w*(?!')")],
    ),
    "cpp": dict(
        blank=r"\s*", skip=r"\\\r?\n|//(?:[^\n\\]|\\\r?\n|\\.)*|/\*(?:[^*]|\*(?!/))*\*/|\#(?:[^\n\\/]|\\\r?\n|\\.|/\*(?:[^*]|\*(?!/))*\*/|/)*", name=r"(?:[^\W\d]|\$)[\w$]*", number=_NUM_C + r"\w*",
        strings=[("STR", r'(?:u8|[uUL])?R"(?P<h>[^()\\\s]{0,16})\((?:(?!\)(?P=h)")[\s\S])*\)(?P=h)"|(?:u8|[uUL])?' + _DQ), ("CHAR", r"(?:u8|[uUL])?'(?:[^'\\\n]|\\[^\n']+|\\')+'")],
    ),
    "python": dict(
        blank=r"[ \t\f]*", skip=r"\\\r?\n|#[^\n]*", name=_W, number=r"(?:0[xX][\da-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|(?:\d[\d_]*\.?(?:\d[\d_]*)?|\.\d[\d_]*)(?:[eE][+-]?[\d_]+)?)[jJ]?(?!\w)",
        strings=[("FSTR", _F_PREFIX + "(?:" + _PY_QUOTED + r"|\"\"\"|\'\'\'|\"|\')"), ("STR", "(?:[rRbBuU]{1,2})?(?:" + _PY_QUOTED + ")")], newline=True,
    ),
}
_OPEN, _CLOSE = "([{", {")": "(", "]": "[", "}": "{"}


class Unbalanced(Exception):
    """A bracket that doesn't close, or closes nothing."""


class Language:
    def __init__(self, name: str, text: str, spec: str):
        self.name, self.spec = name, spec
        self.grammar = g = Grammar(text)
        d = _SPECS[spec]
        self.words = {x: g.literals[x] for x in g.word_literals} | ({"_": g.literals["_"]} if "_" in g.literals else {})
        punctuation = sorted((x for x in g.literals if not x[0].isalpha() and x != "_"), key=lambda x: -len(x))
        parts: list[str] = []
        self.kinds: list = [None]  # by group: None skip, "word", "open", "close", "op", "newline", "template", "fstring", or a class's character
        self.known: dict[tuple[str, str], bool] = {}  # (rule, level) of interpolations

        def add(kind, regex: str) -> None:
            parts.append("(" + regex + ")")
            self.kinds.extend([kind] * re.compile(parts[-1]).groups)

        if "regex" in d:
            add(g.classes["REGEX"], d["regex"])
        front = len(parts)
        if "hash" in d:
            add(g.classes.get("HASHBANG"), d["hash"])
        early = {"rust": 1, "cpp": 1, "python": 2}.get(spec, 0)
        for c, r in d["strings"][:early]:
            add("fstring" if c == "FSTR" else g.classes[c], r)
        add(None, d["skip"])
        add("word", d["name"])
        if d.get("newline"):
            add("newline", r"\r?\n" if spec != "python" else r"(?:\r?\n[ \t\f]*(?:#[^\n]*)?(?=\r?\n))*\r?\n[ \t\f]*(?![ \t\f#])")
        if "long" in d:
            add("newline", d["long"])
        add("open", r"[(\[{]")
        add("close", r"[)\]}]")
        add(g.classes["NUM"], d["number"])
        for c, r in d["strings"][early:]:
            add("template" if c == "TPL" else g.classes.get(c, g.error), r)
        add(g.error, r"/\*|\*/" if spec not in ("python", "go") else r"[`?]")
        add("op", "|".join(map(re.escape, punctuation)))
        add(None, r"\r")
        add(g.error, r"\S")
        # blanks belong to the token that follows; what may look at the character before them comes first
        self.regex = re.compile("|".join([*parts[:front], d["blank"] + "(?:" + "|".join(parts[front:]) + ")"]))
        self.chars = g.literals | self.words
        self.name_char = g.classes["NAME"]
        lit = lambda *xs: {g.literals[x] for x in xs if x in g.literals}
        cls = {g.classes[x] for x in ("NAME", "NUM", "STR", "TPL", "REGEX", "PRIVATE", "CHAR") if x in g.classes}
        if spec == "script":
            self.end = g.classes["NL"]
            words = set(self.words.values()) - lit("import export if for while do try switch case throw new typeof void delete in instanceof else finally const var let class function extends implements default enum interface await async".split()[0], *"export if for while do try switch case throw new typeof void delete in instanceof else finally const var class function extends implements enum interface".split())
            self.enders = cls | words | lit("++", "--", "!", ">")
            self.before_not = re.compile(r"\s*(?:(?://[^\n]*\n|/\*(?:[^*]|\*(?!/))*\*/)\s*)*(?:[.,?:;=&|^%)\]{]|\*(?!\w)|[+](?!\+)|-(?!-)|/(?![/*])|[<>](?!\w)|!=|(?:in|instanceof|as|satisfies|of|extends|implements)\b(?!\s*[:(=?]))")
        elif spec == "go":
            self.end = g.literals[";"]
            self.enders = cls | lit("break", "continue", "fallthrough", "return", "++", "--", "range") - lit("range")
        elif spec == "python":
            self.end = g.classes["NL"]

    # -- levels ---------------------------------------------------------------
    def level(self, text: str) -> str:
        """The outermost level of a whole text; raises Unbalanced."""
        return self._python(text) if self.spec == "python" else self._brackets(text)[0]

    def _brackets(self, text: str, at: int | None = 0, inside: bool = False) -> tuple[str, int]:
        """The level from an offset to the end of the text, or of the interpolation that began there, and where it ends."""
        g, kinds, chars, name = self.grammar, self.kinds, self.chars, self.name_char
        get = chars.get
        script, go = self.spec == "script", self.spec == "go"
        stack: list = [("${", [])] if inside else []
        cur: list[str] = []
        put = cur.append
        while at is not None:
            again = None
            for m in self.regex.finditer(text, at):
                k = m.lastindex
                kind = kinds[k]
                if kind == "word":
                    put(get(m[k], name))
                elif kind == "op":
                    put(chars[m[k]])
                elif kind is None:
                    continue
                elif kind == "open":
                    stack.append((m[k], cur))
                    cur = []
                    put = cur.append
                elif kind == "close":
                    if not stack or stack[-1][0] != _CLOSE[m[k]]:
                        if inside and len(stack) == 1 and m[k] == "}":
                            return "".join(cur), m.end()
                        raise Unbalanced(m[k])
                    b, up = stack.pop()
                    if script and b == "{" and cur and cur[-1] != self.end:
                        put(self.end)
                    up.append(g.group(b, "".join(cur)))
                    cur = up
                    put = cur.append
                elif kind == "newline":
                    if script:
                        if cur and (not stack or stack[-1][0] == "{") and (cur[-1] in self.enders or cur[-1] >= "က") and not self.before_not.match(text, m.end()):
                            put(self.end)
                    elif cur and (cur[-1] in self.enders or cur[-1] >= "က") and "\n" in m[k]:
                        put(self.end)
                elif kind == "template":
                    if "${" in m[k] or len(m[k]) == 1:
                        c, again = self._template(text, m.start(k) + 1)
                        put(c)
                        break
                    put(g.classes["TPL"])
                else:
                    put(kind)
            at = again
        if stack:
            raise Unbalanced(stack[-1][0])
        if (script or go) and cur and cur[-1] != self.end:
            put(self.end)
        return "".join(cur), len(text)

    def _derives(self, rule: str, level: str) -> bool:
        found = self.known.get((rule, level))
        if found is None:
            found = self.grammar.error not in level and self.grammar.derives(rule, level)
            if len(self.known) < _KNOWN_MOST and len(level) <= 200:
                self.known[rule, level] = found
        return found

    def _template(self, text: str, at: int) -> tuple[str, int]:
        """The token of a template literal whose text begins at an offset, and where it ends."""
        g = self.grammar
        levels = []
        while m := _TPL_SPECIAL.search(text, at):
            at = m.end()
            if m[0] == "`":
                if all(self._derives("test", x) for x in levels):
                    return g.classes["TPL"], at
                if "TYPE_TPL" in g.classes and all(self._derives("type", x) for x in levels):
                    return g.classes["TYPE_TPL"], at
                return g.error, at
            if m[0] == "${":
                level, at = self._brackets(text, at, True)
                levels.append(level)
        raise Unbalanced("`")

    def _fstring(self, text: str, at: int) -> tuple[str, int]:
        """The token of an f-string that begins at an offset, and where it ends."""
        m = _F_OPEN.match(text, at)
        end, good = self._literal(text, m.end(), m[2], "r" in m[1].lower(), False)
        return (self.grammar.classes["STR"] if good else self.grammar.error), end

    def _literal(self, text: str, at: int, quote: str, raw: bool, spec: bool) -> tuple[int, bool]:
        """The end of an f-string's text, or of a format specification before its }, and whether its fields are expressions."""
        good = True
        while m := _F_SPECIAL.search(text, at):
            c, at = m[0], m.end()
            if c == "\\":
                if not raw and text.startswith("N{", at):
                    at = text.find("}", at) + 1
                    if not at:
                        break
                elif text[at: at + 1] not in ("{", "}"):
                    at += 2 if text.startswith("\r\n", at) else 1
            elif c == "{":
                if not spec and text.startswith("{", at):
                    at += 1
                else:
                    at, fine = self._field(text, at, quote, raw)
                    good = good and fine
            elif c == "}":
                if spec:
                    return m.start(), good
                if text.startswith("}", at):
                    at += 1
                else:
                    good = False
            elif c == "\n":
                if len(quote) == 1:
                    break
            elif text.startswith(quote, m.start()):
                if spec:
                    break
                return m.start() + len(quote), good
        raise Unbalanced(quote)

    def _field(self, text: str, at: int, quote: str, raw: bool) -> tuple[int, bool]:
        """The end of a replacement field of an f-string that begins after its {, and whether it holds an expression."""
        g, kinds = self.grammar, self.kinds
        stack: list = []
        cur: list[str] = []
        while m := self.regex.match(text, at):
            k = m.lastindex
            kind, s = kinds[k], m.start(k)
            at = m.end()
            if not stack and kind is not None and (text[s] in ":}" or text[s] == "!" and not text.startswith("!=", s) or _DEBUG.match(text, s) and not text.startswith("==", s)):
                good = self._derives("rhs", "".join(cur))
                at = s
                if text[at] == "=":
                    at = _DEBUG.match(text, at).end()
                if text[at] == "!":
                    c = _CONVERSION.match(text, at)
                    good = good and bool(c)
                    at = c.end() if c else at + 1
                if text.startswith(":", at):
                    at, fine = self._literal(text, at + 1, quote, raw, True)
                    good = good and fine
                if not text.startswith("}", at):
                    raise Unbalanced("{")
                return at + 1, good
            if kind == "word":
                cur.append(self.chars.get(m[k], self.name_char))
            elif kind == "op":
                cur.append(self.chars[m[k]])
            elif kind is None or kind == "newline":
                continue
            elif kind == "open":
                stack.append((m[k], cur))
                cur = []
            elif kind == "close":
                if not stack or stack[-1][0] != _CLOSE[m[k]]:
                    raise Unbalanced(m[k])
                b, up = stack.pop()
                up.append(g.group(b, "".join(cur)))
                cur = up
            elif kind == "fstring":
                c, at = self._fstring(text, s)
                cur.append(c)
            else:
                cur.append(kind)
        raise Unbalanced("{")

    def _python(self, text: str) -> str:
        g, kinds, chars, name, nl = self.grammar, self.kinds, self.chars, self.name_char, self.end
        get = chars.get
        stack: list = []  # open brackets and blocks
        indents = [0]
        cur: list[str] = []
        put = cur.append
        depth = 0

        def indent(width: int) -> None:
            nonlocal cur, put
            if width > indents[-1]:
                indents.append(width)
                stack.append(("<", cur))
                cur = []
                put = cur.append
            while width < indents[-1]:
                indents.pop()
                if width > indents[-1]:
                    raise Unbalanced("dedent")
                b, up = stack.pop()
                up.append(g.group("<", "".join(cur)))
                cur = up
                put = cur.append

        first = re.match(r"(?:[ \t\f]*(?:#[^\n]*)?\r?\n)*([ \t\f]*)", text)
        at = first.end(1)
        if first[1] and at < len(text) and text[at] != "#":
            raise Unbalanced("indent")
        while at is not None:
            again = None
            for m in self.regex.finditer(text, at):
                k = m.lastindex
                kind = kinds[k]
                if kind == "word":
                    put(get(m[k], name))
                elif kind == "op":
                    put(chars[m[k]])
                elif kind is None:
                    continue
                elif kind == "newline":
                    if not depth:
                        if cur and cur[-1] != nl and cur[-1] < "က" or cur and cur[-1] >= "က" and g._group_of[cur[-1]][0] != "<":
                            put(nl)
                        if m.end() < len(text):
                            s = m[k]
                            s = s[s.rindex("\n") + 1:]
                            indent(len(s.expandtabs(8)) if "\t" in s else len(s))
                elif kind == "open":
                    stack.append((m[k], cur))
                    cur = []
                    put = cur.append
                    depth += 1
                elif kind == "close":
                    if not stack or stack[-1][0] != _CLOSE[m[k]]:
                        raise Unbalanced(m[k])
                    b, up = stack.pop()
                    up.append(g.group(b, "".join(cur)))
                    cur = up
                    put = cur.append
                    depth -= 1
                elif kind == "fstring":
                    if "{" in m[k] or "}" in m[k] or not _F_CLOSED.match(m[k]):
                        c, again = self._fstring(text, m.start(k))
                        put(c)
                        break
                    put(g.classes["STR"])
                else:
                    put(kind)
            at = again
        if depth:
            raise Unbalanced(stack[-1][0])
        if cur and cur[-1] != nl and not (cur[-1] >= "က" and g._group_of[cur[-1]][0] == "<"):
            put(nl)
        indent(0)
        return "".join(cur)

    def parses(self, text: str, rule: str = "file") -> bool:
        """Whether the rule derives the whole text."""
        try:
            level = self.level(text)
        except Unbalanced:
            return False
        return self.grammar.error not in level and self.grammar.derives(rule, level)


@lru_cache(None)
def language(name: str) -> Language:
    text, spec = {
        "python": (grammars.PYTHON, "python"), "javascript": (grammars.SCRIPT + grammars.JS_ONLY, "script"), "typescript": (grammars.SCRIPT + grammars.TS_ONLY, "script"),
        "go": (grammars.GO, "go"), "java": (grammars.JAVA, "java"), "rust": (grammars.RUST, "rust"), "cpp": (grammars.CPP, "cpp"),
    }[name]
    return Language(name, text + grammars.PREFIXES[name], spec)


LANGUAGES = ("python", "rust", "go", "javascript", "typescript", "java", "cpp")
