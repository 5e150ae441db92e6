"""Functions of whole and of broken files, found by parsing.

The lexer's brackets are mended where they do not fit: a closing bracket that belongs
further out closes what stands open inside it, one that belongs nowhere is an error
token, and what is open at the end of the text ends there.  In Python a line that begins
a definition also ends brackets left open, and a dedent to no known width goes to the
nearest one.  Every level so found, sound or not, is searched for functions: wherever a
line or statement begins, the generalised LL parser is asked how far the language's rule
for a function reaches.  Damage stays in the level that holds it, so the functions before,
behind and around it are found, and a function with damage inside is not.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

from .gll import END
from .languages import _CLOSE, Language, Unbalanced

_HEADS = {"python": ("def", "async"), "go": ("func",)}
#: levels that hold statements only, by language; their inner levels are searched themselves
_BODIES = {"java": "block", "cpp": "block", "go": "block"}
_CONTROL = frozenset("if for while switch catch with do else try return function super".split())
_NAME = re.compile(r"(?:pub(?:\s*\([^()]*\))?\s+|(?:async|const|unsafe|safe|default|export|extern(?:\s*\"[^\"]*\")?)\s+)*(?:def|fn|function\s*\*?|func(?:\s*\([^()]*\))?)\s*([\w$]+)")
_BEFORE_PAREN = re.compile(r"([#~]?[\w$]+|operator[^\w\s(]+(?:\(\))?|\[[^\]]*\]|\"[^\"\n]*\"|'[^'\n]*')[ \t\r\n]*(?:<[^()]*>[ \t\r\n]*)?\??\Z")


class Level:
    """The tokens of a level, where each begins (not kept inside round and square brackets) and where its groups end."""

    __slots__ = ("chars", "at", "ends", "bracket", "group")

    def __init__(self, bracket: str):
        self.bracket = bracket
        self.chars: list[str] = []
        self.at: list[int] = []
        self.ends: dict[int, int] = {}
        self.group = ""

    def put(self, char: str, at: int) -> None:
        self.chars.append(char)
        self.at.append(at)


def levels(lang: Language, text: str) -> list[Level]:
    """Every level of a text that may hold functions, inner ones first, with brackets mended."""
    return _python_levels(lang, text) if lang.spec == "python" else _bracket_levels(lang, text)


def _shut(lang: Language, stack: list[Level], done: list[Level], at: int, opened: list[int], sound: bool) -> None:
    """Ends the innermost level; an unsound one is an error in the level around it."""
    level = stack.pop()
    begin = opened.pop()
    if level.bracket in "{<":
        if lang.spec == "script" and level.bracket == "{" and level.chars and level.chars[-1] != lang.end:
            level.put(lang.end, at)
        done.append(level)
    level.group = lang.grammar.group(level.bracket, "".join(level.chars)) if sound else lang.grammar.error
    up = stack[-1]
    up.ends[len(up.chars)] = at
    up.put(level.group, begin)


def _bracket_levels(lang: Language, text: str) -> list[Level]:
    g, kinds, chars, name = lang.grammar, lang.kinds, lang.chars, lang.name_char
    get = chars.get
    script, go = lang.spec == "script", lang.spec == "go"
    done: list[Level] = []
    top = Level("")
    stack, opened = [top], [0]
    put, place = top.chars.append, top.at.append
    at: int | None = 0
    while at is not None:
        again = None
        for m in lang.regex.finditer(text, at):
            k = m.lastindex
            kind = kinds[k]
            if kind == "word":
                put(get(m[k], name))
                place(m.start(k))
                continue
            if kind == "op":
                put(chars[m[k]])
                place(m.start(k))
                continue
            if kind is None:
                continue
            a = m.start(k)
            if kind == "open":
                top = Level(m[k])
                stack.append(top)
                opened.append(a)
            elif kind == "close":
                wanted = _CLOSE[m[k]]
                if top.bracket == wanted:
                    _shut(lang, stack, done, m.end(), opened, True)
                elif any(x.bracket == wanted for x in stack) and not (wanted != "{" and any(x.bracket == "{" for x in stack[max(i for i, x in enumerate(stack) if x.bracket == wanted):])):
                    while stack[-1].bracket != wanted:
                        _shut(lang, stack, done, a, opened, False)
                    _shut(lang, stack, done, m.end(), opened, True)
                else:
                    top.put(g.error, a)
                top = stack[-1]
            elif kind == "newline":
                last = top.chars[-1] if top.chars else ""
                if script:
                    if last and top.bracket in ("", "{") and (last in lang.enders or last >= "က") and not lang.before_not.match(text, m.end()):
                        top.put(lang.end, a)
                elif last and (last in lang.enders or last >= "က") and "\n" in m[k]:
                    top.put(lang.end, a)
            elif kind == "template":
                if "${" in m[k] or len(m[k]) == 1:
                    try:
                        c, again = lang._template(text, a + 1)
                    except Unbalanced:
                        c, again = g.error, a + 1
                    top.put(c, a)
                    break
                top.put(g.classes["TPL"], a)
            else:
                top.put(kind, a)
            put, place = top.chars.append, top.at.append
        at = again
    while len(stack) > 1:
        _shut(lang, stack, done, len(text), opened, False)
    if (script or go) and stack[0].chars and stack[0].chars[-1] != lang.end:
        stack[0].put(lang.end, len(text))
    return [*done, stack[0]]


def _python_levels(lang: Language, text: str) -> list[Level]:
    g, kinds, chars, nl = lang.grammar, lang.kinds, lang.chars, lang.end
    done: list[Level] = []
    stack, opened, indents = [Level("")], [0], [0]
    depth = 0

    code = 0  # where the code so far ends

    def indent(width: int, at: int) -> None:
        if width > indents[-1]:
            indents.append(width)
            stack.append(Level("<"))
            opened.append(at)
        while width < indents[-1]:
            indents.pop()
            _shut(lang, stack, done, code, opened, True)
            if width > indents[-1]:
                stack[-1].put(g.error, at)
                break

    def line(a: int) -> None:
        top = stack[-1]
        if top.chars and top.chars[-1] != nl and not (top.chars[-1] >= "က" and g._group_of.get(top.chars[-1], " ")[0] == "<"):
            top.put(nl, a)

    at: int | None = re.match(r"(?:[ \t\f]*(?:#[^\n]*)?\r?\n)*[ \t\f]*", text).end()
    while at is not None:
        again = None
        for m in lang.regex.finditer(text, at):
            k = m.lastindex
            kind, a, b = kinds[k], m.start(k), m.end()
            if kind == "word":
                if depth and m[k] in ("def", "class", "async", "import", "return") and not text[text.rfind("\n", 0, a) + 1: a].strip():
                    # a line that begins a statement: the brackets before it were never closed
                    begin = text.rfind("\n", 0, a) + 1
                    while depth:
                        _shut(lang, stack, done, begin, opened, False)
                        depth -= 1
                    line(begin)
                    indent(len(text[begin:a].expandtabs(8)), a)
                stack[-1].put(chars.get(m[k], lang.name_char), a)
            elif kind == "op":
                stack[-1].put(chars[m[k]], a)
            elif kind is None:
                continue
            elif kind == "newline":
                if not depth:
                    line(a)
                    if b < len(text):
                        s = m[k]
                        indent(len(s[s.rindex("\n") + 1:].expandtabs(8)), b)
            elif kind == "open":
                stack.append(Level(m[k]))
                opened.append(a)
                depth += 1
            elif kind == "close":
                wanted = _CLOSE[m[k]]
                inner = [x.bracket for x in stack[len(stack) - depth:]]
                if wanted in inner:
                    while stack[-1].bracket != wanted:
                        _shut(lang, stack, done, a, opened, False)
                        depth -= 1
                    _shut(lang, stack, done, b, opened, True)
                    depth -= 1
                else:
                    stack[-1].put(g.error, a)
            elif kind == "fstring":
                try:
                    c, again = lang._fstring(text, a)
                except (Unbalanced, AttributeError):
                    c, again = g.error, a + 1
                stack[-1].put(c, a)
                code = again
                break
            else:
                stack[-1].put(kind, a)
            if kind != "newline":
                code = b
        at = again
    while depth:
        _shut(lang, stack, done, len(text), opened, False)
        depth -= 1
    line(len(text))
    indent(0, len(text))
    return [*done, stack[0]]


def _name(level: Level, i: int, text: str, stop: int) -> str:
    """The name of the function that begins at a token: what its keyword says, or the word before its parameters."""
    for k in range(i, len(level.chars)):
        if level.chars[k] >= "က" and text[level.at[k]] in "({":
            if m := _NAME.match(text[level.at[i]: stop]) or _BEFORE_PAREN.search(text[level.at[i]: level.at[k]]):
                return m[1]
            break
    return ""


def _all(s: str, char: str) -> list[int]:
    out, at = [], s.find(char)
    while at >= 0:
        out.append(at)
        at = s.find(char, at + 1)
    return out


def functions(lang: Language, text: str) -> list[tuple[int, int, str]]:
    """(start, end, name) of the functions and methods of a text that the language's rule derives."""
    g = lang.grammar
    rules = [g.rules[r] for r in ("island", "island_method") if r in g.rules]
    heads = {lang.chars[x] for x in _HEADS.get(lang.name, ())}
    body = _BODIES.get(lang.name)
    line_starts = [0, *(m.end() for m in re.finditer("\n", text))]
    marks = "".join(c for c in (g.literals.get(";"), g.classes.get("NL"), g.literals.get(":")) if c)
    behind = re.compile(f"[{re.escape(marks)}\u1000-\U0010ffff]") if marks else re.compile("[\u1000-\U0010ffff]")
    out: dict[tuple[int, int], str] = {}
    for level in levels(lang, text):
        if not level.chars or body and level.bracket == "{" and body in g._group_of.get(level.group, ("", ()))[1] and not g._group_of[level.group][1] & {"class_body", "items"}:
            continue
        s = "".join(level.chars) + END
        at, n = level.at, len(level.chars)
        if heads:
            places = [i for h in heads for i in _all(s, h)]
        else:
            # behind a statement, a label or a block, and where a line begins
            places = [0, *(m.end() for m in behind.finditer(s) if m[0] < "က" or g._group_of.get(m[0], " ")[0] in "{<")]
            lo, hi = bisect_right(line_starts, at[0]), bisect_right(line_starts, at[-1])
            places += [bisect_left(at, p) for p in line_starts[lo:hi]]
        for i in sorted(set(places)):
            if i >= n:
                continue
            c, a = level.chars[i], at[i]
            before = level.chars[i - 1] if i else None
            if before is not None and before not in marks and g._group_of.get(before, " ")[0] not in "{<" and text[line_starts[bisect_right(line_starts, a) - 1]: a].strip(" \t\f\ufeff"):
                continue
            if text[a: a + 1] == "[":  # attributes are no part of a function
                continue
            for rule in rules:
                if not g._starts(rule, c):
                    continue
                ends, _ = g.run(rule, s, i)
                if ends and ends[-1]:
                    last = i + ends[-1] - 1
                    while lang.name == "python" and last > i and last not in level.ends and level.chars[last] in marks:
                        last -= 1
                    stop = level.ends.get(last)
                    if stop is None:  # a body on the line itself ends with the line
                        stop = at[last + 1] if last + 1 < n else len(text)
                    if lang.name == "python":
                        stop = a + len(text[a:stop].rstrip())
                    name = _name(level, i, text, stop)
                    if name not in _CONTROL:
                        out.setdefault((a, stop), name)
    return [(a, b, n) for (a, b), n in sorted(out.items())]
