"""Generalised LL recognition with a graph-structured stack.

Grammars are written in EBNF.  Every nonterminal's right side is compiled to a
deterministic automaton over terminals, bracket groups and nonterminals, so
alternatives that share a beginning share the work; what stays ambiguous is
followed in parallel over one graph-structured stack (a node per nonterminal and
position, with edges for the callers and the set of ends found so far).

Input is a *level*: the tokens between two brackets, one character a token, where
an inner bracket pair is a single character that stands for "a group of this
bracket whose contents are derived by exactly these nonterminals".  Levels are
recognised from the inside out.  This has two effects that matter at scale:

* equal levels (and equal statements inside them) are recognised once in a worker
  process and then looked up, whatever names and literals they hold;
* damage stays local: a function whose brackets close is still recognised when
  the file around it is broken.

Notation: ``name = alternatives ;`` with ``'text'`` for a literal token, UPPER
for a token class, ``@(x) @[x] @{x} @<x>`` for a bracket group with contents x,
``? * + | ( )`` as usual and ``%KW`` for any keyword.  A name that starts with
``!`` on its left side is memoised over token sequences.
"""

from __future__ import annotations

import re

END = "\x00"
BRACKETS = {"(": ")", "[": "]", "{": "}", "<": ">"}
_MEMO_LIMIT = 150_000
_TOKEN = re.compile(r"\s*(?:(@[(\[{<])\s*(\w+)\s*[)\]}>]|'((?:[^'\\]|\\.)+)'|(%KW)|(!?\w+)|([=;|?*+()]))")


class _Rule:
    __slots__ = ("name", "index", "memo", "start", "nullable", "table", "size", "firsts", "tree")

    def __init__(self, name: str, index: int, memo: bool):
        self.name, self.index, self.memo, self.nullable = name, index, memo, False
        self.table: dict[str, dict[int, dict[str, tuple]]] = {}
        self.size = 0
        self.firsts: dict[str, bool] = {}


class Grammar:
    """A compiled grammar.

    ``literals``: every literal token with its character; ``classes``: token
    classes with theirs.  ``contents``: bracket -> the rules that may fill it.
    """

    def __init__(self, text: str):
        self.rules: dict[str, _Rule] = {}
        self.literals: dict[str, str] = {}
        self.classes: dict[str, str] = {}
        self.contents: dict[str, list[str]] = {b: [] for b in BRACKETS}
        self._next = 1
        self._groups: dict[tuple[str, frozenset], str] = {}
        self._group_of: dict[str, tuple[str, frozenset]] = {}
        self._levels: dict[tuple[str, str], str] = {}
        self.error = self._char(self.classes, "ERR")
        self._parse(text)
        self._any = self.classes.get("ANY")
        self.word_literals = [x for x in self.literals if x[0].isalpha()]
        self._compile()
        # groups get characters above all token characters
        self._next_group = 0x1000

    # -- reading the notation -------------------------------------------------
    def _char(self, table: dict[str, str], key: str) -> str:
        if key not in table:
            table[key] = chr(self._next)
            self._next += 1
        return table[key]

    def _parse(self, text: str) -> None:
        tokens, at = [], 0
        text = text.strip()
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise ValueError(f"grammar, at {text[at:at + 40]!r}")
            at = m.end()
            if m[1]:
                tokens.append(("group", m[1][1], m[2]))
            elif m[3]:
                tokens.append(("lit", m[3].replace("\\'", "'")))
            elif m[4]:
                tokens.append(("kw",))
            elif m[5]:
                tokens.append(("name", m[5]))
            else:
                tokens.append(("op", m[6]))
        pos = 0

        def alternatives():
            nonlocal pos
            alts = [sequence()]
            while tokens[pos] == ("op", "|"):
                pos += 1
                alts.append(sequence())
            return ("alt", alts) if len(alts) > 1 else alts[0]

        def sequence():
            nonlocal pos
            items = []
            while tokens[pos] not in (("op", "|"), ("op", ";"), ("op", ")")):
                t = tokens[pos]
                pos += 1
                if t == ("op", "("):
                    x = alternatives()
                    pos += 1
                elif t[0] == "lit":
                    x = ("t", self._char(self.literals, t[1]))
                elif t[0] == "name":
                    x = ("t", self._char(self.classes, t[1])) if t[1].isupper() else ("n", t[1])
                elif t[0] == "group":
                    if t[2] not in self.contents[t[1]]:
                        self.contents[t[1]].append(t[2])
                    x = ("g", t[1], t[2])
                elif t[0] == "kw":
                    x = ("kw",)
                else:
                    raise ValueError(f"grammar, {t}")
                while tokens[pos] in (("op", "?"), ("op", "*"), ("op", "+")):
                    x = (tokens[pos][1], x)
                    pos += 1
                items.append(x)
            return ("seq", items)

        while pos < len(tokens):
            name = tokens[pos][1]
            memo = name.startswith("!")
            name = name.lstrip("!")
            assert tokens[pos + 1] == ("op", "="), tokens[pos: pos + 3]
            pos += 2
            rule = _Rule(name, len(self.rules), memo)
            assert name not in self.rules, name
            rule.tree = alternatives()
            assert tokens[pos] == ("op", ";"), (name, tokens[pos])
            pos += 1
            self.rules[name] = rule

    # -- compiling ------------------------------------------------------------
    def _compile(self) -> None:
        def nullable(x) -> bool:
            if x[0] in ("t", "g", "kw"):
                return False
            if x[0] == "n":
                return self.rules[x[1]].nullable
            if x[0] == "seq":
                return all(map(nullable, x[1]))
            if x[0] == "alt":
                return any(map(nullable, x[1]))
            return x[0] in "?*" or nullable(x[1])

        changed = True
        while changed:
            changed = False
            for r in self.rules.values():
                if not r.nullable and nullable(r.tree):
                    r.nullable = changed = True

        self._edges: list[dict] = []  # state -> {symbol: state}
        self._final: list[bool] = []
        keywords = sorted(self.literals[x] for x in self.word_literals)
        for r in self.rules.values():
            nfa: list[list] = [[]]

            def new() -> int:
                nfa.append([])
                return len(nfa) - 1

            def build(x, a: int) -> int:
                if x[0] == "t" or x[0] == "g":
                    b = new()
                    nfa[a].append((x, b))
                    return b
                if x[0] == "kw":
                    b = new()
                    for k in keywords:
                        nfa[a].append((("t", k), b))
                    return b
                if x[0] == "n":
                    b = new()
                    nfa[a].append((x, b))
                    if self.rules[x[1]].nullable:
                        nfa[a].append((None, b))
                    return b
                if x[0] == "seq":
                    for y in x[1]:
                        a = build(y, a)
                    return a
                if x[0] == "alt":
                    b = new()
                    for y in x[1]:
                        s = new()
                        nfa[a].append((None, s))
                        nfa[build(y, s)].append((None, b))
                    return b
                s = new()
                nfa[a].append((None, s))
                e = build(x[1], s)
                b = new()
                nfa[e].append((None, b))
                if x[0] in "*+":
                    nfa[e].append((None, s))
                if x[0] in "*?":
                    nfa[a].append((None, b))
                return b

            last = build(r.tree, 0)

            def closure(states) -> frozenset:
                seen, todo = set(states), list(states)
                while todo:
                    for sym, b in nfa[todo.pop()]:
                        if sym is None and b not in seen:
                            seen.add(b)
                            todo.append(b)
                return frozenset(seen)

            first = closure([0])
            ids = {first: len(self._edges)}
            self._edges.append({})
            self._final.append(last in first)
            todo = [first]
            r.start = ids[first]
            while todo:
                now = todo.pop()
                moves: dict = {}
                for a in now:
                    for sym, b in nfa[a]:
                        if sym is not None:
                            moves.setdefault(sym, set()).add(b)
                for sym, bs in moves.items():
                    to = closure(bs)
                    if to not in ids:
                        ids[to] = len(self._edges)
                        self._edges.append({})
                        self._final.append(last in to)
                        todo.append(to)
                    self._edges[ids[now]][sym] = ids[to]
        self._acts: list[dict] = [{} for _ in self._edges]

    # -- running --------------------------------------------------------------
    def _starts(self, rule: _Rule, ch: str) -> bool:
        """Whether a nonempty derivation of the rule can begin with the token."""
        known = rule.firsts.get(ch)
        if known is None:
            known = rule.firsts[ch] = self._walk(rule, ch, set())
        return known

    def _walk(self, rule: _Rule, ch: str, seen: set) -> bool:
        if rule.name in seen:
            return False
        seen.add(rule.name)
        for sym in self._edges[rule.start]:
            if sym[0] == "t":
                if sym[1] == ch or sym[1] == self._any and ch != self.error and ch != END:
                    return True
            elif sym[0] == "g":
                g = self._group_of.get(ch)
                if g and g[0] == sym[1] and sym[2] in g[1]:
                    return True
            elif self._walk(self.rules[sym[1]], ch, seen):
                return True
        return False

    def _act(self, state: int, ch: str) -> tuple:
        nexts, calls = [], []
        for sym, to in self._edges[state].items():
            if sym[0] == "t":
                if sym[1] == ch or sym[1] == self._any and ch != self.error and ch != END:
                    nexts.append(to)
            elif sym[0] == "g":
                g = self._group_of.get(ch)
                if g and g[0] == sym[1] and sym[2] in g[1]:
                    nexts.append(to)
            elif ch != END and self._starts(self.rules[sym[1]], ch):
                calls.append((self.rules[sym[1]], to))
        act = self._acts[state][ch] = (tuple(nexts), tuple(calls), self._final[state])
        return act

    def run(self, rule: _Rule, s: str, at: int = 0) -> tuple[tuple[int, ...], int]:
        """The ends (relative to ``at``) of what the rule derives from ``s[at:]``, and
        the length of what was looked at.  ``s`` must end with END."""
        acts = self._acts
        root: tuple[list, set] = ([], set())
        nodes: dict = {}
        todo = [(rule.start, root, at)]
        seen = set()
        far = at
        while todo:
            state, node, i = todo.pop()
            while True:
                if i > far:
                    far = i
                ch = s[i]
                act = acts[state].get(ch)
                if act is None:
                    act = self._act(state, ch)
                nexts, calls, final = act
                if final and i not in node[1]:
                    node[1].add(i)
                    for to, up in node[0]:
                        key = (to, id(up), i)
                        if key not in seen:
                            seen.add(key)
                            todo.append((to, up, i))
                for called, to in calls:
                    if called.memo:
                        ends, size = self._memoised(called, s, i)
                        if i + size - 1 > far:
                            far = i + size - 1
                        for e in ends:
                            key = (to, id(node), i + e)
                            if key not in seen:
                                seen.add(key)
                                todo.append((to, node, i + e))
                        continue
                    key = (called.index, i)
                    new = nodes.get(key)
                    if new is None:
                        nodes[key] = new = ([(to, node)], set())
                        todo.append((called.start, new, i))
                    else:
                        edge = (to, node)
                        if all(e[0] != to or e[1] is not node for e in new[0]):
                            new[0].append(edge)
                            for e in new[1]:
                                key = (to, id(node), e)
                                if key not in seen:
                                    seen.add(key)
                                    todo.append((to, node, e))
                if len(nexts) == 1:
                    state = nexts[0]
                    i += 1
                    continue
                for to in nexts:
                    todo.append((to, node, i + 1))
                break
        return tuple(sorted(e - at for e in root[1])), far - at + 1

    def _memoised(self, rule: _Rule, s: str, i: int) -> tuple[tuple[int, ...], int]:
        lengths = rule.table.get(s[i: i + 2])
        if lengths is not None:
            for n, found in lengths.items():
                ends = found.get(s[i: i + n])
                if ends is not None:
                    return ends, n
        ends, n = self.run(rule, s, i)
        if n <= 400:
            if rule.size > _MEMO_LIMIT:
                rule.table.clear()
                rule.size = 0
            rule.size += 1
            rule.table.setdefault(s[i: i + 2], {}).setdefault(n, {})[s[i: i + n]] = ends
        return ends, n

    def derives(self, name: str, level: str) -> bool:
        """Whether the rule derives the whole level (without END)."""
        ends, _ = self.run(self.rules[name], level + END)
        return bool(ends) and ends[-1] == len(level)

    def group(self, bracket: str, level: str) -> str:
        """The character of a bracket group with this level in it."""
        key = (bracket, level)
        found = self._levels.get(key)
        if found is None:
            kinds = frozenset(c for c in self.contents[bracket] if self.derives(c, level))
            found = self._groups.get((bracket, kinds))
            if found is None:
                found = chr(self._next_group)
                self._next_group += 1
                if 0xD800 <= self._next_group <= 0xDFFF:
                    self._next_group = 0xE000
                self._groups[(bracket, kinds)] = found
                self._group_of[found] = (bracket, kinds)
            if len(level) <= 200:
                if len(self._levels) > _MEMO_LIMIT:
                    self._levels.clear()
                self._levels[key] = found
        return found
