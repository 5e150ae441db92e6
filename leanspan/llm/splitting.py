"""Splitting oversized items at natural boundaries (problem 5).

Structure-tree packing.  The lines of a text are parsed into a tree: headings hold what
follows down to the next heading of their rank, fences hold what they enclose, a line
holds the deeper lines below it (the body of a declaration, the continuation of a list
item), a closing bracket belongs to the line that opened, and siblings that blank lines
part form blocks.  Packing works from the bottom up: neighbouring subtrees are merged
while they fit the limit, and only a node that does not fit is taken apart; so a cut
never falls inside a subtree that would have fitted.  A line that does not fit by itself
is taken apart into sentences, these into words, and these between characters.  Every
piece but the first begins with the end of its predecessor, so that consecutive pieces
overlap by up to ``overlap`` tokens, cut at a line or word.

Defined results: null, empty and blank texts and texts within the limit give no
pieces; equal deliveries of an id count once; null start lines count from line 1; a
text without any boundary is cut between characters; pieces without their overlap add
up to the text exactly; extra columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leanspan.functions.tokens import WHITE_SPACE_PY, estimate

LIMIT, OVERLAP = 1024, 64
PIECE_SCHEMA = "chunk_id long, file_id long, piece int, content string, start_line long, end_line long, start_byte long, end_byte long, overlap_bytes long, token_count long"

_FENCE = re.compile(r"^[ \t]*(```|~~~)")
_HEADING = re.compile(r"^(#{1,6})[ \t]+\S")
_TAG = re.compile(r"^<h([1-6])\b", re.I)
_CLOSING = re.compile(r"^[ \t]*(?:[)\]}>]|</|end\b|fi\b|done\b|esac\b)")
_LINE_END = re.compile(r"\r\n|[\n\r\v\f\x1c-\x1e\x85\u2028\u2029]")
_SENTENCE = re.compile(r"(?<=[.!?;:])[ \t]+(?=\S)")
_GAP = re.compile(r"(?<=[\s,;(){}\[\]|/=&])(?=\S)")
_DEEPEST = 400  # indents beyond it count as one
_STARTS = re.compile(f"(?<![^{WHITE_SPACE_PY}])[^{WHITE_SPACE_PY}]")


class _Measure:
    """Token estimates of slices in constant time."""

    def __init__(self, text: str):
        self.text = text
        self.starts = [m.start() for m in _STARTS.finditer(text)]
        self.space = re.compile(f"[{WHITE_SPACE_PY}]")

    def __call__(self, a: int, b: int) -> int:
        if b <= a:
            return 0
        words = bisect_left(self.starts, b) - bisect_left(self.starts, a)
        if not self.space.match(self.text, a) and (a and not self.space.match(self.text, a - 1)):
            words += 1  # the slice begins inside a word
        return max(-(-(b - a) // 4), words, 1)


class Node:
    """A subtree: text[start:end], and its parts in order, which add up to it; a line has none."""

    __slots__ = ("start", "end", "parts")

    def __init__(self, start: int, end: int):
        self.start, self.end = start, end
        self.parts: list[Node] = []


def tree(text: str) -> Node:
    """The structure of a text's lines."""
    root = Node(0, len(text))
    # open nodes with their depths: headings 1 to 6, others 10 and the width of their indent
    open_: list[tuple[int, Node]] = [(0, root)]
    blanks: set[int] = set()  # starts of lines that a blank line precedes
    fence, base, blank, at = "", 0, False, 0
    for line in _lines(text):
        end = at + len(line)
        if not line.strip():
            # a blank line ends the line before it
            blank = True
            _stretch(open_, end)
            at = end
            continue
        width = len(line.expandtabs(4)) - len(line.expandtabs(4).lstrip())
        depth = base + 10 + min(width, _DEEPEST)
        mark = _FENCE.match(line)
        if fence:
            if mark and mark[1] == fence:
                fence, base = "", 0
                _stretch(open_, end)
                at, blank = end, False
                continue
        elif mark:
            fence = mark[1]
        elif h := _HEADING.match(line):
            depth = len(h[1])
        elif h := _TAG.match(line):
            depth = int(h[1])
        while open_[-1][0] > depth or open_[-1][0] == depth and not _CLOSING.match(line):
            open_.pop()
        if open_[-1][0] == depth:
            # a closing bracket: part of the node that the line before opened at this depth
            open_[-1][1].parts.append(Node(at, end))
            _stretch(open_, end)
        else:
            node = Node(at, end)
            node.parts.append(Node(at, end))  # its own line
            if blank:
                blanks.add(at)
            open_[-1][1].parts.append(node)
            open_.append((depth, node))
            _stretch(open_, end)
        if mark and fence:
            base = depth + 1
        at, blank = end, False
    _tidy(root, blanks)
    return root


def _lines(text: str) -> Iterator[str]:
    at = 0
    for m in _LINE_END.finditer(text):
        yield text[at: m.end()]
        at = m.end()
    if at < len(text):
        yield text[at:]


def _stretch(open_: list[tuple[int, Node]], end: int) -> None:
    """Lets the open nodes, and the last line among them, reach to an offset."""
    for _, n in open_:
        n.end = max(n.end, end)
    last = open_[-1][1]
    if last.parts:
        last.parts[-1].end = end


def _tidy(root: Node, blanks: set[int]) -> None:
    """Starts at the parent's start, blocks of siblings, and no nodes with a single part."""
    todo = [root]
    while todo:
        node = todo.pop()
        while len(node.parts) == 1:
            node.parts = node.parts[0].parts
        if node.parts:
            node.parts[0].start = node.start
            node.parts[-1].end = node.end
        groups: list[list[Node]] = []
        for p in node.parts:
            if not groups or p.start in blanks:
                groups.append([])
            groups[-1].append(p)
        if 1 < len(groups) < len(node.parts):
            node.parts = []
            for g in groups:
                block = g[0]
                if len(g) > 1:
                    block = Node(g[0].start, g[-1].end)
                    block.parts = g
                    todo += g
                else:
                    todo.append(block)
                node.parts.append(block)
        else:
            todo += node.parts


def _apart(text: str, a: int, b: int, limit: int, size: _Measure) -> list[tuple[int, int]]:
    """A line that does not fit: sentences, words, characters; merged as far as they fit."""
    for pattern in (_SENTENCE, _GAP):
        cuts = sorted({a, b, *(a + m.end() for m in pattern.finditer(text[a:b]))})
        if len(cuts) > 2:
            out: list[tuple[int, int]] = []
            for x, y in zip(cuts, cuts[1:]):
                out += [(x, y)] if size(x, y) <= limit else _apart(text, x, y, limit, size)
            return _merge(out, limit, size)
    step = 4 * limit
    return [(x, min(x + step, b)) for x in range(a, b, step)]


def _merge(parts: list[tuple[int, int]], limit: int, size: _Measure) -> list[tuple[int, int]]:
    """Joins neighbours, from the left, while they fit together."""
    out: list[tuple[int, int]] = []
    for p in parts:
        if out and size(out[-1][0], p[1]) <= limit:
            out[-1] = (out[-1][0], p[1])
        else:
            out.append(p)
    return out


def pack(text: str, limit: int, size: _Measure) -> list[tuple[int, int]]:
    """Consecutive ranges of at most ``limit`` tokens that add up to the text.

    A node that fits is one range.  Of one that does not, the parts are packed first and
    the ranges that come of them are merged with their neighbours.
    """
    root = tree(text)
    todo: list[tuple[Node, bool]] = [(root, False)]
    done: list[list[tuple[int, int]]] = []
    while todo:
        node, packed = todo.pop()
        if packed:
            ranges = [r for part in done[len(done) - len(node.parts):] for r in part]
            del done[len(done) - len(node.parts):]
            done.append(_merge(ranges, limit, size))
        elif size(node.start, node.end) <= limit:
            done.append([(node.start, node.end)])
        elif not node.parts:
            done.append(_apart(text, node.start, node.end, limit, size))
        else:
            todo.append((node, True))
            todo += [(p, False) for p in reversed(node.parts)]
    return done[0]


def split_text(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int]]:
    """(start with overlap, start, end) of each piece of a text, in code points."""
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and less than limit")
    size = _Measure(text)
    out: list[tuple[int, int, int]] = []
    lines = [0, *(m.end() for m in re.finditer("\n", text))]
    # one token for a word that the overlap's cut halves
    for a, b in pack(text, max(1, limit - overlap - (overlap > 0)), size):
        begin = a
        if out and overlap:
            least = out[-1][1]
            near = max(least, a - 4 * overlap)
            options = lines[bisect_left(lines, near): bisect_left(lines, a)] or [p for p in size.starts[bisect_left(size.starts, near): bisect_left(size.starts, a)]] or [near]
            for p in options:
                if size(p, a) <= overlap and size(p, b) <= limit:
                    begin = p
                    break
        out.append((begin, a, b))
    return out


def split_oversized(chunks: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Pieces (PIECE_SCHEMA) of the chunks above the limit, whatever their recorded token count.

    The size test runs in the JVM and only oversized rows reach Python; duplicates are
    removed among those alone.
    """
    n = F.length("content")
    # a quarter of the code points alone decides above 4 x limit; words, of two code points each at least, cannot reach the limit below 2 x limit
    large = F.when(n > 4 * limit, F.lit(True)).when(n <= 2 * limit, F.lit(False)).otherwise(estimate("content") > limit)
    over = chunks.filter(F.col("id").isNotNull() & large).select("id", "file_id", "content", "start_line", "start_byte").dropDuplicates(["id"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for chunk, file, text, line, byte in zip(batch["id"], batch["file_id"], batch["content"], batch["start_line"], batch["start_byte"]):
                line, byte = (1 if pd.isna(line) else int(line)), (0 if pd.isna(byte) else int(byte))
                size = _Measure(text)
                newlines = [m.start() for m in re.finditer("\n", text)]
                ascii_ = text.isascii()
                offsets = None if ascii_ else [0, *accumulate(len(c.encode("utf-8", "surrogatepass")) for c in text)]
                at = (lambda p: p) if ascii_ else (lambda p: offsets[p])
                for k, (begin, a, b) in enumerate(split_text(text, limit, overlap)):
                    first = line + bisect_left(newlines, begin)
                    last = line + bisect_left(newlines, max(begin, b - 1))
                    out.append((chunk, None if pd.isna(file) else file, k, text[begin:b], first, last, byte + at(begin), byte + at(b), at(a) - at(begin), size(begin, b)))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in PIECE_SCHEMA.split(", ")]).astype({"file_id": "Int64"})

    return over.mapInPandas(run, PIECE_SCHEMA)
