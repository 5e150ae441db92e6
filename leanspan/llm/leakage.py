"""Evaluation texts leaking into training text (problem 6).

The evaluation items form a small inverted index with BM25 weights, in blocks of items
with the largest weight of each block.  Every training text queries the index by
block-max WAND, which yields every item whose score reaches the item's own threshold.
That threshold is the least score that runs covering two fifths of the item can have, so
a text that holds so much of an item always reaches it and nothing is lost.  The
items found are then verified on the whole text: runs of eight or more consecutive
words must cover two fifths of the item's words.

Words are compared after undoing entities and tags, case folding and dropping
everything but letters, digits and inner underscores.

An instruction paragraph is a first paragraph, ended by an empty line, that several
items share; it does not belong to an item's passage.  It is told by counts over all
items, before any index is made.

Defined results: null ids and null, empty or blank texts give nothing; items of fewer
than eight words cannot be held and give nothing; equal rows count once; several
items with the same passage are each reported; of an item with several texts each is
an item of its own, and the one most held is reported; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import html
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RUN, SHARE = 8, 0.4  # words in a run, part of the item's words that runs must cover
K1, B = 1.2, 0.75
BLOCK = 16  # postings in a block
SHARED_BY = 2  # items that share an instruction paragraph
#: Text of the items of one broadcast index, in bytes; more items make several indexes with the same result.
INDEX_BYTES = 8_000_000

LEAK_SCHEMA = "doc_id long, item_id long, covered_words int, item_words int, longest_run int"

_TAG = re.compile(r"</?[A-Za-z][A-Za-z0-9]*(?:\s[^<>]*)?/?>|<!--|-->|<br\s*/?>")
_WORD = re.compile(r"[^\W_]+(?:_+[^\W_]+)*")
_ENTITY = re.compile(r"&#?\w+;")
_BREAK = re.compile(r"\r?\n[ \t]*\r?\n")


def words_of(text: str) -> list[str]:
    if "&" in text and _ENTITY.search(text):
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub(" ", text)
    return _WORD.findall(text.lower())


def split_head(text: str) -> tuple[str, str, str]:
    """(words of the first paragraph or nothing, the rest, the whole text)."""
    m = _BREAK.search(text)
    return (" ".join(words_of(text[: m.start()])), text[m.end():], text) if m else ("", "", text)


def own_passages(items: DataFrame) -> DataFrame:
    """item_id, passage: the items' own passages as words, without the instruction paragraphs.

    A paragraph is shared when it begins texts of at least SHARED_BY items; items are
    counted by the hash of its words, in one small shuffle.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts = [split_head(t) for t in batch["text"]]
            yield pd.DataFrame({"item_id": batch["item_id"], "head": [h for h, _, _ in parts], "rest": [" ".join(words_of(r)) for _, r, _ in parts], "whole": [" ".join(words_of(w)) for _, _, w in parts]})

    made = items.select("item_id", "text").mapInPandas(run, "item_id long, head string, rest string, whole string").withColumn("key", F.sha2("head", 256))
    shared = made.filter("head <> ''").groupBy("key").agg(F.countDistinct("item_id").alias("n")).filter(F.col("n") >= SHARED_BY).select("key", F.lit(True).alias("shared"))
    return made.join(shared, "key", "left").select("item_id", F.when(F.col("shared"), F.col("rest")).otherwise(F.col("whole")).alias("passage")).distinct()


def least_score(words: list[str], weight: dict[str, float]) -> float:
    """A lower bound of the summed weights of the words of any runs that cover enough of an item.

    A word that stands at several places gives each its part, so that the parts of any
    places add up to no more than the weights of the words there.  Over the places one
    after another the least sum is kept for every number of places covered so far and
    for the length of the run that ends there (RUN stands for all longer ones); a run may
    end only when it is long enough.
    """
    tf = Counter(words)
    need = max(RUN, math.ceil(SHARE * len(words) - 1e-9))
    best = np.full((RUN + 1, need + 1), np.inf)  # run length, places covered (need: or more)
    best[0, 0] = 0.0
    for w in words:
        part = weight[w] / tf[w]
        grown = np.full_like(best, np.inf)
        grown[0] = np.minimum(best[0], best[RUN])
        longer = np.empty_like(best)
        longer[:, 1:] = best[:, :-1] + part
        longer[:, 0] = np.inf
        longer[:, need] = np.minimum(longer[:, need], best[:, need] + part)
        grown[1:] = longer[:-1]
        grown[RUN] = np.minimum(grown[RUN], longer[RUN])
        best = grown
    return float(min(best[0, need], best[RUN, need]))


class ItemIndex:
    """BM25 inverted index of item passages (lists of words) with block maxima and a threshold for each item."""

    def __init__(self, items: list[tuple[int, str]]):
        own = [(i, p.split(" ")) for i, p in sorted(set(items)) if p.count(" ") + 1 >= RUN]
        n = len(own)
        df = Counter(t for _, w in own for t in set(w))
        mean = sum(len(w) for _, w in own) / max(n, 1)
        idf = {t: math.log(1 + (n - d + 0.5) / (d + 0.5)) for t, d in df.items()}
        weighted = []
        for _, w in own:
            tf = Counter(w)
            weight = {t: idf[t] * f * (K1 + 1) / (f + K1 * (1 - B + B * len(w) / mean)) for t, f in tf.items()}
            weighted.append((least_score(w, weight), weight))
        # items of like thresholds share a block, which keeps the block's bound close
        order = sorted(range(n), key=lambda k: (weighted[k][0], own[k][0], k))
        self.ids = [own[k][0] for k in order]
        self.words = [own[k][1] for k in order]
        terms: dict[str, list[tuple[int, float]]] = defaultdict(list)
        for k, old in enumerate(order):
            least, weight = weighted[old]
            for t, x in weight.items():
                terms[t].append((k, x / least))  # a score of 1 is the item's threshold
        self.blocks = -(-n // BLOCK)
        self.term = {t: k for k, t in enumerate(terms)}
        posts = list(terms.values())
        # postings of all terms one after another; the block entries of a term say where each block's postings are
        self.post_item = np.array([k for p in posts for k, _ in p], dtype=np.int64)
        self.post_weight = np.array([x for p in posts for _, x in p])
        block_of, starts, tops, sizes = [], [], [], []
        at = 0
        for p in posts:
            before = len(tops)
            for k, x in p:
                if len(tops) == before or block_of[-1] != k // BLOCK:
                    block_of.append(k // BLOCK)
                    starts.append(at)
                    tops.append(x)
                elif x > tops[-1]:
                    tops[-1] = x
                at += 1
            sizes.append(len(tops) - before)
        self.top_at = np.cumsum([0, *sizes])
        self.top_block = np.array(block_of, dtype=np.int64)
        self.top_weight = np.array(tops)
        self.top_post = np.array([*starts, at], dtype=np.int64)
        self.term_top = np.array([max((x for _, x in p), default=0.0) for p in posts] or [0.0])
        #: every eight words of an item -> where
        self.runs: dict[tuple, list[tuple[int, int]]] = {}
        for k, w in enumerate(self.words):
            for p in range(len(w) - RUN + 1):
                self.runs.setdefault(tuple(w[p: p + RUN]), []).append((k, p))

    @staticmethod
    def _expand(at: np.ndarray, which: np.ndarray) -> np.ndarray:
        """Indices of the entries of several lists."""
        begin = at[which]
        counts = at[which + 1] - begin
        ends = np.cumsum(counts)
        return np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - ends + counts, counts)

    def search(self, words: list[str], least: float = 1.0 - 1e-9) -> set[int]:
        """Every item whose score for the words reaches its threshold, by block-max WAND.

        The lists are taken by falling maxima up to the pivot, behind which the maxima of
        all lists left add up to less than the threshold; only blocks that a list before
        the pivot enters can hold a hit.  Of these the blocks whose maxima, over all
        lists, fall short are skipped, and postings are read in the blocks left only.
        """
        get = self.term.get
        found = np.array([t for w in set(words) if (t := get(w)) is not None], dtype=np.int64)
        if not len(found):
            return set()
        found = found[np.argsort(-self.term_top[found], kind="stable")]
        behind = np.cumsum(self.term_top[found][::-1])[::-1]
        if behind[0] < least:
            return set()
        pivot = int(np.searchsorted(-behind, -least, side="right"))
        entered = np.zeros(self.blocks, dtype=bool)
        entered[self.top_block[self._expand(self.top_at, found[:pivot])]] = True
        entry = self._expand(self.top_at, found)
        entry = entry[entered[self.top_block[entry]]]
        live = np.bincount(self.top_block[entry], weights=self.top_weight[entry], minlength=self.blocks) >= least
        entry = entry[live[self.top_block[entry]]]
        if not len(entry):
            return set()
        post = self._expand(self.top_post, entry)
        first = int(self.post_item[post].min())
        score = np.bincount(self.post_item[post] - first, weights=self.post_weight[post])
        return set((np.flatnonzero(score >= least) + first).tolist())

    def verify(self, items: set[int], words: list[str]) -> dict[int, tuple[int, int]]:
        """item -> (words of it that runs cover, longest run), over a whole text, for the items given."""
        covered: dict[int, bytearray] = {}
        longest: dict[int, int] = {}
        live: dict[tuple[int, int], int] = {}  # item and position just after a run -> its length
        get = self.runs.get
        for gram in zip(*(words[k:] for k in range(RUN))):
            at = get(gram)
            if at is None:
                if live:
                    live = {}
                continue
            new = {}
            for k, q in at:
                if k in items:
                    if k not in covered:
                        covered[k] = bytearray(len(self.words[k]))
                    covered[k][q: q + RUN] = b"\x01" * RUN
                    new[k, q + 1] = n = live.get((k, q), RUN - 1) + 1
                    if n > longest.get(k, 0):
                        longest[k] = n
            live = new
        return {k: (sum(c), longest[k]) for k, c in covered.items()}

    def leaks(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item id, covered words, item words, longest run) of the items that a text holds."""
        words = words_of(text)
        if len(words) < RUN:
            return []
        found = self.search(words)
        if not found:
            return []
        held = [(self.ids[k], n, len(self.words[k]), run) for k, (n, run) in self.verify(found, words).items() if n >= SHARE * len(self.words[k]) - 1e-9]
        best: dict[int, tuple[int, int, int, int]] = {}
        for h in sorted(held, key=lambda h: (h[1] / h[2], h)):
            best[h[0]] = h
        return [best[i] for i in sorted(best)]


def find_leaks(documents: DataFrame, benchmark: DataFrame, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """LEAK_SCHEMA; one row for each document and item that it holds.

    The items' passages are made first and written nowhere; they are fixed held-out
    material whose size is checked, and are dealt into indexes of at most about
    ``index_bytes`` of text, each broadcast and each searched by every document.  Which
    items share an index makes no difference to the result.  Documents are never shuffled.
    """
    items = own_passages(benchmark.filter(F.col("item_id").isNotNull() & F.col("text").isNotNull()))
    size = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shares = max(1, -(-size // index_bytes))
    docs = documents.filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text")
    out = None
    for k in range(shares):
        part = items if shares == 1 else items.filter(F.pmod(F.xxhash64("item_id"), F.lit(shares)) == k)
        found = _search(docs, [(r["item_id"], r["passage"]) for r in part.collect()])
        out = found if out is None else out.unionByName(found)
    return out


_INDEXES: dict[str, ItemIndex] = {}


def _index(key: str, rows: list[tuple[int, str]]) -> ItemIndex:
    """The index of some items, made once in each worker process."""
    if key not in _INDEXES:
        _INDEXES.clear()
        _INDEXES[key] = ItemIndex(rows)
    return _INDEXES[key]


def _search(docs: DataFrame, rows: list[tuple[int, str]]) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(sorted(rows))
    key = hashlib.sha256(repr(sorted(rows)).encode()).hexdigest()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = _index(key, shared.value)
        for batch in batches:
            out = [(doc, *x) for doc, text in zip(batch["doc_id"], batch["text"]) for x in index.leaks(text)]
            yield pd.DataFrame(out, columns=[c.split()[0] for c in LEAK_SCHEMA.split(", ")])

    return docs.mapInPandas(run, LEAK_SCHEMA)
