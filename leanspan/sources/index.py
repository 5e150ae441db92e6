"""A stored word and trigram index of chunks, published as one generation.

Five tables are made of the chunks and their files:

* ``texts``: each chunk once, ordered by id, so that a few ids are read from few row groups;
* ``words``: term, key, tf and the text's length, in buckets of the term's hash, ordered by term;
* ``grams``: three lower-case characters and, block by block of the ids, the keys that hold them;
* ``edges``: imports of files that resolve;
* ``sizes``: how many texts there are and their mean length, one row.

A search reads the buckets of its terms, never the texts; what the index proposes is
verified on the texts of the proposed keys alone.  Buckets are salted by key while they
are built, so that a term that every text holds is counted in many tasks, and a gram's
keys are arrays of at most BLOCK ids.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leanspan.functions.text import token_terms

from . import generation

FORMAT = 2  # of the stored tables; an index of another one is built anew
BUCKETS, SALTS, BLOCK = 32, 8, 8192
SCAN_BYTES = 64_000_000  # of compressed texts: a few seconds of one core
FEW = 500  # ids that are pushed into the scan as literals; more are joined


def index_folder(spark: SparkSession) -> str:
    """The shared folder of the cluster, or a folder that stays for this user where none is set, as in local tests."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/") + "/leanspan-index"
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    return f"file://{tempfile.gettempdir()}/leanspan-index-{os.getuid()}"


def _bucket(term: str | Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def buckets_of(terms: list[str]) -> list[int]:
    """The buckets of some terms, as the column expression gives them."""
    signed = lambda x: x - (1 << 64) if x >= 1 << 63 else x
    return sorted({signed(xxhash.xxh64_intdigest(t.encode("utf-8", "surrogatepass"), seed=42)) % BUCKETS for t in terms})


def grams_of(text: str) -> list[str]:
    low = text.lower()
    return sorted({low[k: k + 3] for k in range(len(low) - 2)})


@dataclass(frozen=True)
class Index:
    """The tables of one generation, pinned."""

    texts: DataFrame
    words: DataFrame
    grams: DataFrame
    sizes: DataFrame
    edges: DataFrame | None = None  # imports of the files, where there are files
    text_bytes: int = 1 << 62  # of the stored texts

    @property
    def small(self) -> bool:
        """Whether reading all texts costs less than a lookup does; the result is the same."""
        return self.text_bytes <= SCAN_BYTES

    def postings(self, terms: list[str]) -> DataFrame:
        """term, key, tf, length of the terms: a parameter list, pushed into the scan with its buckets."""
        if not terms:
            return self.words.limit(0).drop("bucket")
        return self.words.filter(F.col("bucket").isin(buckets_of(terms)) & F.col("term").isin(list(terms))).drop("bucket")

    def holding(self, literal: str) -> DataFrame | None:
        """key of the texts that hold every trigram of a literal; None when it has none and every text may match."""
        wanted = grams_of(literal)
        if not wanted:
            return None
        found = self.grams.filter(F.col("bucket").isin(buckets_of(wanted)) & F.col("gram").isin(wanted))
        # a gram has one array a block, of BLOCK keys at most
        blocks = found.groupBy("block").agg(F.count("*").alias("n"), F.collect_list("keys").alias("lists")).filter(F.col("n") == len(wanted))
        return blocks.select(F.explode(F.aggregate(F.slice("lists", 2, len(wanted)), F.col("lists")[0], lambda a, x: F.array_intersect(a, x))).alias("key"))

    def matching(self, literals: list[list[str]]) -> DataFrame | None:
        """key of the texts that may match a conjunction of alternatives of literals; None when nothing can be left out."""
        out = None
        for alternatives in literals:
            any_of = None
            for x in alternatives:
                keys = self.holding(x)
                if keys is None:
                    any_of = None
                    break
                any_of = keys if any_of is None else any_of.unionByName(keys)
            else:
                any_of = any_of.distinct() if len(alternatives) > 1 else any_of
                out = any_of if out is None else out.join(any_of, "key", "left_semi")
        return out

    def pick(self, ids: list[int]) -> DataFrame:
        """The texts of ids that the caller holds already."""
        if len(ids) > FEW:
            wanted = self.texts.sparkSession.createDataFrame([(i,) for i in ids], "id long")
            return self.texts.filter(F.col("id").between(min(ids), max(ids))).join(F.broadcast(wanted), "id", "left_semi")
        return self.texts.filter(F.col("id").isin(ids)) if ids else self.texts.limit(0)

    def fetch(self, keys: DataFrame | None) -> DataFrame:
        """The texts of the keys: of a few by literals in the scan, of more by a join; of None all."""
        if keys is None:
            return self.texts
        some = [r["key"] for r in keys.limit(FEW + 1).collect()]
        if len(some) <= FEW:
            return self.texts.filter(F.col("id").isin(some)) if some else self.texts.limit(0)
        return self.texts.join(keys.select(F.col("key").alias("id")), "id", "left_semi")


def _gram_rows(texts: DataFrame) -> DataFrame:
    """gram, block, keys of each batch of texts: the keys of a batch are put together before anything is shuffled."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            held: dict[tuple[str, int], list[int]] = {}
            for key, text in zip(batch["id"], batch["content"]):
                for g in grams_of(text):
                    held.setdefault((g, key // BLOCK), []).append(key)
            yield pd.DataFrame({"gram": [g for g, _ in held], "block": [b for _, b in held], "keys": list(held.values())})

    return texts.select("id", "content").mapInPandas(run, "gram string, block long, keys array<long>")


def build(spark: SparkSession, chunks: DataFrame, root: str, fingerprint: str, files: DataFrame | None = None) -> None:
    """Builds and publishes the index; somebody who published the same meanwhile has done the work."""
    own = chunks.filter("id is not null and content is not null").dropDuplicates(["id"])
    texts = own.repartitionByRange("id").sortWithinPartitions("id")
    try:
        generation.publish(spark, f"{root}/texts", {"texts": texts}, 0, {"texts": fingerprint})
    except generation.StaleBaseline:
        pass
    stored = generation.read(spark, f"{root}/texts", "texts")
    terms = stored.select(F.col("id").alias("key"), token_terms("content").alias("words")).withColumn("length", F.size("words"))
    salt = F.pmod("key", F.lit(SALTS)).cast("int")
    each = terms.select("key", "length", F.explode("words").alias("term")).withColumn("bucket", _bucket("term")).withColumn("salt", salt).repartition("bucket", "salt")
    words = each.groupBy("bucket", "salt", "term", "key").agg(F.count("*").alias("tf"), F.first("length").alias("length")).sortWithinPartitions("bucket", "term").drop("salt")
    grams = _gram_rows(stored).withColumn("bucket", _bucket("gram")).groupBy("bucket", "gram", "block").agg(F.sort_array(F.flatten(F.collect_list("keys"))).alias("keys")).sortWithinPartitions("bucket", "gram")
    sizes = terms.agg(F.count("*").alias("n"), F.avg("length").alias("mean"))
    more = {}
    if files is not None:
        from leanspan.operators.derive import resolve_imports

        more["edges"] = resolve_imports(files).filter("resolved_path is not null").select("path", "raw_target", "line", "resolved_path")
    try:
        generation.publish(spark, f"{root}/terms", {"words": words, "grams": grams, "sizes": sizes} | more, 0, {"terms": fingerprint}, {"words": ["bucket"], "grams": ["bucket"]})
    except generation.StaleBaseline:
        pass


def source_fingerprint(spark: SparkSession, path: str) -> str:
    """A fingerprint of the files of a table: names, lengths and times."""
    fs, hadoop = generation._fs(spark, path)
    found = []
    walk = fs.listFiles(hadoop(path), True)
    while walk.hasNext():
        f = walk.next()
        found.append(f"{f.getPath()}:{f.getLen()}:{f.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(found)).encode()).hexdigest()[:32]


#: indexes that this application has opened; a folder's content never changes
_OPEN: dict[tuple[str, str], Index] = {}


def index_of(spark: SparkSession, directory: str, root: str | None = None) -> Index:
    """The index of a directory's chunks, built when there is none for the files as they are."""
    source, files = f"{directory}/chunks.parquet", f"{directory}/files.parquet"
    fs, hadoop = generation._fs(spark, files)
    has_files = fs.exists(hadoop(files))
    fingerprint = source_fingerprint(spark, source) + (source_fingerprint(spark, files)[:16] if has_files else "")
    root = f"{root or index_folder(spark)}/{FORMAT}-{fingerprint}"
    known = _OPEN.get((spark.sparkContext.applicationId, root))
    if known:
        return known
    terms = generation.manifest(spark, f"{root}/terms")
    if not terms["generation"]:
        build(spark, spark.read.parquet(source), root, fingerprint, spark.read.parquet(files) if has_files else None)
        terms = generation.manifest(spark, f"{root}/terms")
    texts = generation.manifest(spark, f"{root}/texts")
    size = fs.getContentSummary(hadoop(f"{root}/texts/{texts['tables']['texts']}")).getLength()
    tables = [generation.open_table(spark, f"{root}/terms", terms, n) for n in ("words", "grams", "sizes", *(["edges"] if "edges" in terms["tables"] else []))]
    made = Index(generation.open_table(spark, f"{root}/texts", texts, "texts"), *tables, *([None] if len(tables) == 3 else []), int(size))
    _OPEN[spark.sparkContext.applicationId, root] = made
    return made
