"""Joins the engine needs beyond equality: intervals, narrowest intervals, neighbours, near signatures."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leanspan.streaming.changes import shared_folder

BAND_LINES = 128


def _bands(start: str, end: str, width: int) -> Column:
    return F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.greatest(F.col(start), F.col(end)) / width)))


def overlap_join(left: DataFrame, right: DataFrame, key: str, band: int = BAND_LINES) -> DataFrame:
    """Pairs whose closed intervals [a, b] and [c, d] overlap within a key; left has a, b, right c, d.

    Both sides are exploded into bands, so that each task meets intervals that are near
    each other only; a pair that shares several bands is emitted in the first.
    """
    x = left.withColumn("band", _bands("a", "b", band))
    y = right.withColumn("band", _bands("c", "d", band))
    hit = x.join(y, [key, "band"]).filter((F.col("a") <= F.col("d")) & (F.col("c") <= F.col("b")))
    return hit.filter(F.col("band") == F.floor(F.greatest("a", "c") / band)).drop("band")


def narrowest_enclosing(points: DataFrame, intervals: DataFrame, key: str, band: int = BAND_LINES) -> DataFrame:
    """For each point (key, point_id, at) the interval (c, d, tie, ...) of least length that covers it, or nulls."""
    p = points.withColumn("band", F.floor(F.col("at") / band))
    rest = [c for c in intervals.columns if c != key]
    i = intervals.withColumn("band", _bands("c", "d", band))
    hit = p.join(i, [key, "band"]).filter((F.col("c") <= F.col("at")) & (F.col("at") <= F.col("d")))
    best = hit.groupBy(key, "point_id").agg(F.min_by(F.struct(*rest), F.struct(F.col("d") - F.col("c"), F.col("tie"))).alias("r"))
    return points.join(best, [key, "point_id"], "left").select(key, "point_id", "at", *[F.col(f"r.{c}").alias(c) for c in rest])


def unique_key_join(left: DataFrame, right: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Matches on keys that both sides hold exactly once (null-safe): value of the left as before, of the right as after."""
    def once(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*keys).agg(F.count("*").alias("n"), F.min(value).alias(name)).filter("n = 1").drop("n")

    a, b = once(left, "before"), once(right, "after")
    cond = [a[k].eqNullSafe(b[k]) for k in keys]
    return a.join(b, cond).select(*[a[k] for k in keys], "before", "after")


def simhash(tokens: Column) -> Column:
    """64-bit signature of an array of tokens, by sign of the votes of each bit of md5; null below three tokens of three bytes.

    Equal tokens vote as often as they occur.  The votes of a text are one matrix
    operation in Arrow batches; hashes of tokens are kept by each worker.
    """

    @F.pandas_udf("long")
    def signature(joined: pd.Series) -> pd.Series:
        known: dict[str, bytes] = {}
        out: list[int | None] = []
        for text in joined:
            rows = []
            for t in text.split("\x00") if text else ():
                h = known.get(t)
                if h is None:
                    data = t.encode("utf-8", "surrogatepass")
                    h = known[t] = hashlib.md5(data).digest()[:8] if len(data) >= 3 else b""
                rows.append(h)
            if len(known) > 500_000:
                known.clear()
            bits = np.frombuffer(b"".join(rows), dtype=np.uint8).reshape(-1, 8)
            if len(bits) < 3:
                out.append(None)
                continue
            votes = np.unpackbits(bits, axis=1).sum(axis=0, dtype=np.int64)
            out.append(int(np.packbits(2 * votes >= len(bits)).view(">i8")[0]))
        return pd.Series(out, dtype="Int64")

    return signature(F.array_join(tokens, "\x00"))


#: Two 64-bit words within 8 bits agree up to two bits in one of these blocks.
BLOCKS = ((0, 22), (22, 21), (43, 21))
RADIUS = 2


def near_signatures(df: DataFrame, signature: str, distance: int = 8, within: list[str] | None = None) -> DataFrame:
    """Pairs (left, right) of different signatures within a Hamming distance of at most 8, each once; of equal ``within`` columns only, which stand before them.

    Works on distinct signatures only, so copies cost nothing.  Of three blocks one
    differs in two bits at most, and two words within two bits have a word within one
    bit of both: each signature offers its blocks with none or one bit flipped (67 keys),
    equal keys meet, and what meets is verified.
    """
    if distance > RADIUS * len(BLOCKS) + 2:
        raise ValueError("distance is more than the blocks guarantee")
    of = within or []
    s = df.filter(F.col(signature).isNotNull()).select(*of, F.col(signature).alias("s")).distinct()

    def offer(number: int, at: int, width: int) -> Column:
        # the block's number above its value, with the flips as constants
        block = F.shiftrightunsigned("s", at).bitwiseAND(F.lit((1 << width) - 1)).bitwiseOR(F.lit(number << 32))
        return F.transform(F.array(*[F.lit(m).cast("long") for m in (0, *(1 << b for b in range(width)))]), lambda m: block.bitwiseXOR(m))

    keys = s.select(*of, "s", F.explode(F.concat(*[offer(n, at, width) for n, (at, width) in enumerate(BLOCKS)])).alias("k"))
    x, y = keys.select(*of, "k", F.col("s").alias("left")), keys.select(*of, "k", F.col("s").alias("right"))
    # both sides grow with the data and are the same exchange, so neither may be broadcast
    hit = x.join(y.hint("merge"), [*of, "k"]).filter((F.col("left") < F.col("right")) & (F.bit_count(F.col("left").bitwiseXOR(F.col("right"))) <= distance))
    return hit.select(*of, "left", "right").distinct()


#: Two 64-bit words within 8 bits are equal in one of these nine blocks.
WHOLE = ((0, 8), *((8 + 7 * n, 7) for n in range(8)))
TILE_MOST = 1 << 17  # signatures that a task compares with as many others
ROWS, COLUMNS = 64, 1024  # that are compared in one step; a column's count of a step has to fit a byte


def _axis(words: np.ndarray) -> np.uint64:
    """The bits that rise along the direction in which the words spread most; it sets only the order of comparing, so part of the words will do."""
    few = np.ascontiguousarray(words[:: len(words) // 4096 + 1])
    bits = np.unpackbits(few.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
    bits -= bits.mean(axis=0)
    return np.packbits(np.linalg.eigh(bits.T @ bits)[1][:, -1] > 0, bitorder="little").view(np.uint64)[0]


def near_in_tile(a: np.ndarray, b: np.ndarray | None, block: int, distance: int) -> tuple[np.ndarray, np.ndarray | None]:
    """For each word of a the number of words of b (of a itself, if b is None) within the distance that are equal to it in this block and in none before it, and the same for b.

    The words are ordered by their bits set along one direction less those set against it.
    One bit moves this by one, so only words whose places are within the distance are compared.
    """
    low, high = np.uint64(sum(1 << at for at, _ in WHOLE[:block])), np.uint64(sum(1 << at + width - 1 for at, width in WHOLE[:block]))
    plus = _axis(a)

    def arranged(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        place = np.bitwise_count(words & plus).astype(np.int64) - np.bitwise_count(words & ~plus)
        order = np.argsort(place, kind="stable")
        return order, words[order], place[order]

    order, words, place = arranged(a)
    order_b, others, place_b = (order, words, place) if b is None else arranged(b)
    count = np.zeros(len(words), np.int64)
    count_b = count if b is None else np.zeros(len(others), np.int64)
    starts, ends = np.searchsorted(place_b, place - distance), np.searchsorted(place_b, place + distance, "right")
    x_all, t_all = np.empty((ROWS, COLUMNS), np.uint64), np.empty((ROWS, COLUMNS), np.uint64)
    for i in range(0, len(words), ROWS):
        rows = words[i : i + ROWS, None]
        k = len(rows)
        last = ends[i + k - 1]
        for j in range(i if b is None else starts[i], last, COLUMNS):
            columns = others[j : min(j + COLUMNS, last)]
            x = np.bitwise_xor(rows, columns, out=x_all[:k, : len(columns)])
            near = np.bitwise_count(x) <= distance
            if block:  # (x - low) & ~x has the highest bit of a block before this one only if such a block is 0
                t = np.subtract(x, low, out=t_all[:k, : len(columns)])
                t &= np.invert(x, out=x)
                t &= high
                near &= t == 0
            if b is None and j == i:
                near[:, :k] &= ~np.tri(k, dtype=bool)
            count[i : i + k] += np.bitwise_count(np.packbits(near, axis=1)).sum(axis=1, dtype=np.int64)
            count_b[j : j + len(columns)] += np.add.reduce(near.view(np.uint8), axis=0, dtype=np.uint8)
    out, out_b = np.empty_like(count), None if b is None else np.empty_like(count_b)
    out[order] = count
    if b is not None:
        out_b[order_b] = count_b
    return out, out_b


def near_counts(df: DataFrame, signature: str, distance: int = 8, most: int = TILE_MOST) -> DataFrame:
    """s, near: the number of other signatures within a Hamming distance of at most 8, for the distinct signatures that have any.

    Pairs are counted where they meet and never written: where many signatures are near
    each other, there are far more pairs than signatures.  Of nine blocks one is equal, so
    each signature goes to nine groups, and a pair is counted in the first group in which
    both are.  Groups of over ``most`` are cut into parts that meet two by two.
    """
    if distance >= len(WHOLE):
        raise ValueError("distance is more than the blocks guarantee")
    s = df.filter(F.col(signature).isNotNull()).select(F.col(signature).alias("s")).distinct()
    # block and value in one number
    groups = F.array(*[F.shiftrightunsigned("s", at).bitwiseAND(F.lit((1 << width) - 1)).bitwiseOR(F.lit(n << 8)) for n, (at, width) in enumerate(WHOLE)])
    keys = s.select("s", F.explode(groups).alias("g"))
    # 256 rows a block at most, whatever the data
    parts = keys.groupBy("g").agg(F.count("*").alias("n")).filter("n > 1").select("g", F.ceil(F.col("n") / most).alias("parts"))
    cut = keys.join(F.broadcast(parts), "g").withColumn("part", F.pmod(F.xxhash64("s"), "parts")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    low, high = F.least("part", "other"), F.greatest("part", "other")
    tiles = cut.select("s", F.shiftleft("g", 48).bitwiseOR(F.shiftleft(low, 24)).bitwiseOR(high).alias("tile"), (F.col("part") == low).alias("first"))

    def count(key: tuple[int], rows: pd.DataFrame) -> pd.DataFrame:
        tile, words, first = int(key[0]), rows["s"].to_numpy().view(np.uint64), rows["first"].to_numpy(bool)
        near = np.zeros(len(rows), np.int64)
        if tile >> 24 & 0xFFFFFF == tile & 0xFFFFFF:
            near = near_in_tile(words, None, tile >> 56, distance)[0]
        elif first.any() and not first.all():
            near[first], near[~first] = near_in_tile(words[first], words[~first], tile >> 56, distance)
        return pd.DataFrame({"s": rows["s"], "near": near})[near > 0]

    # few bytes, much work: more tasks than their size asks for
    tasks = max(64, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return tiles.repartition(tasks, "tile").groupBy("tile").applyInPandas(count, "s long, near long").groupBy("s").agg(F.sum("near").alias("near"))


def near_duplicate_classes(df: DataFrame, key: str, signature: str, distance: int = 8) -> DataFrame:
    """One row for each item: its class (the signature), the class's size, and its number of near classes.

    Signatures are computed once and kept in a checkpoint.  Items are reduced to their
    classes, whose near classes are counted without making pairs.
    """
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    items = df.select(key, F.col(signature).alias("class")).checkpoint()
    sizes = items.filter("class is not null").groupBy("class").agg(F.count("*").alias("members"))
    links = near_counts(items, "class", distance).select(F.col("s").alias("class"), F.col("near").alias("near_classes"))
    return items.join(sizes.join(links, "class", "left"), "class", "left").select(key, "class", F.coalesce("members", F.lit(1)).alias("members"), F.coalesce("near_classes", F.lit(0)).alias("near_classes"))
