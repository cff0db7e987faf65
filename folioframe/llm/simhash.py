"""SimHash near-duplicates: positional-byte index, count filter, verification, components.

Fingerprints of 64 bits that differ in at most ``d`` bits differ in at most ``d`` of their 8 bytes, so they share at
least ``8 - d`` positional bytes. The index lists each distinct fingerprint under its positional bytes. A list under a
single byte holds 1/256 of all fingerprints, and walking such lists would compare all pairs; lists are therefore
intersected ``width`` at a time: a family of position sets is chosen so that every set of ``8 - d`` positions contains
a member of it, so no pair is missed. For each pair that meets in a list the shared positional bytes are tallied, pairs
that reach the guaranteed minimum are kept and verified bit by bit.

Defined results: a null, empty or blank text has fingerprint zero, linked like any other; equal texts have equal
fingerprints; repeated rows give repeated result rows; a null id never becomes a component id unless all ids of the
component are null; an empty table gives an empty result. Other columns of the input are not read.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..session import broadcast_if_small, materialize
from .common import components, map_texts

SHINGLE_WORDS = 4
SEED = 42
MAX_BITS = 4
BYTES = 8
# distinct fingerprints beyond which lists are intersected four at a time instead of three
WIDE_FROM = 50_000_000


def fingerprinter(words_per_shingle: int):
    """A function from texts to one list: their fingerprints as signed longs."""
    digest = xxhash.xxh64_intdigest

    def run(texts: list) -> list:
        hashes: list[int] = []
        counts = []
        for text in texts:
            words = text.encode().lower().split() if text else []      # both act on ASCII only
            if len(words) <= words_per_shingle:
                if words:
                    hashes.append(digest(b" ".join(words), SEED))
                counts.append(min(1, len(words)))
                continue
            joined = b" ".join(words)
            ends = np.cumsum([len(w) + 1 for w in words])
            starts = (ends - [len(w) + 1 for w in words]).tolist()
            stops = (ends - 1).tolist()[words_per_shingle - 1:]
            hashes.extend([digest(joined[a:b], SEED) for a, b in zip(starts, stops)])
            counts.append(len(stops))
        sizes = np.array(counts)
        out = np.zeros(len(texts), dtype=np.uint64)
        if hashes:
            bits = np.unpackbits(np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            full = np.nonzero(sizes)[0]
            offsets = (np.cumsum(sizes) - sizes)[full]
            ones = np.add.reduceat(bits, offsets, axis=0, dtype=np.int64)
            packed = np.packbits(2 * ones > sizes[full][:, None], axis=1, bitorder="little")
            out[full] = packed.reshape(-1, 8).copy().view("<u8").ravel()
        return [out.view(np.int64)]

    return run


def fingerprints(df: DataFrame, keep: list[str], text_col: str = "text", words: int = SHINGLE_WORDS) -> DataFrame:
    """``keep`` columns and ``fp``, the 64-bit SimHash of the whole text as a signed long."""
    return map_texts(df, text_col, keep, StructType([StructField("fp", LongType())]), lambda: fingerprinter(words))


def position_sets(width: int, shared: int) -> list[tuple[int, ...]]:
    """Sets of ``width`` byte positions such that each set of ``shared`` positions contains one of them.

    Three out of four by Turan's construction in three groups, in every other case all sets of that width.
    """
    if (width, shared) != (3, 4):
        return list(combinations(range(BYTES), min(width, shared)))
    group = [p % 3 for p in range(BYTES)]
    chosen = []
    for s in combinations(range(BYTES), 3):
        g = sorted(group[p] for p in s)
        if g[0] == g[2] or g in ([0, 0, 1], [1, 1, 2], [0, 2, 2]):
            chosen.append(s)
    return chosen


def _byte(col, p: int):
    return F.shiftrightunsigned(col, 8 * p).bitwiseAND(F.lit(255))


def _index(fps: DataFrame, sets: list[tuple[int, ...]]) -> DataFrame:
    keys = []
    for k, positions in enumerate(sets):
        key = F.lit(k).cast("long")
        for p in positions:
            key = key * 256 + _byte(F.col("fp"), p)
        keys.append(key)
    return fps.select("*", F.explode(F.array(*keys)).alias("key"))


def _shared_mask(a, b):
    """Bit p is set where the positional byte p is the same."""
    x = a.bitwiseXOR(b)
    mask = F.lit(0)
    for p in range(BYTES):
        mask = mask + F.when(_byte(x, p) == 0, 1 << p).otherwise(0)
    return mask


def links(fps: DataFrame, label: str = "simhash", max_bits: int = MAX_BITS, wide_from: int = WIDE_FROM) -> DataFrame:
    """Links (u, v) that connect all distinct fingerprints at ``max_bits`` or fewer differing bits.

    Two passes over the index keep dense groups linear. The first links every member of a list to the smallest one if
    the two verify, and joins what this connects. The second compares the members of a list that are still apart. A
    pair is looked at in the first list that it shares only.
    """
    shared = BYTES - max_bits
    width = 3 if fps.count() <= wide_from else 4
    sets = position_sets(width, shared)
    index = _index(fps.select("fp"), sets)
    pivots = index.groupBy("key").agg(F.min("fp").alias("pivot"), F.count("*").alias("n")).where("n > 1").drop("n")
    u, v = F.col("u"), F.col("v")

    def verified(pairs: DataFrame) -> DataFrame:
        tally = F.bit_count(_shared_mask(u, v))
        return pairs.where((tally >= shared) & (F.bit_count(u.bitwiseXOR(v)) <= max_bits))

    star = verified(index.join(pivots, "key").where("fp <> pivot").select(F.col("fp").alias("u"), F.col("pivot").alias("v")))
    star = materialize(star.distinct(), f"{label}-star")
    joined = materialize(components(star, label), f"{label}-joined")
    nodes = fps.select("fp").join(joined, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root"))
    # lists in which all members are joined already need no second look
    lists = _index(nodes, sets)
    apart = lists.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("key")
    lists = lists.join(apart, "key", "left_semi")
    first = {m: next((k for k, s in enumerate(sets) if all(m >> p & 1 for p in s)), -1) for m in range(256)}
    first_shared = F.element_at(F.array(*[F.lit(first[m]) for m in range(256)]), _shared_mask(F.col("a.fp"), F.col("b.fp")) + 1)
    base = 256 ** width
    rest = lists.alias("a").join(lists.alias("b"), (F.col("a.key") == F.col("b.key")) & (F.col("a.fp") < F.col("b.fp"))
                                 & (F.col("a.root") != F.col("b.root"))
                                 & (F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= max_bits)
                                 & (F.bit_count(_shared_mask(F.col("a.fp"), F.col("b.fp"))) >= shared)
                                 & (first_shared == F.floor(F.col("a.key") / base)))
    return star.union(rest.select(F.col("b.fp").alias("u"), F.col("a.fp").alias("v")))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS,
                    words: int = SHINGLE_WORDS, label: str = "simhash") -> DataFrame:
    """One row per row of ``df``: ``id_col``, ``fp`` and ``component_id``, the smallest id reachable by links."""
    docs = materialize(fingerprints(df, [id_col], text_col, words).withColumnRenamed(id_col, "__id"), f"{label}-fp")
    fps = docs.groupBy("fp").agg(F.min("__id").alias("rep"))
    roots = components(links(fps, label, max_bits), label)
    table = fps.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    lowest = table.groupBy("root").agg(F.min("rep").alias("component_id"))
    table = materialize(table.join(lowest, "root").select("fp", "component_id"), f"{label}-classes")
    return docs.join(table, "fp").select(F.col("__id").alias(id_col), "fp", "component_id")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS,
             words: int = SHINGLE_WORDS, label: str = "simhash") -> DataFrame:
    """``df`` with one row of each group of near duplicates: that of the smallest id (rows without id come last).

    Rows that repeat an id and a text are one document; of such rows one stays.
    """
    text_key = F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))
    # an id for rows that have none, above all given ones
    ids = F.coalesce(F.col(f"`{id_col}`").cast("long"), text_key.bitwiseAND(F.lit((1 << 61) - 1)) + F.lit(1 << 62))
    # the row is one struct beside names of our own, so any name may be its
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), ids.alias("__key"), F.col(f"`{text_col}`").alias("text"))
    classes = near_duplicates(rows, "__key", "text", max_bits, words, label)
    by_key = materialize(classes.groupBy("__key").agg(F.count("*").alias("__n"), F.min("component_id").alias("__c")), f"{label}-keys")
    go = by_key.where("__key <> __c or __n > 1").select("__key")
    again = by_key.where("__key = __c and __n > 1").select("__key")
    # only ids that go are joined: few where most documents stay, and then no text is shuffled
    plain = rows.join(broadcast_if_small(go), "__key", "left_anti")
    once = rows.join(broadcast_if_small(again), "__key", "left_semi").dropDuplicates(["__key"])
    return plain.union(once).select(*[F.col("row").getField(c).alias(c) for c in df.columns])
