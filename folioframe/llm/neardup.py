"""Near-duplicate documents by an exact set-similarity join on word shingles.

A text's set holds the hashes of its shingles of ``words`` words (split at ASCII white space, A-Z in lower case); a text of
fewer words is one shingle, a blank one has an empty set. Two texts match if the Jaccard similarity of their sets is at
least ``NUMERATOR / DENOMINATOR``. Texts with equal sets are one class, and classes that matches connect are one group.

Candidates come from SimHash first (``simhash.links`` over the fingerprints of the same shingles); what it links is verified on the
whole sets, read from the texts again. Its bits miss most matches that are not nearly equal, so a join on prefixes adds the rest: as in
the line join, matching sets share a token of their prefixes in a global order, rarest first by hashed counters. Two passes over the
lists of prefix tokens keep dense groups linear: the first compares every member of a list with the smallest class of it, the second
only members that are still in different groups; what is joined already is not compared again. Their candidates, which pass the length
and the positional filter, are verified too. Prefix tokens are shuffled once: most stand in one class and go no further.

Defined results: blank and null texts are one class; rows that repeat an id and a text are one document, rows with the same
id and different texts are different documents; rows without id come last; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_if_small, materialize
from .common import components, pieces, text_sizes
from .linedup import DENOMINATOR, NUMERATOR, REMEMBERED, prefix_length, token_counts
from .simhash import fingerprinter, links

SHINGLE_WORDS = 5


def shingle_set(text: str | None, words: int = SHINGLE_WORDS) -> np.ndarray:
    """Distinct hashes of the shingles, ascending."""
    found = text.encode().lower().split() if text else []
    joined, digest = b" ".join(found), xxhash.xxh64_intdigest
    if len(found) <= words:
        return np.array([digest(joined)] if found else [], dtype=np.uint64)
    sizes = np.array([len(w) for w in found]) + 1
    ends = np.cumsum(sizes)
    spans = zip((ends - sizes).tolist(), (ends - 1).tolist()[words - 1:])
    return np.unique(np.array([digest(joined[a:b]) for a, b in spans], dtype=np.uint64))


def sets_of(df: DataFrame, counts: np.ndarray, id_col: str, text_col: str, words: int) -> DataFrame:
    """One row per row of ``df``: (id, body, class, n, fp, prefix); ``fp`` and ``prefix`` are null where the task has given this class before."""
    text = F.col(f"`{text_col}`")
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("body"), text.alias("text"))
    shared = df.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, seen, simhash = shared.value, set(), fingerprinter(words)
        for batch in batches:
            for lo, hi in pieces(text_sizes(batch.column(2))):
                part = batch.slice(lo, hi - lo)
                classes, sizes, prefixes, fresh, at = [], [], [], [], []
                for text in part.column(2).to_pylist():
                    found = shingle_set(text, words)
                    c = xxhash.xxh64_intdigest(found.tobytes())
                    prefix = None
                    if c not in seen:
                        seen.add(c)
                        fresh.append(text)
                        at.append(len(classes))
                        order = np.lexsort((found, count[(found & np.uint64(len(count) - 1)).astype(np.int64)]))
                        prefix = found[order[:prefix_length(len(found))]].view(np.int64) if len(found) else []
                    classes.append(c)
                    sizes.append(len(found))
                    prefixes.append(prefix)
                if len(seen) > REMEMBERED:
                    seen = set()
                fps = np.zeros(len(classes), dtype=np.int64)
                fps[at] = simhash(fresh)[0]
                known = np.ones(len(classes), dtype=bool)
                known[at] = False
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(np.array(classes, dtype=np.uint64).view(np.int64)), pa.array(sizes, pa.int32()),
                     pa.array(fps, mask=known), pa.array(prefixes, pa.list_(pa.int64()))], names=["id", "body", "class", "n", "fp", "prefix"])

    return rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, body long, class long, n int, fp long, prefix array<long>")


def _reach(a: str, b: str):
    """What every match passes at its first shared token: lengths, and what is left of both sets from there on."""
    t, d = NUMERATOR, DENOMINATOR
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    last = F.least(n - F.col(f"{a}.pos"), m - F.col(f"{b}.pos"))
    return (d * F.least(n, m) >= t * F.greatest(n, m)) & ((t + d) * last >= t * (n + m))


def verified(df: DataFrame, classes: DataFrame, pairs: DataFrame, id_col: str, text_col: str, words: int, label: str) -> DataFrame:
    """(u, v) of all ``pairs`` whose whole sets match."""
    t, d = NUMERATOR, DENOMINATOR
    pairs = materialize(pairs, f"{label}-pairs")
    asked = pairs.select(F.explode(F.array("u", "v")).alias("class")).distinct()
    asked = materialize(asked.join(classes.select("class", F.col("id").alias("__id"), F.col("body").alias("__b")), "class"), f"{label}-needed")
    text = F.col(f"`{text_col}`")
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("body"), text.alias("text"))
    rows = rows.join(broadcast_if_small(asked), F.col("id").eqNullSafe(F.col("__id")) & (F.col("body") == F.col("__b"))).select("class", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in pieces(text_sizes(batch.column(1))):
                part = batch.slice(lo, hi - lo)
                sets = [shingle_set(text, words).view(np.int64) for text in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["class", "tokens"])

    sets = materialize(rows.mapInArrow(run, "class long, tokens array<long>").dropDuplicates(["class"]), f"{label}-sets")
    both = pairs.join(sets.withColumnsRenamed({"class": "u", "tokens": "x"}), "u").join(sets.withColumnsRenamed({"class": "v", "tokens": "y"}), "v")
    return materialize(both.where((t + d) * F.size(F.array_intersect("x", "y")) >= t * (F.size("x") + F.size("y"))).select("u", "v"), f"{label}-links")


def fingerprint_links(classes: DataFrame, label: str) -> DataFrame:
    """(u, v) of classes that SimHash links: those of one fingerprint to its smallest, and the smallest ones of linked fingerprints."""
    fps = materialize(classes.groupBy("fp").agg(F.min("class").alias("v"), F.count("*").alias("many")), f"{label}-fps")
    shared = fps.where("many > 1").select("fp", "v")
    same = classes.select("fp", F.col("class").alias("u")).join(broadcast_if_small(shared), "fp").where("u <> v").select("u", "v")
    found = broadcast_if_small(materialize(links(fps.select("fp"), label).toDF("x", "y"), f"{label}-found"))
    ends = fps.select("fp", F.col("v").alias("class"))
    linked = found.join(ends.toDF("x", "u"), "x").join(ends.toDF("y", "v"), "y").select("u", "v")
    return same.union(linked).distinct()


def groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS, label: str = "neardup") -> DataFrame:
    """One row per row of ``df``: (id, body, root), the root being the same for all documents of a group."""
    def count(texts: pa.Array, total: np.ndarray) -> None:
        for text in texts.to_pylist():
            np.add.at(total, (shingle_set(text, words) & np.uint64(len(total) - 1)).astype(np.int64), 1)

    table = materialize(sets_of(df, token_counts(df, text_col, count=count), id_col, text_col, words), f"{label}-docs")
    classes = table.groupBy("class").agg(F.min(F.struct("id", "body")).alias("first"), F.max("n").alias("n"), F.max("fp").alias("fp"), F.max("prefix").alias("prefix"))
    classes = materialize(classes.select("class", "first.*", "n", "fp", "prefix"), f"{label}-classes")

    def joined_by(edges: DataFrame, name: str) -> DataFrame:
        return materialize(components(edges, label), f"{label}-{name}").withColumnRenamed("node", "class")

    def rooted(rows: DataFrame, roots: DataFrame) -> DataFrame:
        return rows.join(broadcast_if_small(roots), "class", "left").withColumn("root", F.coalesce("root", "class"))

    near = verified(df, classes, fingerprint_links(classes, f"{label}-simhash"), id_col, text_col, words, f"{label}-near")
    # one exchange by token: the lists of two classes or more, and their smallest class
    posts = classes.select("class", "n", F.posexplode("prefix").alias("pos", "token")).repartition("token")
    pivots = posts.groupBy("token").agg(F.min(F.struct("class", "n", "pos")).alias("a"), F.count("*").alias("many")).where("many > 1").drop("many")
    posts = materialize(posts.join(pivots, "token"), f"{label}-lists")
    roots = joined_by(near, "near-joined")
    star = rooted(posts.where(F.col("a.class") < F.col("class")), roots).select("token", "a", "root", F.struct("class", "n", "pos").alias("b")).where(_reach("a", "b"))
    star = star.select(F.col("b.class").alias("u"), F.col("a.class").alias("v"), "root").distinct()
    pivot_roots = roots.select(F.col("class").alias("v"), F.col("root").alias("pivot_root"))
    star = star.join(broadcast_if_small(pivot_roots), "v", "left").where(F.col("root") != F.coalesce("pivot_root", "v")).select("u", "v")
    star = near.union(verified(df, classes, star, id_col, text_col, words, f"{label}-star"))
    lists = rooted(posts.drop("a"), joined_by(star, "joined")).select("class", "n", "root", "pos", "token")
    apart = lists.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("token")
    lists = materialize(lists.join(apart, "token", "left_semi"), f"{label}-apart")
    a, b = lists.alias("a"), lists.alias("b")
    rest = a.join(b, (F.col("a.token") == F.col("b.token")) & (F.col("a.class") < F.col("b.class")) & (F.col("a.root") != F.col("b.root")) & _reach("a", "b"))
    rest = verified(df, classes, rest.select(F.col("b.class").alias("u"), F.col("a.class").alias("v")).distinct(), id_col, text_col, words, f"{label}-rest")
    roots = components(star.union(rest), label).withColumnRenamed("node", "class")
    return table.join(broadcast_if_small(materialize(roots, f"{label}-roots")), "class", "left").select("id", "body", F.coalesce("root", "class").alias("root"))


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS, label: str = "neardup") -> DataFrame:
    """``df`` with one row of each group: that of the smallest id, rows without id come last."""
    place = F.struct(F.col("id").isNull().alias("none"), "id", "body")
    docs = groups(df, id_col, text_col, words, label).groupBy("root", "id", "body").agg(F.count("*").alias("many"))
    docs = materialize(docs, f"{label}-groups")
    firsts = docs.groupBy("root").agg(F.min(place).alias("first"))
    # the texts are joined with documents that go or repeat only, few where most stay
    gone = docs.join(firsts, "root").withColumn("stays", place == F.col("first")).where("not stays or many > 1")
    gone = materialize(gone.select(F.col("id").alias("gone_id"), F.col("body").alias("gone_body"), "stays"), f"{label}-gone")
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(f"`{id_col}`").alias("id"), F.xxhash64(F.col(f"`{text_col}`")).alias("body"))
    same = F.col("id").eqNullSafe(F.col("gone_id")) & (F.col("body") == F.col("gone_body"))
    plain = rows.join(broadcast_if_small(gone), same, "left_anti")
    once = rows.join(broadcast_if_small(gone.where("stays")), same, "left_semi").dropDuplicates(["id", "body"])
    return plain.union(once).select(*[F.col("row").getField(c).alias(c) for c in df.columns])
