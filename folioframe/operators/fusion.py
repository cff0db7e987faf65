"""Rank fusion and candidate assembly. A leg is rows (query_id, leg, doc_id, score, rank)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import settings as S
from ..functions.common import strip
from ..functions.text import parent_chunk_id
from ..session import broadcast_if_small, materialize
from .lexical import rank_top
from .skew import rank_by_range


def legs(**named: DataFrame) -> DataFrame:
    """Union of rankings with a ``leg`` column."""
    cols = ["query_id", "doc_id", "score", "rank"]
    return reduce(DataFrame.unionByName,
                  [df.select(*cols, F.lit(name).alias("leg")) for name, df in named.items()])


def distinct_queries(rewrites: DataFrame, limit: int | None = None) -> DataFrame:
    """(group_id, pos, query) -> trimmed, non-empty, first occurrence of each text, renumbered."""
    first = rewrites.select("group_id", "pos", strip("query").alias("query")).filter(
        F.col("query") != "").groupBy("group_id", "query").agg(F.min("pos").alias("pos"))
    if limit is None:
        return rank_by_range(first.withColumnRenamed("pos", "_pos"), ["group_id"], [F.col("_pos"), F.col("query")], "pos", "queries").drop("_pos")
    w = Window.partitionBy("group_id").orderBy("pos", "query")
    return first.withColumn("pos", F.row_number().over(w)).filter(F.col("pos") <= limit)


def collapse_to_parents(ranked: DataFrame, keys=("query_id", "leg")) -> DataFrame:
    """Children become their parent, the best-ranked one stays; ``collapsed`` counts the rest."""
    best = ranked.withColumn("doc_id", parent_chunk_id("doc_id")).groupBy(*keys, "doc_id").agg(
        F.min(F.struct("rank", "score")).alias("b"), (F.count("*") - 1).alias("collapsed"))
    w = Window.partitionBy(*keys).orderBy("b.rank")
    return best.select(*keys, "doc_id", F.col("b.score").alias("score"),
                       F.row_number().over(w).alias("rank"), "collapsed")


def rrf_fuse(ranked: DataFrame, k: float = S.RRF_K, top: int = S.RRF_TOP_K,
             weights: DataFrame | None = None, keys=("query_id",)) -> DataFrame:
    """Sum of weight/(k+rank) over the legs, top ``top`` per query."""
    if weights is not None:
        ranked = ranked.join(weights, "leg")
        part = F.col("weight") / (F.lit(k) + F.col("rank"))
    else:
        part = F.lit(1.0) / (F.lit(k) + F.col("rank"))
    fused = ranked.groupBy(*keys, "doc_id").agg(F.round(F.sum(part), 12).alias("score"))
    return rank_top(fused, top, keys=keys)


def rrf_fuse_min_score(ranked: DataFrame, minimums: dict, k: float = S.RRF_K,
                       top: int = S.RRF_TOP_K) -> DataFrame:
    """Drop rows below their leg's minimum first; ranks renumber."""
    floor = reduce(lambda c, kv: c.when(F.col("leg") == kv[0], F.lit(float(kv[1]))), minimums.items(), F)
    kept = ranked.filter(F.col("score") >= F.coalesce(floor.otherwise(F.lit(None)), F.lit(float("-inf"))))
    w = Window.partitionBy("query_id", "leg").orderBy("rank")
    return rrf_fuse(kept.withColumn("rank", F.row_number().over(w)), k, top)


def fusion_details(ranked: DataFrame, leg_names=("bm25", "embedding"), k: float = S.RRF_K) -> DataFrame:
    """Per (query, doc): each leg's rank, score and contribution, and the total."""
    aggs = []
    for leg in leg_names:
        hit = F.col("leg") == leg
        aggs += [F.min(F.when(hit, F.col("rank"))).alias(f"{leg}_rank"),
                 F.max(F.when(hit, F.col("score"))).alias(f"{leg}_score")]
    wide = ranked.groupBy("query_id", "doc_id").agg(*aggs)
    parts = {f"{leg}_contribution": F.coalesce(1.0 / (F.lit(k) + F.col(f"{leg}_rank")), F.lit(0.0))
             for leg in leg_names}
    return wide.withColumns(parts).withColumn(
        "rrf_score", reduce(lambda a, b: a + b, [F.col(c) for c in parts]))


def single_leg_fallback(ranked: DataFrame, k: float = S.RRF_K, top: int = S.RRF_TOP_K) -> DataFrame:
    """Fuse, but where only one leg answered pass its rows through with their raw scores.

    The ranking is dealt by query and read once: legs that are read twice in a plan share exchanges, and Spark 4.1 then takes
    their union for partitioned by query where it is not.
    """
    of_query = Window.partitionBy("query_id")
    marked = ranked.filter(F.col("query_id").isNotNull()).repartition("query_id").withColumn(
        "_alone", F.min("leg").over(of_query) == F.max("leg").over(of_query)).filter(F.col("_alone").isNotNull())
    # a row of a lone leg is a group of its own
    rows = marked.groupBy("query_id", "doc_id", "_alone", F.when(F.col("_alone"), F.col("rank")).alias("_own")).agg(
        F.max("score").alias("_raw"), F.round(F.sum(F.lit(1.0) / (F.lit(k) + F.col("rank"))), 12).alias("_fused"))
    scored = rows.withColumn("score", F.when(F.col("_alone"), F.col("_raw")).otherwise(F.col("_fused")))
    place = F.row_number().over(of_query.orderBy(F.col("score").desc(), F.col("doc_id").asc()))
    return scored.withColumn("rank", F.when(F.col("_alone"), F.col("_own")).otherwise(place)).filter(F.col("rank") <= top).select(
        "query_id", "doc_id", "score", "rank")


def candidates(fused: DataFrame, chunks: DataFrame, key: str = "chunk_id",
               keep: tuple = ()) -> DataFrame:
    """Late text fetch: join the few fused ids to the chunk table; ids without text are dropped."""
    have = chunks.columns
    title = F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in ("page_title", "section_path") if c in have],
                       F.col("doc_id").cast("string"))
    # known before the chunks are read, so that no text is shuffled
    fused = broadcast_if_small(materialize(fused, "fused"))
    rows = fused.join(chunks.withColumnRenamed(key, "doc_id"), "doc_id")
    return rows.filter(F.col("text").isNotNull() & (F.col("text") != "")).select(
        "query_id", "doc_id", F.col("rank").alias("fused_rank"), F.col("score").alias("rrf_score"),
        F.col("text").alias("content"), title.alias("title"), *keep)


def compare_overlap(ranked: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, method_a, method_b, overlap) of the top ``k`` of every pair of methods."""
    top = ranked.filter(F.col("rank") <= k).groupBy("query_id", "doc_id").agg(
        F.collect_set("method").alias("m"))       # at most one entry per method
    pairs = top.select("query_id", F.explode("m").alias("method_a"), "m").select(
        "query_id", "method_a", F.explode("m").alias("method_b")).filter("method_a < method_b")
    return pairs.groupBy("query_id", "method_a", "method_b").agg(F.count("*").alias("overlap"))


def merge_legacy(results: DataFrame, top: int = 10) -> DataFrame:
    """Concatenated rewrite results (question_id, pos, content, rerank_score): first row per content,
    then the best ``top`` by rerank score, missing scores as 0."""
    first = results.groupBy("question_id", F.sha2("content", 256).alias("_h")).agg(
        F.min_by(F.struct("pos", "content", "rerank_score"), "pos").alias("r"))
    score = F.coalesce("r.rerank_score", F.lit(0.0))
    w = Window.partitionBy("question_id").orderBy(score.desc(), F.col("r.pos"))
    return first.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top).select(
        "question_id", "r.pos", "r.content", score.alias("rerank_score"), "rank")
