import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioframe.operators import dense as D
from folioframe.operators import fusion as U
from folioframe.operators import select as P
from folioframe.operators import skew as K
from folioframe.operators.lexical import bm25_search, bm25_search_eval, lexical_index
from folioframe.plans import search as X

DOCS = ["red fox jumps", "red red dog", "blue fish swims far away", "red", "", "fox fox fox dog"]


def corpus(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(DOCS)], "chunk_id long, text string")


def brute(query, docs):
    toks = [d.split() for d in docs]
    n, avg = len(docs), sum(map(len, toks)) / len(docs)
    vocab = {t for d in toks for t in d}
    df = {t: sum(t in d for d in toks) for t in vocab}
    raw = {t: math.log(n - df[t] + .5) - math.log(df[t] + .5) for t in vocab}
    mean = sum(raw.values()) / len(raw)
    idf = {t: .25 * mean if v < 0 else v for t, v in raw.items()}
    return [sum(idf.get(q, 0) * d.count(q) * 2.5 / (d.count(q) + 1.5 * (.25 + .75 * len(d) / avg)) for q in query.split()) for d in toks]


@pytest.mark.parametrize("limit", [1000, 0])
def test_bm25_matches_brute_force_on_both_join_paths(spark, limit):
    queries = spark.createDataFrame([(1, "red fox red"), (2, "dog unknown"), (3, "zzz")], "query_id long, query string")
    rows = bm25_search(lexical_index(corpus(spark)), queries, 3, broadcast_rows=limit).collect()
    for qid, text in ((1, "red fox red"), (2, "dog unknown")):
        want = sorted(((round(s, 6), i) for i, s in enumerate(brute(text, DOCS)) if s > 0), key=lambda p: (-p[0], p[1]))[:3]
        assert [(r.score, r.doc_id) for r in sorted(rows, key=lambda r: r["rank"]) if r.query_id == qid] == want
    assert not [r for r in rows if r.query_id == 3]


def test_eval_bm25_fills_up_with_zero_scores(spark):
    queries = spark.createDataFrame([(1, "swims"), (2, "zzz")], "query_id long, query string")
    rows = bm25_search_eval(lexical_index(corpus(spark), mode="eval"), queries, 4).collect()
    got = {q: [r.doc_id for r in sorted(rows, key=lambda r: r["rank"]) if r.query_id == q] for q in (1, 2)}
    assert got == {1: [2, 0, 1, 3], 2: [0, 1, 2, 3]}


def test_dense_paths_agree_with_numpy(spark):
    rng = np.random.default_rng(1)
    docs, qs = rng.normal(size=(200, 8)).astype("float32"), rng.normal(size=(7, 8)).astype("float32")
    docs[5] = docs[9]
    dv = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(docs)] + [(999, None)], "chunk_id long, embedding array<float>").repartition(5)
    qv = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(qs)], "query_id long, embedding array<float>")
    a = D.dense_search(dv, qv, 6).orderBy("query_id", "rank").collect()
    b = D.dense_search(dv, qv, 6, wave_bytes=3 * 8 * 8).orderBy("query_id", "rank").collect()     # waves of three queries
    assert [tuple(r) for r in a] == [tuple(r) for r in b]
    d64, q64 = docs.astype("float64"), qs.astype("float64")
    cos = np.round(q64 @ d64.T / (np.linalg.norm(q64, axis=1)[:, None] * np.linalg.norm(d64, axis=1)), 6)
    for q in range(7):
        want = sorted(range(200), key=lambda i: (-cos[q, i], i))[:6]
        assert [r.doc_id for r in a if r.query_id == q] == want


def test_cells_find_nearly_all_neighbours(spark, sf_dir):
    vectors = spark.read.parquet(sf_dir.replace("sf0.001", "sf0.1") + "/embeddings.parquet")
    queries = vectors.filter("vec_id % 25 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    exact = {(r.query_id, r.doc_id) for r in D.dense_search(vectors, queries, 20, id_col="vec_id").collect()}
    index = D.build_cells(vectors, id_col="vec_id")
    found = {(r.query_id, r.doc_id) for r in D.cell_search(index, queries, 20).collect()}
    recall = len(found & exact) / len(exact)
    print("recall", recall, "cells", len(index.centres), "probes", index.probes)
    assert recall >= 0.9
    # all cells probed: the exact result
    every = D.cell_search(index, queries, 20, probes=len(index.centres))
    assert {(r.query_id, r.doc_id) for r in every.collect()} == exact
    assert index.table.count() == vectors.count()


def test_worker_holds_a_bounded_best(spark):
    rng = np.random.default_rng(3)
    best, seen = D.Best(5, 3), []
    for _ in range(40):
        scores, ids = rng.integers(0, 6, (5, 8)) / 5, rng.integers(0, 10 ** 6, 8)
        best.offer(0, scores, ids)
        seen.append((scores, ids))
        assert len(best.rows[0]) <= 15
    for q in range(5):
        want = sorted((-s[q, i], ids[i]) for s, ids in seen for i in range(8))[:3]
        assert [(-v, i) for s, v, i in zip(*best.rows) if s == q] == want


def leg(spark, rows):
    return spark.createDataFrame(rows, "query_id long, leg string, doc_id string, score double, rank int")


def test_collapse_then_fuse(spark):
    ranked = leg(spark, [(1, "bm25", "p:chunk:0:child:1", 9., 1), (1, "bm25", "p:chunk:0:child:0", 8., 2), (1, "bm25", "q:chunk:1", 7., 3),
                         (1, "embedding", "q:chunk:1:child:0", .9, 1), (1, "embedding", "r:chunk:0", .5, 2)])
    c = U.collapse_to_parents(ranked)
    assert {(r.leg, r.doc_id, r["rank"], r.collapsed) for r in c.collect()} == {
        ("bm25", "p:chunk:0", 1, 1), ("bm25", "q:chunk:1", 2, 0), ("embedding", "q:chunk:1", 1, 0), ("embedding", "r:chunk:0", 2, 0)}
    fused = {r.doc_id: r.score for r in U.rrf_fuse(c).collect()}
    assert fused["q:chunk:1"] == pytest.approx(1 / 62 + 1 / 61) and fused["p:chunk:0"] == pytest.approx(1 / 61)
    # order of the input rows does not matter
    assert U.rrf_fuse(c.orderBy(F.rand(3))).orderBy("rank").collect() == U.rrf_fuse(c).orderBy("rank").collect()


def test_single_leg_passes_raw_scores(spark):
    rows = U.single_leg_fallback(leg(spark, [(1, "bm25", "a", 5., 1), (2, "bm25", "a", 5., 1), (2, "embedding", "b", .3, 1)])).collect()
    assert {(r.query_id, r.doc_id, round(r.score, 6)) for r in rows} == {(1, "a", 5.0), (2, "a", round(1 / 61, 6)), (2, "b", round(1 / 61, 6))}


def test_single_leg_of_searches_that_share_exchanges(spark):
    from folioframe.operators.lexical import rank_top

    def search(where, salt):
        rows = spark.range(0, 2000, 1, 4).filter(where).selectExpr("id % 40 AS query_id", "id AS doc_id", f"(id * {salt}) % 1009 / 1.0D AS score")
        return rank_top(rows.mapInArrow(lambda batches: batches, "query_id long, doc_id long, score double"), 20)
    # both legs answer 15 of the 40 questions
    ranked = U.legs(bm25=search("id % 40 < 15", 31), embedding=search("true", 57))
    plain = spark.createDataFrame(ranked.collect(), ranked.schema)
    legs_of = {r.query_id: r.n for r in plain.groupBy("query_id").agg(F.count_distinct("leg").alias("n")).collect()}
    want = {tuple(r) for r in U.rrf_fuse(plain).select("query_id", "doc_id", "score", "rank").collect() if legs_of[r.query_id] == 2} | {
        (r.query_id, r.doc_id, r.score, r["rank"]) for r in plain.collect() if legs_of[r.query_id] == 1}
    got = [tuple(r) for r in U.single_leg_fallback(ranked).collect()]
    assert set(got) == want and len(got) == len(want) == 15 * 30 + 25 * 20
    assert {r["count"] for r in U.single_leg_fallback(ranked).groupBy("query_id").count().collect()} == {20, 30}


def test_hybrid_search_of_legs_that_share_exchanges(spark):
    from folioframe.operators.lexical import rank_top

    def search(where, salt):
        rows = spark.range(0, 400, 1, 4).filter(where).selectExpr("id % 8 AS query_id", "id AS doc_id", f"(id * {salt}) % 1009 / 1.0D AS score")
        return rank_top(rows.mapInArrow(lambda batches: batches, "query_id long, doc_id long, score double"), 5)
    ranked = U.legs(bm25=search("id % 8 < 3", 31), embedding=search("true", 57))
    queries = spark.range(8).selectExpr("id AS query_id", "concat('w', id % 3) AS query")
    chunks = spark.range(400).selectExpr("id AS chunk_id", "concat_ws(' ', 'w' || id % 3, 'w' || id % 5) AS text")

    def found(legs):
        rows = X.search_hybrid(legs, queries, chunks, lambda q, c: F.round(P.overlap_scorer(q, c), 9)).select("query_id", "id", "rerank_score", "rank")
        return sorted(tuple(r) for r in rows.collect())
    want = found(spark.createDataFrame(ranked.collect(), ranked.schema))
    assert found(ranked) == want and len({r[0] for r in want}) == 8


def test_score_filter(spark):
    df = spark.createDataFrame([(1, "a", .9), (1, "b", .8), (1, "c", .71), (1, "d", .3), (2, "a", .1), (2, "b", .05), (3, "a", float("nan")), (3, "b", None)],
                               "query_id long, doc_id string, score double")
    got = {}
    for r in P.filter_reranked(df).collect():
        got.setdefault(r.query_id, set()).add(r.doc_id)
    assert got == {1: {"a", "b", "c"}, 2: {"a"}}


def test_token_budget_is_spent_exactly(spark):
    df = spark.createDataFrame([(1, 1, "a" * 80), (1, 2, "b" * 400), (1, 3, "c")], "query_id long, rank int, content string")
    rows = P.pack_token_budget(df, 40).orderBy("rank").collect()
    assert [r.context_truncated for r in rows] == [False, True] and sum(r.context_tokens for r in rows) <= 40


def test_null_keys_keep_their_rows(spark):
    df = spark.createDataFrame([(None, 1, "a"), (None, 2, "b"), ("x", None, "c"), ("x", 3, "d")], "query_id string, rank int, content string")
    assert P.pack_token_budget(df, 40).count() == 4


@pytest.mark.parametrize("share", [0.0, 0.9])
def test_ranks_by_range(spark, share):
    rng = np.random.default_rng(5)
    rows = [("hot" if rng.random() < share else None if i % 11 == 0 else f"k{i % 7}", int(rng.integers(0, 50)), i) for i in range(3_000)]
    df = spark.createDataFrame(rows, "key string, v long, id long").repartition(6)
    got = {r.id: r.n for r in K.rank_by_range(df, ["key"], [F.col("v").desc(), F.col("id")], "n").collect()}
    for key in {r[0] for r in rows}:
        order = sorted((r for r in rows if r[0] == key), key=lambda r: (-r[1], r[2]))
        assert [got[r[2]] for r in order] == list(range(1, len(order) + 1))
    whole = sorted(rows, key=lambda r: (-r[1], r[2]))
    for first, size in ((0, 7), (1_234, 30), (2_990, 50), (5_000, 5)):
        page = K.page_by_range(df, [F.col("v").desc(), F.col("id")], first, size).collect()
        assert sorted(r.id for r in page) == sorted(r[2] for r in whole[first:first + size])


def test_evidence_gate(spark):
    q = spark.createDataFrame([(i,) for i in range(1, 6)], "query_id long")
    rows = spark.createDataFrame([(1, "x", "p", .8), (2, "x", "p", .1), (3, " ", "p", .9), (4, "x", None, None)],
                                 "query_id long, content string, page_id string, rerank_score double").withColumn("score", F.lit(None).cast("double"))
    got = {r.query_id: r for r in P.assess_evidence(rows, q).collect()}
    assert [got[i].evidence_status for i in range(1, 6)] == ["sufficient", "insufficient", "insufficient", "sufficient", "insufficient"]
    assert got[4].evidence_source_count == 1


def test_grades_fail_closed_and_boundaries(spark):
    s = spark.createDataFrame([(1, 0, .7), (1, 1, .5), (1, 2, .3), (2, 0, .9), (3, 0, .5), (4, 0, 1.2), (5, 1, .9)], "query_id long, doc_index long, score double")
    c = spark.createDataFrame([(1, 3, "complete"), (2, 1, "incomplete"), (3, 1, "none"), (4, 1, "complete"), (5, 1, "complete"), (6, 2, "complete")],
                              "query_id long, n_documents long, coverage string")
    g = {r.query_id: r for r in P.grade_scores(s, c).collect()}
    assert [g[i].grade for i in range(1, 7)] == ["correct", "ambiguous", "ambiguous", "incorrect", "incorrect", "incorrect"]
    assert (g[1].support_count, g[1].limited_count, g[1].incorrect_count) == (1, 1, 1) and g[5].grading_failed and not g[3].grading_failed


def test_passage_lookup_equals_scan(spark):
    docs = spark.createDataFrame([(i, f"alpha beta {w} gamma delta {i}") for i, w in enumerate(["x", "y", "x", "z"])], "doc_id long, text string")
    q = spark.createDataFrame([(1, "eta x gam"), (2, "beta y gamma"), (3, "beta q gamma")], "query_id long, query string")
    got = {tuple(r) for r in X.containing_documents(q, docs).collect()}
    assert got == {(1, 0), (1, 2), (2, 1)}


def test_texts_stay_where_they_are(spark):
    """Labels and candidates are looked up in the documents; no text and no word of a document is shuffled."""
    from folioframe.operators import fusion as U
    from folioframe.plans import search as X
    docs = spark.createDataFrame([(i, f"one two w{i} three four five") for i in range(200)], "doc_id long, text string")
    queries = spark.createDataFrame([(1, "two w7 three"), (2, "o"), (3, "w9 three four")], "query_id long, query string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = X.containing_documents(queries, docs)
        fused = spark.createDataFrame([(1, 7, 0.5, 1), (2, 9, 0.4, 1)], "query_id long, doc_id long, score double, rank int")
        texts = U.candidates(fused, docs.withColumnRenamed("doc_id", "chunk_id"))
        for df in (found, texts):
            assert "hashpartitioning" not in df._jdf.queryExecution().executedPlan().toString()
        assert {tuple(r) for r in found.collect()} == {(1, 7), (3, 9)} | {(2, i) for i in range(200)}
        assert {(r["query_id"], r["content"]) for r in texts.collect()} == {(1, "one two w7 three four five"), (2, "one two w9 three four five")}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
