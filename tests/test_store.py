import random
import uuid

import pytest
from pyspark.sql import functions as F

from folioframe.operators import index as I
from folioframe.operators.lexical import bm25_search, bm25_search_eval, lexical_index
from folioframe.operators.store import LexicalStore

WORDS = [f"w{i}" for i in range(60)]


def texts(rng, ids):
    return {i: " ".join(rng.choices(WORDS, weights=[1 / (j + 1) for j in range(60)], k=rng.choice([0, 1, 3, 10, 40, 200]))) for i in ids}


def frame(spark, docs):
    return spark.createDataFrame(list(docs.items()), "chunk_id long, text string").repartition(3)


def as_set(df, *cols):
    rows = [tuple(r) for r in df.select(*cols).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def same_as_rebuilt(spark, store, docs, queries):
    """Every table and every search of the store equals that of an index built anew."""
    fresh = lexical_index(frame(spark, docs), mode=store.state["mode"])
    assert as_set(store.postings(), "chunk_id", "term", "tf", "dl") == as_set(fresh["postings"], "chunk_id", "term", "tf", "dl")
    assert as_set(store.term_df(), "term", "df", "cf") == as_set(fresh["term_df"], "term", "df", "cf")
    want, got = fresh["stats"].first(), store.stats().first()
    assert got["n_docs"] == want["n_docs"] and got["avgdl"] == pytest.approx(want["avgdl"]) and got["mean_idf"] == pytest.approx(want["mean_idf"])
    cols = ["query_id", "doc_id", "score", "rank"]
    exact = as_set(bm25_search(fresh, queries, 5), *cols)
    assert as_set(bm25_search(store.index(), queries, 5), *cols) == exact == as_set(store.search(queries, 5, prune=False), *cols)


def test_changes_equal_a_rebuild(spark, tmp_path):
    rng = random.Random(2)
    queries = spark.createDataFrame([(i, " ".join(rng.choices(WORDS, k=6))) for i in range(12)] + [(90, ""), (91, "nowhere"), (92, None)], "query_id long, query string")
    path = f"{tmp_path}/{uuid.uuid4().hex}"
    store = LexicalStore.create(spark, path, buckets=4, block_docs=3)
    assert store.search(queries, 5).count() == 0
    docs = texts(rng, range(120))
    store.upsert(frame(spark, docs))
    same_as_rebuilt(spark, store, docs, queries)
    changed = texts(rng, [*range(100, 150), 7])
    store.upsert(frame(spark, changed))
    docs |= changed
    gone = spark.createDataFrame([(i,) for i in [*range(0, 40), 149, 5000]], "chunk_id long")
    store.remove(gone)
    docs = {i: t for i, t in docs.items() if i >= 40 and i != 149}
    store = LexicalStore.open(spark, path)                  # a new reader sees the newest commit
    assert len(store.state["segments"]) == 2
    same_as_rebuilt(spark, store, docs, queries)
    wanted = {**{i: t for i, t in docs.items() if i % 5}, **texts(rng, range(200, 220))}
    assert store.sync(frame(spark, wanted)) == {"indexed": 20, "removed": len(docs) - len([i for i in docs if i % 5]), "skipped": len([i for i in docs if i % 5])}
    assert store.sync(frame(spark, wanted)) == {"indexed": 0, "removed": 0, "skipped": len(wanted)}
    same_as_rebuilt(spark, store, wanted, queries)
    store.compact(max_segments=1)
    assert len(store.state["segments"]) == 1 and not store.state["dead"]
    same_as_rebuilt(spark, LexicalStore.open(spark, path), wanted, queries)
    with pytest.raises(ValueError):
        store.upsert(spark.createDataFrame([(1, "a"), (1, "b")], "chunk_id long, text string"))
    store = LexicalStore.open(spark, path)                  # the failed batch was never committed
    store.remove(frame(spark, wanted))
    assert store.state["n_docs"] == 0 and store.search(queries, 5).count() == 0


def test_search_shuffles_no_postings(spark, tmp_path):
    rng = random.Random(4)
    store = LexicalStore.create(spark, f"{tmp_path}/s", buckets=4)
    store.upsert(frame(spark, texts(rng, range(300))))
    queries = spark.createDataFrame([(1, "w40 w3 w59"), (2, "w1")], "query_id long, query string")
    found = store.search(queries, 3)
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    final = plan.split("Initial Plan")[0]
    # the one exchange follows the ranking of each task; nothing tokenises
    assert final.count("Exchange hashpartitioning") == 1 and "regexp_extract_all" not in final
    assert final.index("WindowGroupLimit") < final.index("Exchange hashpartitioning") or "WindowGroupLimit" in final


def test_bounds_keep_blocks_out_of_the_sum(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(sf_dir.replace("sf0.001", "sf0.01") + "/documents.parquet").select(F.col("doc_id").alias("chunk_id"), "text")
    queries = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    store = LexicalStore.create(spark, f"{tmp_path}/s", buckets=4, block_docs=4)
    store.upsert(docs)
    from folioframe.operators.lexical import query_terms
    weights = store._weights(query_terms(queries))
    kept = sum(rows.select(F.sum(F.size("docs"))).first()[0] for _, rows in store.survivors(weights, 5))
    every = sum(store._blocks(s).join(F.broadcast(weights), "term").select(F.sum(F.size("docs"))).first()[0] for s in store.state["segments"])
    assert kept < every / 1.5
    cols = ["query_id", "doc_id", "score", "rank"]
    assert as_set(store.search(queries, 5), *cols) == as_set(bm25_search(lexical_index(docs), queries, 5), *cols)


def test_eval_search_puts_zero_before_negative(spark, tmp_path):
    # a vocabulary of words that most documents hold has a mean below zero, so common words score below zero
    docs = {i: "a b c" if i % 4 else "a c" for i in range(12)} | {100: "z", 101: ""}
    queries = spark.createDataFrame([(1, "a"), (2, "z a"), (3, "missing"), (4, "z")], "query_id long, query string")
    cols = ["query_id", "doc_id", "score", "rank"]
    fresh = lexical_index(frame(spark, docs), mode="eval")
    store = LexicalStore.create(spark, f"{tmp_path}/s", mode="eval", buckets=2)
    store.upsert(frame(spark, docs))
    for k in (3, 20):
        got = as_set(bm25_search_eval(fresh, queries, k), *cols)
        assert got == as_set(bm25_search_eval(store.index(), queries, k), *cols)
        scores = {(q, d): s for q, d, s, _ in as_set(bm25_search_eval(fresh, queries, 20), *cols)}
        for q in range(1, 5):
            want = sorted(docs, key=lambda d: (-scores.get((q, d), 0.0), d))[:k]
            assert [d for _, d, _, _ in sorted((r for r in got if r[0] == q), key=lambda r: r[3])] == want
    assert any(s < 0 for _, _, s, _ in as_set(bm25_search_eval(fresh, queries, 20), *cols))


def test_a_search_writes_no_row_per_pair(spark, tmp_path, monkeypatch):
    """Every document matches every question; what leaves the scan is k rows a question and task, over several waves and tiles."""
    from folioframe.operators import scan
    from folioframe.operators.lexical import query_terms
    from pyspark.sql.types import LongType
    monkeypatch.setattr(scan, "WAVE_QUESTIONS", 7)
    monkeypatch.setattr(scan, "TILE_CELLS", 40)
    monkeypatch.setattr(scan, "TILE_SUMS", 50)
    docs = spark.createDataFrame([(i, f"all words {'more ' * (i % 5)} w{i % 11}") for i in range(400)], "chunk_id long, text string").repartition(3)
    queries = spark.createDataFrame([(i, f"all words w{i} w{i}") for i in range(20)], "query_id long, query string")
    store = LexicalStore.create(spark, str(tmp_path / "ix"), "search", LongType(), buckets=3)
    store.upsert(docs)
    got = store.search(queries, 5)
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in store.search(queries, 5, prune=False).collect()} and got.count() == 100
    pairs = store.scores(query_terms(queries)).count()
    offered = sum(b.num_rows for wave in scan._waves(store._weights(query_terms(queries))) for b in scan._scan(
        iter(store.documents().select("chunk_id", "dl", "terms").toArrow().combine_chunks().to_batches()), wave, store.state["avgdl"], 5, 0.0, 1.5, 0.75,
        scan.pa.schema([("query_id", scan.pa.int64()), ("doc_id", scan.pa.int64()), ("score", scan.pa.float64())])))
    assert pairs == 8000 and offered == 100


def test_an_upsert_writes_no_postings_and_buckets_grow(spark, tmp_path, monkeypatch):
    """Building an index and searching it sorts no posting; where postings are asked for, a bucket holds a bounded number of them."""
    from folioframe.operators import store as module
    from folioframe.operators.lexical import query_terms
    docs = texts(random.Random(6), range(200))
    queries = spark.createDataFrame([(1, "w40 w3 w59"), (2, "w1")], "query_id long, query string")
    store = LexicalStore.create(spark, str(tmp_path / "ix"), buckets=2)
    store.upsert(frame(spark, docs))
    assert store.search(queries, 3).count() and not (tmp_path / "ix" / "postings").exists()
    monkeypatch.setattr(module, "BUCKET_POSTINGS", 100, raising=False)
    n = store.postings().count()
    got = as_set(store.scores(query_terms(queries)), "query_id", "doc_id", "score")
    table = f"lexical_{store.state['segments'][0]['name']}"
    buckets = {r[0]: r[1] for r in spark.sql(f"DESCRIBE EXTENDED {table}").collect()}["Num Buckets"]
    assert int(buckets) == -(-n // 100) > 2
    fresh = bm25_search(lexical_index(frame(spark, docs)), queries, 1000)
    assert {r for r in got if r[2] > 0} == as_set(fresh, "query_id", "doc_id", "score")
