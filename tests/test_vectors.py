"""The kept store of embeddings: what the model is asked for, and what readers get."""

import pytest
from pyspark.sql import functions as F

from folioframe.operators.vectors import VectorStore

TEXTS = "id int, text string"


def lengths(text):
    return F.array(F.length(text).cast("float"), F.lit(2.0).cast("float"))


def asked(store, profile):
    return {r.batch: r.n for r in store.vectors(profile).groupBy("batch").agg(F.count("*").alias("n")).collect()}


def test_only_changed_texts_reach_the_model(spark, tmp_path):
    store = VectorStore(spark, str(tmp_path / "v"))
    first = spark.createDataFrame([(1, "one"), (2, " one "), (3, "three"), (4, None), (5, " \t"), (6, "four")], TEXTS)
    store.add(first, lengths, 2, "p|a", "1")
    assert asked(store, "p|a") == {"1": 3}
    changed = spark.createDataFrame([(1, "one"), (3, "three!"), (6, "four")], TEXTS)
    store.add(changed, lengths, 2, "p|a", "2")
    assert asked(store, "p|a") == {"1": 3, "2": 1}
    for batch in ("2", "3", "1"):                 # repeated, and with nothing new
        store.add(first if batch == "1" else changed, lengths, 2, "p|a", batch)
    assert asked(store, "p|a") == {"1": 3, "2": 1}
    assert store.vectors("p|a").count() == store.vectors("p|a").select("key").distinct().count()
    # another profile shares nothing, and a reopened store has all
    again = VectorStore(spark, str(tmp_path / "v"))
    assert asked(again, "p|b") == {} and asked(again, "p|a") == {"1": 3, "2": 1}
    again.add(first, lengths, 2, "p|b", "1")
    assert asked(again, "p|b") == {"1": 3} and asked(again, "p|a") == {"1": 3, "2": 1}


def test_readers_get_every_row_once(spark, tmp_path):
    store = VectorStore(spark, str(tmp_path / "v"))
    rows = [(i, "hot") for i in range(50)] + [(50, "cold"), (51, None), (52, " "), (53, "unknown")]
    texts = spark.createDataFrame([(i, t, "clash") for i, t in rows], "id int, text string, key string")
    store.add(texts.filter("id < 51"), lengths, 2, "p", "1")
    for hot_rows in (10, 1000):                   # with and without salts
        got = {r.id: r.embedding for r in store.embed(texts, 2, "p", hot_rows=hot_rows).collect()}
        assert got == {i: {"hot": [3.0, 2.0], "cold": [4.0, 2.0], None: [0.0, 0.0], " ": [0.0, 0.0], "unknown": None}[t] for i, t in rows}
    assert store.embed(texts, 2, "p").columns == ["id", "text", "key", "embedding"]
    assert store.embed(texts.limit(0), 2, "p").count() == 0
    assert {r.text for r in store.missing(texts, "p").collect()} == {"unknown"}


def test_texts_are_read_once_for_keys_and_once_for_the_model(spark, tmp_path):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b
    first = spark.createDataFrame([(i, f"text {i % 60}") for i in range(80)], TEXTS).mapInArrow(counted, TEXTS)
    store = VectorStore(spark, str(tmp_path / "v"))

    def reads(*args):
        before = read.value
        store.add(first, lengths, 2, "p", *args)
        return read.value - before
    assert reads("1") == 160 and asked(store, "p") == {"1": 60}
    assert reads("2") == 80 and reads("1") == 160 and asked(store, "p") == {"1": 60}      # nothing is absent; a batch run again replaces itself
    before = read.value
    got = store.embed(first, 2, "p").collect()
    assert read.value - before == 160 and len(got) == 80 and all(r.embedding == [float(len(r.text)), 2.0] for r in got)


def test_a_text_of_more_keys_than_are_broadcast_travels_once(spark, tmp_path, monkeypatch):
    from folioframe import session
    from folioframe.operators import vectors
    for module in (session, vectors):
        monkeypatch.setattr(module, "fits", lambda *a: False, raising=False)
    rows = [(i, "hot") for i in range(500)] + [(500 + i, f" text {i % 20}") for i in range(40)] + [(900, None), (901, "\t")]
    texts = spark.createDataFrame(rows, TEXTS).repartition(4)
    store = VectorStore(spark, str(tmp_path / "v"))
    store.add(texts.filter("id < 510 OR id >= 900"), lengths, 2, "p", "1")
    assert asked(store, "p") == {"1": 11}
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        missing = store.missing(texts, "p")
        assert sorted(r.text for r in missing.collect()) == sorted(f"text {i}" for i in range(10, 20))
        plan = missing._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
        assert plan.index("Exchange hashpartitioning(key") < plan.index("partial_first(text")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    for batch in ("2", "3", "2"):
        store.add(texts, lengths, 2, "p", batch)
    assert asked(store, "p") == {"1": 11, "2": 10}


def test_labels_are_joined_without_moving_texts(spark, sf_dir):
    from folioframe.catalog import indexes
    from folioframe.catalog.registry import Tables
    t = Tables(spark, sf_dir)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        texts = indexes.labelled(t)
        assert sorted(r.text for r in texts.collect()) == sorted(r.text for r in t.documents.join(t.labels, "doc_id").select("text").collect())
        assert "hashpartitioning" not in texts._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_a_wrong_vector_is_an_error(spark, tmp_path):
    store = VectorStore(spark, str(tmp_path / "v"))
    texts = spark.createDataFrame([(1, "a")], TEXTS)
    for wrong in (lambda t: F.array(F.lit(1.0)), lambda t: F.array(F.lit(1.0), F.lit(float("nan"))), lambda t: F.lit(None).cast("array<float>")):
        with pytest.raises(Exception, match="finite numbers"):
            store.add(texts, wrong, 2, "p", "1")
    assert store.vectors("p").count() == 0


def test_term_vectors_are_folded_without_a_shuffle(spark):
    from folioframe.operators.index import build_postings, counted_terms, folded_term_vectors, hashed_term_vectors
    rows = [(i, " ".join(f"w{(i * j) % 37} Über 数据" for j in range(i % 9))) for i in range(60)] + [(100, ""), (101, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = folded_term_vectors(counted_terms(docs, "doc_id", "text").repartition(3))
    want = hashed_term_vectors(build_postings(docs, "doc_id", "text"), "chunk_id")
    assert {(r[0], tuple(r[1])) for r in got.collect()} == {(r[0], tuple(r[1])) for r in want.collect()} and got.count() == want.count() > 40
    plan = folded_term_vectors(counted_terms(docs, "doc_id", "text"))._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan
