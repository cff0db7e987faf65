"""A run of methods of which some fail."""

import pytest
from pyspark.sql import functions as F

from folioframe.plans import ablation as A


def inputs(spark):
    queries = spark.createDataFrame([(1, "c", "answer"), (2, "d", "answer"), (3, "d", "reject")], "query_id int, category string, expected_action string")
    qrels = spark.createDataFrame([(1, "a", 1.0), (2, "b", 1.0)], "query_id int, doc_id string, grade double")
    return queries, qrels, spark.createDataFrame([("a",), ("b",)], "doc_id string")


def ranking(context):
    return context["queries"].select("query_id", F.lit("a").alias("doc_id"), F.lit(1).alias("rank"))


def test_failures_are_rows(spark):
    queries, qrels, docs = inputs(spark)

    def broken(context):
        raise ValueError("first line\nsecond")

    def late(context):           # fails while its job runs
        return ranking(context).withColumn("rank", F.raise_error(F.lit("in a task")).cast("int"))

    run = A.run_methods(lambda: {"queries": queries}, {"good": ranking, "broken": broken, "late": late}, queries)
    parts = A.full_report(run, qrels, queries, docs, {"top_k": 3, "models": {"b": 1, "a": 2}}, ["good", "broken", "late"], (1, 3))
    got = {r.method: (r.mrr, r.failures, r.failure_rate, r.evaluated_queries, r.latency_ms >= 0) for r in parts["methods"].collect()}
    assert got == {"good": (0.5, 0, 0.0, 2, True), "broken": (0.0, 2, 1.0, 2, True), "late": (0.0, 2, 1.0, 2, True)}
    errors = {r.method: r.error for r in run["errors"].collect()}
    assert errors["broken"] == "ValueError: first line" and set(errors) == {"broken", "late"}
    assert parts["setup"].first().status == "succeeded" and parts["dataset"].first().unanswerable_queries == 1
    assert {r.name: r.value for r in parts["configuration"].collect()} == {"top_k": "3", "models": '{"a": 2, "b": 1}'}
    assert {(r.method, r.category, r.mrr) for r in parts["categories"].collect() if r.method == "good"} == {("good", "c", 1.0), ("good", "d", 0.0)}


def test_a_failed_set_up_leaves_methods_that_need_none(spark):
    queries, qrels, docs = inputs(spark)

    def prepare():
        raise OSError("no model")

    run = A.run_methods(prepare, {"bm25": lambda _: ranking({"queries": queries}), "embedding": ranking}, queries, without_setup=("bm25",))
    parts = A.full_report(run, qrels, queries, docs, {"top_k": 1}, ["bm25", "embedding"], (1,))
    assert {r.method: r.failures for r in parts["methods"].collect()} == {"bm25": 0, "embedding": 2}
    assert (parts["setup"].first().status, parts["setup"].first().error) == ("failed", "OSError: no model")
    alone = A.run_methods(prepare, {"bm25": lambda _: ranking({"queries": queries})}, queries, without_setup=("bm25",))
    assert alone["setup"].first().status == "not_required" and alone["errors"].count() == 0
    with pytest.raises(ValueError):
        A.full_report(alone, qrels, queries, docs, {"top_k": 1}, ["bm25"], (1, 3))
    with pytest.raises(ValueError):
        A.full_report(alone, qrels, queries, docs, {"top_k": 3}, [], (1,))
