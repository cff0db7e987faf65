import math
import random

import pytest
from pyspark.sql import functions as F

from folioframe.operators import evaluate as E
from folioframe.operators.skew import ordinal, running_sum


def test_metrics(spark):
    r = spark.createDataFrame([("m", 1, "a", 1), ("m", 1, "a", 2), ("m", 1, "b", 3), ("m", 2, "x", 1)], "method string, query_id long, doc_id string, rank int")
    q = spark.createDataFrame([(1, "a", 3.0), (1, "b", 1.0), (2, "y", 1.0), (1, "z", 0.0)], "query_id long, doc_id string, grade double")
    want = spark.createDataFrame([("m", 1, "c"), ("m", 2, "c"), ("m", 3, "d")], "method string, query_id long, category string")
    got = {x.query_id: x for x in E.query_metrics(r, q, want, (1, 2)).collect()}
    assert got[1].mrr == 1.0 and got[1].ndcg_2 == pytest.approx(1.0) and got[1].precision_2 == 1.0 and got[1].recall_1 == 0.5
    assert got[2].hit_2 == 0.0 and got[3].mrr == 0.0
    means = {(x.method, x.category): x.mrr for x in E.aggregate_metrics(E.query_metrics(r, q, want, (1,)), ["mrr"]).collect()}
    assert means == {("m", None): pytest.approx(1 / 3), ("m", "c"): .5, ("m", "d"): 0.0}


def test_evidence_coverage(spark):
    ev = spark.createDataFrame([(1, 0, "s", 0, 10), (1, 1, "s", 20, 20), (1, 2, "t", 0, 10)], "query_id long, ord int, source_id string, start int, end int")
    ret = spark.createDataFrame([("m", 1, 1, "s", 0, 5), ("m", 1, 2, "s", 3, 8), ("m", 1, 3, "s", 8, 30), ("m", 1, 3, "u", 0, 9)],
                                "method string, query_id long, rank int, source_id string, start int, end int")
    q = spark.createDataFrame([("m", 1), ("m", 2)], "method string, query_id long")
    got = {(r.query_id, r.k): (r.evidence_recall, r.evidence_coverage) for r in E.evidence_metrics(ret, ev, q, (1, 2, 3)).collect()}
    assert got == {(1, 1): (.5, .25), (1, 2): (.5, .4), (1, 3): (.5, .5), (2, 1): (0, 0), (2, 2): (0, 0), (2, 3): (0, 0)}


def test_nearest_rank_is_exact(spark):
    rng, rows = random.Random(2), []
    for key, n in (("a", 1), ("b", 7), ("c", 500)):
        rows += [(key, rng.choice([rng.random() * 1e3, 5.0])) for _ in range(n)]
    rows += [("d", 3.0)] * 9
    got = {r.method: r for r in E.latency_summary(spark.createDataFrame(rows, "method string, latency_ms double")).collect()}
    for key in "abcd":
        v = sorted(x for k, x in rows if k == key)
        for name, p in (("p50", .5), ("p95", .95)):
            assert got[key][name] == v[max(0, math.ceil(p * len(v)) - 1)]


def test_sliced_windows_equal_plain_ones(spark):
    rows = [("hot" if i % 3 else f"k{i % 5}", i, i % 4) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, id long, v long")
    got = {r.id: r.n for r in ordinal(df, ["k"], "id", "n", 7).collect()}
    sums = {r.id: r.s for r in running_sum(df, ["k"], "id", F.col("v"), "s", 11).collect()}
    count, total = {}, {}
    for k, i, v in rows:
        count[k], total[k] = count.get(k, 0) + 1, total.get(k, 0) + v
        assert got[i] == count[k] and sums[i] == total[k]


def test_missed_brackets_are_widened(spark):
    rng = random.Random(9)
    rows = [(f"k{i % 3}", float(rng.choice([rng.randint(0, 5000), 7, 7, 7]))) for i in range(6_000)] + [("one", 1.5), ("none", None)]
    df = spark.createDataFrame(rows, "key string, v double").repartition(4)
    got = {r.key: (r.p10, r.p95) for r in E.nearest_rank(df, "key", "v", {"p10": 0.10, "p95": 0.95}, accuracy=3, widths=(1e-9, 1e-8)).collect()}
    for key in ("k0", "k1", "k2", "one"):
        values = sorted(v for k, v in rows if k == key)
        assert got[key] == tuple(values[max(1, math.ceil(p * len(values))) - 1] for p in (0.10, 0.95))
