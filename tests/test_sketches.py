"""Quantiles from merged sketches against sorted lists."""

import math
import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from folioframe.operators import sketches as K

START = datetime(2024, 1, 1)


def table(spark):
    rng, rows = random.Random(5), []
    for key, n in (("a", 4000), ("b", 1), ("c", 30), (None, 300)):
        rows += [(key, START + timedelta(minutes=rng.randrange(3 * 1440)), rng.choice([rng.gauss(0, 1e3), 7.0])) for _ in range(n)]
    rows += [("a", START, None), ("a", START, float("nan")), ("d", START, None)]
    return rows, spark.createDataFrame(rows, "key string, ts timestamp, v double")


def ranked(values, p):
    return sorted(values)[max(0, math.ceil(p * len(values)) - 1)]


def test_exact_quantiles_of_merged_windows(spark):
    rows, df = table(spark)
    kept = K.hourly_sketches(df, ["key"], "ts", "v", k=50)
    days = K.merge_sketches(kept, ["key"], "1 day")
    wanted = {"low": 0.01, "mid": 0.5, "high": 0.95}
    got = {(r.key, r.window_start): (r.low, r.mid, r.high) for r in K.exact_quantiles(
        df.withColumn("window_start", F.date_trunc("day", "ts")), days, ["key", "window_start"], "v", wanted, k=50).collect()}
    groups = {}
    for key, ts, v in rows:
        if v is not None and not math.isnan(v):
            groups.setdefault((key, datetime(ts.year, ts.month, ts.day)), []).append(v)
    assert got == {g: tuple(ranked(vs, p) for p in wanted.values()) for g, vs in groups.items()}


def test_a_missed_bracket_is_repeated(spark):
    _, df = table(spark)
    whole = K.merge_sketches(K.hourly_sketches(df, ["key"], "ts", "v", k=8), ["key"])
    # so large a k is taken for the sketch that the bracket is far too narrow
    got = {r.key: r.mid for r in K.exact_quantiles(df, whole, ["key"], "v", {"mid": 0.5}, k=60_000).collect()}
    values = {}
    for r in df.filter("v IS NOT NULL AND NOT isnan(v)").collect():
        values.setdefault(r.key, []).append(r.v)
    assert got == {k: ranked(v, 0.5) for k, v in values.items()}


def test_the_sketch_alone_stays_within_its_error(spark):
    rows = spark.range(20_000).select((F.col("id") * 7919 % 20_000).cast("double").alias("v"), (F.lit(START) + F.make_dt_interval(hours=F.col("id") % 40)).alias("ts"))
    merged = K.merge_sketches(K.hourly_sketches(rows, [], "ts", "v", k=200), [])
    r = K.quantiles(merged, {"p50": 0.5, "p95": 0.95}).first()
    assert r.n == 20_000 and abs(r.p50 / 20_000 - 0.5) < 2 * K.rank_error(200) and abs(r.p95 / 20_000 - 0.95) < 2 * K.rank_error(200)
