"""Quantiles of any window from stored sketches: one KLL sketch per key and hour, merged on demand.

A sketch of parameter k places a value within ``rank_error(k)`` of its true rank, as a share of all values, with a confidence
of 99 %, and merging keeps that. Where the exact nearest rank is wanted, the sketch brackets it: values below the bracket are only
counted, those inside are counted per distinct value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import broadcast_if_small, materialize
from .skew import join_null_safe

SKETCH_K = 1_000


def rank_error(k: int = SKETCH_K) -> float:
    """Share of all values by which a rank may be off (the published fit for this sketch)."""
    return 2.296 / k ** 0.9021


def _numbers(df: DataFrame, value: str) -> DataFrame:
    return df.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))


def sketch_columns(value: str, k: int = SKETCH_K) -> list:
    """Aggregates of a sketch row: n, low, high, sketch. They also run in a streaming aggregation."""
    v = F.col(value).cast("double")
    v = F.when(~F.isnan(v), v)
    return [F.count(v).alias("n"), F.min(v).alias("low"), F.max(v).alias("high"), F.kll_sketch_agg_double(v, k).alias("sketch")]


def hourly_sketches(df: DataFrame, keys: list, ts: str, value: str, k: int = SKETCH_K) -> DataFrame:
    """(keys, hour, n, low, high, sketch); nulls and NaN take no part."""
    return _numbers(df, value).groupBy(*keys, F.date_trunc("hour", ts).alias("hour")).agg(*sketch_columns(value, k))


def merge_sketches(sketches: DataFrame, keys: list, size: str | None = None, hour: str = "hour") -> DataFrame:
    """(keys, window_start, n, low, high, sketch) for windows of ``size``; without one, (keys, n, …) over all hours."""
    by = list(keys) + ([F.window(hour, size)["start"].alias("window_start")] if size else [])
    return sketches.groupBy(*by).agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"),
                                     F.kll_merge_agg_double("sketch").alias("sketch"))


def quantiles(sketches: DataFrame, wanted: dict) -> DataFrame:
    """Add a column per name of ``wanted`` (name: share), off by ``rank_error`` at most, read from the sketches alone."""
    return sketches.withColumns({name: F.kll_sketch_get_quantile_double("sketch", F.lit(float(p))) for name, p in wanted.items()})


def _brackets(sketches: DataFrame, by: list, wanted: dict, slack: float) -> DataFrame:
    def edge(p, outer):
        return outer if p <= 0.0 or p >= 1.0 else F.kll_sketch_get_quantile_double("sketch", F.lit(p))
    each = [F.struct(F.lit(name).alias("name"), F.greatest(F.lit(1).cast("long"), F.ceil(F.lit(p) * F.col("n"))).alias("pos"),
                     edge(p - slack, F.col("low")).alias("lo"), edge(p + slack, F.col("high")).alias("hi")) for name, p in wanted.items()]
    return sketches.select(*by, F.explode(F.array(*each)).alias("q")).select(*by, "q.*")


def exact_quantiles(rows: DataFrame, sketches: DataFrame, by: list, value: str, wanted: dict, k: int = SKETCH_K) -> DataFrame:
    """(by, names of ``wanted``): exact nearest-rank quantiles of ``rows`` (by, value), bracketed by ``sketches`` (by, n, low, high, sketch).

    The bracket is three rank errors wide to each side; groups whose bracket misses a rank are repeated with the whole range, so
    none is left without a value. Null keys are groups like others.
    """
    rows, found, left = _numbers(rows.select(*by, F.col(value).cast("double").alias("_v")), "_v"), None, sketches
    for slack in (3 * rank_error(k), 1.0):
        brackets = broadcast_if_small(_brackets(left, by, wanted, slack))
        placed = join_null_safe(rows, brackets, by).filter(F.col("_v") <= F.col("hi"))
        inside = materialize(placed.groupBy(*by, "name", "pos", F.when(F.col("_v") >= F.col("lo"), F.col("_v")).alias("v")).agg(F.count("*").alias("_c")), "ranks")
        order = Window.partitionBy(*by, "name").orderBy(F.col("v").asc_nulls_first())
        reached = inside.withColumn("_upto", F.sum("_c").over(order)).filter(F.col("_upto") >= F.col("pos"))
        # the first entry to reach the rank: a value, or what lies below the bracket, and that is a miss
        picked = reached.groupBy(*by, "name").agg(F.min_by("v", "_upto").alias("v")).filter("v IS NOT NULL")
        found = picked if found is None else found.unionByName(picked)
        full = picked.groupBy(*by).agg(F.count("*").alias("_names")).filter(F.col("_names") == len(wanted)).drop("_names")
        left = join_null_safe(left, full, by, "left_anti")
        if not left.limit(1).count():
            break
    # a group that was repeated has its values twice
    picks = [F.max(F.when(F.col("name") == name, F.col("v"))).alias(name) for name in wanted]
    return found.groupBy(*by).agg(*picks)
