"""Ordinals and running sums inside groups of any size.

A window partitioned by a hot key puts the whole key in one task. Here a key is cut into slices of
a dense order column: sizes or sums are aggregated per slice, their prefix is a window over the
small slice table, and the row-level window runs inside one slice only.
"""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize


def _sliced(df: DataFrame, order: str, slice_rows: int) -> DataFrame:
    return df.withColumn("_slice", F.floor(F.col(order) / slice_rows))


def join_null_safe(rows: DataFrame, table: DataFrame, keys: list, how: str = "inner") -> DataFrame:
    """Join on equal keys where null equals null; the keys of ``rows`` stay."""
    named = table.withColumnsRenamed({k: f"_key{i}" for i, k in enumerate(keys)})
    same = reduce(operator.and_, [F.col(k).eqNullSafe(F.col(f"_key{i}")) for i, k in enumerate(keys)])
    return rows.join(named, same, how).drop(*[f"_key{i}" for i in range(len(keys))])


def running_sum(df: DataFrame, keys: list, order: str, value, out: str, slice_rows: int = 65_536) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the rows of the same keys up to and including this one.

    ``order`` is a whole number, unique within the keys.
    """
    rows = _sliced(df, order, slice_rows).withColumn("_v", value)
    per = rows.groupBy(*keys, "_slice").agg(F.sum("_v").alias("_s"))
    w = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per.withColumn("_before", F.coalesce(F.sum("_s").over(w), F.lit(0))).drop("_s")
    inside = Window.partitionBy(*keys, "_slice").orderBy(order)
    return join_null_safe(rows, offsets, [*keys, "_slice"]).withColumn(
        out, F.sum("_v").over(inside) + F.col("_before")).drop("_slice", "_v", "_before")


def ordinal(df: DataFrame, keys: list, order: str, out: str, slice_rows: int = 65_536) -> DataFrame:
    """Add ``out``: 1, 2, 3 … in ``order`` within the keys."""
    return running_sum(df, keys, order, F.lit(1).cast("long"), out, slice_rows)


def first_slices(df: DataFrame, keys: list, order: str, limit: int, slice_rows: int = 1024) -> DataFrame:
    """Rows of the slices of ``order`` that hold the first ``limit`` rows of each key, and at most one slice more.

    A window with a rank limit above Spark's own threshold would put a whole key into one task; after this cut a key
    has ``limit + slice_rows`` rows at most. ``order`` is a whole number, unique within the keys.
    """
    rows = _sliced(df, order, slice_rows)
    per = rows.groupBy(*keys, "_slice").agg(F.count("*").alias("_rows"))
    w = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    kept = per.withColumn("_before", F.coalesce(F.sum("_rows").over(w), F.lit(0))).filter(F.col("_before") < limit).select(*keys, "_slice")
    return join_null_safe(rows, kept, [*keys, "_slice"], "left_semi").drop("_slice")


def rank_by_range(df: DataFrame, keys: list, order: list, out: str, label: str = "ranks") -> DataFrame:
    """Add ``out``: 1, 2, 3 … within the keys by any order columns (sort expressions), however large a key is.

    Rows are cut into ranges of (keys, order), so a key of any size lies in consecutive ranges. Rows per key and range are
    counted, their prefix is a window over that small table, and the row-level window runs inside one range. The order should
    end in a unique column; rows that are equal on all of it fall into one range.
    """
    ranged = df.repartitionByRange(*keys, *order) if keys or order else df
    cut = materialize(ranged.withColumn("_range", F.spark_partition_id()), label)       # the ranges are sampled, so they are kept
    per = cut.groupBy(*keys, "_range").agg(F.count("*").alias("_rows"))
    w = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)      # a row a range and key
    offsets = per.withColumn("_before", F.coalesce(F.sum("_rows").over(w), F.lit(0))).drop("_rows")
    inside = Window.partitionBy(*keys, "_range").orderBy(*order)
    return join_null_safe(cut, offsets, [*keys, "_range"]).withColumn(
        out, (F.row_number().over(inside) + F.col("_before")).cast("int" if keys else "long")).drop("_range", "_before")


def page_by_range(df: DataFrame, order: list, first: int, size: int, label: str = "page") -> DataFrame:
    """Rows ``first`` + 1 to ``first`` + ``size`` of the whole order, from the ranges that hold them only."""
    cut = materialize(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), label)
    before, wanted = 0, {}
    for r in cut.groupBy("_range").count().orderBy("_range").collect():        # a row a range
        if before < first + size and before + r["count"] > first:
            wanted[r["_range"]] = before
        before += r["count"]
    if not wanted:
        return cut.drop("_range").limit(0)
    start = F.create_map(*[F.lit(x) for pair in wanted.items() for x in pair])
    rows = cut.filter(F.col("_range").isin(list(wanted)))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) + start[F.col("_range")]
    return rows.withColumn("_place", place).filter((F.col("_place") > first) & (F.col("_place") <= first + size)).orderBy("_place").drop("_range", "_place")
