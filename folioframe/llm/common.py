"""Shared helpers: row-wise Arrow maps in bounded pieces, tables that cut lineage, connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..session import materialize

# bytes of text that a Python worker turns into arrays at a time
PIECE_CHARS = 1_500_000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents")


def pieces(sizes: list[int], limit: int = PIECE_CHARS) -> Iterator[tuple[int, int]]:
    """Consecutive slices of rows with a total size of about ``limit`` each; a larger row is a slice of its own."""
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def text_sizes(values: pa.Array) -> list[int]:
    """Bytes of each text, or items of each list; 0 for null."""
    nested = pa.types.is_list(values.type) or pa.types.is_large_list(values.type)
    return pc.fill_null(pc.list_value_length(values) if nested else pc.binary_length(values), 0).to_pylist()


def map_texts(df: DataFrame, text_col: str, keep: list[str], schema: StructType,
              make: Callable[[], Callable[[list], list]], limit: int = PIECE_CHARS) -> DataFrame:
    """The columns ``keep`` and those of ``schema``, computed from the whole texts in an Arrow map stage.

    ``make`` is called once per task and returns a function from a list of texts (or bytes, or None; for array columns
    the Arrow array) to the list of the new columns' values, one list or array per field. Rows go through it in pieces of
    about ``limit`` bytes or items, so a worker holds one piece as Python objects and not a whole Arrow batch.
    """
    rows = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").alias("__text"))
    kept = StructType(rows.schema.fields[:-1])
    out_schema = StructType(kept.fields + schema.fields)
    arrow = to_arrow_schema(out_schema)
    added = [arrow.field(i) for i in range(len(kept.fields), len(arrow))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in batches:
            values = batch.column(batch.num_columns - 1)
            for lo, hi in pieces(text_sizes(values), limit):
                part = batch.slice(lo, hi - lo)
                texts = values.slice(lo, hi - lo)
                new = fn(texts if pa.types.is_nested(values.type) else texts.to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column(i).cast(arrow.field(i).type) for i in range(len(kept.fields))]
                    + [pa.array(v, type=f.type) for v, f in zip(new, added)],
                    schema=arrow)

    return rows.mapInArrow(run, out_schema)


def components(edges: DataFrame, label: str, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges`` (u, v): one row (node, root) per node, root being the smallest node reachable.

    Alternating large-star and small-star rounds; each is a few shuffles of the edges and ends in a table of the shared
    folder. No node's neighbours are gathered, and every chain shortens in each round.
    """
    table = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(),
                        f"{label}-edges")
    state = None
    for _ in range(max_rounds):
        now = table.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == state or now[0] == 0:
            return table.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                table.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
        state = tuple(now)
        both = table.union(table.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(lowest, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").select(F.explode(F.array(
            F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
            F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        table = materialize(small, f"{label}-round")
    raise RuntimeError("components did not settle")
