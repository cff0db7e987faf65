"""Registration of the runnable queries: name -> (Spark callable, oracle SQL or None)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import spread

# tables whose rows are costly to work on
TEXT_TABLES = {"documents", "pages", "conversations"}

QUERIES: dict = {}
ORACLES: dict = {}


def plain(df: DataFrame) -> DataFrame:
    """Whole numbers as bigint and fractions as double, as the oracles return them."""
    widen = {"tinyint": "bigint", "smallint": "bigint", "int": "bigint", "float": "double",
             "timestamp": "timestamp_ntz"}
    return df.select(*[F.col(f"`{n}`").cast(widen[t]).alias(n) if t in widen else F.col(f"`{n}`")
                       for n, t in df.dtypes])


def query(name: str, sql: str | None = None):
    def add(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return plain(fn(Tables(spark, sf_dir)))
        run.__name__ = name
        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return fn
    return add


class Tables:
    """The given parquet tables, read on demand."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        df = self.spark.read.parquet(f"{self.dir}/{name}.parquet")
        df = spread(df) if name in TEXT_TABLES else df
        setattr(self, name, df)      # read the footer once per query
        return df
