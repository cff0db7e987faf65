"""A kept store of embeddings, addressed by content: a distinct text of a profile is embedded once.

Rows are (key, embedding) in a folder per profile and batch, ``key`` being the SHA-256 of the trimmed text. A batch asks the
model only for keys that no other batch of its profile holds, so running one again writes the same folder again and adds
nothing. A profile has one writer at a time; readers see whole batches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.common import strip
from ..session import broadcast_if_small, fits, materialize

# rows that share a text before their join is spread over SALTS tasks
HOT_ROWS = 100_000
SALTS = 64


def text_key(text: str) -> Column:
    """Key of a text; null for one without anything to embed."""
    trimmed = strip(F.coalesce(F.col(f"`{text}`"), F.lit("")))
    return F.when(trimmed != "", F.sha2(trimmed, 256))


def _checked(vector: Column, dims: int) -> Column:
    """The vector, or an error for one that is missing, of another size or not finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    fine = F.coalesce((F.size(vector) == dims) & ~bad, F.lit(False))
    return F.when(fine, vector).otherwise(F.raise_error(F.lit(f"the model must return {dims} finite numbers for a text")).cast("array<float>"))


class VectorStore:
    SCHEMA = "key string, embedding array<float>, profile string, batch string"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        # the folder has to be there for the first reader
        spark.createDataFrame([], self.SCHEMA).write.mode("ignore").partitionBy("profile", "batch").parquet(path)

    def vectors(self, profile: str | None = None) -> DataFrame:
        rows = self.spark.read.schema(self.SCHEMA).parquet(self.path)
        return rows if profile is None else rows.filter(F.col("profile") == profile)

    def missing(self, texts: DataFrame, profile: str, text: str = "text", batch: str | None = None) -> DataFrame:
        """(key, text) of each distinct text without a vector in the profile; vectors of ``batch`` do not count.

        Keys travel first and are kept: texts are read once for the keys, and again only where some are absent.
        """
        held = self.vectors(profile)
        held = held if batch is None else held.filter(F.col("batch") != batch)
        rows = texts.select(text_key(text).alias("key"), strip(F.col(f"`{text}`")).alias("text"))
        absent = materialize(rows.filter("key IS NOT NULL").select("key").distinct().join(held.select("key"), "key", "left_anti"), "absent-keys")
        if absent.isEmpty():
            return absent.withColumn("text", F.lit(None).cast("string"))
        if fits(absent):
            return rows.join(F.broadcast(absent), "key", "left_semi").groupBy("key").agg(F.first("text").alias("text"))
        # copies are dropped in each task before texts travel, so that a hot text does not meet in one
        return rows.filter("key IS NOT NULL").groupBy("key").agg(F.first("text").alias("text")).join(absent, "key", "left_semi")

    def add(self, texts: DataFrame, embedder, dims: int, profile: str, batch: str, text: str = "text") -> None:
        """Embed what the profile lacks and keep it as one batch; a batch that is run again replaces itself."""
        fresh = self.missing(texts, profile, text, batch)
        vector = embedder(F.col("text")).cast("array<float>")
        rows = fresh.select("key", vector.alias("embedding")).select("key", _checked(F.col("embedding"), dims).alias("embedding"),
                                                                    F.lit(profile).alias("profile"), F.lit(batch).alias("batch"))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("profile", "batch").parquet(self.path)

    def embed(self, texts: DataFrame, dims: int, profile: str, text: str = "text", hot_rows: int = HOT_ROWS) -> DataFrame:
        """``texts`` with ``embedding``: zeros where there is no text, null where the profile lacks it; no model is called.

        The rows of a text that many share are spread over salts, and its vector is repeated for each of them.
        """
        keyed = texts.select(F.struct(*[F.col(f"`{c}`") for c in texts.columns]).alias("row"), text_key(text).alias("key"))
        hot = keyed.filter("key IS NOT NULL").groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > hot_rows).select("key", F.lit(SALTS).alias("salts"))
        hot = broadcast_if_small(materialize(hot, "hot-keys"))
        # rows without a text match nothing; they are spread too
        salt = F.pmod(F.monotonically_increasing_id(), F.coalesce("salts", F.when(F.col("key").isNull(), SALTS), F.lit(1))).cast("int")
        rows = keyed.join(hot, "key", "left").withColumn("salt", salt).drop("salts")
        held = self.vectors(profile).select("key", "embedding").join(hot, "key", "left")
        held = held.withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")
        zeros = F.array_repeat(F.lit(0.0).cast("float"), dims)
        joined = rows.join(held, ["key", "salt"], "left")
        return joined.select("row.*", F.when(F.col("key").isNull(), zeros).otherwise(F.col("embedding")).alias("embedding"))
