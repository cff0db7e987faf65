"""Sharding by extendible hashing, in DataFrame operations only.

A directory is indexed by the leading bits of a hash of the id. It starts as one bucket; a bucket over the byte limit is
split on the next bit, all others stay as they are, until each shard fits. Sizes are summed once per cell of
``PAGE_BITS`` bits, and all splits within a page of the directory follow from the cells. Where cells themselves are too
large, a further page with the next bits is made for those alone, so no page is larger than what it has to tell apart.

Defined results: a null or empty text has no bytes; rows without an id are hashed by their text; repeated rows have one
hash, which no bit can split: a bucket that holds a single hash stays whole and has ``fits`` false if it is too large
(also a single text beyond the limit); an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_if_small, materialize

HASH_BITS = 60
PAGE_BITS = 15
LIMIT_BYTES = 1 << 20


def hash_of(id_col: str, text_col: str):
    """60 bits of the MD5 of the id, as a whole number."""
    key = F.coalesce(F.col(f"`{id_col}`").cast("string"), F.concat(F.lit("text:"), F.md5(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))))
    return F.conv(F.substring(F.md5(key), 1, HASH_BITS // 4), 16, 10).cast("long")


def size_of(text_col: str):
    return F.coalesce(F.octet_length(F.col(f"`{text_col}`")), F.lit(0)).cast("long")


def _page(rows: DataFrame, low: int, high: int, limit: int, label: str) -> DataFrame:
    """For each used cell of ``high`` bits below oversized buckets of ``low`` bits: its bucket, or null if it must be split on."""
    cells = materialize(rows.groupBy(F.shiftright("h", HASH_BITS - high).alias("cell")).agg(
        F.sum("bytes").alias("bytes"), F.count("*").alias("rows"), F.min("h").alias("a"), F.max("h").alias("b")), f"{label}-cells")
    levels = cells.select("*", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("depth")).withColumn(
        "prefix", F.expr(f"shiftright(cell, {high} - depth)"))
    buckets = levels.groupBy("depth", "prefix").agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"), F.min("a").alias("a"), F.max("b").alias("b"))
    buckets = materialize(buckets.withColumn("split", (F.col("bytes") > limit) & (F.col("a") < F.col("b"))), f"{label}-buckets")
    # a bucket exists if its parent was split; the first level of a page always exists
    parents = buckets.where("split").select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("parent"))
    made = buckets.withColumn("parent", F.shiftright("prefix", 1)).join(parents.withColumn("yes", F.lit(True)), ["depth", "parent"], "left")
    leaves = made.where((F.col("yes") | (F.col("depth") == low)) & ~F.col("split")).select(
        "depth", "prefix", F.col("bytes").alias("shard_bytes"), F.col("rows").alias("shard_rows"))
    found = levels.select("cell", "depth", "prefix").join(leaves, ["depth", "prefix"])
    return materialize(cells.select("cell").join(found, "cell", "left"), f"{label}-page")


def pages(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit_bytes: int = LIMIT_BYTES, page_bits: int = PAGE_BITS,
          label: str = "sharding") -> list[tuple[int, DataFrame]]:
    """The directory: (bits, page) for one page after another; each row maps a cell of so many bits to its shard."""
    rows = df.select(hash_of(id_col, text_col).alias("h"), size_of(text_col).alias("bytes"))
    out: list[tuple[int, DataFrame]] = []
    low = 0
    while low < HASH_BITS:
        high = min(HASH_BITS, low + page_bits)
        page = _page(rows, low, high, limit_bytes, label)
        out.append((high, page.where("depth is not null")))
        rest = page.where("depth is null").select(F.col("cell").alias("over"))
        if rest.isEmpty():
            break
        rows = rows.join(broadcast_if_small(rest), F.shiftright("h", HASH_BITS - high) == F.col("over"), "left_semi")
        low = high
    return out


def assign(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit_bytes: int = LIMIT_BYTES, page_bits: int = PAGE_BITS,
           label: str = "sharding") -> DataFrame:
    """One row per row of ``df``: id, ``bytes``, ``shard`` (its leading bits as text), ``depth``, ``shard_bytes``, ``shard_rows``, ``fits``."""
    directory = pages(df, id_col, text_col, limit_bytes, page_bits, label)
    rows = df.select(F.col(f"`{id_col}`").alias("__id"), hash_of(id_col, text_col).alias("h"), size_of(text_col).alias("bytes"))
    parts = ["depth", "prefix", "shard_bytes", "shard_rows"]
    for k, (bits, page) in enumerate(directory):
        page = page.select(F.col("cell").alias("__cell"), F.struct(*parts).alias(f"p{k}"))
        rows = rows.join(broadcast_if_small(page), F.shiftright("h", HASH_BITS - bits) == F.col("__cell"), "left").drop("__cell")
    found = F.coalesce(*[F.col(f"p{k}") for k in range(len(directory))])
    rows = rows.withColumn("s", found)
    shard = F.when(F.col("s.depth") == 0, "").otherwise(F.expr("lpad(bin(s.prefix), s.depth, '0')"))
    return rows.select(F.col("__id").alias(id_col), "bytes", shard.alias("shard"), F.col("s.depth").cast("long").alias("depth"),
                       F.col("s.shard_bytes").alias("shard_bytes"), F.col("s.shard_rows").alias("shard_rows"),
                       (F.col("s.shard_bytes") <= limit_bytes).alias("fits"))


def write_shards(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit_bytes: int = LIMIT_BYTES) -> None:
    """Write ``df`` as Parquet, one folder ``shard=<bits>`` per shard, each written by one task (a shard is bounded)."""
    directory = pages(df, id_col, text_col, limit_bytes)
    # the row is one struct beside names of our own, so any name but that of the folders may be its
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), hash_of(id_col, text_col).alias("h"))
    for k, (bits, page) in enumerate(directory):
        page = page.select("cell", F.struct("depth", "prefix").alias(f"p{k}"))
        rows = rows.join(broadcast_if_small(page), F.shiftright("h", HASH_BITS - bits) == F.col("cell"), "left").drop("cell")
    rows = rows.withColumn("s", F.coalesce(*[F.col(f"p{k}") for k in range(len(directory))]))
    name = F.concat(F.lit("b"), F.when(F.col("s.depth") == 0, "").otherwise(F.expr("lpad(bin(s.prefix), s.depth, '0')")))
    folder = "__shard"
    while folder in df.columns:
        folder += "_"
    rows.select(*[F.col("row").getField(c).alias(c) for c in df.columns], name.alias(folder)).repartition(folder).write.partitionBy(folder).parquet(path)


def oracle(limit_bytes: int = LIMIT_BYTES, depth: int = 24) -> str:
    return f"""
WITH rows AS (
  SELECT doc_id, ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'text:' || md5(coalesce(text, '')))), 1, 15))::BIGINT AS h,
         coalesce(strlen(text), 0)::BIGINT AS bytes FROM documents),
nodes AS (
  SELECT d AS depth, h >> ({HASH_BITS} - d)::INT AS prefix, sum(bytes) AS bytes, count(*) AS rows, min(h) < max(h) AS many
  FROM rows, range(0, {depth}) t(d) GROUP BY ALL),
leaves AS (
  SELECT n.* FROM nodes n LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.prefix = n.prefix >> 1
  WHERE NOT (n.bytes > {limit_bytes} AND n.many) AND (n.depth = 0 OR (p.bytes > {limit_bytes} AND p.many)))
SELECT r.doc_id, r.bytes, CASE WHEN l.depth = 0 THEN '' ELSE lpad(bin(l.prefix), l.depth::INT, '0') END AS shard, l.depth::BIGINT AS depth,
       l.bytes::BIGINT AS shard_bytes, l.rows::BIGINT AS shard_rows, l.bytes <= {limit_bytes} AS fits
FROM rows r JOIN leaves l ON l.prefix = r.h >> ({HASH_BITS} - l.depth)::INT"""
