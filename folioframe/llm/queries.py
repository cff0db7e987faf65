"""Registered queries of the ten operators and of the pipeline: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from . import bpe, langid, linedup, media, mixing, negatives, pagetext, pii, quality, secrets, sharding, simhash, turns
from .common import read_documents, read_table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = simhash.near_duplicates(read_documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again."""
    return bpe.round_trip(read_documents(spark, sf_dir))


@query
def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdict of every document."""
    return quality.rate(read_documents(spark, sf_dir))


@query
def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document."""
    return langid.identify(read_documents(spark, sf_dir))


@query
def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document."""
    return secrets.report(read_documents(spark, sf_dir))


@query
def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard of every document."""
    return sharding.assign(read_documents(spark, sf_dir))


ORACLES["op5_sharding"] = sharding.oracle()


@query
def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every copy of a document that the mixture takes."""
    return mixing.select(read_documents(spark, sf_dir))


ORACLES["op2_mixing"] = mixing.oracle()


@query
def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    return pii.report(read_documents(spark, sf_dir))


@query
def op4_linedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without lines that match an earlier one: counts and digest of the text that is left."""
    docs = read_documents(spark, sf_dir).select("doc_id", "text")
    return linedup.dedupe(docs, counts=True).select("doc_id", F.col("__lines").alias("n_lines"), F.col("__gone").alias("n_removed"), F.md5("text").alias("text_md5"))


ORACLES["op4_linedup"] = linedup.oracle()


@query
def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a progressive JPEG file, read back."""
    return media.digests(read_documents(spark, sf_dir))


@query
def op11_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation damaged and repaired again: counts of faults, cheapest edits, digest."""
    return turns.report(read_table(spark, sf_dir, "conversations"))


@query
def op12_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return pagetext.extract(read_table(spark, sf_dir, "pages"), ["page_id", "url"])


@query
def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector."""
    return negatives.report(read_table(spark, sf_dir, "embeddings"))


ORACLES["op13_negatives"] = negatives.oracle()


@query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents."""
    return corpus_pipeline.run(spark, sf_dir)


if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
