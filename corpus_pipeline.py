"""A training corpus from raw documents: five stages, each written as Parquet and read again by the next.

1. quality rules: documents that fail a hard limit or lie far outside their language and source are left out
2. line deduplication: lines that match an earlier line of the corpus are taken out of the texts
3. near-duplicates: one document of each group stays whose sets of five-word shingles have a Jaccard similarity of 0.8 or more;
   SimHash names the first pairs, a join on rare shingles those that its bits miss, and every pair is checked on the whole sets
4. mixing: documents are taken, or repeated, so that sources have tempered weights
5. encoding: doc_id, lang and source with the token ids of what is left; other columns end here

All stages but the last return the columns they were given, whatever these are called. Null and empty texts fail the quality rules;
a text whose lines all go stays as an empty text, and the empty texts are one group of near-duplicates. Rows that repeat an id and a
text are one document from the third stage on; rows without an id are documents too. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folioframe.llm import bpe, linedup, mixing, neardup, quality
from folioframe.llm.common import read_documents
from folioframe.session import materialize

SHINGLE_WORDS = 5
MIX_ENTROPY = 0.95
MIX_BUDGET = 1.0
MIX_REPEATS = 4.0


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, label="pipeline-quality")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return linedup.dedupe(docs, label="pipeline-lines")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.keep_one(docs, words=SHINGLE_WORDS, label="pipeline-neardup")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs, entropy=MIX_ENTROPY, max_repeats=MIX_REPEATS, budget_ratio=MIX_BUDGET, label="pipeline-mixing")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode(docs, ["doc_id", "lang", "source"])


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mix_sources", mix_sources), ("encode", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


# fingerprints by XXH64 and byte-pair encoding have no SQL form; tests hold the pipeline against a plain version
ORACLE_SQL = None
