"""Substring search for many search texts at once, through postings of distinct trigrams.

A row that holds a search text holds every trigram of it. Trigrams are taken inside the row, so nothing but (gram, id) leaves the
map stage; a table of them is kept sorted by gram and answers any number of search texts. Of a search text only its ``RAREST``
trigrams are looked up, rows that have them all are candidates, and candidates are compared with the whole text. Search texts of one
or two symbols are looked up in the trigrams that hold them; texts of less than three symbols are their own gram.

Letter case is folded as in ``like_literal``. Null texts hold nothing, null or empty search texts are found nowhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.common import casefold
from ..session import broadcast_if_small, materialize

RAREST = 3


def grams(text: Column) -> Column:
    """Distinct overlapping triples of symbols of a folded text; a shorter text is one gram."""
    return F.when(F.length(text) >= 3, F.array_distinct(F.regexp_extract_all(text, F.lit("(?s)(?=(...))"), 1))).when(F.length(text) > 0, F.array(text))


def build_grams(rows: DataFrame, id_col: str, text: str) -> DataFrame:
    """Table (gram, id), sorted by gram within its files so that a search reads few row groups."""
    posted = rows.select(F.col(id_col).alias("id"), F.explode_outer(grams(casefold(text))).alias("gram")).filter("gram IS NOT NULL")
    return materialize(posted.select("gram", "id").repartitionByRange("gram", "id").sortWithinPartitions("gram", "id"), "grams")


def find_containing(table: DataFrame, rows: DataFrame, searches: DataFrame, id_col: str, text: str, search_id: str = "search_id", needle: str = "needle") -> DataFrame:
    """(search_id, id) of all rows of ``rows`` whose text contains the search text, case folded. ``table`` is theirs by ``build_grams``."""
    asked = searches.select(F.col(search_id).alias("search_id"), casefold(needle).alias("needle")).filter(F.length("needle") > 0)
    asked = materialize(asked, "gram-searches")
    long_ = asked.filter(F.length("needle") >= 3).select("search_id", F.explode(grams(F.col("needle"))).alias("gram"))
    short = asked.filter(F.length("needle") < 3)
    wanted = broadcast_if_small(long_.select("gram").distinct())
    held = table.join(wanted, "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("df"))
    ranked = long_.join(held, "gram", "left").groupBy("search_id").agg(
        F.slice(F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "gram"))), 1, RAREST).alias("few"))      # a search text's grams
    picked = ranked.select("search_id", F.size("few").alias("n"), F.explode("few.gram").alias("gram"))
    candidates = table.join(broadcast_if_small(picked), "gram").groupBy("search_id", "id").agg(F.count("*").alias("hits"), F.max("n").alias("n")).filter("hits = n")
    # the few grams of the alphabet that hold a short text
    spelled = table.select("gram").distinct().join(F.broadcast(short.select("needle").distinct()) if short.limit(1).count() else short.select("needle"), F.contains("gram", "needle"))
    brief = table.join(broadcast_if_small(spelled), "gram").join(short, "needle").select("search_id", "id").distinct()
    pairs = candidates.select("search_id", "id").unionByName(brief)
    texts = rows.select(F.col(id_col).alias("id"), casefold(text).alias("_text"))
    return pairs.join(broadcast_if_small(asked), "search_id").join(texts, "id").filter(F.contains("_text", "needle")).select("search_id", "id").distinct()
