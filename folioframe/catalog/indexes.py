"""Registered index queries (IX)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import index as I
from ..operators.store import LexicalStore
from ..operators.vectors import VectorStore
from ..session import broadcast_if_small, shared_dir
from .data import BM25, WS, corpus, kept_index, questions, sql_strip
from .registry import query


@query("ix1_postings", f"WITH {BM25} SELECT doc_id AS chunk_id, term, tf, dl FROM post JOIN dl USING (doc_id)")
def ix1(t):
    return I.build_postings(corpus(t))


@query("ix1_kept_postings", f"WITH {BM25} SELECT doc_id AS chunk_id, term, tf, dl FROM post JOIN dl USING (doc_id)")
def ix1k(t):
    return kept_index(t).postings()


@query("ix2_okapi_idf", f"WITH {BM25} SELECT term, df, round(idf, 9) AS idf FROM idf")
def ix2(t):
    index = kept_index(t)
    return I.okapi_idf(index.term_df(), index.stats()).select("term", "df", F.round("idf", 9).alias("idf"))


@query("ix3_index_stats", f"WITH {BM25} SELECT n AS document_count, round(avgdl, 9) AS average_tokens, 1.5::DOUBLE AS k1, 0.75::DOUBLE AS b FROM stats")
def ix3(t):
    return I.index_stats(I.doc_lengths(corpus(t))).withColumn("average_tokens", F.round("average_tokens", 9))


# the stored index: labelled documents; the batch: documents of good quality plus the unlabelled ones, in lower case
def stored(t):
    return t.documents.join(t.labels, "doc_id").select(F.col("doc_id").alias("chunk_id"), "text", "lang", "quality")


def batch(t):
    return t.documents.join(t.labels, "doc_id", "left").filter("quality IS NULL OR quality = 1").select(
        F.col("doc_id").alias("chunk_id"), F.lower("text").alias("text"), "lang", "quality")


STORED = "stored AS (SELECT doc_id AS chunk_id, text, lang, quality FROM documents JOIN labels USING (doc_id))"
BATCH = ("batch AS (SELECT doc_id AS chunk_id, lower(text) AS text, lang, quality FROM documents LEFT JOIN labels USING (doc_id) "
         "WHERE quality IS NULL OR quality = 1)")


@query("ix4_upsert_chunks", f"WITH {STORED}, {BATCH} SELECT chunk_id, md5(text) AS text FROM batch UNION ALL SELECT chunk_id, md5(text) FROM stored WHERE quality <> 1")
def ix4(t):
    return I.upsert_chunks(stored(t), batch(t)).select("chunk_id", F.md5("text").alias("text"))


@query("ix4_remove_chunks", f"WITH {STORED} SELECT chunk_id, lang FROM stored WHERE quality <> 1")
def ix4r(t):
    return I.remove_chunks(stored(t), batch(t)).select("chunk_id", "lang")


def maintained(t):
    """A kept index of the labelled documents, then the batch upserted, French documents removed, and all of it compacted."""
    store = LexicalStore.create(t.spark, shared_dir(t.spark, "lexical-maintained"), buckets=t.spark.sparkContext.defaultParallelism)
    store.upsert(stored(t).select("chunk_id", "text"))
    store.upsert(batch(t).select("chunk_id", "text"))
    store.remove(t.documents.filter("lang = 'fr'").select(F.col("doc_id").alias("chunk_id")))
    store.compact(dead_share=0.0, max_segments=1)
    return store


# the same rows as an index built anew from what is left
LEFT = f"""{STORED}, {BATCH}, documents_left AS (SELECT chunk_id AS doc_id, text FROM (SELECT chunk_id, text FROM batch UNION ALL SELECT chunk_id, text FROM stored WHERE quality <> 1)
  WHERE chunk_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'fr'))"""
BM25_LEFT = BM25.replace("FROM documents", "FROM documents_left")


@query("ix4_maintained_search", f"WITH {LEFT}, {BM25_LEFT} SELECT query_id, doc_id, score, rank FROM bm25")
def ix4m(t):
    return maintained(t).search(questions(t), 20)


@query("ix7_maintained_terms", f"WITH {LEFT}, {BM25_LEFT} SELECT term, df, round(idf, 9) AS idf FROM idf")
def ix7m(t):
    index = maintained(t)
    return I.okapi_idf(index.term_df(), index.stats()).select("term", "df", F.round("idf", 9).alias("idf"))


@query("ix9_store_sync", """WITH kept AS (SELECT d.doc_id, quality, lang FROM documents d JOIN labels USING (doc_id)), want AS (SELECT doc_id, lang FROM documents WHERE lang <> 'de')
SELECT (SELECT count(*) FROM want WHERE doc_id NOT IN (SELECT doc_id FROM kept WHERE quality <> 1)) AS indexed,
  (SELECT count(*) FROM kept WHERE doc_id NOT IN (SELECT doc_id FROM want)) AS removed, (SELECT count(*) FROM kept WHERE quality <> 1 AND doc_id IN (SELECT doc_id FROM want)) AS skipped""")
def ix9s(t):
    # stored texts of good quality have an addition, so their documents count as changed
    store = LexicalStore.create(t.spark, shared_dir(t.spark, "lexical-sync"), buckets=t.spark.sparkContext.defaultParallelism)
    store.upsert(stored(t).select("chunk_id", F.when(F.col("quality") == 1, F.concat("text", F.lit(" old"))).otherwise(F.col("text")).alias("text")))
    counts = store.sync(t.documents.filter("lang <> 'de'").select(F.col("doc_id").alias("chunk_id"), "text"))
    return t.spark.createDataFrame([tuple(counts[c] for c in ("indexed", "removed", "skipped"))], "indexed long, removed long, skipped long")


@query("ix5_add_vectors", """SELECT v.vec_id AS chunk_id, v.label AS label, round(list_sum([x::DOUBLE * x for x in embedding]), 5) AS norm2 FROM embeddings v
UNION ALL SELECT d.doc_id, -1, 0.0 FROM documents d WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)""")
def ix5(t):
    have = t.embeddings.select(F.col("vec_id").alias("chunk_id"), "embedding", "label")
    new = t.documents.select(F.col("doc_id").alias("chunk_id"), F.array_repeat(F.lit(0.0).cast("float"), 64).alias("embedding"),
                             F.lit(-1).alias("label"))
    norm = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return I.add_vectors(have, new).select("chunk_id", "label", F.round(norm, 5).alias("norm2"))


@query("ix6_delete_where", f"WITH {STORED} SELECT chunk_id, lang FROM stored WHERE NOT (lang = 'en' AND quality = 0)")
def ix6(t):
    return I.delete_where(stored(t), (F.col("lang") == "en") & (F.col("quality") == 0)).select("chunk_id", "lang")


@query("ix7_replace_page_chunks", """SELECT page_id, chunk_id, revision FROM (
  SELECT conv_id AS page_id, conv_id * 100 + turn AS chunk_id, 1::BIGINT AS revision, max(turn) OVER (PARTITION BY conv_id) AS n FROM conversations)
  WHERE n < 4 UNION ALL SELECT conv_id, conv_id * 100 + turn + 50, 2 FROM (SELECT *, max(turn) OVER (PARTITION BY conv_id) AS n FROM conversations)
  WHERE n >= 4 AND role = 'user' AND length(text) > 200""")
def ix7(t):
    # conversations are pages; those of five turns or more are re-indexed with their long user turns, some with none
    current = t.conversations.select(F.col("conv_id").alias("page_id"), (F.col("conv_id") * 100 + F.col("turn")).alias("chunk_id"),
                                     F.lit(1).alias("revision"))
    long_ = t.conversations.groupBy("conv_id").agg(F.max("turn").alias("n")).filter("n >= 4")
    fresh = t.conversations.join(long_, "conv_id").filter("role = 'user' AND length(text) > 200").select(
        F.col("conv_id").alias("page_id"), (F.col("conv_id") * 100 + F.col("turn") + 50).alias("chunk_id"), F.lit(2).alias("revision"))
    return I.replace_page_chunks(current, fresh, long_.select(F.col("conv_id").alias("page_id")))


def file_chunks(t):
    """Order lines as chunks of a file per supplier, the ship date being the modification time."""
    return t.lineitem.select(
        F.concat(F.lit("f"), F.col("l_suppkey").cast("string")).alias("filename"),
        F.when(F.col("l_returnflag") == "N", "note").otherwise("doc").alias("source_type"),
        F.unix_timestamp("l_shipdate").cast("double").alias("mtime"))


@query("ix8_indexed_mtimes", "SELECT 'f' || l_suppkey AS filename, max(epoch(l_shipdate))::DOUBLE AS indexed_mtime FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1")
def ix8(t):
    return I.indexed_mtimes(file_chunks(t))


SYNC = """have AS (SELECT 'f' || l_suppkey AS filename, max(epoch(l_shipdate))::DOUBLE AS m FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1),
disk AS (SELECT 'f' || l_suppkey AS filename, max(epoch(l_shipdate))::DOUBLE AS d FROM lineitem WHERE l_quantity > 10 AND l_suppkey > 5 GROUP BY 1
  UNION ALL SELECT 'new' || s_suppkey, 1.0 FROM supplier),
plan AS (SELECT coalesce(disk.filename, have.filename) AS filename, CASE WHEN disk.filename IS NULL THEN 'clean' WHEN have.filename IS NULL OR m < d THEN 'reindex' ELSE 'skip' END AS action
  FROM disk FULL JOIN have ON disk.filename = have.filename)"""


def sync(t):
    disk = t.lineitem.filter("l_quantity > 10 AND l_suppkey > 5").groupBy(
        F.concat(F.lit("f"), F.col("l_suppkey").cast("string")).alias("filename")).agg(
        F.max(F.unix_timestamp("l_shipdate").cast("double")).alias("mtime"))
    new = t.supplier.select(F.concat(F.lit("new"), F.col("s_suppkey").cast("string")).alias("filename"), F.lit(1.0).alias("mtime"))
    return I.sync_plan(disk.unionByName(new), file_chunks(t))


@query("ix9_sync_plan", f"WITH {SYNC} SELECT * FROM plan")
def ix9(t):
    return sync(t).select("filename", "action")


@query("ix9_sync_counts", f"""WITH {SYNC} SELECT count(*) FILTER (action <> 'clean') AS total, count(*) FILTER (action = 'reindex') AS reindexed,
  count(*) FILTER (action = 'skip') AS skipped, count(*) FILTER (action = 'clean') AS cleaned FROM plan""")
def ix9c(t):
    return I.sync_counts(sync(t))


@query("ix10_index_version")
def ix10(t):
    return I.index_version(corpus(t))


@query("ix11_embedding_profile", rf"""SELECT l_orderkey, l_linenumber::BIGINT AS line, l_partkey, CASE WHEN l_returnflag = 'R' THEN 'local' ELSE 'online' END AS provider,
  CASE WHEN l_returnflag = 'R' THEN '_my base/' || l_suppkey ELSE regexp_replace(regexp_replace(regexp_replace('_my base/' || l_suppkey, '[^A-Za-z0-9._-]+', '-', 'g'),
   '^[._-]+|[._-]+$', '', 'g')[1:49], '[._-]+$', '') || '-' || sha256('online|http://x/' || l_partkey || '|m|' || l_linenumber)[1:12] END AS profile FROM lineitem""")
def ix11(t):
    rows = t.lineitem.select(
        "l_orderkey", F.col("l_linenumber").alias("line"), "l_partkey",
        F.when(F.col("l_returnflag") == "R", "local").otherwise("online").alias("provider"),
        F.concat(F.lit("_my base/"), F.col("l_suppkey").cast("string")).alias("base"),
        F.concat(F.lit(" http://x/"), F.col("l_partkey").cast("string"), F.lit("//")).alias("url"), F.lit("m ").alias("model"))
    return rows.select("l_orderkey", "line", "l_partkey", "provider",
                       I.embedding_profile("base", "provider", "url", "model", "line").alias("profile"))


@query("ix12_validate_vectors", """SELECT vec_id AS id, CASE WHEN label = 0 THEN 'missing' WHEN label = 1 THEN 'empty' WHEN label = 2 THEN 'dimension' ELSE 'not_finite' END AS problem
FROM embeddings WHERE label <= 3""")
def ix12(t):
    label, v = F.col("label"), F.col("embedding")
    broken = (F.when(label == 0, F.lit(None)).when(label == 1, F.slice(v, 1, 0)).when(label == 2, F.slice(v, 1, 63))
              .when(label == 3, F.transform(v, lambda x: x * F.lit(float("nan")).cast("float"))).otherwise(v))
    return I.validate_vectors(t.embeddings.select("vec_id", broken.alias("embedding")), "vec_id")


@query("ix12_validate_batches", """WITH req AS (SELECT vec_id // 8 AS batch, count(*) AS n FROM embeddings WHERE vec_id // 8 % 11 <> 3 GROUP BY 1),
ans AS (SELECT vec_id // 8 AS batch, vec_id % 8 + CASE WHEN vec_id % 29 = 0 THEN 1 ELSE 0 END AS i FROM embeddings WHERE NOT (label = 0 AND vec_id % 5 = 0)),
per AS (SELECT batch, count(*) AS c, count(DISTINCT i) AS d, min(i) AS lo, max(i) AS hi FROM ans GROUP BY 1)
SELECT batch, CASE WHEN n IS NULL THEN 'unknown' WHEN coalesce(c, 0) <> n THEN 'count' ELSE 'index' END AS problem FROM req FULL JOIN per USING (batch)
WHERE n IS NULL OR coalesce(c, 0) <> n OR d <> n OR lo <> 0 OR hi <> n - 1""")
def ix12b(t):
    batch = F.floor(F.col("vec_id") / 8).alias("batch")
    requests = t.embeddings.groupBy(batch).agg(F.count("*").alias("n_inputs")).filter("batch % 11 <> 3")
    answers = t.embeddings.filter("NOT (label = 0 AND vec_id % 5 = 0)").select(batch, (F.col("vec_id") % 8 + F.when(F.col("vec_id") % 29 == 0, 1).otherwise(0)).alias("index"))
    return I.validate_batches(requests, answers)


@query("ix13_embed", rf"""SELECT doc_id, CASE WHEN regexp_matches(text, '^{WS}*$') THEN 0.0 ELSE length(regexp_replace(text, '\A{WS}+|{WS}+\z', '', 'g'))::DOUBLE END AS first FROM documents""")
def ix13(t):
    def lengths(text):
        return F.array(F.length(text).cast("double"), F.lit(1.0))
    return I.embed(t.documents, lengths, 2).select("doc_id", F.col("embedding")[0].alias("first"))


def labelled(t):
    """Texts of the labelled documents. Ids are eight bytes each, so more of them than of other rows are sent to the texts, which stay where they are."""
    return t.documents.join(broadcast_if_small(t.labels.select("doc_id"), 2_000_000), "doc_id", "left_semi").select("text")


def embedding_store(t):
    """Labelled documents first, then all of them with German ones in lower case; the second batch is run twice, and once more as a third."""
    def lengths(text):
        return F.array(F.length(text).cast("float"), F.lit(1.0).cast("float"))
    store = VectorStore(t.spark, shared_dir(t.spark, "vectors"))
    store.add(labelled(t), lengths, 2, "lengths-2", "1")
    now = t.documents.select("doc_id", F.when(F.col("lang") == "de", F.lower("text")).otherwise(F.col("text")).alias("text"))
    for name in ("2", "3", "2"):
        store.add(now, lengths, 2, "lengths-2", name)
    return store, now


NOW = f"now AS (SELECT doc_id, {sql_strip("CASE WHEN lang = 'de' THEN lower(text) ELSE text END")} AS k FROM documents)"


# what the model was asked for: the third batch and the repeated one add nothing
@query("ix13_kept_embeddings", f"""WITH {NOW}, a AS (SELECT DISTINCT {sql_strip('text')} AS k FROM documents JOIN labels USING (doc_id))
SELECT '1' AS batch, count(*) AS embedded FROM a WHERE k <> '' UNION ALL SELECT '2', count(DISTINCT k) FROM now WHERE k <> '' AND k NOT IN (SELECT k FROM a)""")
def ix13k(t):
    return embedding_store(t)[0].vectors("lengths-2").groupBy("batch").agg(F.count("*").alias("embedded"))


@query("ix13_store_embed", f"WITH {NOW} SELECT doc_id, length(k)::DOUBLE AS first FROM now")
def ix13s(t):
    store, now = embedding_store(t)
    return store.embed(now, 2, "lengths-2").select("doc_id", F.col("embedding")[0].alias("first"))
