"""Index tables: postings, term statistics, vectors; incremental maintenance and checks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import settings as S
from ..functions.common import let, strip
from ..functions.tokens import tokenize, tokenize_eval


# --- inverted index -----------------------------------------------------------------------

def counted_terms(chunks: DataFrame, id_col: str = "chunk_id", text: str = "text", mode: str = "search") -> DataFrame:
    """(chunk_id, text, dl, terms): the terms of each text with their counts, as array<struct<term, tf>>.

    Terms are counted inside the row: the sorted tokens are cut at their changes, and the length of a
    run is the term's count. Texts and tokens stay in their map stage, nothing is shuffled.
    """
    def runs(t: Column) -> Column:
        # where a run begins; the place after the last one closes the list
        heads = F.filter(F.transform(t, lambda x, i: F.when((i == 0) | (x != F.get(t, i - 1)), i)), lambda i: i.isNotNull())
        return let(F.concat(heads, F.array(F.size(t))), lambda h: F.transform(
            F.slice(h, F.lit(1), F.size(h) - 1), lambda at, i: F.struct(F.get(t, at).alias("term"), (F.get(h, i + 1) - at).alias("tf"))))

    # bound variables, not projections: the optimizer may not repeat the tokenizer in a lambda
    tokens = F.sort_array(tokenize(text) if mode == "search" else tokenize_eval(text))
    rows = chunks.select(F.col(id_col).alias("chunk_id"), F.col(text).alias("text"), let(tokens, runs).alias("terms"))
    return rows.select("chunk_id", "text", F.aggregate("terms", F.lit(0), lambda n, x: n + x["tf"]).alias("dl"), "terms")


def build_postings(chunks: DataFrame, id_col: str = "chunk_id", text: str = "text",
                   mode: str = "search") -> DataFrame:
    """postings(chunk_id, term, tf, dl); a text without terms has none."""
    rows = counted_terms(chunks, id_col, text, mode)
    # the outer form, as before an inner one a filter on the size of the list would count every text twice
    return rows.select("chunk_id", "dl", F.inline_outer("terms")).filter("term IS NOT NULL").select("chunk_id", "term", "tf", "dl")


def doc_lengths(chunks: DataFrame, id_col: str = "chunk_id", text: str = "text",
                mode: str = "search") -> DataFrame:
    """doc_stats(chunk_id, dl), documents without tokens included."""
    tokens = tokenize(text) if mode == "search" else tokenize_eval(text)
    return chunks.select(F.col(id_col).alias("chunk_id"), F.size(tokens).alias("dl"))


def corpus_stats(doc_stats: DataFrame) -> DataFrame:
    """One row: documents and average length."""
    return doc_stats.agg(F.count("*").alias("n_docs"),
                         F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avgdl"))


def document_frequencies(postings: DataFrame) -> DataFrame:
    """(term, df, cf): documents holding a term and its occurrences."""
    # the test on cf keeps both columns in every use, so that all uses share one exchange
    return postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf")).filter("cf > 0")


def raw_idf(df="df", n_docs="n_docs"):
    return F.log(F.col(n_docs) - F.col(df) + 0.5) - F.log(F.col(df) + 0.5)


def index_constants(term_df: DataFrame, n_docs: DataFrame) -> DataFrame:
    """One row n_docs, avgdl, mean_idf (over the vocabulary, negative values included).

    The vocabulary is first counted per distinct document frequency, a small table.
    """
    per_df = term_df.groupBy("df").agg(F.count("*").alias("_n"), F.sum("cf").alias("_len"))
    return per_df.join(F.broadcast(n_docs.select("n_docs"))).groupBy("n_docs").agg(      # n_docs is one row
        (F.sum(raw_idf() * F.col("_n")) / F.sum("_n")).alias("mean_idf"),
        (F.sum("_len") / F.col("n_docs")).alias("avgdl"))


def floored_idf(epsilon: float = S.BM25_EPSILON):
    """idf column from df, n_docs and mean_idf: negative idf becomes ``epsilon`` times the mean."""
    return F.when(raw_idf() < 0, F.col("mean_idf") * epsilon).otherwise(raw_idf())


def okapi_idf(term_df: DataFrame, stats: DataFrame, epsilon: float = S.BM25_EPSILON) -> DataFrame:
    """term_stats(term, df, idf); ``stats`` is the one-row table with n_docs and mean_idf."""
    return term_df.join(F.broadcast(stats)).select("term", "df", floored_idf(epsilon).alias("idf"))


def index_stats(doc_stats: DataFrame, k1: float = S.BM25_K1, b: float = S.BM25_B) -> DataFrame:
    return corpus_stats(doc_stats).select(
        F.col("n_docs").alias("document_count"), F.col("avgdl").alias("average_tokens"),
        F.lit(k1).alias("k1"), F.lit(b).alias("b"))


# --- incremental maintenance --------------------------------------------------------------

def upsert_chunks(current: DataFrame, batch: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Rows of the batch replace those with the same id; others are added."""
    return current.join(batch.select(key).distinct(), key, "left_anti").unionByName(batch)


def remove_chunks(current: DataFrame, ids: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Absent ids are ignored."""
    return current.join(ids.select(key).distinct(), key, "left_anti")


def add_vectors(current: DataFrame, batch: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Insert-if-absent append."""
    return current.unionByName(batch.dropDuplicates([key]).join(current.select(key), key, "left_anti"))


def delete_where(current: DataFrame, predicate: Column) -> DataFrame:
    return current.filter(~F.coalesce(predicate, F.lit(False)))


def replace_page_chunks(current: DataFrame, fresh: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """All chunks of a re-indexed page are replaced by those of its new revision.

    ``pages`` (page_id) names the re-indexed pages; one that yields no chunk loses those it had.
    """
    done = fresh.select("page_id") if pages is None else pages.select("page_id").unionByName(fresh.select("page_id"))
    return current.join(done.distinct(), "page_id", "left_anti").unionByName(
        fresh, allowMissingColumns=True)


def indexed_mtimes(chunks: DataFrame) -> DataFrame:
    return chunks.filter(F.col("source_type") == "doc").groupBy("filename").agg(
        F.max(F.coalesce("mtime", F.lit(0.0))).alias("indexed_mtime"))


def sync_plan(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """(filename, action): reindex new or newer files, skip unchanged, clean vanished."""
    have = indexed_mtimes(chunks).withColumn("_indexed", F.lit(True))
    disk = files.select("filename", F.col("mtime").alias("disk_mtime")).withColumn("_disk", F.lit(True))
    return disk.join(have, "filename", "full_outer").select(
        "filename", "disk_mtime", "indexed_mtime",
        F.when(F.col("_disk").isNull(), "clean")
        .when(F.col("_indexed").isNull() | (F.col("indexed_mtime") < F.col("disk_mtime")), "reindex")
        .otherwise("skip").alias("action"))


def sync_counts(plan: DataFrame) -> DataFrame:
    return plan.agg(F.count_if(F.col("action") != "clean").alias("total"),
                    *[F.count_if(F.col("action") == a).alias(n) for a, n in
                      (("reindex", "reindexed"), ("skip", "skipped"), ("clean", "cleaned"))])


def index_version(chunks: DataFrame, key: str = "chunk_id", text: str = "text") -> DataFrame:
    """``count:fingerprint`` derived from the contents, so equal-sized edits change it too."""
    return chunks.agg(F.concat_ws(
        ":", F.count("*").cast("string"),
        F.coalesce(F.hex(F.bit_xor(F.xxhash64(key, text))), F.lit("0"))).alias("index_version"))


def embedding_profile(base, provider, url, model, dims) -> Column:
    """Collection name of an embedding configuration; a partition key that keeps spaces apart."""
    base, provider = F.col(base), F.col(provider)
    profile = F.concat_ws("|", strip(provider), F.regexp_replace(strip(url), "/+$", ""), strip(model),
                          F.coalesce(F.col(dims), F.lit(0)).cast("string"))
    edge = r"\A[._-]+|[._-]+\z"
    safe = F.regexp_replace(F.regexp_replace(base, r"[^A-Za-z0-9._-]+", "-"), edge, "")
    safe = F.coalesce(F.nullif(safe, F.lit("")), F.lit("notes"))
    safe = F.regexp_replace(F.substring(safe, 1, 49), r"[._-]+\z", "")
    safe = F.coalesce(F.nullif(safe, F.lit("")), F.lit("notes"))
    return F.when(provider == "local", base).otherwise(
        F.concat(safe, F.lit("-"), F.substring(F.sha2(profile, 256), 1, 12)))


# --- vectors ------------------------------------------------------------------------------

def validate_vectors(vectors: DataFrame, id_col: str, vec: str = "embedding",
                     dims: int | None = None) -> DataFrame:
    """Violations (id, problem): missing, empty, wrong dimension, not finite.

    Without ``dims`` the most frequent dimension counts as the right one.
    """
    sizes = vectors.groupBy(F.size(vec).alias("_d")).agg(F.count("*").alias("_n"))
    expected = (sizes.filter("_d > 0").agg(F.max_by("_d", F.struct("_n", "_d")).alias("_dims"))
                if dims is None else vectors.sparkSession.range(1).select(F.lit(dims).alias("_dims")))
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    problem = (F.when(F.col(vec).isNull(), "missing").when(F.size(vec) == 0, "empty")
               .when(F.size(vec) != F.col("_dims"), "dimension").when(bad, "not_finite"))
    return vectors.join(F.broadcast(expected)).select(
        F.col(id_col).alias("id"), problem.alias("problem")).filter("problem IS NOT NULL")


def validate_batches(requests: DataFrame, answers: DataFrame) -> DataFrame:
    """Violations (batch, problem) of a model's answers (batch, index) to requests (batch, n_inputs).

    ``count``: not as many answers as inputs; ``index``: the indices are not exactly 0 to n - 1; ``unknown``: no such request.
    """
    per = answers.groupBy("batch").agg(F.count("*").alias("_n"), F.count_distinct("index").alias("_distinct"), F.min("index").alias("_low"), F.max("index").alias("_high"))
    n = F.coalesce("_n", F.lit(0))
    exact = (F.col("_distinct") == F.col("n_inputs")) & (F.col("_low") == 0) & (F.col("_high") == F.col("n_inputs") - 1)
    problem = F.when(F.col("n_inputs").isNull(), "unknown").when(n != F.col("n_inputs"), "count").when((F.col("n_inputs") > 0) & ~F.coalesce(exact, F.lit(False)), "index")
    return requests.select("batch", "n_inputs").join(per, "batch", "full_outer").select("batch", problem.alias("problem")).filter("problem IS NOT NULL")


def embed(texts: DataFrame, embedder, dims: int, text: str = "text") -> DataFrame:
    """Add ``embedding``. Each distinct trimmed text is embedded once; blanks get zero vectors."""
    keyed = texts.withColumn("_key", strip(F.coalesce(F.col(text), F.lit(""))))
    todo = keyed.filter("_key <> ''").select("_key").distinct()
    done = todo.withColumn("_vec", embedder(F.col("_key")))
    return keyed.join(done, "_key", "left").withColumn(
        "embedding", F.coalesce("_vec", F.array_repeat(F.lit(0.0), dims))).drop("_key", "_vec")


def hashed_term_vectors(postings: DataFrame, id_col: str, dims: int = 64) -> DataFrame:
    """Model-free vectors: term counts folded into ``dims`` slots by the md5 of the term.

    Runs inside the per-document partitioning of the postings.
    """
    slot = F.conv(F.substring(F.md5("term"), 1, 8), 16, 10).cast("long") % dims
    folded = postings.groupBy(id_col, slot.alias("_slot")).agg(F.sum("tf").cast("double").alias("_w")).groupBy(
        id_col).agg(F.map_from_entries(F.collect_list(F.struct("_slot", "_w"))).alias("_m"))   # at most dims entries
    return folded.select(id_col, F.transform(
        F.sequence(F.lit(0).cast("long"), F.lit(dims - 1).cast("long")),
        lambda i: F.coalesce(F.try_element_at("_m", i), F.lit(0.0))).alias("embedding"))


def _fold(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[pa.RecordBatch]:
    """(id, embedding) of rows (id, terms); a batch's distinct terms are hashed once."""
    for batch in batches:
        names, counts = batch.column(1).flatten().flatten()
        coded = names.dictionary_encode()
        slots = np.array([int.from_bytes(hashlib.md5(t).digest()[:4]) % dims for t in coded.dictionary.cast(pa.binary()).to_pylist()], dtype=np.int64)
        doc = pc.list_parent_indices(batch.column(1)).to_numpy(zero_copy_only=False).astype(np.int64)
        sums = np.bincount(doc * dims + slots[coded.indices.to_numpy(zero_copy_only=False)], weights=counts.to_numpy(zero_copy_only=False), minlength=len(batch) * dims)
        offsets = pa.array(np.arange(len(batch) + 1, dtype=np.int32) * dims)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(sums))], ["id", "embedding"])


def folded_term_vectors(rows: DataFrame, id_col: str = "chunk_id", dims: int = 64) -> DataFrame:
    """``hashed_term_vectors`` of rows that hold all terms of an id (``counted_terms``): a map stage, no posting is shuffled."""
    table = rows.filter(F.size("terms") > 0).select(F.col(id_col).alias("id"), F.expr("transform(terms, t -> struct(t.term AS term, t.tf AS tf))").alias("terms"))
    return table.mapInArrow(lambda batches: _fold(batches, dims), f"id {dict(table.dtypes)['id']}, embedding array<double>").withColumnRenamed("id", id_col)
