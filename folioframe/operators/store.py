"""A kept lexical index: segments of Parquet that searches read, kept up to date without building it anew.

Below one folder of a shared file system:

- a segment per batch has its documents (id, text fingerprint, length, counted terms). Its postings are written when ``scores`` or
  ``survivors`` first ask for them, once per application: one row per term and block of about ``block_docs`` documents of like length,
  with the block's largest count and smallest length, which bound every contribution whatever the average length becomes. Postings are
  bucketed by block, so sums and bounds are computed where the rows lie, and the number of buckets grows with them;
- delete marks: (segment, id) of revisions that a later batch replaced or removed;
- term statistics as signed additions per batch, so document frequencies stay exact without reading postings;
- a commit per change: one row naming the live parts and the constants. A reader takes the newest one; a writer that fails before
  its commit leaves parts that nobody reads. There is one writer at a time.

Searches scan the documents, whose terms lie in one row each, and shuffle only the best k of each task (``operators.scan``): a row per
question and document is never made. ``survivors`` tells by upper bounds which blocks can hold one of the best: the bound of a (question,
block) is the sum over the question's terms of the largest contribution in that block.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, LongType

from .. import settings as S
from ..session import broadcast_if_small, fits, materialize
from . import index as ix
from .lexical import bm25_scores, query_terms, rank_top
from .scan import best_documents

# a segment with a larger share of dead documents than this is written anew by ``compact``
DEAD_SHARE = 0.2
# bands of document length per doubling
BANDS = 4
# postings that one task sorts when it writes a bucket
BUCKET_POSTINGS = 2_000_000


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


class LexicalStore:
    """Handle on the index in ``path``; ``open`` for an existing one, ``create`` for an empty one."""

    def __init__(self, spark: SparkSession, path: str, state: dict):
        self.spark, self.path, self.state = spark, path.rstrip("/"), state

    # --- commits ----------------------------------------------------------------------------

    @classmethod
    def create(cls, spark: SparkSession, path: str, mode: str = "search", id_type: DataType | None = None, buckets: int = 32, block_docs: int = 8) -> LexicalStore:
        store = cls(spark, path, {"version": 0, "mode": mode, "id_type": json.loads((id_type or LongType()).json()), "buckets": buckets, "block_docs": block_docs,
                                  "segments": [], "dead": [], "stats": [], "n_docs": 0, "avgdl": 0.0, "mean_idf": 0.0})
        store._commit({})
        return store

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> LexicalStore:
        commits = spark.read.schema("version long, state string").parquet(f"{path.rstrip('/')}/commits/*")
        return cls(spark, path, json.loads(commits.agg(F.max_by("state", "version")).first()[0]))

    def _commit(self, changes: dict) -> None:
        state = {**self.state, **changes, "version": self.state["version"] + 1}
        row = self.spark.createDataFrame([(state["version"], json.dumps(state))], "version long, state string")
        row.coalesce(1).write.parquet(f"{self.path}/commits/{state['version']:08d}")      # fails where that version exists
        self.state = state

    def _write(self, df: DataFrame, kind: str) -> str:
        name = f"{kind}/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{name}")
        return name

    def _read(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    # --- tables -----------------------------------------------------------------------------

    @property
    def _id(self) -> str:
        kind = self.state["id_type"]
        return kind if isinstance(kind, str) else kind["type"]

    @property
    def _docs_schema(self) -> str:
        return f"chunk_id {self._id}, fingerprint long, dl int, terms array<struct<term: string, tf: int>>"

    def _dead(self) -> DataFrame:
        schema = f"segment string, chunk_id {self._id}"
        marks = [self._read(n, schema) for n in self.state["dead"]]
        return _union(marks) if marks else self.spark.createDataFrame([], schema)

    def documents(self, segments: list[dict] | None = None) -> DataFrame:
        """Live documents: segment, chunk_id, fingerprint, dl, terms."""
        segments = self.state["segments"] if segments is None else segments
        if not segments:
            return self.spark.createDataFrame([], f"segment string, {self._docs_schema}")
        rows = _union([self._read(s["docs"], self._docs_schema).select(F.lit(s["name"]).alias("segment"), "*") for s in segments])
        return rows.join(self._dead(), ["segment", "chunk_id"], "left_anti") if self.state["dead"] else rows

    def postings(self) -> DataFrame:
        """postings(chunk_id, term, tf, dl) of the live documents, as ``index.build_postings`` gives them."""
        return self.documents().select("chunk_id", "dl", F.inline("terms")).select("chunk_id", "term", "tf", "dl")

    def term_df(self) -> DataFrame:
        """(term, df, cf) over the live documents."""
        parts = [self._read(n, "term string, df long, cf long") for n in self.state["stats"]]
        rows = _union(parts) if parts else self.spark.createDataFrame([], "term string, df long, cf long")
        if len(parts) == 1:         # a row per term already
            return rows.filter("cf > 0")
        return rows.groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf")).filter("cf > 0")

    def stats(self) -> DataFrame:
        """One row n_docs, mean_idf, avgdl, as ``index.index_constants`` gives it."""
        return self.spark.createDataFrame([(self.state["n_docs"], self.state["mean_idf"], self.state["avgdl"])], "n_docs long, mean_idf double, avgdl double")

    def index(self) -> dict:
        """The tables under the names of ``lexical.lexical_index``, and this store for searches."""
        return {"postings": self.postings(), "doc_ids": self.documents().select("chunk_id"), "stats": self.stats(), "term_df": self.term_df(), "store": self}

    def _blocks(self, segment: dict) -> DataFrame:
        """Postings of a segment as a bucketed table of this session, so that its bucketing is known to the planner."""
        name = f"lexical_{segment['name']}"
        if not self.spark.catalog.tableExists(name):
            self._post(segment, name)
        return self.spark.table(name)

    def _post(self, segment: dict, table: str) -> None:
        """Write a segment's postings to a folder of their own."""
        docs = self._read(segment["docs"], self._docs_schema)
        band = F.floor(F.log2(F.greatest("dl", F.lit(1))) * BANDS).cast("int")
        sizes = docs.groupBy(band.alias("band")).agg(F.count("*").alias("n"), F.sum(F.size("terms")).alias("postings")).collect()     # at most BANDS * 31 rows
        buckets = max(self.state["buckets"], -(-sum(r["postings"] for r in sizes) // BUCKET_POSTINGS))
        slots = F.create_map(*[F.lit(x) for r in sizes for x in (r["band"], max(1, r["n"] // self.state["block_docs"]))]) if sizes else F.create_map(F.lit(0), F.lit(1))
        block = F.xxhash64(band, F.pmod(F.xxhash64("chunk_id"), slots[band]))
        # documents travel whole and are taken apart behind the shuffle
        rows = docs.select(block.alias("block"), "chunk_id", "dl", "terms").repartition(buckets, "block").select("block", "chunk_id", "dl", F.inline("terms"))
        posted = rows.groupBy("block", "term").agg(      # a block's documents, a handful
            F.array_sort(F.collect_list(F.struct("chunk_id", F.col("tf").cast("int").alias("tf"), "dl"))).alias("docs"), F.max("tf").cast("int").alias("max_tf"), F.min("dl").alias("min_dl"))
        posted.write.bucketBy(buckets, "block").sortBy("term").option("path", f"{self.path}/postings/{uuid.uuid4().hex}").saveAsTable(table)

    # --- changes ----------------------------------------------------------------------------

    def _segment(self, docs: DataFrame) -> tuple[dict, str]:
        """Write a segment from documents (chunk_id, fingerprint, dl, terms): its entry and the folder of its term counts."""
        name = uuid.uuid4().hex
        folder = f"docs/{name}"
        docs.select("chunk_id", "fingerprint", "dl", "terms").write.parquet(f"{self.path}/{folder}")
        docs = self._read(folder, self._docs_schema)
        stats = self._write(docs.select(F.inline("terms")).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").cast("long").alias("cf")), "stats")
        return {"name": name, "docs": folder, "n": docs.count(), "dead": 0}, stats

    def _settle(self, segments: list[dict], dead: list[str], stats: list[str], n_docs: int) -> None:
        """Commit the parts with the constants that follow from them."""
        before, self.state = self.state, {**self.state, "stats": stats}
        counted = self.spark.createDataFrame([(n_docs,)], "n_docs long")
        found = ix.index_constants(self.term_df(), counted).first() if n_docs else None
        self.state = before
        self._commit({"segments": segments, "dead": dead, "stats": stats, "n_docs": n_docs,
                      "mean_idf": found["mean_idf"] if found else 0.0, "avgdl": found["avgdl"] if found else 0.0})

    def _replace(self, ids: DataFrame | None, fresh: dict | None, added: list[str]) -> None:
        """Mark the live revisions of ``ids`` dead and add a segment."""
        segments = [dict(s) for s in self.state["segments"]]
        dead, stats, gone = list(self.state["dead"]), [*self.state["stats"], *added], 0
        if ids is not None and segments:
            old = self.documents().join(ids.select("chunk_id").distinct(), "chunk_id", "left_semi")
            marks = self._write(old.select("segment", "chunk_id"), "dead")
            counts = {r["segment"]: r["count"] for r in self._read(marks, f"segment string, chunk_id {self._id}").groupBy("segment").count().collect()}
            gone = sum(counts.values())
            if gone:
                lost = old.select(F.inline("terms")).groupBy("term").agg((-F.count("*")).alias("df"), (-F.sum("tf")).cast("long").alias("cf"))
                stats.append(self._write(lost, "stats"))
                dead.append(marks)
                for s in segments:
                    s["dead"] += counts.get(s["name"], 0)
        if fresh is not None:
            segments.append(fresh)
        self._settle(segments, dead, stats, self.state["n_docs"] - gone + (fresh["n"] if fresh else 0))

    def upsert(self, chunks: DataFrame, id_col: str = "chunk_id", text: str = "text") -> None:
        """Add documents, replacing those with the same id; a batch names an id once."""
        docs = ix.counted_terms(chunks, id_col, text, self.state["mode"]).select(
            F.col("chunk_id").cast(self._id).alias("chunk_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("fingerprint"), "dl", "terms")
        fresh, stats = self._segment(docs)
        ids = self._read(fresh["docs"], self._docs_schema).select("chunk_id")
        if ids.groupBy("chunk_id").count().filter("count > 1").limit(1).count():
            raise ValueError("a batch names an id more than once")
        self._replace(ids, fresh, [stats])

    def remove(self, ids: DataFrame) -> None:
        """Remove documents by ``chunk_id``; absent ids are ignored."""
        self._replace(ids.select(F.col("chunk_id").cast(self._id).alias("chunk_id")), None, [])

    def sync(self, chunks: DataFrame, id_col: str = "chunk_id", text: str = "text") -> dict[str, int]:
        """Make the index that of ``chunks``: new and changed texts are indexed, vanished ids removed, others not touched."""
        want = chunks.select(F.col(id_col).cast(self._id).alias("chunk_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_new"))
        have = self.documents().select("chunk_id", F.col("fingerprint").alias("_old"))
        action = (F.when(F.col("_new").isNull(), "removed").when(F.col("_old").isNull() | (F.col("_old") != F.col("_new")), "indexed").otherwise("skipped"))
        plan = materialize(want.join(have, "chunk_id", "full_outer").select("chunk_id", action.alias("action")), "lexical-sync")
        counts = {"indexed": 0, "removed": 0, "skipped": 0, **{r["action"]: r["count"] for r in plan.groupBy("action").count().collect()}}
        if counts["removed"]:
            self.remove(plan.filter("action = 'removed'"))
        if counts["indexed"]:
            todo = plan.filter("action = 'indexed'").select(F.col("chunk_id").alias(id_col))
            self.upsert(chunks.join(todo, id_col, "left_semi"), id_col, text)
        return counts

    def compact(self, dead_share: float = DEAD_SHARE, max_segments: int = 8) -> None:
        """Write small and half-dead segments anew as one; their marks and statistics are folded.

        Segments with more than ``dead_share`` dead documents are taken, and the smallest ones while more than ``max_segments`` would be left.
        """
        order = sorted(self.state["segments"], key=lambda s: s["n"] - s["dead"])
        chosen = [s for s in order if s["dead"] > dead_share * s["n"]]
        others = [s for s in order if s not in chosen]
        while others and len(others) + bool(chosen) > max_segments:
            chosen.append(others.pop(0))
        if not chosen:
            return
        fresh, _ = self._segment(self.documents(chosen))        # its counts are part of the totals already
        names = [s["name"] for s in others]
        dead = [self._write(self._dead().filter(F.col("segment").isin(names)), "dead")] if self.state["dead"] and any(s["dead"] for s in others) else []
        totals = self._write(self.term_df(), "stats")
        self._settle([*others, *([fresh] if fresh["n"] else [])], dead, [totals], self.state["n_docs"])

    # --- searches ---------------------------------------------------------------------------

    def _weights(self, terms: DataFrame) -> DataFrame:
        """(term, query_id, w): question terms with what a count is multiplied by; a checked, small table."""
        known = self.term_df().join(broadcast_if_small(terms.select("term").distinct()), "term", "left_semi")
        return materialize(terms.join(known, "term").join(F.broadcast(self.stats())).select(
            "term", "query_id", (F.col("qtf") * ix.floored_idf()).alias("w")), "lexical-weights")

    def _contribution(self, tf, dl, k1: float, b: float):
        tf, dl = F.col(tf), F.col(dl)
        return F.col("w") * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / F.lit(self.state["avgdl"])))

    def _sums(self, rows: DataFrame, segment: dict, k1: float, b: float) -> DataFrame:
        """(query_id, doc_id, score) from rows (block, query_id, w, docs): no exchange, a document lies in one block."""
        parts = rows.select("block", "query_id", "w", F.inline("docs"))
        if segment["dead"]:
            gone = self._dead().filter(F.col("segment") == segment["name"]).select("chunk_id")
            parts = parts.join(F.broadcast(gone) if fits(gone) else gone, "chunk_id", "left_anti")
        return parts.groupBy("block", "query_id", "chunk_id").agg(F.round(F.sum(self._contribution("tf", "dl", k1, b)), S.SCORE_DECIMALS).alias("score")).select(
            "query_id", F.col("chunk_id").alias("doc_id"), "score")

    def _bounded(self, segment: dict, weights: DataFrame, k1: float, b: float) -> DataFrame:
        return self._blocks(segment).join(F.broadcast(weights), "term").withColumn("bound", self._contribution("max_tf", "min_dl", k1, b))

    def scores(self, terms: DataFrame, k1: float = S.BM25_K1, b: float = S.BM25_B, broadcast_rows: int = 500_000) -> DataFrame:
        """(query_id, doc_id, score) of every document that shares a term with the question."""
        if not self.state["segments"] or not fits(terms, broadcast_rows):
            return bm25_scores(self.postings(), self.term_df(), self.stats(), terms, k1, b, broadcast_rows)
        weights = self._weights(terms)
        return _union([self._sums(self._blocks(s).join(F.broadcast(weights), "term"), s, k1, b) for s in self.state["segments"]])

    def survivors(self, weights: DataFrame, k: int, k1: float = S.BM25_K1, b: float = S.BM25_B) -> list[tuple[dict, DataFrame]]:
        """Per segment the rows (block, query_id, w, docs) whose block may hold one of the best ``k``."""
        first = 2 * k
        segments = self.state["segments"]
        bounds = _union([self._bounded(s, weights, k1, b).groupBy("block", "query_id").agg(F.sum("bound").alias("bound")).select(
            F.lit(s["name"]).alias("segment"), "block", "query_id", "bound") for s in segments])
        best = materialize(rank_top(bounds, first, by="bound", tie="block", rank="place").select("segment", "block", "query_id"), "lexical-first")   # questions x 2k rows
        tried = [self._sums(self._blocks(s).join(F.broadcast(weights), "term").join(
            F.broadcast(best.filter(F.col("segment") == s["name"]).drop("segment")), ["block", "query_id"], "left_semi"), s, k1, b) for s in segments]
        limits = rank_top(_union(tried).filter("score > 0"), k).groupBy("query_id").agg(F.count("*").alias("_n"), F.min("score").alias("least")).filter(F.col("_n") >= k)
        limits = F.broadcast(materialize(limits.select("query_id", "least"), "lexical-limits"))     # a row a question
        out = []
        for s in segments:
            grouped = self._bounded(s, weights, k1, b).groupBy("block", "query_id").agg(      # a question's terms in one block
                F.sum("bound").alias("bound"), F.collect_list(F.struct("w", "docs")).alias("rows"))
            kept = grouped.join(limits, "query_id", "left").filter(F.col("bound") >= F.coalesce("least", F.lit(0.0)) - 10.0 ** -S.SCORE_DECIMALS)
            out.append((s, kept.select("block", "query_id", F.inline("rows"))))
        return out

    def search(self, queries: DataFrame, k: int = S.LEXICAL_TOP_K, id_col: str = "query_id", text: str = "query", k1: float = S.BM25_K1, b: float = S.BM25_B,
               prune: bool = True, broadcast_rows: int = 500_000) -> DataFrame:
        """rankings(query_id, doc_id, score, rank) with positive scores only; ``prune=False`` sums every pair in the engine, to compare with."""
        terms = query_terms(queries, id_col, text, self.state["mode"])
        if not prune:
            return rank_top(self.scores(terms, k1, b, broadcast_rows).filter("score > 0"), k)
        return self.best(terms, k, 0.5 * 10.0 ** -S.SCORE_DECIMALS, k1, b)

    def best(self, terms: DataFrame, k: int, least: float, k1: float = S.BM25_K1, b: float = S.BM25_B) -> DataFrame:
        """The ``k`` best documents per question among those that share a term with it and score ``least`` or more."""
        if not self.state["segments"]:
            return rank_top(self.scores(terms, k1, b), k)
        return best_documents(self.documents(), self._weights(terms), self.state["avgdl"] or 1.0, k, least, k1, b)
