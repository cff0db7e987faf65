"""Exact cosine nearest neighbours for a table of query vectors."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import settings as S
from ..session import materialize
from .best import Best
from .lexical import rank_top

# bytes of query vectors sent with one scan, and of one tile of scores in a task
WAVE_BYTES = 8 << 20
TILE_BYTES = 16 << 20


def _scan(batches: Iterator[pd.DataFrame], q_ids: list, q_vecs: np.ndarray, k: int, eps: float, asked: list[np.ndarray] | None = None) -> Iterator[pd.DataFrame]:
    """Best ``k`` rows (id, vec and, with ``asked``, cell) of all batches for each query; one emission at the end.

    ``asked`` holds per cell the queries that probe it.
    """
    best, q_norm = Best(len(q_ids), k), np.maximum(np.linalg.norm(q_vecs, axis=1), eps)
    for pdf in batches:
        if not len(pdf):
            continue
        vectors = np.stack(pdf["vec"].to_numpy()).astype("float64")
        ids, norm = np.asarray(pdf["id"].tolist()), np.linalg.norm(vectors, axis=1)
        cells = [(None, slice(None))] if asked is None else [(c, np.nonzero(pdf["cell"].to_numpy() == c)[0]) for c in pdf["cell"].unique()]
        for cell, rows in cells:
            d, dn, di = vectors[rows], norm[rows], ids[rows]
            step = max(1, TILE_BYTES // (8 * len(di)))
            mine = np.arange(len(q_ids)) if cell is None else asked[cell]
            for lo in range(0, len(mine), step):
                part = mine[lo:lo + step]
                scores = np.round((q_vecs[part] @ d.T) / np.maximum(q_norm[part][:, None] * dn[None, :], eps), S.SCORE_DECIMALS)
                if cell is None:
                    best.offer(lo, scores, di)
                else:
                    for i, q in enumerate(part):
                        best.offer(int(q), scores[i:i + 1], di)
    slots, values, ids = best.rows
    yield pd.DataFrame({"query_id": [q_ids[s] for s in slots], "doc_id": ids, "score": values})


def _waves(queries: DataFrame, most: int) -> Iterator[tuple[list, np.ndarray]]:
    """Queries (id, vector) a bounded number at a time; one partition of them is at the driver."""
    ids, vectors = [], []
    for row in queries.toLocalIterator():
        ids.append(row[0])
        vectors.append(row[1])
        if len(ids) == most:
            yield ids, np.array(vectors, dtype="float64")
            ids, vectors = [], []
    if ids:
        yield ids, np.array(vectors, dtype="float64")


def _schema(vectors: DataFrame, queries: DataFrame, id_col: str, q_id: str) -> str:
    return (f"query_id {queries.schema[q_id].dataType.simpleString()}, "
            f"doc_id {vectors.schema[id_col].dataType.simpleString()}, score double")


def dense_search(vectors: DataFrame, queries: DataFrame, k: int = S.DENSE_TOP_K, id_col: str = "chunk_id",
                 vec: str = "embedding", q_id: str = "query_id", q_vec: str = "embedding",
                 eps: float = 1e-12, wave_bytes: int = WAVE_BYTES) -> DataFrame:
    """rankings(query_id, doc_id, score, rank), score = cosine similarity. Vectors that are missing are skipped.

    Query vectors go to the tasks in waves of ``wave_bytes``; each wave is one scan of the vectors, without a shuffle. A
    task multiplies tiles of bounded size, holds the best ``k`` per query of its wave over all its batches and emits
    them once, so its memory does not grow with the number of queries, nor with that of the vectors.
    """
    table = vectors.filter(F.col(vec).isNotNull() & (F.size(vec) > 0)).select(F.col(id_col).alias("id"), F.col(vec).alias("vec"))
    asked = queries.filter(F.col(q_vec).isNotNull()).select(q_id, q_vec)
    schema, context = _schema(vectors, queries, id_col, q_id), vectors.sparkSession.sparkContext
    head = asked.limit(1).collect()
    parts: list[DataFrame] = []
    for ids, matrix in _waves(asked, max(1, wave_bytes // (8 * max(1, len(head[0][1]))))) if head else ():
        shared = context.broadcast((ids, matrix))
        found = rank_top(table.mapInPandas(lambda batches, shared=shared: _scan(batches, *shared.value, k, eps), schema), k)
        if parts:       # with a single wave the result stays lazy
            found = materialize(found, "dense-wave")
        parts.append(found)
    if not parts:
        return vectors.sparkSession.createDataFrame([], f"{schema}, rank int")
    if len(parts) > 1:
        parts[0] = materialize(parts[0], "dense-wave")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


# --- inverted file: approximate ------------------------------------------------------------

@dataclass
class Cells:
    """Vectors stored by the coarse cell they lie in: table (cell, id, vec), partitioned by cell, the cells' centres, and how many to probe."""

    table: DataFrame
    centres: np.ndarray
    probes: int


def fit_centres(sample: np.ndarray, cells: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Spherical k-means on unit vectors; a centre without vectors moves to the vector that fits worst."""
    rng = np.random.default_rng(seed)
    centres = sample[rng.choice(len(sample), min(cells, len(sample)), replace=False)]
    for _ in range(rounds):
        scores = sample @ centres.T
        own = scores.argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        empty = np.nonzero(np.bincount(own, minlength=len(centres)) == 0)[0]
        if len(empty):
            sums[empty] = sample[np.argsort(scores.max(axis=1), kind="stable")[:len(empty)]]
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centres


def probes_for(sample: np.ndarray, centres: np.ndarray, recall: float, k: int = 20, queries: int = 256) -> int:
    """Fewest nearest cells that hold the share ``recall`` of the ``k`` neighbours of sampled vectors in the sample."""
    asked = sample[:queries]
    scores = asked @ sample.T
    near = np.argpartition(-scores, min(k, len(sample) - 1), axis=1)[:, :k]
    place = np.argsort(np.argsort(-(asked @ centres.T), axis=1, kind="stable"), axis=1)      # of each cell for each query
    needed = np.sort(np.take_along_axis(place, (sample @ centres.T).argmax(axis=1)[near], axis=1).ravel())
    return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)]) + 1


def build_cells(vectors: DataFrame, cells: int | None = None, sample_rows: int = 20_000, id_col: str = "chunk_id", vec: str = "embedding", recall: float = 0.95) -> Cells:
    """Assign every vector to the nearest of ``cells`` centres (square root of the count, at most an eighth of the sample).

    The centres are fitted on at most ``sample_rows`` vectors, those of the smallest hashes of their ids, and so is the number
    of cells to probe for ``recall``: vectors without structure need most of them. All vectors are stored.
    """
    table = vectors.filter(F.col(vec).isNotNull() & (F.size(vec) > 0)).select(F.col(id_col).alias("id"), F.col(vec).alias("vec"))
    rows = table.orderBy(F.xxhash64("id"), "id").limit(sample_rows).collect()
    sample = np.array([r["vec"] for r in rows], dtype="float64").reshape(len(rows), -1)
    sample /= np.maximum(np.linalg.norm(sample, axis=1, keepdims=True), 1e-12)
    wanted = cells or max(1, min(round(table.count() ** 0.5), len(rows) // 8))
    centres = fit_centres(sample, wanted) if len(rows) else np.zeros((1, 1))
    shared = table.sparkSession.sparkContext.broadcast(centres)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield pdf.assign(cell=(np.stack(pdf["vec"].to_numpy()).astype("float64") @ shared.value.T).argmax(axis=1))

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in table.schema)
    return Cells(materialize(table.mapInPandas(assign, f"{fields}, cell long"), "cells", partition_by=["cell"]), centres, probes_for(sample, centres, recall) if len(rows) else 1)


def cell_search(index: Cells, queries: DataFrame, k: int, probes: int | None = None, q_id: str = "query_id", q_vec: str = "embedding",
                eps: float = 1e-12, wave_bytes: int = WAVE_BYTES) -> DataFrame:
    """Approximate ``dense_search``: only the ``probes`` cells nearest to a query are read, their vectors scored exactly."""
    asked = queries.filter(F.col(q_vec).isNotNull()).select(q_id, q_vec)
    schema, spark = _schema(index.table, queries, "id", q_id), index.table.sparkSession
    probes = min(len(index.centres), probes or index.probes)
    parts: list[DataFrame] = []
    for ids, matrix in _waves(asked, max(1, wave_bytes // (8 * index.centres.shape[1]))):
        near = np.argsort(-(matrix @ index.centres.T), axis=1, kind="stable")[:, :probes]
        by_cell = [np.nonzero((near == c).any(axis=1))[0] for c in range(len(index.centres))]
        shared = spark.sparkContext.broadcast((ids, matrix, by_cell))

        def scan(batches, shared=shared):
            ids, matrix, by_cell = shared.value
            return _scan(batches, ids, matrix, k, eps, by_cell)

        read = index.table.filter(F.col("cell").isin([c for c, q in enumerate(by_cell) if len(q)]))     # whole folders are skipped
        parts.append(materialize(rank_top(read.select("id", "vec", "cell").mapInPandas(scan, schema), k), "cell-wave"))
    if not parts:
        return spark.createDataFrame([], f"{schema}, rank int")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def cosine_eval(vectors: DataFrame, queries: DataFrame, k: int, **kw) -> DataFrame:
    """Evaluation form: the same product with its guard of 1e-12."""
    return dense_search(vectors, queries, k, eps=1e-12, **kw)


def dense_search_where(vectors: DataFrame, queries: DataFrame, predicate: Column,
                       k: int = S.DENSE_TOP_K, **kw) -> DataFrame:
    """Metadata predicate before the neighbour search; it reaches the scan."""
    return dense_search(vectors.filter(predicate), queries, k, **kw)


def label_centroids(vectors: DataFrame, label: str = "label", vec: str = "embedding") -> DataFrame:
    """(query_id, embedding): the mean vector of each label, summed before the shuffle."""
    per = vectors.select(label, F.posexplode(vec).alias("pos", "x")).groupBy(label, "pos").agg(
        F.avg(F.col("x").cast("double")).alias("m"))
    return per.groupBy(F.col(label).alias("query_id")).agg(F.transform(
        F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda p: p["m"]).alias("embedding"))
