"""Hard negatives from exact integer inner products, multiplied by Strassen's recursion on int64 tiles.

Vectors become whole numbers ``floor(scale * x)``. A tile of anchors times a tile of rows is one product by Strassen's recursion
(the form with 15 additions), zero-padded to even sides at each level; sums of int64 are exact modulo 2**64, so every product that
fits a long is exact whatever its partial sums do. Two passes: heaps of the best rows of an anchor's own label give its positives;
each positive opens a window of scores, and heaps of the best rows of other labels inside each window give its negatives. A task
keeps one bounded heap per anchor or window, rows of equal labels are multiplied in one tile, and the heaps of all tasks are merged
by a ranked window over at most k rows per task and heap.

How rows move: vectors never do. Anchors are read in waves of ``WAVE_BYTES``, whatever their number, and a wave is sent to the tasks
of one scan of all rows per pass, which multiplies as it reads. A wave's results are a table of the shared folder.

Defined results: a row with a null id, label or vector, or with a null or non-finite component takes no part. Vectors of unequal
length are padded with zeros. Components beyond ``limit`` (so that products fit a long) are cut to it. "Other" rows have another id;
rows that repeat an id and have the same score count once, repeated anchors too. Fewer rows than asked for are returned where there are no more; a
positive without negatives has no rows. An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

POSITIVES, NEGATIVES = 5, 10
LOWEST, HIGHEST = 30, 90            # of a positive's score, in hundredths
SCALE = 256
LEAF = 32                           # sides up to this are multiplied directly
ANCHOR_TILE, FIRST_ROWS, ROW_TILE = 512, 256, 4096
WAVE_BYTES = 4 << 20
NONE = np.iinfo(np.int64).min


def multiply(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """Matrix product of int64 matrices by Strassen's recursion."""
    m, k = a.shape
    n = b.shape[1]
    if min(m, k, n) <= leaf:
        return a @ b
    if m % 2 or k % 2:
        a = np.pad(a, ((0, m % 2), (0, k % 2)))
    if k % 2 or n % 2:
        b = np.pad(b, ((0, k % 2), (0, n % 2)))
    h, g, w = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:h, :g], a[:h, g:], a[h:, :g], a[h:, g:]
    b11, b12, b21, b22 = b[:g, :w], b[:g, w:], b[g:, :w], b[g:, w:]
    s1 = a21 + a22
    s2 = s1 - a11
    t1 = b12 - b11
    t2 = b22 - t1
    p1 = multiply(a11, b11, leaf)
    out = np.empty((2 * h, 2 * w), dtype=np.int64)
    np.add(p1, multiply(a12, b21, leaf), out=out[:h, :w])
    p1 += multiply(s2, t2, leaf)
    p5 = multiply(s1, t1, leaf)
    np.add(p1 + p5, multiply(a12 - s2, b22, leaf), out=out[:h, w:])
    p1 += multiply(a11 - a21, b22 - b12, leaf)
    np.subtract(p1, multiply(a22, t2 - b21, leaf), out=out[h:, :w])
    np.add(p1, p5, out=out[h:, w:])
    return out[:m, :n]


class Heaps:
    """The k best distinct (score, id) of each slot: higher scores first, then smaller ids. Mergeable."""

    def __init__(self, slots: int, k: int):
        self.k = k
        self.scores = np.full((slots, k), NONE, dtype=np.int64)
        self.ids = np.full((slots, k), NONE, dtype=np.int64)

    def worst(self) -> np.ndarray:
        return self.scores[:, -1]

    def offer(self, slots: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        if not len(slots):
            return
        touched = np.unique(slots)
        old = self.scores[touched]
        full = old != NONE
        slots = np.concatenate([slots, np.repeat(touched, full.sum(axis=1))])
        scores = np.concatenate([scores, old[full]])
        ids = np.concatenate([ids, self.ids[touched][full]])
        order = np.lexsort((ids, -scores, slots))
        slots, scores, ids = slots[order], scores[order], ids[order]
        new = np.ones(len(slots), dtype=bool)
        new[1:] = (slots[1:] != slots[:-1]) | (scores[1:] != scores[:-1]) | (ids[1:] != ids[:-1])
        slots, scores, ids = slots[new], scores[new], ids[new]
        first = np.searchsorted(slots, slots)
        place = np.arange(len(slots)) - first
        kept = place < self.k
        self.scores[touched], self.ids[touched] = NONE, NONE
        self.scores[slots[kept], place[kept]] = scores[kept]
        self.ids[slots[kept], place[kept]] = ids[kept]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        slot, place = np.nonzero(self.ids != NONE)
        return slot, self.scores[slot, place], self.ids[slot, place]


def limit(dims: int) -> int:
    """Largest component for which an inner product of that many fits a long."""
    return math.isqrt((2 ** 62) // max(dims, 1))


def whole(vectors: pa.Array, dims: int, scale: int = SCALE) -> tuple[np.ndarray, np.ndarray]:
    """(rows that take part, their whole numbers padded to ``dims``)."""
    lengths = vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    values = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)       # nulls become nan
    bad = ~np.isfinite(values)
    owner = np.repeat(np.arange(len(lengths)), lengths)
    ok = vectors.is_valid().to_numpy(zero_copy_only=False).copy()
    ok[owner[bad]] = False
    out = np.zeros((len(lengths), dims), dtype=np.int64)
    top = limit(dims)
    place = np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    good = ok[owner]
    out[owner[good], place[good]] = np.clip(np.floor(scale * values[good]), -top, top).astype(np.int64)
    return ok, out[ok]


def tiles(n: int) -> Iterator[slice]:
    """Slices of n rows, short ones first: heaps that fill early reject most of what follows."""
    at, size = 0, FIRST_ROWS
    while at < n:
        yield slice(at, min(n, at + size))
        at, size = at + size, min(ROW_TILE, 2 * size)


def _read(batch: pa.RecordBatch, dims: int, scale: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    known = batch.filter(pc.and_(batch.column(0).is_valid(), batch.column(1).is_valid()))
    vectors = known.column(2)
    ok, matrix = whole(vectors, dims, scale)
    return known.column(0).to_numpy()[ok], known.column(1).to_numpy()[ok], matrix


def _scores(anchors: np.ndarray, label: np.ndarray, matrix: np.ndarray, labels: np.ndarray, same: bool):
    """(indices of anchors, slice of rows in their own order, products) of all tiles of equal (or unequal) label."""
    for value in np.unique(labels):
        rows = np.nonzero(labels == value)[0]
        mine = np.nonzero((label == value) == same)[0]
        for lo in range(0, len(mine), ANCHOR_TILE):
            part = mine[lo:lo + ANCHOR_TILE]
            left = anchors[part]
            for piece in tiles(len(rows)):
                yield part, rows[piece], multiply(left, matrix[rows[piece]].T)


def _emit(heaps: Heaps) -> pa.RecordBatch:
    slot, scores, ids = heaps.rows()
    return pa.RecordBatch.from_pydict({"slot": pa.array(slot, pa.int64()), "score": pa.array(scores, pa.int64()), "id": pa.array(ids, pa.int64())})


HEAP_ROWS = "slot long, score long, id long"


def _merge(rows: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("slot").orderBy(F.desc("score"), "id")
    return rows.dropDuplicates(["slot", "score", "id"]).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _wave(table: DataFrame, ids: np.ndarray, label: np.ndarray, anchors: np.ndarray, scale: int, positives: int, negatives: int, low: int, high: int, name: str) -> DataFrame:
    """Results of one wave of anchors."""
    spark = table.sparkSession
    dims = anchors.shape[1]
    sent = spark.sparkContext.broadcast((ids, label, anchors))

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, label, anchors = sent.value
        heaps = Heaps(len(own), positives)
        for batch in batches:
            row_ids, labels, matrix = _read(batch, dims, scale)
            for part, rows, product in _scores(anchors, label, matrix, labels, same=True):
                a, r = np.nonzero((product >= heaps.worst()[part][:, None]) & (row_ids[rows][None, :] != own[part][:, None]))
                heaps.offer(part[a], product[a, r], row_ids[rows[r]])
        yield _emit(heaps)

    found = _merge(table.mapInArrow(nearest, HEAP_ROWS), positives).orderBy("slot", "rank").toPandas()      # wave x positives rows
    slot, score, positive = (found[c].to_numpy(dtype=np.int64) for c in ("slot", "score", "id"))
    windows = spark.sparkContext.broadcast((slot, -((-low * score) // 100), (high * score) // 100))

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, label, anchors = sent.value
        owner, bottom, top = windows.value
        heaps = Heaps(len(owner), negatives)
        first = np.searchsorted(owner, np.arange(len(anchors) + 1))
        most = int((first[1:] - first[:-1]).max(initial=0))
        for batch in batches:
            row_ids, labels, matrix = _read(batch, dims, scale)
            for part, rows, product in _scores(anchors, label, matrix, labels, same=False):
                for j in range(most):       # the j-th positive of each anchor of the tile
                    has = np.nonzero(first[part] + j < first[part + 1])[0]
                    if not len(has):
                        continue
                    w = first[part[has]] + j
                    least = np.maximum(bottom[w], heaps.worst()[w])[:, None]
                    seen = product if len(has) == len(part) else product[has]
                    a, r = np.nonzero((seen >= least) & (seen <= top[w][:, None]))
                    heaps.offer(w[a], seen[a, r], row_ids[rows[r]])
        yield _emit(heaps)

    merged = _merge(table.mapInArrow(inside, HEAP_ROWS), negatives)
    keys = spark.createDataFrame(pa.table({"slot": pa.array(range(len(slot)), pa.int64()), "anchor_id": pa.array(ids[slot], pa.int64()),
                                           "positive_id": pa.array(positive, pa.int64()), "positive_score": pa.array(score, pa.int64())}))
    out = merged.join(keys, "slot").select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"),
                                           "positive_score", F.col("score").alias("negative_score"))
    return materialize(out, name)


def mine(df: DataFrame, is_anchor, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = SCALE, positives: int = POSITIVES,
         negatives: int = NEGATIVES, low: int = LOWEST, high: int = HIGHEST, wave_bytes: int = WAVE_BYTES, label: str = "negatives") -> DataFrame:
    """For each row with ``is_anchor`` (a column over ``df``) and each of its positives the best rows inside the window of scores.

    Columns anchor_id, positive_id, rank, negative_id, positive_score, negative_score.
    """
    spark = df.sparkSession
    table = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("long").alias("label"), F.col(f"`{vector_col}`").alias("vector"),
                      is_anchor.alias("anchor"))
    dims = max(table.agg(F.max(F.size("vector"))).first()[0] or 0, 1)
    chosen = table.where("anchor AND id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL").select("id", "label", "vector").dropDuplicates()
    table = table.select("id", "label", "vector")
    most = max(1, wave_bytes // (8 * dims))
    parts: list[DataFrame] = []
    wave: list = []

    def flush() -> None:
        if wave:
            vectors = pa.array([r["vector"] for r in wave], pa.list_(pa.float64()))
            ok, matrix = whole(vectors, dims, scale)
            ids, labels = (np.array([r[c] for r in wave], dtype=np.int64)[ok] for c in ("id", "label"))
            if len(ids):
                parts.append(_wave(table, ids, labels, matrix, scale, positives, negatives, low, high, f"{label}-wave"))
            wave.clear()

    for row in chosen.toLocalIterator():        # one partition's anchors at a time
        wave.append(row)
        if len(wave) >= most:
            flush()
    flush()
    if not parts:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def report(df: DataFrame) -> DataFrame:
    """Hard negatives of every hundredth vector, with the label of every seventh moved by one."""
    seventh = F.coalesce(F.pmod("vec_id", F.lit(7)) == 0, F.lit(False))
    moved = df.select("vec_id", "embedding", F.when(seventh, F.pmod(F.col("label") + 1, F.lit(10))).otherwise(F.col("label")).alias("label"))
    return mine(moved, F.pmod("vec_id", F.lit(100)) == 0)


def oracle() -> str:
    return f"""
WITH rows AS (
    SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT a.id AS anchor_id, b.id AS id, a.label = b.label AS same, CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
    FROM rows a JOIN rows b ON a.id <> b.id
    WHERE a.id % 100 = 0
), positives AS (
    SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= {POSITIVES}
)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.id) AS INTEGER) AS rank,
       n.id AS negative_id, p.positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same
    AND {LOWEST} * p.positive_score <= 100 * n.score AND 100 * n.score <= {HIGHEST} * p.positive_score
QUALIFY rank <= {NEGATIVES}
"""
