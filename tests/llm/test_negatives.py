import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DateType, FloatType, IntegerType, LongType, StructField, StructType

from folioframe.llm import negatives
from folioframe.llm.queries import ORACLES, QUERIES

ROWS = StructType([StructField("vec_id", LongType()), StructField("embedding", ArrayType(FloatType())), StructField("label", IntegerType())])
COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def as_set(df):
    rows = [tuple(r) for r in df.select(*COLUMNS).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def plain(rows, anchor, positives=5, negatives_=10):
    """All pairs by Python integers."""
    good = [(i, [int(np.floor(256 * float(x))) for x in v], lab) for i, v, lab in rows
            if i is not None and lab is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for a, va, la in good:
        if a % anchor:
            continue
        score = lambda v: sum(x * y for x, y in zip(va, v))
        same = sorted({(-score(v), i) for i, v, lab in good if lab == la and i != a})[:positives]
        other = sorted({(-score(v), i) for i, v, lab in good if lab != la})
        for p, pos in same:
            fitting = [(n, i) for n, i in other if 30 * -p <= 100 * -n <= 90 * -p][:negatives_]
            out |= {(a, pos, r + 1, i, -p, -n) for r, (n, i) in enumerate(fitting)}
    return out


def test_query_on_given_table(spark, sf_dir):
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf_dir}/embeddings.parquet'")
    want = {tuple(r) for r in duck.execute(f"SELECT {', '.join(COLUMNS)} FROM ({ORACLES['op13_negatives']})").fetchall()}
    assert want and as_set(QUERIES["op13_negatives"](spark, sf_dir)) == want


@pytest.mark.parametrize("shape", [(1, 1, 1), (7, 5, 9), (33, 70, 129), (64, 64, 64), (100, 37, 300), (65, 130, 67)])
def test_multiply(shape):
    rng = np.random.default_rng(1)
    m, k, n = shape
    for leaf in (1, 4, 32):
        a, b = rng.integers(-2 ** 28, 2 ** 28, (m, k)), rng.integers(-2 ** 28, 2 ** 28, (k, n))
        want = np.array([[sum(int(x) * int(y) for x, y in zip(r, c)) for c in b.T] for r in a])
        assert (negatives.multiply(a, b, leaf) == want).all()


def test_heaps_merge_in_any_order():
    rng = random.Random(3)
    offers = [(rng.randrange(4), rng.randrange(6), rng.randrange(9)) for _ in range(300)]
    heaps = negatives.Heaps(4, 5)
    while offers:
        part, offers = offers[:17], offers[17:]
        heaps.offer(*(np.array(c, dtype=np.int64) for c in zip(*part)))
    rng = random.Random(3)
    offers = [(rng.randrange(4), rng.randrange(6), rng.randrange(9)) for _ in range(300)]
    want = [t for s in range(4) for t in sorted({(s, -v, i) for x, v, i in offers if x == s})[:5]]
    assert [(int(s), -int(v), int(i)) for s, v, i in zip(*heaps.rows())] == want


def odd_rows(rng):
    rows = [(i, [rng.uniform(-1, 1) for _ in range(6)], rng.choice([0, 1, 1, 1, 2])) for i in range(150)]
    rows += [(i, [0.5] * 6, i % 3) for i in range(150, 240)]                                    # one very common vector
    rows += [(300, None, 1), (301, [0.1, None], 1), (302, [float("nan")] * 6, 2), (303, [float("inf")] * 6, 0), (None, [0.5] * 6, 1), (304, [0.5] * 6, None), (305, [], 1),
             (306, [0.9, 0.9], 2), (307, [0.25] * 9, 2), (310, [-0.5] * 6, 7)]
    return rows + rows[:20] + [(10, [0.3] * 6, 2), (10, [0.3] * 6, 2)]                          # repeated rows, one id with two contents


def test_odd_rows(spark):
    rows = odd_rows(random.Random(8))
    names = ["slot", "score", "id", "anchor", "vector", "rank"]
    odd = StructType([*ROWS.fields, *[StructField(n, DateType()) for n in names]])
    df = spark.createDataFrame([(*r, *[None] * len(names)) for r in rows], odd).repartition(4)
    want = plain([(i, None if v is None else [x if x is None else float(np.float32(x)) for x in v], lab) for i, v, lab in rows], 10)
    for wave_bytes in (negatives.WAVE_BYTES, 9 * 8 * 4):        # one wave, and waves of four anchors
        assert as_set(negatives.mine(df, F.col("vec_id") % 10 == 0, wave_bytes=wave_bytes)) == want
    assert negatives.mine(spark.createDataFrame([], ROWS), F.col("vec_id") % 10 == 0).count() == 0
    assert negatives.mine(df, F.lit(False)).columns == COLUMNS
