import random

import numpy as np
import pytest
from folioframe.llm import quality
from pyspark.sql import functions as F


def plain(text):
    words, lines, seen, dup = [], (text or "").split("\n"), set(), 0
    cur = ""
    for c in text or "":
        if c in " \t\n\v\f\r":
            if cur:
                words.append(cur)
            cur = ""
        else:
            cur += c
    if cur:
        words.append(cur)
    for x in lines:
        if x.strip(" \t\n\v\f\r"):
            dup += x in seen
            seen.add(x)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    inside = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(inside)


def test_statistics_against_plain_count():
    rnd = random.Random(2)
    for _ in range(300):
        text = "".join(rnd.choice(["a", "b", " ", "\n", "#", "|", "é", "\x85", "\xa0", "\x1c", "word "]) for _ in range(rnd.randint(0, 60)))
        assert quality.text_statistics(text)[:5] == plain(text)


def test_chi_squared():
    assert quality.chi2_quantile(0.95, 5) == pytest.approx(11.0705, abs=1e-3)
    assert quality.chi2_cdf(4.3515, 5) == pytest.approx(0.5, abs=1e-3)
    assert quality.consistency(0.75) == pytest.approx(1.41, abs=0.01)


def test_estimates_against_numpy(spark):
    """The distributed steps end near the plain C-steps on the same vectors, and planted outliers lie far outside."""
    rng = np.random.default_rng(4)
    good = rng.normal(size=(1500, 5)) @ np.diag([1.0, 0.5, 0.7, 0.6, 0.4]) + [5, 1.5, 0.5, 0.4, 0.3]
    bad = rng.normal(size=(300, 5)) * 0.1 + [5, 1.5, 9, 4, 0.3]
    x = np.vstack([good, bad])
    rows = spark.createDataFrame([("s", r.tolist()) for r in x], "stratum string, x array<double>")
    model = quality._starts(rows, "t")
    assert {r.start for r in model.collect()} == {0, 1, 2}
    for _ in range(6):
        model = quality._concentrate(rows, model, 0.75, "t")
    best = min(model.collect(), key=lambda r: r.logdet)
    centre, inverse = np.median(x, axis=0), np.linalg.inv(np.cov(good.T) + np.diag(np.square(quality.FLOORS)))
    for _ in range(30):
        d = np.einsum("ij,jk,ik->i", x - centre, inverse, x - centre)
        near = x[np.argsort(d)[:int(0.75 * len(x))]]
        centre = near.mean(axis=0)
        inverse = np.linalg.inv(np.cov(near.T, bias=True) * quality.consistency(0.75) + np.diag(np.square(quality.FLOORS)))
    assert np.allclose(best.centre, centre, atol=0.1)
    far = np.einsum("ij,jk,ik->i", bad - best.centre, np.array(best.inverse).reshape(5, 5), bad - best.centre)
    assert far.min() > quality.chi2_quantile(quality.CUT_PROBABILITY, 5)


def test_clean_stays_and_junk_goes(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/labels.parquet")
    rated = quality.rate(docs).join(labels, "doc_id").where("not base_failed").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept"))
    got = {r.quality: r.kept for r in rated.collect()}
    assert got[1] >= 0.99 and got[0] <= 0.05


def test_odd_rows(odd_docs):
    kept = quality.keep_good(odd_docs)
    assert kept.columns == odd_docs.columns
    assert [r.doc_id for r in kept.collect()] == [4]
    rows = quality.rate(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert all(r.base_failed and not r.kept for r in rows if r.doc_id in (1, 2, 3))
    assert quality.rate(odd_docs.where("false")).count() == 0
    assert quality.keep_good(odd_docs.where("false")).count() == 0
