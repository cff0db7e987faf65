"""Quality rules: text statistics, hard limits, and robust multivariate outliers per language and source.

Five statistics of a text are transformed to a vector. For each stratum (language and source; strata with few rows are
pooled by language, then over all) the minimum-covariance-determinant estimate of centre and scatter is found over all
rows that pass the hard limits: from three deterministic starts, concentration steps take the rows nearest by
Mahalanobis distance and estimate anew, the start with the smallest determinant is followed to its end and reweighted.
A document is rejected if its Mahalanobis distance is beyond ``cut`` or a hard limit fails.

One concentration step is one aggregation over the statistics, whatever the size of a stratum: the sums of a step are
kept per class of distance (classes are a sixteenth of an octave), and the nearest rows are the classes from zero on
until ``share`` of the stratum is reached, the last class included whole.

Defined results: a null, empty or blank text has zero statistics and fails the hard limit on words; null language and
source are values of their own; repeated rows count as often as they occur and get equal results; an empty table gives
an empty result; other columns are not read, and statistics are kept under names that begin with two underscores.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..session import broadcast_if_small, materialize
from .common import map_texts

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = "#*$%&|<>"
WHITE = " \t\n\v\f\r"
STATS = ["__n_words", "__word_chars", "__n_symbols", "__n_dup_lines", "__n_repeat_words", "__n_lines"]

# share of a stratum that determines the estimate, rows that a stratum needs, steps
SHARE = 0.75
MIN_STRATUM = 200
FIRST_STEPS = 3
LAST_STEPS = 4
# squared distances beyond this probability of the chi-squared law are rejected
CUT_PROBABILITY = 1 - 1e-9
REWEIGHT_PROBABILITY = 0.975
# standard deviations below which a transformed statistic counts as constant
FLOORS = (0.20, 0.05, 0.25, 0.18, 0.14)
DIMS = len(FLOORS)
CLASSES_PER_OCTAVE = 16


def repeated_words(words: list) -> int:
    """Words inside 3-word windows that occur twice or more."""
    n = len(words)
    if n < 4:
        return 0
    number: dict = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], dtype=np.int64)
    size = len(number)
    pairs = ids[:-2] * size + ids[1:-1]
    if size > 2_000_000:            # three ids would not fit into 63 bits
        pairs = np.unique(pairs, return_inverse=True)[1]
    _, back, counts = np.unique(pairs * size + ids[2:], return_inverse=True, return_counts=True)
    again = counts[back] > 1
    inside = np.zeros(n, dtype=bool)
    inside[:-2] |= again
    inside[1:-1] |= again
    inside[2:] |= again
    return int(inside.sum())


def text_statistics(text: str | None) -> tuple[int, int, int, int, int, int]:
    if not text:
        return 0, 0, 0, 0, 0, 0
    words = text.encode().split()           # bytes are split at the six ASCII white-space characters only
    lines = [x for x in text.split("\n") if x.strip(WHITE)]
    return (len(words), len(text) - sum(map(text.count, WHITE)), sum(map(text.count, SYMBOLS)),
            len(lines) - len(set(lines)), repeated_words(words), len(lines))


def measure(df: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` columns with the statistics of the whole text, in columns named ``__n_words`` and so on."""
    schema = StructType([StructField(n, LongType()) for n in STATS])
    return map_texts(df, text_col, keep, schema, lambda: lambda texts: list(zip(*map(text_statistics, texts))) or [[]] * len(STATS))


def base_failed():
    return (F.col("__n_words") < MIN_WORDS) | (100 * F.col("__n_repeat_words") > MAX_REPEAT_PERCENT * F.col("__n_words"))


def vector():
    """The transformed statistics of a text."""
    words, lines = F.greatest(F.col("__n_words"), F.lit(1)), F.greatest(F.col("__n_lines"), F.lit(1))
    return F.array(
        F.log(words.cast("double")),
        F.log(F.greatest(F.col("__word_chars"), F.lit(1)) / words),
        F.log1p(100.0 * F.col("__n_symbols") / words),
        F.asin(F.sqrt(F.col("__n_dup_lines") / lines)),
        F.asin(F.sqrt(F.col("__n_repeat_words") / words)))


def _key(name: str):
    return F.coalesce(F.concat(F.lit("="), F.col(f"`{name}`").cast("string")), F.lit("-"))


def gamma_cdf(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function by its series."""
    if x <= 0:
        return 0.0
    term = total = 1 / a
    k = a
    while term > total * 1e-17:
        k += 1
        term *= x / k
        total += term
    return min(1.0, total * math.exp(-x + a * math.log(x) - math.lgamma(a)))


def chi2_cdf(x: float, k: float) -> float:
    return gamma_cdf(k / 2, x / 2)


def chi2_quantile(p: float, k: float) -> float:
    lo, hi = 0.0, 10.0 * k + 200
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_cdf(mid, k) < p else (lo, mid)
    return hi


def consistency(share: float, k: int = DIMS) -> float:
    """Factor that makes the scatter of the nearest ``share`` of normal rows that of all rows."""
    return share / chi2_cdf(chi2_quantile(share, k), k + 2)


def _estimates(scale: float, floors=FLOORS):
    """From rows (stratum, start, n, sums, products) to rows (stratum, start, centre, inverse, logdet)."""
    upper = np.triu_indices(DIMS)

    def run(frames):
        for frame in frames:
            rows = []
            for r in frame.itertuples(index=False):
                centre = np.array(r.sums) / r.n
                scatter = np.zeros((DIMS, DIMS))
                scatter[upper] = np.array(r.products) / r.n
                scatter = scatter + scatter.T - np.diag(np.diag(scatter)) - np.outer(centre, centre)
                scatter = scatter * scale + np.diag(np.square(floors))
                rows.append((r.stratum, r.start, centre.tolist(), np.linalg.inv(scatter).ravel().tolist(), float(np.linalg.slogdet(scatter)[1])))
            yield pd.DataFrame(rows, columns=["stratum", "start", "centre", "inverse", "logdet"])

    return run


MODEL = "stratum string, start int, centre array<double>, inverse array<double>, logdet double"


def _sums(x, where=None):
    """Count, sums and products of the vector's coordinates."""
    one = F.lit(1.0) if where is None else where
    return [F.sum(one).alias("n"), F.array(*[F.sum(x[i] * one) for i in range(DIMS)]).alias("sums"),
            F.array(*[F.sum(x[i] * x[j] * one) for i in range(DIMS) for j in range(i, DIMS)]).alias("products")]


def _distance():
    d = [F.col("x")[i] - F.col("centre")[i] for i in range(DIMS)]
    total = F.lit(0.0)
    for i in range(DIMS):
        inner = F.lit(0.0)
        for j in range(DIMS):
            inner = inner + F.col("inverse")[i * DIMS + j] * d[j]
        total = total + d[i] * inner
    return F.greatest(total, F.lit(0.0))


def _starts(rows: DataFrame, label: str) -> DataFrame:
    """Centre at the medians; scatter from median deviations, hyperbolic tangents of scores, and spatial signs."""
    medians = broadcast_if_small(materialize(rows.groupBy("stratum").agg(
        F.array(*[F.percentile_approx(F.col("x")[i], 0.5, 1000) for i in range(DIMS)]).alias("median")), f"{label}-medians"))
    spreads = rows.join(medians, "stratum").groupBy("stratum", "median").agg(
        F.array(*[F.percentile_approx(F.abs(F.col("x")[i] - F.col("median")[i]), 0.5, 1000) for i in range(DIMS)]).alias("mad"))
    spreads = broadcast_if_small(materialize(spreads, f"{label}-spreads"))
    floors = list(FLOORS)
    z = [(F.col("x")[i] - F.col("median")[i]) / F.greatest(1.4826 * F.col("mad")[i], F.lit(floors[i])) for i in range(DIMS)]
    scored = rows.join(spreads, "stratum").select("stratum", "median", "mad", F.array(*z).alias("z"))
    norm = F.lit(1e-12)
    for i in range(DIMS):
        norm = norm + F.col("z")[i] * F.col("z")[i]
    upper = [(i, j) for i in range(DIMS) for j in range(i, DIMS)]
    sums = scored.groupBy("stratum", "median", "mad").agg(
        F.array(*[F.avg(F.tanh(F.col("z")[i]) * F.tanh(F.col("z")[j])) for i, j in upper]).alias("tanh"),
        F.array(*[F.avg(F.col("z")[i] * F.col("z")[j] / norm) for i, j in upper]).alias("sign"))

    def run(frames):
        at = np.triu_indices(DIMS)
        for frame in frames:
            out = []
            for r in frame.itertuples(index=False):
                sd = np.maximum(1.4826 * np.array(r.mad), floors)
                full = [np.eye(DIMS)]
                for packed in (r.tanh, r.sign):
                    m = np.zeros((DIMS, DIMS))
                    m[at] = packed
                    m = m + m.T - np.diag(np.diag(m)) + 0.01 * np.eye(DIMS)
                    root = np.sqrt(np.diag(m))
                    full.append(m / np.outer(root, root))
                for start, correlation in enumerate(full):
                    scatter = correlation * np.outer(sd, sd)
                    out.append((r.stratum, start, list(r.median), np.linalg.inv(scatter).ravel().tolist(), float(np.linalg.slogdet(scatter)[1])))
            yield pd.DataFrame(out, columns=["stratum", "start", "centre", "inverse", "logdet"])

    return materialize(sums.mapInPandas(run, MODEL), f"{label}-starts")


def _concentrate(rows: DataFrame, model: DataFrame, share: float, label: str) -> DataFrame:
    """One concentration step of every stratum and start."""
    far = rows.join(broadcast_if_small(model), "stratum").select("stratum", "start", "x", _distance().alias("d"))
    step = F.greatest(F.lit(-640), F.least(F.lit(640), F.floor(F.log2(F.col("d") + 1e-12) * CLASSES_PER_OCTAVE))).cast("int")
    classes = far.groupBy("stratum", "start", step.alias("class")).agg(*_sums(F.col("x")))
    # at most 1,281 classes in a window
    w = Window.partitionBy("stratum", "start")
    near = classes.withColumn("before", F.coalesce(F.sum("n").over(w.orderBy("class").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))) \
        .withColumn("all", F.sum("n").over(w)).where(F.col("before") < share * F.col("all"))
    total = near.groupBy("stratum", "start").agg(
        F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[i]) for i in range(DIMS)]).alias("sums"),
        F.array(*[F.sum(F.col("products")[i]) for i in range(DIMS * (DIMS + 1) // 2)]).alias("products"))
    return materialize(total.mapInPandas(_estimates(consistency(share)), MODEL), f"{label}-step")


def estimate(stats: DataFrame, lang_col: str = "lang", source_col: str = "source", share: float = SHARE,
             min_stratum: int = MIN_STRATUM, label: str = "quality") -> tuple[DataFrame, DataFrame]:
    """(cells, model): the stratum of each language and source, and centre and inverse scatter of each stratum."""
    ok = stats.where(~base_failed()).select(_key(lang_col).alias("lk"), _key(source_col).alias("sk"), vector().alias("x"))
    every = stats.groupBy(_key(lang_col).alias("lk"), _key(source_col).alias("sk")).agg(F.sum((~base_failed()).cast("long")).alias("n"))
    w = Window.partitionBy("lk", F.col("n") >= min_stratum)
    cells = every.withColumn("pooled", F.sum("n").over(w)).select("lk", "sk", F.when(F.col("n") >= min_stratum, F.concat_ws("\x1f", "lk", "sk"))
                          .when(F.col("pooled") >= min_stratum, F.col("lk")).otherwise("*").alias("stratum"))
    cells = materialize(cells, f"{label}-cells")
    rows = materialize(ok.join(broadcast_if_small(cells), ["lk", "sk"]).select("stratum", "x"), f"{label}-vectors")
    model = _starts(rows, label)
    for _ in range(FIRST_STEPS):
        model = _concentrate(rows, model, share, label)
    model = model.groupBy("stratum").agg(F.min_by(F.struct("start", "centre", "inverse", "logdet"), F.struct("logdet", "start")).alias("m")).select("stratum", "m.*")
    for _ in range(LAST_STEPS):
        model = _concentrate(rows, model, share, label)
    inner = rows.join(broadcast_if_small(model), "stratum").where(_distance() <= chi2_quantile(REWEIGHT_PROBABILITY, DIMS))
    sums = inner.groupBy("stratum", "start").agg(*_sums(F.col("x")))
    return cells, materialize(sums.mapInPandas(_estimates(consistency(REWEIGHT_PROBABILITY)), MODEL), f"{label}-model")


def judge(stats: DataFrame, cells: DataFrame, model: DataFrame, lang_col: str = "lang", source_col: str = "source",
          cut_probability: float = CUT_PROBABILITY) -> DataFrame:
    """``stats`` with ``__distance`` (squared; null without an estimate) and ``__kept``.

    ``stats`` holds the columns of ``measure`` beside language, source and whatever is named with two underscores.
    """
    strata = broadcast_if_small(materialize(cells.join(model, "stratum", "left").select("lk", "sk", "centre", "inverse"), "quality-strata"))
    cut = chi2_quantile(cut_probability, DIMS)
    rows = stats.withColumns({"lk": _key(lang_col), "sk": _key(source_col), "x": vector()})
    rows = rows.join(strata, ["lk", "sk"], "left").withColumn("__distance", _distance())
    return rows.withColumn("__kept", ~base_failed() & (F.coalesce("__distance", F.lit(0.0)) <= cut)).drop("lk", "sk", "x", "centre", "inverse")


def rate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
         label: str = "quality") -> DataFrame:
    """One row per row of ``df``: id, statistics, ``base_failed``, ``kept``, ``distance``."""
    small = df.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{text_col}`").alias("__body"), F.col(f"`{lang_col}`").alias("__lang"), F.col(f"`{source_col}`").alias("__source"))
    stats = materialize(measure(small, ["__id", "__lang", "__source"], "__body"), f"{label}-stats")
    cells, model = estimate(stats, "__lang", "__source", label=label)
    judged = judge(stats, cells, model, "__lang", "__source")
    return judged.select(F.col("__id").alias(id_col), *[F.col(s).alias(s[2:]) for s in STATS[:5]], base_failed().alias("base_failed"),
                         F.col("__kept").alias("kept"), F.col("__n_lines").alias("n_lines"), F.col("__distance").alias("distance"))


def keep_good(df: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", label: str = "quality") -> DataFrame:
    """The rows of ``df`` that are not rejected, with all their columns.

    The statistics are taken twice, once for the estimates and once beside the text, so that no text is shuffled.
    """
    packed = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("__row"), F.col(f"`{text_col}`").alias("__body"),
                       F.col(f"`{lang_col}`").alias("__lang"), F.col(f"`{source_col}`").alias("__source"))
    stats = materialize(measure(packed, ["__lang", "__source"], "__body"), f"{label}-stats")
    cells, model = estimate(stats, "__lang", "__source", label=label)
    judged = judge(measure(packed, ["__row", "__lang", "__source"], "__body"), cells, model, "__lang", "__source")
    return judged.where("__kept").select("__row.*")
