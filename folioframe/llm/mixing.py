"""Mixing sources to target weights: tempered shares, a bisected exponent, budgeted block permutations.

A source with share ``p`` of all tokens gets the weight ``p ** a`` (normalised). The exponent is the largest one in
[0, 1] at which the weights' entropy still reaches ``entropy`` (as a part of its maximum), raised to the smallest one at
which no source is repeated more than ``max_repeats`` times, if that is larger; natural shares have exponent one. It is
bisected on a grid of 2 ** -20; one job looks at four halvings at once, over the table of sources.

To realise the weights, each source is cut into blocks by a hash of the id, about ``block_tokens`` tokens each. A source
that gets ``n`` times its own tokens is passed ``floor(n)`` times in full and once in part. Each pass permutes the blocks;
the partial one takes blocks until the budget is used, and the block in which it ends is cut at a document. Only sums per
block and the ids in cut blocks are shuffled, and documents find their block in a small table, so no text moves.

Defined results: tokens are words; a null text has none and is taken with its block; null is a source of its own; a
source without tokens has weight zero and is not taken; repeated rows share a place in the permutation, so they are taken
or left together; rows without an id are placed by their text; an empty table gives an empty result; other columns are
kept by ``mix`` and not read otherwise.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import broadcast_if_small, materialize

ENTROPY = 0.998
MAX_REPEATS = 4.0
BUDGET_RATIO = 1.25
BLOCK_TOKENS = 500_000
BLOCK_DOCS = 50_000
GRID = 20           # the exponent is a multiple of 2 ** -GRID
SEED = "mix"


def tokens_of(text_col: str):
    return F.coalesce(F.regexp_count(F.col(f"`{text_col}`"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _number(*parts):
    """60 bits of an MD5, as a whole number."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 15), 16, 10).cast("long")


def _id(id_col: str, text_col: str):
    return F.coalesce(F.col(f"`{id_col}`").cast("string"), F.concat(F.lit("text:"), F.md5(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))))


def _source(source_col: str):
    """Sources as text in which null is a value: ``=name`` or ``-``."""
    return F.coalesce(F.concat(F.lit("="), F.col(f"`{source_col}`").cast("string")), F.lit("-"))


def _bisect(sources: DataFrame, good, value, keep_low: bool) -> int:
    """Grid point next to the border of a monotone condition: the last good one (good from 0 on) or the first good one.

    ``value`` gives the aggregate over sources at exponent ``a``, ``good`` tests it.
    """
    low, high = 0, 1 << GRID            # keep_low: low is good; otherwise high is
    while high - low > 1:
        step = max(1, (high - low) // 16)
        points = [p for p in range(low + step, high, step)]
        rows = sources.select("share", "n", F.explode(F.array(*[F.lit(p) for p in points])).alias("point"))
        rows = rows.withColumn("a", F.col("point") / float(1 << GRID)).withColumn("u", F.pow("share", F.col("a")))
        seen = {r["point"]: r["good"] for r in rows.groupBy("point").agg(good(value).alias("good")).collect()}
        if keep_low:
            low = max([low, *[p for p in points if seen[p]]])
            high = min([high, *[p for p in points if not seen[p]]])
        else:
            low = max([low, *[p for p in points if not seen[p]]])
            high = min([high, *[p for p in points if seen[p]]])
    return low if keep_low else high


def plan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", entropy: float | None = ENTROPY,
         max_repeats: float | None = MAX_REPEATS, budget_tokens: int | None = None, budget_ratio: float = BUDGET_RATIO,
         block_tokens: int = BLOCK_TOKENS, block_docs: int = BLOCK_DOCS, label: str = "mixing") -> tuple[DataFrame, DataFrame]:
    """(sources, blocks). Sources: tokens, weight, wanted tokens, exponent, blocks. Blocks: how often and when each is taken."""
    docs = materialize(df.select(_source(source_col).alias("src"), _id(id_col, text_col).alias("key"), tokens_of(text_col).alias("tokens")), f"{label}-docs")
    sums = materialize(docs.groupBy("src").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("docs")).where("tokens > 0"), f"{label}-sums")
    total, count = sums.agg(F.sum("tokens"), F.count("*")).first()
    total = total or 0
    budget = budget_tokens if budget_tokens is not None else math.floor(total * budget_ratio)
    shares = sums.withColumn("share", F.col("tokens") / F.lit(float(max(total, 1)))).withColumn("n", F.col("tokens").cast("double"))
    exponent = 1 << GRID
    if count and entropy is not None:
        # with u = share ** a: entropy = log(sum u) - sum(u log u) / sum u
        got = F.log(F.sum("u")) - F.sum(F.col("u") * F.log("u")) / F.sum("u")
        natural = sums.agg(F.log(F.lit(float(total))) - F.sum(F.col("tokens") * F.log("tokens")) / F.lit(float(total))).first()[0]
        goal = entropy * math.log(count)
        if natural < goal:
            exponent = _bisect(shares, lambda v: v >= goal, got, True)
    if count and max_repeats is not None:
        # the most repeated source has the largest u / tokens
        got = F.max(F.col("u") / F.col("n")) / F.sum("u") * float(budget)
        now = shares.withColumn("u", F.pow("share", F.lit(exponent / (1 << GRID)))).agg((got <= max_repeats).alias("ok")).first()[0]
        if not now:
            exponent = max(exponent, _bisect(shares, lambda v: v <= max_repeats, got, False))
    a = exponent / (1 << GRID)
    raw = shares.withColumn("u", F.pow("share", F.lit(a)))
    norm = (raw.agg(F.sum("u")).first()[0] or 1.0)
    sources = raw.select("src", "tokens", "docs", F.lit(a).alias("exponent"), (F.col("u") / norm).alias("weight")) \
        .withColumn("wanted", F.floor(F.round(F.col("weight"), 12) * F.lit(float(budget)))) \
        .withColumn("passes", F.floor(F.col("wanted") / F.col("tokens"))) \
        .withColumn("rest", F.col("wanted") - F.col("passes") * F.col("tokens")) \
        .withColumn("n_blocks", F.greatest(F.ceil(F.col("tokens") / block_tokens), F.ceil(F.col("docs") / block_docs)))
    sources = materialize(sources, f"{label}-sources")
    placed = docs.join(broadcast_if_small(sources.select("src", "n_blocks")), "src").withColumn("block", F.pmod(_number(F.lit(SEED), "key"), F.col("n_blocks")))
    sizes = placed.groupBy("src", "block").agg(F.sum("tokens").alias("block_tokens"), F.count("*").alias("block_docs"))
    sizes = materialize(sizes.join(broadcast_if_small(sources), "src"), f"{label}-sizes")
    passes = sizes.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("passes") + F.when(F.col("rest") > 0, 1).otherwise(0))).alias("epoch")) \
        .where((F.col("passes") > 0) | (F.col("rest") > 0))
    passes = passes.withColumn("turn", _number(F.lit(SEED), "epoch", "src", "block"))
    w = Window.partitionBy("src", "epoch").orderBy("turn", "block")
    passes = passes.withColumn("place", F.row_number().over(w).cast("long")).withColumn(
        "before", F.coalesce(F.sum("block_tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    passes = passes.withColumn("left", F.when(F.col("epoch") <= F.col("passes"), F.lit((1 << 62))).otherwise(F.col("rest") - F.col("before")))
    passes = materialize(passes.where("left > 0"), f"{label}-passes")
    # the last document of a cut block: the running sum before it is still below what is left; ties go together
    cut = passes.where("left < block_tokens").select("src", "block", "epoch", "left")
    inside = placed.select("src", "block", "key", "tokens").join(broadcast_if_small(cut), ["src", "block"]) \
        .withColumn("turn", _number(F.lit(SEED), "epoch", "key"))
    w = Window.partitionBy("src", "block", "epoch").orderBy("turn")
    ends = inside.withColumn("upto", F.sum("tokens").over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow))) \
        .withColumn("own", F.sum("tokens").over(Window.partitionBy("src", "block", "epoch", "turn"))) \
        .where(F.col("upto") - F.col("own") < F.col("left")).groupBy("src", "block", "epoch").agg(F.max("turn").alias("last"))
    blocks = passes.join(ends, ["src", "block", "epoch"], "left").select(
        "src", "block", "epoch", "n_blocks", "place", "before", "tokens", "wanted", F.when(F.col("left") >= F.col("block_tokens"), F.lit((1 << 62))).otherwise(F.coalesce("last", F.lit(-1))).alias("last"))
    return sources, materialize(blocks, f"{label}-blocks")


def _taken(rows: DataFrame, sources: DataFrame, blocks: DataFrame) -> DataFrame:
    """Rows with ``__src`` and ``__key`` repeated for each pass that takes them, with ``__pass`` and the block's columns."""
    counts = broadcast_if_small(sources.select(F.col("src").alias("__src"), F.col("n_blocks").alias("__n")))
    placed = rows.join(counts, "__src").withColumn("__block", F.pmod(_number(F.lit(SEED), "__key"), F.col("__n")))
    packed = blocks.select(F.col("src").alias("__src"), F.col("block").alias("__block"), F.struct("epoch", "block", "place", "last",
                           ((F.col("epoch") - 1) * F.col("tokens") + F.col("before")).alias("done"), "wanted").alias("__pass"))
    hit = placed.join(broadcast_if_small(packed), ["__src", "__block"])
    return hit.where(_number(F.lit(SEED), "__pass.epoch", "__key") <= F.col("__pass.last"))


def select(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """One row per copy that is taken: id, source, tokens, ``epoch``, ``block``, ``block_place`` in its pass, and ``schedule``,
    the part of the source's budget that comes before the block: in that order, every prefix has the wanted weights."""
    sources, blocks = plan(df, id_col, text_col, source_col, **options)
    rows = df.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{source_col}`").alias("__source"), tokens_of(text_col).alias("__tokens"),
                     _source(source_col).alias("__src"), _id(id_col, text_col).alias("__key"))
    return _taken(rows, sources, blocks).select(
        F.col("__id").alias(id_col), F.col("__source").alias(source_col), F.col("__tokens").alias("tokens"), F.col("__pass.epoch").alias("epoch"),
        F.col("__pass.block").alias("block"), F.col("__pass.place").alias("block_place"),
        F.round(F.col("__pass.done") / F.col("__pass.wanted"), 9).alias("schedule"))


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The rows of ``df``, each as often as it is taken, with all columns."""
    sources, blocks = plan(df, id_col, text_col, source_col, **options)
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("__row"), _source(source_col).alias("__src"), _id(id_col, text_col).alias("__key"))
    return _taken(rows, sources, blocks).select("__row.*")


def oracle(entropy: float = ENTROPY, max_repeats: float = MAX_REPEATS, budget_ratio: float = BUDGET_RATIO) -> str:
    n = "('0x' || substr(md5(concat_ws(':', {})), 1, 15))::BIGINT"
    top = 1 << GRID
    pw = f"list_transform(shares, lambda s: pow(s, mid / {top}.0))"
    return f"""
WITH RECURSIVE docs AS (
  SELECT doc_id, source, coalesce('=' || source, '-') AS src, coalesce(CAST(doc_id AS VARCHAR), 'text:' || md5(coalesce(text, ''))) AS key,
         coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS tokens FROM documents),
sums AS (SELECT src, sum(tokens)::BIGINT AS tokens, count(*) AS docs FROM docs GROUP BY src HAVING sum(tokens) > 0),
tot AS (SELECT sum(tokens)::DOUBLE AS total, count(*) AS k FROM sums),
lists AS (SELECT list(tokens / total ORDER BY src) AS shares, list(tokens::DOUBLE ORDER BY src) AS ns, any_value(total) AS total, any_value(k) AS k FROM sums, tot),
ent(lo, hi) AS (
  SELECT 0, {top} UNION ALL
  SELECT CASE WHEN ok THEN mid ELSE lo END, CASE WHEN ok THEN hi ELSE mid END FROM (
    SELECT lo, hi, mid, ln(list_sum(u)) - list_sum(list_transform(u, lambda x: x * ln(x))) / list_sum(u) >= {entropy} * ln(k) AS ok FROM (
      SELECT lo, hi, mid, k, {pw} AS u FROM (SELECT lo, hi, (lo + hi) // 2 AS mid FROM ent WHERE hi - lo > 1), lists))),
nat AS (SELECT CASE WHEN -list_sum(list_transform(shares, lambda s: s * ln(s))) >= {entropy} * ln(k) THEN {top} ELSE (SELECT max(lo) FROM ent) END AS e FROM lists),
rep(lo, hi) AS (
  SELECT 0, {top} UNION ALL
  SELECT CASE WHEN ok THEN lo ELSE mid END, CASE WHEN ok THEN mid ELSE hi END FROM (
    SELECT lo, hi, mid, list_max(list_transform(list_zip(u, ns), lambda x: x[1] / x[2])) / list_sum(u) * floor(total * {budget_ratio}) <= {max_repeats} AS ok FROM (
      SELECT lo, hi, mid, ns, total, {pw} AS u FROM (SELECT lo, hi, (lo + hi) // 2 AS mid FROM rep WHERE hi - lo > 1), lists))),
expo AS (SELECT greatest((SELECT e FROM nat), CASE WHEN {max_repeats} >= (
           SELECT list_max(list_transform(list_zip(u, ns), lambda x: x[1] / x[2])) / list_sum(u) * floor(total * {budget_ratio}) FROM (
             SELECT ns, total, list_transform(shares, lambda s: pow(s, e / {top}.0)) AS u FROM lists, nat)) THEN 0 ELSE (SELECT min(hi) FROM rep) END) AS e),
raw AS (SELECT src, tokens, docs, total, pow(tokens / total, e / {top}.0) AS u FROM sums, tot, expo),
sources AS (
  SELECT *, (wanted // tokens) AS passes, wanted % tokens AS rest, greatest(ceil(tokens / {BLOCK_TOKENS}.0), ceil(docs / {BLOCK_DOCS}.0))::BIGINT AS n_blocks FROM (
    SELECT src, tokens, docs, floor(round(u / sum(u) OVER (), 12) * floor(total * {budget_ratio}))::BIGINT AS wanted FROM raw)),
placed AS (SELECT d.*, {n.format(f"'{SEED}', key")} % n_blocks AS block FROM docs d JOIN sources USING (src)),
sizes AS (SELECT src, block, sum(tokens)::BIGINT AS block_tokens FROM placed GROUP BY ALL),
passes AS (
  SELECT *, CASE WHEN epoch <= passes THEN 4611686018427387904 ELSE rest - before END AS lft FROM (
    SELECT *, row_number() OVER w AS place, coalesce(sum(block_tokens) OVER (PARTITION BY src, epoch ORDER BY turn, block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM (
      SELECT z.src, z.block, z.block_tokens, s.tokens, s.wanted, s.passes, s.rest, epoch, {n.format(f"'{SEED}', epoch, z.src, z.block")} AS turn
      FROM sizes z JOIN sources s USING (src), LATERAL (SELECT unnest(range(1, s.passes + CASE WHEN s.rest > 0 THEN 2 ELSE 1 END)) AS epoch))
    WINDOW w AS (PARTITION BY src, epoch ORDER BY turn, block))),
inside AS (
  SELECT p.doc_id, p.source, p.key, p.tokens, q.src, q.block, q.epoch, q.place, q.lft, q.block_tokens, (q.epoch - 1) * q.tokens + q.before AS done, q.wanted,
         {n.format(f"'{SEED}', q.epoch, p.key")} AS turn
  FROM placed p JOIN passes q ON p.src = q.src AND p.block = q.block WHERE q.lft > 0),
summed AS (
  SELECT *, sum(tokens) OVER (PARTITION BY src, block, epoch ORDER BY turn RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
          - sum(tokens) OVER (PARTITION BY src, block, epoch, turn) AS upto FROM inside)
SELECT doc_id, source, tokens, epoch::BIGINT AS epoch, block::BIGINT AS block, place::BIGINT AS block_place, round(done / wanted::DOUBLE, 9) AS schedule
FROM summed WHERE lft >= block_tokens OR upto < lft"""
