"""Personal data by patterns and bootstrapped contexts, in DataFrame operations only.

Fixed patterns find e-mail addresses, IP addresses, card and phone numbers; these are the seeds. Every token that looks
like an identifier (it holds a digit or ``@``) is a mention: an instance (the token without outer punctuation, in lower
case) in a context (the two whole words before the word in which it starts, digits as 0; seeds by the same rule). Contexts are the lexical patterns. The graph of distinct
(pattern, instance) pairs is scored in rounds, per kind: a pattern's confidence is the sum of its instances' scores over
their number plus one; an instance is a seed (score 1), or has one minus the product of the doubts of its confident
patterns. In the end mentions of instances that are no seeds, with a score of ``ACCEPT`` or more from patterns with
``MIN_SUPPORT`` or more instances, are reported as ``context`` spans.

Positions come from the texts between the matches: their lengths and those of the matches are summed up, in blocks, so
that the cost stays far below quadratic in the number of matches. Patterns are written so that they run in linear time
and without recursion (possessive repeats, starts that are not inside a run).

Defined results: a null or empty text has no spans; repeated rows get equal results; an empty table gives an empty
result; other columns are not read; positions are code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize

KINDS = ["email", "ip", "card", "phone"]
# fixed patterns, in a form that never goes back into a run
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9]){11,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
GATES = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){11}", "phone": r"\+[0-9]"}
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]"
ROUNDS = 3
MIN_SUPPORT = 3
CONFIDENT = 0.5
ACCEPT = 0.6
SCORE_DECIMALS = 9
MIN_CHARS = 4


def located(df: DataFrame, text: str, pattern: str, gate: str, out: str) -> DataFrame:
    """Add ``out``: array of (start, value, end), the leftmost non-overlapping matches with their places.

    ``gate`` is a pattern that any text with a match holds. For mentions the texts between them stay as ``mention_s``.
    """
    hit = F.col(text).rlike(gate)
    none = F.array().cast("array<string>")
    m, s, n, b = f"{out}_m", f"{out}_s", f"{out}_n", f"{out}_b"
    df = df.withColumns({m: F.when(hit, F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))).otherwise(none),
                         s: F.when(hit, F.split(F.col(text), pattern, -1)).otherwise(none)})
    # gap before each match and the match: lengths in turn
    df = df.withColumn(n, F.transform(F.col(m), lambda v, i: F.length(F.get(F.col(s), i)) + F.length(v)))
    size = F.greatest(F.ceil(F.sqrt(F.size(n))).cast("int"), F.lit(1))
    add = lambda a, v: a + v
    df = df.withColumn(b, F.when(F.size(n) == 0, F.array().cast("array<int>")).otherwise(F.transform(
        F.sequence(F.lit(0), F.floor((F.size(n) - 1) / size).cast("int")), lambda k: F.aggregate(F.slice(n, k * size + 1, size), F.lit(0), add))))
    df = df.withColumn(b, F.transform(F.col(b), lambda _, k: F.aggregate(F.slice(b, F.lit(1), k), F.lit(0), add)))
    end = lambda i: F.get(F.col(b), F.floor(i / size).cast("int")) + F.aggregate(
        F.slice(n, (F.floor(i / size) * size + 1).cast("int"), (i % size + 1).cast("int")), F.lit(0), add)
    spans = F.transform(F.col(m), lambda v, i: F.struct((end(i) - F.length(v)).alias("start"), v.alias("value"), end(i).alias("end")))
    return df.withColumn(out, spans).drop(m, n, b) if out == "mention" else df.withColumn(out, spans).drop(m, s, n, b)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """True if the digit string passes: from the right, every second digit doubled and reduced by 9 if above it."""
    doubled = lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2))
    return F.aggregate(F.transform(F.split(F.reverse(number), ""), doubled), F.lit(0), lambda a, v: a + F.coalesce(v, F.lit(0))) % 10 == 0


def valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(?:\.|$)){4}$")
    if kind == "card":
        return F.length(digits(value)).between(12, 19) & luhn(digits(value))
    if kind == "phone":
        return F.length(digits(value)).between(9, 15)
    return F.lit(True)


def base_spans(df: DataFrame, text: str) -> DataFrame:
    """Add ``base``: array of (start, kind, end, value) of the fixed patterns, ordered by start and kind."""
    for kind in KINDS:
        df = located(df, text, PATTERNS[kind], GATES[kind], kind)

    def passing(k: int, kind: str) -> Column:
        return F.transform(F.filter(F.col(kind), lambda m: valid(kind, m["value"])),
                           lambda m: F.struct(m["start"].alias("start"), F.lit(k).alias("kind"), m["end"].alias("end"), m["value"].alias("value")))

    found = [passing(k, kind) for k, kind in enumerate(KINDS)]
    return df.withColumn("base", F.array_sort(F.concat(*found))).drop(*KINDS)


def context(words: Column) -> Column:
    """The last two of the words before a mention, in lower case and with 0 for digits."""
    last = F.slice(F.concat(F.array(F.lit("^"), F.lit("^")), words), -2, 2)
    return F.regexp_replace(F.lower(F.array_join(last, " ")), "[0-9]", "0")


def mentions(df: DataFrame, text: str) -> DataFrame:
    """Add ``mentions``: array of (start, end, instance, pattern, kind): the seeds in ``base``, and all other identifier-like
    tokens of four or more symbols, with null kind."""
    token = rf"(?<!{WORD})(?:[^0-9@\x20\x09-\x0D]*+[0-9@]){WORD}*+"
    df = located(df, text, token, "[0-9@]", "mention")
    inner = r"[\p{L}\p{N}+](?:.*[\p{L}\p{N}])?"
    core = lambda v: F.regexp_extract(v, inner, 0)
    # words with a digit or @ are mentions, so the two words before one are in the gap before it, the mention before that and so on
    words = lambda s: F.filter(F.split(s, SPACE + "+"), lambda w: w != "")
    df = df.withColumn("mention_w", F.transform("mention_s", lambda s: words(s)))
    df = df.withColumn("mention_w", F.transform("mention_w", lambda w: F.slice(w, F.greatest(F.size(w) - 1, F.lit(1)), 2)))
    value = lambda i: F.array_compact(F.array(F.get(F.col("mention"), i)["value"]))
    gap = lambda i: F.coalesce(F.get(F.col("mention_w"), i), F.array().cast("array<string>"))
    df = df.withColumn("mention_c", F.transform("mention", lambda _, i: context(F.concat(value(i - 2), gap(i - 1), value(i - 1), gap(i)))))
    all_of = F.transform(F.col("mention"), lambda m, i: F.struct(
        (m["start"] + F.instr(m["value"], core(m["value"])) - 1).alias("start"), F.lower(core(m["value"])).alias("instance"), F.get(F.col("mention_c"), i).alias("pattern"),
        F.length(core(m["value"])).alias("n")))
    apart = lambda m: ~F.exists("base", lambda b: (b["start"] < m["start"] + m["n"]) & (m["start"] < b["end"]))
    free = F.transform(F.filter(all_of, lambda m: (m["n"] >= MIN_CHARS) & apart(m)), lambda m: F.struct(
        m["start"].alias("start"), (m["start"] + m["n"]).alias("end"), m["instance"].alias("instance"), m["pattern"].alias("pattern"), F.lit(None).cast("int").alias("kind")))
    # every seed starts in a word with a digit or @, the last mention that starts no later
    within = lambda b: F.get(F.col("mention_c"), F.size(F.filter(F.col("mention"), lambda m: m["start"] <= b["start"])) - 1)
    seeds = F.transform(F.col("base"), lambda b: F.struct(
        b["start"].alias("start"), b["end"].alias("end"), F.lower(b["value"]).alias("instance"), within(b).alias("pattern"), b["kind"].alias("kind")))
    return df.withColumn("mentions", F.concat(free, seeds)).drop("mention", "mention_s", "mention_w", "mention_c")


def score(seen: DataFrame, rounds: int = ROUNDS, min_support: int = MIN_SUPPORT, confident: float = CONFIDENT, label: str = "pii") -> DataFrame:
    """Scores of instances from the graph of ``seen`` (pattern, instance, kind or null): rows (instance, kind, score), seeds left out."""
    edges = materialize(seen.groupBy("pattern", "instance").agg(F.max("kind").alias("kind")), f"{label}-edges")
    seeds = materialize(edges.where("kind is not null").groupBy("instance").agg(F.max("kind").alias("kind")).withColumn("score", F.lit(1.0)), f"{label}-seeds")
    graph = materialize(edges.select("pattern", "instance"), f"{label}-graph")
    support = graph.groupBy("pattern").agg(F.count("*").alias("n")).where(F.col("n") >= min_support)
    known, found = seeds, None
    for _ in range(rounds):
        sums = graph.join(known, "instance").groupBy("pattern", "kind").agg(F.sum("score").alias("s"))
        good = sums.join(support, "pattern").withColumn("c", F.round(F.col("s") / (F.col("n") + 1), SCORE_DECIMALS)).where(F.col("c") >= confident)
        reached = graph.join(good.select("pattern", "kind", "c"), "pattern").groupBy("instance", "kind").agg(F.sum(F.log1p(-F.least("c", F.lit(1 - 1e-9)))).alias("doubt"))
        reached = reached.join(seeds.select("instance"), "instance", "left_anti").select("instance", "kind", F.round(1 - F.exp("doubt"), SCORE_DECIMALS).alias("score"))
        best = F.max_by(F.struct("kind", "score"), F.struct("score", -F.col("kind")))
        found = materialize(reached.groupBy("instance").agg(best.alias("b")).select("instance", "b.*"), f"{label}-found")
        known = seeds.union(found)
    return found


def find(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", accept: float = ACCEPT, label: str = "pii", **options) -> DataFrame:
    """One row per row of ``df``: id, ``base`` and ``found`` (start, kind, end, value), the latter by context."""
    rows = df.select(F.col(f"`{id_col}`").alias("__id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("__body"))
    rows = mentions(base_spans(rows, "__body"), "__body").select("__id", "base", "mentions")
    table = materialize(rows.withColumn("__row", F.monotonically_increasing_id()), f"{label}-rows")      # numbered once, as it is written
    seen = table.where(F.size("mentions") > 0).select("__row", F.explode("mentions").alias("m")).select("__row", "m.*")
    scores = score(seen.select("pattern", "instance", "kind"), label=label, **options)
    hits = seen.where("kind is null").drop("kind").join(scores.where(F.col("score") >= accept), "instance")
    spans = hits.groupBy("__row").agg(F.array_sort(F.collect_set(F.struct("start", "kind", "end", F.col("instance").alias("value")))).alias("found"))
    empty = F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>")
    return table.join(spans, "__row", "left").select(F.col("__id").alias(id_col), "base", F.coalesce("found", empty).alias("found"))


def report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts per kind, digest of the fixed spans, all spans as text."""
    rows = find(df, id_col, text_col)
    names = F.array(*[F.lit(k) for k in KINDS], F.lit("context"))
    show = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["k"]), s["start"], s["end"])), ",")
    plain = lambda col, kind: F.transform(col, lambda s: F.struct(s["start"].alias("start"), (s["kind"] if kind is None else F.lit(kind)).alias("k"), s["end"].alias("end")))
    every = F.array_sort(F.concat(plain("base", None), plain("found", len(KINDS))))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return rows.select(id_col, *[count(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)],
                       F.sha2(show(plain("base", None)), 256).alias("base_sha256"), show(every).alias("spans"),
                       F.size("found").cast("long").alias("n_context"), F.size(every).cast("long").alias("n_spans"))
