"""Line deduplication by an exact set-similarity join.

A line's tokens are its distinct words (split at ASCII white space, A-Z in lower case). Two lines match if the Jaccard
similarity of their token sets is at least ``NUMERATOR / DENOMINATOR``. A line is removed if any line that comes earlier,
by (id, line number), matches it. Lines without a word always stay.

- A first pass counts all tokens in a table of fixed size (2 ** SKETCH_BITS hashed counters). The counters give a global
  order of tokens, rarest first; any global order is right for the filters, a rough one only costs candidates.
- A second pass gives each line its class (the token set) and its prefix tokens in that order.
- Classes meet in the lists of their prefix tokens only: matching sets of n tokens share one of the first
  n - ceil(t n) + 1. Sets of up to three tokens match no other set, so they are in no list. Lists are joined with the length filter, the positional filter and a filter on 64 parity marks of the
  sets, all of which keep every match. Candidates are verified on the whole sets, which are read from the texts again.
- Equal lines are never compared with each other: a class stands at its first line, and its other lines go. Whether the
  first line goes too, only takes one earlier class that matches. So in groups of lines that all match each other, pairs
  are not made: classes are first compared with the earliest class that shares their smallest or largest token hash,
  and only those that this does not settle look for earlier classes in the lists. Candidates pass a last filter on parity marks of
  four bits a token before any set is read, and a single candidate of each class is verified before all others.

Words stand as 64-bit hashes (32 bits in the lists) and classes as 64-bit hashes of these. Removed lines are joined to the documents by id and
hash of the text; they are broadcast if they are few, so texts are shuffled only where much is removed.

Defined results: null and empty texts stay as they are; a text whose lines all go becomes empty; rows that repeat an id
and a text are one document and keep the same lines; rows without an id come first; an empty table gives an empty
result; other columns are passed on unread.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_if_small, materialize
from .common import pieces, text_sizes

NUMERATOR, DENOMINATOR = 4, 5
# sets up to this size match equal sets only
ALONE = (DENOMINATOR - 1) // (DENOMINATOR - NUMERATOR) - 1
SKETCH_BITS = 20
CHUNK_BITS = 14
# classes that a task remembers so as to write their prefix once
REMEMBERED = 150_000
# bytes of text that a worker splits into words at a time
SPLIT_CHARS = 2_000_000
# words up to this many bytes are hashed together, eight bytes at a time
SHORT_WORD = 64


def _words(lines: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words of some texts, and for each word in order its number and its text's place."""
    found = pc.ascii_split_whitespace(pc.ascii_lower(lines.cast(pa.string())))
    words, place = found.flatten(), pc.list_parent_indices(found)
    full = pc.greater(pc.binary_length(words), 0)
    coded = words.filter(full).dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy().astype(np.int64), place.filter(full).to_numpy().astype(np.int64)


def _stirred(h: np.ndarray) -> np.ndarray:
    """Each bit of 64 spread over all others, one to one."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _hashes(words: pa.Array) -> np.ndarray:
    """64-bit hashes of words: eight bytes at a time for all of them together, XXH64 for long ones."""
    words = words.cast(pa.binary())
    n = len(words)
    if not n:
        return np.zeros(0, dtype=np.uint64)
    ends = np.frombuffer(words.buffers()[1], dtype=np.int32)[words.offset:words.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(words.buffers()[2], dtype=np.uint8)[ends[0]:ends[-1]]
    raw, ends = np.concatenate([raw, np.zeros(8, dtype=np.uint8)]), ends - ends[0]
    starts, sizes = ends[:-1], np.diff(ends)
    eight = np.ndarray(shape=(len(raw) - 7,), dtype="<u8", buffer=raw.data, strides=(1,))      # the eight bytes from each byte on
    out = _stirred(sizes.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    for at in range(0, min(int(sizes.max()), SHORT_WORD), 8):
        some = np.flatnonzero((sizes > at) & (sizes <= SHORT_WORD))
        spare = np.maximum(8 - (sizes[some] - at), 0).astype(np.uint64) * np.uint64(8)
        out[some] = _stirred(out[some] ^ (eight[starts[some] + at] << spare))
    for i in np.flatnonzero(sizes > SHORT_WORD).tolist():
        out[i] = xxhash.xxh64_intdigest(raw[starts[i]:starts[i] + sizes[i]].tobytes())
    return out


def _count_words(texts: pa.Array, total: np.ndarray) -> None:
    words, ids, _ = _words(texts)
    bucket = (_hashes(words) & np.uint64(len(total) - 1)).astype(np.int64)
    np.add.at(total, bucket, np.bincount(ids, minlength=len(words)))


def token_counts(df: DataFrame, text_col: str = "text", bits: int = SKETCH_BITS, count: Callable[[pa.Array, np.ndarray], None] = _count_words) -> np.ndarray:
    """Occurrences of words, or of what ``count`` adds up, by the low bits of their hash, over the whole corpus.

    Each task sends its counters in chunks; chunks are summed as a stream where they arrive, and 2 ** bits sums reach the driver.
    """
    chunk = 1 << min(bits, CHUNK_BITS)
    schema = "chunk int, counts binary"

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, dtype=np.int64)
        for batch in batches:
            texts = batch.column(0)
            for lo, hi in pieces(text_sizes(texts)):
                count(texts.slice(lo, hi - lo), total)
        parts = total.reshape(-1, chunk)
        used = [i for i in range(len(parts)) if parts[i].any()]
        yield pa.RecordBatch.from_pydict({"chunk": pa.array(used, pa.int32()), "counts": pa.array([parts[i].tobytes() for i in used], pa.binary())})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                part = np.frombuffer(raw, dtype=np.int64)
                sums[k] = sums[k] + part if k in sums else part
        yield pa.RecordBatch.from_pydict({"chunk": pa.array(list(sums), pa.int32()), "counts": pa.array([s.tobytes() for s in sums.values()], pa.binary())})

    rows = df.select(F.col(f"`{text_col}`").alias("text")).mapInArrow(tally, schema).repartition("chunk").mapInArrow(add, schema)
    out = np.zeros(((1 << bits) // chunk, chunk), dtype=np.int64)
    for r in rows.collect():
        out[r["chunk"]] += np.frombuffer(r["counts"], dtype=np.int64)
    return out.ravel()


def _sorted_lines(texts: pa.Array, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each line with a word its text's place and its number; the tokens of these lines one after another, rarest first, with their
    counts; and where each line's tokens end."""
    split = pc.split_pattern(pc.fill_null(texts, ""), "\n")
    doc = pc.list_parent_indices(split).to_numpy().astype(np.int64)
    words, ids, line_of = _words(split.flatten())
    if not len(words):
        return doc[:0], doc[:0], np.zeros(0, dtype=np.uint64), count[:0], np.zeros(0, dtype=np.int64)
    hashes = _hashes(words)
    found = count[(hashes & np.uint64(len(count) - 1)).astype(np.int64)]
    order = np.lexsort((hashes, found))
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.arange(len(order))
    every = np.sort(line_of * len(words) + rank[ids])
    pair = every[np.concatenate([[True], every[1:] != every[:-1]])]          # distinct words of each line in order
    line, token = pair // len(words), order[pair % len(words)]
    sizes = np.bincount(line, minlength=len(doc))
    chosen = np.flatnonzero(sizes)
    return doc[chosen], (chosen - np.searchsorted(doc, doc[chosen])), hashes[token], found[token], np.cumsum(sizes[chosen])


def prefix_length(n: int) -> int:
    """Tokens of a set of n in one of which any matching set shares: n - ceil(t n) + 1."""
    return n - -(-NUMERATOR * n // DENOMINATOR) + 1


def wide_marks(token: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of marks of sets that lie one after another, and the number of words of each set.

    A bit is flipped by each token that falls on it; half as many words follow by xor of the halves.
    """
    words = np.ones(len(sizes), dtype=np.int64)
    while (few := 16 * words < sizes).any():
        words[few] *= 2
    first = np.repeat(64 * (np.cumsum(words) - words), sizes)
    bit = (token & np.repeat(64 * words - 1, sizes).astype(np.uint64)).astype(np.int64)
    flipped = np.bincount(first + bit, minlength=64 * int(words.sum())) & 1
    return np.packbits(flipped.astype(np.uint8), bitorder="little").view(np.int64), words


def _within(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places starts[i] to starts[i] + sizes[i] - 1 of all i."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


def lines(df: DataFrame, counts: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per line with a token: (id, body, line, class, n, marks, ends, prefix, wide).

    ``marks`` has a bit for each token, flipped by each that falls on it, so two sets differ in at least as many tokens as
    bits. ``ends`` has 32 bits of the smallest and the largest token, ``prefix`` 32 bits of each prefix token, ``wide`` four
    marks a token or more, a power of two of words; all are null where the task has given this class before, and for sets that match no other.
    A prefix token that the whole corpus holds once meets no other set: it is null and keeps its place.
    """
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(F.col(f"`{text_col}`")).alias("body"), F.col(f"`{text_col}`").alias("text"))
    kind = dict(rows.dtypes)["id"]
    schema = f"id {kind}, body long, line int, class long, n int, marks long, ends array<int>, prefix array<int>, wide array<long>"
    shared = df.sparkSession.sparkContext.broadcast(counts.astype(np.uint32) if counts.max(initial=0) < 1 << 32 else counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = shared.value
        seen: set[int] = set()
        for batch in batches:
            texts = batch.column(2)
            for lo, hi in pieces(text_sizes(texts), SPLIT_CHARS):
                part = batch.slice(lo, hi - lo)
                doc, line, token, often, ends = _sorted_lines(texts.slice(lo, hi - lo), count)
                if not len(ends):
                    continue
                sizes = np.diff(ends, prepend=0)
                heads = ends - sizes
                marks = np.bitwise_xor.reduceat(np.uint64(1) << (token >> np.uint64(58)), heads).view(np.int64)
                both = np.stack([np.minimum.reduceat(token, heads), np.maximum.reduceat(token, heads)], axis=1)
                raw, classes, given = token.tobytes(), [], np.zeros(len(ends), dtype=bool)
                for i, (end, n) in enumerate(zip(ends.tolist(), sizes.tolist())):
                    c = xxhash.xxh64_intdigest(raw[8 * (end - n):8 * end])
                    classes.append(c)
                    if n > ALONE and c not in seen:
                        seen.add(c)
                        given[i] = True
                if len(seen) > REMEMBERED:
                    seen = set()
                blank, many = ~given, np.where(given, prefix_length(sizes), 0)
                taken = _within(heads[given], many[given])
                wide, words = wide_marks(token[_within(heads[given], sizes[given])], sizes[given])
                wides = np.zeros(len(ends), dtype=np.int64)
                wides[given] = words
                low = lambda x: (x & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32)
                listed = lambda n, values: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), values, mask=pa.array(blank))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(doc)), part.column(1).take(pa.array(doc)), pa.array(line, pa.int32()),
                     pa.array(np.array(classes, dtype=np.uint64).view(np.int64)), pa.array(sizes.astype(np.int32)), pa.array(marks),
                     listed(2 * given, pa.array(low(both[given]).ravel())), listed(many, pa.array(low(token[taken]), mask=often[taken] == 1)),
                     listed(wides, pa.array(wide))], names=["id", "body", "line", "class", "n", "marks", "ends", "prefix", "wide"])

    return rows.mapInArrow(run, schema)


def token_sets(df: DataFrame, needed: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(class, tokens) of the lines named in ``needed`` (id, body, lines of (line, class)), read from the texts once more."""
    body = F.xxhash64(F.col(f"`{text_col}`"))
    asked = needed.withColumnsRenamed({"id": "asked_id", "body": "asked_body", "lines": "asked_lines"})
    rows = df.select(F.col(f"`{id_col}`").alias("id"), body.alias("body"), F.col(f"`{text_col}`").alias("text"))
    rows = rows.join(broadcast_if_small(asked), F.col("id").eqNullSafe(F.col("asked_id")) & (F.col("body") == F.col("asked_body"))).select("text", "asked_lines")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in pieces(text_sizes(batch.column(0)), SPLIT_CHARS):
                part = batch.slice(lo, hi - lo)
                classes, chosen = [], []
                for text, wanted in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    found = text.split("\n")
                    for w in wanted:
                        classes.append(w["class"])
                        chosen.append(found[w["line"]])
                words, ids, line_of = _words(pa.array(chosen, pa.string()))
                pair = np.unique(line_of * max(1, len(words)) + ids)
                sizes = np.bincount(pair // max(1, len(words)), minlength=len(chosen))
                sets = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(_hashes(words)[pair % max(1, len(words))].view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(classes, pa.int64()), sets], names=["class", "tokens"])

    return rows.mapInArrow(run, "class long, tokens array<long>")


def _place(side: str):
    return F.struct(f"{side}.id", f"{side}.line", f"{side}.class")


def _alike():
    """What every match passes: lengths, and marks; a match leaves at most (d - t) / (d + t) of both sizes outside."""
    t, d = NUMERATOR, DENOMINATOR
    least, most = F.least(F.col("a.n"), F.col("b.n")), F.greatest(F.col("a.n"), F.col("b.n"))
    return (d * least >= t * most) & ((t + d) * F.bit_count(F.col("a.marks").bitwiseXOR(F.col("b.marks"))) <= (d - t) * (F.col("a.n") + F.col("b.n")))


def near_ends(classes: DataFrame) -> DataFrame:
    """Pairs (a, b): class b and the earliest class a that shares its smallest, or its largest, token hash."""
    rows = classes.where("ends IS NOT NULL").select("id", "line", "class", "n", "marks", F.posexplode("ends").alias("end", "token"))
    firsts = rows.groupBy("end", "token").agg(F.min(F.struct("id", "line", "class", "n", "marks")).alias("a"), F.count("*").alias("many")).where("many > 1").drop("many")
    rows = rows.select("end", "token", F.struct("id", "line", "class", "n", "marks").alias("b")).join(broadcast_if_small(firsts), ["end", "token"])
    return rows.where((_place("a") < _place("b")) & _alike()).select(F.col("a.class").alias("a"), F.col("b.class").alias("b")).distinct()


def in_lists(classes: DataFrame, settled: DataFrame) -> DataFrame:
    """Pairs (a, b) of a class b that is not settled and an earlier class a that meets it in a list and passes all filters."""
    t, d = NUMERATOR, DENOMINATOR
    marked = classes.where("prefix IS NOT NULL").join(broadcast_if_small(settled.select("class", F.lit(True).alias("done"))), "class", "left")
    # place in the prefix, and whether the class is open, in one number: both sides need it, so they read one exchange
    posted = marked.select("id", "line", "class", "n", "marks", F.col("done").isNull().cast("int").alias("open"), F.posexplode("prefix").alias("pos", "token"))
    posted = posted.where("token IS NOT NULL").select("id", "line", "class", "n", "marks", "token", (F.col("pos") * 2 + F.col("open")).alias("spot"))
    a, b = posted.alias("a"), posted.alias("b")
    last = F.least(F.col("a.n") - F.shiftright("a.spot", 1), F.col("b.n") - F.shiftright("b.spot", 1))
    later = F.when(F.col("b.spot") % 2 == 1, _place("a") < _place("b")).otherwise(False)
    pairs = a.join(b, (F.col("a.token") == F.col("b.token")) & later & _alike() & ((t + d) * last >= t * (F.col("a.n") + F.col("b.n"))))
    return pairs.select(F.col("a.class").alias("a"), F.col("b.class").alias("b")).distinct()


def close_enough(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (a, b) whose wide marks leave a match possible; long sets fill the 64 marks of the lists, these grow with the set."""
    t, d = NUMERATOR, DENOMINATOR
    side = lambda name: classes.select(F.col("class").alias(name), F.col("n").alias(f"n_{name}"), F.col("wide").alias(f"w_{name}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    # sets of a match differ by a quarter at most, so one has as many words of marks as the other, or twice as many
    half = lambda w: F.zip_with(F.slice(w, F.lit(1), F.shiftright(F.size(w), 1)), F.slice(w, F.shiftright(F.size(w), 1) + 1, F.shiftright(F.size(w), 1)), lambda x, y: x.bitwiseXOR(y))
    a, b = F.col("w_a"), F.col("w_b")
    apart = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: F.bit_count(u.bitwiseXOR(v))), F.lit(0), lambda n, k: n + k)
    bits = F.when(F.size(a) == F.size(b), apart(a, b)).when(F.size(a) > F.size(b), apart(half(a), b)).otherwise(apart(a, half(b)))
    return both.where((t + d) * bits <= (d - t) * (F.col("n_a") + F.col("n_b"))).select("a", "b")


def verified(df: DataFrame, classes: DataFrame, pairs: DataFrame, id_col: str, text_col: str, label: str) -> DataFrame:
    """(class): the b of all ``pairs`` whose whole token sets match."""
    t, d = NUMERATOR, DENOMINATOR
    pairs = materialize(close_enough(pairs, classes), f"{label}-candidates")
    asked = pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct()
    needed = asked.join(classes.select("class", "id", "line", "body"), "class").groupBy("id", "body").agg(F.collect_list(F.struct("line", "class")).alias("lines"))
    sets = materialize(token_sets(df, materialize(needed, f"{label}-needed"), id_col, text_col).dropDuplicates(["class"]), f"{label}-sets")

    def hold(some: DataFrame, name: str) -> DataFrame:
        both = some.join(sets.withColumnsRenamed({"class": "a", "tokens": "x"}), "a").join(sets.withColumnsRenamed({"class": "b", "tokens": "y"}), "b")
        shared = F.size(F.array_intersect("x", "y"))
        return materialize(both.where((t + d) * shared >= t * (F.size("x") + F.size("y"))).select(F.col("b").alias("class")).distinct(), f"{label}-{name}")

    # one match is enough: a single candidate of each b comes first, all others only for those that it does not settle
    settled = hold(pairs.groupBy("b").agg(F.min("a").alias("a")), "one")
    rest = pairs.join(broadcast_if_small(settled.select(F.col("class").alias("b"))), "b", "left_anti")
    return settled.union(hold(rest, "others"))


def removed(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "linedup") -> DataFrame:
    """(id, body, gone): the numbers of the lines that go, for each document that loses any."""
    counts = token_counts(df, text_col)
    table = materialize(lines(df, counts, id_col, text_col), f"{label}-lines")
    classes = table.groupBy("class").agg(F.min(F.struct("id", "line", "body")).alias("first"), F.count("*").alias("many"), F.max("n").alias("n"),
                                         F.max("marks").alias("marks"), F.max("ends").alias("ends"), F.max("prefix").alias("prefix"), F.max("wide").alias("wide"))
    classes = materialize(classes.select("class", "first.*", "many", "n", "marks", "ends", "prefix", "wide"), f"{label}-classes")
    settled = verified(df, classes, near_ends(classes), id_col, text_col, f"{label}-ends")
    settled = settled.union(verified(df, classes, in_lists(classes, settled), id_col, text_col, f"{label}-lists"))
    # a class whose first line goes, or that has more lines than one
    gone = classes.join(settled.withColumn("whole", F.lit(True)), "class", "left").where(F.col("whole") | (F.col("many") > 1)).select(
        "class", F.struct("id", "line").alias("first"), F.coalesce("whole", F.lit(False)).alias("whole"))
    gone = broadcast_if_small(materialize(gone, f"{label}-limits"))
    hit = table.select("id", "body", "line", "class").join(gone, "class").where(F.col("whole") | (F.struct("id", "line") > F.col("first")))
    return hit.groupBy("id", "body").agg(F.array_sort(F.collect_set("line")).alias("gone"))


def _without(lines_col, gone):
    return F.array_join(F.filter(lines_col, lambda _, i: ~F.coalesce(F.array_contains(gone, i), F.lit(False))), "\n")


def dedupe(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "linedup", counts: bool = False) -> DataFrame:
    """``df`` with the later matching lines taken out of the text column; with ``counts`` also ``__lines`` and ``__gone``."""
    gone = materialize(removed(df, id_col, text_col, label), f"{label}-gone").withColumnsRenamed({"id": "gone_id", "body": "gone_body"})
    # the row is one struct beside names of our own, so any name may be its
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"),
                     F.xxhash64(F.col(f"`{text_col}`")).alias("body"))
    rows = rows.join(broadcast_if_small(gone), F.col("id").eqNullSafe(F.col("gone_id")) & (F.col("body") == F.col("gone_body")), "left")
    parts = F.split("text", "\n", -1)
    clean = F.when(F.col("gone").isNull(), F.col("text")).otherwise(_without(parts, F.col("gone")))
    more = [F.when(F.col("text").isNull(), 0).otherwise(F.size(parts)).cast("long").alias("__lines"),
            F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("__gone")] if counts else []
    return rows.select(*[clean.alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in df.columns], *more)


def oracle() -> str:
    t, d = NUMERATOR, DENOMINATOR
    up, low = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
WITH split AS (
  SELECT doc_id, text, unnest(string_split(text, chr(10))) AS body, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents WHERE text <> ''),
worded AS (
  SELECT doc_id, line, list_sort(list_distinct(regexp_extract_all(translate(body, '{up}', '{low}'), '[^\\x20\\x09-\\x0D]+'))) AS words FROM split),
named AS (SELECT doc_id, line, words, len(words) AS n FROM worded WHERE len(words) > 0),
classes AS (SELECT words, any_value(n) AS n, min((doc_id, line)) AS first, row_number() OVER () AS c FROM named GROUP BY words),
tokens AS (SELECT c, n, unnest(words) AS w FROM classes),
df AS (SELECT w, count(*) AS f FROM tokens GROUP BY w),
ranked AS (SELECT c, n, w, row_number() OVER (PARTITION BY c ORDER BY f, w) AS pos FROM tokens JOIN df USING (w)),
prefix AS (SELECT * FROM ranked WHERE pos <= n - ({t} * n + {d - 1}) // {d} + 1),
pairs AS (SELECT DISTINCT a.c AS a, b.c AS b FROM prefix a JOIN prefix b ON a.w = b.w AND a.c < b.c WHERE {d} * least(a.n, b.n) >= {t} * greatest(a.n, b.n)),
good AS (
  SELECT a, b FROM pairs p JOIN classes x ON x.c = p.a JOIN classes y ON y.c = p.b
  WHERE {t + d} * len(list_intersect(x.words, y.words)) >= {t} * (x.n + y.n)),
links AS (SELECT a, b FROM good UNION ALL SELECT b, a FROM good UNION ALL SELECT c, c FROM classes),
start AS (SELECT l.a AS c, min(k.first) AS first FROM links l JOIN classes k ON k.c = l.b GROUP BY l.a),
gone AS (
  SELECT m.doc_id, m.line FROM named m JOIN classes k ON k.words = m.words JOIN start s ON s.c = k.c WHERE (m.doc_id, m.line) > s.first),
kept AS (
  SELECT s.doc_id, string_agg(s.body, chr(10) ORDER BY s.line) AS text FROM split s ANTI JOIN gone g ON g.doc_id = s.doc_id AND g.line = s.line GROUP BY s.doc_id),
number AS (SELECT doc_id, count(*) AS n_removed FROM gone GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN 0 ELSE len(string_split(d.text, chr(10))) END::BIGINT AS n_lines, coalesce(n.n_removed, 0)::BIGINT AS n_removed,
       CASE WHEN d.text IS NOT NULL THEN md5(coalesce(k.text, '')) END AS text_md5
FROM documents d LEFT JOIN kept k USING (doc_id) LEFT JOIN number n USING (doc_id)"""
