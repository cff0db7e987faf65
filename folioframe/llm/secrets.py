"""Secret scans: fixed patterns, and a battery of randomness tests with false-discovery control.

Candidates are maximal runs of 20 or more encoding symbols. Each gets the narrowest encoding that holds its symbols, and
three statistics over that alphabet: chi-squared distance from uniform use, runs of one class of symbols (capitals, small letters,
digits, signs), and serial correlation of neighbours. Each has a known law if the symbols are random, and another if they are
ordinary text, whose symbol and neighbour frequencies are counted over the whole corpus outside of candidates, so that keys do not
make up the law of text. Alphabets of capitals only take the law of text with its case folded. Text is taken to change class at
least every twentieth symbol, as identifiers and paths do. A candidate is reported if

- the battery does not reject randomness (each test at ``ALPHA / 3``), and
- ordinary text is rejected: the three distances from its law, weighted by how far a random string of that length is
  expected to lie from it, give one p-value, and the p-values of each stratum (encoding and length class) go through the
  Benjamini-Hochberg procedure at rate ``FDR``. P-values are rounded up to a fixed grid, so the procedure needs only
  counts per stratum and grid point, and is exact on the rounded values.

Decimal strings are no candidates: digits of ordinary numbers are as good as random. Reported runs inside or across a fixed-pattern match add nothing and are left out.

Defined results: a null or empty text has no spans; repeated rows count as often as they occur and get equal results;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from ..session import materialize
from .common import map_texts

MIN_RUN = 20
ALPHA = 1e-3
FDR = 1e-3
GRID_PER_DECADE = 8
GRID_TOP = 400
TEXT_CHANGES = 0.05

# fixed patterns
ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ["assign", "access", "hex", "random"]
KEYWORDS = ("password", "passwd", "secret", "token", "api")
MIN_VALUE, MIN_ACCESS, MIN_HEX = 6, 20, 24

SYMBOLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_"
RUN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{%d,}" % MIN_RUN)
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# narrowest first
ENCODINGS = {"decimal": DIGITS, "hex": DIGITS + "abcdef", "HEX": DIGITS + "ABCDEF", "base32": UPPER + "234567", "lower": DIGITS + LOWER,
             "upper": DIGITS + UPPER, "base62": UPPER + LOWER + DIGITS, "base64": UPPER + LOWER + DIGITS + "+/", "base64url": UPPER + LOWER + DIGITS + "-_",
             "mixed": SYMBOLS}
LENGTHS = (20, 24, 32, 40, 48, 64, 96, 128)


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns' matches, in order."""
    if not text:
        return []
    found = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= MIN_VALUE]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    for run in RUN.finditer(text):      # longer hexadecimal runs lie inside such a run
        if len(run[0]) >= MIN_HEX:
            found += [(m.start(), 2, m.end()) for m in HEX.finditer(text, run.start(), run.end()) if m.end() - m.start() >= MIN_HEX]
    return sorted(found)


def show(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def normal_tail(z: float) -> float:
    """Probability that a standard normal variable is below ``z``."""
    return 0.5 * math.erfc(-z / math.sqrt(2))


class Battery:
    """The tests of one encoding; ``pairs`` counts neighbours of SYMBOLS in ordinary text."""

    def __init__(self, alphabet: str, pairs: np.ndarray):
        at = [SYMBOLS.index(c) for c in alphabet]
        if not set(alphabet) & set(LOWER):      # text is seldom in capitals: small letters stand for them
            fold = [SYMBOLS.index(c.lower()) for c in SYMBOLS]
            pairs = pairs + np.where(np.arange(len(SYMBOLS)) != fold, 1, 0)[:, None] * pairs[fold, :]
            pairs = pairs + np.where(np.arange(len(SYMBOLS)) != fold, 1, 0)[None, :] * pairs[:, fold]
        table = pairs[np.ix_(at, at)] + 1e-3            # neighbours within the alphabet
        table = table / table.sum()
        use = (table.sum(axis=0) + table.sum(axis=1)) / 2
        self.size = len(alphabet)
        self.code = {c: i for i, c in enumerate(alphabet)}
        self.s2, self.s3 = float((use ** 2).sum()), float((use ** 3).sum())
        self.kind = np.array([0 if c in UPPER else 1 if c in LOWER else 2 if c in DIGITS else 3 for c in alphabet])
        self.change = max(TEXT_CHANGES, float(table[self.kind[:, None] != self.kind[None, :]].sum()))
        share = np.bincount(self.kind) / self.size
        p2, p3 = float((share ** 2).sum()), float((share ** 3).sum())
        self.random_change = 1 - p2
        # neighbouring changes are not independent
        self.change_spread = lambda n: (n - 1) * p2 * (1 - p2) + 2 * (n - 2) * (p3 - p2 * p2)
        x = np.arange(self.size)
        mean = float((use * x).sum())
        self.serial = float(((x - mean)[:, None] * (x - mean)[None, :] * table).sum() / ((use * (x - mean) ** 2).sum()))

    def statistics(self, run: str) -> tuple[float, float, float]:
        codes = np.array([self.code[c] for c in run])
        n = len(codes)
        chi = self.size / n * float((np.bincount(codes, minlength=self.size).astype(float) ** 2).sum()) - n
        kind = self.kind[codes]
        runs = 1 + int((kind[1:] != kind[:-1]).sum())
        d = codes - codes.mean()
        spread = float((d * d).sum())
        return chi, runs, float((d[1:] * d[:-1]).sum()) / spread if spread else 1.0

    def laws(self, n: int) -> tuple[list, list]:
        """(mean, deviation) of the three statistics for random symbols and for ordinary text."""
        k, s2, s3, c = self.size, self.s2, self.s3, self.change
        spread = 2 * n * (n - 1) * (s2 + 2 * (n - 2) * s3 - (2 * n - 3) * s2 * s2)
        random = [(k - 1, math.sqrt(2 * (k - 1) * (n - 1) / n)), (1 + (n - 1) * self.random_change, math.sqrt(max(self.change_spread(n), 1e-9))),
                  (-1 / n, 1 / math.sqrt(n))]
        text = [(k * (1 + (n - 1) * s2) - n, k / n * math.sqrt(max(spread, 1e-9))), (1 + (n - 1) * c, math.sqrt((n - 1) * c * (1 - c) + 1e-9)),
                (self.serial - 1 / n, 1 / math.sqrt(n))]
        return random, text

    def test(self, run: str) -> tuple[bool, float]:
        """Whether randomness is not rejected, and the p-value of ordinary text."""
        seen, (random, text) = self.statistics(run), self.laws(len(run))
        k = self.size - 1
        # the chi-squared law by the cube root, upper tail; the others on both sides
        cube = ((max(seen[0], 1e-9) / k) ** (1 / 3) - (1 - 2 / (9 * k))) / math.sqrt(2 / (9 * k))
        tails = [normal_tail(-cube)] + [2 * normal_tail(-abs(seen[i] - random[i][0]) / random[i][1]) for i in (1, 2)]
        weights = [(random[i][0] - text[i][0]) / text[i][1] for i in range(3)]
        norm = math.sqrt(sum(w * w for w in weights))
        z = sum(w * (seen[i] - text[i][0]) / text[i][1] for i, w in enumerate(weights)) / norm if norm else 0.0
        return min(tails) >= ALPHA / 3, normal_tail(-z)


def encoding_of(run: str) -> str:
    used = set(run)
    return next((name for name, alphabet in ENCODINGS.items() if used <= set(alphabet)), "")


def candidates(text: str | None, batteries: dict[str, Battery]) -> list[tuple[int, int, int, int, bool]]:
    """(start, end, stratum, grid point, random) of each run; stratum numbers encoding and length class."""
    out = []
    for m in RUN.finditer(text) if text else ():
        body = m[0].rstrip("=")
        lead = len(body) - len(body.lstrip("="))
        body = body[lead:]
        for part in re.finditer("[^=]+", body) if "=" in body else [None]:
            run, offset = (body, 0) if part is None else (part[0], part.start())
            name = encoding_of(run)
            if len(run) < MIN_RUN or name in ("", "decimal"):
                continue
            random, p = batteries[name].test(run)
            start = m.start() + lead + offset
            stratum = list(ENCODINGS).index(name) * len(LENGTHS) + sum(len(run) >= x for x in LENGTHS) - 1
            point = GRID_TOP if p <= 0 else min(GRID_TOP, math.floor(-math.log10(p) * GRID_PER_DECADE))
            out.append((start, start + len(run), stratum, max(0, point), random))
    return out


def neighbour_counts(df: DataFrame, text_col: str = "text") -> np.ndarray:
    """How often each of SYMBOLS follows each other in the whole corpus; at most 66 x 66 rows reach the driver."""
    size = len(SYMBOLS)

    def run(batches):
        place = np.full(256, size, dtype=np.int64)
        for i, c in enumerate(SYMBOLS):
            place[ord(c)] = i
        total = np.zeros((size + 1) ** 2, dtype=np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                text = RUN.sub(" ", text) if text else ""
                if len(text) > 1:
                    codes = place[np.frombuffer(text.encode(), dtype=np.uint8)]
                    total += np.bincount(codes[:-1] * (size + 1) + codes[1:], minlength=len(total))
        used = np.nonzero(total)[0]
        yield pa.RecordBatch.from_pydict({"code": pa.array(used, pa.int32()), "n": pa.array(total[used], pa.int64())})

    rows = df.select(F.col(f"`{text_col}`").alias("text")).mapInArrow(run, "code int, n long").groupBy("code").agg(F.sum("n").alias("n")).collect()
    out = np.zeros((size + 1) ** 2)
    for r in rows:
        out[r["code"]] = r["n"]
    return out.reshape(size + 1, size + 1)[:size, :size]


def thresholds(found: DataFrame, rate: float = FDR) -> dict[int, int]:
    """Smallest grid point that is reported, by stratum."""
    counts = found.select(F.explode("runs").alias("r")).groupBy("r.stratum", "r.point").count().collect()   # strata x grid points
    out: dict[int, int] = {}
    for stratum in {r["stratum"] for r in counts}:
        at = np.zeros(GRID_TOP + 1)
        for r in counts:
            if r["stratum"] == stratum:
                at[r["point"]] = r["count"]
        above = np.cumsum(at[::-1])[::-1]
        passing = np.nonzero((10.0 ** (-np.arange(GRID_TOP + 1) / GRID_PER_DECADE) <= rate * above / at.sum()) & (above > 0))[0]
        if len(passing):
            out[stratum] = int(passing[0])
    return out


def scan(df: DataFrame, keep: list[str], pairs: np.ndarray, text_col: str = "text") -> DataFrame:
    """``keep`` columns, ``base`` (spans of the fixed patterns), ``base_sha256`` and ``runs`` (all candidates)."""
    span = StructType([StructField("start", LongType()), StructField("kind", IntegerType()), StructField("end", LongType())])
    run = StructType([StructField("start", LongType()), StructField("end", LongType()), StructField("stratum", IntegerType()),
                      StructField("point", IntegerType()), StructField("random", IntegerType())])
    schema = StructType([StructField("base", ArrayType(span)), StructField("base_sha256", StringType()), StructField("runs", ArrayType(run))])

    def make():
        batteries = {name: Battery(alphabet, pairs) for name, alphabet in ENCODINGS.items()}

        def work(texts: list) -> list:
            base, digests, runs = [], [], []
            for text in texts:
                spans = base_spans(text)
                base.append([{"start": a, "kind": k, "end": b} for a, k, b in spans])
                digests.append(hashlib.sha256(show(spans).encode()).hexdigest())
                runs.append([{"start": a, "end": b, "stratum": s, "point": p, "random": int(r)} for a, b, s, p, r in candidates(text, batteries)])
            return [base, digests, runs]

        return work

    return map_texts(df, text_col, keep, schema, make)


def find(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = FDR, label: str = "secrets") -> DataFrame:
    """One row per row of ``df``: id, ``spans`` (start, kind, end) in order, the fixed ones among them as ``base``."""
    rows = df.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{text_col}`").alias("__body"))
    pairs = neighbour_counts(rows, "__body")
    found = materialize(scan(rows, ["__id"], pairs, "__body"), label)
    limits = thresholds(found, rate)
    lowest = F.array(*[F.lit(limits.get(s, GRID_TOP + 1)) for s in range(len(ENCODINGS) * len(LENGTHS))])
    apart = lambda r: ~F.exists("base", lambda b: (b["start"] < r["end"]) & (r["start"] < b["end"]))
    added = F.filter("runs", lambda r: (r["random"] == 1) & (r["point"] >= F.get(lowest, r["stratum"])) & apart(r))
    added = F.transform(added, lambda r: F.struct(r["start"].alias("start"), F.lit(3).alias("kind"), r["end"].alias("end")))
    return found.select(F.col("__id").alias(id_col), "base", "base_sha256", F.array_sort(F.concat("base", added)).alias("spans"))


def report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts per kind, digest of the fixed spans and all spans as text."""
    found = find(df, id_col, text_col)
    names = F.array(*[F.lit(k) for k in KINDS])
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    text = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")
    return found.select(id_col, *[count(k).alias(f"n_{name}") for k, name in enumerate(KINDS[:3])], "base_sha256", text.alias("spans"), count(3).alias("n_random"))
