"""Main text of web pages by a maximum-scoring subsequence of words and tags.

A page is a sequence of words and tags. A word scores ``WORD`` plus, and a tag minus the weight of its kind; the contiguous run of
the highest sum is the content region. Weights come from labelled pages: a page whose markup names its content by exactly one
``<article>`` (or, without one, exactly one ``<main>``) labels its own tokens as inside or outside. Spark counts the kinds of tags
over all such pages, and a kind's weight is the log-odds of standing outside against inside, at least ``LEAST``. A kind is the tag's
name, opening or closing. Tags that open and close the labelled element itself count as outside, so the best run begins behind and
ends before them. Weights above ``LEAST`` are then multiplied by that one of ``SCALES`` (the first among equals) whose best runs
misplace the fewest words over all labelled pages.

Elements that never hold content (scripts, styles, menus, page headers and footers, sidebars, forms, and those whose class, id
or role names an advert, a notice, comments and the like) are one tag ``!name`` as a whole: their words are not scored and not in
the text, wherever they stand. The linear scan is Kadane's; of equal sums the longest run is taken.

Text: character references are decoded, white space inside a block is one space, blocks are joined in page order by a newline.

Defined results: a null or empty page, and one without a word outside such elements, has an empty text; repeated rows give equal
results; an element that is never closed ends with its parent; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import html as references
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import map_texts

WORD = 1.0
LEAST = 0.25
UNSEEN = 1.0
SCALES = (1, 2, 4, 8, 16, 32)
MAX_KINDS = 2_000

# fixed values: HTML elements by role
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
NOISE = frozenset("nav footer aside form script style noscript template iframe head header menu dialog button select textarea svg canvas object title option datalist".split())
BLOCKS = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6
    header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul""".split())
CLOSES_P = BLOCKS - {"caption", "body", "html", "legend", "optgroup", "option", "tbody", "td", "tfoot", "th", "thead", "tr"}
# words of class, id or role that mark an element as something else than content
MARKERS = frozenset("""ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert
    popup modal newsletter subscribe subscription signup login sidebar side menu nav navbar navigation breadcrumb breadcrumbs footer masthead topbar toolbar
    comment comments reply replies respond discussion disqus share sharing social related recommended widget pagination pager search searchbox complementary
    contentinfo""".split())
# ... but not beside one of these, as in "has-sidebar"
HARMLESS = frozenset("has with no without".split())
CONTENT = ("article", "main")

TOKEN = r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)(%s)>|[^<]+|<"
QUOTED = re.compile(TOKEN % r"""(?:[^>"']|"[^"]*"|'[^']*')*+""", re.DOTALL)
# for the rest of a page once a quote was found open, so that a scan to the page's end happens at most twice
PLAIN = re.compile(TOKEN % "[^>]*+", re.DOTALL)
MARKED = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden)(?=[\s=/]|$)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+))?""", re.IGNORECASE)
PIECES = re.compile(r"[a-z]+", re.IGNORECASE)
SPACES = re.compile(r"\s+")


def marks(attributes: str) -> tuple[str, bool]:
    """(first marker word of class, id or role, or ''; whether the element is hidden)."""
    first, hidden = "", False
    for name, value in MARKED.findall(attributes) if attributes else ():
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            hidden = True
        elif not first and name != "aria-hidden":
            words = PIECES.findall(value)
            first = "" if HARMLESS.intersection(words) else next((w for w in words if w in MARKERS), "")
    return first, hidden


def tokens(page: str) -> list[tuple[str, str]]:
    """The page as (kind, text): kind ``#`` with a run of text, else a tag's kind without text.

    An element that cannot hold content is one token ``!name``.
    """
    out: list[tuple[str, str]] = []
    open_tags: list[str] = []
    places: dict[str, list[int]] = {}       # name -> depths at which it is open
    skip = None                 # depth of the open element that cannot hold content
    raw = None                  # name of an element whose text is not markup
    token, last = QUOTED, page.rfind(">")
    at, end = 0, len(page)

    def cut(depth: int) -> None:
        while len(open_tags) > depth:
            places[open_tags.pop()].pop()

    while at < end:
        if raw:
            close = re.compile(rf"</{raw}(?=[\s/>])[^>]*>?", re.IGNORECASE).search(page, at)
            at, raw = (close.end(), None) if close else (end, None)
            continue
        if page[at] == "<" and at > last:       # no tag ends behind this
            if skip is None and page[at + 1:at + 2] not in ("!", "?"):
                out.append(("#", page[at:]))
            break
        m = token.match(page, at)
        if m[0] == "<" and token is QUOTED and (page[at + 1:at + 2].isalpha() or page.startswith("</", at)):
            token = PLAIN
            continue
        at = m.end()
        name = m[2]
        if name is None:
            if skip is None and m[0][:2] not in ("<!", "<?"):
                out.append(("#", m[0]))
            continue
        name = name.lower()
        if m[1]:
            if places.get(name):
                depth = places[name][-1]
                # an inline close cannot reach out of the element that cannot hold content
                if skip is not None and depth < skip and name not in BLOCKS:
                    continue
                cut(depth)
                if skip is not None and depth <= skip:
                    ended, skip = depth == skip, None
                    if ended:
                        continue
            if skip is None:
                out.append(("/" + name, ""))
            continue
        marker, hidden = marks(m[3])
        if name in CLOSES_P and places.get("p") and (skip is None or places["p"][-1] > skip):
            cut(places["p"][-1])
        noise = (name in NOISE or bool(marker) or hidden) and name not in ("html", "body", *CONTENT)
        if skip is None:
            out.append(("!" + name if noise else name, ""))
        if name in VOID or (m[3].endswith("/") and name not in BLOCKS and name not in RAW):
            continue
        if name in RAW:
            raw = name
            continue
        if noise and skip is None:
            skip = len(open_tags)
        places.setdefault(name, []).append(len(open_tags))
        open_tags.append(name)
    return out


def score(found: list[tuple[str, str]], weights: dict[str, float]) -> list[float]:
    return [WORD * len(text.split()) if kind == "#" else -weights.get(kind, UNSEEN) for kind, text in found]


def best_run(scores: list[float]) -> tuple[int, int]:
    """Start and end of the contiguous run of the highest sum; the first of the longest among equal ones; empty if none is positive."""
    best, where, total, start = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if total < 0:
            total, start = 0.0, i
        total += s
        if total > best + 1e-9 or (total > best - 1e-9 and best > 0 and i + 1 - start > where[1] - where[0]):
            best, where = max(best, total), (start, i + 1)
    return where


def text_of(found: list[tuple[str, str]]) -> str:
    """Blocks of a run of tokens joined by newlines."""
    blocks, part = [], []
    for kind, text in [*found, ("p", "")]:
        if kind == "#":
            part.append(text)
        elif kind == "br":
            part.append(" ")
        elif kind.lstrip("/!") in BLOCKS:
            block = SPACES.sub(" ", references.unescape("".join(part))).strip()
            if block:
                blocks.append(block)
            part = []
    return "\n".join(blocks)


def label(found: list[tuple[str, str]]) -> tuple[int, int] | None:
    """Range of the tokens inside the one element that the page itself names as its content."""
    for name in CONTENT:
        starts = [i for i, t in enumerate(found) if t[0] == name]
        ends = [i for i, t in enumerate(found) if t[0] == "/" + name]
        if len(starts) == 1 and len(ends) == 1 and starts[0] < ends[0]:
            return starts[0] + 1, ends[0]
    return None


def count_kinds(df: DataFrame, html_col: str) -> DataFrame:
    """How often each kind of tag stands inside and outside of labelled content, over all labelled pages: kind, inside, outside."""
    def run(batches):
        inside: dict[str, int] = {}
        outside: dict[str, int] = {}
        for batch in batches:
            for page in batch.column(0).to_pylist():
                found = tokens(page) if page else []
                span = label(found)
                if span is None:
                    continue
                for i, (kind, _) in enumerate(found):
                    if kind != "#":
                        side = inside if span[0] <= i < span[1] else outside
                        side[kind] = side.get(kind, 0) + 1
        names = sorted(inside.keys() | outside.keys())
        yield pa.RecordBatch.from_pydict({"kind": pa.array(names, pa.string()), "inside": pa.array([inside.get(k, 0) for k in names], pa.int64()),
                                          "outside": pa.array([outside.get(k, 0) for k in names], pa.int64())})

    counts = df.select(F.col(f"`{html_col}`").alias("page")).mapInArrow(run, "kind string, inside long, outside long")
    return counts.groupBy("kind").agg(F.sum("inside").alias("inside"), F.sum("outside").alias("outside"))


def misplaced(df: DataFrame, html_col: str, choices: list[dict[str, float]]) -> list[int]:
    """Words of labelled pages on the wrong side of the best run, for each choice of weights."""
    def run(batches):
        wrong = [0] * len(choices)
        for batch in batches:
            for page in batch.column(0).to_pylist():
                found = tokens(page) if page else []
                span = label(found)
                if span is None:
                    continue
                before = [0]
                for kind, text in found:
                    before.append(before[-1] + (len(text.split()) if kind == "#" else 0))
                for k, weights in enumerate(choices):
                    lo, hi = best_run(score(found, weights))
                    both = max(0, before[max(lo, min(hi, span[1]))] - before[min(hi, max(lo, span[0]))])
                    wrong[k] += before[hi] - before[lo] + before[span[1]] - before[span[0]] - 2 * both
        yield pa.RecordBatch.from_pydict({"choice": pa.array(range(len(choices)), pa.int32()), "wrong": pa.array(wrong, pa.int64())})

    rows = df.select(F.col(f"`{html_col}`").alias("page")).mapInArrow(run, "choice int, wrong long").groupBy("choice").agg(F.sum("wrong").alias("wrong")).collect()
    found = {r["choice"]: r["wrong"] for r in rows}
    return [found.get(k, 0) for k in range(len(choices))]


def fit(df: DataFrame, html_col: str = "html") -> dict[str, float]:
    """Weight of each kind of tag.

    At most ``MAX_KINDS`` kinds, the most frequent, reach the driver (invented names could be many); a rarer one has the weight of
    an unseen kind.
    """
    rows = count_kinds(df, html_col).orderBy(F.desc(F.col("inside") + F.col("outside")), "kind").limit(MAX_KINDS).collect()
    odds = {r["kind"]: math.log((r["outside"] + 0.5) / (r["inside"] + 0.5)) for r in rows}
    choices = [{k: LEAST if w <= LEAST else w * scale for k, w in odds.items()} for scale in SCALES]
    wrong = misplaced(df, html_col, choices)
    return choices[wrong.index(min(wrong))]


def extract(df: DataFrame, keep: list[str], html_col: str = "html", weights: dict[str, float] | None = None) -> DataFrame:
    """``keep`` columns, text and n_chars of every page."""
    weights = fit(df, html_col) if weights is None else weights
    schema = StructType([StructField("text", StringType()), StructField("n_chars", LongType())])

    def make():
        def work(pages: list) -> list:
            texts = []
            for page in pages:
                found = tokens(page) if page else []
                lo, hi = best_run(score(found, weights))
                texts.append(text_of(found[lo:hi]))
            return [texts, [len(t) for t in texts]]
        return work

    return map_texts(df, html_col, keep, schema, make)
