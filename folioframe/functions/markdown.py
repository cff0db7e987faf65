"""Markdown cleaning and outline functions. All are column expressions over one document,
so a corpus is cleaned in one map stage without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import HS, NWS, WS, blank_to_null, col, let, lstrip, rstrip, strip

HEADING_LINE = rf"(?d)\A{HS}*(#{{1,6}}){HS}+({NWS}.*)"
_AT_HEADING = rf"(?dm)^(?={HS}*#{{1,6}}{HS}+{NWS})"
_AT_FENCE = rf"(?dm)^(?={HS}*(?:`{{3,}}|~{{3,}}))"
_CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"
PAGE_NUMBER = (
    rf"^{WS}*(第{WS}*\p{{Nd}}+{WS}*页|Page{WS}*\p{{Nd}}+|"
    rf"\p{{Nd}}+{WS}*/{WS}*\p{{Nd}}+|-{WS}*\p{{Nd}}+{WS}*-){WS}*$"
)
_LINK = r"\[([^\]]+)\]\((?:[^()\\]|\\.)*\)"


def heading_sections(text) -> Column:
    """Split in front of every heading line; a text before the first heading is the first item."""
    return F.split(col(text), _AT_HEADING)


def heading_level(section: Column) -> Column:
    """Level of the heading a section opens with, 0 when it opens with none."""
    return F.length(F.regexp_extract(section, HEADING_LINE, 1))


def heading_title(section: Column) -> Column:
    return strip(F.regexp_extract(section, HEADING_LINE, 2))


def strip_control_chars(text) -> Column:
    return F.regexp_replace(col(text), _CONTROL, "")


def strip_page_number_lines(text) -> Column:
    return F.regexp_replace(col(text), "(?dm)" + PAGE_NUMBER, "")


def blank_repeated_short_lines(text, times: int = 3, max_chars: int = 30) -> Column:
    """Blank every short non-heading line that occurs ``times`` or more in the document."""
    def short(line):
        return (F.length(line) >= 1) & (F.length(line) <= max_chars) & ~line.startswith("#")

    def repeated(ordered):
        # in a sorted list a value occurs n times iff it equals the value n-1 places on
        ahead = F.slice(ordered, times, F.greatest(F.size(ordered), F.lit(1)))
        return F.array_distinct(F.array_compact(
            F.zip_with(ordered, ahead, lambda a, b: F.when(a == b, a))))

    text = col(text)
    lines = F.split(text, "\n")
    return let(lines, lambda ls: let(
        repeated(F.array_sort(F.filter(F.transform(ls, strip), short))),
        lambda bad: F.when(F.size(bad) == 0, text).otherwise(F.array_join(
            F.transform(ls, lambda l: F.when(F.array_contains(bad, strip(l)), F.lit(""))
                        .otherwise(l)), "\n"))))


def repaired_levels(levels: Column) -> Column:
    """A heading is at most one deeper than the repaired heading before it."""
    def step(done, level):
        last = F.try_element_at(done, F.lit(-1))
        return F.concat(done, F.array(
            F.when(F.size(done) == 0, level).otherwise(F.least(level, last + 1))))
    return F.aggregate(levels, F.array().cast("array<int>"), step)


def normalize_heading_levels(text) -> Column:
    """Re-emit headings as ``#… title`` with repaired levels."""
    def rebuild(parts):
        heads = F.filter(parts, lambda s: heading_level(s) > 0)
        shift = F.size(parts) - F.size(heads)      # 1 when text precedes the first heading

        def emit(levels):
            def one(section, i):
                head_line = F.regexp_extract(section, r"(?d)\A[^\n]*", 0)
                rest = F.substring(section, F.length(head_line) + 1, F.length(section))
                level = F.get(levels, i - shift)
                fixed = F.concat(F.repeat(F.lit("#"), level), F.lit(" "),
                                 heading_title(section), rest)
                return F.when(i < shift, section).otherwise(fixed)
            return F.array_join(F.transform(parts, one), "")
        return let(repaired_levels(F.transform(heads, heading_level)), emit)

    text = col(text)
    return F.when(~F.regexp_like(text, F.lit(_AT_HEADING)), text).otherwise(
        let(heading_sections(text), rebuild))


def squeeze_blank_lines(text) -> Column:
    return F.regexp_replace(col(text), r"\n{3,}", "\n\n")


def rtrim_lines(text) -> Column:
    return F.regexp_replace(col(text), rf"{HS}(?<!{HS}{{2}}){HS}*+(?=\n|\z)", "")


def clean_link_label(text) -> Column:
    """Replace links and images by their label until none is left, then squash whitespace.

    Each pass that changes the text removes at least one ``](``, so their number bounds the passes
    exactly; once a pass changed nothing the rest of the fold only hands the text on.
    """
    def one_pass(t):
        return F.regexp_replace(F.regexp_replace(t, "(?d)!" + _LINK, "$1"), "(?d)" + _LINK, "$1")

    def step(acc, _):
        return F.when(acc["open"], let(one_pass(acc["t"]), lambda n: F.struct(
            n.alias("t"), (n != acc["t"]).alias("open")))).otherwise(acc)

    def body(t):
        passes = F.sequence(F.lit(0), F.size(F.split(t, r"\]\(")))
        zero = F.struct(t.alias("t"), F.lit(True).alias("open"))
        flat = F.when(t.contains("]("), F.aggregate(passes, zero, step, lambda a: a["t"])).otherwise(t)
        return F.trim(F.regexp_replace(flat, rf"{WS}+", " "))

    return let(F.coalesce(col(text), F.lit("")), body)


def normalize_heading_links(text) -> Column:
    """Clean the label of heading lines outside code fences; other lines stay untouched."""
    pattern = rf"(?d)\A({HS}{{0,3}}#{{1,6}})({HS}+)(.*?)({HS}*)\z"
    any_heading = rf"(?dm)^{HS}{{0,3}}#{{1,6}}{HS}"

    def clean_line(line):
        fixed = F.concat(F.regexp_extract(line, pattern, 1), F.regexp_extract(line, pattern, 2),
                         clean_link_label(F.regexp_extract(line, pattern, 3)),
                         F.regexp_extract(line, pattern, 4))
        return F.when(line.rlike(pattern), fixed).otherwise(line)

    def fence_mark(segment):
        return F.regexp_extract(segment, rf"\A{HS}*([`~])", 1)

    def states(segments):
        """Open fence character after the fence line that starts each segment ('' = outside)."""
        def step(done, segment):
            mark = F.regexp_extract(segment, rf"\A{HS}*(?:(`)``|(~)~~)", 0)
            mark = F.right(mark, F.lit(1))
            last = F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit(""))
            now = (F.when(mark == "", last).when(last == "", mark)
                   .when(last == mark, F.lit("")).otherwise(last))
            return F.concat(done, F.array(now))
        return F.aggregate(segments, F.array().cast("array<string>"), step)

    def clean_segment(segment, state):
        cleaned = F.array_join(F.transform(F.split(segment, "\n"), clean_line), "\n")
        return F.when(state == "", cleaned).otherwise(segment)

    text = F.coalesce(col(text), F.lit(""))
    rebuilt = let(F.split(text, _AT_FENCE), lambda segs: let(states(segs), lambda st: F.array_join(
        F.zip_with(segs, st, clean_segment), "")))
    return F.when(F.regexp_like(text, F.lit(any_heading)), rebuilt).otherwise(text)


def clean_markdown(text) -> Column:
    """The cleaning steps in their fixed order."""
    # every step is bound once, so that a step naming its input twice does not redo the ones before
    out = let(F.coalesce(col(text), F.lit("")), normalize_heading_links)
    out = strip_page_number_lines(strip_control_chars(out))
    out = let(out, blank_repeated_short_lines)
    out = let(out, normalize_heading_levels)
    return strip(rtrim_lines(squeeze_blank_lines(out)))


def outline(text) -> Column:
    """Headings of level 1-4 as array<struct<level,title,line>>; fences are not looked at."""
    pattern = rf"(?d)\A(#{{1,4}}){WS}+(.+)\z"
    rows = F.transform(F.split(col(text), "\n"), lambda l, i: F.struct(
        F.length(F.regexp_extract(l, pattern, 1)).alias("level"),
        F.regexp_extract(l, pattern, 2).alias("title"), i.alias("line")))
    return F.filter(rows, lambda r: r["level"] > 0)


def file_stem(path) -> Column:
    name = F.regexp_extract(col(path), r"([^/]*)\z", 1)
    return F.when(name.rlike(r"\A.+\.[^.]*\z"), F.regexp_replace(name, r"\.[^.]*\z", "")).otherwise(name)


def title_from_markdown(path, text) -> Column:
    """First heading of any level, else the file stem."""
    first = F.regexp_extract(col(text), rf"(?dm)^(#{{1,6}}){WS}+(.+?){WS}*$", 2)
    return F.coalesce(blank_to_null(first), file_stem(path))


def legacy_title_content(path, raw) -> Column:
    """A first line ``# title`` becomes the title and the rest the content; else the file stem."""
    raw = F.regexp_replace(col(raw), r"\r\n?", "\n")
    first = F.regexp_extract(raw, r"(?d)\A[^\n]*", 0)
    rest = F.substring(raw, F.length(first) + 2, F.length(raw))
    stem = clean_link_label(file_stem(path))
    own = clean_link_label(F.substring(first, F.lit(3), F.length(first)))
    return F.when(first.startswith("# "), F.struct(
        F.when(own == "", stem).otherwise(own).alias("title"),
        normalize_heading_links(lstrip(rest)).alias("content"))).otherwise(F.struct(
            stem.alias("title"), normalize_heading_links(raw).alias("content")))


def validate_title(title) -> Column:
    """struct<value, error_code> of a page title."""
    cleaned = clean_link_label(title)
    error = (F.when(cleaned == "", F.lit("TITLE_EMPTY"))
             .when(F.length(cleaned) > 255, F.lit("TITLE_TOO_LONG"))
             .when(cleaned.contains("\u0000"), F.lit("TITLE_ILLEGAL_CHAR")))
    return F.struct(cleaned.alias("value"), error.alias("error_code"))


def validate_content(content) -> Column:
    content = col(content)
    return F.struct(
        F.when(content.isNotNull(), rstrip(normalize_heading_links(content))).alias("value"),
        F.when(content.isNull(), F.lit("CONTENT_EMPTY")).alias("error_code"))


def validate_page_id(page_id) -> Column:
    ok = F.coalesce(col(page_id).rlike(
        r"\A[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\z"), F.lit(False))
    return F.when(~ok, F.lit("PAGE_ID_INVALID"))
