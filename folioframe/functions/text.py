"""General text functions: ids, snippets, redaction, time codes, URLs, classification."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import HS, WS, blank_to_null, casefold, col, let, rstrip, squash, strip

# Secrets masked in log text, in this order.
SECRET_ASSIGNMENT = (
    r"(?i)\b(api[_-]?key|authorization|access[_-]?token|secret|password)"
    r"(\s*[=:]\s*)((?:Bearer\s+)?[^\s,;\]\}\)]+)"
)
BEARER_TOKEN = r"(?i)\bBearer\s+[A-Za-z0-9._~+/=-]+"
URL_SECRET = r"(?i)([?&](?:api[_-]?key|token|secret)=)[^&#\s]+"

# Patterns of sensitive values that must not enter a dataset.
SENSITIVE = [
    r"(?i)-----BEGIN [A-Z ]*PRIVATE KEY-----",
    r"\bsk-[A-Za-z0-9_-]{12,}\b",
    r"""(?i)\b(?:api[_-]?key|access[_-]?token|secret[_-]?key|password|passwd)\b"""
    r"""\s*[:=]\s*["']?[A-Za-z0-9_./+=-]{12,}""",
    r"(?i)\bBearer\s+[A-Za-z0-9._-]{12,}",
]


def content_hash(text) -> Column:
    return F.sha2(col(text), 256)


def stable_id(prefix: str, *parts) -> Column:
    """``prefix-`` and 16 hex digits of the hash of the parts."""
    joined = F.concat_ws("\x1f", *[col(p).cast("string") for p in parts])
    return F.concat(F.lit(prefix + "-"), F.substring(F.sha2(joined, 256), 1, 16))


def normalize_strings(values, exclude=None) -> Column:
    """Trim, drop empties, keep the first of each case-folded value, leave out ``exclude``."""
    values = F.transform(F.coalesce(col(values), F.array().cast("array<string>")), strip)
    keyed = F.array_sort(F.filter(
        F.transform(values, lambda v, i: F.struct(casefold(v).alias("f"), i.alias("i"), v.alias("v"))),
        lambda r: r["v"] != ""))
    banned = F.transform(exclude, casefold) if exclude is not None else F.array().cast("array<string>")

    def first_of_each(rows, bad):
        # rows are sorted by folded value and place: keep those whose predecessor differs
        before = F.concat(F.array(F.lit(None).cast("string")), F.transform(rows, lambda r: r["f"]))
        kept = F.array_compact(F.zip_with(rows, before, lambda r, f: F.when(
            r.isNotNull() & ~r["f"].eqNullSafe(f) & ~F.array_contains(bad, r["f"]),
            F.struct(r["i"].alias("i"), r["v"].alias("v")))))
        return F.transform(F.array_sort(kept), lambda r: r["v"])

    return let(banned, lambda bad: let(keyed, lambda rows: first_of_each(rows, bad)))


def conversation_title(text, limit: int = 80, default: str | None = "新对话") -> Column:
    flat = squash(F.coalesce(col(text), F.lit("")))
    return (F.when(flat == "", F.lit(default))
            .when(F.length(flat) <= limit, flat)
            .otherwise(F.concat(rstrip(F.substring(flat, 1, limit - 3)), F.lit("..."))))


def search_snippet(text, query, radius: int, miss: str) -> Column:
    """Single-line window around the first case-folded hit.

    ``miss='empty'`` gives '' without a hit (pages), ``miss='head'`` the first characters (messages).
    """
    query = query if isinstance(query, Column) else F.lit(query)
    flat = squash(F.coalesce(col(text), F.lit("")))

    def window(t):
        at = F.instr(casefold(t), casefold(query))
        start = F.greatest(F.lit(0), at - 1 - radius)
        end = F.least(F.length(t), at - 1 + F.length(query) + radius)
        cut = F.concat(F.when(start > 0, F.lit("...")).otherwise(F.lit("")),
                       F.substring(t, start + 1, end - start),
                       F.when(end < F.length(t), F.lit("...")).otherwise(F.lit("")))
        missed = F.lit("") if miss == "empty" else F.substring(t, 1, radius * 2)
        return F.when(at > 0, cut).otherwise(missed)

    return let(flat, window)


def contains_literal(text, query) -> Column:
    """Case-insensitive containment; ``%`` and ``_`` have no special meaning."""
    query = query if isinstance(query, Column) else F.lit(query)
    return F.contains(F.lower(col(text)), F.lower(query))


def redact(text, max_length: int = 4000) -> Column:
    out = F.coalesce(col(text), F.lit(""))
    out = F.regexp_replace(out, SECRET_ASSIGNMENT, "$1$2[REDACTED]")
    out = F.regexp_replace(out, BEARER_TOKEN, "Bearer [REDACTED]")
    out = F.regexp_replace(out, URL_SECRET, "$1[REDACTED]")
    return F.when(F.length(out) > max_length,
                  F.concat(F.substring(out, 1, max_length), F.lit("...[TRUNCATED]"))).otherwise(out)


def has_sensitive_value(text) -> Column:
    text = col(text)
    hit = F.lit(False)
    for pattern in SENSITIVE:
        hit = hit | text.rlike(pattern)
    return hit


def parse_timecode(code) -> Column:
    """``MM:SS`` or ``HH:MM:SS`` to seconds."""
    parts = F.transform(F.split(col(code), ":"), lambda p: p.try_cast("double"))
    return (F.when(F.size(parts) == 2, F.get(parts, F.lit(0)) * 60 + F.get(parts, F.lit(1)))
            .when(F.size(parts) == 3, F.get(parts, F.lit(0)) * 3600 + F.get(parts, F.lit(1)) * 60
                  + F.get(parts, F.lit(2))))


def format_timecode(seconds) -> Column:
    total = F.greatest(F.lit(0), col(seconds).cast("int"))
    h, m, s = F.floor(total / 3600), F.floor(total / 60) % 60, total % 60
    return F.when(h > 0, F.format_string("%02d:%02d:%02d", h, m, s)).otherwise(
        F.format_string("%02d:%02d", m, s))


def plain_number(value: Column) -> Column:
    """Number text without a trailing ``.0``."""
    return F.regexp_replace(value.cast("string"), r"\.0\z", "")


def audio_provenance(source_uri, content) -> Column:
    """struct of audio id, time range and links, NULL unless the uri names an audio file."""
    uri = F.coalesce(col(source_uri), F.lit(""))
    time_range = r"\[(\d{1,2}:\d{2}(?::\d{2})?)\s*-\s*(\d{1,2}:\d{2}(?::\d{2})?)\]"
    body = F.coalesce(col(content), F.lit(""))
    audio = F.regexp_extract(uri, r"\Aaudio:(\d+)", 1)
    first, last = F.regexp_extract(body, time_range, 1), F.regexp_extract(body, time_range, 2)
    start = F.when(first != "", parse_timecode(first)).otherwise(F.lit(0.0))
    end = F.when(last != "", parse_timecode(last))
    end_text = plain_number(end)
    base = F.concat(F.lit("/audio/"), audio.try_cast("long").cast("string"))
    return F.when(audio != "", F.struct(
        audio.try_cast("long").alias("audio_id"), start.alias("audio_start"), end.alias("audio_end"),
        F.concat(base, F.lit("/file#t="), plain_number(start),
                 F.coalesce(F.concat(F.lit(","), end_text), F.lit(""))).alias("audio_url"),
        F.concat(base, F.lit("/transcript?start="), plain_number(start),
                 F.coalesce(F.concat(F.lit("&end="), end_text), F.lit(""))).alias("transcript_url")))


# Address ranges that are not globally reachable (as literal IPv4 hosts).
PRIVATE_IPV4 = (
    r"\A(?:0\.|10\.|127\.|169\.254\.|192\.168\.|192\.0\.[02]\.|198\.1[89]\.|198\.51\.100\.|"
    r"203\.0\.113\.|172\.(?:1[6-9]|2\d|3[01])\.|100\.(?:6[4-9]|[7-9]\d|1[01]\d|12[0-7])\.|"
    r"2[4-5]\d\.)"
)
PRIVATE_IPV6 = r"\A\[(?:::1?\]|f[cd]|fe[89ab]|ff|2001:db8:|::ffff:)"
URL_PARTS = r"\A(?i:(https?))://([^/?#@\s]+)([^?#]*)(\?[^#]*)?"


def guard_url(url) -> Column:
    """Normalised public http(s) URL, NULL when it must not be fetched (no DNS look-up)."""
    url = col(url)
    trimmed = strip(url)
    scheme = F.lower(F.regexp_extract(trimmed, URL_PARTS, 1))
    authority = F.lower(F.regexp_extract(trimmed, URL_PARTS, 2))
    host = F.regexp_replace(F.regexp_extract(authority, r"\A(\[[^\]]*\]|[^:]*)", 1), r"\.+\z", "")
    port = F.regexp_extract(authority, r"(?:\]|\A[^:\[]*):(\d+)\z", 1)
    path = F.regexp_extract(trimmed, URL_PARTS, 3)
    query = F.regexp_extract(trimmed, URL_PARTS, 4)
    bad_host = ((host == "") | (host == "localhost") | host.endswith(".localhost")
                | host.rlike(PRIVATE_IPV4) | host.rlike(PRIVATE_IPV6))
    bad_port = ((port != "") & (F.coalesce(port.try_cast("int"), F.lit(70000)) > 65535)) | (
        (port == "") & authority.rlike(r":[^\]]*[^0-9\]][^\]]*\z"))
    ok = (scheme != "") & (F.length(url) <= 2048) & ~bad_host & ~bad_port
    return F.when(ok, F.concat(
        scheme, F.lit("://"), host,
        F.when(port.isin("", "0"), F.lit("")).otherwise(
            F.concat(F.lit(":"), port.try_cast("int").cast("string"))),
        F.when(path == "", F.lit("/")).otherwise(path),
        F.when(query == "?", F.lit("")).otherwise(query)))


def clean_external_text(text) -> Column:
    out = F.regexp_replace(F.coalesce(col(text), F.lit("")), r"\x00", "")
    out = F.regexp_replace(out, r"\r\n|[\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]", "\n")
    out = F.regexp_replace(out, rf"{HS}(?<!{HS}{{2}}){HS}*+(?=\n|\z)", "")
    return strip(out)


def clean_title(text) -> Column:
    return strip(F.regexp_replace(F.coalesce(col(text), F.lit("")), r"[#\r\n]+", " "))


def split_tags(text) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(col(text), F.lit("")), ","), strip),
                    lambda t: t != "")


def classify_error(stage) -> Column:
    """struct<code, component, operation, retryable> from a stage name, first rule wins."""
    s = F.lower(strip(F.coalesce(blank_to_null(stage), F.lit("unknown"))))
    tail = F.element_at(F.split(s, r"\."), -1)

    def row(code, component, operation, retryable):
        operation = F.lit(operation) if isinstance(operation, str) else operation
        return F.struct(F.lit(code).alias("code"), F.lit(component).alias("component"),
                        operation.alias("operation"), F.lit(retryable).alias("retryable"))

    return (F.when(s == "retrieval.embedding", row("EMBEDDING_PROVIDER_ERROR", "retrieval", "embedding", True))
            .when(s == "retrieval.rerank", row("RERANK_PROVIDER_ERROR", "retrieval", "rerank", True))
            .when(s.startswith("retrieval."), row("RETRIEVAL_ERROR", "retrieval", tail, True))
            .when(s.startswith("llm."), row("LLM_PROVIDER_ERROR", "llm", tail, True))
            .when(s.isin("agent.plan", "agent.replan"), row("AGENT_PLAN_ERROR", "agent", tail, True))
            .when(s == "agent.external_retrieval", row("MCP_FETCH_ERROR", "mcp", "external_retrieval", True))
            .when(s.startswith("agent.external_"), row("AGENT_EXECUTION_ERROR", "agent", tail, True))
            .when(s.startswith("agent."), row("AGENT_EXECUTION_ERROR", "agent", tail, False))
            .otherwise(row("INTERNAL_ERROR", "application", s, False)))


def parent_chunk_id(chunk_id) -> Column:
    return F.regexp_replace(col(chunk_id), r"\A(.+:chunk:\d+):child:\d+\z", "$1")


def canonical_positions(text) -> Column:
    """array<struct<ch,pos>>: whitespace runs as one space, each kept character with its offset. Linear in the text."""
    def kept(chars):
        blank = lambda i: F.get(chars, i).rlike(WS)
        places = F.filter(F.sequence(F.lit(0), F.size(chars) - 1), lambda i: (i == 0) | ~(blank(i) & blank(i - 1)))
        return F.transform(places, lambda i: F.struct(
            F.when(blank(i), F.lit(" ")).otherwise(F.get(chars, i)).alias("ch"), i.alias("pos")))

    c = col(text)
    return F.when(c == "", F.array().cast("array<struct<ch:string,pos:int>>")).otherwise(let(F.split(c, ""), kept))
