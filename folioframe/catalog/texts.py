"""Registered text queries (TX)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import markdown as M
from ..functions import querylog as Q
from ..functions import text as T
from ..functions import tokens as K
from ..operators.layout import render_markdown_table
from .data import (HS, MD, WS, markdown, sql_estimate, sql_squash, sql_strip,
                   sql_tokens, timeline, TIMELINE)
from .registry import query

NL = "chr(10)"


def lines(src: str, text: str) -> str:
    """SQL: one row per line of ``text`` of ``src``."""
    return (f"SELECT doc_id, unnest(string_split({text}, {NL})) AS line, "
            f"unnest(range(len(string_split({text}, {NL})))) AS pos FROM {src}")


def joined(src: str, line: str = "line") -> str:
    return f"SELECT doc_id, string_agg({line}, {NL} ORDER BY pos) AS t FROM {src} GROUP BY doc_id"


def label_sql(x: str) -> str:
    """SQL: three link-label passes, squashed."""
    for _ in range(3):
        x = (r"regexp_replace(regexp_replace(" + x + r", '!\[([^\]]+)\]\((?:[^()\\]|\\.)*\)', '\1', 'g'), "
             r"'\[([^\]]+)\]\((?:[^()\\]|\\.)*\)', '\1', 'g')")
    return sql_squash(x)


PAGE_NO = (rf"(?m)^{WS}*(第{WS}*\p{{Nd}}+{WS}*页|Page{WS}*\p{{Nd}}+|\p{{Nd}}+{WS}*/{WS}*\p{{Nd}}+|"
           rf"-{WS}*\p{{Nd}}+{WS}*-){WS}*$")
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"
HEAD = rf"'^(#{{1,6}}){WS}+([^\n]+)$'"
MD_SRC = f"src AS (SELECT doc_id, {MD} AS t FROM documents)"

# the cleaning steps as CTEs over (doc_id, t)
LINKS_STEP = rf"""l8 AS ({lines('src', 't')}),
f8 AS (SELECT *, regexp_matches(line, '^{HS}*(```|~~~)') AS fence,
  sum(CASE WHEN regexp_matches(line, '^{HS}*```') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) % 2 AS inside FROM l8),
h8 AS (SELECT doc_id, pos, CASE WHEN NOT fence AND inside = 0 AND regexp_matches(line, '^{HS}{{0,3}}#{{1,6}}{HS}')
  THEN regexp_extract(line, '^({HS}{{0,3}}#{{1,6}}{HS}+)(.*?){HS}*$', 1) ||
       {label_sql(rf"regexp_extract(line, '^({HS}{{0,3}}#{{1,6}}{HS}+)(.*?){HS}*$', 2)")} ||
       regexp_extract(line, '({HS}*)$', 1) ELSE line END AS line FROM f8),
s8 AS ({joined('h8')})"""
PAGES_STEP = f"s3 AS (SELECT doc_id, regexp_replace(regexp_replace(t, '{CONTROL}', '', 'g'), '{PAGE_NO}', '', 'g') AS t FROM @SRC)"
REPEAT_STEP = f"""l4 AS ({lines('@SRC', 't')}), k4 AS (SELECT *, {sql_strip('line')} AS s FROM l4),
c4 AS (SELECT *, count(*) OVER (PARTITION BY doc_id, s) AS n FROM k4),
s4 AS ({joined('c4', "CASE WHEN n >= 3 AND length(s) BETWEEN 1 AND 30 AND s NOT LIKE '#%' THEN '' ELSE line END")})"""
LEVEL_STEP = f"""l5 AS ({lines('@SRC', 't')}), k5 AS (SELECT *, {sql_strip('line')} AS s FROM l5),
m5 AS (SELECT *, length(regexp_extract(s, {HEAD}, 1)) AS lv, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i0
  FROM k5 WHERE regexp_matches(s, {HEAD})),
n5 AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i FROM m5),
r5 AS (SELECT doc_id, pos, i + min(lv - i) OVER (PARTITION BY doc_id ORDER BY i) AS fixed,
  {sql_strip(f"regexp_extract(s, {HEAD}, 2)")} AS title FROM n5),
s5 AS (SELECT doc_id, string_agg(CASE WHEN fixed IS NULL THEN line ELSE repeat('#', fixed::INT) || ' ' || title END, {NL} ORDER BY pos) AS t
  FROM k5 LEFT JOIN r5 USING (doc_id, pos) GROUP BY doc_id)"""


def blank(src):
    return rf"regexp_replace({src}, '\n{{3,}}', {NL} || {NL}, 'g')"


def rtrim(src):
    return rf"regexp_replace({src}, '(?m){HS}+$', '', 'g')"


@query("tx1_clean_markdown", f"""WITH {MD_SRC}, {LINKS_STEP}, {PAGES_STEP.replace('@SRC', 's8')}, {REPEAT_STEP.replace('@SRC', 's3')},
{LEVEL_STEP.replace('@SRC', 's4')} SELECT doc_id, md5({sql_strip(rtrim(blank('t')))}) AS cleaned FROM s5""")
def tx1(t):
    return t.documents.select("doc_id", F.md5(M.clean_markdown(markdown())).alias("cleaned"))


@query("tx2_strip_control_chars",
       f"SELECT doc_id, length(regexp_replace(text, '{CONTROL}', '', 'g'))::BIGINT AS n, "
       f"md5(regexp_replace(text, '{CONTROL}', '', 'g')) AS cleaned FROM documents")
def tx2(t):
    out = M.strip_control_chars("text")
    return t.documents.select("doc_id", F.length(out).alias("n"), F.md5(out).alias("cleaned"))


@query("tx3_strip_page_number_lines",
       f"SELECT doc_id, md5(regexp_replace(replace(text, '. ', chr(10) || doc_id || ' / ' || n_chars || ' ' || chr(10)), "
       f"'{PAGE_NO}', '', 'g')) AS cleaned FROM documents")
def tx3(t):
    numbered = F.replace(F.col("text"), F.lit(". "), F.concat(
        F.lit("\n"), F.col("doc_id").cast("string"), F.lit(" / "), F.col("n_chars").cast("string"), F.lit(" \n")))
    return t.documents.select("doc_id", F.md5(M.strip_page_number_lines(numbered)).alias("cleaned"))


@query("tx4_blank_repeated_short_lines", f"""WITH src AS (SELECT doc_id, replace(text, ' ', chr(10)) AS t FROM documents),
{REPEAT_STEP.replace('@SRC', 'src')} SELECT doc_id, md5(t) AS cleaned FROM s4""")
def tx4(t):
    # one word per line, so that real repetitions occur
    words = F.replace(F.col("text"), F.lit(" "), F.lit("\n"))
    return t.documents.select("doc_id", F.md5(M.blank_repeated_short_lines(words)).alias("cleaned"))


@query("tx5_normalize_heading_levels", f"""WITH {MD_SRC}, {LEVEL_STEP.replace('@SRC', 'src')}
SELECT doc_id, md5(t) AS cleaned FROM s5""")
def tx5(t):
    return t.documents.select("doc_id", F.md5(M.normalize_heading_levels(markdown())).alias("cleaned"))


@query("tx6_squeeze_rtrim_strip",
       f"SELECT doc_id, md5({sql_strip(rtrim(blank('replace(text, chr(46), chr(10) || chr(10))')))}) AS cleaned FROM documents")
def tx6(t):
    spread = F.replace(F.col("text"), F.lit("."), F.lit("\n\n"))
    return t.documents.select("doc_id", F.md5(M.strip(M.rtrim_lines(M.squeeze_blank_lines(spread)))).alias("cleaned"))


LINKED_TEXT = r"regexp_replace(text, '([A-Z][a-z]+) ([a-z]+)', '[![\1](a/b) \2](http://h)', 'g')"


@query("tx7_clean_link_label", f"SELECT doc_id, md5({label_sql(LINKED_TEXT)}) AS label FROM documents")
def tx7(t):
    linked = F.regexp_replace("text", r"([A-Z][a-z]+) ([a-z]+)", "[![$1](a/b) $2](http://h)")
    return t.documents.select("doc_id", F.md5(M.clean_link_label(linked)).alias("label"))


@query("tx8_normalize_heading_links", f"WITH {MD_SRC}, {LINKS_STEP} SELECT doc_id, md5(t) AS cleaned FROM s8")
def tx8(t):
    return t.documents.select("doc_id", F.md5(M.normalize_heading_links(markdown())).alias("cleaned"))


@query("tx9_outline", f"""WITH {MD_SRC}, l AS ({lines('src', 't')})
SELECT doc_id, length(regexp_extract(line, '^(#{{1,4}})\\s+(.+)$', 1))::BIGINT AS level,
  regexp_extract(line, '^(#{{1,4}})\\s+(.+)$', 2) AS title, pos AS line FROM l
WHERE regexp_matches(line, '^(#{{1,4}})\\s+(.+)$')""")
def tx9(t):
    return t.documents.select("doc_id", F.inline(M.outline(markdown())))


@query("tx10_title_from_markdown", rf"""SELECT doc_id, coalesce(nullif({sql_strip(
    f"regexp_extract({MD}, '(?m)^(#{{1,6}}){WS}+(.+?){WS}*$', 2)")}, ''), 'file' || doc_id) AS title FROM documents""")
def tx10(t):
    path = F.concat(F.lit("dir/file"), F.col("doc_id").cast("string"), F.lit(".md"))
    return t.documents.select("doc_id", M.title_from_markdown(path, markdown()).alias("title"))


@query("tx11_legacy_title_content", rf"""WITH {MD_SRC}, p AS (SELECT doc_id, t, split_part(t, chr(10), 1) AS first FROM src)
SELECT doc_id, CASE WHEN first LIKE '# %' AND {sql_squash('first[3:]')} <> '' THEN {label_sql('first[3:]')} ELSE 'f' || doc_id END AS title,
  CASE WHEN first LIKE '# %' THEN length(regexp_replace(t[length(first) + 2:], '\A{WS}+', '')) ELSE length(t) END::BIGINT AS n
FROM p""")
def tx11(t):
    path = F.concat(F.lit("f"), F.col("doc_id").cast("string"), F.lit(".txt"))
    # link labels in later headings are cleaned too; the length is taken before that
    raw = markdown()
    first = F.regexp_extract(raw, r"(?d)\A[^\n]*", 0)
    rest = M.lstrip(F.substring(raw, F.length(first) + 2, F.length(raw)))
    return t.documents.select("doc_id", M.legacy_title_content(path, raw)["title"].alias("title"),
                              F.when(first.startswith("# "), F.length(rest)).otherwise(F.length(raw)).alias("n"))


@query("tx12_validate_title", f"""WITH c AS (SELECT doc_id, {label_sql('text')} AS v FROM documents)
SELECT doc_id, md5(v) AS v, coalesce(CASE WHEN v = '' THEN 'TITLE_EMPTY' WHEN length(v) > 255 THEN 'TITLE_TOO_LONG' END, 'OK') AS title_error,
  CASE WHEN regexp_matches(md5(v), '^[0-9a-f]{{8}}-') THEN 'OK' ELSE 'PAGE_ID_INVALID' END AS id_error FROM c""")
def tx12(t):
    v = M.validate_title("text")
    rows = t.documents.select("doc_id", v.alias("v"))
    return rows.select("doc_id", F.md5("v.value").alias("v"), F.coalesce("v.error_code", F.lit("OK")).alias("title_error"),
                       F.coalesce(M.validate_page_id(F.md5("v.value")), F.lit("OK")).alias("id_error"))


@query("tx13_normalize_strings", rf"""WITH w AS (
  SELECT doc_id, unnest(string_split(text, ' ')) AS w, unnest(range(len(string_split(text, ' ')))) AS pos FROM documents),
s AS (SELECT doc_id, pos, {sql_strip('w')} AS w, lower(replace({sql_strip('w')}, 'ß', 'ss')) AS f FROM w),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, f ORDER BY pos) AS n FROM s WHERE w <> '' AND f NOT IN ('the', 'le'))
SELECT doc_id, count(*)::BIGINT AS n, md5(string_agg(w, ',' ORDER BY pos)) AS tags FROM k WHERE n = 1 GROUP BY doc_id""")
def tx13(t):
    tags = T.normalize_strings(F.split("text", " "), F.array(F.lit("The"), F.lit("le")))
    return t.documents.select("doc_id", tags.alias("g")).select(
        "doc_id", F.size("g").alias("n"), F.md5(F.array_join("g", ",")).alias("tags")).filter("n > 0")


@query("tx14_content_hash", "SELECT doc_id, sha256(text) AS content_hash FROM documents")
def tx14(t):
    return t.documents.select("doc_id", T.content_hash("text").alias("content_hash"))


@query("tx15_stable_id", "SELECT doc_id, 'parent-' || sha256(source || chr(31) || doc_id || chr(31) || text)[1:16] AS id FROM documents")
def tx15(t):
    return t.documents.select("doc_id", T.stable_id("parent", "source", "doc_id", "text").alias("id"))


@query("tx16_conversation_title", rf"""WITH s AS (SELECT doc_id, {sql_squash('text')} AS s FROM documents)
SELECT doc_id, CASE WHEN s = '' THEN '新对话' WHEN length(s) <= 80 THEN s
  ELSE regexp_replace(s[1:77], '{WS}+\z', '') || '...' END AS title FROM s""")
def tx16(t):
    return t.documents.select("doc_id", T.conversation_title("text").alias("title"))


def snippet_sql(text, q, radius, miss):
    return f"""WITH s AS (SELECT id, {sql_squash('x')} AS s FROM (SELECT {text})),
p AS (SELECT *, strpos(lower(replace(s, 'ß', 'ss')), '{q}') AS p0 FROM s)
SELECT id, CASE WHEN p0 = 0 THEN {miss} ELSE CASE WHEN p0 - 1 > {radius} THEN '...' ELSE '' END ||
  substr(s, (greatest(p0 - 1 - {radius}, 0) + 1)::BIGINT,
    (least(length(s), p0 - 1 + {len(q)} + {radius}) - greatest(p0 - 1 - {radius}, 0))::BIGINT) ||
  CASE WHEN p0 - 1 + {len(q)} + {radius} < length(s) THEN '...' ELSE '' END END AS snippet FROM p"""


@query("tx17_search_snippet_pages", snippet_sql("doc_id AS id, text AS x FROM documents", "tion", 56, "''"))
def tx17a(t):
    return t.documents.select(F.col("doc_id").alias("id"), T.search_snippet("text", "TION", 56, "empty").alias("snippet"))


@query("tx17_search_snippet_messages",
       snippet_sql("conv_id * 1000 + turn AS id, text AS x FROM conversations", "ere", 48, "s[1:96]"))
def tx17b(t):
    return t.conversations.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"),
                                  T.search_snippet("text", "ere", 48, "head").alias("snippet"))


@query("tx18_like_literal", "SELECT doc_id FROM documents WHERE contains(lower(text), '%') OR contains(lower(text), 'the_')")
def tx18(t):
    return t.documents.filter(T.contains_literal("text", "%") | T.contains_literal("text", "THE_")).select("doc_id")


@query("tx19_estimate_tokens", f"SELECT doc_id, {sql_estimate('text')}::BIGINT AS tokens FROM documents")
def tx19(t):
    return t.documents.select("doc_id", K.estimate_tokens("text").alias("tokens"))


MARK = "chr(10) || '...[内容已按上下文预算截断]'"


@query("tx20_truncate_text", rf"""WITH b AS (SELECT doc_id, text, doc_id % 200 AS b FROM documents),
c AS (SELECT *, CASE WHEN 13 > b THEN '...' ELSE {MARK} END AS marker, CASE WHEN 13 > b THEN 1 ELSE 13 END AS cost,
  {sql_estimate('text')} AS est FROM b)
SELECT doc_id, CASE WHEN b <= 0 THEN '' WHEN est <= b THEN md5(text)
  ELSE md5(regexp_replace(text[1:4 * (b - cost)], '{WS}+\z', '') || marker) END AS cut FROM c""")
def tx20(t):
    # per-document budgets from 0 to 199 tokens; the texts hold no wide characters
    b = (F.col("doc_id") % 200).cast("int")
    return t.documents.select("doc_id", K.truncate_text("text", b).alias("c")).select(
        "doc_id", F.when(F.col("c") == "", "").otherwise(F.md5("c")).alias("cut"))


@query("tx21_serialize_context", """SELECT doc_id, '{"lang":"' || lang || '","n":"' || n_chars || '","source":"' || source || '"}' AS json FROM documents""")
def tx21(t):
    m = F.create_map(F.lit("source"), F.col("source"), F.lit("lang"), F.col("lang"),
                     F.lit("n"), F.col("n_chars").cast("string"))
    return t.documents.select("doc_id", K.serialize_context(m).alias("json"))


# nested JSON with its keys out of order; German documents are plain text
@query("tx21_serialize_json", """SELECT doc_id, CASE WHEN lang = 'de' THEN 'no json' ELSE '{"lang":"' || lang || '","source":"' || source || '","z":{"a":[' || n_chars || ',null],"b":true}}' END AS json FROM documents""")
def tx21j(t):
    nested = F.format_string('{"z": {"b": true, "a": [%d, null]}, "source": "%s", "lang": "%s"}', "n_chars", "source", "lang")
    return t.documents.select("doc_id", K.serialize_json(F.when(F.col("lang") == "de", "no json").otherwise(nested)).alias("json"))


@query("tx22_limit_context", f"""SELECT doc_id, {sql_estimate('text')}::BIGINT AS estimated_tokens,
  least({sql_estimate('text')}, 100)::BIGINT >= 0 AS ok, 100::BIGINT AS token_budget, {sql_estimate('text')} > 100 AS truncated FROM documents""")
def tx22(t):
    return t.documents.select("doc_id", K.limit_context("text", 100).alias("c")).select(
        "doc_id", F.col("c.estimated_tokens").alias("estimated_tokens"), (F.col("c.used_tokens") <= 100).alias("ok"),
        F.col("c.token_budget").alias("token_budget"), F.col("c.truncated").alias("truncated"))


SECRETS = r"regexp_replace(text, ' (t[a-z]+) ([a-z]+)', ' api_key=\1 Bearer \2 http://h?token=\1', 'g')"


@query("tx23_redact", rf"""WITH r AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace({SECRETS},
  '(?i)\b(api[_-]?key|authorization|access[_-]?token|secret|password)(\s*[=:]\s*)((?:Bearer\s+)?[^\s,;\]\}}\)]+)', '\1\2[REDACTED]', 'g'),
  '(?i)\bBearer\s+[A-Za-z0-9._~+/=-]+', 'Bearer [REDACTED]', 'g'),
  '(?i)([?&](?:api[_-]?key|token|secret)=)[^&#\s]+', '\1[REDACTED]', 'g') AS r FROM documents)
SELECT doc_id, md5(CASE WHEN length(r) > 4000 THEN r[1:4000] || '...[TRUNCATED]' ELSE r END) AS redacted FROM r""")
def tx23(t):
    leaky = F.regexp_replace("text", " (t[a-z]+) ([a-z]+)", " api_key=$1 Bearer $2 http://h?token=$1")
    return t.documents.select("doc_id", F.md5(T.redact(leaky)).alias("redacted"))


SENS = r"""(regexp_matches({x}, '(?i)-----BEGIN [A-Z ]*PRIVATE KEY-----') OR regexp_matches({x}, '\bsk-[A-Za-z0-9_-]{{12,}}\b')
 OR regexp_matches({x}, '(?i)\b(?:api[_-]?key|access[_-]?token|secret[_-]?key|password|passwd)\b\s*[:=]\s*["'']?[A-Za-z0-9_./+=-]{{12,}}')
 OR regexp_matches({x}, '(?i)\bBearer\s+[A-Za-z0-9._-]{{12,}}'))"""


@query("tx24_has_sensitive_value", f"SELECT doc_id, {SENS.format(x='text')} AS sensitive FROM documents")
def tx24(t):
    return t.documents.select("doc_id", T.has_sensitive_value("text").alias("sensitive"))


@query("tx25_timecodes", """WITH s AS (SELECT event_id, (value * 40)::DOUBLE AS sec FROM events),
i AS (SELECT event_id, greatest(0, trunc(sec)::BIGINT) AS s FROM s)
SELECT event_id, CASE WHEN s >= 3600 THEN format('{:02d}:{:02d}:{:02d}', s // 3600, s // 60 % 60, s % 60)
  ELSE format('{:02d}:{:02d}', s // 60, s % 60) END AS code, s::DOUBLE AS seconds FROM i""")
def tx25(t):
    code = T.format_timecode(F.col("value") * 40)
    return t.events.select("event_id", code.alias("code"), T.parse_timecode(code).alias("seconds"))


@query("tx26_audio_provenance", """WITH s AS (SELECT event_id, user_id, trunc(value)::BIGINT AS a, trunc(value)::BIGINT + 7 AS b FROM events
  WHERE event_type <> 'error')
SELECT event_id, user_id AS audio_id, a::DOUBLE AS audio_start, b::DOUBLE AS audio_end,
  '/audio/' || user_id || '/file#t=' || a || ',' || b AS audio_url,
  '/audio/' || user_id || '/transcript?start=' || a || '&end=' || b AS transcript_url FROM s""")
def tx26(t):
    kind = F.when(F.col("event_type") == "error", "file:").otherwise("audio:")
    uri = F.concat(kind, F.col("user_id").cast("string"), F.lit("/x"))
    sec = F.floor("value")
    content = F.concat(F.lit("said ["), T.format_timecode(sec), F.lit(" - "), T.format_timecode(sec + 7), F.lit("] hello"))
    return t.events.select("event_id", T.audio_provenance(uri, content).alias("a")).filter("a IS NOT NULL").select(
        "event_id", "a.*")


@query("tx27_guard_url", r"""WITH v AS (SELECT page_id, url FROM pages
  UNION ALL SELECT page_id, regexp_replace(url, '^https?://[^/]+', 'http://10.1.2.3') FROM pages
  UNION ALL SELECT page_id, regexp_replace(url, '^http', 'HTTP') || '' FROM pages),
p AS (SELECT page_id, url, regexp_extract(url, '^(?i:(https?))://([^/?#]+)([^?#]*)(\?[^#]*)?', ['s','h','p','q']) AS r FROM v)
SELECT page_id, lower(r.s) || '://' || rtrim(lower(r.h), '.') || CASE WHEN r.p = '' THEN '/' ELSE r.p END || r.q AS guarded,
  count(*)::BIGINT AS n FROM p WHERE r.s <> '' AND r.h <> '10.1.2.3' GROUP BY ALL""")
def tx27(t):
    u = F.col("url")
    rows = t.pages.select("page_id", F.explode(F.array(
        u, F.regexp_replace(u, "^https?://[^/]+", "http://10.1.2.3"), F.regexp_replace(u, "^http", "HTTP"))).alias("url"))
    return rows.select("page_id", T.guard_url("url").alias("guarded")).filter("guarded IS NOT NULL").groupBy(
        "page_id", "guarded").agg(F.count("*").alias("n"))


@query("tx28_clean_external_text", rf"""SELECT page_id, md5({sql_strip(rf"regexp_replace(html, '(?m){HS}+$', '', 'g')")}) AS content,
  md5({sql_strip(r"regexp_replace(html, '[#\r\n]+', ' ', 'g')")}) AS title FROM pages""")
def tx28(t):
    return t.pages.select("page_id", F.md5(T.clean_external_text("html")).alias("content"),
                          F.md5(T.clean_title("html")).alias("title"))


@query("tx29_split_tags", rf"""SELECT doc_id, len(list_filter([{sql_strip('x')} for x in string_split(text, ',')], lambda x: x <> ''))::BIGINT AS n,
  md5(array_to_string([{sql_strip('x')} for x in string_split(text, ',') if {sql_strip('x')} <> ''], '|')) AS tags FROM documents""")
def tx29(t):
    return t.documents.select("doc_id", T.split_tags("text").alias("g")).select(
        "doc_id", F.size("g").alias("n"), F.md5(F.array_join("g", "|")).alias("tags"))


@query("tx30_tokenize", f"SELECT doc_id, len({sql_tokens('text')})::BIGINT AS n, md5(array_to_string({sql_tokens('text')}, ' ')) AS tokens FROM documents")
def tx30(t):
    return t.documents.select("doc_id", K.tokenize("text").alias("k")).select(
        "doc_id", F.size("k").alias("n"), F.md5(F.array_join("k", " ")).alias("tokens"))


EVAL_TOK = rf"regexp_extract_all(lower(text), '[\x{{4e00}}-\x{{9fd5}}]+|[a-z0-9]+(?:\.[0-9]+)?%?|[^\x{{4e00}}-\x{{9fd5}}a-z0-9{WS[1:-1]}]')"


@query("tx31_tokenize_eval", f"SELECT doc_id, len({EVAL_TOK})::BIGINT AS n, md5(array_to_string({EVAL_TOK}, ' ')) AS tokens FROM documents")
def tx31(t):
    return t.documents.select("doc_id", K.tokenize_eval("text").alias("k")).select(
        "doc_id", F.size("k").alias("n"), F.md5(F.array_join("k", " ")).alias("tokens"))


@query("tx32_canonical_with_positions", rf"""WITH c AS (SELECT doc_id AS id, unnest(string_split(text, '')) AS ch,
  unnest(range(length(text))) AS pos FROM documents),
w AS (SELECT *, regexp_matches(ch, '{WS}') AS ws, lag(regexp_matches(ch, '{WS}')) OVER (PARTITION BY id ORDER BY pos) AS pw FROM c)
SELECT id, count(*)::BIGINT AS n, sum(pos)::BIGINT AS pos_sum, md5(string_agg(CASE WHEN ws THEN ' ' ELSE ch END, '' ORDER BY pos)) AS canonical
FROM w WHERE NOT (ws AND coalesce(pw, false)) GROUP BY id""")
def tx32(t):
    return t.documents.select(F.col("doc_id").alias("id"), T.canonical_positions("text").alias("c")).select(
        "id", F.size("c").alias("n"),
        F.aggregate("c", F.lit(0).cast("long"), lambda a, p: a + p["pos"]).alias("pos_sum"),
        F.md5(F.array_join(F.transform("c", lambda p: p["ch"]), "")).alias("canonical"))


@query("tx33_classify_error", f"""WITH {TIMELINE} SELECT sequence, stage, CASE stage WHEN 'retrieval.rerank' THEN 'RERANK_PROVIDER_ERROR'
  WHEN 'retrieval.bm25' THEN 'RETRIEVAL_ERROR' WHEN 'llm.answer' THEN 'LLM_PROVIDER_ERROR' WHEN 'agent.plan' THEN 'AGENT_PLAN_ERROR'
  ELSE 'AGENT_EXECUTION_ERROR' END AS code, split_part(stage, '.', 1) AS component, split_part(stage, '.', 2) AS operation,
  stage <> 'agent.evidence' AS retryable FROM tl""")
def tx33(t):
    return timeline(t).select("sequence", "stage", T.classify_error("stage").alias("e")).select("sequence", "stage", "e.*")


# a query log built from the texts: first words plus a command that depends on the language and source
LOG_WORDS = [("en", "总结"), ("fr", "有哪些"), ("de", "删除笔记"), ("es", "今天的笔记\u3000标签是")]


def query_log(t):
    lead = F
    for lang, word in LOG_WORDS:
        lead = lead.when(F.col("lang") == lang, word)
    tail = F.when(F.col("source").endswith("1"), " #t1\u3000这个？").when(F.col("source").endswith("2"), " 以及上周").otherwise("")
    return t.documents.select("doc_id", F.concat(lead.otherwise(""), F.col("text"), tail).alias("q"))


QLOG = r"""qlog AS (SELECT doc_id, lang, source, CASE lang WHEN 'en' THEN '总结' WHEN 'fr' THEN '有哪些' WHEN 'de' THEN '删除笔记'
  WHEN 'es' THEN '今天的笔记' || chr(12288) || '标签是' ELSE '' END || text ||
  CASE WHEN source LIKE '%1' THEN ' #t1' || chr(12288) || '这个？' WHEN source LIKE '%2' THEN ' 以及上周' ELSE '' END AS q FROM documents)"""


@query("tx34_classify_intent", f"""WITH {QLOG} SELECT doc_id, CASE lang WHEN 'en' THEN 'summarize' WHEN 'de' THEN 'delete_note'
  ELSE 'search' END AS intent FROM qlog""")
def tx34(t):
    return query_log(t).select("doc_id", Q.classify_intent("q").alias("intent"))


@query("tx35_is_fast_path", f"""WITH {QLOG} SELECT doc_id, lang NOT IN ('en', 'de') AND source NOT LIKE '%2' AND length(regexp_replace(q, '{WS}', '', 'g')) <= 160
  AND (lang = 'fr' OR source LIKE '%1' OR regexp_matches(q, '[?？]$')) AS fast FROM qlog""")
def tx35(t):
    return query_log(t).select("doc_id", Q.is_fast_path("q").alias("fast"))


@query("tx36_needs_context", f"WITH {QLOG} SELECT doc_id, source LIKE '%1' AS needs FROM qlog")
def tx36(t):
    return query_log(t).select("doc_id", Q.needs_context("q").alias("needs"))


@query("tx37_extract_date_range", f"""WITH {QLOG} SELECT doc_id,
  CASE WHEN lang = 'es' THEN DATE '2024-01-01' + n::INT ELSE date_trunc('week', DATE '2024-01-01' + n::INT) - INTERVAL 7 DAYS END::TIMESTAMP AS date_from,
  CASE WHEN lang = 'es' THEN DATE '2024-01-01' + n::INT ELSE date_trunc('week', DATE '2024-01-01' + n::INT) - INTERVAL 1 DAY END::TIMESTAMP
    + INTERVAL 86399999999 MICROSECONDS AS date_to
FROM qlog JOIN (SELECT doc_id, n_chars % 366 AS n FROM documents) USING (doc_id) WHERE lang = 'es' OR source LIKE '%2'""")
def tx37(t):
    day = t.documents.select("doc_id", F.timestamp_seconds(
        F.lit(1704067200 + 43200) + (F.col("n_chars") % 366) * 86400).alias("today"))
    return query_log(t).join(day, "doc_id").select("doc_id", Q.extract_date_range("q", "today").alias("d")).filter(
        "d IS NOT NULL").select("doc_id", "d.*")


@query("tx38_extract_tags_filename", rf"""WITH {QLOG} SELECT doc_id,
  coalesce(CASE WHEN lang = 'es' THEN regexp_extract(q, '标签[是为]{WS}*["“]?([^"“{WS[1:-1]}]+)["”]?', 1) END,
    CASE WHEN regexp_matches(q, '#([^{WS[1:-1]}#，。,.]+)') THEN regexp_extract(q, '#([^{WS[1:-1]}#，。,.]+)', 1) END) AS tag_filter,
  len(list_distinct(regexp_extract_all(q, '#([^{WS[1:-1]}#，。,.]+)', 1)))::BIGINT AS n_tags,
  CASE WHEN lang = 'es' THEN regexp_extract(q, '笔记{WS}([^{WS[1:-1]}]+)', 1) END AS filename FROM qlog""")
def tx38(t):
    return query_log(t).select("doc_id", Q.extract_tag_filter("q").alias("tag_filter"),
                               F.size(Q.extract_tags("q")).alias("n_tags"), Q.extract_filename("q").alias("filename"))


@query("tx39_parse_search_params", rf"""WITH {QLOG}, p AS (SELECT doc_id, q, lang = 'es' OR source LIKE '%2' AS dated,
  CASE WHEN lang = 'es' THEN regexp_extract(q, '标签是([^"“{WS[1:-1]}]+)', 1) WHEN regexp_matches(q, '#([^{WS[1:-1]}#，。,.]+)') THEN regexp_extract(q, '#([^{WS[1:-1]}#，。,.]+)', 1) END AS tag FROM qlog),
d AS (SELECT *, CASE WHEN dated THEN regexp_replace(regexp_replace(q, '(上|本|这|下)?(周|月|年)\d{{0,2}}', '', 'g'), '\d{{4}}[-/]\d{{1,2}}[-/]\d{{0,2}}', '', 'g') ELSE q END AS s FROM p)
SELECT doc_id, coalesce(nullif({sql_strip("CASE WHEN tag IS NULL THEN s ELSE replace(replace(s, '标签是' || tag, ''), '标签' || tag, '') END")}, ''), q) AS search, tag AS tag_filter FROM d""")
def tx39(t):
    now = F.to_timestamp(F.lit("2024-05-15 12:00:00"))
    return query_log(t).select("doc_id", Q.parse_search_params("q", now).alias("p")).select(
        "doc_id", F.col("p.query").alias("search"), F.col("p.tag_filter").alias("tag_filter"))


@query("tx40_render_markdown_table", """WITH w AS (SELECT o_custkey AS table_id, max(3 + (o_orderstatus = 'F')::INT) AS width,
  min(o_orderkey) AS first_row FROM orders GROUP BY o_custkey)
SELECT table_id, o_orderkey AS row_no, '| ' || o_orderkey || ' | ' || o_orderdate::DATE || ' | ' || o_orderstatus ||
  CASE WHEN width = 4 THEN ' | ' || CASE WHEN o_orderstatus = 'F' THEN o_orderpriority ELSE '' END ELSE '' END || ' |' ||
  CASE WHEN o_orderkey = first_row THEN chr(10) || '| ' || array_to_string(['---' for x in range(width)], ' | ') || ' |' ELSE '' END AS line
FROM orders JOIN w ON table_id = o_custkey""")
def tx40(t):
    cells = F.array(F.col("o_orderkey").cast("string"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.col("o_orderstatus"))
    wide = F.when(F.col("o_orderstatus") == "F", F.concat(cells, F.array(F.concat(F.lit(" "), "o_orderpriority")))).otherwise(cells)
    rows = t.orders.select(F.col("o_custkey").alias("table_id"), F.col("o_orderkey").alias("row_no"),
                           F.posexplode(wide).alias("col_no", "text"))
    return render_markdown_table(rows)
