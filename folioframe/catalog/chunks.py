"""Registered layout, chunking and corpus queries (CH)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import parent_chunk_id
from ..operators import chunking as C
from ..operators.layout import classify_layout_lines, layout_chars_to_lines
from .data import MD, WS, markdown, sql_strip
from .registry import query
from .texts import HEAD, NL, lines

# --- SQL twins: sections, packed parents, packed children ----------------------------------

SECTIONS = rf"""src AS (SELECT doc_id, {MD} AS t FROM documents),
ln AS ({lines('src', 't')}),
hd AS (SELECT *, {sql_strip('line')} AS s, regexp_matches({sql_strip('line')}, {HEAD}) AS h FROM ln),
sc AS (SELECT *, sum(h::INT) OVER (PARTITION BY doc_id ORDER BY pos)::BIGINT AS sec FROM hd),
hh AS (SELECT doc_id, sec, length(regexp_extract(s, {HEAD}, 1)) AS lv, {sql_strip(f"regexp_extract(s, {HEAD}, 2)")} AS title FROM sc WHERE h),
anc AS (SELECT h.doc_id, h.sec, string_agg(a.title, ' > ' ORDER BY a.lv) AS path FROM hh h JOIN hh a
  ON a.doc_id = h.doc_id AND a.sec <= h.sec WHERE NOT EXISTS (SELECT 1 FROM hh x WHERE x.doc_id = a.doc_id
  AND x.sec > a.sec AND x.sec <= h.sec AND x.lv <= a.lv) GROUP BY ALL),
sec AS (SELECT doc_id, sec, coalesce(path, '') AS path, text FROM (
  SELECT doc_id, sec, {sql_strip(f"string_agg(line, {NL} ORDER BY pos)")} AS text FROM sc GROUP BY doc_id, sec)
  LEFT JOIN anc USING (doc_id, sec) WHERE text <> '')"""


def packed(name: str, src: str, keys: str, pieces: str, max_chars: int, restart: str) -> str:
    """SQL: greedy packing of ``pieces`` of (keys, text, joiner) by walking one piece at a time."""
    on = " AND ".join(f"p.{k.strip()} = r.{k.strip()}" for k in keys.split(","))
    rk = ", ".join(f"r.{k.strip()}" for k in keys.split(","))
    return rf"""{name}_raw AS (SELECT {keys}, joiner, unnest(p) AS piece, unnest(range(len(p))) AS i0 FROM (
  SELECT {keys}, joiner, {pieces} AS p FROM {src})),
{name}_pc AS (SELECT {keys}, joiner, {sql_strip('piece')} AS piece, row_number() OVER (PARTITION BY {keys} ORDER BY i0) AS i
  FROM {name}_raw WHERE {sql_strip('piece')} <> ''),
{name}_walk AS (SELECT {keys}, i, piece AS cur, NULL::VARCHAR AS done FROM {name}_pc WHERE i = 1
  UNION ALL SELECT {rk}, p.i, CASE WHEN length(cur) + length(joiner) + length(piece) <= {max_chars} THEN cur || joiner || piece
    ELSE {restart} END, CASE WHEN length(cur) + length(joiner) + length(piece) <= {max_chars} THEN NULL ELSE cur END
  FROM {name}_walk r JOIN {name}_pc p ON {on} AND p.i = r.i + 1),
{name} AS (SELECT {keys}, i, done AS text FROM {name}_walk WHERE done IS NOT NULL
  UNION ALL SELECT {keys}, max(i) + 1, arg_max(cur, i) FROM {name}_walk GROUP BY {keys})"""


PARAGRAPHS = rf"string_split(regexp_replace(text, '\n{WS}*\n', chr(1), 'g'), chr(1))"
SENTENCES = r"string_split(regexp_replace(text, '([。！？.!?])', '\1' || chr(1), 'g'), chr(1))"

PARENTS = (SECTIONS + f""",
big AS (SELECT doc_id, sec, text, chr(10) || chr(10) AS joiner FROM sec WHERE length(text) > 1200),
""" + packed("pp", "big", "doc_id, sec", PARAGRAPHS, 1200,
             "CASE WHEN length(cur) > 120 THEN right(cur, 120) || joiner || piece ELSE piece END") + """,
par AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY sec, i) - 1 AS chunk_index, path, text FROM (
  SELECT doc_id, sec, i, text FROM pp UNION ALL SELECT doc_id, sec, 1, text FROM sec WHERE length(text) <= 1200)
  JOIN (SELECT doc_id, sec, path FROM sec) USING (doc_id, sec))""")


def children(src: str) -> str:
    """SQL: children of (doc_id, chunk_index, text) rows of ``src``."""
    return rf"""kid_src AS (SELECT doc_id, chunk_index, {sql_strip('text')} AS text,
  CASE WHEN contains({sql_strip('text')}, chr(10)) THEN chr(10) || chr(10) ELSE '' END AS joiner FROM {src} WHERE length({sql_strip('text')}) > 500),
""" + packed("kk", "kid_src", "doc_id, chunk_index",
             f"CASE WHEN len(list_filter({PARAGRAPHS}, lambda x: {sql_strip('x')} <> '')) = 1 THEN {SENTENCES} ELSE {PARAGRAPHS} END",
             500, sql_strip("right(cur, 80) || joiner || piece")) + """,
kid AS (SELECT doc_id, chunk_index, row_number() OVER (PARTITION BY doc_id, chunk_index ORDER BY i, w) - 1 AS child_index,
  substr(text, w, 500) AS text FROM (SELECT *, unnest(CASE WHEN length(text) <= 500 THEN [1] ELSE range(1, length(text) + 1, 420) END) AS w FROM kk))"""


UNITS = PARENTS + ",\n" + children("par") + """,
unit AS (SELECT doc_id, chunk_index, -1 AS child_index, path, text FROM par
  UNION ALL SELECT doc_id, chunk_index, child_index, path, kid.text FROM kid JOIN par USING (doc_id, chunk_index))"""


@query("ch3_split_by_headers", f"WITH {SECTIONS} SELECT doc_id, path AS section_path, md5(text) AS text FROM sec")
def ch3(t):
    return t.documents.select("doc_id", F.inline(C.split_by_headers(markdown()))).select(
        "doc_id", "section_path", F.md5("text").alias("text"))


@query("ch4_split_long_text", f"WITH RECURSIVE {PARENTS} SELECT doc_id, chunk_index, path AS section_path, md5(text) AS text FROM par")
def ch4(t):
    return t.documents.select("doc_id", F.posexplode(C.parents(markdown())).alias("chunk_index", "p")).select(
        "doc_id", "chunk_index", "p.section_path", F.md5("p.text").alias("text"))


WHOLE = "whole AS (SELECT doc_id, 0 AS chunk_index, text FROM documents)"


@query("ch5_split_children", f"WITH RECURSIVE {WHOLE}, {children('whole')} SELECT doc_id, child_index, md5(text) AS text FROM kid")
def ch5(t):
    return t.documents.select("doc_id", F.posexplode(C.split_children("text")).alias("child_index", "c")).select(
        "doc_id", "child_index", F.md5("c").alias("text"))


def page_chunks(t):
    pages = t.documents.select(
        F.col("doc_id").alias("page_id"), F.lit(1).alias("revision"), F.concat(F.lit("Page "), "source").alias("title"),
        markdown().alias("content"), F.col("lang").alias("notebook"), F.array("lang", "source").alias("tags"))
    return C.chunk_pages(pages, clean=False)


@query("ch6_chunk_pages", f"""WITH RECURSIVE {UNITS} SELECT 'page:' || doc_id || ':revision:1:chunk:' || chunk_index ||
  CASE WHEN child_index >= 0 THEN ':child:' || child_index ELSE '' END AS chunk_id,
  'page:' || doc_id || ':revision:1:chunk:' || chunk_index AS parent_chunk_id,
  CASE WHEN child_index >= 0 THEN 'child' ELSE 'parent' END AS chunk_level, CASE WHEN path = '' THEN 'Page ' || source ELSE path END AS section_path,
  lang || ',' || source AS tags, md5(unit.text) AS text FROM unit JOIN documents USING (doc_id)""")
def ch6(t):
    return page_chunks(t).select("chunk_id", "parent_chunk_id", "chunk_level", "section_path", "tags", F.md5("text").alias("text"))


@query("ch6_page_index_status", f"""WITH RECURSIVE {UNITS} SELECT d.doc_id AS page_id, count(*) FILTER (child_index = -1) AS chunks,
  count(*) FILTER (child_index >= 0) AS child_chunks, CASE WHEN count(child_index) > 0 THEN 'indexed' ELSE 'skipped_empty' END AS status
FROM documents d LEFT JOIN unit USING (doc_id) GROUP BY 1""")
def ch6_status(t):
    pages = t.documents.select(F.col("doc_id").alias("page_id"), markdown().alias("content"))
    return C.page_index_status(pages, page_chunks(t))


@query("ch7_chunk_files")
def ch7(t):
    files = t.documents.select(F.concat(F.lit("f"), F.col("doc_id").cast("string"), F.lit(".md")).alias("filename"),
                               F.col("n_chars").cast("double").alias("mtime"), markdown().alias("text"))
    return C.chunk_files(files)


@query("ch8_chunk_text_for_index", f"""WITH RECURSIVE {UNITS} SELECT doc_id AS page_id, chunk_index, child_index,
  length('Page ' || source || ' ' || CASE WHEN path = '' THEN 'Page ' || source ELSE path END || ' ' || unit.text)::BIGINT AS n,
  md5('Page ' || source || ' ' || CASE WHEN path = '' THEN 'Page ' || source ELSE path END || ' ' || unit.text) AS index_text
FROM unit JOIN documents USING (doc_id)""")
def ch8(t):
    return C.index_text(page_chunks(t), "page_title", "section_path").select(
        "page_id", "chunk_index", "child_index", F.length("index_text").alias("n"), F.md5("index_text").alias("index_text"))


@query("ch9_parent_chunk_id", """SELECT id, regexp_replace(id, '^(.+:chunk:[0-9]+):child:[0-9]+$', '\\1') AS parent FROM (
  SELECT 'page:' || l_orderkey || ':chunk:' || l_linenumber || CASE WHEN l_returnflag = 'N' THEN ':child:' || l_partkey ELSE '' END AS id FROM lineitem)""")
def ch9(t):
    ids = t.lineitem.select(F.concat(
        F.lit("page:"), F.col("l_orderkey").cast("string"), F.lit(":chunk:"), F.col("l_linenumber").cast("string"),
        F.when(F.col("l_returnflag") == "N", F.concat(F.lit(":child:"), F.col("l_partkey").cast("string"))).otherwise("")).alias("id"))
    return ids.select("id", parent_chunk_id("id").alias("parent"))


def sources(t):
    return t.documents.select(
        F.concat_ws("/", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".md"))).alias("path"), "doc_id",
        F.concat(F.lit("T"), F.col("doc_id").cast("string")).alias("title"), F.col("lang").alias("domain"),
        F.lit("note").alias("document_type"), markdown().alias("normalized_text"),
        F.sha2("text", 256).alias("sha256")).withColumn("normalized_sha256", F.sha2("normalized_text", 256))


CORPUS_ID = ("'parent-' || sha256(source || '/' || doc_id || '.md' || chr(31) || chunk_index || chr(31) || par_text)[1:16] || "
             "CASE WHEN child_index >= 0 THEN ':child:' || child_index ELSE '' END")


FLAT = rf"trim(regexp_replace(text, '{WS}+', ' ', 'g'))"


@query("ch10_build_corpus", f"""WITH RECURSIVE {UNITS} SELECT {CORPUS_ID} AS id, md5(text) AS text, contains(flat, {FLAT}) AS rereads,
  CASE WHEN child_index >= 0 THEN 'child' ELSE 'parent' END AS chunk_level, CASE WHEN path = '' THEN 'T' || doc_id ELSE path END AS section_path
FROM (SELECT unit.*, source, par.text AS par_text, flat FROM unit JOIN par USING (doc_id, chunk_index) JOIN documents USING (doc_id) JOIN (SELECT doc_id, {FLAT.replace("text", "t")} AS flat FROM src) USING (doc_id))""")
def ch10(t):
    src = sources(t)
    corpus = C.build_corpus(src).join(src.select(F.col("path").alias("source_path"), "normalized_text"), "source_path")
    span = F.substring("normalized_text", F.col("source_start_char") + 1, F.col("source_end_char") - F.col("source_start_char"))
    flat = lambda c: F.trim(F.regexp_replace(c, rf"{WS}+", " "))
    return corpus.select("id", F.md5("text").alias("text"), F.coalesce(flat(span) == flat("text"), F.lit(False)).alias("rereads"), "chunk_level", "section_path")


@query("ch11_locate_span", """SELECT doc_id, (strpos(text, s) - 1)::BIGINT AS "start", (strpos(text, s) - 1 + length(s))::BIGINT AS "end"
FROM (SELECT doc_id, text, text[length(text) // 2:length(text) // 2 + 40] AS s FROM documents)""")
def ch11(t):
    half = F.floor(F.length("text") / 2).cast("int")
    piece = F.substring(F.col("text"), F.greatest(half, F.lit(1)), F.lit(41) + F.least(half - 1, F.lit(0)))
    return t.documents.select("doc_id", F.inline(F.array(C.locate_span(F.col("text"), piece, F.lit(0)))))


# pieces of parents as an independent walk; the source span is compared without its whitespace
EVIDENCE = PARENTS.replace("WITH RECURSIVE", "") + rf""",
pg AS (SELECT doc_id, chunk_index, i, {sql_strip('p')} AS p FROM (SELECT doc_id, chunk_index, unnest({PARAGRAPHS}) AS p, unnest(range(len({PARAGRAPHS}))) AS i FROM par)),
cw AS (SELECT doc_id, chunk_index, i, p, 0 AS a, 0 AS b FROM pg WHERE p <> '' UNION ALL
  SELECT doc_id, chunk_index, i, p, b, CASE WHEN length(p) <= 420 THEN length(p) WHEN s < length(p) AND length(m) > 0 THEN b + 210 + length(m) ELSE s END FROM (
    SELECT *, least(b + 420, length(p)) AS s, regexp_extract(p[b + 211:least(b + 420, length(p)) + 1], '(?s)^(.*[。！？.!?
])', 1) AS m FROM cw WHERE b < length(p)))"""


@query("ch12_evidence_spans", rf"""WITH RECURSIVE {EVIDENCE} SELECT source || '/' || doc_id || '.md' AS source_path, chunk_index::BIGINT AS chunk_index,
  row_number() OVER (PARTITION BY doc_id, chunk_index ORDER BY i, a) - 1 AS span_index, md5(regexp_replace(x, '{WS}+', ' ', 'g')) AS text
FROM (SELECT doc_id, chunk_index, i, a, {sql_strip('p[a + 1:b]')} AS x FROM cw WHERE b > 0) JOIN documents USING (doc_id) WHERE length(x) >= 8""")
def ch12(t):
    spans = C.evidence_spans(C.with_parents(sources(t)))
    return spans.select("source_path", "chunk_index", "span_index", F.md5(F.regexp_replace("text", rf"{WS}+", " ")).alias("text"))


@query("ch13_select_spread_chunks")
def ch13(t):
    rows = C.with_parents(sources(t)).select("path", C.select_spread_chunks(F.col("parents"), F.lit(2)).alias("c"))
    return rows.select("path", F.inline("c"))


@query("ch14_load_sources", """SELECT 'd/' || doc_id || '.md' AS path, lang AS domain, sha256(text) AS sha256,
  (n_chars % 3 + 1)::BIGINT AS target, doc_id::VARCHAR AS title FROM documents JOIN labels USING (doc_id) WHERE quality = 1""")
def ch14(t):
    path = F.concat(F.lit("d/"), F.col("doc_id").cast("string"), F.lit(".md"))
    manifest = t.documents.join(t.labels.filter("quality = 1"), "doc_id").select(
        path.alias("path"), F.col("lang").alias("domain"), F.col("source").alias("document_type"),
        (F.col("n_chars") % 3 + 1).alias("positive_question_target"))
    files = t.documents.select(path.alias("path"), F.col("text").alias("raw_text"))
    return C.load_sources(manifest, files).select("path", "domain", "sha256", "target", "title")


@query("ch15_domain_outline", f"""WITH src AS (SELECT doc_id, lang, source, {MD} AS t FROM documents),
h AS (SELECT doc_id, lang, source, unnest(regexp_extract_all(t, '(?m)^(#{{1,6}}{WS}+.+?){WS}*$', 1)[1:80]) AS heading,
  unnest(range(len(regexp_extract_all(t, '(?m)^(#{{1,6}}{WS}+.+?){WS}*$', 1)[1:80]))) AS position FROM src)
SELECT lang AS domain, source || '/' || doc_id || '.md' AS path, position, heading FROM h""")
def ch15(t):
    return C.domain_outline(sources(t))


@query("ch16_corpus_profile", f"""WITH RECURSIVE {UNITS} SELECT (SELECT count(*) FROM documents) AS documents, (SELECT sum(length(t))::BIGINT FROM src) AS chars,
  count(*) AS units, count(*) FILTER (child_index = -1) AS parents, count(*) FILTER (child_index >= 0) AS children FROM unit""")
def ch16(t):
    src = sources(t)
    # only the counts are needed, so the units are not located
    corpus = src.select(F.inline(C.units(F.col("normalized_text")))).select(
        F.when(F.col("child_index") < 0, "parent").otherwise("child").alias("chunk_level"))
    return C.corpus_profile(src, corpus)


# --- layout: every part-supplier line is a character of a page ------------------------------

def layout_chars(t):
    return t.lineitem.select(
        F.col("l_orderkey").alias("doc_id"), F.col("l_suppkey").alias("page"), F.col("l_quantity").alias("top"),
        F.col("l_extendedprice").alias("x0"), (F.lit(8.0) + F.col("l_linenumber") * 2).alias("size"),
        F.when(F.col("l_returnflag") == "R", "Arial-Bold").otherwise("Arial").alias("fontname"),
        F.concat(F.lit("c"), F.col("l_partkey").cast("string")).alias("text"))


LAYOUT = """ch AS (SELECT l_orderkey AS doc_id, l_suppkey AS page, l_quantity AS top, l_extendedprice AS x0, 8.0 + l_linenumber * 2 AS size,
  l_returnflag = 'R' AS bold, 'c' || l_partkey AS text FROM lineitem),
lg AS (SELECT *, lag(top) OVER w AS pt, lag(size) OVER w AS ps FROM ch WINDOW w AS (PARTITION BY doc_id, page ORDER BY top, x0)),
nl AS (SELECT *, sum(CASE WHEN abs(top - pt) >= 0.5 * greatest(ps, size) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page ORDER BY top, x0)::BIGINT AS line_no FROM lg),
li AS (SELECT doc_id, page, line_no, string_agg(text, '' ORDER BY top, x0) AS text, max(size)::DOUBLE AS max_size, bool_and(bold) AS all_bold FROM nl GROUP BY ALL)"""


@query("ch1_layout_chars_to_lines", f"WITH {LAYOUT} SELECT * FROM li")
def ch1(t):
    return layout_chars_to_lines(layout_chars(t))


@query("ch2_classify_layout_lines", f"""WITH {LAYOUT},
cnt AS (SELECT doc_id, round(max_size, 1) AS s, count(*) AS n, min(page * 1000000 + line_no) AS f FROM li WHERE max_size BETWEEN 8 AND 24 GROUP BY ALL),
body AS (SELECT doc_id, arg_min(s, (-n) * 1000000000000 + f) AS b FROM cnt GROUP BY doc_id),
k AS (SELECT li.*, max_size / coalesce(b, 12) AS r FROM li LEFT JOIN body USING (doc_id)),
c AS (SELECT *, CASE WHEN r >= 1.8 THEN 1 WHEN r >= 1.4 THEN 2 WHEN r >= 1.15 THEN 3 ELSE 0 END AS lv FROM k),
m AS (SELECT *, CASE WHEN lv > 0 THEN 'heading' WHEN all_bold AND length(text) < 50 THEN 'bold' ELSE 'text' END AS kind,
  CASE WHEN lv > 0 THEN repeat('#', lv) || ' ' || text WHEN all_bold AND length(text) < 50 THEN '## ' || text ELSE text END AS block FROM c),
g AS (SELECT *, lag(kind) OVER (PARTITION BY doc_id, page ORDER BY line_no) AS pk FROM m),
b AS (SELECT *, sum(CASE WHEN kind <> 'text' OR coalesce(pk, '') <> 'text' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page ORDER BY line_no)::BIGINT AS block_no FROM g)
SELECT doc_id, page, block_no, any_value(kind) AS kind, string_agg(block, ' ' ORDER BY line_no) AS markdown FROM b GROUP BY ALL""")
def ch2(t):
    return classify_layout_lines(layout_chars_to_lines(layout_chars(t)))
