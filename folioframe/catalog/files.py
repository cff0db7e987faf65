"""Registered source and sink queries (SRC): tables are written out and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import shared_dir
from ..sources import io as R
from .data import WIKI_PAGES, corpus, markdown, MD, wiki_pages, timeline, TIMELINE
from .registry import query


@query("src1_read_corpus", r"""SELECT doc_id::VARCHAR AS doc_id, md5(regexp_replace(text, '^\s+|\s+$', '', 'g')) AS text, lang AS title, source FROM documents""")
def src1(t):
    path = shared_dir(t.spark, "corpus")
    d = t.documents
    rows = d.select(F.when(F.col("lang") == "en", " ").otherwise(F.col("doc_id").cast("string")).alias("id"), F.col("doc_id").cast("string").alias("doc_id"),
                    F.when(F.col("lang") == "fr", F.col("text")).alias("text"), F.col("text").alias("content"), F.concat(F.lit(" "), "lang").alias("title"),
                    F.create_map(F.lit("source"), F.col("source")).alias("metadata"))
    R.write_jsonl(rows, path)
    return R.read_corpus(t.spark, path).select("doc_id", F.md5("text").alias("text"), "title", F.col("metadata.source").alias("source"))


def faulty_corpus(t):
    """A corpus file with every kind of fault, by language and length of the document."""
    path, d = shared_dir(t.spark, "corpus"), F.col("doc_id").cast("string")
    kind = F.col("n_chars") % 7
    fields = [F.concat(F.lit('{"id":"'), d, F.lit('"')), F.concat(F.lit('"content":"'), F.when(kind == 0, " ").otherwise(F.md5("text")), F.lit('"')),
              F.when(kind == 1, '"title":5').otherwise('"title":" t"'),
              F.concat(F.lit('"metadata":'), F.when(kind == 2, F.lit("[]")).otherwise(F.concat(F.lit('{"n":'), F.col("n_chars").cast("string"), F.lit("}}"))))]
    line = F.concat(F.concat_ws(",", *fields), F.when(kind == 2, "}").otherwise(""))
    value = (F.when(F.col("lang") == "de", F.concat(F.lit('{"id":'), d)).when(F.col("lang") == "fr", F.concat(F.lit("["), d, F.lit("]")))
             .when(F.col("lang") == "es", F.concat(F.lit('{"id":'), d, F.lit(',"text":"x"}'))).otherwise(line))
    twice = F.explode(F.array_repeat(value, F.when(kind == 3, 2).otherwise(1)))
    t.documents.select(twice.alias("value")).write.mode("overwrite").text(path)
    return R.read_corpus_checked(t.spark, path)


FAULTY = """d AS (SELECT doc_id::VARCHAR AS id, lang, n_chars % 7 AS kind, n_chars, text, CASE lang WHEN 'de' THEN '{"id":' || doc_id WHEN 'fr' THEN '[' || doc_id || ']' WHEN 'es' THEN '{"id":' || doc_id || ',"text":"x"}' END AS bad,
  unnest(CASE WHEN n_chars % 7 = 3 THEN [1, 2] ELSE [1] END) AS copy FROM documents)"""


@query("src1_corpus_violations", f"""WITH {FAULTY} SELECT CASE lang WHEN 'de' THEN 'invalid_json' WHEN 'fr' THEN 'not_an_object' ELSE 'id_missing' END AS rule, md5(bad) AS key FROM d WHERE bad IS NOT NULL
UNION ALL SELECT CASE kind WHEN 0 THEN 'text_missing' WHEN 1 THEN 'title_not_text' ELSE 'metadata_not_an_object' END, id FROM d WHERE bad IS NULL AND kind < 3
UNION ALL SELECT 'duplicate_id', id FROM d WHERE bad IS NULL AND kind = 3 AND copy = 1""")
def src1v(t):
    return faulty_corpus(t)["violations"]


@query("src1_checked_documents", f"WITH {FAULTY} SELECT id AS doc_id, md5(text) AS text, 't' AS title, n_chars AS n FROM d WHERE bad IS NULL AND kind >= 3")
def src1d(t):
    return faulty_corpus(t)["documents"].select("doc_id", "text", "title", F.try_variant_get("metadata", "$.n", "bigint").alias("n"))


def question_file(t):
    path = shared_dir(t.spark, "questions")
    c = F.col("conv_id").cast("string")
    graded = F.map_from_arrays(F.array(F.concat(F.lit("d"), c), F.concat(F.lit(" e"), c)), F.array(F.lit(3.0), F.lit(1.5)))
    rows = t.conversations.select(
        F.concat(c, F.lit("-"), F.col("turn").cast("string")).alias("query_id"), F.col("text").alias("query"), F.when(F.col("turn") > 1, F.col("role")).alias("category"),
        F.when(F.col("turn") % 2 == 0, graded).alias("relevance"), F.array(F.concat(F.lit("x"), c)).alias("relevant_doc_ids"),
        F.when(F.col("turn") == 0, F.array(F.struct(F.lit("s").alias("source_id"), F.lit(1).alias("start_char"), F.length("text").alias("end_char"), F.col("text").alias("quote")))).alias("evidence"))
    R.write_jsonl(rows, path)
    return R.read_queries(t.spark, path)


@query("src2_read_queries", r"SELECT conv_id || '-' || turn AS query_id, md5(regexp_replace(text, '^\s+|\s+$', '', 'g')) AS query, CASE WHEN turn > 1 THEN role ELSE 'default' END AS category, CASE WHEN turn > 1 THEN role ELSE 'default' END AS question_type, 'answer' AS expected_action FROM conversations")
def src2(t):
    return question_file(t)["queries"].select("query_id", F.md5("query").alias("query"), "category", "question_type", "expected_action")


@query("src2_read_qrels", """SELECT conv_id || '-' || turn AS query_id, 'd' || conv_id AS doc_id, 3.0::DOUBLE AS grade FROM conversations WHERE turn % 2 = 0 UNION ALL SELECT conv_id || '-' || turn, 'e' || conv_id, 1.5 FROM conversations WHERE turn % 2 = 0
UNION ALL SELECT conv_id || '-' || turn, 'x' || conv_id, 1.0 FROM conversations WHERE turn % 2 = 1""")
def src2q(t):
    return question_file(t)["qrels"]


@query("src2_read_evidence", "SELECT conv_id || '-' || turn AS query_id, 0::BIGINT AS ord, 1::BIGINT AS start_char, length(text) AS end_char, text AS quote FROM conversations WHERE turn = 0")
def src2e(t):
    return question_file(t)["evidence"].select("query_id", "ord", "start_char", "end_char", "quote")


@query("src3_read_markdown_dir", "SELECT sum(length(text) + 1)::BIGINT AS chars FROM conversations")
def src3(t):
    path = shared_dir(t.spark, "notes")
    t.conversations.select("text").write.mode("overwrite").text(path)
    files = R.read_markdown_dir(t.spark, path)
    return files.filter("status = 'ok'").agg(F.sum(F.length("text")).alias("chars"))


def legacy(t):
    files = t.documents.select(F.concat_ws("/", "source", "n_chars").alias("path"), markdown().alias("text")).dropDuplicates(["path"])
    return R.import_legacy(files, wiki_pages(t).filter("notebook = 'en'"), "document", "old")


@query("src4_import_legacy", f"""WITH {WIKI_PAGES}, f AS (SELECT DISTINCT source || '/' || n_chars AS path FROM documents), l AS (SELECT DISTINCT source_uri FROM wiki WHERE status <> 'deleted' AND notebook = 'en')
SELECT count(*) AS total, count(*) FILTER (path NOT IN (SELECT source_uri FROM l)) AS imported, count(*) FILTER (path IN (SELECT source_uri FROM l)) AS skipped, 0::BIGINT AS errors FROM f""")
def src4(t):
    return legacy(t)["counts"]


def page_files(t):
    return wiki_pages(t).select("page_id", "title", "tags", "content", R.render_page(
        {"id": F.col("page_id"), "title": F.col("title"), "revision": F.col("revision"), "tags": F.col("tags")}, F.col("content")).alias("raw"))


# every third file misses its title, German ones never close their header
@query("src5_parse_front_matter", rf"""WITH {WIKI_PAGES} SELECT page_id, CASE WHEN notebook = 'de' THEN 'HEADER_NOT_CLOSED' WHEN page_id::BIGINT % 3 = 0 THEN 'HEADER_INCOMPLETE' END AS error,
  CASE WHEN notebook <> 'de' AND page_id::BIGINT % 3 <> 0 THEN title END AS title, CASE WHEN notebook <> 'de' AND page_id::BIGINT % 3 <> 0 THEN md5(regexp_replace(content, '\s+\z', '')) END AS body FROM wiki""")
def src5(t):
    raw = F.when(F.array_contains("tags", "de"), F.replace("raw", F.lit("\n---\n"), F.lit("\n"))).when(
        F.col("page_id").cast("long") % 3 == 0, F.regexp_replace("raw", r"(?m)^title: .*\n", "")).otherwise(F.col("raw"))
    files = page_files(t).select("page_id", raw.alias("raw"))
    return R.parse_front_matter(files).select("page_id", F.regexp_replace("error", ":.*", "").alias("error"), F.col("meta.title").alias("title"), F.md5("body").alias("body"))


@query("src6_render_page", rf"""WITH {WIKI_PAGES} SELECT page_id, md5('---' || chr(10) || 'id: "' || page_id || '"' || chr(10) || 'title: ' || to_json(title)::VARCHAR || chr(10) || 'revision: 1' || chr(10) || 'tags: ["' || tags[1] || '","' || tags[2] || '"]' || chr(10) || '---' || chr(10) || chr(10) ||
  regexp_replace(content, '\s+\z', '') || chr(10)) AS raw FROM wiki""")
def src6(t):
    return page_files(t).select("page_id", F.md5("raw").alias("raw"))


@query("src7_export_pages", f"WITH {WIKI_PAGES} SELECT page_id, title, md5(content) AS content FROM wiki WHERE status <> 'deleted'")
def src7(t):
    path = shared_dir(t.spark, "export")
    R.export_pages(wiki_pages(t), path)
    manifest = t.spark.read.schema("page_id string").json(f"{path}/manifest")
    pages = t.spark.read.schema("page_id string, title string, content string").json(f"{path}/pages")
    return pages.join(manifest, "page_id").select("page_id", "title", F.md5("content").alias("content"))


@query("src8_write_report", "SELECT lang, count(*) AS documents, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY 1")
def src8(t):
    path = shared_dir(t.spark, "report")
    R.write_report(t.documents.groupBy("lang").agg(F.count("*").alias("documents"), F.sum("n_chars").alias("chars")), path)
    return t.spark.read.schema("lang string, documents long, chars long").json(path)


def logs(t):
    path = shared_dir(t.spark, "logs")
    rows = timeline(t).select(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"), F.when(F.col("status") == "failed", "ERROR").otherwise("INFO").alias("level"),
                              F.lit("app").alias("logger"), "request_id", F.concat(F.lit("stage "), "stage").alias("message"), "stage", "duration_ms",
                              F.when(F.col("status") == "failed", "AGENT_EXECUTION_ERROR").alias("error_code"))
    R.write_jsonl(rows, path)
    return R.read_json_logs(t.spark, path)


@query("src9_logs_by_error", f"WITH {TIMELINE} SELECT request_id, 'ERROR' AS level, stage, round(duration_ms, 4) AS duration_ms FROM tl WHERE status = 'failed'")
def src9(t):
    return R.logs_by_error(logs(t), "AGENT_EXECUTION_ERROR").select("request_id", "level", "stage", F.round("duration_ms", 4).alias("duration_ms"))


@query("src9_logs_by_request", f"WITH {TIMELINE} SELECT stage, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS timestamp FROM tl WHERE request_id = (SELECT min(request_id) FROM tl)")
def src9r(t):
    first = timeline(t).agg(F.min("request_id")).first()[0]       # one value
    return R.logs_by_request(logs(t), first).select("stage", "timestamp")


@query("src10_read_tables", """SELECT event_id::VARCHAR AS request_id, event_type AS stage, round(value, 4) AS duration_ms, json_extract_string(props, '$.k') AS k FROM events""")
def src10(t):
    path = shared_dir(t.spark, "agent_runs")
    t.events.select(F.col("event_id").cast("string").alias("request_id"), F.to_json(F.array(F.struct(F.col("event_type").alias("stage"), F.col("value").alias("duration_ms")))).alias("timeline"),
                    F.col("props").alias("retrieval_stats")).write.mode("overwrite").parquet(path)
    runs = R.read_table(t.spark, "agent_runs", path)
    return runs.select("request_id", F.col("timeline")[0]["stage"].alias("stage"), F.round(F.col("timeline")[0]["duration_ms"], 4).alias("duration_ms"), F.col("retrieval_stats.k").alias("k"))


# statistics of errors are cut off and cannot be parsed
@query("src10_read_variant", """SELECT event_id::VARCHAR AS request_id, event_type AS stage, CASE WHEN event_type <> 'error' THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k, CASE WHEN event_type = 'error' THEN 'retrieval_stats' ELSE '' END AS unparsed FROM events""")
def src10v(t):
    path = shared_dir(t.spark, "agent_runs")
    t.events.select(F.col("event_id").cast("string").alias("request_id"), F.to_json(F.array(F.struct(F.col("event_type").alias("stage"), F.col("value").alias("duration_ms")))).alias("timeline"),
                    F.when(F.col("event_type") == "error", F.concat(F.lit("{"), "props")).otherwise(F.col("props")).alias("retrieval_stats")).write.mode("overwrite").parquet(path)
    runs = R.read_table_variant(t.spark, "agent_runs", path)
    return runs.select("request_id", F.try_variant_get("timeline", "$[0].stage", "string").alias("stage"), F.try_variant_get("retrieval_stats", "$.k", "bigint").alias("k"),
                       F.array_join("unparsed", ",").alias("unparsed"))


@query("src11_chunks_by_id", "SELECT doc_id AS chunk_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def src11(t):
    ids = t.labels.filter("quality = 1").select(F.col("doc_id").alias("chunk_id"))
    return R.chunks_by_id(corpus(t), ids).select("chunk_id", "lang")


@query("src11_chunks_where", "SELECT doc_id AS chunk_id FROM documents WHERE lang = 'fr' AND source = 'src3'")
def src11w(t):
    return R.chunks_where(corpus(t), (F.col("lang") == "fr") & (F.col("source") == "src3")).select("chunk_id")


@query("src11_chunks_by_source", f"SELECT doc_id AS chunk_id, length({MD}) AS n FROM documents WHERE source = 'src7'")
def src11s(t):
    chunks = t.documents.select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("filename"), markdown().alias("text"))
    return R.chunks_by_source(chunks, "src7").select("chunk_id", F.length("text").alias("n"))
