"""Corpus, wiki, telemetry and transcript tables derived from the given ones, in Spark and as SQL.

The SQL twins are CTE bodies for the oracles and are written on their own terms.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.index import build_postings, folded_term_vectors, hashed_term_vectors
from ..operators.store import LexicalStore
from ..session import shared_dir
from .registry import Tables

# whitespace classes in RE2 syntax
WS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
HS = r"[\t\x0b-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def sql_strip(x: str) -> str:
    return rf"regexp_replace({x}, '\A{WS}+|{WS}+\z', '', 'g')"


def sql_squash(x: str) -> str:
    return rf"trim(regexp_replace({x}, '{WS}+', ' ', 'g'))"


def sql_tokens(x: str) -> str:
    return rf"regexp_extract_all({x}, '[a-zA-Z0-9]+|[\x{{4e00}}-\x{{9fa5}}]+')"


def sql_estimate(x: str) -> str:
    rest = rf"length(regexp_replace({x}, '[\x{{3400}}-\x{{9fff}}]', '', 'g'))"
    return f"(length({x}) - {rest} + CAST(ceil({rest} / 4.0) AS BIGINT))"


# --- Markdown-like text: short lines become headings (some linked) and fences --------------

def markdown(text="text"):
    t = F.regexp_replace(F.col(text), r"\.\n", ".\n\n")
    t = F.regexp_replace(t, r"(?dm)^(Th[^\n]{0,30})$", "```")
    t = F.regexp_replace(t, r"(?dm)^([A-M][^\n]{0,60})$", "# $1")
    return F.regexp_replace(t, r"(?dm)^([N-Z][^\n]{0,60})$", "### [$1](http://h/x)")


MD = (r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\.\n', '.' || chr(10) || chr(10), 'g'),"
      r" '(?m)^(Th[^\n]{0,30})$', '```', 'g'), '(?m)^([A-M][^\n]{0,60})$', '# \1', 'g'),"
      r" '(?m)^([N-Z][^\n]{0,60})$', '### [\1](http://h/x)', 'g')")


# --- wiki pages ---------------------------------------------------------------------------

def wiki_pages(t: Tables) -> DataFrame:
    d = t.documents.join(t.labels, "doc_id", "left")
    return d.select(
        F.col("doc_id").cast("string").alias("page_id"),
        F.coalesce(F.nullif(F.regexp_extract("text", r"^\S+ \S+", 0), F.lit("")), F.lit("untitled")).alias("title"),
        F.col("lang").alias("notebook"), F.array("lang", "source").alias("tags"),
        F.array(F.regexp_extract("text", r"^\S+", 0)).alias("aliases"),
        F.when(F.col("toxic") == 1, "deleted").otherwise("active").alias("status"),
        F.when(F.col("quality") == 1, "note").when(F.col("quality") == 0, "document")
        .otherwise("wiki").alias("source_type"),
        F.concat_ws("/", "source", "n_chars").alias("source_uri"),
        F.lit(1).alias("revision"), F.col("text").alias("content"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("n_chars") * 60).alias("updated_at"))


WIKI_PAGES = r"""wiki AS (
  SELECT d.doc_id::VARCHAR AS page_id, coalesce(nullif(regexp_extract(text, '^\S+ \S+'), ''), 'untitled') AS title,
    lang AS notebook, [lang, source] AS tags, [regexp_extract(text, '^\S+')] AS aliases,
    CASE WHEN toxic = 1 THEN 'deleted' ELSE 'active' END AS status,
    CASE quality WHEN 1 THEN 'note' WHEN 0 THEN 'document' ELSE 'wiki' END AS source_type,
    source || '/' || n_chars AS source_uri, 1 AS revision, text AS content,
    TIMESTAMP '2024-01-01' + to_minutes(n_chars) AS updated_at
  FROM documents d LEFT JOIN labels USING (doc_id))"""


def linked_pages(t: Tables) -> DataFrame:
    """Wiki pages whose capitalised words are links, some with anchor and label."""
    return wiki_pages(t).withColumn("content", F.regexp_replace(F.regexp_replace(
        "content", r"([A-H][a-z]+) ([a-z]+)", "[[$1 $2]] "), r"([I-Z][a-z]+) ", "[[ $1#top|label]] "))


LINKED = (r"linked AS (SELECT * REPLACE (regexp_replace(regexp_replace(content, "
          r"'([A-H][a-z]+) ([a-z]+)', '[[\1 \2]] ', 'g'), '([I-Z][a-z]+) ', '[[ \1#top|label]] ', 'g') "
          r"AS content) FROM wiki)")


def revisions(t: Tables) -> DataFrame:
    return t.conversations.select(
        F.col("conv_id").alias("page_id"), (F.col("turn") + 1).alias("revision"),
        F.concat(F.lit("page "), F.col("conv_id").cast("string")).alias("title"),
        F.col("text").alias("content"), F.col("role").alias("change_summary"))


REVISIONS = ("revs AS (SELECT conv_id AS page_id, turn + 1 AS revision, 'page ' || conv_id AS title, "
             "text AS content, role AS change_summary FROM conversations)")


# --- conversations ------------------------------------------------------------------------

def messages(t: Tables) -> DataFrame:
    return t.conversations.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("conv_id").alias("session_id"),
        "role", F.col("text").alias("content"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("conv_id") * 3600 + F.col("turn") * 60).alias("created_at"))


MESSAGES = ("msgs AS (SELECT conv_id * 1000 + turn AS id, conv_id AS session_id, role, text AS content, "
            "TIMESTAMP '2024-01-01' + to_hours(conv_id) + to_minutes(turn) AS created_at FROM conversations)")


# --- run telemetry: one run per user and day ----------------------------------------------

STAGES = [("view", "retrieval.bm25"), ("click", "retrieval.rerank"), ("signup", "agent.plan"),
          ("purchase", "llm.answer"), ("error", "agent.evidence")]


def timeline(t: Tables) -> DataFrame:
    stage = F
    for event, name in STAGES:
        stage = stage.when(F.col("event_type") == event, name)
    day = F.date_format("ts", "yyyyMMdd")
    return t.events.select(
        F.concat_ws("-", F.col("user_id").cast("string"), day).alias("request_id"),
        F.col("user_id").alias("session_id"), F.col("event_id").alias("sequence"), "ts",
        stage.otherwise("other").alias("stage"),
        F.when(F.col("event_type") == "error", "failed").otherwise("completed").alias("status"),
        F.col("value").alias("duration_ms"), F.get_json_object("props", "$.k").cast("long").alias("k"))


TIMELINE = """tl AS (
  SELECT user_id || '-' || strftime(ts, '%Y%m%d') AS request_id, user_id AS session_id, event_id AS sequence, ts,
    CASE event_type WHEN 'view' THEN 'retrieval.bm25' WHEN 'click' THEN 'retrieval.rerank'
      WHEN 'signup' THEN 'agent.plan' WHEN 'purchase' THEN 'llm.answer' WHEN 'error' THEN 'agent.evidence'
      ELSE 'other' END AS stage,
    CASE WHEN event_type = 'error' THEN 'failed' ELSE 'completed' END AS status,
    value AS duration_ms, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"""


def model_calls(t: Tables) -> DataFrame:
    """Every event as a model call: k and the value give the token counts."""
    return timeline(t).select(
        "request_id", "sequence", F.col("stage").alias("operation"),
        (F.col("k") * 10).alias("prompt_tokens"), F.round("duration_ms").cast("long").alias("completion_tokens"),
        (F.col("k") * 10 + F.round("duration_ms").cast("long")).alias("total_tokens"),
        F.when(F.col("stage") == "llm.answer", F.lit(200)).cast("long").alias("token_budget"),
        F.lit(None).cast("long").alias("input_budget"), F.lit(None).cast("long").alias("context_window_tokens"),
        (F.col("status") == "failed").alias("fallback_used"), (F.col("duration_ms") > 100).alias("truncated"),
        "duration_ms")


CALLS = """calls AS (
  SELECT request_id, sequence, stage AS operation, k * 10 AS prompt_tokens,
    round(duration_ms)::BIGINT AS completion_tokens, k * 10 + round(duration_ms)::BIGINT AS total_tokens,
    CASE WHEN stage = 'llm.answer' THEN 200 END AS token_budget, NULL::BIGINT AS input_budget,
    status = 'failed' AS fallback_used, duration_ms > 100 AS truncated, duration_ms FROM tl)"""


# --- retrieval ----------------------------------------------------------------------------

def corpus(t: Tables) -> DataFrame:
    return t.documents.select(F.col("doc_id").alias("chunk_id"), "text", "lang", "source")


def questions(t: Tables) -> DataFrame:
    return t.benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


# BM25 scores of every benchmark passage against every document, and the top 20
QSRC = "qsrc AS (SELECT item_id AS query_id, text FROM benchmark)"
BM25_ON_QSRC = rf"""tok AS (SELECT doc_id, unnest({sql_tokens('text')}) AS term FROM documents),
post AS (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY ALL),
dl AS (SELECT doc_id, sum(tf)::BIGINT AS dl FROM post GROUP BY doc_id),
stats AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT sum(tf) FROM post)::DOUBLE
          / (SELECT count(*) FROM documents) AS avgdl),
raw AS (SELECT term, count(*) AS df, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS idf
        FROM post, stats GROUP BY term, n),
idf AS (SELECT term, df, CASE WHEN idf < 0 THEN 0.25 * (SELECT avg(idf) FROM raw) ELSE idf END AS idf FROM raw),
qt AS (SELECT query_id, term, count(*) AS qtf FROM (
       SELECT query_id, unnest({sql_tokens('text')}) AS term FROM qsrc) GROUP BY ALL),
scored AS (SELECT query_id, doc_id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
  FROM qt JOIN idf USING (term) JOIN post USING (term) JOIN dl USING (doc_id), stats GROUP BY ALL),
bm25 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank
  FROM scored WHERE score > 0) WHERE rank <= 20)"""

# term-hash vectors of documents and questions, cosine top 20
DENSE = rf"""hv AS (SELECT doc_id, CAST('0x' || md5(term)[1:8] AS BIGINT) % 64 AS slot, sum(tf)::BIGINT AS w FROM post GROUP BY ALL),
hq AS (SELECT query_id, CAST('0x' || md5(term)[1:8] AS BIGINT) % 64 AS slot, sum(qtf)::BIGINT AS w FROM qt GROUP BY ALL),
nv AS (SELECT doc_id, sqrt(sum(w * w)::DOUBLE) AS n FROM hv GROUP BY doc_id),
nq AS (SELECT query_id, sqrt(sum(w * w)::DOUBLE) AS n FROM hq GROUP BY query_id),
cosine AS (SELECT query_id, doc_id, round(sum(hv.w * hq.w)::DOUBLE / (any_value(nq.n) * any_value(nv.n)), 6) AS score
  FROM hq JOIN hv USING (slot) JOIN nv USING (doc_id) JOIN nq USING (query_id) GROUP BY query_id, doc_id),
dense AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank
  FROM cosine) WHERE rank <= 20)"""

BM25 = QSRC + ",\n" + BM25_ON_QSRC
LEGS_ON_QSRC = (BM25_ON_QSRC + ",\n" + DENSE + ",\nlegs AS (SELECT query_id, doc_id, score, rank, 'bm25' AS leg FROM bm25 "
        "UNION ALL SELECT query_id, doc_id, score, rank, 'embedding' FROM dense)")
LEGS = QSRC + ",\n" + LEGS_ON_QSRC


def kept_index(t: Tables, mode: str = "search") -> LexicalStore:
    """The lexical index of the documents, kept for the application.

    It is built when first asked for and opened afterwards, as long as the files of the table are the same; it lies in the
    shared folder, so a search reads segments and tokenizes nothing but its questions.
    """
    files = t.spark.read.parquet(f"{t.dir}/documents.parquet").select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time")
    state = files.distinct().agg(F.bit_xor(F.xxhash64("file_path", "file_size", "file_modification_time"))).first()[0]
    kept = t.spark.sparkContext.__dict__.setdefault("_folioframe_indexes", {})
    key = (t.dir, mode, state)
    if key not in kept:
        path = shared_dir(t.spark, f"lexical-{mode}")
        store = LexicalStore.create(t.spark, path, mode, t.documents.schema["doc_id"].dataType, buckets=t.spark.sparkContext.defaultParallelism)
        store.upsert(corpus(t))
        kept[key] = path
    return LexicalStore.open(t.spark, kept[key])


def bm25_leg(t: Tables, k: int = 20, q=None) -> DataFrame:
    return kept_index(t).search(questions(t) if q is None else q, k)


def hashed_vectors(t: Tables) -> DataFrame:
    return folded_term_vectors(kept_index(t).documents())


def question_vectors(t: Tables, q=None, mode: str = "search") -> DataFrame:
    q = questions(t) if q is None else q
    return hashed_term_vectors(build_postings(q, "query_id", "query", mode), "chunk_id").select(
        F.col("chunk_id").alias("query_id"), "embedding")


def dense_leg(t: Tables, k: int = 20, q=None) -> DataFrame:
    from ..operators.dense import dense_search
    return dense_search(hashed_vectors(t), question_vectors(t, q), k)


def both_legs(t: Tables, q=None) -> DataFrame:
    from ..operators.fusion import legs
    return legs(bm25=bm25_leg(t, q=q), embedding=dense_leg(t, q=q))


# labels: every document that contains the passage verbatim
def qrels(t: Tables) -> DataFrame:
    from ..plans.search import containing_documents
    return containing_documents(questions(t), t.documents.select("doc_id", "text")).withColumn("grade", F.lit(1.0))


QRELS = ("qrels AS (SELECT item_id AS query_id, doc_id, 1.0::DOUBLE AS grade FROM benchmark b "
         "JOIN documents d ON contains(d.text, b.text))")
