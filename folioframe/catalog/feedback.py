"""Registered feedback and research queries (FB)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import feedback as B
from .data import sql_squash, sql_strip
from .registry import query


# feedback: an order line comments on its order; the order is the run
def batch(t):
    rf = F.col("l_returnflag")
    return t.lineitem.select(
        F.col("l_orderkey").cast("string").alias("request_id"), (F.col("l_orderkey") % 50).alias("session_id"),
        F.when(rf == "R", "content_outdated").when(rf == "A", "citation_error").otherwise("praise").alias("category"),
        F.concat(F.lit("  note "), "l_linestatus", F.lit("\n x ")).alias("user_note"), (F.col("l_partkey") * 100000 + F.col("l_suppkey") * 100 + F.col("l_quantity").cast("int")).alias("pos"))


def existing(t):
    return t.orders.filter("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").cast("string").alias("request_id"), (F.col("o_orderkey") % 50).alias("session_id"))


def runs(t):
    return t.orders.select(F.col("o_orderkey").cast("string").alias("request_id"), (F.col("o_orderkey") % 50).alias("session_id"),
                           F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "success").otherwise("failed").alias("status"))


FEED = """b AS (SELECT l_orderkey AS rid, arg_min(l_returnflag, l_partkey * 100000 + l_suppkey * 100 + l_quantity::INT) AS rf, arg_min(l_linestatus, l_partkey * 100000 + l_suppkey * 100 + l_quantity::INT) AS ls FROM lineitem GROUP BY 1),
j AS (SELECT b.*, CASE WHEN rf NOT IN ('R', 'A') THEN 'CATEGORY_UNSUPPORTED' WHEN o_orderpriority = '1-URGENT' THEN 'REPEATED' WHEN o_orderkey IS NULL THEN 'NOT_FOUND'
  WHEN o_orderstatus NOT IN ('F', 'O') THEN 'RUN_NOT_COMPLETED' END AS reason FROM b LEFT JOIN orders ON o_orderkey = rid)"""


@query("fb1_create_feedback", f"WITH {FEED} SELECT rid::VARCHAR AS request_id, CASE rf WHEN 'R' THEN 'content_outdated' ELSE 'citation_error' END AS category, 'note ' || ls || ' x' AS user_note, 'reported' AS status FROM j WHERE reason IS NULL")
def fb1(t):
    return B.create_feedback(batch(t), existing(t), runs(t))["accepted"].drop("session_id")


@query("fb1_feedback_rejects", f"WITH {FEED} SELECT rid::VARCHAR AS request_id, reason FROM j WHERE reason <> 'REPEATED'")
def fb1r(t):
    return B.create_feedback(batch(t), existing(t), runs(t))["rejects"]


def cited(t):
    return B.cited_pages(t.lineitem.select(F.col("l_orderkey").alias("request_id"), F.col("l_suppkey").alias("page_id"),
                                           (F.col("l_linenumber") * 1000 + F.col("l_suppkey")).alias("pos")))


CITED = """c AS (SELECT l_orderkey AS request_id, l_suppkey AS page_id, min(l_linenumber * 1000 + l_suppkey) AS p FROM lineitem GROUP BY 1, 2),
ct AS (SELECT request_id, page_id, row_number() OVER (PARTITION BY request_id ORDER BY p) AS position FROM c)"""


@query("fb2_cited_pages", f"WITH {CITED} SELECT * FROM ct")
def fb2(t):
    return cited(t)


@query("fb3_auto_target", f"""WITH {CITED}, n AS (SELECT request_id, count(*) AS n, min(page_id) AS one FROM ct GROUP BY 1),
f AS (SELECT o_orderkey AS request_id, CASE WHEN o_orderstatus = 'F' THEN o_custkey % 10 + 1 END AS tp, o_orderpriority < '3' AS outdated FROM orders)
SELECT f.request_id, CASE WHEN tp IS NOT NULL AND ct.page_id IS NULL THEN 'TARGET_NOT_CITED' END AS target_error, CASE WHEN tp IS NOT NULL THEN ct.page_id WHEN outdated AND n = 1 THEN one END AS target
FROM f LEFT JOIN n USING (request_id) LEFT JOIN ct ON ct.request_id = f.request_id AND ct.page_id = tp""")
def fb3(t):
    f = t.orders.select(F.col("o_orderkey").alias("request_id"), F.when(F.col("o_orderstatus") == "F", F.col("o_custkey") % 10 + 1).alias("target_page_id"),
                        F.when(F.col("o_orderpriority") < "3", "content_outdated").otherwise("citation_error").alias("category"))
    return B.auto_target(f, cited(t)).select("request_id", "target_error", "target")


@query("fb4_retrieval_snapshot", """SELECT event_id AS request_id, CASE WHEN event_type = 'view' THEN '[{"page_id":"p1"}]' ELSE '[]' END AS sources, CASE WHEN event_type = 'view' THEN '{"n":3}' ELSE props END AS retrieval_stats,
  CASE WHEN event_type = 'view' THEN round(value, 4) END AS evidence_score, CASE WHEN event_type = 'view' THEN 1 ELSE 0 END AS evidence_source_count FROM events""")
def fb4(t):
    resp = F.concat(F.lit('{"sources":[{"page_id":"p1"}],"retrieval_stats":{"n":3},"evidence_source_count":1,"evidence_score":'), F.col("value").cast("string"), F.lit("}"))
    rows = t.events.select(F.col("event_id").alias("request_id"), F.when(F.col("event_type") == "view", resp).alias("response"), F.col("props").alias("retrieval_stats"), F.lit(None).cast("string").alias("timeline"))
    return B.retrieval_snapshot(rows).select("request_id", "sources", "retrieval_stats", F.round("evidence_score", 4).alias("evidence_score"), "evidence_source_count")


@query("fb5_refresh_retest", """SELECT o_orderkey AS request_id, CASE WHEN o_orderpriority = '1-URGENT' THEN 'resolved' WHEN c_mktsegment = 'BUILDING' THEN 'resolved' WHEN c_mktsegment = 'MACHINERY' THEN 'retest_failed' ELSE 'retesting' END AS status,
  CASE WHEN o_orderpriority <> '1-URGENT' AND c_mktsegment = 'BUILDING' THEN c_name END AS retest_answer, CASE WHEN o_orderpriority <> '1-URGENT' AND c_mktsegment = 'MACHINERY' THEN '原问题自动复测失败' END AS error
FROM orders LEFT JOIN customer ON c_custkey = o_custkey""")
def fb5(t):
    f = t.orders.select(F.col("o_orderkey").alias("request_id"), F.col("o_custkey").alias("retest_request_id"),
                        F.when(F.col("o_orderpriority") == "1-URGENT", "resolved").otherwise("retesting").alias("status"))
    seg = F.col("c_mktsegment")
    r = t.customer.select(F.col("c_custkey").alias("request_id"), F.when(seg == "BUILDING", "completed").when(seg == "MACHINERY", "timed_out").otherwise("running").alias("status"),
                          F.col("c_name").alias("response"), F.lit(None).cast("string").alias("error"))
    return B.refresh_retest(f, r).drop("retest_request_id")


@query("fb6_before_after", "SELECT l_orderkey AS request_id, l_discount AS before_score, l_tax AS after_score, round(l_tax - l_discount, 6) AS delta_score FROM lineitem")
def fb6(t):
    rows = t.lineitem.select(F.col("l_orderkey").alias("request_id"), F.lit("c").alias("category"), F.lit("s").alias("status"),
                             F.col("l_discount").alias("before_score"), F.col("l_tax").alias("after_score"))
    return B.before_after(rows, ("score",)).select("request_id", "before_score", "after_score", F.round("delta_score", 6).alias("delta_score"))


@query("fb7_latest_index_task", """WITH p AS (SELECT c_custkey AS page_id, CASE WHEN c_nationkey < 12 THEN 1 + c_nationkey % 5 END AS revision FROM customer),
t AS (SELECT o_custkey AS page_id, o_orderpriority[1]::BIGINT AS revision, o_orderkey AS task_id, o_orderstatus AS status, o_orderdate AS c FROM orders)
SELECT p.page_id, p.revision::BIGINT AS revision, arg_max(task_id, (c, task_id)) AS task_id, coalesce(arg_max(status, (c, task_id)), 'failed') AS status FROM p LEFT JOIN t ON t.page_id = p.page_id AND (p.revision IS NULL OR t.revision = p.revision) GROUP BY 1, 2""")
def fb7(t):
    pages = t.customer.select(F.col("c_custkey").alias("page_id"), F.when(F.col("c_nationkey") < 12, 1 + F.col("c_nationkey") % 5).cast("long").alias("revision"))
    tasks = t.orders.select(F.col("o_custkey").alias("page_id"), F.substring("o_orderpriority", 1, 1).cast("long").alias("revision"), F.col("o_orderkey").alias("task_id"),
                            F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("created_at"))
    return B.latest_index_task(pages, tasks)


@query("fb8_feedback_counts", """SELECT CASE l_returnflag WHEN 'R' THEN '内容过期' WHEN 'A' THEN '引用错误' ELSE 'praise' END AS category_label, l_linestatus AS status, count(*) AS n FROM lineitem GROUP BY 1, 2""")
def fb8(t):
    rf = F.col("l_returnflag")
    return B.feedback_counts(t.lineitem.select(F.when(rf == "R", "content_outdated").when(rf == "A", "citation_error").otherwise("praise").alias("category"), F.col("l_linestatus").alias("status")))


# search payloads in three shapes built from the pages
def payloads(t):
    item = F.struct(F.col("url").alias("link"), F.concat(F.lit(" T"), F.col("page_id").cast("string")).alias("name"), F.lit("s").alias("summary"))
    bare = F.struct(F.lit("no url").alias("title"))
    shape = F.col("page_id") % 3
    return t.pages.select("page_id", "url", F.when(shape == 0, F.to_json(F.struct(F.array(item).alias("items")))).when(
        shape == 1, F.concat(F.lit("["), F.to_json(item), F.lit(","), F.to_json(bare), F.lit("]"))).otherwise(F.to_json(item)).alias("payload"))


@query("fb9_search_items", "SELECT page_id, url, 'T' || page_id AS title, 's' AS snippet FROM pages")
def fb9(t):
    return payloads(t).select("page_id", F.inline(B.search_items("payload")))


@query("fb10_fetch_content", f"SELECT page_id, md5(CASE page_id % 3 WHEN 0 THEN {sql_strip('html')} WHEN 1 THEN {sql_strip('html')} ELSE 'a' || chr(10) || url END) AS content FROM pages")
def fb10(t):
    shape = F.col("page_id") % 3
    text = F.struct(F.lit(" ").alias("content"), F.col("html").alias("text"))
    payload = F.when(shape == 0, F.to_json(text)).when(shape == 1, F.to_json(F.struct(F.struct(text.alias("page")).alias("data")))).otherwise(
        F.concat(F.lit('[{"body":"a"},{"x":1},'), F.to_json(F.struct(F.col("url").alias("markdown"))), F.lit("]")))
    return t.pages.select("page_id", F.md5(B.fetch_content(payload)).alias("content"))


# research: every page is found by the run of its tens digit, in three queries
def found(t):
    pid = F.col("page_id")
    return t.pages.select(F.floor(pid / 10).alias("run_id"), (pid % 3).alias("query_no"), pid.alias("pos"),
                          F.when(pid % 7 == 0, F.lit("http://192.168.0.1/x")).otherwise(F.regexp_replace("url", r"[?#].*", "")).alias("url"))


@query("fb11_collect_candidates", r"""WITH f AS (SELECT page_id // 10 AS run_id, page_id % 3 AS query_no, page_id AS pos, regexp_replace(url, '[?#].*', '') AS url FROM pages WHERE page_id % 7 <> 0 AND page_id % 3 < 2),
u AS (SELECT run_id, CASE WHEN regexp_matches(url, '^https?://[^/]+$') THEN url || '/' ELSE url END AS url, arg_min(pos, query_no * 1000000 + pos) AS pos, min(query_no * 1000000 + pos) AS o FROM f GROUP BY 1, 2)
SELECT run_id, url, pos, rank FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY o) AS rank FROM u) WHERE rank <= 5""")
def fb11(t):
    return B.collect_candidates(found(t)).select("run_id", "url", "pos", "rank")


@query("fb12_normalize_sources")
def fb12(t):
    pid = F.col("page_id")
    raw = t.pages.select(F.floor(pid / 10).alias("run_id"), pid.alias("pos"), "url", F.lit("").alias("title"), F.lit("").alias("snippet"),
                         F.regexp_replace("html", r"<[^>]*>", " ").alias("content"))
    return B.normalize_sources(raw)


@query("fb13_clean_queries", f"""WITH w AS (SELECT doc_id, text, list_distinct([{sql_squash('x')}[1:300] for x in string_split(text, '.') if {sql_squash('x')} <> '']) AS q,
  [{sql_squash('x')}[1:300] for x in string_split(text, '.') if {sql_squash('x')} <> ''] AS l FROM documents)
SELECT doc_id, md5(CASE WHEN len(l) = 0 THEN text[1:300] ELSE l[1] END) AS first, least(greatest(len(q), 1), 2)::BIGINT AS n FROM w""")
def fb13(t):
    q = B.clean_queries(F.split("text", r"\."), F.col("text"))
    return t.documents.select("doc_id", q.alias("q")).select("doc_id", F.md5(F.col("q")[0]).alias("first"), F.size("q").alias("n"))


@query("fb14_research_runs", "SELECT s_suppkey AS run_id, s_nationkey::BIGINT AS nation, l_partkey AS source_id, created_at FROM supplier LEFT JOIN (SELECT DISTINCT l_suppkey, l_partkey, l_shipdate AS created_at FROM lineitem) ON l_suppkey = s_suppkey")
def fb14(t):
    sources = t.lineitem.select(F.col("l_suppkey").alias("run_id"), F.col("l_partkey").alias("source_id"), F.col("l_shipdate").alias("created_at")).distinct()
    return B.research_runs(t.supplier.select(F.col("s_suppkey").alias("run_id"), F.col("s_nationkey").alias("nation")), sources)
