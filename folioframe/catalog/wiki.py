"""Registered wiki queries (WK)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import wiki as W
from .data import (LINKED, REVISIONS, WIKI_PAGES, linked_pages, revisions, sql_squash, sql_strip, wiki_pages)
from .registry import query

def now_():
    return F.to_timestamp(F.lit("2024-06-01 00:00:00"))


def stored_pages(t):
    return wiki_pages(t).withColumn("content_hash", F.sha2("content", 256)).select(*W.PAGE_COLUMNS)


# a batch: every document under its source uri, the French ones edited, the Spanish ones under a new uri
def source_batch(t):
    return t.documents.join(t.labels, "doc_id", "left").select(
        F.when(F.col("quality") == 1, "note").when(F.col("quality") == 0, "document").otherwise("wiki").alias("source_type"),
        F.concat(F.when(F.col("lang") == "es", "new/").otherwise(""), F.concat_ws("/", "source", "n_chars")).alias("source_uri"),
        F.col("doc_id").alias("item"), F.lit("t").alias("title"),
        F.when(F.col("lang") == "fr", F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("content"))


@query("wk1_upsert_by_source", f"""WITH {WIKI_PAGES}, cur AS (SELECT source_type, source_uri, arg_max(page_id, (updated_at, page_id)) AS page_id,
  arg_max(sha256(content), (updated_at, page_id)) AS h FROM wiki WHERE status <> 'deleted' GROUP BY ALL),
b AS (SELECT doc_id AS item, CASE quality WHEN 1 THEN 'note' WHEN 0 THEN 'document' ELSE 'wiki' END AS source_type,
  CASE WHEN lang = 'es' THEN 'new/' ELSE '' END || source || '/' || n_chars AS source_uri, sha256(CASE WHEN lang = 'fr' THEN text || '!' ELSE text END) AS h FROM documents LEFT JOIN labels USING (doc_id))
SELECT item, page_id, CASE WHEN page_id IS NULL THEN 'created' WHEN cur.h = b.h THEN 'deduplicated' ELSE 'updated' END AS action,
  CASE WHEN page_id IS NULL OR cur.h = b.h THEN 1 ELSE 2 END::BIGINT AS revision FROM b LEFT JOIN cur USING (source_type, source_uri)""")
def wk1(t):
    return W.upsert_by_source(stored_pages(t), source_batch(t)).select("item", "page_id", "action", "revision")


@query("wk2_create_pages", r"""SELECT conv_id * 1000 + turn AS page_id, 'Talk ' || role AS title, 'talk' AS tags, sha256(regexp_replace(text, '\s+\z', '')) AS content_hash
FROM conversations WHERE conv_id * 1000 + turn NOT IN (SELECT doc_id FROM documents) AND turn <> 3""")
def wk2(t):
    have = stored_pages(t).withColumn("page_id", F.col("page_id").cast("long"))
    batch = t.conversations.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("page_id"),
        F.when(F.col("turn") == 3, "  ").otherwise(F.concat(F.lit("[Talk](x)  "), "role")).alias("title"), F.lit("n").alias("notebook"),
        F.array(F.lit("talk"), F.lit(" TALK ")).alias("tags"), F.array(F.concat(F.lit("talk "), "role")).alias("aliases"),
        F.lit("note").alias("source_type"), F.lit("u").alias("source_uri"), F.col("text").alias("content"))
    return W.create_pages(have, batch, now_())["pages"].select(
        "page_id", "title", F.array_join(F.concat("tags", "aliases"), ",").alias("tags"), "content_hash")


@query("wk2_create_rejects", """SELECT conv_id * 1000 + turn AS page_id, CASE WHEN conv_id * 1000 + turn IN (SELECT doc_id FROM documents) THEN 'CONFLICT' ELSE 'TITLE_EMPTY' END AS reason
FROM conversations WHERE conv_id * 1000 + turn IN (SELECT doc_id FROM documents) OR turn = 3""")
def wk2r(t):
    have = stored_pages(t).withColumn("page_id", F.col("page_id").cast("long"))
    batch = t.conversations.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("page_id"), F.when(F.col("turn") == 3, "  ").otherwise("T").alias("title"),
        F.lit("n").alias("notebook"), F.array().cast("array<string>").alias("tags"), F.array().cast("array<string>").alias("aliases"),
        F.lit("note").alias("source_type"), F.lit("u").alias("source_uri"), F.col("text").alias("content"))
    return W.create_pages(have, batch, now_())["rejects"]


# edits: the labelled documents; the toxic ones are deleted pages, those of bad quality expect a wrong revision
def edits(t):
    return t.labels.select(F.col("doc_id").cast("string").alias("page_id"), F.when(F.col("quality") == 0, 7).otherwise(1).alias("expected_revision"),
                           F.concat(F.lit("New "), F.col("doc_id").cast("string")).alias("title"))


REASON = "CASE WHEN toxic = 1 THEN 'NOT_FOUND' WHEN quality = 0 THEN 'CONFLICT' END"


@query("wk3_update_pages", f"""WITH {WIKI_PAGES} SELECT page_id, 'New ' || doc_id AS title, array_to_string(aliases, '|') || CASE WHEN lower(replace(title, 'ß', 'ss')) <> lower(replace(aliases[1], 'ß', 'ss')) AND {sql_squash('title')} = title
  AND title NOT LIKE '%](%' THEN '|' || title ELSE '' END AS aliases, 2::BIGINT AS revision, lang AS notebook FROM wiki JOIN (SELECT doc_id, lang FROM documents JOIN labels USING (doc_id) WHERE toxic = 0 AND quality = 1) d ON page_id = d.doc_id::VARCHAR""")
def wk3(t):
    e = edits(t).withColumns({c: F.lit(None).cast("string") for c in ("content", "notebook")}).withColumns(
        {c: F.lit(None).cast("array<string>") for c in ("tags", "aliases")})
    return W.update_pages(stored_pages(t), e, now_())["pages"].select("page_id", "title", F.array_join("aliases", "|").alias("aliases"), "revision", "notebook")


@query("wk3_update_rejects", f"SELECT doc_id::VARCHAR AS page_id, {REASON} AS reason FROM labels WHERE toxic = 1 OR quality = 0")
def wk3r(t):
    e = edits(t).withColumns({c: F.lit(None).cast("string") for c in ("content", "notebook")}).withColumns(
        {c: F.lit(None).cast("array<string>") for c in ("tags", "aliases")})
    return W.update_pages(stored_pages(t), e, now_())["rejects"]


@query("wk4_rename_pages", "SELECT doc_id::VARCHAR AS page_id, 2::BIGINT AS revision, 'New ' || doc_id AS title, '重命名页面为 New ' || doc_id AS change_summary, md5(text) AS content FROM labels JOIN documents USING (doc_id) WHERE toxic = 0 AND quality = 1")
def wk4(t):
    return W.rename_pages(stored_pages(t), edits(t), now_())["revisions"].select(
        "page_id", "revision", "title", "change_summary", F.md5("content").alias("content"))


@query("wk5_delete_pages", "SELECT doc_id::VARCHAR AS page_id, 'deleted' AS status, 2::BIGINT AS revision FROM labels WHERE toxic = 0 AND quality = 1")
def wk5(t):
    return W.delete_pages(stored_pages(t), edits(t), now_())["pages"].select("page_id", "status", "revision")


@query("wk5_snapshot_after_delete", "SELECT CASE WHEN toxic = 1 OR quality = 1 THEN 'deleted' ELSE 'active' END AS status, CASE WHEN toxic = 0 AND quality = 1 THEN 2 ELSE 1 END::BIGINT AS revision, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ALL")
def wk5s(t):
    pages = stored_pages(t)
    return W.apply_write(pages, W.delete_pages(pages, edits(t), now_())["pages"]).groupBy("status", "revision").agg(F.count("*").alias("n"))


@query("wk6_list_revisions", f"WITH {REVISIONS} SELECT page_id, revision, title, change_summary, row_number() OVER (PARTITION BY page_id ORDER BY revision DESC) AS position FROM revs")
def wk6(t):
    return W.list_revisions(revisions(t))


@query("wk6_get_revision", f"WITH {REVISIONS} SELECT page_id, revision, md5(content) AS content FROM revs WHERE revision = 2")
def wk6g(t):
    wanted = revisions(t).select("page_id").distinct().withColumn("revision", F.lit(2))
    return W.get_revisions(revisions(t), wanted).select("page_id", "revision", F.md5("content").alias("content"))


def conv_pages(t):
    cur = W.latest_snapshot(revisions(t))
    return cur.select("page_id", "title", F.lit("n").alias("notebook"), F.array(F.lit("a")).alias("tags"), F.array().cast("array<string>").alias("aliases"),
                      F.when(F.col("revision") > 5, "deleted").otherwise("active").alias("status"), F.lit("note").alias("source_type"),
                      F.lit("u").alias("source_uri"), "revision", "content", F.sha2("content", 256).alias("content_hash"), now_().alias("updated_at"))


@query("wk7_rollback", f"""WITH {REVISIONS}, m AS (SELECT page_id, max(revision) AS r FROM revs GROUP BY 1)
SELECT page_id, r + 1 AS revision, md5(content) AS content, 'active' AS status FROM m JOIN revs USING (page_id) WHERE revs.revision = 1 AND r <> 4""")
def wk7(t):
    full = revisions(t).withColumns({"tags": F.array(F.lit("a")), "aliases": F.array().cast("array<string>"), "notebook": F.lit("n"),
                                     "source_type": F.lit("note"), "source_uri": F.lit("u")})
    pages = conv_pages(t)
    e = pages.select("page_id", F.when(F.col("revision") == 4, 0).otherwise(F.col("revision")).alias("expected_revision"), F.lit(1).alias("target_revision"))
    return W.rollback_pages(pages, full, e, now_())["pages"].select("page_id", "revision", F.md5("content").alias("content"), "status")


@query("wk8_latest_snapshot", f"WITH {REVISIONS} SELECT page_id, max(revision) AS revision, md5(arg_max(content, revision)) AS content FROM revs GROUP BY 1")
def wk8(t):
    return W.latest_snapshot(revisions(t)).select("page_id", "revision", F.md5("content").alias("content"))


@query("wk8_identity_violations", """WITH m AS (SELECT conv_id, max(turn) + 1 AS r FROM conversations GROUP BY 1), f AS (SELECT m.*, CASE WHEN o_orderstatus = 'P' THEN -1 ELSE conv_id END AS mid,
  CASE WHEN o_orderstatus = 'O' THEN 1 ELSE r END AS mr FROM m JOIN orders ON o_orderkey = conv_id)
SELECT conv_id AS page_id, CASE WHEN mid <> conv_id THEN 'id' ELSE 'revision' END AS problem FROM f WHERE mid <> conv_id OR mr <> r""")
def wk8i(t):
    pages = W.latest_snapshot(revisions(t))
    st = F.col("o_orderstatus")
    files = pages.join(t.orders, F.col("page_id") == F.col("o_orderkey")).select(
        "page_id", F.when(st == "P", -1).otherwise(F.col("page_id")).alias("meta_id"), F.when(st == "O", 1).otherwise(F.col("revision")).alias("meta_revision"))
    return W.identity_violations(files, pages)


@query("wk9_diff_counts", f"""WITH {REVISIONS}, l AS (SELECT DISTINCT page_id, revision, unnest(string_split(content, chr(10))) AS line FROM revs)
SELECT r.page_id, r.revision, (SELECT count(*) FROM l a WHERE a.page_id = r.page_id AND a.revision = r.revision AND NOT EXISTS (SELECT 1 FROM l b WHERE b.page_id = r.page_id AND b.revision = r.revision - 1 AND b.line = a.line)) AS added,
  (SELECT count(*) FROM l a WHERE a.page_id = r.page_id AND a.revision = r.revision - 1 AND NOT EXISTS (SELECT 1 FROM l b WHERE b.page_id = r.page_id AND b.revision = r.revision AND b.line = a.line)) AS removed
FROM revs r WHERE revision > 1""")
def wk9c(t):
    return W.diff_counts(W.revision_pairs(revisions(t)))


FOLD = "lower(replace({0}, 'ß', 'ss'))"
NAMES = f"""nm AS (SELECT DISTINCT page_id, {FOLD.format('n')} AS name FROM (SELECT page_id, title AS n FROM wiki WHERE status <> 'deleted' UNION ALL SELECT page_id, aliases[1] FROM wiki WHERE status <> 'deleted')),
dict AS (SELECT name, count(*) AS n, min(page_id) AS page_id FROM nm GROUP BY 1)"""


@query("wk10_find_page", f"""WITH {WIKI_PAGES}, {NAMES}, r AS (SELECT DISTINCT regexp_extract(text, '^\\S+ \\S+') AS ref FROM documents UNION SELECT doc_id || '.md' FROM documents),
s AS (SELECT ref, regexp_replace({sql_strip('ref')}, '(.)\\.[^./]*$', '\\1') AS stem FROM (SELECT ref FROM r)),
q AS (SELECT ref, stem, EXISTS (SELECT 1 FROM wiki w WHERE w.page_id = stem AND status <> 'deleted') AS by_id, n, dict.page_id FROM s LEFT JOIN dict ON name = {FOLD.format('stem')})
SELECT ref, CASE WHEN {sql_strip('ref')} = '' THEN 'invalid' WHEN by_id THEN 'found' WHEN n IS NULL THEN 'not_found' WHEN n > 1 THEN 'ambiguous' ELSE 'found' END AS outcome,
  CASE WHEN by_id THEN stem WHEN n = 1 THEN page_id END AS page_id FROM q""")
def wk10(t):
    refs = t.documents.select(F.explode(F.array(F.regexp_extract("text", r"^\S+ \S+", 0), F.concat(F.col("doc_id").cast("string"), F.lit(".md")))).alias("ref"))
    return W.find_page(stored_pages(t), refs)


@query("wk11_list_pages", f"""WITH {WIKI_PAGES}, m AS (SELECT * FROM wiki WHERE status <> 'deleted' AND notebook = 'en' AND (contains(lower(content), 'ing') OR contains(lower(title), 'ing') OR contains(lower(aliases[1]), 'ing')))
SELECT page_id, title, (SELECT count(*) FROM m) AS total FROM m ORDER BY updated_at DESC, page_id LIMIT 20 OFFSET 10""")
def wk11(t):
    return W.list_pages(stored_pages(t), offset=10, limit=20, notebook="en", query="ING").select("page_id", "title", "total")


@query("wk11_match_pages", f"""WITH {WIKI_PAGES} SELECT page_id, contains({FOLD.format('content')}, 'eau') AS has_snippet FROM wiki WHERE list_contains(tags, 'src3')
  AND (contains({FOLD.format('content')}, 'eau') OR contains({FOLD.format('title')}, 'eau') OR contains({FOLD.format('aliases[1]')}, 'eau') OR list_contains([contains(x, 'eau') for x in tags], true))""")
def wk11m(t):
    return W.match_pages(stored_pages(t), tag="src3", query="eau", include_deleted=True).select("page_id", F.col("match_snippet").isNotNull().alias("has_snippet"))


@query("wk12_list_notes", f"""WITH {WIKI_PAGES} SELECT page_id, strftime(updated_at, '%Y-%m-%dT%H:%M:%S') AS updated_iso FROM wiki WHERE updated_at >= TIMESTAMP '2024-01-01' AND updated_at <= TIMESTAMP '2024-01-02 23:59:59'
ORDER BY updated_iso DESC, page_id LIMIT 20""")
def wk12(t):
    notes = wiki_pages(t).select("page_id", F.date_format("updated_at", "yyyy-MM-dd'T'HH:mm:ss").alias("updated_iso"))
    return W.list_notes(notes, "2024-01-01", "2024-01-02")


@query("wk13_list_by_kind", f"""WITH {WIKI_PAGES}, m AS (SELECT * FROM wiki WHERE status <> 'deleted' AND source_type IN ('document', 'wiki'))
SELECT page_id, octet_length(encode(content))::BIGINT AS size, (SELECT count(*) FROM m) AS total FROM m ORDER BY updated_at DESC, page_id LIMIT 15""")
def wk13(t):
    return W.list_by_kind(stored_pages(t), ["document", "wiki"], 0, 15, with_size=True).select("page_id", "size", "total")


LINKS = rf"""{WIKI_PAGES}, {LINKED}, lk AS (SELECT DISTINCT page_id AS source_page_id, {sql_strip('x')} AS target_title FROM (SELECT page_id,
  unnest(regexp_extract_all(content, '\[\[([^\]|#]+)(?:#[^\]|]+)?(?:\|[^\]]+)?\]\]', 1)) AS x FROM linked WHERE status <> 'deleted') WHERE {sql_strip('x')} <> ''), {NAMES},
rl AS (SELECT source_page_id, target_title, CASE WHEN n = 1 THEN page_id END AS target_page_id, coalesce(n, 0) AS n_matches FROM lk LEFT JOIN dict ON name = {FOLD.format('target_title')})"""


def with_hash(t):
    return linked_pages(t)


@query("wk14_extract_links", f"WITH {LINKS} SELECT * FROM lk")
def wk14(t):
    return W.extract_links(with_hash(t))


@query("wk15_resolve_links", f"WITH {LINKS} SELECT * FROM rl")
def wk15(t):
    return W.resolve_links(with_hash(t))


@query("wk16_page_links", f"""WITH {LINKS} SELECT source_page_id AS page_id, 'outgoing' AS direction, target_page_id AS other_id, target_title AS title, target_page_id IS NOT NULL AS resolved FROM rl
UNION ALL SELECT target_page_id, 'backlink', source_page_id, title, true FROM rl JOIN wiki ON page_id = source_page_id WHERE target_page_id IS NOT NULL AND status <> 'deleted'""")
def wk16(t):
    return W.page_links(W.resolve_links(with_hash(t)), with_hash(t))


@query("wk17_link_graph_stats", f"""WITH {LINKS}, o AS (SELECT source_page_id AS page_id, count(*) AS out_degree, count(*) FILTER (n_matches = 0) AS dangling, count(*) FILTER (n_matches > 1) AS ambiguous FROM rl GROUP BY 1),
i AS (SELECT target_page_id AS page_id, count(*) AS in_degree FROM rl WHERE target_page_id IS NOT NULL GROUP BY 1)
SELECT page_id, coalesce(out_degree, 0) AS out_degree, coalesce(dangling, 0) AS dangling, coalesce(ambiguous, 0) AS ambiguous, coalesce(in_degree, 0) AS in_degree FROM o FULL JOIN i USING (page_id)""")
def wk17(t):
    return W.link_graph_stats(W.resolve_links(with_hash(t)))


@query("wk18_facets", "SELECT DISTINCT 'notebook' AS kind, lang AS value FROM documents LEFT JOIN labels USING (doc_id) WHERE toxic IS DISTINCT FROM 1 UNION SELECT DISTINCT 'tag', unnest([lang, source]) FROM documents LEFT JOIN labels USING (doc_id) WHERE toxic IS DISTINCT FROM 1")
def wk18(t):
    return W.facets(stored_pages(t))


# index tasks: one per order, the status from the order, the attempt time from its date
def tasks(t):
    st = F.col("o_orderstatus")
    return t.orders.select(
        F.col("o_orderkey").alias("task_id"), F.col("o_custkey").cast("string").alias("page_id"), F.lit(1).alias("revision"), F.lit("upsert").alias("action"),
        F.when(st == "F", "completed").when(st == "P", "failed").otherwise("pending").alias("status"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderdate")).alias("next_attempt_at"), F.col("o_orderdate").alias("created_at"))


TASKS = """tk AS (SELECT o_orderkey AS task_id, o_custkey::VARCHAR AS page_id, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'P' THEN 'failed' ELSE 'pending' END AS status,
  CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderdate END AS nxt, o_orderdate AS created_at FROM orders)"""
def at_():
    return F.to_timestamp(F.lit("1995-06-01 00:00:00"))


@query("wk19_index_task_counts", f"WITH {TASKS} SELECT status, count(*) AS tasks, count(*) FILTER (status IN ('pending', 'failed') AND (nxt IS NULL OR nxt <= TIMESTAMP '1995-06-01')) AS due FROM tk GROUP BY 1")
def wk19(t):
    return W.task_counts(tasks(t), at_())


@query("wk19_due_tasks", f"WITH {TASKS} SELECT task_id, page_id, status FROM tk WHERE status IN ('pending', 'failed') AND (nxt IS NULL OR nxt <= TIMESTAMP '1995-06-01') ORDER BY created_at, task_id LIMIT 5")
def wk19d(t):
    return W.due_tasks(tasks(t), at_()).select("task_id", "page_id", "status")


@query("wk19_stale_pages", f"WITH {WIKI_PAGES}, {TASKS} SELECT page_id, revision::BIGINT AS revision FROM wiki WHERE status <> 'deleted' AND page_id NOT IN (SELECT page_id FROM tk WHERE status = 'completed')")
def wk19s(t):
    return W.stale_pages(stored_pages(t), tasks(t))


@query("wk20_link_sources", "SELECT DISTINCT l_orderkey AS page_id, l_suppkey AS source_id FROM lineitem WHERE l_returnflag <> 'R' AND (l_orderkey, l_suppkey) NOT IN (SELECT (l_orderkey, l_suppkey) FROM lineitem WHERE l_returnflag = 'R')")
def wk20(t):
    rows = t.lineitem.select(F.col("l_orderkey").alias("page_id"), F.col("l_suppkey").alias("source_id"), F.col("l_partkey").alias("run_id"), "l_returnflag")
    runs = t.part.select(F.col("p_partkey").alias("run_id"), F.lit("open").alias("status"))
    return W.link_sources(rows.filter("l_returnflag = 'R'"), rows.filter("l_returnflag <> 'R'"), runs)["page_sources"]


@query("wk20_saved_runs", "SELECT p_partkey AS run_id, 'saved' AS status FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag <> 'R')")
def wk20r(t):
    rows = t.lineitem.select(F.col("l_orderkey").alias("page_id"), F.col("l_suppkey").alias("source_id"), F.col("l_partkey").alias("run_id"), "l_returnflag")
    runs = t.part.select(F.col("p_partkey").alias("run_id"), F.lit("open").alias("status"))
    return W.link_sources(rows.filter("l_returnflag = 'R'"), rows.filter("l_returnflag <> 'R'"), runs)["runs"]
