"""Versioned wiki pages as tables: writes, history, links, look-ups, freshness.

A write returns the rows to append and the rows it refused; nothing is changed in place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.common import casefold, strip
from ..functions.markdown import clean_link_label, file_stem, validate_content, validate_title
from ..functions.text import normalize_strings, search_snippet
from .select import SHALLOW_ROWS
from .skew import ordinal, page_by_range

PAGE_COLUMNS = ["page_id", "title", "notebook", "tags", "aliases", "status", "source_type", "source_uri",
                "revision", "content", "content_hash", "updated_at"]
# What a link looks like, and which source types make a note or a document.
WIKI_LINK = r"\[\[([^\]|#]+)(?:#[^\]|]+)?(?:\|[^\]]+)?\]\]"
STRINGS = "array<string>"


def _strings(c) -> Column:
    return F.coalesce(F.col(c), F.array().cast(STRINGS))


def latest_by_source(pages: DataFrame) -> DataFrame:
    """The newest non-deleted page of each (source_type, source_uri); an aggregate, so a source
    holding a third of all pages is reduced before the shuffle."""
    return pages.filter("status <> 'deleted'").groupBy("source_type", "source_uri").agg(
        F.max_by(F.struct("page_id", "revision", "content_hash"), F.struct("updated_at", "page_id")).alias("cur"))


def upsert_by_source(pages: DataFrame, batch: DataFrame) -> DataFrame:
    """batch (source_type, source_uri, title, content) -> action per row: created at revision 1,
    deduplicated when the content hash is the same, else updated to the next revision."""
    incoming = batch.withColumn("content_hash", F.sha2(F.col("content"), 256))
    joined = incoming.join(latest_by_source(pages), ["source_type", "source_uri"], "left")
    action = (F.when(F.col("cur").isNull(), "created")
              .when(F.col("cur.content_hash") == F.col("content_hash"), "deduplicated").otherwise("updated"))
    return joined.withColumn("action", action).select(
        *[c for c in batch.columns], "content_hash", F.col("cur.page_id").alias("page_id"), "action",
        F.when(F.col("action") == "created", 1).when(F.col("action") == "deduplicated", F.col("cur.revision"))
        .otherwise(F.col("cur.revision") + 1).alias("revision"))


def create_pages(pages: DataFrame, batch: DataFrame, now: Column) -> dict:
    """batch (page_id, title, notebook, tags, aliases, source_type, source_uri, content)."""
    checked = batch.withColumn("_t", validate_title("title")).withColumn("_c", validate_content("content"))
    taken = checked.join(pages.select("page_id").distinct(), "page_id", "left_semi")
    bad = F.coalesce(F.col("_t.error_code"), F.col("_c.error_code"))
    fresh = checked.join(pages.select("page_id").distinct(), "page_id", "left_anti")
    title = F.col("_t.value")
    rows = fresh.filter(bad.isNull()).select(
        "page_id", title.alias("title"), "notebook", normalize_strings("tags").alias("tags"),
        normalize_strings("aliases", F.array(title)).alias("aliases"), F.lit("active").alias("status"),
        "source_type", "source_uri", F.lit(1).alias("revision"), F.col("_c.value").alias("content"),
        F.sha2(F.col("_c.value"), 256).alias("content_hash"), now.alias("updated_at"))
    rejects = taken.select("page_id", F.lit("CONFLICT").alias("reason")).unionByName(
        fresh.filter(bad.isNotNull()).select("page_id", bad.alias("reason")))
    return {"pages": rows, "revisions": revision_rows(rows, F.lit("create")), "rejects": rejects,
            "tasks": index_tasks(rows, "upsert")}


def revision_rows(pages: DataFrame, summary: Column) -> DataFrame:
    return pages.select("page_id", "revision", "title", "content", "tags", "aliases", "notebook",
                        "source_type", "source_uri", summary.alias("change_summary"),
                        F.col("updated_at").alias("created_at"))


def index_tasks(pages: DataFrame, action: str) -> DataFrame:
    return pages.select("page_id", "revision", F.lit(action).alias("action"), F.lit("pending").alias("status"))


def _expected(pages: DataFrame, edits: DataFrame, include_deleted: bool = False) -> DataFrame:
    """Current rows next to the edits, with the reason an edit is refused."""
    cur = pages.select("page_id", F.struct(*[F.col(c) for c in PAGE_COLUMNS]).alias("cur"))
    joined = edits.join(cur, "page_id", "left")
    gone = F.col("cur").isNull() if include_deleted else (
        F.col("cur").isNull() | (F.col("cur.status") == "deleted"))
    return joined.withColumn("reason", F.when(gone, "NOT_FOUND").when(
        F.col("cur.revision") != F.col("expected_revision"), "CONFLICT"))


def _result(judged: DataFrame, rows: DataFrame, summary: Column, action: str = "upsert") -> dict:
    return {"pages": rows.select(*PAGE_COLUMNS), "revisions": revision_rows(rows, summary),
            "tasks": index_tasks(rows, action),
            "rejects": judged.filter("reason IS NOT NULL").select("page_id", "reason")}


def update_pages(pages: DataFrame, edits: DataFrame, now: Column, summary: Column | None = None) -> dict:
    """edits (page_id, expected_revision, title, content, notebook, tags, aliases); NULL keeps a field.

    A changed title leaves the old one behind as an alias, provided that one was clean.
    """
    judged = _expected(pages, edits).withColumn("_t", validate_title(F.coalesce("title", "cur.title")))
    judged = judged.withColumn("reason", F.coalesce("reason", "_t.error_code"))
    old, new = F.col("cur.title"), F.col("_t.value")
    keep_old = (old != new) & (clean_link_label(old) == old)
    aliases = F.concat(F.coalesce("aliases", "cur.aliases", F.array().cast(STRINGS)),
                       F.when(keep_old, F.array(old)).otherwise(F.array().cast(STRINGS)))
    body = F.coalesce(validate_content("content")["value"], F.col("cur.content"))
    rows = judged.filter("reason IS NULL").select(
        "page_id", new.alias("title"), F.coalesce("notebook", "cur.notebook").alias("notebook"),
        normalize_strings(F.coalesce("tags", "cur.tags")).alias("tags"),
        normalize_strings(aliases, F.array(new)).alias("aliases"), F.col("cur.status").alias("status"),
        F.col("cur.source_type").alias("source_type"), F.col("cur.source_uri").alias("source_uri"),
        (F.col("cur.revision") + 1).alias("revision"), body.alias("content"),
        F.sha2(body, 256).alias("content_hash"), now.alias("updated_at"))
    return _result(judged, rows, F.lit("update") if summary is None else summary)


def rename_pages(pages: DataFrame, renames: DataFrame, now: Column) -> dict:
    """renames (page_id, expected_revision, title)."""
    nothing = {c: F.lit(None).cast(STRINGS if c in ("tags", "aliases") else "string")
               for c in ("content", "notebook", "tags", "aliases")}
    return update_pages(pages, renames.withColumns(nothing), now,
                        F.concat(F.lit("重命名页面为 "), F.col("title")))


def delete_pages(pages: DataFrame, edits: DataFrame, now: Column) -> dict:
    """Soft delete: next revision, status deleted, snapshot kept, index rows to be removed."""
    judged = _expected(pages, edits)
    rows = judged.filter("reason IS NULL").select("cur.*").withColumns(
        {"revision": F.col("revision") + 1, "status": F.lit("deleted"), "updated_at": now})
    return _result(judged, rows, F.lit("删除页面"), "delete")


def rollback_pages(pages: DataFrame, revisions: DataFrame, edits: DataFrame, now: Column) -> dict:
    """edits (page_id, expected_revision, target_revision): the target snapshot becomes a new
    revision; deleted pages come back."""
    judged = _expected(pages, edits, include_deleted=True)
    snap = revisions.select("page_id", F.col("revision").alias("target_revision"),
                            F.struct("title", "content", "tags", "aliases", "notebook", "source_type",
                                     "source_uri").alias("snap"))
    judged = judged.join(snap, ["page_id", "target_revision"], "left").withColumn(
        "reason", F.coalesce("reason", F.when(F.col("snap").isNull(), "REVISION_NOT_FOUND")))
    rows = judged.filter("reason IS NULL").select(
        "page_id", validate_title("snap.title")["value"].alias("title"), F.col("snap.notebook").alias("notebook"),
        normalize_strings("snap.tags").alias("tags"), normalize_strings("snap.aliases").alias("aliases"),
        F.lit("active").alias("status"), F.coalesce("snap.source_type", "cur.source_type").alias("source_type"),
        F.col("snap.source_uri").alias("source_uri"), (F.col("cur.revision") + 1).alias("revision"),
        F.col("snap.content").alias("content"), F.sha2("snap.content", 256).alias("content_hash"),
        now.alias("updated_at"), "target_revision")
    return _result(judged, rows, F.concat(F.lit("回滚到版本 "), F.col("target_revision").cast("string")))


def apply_write(pages: DataFrame, written: DataFrame) -> DataFrame:
    """Snapshot after a write: written rows replace those with the same id."""
    return pages.select(*PAGE_COLUMNS).join(written.select("page_id"), "page_id", "left_anti").select(
        *PAGE_COLUMNS).unionByName(written.select(*PAGE_COLUMNS))


# --- history ------------------------------------------------------------------------------

def list_revisions(revisions: DataFrame, page_ids: DataFrame | None = None) -> DataFrame:
    """History without bodies and its order, newest first."""
    rows = revisions if page_ids is None else revisions.join(page_ids, "page_id", "left_semi")
    back = rows.drop("content").withColumn("_back", -F.col("revision"))
    return ordinal(back, ["page_id"], "_back", "position").drop("_back")


def get_revisions(revisions: DataFrame, wanted: DataFrame) -> DataFrame:
    """Exact snapshots of wanted (page_id, revision)."""
    return revisions.join(wanted, ["page_id", "revision"], "left_semi")


def latest_snapshot(revisions: DataFrame) -> DataFrame:
    """Current state: the highest revision of each page, reduced before the shuffle."""
    rest = [c for c in revisions.columns if c != "page_id"]
    return revisions.groupBy("page_id").agg(F.max_by(F.struct(*rest), "revision").alias("s")).select(
        "page_id", "s.*")


def identity_violations(files: DataFrame, pages: DataFrame) -> DataFrame:
    """Stored file headers (page_id, meta_id, meta_revision) that disagree with their page row."""
    joined = files.join(pages.select("page_id", "revision"), "page_id")
    problem = F.when(F.col("meta_id") != F.col("page_id"), "id").when(
        F.coalesce(F.col("meta_revision"), F.lit(0)) != F.col("revision"), "revision")
    return joined.select("page_id", problem.alias("problem")).filter("problem IS NOT NULL")


def revision_pairs(revisions: DataFrame) -> DataFrame:
    """Each revision next to the one before it."""
    old = revisions.select("page_id", (F.col("revision") + 1).alias("revision"), F.col("content").alias("old"))
    return revisions.select("page_id", "revision", F.col("content").alias("new")).join(old, ["page_id", "revision"])


def diff_counts(pairs: DataFrame) -> DataFrame:
    """Distinct lines added and removed per pair."""
    old, new = F.split("old", "\n"), F.split("new", "\n")
    return pairs.select("page_id", "revision", F.size(F.array_except(new, old)).alias("added"),
                        F.size(F.array_except(old, new)).alias("removed"))


# --- look-ups -----------------------------------------------------------------------------

def page_names(pages: DataFrame) -> DataFrame:
    """(name, page_id): folded titles and aliases of pages that are not deleted."""
    return pages.filter("status <> 'deleted'").select(
        "page_id", F.explode(F.array_distinct(F.transform(
            F.concat(F.array("title"), _strings("aliases")), casefold))).alias("name"))


def name_dictionary(pages: DataFrame) -> DataFrame:
    """(name, n_pages, page_id): how many pages answer to a name and one of them."""
    return page_names(pages).groupBy("name").agg(F.count("*").alias("n_pages"), F.min("page_id").alias("page_id"))


def find_page(pages: DataFrame, refs: DataFrame) -> DataFrame:
    """refs (ref) -> (ref, outcome, page_id): by id first, else by folded title or alias."""
    r = refs.select("ref").distinct().withColumn("stem", file_stem(strip("ref")))
    ids = pages.filter("status <> 'deleted'").select(F.col("page_id").alias("stem"), F.lit(True).alias("_by_id"))
    names = name_dictionary(pages).withColumnRenamed("page_id", "_named")
    joined = r.join(ids, "stem", "left").withColumn("name", casefold("stem")).join(names, "name", "left")
    outcome = (F.when(F.coalesce(strip("ref"), F.lit("")) == "", "invalid").when(F.col("_by_id"), "found")
               .when(F.col("n_pages").isNull(), "not_found").when(F.col("n_pages") > 1, "ambiguous").otherwise("found"))
    return joined.select("ref", outcome.alias("outcome"), F.when(F.col("_by_id"), F.col("stem")).when(
        F.col("n_pages") == 1, F.col("_named")).alias("page_id"))


def match_pages(pages: DataFrame, notebook: str | None = None, tag: str | None = None, query: str | None = None,
                source_type: str | None = None, include_deleted: bool = False) -> DataFrame:
    """Pages passing the filters; ``match_snippet`` only where the body matched."""
    rows = pages if include_deleted else pages.filter("status <> 'deleted'")
    if notebook:
        rows = rows.filter(F.col("notebook") == notebook)
    if source_type:
        rows = rows.filter(F.col("source_type") == source_type)
    if tag:
        rows = rows.filter(F.array_contains("tags", tag))
    wanted = (query or "").strip()
    if not wanted:
        return rows.withColumn("match_snippet", F.lit(None).cast("string"))
    needle = casefold(F.lit(wanted))
    in_names = F.exists(F.concat(F.array("title"), _strings("aliases"), _strings("tags")),
                        lambda v: F.contains(casefold(v), needle))
    in_body = F.contains(casefold("content"), needle)
    return rows.filter(in_names | in_body).withColumn(
        "match_snippet", F.when(in_body, search_snippet("content", wanted, 56, "empty")))


def list_pages(pages: DataFrame, offset: int = 0, limit: int = 100, **filters) -> DataFrame:
    """One page of matches, newest first, with the total; a bounded top-n, or the ranges that hold a deep page."""
    rows, order = match_pages(pages, **filters), [F.col("updated_at").desc(), F.col("page_id")]
    total = rows.agg(F.count("*").alias("total"))
    head = rows.orderBy(*order).offset(offset).limit(limit) if offset + limit <= SHALLOW_ROWS else page_by_range(rows, order, offset, limit)
    return head.join(F.broadcast(total))       # one row


def list_notes(notes: DataFrame, date_from: str | None, date_to: str | None, limit: int = 20) -> DataFrame:
    """Notes whose ISO time text lies in the bounds, compared as text; a bare end date means its last second."""
    rows = notes
    if date_from:
        rows = rows.filter(F.col("updated_iso") >= date_from)
    if date_to:
        rows = rows.filter(F.col("updated_iso") <= date_to + "T23:59:59")
    return rows.orderBy(F.col("updated_iso").desc(), "page_id").limit(limit)


def list_by_kind(pages: DataFrame, kinds: list, offset: int, limit: int, with_size: bool = False) -> DataFrame:
    rows = pages.filter(F.col("source_type").isin(kinds) & (F.col("status") != "deleted"))
    head = rows.orderBy(F.col("updated_at").desc(), "page_id").offset(offset).limit(limit)
    out = head.withColumn("size", F.octet_length("content")) if with_size else head
    return out.join(F.broadcast(rows.agg(F.count("*").alias("total"))))       # one row


# --- links --------------------------------------------------------------------------------

def extract_links(pages: DataFrame) -> DataFrame:
    """(source_page_id, target_title), distinct trimmed titles per page."""
    titles = F.array_distinct(F.filter(F.transform(
        F.regexp_extract_all("content", F.lit(WIKI_LINK), 1), strip), lambda t: t != ""))
    return pages.filter("status <> 'deleted'").select(
        F.col("page_id").alias("source_page_id"), F.explode(titles).alias("target_title"))


def resolve_links(pages: DataFrame) -> DataFrame:
    """(source_page_id, target_title, target_page_id, n_matches): resolved when exactly one page has the
    name. The dictionary side has one row per name; a much-linked name makes its link side skewed,
    which the adaptive skew join splits (outer join, left side)."""
    links = extract_links(pages).withColumn("name", casefold("target_title"))
    return links.join(name_dictionary(pages), "name", "left").select(
        "source_page_id", "target_title", F.when(F.col("n_pages") == 1, F.col("page_id")).alias("target_page_id"),
        F.coalesce("n_pages", F.lit(0)).alias("n_matches"))


def page_links(links: DataFrame, pages: DataFrame) -> DataFrame:
    """Outgoing and incoming links per page as (page_id, direction, other_id, title, resolved)."""
    out = links.select(F.col("source_page_id").alias("page_id"), F.lit("outgoing").alias("direction"),
                       F.col("target_page_id").alias("other_id"), F.col("target_title").alias("title"),
                       F.col("target_page_id").isNotNull().alias("resolved"))
    live = pages.filter("status <> 'deleted'").select(F.col("page_id").alias("source_page_id"), "title")
    back = links.filter("target_page_id IS NOT NULL").join(live, "source_page_id").select(
        F.col("target_page_id").alias("page_id"), F.lit("backlink").alias("direction"),
        F.col("source_page_id").alias("other_id"), "title", F.lit(True).alias("resolved"))
    return out.unionByName(back)


def link_graph_stats(links: DataFrame) -> DataFrame:
    """Per page: links out, dangling, ambiguous, links in."""
    out = links.groupBy(F.col("source_page_id").alias("page_id")).agg(
        F.count("*").alias("out_degree"), F.count_if(F.col("n_matches") == 0).alias("dangling"),
        F.count_if(F.col("n_matches") > 1).alias("ambiguous"))
    into = links.filter("target_page_id IS NOT NULL").groupBy(F.col("target_page_id").alias("page_id")).agg(
        F.count("*").alias("in_degree"))
    return out.join(into, "page_id", "full_outer").na.fill(0)


def facets(pages: DataFrame) -> DataFrame:
    """Distinct notebooks and tags as (kind, value)."""
    live = pages.filter("status <> 'deleted'")
    books = live.select(F.lit("notebook").alias("kind"), F.col("notebook").alias("value"))
    tags = live.select(F.lit("tag").alias("kind"), F.explode("tags").alias("value"))
    return books.unionByName(tags).filter("value IS NOT NULL AND value <> ''").distinct()


# --- index tasks and sources ----------------------------------------------------------------

def task_counts(tasks: DataFrame, now: Column) -> DataFrame:
    """(status, tasks, due): due means pending or failed with no later attempt time."""
    due = F.col("status").isin("pending", "failed") & (
        F.col("next_attempt_at").isNull() | (F.col("next_attempt_at") <= now))
    return tasks.groupBy("status").agg(F.count("*").alias("tasks"), F.count_if(due).alias("due"))


def due_tasks(tasks: DataFrame, now: Column, limit: int = 5) -> DataFrame:
    due = F.col("status").isin("pending", "failed") & (
        F.col("next_attempt_at").isNull() | (F.col("next_attempt_at") <= now))
    return tasks.filter(due).orderBy("created_at", "task_id").limit(limit)


def stale_pages(pages: DataFrame, tasks: DataFrame) -> DataFrame:
    """Pages whose current revision has no completed upsert."""
    done = tasks.filter("status = 'completed' AND action = 'upsert'").select("page_id", "revision").distinct()
    return pages.filter("status <> 'deleted'").join(done, ["page_id", "revision"], "left_anti").select(
        "page_id", "revision")


def link_sources(existing: DataFrame, wanted: DataFrame, runs: DataFrame) -> dict:
    """wanted (page_id, source_id, run_id): pairs not yet there, and the runs marked saved."""
    pairs = ["page_id", "source_id"]
    fresh = wanted.select(*pairs).distinct().join(existing.select(*pairs), pairs, "left_anti")
    saved = runs.join(wanted.select("run_id").distinct(), "run_id", "left_semi").withColumn("status", F.lit("saved"))
    return {"page_sources": fresh, "runs": saved}
