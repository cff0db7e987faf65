"""Wiki, conversation, telemetry, feedback and transcript tables."""

import datetime as dt

from pyspark.sql import functions as F

from folioframe.operators import audio as A
from folioframe.operators import convo as C
from folioframe.operators import feedback as B
from folioframe.operators import index as I
from folioframe.operators import select as P
from folioframe.operators import telemetry as O
from folioframe.operators import wiki as W
from folioframe.sources import io as R

NOW = dt.datetime(2024, 1, 2)


def page(pid, title, content="c", rev=1, status="active", aliases=(), uri="u"):
    return (pid, title, "n", ["t"], list(aliases), status, "note", uri, rev, content, "", NOW)


SCHEMA = ("page_id string, title string, notebook string, tags array<string>, aliases array<string>, status string, source_type string, "
          "source_uri string, revision int, content string, content_hash string, updated_at timestamp")


def test_versions(spark):
    pages = spark.createDataFrame([page("1", "Alpha"), page("2", "Beta", status="deleted")], SCHEMA)
    ask = spark.createDataFrame([("1", 1, "Gamma"), ("2", 1, "X"), ("9", 1, "Y")], "page_id string, expected_revision int, title string")
    out = W.rename_pages(pages, ask, F.lit(NOW))
    row = out["pages"].first()
    assert (row.revision, row.title, row.aliases) == (2, "Gamma", ["Alpha"])
    assert {(r.page_id, r.reason) for r in out["rejects"].collect()} == {("2", "NOT_FOUND"), ("9", "NOT_FOUND")}
    stale = W.rename_pages(W.apply_write(pages, out["pages"]), ask.filter("page_id = '1'"), F.lit(NOW))
    assert [r.reason for r in stale["rejects"].collect()] == ["CONFLICT"] and stale["pages"].count() == 0
    gone = W.delete_pages(pages, ask.filter("page_id = '1'"), F.lit(NOW))["pages"]
    history = W.revision_rows(pages, F.lit("first"))
    back = W.rollback_pages(W.apply_write(pages, gone), history, spark.createDataFrame([("1", 2, 1)], "page_id string, expected_revision int, target_revision int"), F.lit(NOW))
    assert [(r.revision, r.status, r.title) for r in back["pages"].collect()] == [(3, "active", "Alpha")]


def test_links(spark):
    pages = spark.createDataFrame([page("1", "A", "[[b]] [[ B#x|y]] [[Nope]] [[dup]]"), page("2", "B", aliases=["Dup"]), page("3", "dup")], SCHEMA)
    got = {r.target_title: r.target_page_id for r in W.resolve_links(pages).collect()}
    assert got == {"b": "2", "B": "2", "Nope": None, "dup": None}
    assert {(r.ref, r.outcome) for r in W.find_page(pages, spark.createDataFrame([("DUP",), ("a.md",), ("zz",)], "ref string")).collect()} == {
        ("DUP", "ambiguous"), ("a.md", "found"), ("zz", "not_found")}


def test_page_file_round_trip(spark):
    pages = spark.createDataFrame([("u", 'T: "x"', 2, ["a", "b: c"], "body\n---\nmore \n")], "id string, title string, revision int, tags array<string>, content string")
    raw = pages.select(R.render_page({c: F.col(c) for c in ("id", "title", "revision", "tags")}, F.col("content")).alias("raw"))
    row = R.parse_front_matter(raw).first()
    assert row.error is None and row.body == "body\n---\nmore" and row.meta["title"] == 'T: "x"' and row.meta["revision"] == "2"
    bad = spark.createDataFrame([("no",), ("---\nid: 1\n",), ("---\n- a\n---\nx",), ("---\nid: 1\n---\nx",)], "raw string")
    assert [r.error for r in R.parse_front_matter(bad).collect()] == ["NO_HEADER", "HEADER_NOT_CLOSED", "HEADER_NOT_A_MAPPING", "HEADER_INCOMPLETE"]


def test_readers(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"id":" ","doc_id":"a","content":" t "}\n\n{"id":"b","text":"u","metadata":{"k":"v"}}\n')
    rows = R.read_corpus(spark, str(tmp_path / "c.jsonl")).collect()
    assert [(r.doc_id, r.text) for r in rows] == [("a", "t"), ("b", "u")] and rows[1].metadata == {"k": "v"}
    (tmp_path / "q.json").write_text('[{"id":"1","query":"q","relevance":{"a":2}},{"query_id":"2","query":"r","relevant_doc_ids":["b"],"category":"x"}]')
    q = R.read_queries(spark, str(tmp_path / "q.json"), array=True)
    assert {(r.query_id, r.doc_id, r.grade) for r in q["qrels"].collect()} == {("1", "a", 2.0), ("2", "b", 1.0)}
    assert {r.question_type for r in q["queries"].collect()} == {"default", "x"}
    (tmp_path / "d").mkdir()
    for name, text in (("a.md", "# T\nx"), ("b.txt", "  "), ("c.pdf", "no")):
        (tmp_path / "d" / name).write_text(text)
    assert {(r.filename, r.status) for r in R.read_markdown_dir(spark, str(tmp_path / "d")).collect()} == {("a.md", "ok"), ("b.txt", "skipped_empty")}


def test_upsert_is_idempotent(spark):
    cur = spark.createDataFrame([(1, "a"), (2, "b")], "chunk_id int, text string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "chunk_id int, text string")
    once = I.upsert_chunks(cur, new)
    assert {tuple(r) for r in once.collect()} == {(1, "a"), (2, "c"), (3, "d")} == {tuple(r) for r in I.upsert_chunks(once, new).collect()}


def test_history_starts_after_the_cursor(spark):
    m = spark.createDataFrame([(i, "s", "user", f"m{i}", NOW + dt.timedelta(minutes=i)) for i in range(1, 8)], "id long, session_id string, role string, content string, created_at timestamp")
    s = spark.createDataFrame([("s", "old", 3)], "session_id string, summary string, summary_message_id long")
    assert [r.content for r in C.history(m, s, 3).orderBy("position").collect()] == ["old", "m5", "m6", "m7"]


def test_context_never_exceeds_its_budget(spark):
    rows = [(b, seg, i, role, "word " * n) for b in range(0, 120, 7) for seg, i, role, n in
            [("system", 0, "system", 4), ("summary", 1, "system", 30), ("recent", 2, "user", 9), ("recent", 3, "assistant", 12), ("current", 4, "user", 8)]]
    msgs = spark.createDataFrame(rows, "request_id int, segment string, pos int, role string, content string")
    req = spark.createDataFrame([(b, 200 - b) for b in range(0, 120, 7)], "request_id int, output_reserve int")
    stats = C.assemble_context(req, msgs, window=200, history_budget=40, summary_budget=20)["stats"].collect()
    assert len(stats) == 18
    for r in stats:
        assert r.input_budget == r.request_id and r.used_tokens <= r.input_budget and r.summary_tokens <= 20 and r.recent_tokens <= 40
    roomy = max(stats, key=lambda r: r.request_id)
    assert roomy.current_tokens > 0 and roomy.system_tokens > 0


def test_budgets_and_steps(spark):
    calls = spark.createDataFrame([("r", "agent.query_rewrite", None, 10, 400)], "request_id string, operation string, token_budget int, prompt_tokens int, completion_tokens int").withColumns(
        {"input_budget": F.lit(None).cast("int"), "context_window_tokens": F.lit(None).cast("int")})
    row = O.normalized_calls(calls).first()
    assert (row.token_budget, row.token_remaining, row.input_budget, row.input_remaining) == (300, 0, 15700, 15690)
    p = spark.createDataFrame([(None,), (" ",), ('""',), ("[]",), ("{}",), ('{"results":[]}',), ('{"items":{"results":null}}',), ('{"a":1}',), ('"x"',)], "p string")
    assert [r.e for r in p.select(O.is_empty_payload("p").alias("e")).collect()] == [True] * 7 + [False] * 2


def test_sources_share_one_budget(spark):
    raw = spark.createDataFrame([("r", i, u, "", "", c) for i, (u, c) in enumerate([
        ("http://a.com", "x" * 6), ("http://a.com/", "y"), ("http://10.0.0.1", "z"), ("http://b.com", "x" * 6), ("http://c.com", "w" * 9), ("http://d.com", "late")])],
        "run_id string, pos int, url string, title string, snippet string, content string")
    rows = B.normalize_sources(raw, limit=5, max_chars=10).orderBy("position").collect()
    # the second copy is cut by the budget first, and a cut text counts as a new one
    assert [(r.url, r.content) for r in rows] == [("http://a.com/", "x" * 6), ("http://b.com/", "x" * 4)]


def test_transcripts_and_summary_text(spark):
    seg = spark.createDataFrame([(1, 0.0, 2.0, "a"), (1, 2.0, 4.0, "b"), (1, 5.0, 6.0, "c")], "audio_id int, start double, end double, text string")
    win = spark.createDataFrame([(1, 2.0, 4.5)], "audio_id int, w_start double, w_end double")
    assert sorted(r.text for r in A.transcript_range(seg, win).collect()) == ["a", "b"]
    rows = spark.createDataFrame([(1, 2, "b", .1), (1, 1, "a", .9), (2, 1, "z", .1)], "query_id int, rank int, content string, rerank_score double")
    assert {r.query_id: r.text for r in P.summary_text(P.filter_for_summary(rows)).collect()} == {1: "a", 2: "z"}


def test_first_slices_hold_the_first_rows(spark):
    """The cut in front of ranked selections keeps the first rows of every key and bounds what a hot key keeps."""
    from folioframe.operators.skew import first_slices
    rows = [("hot", 3 * i) for i in range(5000)] + [(f"k{i % 7}", i) for i in range(40)]
    df = spark.createDataFrame(rows, "k string, id long")
    got = {}
    for r in first_slices(df, ["k"], "id", 300, 64).collect():
        got.setdefault(r.k, []).append(r.id)
    for k in {k for k, _ in rows}:
        first = sorted(i for x, i in rows if x == k)[:300]
        assert sorted(got[k])[:len(first)] == first
        assert len(got[k]) <= 300 + 64


def test_small_summary_budget_takes_every_line_that_fits(spark):
    from folioframe.operators import convo
    messages = spark.createDataFrame([("s", i, "u", "x") for i in range(70)], "session_id string, id long, role string, content string")
    sessions = spark.createDataFrame([("s", None, None)], "session_id string, summary string, summary_message_id long")
    got = convo.summary_selection(messages, sessions, budget=10, keep=5)
    assert got.count() > 10


def test_emptied_page_loses_its_chunks(spark):
    from folioframe.operators.index import replace_page_chunks
    current = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "page_id long, chunk_id string")
    fresh = spark.createDataFrame([(2, "d")], "page_id long, chunk_id string")
    pages = spark.createDataFrame([(1,), (2,)], "page_id long")
    assert {tuple(r) for r in replace_page_chunks(current, fresh, pages).collect()} == {(2, "d")}


def test_short_passages_find_their_documents(spark):
    from folioframe.plans.search import containing_documents
    docs = spark.createDataFrame([(1, "C++ alpha. alpha beta gamma"), (2, "beta"), (3, "alphabet a ,"), (4, "")], "doc_id long, text string")
    asked = ["alpha beta", "C++ alpha.", "alpha beta gamma", "a", ",", "bet", "zz", ""]
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id long, query string")
    texts = {r.doc_id: r.text for r in docs.collect()}
    want = {(q, d) for q, p in enumerate(asked) if p for d, t in texts.items() if p in t}
    assert {tuple(r) for r in containing_documents(queries, docs).collect()} == want
