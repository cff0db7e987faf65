"""Reading with checks: corpora, stored tables, hashes of bytes."""

import hashlib
import json

from pyspark.sql import functions as F

from folioframe.functions.tokens import serialize_json
from folioframe.operators import evaluate as E
from folioframe.sources import io as R


def test_faults_of_a_corpus_are_rows(spark, tmp_path):
    good = {"id": " a ", "text": "x\ny", "title": " T ", "metadata": {"n": 1, "deep": {"b": [True, None]}}}
    lines = [json.dumps(good), "", "  ", '{"doc_id": "b", "id": " ", "text": " ", "content": "ü"}', '{"id": "b", "text": "again"}', '{"id": "c", "text": "  "}', '{"id": 4, "text": "t"}',
             '{"id": "e", "text": "t", "title": null}', '{"id": "f", "text": "t", "metadata": "m"}', '{"id": "g", "text": ["t"], "title": 3}', '["a"]', "7", "{broken"]
    (tmp_path / "c.jsonl").write_text("\n".join(lines), encoding="utf-8")
    out = R.read_corpus_checked(spark, str(tmp_path / "c.jsonl"))
    md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
    assert {(r.rule, r.key) for r in out["violations"].collect()} == {
        ("duplicate_id", "b"), ("text_missing", "c"), ("id_missing", md5('{"id": 4, "text": "t"}')), ("title_not_text", "e"), ("metadata_not_an_object", "f"),
        ("text_missing", "g"), ("title_not_text", "g"), ("not_an_object", md5('["a"]')), ("not_an_object", md5("7")), ("invalid_json", md5("{broken"))}
    docs = {(r.doc_id, r.text, r.title, r.b) for r in out["documents"].withColumn("b", F.try_variant_get("metadata", "$.deep.b[0]", "boolean")).collect()}
    assert docs == {("a", "x\ny", "T", True), ("b", "ü", "", None), ("b", "again", "", None)}


def test_an_empty_corpus_is_a_violation(spark, tmp_path):
    for name, text in (("blank", "\n \n"), ("bad", "{\n")):
        (tmp_path / name).write_text(text)
        rules = {r.rule for r in R.read_corpus_checked(spark, str(tmp_path / name))["violations"].collect()}
        assert "corpus_empty" in rules


def test_json_columns_as_variant(spark, tmp_path):
    rows = spark.createDataFrame([("1", '[{"stage":"s"}]', '{"k":{"x":2}}'), ("2", "[", None), ("3", None, "oops")], "request_id string, timeline string, retrieval_stats string")
    rows.write.parquet(str(tmp_path / "runs"))
    got = {r.request_id: (r.x, r.unparsed) for r in R.read_table_variant(spark, "agent_runs", str(tmp_path / "runs")).select(
        "request_id", F.try_variant_get("retrieval_stats", "$.k.x", "int").alias("x"), "unparsed").collect()}
    assert got == {"1": (2, []), "2": (None, ["timeline"]), "3": (None, ["retrieval_stats"])}


def test_json_keys_are_sorted_at_any_depth(spark):
    value = {"ü": "é\"\n", "b": {"z": [{"d": 1, "c": None}], "a": False}, "a": 1.5, "": 10 ** 12}
    rows = spark.createDataFrame([(json.dumps(value),), ("plain text",), (None,), ('{"a":1,"a":2}',)], "t string")
    got = [r.j for r in rows.select(serialize_json("t").alias("j")).collect()]
    assert got[0] == json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    assert got[1:] == ["plain text", None, '{"a":1,"a":2}']


def test_a_changed_byte_is_a_violation(spark, tmp_path):
    root = tmp_path / "src"
    (root / "deep").mkdir(parents=True)
    (root / "a.md").write_bytes(b"# A\n\nalpha beta  \n")
    (root / "deep" / "b.md").write_bytes("über\n".encode())
    (root / "bad.md").write_bytes(b"\xff\xfe\x00")
    (root / "c.txt").write_bytes(b"no source")
    before = R.read_sources(spark, str(root))
    manifest = spark.createDataFrame(before.select("path", "raw_sha256", "normalized_sha256").collect(), "path string, raw_sha256 string, normalized_sha256 string")
    rows = {r.path: r for r in before.collect()}
    assert set(rows) == {"a.md", "deep/b.md", "bad.md"} and rows["a.md"].normalized_text == "# A\n\nalpha beta" and rows["bad.md"].raw_text is None
    assert all(rows[p].raw_sha256 == hashlib.sha256((root / p).read_bytes()).hexdigest() for p in rows)
    evidence = spark.createDataFrame([(1, 1, "a.md", 5, 10, "alpha"), (1, 2, "deep/b.md", 0, 4, "über"), (2, 1, "gone.md", 0, 1, "x")],
                                     "query_id int, ord int, source_id string, start_char int, end_char int, quote string")
    bound = spark.createDataFrame(E.bind_sources(evidence, before).collect(), E.bind_sources(evidence, before).schema)
    found = lambda df: {(r.rule, r.key) for r in df.collect()}
    assert found(E.audit_sources(manifest, before)) == {("not_utf8", "bad.md")}
    assert found(E.audit_evidence(bound, before)) == {("missing_source", "2/1")}
    (root / "a.md").write_bytes(b"# A\n\nalpha beta\n")             # blanks at a line's end are not text
    (root / "deep" / "b.md").write_bytes("Über\n".encode())
    (root / "bad.md").unlink()
    (root / "new.md").write_bytes(b"new")
    (root / "empty.md").write_bytes(b"")
    now = R.read_sources(spark, str(root))
    assert found(E.audit_sources(manifest, now)) == {("raw_hash", "a.md"), ("raw_hash", "deep/b.md"), ("normalized_hash", "deep/b.md"), ("missing_file", "bad.md"), ("unlisted_file", "new.md")}
    assert found(E.audit_evidence(bound, now)) == {("raw_hash", "1/1"), ("raw_hash", "1/2"), ("source_hash", "1/2"), ("quote_mismatch", "1/2"), ("missing_source", "2/1")}


def test_packed_sources_equal_files(spark, tmp_path):
    texts = {f"{i % 7}/{i}.md": f"# T {i}\n\nüber  {i}\n".encode() for i in range(60)} | {"bad.md": b"\xff\x00"}
    for name, content in texts.items():
        (tmp_path / "files" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "files" / name).write_bytes(content)
    packed = str(tmp_path / "packed")
    R.write_packed_sources(spark.createDataFrame([*texts.items(), ("gone.md", None)], "path string, content binary"), packed)
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    got = rows(R.read_packed_sources(spark, packed))
    assert len(got) == len(texts) and got == rows(R.read_sources(spark, str(tmp_path / "files")))


def test_sources_of_a_query_are_packed(spark, sf_dir, monkeypatch):
    """The number of files does not follow that of documents."""
    from folioframe.catalog import evaluation
    from folioframe.catalog.registry import QUERIES
    folders, fresh = [], evaluation.shared_dir
    monkeypatch.setattr(evaluation, "shared_dir", lambda *a: folders.append(fresh(*a)) or folders[-1])
    n = QUERIES["ev17_source_hashes"](spark, sf_dir).count()
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folders[0]).count()
    assert n == spark.read.parquet(f"{sf_dir}/documents.parquet").count() and files * 10 < n
