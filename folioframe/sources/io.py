"""Readers and writers: corpora, questions, Markdown directories, page files, logs, reports, tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.common import blank_to_null, rstrip, strip
from ..functions.markdown import clean_markdown, legacy_title_content
from ..session import broadcast_if_small
from . import schemas


def _read_json(spark: SparkSession, path: str, schema: str, array: bool) -> DataFrame:
    """JSON lines (splittable, blank lines skipped) or files holding one JSON array."""
    return spark.read.schema(schema).option("multiLine", array).json(path)


def read_corpus(spark: SparkSession, path: str, array: bool = False) -> DataFrame:
    """documents(doc_id, text, title, metadata); the first non-empty alias of a field wins."""
    raw = _read_json(spark, path, schemas.CORPUS, array)
    return raw.select(F.coalesce(blank_to_null("id"), blank_to_null("doc_id")).alias("doc_id"),
                      F.coalesce(blank_to_null("text"), blank_to_null("content")).alias("text"),
                      F.coalesce(strip("title"), F.lit("")).alias("title"), "metadata")


def _text_at(doc: str, *keys: str) -> Column:
    """The first of ``keys`` of an object that holds a text which is not blank, trimmed."""
    def one(key: str) -> Column:
        value = F.try_variant_get(doc, f"$.{key}", "variant")
        return F.when(F.schema_of_variant(value) == "STRING", blank_to_null(F.try_variant_get(doc, f"$.{key}", "string")))
    return F.coalesce(*[one(k) for k in keys])


def _corpus_rows(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, text, title, metadata, key, faults) of each JSON line that is not blank."""
    lines = spark.read.text(path).filter(strip("value") != "").withColumn("doc", F.try_parse_json("value"))
    kind = lambda key: F.schema_of_variant(F.try_variant_get("doc", f"$.{key}", "variant"))
    rows = lines.withColumns({"doc_id": _text_at("doc", "id", "doc_id"), "text": _text_at("doc", "text", "content"),
                              "title_kind": kind("title"), "metadata_kind": kind("metadata")})
    is_object = F.col("doc").isNotNull() & F.col("value").rlike(r"\A\s*\{")
    rules = [("invalid_json", F.col("doc").isNull()), ("not_an_object", F.col("doc").isNotNull() & ~is_object),
             ("id_missing", is_object & F.col("doc_id").isNull()), ("text_missing", is_object & F.col("text").isNull()),
             ("title_not_text", F.coalesce(F.col("title_kind") != "STRING", F.lit(False))),
             ("metadata_not_an_object", F.coalesce(~F.col("metadata_kind").startswith("OBJECT"), F.lit(False)))]
    return rows.select("doc_id", "text", F.coalesce(strip(F.try_variant_get("doc", "$.title", "string")), F.lit("")).alias("title"),
                       F.try_variant_get("doc", "$.metadata", "variant").alias("metadata"), F.coalesce("doc_id", F.md5("value")).alias("key"),
                       F.array_compact(F.array(*[F.when(broken, name) for name, broken in rules])).alias("faults"))


def read_corpus_checked(spark: SparkSession, path: str) -> dict:
    """``documents`` (doc_id, text, title, metadata VARIANT) of JSON lines, and ``violations`` (rule, key).

    A line with a fault of its own is no document; ids that repeat are named and stay, a corpus without documents is a
    violation. The key is the id, or the MD5 of a line that has none.
    """
    rows = _corpus_rows(spark, path)
    good = rows.filter(F.size("faults") == 0)
    repeated = good.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select(F.lit("duplicate_id").alias("rule"), F.col("doc_id").alias("key"))
    empty = good.agg(F.count("*").alias("n")).filter("n = 0").select(F.lit("corpus_empty").alias("rule"), F.lit("").alias("key"))
    own = rows.select(F.explode("faults").alias("rule"), "key")
    return {"documents": good.select("doc_id", "text", "title", "metadata"), "violations": own.unionByName(repeated).unionByName(empty)}


def read_queries(spark: SparkSession, path: str, array: bool = False) -> dict:
    """``queries``, long ``qrels`` and long ``evidence`` of a question file."""
    raw = _read_json(spark, path, schemas.QUERIES, array).withColumn(
        "query_id", F.coalesce(blank_to_null("id"), blank_to_null("query_id")))
    category = F.coalesce(strip("category"), F.lit("default"))
    queries = raw.select(
        "query_id", strip("query").alias("query"), category.alias("category"),
        F.coalesce(strip("question_type"), category).alias("question_type"),
        F.coalesce("expected_action", F.lit("answer")).alias("expected_action"),
        F.coalesce(strip("reference_answer"), F.lit("")).alias("reference_answer"),
        F.transform(F.coalesce("reference_claims", F.array().cast("array<string>")), strip).alias("claims"), "metadata")
    graded = raw.filter("relevance IS NOT NULL").select("query_id", F.explode("relevance").alias("doc_id", "grade"))
    listed = raw.filter("relevance IS NULL").select("query_id", F.explode("relevant_doc_ids").alias("doc_id"), F.lit(1.0).alias("grade"))
    qrels = graded.unionByName(listed).withColumn("doc_id", strip("doc_id"))
    evidence = raw.select("query_id", F.posexplode("evidence").alias("ord", "e")).select("query_id", "ord", "e.*")
    return {"queries": queries, "qrels": qrels, "evidence": evidence}


def read_markdown_dir(spark: SparkSession, path: str, pattern: str = "*.{md,txt}") -> DataFrame:
    """files(filename, mtime, text, status); blank files are marked ``skipped_empty``."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    text = F.decode("content", "UTF-8")
    return raw.select("path", F.regexp_extract("path", r"([^/]*)$", 1).alias("filename"),
                      F.unix_micros("modificationTime").cast("double").alias("_us"), text.alias("text")).select(
        "path", "filename", (F.col("_us") / 1e6).alias("mtime"), "text",
        F.when(strip("text") == "", "skipped_empty").otherwise("ok").alias("status"))


def read_sources(spark: SparkSession, root: str, pattern: str = "*.md", normalize: Callable[[Column], Column] = clean_markdown) -> DataFrame:
    """sources(path, n_bytes, raw_sha256, raw_text, normalized_text, normalized_sha256) of the files below ``root``.

    ``raw_sha256`` is that of the bytes in the file, taken in the scan; ``path`` is relative to ``root``. A file that is not UTF-8
    keeps its raw hash and has no text; Spark's scan passes over files of no bytes, so these count as missing.
    """
    raw = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(root)
    inside = F.regexp_replace("path", rf"\A.*?\Q{root.rstrip('/')}\E/", "")
    return _hashed_sources(raw.select(inside.alias("path"), F.col("length").alias("n_bytes"), "content"), normalize)


def write_packed_sources(sources: DataFrame, root: str) -> None:
    """Sources (path, content BINARY) packed into a few Parquet files; a file system holds no millions of small files, and no scan lists them."""
    sources.select("path", "content").filter("content IS NOT NULL").write.mode("overwrite").parquet(root)


def read_packed_sources(spark: SparkSession, root: str, normalize: Callable[[Column], Column] = clean_markdown) -> DataFrame:
    """As ``read_sources``, of what ``write_packed_sources`` wrote; sources of no bytes count here."""
    raw = spark.read.schema("path string, content binary").parquet(root)
    return _hashed_sources(raw.select("path", F.octet_length("content").cast("long").alias("n_bytes"), "content"), normalize)


def _hashed_sources(raw: DataFrame, normalize: Callable[[Column], Column]) -> DataFrame:
    """Add texts and hashes to (path, n_bytes, content)."""
    text = F.try_validate_utf8(F.col("content").cast("string"))
    rows = raw.select("path", "n_bytes", F.sha2("content", 256).alias("raw_sha256"), text.alias("raw_text"))
    rows = rows.withColumn("normalized_text", F.when(F.col("raw_text").isNotNull(), normalize(F.col("raw_text"))))
    return rows.withColumn("normalized_sha256", F.sha2("normalized_text", 256))


def import_legacy(files: DataFrame, pages: DataFrame, source_type: str, notebook: str) -> dict:
    """Pages for files (path, text) whose path is not the source of a live page; and the counts."""
    live = pages.filter((F.col("status") != "deleted") & F.col("source_uri").isNotNull()).select(
        F.col("source_uri").alias("path")).distinct()
    fresh = files.join(live, "path", "left_anti")
    made = fresh.select("path", legacy_title_content("path", "text").alias("p")).select(
        F.col("p.title").alias("title"), F.col("p.content").alias("content"), F.lit(source_type).alias("source_type"),
        F.lit(notebook).alias("notebook"), F.col("path").alias("source_uri"))
    good = (F.col("title") != "") & (F.length("title") <= 255)
    marked = files.join(live.withColumn("_live", F.lit(True)), "path", "left").select(
        F.col("_live").isNotNull().alias("skip"), legacy_title_content("path", "text")["title"].alias("title"))
    counts = marked.agg(F.count("*").alias("total"), F.count_if(~F.col("skip") & good).alias("imported"),
                        F.count_if("skip").alias("skipped"), F.count_if(~F.col("skip") & ~good).alias("errors"))
    return {"pages": made.filter(good), "counts": counts}


# --- page files -----------------------------------------------------------------------------

def render_page(meta: dict, content) -> Column:
    """Text of a page file: a YAML header (values as JSON, which YAML reads) and the body."""
    def value(c: Column) -> Column:
        # a one-field object is rendered and unwrapped, which quotes text and lists properly
        return F.regexp_extract(F.to_json(F.struct(c.alias("v")), {"ignoreNullFields": "false"}), r'(?s)\A\{"v":(.*)\}\z', 1)
    lines = [F.concat(F.lit(f"{k}: "), value(c)) for k, c in meta.items()]
    return F.concat(F.concat_ws("\n", F.lit("---"), *lines, F.lit("---")), F.lit("\n\n"), rstrip(content), F.lit("\n"))


def split_front_matter(raw) -> Column:
    """struct<header, body, error>: native part of reading a page file."""
    raw = F.col(raw) if isinstance(raw, str) else raw
    close = F.call_function("locate", F.lit("\n---\n"), raw, F.lit(5))
    error = (F.when(~raw.startswith("---\n"), "NO_HEADER").when(close == 0, "HEADER_NOT_CLOSED"))
    body = F.regexp_replace(F.substring(raw, close + 5, F.length(raw)), r"\A\n+", "")
    return F.struct(F.when(error.isNull(), F.substring(raw, F.lit(5), close - 5)).alias("header"),
                    F.when(error.isNull(), F.regexp_replace(body, r"\n\z", "")).alias("body"), error.alias("error"))


# keys that every header has
REQUIRED_KEYS = ["id", "title", "revision"]


def _header_entries(header: Column) -> Column:
    """array<struct<key,value>> of ``key: value`` lines; values in JSON or plain text, a repeated key counts last."""
    lines = F.filter(F.split(header, "\n"), lambda x: ~x.rlike(r"\A\s*(#.*)?\z"))
    entries = F.transform(lines, lambda x: F.struct(
        F.regexp_extract(x, r"\A([^\s:#][^:]*?)\s*:(?:\s|\z)", 1).alias("key"), F.trim(F.regexp_extract(x, r"\A[^:]*:(.*)\z", 1)).alias("raw")))
    return F.transform(entries, lambda e: F.struct(e["key"].alias("key"), F.when(~e["raw"].isin("", "null", "~"), F.coalesce(
        F.get_json_object(F.concat(F.lit('{"v":'), e["raw"], F.lit("}")), "$.v"), e["raw"])).alias("value")))


def parse_front_matter(files: DataFrame, raw: str = "raw") -> DataFrame:
    """Add ``meta`` (map), ``body`` and ``error``; broken files are kept with their error.

    Headers are read as ``render_page`` writes them, one ``key: value`` per line; a header with any other line is
    quarantined as HEADER_INVALID.
    """
    def last_only(entries):
        return F.filter(entries, lambda e, i: e["value"].isNotNull() & ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda x: x["key"] == e["key"]))

    split = files.withColumn("_s", split_front_matter(raw))
    read = split.withColumn("_e", F.when(F.col("_s.header").isNotNull(), _header_entries(F.col("_s.header"))))
    read = read.withColumn("_m", F.when(~F.exists("_e", lambda e: e["key"] == ""), F.map_from_entries(last_only(F.col("_e")))))
    missing = F.exists(F.array(*[F.lit(k) for k in REQUIRED_KEYS]), lambda k: ~F.exists("_e", lambda e: e["key"] == k))
    error = (F.when(F.col("_e").isNull(), None).when(~F.exists("_e", lambda e: e["key"] != ""), "HEADER_NOT_A_MAPPING")
             .when(F.exists("_e", lambda e: e["key"] == ""), "HEADER_INVALID").when(missing, "HEADER_INCOMPLETE"))
    error = F.coalesce(F.col("_s.error"), error, F.when(F.col("_e").isNull(), "HEADER_NOT_A_MAPPING"))
    return read.withColumn("_error", error).select(*files.columns, F.when(F.col("_error").isNull(), F.col("_m")).alias("meta"),
                                                   F.when(F.col("_error").isNull(), F.col("_s.body")).alias("body"), F.col("_error").alias("error"))


# --- writers --------------------------------------------------------------------------------

def export_pages(pages: DataFrame, path: str) -> None:
    """Every active page and a manifest without file paths, as JSON lines below ``path``."""
    live = pages.filter("status <> 'deleted'")
    live.write.mode("overwrite").json(f"{path}/pages")
    live.drop("content", "file_path").write.mode("overwrite").json(f"{path}/manifest")


def write_jsonl(df: DataFrame, path: str) -> None:
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").text(path)


def write_report(report: DataFrame, path: str) -> None:
    """A report of a few rows as one JSON file."""
    report.select(F.to_json(F.struct(*report.columns)).alias("value")).coalesce(1).write.mode("overwrite").text(path)


# --- logs and tables --------------------------------------------------------------------------

def read_json_logs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.LOGS).json(path).withColumn("date", F.to_date(F.substring("timestamp", 1, 10)))


def logs_by_request(logs: DataFrame, request_id: str) -> DataFrame:
    return logs.filter(F.col("request_id") == request_id)


def logs_by_error(logs: DataFrame, code: str) -> DataFrame:
    return logs.filter(F.col("error_code") == code)


def read_table(spark: SparkSession, name: str, path: str | None = None, jdbc: dict | None = None) -> DataFrame:
    """A stored table from parquet or over JDBC, its JSON columns decoded once."""
    if jdbc:
        df = spark.read.format("jdbc").options(dbtable=name, **jdbc).load()
    else:
        df = spark.read.schema(schemas.TABLES[name]).parquet(path)
    return df.withColumns({c: F.from_json(c, t) for c, t in schemas.JSON_COLUMNS.get(name, {}).items()})


def read_table_variant(spark: SparkSession, name: str, path: str) -> DataFrame:
    """A stored table with its JSON columns as VARIANT, whatever they hold, and ``unparsed``: the columns whose text is no JSON."""
    df = spark.read.schema(schemas.TABLES[name]).parquet(path)
    names = list(schemas.JSON_COLUMNS.get(name, {}))
    values = {c: F.try_parse_json(c) for c in names}
    broken = F.array_compact(F.array(*[F.when(F.col(c).isNotNull() & v.isNull(), c) for c, v in values.items()])) if names else F.array().cast("array<string>")
    return df.withColumn("unparsed", broken).withColumns(values)


def chunks_by_id(chunks: DataFrame, ids: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Chunks of wanted ids; ids without a chunk are simply absent."""
    return chunks.join(broadcast_if_small(ids.select(key).distinct()), key, "left_semi")


def chunks_by_source(chunks: DataFrame, filename: str) -> DataFrame:
    return chunks.filter(F.col("filename") == filename)


def chunks_where(chunks: DataFrame, predicate: Column) -> DataFrame:
    return chunks.filter(predicate)

