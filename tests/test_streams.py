"""A stream cut into several files gives what the batch gives."""

from datetime import datetime

from pyspark.sql import functions as F

from folioframe.streaming import streams as S


def events(spark, tmp_path, sf_dir):
    """The event table as four files in time order."""
    df = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    for part in range(4):
        df.filter(F.floor(F.col("event_id") / 250) == part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return df, S.file_stream(spark, str(tmp_path / "in"), "*.parquet", df.schema, max_files=1)


def test_run_metrics_match_the_batch(spark, tmp_path, sf_dir):
    df, stream = events(spark, tmp_path, sf_dir)
    shape = lambda d: d.select("ts", F.lit("completed").alias("status"), F.lit(1).alias("tokens"), F.col("value").alias("duration_ms"))
    sink = S.run_available(S.stream_run_metrics(shape(stream), delay="40 days"), "update")
    got = {r.window_start: r.runs for r in S.latest(sink, ["window_start", "window_end"]).collect()}
    want = {r.w: r.n for r in df.groupBy(F.date_trunc("hour", "ts").alias("w")).agg(F.count("*").alias("n")).collect()}
    assert got == want


def test_newest_revision_wins(spark, tmp_path):
    rows = [("p", r, "T", f"text of revision {r}") for r in (1, 2, 3)] + [("q", 1, "T", "other")]
    df = spark.createDataFrame(rows, "page_id string, revision int, title string, content string")
    for r in (1, 2, 3):
        df.filter(F.col("revision") == r).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    log = S.stream_index(S.file_stream(spark, str(tmp_path / "in"), "*.parquet", df.schema, max_files=1))
    assert {(r.page_id, r.revision, r.text) for r in S.current_chunks(log).collect()} == {("p", 3, "text of revision 3"), ("q", 1, "other")}


def test_run_log_is_split_late_repeated_and_resumed(spark, tmp_path):
    at = lambda m: datetime(2024, 1, 1, 0, m)
    one = [("a", 1, "stage", at(1)), ("a", 3, "stage", at(3)), ("b", 1, "stage", at(1)), ("b", 2, "token", at(2))]
    two = [("a", 3, "stage", at(3)), ("a", 2, "stage", at(2)), ("b", 4, "run_failed", at(4)), ("b", 5, "stage", at(5)), ("c", 7, "stage", at(5))]
    three = [("b", 3, "stage", at(3)), ("b", 6, "run_completed", at(6)), ("a", 4, "run_completed", at(6)), ("a", 4, "run_completed", at(6)), ("c", 8, "stage", at(6)), ("c", 7, "stage", at(5))]
    schema = "run_id string, sequence long, type string, ts timestamp"
    folder = str(tmp_path / "in")
    for part in (one, two, three):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
    read = lambda n, cursors=None: {(r.run_id, r.sequence) for r in _once(S.run_available(S.stream_run_log(
        S.file_stream(spark, folder, "*.parquet", spark.createDataFrame([], schema).schema, n), cursors), state_store=S.ROCKSDB))}
    want = {("a", 1), ("a", 2), ("a", 3), ("a", 4), ("b", 1), ("b", 3), ("b", 4), ("c", 7), ("c", 8)}
    assert read(1) == want                  # a file a batch
    assert read(10) == want                 # all at once
    cursors = spark.createDataFrame([("a", 2), ("b", 9), ("z", 1)], "run_id string, cursor long")
    assert read(1, cursors) == {("a", 3), ("a", 4), ("c", 7), ("c", 8)}


def _once(sink):
    rows = [(r.run_id, r.sequence) for r in sink.collect()]
    assert len(rows) == len(set(rows))
    return sink.collect()


def test_run_state_follows_the_watermark(spark, tmp_path):
    at = lambda m: datetime(2024, 1, 1, 0, m)
    one = [("a", 1, "stage", "running", at(0)), ("b", 1, "stage", "running", at(1)), ("b", 2, "run_completed", "completed", at(2)), ("d", 1, "stage", "running", at(1))]
    two = [("c", 9, "stage", "running", at(9)), ("d", 2, "run_failed", "failed", at(9)), ("d", 0, "stage", "early", at(9))]
    schema = "run_id string, sequence long, type string, status string, ts timestamp"
    folder = str(tmp_path / "in")
    for part in (one, two):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
    for n in (1, 10):
        stream = S.file_stream(spark, folder, "*.parquet", spark.createDataFrame([], schema).schema, n)
        got = {(r.run_id, r.status, r.last_sequence, r.started_at) for r in S.run_available(S.stream_run_state(stream), "update").collect()}
        assert got == {("a", "timed_out", 1, at(0)), ("b", "completed", 2, at(1)), ("c", "running", 9, at(9)), ("d", "failed", 2, at(1))}


def test_stateful_streams_stay_in_the_engine(spark, tmp_path):
    """No Python worker is called once per run."""
    schema = "run_id string, sequence long, type string, status string, ts timestamp"
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "in"))
    stream = S.file_stream(spark, str(tmp_path / "in"), "*.parquet", spark.createDataFrame([], schema).schema)
    for log in (S.stream_run_log(stream), S.stream_run_state(stream)):
        assert "InPandas" not in log.stream._jdf.queryExecution().logical().toString()


def test_a_table_may_be_a_folder_or_lack_rows(spark, tmp_path):
    rows = spark.createDataFrame([("p", 1, "T", "text"), ("q", 1, "T", "other")], "page_id string, revision int, title string, content string")
    rows.repartition(2).write.parquet(str(tmp_path / "pages.parquet"))
    (tmp_path / "none.parquet").mkdir()
    read = lambda name: {r.text for r in S.current_chunks(S.stream_index(S.file_stream(spark, str(tmp_path), name, rows.schema))).collect()}
    assert read("pages.parquet") == {"text", "other"}
    assert read("none.parquet") == set()
