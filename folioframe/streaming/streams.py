"""Structured Streaming forms of the incremental operators.

Every function takes and returns streaming DataFrames, or a ``Log`` of one; ``run_available`` drives it to completion.
Sinks write a folder per batch id, so a batch repeated after a failure overwrites itself.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import settings as S
from ..functions.text import conversation_title
from ..operators.chunking import chunk_pages
from ..operators.select import assess_evidence
from ..operators.sketches import sketch_columns
from ..session import broadcast_if_small, shared_dir

# Event types and states that end a run.
TERMINAL_TYPES = ["run_completed", "run_failed", "run_cancelled", "run_timed_out"]


_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
# keyed state with maps and timers needs this provider
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Log(NamedTuple):
    """A stream whose sink is a log, and what reads its rows (with ``batch_id``, the batch they arrived in) from it."""
    stream: DataFrame
    read: Callable[[DataFrame], DataFrame]


def file_stream(spark: SparkSession, folder: str, pattern: str, schema, max_files: int | None = None) -> DataFrame:
    """The Parquet files below ``folder`` that ``pattern`` names, and those in folders that it names."""
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    # the braces make a plain name a pattern: a stream takes a pattern that names a file or a folder, but not the path of a file
    return reader.parquet(f"{folder.rstrip('/')}/{{{pattern}}}")


def run_available(stream: DataFrame | Log, mode: str = "append", label: str = "stream",
                  per_batch: Callable[[DataFrame], DataFrame] | None = None, state_store: str | None = None) -> DataFrame:
    """Process what is there and return the sink as a table with ``batch_id``; ``state_store`` names a provider for this query alone."""
    if isinstance(stream, Log):
        return stream.read(run_available(stream.stream, mode, label, per_batch, state_store))
    spark = stream.sparkSession
    if state_store:
        before = spark.conf.get(_PROVIDER, None)
        spark.conf.set(_PROVIDER, state_store)
        try:
            return run_available(stream, mode, label, per_batch)
        finally:
            spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)
    base = shared_dir(spark, label)
    out, written = f"{base}/out", []

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = per_batch(batch) if per_batch else batch
        rows.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")
        written.append(batch_id)

    query = (stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/checkpoint")
             .trigger(availableNow=True).foreachBatch(write).start())
    query.awaitTermination()
    if not written:         # no file, no batch
        empty = spark.createDataFrame([], stream.schema)
        return (per_batch(empty) if per_batch else empty).withColumn("batch_id", F.lit(0))
    return spark.read.option("basePath", out).option("mergeSchema", "false").parquet(out)


def latest(sink: DataFrame, keys: list) -> DataFrame:
    """Last version of each key of an update-mode sink."""
    rest = [c for c in sink.columns if c not in keys]
    return sink.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch_id").alias("r")).select(*keys, "r.*")


# --- index ------------------------------------------------------------------------------------

def stream_index(pages: DataFrame, label: str = "index") -> DataFrame:
    """Chunk new page revisions as they arrive. The sink is a log of chunks and of one row without a chunk per
    revision; ``current_chunks`` reads the newest revision of each page from it, which replaces older ones
    without rewriting them, also if it has no chunk."""
    def log(batch: DataFrame) -> DataFrame:
        return chunk_pages(batch, clean=False).unionByName(batch.select("page_id", "revision"), allowMissingColumns=True)

    return run_available(pages, "append", label, log)


def current_chunks(log: DataFrame) -> DataFrame:
    newest = log.groupBy("page_id").agg(F.max("revision").alias("revision"))
    chunks = log.filter("chunk_id IS NOT NULL")
    return chunks.join(newest, ["page_id", "revision"], "left_semi").dropDuplicates(["chunk_id"])


# --- run events -------------------------------------------------------------------------------

def stream_events(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Each (run, sequence) once; token events are not part of the log."""
    return events.filter("type <> 'token'").withWatermark("ts", delay).dropDuplicatesWithinWatermark(
        ["run_id", "sequence"])


def stream_run_log(events: DataFrame, cursors: DataFrame | None = None, delay: str = "1 hour") -> Log:
    """(run_id, sequence, type, ts): each event of a run once, after its cursor and up to the event that ends the run.

    ``cursors`` (run_id, cursor) is a batch table: a reader that saw a run up to a sequence resumes behind it. A run ends with the
    smallest sequence of a terminal type that has arrived; greater ones that come with it or later are no part of the log, smaller ones are.
    Token events are left out. Repeats within ``delay`` are dropped before the sink, others when it is read, where runs are cut at their
    ends as well: a row of the sink never changes, and no run is read whole.
    """
    rows = events.filter("type <> 'token'").select("run_id", F.col("sequence").cast("long").alias("sequence"), "type", "ts")
    if cursors is not None:
        seen = cursors.groupBy("run_id").agg(F.max(F.col("cursor").cast("long")).alias("_cursor"))
        rows = rows.join(broadcast_if_small(seen), "run_id", "left").filter("_cursor IS NULL OR sequence > _cursor").drop("_cursor")
    return Log(rows.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["run_id", "sequence"]), run_log)


def run_log(log: DataFrame) -> DataFrame:
    """The first arrival of each event, without those behind an end of their run that had arrived."""
    rest = [c for c in log.columns if c not in ("run_id", "sequence", "batch_id")]
    once = log.groupBy("run_id", "sequence").agg(F.min_by(F.struct(*rest, "batch_id"), "batch_id").alias("r")).select("run_id", "sequence", "r.*")
    ends = log.filter(F.col("type").isin(TERMINAL_TYPES)).groupBy(F.col("run_id").alias("_run"), F.col("batch_id").alias("_at")).agg(F.min("sequence").alias("_end"))
    behind = (F.col("run_id") == F.col("_run")) & (F.col("batch_id") >= F.col("_at")) & (F.col("sequence") > F.col("_end"))
    return once.join(ends, behind, "left_anti").select(*log.columns)


def stream_run_state(events: DataFrame, delay: str = "0 seconds", timeout_s: int = S.RUN_TIMEOUT_SECONDS) -> Log:
    """Latest status per run; a run without a terminal event is ``timed_out`` once the watermark is ``timeout_s`` past its start.

    Running extremes per run are kept (update mode), so a long run is never held whole; ``run_state`` reads the statuses from the sink."""
    runs = events.withWatermark("ts", delay).groupBy("run_id").agg(
        F.max_by("status", "sequence").alias("status"), F.max("sequence").alias("last_sequence"), F.min("ts").alias("started_at"),
        F.max("ts").alias("_last"), F.bool_or(F.col("type").isin(TERMINAL_TYPES)).alias("_ended"))
    return Log(runs, lambda sink: run_state(sink, delay, timeout_s))


def run_state(sink: DataFrame, delay: str, timeout_s: int) -> DataFrame:
    """(run_id, status, last_sequence, started_at, batch_id) of each run as the watermark of all events left it."""
    newest = sink.groupBy("run_id").agg(F.max_by(F.struct(*[c for c in sink.columns if c != "run_id"]), "batch_id").alias("r")).select("run_id", "r.*")
    mark = sink.agg((F.max("_last") - F.expr(f"INTERVAL {delay}")).alias("_mark"))
    late = ~F.col("_ended") & (F.col("started_at") + F.expr(f"INTERVAL {timeout_s} SECONDS") < F.col("_mark"))
    return newest.join(F.broadcast(mark)).withColumn("status", F.when(late, "timed_out").otherwise(F.col("status"))).select(      # one row
        "run_id", "status", "last_sequence", "started_at", "batch_id")


# --- conversations, feedback, actions -----------------------------------------------------------

def stream_sessions(messages: DataFrame, gap: str = "24 hours", delay: str = "1 hour") -> DataFrame:
    """Sessions closed by ``gap`` of silence: count, bounds and title of the first user message."""
    user = F.when(F.col("role") == "user", F.col("ts"))
    return messages.withWatermark("ts", delay).groupBy("session_id", F.session_window("ts", gap).alias("w")).agg(
        F.count("*").alias("message_count"), F.min("ts").alias("started_at"), F.max("ts").alias("updated_at"),
        conversation_title(F.min_by("content", user)).alias("title")).drop("w")


def stream_dedupe(feedback: DataFrame, key: str = "request_id", delay: str = "1 day") -> DataFrame:
    """One feedback per request; the first to arrive stays."""
    return feedback.withWatermark("ts", delay).dropDuplicatesWithinWatermark([key])


def stream_pending_expiry(actions: DataFrame, decisions: DataFrame, hours: int = S.PENDING_ACTION_HOURS,
                          delay: str = "10 minutes") -> DataFrame:
    """Actions (action_id, key, ts) left-joined to decisions (key, decided_at, decision) within the expiry
    interval; without one the action is ``expired`` once both watermarks have passed it."""
    a = actions.withWatermark("ts", delay)
    d = decisions.withColumnRenamed("key", "d_key").withWatermark("decided_at", delay)
    cond = (F.col("key") == F.col("d_key")) & (F.col("decided_at") >= F.col("ts")) & (
        F.col("decided_at") <= F.col("ts") + F.expr(f"INTERVAL {hours} HOURS"))
    return a.join(d, cond, "left_outer").select(
        "action_id", "key", "ts", F.coalesce("decision", F.lit("expired")).alias("outcome"), "decided_at")


# --- metrics, gate ------------------------------------------------------------------------------

def stream_run_metrics(runs: DataFrame, size: str = "1 hour", slide: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Tumbling or sliding counts, failure rate, tokens and approximate p95 of the run time."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return runs.withWatermark("ts", delay).groupBy(w.alias("w")).agg(
        F.count("*").alias("runs"), F.count_if(F.col("status") == "failed").alias("failures"), F.sum("tokens").alias("tokens"),
        F.percentile_approx("duration_ms", 0.95, 10_000).alias("p95_ms"), F.max("duration_ms").alias("max_ms")).select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "runs", "failures",
        (F.col("failures") / F.col("runs")).alias("failure_rate"), "tokens", "p95_ms", "max_ms")


def stream_run_sketches(runs: DataFrame, size: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Counts and a sketch of the run time per window, once closed: (window_start, runs, failures, n, low, high, sketch).

    Stored rows merge to longer windows, and give quantiles without the runs (``operators.sketches``).
    """
    return runs.withWatermark("ts", delay).groupBy(F.window("ts", size).alias("w")).agg(
        F.count("*").alias("runs"), F.count_if(F.col("status") == "failed").alias("failures"), *sketch_columns("duration_ms")).select(
        F.col("w.start").alias("window_start"), "runs", "failures", "n", "low", "high", "sketch")


def stream_quality(rows: DataFrame, label: str = "quality") -> DataFrame:
    """Evidence gate over all rows of a question, in however many micro-batches they came: the sink is the log of
    rows, and the verdict is read from it."""
    log = run_available(rows, "append", label)
    return assess_evidence(log, log.select("query_id"))
