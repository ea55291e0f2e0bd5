"""Streams: an inbox of drawing files analysed as they come, job progress, and sessions of events."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from threading import Lock

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from plansheet.sources.drawings import parse


def drawings(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """A stream of the parsed entities of files that arrive below path."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    files = spark.readStream.schema(schema).format("binaryFile").option("maxFilesPerTrigger", files_per_batch).load(path)
    return parse(files.select(F.col("path").alias("drawing_id"), F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).alias("extension"), "content"))


def analyse(parsed: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Run work on each micro-batch of parsed drawings; a batch is done again after a failure, so work must overwrite by batch number."""
    writer = parsed.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start() if available_now else writer.start()


class Progress(StreamingQueryListener):
    """Snapshots of queries' progress: the last few hundred here, and all in a table below folder, if one is given, where they outlive the driver."""

    def __init__(self, keep: int = 300, folder: str | None = None, spark: SparkSession | None = None):
        self.rows: list[dict] = []
        self.keep, self.folder, self.spark, self.lock = keep, folder, spark, Lock()

    def _add(self, **row) -> None:
        row = {"error": None} | row
        if self.folder is not None:
            write_snapshot(self.spark, self.folder, row)
        with self.lock:
            self.rows = [*self.rows[-self.keep + 1 :], row]

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self._add(id=str(event.id), run=str(event.runId), name=event.name, status="running", batch=-1, rows=0)

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        self._add(id=str(p.id), run=str(p.runId), name=p.name, status="running", batch=p.batchId, rows=p.numInputRows)

    def onQueryIdle(self, event) -> None:  # noqa: N802
        self._add(id=str(event.id), run=str(event.runId), name=None, status="idle", batch=-1, rows=0)

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self._add(id=str(event.id), run=str(event.runId), name=None, status="failed" if event.exception else "completed", batch=-1, rows=0, error=event.exception)


SNAPSHOT = "id string, run string, name string, status string, batch bigint, rows bigint, error string, at timestamp"


def write_snapshot(spark: SparkSession, folder: str, row: dict) -> None:
    """Adds a snapshot to the table, in a folder of its own: a job's start is told by another thread than its progress, and writers of one folder would clear each other's files."""
    df = spark.createDataFrame([tuple(row[c] for c in ("id", "run", "name", "status", "batch", "rows", "error"))], SNAPSHOT.rpartition(",")[0])
    df.withColumn("at", F.current_timestamp()).write.parquet(f"{folder}/snapshot={uuid.uuid4().hex}")


def job_status(spark: SparkSession, folder: str, job: str | None = None) -> DataFrame:
    """(id, run, name, status, batches, rows, error, at) of each run in the table, or of one job's: its last status and what it has read so far."""
    rows = spark.read.schema(f"{SNAPSHOT}, snapshot string").parquet(folder)
    rows = rows if job is None else rows.where(F.col("id") == job)
    ended = F.col("status").isin("completed", "failed")
    last = F.max_by(F.struct("status", "error"), F.struct(ended.cast("int").alias("ended"), "at", "batch"))
    out = rows.groupBy("id", "run").agg(F.max("name").alias("name"), last.alias("l"), F.countDistinct(F.when(F.col("batch") >= 0, F.col("batch"))).alias("batches"), F.sum("rows").alias("rows"), F.max("at").alias("at"))
    return out.select("id", "run", "name", "l.status", "batches", "rows", "l.error", "at")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(user_id, start, end, n, value): runs of a user's events without a gap, batch or stream (with a watermark)."""
    df = events.withWatermark("ts", late) if events.isStreaming else events
    out = df.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))
    return out.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "value")
