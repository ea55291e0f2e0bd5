"""Streams over files."""

import random
import time

import pytest
from pyspark.errors import StreamingQueryException

from plansheet.sources import drawings
from plansheet.streaming import edits, inbox


def test_inbox(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.nc").write_text("G1 X10\nG1 Y5")
    (tmp_path / "in" / "b.nc").write_text("G81")
    progress = inbox.Progress()
    spark.streams.addListener(progress)
    out = str(tmp_path / "out")

    def work(df, batch):
        df.select("drawing_id", "kind", "error").write.mode("overwrite").parquet(f"{out}/batch={batch}")

    inbox.analyse(inbox.drawings(spark, f"file://{tmp_path}/in"), work, str(tmp_path / "state")).awaitTermination()
    rows = spark.read.parquet(out).collect()
    assert sorted(r["kind"] or "" for r in rows) == ["", "line", "line"] and [r["error"] for r in rows if r["error"]] == ["unknown code"]
    spark.streams.removeListener(progress)
    assert drawings.formats(spark).count() == len(drawings.FORMATS)


def test_progress_of_completed_and_failed_jobs(spark, tmp_path):
    """Snapshots are a table, which a listener writes and any session reads by job."""
    (tmp_path / "in").mkdir()
    for k in range(3):
        (tmp_path / "in" / f"{k}.nc").write_text("G1 X10\nG1 Y5")
    folder = f"file://{tmp_path}/jobs"
    progress = inbox.Progress(folder=folder, spark=spark)
    spark.streams.addListener(progress)

    def broken(df, batch):
        raise ValueError("no such tool")

    files = inbox.drawings(spark, f"file://{tmp_path}/in", files_per_batch=1)
    good = inbox.analyse(files, lambda df, batch: df.count() and None, str(tmp_path / "good"))
    good.awaitTermination()
    bad = inbox.analyse(files, broken, str(tmp_path / "bad"))
    with pytest.raises(StreamingQueryException):
        bad.awaitTermination()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    for _ in range(100):
        if {"completed", "failed"} <= {r["status"] for r in progress.rows}:
            break
        time.sleep(0.1)
    spark.streams.removeListener(progress)
    rows = {r.id: r for r in inbox.job_status(spark, folder).collect()}
    assert (rows[good.id].status, rows[good.id].batches, rows[good.id].rows, rows[good.id].error) == ("completed", 3, 3, None)
    assert rows[bad.id].status == "failed" and "no such tool" in rows[bad.id].error
    assert [r.status for r in inbox.job_status(spark, folder, good.id).collect()] == ["completed"]


def replay(log):
    """Two stacks of versions, as an editor keeps them."""
    now, undo, redo = (), [], []
    for seq, op in sorted(log):
        if op in ("add", "remove"):
            undo, redo, now = [*undo, now], [], (*now, seq)
        elif op == "undo" and undo:
            redo, now, undo = [*redo, now], undo[-1], undo[:-1]
        elif op == "redo" and redo:
            undo, now, redo = [*undo, now], redo[-1], redo[:-1]
    return now


EDIT = "drawing_id bigint, seq bigint, op string, seg_id bigint, x1 double, y1 double, x2 double, y2 double, layer string"


def test_undo_and_redo(spark, tmp_path):
    """A stream with late edits ends where a replay of all edits does, and new edits after an undo can't be redone."""
    r = random.Random(7)
    logs = {d: [(k, r.choice(["add", "add", "remove", "undo", "undo", "redo", "paint"])) for k in range(25)] for d in range(5)}
    logs[9] = [(0, "add"), (1, "add"), (2, "undo"), (3, "add"), (4, "redo"), (5, "undo"), (6, "undo"), (7, "undo"), (8, "redo")]
    rows = [(d, k, op, k % 6, float(k), 0.0, 1.0, 1.0, "0") for d, log in logs.items() for k, op in log]
    rows += [(None, 3, "add", 1, 0.0, 0.0, 1.0, 1.0, "0"), (1, None, "add", 1, 0.0, 0.0, 1.0, 1.0, "0")]
    batch = {s.drawing_id: s for s in edits.replayed(spark.createDataFrame(rows, EDIT)).collect()}
    for d, log in logs.items():
        assert tuple(batch[d].history[: batch[d].place]) == replay(log)
    assert (batch[9].history, batch[9].place) == ([0, 3], 1)
    r.shuffle(rows)  # edits come late, over three files, some twice
    for k in range(3):
        spark.createDataFrame(rows[k::3] + rows[:5], EDIT).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(EDIT).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    out = f"{tmp_path}/out"

    def work(df, number):
        df.write.mode("overwrite").parquet(f"{out}/batch={number}")

    edits.tracked(stream).writeStream.outputMode("update").foreachBatch(work).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    last = {}
    for s in sorted(spark.read.parquet(out).collect(), key=lambda s: s.batch):
        last[s.drawing_id] = s
    assert {d: (s.history, s.place, s.n_edits) for d, s in last.items()} == {d: (s.history, s.place, s.n_edits) for d, s in batch.items()}


def test_lines_at_a_place(spark):
    lines = spark.createDataFrame([(1, 0, 0.0, 0.0, 5.0, 0.0, "a"), (1, 1, 1.0, 0.0, 5.0, 0.0, "a"), (2, 0, 0.0, 0.0, 5.0, 0.0, "a")], EDIT.replace("seq bigint, op string, ", ""))
    log = spark.createDataFrame([(1, 1, "remove", 0, 0.0, 0.0, 0.0, 0.0, "0"), (1, 2, "add", 7, 2.0, 2.0, 3.0, 3.0, "b"), (1, 3, "remove", 1, 0.0, 0.0, 0.0, 0.0, "0"), (1, 4, "undo", None, None, None, None, None, None)], EDIT)
    got = edits.drawn(lines, log, edits.replayed(log)).collect()
    assert sorted((g.drawing_id, g.seg_id, g.x1) for g in got) == [(1, 1, 1.0), (1, 7, 2.0), (2, 0, 0.0)]
