"""Edits of drawings with undo and redo, as a fold over a table or as a stream with state.

An edit is (drawing_id, seq, op, seg_id, x1, y1, x2, y2, layer), op one of add, remove, undo and redo. A drawing's state is
the edits that it has been through, in order, and a place in them: undo steps back, redo forth, and a new edit goes on from
the place, so that what had been undone can't be redone. That says the same as two stacks of versions, with a number for
each edit and no copy of the lines.

Edits are taken in order of seq, whatever order they come in. The stream's state holds a drawing's edits by seq, so one that
comes late is put in its place and the drawing told again; the last row of a drawing is what a replay of all its edits
gives. An undo at the start and a redo at the end do nothing, and neither does an unknown op. Edits without a drawing or seq
are left out; of edits with one seq the first that came counts in the stream, the least by its columns in a table.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_STATE = "struct<history:array<bigint>,place:bigint>"
TOLD = "drawing_id bigint, history array<bigint>, place bigint, n_edits bigint"


def step(state: Column, edit: Column) -> Column:
    """The state after an edit."""
    h, p = state["history"], state["place"]
    new = F.when(edit["op"] == "undo", F.struct(h.alias("history"), F.greatest(F.lit(0).cast("bigint"), p - 1).alias("place")))
    new = new.when(edit["op"] == "redo", F.struct(h.alias("history"), F.least(F.size(h).cast("bigint"), p + 1).alias("place")))
    new = new.when(edit["op"].isin("add", "remove"), F.struct(F.array_append(F.slice(h, F.lit(1), p.cast("int")), edit["seq"]).alias("history"), (p + 1).alias("place")))
    return new.otherwise(state).cast(_STATE)


def replayed(edits: DataFrame) -> DataFrame:
    """(drawing_id, history, place, n_edits): each drawing's state after all its edits."""
    once = edits.where("drawing_id is not null and seq is not null").groupBy("drawing_id", "seq").agg(F.min("op").alias("op"))
    rows = once.groupBy("drawing_id").agg(F.array_sort(F.collect_list(F.struct("seq", "op"))).alias("e"))
    start = F.struct(F.array().cast("array<bigint>").alias("history"), F.lit(0).cast("bigint").alias("place"))
    return rows.select("drawing_id", F.aggregate("e", start, step).alias("s"), F.size("e").cast("bigint").alias("n_edits")).select("drawing_id", "s.history", "s.place", "n_edits")


def tracked(edits: DataFrame) -> DataFrame:
    """A stream of edits as a stream of states (drawing_id, history, place, n_edits), a row for each drawing that a batch touches."""

    def fold(log: dict[int, str]) -> tuple[list[int], int]:
        history, place = [], 0
        for seq in sorted(log):
            op = log[seq]
            if op in ("add", "remove"):
                history, place = [*history[:place], seq], place + 1
            elif op in ("undo", "redo"):
                place = max(0, place - 1) if op == "undo" else min(len(history), place + 1)
        return history, place

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        log = dict(zip(*state.get)) if state.exists else {}
        for pdf in batches:
            for seq, op in zip(pdf.seq.tolist(), pdf.op.tolist()):
                log.setdefault(int(seq), op)
        state.update((list(log), list(log.values())))
        history, place = fold(log)
        yield pd.DataFrame({"drawing_id": [key[0]], "history": [history], "place": [place], "n_edits": [len(log)]})

    some = edits.where("drawing_id is not null and seq is not null").select("drawing_id", "seq", "op")
    return some.groupBy("drawing_id").applyInPandasWithState(run, TOLD, "seqs array<bigint>, ops array<string>", "update", "NoTimeout")


def drawn(lines: DataFrame, edits: DataFrame, states: DataFrame) -> DataFrame:
    """The lines of each drawing at its place: lines without what was removed, and with what was added since."""
    applied = states.select("drawing_id", F.explode(F.slice("history", 1, F.col("place").cast("int"))).alias("seq"))
    done = edits.join(applied, ["drawing_id", "seq"])
    columns = ["drawing_id", "seg_id", "x1", "y1", "x2", "y2", "layer"]
    every = lines.select(*columns, F.lit(-1).cast("bigint").alias("seq"), F.lit("add").alias("op")).unionByName(done.select(*columns, "seq", "op"))
    last = every.groupBy("drawing_id", "seg_id").agg(F.max_by(F.struct("op", *columns[2:]), "seq").alias("l"))
    return last.where("l.op = 'add'").select("drawing_id", "seg_id", *(f"l.{c}" for c in columns[2:]))
