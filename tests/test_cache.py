"""Results kept by content: read again, computed again for what changed alone."""

import os

import pytest
from pyspark.sql import functions as F

from plansheet.plans import flows
from plansheet.plans.cache import Results, contents

SEG = "drawing_id bigint, seg_id bigint, x1 double, y1 double, x2 double, y2 double, layer string"


def panel(d, off=0.0):
    spots = [(0, 0, 300, 200), (20, 20, 40, 30), (240 - off, 20, 40, 30), (20, 150, 40, 30), (240, 150, 40, 30), (130, 80, 40, 40)]
    out = []
    for x, y, w, h in spots:
        c = [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]
        out += [(d, len(out) + k, *map(float, (*p, *q)), "0") for k, (p, q) in enumerate(zip(c, c[1:] + c[:1]))]
    return out


def rows(df):
    return sorted(map(str, df.select(*(c for c in df.columns if c != "cached")).collect()))


def cached(df):
    return {r.drawing_id: r.cached for r in df.select("drawing_id", "cached").distinct().collect()}


def test_only_changes_are_computed(spark, tmp_path):
    lines = [r for d in (1, 2, 3) for r in panel(d, d / 2)] + [(None, 0, 0.0, 0.0, 1.0, 1.0, None)]
    df, kept, asked = spark.createDataFrame(lines, SEG), Results(spark, f"file://{tmp_path}/kept"), []

    def make(own):
        asked.append(sorted(r.drawing_id or 0 for r in own["segments"].select("drawing_id").distinct().collect()))
        return {"boxes": flows.boxes(own["segments"]), "counts": own["segments"].groupBy("drawing_id").agg(F.count(F.lit(1)).alias("n"))}

    first = kept.get("boxes", {"segments": df}, make)
    assert asked == [[0, 1, 2, 3]] and cached(first["boxes"]) == dict.fromkeys((None, 1, 2, 3), False)
    again = kept.get("boxes", {"segments": df.orderBy(F.desc("x1"))}, make)  # in another order
    assert len(asked) == 1 and cached(again["counts"]) == dict.fromkeys((None, 1, 2, 3), True)
    assert rows(again["boxes"]) == rows(first["boxes"])
    edited = spark.createDataFrame([(*r[:2], r[2] - 1, *r[3:]) if r[0] == 2 and r[1] == 5 else r for r in lines], SEG)
    third = kept.get("boxes", {"segments": edited}, make)
    assert asked[1:] == [[2]] and cached(third["boxes"]) == {None: True, 1: True, 2: False, 3: True}
    assert rows(third["boxes"]) == rows(make({"segments": edited})["boxes"])
    asked.clear()
    assert set(cached(kept.get("boxes", {"segments": df}, make)["boxes"]).values()) == {True} and not asked  # the edit undone
    kept.get("boxes", {"segments": df.where("drawing_id = 1")}, make, options="other")
    assert asked == [[1]]
    kept.drop("boxes")
    kept.get("boxes", {"segments": df.where("drawing_id = 1")}, make)
    assert asked == [[1], [1]]


def test_failed_batches_are_not_read(spark, tmp_path):
    df, kept = spark.createDataFrame(panel(1), SEG), Results(spark, f"file://{tmp_path}/kept")

    def broken(own):
        return {"boxes": flows.boxes(own["segments"]), "counts": own["segments"].select("drawing_id", F.raise_error(F.lit("lost")).alias("n"))}

    with pytest.raises(Exception, match="lost"):
        kept.get("boxes", {"segments": df}, broken)
    got = kept.get("boxes", {"segments": df}, lambda own: {"boxes": flows.boxes(own["segments"]), "counts": own["segments"].groupBy("drawing_id").count()})
    assert cached(got["boxes"]) == {1: False} and got["boxes"].count() == 1


def test_contents_tell_drawings_apart(spark):
    a = panel(1)
    one = lambda some, **more: contents({"segments": spark.createDataFrame(some, SEG), **more}).first().content
    assert one(a) == one(a[::-1]) and len({one(a), one(a[1:]), one([*a, a[0]]), one([*a, a[0], a[0]]), one([(1, *r[1:-1], "1") if r[1] == 3 else r for r in a])}) == 5


def test_candidates_are_kept(spark, tmp_path):
    kept, lines = Results(spark, f"file://{tmp_path}/kept"), panel(1, 2.0) + panel(2, 1.0)
    arcs = spark.createDataFrame([(1, 0, 150.0, 20.0, 9.0, 0.0, 3.14159265, True, "0")], "drawing_id bigint, arc_id bigint, cx double, cy double, r double, a0 double, a1 double, is_ccw boolean, layer string")
    ranked, best, made = flows.cached_candidates(kept, spark.createDataFrame(lines, SEG), arcs)
    assert ranked.count() == 8 and set(cached(ranked).values()) == {False}
    batches = lambda: len(os.listdir(f"{tmp_path}/kept/candidates/lines"))
    ranked2, best2, made2 = flows.cached_candidates(kept, spark.createDataFrame(lines, SEG), arcs)
    assert batches() == 1 and cached(ranked2) == {1: True, 2: True} and rows(ranked2) == rows(ranked) and rows(flows.applied(best2, made2)) == rows(flows.applied(best, made))
    ranked3, best3, made3 = flows.cached_candidates(kept, spark.createDataFrame(panel(1, 2.0) + panel(2, 3.0), SEG), arcs)
    assert batches() == 2 and cached(ranked3) == {1: True, 2: False}
    assert flows.applied(best3, made3).groupBy("drawing_id").count().count() == 2
