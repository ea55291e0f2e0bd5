"""Faults that only showed on larger tables: far coordinates, flat rings, tables larger than their files, full cells."""

import math
import random
import time

import numpy as np
from pyspark.sql import functions as F

from plansheet.functions import scalar as S
from plansheet.operators import features, joins, quality, repair, symmetry, tables
from plansheet.plans import views, work


def ring(x0, y0, w, h):
    return [(x0, y0), (x0 + w, y0), (x0 + w, y0 + h), (x0, y0 + h)]


def test_ring_far_from_the_origin(spark):
    rows = [(k, ring(4900.0, 2_880_000.0 + 120 * k, 23.0, 94.61)) for k in range(20)]
    df = spark.createDataFrame(rows, "k int, pts array<struct<x:double,y:double>>").select("k", S.signed_area(F.col("pts")).alias("a"), S.ring_centroid(F.col("pts")).alias("c"))
    for k, a, c in df.collect():
        assert abs(a - 23.0 * 94.61) < 1e-7
        assert c["x"] == 4911.5 and abs(c["y"] - (2_880_000.0 + 120 * k + 47.305)) < 1e-9


def test_flat_ring_is_not_skewed(spark):
    rows = [(0, 0, [(0.0, 5.0), (40.0, 5.0), (40.0, 5.0), (9.0, 5.0)]), (0, 1, [(0.0, 0.0), (40.0, 0.0), (40.0, 30.0), (9.0, 30.0)])]
    df = spark.createDataFrame(rows, "drawing_id bigint, loop_id bigint, pts array<struct<x:double,y:double>>").withColumn("n", F.lit(4))
    assert [r.loop_id for r in quality.skewed_loops(df).collect()] == [1]


def test_svg_is_rounded_once(spark, tmp_path):
    # the lowest line is just short of a half of the third place, which a first rounding to four places would fill up
    low = lambda k, h: (k // 50 * 120.0 + h) * 25.4 / 96
    k, h = next((k, c / 1000) for k in range(0, 100, 50) for c in range(90_000, 100_000) if round(low(k, c / 1000) * 1e4) % 10 == 5 and 0.496 < low(k, c / 1000) * 1000 % 1 < 0.499)
    spark.createDataFrame([(k, 10, h * 10)], "p_partkey bigint, p_size int, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    [r] = work.QUERIES["src4_svg"](spark, str(tmp_path)).collect()
    assert r.y == -math.floor(low(k, h) * 1000) / 1000


def test_refinement_never_ends_farther_off(spark):
    d = views.segments(spark, "/root/testdata/sf0.1").where("drawing_id in (277, 625)").orderBy("drawing_id", "seg_id").select("drawing_id", "x1", "y1").toPandas()
    for _, g in d.groupby("drawing_id"):
        p = g[["x1", "y1"]].to_numpy()
        p = np.concatenate([p, np.column_stack([500.0 - p[:, 0], p[:, 1]])])
        x, y, a = symmetry.simplex_axis(p, np.array([251.5, 250.0]), 1.5702, lambda m: symmetry.nearest_distance(m, p))
        assert abs(symmetry.snapped(x, y, a)[0] - 250.0) < 1.5001


def test_tables_are_broadcast_by_counted_size(spark):
    panels = work.panels(spark, "/root/testdata/sf0.01")  # 36,000 lines from a file of a few kilobytes
    assert spark.conf.get(tables.PLANNED) == "-1" and spark.conf.get(tables.COUNTED) == "10485760b"
    plan = panels.join(panels.select("drawing_id", "seg_id", F.col("x1").alias("other")), ["drawing_id", "seg_id"])._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" not in plan


def test_nearest_one_holds_no_lists(spark, monkeypatch):
    rng = random.Random(3)  # a strip, as long as a thousand times its width
    rows = [(0, k, rng.choice((0.0, 1000.0, 2000.0)) + rng.random(), 120.0 * k) for k in range(3000)]
    a = spark.createDataFrame(rows[::2], "drawing_id bigint, id bigint, x double, y double")
    b = spark.createDataFrame(rows[1::2], "drawing_id bigint, rid bigint, rx double, ry double")
    with monkeypatch.context() as m:
        m.setattr(F, "collect_list", None)
        grid = joins.k_nearest(a, b, 1, pairs=0)
    span, at = joins._point_grid(b, "drawing_id", 2.0, 12)
    assert at(0).groupBy("drawing_id", "_cx", "_cy").count().agg(F.max("count")).first()[0] < 12
    key = lambda df: sorted((r.id, r.rank, r.rid, round(r.dist, 9)) for r in df.collect())
    assert key(grid) == key(joins.k_nearest(a, b, 1))


def test_side_pairs_of_many_rings(spark):
    """Against every left ring looking at all that are free; 40,000 rings take seconds."""
    rng = random.Random(5)
    at = lambda k, n: (0, k, k, rng.uniform(-400, 400) if n < 2000 else 37.0 * (k % 30 - 15) + rng.random(), rng.uniform(0, 900) if n < 2000 else 41.0 * (k // 30) + rng.random())
    axes = spark.createDataFrame([(0,)], "drawing_id bigint").withColumn("a", S.vertical_axis(F.lit(0.0)))
    schema = "drawing_id bigint, loop_id bigint, rank int, x double, y double"
    rows = [at(k, 600) for k in range(600)]
    got = repair.side_pairs(spark.createDataFrame(rows, schema), axes).collect()
    free, want = {k: (x, y) for _, k, n, x, y in rows if n > 0 and x > 0}, []
    for _, k, n, x, y in rows:
        if n > 0 and x < 0:
            best = min(free, key=lambda j: (free[j][0] + x) ** 2 + (free[j][1] - y) ** 2, default=None)  # noqa: B023
            best = best if best is not None and (free[best][0] + x) ** 2 + (free[best][1] - y) ** 2 < 1600 else None
            free.pop(best, None)
            want.append((k, best))
    assert sorted(map(str, want + [(None, k) for k in free])) == sorted(str((r.loop_left, r.loop_right)) for r in got)
    began = time.time()
    assert repair.side_pairs(spark.createDataFrame([at(k, 40_000) for k in range(40_000)], schema), axes).count() > 20_000
    assert time.time() - began < 30


def test_bundles_without_pairs(spark, monkeypatch):
    """Against all pairs in turn, on lines level, upright, slanted alike, slanted anyhow, of no length and far off; and 12,000 lines in one line."""
    rng = random.Random(7)
    rows = []
    for k in range(700):
        x, y, n = rng.choice((0.0, 7.3)) * 40 + rng.choice((0, 0.3, 0.6)), 120.0 * rng.randrange(40) + 2_000_000, rng.uniform(5, 40)
        t = math.radians((0, 90, 30, 179.5, 0.7, rng.uniform(0, 180))[k % 6])
        n = 0.0 if k % 97 == 0 else n
        rows.append((k % 2, 3 * k, x, y, x + n * math.cos(t), y + n * math.sin(t), "0"))
    lines = features.line_features(spark.createDataFrame(rows, "drawing_id bigint, seg_id bigint, x1 double, y1 double, x2 double, y2 double, layer string"))
    near, used, want = {}, set(), []
    for d, a, b in features.collinear_pairs(lines).select("drawing_id", "seg_a", "seg_b").collect():
        near.setdefault((d, a), []).append((d, b))
    for a in sorted(near):
        if a not in used and (members := [b for b in sorted(near[a]) if b not in used]):
            used |= {a, *members}
            want.append((a[0], a[1], [b[1] for b in (a, *members)]))
    monkeypatch.setattr(features, "collinear_pairs", None)
    assert len(want) > 50 and sorted((r.drawing_id, r.seed, r.members) for r in features.collinear_bundles(lines).collect()) == want
    column = spark.range(12_000).selectExpr("0L as drawing_id", "id as seg_id", "5D as x1", "120D * id as y1", "5D as x2", "120D * id + 90 as y2", "'0' as layer")
    assert [(r.seed, len(r.members)) for r in features.collinear_bundles(features.line_features(column)).collect()] == [(0, 12_000)]


def test_area_ranks_far_from_the_origin(spark, tmp_path):
    from plansheet.plans import geometry

    rows = [(1_000_000 + 20 * k, 20 + k % 3, 900.1 + k % 7 / 10) for k in range(200)]
    spark.createDataFrame(rows, "p_partkey bigint, p_size int, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    want = [k for _, k in sorted((-round(w * (h / 10), 6), k) for k, w, h in rows)]
    assert [r.loop_id for r in geometry.QUERIES["win4_area_rank"](spark, str(tmp_path)).orderBy("rank").collect()] == want


def test_files_are_spread_over_tasks(spark):
    """A file of 20,000 rectangles or 15,000 panels was one task, whose cells or lines grew with the file; shuffles had a fixed number of parts."""
    from plansheet.plans import geometry

    tasks = lambda df: df.select(F.spark_partition_id().alias("k")).distinct().count()
    for made in (views.rectangle_segments, work.panels, work.panel_arcs, work.panel_circles, geometry.polygons):
        assert tasks(made(spark, "/root/testdata/sf0.1")) > 1
    assert tasks(views.rectangle_segments(spark, "/root/testdata/sf0.001")) == 1
    assert int(spark.conf.get(tables.PARTS)) >= tables.INITIAL
    assert tables.spread(spark.range(65_000)).rdd.getNumPartitions() == 6


def test_groups_over_batches(spark):
    """Groups of one row, of some, and of many batches; a group's rows come in the order asked for, as one chunk; keys may be null."""
    import pyarrow as pa

    rows = [(k, i) for k, n in ((0, 1), (1, 2_500), (2, 1), (3, 40), (None, 1_700)) for i in range(n)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "drawing_id bigint, v bigint")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")

    def run(t: pa.Table) -> pa.Table:
        v = t.column("v").to_numpy()
        fit = bool((v == np.arange(len(v))).all()) and t.column("v").num_chunks == 1
        return pa.table([t.column("drawing_id").slice(0, 1).combine_chunks(), pa.array([len(t)]), pa.array([fit])], names=["drawing_id", "n", "fit"])

    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
        got = tables.each_group(df, run, "drawing_id bigint, n bigint, fit boolean", order=("v",)).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert sorted((str(r.drawing_id), r.n, r.fit) for r in got) == [("0", 1, True), ("1", 2_500, True), ("2", 1, True), ("3", 40, True), ("None", 1_700, True)]


def test_weld_of_a_large_drawing_by_parts(spark, monkeypatch):
    """Chains of ends, clusters and tabs, against the kernel for small drawings; a task's kernel holds a part, not the drawing."""
    rng = random.Random(11)
    spot = lambda k: (7.0 * (k % 12) + 0.02 * rng.randrange(6), 9.0 * (k // 12) + 0.02 * rng.randrange(3))
    rows = [(k % 2, k, *spot(rng.randrange(60)), *spot(rng.randrange(60)), "0") for k in range(240)]
    df = spark.createDataFrame(rows, "drawing_id bigint, seg_id bigint, x1 double, y1 double, x2 double, y2 double, layer string")
    key = lambda df: sorted((r.drawing_id, r.seg_id, *(round(r[c], 9) for c in repair.SEG)) for r in df.collect())
    sizes, each = [], repair.each_group

    def noted(df, run, schema, key, order):
        sizes.append(df.groupBy(key).count().agg(F.max("count"), F.count("*")).first())
        return each(df, run, schema, key, order)

    monkeypatch.setattr(repair, "each_group", noted)
    monkeypatch.setattr(repair, "WELDED", 60)
    for tabs in (False, True):
        want = key(repair.weld(df, keep_tabs=tabs, pairs=1 << 20))
        assert key(repair.weld(df, keep_tabs=tabs, pairs=0)) == want and len(want) > 200
    assert sizes[0][0] < 1200 and sizes[0][1] > 8


def test_equal_drawings_are_analysed_once(spark, monkeypatch):
    """Copies of a drawing were each refined anew; a drawing that differs in a bit is no copy."""
    from plansheet.operators import small

    runs, calls = [], []
    for name in ("each_pair", "each_group"):
        monkeypatch.setattr(small, name, lambda *a, _each=getattr(small, name): runs.append(a[-2]) or _each(*a))
    for name in ("axes_of", "graph_of"):
        monkeypatch.setattr(small, name, lambda *a, _name=name, _of=getattr(small, name): calls.append(_name) or _of(*a))
    axes_of, rng = small.axes_of, np.random.default_rng(4)
    xy = rng.uniform(0, 300, (30, 4))
    drawing = lambda k, xy: spark.createDataFrame([(k, i, *map(float, r), "0") for i, r in enumerate(xy)], "drawing_id bigint, seg_id bigint, x1 double, y1 double, x2 double, y2 double, layer string")
    other = xy.copy()
    other[7, 1] = np.nextafter(other[7, 1], np.inf)
    lines = [drawing(k, z).toArrow() for k, z in ((5, xy), (6, xy[::1]), (7, other))]
    pts = [t.select(["drawing_id", "seg_id", "x1", "y1"]).rename_columns(["drawing_id", "id", "x", "y"]) for t in lines]
    axes = spark.createDataFrame([(0, 3, 150.0, 0.0, 0.0, 1.0), (0, 1, 0.0, 150.0, 1.0, 0.0)], "drawing_id bigint, axis_id bigint, ox double, oy double, dx double, dy double")
    segments = drawing(5, xy)
    small.graphs(segments), small.best_axes(segments.select("drawing_id", F.col("seg_id").alias("id"), F.col("x1").alias("x"), F.col("y1").alias("y")), axes.withColumn("a", F.struct("ox", "oy", "dx", "dy")))
    graph, best = runs
    made = [(graph(t), best(p, axes.toArrow())) for t, p in zip(lines, pts)]
    assert calls == ["graph_of", "axes_of"] * 2
    for (g, b), name in zip(made, (5, 6, 7)):
        assert g.column("drawing_id").to_pylist() == [name] and b.column("drawing_id").to_pylist() == [name] * 2
    assert made[0][0].drop(["drawing_id"]) == made[1][0].drop(["drawing_id"]) and made[0][1].drop(["drawing_id"]) == made[1][1].drop(["drawing_id"])
    want = axes_of(np.arange(30), xy[:, :2], [(1, np.array([0.0, 150.0, 1.0, 0.0])), (3, np.array([150.0, 0.0, 0.0, 1.0]))], 0.2, 4, 35, 200, True)
    assert [{c: r[c] for c in r if c != "drawing_id"} for r in made[0][1].to_pylist()] == want


def test_unions_do_not_pass_for_dealt(spark):
    """At 60 times sf0.1 agg14 lost all drawings, as Spark took a union of joins for dealt by their key."""
    rows = [(k, i, 100.0 + 50 * math.cos(math.tau * i / 4), 100.0 + 50 * math.sin(math.tau * i / 4)) for k in range(300) for i in range(4)]
    spark.conf.unset("spark.sql.unionOutputPartitioning")
    rel = symmetry.centred(spark.createDataFrame(rows, "drawing_id bigint, id bigint, x double, y double"), 5.0)
    got = symmetry.order_matches(rel, 5.0).where("matched = 1").groupBy("rot_order").count().collect()
    assert spark.conf.get(tables.UNION) == "false" and {r.rot_order: r["count"] for r in got} == {2: 300, 4: 300}


def test_drawings_over_a_readers_limit_are_several_files(spark, tmp_path):
    """104,000 lines of one drawing were one file, which its reader refused, so that all of them were lost."""
    from plansheet.sinks import writers
    from plansheet.sources import drawings

    spark.range(26_000).selectExpr("20 * id as p_partkey", "cast(1 + id % 50 as int) as p_size", "900 + id % 1000 / 10D as p_retailprice").write.parquet(f"{tmp_path}/part.parquet")
    for name in ("src2_dxf", "src5_hpgl"):
        assert work.QUERIES[name](spark, str(tmp_path)).agg(F.count("x1"), F.countDistinct("y1", "x1", "y2", "x2")).first() == (104_000, 104_000)
    assert [r.n for r in work.QUERIES["src4_svg"](spark, str(tmp_path)).collect()] == [104_000]
    lines = views.rectangle_segments(spark, "/root/testdata/sf0.001").where("drawing_id < 2")
    arcs = spark.createDataFrame([(1, 9, 0.0, 0.0, 5.0, 0.0, 1.0, True, "A"), (1, 900, 0.0, 0.0, 7.0, 0.0, 1.0, True, "A")], "drawing_id bigint, arc_id bigint, cx double, cy double, r double, a0 double, a1 double, is_ccw boolean, layer string")
    files = writers.dxf_text(lines, arcs, most=100)
    read = lambda df: sorted(map(str, drawings.parse(df.select("drawing_id", F.lit(".dxf").alias("extension"), F.col("text").alias("content"))).select("drawing_id", "kind", "x1", "y1", "x2", "y2", "r", "layer", "error").collect()))
    assert files.groupBy("drawing_id", "sheet").count().where("count > 1").isEmpty() and files.count() > 10
    assert read(files) == read(writers.dxf_text(lines, arcs))


def plain_pairs(x, y, area, mx, my, off, area_limit, far, near):
    free, out = np.ones(len(x), bool), []
    for i in range(len(x)):
        if not free[i]:
            continue
        top = np.maximum(area, area[i])
        fits = free & (top > 1e-4) & (np.abs(area - area[i]) < area_limit * top)
        fits[i] = False
        if fits.any():
            d = np.where(fits, np.hypot(mx[i] - x, my[i] - y), np.inf)
            j = int(np.argmin(d))
            if d[j] < far:
                free[i] = free[j] = False
                out.append((i, j, float(d[j]), float(abs(area[i] - area[j]) / top[j])))
        elif off[i] < near:
            free[i] = False
            out.append((i, i, float(off[i]), 0.0))
    return out


def test_mirror_pairs_look_at_near_loops_alone():
    rng = np.random.default_rng(5)
    for trial in range(300):
        n = int(rng.integers(1, 80))
        wide, scale = rng.choice([20.0, 200.0, 3000.0]), rng.choice([1e-4, 1.0, 50.0])
        x, y = np.round(rng.uniform(-wide, wide, n), rng.integers(0, 3)), np.round(rng.uniform(0, wide, n), 0)
        area = np.sort(scale * rng.choice([1.0, 1.3, 1.54, 2.0, 9.0, 100.0], n) * rng.choice([1.0, 1.0, 1.2], n))[::-1].copy()
        args = x, y, area, -x, y, np.abs(x), 0.35, 30.0, 15.0
        assert symmetry.greedy_pairs(*args) == plain_pairs(*args)
    n = 100_000
    x, y = np.arange(n) % 50 * 100.0 - 2450.0, np.arange(n) // 50 * 120.0
    start = time.time()
    assert len(symmetry.greedy_pairs(x, y, np.full(n, 7.0), -x, y, np.abs(x), 0.35, 30.0, 15.0)) == n // 2
    assert time.time() - start < 25
