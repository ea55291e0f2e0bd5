"""Distance joins of large drawings against brute force, and against the kernels for small ones."""

import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from plansheet.operators import joins, quality, small, symmetry, topology
from plansheet.plans import flows

SEG = "drawing_id bigint, seg_id bigint, x1 double, y1 double, x2 double, y2 double, layer string"


@pytest.fixture(scope="module")
def tables(spark):
    """Two drawings: lines short, long, upright, level and without length, one a thousand times as long; points inside, outside and on them."""
    r = random.Random(3)
    lines, pts = [], []
    for d in (1, 2):
        for k in range(70):
            x, y, t, n = r.uniform(0, 900), r.uniform(0, 500), r.choice([0, math.pi / 2, r.uniform(0, 6.3)]), r.choice([0, 5, 30, 30, 400])
            lines.append((d, k, x, y, x + n * math.cos(t), y + n * math.sin(t), f"L{k % 4}"))
        lines.append((d, 99, -1e5, -3e4, 2e5, 1e5, "far"))
        pts += [(d, k, r.choice([r.uniform(-50, 950), r.uniform(4000, 9000)]), r.uniform(-50, 560)) for k in range(60)]
        pts += [(d, 60 + k, lines[k][2], lines[k][3]) for k in range(9)]
    return lines, pts, spark.createDataFrame(lines, SEG), spark.createDataFrame(pts, "drawing_id bigint, id bigint, x double, y double")


def away(p, s):
    x1, y1, x2, y2 = s[2:6]
    n = (x2 - x1) ** 2 + (y2 - y1) ** 2
    t = 0.0 if n < 1e-24 else max(0.0, min(1.0, ((p[2] - x1) * (x2 - x1) + (p[3] - y1) * (y2 - y1)) / n))
    return math.hypot(x1 + t * (x2 - x1) - p[2], y1 + t * (y2 - y1) - p[3])


@pytest.mark.parametrize("pairs", [0, joins.PAIRS])
def test_nearest_segment(tables, pairs):
    lines, pts, segments, points = tables
    got = {(r.drawing_id, r.id): r for r in joins.nearest_segment(points, segments, pairs=pairs).collect()}
    assert len(got) == len(pts)
    for p in pts:
        dist, k, layer = min((away(p, s), s[1], s[6]) for s in lines if s[0] == p[0])
        r = got[p[:2]]
        assert abs(r.dist - dist) < 1e-6 and (dist < 1e-6 or (r.seg_id, r.layer) == (k, layer))


@pytest.mark.parametrize("pairs", [0, joins.PAIRS])
@pytest.mark.parametrize("k", [1, 5, 500])
def test_k_nearest(tables, spark, pairs, k):
    _, pts, _, points = tables
    some = [p for p in pts if p[1] % 3 == 0] + [(1, 900 + i, 10.0, 10.0) for i in range(4)]  # ties
    right = spark.createDataFrame([(d, i, x, y) for d, i, x, y in some], "drawing_id bigint, rid bigint, rx double, ry double")
    got = sorted((r.drawing_id, r.id, r["rank"], r.rid, round(r.dist, 6)) for r in joins.k_nearest(points, right, k, pairs=pairs).collect())
    want = []
    for d, i, x, y in pts:
        best = sorted((math.hypot(q[2] - x, q[3] - y), q[1]) for q in some if q[0] == d)[:k]
        want += [(d, i, n + 1, j, round(v, 6)) for n, (v, j) in enumerate(best)]
    assert got == sorted(want)


def test_boxes_of_all_lengths_meet(tables):
    lines, _, segments, _ = tables
    box = lambda s: (min(s[2], s[4]), max(s[2], s[4]), min(s[3], s[5]), max(s[3], s[5]))
    meet = lambda a, b: a[1] >= b[0] - 1e-6 and b[1] >= a[0] - 1e-6 and a[3] >= b[2] - 1e-6 and b[3] >= a[2] - 1e-6
    got = joins.box_pairs(segments, 20.0).select("drawing_id", "seg_id_a", "seg_id_b").collect()
    want = [(a[0], a[1], b[1]) for a in lines for b in lines if a[0] == b[0] and a[1] < b[1] and meet(box(a), box(b))]
    assert sorted(map(tuple, got)) == sorted(want)


def test_long_lines_cost_few_rows(spark):
    short = spark.range(2000).select(F.lit(1).cast("bigint").alias("drawing_id"), F.col("id").alias("seg_id"), (F.col("id") * 7 % 997).cast("double").alias("x1"), (F.col("id") * 31 % 883).cast("double").alias("y1"))
    short = short.withColumn("x2", F.col("x1") + 6).withColumn("y2", F.col("y1") + 3).withColumn("layer", F.lit("0"))
    both = short.unionByName(spark.createDataFrame([(1, 9999, -5e5, -5e5, 5e5, 5e5, "0")], SEG))
    pairs = joins.box_pairs(both, 20.0)
    assert pairs.where("seg_id_b = 9999").count() == 2000
    crossing = {r.seg_a for r in quality.crossings(both).where("seg_b = 9999").collect()}
    side = lambda x, y: x - y
    assert crossing == {r.seg_id for r in short.collect() if side(r.x1, r.y1) * side(r.x2, r.y2) < 0}
    assert joins.walked(both.where("seg_id = 9999"), F.lit(1000.0)).count() < 4000


# small drawings


def panels(seed):
    """Drawings with rings that share corners, open lines, near misses and, in every other one, a mirror axis that is not upright."""
    r, out = random.Random(seed), []
    for d in range(6):
        turn, off = (0.3 if d % 2 else 0.0), (0.0 if d % 3 else 1.5)
        spots = [(0, 0, 300, 200), (20, 20, 40, 30), (240 - off, 20, 40, 30), (20, 150, 40, 30), (240, 150 + off, 40, 30), (130, 80, 40, 40)]
        lines = []
        for x, y, w, h in spots:
            c = [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]
            lines += [(*p, *q) for p, q in zip(c, c[1:] + c[:1])]
        lines += [(60.0, 35.0, 90.0 + r.random(), 35.05), (300.04, 100, 320, 100)] if d > 3 else []
        spin = lambda x, y: (x * math.cos(turn) - y * math.sin(turn), x * math.sin(turn) + y * math.cos(turn))  # noqa: B023, E731
        out += [(d, k, *spin(*s[:2]), *spin(*s[2:]), "0") for k, s in enumerate(lines)]
    return out


def test_small_drawings_give_the_same_rows(spark):
    df = spark.createDataFrame(panels(1), SEG)
    arcs = spark.createDataFrame([(0, 0, 150.0, 100.0, 9.0, 0.0, 3.0, True, "0")], "drawing_id bigint, arc_id bigint, cx double, cy double, r double, a0 double, a1 double, is_ccw boolean, layer string")
    one, other = flows.Drawing(df, arcs=arcs), flows.Drawing(df, arcs=arcs, small=0)
    assert one.large is None and other.large.count() == 6
    rows = lambda t, *c: sorted(tuple(round(v, 5) if isinstance(v, float) else v for v in r) for r in t.select(*c).collect())
    for name, columns in (("nodes", ("drawing_id", "node_id", "x", "y", "degree")), ("edges", ("drawing_id", "seg_id", "u", "v", "length", "layer")), ("loops", ("drawing_id", "loop_id", "n", "area", "x", "y", "rank"))):
        assert rows(getattr(one, name), *columns) == rows(getattr(other, name), *columns)
    shape = ("drawing_id", "n", *(F.round(c, 4) for c in ("mean", "rms", "max", "p90", "matched", "score")))
    assert rows(one.best, *shape) == rows(other.best, *shape)
    assert rows(one.second, *shape) == rows(other.second, *shape)
    mixed = flows.Drawing(df, arcs=arcs, small=12 * 24)  # some of both kinds
    assert 0 < mixed.large.count() < 6
    assert rows(mixed.best, *shape) == rows(one.best, *shape) and rows(mixed.loops, "drawing_id", "loop_id", "area") == rows(one.loops, "drawing_id", "loop_id", "area")


def test_kept_neighbours_are_exact():
    r = np.random.default_rng(2)
    p = np.unique(np.concatenate([r.uniform(0, 100, (300, 2)), np.repeat(r.uniform(0, 100, (5, 2)), 4, 0)]), axis=0)
    near = symmetry.Nearest(p)
    start = r.uniform(-5, 105, (200, 2))
    images = small.Images(near, start)
    for size in (0.0, 0.1, 1.0, 5.0, 40.0, 0.2):
        m = start + r.normal(0, size + 1e-12, start.shape)
        want = np.sqrt(((m[:, None] - p[None]) ** 2).sum(2)).min(1)
        assert np.abs(images.distance(m) - want).max() < 1e-6


def test_clusters_of_ends():
    ids, xy = np.array([7, 3, 9, 4, 12]), np.array([[0, 0], [0, 0.08], [5, 5], [0, 0.16], [5, 5]])
    assert small.clustered(ids, xy.astype(float), 0.1).tolist() == [3, 3, 9, 3, 9]
    assert topology.cycle_basis([]) == [] and small.graph_of(np.array([0]), np.array([[0.0, 0, 1, 0]]), 0.1)[2] == []


# lines of like directions, rings in rings


@pytest.fixture(scope="module")
def slats(spark):
    """Slats of some angles, spaced and in line, leaning by a degree or two; some across the half turn, one without length."""
    r, out = random.Random(8), []
    for d in (1, 2):
        for k in range(120):
            t, s, n = math.radians(r.choice([0.2, 179.5, 30, 31.5, 90, 135]) + r.choice([0.05, 1.4]) * r.uniform(-1, 1)), r.choice([0, 300, 610]), r.choice([40, 200])
            across = r.choice([0, 0.1, 8, 25, 60, 300])
            x, y = s * math.cos(t) - across * math.sin(t), s * math.sin(t) + across * math.cos(t)
            out.append((d, k, x, y, x + n * math.cos(t), y + n * math.sin(t), "0"))
        out.append((d, 500, 5.0, 5.0, 5.0, 5.0, "0"))
    return spark.createDataFrame(out, SEG)


def test_like_directions_of_large_drawings(slats):
    from plansheet.operators import features

    lines = features.line_features(slats)
    rows = lambda df: sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.collect())
    for make in (features.parallel_pairs, features.collinear_pairs):
        want = rows(make(lines))
        assert len(want) > 100 and rows(make(lines, pairs=0)) == want


def test_slats_of_one_angle_meet_their_neighbours_alone(spark):
    from plansheet.operators import features, joins

    k = F.col("id")
    df = spark.range(3000).select(F.lit(1).cast("bigint").alias("drawing_id"), k.alias("seg_id"), (-7.0 * k).alias("x1"), (7.0 * k).alias("y1"), (-7.0 * k + 900).alias("x2"), (7.0 * k + 900).alias("y2"), F.lit("0").alias("layer"))
    gap = 7 * math.sqrt(2)
    assert features.parallel_pairs(features.line_features(df)).count() == sum(3000 - j for j in range(1, 10) if 4 <= j * gap <= 35)


def test_depths_of_rings(spark):
    r, rings = random.Random(6), []
    for d in (1, 2):
        for k in range(60):
            x, y, w = r.uniform(0, 500), r.uniform(0, 500), r.choice([2, 10, 60, 300, 5000])
            rings.append((d, k, [{"x": x, "y": y}, {"x": x + w, "y": y}, {"x": x + w * 1.1, "y": y + w}, {"x": x, "y": y + w}]))
    loops = topology.ranked_loops(spark.createDataFrame(rings, "drawing_id bigint, loop_id bigint, pts array<struct<x:double,y:double>>")).cache()
    rows, want = loops.collect(), {}
    held = lambda p, x, y: sum((a.y > y) != (b.y > y) and x < (b.x - a.x) * (y - a.y) / (b.y - a.y) + a.x for a, b in zip(p, [*p[1:], p[0]])) % 2 == 1
    for a in rows:
        want[a.drawing_id, a.loop_id] = sum(b.drawing_id == a.drawing_id and b["rank"] < a["rank"] and held(b.pts, a.x, a.y) for b in rows)
    assert {(g.drawing_id, g.loop_id): g.depth for g in topology.containment(loops).collect()} == want and max(want.values()) > 5


def test_a_centre_on_an_edge_is_not_inside(spark, tmp_path):
    from plansheet.plans import catalog

    # a centre is a balance by 500 and all squares are 20 to each side, so that some centres are on edges of others
    rows = [(19, 0.0), (119, 500.0 * 20), (219, -500.0 * 20), (319, 4516.95), (419, 4516.95 + 500 * 20), (519, 4516.95 - 500 * 20), (619, 7056.35), (719, 7056.35 - 10_000.0)]
    spark.createDataFrame(rows, "c_custkey bigint, c_acctbal double").write.parquet(f"{tmp_path}/customer.parquet")
    con = duckdb.connect()
    con.sql(f"create view customer as select * from '{tmp_path}/customer.parquet/*.parquet'")
    for name in ("joi18_containment", "rep14_winding"):
        got = catalog.QUERIES[name](spark, str(tmp_path))
        want = con.sql(f"select {', '.join(got.columns)} from ({catalog.ORACLE_SQL[name]})").fetchall()
        assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) == len(rows)
