"""Geometry on literal fixtures."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plansheet.functions import scalar as S
from plansheet.operators import curves, features, joins, quality, repair, symmetry, topology
from plansheet.plans import flows

SEG = "drawing_id bigint, seg_id bigint, x1 double, y1 double, x2 double, y2 double, layer string"


def lit(*v):
    return tuple(F.lit(float(x)) for x in v)


@pytest.fixture(scope="module")
def value(spark):
    one = spark.range(1)
    return lambda c: one.select(c.alias("v")).first()["v"]


def ring_segments(*rings, drawing=1):
    out = []
    for ring in rings:
        out += [(drawing, len(out) + k, *map(float, (*p, *q)), "0") for k, (p, q) in enumerate(zip(ring, ring[1:] + ring[:1]))]
    return out


def square(x, y, n, h=None):
    h = n if h is None else h
    return [(x, y), (x + n, y), (x + n, y + h), (x, y + h)]


def pts(ring):
    return F.array(*(S.point(*lit(*p)) for p in ring))


def close(a, b, tol=1e-9):
    return all(abs(x - y) <= tol for x, y in zip(a, b, strict=True))


def test_points_segments_and_arcs(value):
    assert value(S.distance(*lit(10, 20, 13, 24))) == 5 and value(S.distance_squared(*lit(10, 20, 13, 24))) == 25
    assert close(value(S.normalized(*lit(3, 4))), (0.6, 0.8)) and value(S.dot(*lit(3, 4, -4, 3))) == 0
    assert abs(value(S.angle_between(*lit(3, 4, -4, 3))) - math.pi / 2) < 1e-12
    assert value(S.point_segment_distance(*lit(0, 0, 100, 0, 50, 10))) == 10 == value(S.point_segment_distance(*lit(0, 0, 100, 0, -10, 0)))
    quarter = (*lit(50, 50, 20, 0, math.pi / 2), F.lit(True))
    assert abs(value(20 * S.sweep(*lit(0, math.pi / 2), F.lit(True))) - 10 * math.pi) < 1e-9
    assert close(value(S.arc_point(*quarter, F.lit(0.0))), (70, 50)) and close(value(S.arc_point(*quarter, F.lit(1.0))), (50, 70))
    assert close(value(S.arc_through(*lit(10, 0, 0, 10, -10, 0)))[:3], (0, 0, 10)) and value(S.arc_through(*lit(0, 0, 1, 1, 2, 2))) is None
    half = value(S.bulge_to_arc(*lit(0, 0, 20, 0, 1)))
    assert close((half["cx"], half["cy"], half["r"]), (10, 0, 10)) and half["is_ccw"]
    assert abs(value(S.arc_to_bulge(*lit(0, 0, 20, 0, 10, 0), F.lit(True))) - 1) < 1e-6
    assert value(S.intersection(lit(0, 0, 10, 10), lit(0, 10, 10, 0)))["x"] == 5 and value(S.intersection(lit(0, 0, 1, 0), lit(0, 1, 1, 1))) is None
    assert value(S.sweep(*lit(1, 1), F.lit(True))) == 0


def test_reflections_and_maps(value):
    assert tuple(value(S.reflect(S.vertical_axis(F.lit(100.0)), *lit(80, 50)))) == (120, 50)
    assert tuple(value(S.reflect(S.horizontal_axis(F.lit(50.0)), *lit(30, 40)))) == (30, 60)
    assert close(value(S.reflect(S.axis(*lit(0, 0, math.pi / 4)), *lit(10, 30))), (30, 10))
    assert tuple(value(S.apply_affine(S.translation(*lit(10, 20)), *lit(5, 5)))) == (15, 25)
    assert close(value(S.apply_affine(S.rotation(*lit(math.pi / 2, 0, 0)), *lit(1, 0))), (0, 1))
    verts = F.array(*(F.struct(*(F.lit(float(v)).alias(n) for v, n in zip(p, ("x", "y", "bulge")))) for p in ((0, 0, 0.5), (20, 0, 0), (20, 20, 0))))
    assert [tuple(v) for v in value(S.reflect_polyline(S.vertical_axis(F.lit(50.0)), verts))] == [(100, 0, -0.5), (80, 0, 0), (80, 20, 0)]
    assert [tuple(v) for v in value(S.reflect_polyline(S.vertical_axis(F.lit(50.0)), verts, True))] == [(80, 20, 0), (80, 0, 0.5), (100, 0, 0)]


def test_rings(value):
    ring = pts([(0, 0), (100, 0), (100, 50), (0, 50)])
    assert value(S.signed_area(ring)) == 5000 and value(S.signed_area(F.reverse(ring))) == -5000
    assert tuple(value(S.ring_centroid(ring))) == (50, 25) and value(S.ring_perimeter(ring)) == 300
    assert value(S.ring_contains(ring, *lit(10, 10))) and not value(S.ring_contains(ring, *lit(110, 10)))
    tilted = value(repair.regularize_ring(pts([(0, 0), (100, 1.5), (100, 100), (0, 98.5)])))
    assert [tuple(p) for p in tilted] == [(0, 0.75), (100, 0.75), (100, 99.25), (0, 99.25)]
    assert close([c for p in value(repair.symmetrized(pts([(0, 0), (10, 0), (11, 10), (0, 10)]), cx=F.lit(5.0))) for c in p], [0, 0, 10, 0, 10.5, 10, -0.5, 10])


def test_curves():
    sine = list(curves.approximate(lambda t: (100 * t, 20 * math.sin(2 * math.pi * t)), 0, 1, 0.02))
    assert len(sine) > 2 and all(close(a[3:5], b[1:3], 1e-9) for a, b in zip(sine, sine[1:]))
    whole = list(curves.approximate(curves.ellipse(0, 0, 50, 0, 0.5), 0, math.tau, 0.02))
    assert len(whole) >= 4 and max(math.dist(a[3:5], b[1:3]) for a, b in zip(whole, whole[1:])) < 1e-3
    line = curves.spline([(0, 0), (1, 2), (3, 1), (4, 4)], [0, 0, 0, 0, 1, 1, 1, 1], 3)
    assert close(line(0.5), [(0 + 3 * a + 3 * b + c) / 8 for a, b, c in ((1, 3, 4), (2, 1, 4))])


def test_continuity(spark):
    df = spark.createDataFrame([(1, 0, 0.0, 0.0, 50.0, 1.745, "0"), (1, 1, 0.0, 0.0, 50.0, 50.0, "0")], SEG)
    out = {r["seg_id"]: (r["x2"], r["y2"]) for r in curves.square_lines(df, S.vertical_axis(F.lit(50.0))).collect()}
    assert out == {0: (50.0, 0.0), 1: (50.0, 50.0)}


def test_topology(spark):
    rows = ring_segments(square(0, 0, 100, 50)) + [(2, k, *r[2:]) for k, r in enumerate(ring_segments(square(0, 0, 50, 25)))]
    rows[5] = (2, 1, 50.02, 0.01, 50.0, 25.0, "0")
    df = spark.createDataFrame(rows, SEG)
    nodes, edges = topology.build_graph(df, 0.05)
    summary = {r["drawing_id"]: (r["n_nodes"], r["n_edges"], r["is_watertight"]) for r in topology.graph_summary(nodes, edges).collect()}
    assert summary == {1: (4, 4, True), 2: (4, 4, True)}
    loop = {r["drawing_id"]: r for r in topology.closed_loops(nodes, edges).collect()}
    assert (loop[1]["area"], loop[1]["x"], loop[1]["y"], loop[1]["perimeter"], loop[1]["rank"]) == (5000, 50, 25, 300, 0) and len(loop) == 2


def test_cycle_basis_counts():
    r = random.Random(1)
    for _ in range(30):
        n = r.randint(3, 12)
        edges = {tuple(sorted(r.sample(range(n), 2))) for _ in range(r.randint(2, 20))}
        seen, parts = {}, 0
        for v in {v for e in edges for v in e}:
            if v not in seen:
                parts += 1
                todo = [v]
                while todo:
                    u = todo.pop()
                    if u not in seen:
                        seen[u] = parts
                        todo += [b for a, b in (*edges, *((y, x) for x, y in edges)) if a == u]
        basis = topology.cycle_basis(list(edges))
        assert len(basis) == len(edges) - len(seen) + parts
        for c in basis:
            assert len(c) >= 3 and len(set(c)) == len(c) and all(tuple(sorted(e)) in edges for e in zip(c, c[1:] + c[:1]))


def test_winding(spark):
    loops = [(1, 0, [(0.0, 0.0), (0.0, 100.0), (100.0, 100.0), (100.0, 0.0)]), (1, 1, [(20.0, 20.0), (80.0, 20.0), (80.0, 80.0), (20.0, 80.0)])]
    df = spark.createDataFrame(loops, "drawing_id bigint, loop_id bigint, pts array<struct<x:double,y:double>>")
    out = {r["loop_id"]: (r["depth"], r["is_ccw"]) for r in topology.normalize_winding(topology.ranked_loops(df)).collect()}
    assert out == {0: (0, True), 1: (1, False)}


def test_weld_and_tabs(spark):
    base = ring_segments(square(0, 0, 100))
    near = [*base[:3], (1, 3, 0.0, 100.0, 0.0, 0.02, "0")]
    tab = [*base[:3], (1, 3, 0.0, 100.0, 0.0, 1.2, "0")]
    out = {r["seg_id"]: (r["x2"], r["y2"]) for r in repair.weld(spark.createDataFrame(near, SEG)).collect()}
    assert close(out[3], (0, 0.01))
    df = spark.createDataFrame(tab, SEG)
    assert [round(r["dist"], 6) for r in repair.holding_tabs(df).collect()] == [1.2]
    assert {r["seg_id"]: r["y2"] for r in repair.weld(df).collect()}[3] == 1.2


def test_nearest_is_exact(spark):
    g = np.random.default_rng(3)
    left, right = np.vstack([g.normal(size=(150, 2)) * 50, [[900.0, -700.0]]]), np.vstack([g.normal(size=(200, 2)) * 3, g.uniform(-200, 200, (30, 2))])
    a = spark.createDataFrame([(1, k, *map(float, p)) for k, p in enumerate(left)] + [(2, 999, 0.0, 0.0)], "drawing_id bigint, id bigint, x double, y double")
    b = spark.createDataFrame([(1, k, *map(float, p)) for k, p in enumerate(right)], "drawing_id bigint, rid bigint, rx double, ry double")
    d = np.sqrt(((left[:, None] - right[None]) ** 2).sum(2))
    got = {r["id"]: (r["rid"], r["dist"]) for r in joins.nearest(a, b).collect()}
    assert all(got[k][0] == int(d[k].argmin()) and abs(got[k][1] - d[k].min()) < 1e-9 for k in range(len(left)))
    assert got[999] == (None, math.inf)


@pytest.mark.parametrize("small", [4096, 10])
def test_symmetry_of_random_points(spark, monkeypatch, small):
    monkeypatch.setattr(symmetry, "SMALL", small)
    g = np.random.default_rng(23).normal(size=(300, 2)) * 100
    df = spark.createDataFrame([(1, k, *map(float, p)) for k, p in enumerate(g)], "drawing_id bigint, id bigint, x double, y double")
    axes = df.select("drawing_id").distinct().select("drawing_id", F.explode(F.array(*(F.struct(F.lit(k).cast("bigint").alias("axis_id"), S.axis(*lit(17, -31, a)).alias("a")) for k, a in enumerate((0, math.pi / 2, 0.237, 2.8))))).alias("h")).select("drawing_id", "h.*")
    devs = {(r["axis_id"], r["id"]): r["dev"] for r in symmetry.deviations(df, axes).collect()}
    for k, a in enumerate((0, math.pi / 2, 0.237, 2.8)):
        d = np.array([math.cos(a), math.sin(a)])
        o = np.array([17, -31])
        image = 2 * (o + ((g - o) @ d)[:, None] * d) - g
        want = np.sqrt(((image[:, None] - g[None]) ** 2).sum(2).min(1))
        assert max(abs(devs[k, i] - want[i]) for i in range(300)) < 1e-9


@pytest.mark.parametrize(("order", "mirrored", "group"), [(4, False, ("C4", "D4")), (6, True, ("D6",))])
def test_rotation(spark, order, mirrored, group):
    petal = [((10, 0), (30, 10)), ((30, 10), (40, 0)), ((40, 0), (10, 0))]
    if mirrored:
        petal += [((x1, -y1), (x2, -y2)) for (x1, y1), (x2, y2) in petal]
    rows = []
    for k in range(order):
        c, s = math.cos(2 * math.pi * k / order), math.sin(2 * math.pi * k / order)
        rows += [(1, len(rows) + i, *(v for x, y in e for v in (c * x - s * y, s * x + c * y)), "0") for i, e in enumerate(petal)]
    out = symmetry.rotational(flows.sampled(spark.createDataFrame(rows, SEG), 8)).first()
    assert out["symmetry_group"] in group and out["confidence"] > 0.9


def test_spacing_of_slats(spark):
    rows = [(1, k, 0.0, y, 100.0, y, "0") for k, y in enumerate((0.0, 16.5, 33.1, 49.5, 71.5))]
    lines = features.line_features(spark.createDataFrame(rows, SEG))
    gaps = sorted(round(r["gap"], 3) for r in features.parallel_pairs(lines).collect())
    assert gaps == [16.4, 16.5, 16.6, 22.0, 33.0, 33.1]
    assert abs(features.spacing_clusters(features.parallel_pairs(lines)).first()["spacing"] - 16.5) <= 0.5


def test_open_and_doubled_lines_are_invalid(spark):
    rows = ring_segments(square(0, 0, 100))[:3]
    rows.append((1, 3, 100.0, 0.0, 0.0, 0.0, "0"))
    v = flows.Drawing(spark.createDataFrame(rows, SEG)).validate().first()
    assert not v["is_watertight"] and v["n_duplicates"] == 1 and not v["is_valid"] and "DUPLICATE_LINES" in v["errors"]


def test_crossings_and_kinks(spark):
    df = spark.createDataFrame([(1, 0, 0.0, 0.0, 100.0, 100.0, "0"), (1, 1, 0.0, 100.0, 100.0, 0.0, "0"), (1, 2, 100.0, 0.0, 150.0, 0.0, "0")], SEG)
    assert [(r["x"], r["y"]) for r in quality.crossings(df).collect()] == [(50.0, 50.0)]
    kinked = spark.createDataFrame(ring_segments([(0, 0), (100, 2), (200, 0), (200, 100), (0, 100)]), SEG)
    assert features.kinks(features.corners(*topology.build_graph(kinked))).count() == 1


def test_change_ratio(spark):
    bars = [(1, i, float(i), 0.0, float(i), 2.0, "0") for i in range(100)]
    df = spark.createDataFrame(bars, SEG)
    turned = df.select("drawing_id", "seg_id", F.col("x2").alias("x1"), F.col("y2").alias("y1"), F.col("x1").alias("x2"), F.col("y1").alias("y2"), "layer")
    change = lambda b: repair.change_ratio(df, b).first()["change"]
    assert change(turned) == 0 and change(df.limit(0)) == 100 and change(df.where("seg_id < 50")) > 0


def test_perfect_panel(spark):
    panel = ring_segments(square(0, 0, 500), square(20, 20, 50), square(430, 20, 50), square(20, 430, 50), square(430, 430, 50))
    d = flows.Drawing(spark.createDataFrame(panel, SEG))
    a, q = d.analyze().first(), d.quality().first()
    assert a["score"] >= 99 and a["classification"] == "PERFECT_SYMMETRIC" and a["n_pairs"] >= 3
    assert q["quality"] >= 90 and q["deformation"] == 0 and q["verdict"] == "AUTO_ACCEPT"


@pytest.fixture(scope="module")
def customers(spark, tmp_path_factory):
    """A folder with a table of seven customers."""
    d = str(tmp_path_factory.mktemp("customers"))
    spark.range(1, 8).select(F.col("id").alias("c_custkey")).write.parquet(f"{d}/customer.parquet")
    return d


def test_analysis_covers_every_customer(spark, customers):
    from plansheet.plans import work

    out = {r["drawing_id"]: r["n_loops"] for r in work.QUERIES["orc1_symmetry_analysis"](spark, customers).collect()}
    assert {int(k): n for k, n in out.items()} == dict.fromkeys(range(1, 8), 6)


def test_reports_and_candidates_read_every_panel(spark, customers, monkeypatch):
    from plansheet.plans import work

    class Stop(Exception):
        pass

    def read(segments, arcs, circles):
        ids.extend({r[0] for r in df.select("drawing_id").distinct().collect()} for df in (segments, arcs, circles))
        raise Stop

    for name in ("candidates", "recommend", "Drawing"):
        monkeypatch.setattr(work.flows, name, read)
    for name in ("orc2_full_report", "orc3_candidates", "orc4_recommendation"):
        ids = []
        with pytest.raises(Stop):
            work.QUERIES[name](spark, customers)
        assert ids == [set(range(1, 8))] * 3


def test_components_and_loops_of_small_and_large_drawings(spark):
    import random

    from plansheet.operators.graph import components
    from plansheet.operators.topology import build_graph, closed_loops

    r = random.Random(4)
    edges = [(d, r.randrange(40), r.randrange(40)) for d in (1, 2) for _ in range(25)]
    df = spark.createDataFrame(edges, "drawing_id bigint, u bigint, v bigint")
    want = {}
    for d in (1, 2):
        low = {n: n for e in edges if e[0] == d for n in e[1:]}
        for _ in low:
            for _, u, v in (e for e in edges if e[0] == d):
                low[u] = low[v] = min(low[u], low[v])
        want |= {(d, n): m for n, m in low.items() if n != m}
    for small in (4096, 0):
        assert {(x["drawing_id"], x["node"]): x["root"] for x in components(df, small=small).collect()} == want
    boxes = [(0, 0, 10), (20, 0, 5), (10, 10, 4)]  # the third meets a corner of the first
    lines = [(1, 4 * k + i, *map(float, a), *map(float, b), "0") for k, (x, y, w) in enumerate(boxes) for i, (a, b) in enumerate((((x, y), (x + w, y)), ((x + w, y), (x + w, y + w)), ((x + w, y + w), (x, y + w)), ((x, y + w), (x, y))))]
    graph = build_graph(spark.createDataFrame(lines, "drawing_id bigint, seg_id bigint, x1 double, y1 double, x2 double, y2 double, layer string"))
    one, two = ([(x["rank"], round(x["area"], 6), x["n"]) for x in closed_loops(*graph, small=k).orderBy("rank").collect()] for k in (4096, 0))
    assert one == two == [(0, 100.0, 4), (1, 25.0, 4), (2, 16.0, 4)]


def test_arcs_and_circles_count_for_symmetry_and_size(spark):
    from plansheet.plans.flows import Drawing

    square = [(d, i, *p, "0") for d in (1, 2) for i, p in enumerate(((0.0, 0.0, 100.0, 0.0), (100.0, 0.0, 100.0, 100.0), (100.0, 100.0, 0.0, 100.0), (0.0, 100.0, 0.0, 0.0)))]
    segments = spark.createDataFrame(square, "drawing_id bigint, seg_id bigint, x1 double, y1 double, x2 double, y2 double, layer string")
    arcs = spark.createDataFrame([(1, 0, 50.0, 100.0, 20.0, 0.0, 3.141592653589793, True, "0"), (2, 0, 80.0, 100.0, 20.0, 0.0, 2.0, True, "0")], "drawing_id bigint, arc_id bigint, cx double, cy double, r double, a0 double, a1 double, is_ccw boolean, layer string")
    circles = spark.createDataFrame([(1, 0, 50.0, 30.0, 10.0, "0"), (2, 0, 20.0, 30.0, 10.0, "0")], "drawing_id bigint, circle_id bigint, cx double, cy double, r double, layer string")
    g = Drawing(segments, arcs=arcs, circles=circles)
    got = {x["drawing_id"]: x for x in g.analyze().collect()}
    assert got[1]["score"] > 99.9 and abs(abs(got[1]["a"]["dy"]) - 1) < 1e-6 and abs(got[1]["a"]["ox"] - 50) < 1e-3
    assert got[2]["score"] < 90
    assert {x["drawing_id"]: round(x["b"]["max_y"], 6) for x in g.boxes.collect()}[1] >= 119.9


def test_curve_pieces_cover_every_arc(spark, tmp_path):
    from plansheet.plans import geometry

    spark.range(1, 31).selectExpr("id as o_orderkey", "id % 4 as o_custkey", "1000e0 * id as o_totalprice").write.parquet(f"{tmp_path}/orders.parquet")
    out = geometry.QUERIES["gen8_curve_pieces"](spark, str(tmp_path)).collect()
    assert {r["ent_id"] for r in out} == set(range(1, 31))
