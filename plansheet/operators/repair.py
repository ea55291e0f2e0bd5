"""Repair: rings made symmetric, mirrored and squared, lines deduplicated and welded, and candidates ranked.

Loops are rows (drawing_id, loop_id, pts and measures); a repair is a projection of rings and an explode of mirror images.
Only choices that depend on the order of rows (greedy pairing, dedupe, welding) are kernels, over pairs of ids or points
that a grid join has found.
"""

from __future__ import annotations

import math
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plansheet.functions import scalar as S
from plansheet.operators.generate import ring_edges
from plansheet.operators import small
from plansheet.operators.graph import components
from plansheet.operators.joins import large_keys, nearest_one, nearest_segment, range_join
from plansheet.operators.quality import duplicate_pairs
from plansheet.operators.tables import each_group, grouped_rows, stored, together
from plansheet.operators.topology import endpoints, ranked_loops

SEG = ("x1", "y1", "x2", "y2")
RING = "array<struct<x:double,y:double>>"


# rings


def regularize_ring(pts: Column, tol: float = 4.0) -> Column:
    """Edges within tol degrees of level, upright or diagonal made so, in order, each seeing what earlier ones moved."""
    n = F.size(pts)

    def edge(ring: Column, i: Column) -> Column:
        both = F.struct(F.get(ring, i).alias("p"), F.get(ring, (i + 1) % n).alias("q"))
        return S.let(both, lambda e: moved(ring, i, e["p"], e["q"]))

    def moved(ring: Column, i: Column, p: Column, q: Column) -> Column:
        dx, dy = q["x"] - p["x"], q["y"] - p["y"]
        sx, sy = F.when(dx >= 0, 1.0).otherwise(-1.0), F.when(dy >= 0, 1.0).otherwise(-1.0)
        mx, my, half = (p["x"] + q["x"]) / 2, (p["y"] + q["y"]) / 2, (F.abs(dx) + F.abs(dy)) / 4

        def ends(a: Column) -> Column:
            """The edge's two ends after the rule that its angle falls under."""
            level, upright, slant = (a < tol) | (a > 180.0 - tol), F.abs(a - 90.0) < tol, (F.abs(a - 45.0) < tol) | (F.abs(a - 135.0) < tol)
            pair = lambda z, w: F.array(z, w)
            return F.when(level, pair(S.point(p["x"], my), S.point(q["x"], my))).when(upright, pair(S.point(mx, p["y"]), S.point(mx, q["y"]))).when(slant, pair(S.point(mx - sx * half, my - sy * half), S.point(mx + sx * half, my + sy * half))).otherwise(pair(p, q))

        new = F.when(S.norm(dx, dy) < 1e-4, F.array(p, q)).otherwise(S.let(S.line_angle(dx, dy), ends))
        return S.let(new, lambda e: F.transform(ring, lambda z, j: F.when(j == i, F.get(e, F.lit(0))).when(j == (i + 1) % n, F.get(e, F.lit(1))).otherwise(z)))

    return F.when(n < 3, pts).otherwise(F.aggregate(F.sequence(F.lit(0), n - 1), pts, edge))


def regularized(rings: DataFrame, tol: float = 4.0) -> DataFrame:
    """Rings with regularize_ring applied."""
    return rings.withColumn("pts", S.let(F.col("pts"), lambda p: regularize_ring(p, tol)))


def regularize_lines(segments: DataFrame, tol: float = 4.0) -> DataFrame:
    """Lines turned about their middle to the nearest of the four directions within tol, short ones dropped."""
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    n, a = S.norm(dx, dy), S.line_angle(dx, dy)
    near = F.array_min(F.array(*(F.struct(F.abs(a - t).alias("d"), F.lit(t % 180.0).alias("t")) for t in (0.0, 45.0, 90.0, 135.0, 180.0))))
    turn = (near["d"] <= tol) & (near["d"] > 1e-3)
    t = F.radians(near["t"])
    mx, my = (F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2
    new = {"x1": mx - n / 2 * F.cos(t), "y1": my - n / 2 * F.sin(t), "x2": mx + n / 2 * F.cos(t), "y2": my + n / 2 * F.sin(t)}
    return segments.where(n >= 1e-4).select(*(F.when(turn, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in segments.columns))


def _nearest_mirror(pts: Column, mirror, key: str) -> Column:
    """Each point's coordinate `key` averaged with that of the nearest mirrored point (the first on ties)."""
    def one(p: Column) -> Column:
        best = F.array_min(F.transform(pts, lambda q, j: F.struct(S.distance_squared(p["x"], p["y"], mirror(q)["x"], mirror(q)["y"]).alias("d"), j.alias("j"))))
        value = (p[key] + mirror(F.get(pts, best["j"]))[key]) / 2
        return S.point(value, p["y"]) if key == "x" else S.point(p["x"], value)

    return F.transform(pts, one)


def mirror_x(pts: Column, cx: Column) -> Column:
    return F.transform(pts, lambda p: S.point(2.0 * cx - p["x"], p["y"]))


def mirror_y(pts: Column, cy: Column) -> Column:
    return F.transform(pts, lambda p: S.point(p["x"], 2.0 * cy - p["y"]))


def mirror_axis(pts: Column, axis: Column) -> Column:
    return F.transform(pts, lambda p: S.reflect(axis, p["x"], p["y"]))


def shift(pts: Column, dx: Column, dy: Column) -> Column:
    return F.transform(pts, lambda p: S.point(p["x"] + dx, p["y"] + dy))


def symmetrized(pts: Column, cx: Column | None = None, cy: Column | None = None) -> Column:
    """A ring made symmetric about x = cx, then about y = cy."""
    if cx is not None:
        pts = S.let(pts, lambda v: _nearest_mirror(v, lambda q: S.point(2.0 * cx - q["x"], q["y"]), "x"))
    if cy is not None:
        pts = S.let(pts, lambda v: _nearest_mirror(v, lambda q: S.point(q["x"], 2.0 * cy - q["y"]), "y"))
    return pts


def symmetrized_about(pts: Column, x: Column, y: Column, axis: Column) -> Column:
    """A ring with centroid (x, y) moved onto an axis, each point averaged with the nearest mirrored one."""
    p = S.project_on_axis(axis, x, y)
    def averaged(moved: Column, mirror: Column) -> Column:
        def one(z: Column) -> Column:
            best = F.array_min(F.transform(mirror, lambda q, j: F.struct(S.distance_squared(z["x"], z["y"], q["x"], q["y"]).alias("d"), j.alias("j"))))
            return S.let(F.get(mirror, best["j"]), lambda m: S.point((z["x"] + m["x"]) / 2, (z["y"] + m["y"]) / 2))

        return F.transform(moved, one)

    return S.let(shift(pts, p["x"] - x, p["y"] - y), lambda v: S.let(mirror_axis(v, axis), lambda m: averaged(v, m)))


# strategies: each takes ranked loops and boxes (drawing_id, b), and gives rings (drawing_id, part, pts)


def _motifs(loops: DataFrame, boxes: DataFrame) -> DataFrame:
    m = S.box_of(F.col("box"))
    out = loops.where("rank > 0").join(boxes.select("drawing_id", F.col("b").alias("box")), "drawing_id")
    return out.withColumn("cx", m["center_x"]).withColumn("cy", m["center_y"]).withColumn("_x", (F.col("b.min_x") < F.col("cx") - 1.0) & (F.col("b.max_x") > F.col("cx") + 1.0)).withColumn("_y", (F.col("b.min_y") < F.col("cy") - 1.0) & (F.col("b.max_y") > F.col("cy") + 1.0))


def four_quadrants(loops: DataFrame, boxes: DataFrame) -> DataFrame:
    """Central rings centred and made symmetric both ways; those on one axis too, one half mirrored; the lower left quadrant's copied to all four."""
    x, y, cx, cy, pts = (F.col(c) for c in ("x", "y", "cx", "cy", "pts"))
    kind = F.when(F.col("_x") & F.col("_y"), "C").when(F.col("_x"), "V").when(F.col("_y"), "H").otherwise("Q")
    # how good a reference a ring is for its kind; only the best ones of a drawing are used
    grade = F.when(kind == "V", F.when(y < cy, 0).otherwise(1)).when(kind == "H", F.when(x < cx, 0).otherwise(1)).when(kind == "Q", F.when((x < cx) & (y < cy), 0).when(x < cx, 1).otherwise(2)).otherwise(0)
    m = _motifs(loops, boxes).withColumn("_kind", kind).withColumn("_grade", grade)
    m = m.withColumn("_best", F.min("_grade").over(Window.partitionBy("drawing_id", "_kind"))).where("_grade = _best")
    v, h = symmetrized(shift(pts, cx - x, F.lit(0.0)), cx=cx), symmetrized(shift(pts, F.lit(0.0), cy - y), cy=cy)
    rings = (
        F.when(F.col("_kind") == "C", F.array(symmetrized(shift(pts, cx - x, cy - y), cx, cy))).when(F.col("_kind") == "V", S.let(v, lambda r: F.array(r, mirror_y(r, cy))))
        .when(F.col("_kind") == "H", S.let(h, lambda r: F.array(r, mirror_x(r, cx)))).otherwise(F.array(pts, mirror_x(pts, cx), mirror_y(pts, cy), mirror_x(mirror_y(pts, cy), cx)))
    )
    return m.select("drawing_id", "loop_id", F.posexplode(rings).alias("part", "pts"))


def bilateral(loops: DataFrame, boxes: DataFrame, source: str = "left") -> DataFrame:
    """Rings across the middle made symmetric; those on the source side (left, right, bottom, top) kept and mirrored."""
    across = source in ("left", "right")
    m = _motifs(loops, boxes)
    at, c = (F.col("x"), F.col("cx")) if across else (F.col("y"), F.col("cy"))
    middle, own = F.col("_x" if across else "_y"), at <= c if source in ("left", "bottom") else at >= c
    pts, zero = F.col("pts"), F.lit(0.0)
    central = symmetrized(shift(pts, c - at, zero), cx=c) if across else symmetrized(shift(pts, zero, c - at), cy=c)
    image = mirror_x(pts, c) if across else mirror_y(pts, c)
    return m.where(middle | own).select("drawing_id", "loop_id", F.posexplode(F.when(middle, F.array(central)).otherwise(F.array(pts, image))).alias("part", "pts"))


def side_pairs(loops: DataFrame, axes: DataFrame, far: float = 40.0) -> DataFrame:
    """(drawing_id, loop_left, loop_right): each ring on the left takes the nearest free mirrored one on the right within far; nulls for the unpaired."""

    def pair(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank")
        left, right = pdf[pdf.mx > pdf.x], pdf[pdf.mx < pdf.x]
        free, out = dict(enumerate(right.loop_id.tolist())), []
        # what is within far of a point is in the nine cells around it, and what is nearest of all matters only within far
        cells: dict[tuple[int, int], list[tuple[int, float, float]]] = {}
        for k, (x, y) in enumerate(zip(right.x.tolist(), right.y.tolist())):
            cells.setdefault((math.floor(x / far), math.floor(y / far)), []).append((k, x, y))
        for loop_id, mx, my in zip(left.loop_id.tolist(), left.mx.tolist(), left.my.tolist()):
            cx, cy = math.floor(mx / far), math.floor(my / far)
            near = [(d, k, at) for i in (-1, 0, 1) for j in (-1, 0, 1) for at in [(cx + i, cy + j)] for k, x, y in cells.get(at, ()) if (d := (x - mx) ** 2 + (y - my) ** 2) < far * far]
            best = None
            if near:
                _, k, at = min(near)
                best = free.pop(k)
                cells[at] = [r for r in cells[at] if r[0] != k]
            out.append((loop_id, best))
        got = pd.DataFrame(out + [(None, k) for k in free.values()], columns=["loop_left", "loop_right"]).astype("Int64")
        got.insert(0, "drawing_id", pdf.drawing_id.iloc[0])
        return got

    c = S.reflect(F.col("a"), F.col("x"), F.col("y"))
    rows = loops.where("rank > 0").join(axes.select("drawing_id", "a"), "drawing_id").select("drawing_id", "loop_id", "rank", "x", "y", c["x"].alias("mx"), c["y"].alias("my"))
    kind, lid = (loops.schema[k].dataType.simpleString() for k in ("drawing_id", "loop_id"))
    return rows.groupBy("drawing_id").applyInPandas(pair, f"drawing_id {kind}, loop_left {lid}, loop_right {lid}")


def consensus(loops: DataFrame, axes: DataFrame, near: float = 10.0) -> DataFrame:
    """Pairs averaged corner by corner where they have as many, else the left one; the unpaired mirrored; rings near the axis made symmetric besides."""
    ring = loops.select("drawing_id", "loop_id", "pts")
    both = side_pairs(loops, axes).join(axes.select("drawing_id", "a"), "drawing_id")
    both = both.join(ring.toDF("drawing_id", "loop_left", "_l"), ["drawing_id", "loop_left"], "left").join(ring.toDF("drawing_id", "loop_right", "_r"), ["drawing_id", "loop_right"], "left")
    l, r, a = F.col("_l"), F.col("_r"), F.col("a")  # noqa: E741
    mean = F.zip_with(l, mirror_axis(r, a), lambda p, q: S.point((p["x"] + q["x"]) / 2, (p["y"] + q["y"]) / 2))
    one = F.when(l.isNull(), r).when(r.isNull() | (F.size(l) != F.size(r)), l).otherwise(mean)
    pairs = both.withColumn("_one", one).select("drawing_id", F.coalesce("loop_left", "loop_right").alias("loop_id"), F.posexplode(F.array(F.col("_one"), mirror_axis(F.col("_one"), a))).alias("part", "pts"))
    mid = loops.where("rank > 0").join(axes.select("drawing_id", "a"), "drawing_id").where(F.abs(S.signed_distance(a, F.col("x"), F.col("y"))) <= near)
    return pairs.unionByName(mid.select("drawing_id", "loop_id", F.lit(2).alias("part"), symmetrized_about(F.col("pts"), F.col("x"), F.col("y"), a).alias("pts")))


def boundary(loops: DataFrame, boxes: DataFrame, straighten: bool = True) -> DataFrame:
    """The outermost ring, or the box in its place."""
    b = F.col("_b")
    corner = lambda x, y: S.point(b[x], b[y])
    rect = F.array(corner("min_x", "min_y"), corner("max_x", "min_y"), corner("max_x", "max_y"), corner("min_x", "max_y"))
    out = loops.where("rank = 0").join(boxes.select("drawing_id", F.col("b").alias("_b")), "drawing_id")
    return out.select("drawing_id", "loop_id", F.lit(0).alias("part"), (rect if straighten else F.col("pts")).alias("pts"))


STRATEGIES = {"4_quadrant": None, "mirror_left_to_right": "left", "mirror_right_to_left": "right", "mirror_bottom_to_top": "bottom", "mirror_top_to_bottom": "top"}


def repair_rings(loops: DataFrame, boxes: DataFrame, strategy: str, axes: DataFrame | None = None, straighten: bool = True) -> DataFrame:
    """The rings of a strategy with the outer boundary; unknown strategies are the consensus about axes."""
    if strategy in ("4_quadrant", "4_quadrant_consensus"):
        out = four_quadrants(loops, boxes)
    elif strategy in STRATEGIES:
        out = bilateral(loops, boxes, STRATEGIES[strategy])
    else:
        out = consensus(loops, axes)
    out = boundary(loops, boxes, straighten).unionByName(out)
    return out.withColumn("loop_id", F.row_number().over(Window.partitionBy("drawing_id").orderBy("loop_id", "part")).cast("bigint") - 1).drop("part")


# lines


def deduplicate(segments: DataFrame, tol: float = 0.05) -> DataFrame:
    """Each line whose ends are those of an earlier line that stays is dropped."""

    def drop(t: pa.Table) -> pa.Table:
        gone: set[int] = set()
        for b, a in sorted(zip(t.column("seg_b").to_pylist(), t.column("seg_a").to_pylist())):
            if a not in gone:
                gone.add(b)
        return grouped_rows(t, [(k,) for k in sorted(gone)], [("seg_id", t.schema.field("seg_b").type)])

    kind, sid = (segments.schema[k].dataType.simpleString() for k in ("drawing_id", "seg_id"))
    gone = each_group(duplicate_pairs(segments, tol), drop, f"drawing_id {kind}, seg_id {sid}")
    return segments.join(gone, ["drawing_id", "seg_id"], "left_anti")


def rings_to_lines(rings: DataFrame, original: DataFrame | None = None) -> DataFrame:
    """Segments of rings, with the layer of the original line nearest to each middle, deduplicated."""
    order = Window.partitionBy("drawing_id").orderBy("loop_id", "i")
    out = stored(ring_edges(rings).withColumn("seg_id", F.row_number().over(order).cast("bigint") - 1).drop("loop_id", "i"), "ring-edges")
    if original is None:
        out = out.withColumn("layer", F.lit("0"))
    else:
        mid = out.select("drawing_id", F.col("seg_id").alias("id"), ((F.col("x1") + F.col("x2")) / 2).alias("x"), ((F.col("y1") + F.col("y2")) / 2).alias("y"))
        layer = nearest_segment(mid, original).select("drawing_id", F.col("id").alias("seg_id"), "layer")
        out = out.join(layer, ["drawing_id", "seg_id"], "left").na.fill({"layer": "0"})
    return deduplicate(out)


def in_zones(segments: DataFrame, zones: DataFrame) -> DataFrame:
    """Segments with an end in a zone (drawing_id, b)."""
    z = zones.select("drawing_id", F.col("b").alias("_z"))
    held = segments.select("drawing_id", "seg_id", *SEG).join(z, "drawing_id").where(S.box_contains(F.col("_z"), F.col("x1"), F.col("y1")) | S.box_contains(F.col("_z"), F.col("x2"), F.col("y2")))
    return segments.join(held.select("drawing_id", "seg_id").distinct(), ["drawing_id", "seg_id"], "left_semi")


def apply_zones(repaired: DataFrame, original: DataFrame, zones: DataFrame) -> DataFrame:
    """Repaired lines outside the zones and original ones inside, these numbered after the others."""
    inside = in_zones(repaired, zones).select("drawing_id", "seg_id")
    kept = repaired.join(inside, ["drawing_id", "seg_id"], "left_anti").select("drawing_id", "seg_id", *SEG, "layer")
    last = repaired.groupBy("drawing_id").agg((F.max("seg_id") + 1).alias("_n"))
    back = in_zones(original, zones).join(last, "drawing_id", "left").withColumn("seg_id", F.col("seg_id") + F.coalesce("_n", F.lit(0)))
    return kept.unionByName(back.select("drawing_id", "seg_id", *SEG, "layer"))


#: How far apart the ends of lines are that a holding tab keeps apart.
TAB = (0.5, 2.0)


def holding_tabs(segments: DataFrame, low: float = TAB[0], high: float = TAB[1]) -> DataFrame:
    """(drawing_id, id, rid, x, y, rx, ry, dist): ends of different lines low to high apart."""
    e = endpoints(segments)
    right = e.select("drawing_id", F.col("id").alias("rid"), F.col("seg_id").alias("_other"), F.col("x").alias("rx"), F.col("y").alias("ry"))
    return range_join(e, right, high).where((F.col("id") < F.col("rid")) & (F.col("seg_id") != F.col("_other")) & (F.col("dist") >= low)).drop("seg_id", "_other")


#: Pairs of near ends, about, that a kernel welds.
WELDED = 100_000


def weld(segments: DataFrame, radius: float = 0.05, keep_tabs: bool = True, pairs: int = 1 << 18) -> DataFrame:
    """Lines with ends within radius moved to their mean, in order of ends, those of holding tabs left alone; lines next to nothing dropped.

    Drawings with so many pairs of lines at most are one array kernel each.
    """
    large = large_keys(segments, segments, "drawing_id", pairs)
    if large is None:
        return small.welded(segments, radius, keep_tabs, *TAB)
    few, many = (segments.join(large, "drawing_id", how) for how in ("left_anti", "left_semi"))
    return small.welded(few, radius, keep_tabs, *TAB).select(*segments.columns).unionByName(_weld(many.select(*segments.columns), radius, keep_tabs))


def _weld(segments: DataFrame, radius: float, keep_tabs: bool) -> DataFrame:
    e = endpoints(segments)
    if keep_tabs:
        tabs = holding_tabs(segments)
        held = tabs.select("drawing_id", "id").unionByName(tabs.select("drawing_id", F.col("rid").alias("id"))).distinct()
        e = e.join(held.withColumn("_held", F.lit(True)), ["drawing_id", "id"], "left").na.fill({"_held": False})
    else:
        e = e.withColumn("_held", F.lit(False))
    right = e.select("drawing_id", F.col("id").alias("rid"), F.col("x").alias("rx"), F.col("y").alias("ry"), F.col("_held").alias("_rheld"))
    near = stored(range_join(e.select("drawing_id", "id", "x", "y"), right, radius).where("not _rheld").select("drawing_id", "id", "rid", "rx", "ry"), "weld-near")
    kinds = near.schema
    # an end is known by the least end near it; where two ends near each other have different ones, these are joined: ends of one
    # name depend on none of another, so that a kernel takes some names and not a drawing
    low = near.groupBy("drawing_id", "id").agg(F.least(F.col("id"), F.min("rid")).alias("_m"), F.count(F.lit(1)).alias("_n"))
    named = stored(near.join(low, ["drawing_id", "id"]).where("_n > 1").drop("_n"), "weld-named")
    apart = named.join(low.select("drawing_id", F.col("id").alias("rid"), F.col("_m").alias("_o")), ["drawing_id", "rid"]).where("_m <> _o")
    roots = components(apart.select("drawing_id", F.col("_m").alias("u"), F.col("_o").alias("v"))).select("drawing_id", F.col("node").alias("_m"), "root")
    parts = max(1, named.count() // WELDED)
    rows = named.join(roots, ["drawing_id", "_m"], "left").withColumn("_part", F.pmod(F.xxhash64("drawing_id", F.coalesce("root", "_m")), F.lit(parts)))

    def balls(t: pa.Table) -> pa.Table:
        drawing, ends, others, xs, ys = (t.column(c).to_pylist() for c in ("drawing_id", "id", "rid", "rx", "ry"))
        seen, to = set(), {}
        first = 0
        for last in range(1, len(ends) + 1):
            if last < len(ends) and ends[last] == ends[first] and drawing[last] == drawing[first]:
                continue
            if (drawing[first], ends[first]) not in seen:
                ball = list(zip(drawing[first:last], others[first:last]))
                seen.update(ball)
                to |= dict.fromkeys(ball, (sum(xs[first:last]) / len(ball), sum(ys[first:last]) / len(ball)))
            first = last
        columns = [[k[0] for k in to], [k[1] for k in to], [v[0] for v in to.values()], [v[1] for v in to.values()]]
        return pa.table([pa.array(c, k) for c, k in zip(columns, (t.schema.field("drawing_id").type, pa.int64(), pa.float64(), pa.float64()))], names=["drawing_id", "id", "wx", "wy"])

    moved = each_group(rows.select("_part", *kinds.names), balls, f"drawing_id {kinds['drawing_id'].dataType.simpleString()}, id bigint, wx double, wy double", "_part", ("drawing_id", "id", "rid"))
    new = e.join(moved, ["drawing_id", "id"], "left").select("drawing_id", "seg_id", (F.col("id") % 2).alias("_e"), F.coalesce("wx", "x").alias("x"), F.coalesce("wy", "y").alias("y"))
    ends = new.groupBy("drawing_id", "seg_id").agg(*(F.min_by(c, "_e").alias(f"{c}1") for c in "xy"), *(F.max_by(c, "_e").alias(f"{c}2") for c in "xy"))
    out = ends.join(segments.drop(*SEG), ["drawing_id", "seg_id"]).where(S.distance(*(F.col(c) for c in SEG)) > 1e-4)
    return out.select(*segments.columns)


def margins(loops: DataFrame, boxes: DataFrame, default: float = 18.5) -> DataFrame:
    """(drawing_id, margin_x, margin_y): medians of the positive gaps between corner boxes and the drawing's box."""
    m = S.box_of(F.col("box"))
    mean = lambda k: F.aggregate("pts", F.lit(0.0), lambda a, p: a + p[k]) / F.size("pts")
    c = loops.where("n = 4").join(boxes.select("drawing_id", F.col("b").alias("box")), "drawing_id").withColumn("_x", mean("x")).withColumn("_y", mean("y"))
    c = c.where((F.abs(F.col("_x") - m["center_x"]) > m["width"] * 0.25) & (F.abs(F.col("_y") - m["center_y"]) > m["height"] * 0.25))
    gap = lambda k: F.when(F.col(f"_{k}") < m[f"center_{k}"], F.col(f"b.min_{k}") - F.col(f"box.min_{k}")).otherwise(F.col(f"box.max_{k}") - F.col(f"b.max_{k}"))
    mid = lambda k: F.coalesce(F.percentile(F.when(gap(k) > 0, gap(k)), F.lit(0.5)), F.lit(default)).alias(f"margin_{k}")
    return c.groupBy("drawing_id").agg(mid("x"), mid("y"))


def equalize_corners(loops: DataFrame, boxes: DataFrame, size: DataFrame) -> DataFrame:
    """Corner boxes of drawings in size (drawing_id, width, height) made that large, at the median margins."""
    wide = margins(loops, boxes).join(size.select("drawing_id", F.col("width").alias("_w"), F.col("height").alias("_h")), "drawing_id")
    m, box = S.box_of(F.col("box")), F.col("box")
    out = loops.join(boxes.select("drawing_id", F.col("b").alias("box")), "drawing_id").join(wide, "drawing_id", "left")
    mean = lambda k: F.aggregate("pts", F.lit(0.0), lambda a, p: a + p[k]) / F.size("pts")
    corner = F.col("_w").isNotNull() & (F.col("n") == 4) & (F.abs(mean("x") - m["center_x"]) > m["width"] * 0.25) & (F.abs(mean("y") - m["center_y"]) > m["height"] * 0.25)
    low = lambda k, s: F.when(mean(k) > m[f"center_{k}"], box[f"max_{k}"] - F.col(f"margin_{k}") - F.col(s)).otherwise(box[f"min_{k}"] + F.col(f"margin_{k}"))
    x1, y1 = low("x", "_w"), low("y", "_h")
    x2, y2 = x1 + F.col("_w"), y1 + F.col("_h")
    new = F.array(S.point(x1, y1), S.point(x2, y1), S.point(x2, y2), S.point(x1, y2))
    return out.select("drawing_id", "loop_id", F.when(corner, new).otherwise(F.col("pts")).alias("pts"))


def change_ratio(original: DataFrame, repaired: DataFrame) -> DataFrame:
    """(drawing_id, change): half the relative difference in lines, half the mean shift of middles both ways against 25 mm, in percent."""
    middle = lambda df: df.select("drawing_id", F.col("seg_id").alias("id"), ((F.col("x1") + F.col("x2")) / 2).alias("x"), ((F.col("y1") + F.col("y2")) / 2).alias("y"))
    a, b = middle(original), middle(repaired)

    def mean(left: DataFrame, right: DataFrame, name: str) -> DataFrame:
        near = nearest_one(left, right.toDF("drawing_id", "rid", "rx", "ry")).select("drawing_id", "id", "dist")
        return left.join(near, ["drawing_id", "id"], "left").groupBy("drawing_id").agg(F.count(F.lit(1)).alias(f"n_{name}"), F.avg("dist").alias(name))

    both = mean(a, b, "old").join(mean(b, a, "new"), "drawing_id", "full").na.fill(0, ["n_old", "n_new"])
    count = F.abs(F.col("n_old") - F.col("n_new")) / F.greatest(F.col("n_old"), F.lit(1))
    ratio = F.least(F.lit(100.0), 100.0 * (0.5 * count + 0.5 * F.least(F.lit(1.0), (F.col("old") + F.col("new")) / 2 / 25.0)))
    return both.select("drawing_id", F.when((F.col("n_old") == 0) | (F.col("n_new") == 0), 100.0).otherwise(ratio).alias("change"))


CANDIDATES = ("a", "b", "c", "d")


def tagged(df: DataFrame, candidates=CANDIDATES) -> DataFrame:
    """df once for each candidate, with drawing_id/candidate for a drawing_id, so that one pass does all of them."""
    k = F.explode(F.array(*map(F.lit, candidates)))
    return df.withColumn("_k", k).withColumn("drawing_id", F.concat_ws("/", F.col("drawing_id").cast("string"), "_k")).drop("_k")


def untagged(df: DataFrame, kind: str) -> DataFrame:
    """A tagged table with its own drawing_id, of the given type, and candidate_id."""
    at = F.regexp_extract("drawing_id", "^(.*)/(.)$", 1), F.regexp_extract("drawing_id", "^(.*)/(.)$", 2)
    return df.withColumn("candidate_id", F.concat(F.lit("candidate_"), at[1])).withColumn("drawing_id", at[0].cast(kind))


def candidate_lines(segments: DataFrame, loops: DataFrame, boxes: DataFrame, corner_size: DataFrame, straighten: bool = True, zones: DataFrame | None = None, candidates=CANDIDATES) -> DataFrame:
    """Tagged lines of the candidates: quadrants with equal corners, quadrants, left to right, and the least change; each squared and welded."""
    square = lambda rings: stored(regularized(rings).select("drawing_id", "loop_id", "pts"), "squared-rings")
    some = set(candidates)
    kinds = {"quads": bool({"a", "b"} & some) and (lambda: repair_rings(loops, boxes, "4_quadrant", straighten=straighten)), "c": "c" in some and (lambda: repair_rings(loops, boxes, "mirror_left_to_right", straighten=straighten)), "d": "d" in some and (lambda: loops)}
    asked = {k: make for k, make in kinds.items() if make}
    held = dict(zip(asked, together(*((lambda make=make: square(make())) for make in asked.values()))))
    made = {"a": lambda: equalize_corners(ranked_loops(held["quads"]), boxes, corner_size), "b": lambda: held["quads"], "c": lambda: held["c"], "d": lambda: held["d"]}
    rings = union([tagged(made[k]().select("drawing_id", "loop_id", "pts"), (k,)) for k in candidates])
    out = stored(rings_to_lines(rings, tagged(segments, candidates)), "ring-lines")
    if "d" in candidates:
        bare = segments.join(loops.select("drawing_id").distinct(), "drawing_id", "left_anti")
        out = out.unionByName(tagged(deduplicate(regularize_lines(bare)), ("d",)).select(*out.columns))
    if zones is not None:
        out = apply_zones(out, tagged(segments, candidates), tagged(zones, candidates))
    return weld(out)


def rank_candidates(scored: DataFrame) -> DataFrame:
    """scored (drawing_id, candidate_id, quality, change, is_valid, has_lines) with cost, place and whether to recommend: sound ones first, then by cost."""
    out = scored.withColumn("cost", 100.0 - F.col("quality") + 0.15 * F.col("change") + F.when(F.col("is_valid"), 0.0).otherwise(100.0))
    out = out.withColumn("is_valid", F.col("is_valid") & F.col("has_lines"))
    w = Window.partitionBy("drawing_id").orderBy(F.desc("is_valid"), "cost", "candidate_id")
    return out.withColumn("place", F.row_number().over(w))


def recommended(ranked: DataFrame, original: DataFrame) -> DataFrame:
    """The first sound candidate that isn't worse than the original quality (drawing_id, quality) by more than 0.01."""
    old = original.select("drawing_id", F.col("quality").alias("_q"))
    ok = ranked.join(old, "drawing_id").where(F.col("is_valid") & (F.col("quality") >= F.col("_q") - 0.01)).drop("_q")
    return ok.withColumn("_k", F.row_number().over(Window.partitionBy("drawing_id").orderBy("place"))).where("_k = 1").drop("_k")


def edit_versions(segments: DataFrame, edits: DataFrame) -> DataFrame:
    """The state after each edit: edits (version, op in add, remove, drawing_id, seg_id and the line) applied in order; undo is reading an earlier version."""
    start = segments.select(F.lit(0).alias("version"), F.lit("add").alias("op"), "drawing_id", "seg_id", *SEG, "layer")
    every = start.unionByName(edits.select(*start.columns))
    w = Window.partitionBy("drawing_id", "seg_id").orderBy("version")
    spans = every.withColumn("until", F.lead("version").over(w)).where("op = 'add'")
    last = every.agg(F.max("version").alias("_last"))
    spans = spans.withColumn("_last", F.lit(last.first()["_last"]))
    return spans.withColumn("version", F.explode(F.sequence("version", F.coalesce(F.col("until") - 1, F.col("_last"))))).drop("op", "until", "_last")


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
