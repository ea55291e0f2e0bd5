"""Planar scalar functions as Column expressions: points, vectors, boxes, segments, arcs, circles, axes, affine maps.

A point or vector is two Columns; results with several parts are structs. All stays inside code generation.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TAU = 2 * math.pi


def col(x: Column | str | float) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(float(x))


def point(x: Column, y: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"))


def let(value: Column, body) -> Column:
    """body of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def turn(angle: Column) -> Column:
    """An angle in [0, 2 pi)."""
    return F.pmod(angle, F.lit(TAU))


# points and vectors


def norm(dx: Column, dy: Column) -> Column:
    return F.sqrt(dx * dx + dy * dy)


def distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return norm(x2 - x1, y2 - y1)


def distance_squared(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return (x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)


def is_close(x1: Column, y1: Column, x2: Column, y2: Column, tol: float = 1e-4) -> Column:
    return distance(x1, y1, x2, y2) <= tol


def quantize(x: Column, tol: float = 0.05) -> Column:
    """The nearest multiple's number, halves to even."""
    return F.rint(x / tol).cast("bigint")


def normalized(dx: Column, dy: Column) -> Column:
    n = norm(dx, dy)
    return F.struct(F.when(n < 1e-12, 0.0).otherwise(dx / n).alias("dx"), F.when(n < 1e-12, 0.0).otherwise(dy / n).alias("dy"))


def dot(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return ax * bx + ay * by


def cross(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return ax * by - ay * bx


def angle_between(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """In [0, pi]; a quarter turn if a vector has no length."""
    n = norm(ax, ay) * norm(bx, by)
    return F.acos(clamp(F.when(n < 1e-24, 0.0).otherwise(dot(ax, ay, bx, by) / n), -1.0, 1.0))


# boxes


def box(min_x: Column, min_y: Column, max_x: Column, max_y: Column) -> Column:
    return F.struct(min_x.alias("min_x"), min_y.alias("min_y"), max_x.alias("max_x"), max_y.alias("max_y"))


def box_of(b: Column) -> dict[str, Column]:
    """Width and height (never negative), centre and area of a box struct."""
    w, h = F.greatest(F.lit(0.0), b["max_x"] - b["min_x"]), F.greatest(F.lit(0.0), b["max_y"] - b["min_y"])
    return {"width": w, "height": h, "center_x": (b["min_x"] + b["max_x"]) / 2, "center_y": (b["min_y"] + b["max_y"]) / 2, "area": w * h}


def box_contains(b: Column, x: Column, y: Column, tol: float = 1e-6) -> Column:
    return x.between(b["min_x"] - tol, b["max_x"] + tol) & y.between(b["min_y"] - tol, b["max_y"] + tol)


def boxes_meet(a: Column, b: Column, tol: float = 1e-6) -> Column:
    return ~((a["max_x"] < b["min_x"] - tol) | (b["max_x"] < a["min_x"] - tol) | (a["max_y"] < b["min_y"] - tol) | (b["max_y"] < a["min_y"] - tol))


def box_union(a: Column, b: Column) -> Column:
    return box(F.least(a["min_x"], b["min_x"]), F.least(a["min_y"], b["min_y"]), F.greatest(a["max_x"], b["max_x"]), F.greatest(a["max_y"], b["max_y"]))


def segment_box(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return box(F.least(x1, x2), F.least(y1, y2), F.greatest(x1, x2), F.greatest(y1, y2))


# segments


def project_on_segment(x1: Column, y1: Column, x2: Column, y2: Column, px: Column, py: Column) -> Column:
    """The nearest point of a segment and its parameter in [0, 1]; the start of one without length."""
    n = distance_squared(x1, y1, x2, y2)
    t = F.when(n < 1e-24, 0.0).otherwise(clamp(dot(px - x1, py - y1, x2 - x1, y2 - y1) / n, 0.0, 1.0))
    return F.struct((x1 + t * (x2 - x1)).alias("x"), (y1 + t * (y2 - y1)).alias("y"), t.alias("t"))


def point_segment_distance(x1: Column, y1: Column, x2: Column, y2: Column, px: Column, py: Column) -> Column:
    p = project_on_segment(x1, y1, x2, y2, px, py)
    return distance(p["x"], p["y"], px, py)


def coincident(a: tuple[Column, ...], b: tuple[Column, ...], tol: float = 0.05) -> Column:
    """Whether segments have the same ends, in either order."""
    same = is_close(a[0], a[1], b[0], b[1], tol) & is_close(a[2], a[3], b[2], b[3], tol)
    return same | (is_close(a[0], a[1], b[2], b[3], tol) & is_close(a[2], a[3], b[0], b[1], tol))


def intersection(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Where two closed segments cross, or null; parallel ones don't."""
    rx, ry, sx, sy = a[2] - a[0], a[3] - a[1], b[2] - b[0], b[3] - b[1]
    d = cross(rx, ry, sx, sy)
    safe = F.when(F.abs(d) < 1e-9, 1.0).otherwise(d)
    t, u = cross(b[0] - a[0], b[1] - a[1], sx, sy) / safe, cross(b[0] - a[0], b[1] - a[1], rx, ry) / safe
    return F.when((F.abs(d) >= 1e-9) & t.between(0.0, 1.0) & u.between(0.0, 1.0), point(a[0] + t * rx, a[1] + t * ry))


def line_angle(dx: Column, dy: Column) -> Column:
    """An undirected line's angle in degrees, in [0, 180)."""
    return F.pmod(F.degrees(F.atan2(dy, dx)), F.lit(180.0))


# arcs and circles


def sweep(a0: Column, a1: Column, is_ccw: Column) -> Column:
    """The directed sweep, never negative; more than a turn stays."""
    d = F.when(is_ccw, a1 - a0).otherwise(a0 - a1)
    return F.when(d < 0, F.pmod(d, F.lit(TAU))).otherwise(d)


def arc_point(cx: Column, cy: Column, r: Column, a0: Column, a1: Column, is_ccw: Column, t: Column) -> Column:
    """The point at share t of the sweep."""
    a = a0 + F.when(is_ccw, 1.0).otherwise(-1.0) * sweep(a0, a1, is_ccw) * t
    return point(cx + r * F.cos(a), cy + r * F.sin(a))


def arc_box(cx: Column, cy: Column, r: Column, a0: Column, a1: Column, is_ccw: Column, n: int = 24) -> Column:
    """The box of n points along an arc, which may miss its extremes by a little."""
    pts = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: arc_point(cx, cy, r, a0, a1, is_ccw, i / (n - 1)))
    xs, ys = F.transform(pts, lambda p: p["x"]), F.transform(pts, lambda p: p["y"])
    return box(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))


def arc_through(ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column) -> Column:
    """The arc from a over b to c, or null if they are in a line."""
    d = 2.0 * (ax * (by - cy) + bx * (cy - ay) + cx * (ay - by))
    safe = F.when(F.abs(d) < 1e-9, 1.0).otherwise(d)
    a2, b2, c2 = ax * ax + ay * ay, bx * bx + by * by, cx * cx + cy * cy
    ux, uy = (a2 * (by - cy) + b2 * (cy - ay) + c2 * (ay - by)) / safe, (a2 * (cx - bx) + b2 * (ax - cx) + c2 * (bx - ax)) / safe
    r = distance(ax, ay, ux, uy)
    ccw = cross(bx - ax, by - ay, cx - bx, cy - by) > 0
    out = F.struct(ux.alias("cx"), uy.alias("cy"), r.alias("r"), turn(F.atan2(ay - uy, ax - ux)).alias("a0"), turn(F.atan2(cy - uy, cx - ux)).alias("a1"), ccw.alias("is_ccw"))
    return F.when((F.abs(d) >= 1e-9) & (r >= 1e-5), out)


def point_arc_distance(cx: Column, cy: Column, r: Column, a0: Column, a1: Column, is_ccw: Column, px: Column, py: Column) -> Column:
    a = turn(F.atan2(py - cy, px - cx))
    inside = turn(F.when(is_ccw, a - a0).otherwise(a0 - a)) <= sweep(a0, a1, is_ccw) + 1e-4
    s, e = (arc_point(cx, cy, r, a0, a1, is_ccw, F.lit(t)) for t in (0.0, 1.0))
    ends = F.least(distance(s["x"], s["y"], px, py), distance(e["x"], e["y"], px, py))
    return F.when(inside, F.abs(distance(cx, cy, px, py) - r)).otherwise(ends)


def bulge_to_arc(x1: Column, y1: Column, x2: Column, y2: Column, bulge: Column) -> Column:
    """The arc over a chord whose bulge is the tangent of a quarter of its angle; null if it is straight."""
    chord = distance(x1, y1, x2, y2)
    bent = (F.abs(bulge) >= 1e-6) & (chord >= 1e-6)
    b, c = F.when(bent, bulge).otherwise(1.0), F.when(bent, chord).otherwise(1.0)
    half = 2.0 * F.atan(b)
    d = c / 2 / F.tan(half)
    cx, cy = (x1 + x2) / 2 - (y2 - y1) / c * d, (y1 + y2) / 2 + (x2 - x1) / c * d
    out = F.struct(cx.alias("cx"), cy.alias("cy"), F.abs(c / (2.0 * F.sin(half))).alias("r"), turn(F.atan2(y1 - cy, x1 - cx)).alias("a0"), turn(F.atan2(y2 - cy, x2 - cx)).alias("a1"), (bulge > 0).alias("is_ccw"))
    return F.when(bent, out)


def arc_to_bulge(x1: Column, y1: Column, x2: Column, y2: Column, cx: Column, cy: Column, is_ccw: Column) -> Column:
    a, b = F.atan2(y1 - cy, x1 - cx), F.atan2(y2 - cy, x2 - cx)
    theta = turn(F.when(is_ccw, b - a).otherwise(a - b))
    theta = F.least(F.when(theta == 0, TAU).otherwise(theta), F.lit(TAU - 1e-6))
    return F.when(distance(x1, y1, x2, y2) < 1e-9, 0.0).otherwise(F.when(is_ccw, 1.0).otherwise(-1.0) * F.tan(theta / 4))


# axes: struct(ox, oy, dx, dy), the direction's angle in [0, pi)


def axis(ox: Column, oy: Column, angle: Column) -> Column:
    a = F.pmod(angle, F.lit(math.pi))
    return F.struct(ox.alias("ox"), oy.alias("oy"), F.cos(a).alias("dx"), F.sin(a).alias("dy"))


def vertical_axis(x: Column) -> Column:
    return F.struct(x.alias("ox"), F.lit(0.0).alias("oy"), F.lit(0.0).alias("dx"), F.lit(1.0).alias("dy"))


def horizontal_axis(y: Column) -> Column:
    return F.struct(F.lit(0.0).alias("ox"), y.alias("oy"), F.lit(1.0).alias("dx"), F.lit(0.0).alias("dy"))


def axis_angle(a: Column) -> Column:
    return F.pmod(F.atan2(a["dy"], a["dx"]), F.lit(math.pi))


def axis_is_vertical(a: Column, tol_deg: float = 0.1) -> Column:
    return F.abs(F.degrees(axis_angle(a)) - 90.0) < tol_deg


def axis_is_horizontal(a: Column, tol_deg: float = 0.1) -> Column:
    d = F.degrees(axis_angle(a))
    return (d < tol_deg) | (F.abs(d - 180.0) < tol_deg)


def signed_distance(a: Column, x: Column, y: Column) -> Column:
    """Positive to the right of the axis's direction."""
    return (x - a["ox"]) * a["dy"] - (y - a["oy"]) * a["dx"]


def project_on_axis(a: Column, x: Column, y: Column) -> Column:
    t = dot(x - a["ox"], y - a["oy"], a["dx"], a["dy"])
    return point(a["ox"] + t * a["dx"], a["oy"] + t * a["dy"])


def reflect(a: Column, x: Column, y: Column) -> Column:
    t = dot(x - a["ox"], y - a["oy"], a["dx"], a["dy"])
    return point(2.0 * (a["ox"] + t * a["dx"]) - x, 2.0 * (a["oy"] + t * a["dy"]) - y)


def reflect_vector(a: Column, dx: Column, dy: Column) -> Column:
    t = dot(dx, dy, a["dx"], a["dy"])
    return F.struct((2.0 * t * a["dx"] - dx).alias("dx"), (2.0 * t * a["dy"] - dy).alias("dy"))


def reflect_arc(a: Column, cx: Column, cy: Column, r: Column, a0: Column, a1: Column, is_ccw: Column) -> Column:
    """Centre and ends reflected, the direction turned round."""
    s, e = (arc_point(cx, cy, r, a0, a1, is_ccw, F.lit(t)) for t in (0.0, 1.0))
    c, s, e = reflect(a, cx, cy), reflect(a, s["x"], s["y"]), reflect(a, e["x"], e["y"])
    return F.struct(c["x"].alias("cx"), c["y"].alias("cy"), r.alias("r"), turn(F.atan2(s["y"] - c["y"], s["x"] - c["x"])).alias("a0"), turn(F.atan2(e["y"] - c["y"], e["x"] - c["x"])).alias("a1"), (~is_ccw).alias("is_ccw"))


def reflect_polyline(a: Column, verts: Column, reverse: bool = False) -> Column:
    """array<struct<x,y,bulge>> reflected: bulges negated, or in reverse order with the bulge of the edge now leaving."""
    n = F.size(verts)

    def vertex(v: Column, bulge: Column) -> Column:
        p = reflect(a, v["x"], v["y"])
        return F.struct(p["x"].alias("x"), p["y"].alias("y"), bulge.alias("bulge"))

    if not reverse:
        return F.transform(verts, lambda v: vertex(v, -v["bulge"]))
    back = F.when(n > 0, F.sequence(n - 1, F.lit(0), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    return F.transform(back, lambda i: vertex(F.get(verts, i), F.get(verts, F.pmod(i - 1, n))["bulge"]))


# affine maps: struct(a, b, c, d, e, f) for x' = a x + b y + c, y' = d x + e y + f


def affine(a: Column, b: Column, c: Column, d: Column, e: Column, f: Column) -> Column:
    return F.struct(*(v.alias(k) for k, v in zip("abcdef", (a, b, c, d, e, f))))


def translation(tx: Column, ty: Column) -> Column:
    one, zero = F.lit(1.0), F.lit(0.0)
    return affine(one, zero, tx, zero, one, ty)


def rotation(angle: Column, x: Column, y: Column) -> Column:
    c, s = F.cos(angle), F.sin(angle)
    return affine(c, -s, x - c * x + s * y, s, c, y - s * x - c * y)


def scaling(sx: Column, sy: Column, x: Column, y: Column) -> Column:
    zero = F.lit(0.0)
    return affine(sx, zero, x - sx * x, zero, sy, y - sy * y)


def compose(m: Column, k: Column) -> Column:
    """m after k."""
    return affine(
        m["a"] * k["a"] + m["b"] * k["d"], m["a"] * k["b"] + m["b"] * k["e"], m["a"] * k["c"] + m["b"] * k["f"] + m["c"],
        m["d"] * k["a"] + m["e"] * k["d"], m["d"] * k["b"] + m["e"] * k["e"], m["d"] * k["c"] + m["e"] * k["f"] + m["f"],
    )


def apply_affine(m: Column, x: Column, y: Column) -> Column:
    return point(m["a"] * x + m["b"] * y + m["c"], m["d"] * x + m["e"] * y + m["f"])


def apply_affine_vector(m: Column, dx: Column, dy: Column) -> Column:
    return F.struct((m["a"] * dx + m["b"] * dy).alias("dx"), (m["d"] * dx + m["e"] * dy).alias("dy"))


# rings: array<struct<x,y>>, closed


def ring_next(pts: Column, i: Column) -> Column:
    return F.get(pts, (i + 1) % F.size(pts))


def ring_sum(pts: Column, term) -> Column:
    """The sum of term(point, next point) around a ring."""
    return F.when(F.size(pts) > 0, F.aggregate(F.sequence(F.lit(0), F.size(pts) - 1), F.lit(0.0), lambda s, i: s + term(F.get(pts, i), ring_next(pts, i)))).otherwise(0.0)


def signed_area(pts: Column) -> Column:
    """Taken about the first point, so that a ring far from the origin loses no digits."""
    o = F.get(pts, F.lit(0))
    return F.when(F.size(pts) < 3, 0.0).otherwise(ring_sum(pts, lambda p, q: cross(p["x"] - o["x"], p["y"] - o["y"], q["x"] - o["x"], q["y"] - o["y"])) / 2)


def ring_centroid(pts: Column) -> Column:
    """The area's centroid, taken about the mean of the points; that mean if there is next to no area."""
    n = F.size(pts)
    mean = lambda k: ring_sum(pts, lambda p, q: p[k]) / F.greatest(n, F.lit(1))

    def centre(v: Column) -> Column:
        a, m = v["a"], v["m"]
        own = lambda p, q: cross(p["x"] - m["x"], p["y"] - m["y"], q["x"] - m["x"], q["y"] - m["y"])
        flat = (n < 3) | (F.abs(a) < 1e-9)
        six = F.when(flat, 1.0).otherwise(6.0 * a)
        off = lambda k: F.when(flat, 0.0).otherwise(ring_sum(pts, lambda p, q: (p[k] - m[k] + (q[k] - m[k])) * own(p, q)) / six)
        return point(m["x"] + off("x"), m["y"] + off("y"))

    return let(F.struct(signed_area(pts).alias("a"), point(mean("x"), mean("y")).alias("m")), centre)


def ring_perimeter(pts: Column) -> Column:
    return ring_sum(pts, lambda p, q: distance(p["x"], p["y"], q["x"], q["y"]))


def ring_box(pts: Column) -> Column:
    xs, ys = F.transform(pts, lambda p: p["x"]), F.transform(pts, lambda p: p["y"])
    return box(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))


def ring_contains(pts: Column, x: Column, y: Column) -> Column:
    """Even-odd: whether a ray to the right crosses an odd number of edges."""
    def crosses(p: Column, q: Column) -> Column:
        straddles = (p["y"] > y) != (q["y"] > y)
        at = (q["x"] - p["x"]) * (y - p["y"]) / F.when(q["y"] == p["y"], 1.0).otherwise(q["y"] - p["y"]) + p["x"]
        return F.when(straddles & (x < at), 1.0).otherwise(0.0)

    return ring_sum(pts, crosses) % 2 == 1


def ring_touches(pts: Column, x: Column, y: Column) -> Column:
    """Whether a point is on one of the ring's edges."""
    def on(p: Column, q: Column) -> Column:
        held = x.between(F.least(p["x"], q["x"]), F.greatest(p["x"], q["x"])) & y.between(F.least(p["y"], q["y"]), F.greatest(p["y"], q["y"]))
        return F.when(held & (cross(q["x"] - p["x"], q["y"] - p["y"], x - p["x"], y - p["y"]) == 0), 1.0).otherwise(0.0)

    return ring_sum(pts, on) > 0


# scores and decisions


def symmetry_score(rms: Column, matched: Column, loop_area_error: Column, tol: float = 0.2) -> Column:
    fit = 100.0 * F.exp(-rms / max(0.5, 5 * tol)) * (0.7 + 0.3 * matched) * (1.0 - 0.2 * F.least(F.lit(1.0), loop_area_error))
    return clamp(fit, 0.0, 100.0)


def symmetry_confidence(score: Column, matched: Column) -> Column:
    return clamp(score / 100.0 * (0.5 + 0.5 * matched), 0.0, 1.0)


def classify(score: Column, rms: Column, matched: Column, pairs: Column) -> Column:
    """Classification and action of an axis profile with its number of paired loops."""
    evident = (matched >= 0.70) | (pairs >= 3)
    mild = (score >= 80.0) | ((pairs >= 5) & (matched >= 0.65))
    kind = (
        F.when((score >= 95.0) & (rms <= 0.15) & (matched >= 0.95), "PERFECT_SYMMETRIC")
        .when(evident & mild, "DISTORTED_SYMMETRY").when(evident, "SEVERELY_DISTORTED_SYMMETRY")
        .when((matched < 0.40) & (pairs <= 1), "INTENDED_ASYMMETRIC").otherwise("UNCERTAIN_ASYMMETRY")
    )
    action = F.when(kind == "PERFECT_SYMMETRIC", "NO_REPAIR_NEEDED").when((kind == "DISTORTED_SYMMETRY") & (score >= 85.0), "AUTO_REPAIR").when(kind == "INTENDED_ASYMMETRIC", "REJECT").otherwise("REVIEW")
    return F.struct(kind.alias("classification"), action.alias("action"))


def verdict(quality: Column, symmetry: Column, penalty: Column) -> Column:
    return F.when((quality >= 85.0) & (symmetry >= 90.0) & (penalty < 15.0), "AUTO_ACCEPT").when(quality >= 60.0, "REVIEW").otherwise("REJECT")


def orientation(angle_deg: Column, tol: float = 4.0) -> Column:
    """The nearest of the four directions within tol and the deviation from it; oblique lines deviate by 0."""
    near = lambda t: F.abs(angle_deg - t)
    flat = F.least(near(0.0), near(180.0))
    best = F.least(flat, near(45.0), near(90.0), near(135.0))
    name = F.when(best > tol, "OBLIQUE").when(flat == best, "HORIZONTAL").when(near(45.0) == best, "DIAGONAL_45").when(near(90.0) == best, "VERTICAL").otherwise("DIAGONAL_135")
    return F.struct(name.alias("orientation"), F.when(best > tol, 0.0).otherwise(best).alias("deviation"))


def loop_category(rank: Column, cx: Column, cy: Column, n: Column, b: Column) -> Column:
    """A loop's part in its drawing with box b; the first that fits."""
    m = box_of(b)
    ax, ay = F.abs(cx - m["center_x"]), F.abs(cy - m["center_y"])
    near_x, near_y = ax < m["width"] * 0.08, ay < m["height"] * 0.08
    far = (ax > m["width"] * 0.25) & (ay > m["height"] * 0.25)
    return F.when(rank == 0, "OUTER_BOUNDARY").when(near_x & near_y, "CENTER_BOX").when(far & (n == 4), "CORNER_BOX").when((near_x | near_y) & (n >= 4), "AXIS_BAR").otherwise("BRACE_CONNECTOR")


def snap_axis(ox: Column, oy: Column, angle: Column, tol_deg: float = 2.5) -> Column:
    """An axis made exactly vertical or horizontal through its origin if it nearly is."""
    a, tol = F.pmod(angle, F.lit(math.pi)), math.radians(tol_deg)
    return F.when(F.abs(a - math.pi / 2) < tol, vertical_axis(ox)).when((a < tol) | (F.abs(a - math.pi) < tol), horizontal_axis(oy)).otherwise(axis(ox, oy, a))


def repair_axis(angle: Column, b: Column) -> Column:
    """The upright or level axis through a box's centre, whichever an axis's angle is nearer to."""
    d, m = F.degrees(F.pmod(angle, F.lit(math.pi))), box_of(b)
    return F.when(d.between(45.0, 135.0), vertical_axis(m["center_x"])).otherwise(horizontal_axis(m["center_y"]))


# calipers of an interactive view


def caliper_angle(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Degrees between two directions; 0 if one has no length."""
    n = norm(ax, ay) * norm(bx, by)
    short = (norm(ax, ay) < 1e-6) | (norm(bx, by) < 1e-6)
    return F.when(short, 0.0).otherwise(F.degrees(F.acos(clamp(dot(ax, ay, bx, by) / F.when(short, 1.0).otherwise(n), -1.0, 1.0))))


def caliper_apex(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Where two unlimited lines meet; the middle of their starts if they are parallel."""
    d = cross(a[2] - a[0], a[3] - a[1], b[2] - b[0], b[3] - b[1])
    flat = F.abs(d) < 1e-6
    t = cross(b[0] - a[0], b[1] - a[1], b[2] - b[0], b[3] - b[1]) / F.when(flat, 1.0).otherwise(d)
    return F.when(flat, point((a[0] + b[0]) / 2, (a[1] + b[1]) / 2)).otherwise(point(a[0] + t * (a[2] - a[0]), a[1] + t * (a[3] - a[1])))


def ortho_constraint(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """An end turned about its start to the nearest eighth of a turn, halves upwards."""
    n = distance(x1, y1, x2, y2)
    a = F.floor(F.atan2(y2 - y1, x2 - x1) / (math.pi / 4) + 0.5) * (math.pi / 4)
    return F.when(n < 1e-4, point(x2, y2)).otherwise(point(x1 + n * F.cos(a), y1 + n * F.sin(a)))


def heat_band(dev: Column) -> Column:
    """0 to 4 by the breaks 0.5, 1.5, 3 and 6."""
    return F.when(dev < 0.5, 0).when(dev < 1.5, 1).when(dev < 3.0, 2).when(dev < 6.0, 3).otherwise(4)


def edited_axis(ox: Column, oy: Column, angle_deg: Column) -> Column:
    """An axis as dragging leaves it: the origin to 0.01, the angle to 0.1 degrees."""
    near = lambda x, n: F.floor(x * n + 0.5) / n
    return axis(near(ox, 100.0), near(oy, 100.0), F.radians(near(angle_deg, 10.0)))
