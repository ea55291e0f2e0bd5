"""Curves as arcs and lines: recursive approximation, and tangents made square to an axis."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plansheet.functions import scalar as S

Curve = Callable[[float], tuple[float, float]]
PIECE = "kind string, x1 double, y1 double, x2 double, y2 double, cx double, cy double, r double, a0 double, a1 double, is_ccw boolean"


def circle_through(a, b, c) -> tuple[float, float, float, bool] | None:
    d = 2.0 * (a[0] * (b[1] - c[1]) + b[0] * (c[1] - a[1]) + c[0] * (a[1] - b[1]))
    if abs(d) < 1e-9:
        return None
    q = [p[0] * p[0] + p[1] * p[1] for p in (a, b, c)]
    x = (q[0] * (b[1] - c[1]) + q[1] * (c[1] - a[1]) + q[2] * (a[1] - b[1])) / d
    y = (q[0] * (c[0] - b[0]) + q[1] * (a[0] - c[0]) + q[2] * (b[0] - a[0])) / d
    r = math.hypot(a[0] - x, a[1] - y)
    return (x, y, r, (b[0] - a[0]) * (c[1] - b[1]) - (b[1] - a[1]) * (c[0] - b[0]) > 0) if r >= 1e-5 else None


def approximate(curve: Curve, t0: float, t1: float, tol: float = 0.02, deepest: int = 8) -> Iterator[tuple]:
    """Lines and arcs in order: a line where three probes are within tol of the chord, an arc through three points where six are, else halves."""
    todo = [(t0, t1, 0)]
    while todo:
        a, b, depth = todo.pop()
        p, q, middle = curve(a), curve(b), (a + b) / 2
        chord = math.dist(p, q)
        halves = [(middle, b, depth + 1), (a, middle, depth + 1)]
        if chord < 1e-6:
            todo += halves if b - a > 1e-4 and depth < deepest else []
            continue
        off = [abs((q[0] - p[0]) * (z[1] - p[1]) - (q[1] - p[1]) * (z[0] - p[0])) / chord for z in (curve(a + (b - a) * k / 4) for k in (1, 2, 3))]
        if max(off) <= tol:
            yield ("line", *p, *q, None, None, None, None, None, None)
            continue
        fit = circle_through(p, curve(middle), q)
        if fit and fit[2] < 1e7:
            x, y, r, ccw = fit
            if depth >= deepest or max(abs(math.dist((x, y), curve(a + (b - a) * k / 7)) - r) for k in range(1, 7)) <= tol:
                yield ("arc", *p, *q, x, y, r, math.atan2(p[1] - y, p[0] - x) % S.TAU, math.atan2(q[1] - y, q[0] - x) % S.TAU, ccw)
                continue
        if depth >= deepest:
            yield ("line", *p, *q, None, None, None, None, None, None)
        else:
            todo += halves


def ellipse(cx: float, cy: float, mx: float, my: float, ratio: float) -> Curve:
    """An ellipse by its centre, major axis vector and axis ratio."""
    return lambda t: (cx + mx * math.cos(t) - ratio * my * math.sin(t), cy + my * math.cos(t) + ratio * mx * math.sin(t))


def spline(points: list[tuple[float, float]], knots: list[float], degree: int) -> Curve:
    """A B-spline by de Boor's scheme."""

    def at(t: float) -> tuple[float, float]:
        k = max(degree, min(len(points) - 1, next((i for i in range(degree, len(points)) if knots[i] <= t < knots[i + 1]), len(points) - 1)))
        d = [points[j + k - degree] for j in range(degree + 1)]
        for r in range(1, degree + 1):
            for j in range(degree, r - 1, -1):
                low, high = knots[j + k - degree], knots[j + 1 + k - r]
                w = 0.0 if high == low else (t - low) / (high - low)
                d[j] = tuple((1 - w) * u + w * v for u, v in zip(d[j - 1], d[j]))
        return d[degree]

    return at


def approximate_ellipses(df: DataFrame, tol: float = 0.02) -> DataFrame:
    """df (drawing_id, ent_id, cx, cy, mx, my, ratio, t0, t1) as pieces (drawing_id, ent_id, i, kind, ...); the span is made positive."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                t1 = r.t1 if r.t1 > r.t0 else r.t1 + S.TAU
                out += [(r.drawing_id, r.ent_id, i, *p) for i, p in enumerate(approximate(ellipse(r.cx, r.cy, r.mx, r.my, r.ratio), r.t0, t1, tol))]
            yield pd.DataFrame(out, columns=["drawing_id", "ent_id", "i", *(x.split()[0] for x in PIECE.split(", "))])

    kinds = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in ("drawing_id", "ent_id"))
    return df.select("drawing_id", "ent_id", "cx", "cy", "mx", "my", "ratio", "t0", "t1").mapInPandas(run, f"{kinds}, i int, {PIECE}")


def square_lines(segments: DataFrame, axis: Column, degrees: float = 5.0, snap: float = 0.2) -> DataFrame:
    """Lines that nearly meet the axis at a right angle meet it so: the end at the axis moves to the other end's projection, the second end first."""
    s, e = S.signed_distance(axis, F.col("x1"), F.col("y1")), S.signed_distance(axis, F.col("x2"), F.col("y2"))
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    n = S.norm(dx, dy)
    off = F.acos(S.clamp(F.abs(S.dot(dx, dy, -axis["dy"], axis["dx"])) / F.greatest(n, F.lit(1e-12)), -1.0, 1.0))
    fit = (n >= 1e-4) & (off <= math.radians(degrees))
    last, first = fit & (F.abs(e) <= snap), fit & (F.abs(e) > snap) & (F.abs(s) <= snap)
    p, q = S.project_on_axis(axis, F.col("x1"), F.col("y1")), S.project_on_axis(axis, F.col("x2"), F.col("y2"))
    new = {"x1": F.when(first, q["x"]).otherwise(F.col("x1")), "y1": F.when(first, q["y"]).otherwise(F.col("y1")), "x2": F.when(last, p["x"]).otherwise(F.col("x2")), "y2": F.when(last, p["y"]).otherwise(F.col("y2"))}
    return segments.select(*(new[c].alias(c) if c in new else F.col(c) for c in segments.columns))


def square_arcs(arcs: DataFrame, axis: Column, degrees: float = 5.0, snap: float = 0.2, keep_side: bool = True) -> DataFrame:
    """Arcs that nearly meet the axis at a right angle get their centre on it, at the radius from where they meet, the start tried first.

    The centre stays on its side of the meeting point, or with keep_side off always goes against the axis's direction.
    """
    names = ("cx", "cy", "r", "a0", "a1", "is_ccw")
    arc = tuple(F.col(c) for c in names)
    sign = F.when(F.col("is_ccw"), 1.0).otherwise(-1.0)
    s, e = (S.arc_point(*arc, F.lit(t)) for t in (0.0, 1.0))

    def meets(p: Column, angle: Column) -> Column:
        t = angle + sign * (math.pi / 2)
        off = F.acos(S.clamp(F.abs(S.dot(F.cos(t), F.sin(t), -axis["dy"], axis["dx"])), -1.0, 1.0))
        return (F.abs(S.signed_distance(axis, p["x"], p["y"])) <= snap) & (off <= math.radians(degrees))

    def moved(p: Column, start: bool) -> Column:
        m = S.project_on_axis(axis, p["x"], p["y"])
        side = S.dot(F.col("cx") - m["x"], F.col("cy") - m["y"], axis["dx"], axis["dy"])
        way = F.when(side >= 0, 1.0).otherwise(-1.0) if keep_side else F.lit(-1.0)
        cx, cy = m["x"] + way * F.col("r") * axis["dx"], m["y"] + way * F.col("r") * axis["dy"]
        a, b = (m, e) if start else (s, m)
        return F.struct(cx.alias("cx"), cy.alias("cy"), F.col("r").alias("r"), S.turn(F.atan2(a["y"] - cy, a["x"] - cx)).alias("a0"), S.turn(F.atan2(b["y"] - cy, b["x"] - cx)).alias("a1"), F.col("is_ccw").alias("is_ccw"))

    new = F.when(meets(s, F.col("a0")), moved(s, True)).when(meets(e, F.col("a1")), moved(e, False)).otherwise(F.struct(*names))
    out = arcs.withColumn("_new", new)
    return out.select(*(F.col(f"_new.{c}").alias(c) if c in names else F.col(c) for c in arcs.columns))
