"""Mirror and rotational symmetry: deviation profiles, axis hypotheses, the best axis, refinement, rotation groups, motif clusters."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plansheet.functions import scalar as S
from plansheet.operators.joins import nearest, nearest_one
from plansheet.operators.tables import each_group, each_pair, grouped_rows, stored

ORDERS = (2, 3, 4, 5, 6, 8, 10, 12, 16)
AXIS = ("ox", "oy", "dx", "dy")
#: A drawing with so many points at most is compared in one array kernel; larger ones go through the grid.
SMALL = 4096


def boxes(pts: DataFrame) -> DataFrame:
    """(drawing_id, b, n, cx, cy): box, count and mean of each drawing's points (x, y)."""
    return pts.groupBy("drawing_id").agg(S.box(F.min("x"), F.min("y"), F.max("x"), F.max("y")).alias("b"), F.count(F.lit(1)).alias("n"), F.avg("x").alias("cx"), F.avg("y").alias("cy"))


class Nearest:
    """Distances to the nearest of some points: which is nearest comes from products of matrices small enough for a core's cache, its distance from the points."""

    def __init__(self, points: np.ndarray, cells: int = 1 << 14):
        self.all = points
        self.middle = points.mean(0)
        self.turned = np.ascontiguousarray((points - self.middle).T)
        self.size, self.block = (self.turned * self.turned).sum(0), max(1, cells // len(points))

    def distance(self, a: np.ndarray) -> np.ndarray:
        m, near = -2.0 * (a - self.middle), np.empty(len(a), np.intp)
        for i in range(0, len(a), self.block):
            d2 = m[i : i + self.block] @ self.turned
            d2 += self.size
            near[i : i + self.block] = d2.argmin(1)
        off = a - self.all[near]
        return np.sqrt(off[:, 0] ** 2 + off[:, 1] ** 2)


def nearest_distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The distance of each point of a to the nearest of b."""
    return Nearest(b).distance(a)


def mirrored(p: np.ndarray, o: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Points mirrored about the axis through o along d."""
    return 2 * (o + ((p - o) @ d)[:, None] * d) - p


def _mirror_kernel(left: pa.Table, right: pa.Table) -> pa.Table:
    """Deviations of one drawing's points (id, x, y) for each of its axes."""
    out = pa.schema([left.schema.field("drawing_id"), ("axis_id", pa.int64()), left.schema.field("id"), ("x", pa.float64()), ("y", pa.float64()), ("dev", pa.float64())])
    p = np.column_stack([left.column(c).to_numpy() for c in "xy"])
    made = []
    for k, *a in zip(*(right.column(c).to_pylist() for c in ("axis_id", *AXIS))):
        near = nearest_distance(mirrored(p, np.array(a[:2]), np.array(a[2:])), p)
        made.append(pa.Table.from_arrays([left.column("drawing_id"), pa.array(np.full(len(p), k)), left.column("id"), left.column("x"), left.column("y"), pa.array(near)], schema=out))
    return pa.concat_tables(made)


def deviations(pts: DataFrame, axes: DataFrame) -> DataFrame:
    """(drawing_id, axis_id, id, x, y, dev): the distance of each point's mirror image to the nearest point of its drawing.

    pts has drawing_id, id, x, y; axes drawing_id, axis_id, a. A small drawing's points are compared in one array kernel,
    which costs no row for each pair; the points of large drawings are dealt by grid cells.
    """
    pts = pts.select("drawing_id", "id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    size = pts.groupBy("drawing_id").agg(F.count(F.lit(1)).alias("_n"))
    large = stored(size.where(F.col("_n") > SMALL).select("drawing_id"), "large-drawings")
    none = large.isEmpty()
    flat = axes.select("drawing_id", F.col("axis_id").cast("bigint").alias("axis_id"), *(F.col("a")[k].alias(k) for k in AXIS))
    few = (lambda df: df) if none else (lambda df: df.join(large, "drawing_id", "left_anti"))
    kinds = {c: pts.schema[c].dataType.simpleString() for c in ("drawing_id", "id")}
    near = each_pair(few(pts), few(flat), _mirror_kernel, f"drawing_id {kinds['drawing_id']}, axis_id bigint, id {kinds['id']}, x double, y double, dev double")
    if none:
        return near
    image = S.reflect(F.col("a"), F.col("x"), F.col("y"))
    left = pts.join(large, "drawing_id", "left_semi").join(axes, "drawing_id").select("drawing_id", F.struct(F.col("axis_id").cast("bigint").alias("axis_id"), "id").alias("_id"), "x", "y", image["x"].alias("mx"), image["y"].alias("my"))
    right = pts.join(large, "drawing_id", "left_semi").select("drawing_id", F.col("id").alias("rid"), F.col("x").alias("rx"), F.col("y").alias("ry"))
    far = nearest(left.select("drawing_id", F.col("_id").alias("id"), F.col("mx").alias("x"), F.col("my").alias("y")), right)
    return near.unionByName(left.join(far.select("drawing_id", F.col("id").alias("_id"), "dist"), ["drawing_id", "_id"]).select("drawing_id", F.col("_id.axis_id").alias("axis_id"), F.col("_id.id").alias("id"), "x", "y", F.col("dist").alias("dev")))


def profile(devs: DataFrame, tol: float = 0.2, area_error: DataFrame | None = None) -> DataFrame:
    """Mean, RMS, median, greatest, 90th percentile, matched share, score and confidence for each drawing and axis."""
    d = F.col("dev")
    out = devs.groupBy("drawing_id", "axis_id").agg(
        F.count(F.lit(1)).alias("n"), F.avg(d).alias("mean"), F.sqrt(F.avg(d * d)).alias("rms"), F.percentile(d, F.lit(0.5)).alias("median"), F.max(d).alias("max"),
        F.percentile(d, F.lit(0.9)).alias("p90"), F.avg(F.when(d <= tol, 1.0).otherwise(0.0)).alias("matched"),
    )
    if area_error is not None:
        out = out.join(area_error, ["drawing_id", "axis_id"], "left").withColumn("loop_area_error", F.coalesce("loop_area_error", F.lit(0.0)))
    return scored(out, tol)


def scored(profiles: DataFrame, tol: float = 0.2) -> DataFrame:
    """Profiles with score and confidence."""
    out = profiles if "loop_area_error" in profiles.columns else profiles.withColumn("loop_area_error", F.lit(0.0))
    out = out.withColumn("score", S.symmetry_score(F.col("rms"), F.col("matched"), F.col("loop_area_error"), tol))
    return out.withColumn("confidence", S.symmetry_confidence(F.col("score"), F.col("matched")))


def principal_axes(pts: DataFrame) -> DataFrame:
    """(drawing_id, angle, minor): angles of the major and minor axes of the points, in [0, pi), from sample covariances."""
    c = pts.groupBy("drawing_id").agg(F.covar_samp("x", "y").alias("xy"), F.var_samp("x").alias("xx"), F.var_samp("y").alias("yy"))
    a = F.atan2(2.0 * F.col("xy"), F.col("xx") - F.col("yy")) / 2
    return c.select("drawing_id", F.pmod(a, F.lit(math.pi)).alias("angle"), F.pmod(a + math.pi / 2, F.lit(math.pi)).alias("minor"))


def hypotheses(pts: DataFrame, loops: DataFrame | None = None, diagonals: bool = True) -> DataFrame:
    """(drawing_id, axis_id, seed, a): upright and level axes, principal axes, motif bisectors, diagonals."""
    at = stored(boxes(pts).join(principal_axes(pts), "drawing_id"), "boxes")
    m = S.box_of(F.col("b"))
    cx, cy, bx, by, zero = F.col("cx"), F.col("cy"), m["center_x"], m["center_y"], F.lit(0.0)
    seeds = [("vertical", S.vertical_axis(x)) for x in (cx, bx, zero)] + [("horizontal", S.horizontal_axis(y)) for y in (cy, by, zero)]
    seeds += [("principal", S.axis(x, y, F.col(a))) for x, y in ((cx, cy), (bx, by)) for a in ("angle", "minor")]
    if diagonals:
        seeds += [("diagonal", S.axis(cx, cy, F.lit(math.pi * t))) for t in (0.25, 0.75)]
    rows = F.array(*(F.struct(F.lit(k).cast("bigint").alias("axis_id"), F.lit(s).alias("seed"), a.alias("a")) for k, (s, a) in enumerate(seeds)))
    out = at.select("drawing_id", F.explode(rows).alias("h")).select("drawing_id", "h.*")
    if loops is None:
        return out
    size = m["area"] * 0.8
    motif = loops.join(at.select("drawing_id", size.alias("_most")), "drawing_id").where("area < _most").withColumn("_k", F.row_number().over(Window.partitionBy("drawing_id").orderBy("rank"))).where("_k <= 10")
    motif = motif.select("drawing_id", "_k", "x", "y", "area")
    pair = motif.alias("p").join(motif.alias("q"), "drawing_id").where("p._k < q._k and greatest(p.area, q.area) > 1e-3 and abs(p.area - q.area) / greatest(p.area, q.area) < 0.25")
    dx, dy = F.col("q.x") - F.col("p.x"), F.col("q.y") - F.col("p.y")
    pair = pair.where(S.norm(dx, dy) > 10.0)
    bisector = S.axis((F.col("p.x") + F.col("q.x")) / 2, (F.col("p.y") + F.col("q.y")) / 2, F.atan2(dx, -dy))
    return out.unionByName(pair.select("drawing_id", (100 + F.col("p._k") * 100 + F.col("q._k")).cast("bigint").alias("axis_id"), F.lit("bisector").alias("seed"), bisector.alias("a")))


#: Random axes are tried on a sample of at most twice so many points.
RANSAC_POINTS = 150


def bisectors(p: np.ndarray, tol: float = 0.2, trials: int = 35, seed: int = 42) -> list[tuple[int, float, float, float, float]]:
    """(inliers, their mean distance, x, y, angle): up to three bisectors of random pairs that map over 40 % of the points onto others, best first."""
    rng, out = np.random.default_rng(seed), []
    near, most = Nearest(p) if len(p) else None, 0.4 * len(p)
    part = len(p) - int(most) // 2  # of the rest too few are left for a trial without a fifth
    for _ in range(trials if len(p) >= 12 else 0):
        i, j = rng.choice(len(p), 2, replace=False)
        v = p[j] - p[i]
        n = math.hypot(*v)
        if n < 15.0:
            continue
        o, d = (p[i] + p[j]) / 2, np.array([-v[1], v[0]]) / n
        image = mirrored(p, o, d)
        dist = near.distance(image[:part])
        if (dist <= 1.5 * tol).sum() + len(p) - part <= most:
            continue
        dist = np.concatenate([dist, near.distance(image[part:])])
        good = dist <= 1.5 * tol
        if good.sum() > most:
            out.append((int(good.sum()), float(dist[good].mean()), float(o[0]), float(o[1]), math.atan2(d[1], d[0]) % math.pi))
    return sorted(out, key=lambda r: (-r[0], r[1]))[:3]


def ransac(pts: DataFrame, tol: float = 0.2, trials: int = 35, most: int = RANSAC_POINTS, seed: int = 42) -> DataFrame:
    """(drawing_id, axis_id, seed, a, inliers): the bisectors of each drawing, tried on a sample of at most 2 * most points."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        out = bisectors(pdf.sort_values("id")[["x", "y"]].to_numpy(float), tol, trials, seed)
        key = pdf.drawing_id.iloc[0]
        return pd.DataFrame([(key, 1000 + k, r[0], *r[2:]) for k, r in enumerate(out)], columns=["drawing_id", "axis_id", "inliers", "ox", "oy", "angle"])

    some = strided(pts, most)
    kind = pts.schema["drawing_id"].dataType.simpleString()
    out = some.select("drawing_id", "id", "x", "y").groupBy("drawing_id").applyInPandas(fit, f"drawing_id {kind}, axis_id bigint, inliers bigint, ox double, oy double, angle double")
    return out.select("drawing_id", "axis_id", F.lit("ransac").alias("seed"), S.axis(F.col("ox"), F.col("oy"), F.col("angle")).alias("a"), "inliers")


def strided(pts: DataFrame, most: int) -> DataFrame:
    """Every k-th point by id, k being the count over `most`, rounded down, and 1 at least."""
    w = Window.partitionBy("drawing_id")
    step = F.greatest(F.lit(1), F.floor(F.col("_n") / most))
    return pts.withColumn("_n", F.count(F.lit(1)).over(w)).withColumn("_k", F.row_number().over(w.orderBy("id")) - 1).where(F.col("_k") % step == 0).drop("_n", "_k")


def _nelder_mead(loss, x: np.ndarray, iterations: int = 60, tol: float = 1e-3) -> np.ndarray:
    """The downhill simplex with coefficients 1, 2, 1/2 and 1/2."""
    simplex = [x] + [x + e for e in np.diag(np.where(x == 0, 0.00025, 0.05 * x))]
    value = [loss(p) for p in simplex]
    for _ in range(iterations):
        order = np.argsort(value, kind="stable")
        simplex, value = [simplex[i] for i in order], [value[i] for i in order]
        if max(np.abs(p - simplex[0]).max() for p in simplex[1:]) <= tol and max(abs(v - value[0]) for v in value[1:]) <= tol:
            break
        centre = np.mean(simplex[:-1], axis=0)
        tried = {k: centre + k * (centre - simplex[-1]) for k in (1.0, 2.0, 0.5, -0.5)}
        one = loss(tried[1.0])
        if one < value[0]:
            two = loss(tried[2.0])
            simplex[-1], value[-1] = (tried[2.0], two) if two < one else (tried[1.0], one)
        elif one < value[-2]:
            simplex[-1], value[-1] = tried[1.0], one
        else:
            inner = 0.5 if one < value[-1] else -0.5
            got = loss(tried[inner])
            if got < min(one, value[-1]):
                simplex[-1], value[-1] = tried[inner], got
            else:
                simplex = [simplex[0]] + [simplex[0] + 0.5 * (p - simplex[0]) for p in simplex[1:]]
                value = [value[0]] + [loss(p) for p in simplex[1:]]
    return simplex[int(np.argmin(value))]


#: Millimetres along an axis's normal from which its refinement may start; none comes first and wins ties.
SHIFTS = (0.0, -0.5, 0.5, -1.0, 1.0, -1.5, 1.5, -2.0, 2.0)


def simplex_axis(p: np.ndarray, o: np.ndarray, angle: float, distance) -> tuple[float, float, float]:
    """(x, y, angle) of the axis through o at angle, moved along its normal and turned to the least trimmed mean square of distance(mirrored points)."""
    normal = np.array([-math.sin(angle), math.cos(angle)])

    def loss(v: np.ndarray) -> float:
        dist = distance(mirrored(p, o + normal * v[0], np.array([math.cos(angle + v[1]), math.sin(angle + v[1])])))
        place = 0.9 * (len(dist) - 1)
        low, high = np.partition(dist, [int(place), min(int(place) + 1, len(dist) - 1)])[[int(place), min(int(place) + 1, len(dist) - 1)]]
        kept = dist[dist <= max(2.0, low + (place - int(place)) * (high - low))]  # the 90th percentile
        return float((kept**2).mean())

    # the simplex starts small and stays in the hollow that it starts in: the best of some shifts on both sides is where it starts
    start = min(([k, 0.0] for k in SHIFTS), key=lambda v: loss(np.array(v)))
    shift, by = _nelder_mead(loss, np.array(start))
    return (*(o + normal * shift), (angle + by) % math.pi)


def snapped(ox: float, oy: float, angle: float, tol_deg: float = 2.5) -> tuple[float, float, float, float]:
    """S.snap_axis of numbers."""
    tol = math.radians(tol_deg)
    if abs(angle - math.pi / 2) < tol:
        return ox, 0.0, 0.0, 1.0
    return (0.0, oy, 1.0, 0.0) if angle < tol or abs(angle - math.pi) < tol else (ox, oy, math.cos(angle), math.sin(angle))


def refine(pts: DataFrame, axes: DataFrame, most: int = 200) -> DataFrame:
    """axes (drawing_id, axis_id, a) moved along their normal and turned to the least trimmed mean square, then made upright or level if nearly so.

    Works on a sample of at most 2 * most points of a drawing, so a kernel's memory is bounded.
    """
    some = strided(pts, most).groupBy("drawing_id").agg(F.collect_list("x").alias("xs"), F.collect_list("y").alias("ys"))
    rows = axes.join(some, "drawing_id").select("drawing_id", "axis_id", *(F.col("a")[k].alias(k) for k in AXIS), "xs", "ys")

    def fit(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                p = np.column_stack([r.xs, r.ys])
                out.append((r.drawing_id, r.axis_id, *simplex_axis(p, np.array([r.ox, r.oy]), math.atan2(r.dy, r.dx) % math.pi, lambda m: nearest_distance(m, p))))  # noqa: B023
            yield pd.DataFrame(out, columns=["drawing_id", "axis_id", "ox", "oy", "angle"])

    kind = pts.schema["drawing_id"].dataType.simpleString()
    out = rows.mapInPandas(fit, f"drawing_id {kind}, axis_id bigint, ox double, oy double, angle double")
    return out.select("drawing_id", "axis_id", S.snap_axis(F.col("ox"), F.col("oy"), F.col("angle")).alias("a"))


def best_axis(pts: DataFrame, axes: DataFrame, tol: float = 0.2, keep: int = 4, refined: bool = True, area_error=None) -> DataFrame:
    """The axis with the least RMS of each drawing, after refining the `keep` best, with its profile."""
    rank = lambda df: df.withColumn("_k", F.row_number().over(Window.partitionBy("drawing_id").orderBy(F.round("rms", 9), "axis_id")))
    first = stored(rank(profile(deviations(pts, axes), tol)).where(F.col("_k") <= (keep if refined else 1)).drop("_k").join(axes.select("drawing_id", "axis_id", "a"), ["drawing_id", "axis_id"]), "best-axes")
    if not refined:
        return first
    moved = stored(refine(pts, first.select("drawing_id", "axis_id", "a")), "refined-axes")
    again = profile(deviations(pts, moved), tol).join(moved, ["drawing_id", "axis_id"]).withColumn("_refined", F.lit(1))
    both = first.withColumn("_refined", F.lit(0)).unionByName(again)
    w = Window.partitionBy("drawing_id").orderBy(F.round("rms", 9), "_refined", "axis_id")
    return both.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k", "_refined")


def secondary_axis(pts: DataFrame, best: DataFrame, tol: float = 0.2, least: float = 0.4, refined: bool = True) -> DataFrame:
    """The better of the axes square to the best one through the points' mean and the box's centre, if its confidence is over `least`."""
    at = boxes(pts)
    m = S.box_of(F.col("b"))
    a = S.axis_angle(F.col("a")) + math.pi / 2
    two = F.array(*(F.struct(F.lit(k).cast("bigint").alias("axis_id"), S.axis(x, y, a).alias("a")) for k, (x, y) in enumerate(((F.col("cx"), F.col("cy")), (m["center_x"], m["center_y"])))))
    axes = stored(best.select("drawing_id", "a").join(at, "drawing_id").select("drawing_id", F.explode(two).alias("h")).select("drawing_id", "h.*"), "second-axes")
    return best_axis(pts, axes, tol, 2, refined).where(F.col("confidence") > least)


def loop_errors(loops: DataFrame, axes: DataFrame) -> DataFrame:
    """(drawing_id, axis_id, loop_id, partner, dist, area_error): each loop's counterpart, the loop nearest to its mirrored centroid."""
    c = S.reflect(F.col("a"), F.col("x"), F.col("y"))
    inner = loops.where("rank > 0")
    left = inner.join(axes, "drawing_id").select("drawing_id", F.struct("axis_id", "loop_id", "area").alias("id"), c["x"].alias("x"), c["y"].alias("y"))
    right = inner.select("drawing_id", F.struct(F.col("loop_id").alias("partner"), F.col("area").alias("area")).alias("rid"), F.col("x").alias("rx"), F.col("y").alias("ry"))
    best = nearest_one(left, right).select("drawing_id", "id.axis_id", "id.loop_id", "id.area", "rid.partner", F.col("rid.area").alias("_area"), "dist")
    top = F.greatest("area", "_area")
    return best.select("drawing_id", "axis_id", "loop_id", "partner", "dist", F.when(top > 1e-9, F.abs(F.col("area") - F.col("_area")) / top).otherwise(0.0).alias("area_error"))


def greedy_pairs(x: np.ndarray, y: np.ndarray, area: np.ndarray, mx: np.ndarray, my: np.ndarray, off: np.ndarray, area_limit: float, far: float, near: float) -> list[tuple[int, int, float, float]]:
    """(i, j, distance, area error) of loops in order: each takes the nearest to its image (mx, my) of the free ones like it in area, if less than
    far off; itself if none is like it and it is less than near off the axis.

    The nearest is looked for in the grid's cells about the image. Whether any is like it, the next free ones by area say.
    """
    n, size = len(x), far * 1.001
    cells: dict[tuple[int, int], list[int]] = {}
    for i, c in enumerate(zip(np.floor(x / size).astype(int).tolist(), np.floor(y / size).astype(int).tolist())):
        cells.setdefault(c, []).append(i)
    by = np.argsort(area, kind="stable")
    place = np.empty(n, np.int64)
    place[by] = np.arange(n)
    place, by = place.tolist(), by.tolist()
    up, down = list(range(n + 1)), list(range(n + 1))  # the next free place from p on, and that before p (places from 1 on), by path halving

    def root(to: list[int], p: int) -> int:
        while to[p] != p:
            to[p] = to[to[p]]
            p = to[p]
        return p

    def like(i: int, k: np.ndarray) -> np.ndarray:
        top = np.maximum(area[k], area[i])
        return free[k] & (top > 1e-4) & (np.abs(area[k] - area[i]) < area_limit * top) & (k != i)

    def any_like(i: int) -> bool:
        p = place[i]
        k = [by[q] for q in (root(up, p + 1), root(down, p) - 1) if 0 <= q < n]
        if like(i, np.array(k, np.int64)).any():
            return True
        sure = area_limit < 1 and area[i] > 2e-4 and all(abs(area[q] - area[i]) > (area_limit + 1e-9) * max(area[q], area[i]) for q in k)
        return not sure and bool(like(i, np.arange(n)).any())

    def take(i: int) -> None:
        free[i] = False
        p = place[i]
        up[p], down[p + 1] = p + 1, p

    free, out = np.ones(n, bool), []
    cx, cy = np.floor(mx / size).astype(int).tolist(), np.floor(my / size).astype(int).tolist()
    for i in range(n):
        if not free[i]:
            continue
        k = np.array(sorted(q for a in (-1, 0, 1) for b in (-1, 0, 1) for q in cells.get((cx[i] + a, cy[i] + b), ())), np.int64)
        k = k[like(i, k)]
        d = np.hypot(mx[i] - x[k], my[i] - y[k])
        if len(k) and d.min() < far:
            j = int(k[d.argmin()])
            take(i)
            take(j)
            out.append((i, j, float(d.min()), float(abs(area[i] - area[j]) / max(area[i], area[j]))))
        elif off[i] < near and not len(k) and not any_like(i):
            take(i)
            out.append((i, i, float(off[i]), 0.0))
    return out


def mirror_pairs(loops: DataFrame, axes: DataFrame, area_limit: float = 0.35, far: float = 30.0, near: float = 15.0) -> DataFrame:
    """(drawing_id, loop_left, loop_right, dist, area_error): greedy one-to-one pairs in order of area, loops on the axis with themselves.

    The order matters, so a drawing's loops (some numbers each, not their points) are paired in one kernel.
    """

    def pair(t: pa.Table) -> pa.Table:
        t = t.sort_by("rank")
        ids, (x, y, area) = t.column("loop_id").to_pylist(), (t.column(c).to_numpy() for c in ("x", "y", "area"))
        ox, oy, dx, dy = (t.column(k)[0].as_py() for k in AXIS)
        along = (x - ox) * dx + (y - oy) * dy
        mx, my, off = 2 * (ox + along * dx) - x, 2 * (oy + along * dy) - y, np.abs((x - ox) * dy - (y - oy) * dx)
        out = [(ids[i], ids[j], d, e) for i, j, d, e in greedy_pairs(x, y, area, mx, my, off, area_limit, far, near)]
        return grouped_rows(t, out, [("loop_left", t.schema.field("loop_id").type), ("loop_right", t.schema.field("loop_id").type), ("dist", pa.float64()), ("area_error", pa.float64())])

    rows = loops.join(axes.select("drawing_id", *(F.col("a")[k].alias(k) for k in AXIS)), "drawing_id").select("drawing_id", "loop_id", "rank", "x", "y", "area", *AXIS)
    kind, lid = (loops.schema[k].dataType.simpleString() for k in ("drawing_id", "loop_id"))
    return each_group(rows, pair, f"drawing_id {kind}, loop_left {lid}, loop_right {lid}, dist double, area_error double")


# rotation


def centred(pts: DataFrame, tol: float = 0.2, centres: DataFrame | None = None) -> DataFrame:
    """pts relative to their drawing's centre (its points' mean, or centres' cx, cy), with radius, angle and whether far enough from it."""
    at = boxes(pts).select("drawing_id", "cx", "cy") if centres is None else centres
    out = pts.join(at, "drawing_id").select("drawing_id", "id", (F.col("x") - F.col("cx")).alias("x"), (F.col("y") - F.col("cy")).alias("y"))
    out = out.withColumn("radius", S.norm(F.col("x"), F.col("y"))).withColumn("theta", S.turn(F.atan2("y", "x")))
    return out.withColumn("active", F.col("radius") > max(0.5, 2 * tol))


def angle_histogram(rel: DataFrame, bins: int = 180) -> DataFrame:
    """(drawing_id, bin, n): active points by angle, empty bins included."""
    b = F.least(F.lit(bins - 1), F.floor(F.col("theta") / S.TAU * bins)).cast("int")
    counts = rel.where("active").groupBy("drawing_id", b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    every = rel.select("drawing_id").distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return every.join(counts, ["drawing_id", "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def smoothed(histogram: DataFrame) -> DataFrame:
    """(drawing_id, bin, s): a quarter, a half and a quarter of a bin and its neighbours around the circle."""
    ring = histogram.groupBy("drawing_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("bin", "n"))), lambda r: r["n"].cast("double")).alias("h"))
    at = lambda k: F.get("h", F.pmod(F.col("bin") + k, F.size("h")))
    return ring.select("drawing_id", "h", F.explode(F.sequence(F.lit(0), F.size("h") - 1)).alias("bin")).select("drawing_id", "bin", (0.25 * at(-1) + 0.5 * at(0) + 0.25 * at(1)).alias("s"))


def fourier(smooth: DataFrame, bins: int = 180) -> DataFrame:
    """(drawing_id, rot_order, power): the spectrum's magnitude at the orders looked at."""
    o = smooth.withColumn("rot_order", F.explode(F.array(*map(F.lit, ORDERS))))
    a = F.col("bin") * F.col("rot_order") * (S.TAU / bins)
    return o.groupBy("drawing_id", "rot_order").agg(F.sqrt(F.pow(F.sum(F.col("s") * F.cos(a)), F.lit(2.0)) + F.pow(F.sum(F.col("s") * F.sin(a)), F.lit(2.0))).alias("power"))


def _within(moved: DataFrame, rel: DataFrame, by: list[str]) -> DataFrame:
    """Distances of moved points (drawing_id, *by, id, mx, my) to the nearest active point."""
    right = rel.where("active").select("drawing_id", F.col("id").alias("rid"), F.col("x").alias("rx"), F.col("y").alias("ry"))
    left = moved.select("drawing_id", F.struct(*by, "id").alias("id"), F.col("mx").alias("x"), F.col("my").alias("y"))
    return nearest_one(left, right).select("drawing_id", *(F.col(f"id.{c}").alias(c) for c in by), F.col("dist").alias("dev"))


def order_matches(rel: DataFrame, tol: float = 0.2) -> DataFrame:
    """(drawing_id, rot_order, matched, rms, max, confidence) of a turn by each order's step."""
    moved = rel.where("active").withColumn("rot_order", F.explode(F.array(*map(F.lit, ORDERS))))
    a = S.TAU / F.col("rot_order")
    moved = moved.withColumn("mx", F.col("x") * F.cos(a) - F.col("y") * F.sin(a)).withColumn("my", F.col("x") * F.sin(a) + F.col("y") * F.cos(a))
    d = F.col("dev")
    out = _within(moved, rel, ["rot_order"]).groupBy("drawing_id", "rot_order").agg(F.avg(F.when(d <= tol, 1.0).otherwise(0.0)).alias("matched"), F.sqrt(F.avg(d * d)).alias("rms"), F.max(d).alias("max"))
    return out.withColumn("confidence", F.col("matched") * F.exp(-F.col("rms") / max(0.5, 3 * tol)))


def choose_order(matches: DataFrame, spectrum: DataFrame) -> DataFrame:
    """(drawing_id, rot_order, matched, rms, max, confidence): orders by falling power, a later one taken if clearly surer or a multiple as sure."""
    rows = matches.join(spectrum, ["drawing_id", "rot_order"]).groupBy("drawing_id").agg(
        F.array_sort(F.collect_list(F.struct((-F.col("power")).alias("_p"), "rot_order", "matched", "rms", "max", "confidence"))).alias("o")
    )
    none = F.struct(F.lit(1).alias("rot_order"), F.lit(0.0).alias("matched"), F.lit(0.0).alias("rms"), F.lit(0.0).alias("max"), F.lit(0.0).alias("confidence"))

    def step(best: Column, o: Column) -> Column:
        some = best["rot_order"] > 1
        part = some & (o["rot_order"] < best["rot_order"]) & (best["rot_order"] % o["rot_order"] == 0)
        multiple = some & (o["rot_order"] > best["rot_order"]) & (o["rot_order"] % best["rot_order"] == 0) & (o["confidence"] >= best["confidence"] - 0.03)
        surer = (o["confidence"] > best["confidence"] + 0.03) | ((best["confidence"] == 0.0) & (o["confidence"] > 0.5))
        return F.when((o["matched"] >= 0.65) & ~part & (multiple | surer), F.struct(*(o[k].alias(k) for k in ("rot_order", "matched", "rms", "max", "confidence")))).otherwise(best)

    return rows.select("drawing_id", F.aggregate("o", none, step).alias("b")).select("drawing_id", "b.*")


def dihedral(rel: DataFrame, chosen: DataFrame, tol: float = 0.2, least: float = 0.6) -> DataFrame:
    """(drawing_id, n_axes, is_dihedral): mirror axes at half steps that map enough points, counted against the active ones."""
    k = chosen.where("rot_order > 1").select("drawing_id", "rot_order", F.explode(F.sequence(F.lit(0), F.col("rot_order") - 1)).alias("k"))
    a = F.pmod(F.col("k") * math.pi / F.col("rot_order"), F.lit(math.pi))
    moved = rel.join(k, "drawing_id").withColumn("mx", F.cos(2 * a) * F.col("x") + F.sin(2 * a) * F.col("y")).withColumn("my", F.sin(2 * a) * F.col("x") - F.cos(2 * a) * F.col("y"))
    hits = _within(moved, rel, ["rot_order", "k"]).groupBy("drawing_id", "rot_order", "k").agg(F.count_if(F.col("dev") <= tol).alias("hits"))
    n = rel.where("active").groupBy("drawing_id").agg(F.count(F.lit(1)).alias("n"))
    good = hits.join(n, "drawing_id").groupBy("drawing_id", "rot_order").agg(F.count_if(F.col("hits") / F.col("n") >= least).alias("n_axes"))
    return good.select("drawing_id", "n_axes", (F.col("n_axes") >= F.greatest(F.lit(1), F.floor(F.col("rot_order") / 2))).alias("is_dihedral"))


def rotational(pts: DataFrame, tol: float = 0.2, centres: DataFrame | None = None) -> DataFrame:
    """The rotation group of each drawing; none for drawings with fewer than 6 points away from the centre."""
    rel = stored(centred(pts, tol, centres), "centred")
    enough = rel.where("active").groupBy("drawing_id").agg(F.count(F.lit(1)).alias("n")).where("n >= 6").select("drawing_id")
    some = stored(rel.join(enough, "drawing_id", "left_semi"), "centred-some")
    chosen = stored(choose_order(order_matches(some, tol), fourier(smoothed(angle_histogram(some)))), "orders")
    out = rel.select("drawing_id").distinct().join(chosen, "drawing_id", "left").join(dihedral(some, chosen, tol), "drawing_id", "left")
    out = out.select("drawing_id", F.coalesce("rot_order", F.lit(1)).alias("rot_order"), *(F.coalesce(c, F.lit(0.0)).alias(c) for c in ("matched", "rms", "max", "confidence")), F.coalesce("n_axes", F.lit(0)).alias("n_axes"), F.coalesce("is_dihedral", F.lit(False)).alias("is_dihedral"))
    o = F.col("rot_order")
    return out.withColumn("symmetry_group", F.when(o == 1, "None").otherwise(F.concat(F.when(F.col("is_dihedral"), "D").otherwise("C"), o.cast("string")))).withColumn("step_deg", 360.0 / o)
