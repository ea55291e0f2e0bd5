"""Small drawings in two passes: a cogrouped array kernel for their graphs and rings, one for their axes.

A drawing of some hundred lines costs more in exchanges than in arithmetic when each step of its analysis is a job of its
own. Here a drawing's segments become nodes, edges and rings in one group, and its points and axis hypotheses the best
axis and the one square to it in another; tables of many small drawings are two jobs however many steps that takes. Both
give the rows that the operators for large drawings give (tested), and callers split by size.

Three bounds spare work and change no result. A hypothesis ends when the squares so far exceed what the worst of the kept
ones has in all. Once an axis is exact to nine places, none that comes later and no refinement can be better. And while an axis is refined, a
mirrored point is compared with the few points nearest at the start: what isn't among these is farther than the last of
them was, less the distance the image has moved since, so a nearer one is settled and only the others look at all points.

Sheets are often cut many times: a worker keeps what it found for the last drawings, and one that is equal to the last bit
(its lines' numbers included) takes that.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plansheet.functions import scalar as S
from plansheet.operators import symmetry
from plansheet.operators.graph import labels
from plansheet.operators.symmetry import AXIS, Nearest, mirrored
from plansheet.operators.tables import each_group, each_pair, stored
from plansheet.operators.topology import cycle_basis

SEG = ("x1", "y1", "x2", "y2")
_XY = pa.struct([("x", pa.float64()), ("y", pa.float64())])
_NODES = pa.list_(pa.struct([("node_id", pa.int64()), ("x", pa.float64()), ("y", pa.float64()), ("degree", pa.int64())]))
_EDGES = pa.list_(pa.struct([("seg_id", pa.int64()), ("u", pa.int64()), ("v", pa.int64())]))
#: Drawings of which a worker keeps what it found; one has symmetry.SMALL points at most, so these are some tens of megabytes at most.
KEPT = 256
_GRAPH = "nodes array<struct<node_id:bigint,x:double,y:double,degree:bigint>>, edges array<struct<seg_id:bigint,u:bigint,v:bigint>>, rings array<array<struct<x:double,y:double>>>"


# graphs


def ordered(t: pa.Table, by: str) -> pa.Table:
    """t by a column of whole numbers, in which it often is already."""
    k = t.column(by).to_numpy()
    return t.take(pa.array(np.argsort(k, kind="stable"))) if (k[1:] < k[:-1]).any() else t


def clustered(ids: np.ndarray, xy: np.ndarray, tol: float) -> np.ndarray:
    """For each point the smallest id linked with it by steps of at most tol."""
    spots, where = np.unique(xy[:, 0] + 1j * xy[:, 1], return_inverse=True)  # in order of x and y; a row's own order takes some times as long
    spots = np.column_stack([spots.real, spots.imag])
    name = np.full(len(spots), np.iinfo(np.int64).max)
    np.minimum.at(name, where, ids)
    near = np.hypot(*(spots[:, None, k] - spots[None, :, k] for k in (0, 1))) <= tol
    a, b = np.nonzero(np.triu(near, 1))
    if len(a):
        node, root = labels(name[a], name[b])
        at = np.searchsorted(node, name)
        held = (at < len(node)) & (node[np.minimum(at, len(node) - 1)] == name)
        name = np.where(held, root[np.minimum(at, len(node) - 1)], name)
    return name[where]


def graph_of(seg: np.ndarray, ends: np.ndarray, tol: float) -> tuple[list[dict], list[dict], list[list[dict]]]:
    """Nodes, edges and rings of one drawing's segments: ids and (x1, y1, x2, y2)."""
    ids, xy = np.concatenate([2 * seg, 2 * seg + 1]), np.concatenate([ends[:, :2], ends[:, 2:]])
    node = clustered(ids, xy, tol)
    u, v = node[: len(seg)], node[len(seg) :]
    names, where, n = np.unique(node, return_inverse=True, return_counts=True)
    x, y = (np.bincount(where, xy[:, k]) / n for k in (0, 1))
    if len(set(seg.tolist())) == len(seg):
        a, b = where[: len(seg)], where[len(seg) :]
        degree = np.bincount(a, minlength=len(names)) + np.bincount(b[a != b], minlength=len(names))
    else:
        degree = np.bincount(np.unique(np.stack([where, np.concatenate([seg, seg])], 1), axis=0)[:, 0], minlength=len(names))
    nodes = [dict(zip(("node_id", "x", "y", "degree"), r)) for r in zip(names.tolist(), x.tolist(), y.tolist(), degree.tolist())]
    edges = [dict(zip(("seg_id", "u", "v"), r)) for r in zip(seg.tolist(), u.tolist(), v.tolist())]
    simple = sorted({(min(e), max(e)) for e in zip(u.tolist(), v.tolist()) if e[0] != e[1]})
    if not simple:
        return nodes, edges, []
    a, b = np.array(simple).T
    member, root = labels(a, b)
    part = dict(zip(member.tolist(), root.tolist()))
    found = [c for c in cycle_basis(simple) if len(c) >= 3]
    found = [c for _, c in sorted(enumerate(found), key=lambda r: (part[r[1][0]], r[0]))]
    spot = dict(zip(names.tolist(), zip(x.tolist(), y.tolist())))
    return nodes, edges, [[{"x": spot[k][0], "y": spot[k][1]} for k in c] for c in found]


@lru_cache(KEPT)
def kept_graph(seg: bytes, ends: bytes, tol: float) -> tuple[pa.Array, ...]:
    """What graph_of gives, as columns of one row, of the bytes of its arrays."""
    made = graph_of(np.frombuffer(seg, np.int64), np.frombuffer(ends).reshape(-1, 4), tol)
    return tuple(pa.array([m], k) for m, k in zip(made, (_NODES, _EDGES, pa.list_(pa.list_(_XY)))))


def graphs(segments: DataFrame, tol: float = 0.1) -> DataFrame:
    """(drawing_id, nodes, edges, rings): the graph of each drawing and the rings of its cycle basis, by component."""

    def run(t: pa.Table) -> pa.Table:
        t = ordered(t, "seg_id")
        made = kept_graph(t.column("seg_id").to_numpy().tobytes(), np.column_stack([t.column(c).to_numpy() for c in SEG]).tobytes(), tol)
        return pa.table([t.column("drawing_id").slice(0, 1).combine_chunks(), *made], names=["drawing_id", "nodes", "edges", "rings"])

    rows = segments.select("drawing_id", F.col("seg_id").cast("bigint").alias("seg_id"), *(F.col(c).cast("double").alias(c) for c in SEG))
    return each_group(rows, run, f"drawing_id {segments.schema['drawing_id'].dataType.simpleString()}, {_GRAPH}")


def welded(segments: DataFrame, radius: float, keep_tabs: bool, low: float, high: float) -> DataFrame:
    """Segments with their ends as repair.weld moves them."""

    def run(t: pa.Table) -> pa.Table:
        t = ordered(t, "seg_id")
        seg, ends = t.column("seg_id").to_numpy(), np.column_stack([t.column(c).to_numpy() for c in SEG])
        xy = ends.reshape(-1, 2)  # in order of 2 * seg_id and 2 * seg_id + 1
        d = np.sqrt((xy[:, None, 0] - xy[None, :, 0]) ** 2 + (xy[:, None, 1] - xy[None, :, 1]) ** 2)
        near, held = d <= radius, np.zeros(len(xy), bool)
        if keep_tabs:
            own = np.repeat(seg, 2)
            held = ((d >= low) & (d <= high) & (own[:, None] != own[None, :])).any(1)
        near &= ~held[None, :]
        seen, moved = np.zeros(len(xy), bool), xy.copy()
        for a in np.nonzero(near.sum(1) > 1)[0]:
            if not seen[a]:
                ball = np.nonzero(near[a])[0]
                seen[ball] = True
                moved[ball] = xy[ball].sum(0) / len(ball)
        new = dict(zip(SEG, moved.reshape(-1, 4).T))
        return pa.table([pa.array(new[c]) if c in new else t.column(c) for c in t.column_names], names=t.column_names)

    df = segments.withColumns({c: F.col(c).cast("double") for c in SEG})
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return each_group(df, run, schema).where(S.distance(*(F.col(c) for c in SEG)) > 1e-4)


# axes


class Images:
    """Distances of images of points to the points, exact, while the images stay near where they were."""

    def __init__(self, near: Nearest, start: np.ndarray, k: int = 2):
        self.near, self.k = near, min(k, len(near.all))
        self.move_to(start)

    def move_to(self, start: np.ndarray) -> None:
        """Notes the k nearest points of each image, and how far the next one is."""
        p, block = self.near.all, self.near.block
        held, self.start, self.far = np.empty((len(start), self.k), np.intp), start, np.full(len(start), np.inf)
        for i in range(0, len(start), block):
            d2 = (start[i : i + block, :1] - p[:, 0]) ** 2
            d2 += (start[i : i + block, 1:] - p[:, 1]) ** 2
            row = np.arange(len(d2))
            for k in range(self.k):
                held[i : i + block, k] = least = d2.argmin(1)
                d2[row, least] = np.inf
            self.far[i : i + block] = np.sqrt(d2.min(1))
        self.x, self.y = p[held, 0], p[held, 1]

    def distance(self, m: np.ndarray) -> np.ndarray:
        d = np.sqrt(((self.x - m[:, :1]) ** 2 + (self.y - m[:, 1:]) ** 2).min(1))
        off = m - self.start
        open_ = np.nonzero(d > self.far - np.sqrt(off[:, 0] ** 2 + off[:, 1] ** 2))[0]
        if 4 * len(open_) > len(m):
            self.move_to(m)
            return np.sqrt(((self.x - m[:, :1]) ** 2 + (self.y - m[:, 1:]) ** 2).min(1))
        if len(open_):
            d[open_] = self.near.distance(m[open_])
        return d


def refined(p: np.ndarray, near: Nearest, o: np.ndarray, d: np.ndarray) -> np.ndarray:
    """An axis (ox, oy, dx, dy) as symmetry.refine would move it, on the points that it looks at."""
    angle = math.atan2(d[1], d[0]) % math.pi
    images = Images(near, mirrored(p, o, np.array([math.cos(angle), math.sin(angle)])))
    return np.array(symmetry.snapped(*symmetry.simplex_axis(p, o, angle, images.distance)))


def profile_of(dev: np.ndarray, tol: float) -> dict[str, float]:
    median, p90 = np.percentile(dev, [50, 90])
    return {"n": len(dev), "mean": dev.mean(), "rms": math.sqrt((dev * dev).mean()), "median": median, "max": dev.max(), "p90": p90, "matched": (dev <= tol).mean()}


def best_of(p: np.ndarray, near: Nearest, axes: Iterable[tuple[int, np.ndarray]], tol: float, keep: int, step: int) -> tuple[int, np.ndarray, dict]:
    """The number, axis and profile of the axis that symmetry.best_axis takes; axes come by number."""
    kept: list[tuple[float, int, np.ndarray, np.ndarray]] = []
    parts = [slice(i, None, 3) for i in range(3)]  # a part is points from all over
    for k, a in axes:
        most = kept[keep - 1][0] if len(kept) >= keep else math.inf
        image, dev, total = mirrored(p, a[:2], a[2:]), np.empty(len(p)), 0.0
        for part in parts:
            dev[part] = d = near.distance(image[part])
            total += float(d @ d)
            if math.sqrt(total / len(p)) > most + 1e-8:
                break
        else:
            kept = sorted([*kept, (round(math.sqrt(total / len(p)), 9), k, a, dev)], key=lambda r: r[:2])[:keep]
            if not kept[0][0]:
                break
    rms, k, a, dev = kept[0]
    found = [(rms, 0, k, a, dev)]
    if rms > 0:
        some, few = (p, near) if step == 1 else (p[::step], Nearest(np.unique(p[::step], axis=0)))
        for _, k, a, _ in kept:
            a = refined(some, few, a[:2], a[2:])
            dev = near.distance(mirrored(p, a[:2], a[2:]))
            found.append((round(math.sqrt(float(dev @ dev) / len(p)), 9), 1, k, a, dev))
    _, _, k, a, dev = min(found, key=lambda r: r[:3])
    return k, a, profile_of(dev, tol)


_FOUND = pa.schema([("which", pa.int32()), ("axis_id", pa.int64()), *((c, pa.float64()) for c in AXIS), ("n", pa.int64()), *((c, pa.float64()) for c in ("mean", "rms", "median", "max", "p90", "matched"))])


def axes_of(ids: np.ndarray, p: np.ndarray, axes: list[tuple[int, np.ndarray]], tol: float, keep: int, trials: int, most: int, square: bool) -> list[dict]:
    """The best axis (which 0) and, if square, the better of those square to it (which 1) of one drawing's points."""
    p = p[np.argsort(ids, kind="stable")]
    near, step = Nearest(np.unique(p, axis=0)), max(1, len(p) // most)

    def tried() -> Iterator[tuple[int, np.ndarray]]:
        yield from axes
        if trials:  # asked for only if no axis before was exact
            for k, (_, _, x, y, t) in enumerate(symmetry.bisectors(p[:: max(1, len(p) // symmetry.RANSAC_POINTS)], tol, trials)):
                yield 1000 + k, np.array([x, y, math.cos(t), math.sin(t)])

    k, a, found = best_of(p, near, tried(), tol, keep, step)
    out = [{"which": 0, "axis_id": k, **dict(zip(AXIS, a.tolist())), **found}]
    if not square:
        return out
    turned = (math.atan2(a[3], a[2]) + math.pi / 2) % math.pi
    two = ((k, np.array([x, y, math.cos(turned), math.sin(turned)])) for k, (x, y) in enumerate((p.mean(0), (p.min(0) + p.max(0)) / 2)))
    k, a, found = best_of(p, near, two, tol, 2, step)
    return [*out, {"which": 1, "axis_id": k, **dict(zip(AXIS, a.tolist())), **found}]


@lru_cache(KEPT)
def kept_axes(p: bytes, numbers: bytes, axes: bytes, tol: float, keep: int, trials: int, most: int, square: bool) -> tuple[dict, ...]:
    """What axes_of gives, of the bytes of its arrays, the points in order of their ids."""
    p = np.frombuffer(p).reshape(-1, 2)
    own = list(zip(np.frombuffer(numbers, np.int64).tolist(), np.frombuffer(axes).reshape(-1, 4)))
    return tuple(axes_of(np.arange(len(p)), p, own, tol, keep, trials, most, square))


def best_axes(pts: DataFrame, axes: DataFrame, tol: float = 0.2, keep: int = 4, trials: int = 35, most: int = 200, square: bool = True) -> DataFrame:
    """(drawing_id, which, axis_id, the profile's columns, a) of each drawing with points (id, x, y) and axes (axis_id, a)."""
    kind = pts.schema["drawing_id"].dataType.simpleString()

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema([("drawing_id", left.schema.field("drawing_id").type), *_FOUND])
        left, right = ordered(left, "id"), ordered(right, "axis_id")
        p, own = (np.column_stack([t.column(c).to_numpy() for c in names]).tobytes() for t, names in ((left, "xy"), (right, AXIS)))
        rows = kept_axes(p, right.column("axis_id").to_numpy().tobytes(), own, tol, keep, trials, most, square)
        name = left.column("drawing_id")[0].as_py()
        return pa.Table.from_pylist([{"drawing_id": name, **r} for r in rows], schema=schema)

    points = pts.select("drawing_id", F.col("id").cast("bigint").alias("id"), *(F.col(c).cast("double").alias(c) for c in "xy"))
    flat = axes.select("drawing_id", F.col("axis_id").cast("bigint").alias("axis_id"), *(F.col("a")[k].alias(k) for k in AXIS))
    out = each_pair(points, flat, run, f"drawing_id {kind}, which int, axis_id bigint, ox double, oy double, dx double, dy double, n bigint, mean double, rms double, median double, max double, p90 double, matched double")
    return symmetry.scored(out.withColumn("a", F.struct(*AXIS)).drop(*AXIS), tol)


def best_axis(pts: DataFrame, axes: DataFrame, tol: float = 0.2) -> DataFrame:
    """symmetry.best_axis, in a kernel for all but large drawings."""
    large = stored(pts.groupBy("drawing_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > symmetry.SMALL).select("drawing_id"), "large-drawings")
    few = lambda p, a: best_axes(p, a, tol, trials=0, square=False).drop("which")
    if large.isEmpty():
        return few(pts, axes)
    part = lambda how: (df.join(large, "drawing_id", how) for df in (pts, axes))
    return few(*part("left_anti")).unionByName(symmetry.best_axis(*part("left_semi"), tol))


def nodes(graph: DataFrame) -> DataFrame:
    return graph.select("drawing_id", F.explode("nodes").alias("n")).select("drawing_id", "n.*")


def edges(graph: DataFrame, segments: DataFrame) -> DataFrame:
    """The graph's edges with length and layer."""
    own = graph.select("drawing_id", F.explode("edges").alias("e")).select("drawing_id", "e.*")
    length: Column = S.distance(*(F.col(c) for c in SEG)).alias("length")
    return own.join(segments.select("drawing_id", "seg_id", length, "layer"), ["drawing_id", "seg_id"])


def rings(graph: DataFrame) -> DataFrame:
    return graph.select("drawing_id", F.posexplode("rings").alias("loop_id", "pts")).withColumn("loop_id", F.col("loop_id").cast("bigint"))
