"""Topology: endpoints clustered to nodes, degrees, watertightness, closed loops, containment, winding."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plansheet.functions import scalar as S
from plansheet.operators.graph import SMALL, components, labels
from plansheet.operators.joins import bounds, meeting_boxes, range_join
from plansheet.operators.tables import stored


def endpoints(segments: DataFrame) -> DataFrame:
    """(drawing_id, id, seg_id, x, y): both ends of each segment, numbered 2 * seg_id and 2 * seg_id + 1."""
    ends = F.array(F.struct(F.lit(0).alias("e"), F.col("x1").alias("x"), F.col("y1").alias("y")), F.struct(F.lit(1).alias("e"), F.col("x2").alias("x"), F.col("y2").alias("y")))
    return segments.select("drawing_id", "seg_id", F.explode(ends).alias("p")).select("drawing_id", (F.col("seg_id") * 2 + F.col("p.e")).alias("id"), "seg_id", "p.x", "p.y")


def cluster(pts: DataFrame, tol: float) -> DataFrame:
    """pts (drawing_id, id, x, y) with node, the smallest id linked by steps of at most tol."""
    spots = stored(pts.groupBy("drawing_id", "x", "y").agg(F.min("id").alias("id")), "spots")  # equal places once
    right = spots.select("drawing_id", F.col("id").alias("rid"), F.col("x").alias("rx"), F.col("y").alias("ry"))
    pairs = range_join(spots, right, tol).where("id < rid").select("drawing_id", F.col("id").alias("u"), F.col("rid").alias("v"))
    roots = components(pairs)
    named = spots.join(roots, (spots["drawing_id"] == roots["drawing_id"]) & (spots["id"] == roots["node"]), "left").select(spots["drawing_id"], "x", "y", F.coalesce("root", "id").alias("node"))
    return pts.join(named, ["drawing_id", "x", "y"])


def build_graph(segments: DataFrame, tol: float = 0.1) -> tuple[DataFrame, DataFrame]:
    """Nodes (drawing_id, node_id, x, y, degree) at the mean of their endpoints, and edges (drawing_id, seg_id, u, v, length).

    A segment's two ends on one node count once for its degree.
    """
    placed = stored(cluster(endpoints(segments), tol), "endpoints")
    nodes = placed.groupBy("drawing_id", F.col("node").alias("node_id")).agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.countDistinct("seg_id").alias("degree"))
    ends = placed.groupBy("drawing_id", "seg_id").agg(F.min_by("node", "id").alias("u"), F.max_by("node", "id").alias("v"))
    length = segments.select("drawing_id", "seg_id", S.distance(*(F.col(c) for c in ("x1", "y1", "x2", "y2"))).alias("length"), "layer")
    return nodes, ends.join(length, ["drawing_id", "seg_id"])


def graph_summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Counts for each drawing: nodes, edges, open endpoints, junctions, and whether every degree is even."""
    n = nodes.groupBy("drawing_id").agg(F.count(F.lit(1)).alias("n_nodes"), F.count_if(F.col("degree") == 1).alias("n_open"), F.count_if(F.col("degree") >= 3).alias("n_junctions"), F.bool_and(F.col("degree") % 2 == 0).alias("is_watertight"))
    return n.join(edges.groupBy("drawing_id").agg(F.count(F.lit(1)).alias("n_edges")), "drawing_id")


def cycle_basis(edges: list[tuple[int, int]]) -> list[list[int]]:
    """Fundamental cycles of a simple graph, from a spanning tree grown breadth first from the smallest node of each part."""
    near: dict[int, list[int]] = {}
    for u, v in edges:
        if u != v:
            near.setdefault(u, []).append(v)
            near.setdefault(v, []).append(u)
    parent: dict[int, int] = {}
    depth: dict[int, int] = {}
    out, used = [], set()
    for root in sorted(near):
        if root in depth:
            continue
        parent[root], depth[root], queue = root, 0, [root]
        for u in queue:
            for v in sorted(set(near[u])):
                if v not in depth:
                    parent[v], depth[v] = u, depth[u] + 1
                    used.add((min(u, v), max(u, v)))
                    queue.append(v)
    for u, v in sorted({(min(e), max(e)) for e in edges if e[0] != e[1]} - used):
        left, right, a, b = [u], [v], u, v
        while a != b:
            if depth[a] >= depth[b]:
                a = parent[a]
                left.append(a)
            else:
                b = parent[b]
                right.append(b)
        out.append(left + right[-2::-1] if len(right) > 1 else left)
    return out


def _rings(drawing, nodes: dict[int, tuple[float, float]], u: np.ndarray, v: np.ndarray) -> list[tuple]:
    """(drawing_id, part, k, pts) of a graph's fundamental cycles, by component."""
    node, root = labels(u, v)
    part = dict(zip(node.tolist(), root.tolist()))
    found = [c for c in cycle_basis(list(zip(u.tolist(), v.tolist()))) if len(c) >= 3]
    return [(drawing, part[c[0]], k, [{"x": nodes[n][0], "y": nodes[n][1]} for n in c]) for k, c in enumerate(found)]


def _ring_table(rows: list[tuple], kind: pa.DataType) -> pa.Table:
    fields = [("drawing_id", kind), ("part", pa.int64()), ("k", pa.int32()), ("pts", pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))]
    return pa.table([pa.array(c, t) for c, (_, t) in zip(zip(*rows), fields)] if rows else [pa.array([], t) for _, t in fields], names=[n for n, _ in fields])


def closed_loops(nodes: DataFrame, edges: DataFrame, small: int = SMALL) -> DataFrame:
    """(drawing_id, loop_id, pts, n, signed_area, area, perimeter, x, y, b, rank): rings of the graph, largest first.

    A drawing with `small` edges at most is one kernel. The components of a larger one are found first; each of
    these is a kernel of its own, in which a cycle basis is ordered.
    """
    simple = stored(edges.where("u <> v").select("drawing_id", F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "simple-edges")
    at = nodes.select("drawing_id", "node_id", "x", "y")
    schema = f"drawing_id {edges.schema['drawing_id'].dataType.simpleString()}, part bigint, k int, pts array<struct<x:double,y:double>>"

    def drawing(points: pa.Table, lines: pa.Table) -> pa.Table:
        kind = points.schema.field("drawing_id").type
        if not len(points) or not len(lines):
            return _ring_table([], kind)
        xy = dict(zip(points.column("node_id").to_pylist(), zip(points.column("x").to_pylist(), points.column("y").to_pylist())))
        return _ring_table(_rings(points.column("drawing_id")[0].as_py(), xy, lines.column("u").to_numpy(), lines.column("v").to_numpy()), kind)

    large = stored(simple.groupBy("drawing_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > small).select("drawing_id"), "large-drawings")
    none = large.isEmpty()
    few = (lambda df: df) if none else (lambda df: df.join(large, "drawing_id", "left_anti"))
    out = few(at).groupBy("drawing_id").cogroup(few(simple).groupBy("drawing_id")).applyInArrow(drawing, schema)
    if not none:
        many = simple.join(large, "drawing_id", "left_semi")
        roots = components(many)
        named = many.join(roots, (many["drawing_id"] == roots["drawing_id"]) & (many["u"] == roots["node"]), "left").select(many["drawing_id"], "u", "v", F.coalesce("root", "u").alias("part"))
        rows = named.join(at.toDF("drawing_id", "u", "ux", "uy"), ["drawing_id", "u"]).join(at.toDF("drawing_id", "v", "vx", "vy"), ["drawing_id", "v"])

        def component(t: pa.Table) -> pa.Table:
            c = {name: t.column(name).to_pylist() for name in ("u", "v", "ux", "uy", "vx", "vy")}
            xy = dict(zip(c["u"], zip(c["ux"], c["uy"]))) | dict(zip(c["v"], zip(c["vx"], c["vy"])))
            return _ring_table(_rings(t.column("drawing_id")[0].as_py(), xy, t.column("u").to_numpy(), t.column("v").to_numpy()), t.schema.field("drawing_id").type)

        out = out.unionByName(rows.groupBy("drawing_id", "part").applyInArrow(component, schema))
    return ranked_loops(out.withColumn("loop_id", F.row_number().over(Window.partitionBy("drawing_id").orderBy("part", "k")).cast("bigint") - 1).drop("part", "k"))


def measured(loops: DataFrame) -> DataFrame:
    """Loops (drawing_id, loop_id, pts) with their measures."""
    c = S.ring_centroid(F.col("pts"))
    return loops.select("*", F.size("pts").alias("n"), S.signed_area(F.col("pts")).alias("signed_area"), S.ring_perimeter(F.col("pts")).alias("perimeter"), c["x"].alias("x"), c["y"].alias("y"), S.ring_box(F.col("pts")).alias("b")).withColumn("area", F.abs("signed_area"))


def ranked_loops(loops: DataFrame) -> DataFrame:
    """Measured loops with rank 0 for the largest of a drawing, ties by number."""
    return measured(loops).withColumn("rank", F.row_number().over(Window.partitionBy("drawing_id").orderBy(F.desc(F.round("area", 6)), "loop_id")) - 1)


def containment(loops: DataFrame) -> DataFrame:
    """(drawing_id, loop_id, depth): how many larger loops hold each loop's centroid inside, not on an edge; a centroid meets the loops whose boxes hold it, by a hierarchy of grids."""
    inner = loops.select("drawing_id", "loop_id", "x", "y", "rank", *bounds("a", ("x", "y", "x", "y"), 1e-5))
    box = {f"_b{k}{i}": F.col(f"b.{m}_{k}") for k in "xy" for i, m in enumerate(("min", "max"))}
    wide = F.greatest(F.col("b.max_x") - F.col("b.min_x"), F.col("b.max_y") - F.col("b.min_y"))
    size = loops.agg(F.percentile_approx(wide, F.lit(0.5))).first()[0] or 1.0  # half of all boxes stand on the first level
    outer = loops.select(F.col("drawing_id"), F.col("pts").alias("_pts"), F.col("b").alias("_b"), F.col("rank").alias("_rank"), *(c.alias(n) for n, c in box.items()))
    met = meeting_boxes(inner, outer, ["drawing_id"], max(float(size), 1e-6))
    held = met.where((F.col("_rank") < F.col("rank")) & S.box_contains(F.col("_b"), F.col("x"), F.col("y")) & S.ring_contains(F.col("_pts"), F.col("x"), F.col("y")) & ~S.ring_touches(F.col("_pts"), F.col("x"), F.col("y")))
    depth = held.groupBy("drawing_id", "loop_id").agg(F.count(F.lit(1)).alias("depth"))
    return loops.select("drawing_id", "loop_id").join(depth, ["drawing_id", "loop_id"], "left").withColumn("depth", F.coalesce("depth", F.lit(0)))


def normalize_winding(loops: DataFrame, outer_ccw: bool = True) -> DataFrame:
    """Loops with area turned so that even depths run like the outermost and odd ones against it."""
    out = loops.where("area > 1e-4").join(containment(loops), ["drawing_id", "loop_id"])
    want = (F.col("depth") % 2 == 0) == F.lit(outer_ccw)
    turned = F.when((F.col("signed_area") > 0) == want, F.col("pts")).otherwise(F.reverse("pts"))
    return out.withColumn("pts", turned).withColumn("is_ccw", want).withColumn("is_outer", F.col("depth") == 0)
