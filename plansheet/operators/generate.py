"""Generators: sample points of segments, arcs and circles, ring edges, anchors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plansheet.functions import scalar as S


def _steps(df: DataFrame, n: int) -> DataFrame:
    return df.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def sample_segments(segments: DataFrame, n: int = 10) -> DataFrame:
    """n even points with both ends; the middle for n of 1."""
    t = F.col("i") / (n - 1) if n > 1 else F.lit(0.5)
    return _steps(segments, n).select("drawing_id", F.lit("line").alias("src"), F.col("seg_id").alias("ent_id"), "i", (F.col("x1") + t * (F.col("x2") - F.col("x1"))).alias("x"), (F.col("y1") + t * (F.col("y2") - F.col("y1"))).alias("y"))


def sample_arcs(arcs: DataFrame, n: int = 20) -> DataFrame:
    """n even points along the sweep."""
    p = S.arc_point(*(F.col(c) for c in ("cx", "cy", "r", "a0", "a1", "is_ccw")), F.col("i") / (n - 1) if n > 1 else F.lit(0.5))
    return _steps(arcs, n).select("drawing_id", F.lit("arc").alias("src"), F.col("arc_id").alias("ent_id"), "i", p["x"].alias("x"), p["y"].alias("y"))


def sample_circles(circles: DataFrame, n: int = 30) -> DataFrame:
    """n even points, the first not repeated."""
    a = F.col("i") / n * S.TAU
    return _steps(circles, n).select("drawing_id", F.lit("circle").alias("src"), F.col("circle_id").alias("ent_id"), "i", (F.col("cx") + F.col("r") * F.cos(a)).alias("x"), (F.col("cy") + F.col("r") * F.sin(a)).alias("y"))


def sample_drawing(segments: DataFrame, arcs: DataFrame | None = None, circles: DataFrame | None = None, n: int = 10) -> DataFrame:
    """n points a segment, 2n an arc, 3n a circle."""
    out = sample_segments(segments, n)
    for df, make, k in ((arcs, sample_arcs, 2), (circles, sample_circles, 3)):
        out = out if df is None else out.unionByName(make(df, k * n))
    return out


def ring_edges(loops: DataFrame, least: float = 1e-4) -> DataFrame:
    """A segment for each edge of a ring that is longer than `least`."""
    out = loops.select("drawing_id", "loop_id", "pts", F.posexplode("pts").alias("i", "p"))
    q = S.ring_next(F.col("pts"), F.col("i"))
    out = out.select("drawing_id", "loop_id", "i", F.col("p.x").alias("x1"), F.col("p.y").alias("y1"), q["x"].alias("x2"), q["y"].alias("y2"))
    return out.where(S.distance(*(F.col(c) for c in ("x1", "y1", "x2", "y2"))) > least)


def chain_vertices(arcs: DataFrame) -> DataFrame:
    """Arcs in order as polyline vertices (x, y, bulge), the last end added: one row for each drawing."""
    s, e = (S.arc_point(*(F.col(c) for c in ("cx", "cy", "r", "a0", "a1", "is_ccw")), F.lit(t)) for t in (0.0, 1.0))
    bulge = F.when(F.col("is_ccw"), 1.0).otherwise(-1.0) * F.tan(F.least(S.sweep(F.col("a0"), F.col("a1"), F.col("is_ccw")), F.lit(S.TAU - 1e-6)) / 4)
    v = arcs.select("drawing_id", "arc_id", F.struct(s["x"].alias("x"), s["y"].alias("y"), bulge.alias("bulge")).alias("v"), F.struct(e["x"].alias("x"), e["y"].alias("y"), F.lit(0.0).alias("bulge")).alias("e"))
    rows = v.groupBy("drawing_id").agg(F.array_sort(F.collect_list(F.struct("arc_id", "v", "e"))).alias("a"))
    return rows.select("drawing_id", F.concat(F.transform("a", lambda r: r["v"]), F.array(F.element_at("a", -1)["e"])).alias("verts"))


def anchors(boxes: DataFrame, loops: DataFrame | None = None) -> DataFrame:
    """Nine anchors of each drawing's box (drawing_id, b), and the centroids of centre and corner boxes among its loops (x, y, category)."""
    b, m = F.col("b"), S.box_of(F.col("b"))
    at = lambda x, y, kind, importance, confidence: F.struct(x.alias("x"), y.alias("y"), F.lit(kind).alias("kind"), F.lit(importance).alias("importance"), F.lit(confidence).alias("confidence"))
    nine = [at(m["center_x"], m["center_y"], "CENTER", "FIXED", 1.0)]
    nine += [at(b[x], b[y], "CORNER", "FIXED", 1.0) for y in ("min_y", "max_y") for x in ("min_x", "max_x")]
    nine += [at(x, y, "MIDPOINT", "MAJOR", 0.98) for x, y in ((m["center_x"], b["min_y"]), (m["center_x"], b["max_y"]), (b["min_x"], m["center_y"]), (b["max_x"], m["center_y"]))]
    out = boxes.select("drawing_id", F.explode(F.array(*nine)).alias("a")).select("drawing_id", "a.*")
    if loops is None:
        return out
    more = loops.where(F.col("category").isin("CENTER_BOX", "CORNER_BOX"))
    centre = F.col("category") == "CENTER_BOX"
    return out.unionByName(more.select("drawing_id", "x", "y", F.lit("MOTIF").alias("kind"), F.when(centre, "MAJOR").otherwise("SOFT").alias("importance"), F.when(centre, 0.95).otherwise(0.90).alias("confidence")))
