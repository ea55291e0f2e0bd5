"""Motif clusters: lines whose middles lie near each other, the outer frame apart, with their own symmetry."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plansheet.functions import scalar as S
from plansheet.operators.generate import sample_segments
from plansheet.operators.small import best_axis
from plansheet.operators.symmetry import hypotheses
from plansheet.operators.tables import stored
from plansheet.operators.topology import cluster

SEG = ("x1", "y1", "x2", "y2")


def outer_frame(segments: DataFrame, loops: DataFrame, tol: float = 0.1) -> DataFrame:
    """Segments with both ends on corners of the largest of several loops, by their cells."""
    several = loops.groupBy("drawing_id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("drawing_id")
    spots = loops.where("rank = 0").join(several, "drawing_id").select("drawing_id", F.explode("pts").alias("p")).select("drawing_id", S.quantize(F.col("p.x"), tol).alias("qx"), S.quantize(F.col("p.y"), tol).alias("qy")).distinct()
    out = segments
    for k in "12":
        out = out.withColumn("qx", S.quantize(F.col(f"x{k}"), tol)).withColumn("qy", S.quantize(F.col(f"y{k}"), tol)).join(spots, ["drawing_id", "qx", "qy"], "left_semi").drop("qx", "qy")
    return out


def motif_clusters(segments: DataFrame, loops: DataFrame, reach: float = 30.0) -> DataFrame:
    """(drawing_id, seg_id, cluster_id): 0 for the outer frame, else from 1 in order of their first line."""
    frame = outer_frame(segments, loops).select("drawing_id", "seg_id")
    inner = segments.join(frame, ["drawing_id", "seg_id"], "left_anti")
    mid = inner.select("drawing_id", F.col("seg_id").alias("id"), ((F.col("x1") + F.col("x2")) / 2).alias("x"), ((F.col("y1") + F.col("y2")) / 2).alias("y"))
    named = cluster(mid, reach)
    rank = F.dense_rank().over(Window.partitionBy("drawing_id").orderBy("node"))
    return named.select("drawing_id", F.col("id").alias("seg_id"), rank.cast("int").alias("cluster_id")).unionByName(frame.withColumn("cluster_id", F.lit(0)))


def cluster_boxes(segments: DataFrame, named: DataFrame) -> DataFrame:
    """(drawing_id, cluster_id, n, b, x, y): count, box and the box's centre of each cluster, from ends alone."""
    out = segments.join(named, ["drawing_id", "seg_id"]).groupBy("drawing_id", "cluster_id").agg(
        F.count(F.lit(1)).alias("n"), S.box(F.min(F.least("x1", "x2")), F.min(F.least("y1", "y2")), F.max(F.greatest("x1", "x2")), F.max(F.greatest("y1", "y2"))).alias("b")
    )
    m = S.box_of(F.col("b"))
    return out.withColumn("x", m["center_x"]).withColumn("y", m["center_y"])


def local_symmetry(segments: DataFrame, named: DataFrame, tol: float = 0.25, least: int = 4, n: int = 6) -> DataFrame:
    """(drawing_id, cluster_id, score): the best axis of each inner cluster with enough lines, each cluster taken as a drawing."""
    size = named.where("cluster_id > 0").groupBy("drawing_id", "cluster_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least)
    own = segments.join(named.join(size, ["drawing_id", "cluster_id"]), ["drawing_id", "seg_id"])
    own = own.withColumn("drawing_id", F.concat_ws("/", F.col("drawing_id").cast("string"), F.col("cluster_id").cast("string")))
    pts = stored(sample_segments(own, n).select("drawing_id", (F.col("ent_id") * n + F.col("i")).alias("id"), "x", "y"), "cluster-points")
    best = best_axis(pts, hypotheses(pts), tol)
    part = F.split("drawing_id", "/")
    return best.select(F.get(part, F.lit(0)).alias("drawing_id"), F.get(part, F.lit(1)).cast("int").alias("cluster_id"), "score")
