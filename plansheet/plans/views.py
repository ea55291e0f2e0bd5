"""Drawings derived from the given tables: points, segments, arcs, circles and rectangles, each keyed by drawing_id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plansheet.operators.tables import by_counted_size, spread
from plansheet.shipping import ship


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    by_counted_size(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("embedding")
    return _read(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("drawing_id"), F.col("vec_id").alias("pt_id"), (1000 * e[0].cast("double")).alias("x"), (1000 * e[1].cast("double")).alias("y"))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    y = lambda i: (i * 37 % 997) / 2.0
    out = _read(spark, sf_dir, "events").select(
        F.col("user_id").alias("drawing_id"), F.col("event_id").alias("seg_id"), F.col("value").alias("x1"), y(F.col("event_id")).alias("y1"),
        F.lead("value").over(w).alias("x2"), y(F.lead("event_id").over(w)).alias("y2"), F.concat(F.lit("L"), (F.col("event_id") % 5).cast("string")).alias("layer"),
    )
    return out.where("x2 is not null")


def arcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return _read(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("drawing_id"), k.alias("arc_id"), (k % 1000).cast("double").alias("cx"), (F.col("o_totalprice") / 1000).alias("cy"), (1.0 + k % 50).alias("r"),
        F.radians((k * 37 % 360).cast("double")).alias("a0"), F.radians((k * 91 % 360).cast("double")).alias("a1"), (k % 2 == 0).alias("is_ccw"),
    )


def circles(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return _read(spark, sf_dir, "customer").select((k % 100).alias("drawing_id"), k.alias("circle_id"), (F.col("c_acctbal") / 10).alias("cx"), (k % 100).cast("double").alias("cy"), (1.0 + k % 20).alias("r"))


def rectangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return spread(_read(spark, sf_dir, "part")).select(
        (k % 20).alias("drawing_id"), k.alias("rect_id"), ((k % 50) * 100.0).alias("x0"), (F.floor(k / 50) * 120.0).alias("y0"), (F.col("p_size") * 1.0).alias("w"), (F.col("p_retailprice") / 10).alias("h"),
    )


def loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rectangles as rings, corner by corner, counter-clockwise for even numbers."""
    p = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    x0, y0, x1, y1 = F.col("x0"), F.col("y0"), F.col("x0") + F.col("w"), F.col("y0") + F.col("h")
    ccw = F.array(p(x0, y0), p(x1, y0), p(x1, y1), p(x0, y1))
    cw = F.array(p(x0, y0), p(x0, y1), p(x1, y1), p(x1, y0))
    return rectangles(spark, sf_dir).select("drawing_id", F.col("rect_id").alias("loop_id"), F.when(F.col("rect_id") % 2 == 0, ccw).otherwise(cw).alias("pts"))


def rectangle_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four sides of each rectangle, numbered 4 * rect_id on."""
    out = loops(spark, sf_dir).select("drawing_id", "loop_id", F.posexplode("pts").alias("i", "p"), "pts")
    q = F.get("pts", (F.col("i") + 1) % 4)
    return out.select("drawing_id", (F.col("loop_id") * 4 + F.col("i")).alias("seg_id"), F.col("p.x").alias("x1"), F.col("p.y").alias("y1"), q["x"].alias("x2"), q["y"].alias("y2"), F.concat(F.lit("R"), (F.col("loop_id") % 3).cast("string")).alias("layer"))


#: The same views for another engine, as the head of a WITH clause.
HEAD = """with geo_point as (select label::bigint as drawing_id, vec_id as pt_id, 1000 * cast(embedding[1] as double) as x, 1000 * cast(embedding[2] as double) as y from embeddings),
geo_seg as (select * from (select user_id as drawing_id, event_id as seg_id, value as x1, (event_id * 37 % 997) / 2e0 as y1, lead(value) over w as x2,
  ((lead(event_id) over w) * 37 % 997) / 2e0 as y2, 'L' || cast(event_id % 5 as varchar) as layer from events window w as (partition by user_id order by ts, event_id)) where x2 is not null),
geo_arc as (select o_custkey as drawing_id, o_orderkey as arc_id, cast(o_orderkey % 1000 as double) as cx, o_totalprice / 1000 as cy, 1e0 + o_orderkey % 50 as r,
  radians(o_orderkey * 37 % 360) as a0, radians(o_orderkey * 91 % 360) as a1, (o_orderkey % 2 = 0) as is_ccw from orders),
geo_circle as (select c_custkey % 100 as drawing_id, c_custkey as circle_id, c_acctbal / 10 as cx, cast(c_custkey % 100 as double) as cy, 1e0 + c_custkey % 20 as r from customer),
geo_rect as (select p_partkey % 20 as drawing_id, p_partkey as rect_id, (p_partkey % 50) * 100e0 as x0, floor(p_partkey / 50) * 120e0 as y0, p_size * 1e0 as w, p_retailprice / 10 as h from part),
geo_corner as (select drawing_id, rect_id as loop_id, i, case when (case when rect_id % 2 = 0 then i else (4 - i) % 4 end) in (1, 2) then x0 + w else x0 end as x,
  case when (case when rect_id % 2 = 0 then i else (4 - i) % 4 end) in (2, 3) then y0 + h else y0 end as y from geo_rect, (values (0), (1), (2), (3)) v(i)),
geo_side as (select a.drawing_id, a.loop_id * 4 + a.i as seg_id, a.x as x1, a.y as y1, b.x as x2, b.y as y2, 'R' || cast(a.loop_id % 3 as varchar) as layer
  from geo_corner a join geo_corner b on a.loop_id = b.loop_id and b.i = (a.i + 1) % 4)"""
