"""Drawings of equal content are worked on once, with the rows that they would have had."""

import pytest
from pyspark.sql import functions as F

from plansheet.plans import flows, work

SEG = "drawing_id bigint, seg_id bigint, x1 double, y1 double, x2 double, y2 double, layer string"
SF = "/root/testdata/sf0.001"


def test_once_each_gives_all_rows(spark):
    lines = lambda d, x, layer="0": [(d, k, x, float(k), x + 1, float(k), layer) for k in range(3)]
    rows = lines(1, 0.0) + lines(2, 0.0)[::-1] + lines(3, 5.0) + lines(4, 0.0) + lines(5, 0.0, "1") + lines(None, 0.0) + lines(6, 0.0) + lines(7, 0.0)[:2] + lines(7, 0.0)[:1] + lines(8, 0.0) + lines(9, 5.0) + lines(10, 5.0)
    segments = spark.createDataFrame(rows, SEG)
    circles = spark.createDataFrame([(4, 0, 1.0), (8, 0, 1.0), (11, 0, 2.0)], "drawing_id bigint, circle_id bigint, r double")
    seen = []

    def make(own):
        one = own["segments"].groupBy("drawing_id").agg(F.sum("x1").alias("x"), F.max("layer").alias("layer"), F.count(F.lit(1)).alias("n"))
        two = own["circles"].groupBy("drawing_id").agg(F.sum("r").alias("r"))
        out = one.withColumnRenamed("drawing_id", "_d").join(two, F.col("_d").eqNullSafe(F.col("drawing_id")), "full").select(F.coalesce("_d", "drawing_id").cast("string").alias("drawing_id"), "x", "layer", "n", "r")
        seen.append(out.count())
        return out

    rows = lambda df: sorted(map(repr, df.collect()))
    whole = {"segments": segments, "circles": circles}
    want = rows(make(whole))
    assert rows(flows.once_each(make, **whole)) == want and len(want) == 12
    assert seen == [12, 12]  # seven contents of twelve drawings: all are worked on
    whole["segments"] = segments.unionByName(segments.where("drawing_id = 1").withColumn("drawing_id", F.explode(F.array(*(F.lit(k).cast("bigint") for k in range(20, 40))))))
    want = rows(make(whole))
    assert rows(flows.once_each(make, **whole)) == want and len(want) == 32
    assert seen[2:] == [32, 7]


QUERIES = ["orc4_recommendation", "rep1_strategy_dispatch", "orc1_symmetry_analysis", "orc2_full_report", "orc5_applied_repair", "orc3_candidates", "rep12_minimum_change", "joi20_local_symmetry"]


@pytest.mark.parametrize("name", QUERIES)
def test_a_panel_of_each_kind_is_worked_on(spark, monkeypatch, name):
    found, plain = [], flows.Drawing.__init__

    def noted(self, segments, *args, **how):
        found.append(segments.select("drawing_id").distinct().count())
        plain(self, segments, *args, **how)

    monkeypatch.setattr(flows.Drawing, "__init__", noted)
    assert work.QUERIES[name](spark, SF).select("drawing_id").distinct().count() == 150
    assert min(found) == 4 and max(found) <= 16  # four kinds of panels, four candidates of each
