"""Orchestrated analyses: symmetry of drawings, the full report, repair candidates and their application."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from threading import RLock

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plansheet.functions import scalar as S
from plansheet.operators import clusters, features, generate, quality, repair, small, symmetry, topology
from plansheet.operators.tables import stored, together
from plansheet.plans.cache import Results, contents

SEG = ("x1", "y1", "x2", "y2")


def boxes(segments: DataFrame, arcs: DataFrame | None = None, circles: DataFrame | None = None) -> DataFrame:
    """(drawing_id, b): the box of each drawing's segments, arcs and circles."""
    rows = segments.select("drawing_id", S.box(F.least("x1", "x2"), F.least("y1", "y2"), F.greatest("x1", "x2"), F.greatest("y1", "y2")).alias("b"))
    if arcs is not None:
        rows = rows.unionByName(arcs.select("drawing_id", S.arc_box(*(F.col(c) for c in ("cx", "cy", "r", "a0", "a1", "is_ccw"))).alias("b")))
    if circles is not None:
        rows = rows.unionByName(circles.select("drawing_id", S.box(F.col("cx") - F.col("r"), F.col("cy") - F.col("r"), F.col("cx") + F.col("r"), F.col("cy") + F.col("r")).alias("b")))
    return rows.groupBy("drawing_id").agg(S.box(F.min("b.min_x"), F.min("b.min_y"), F.max("b.max_x"), F.max("b.max_y")).alias("b"))


def sampled(segments: DataFrame, n: int, arcs: DataFrame | None = None, circles: DataFrame | None = None) -> DataFrame:
    """(drawing_id, id, x, y): n points a segment, 2n an arc, 3n a circle."""
    kind = F.when(F.col("src") == "line", 0).when(F.col("src") == "arc", 1).otherwise(2)
    return generate.sample_drawing(segments, arcs, circles, n).select("drawing_id", ((F.col("ent_id") * (3 * n) + F.col("i")) * 3 + kind).alias("id"), "x", "y")


class Drawing:
    """What the analyses share of a set of drawings, each part written once when first asked for.

    Arcs and circles count for boxes and symmetry; graphs, loops and what comes from them are of segments. Drawings with
    `small` points at most go through operators.small, larger ones through the grids and stars of the other operators.
    """

    def __init__(self, segments: DataFrame, tol: float = 0.2, node_tol: float = 0.1, samples: int = 12, arcs: DataFrame | None = None, circles: DataFrame | None = None, small: int = symmetry.SMALL):
        self.segments, self.tol, self.node_tol, self.samples, self.arcs, self.circles, self.small = segments, tol, node_tol, samples, arcs, circles, small
        self._held: dict = {}
        self._locks: dict = {}

    def _made(self, name: str, make: Callable):
        """What make returns, made once, also when several threads ask for it."""
        with self._locks.setdefault(name, RLock()):
            if name not in self._held:
                self._held[name] = make()
        return self._held[name]

    def _once(self, name: str, make: Callable) -> DataFrame:
        return self._made(name, lambda: stored(make(), name))

    def ready(self, *names: str) -> None:
        """Makes these parts at the same time, as far as they don't need each other."""
        together(*((lambda n=n: getattr(self, n)) for n in names))

    @property
    def drawings(self) -> DataFrame:
        return self.segments.select("drawing_id").distinct()

    @property
    def boxes(self) -> DataFrame:
        return self._once("boxes", lambda: boxes(self.segments, self.arcs, self.circles))

    @property
    def large(self) -> DataFrame | None:
        """(drawing_id) of drawings with more points than one kernel takes; none, if no drawing is."""

        def make() -> DataFrame | None:
            n = reduce(DataFrame.unionByName, (df.select("drawing_id", F.lit(k * self.samples).alias("n")) for df, k in ((self.segments, 1), (self.arcs, 2), (self.circles, 3)) if df is not None))
            large = stored(n.groupBy("drawing_id").agg(F.sum("n").alias("n")).where(F.col("n") > self.small).select("drawing_id"), "large-drawings")
            return None if large.isEmpty() else large

        return self._made("large", make)

    def _split(self, few: Callable, many: Callable) -> DataFrame:
        """few(part) for small drawings and many(part) for large ones, where part cuts a table down to these."""
        if self.large is None:
            return few(lambda df: df)
        return few(lambda df: df.join(self.large, "drawing_id", "left_anti")).unionByName(many(lambda df: df.join(self.large, "drawing_id", "left_semi")))

    @property
    def graphs(self) -> DataFrame:
        """Nodes, edges and rings of small drawings, a row each."""
        return self._once("graphs", lambda: small.graphs(self.segments if self.large is None else self.segments.join(self.large, "drawing_id", "left_anti"), self.node_tol))

    def _built(self, part: int) -> DataFrame:
        return self._made("built", lambda: [stored(df, "graph") for df in topology.build_graph(self.segments.join(self.large, "drawing_id", "left_semi"), self.node_tol)])[part]

    @property
    def nodes(self) -> DataFrame:
        return self._split(lambda part: small.nodes(self.graphs), lambda part: self._built(0))

    @property
    def edges(self) -> DataFrame:
        return self._once("edges", lambda: self._split(lambda part: small.edges(self.graphs, part(self.segments)), lambda part: self._built(1)))

    @property
    def loops(self) -> DataFrame:
        return self._once("loops", lambda: self._split(lambda part: topology.ranked_loops(small.rings(self.graphs)), lambda part: topology.closed_loops(self._built(0), self._built(1))))

    @property
    def points(self) -> DataFrame:
        return self._once("points", lambda: sampled(self.segments, self.samples, self.arcs, self.circles))

    @property
    def lines(self) -> DataFrame:
        return self._once("lines", lambda: features.line_features(self.segments))

    @property
    def loop_features(self) -> DataFrame:
        return self._once("loop-features", lambda: features.loop_features(self.loops, self.boxes.withColumnRenamed("b", "box")))

    @property
    def axes(self) -> DataFrame:
        """What may be an axis: upright, level, principal and diagonal ones, and bisectors of loops. Those of random points are tried besides."""
        return self._once("axes", lambda: symmetry.hypotheses(self.points, self.loops))

    def _found(self, square: bool) -> DataFrame:
        def many(part: Callable) -> DataFrame:
            pts = stored(part(self.points), "large-points")
            tried = stored(part(self.axes).unionByName(symmetry.ransac(pts, self.tol).drop("inliers")), "large-axes")
            best = stored(symmetry.best_axis(pts, tried, self.tol), "large-best")
            out = best.withColumn("which", F.lit(0))
            return out.unionByName(symmetry.secondary_axis(pts, best, self.tol, -1.0).withColumn("which", F.lit(1))) if square else out

        return self._split(lambda part: small.best_axes(part(self.points), part(self.axes), self.tol, square=square), many)

    @property
    def found(self) -> DataFrame:
        """The best axis of each drawing (which 0) and the better of those square to it (which 1), with their profiles."""
        return self._once("found", lambda: self._found(True))

    @property
    def best(self) -> DataFrame:
        if "found" in self._held or "found" in self._locks:
            return self.found.where("which = 0").drop("which")
        return self._once("best", lambda: self._found(False)).drop("which")

    @property
    def second(self) -> DataFrame:
        """The profile of an axis square to the best one, where there is one to be trusted."""
        return self.found.where("which = 1 and confidence > 0.4").drop("which")

    @property
    def heat(self) -> DataFrame:
        """(drawing_id, id, x, y, dev, band): each point's deviation about the best axis, and its colour band."""
        return self._once("heat", lambda: symmetry.deviations(self.points, self.best.select("drawing_id", "axis_id", "a")).drop("axis_id").withColumn("band", S.heat_band(F.col("dev"))))

    @property
    def anchors(self) -> DataFrame:
        return self._once("anchors", lambda: generate.anchors(self.boxes, self.loop_features))

    @property
    def clusters(self) -> DataFrame:
        return self._once("clusters", lambda: clusters.motif_clusters(self.segments, self.loops))

    @property
    def pairs(self) -> DataFrame:
        return self._once("pairs", lambda: symmetry.mirror_pairs(self.loops, self.best))

    @property
    def spacings(self) -> DataFrame:
        return self._once("spacings", lambda: features.spacing_clusters(features.parallel_pairs(self.lines)))

    @property
    def bundles(self) -> DataFrame:
        return self._once("bundles", lambda: features.collinear_bundles(self.lines))

    @property
    def corner_size(self) -> DataFrame:
        return self._once("corner-size", lambda: features.corner_motifs(self.loop_features))

    @property
    def deformed(self) -> DataFrame:
        return self._once("deformed", lambda: quality.deformation(self.drawings, features.kinks(features.corners(self.nodes, self.edges)), self.segments, self.loops))

    @property
    def doubled(self) -> DataFrame:
        return self._once("doubled", lambda: quality.duplicate_pairs(self.segments))

    @property
    def crossed(self) -> DataFrame:
        return self._once("crossed", lambda: quality.crossings(self.segments).select("drawing_id", "seg_a", "seg_b"))

    def analyze(self) -> DataFrame:
        """A row for each drawing: its best axis and profile, the one square to it, loops paired and not, classification and action."""
        self.ready("found", "loops")
        second = self.second.select("drawing_id", F.col("a").alias("second_a"), F.col("score").alias("second_score"))
        count = self.pairs.groupBy("drawing_id").agg(F.count(F.lit(1)).alias("n_pairs"), F.max("dist").alias("worst_distance"), F.max("area_error").alias("worst_area"))
        n = self.loops.groupBy("drawing_id").agg(F.count(F.lit(1)).alias("n_loops"))
        out = self.best.drop("axis_id", "loop_area_error").join(count, "drawing_id", "left").join(n, "drawing_id", "left").na.fill(0)
        c = S.classify(F.col("score"), F.col("rms"), F.col("matched"), F.col("n_pairs"))
        out = out.withColumn("classification", c["classification"]).withColumn("action", c["action"])
        return out.join(second, "drawing_id", "left")

    def quality(self) -> DataFrame:
        self.ready("best", "spacings", "loop_features", "bundles", "deformed")
        return quality.quality(self.drawings, self.best.select("drawing_id", "score"), self.lines, self.spacings, self.loop_features, self.bundles, self.deformed)

    def validate(self, original: DataFrame | None = None) -> DataFrame:
        self.ready("edges", "loops", "doubled", "crossed", "boxes")
        summary = topology.graph_summary(self.nodes, self.edges)
        return quality.validate(self.drawings, summary, self.loops, self.doubled, self.crossed, self.boxes, original)

    def report(self) -> DataFrame:
        """Analysis, rotation, quality, and counts of intent, anchors, clusters and points in the hottest band, a row for each drawing."""
        self.ready("found", "spacings", "loop_features", "bundles", "deformed", "anchors", "clusters")
        rotation = symmetry.rotational(self.points, 0.25, self.boxes.select("drawing_id", *(S.box_of(F.col("b"))[f"center_{k}"].alias(f"c{k}") for k in "xy")))
        intent = features.constraints(features.angle_clusters(self.lines), self.spacings, self.corner_size).groupBy("drawing_id").agg(F.count(F.lit(1)).alias("n_constraints"))
        q = self.quality().select("drawing_id", "quality", "verdict", "deformation")
        out = self.analyze().join(rotation.select("drawing_id", "symmetry_group", "rot_order"), "drawing_id", "left").join(q, "drawing_id", "left").join(intent, "drawing_id", "left")
        more = (self.anchors.groupBy("drawing_id").agg(F.count(F.lit(1)).alias("n_anchors")), self.clusters.groupBy("drawing_id").agg(F.countDistinct("cluster_id").alias("n_clusters")), self.heat.groupBy("drawing_id").agg(F.count_if(F.col("band") == 4).alias("n_hot"), F.max("dev").alias("worst_deviation")))
        for part in more:
            out = out.join(part, "drawing_id", "left")
        return out.na.fill({"n_constraints": 0, "n_anchors": 0, "n_clusters": 0, "n_hot": 0})


def candidates(segments: DataFrame, zones: DataFrame | None = None, straighten: bool = True, arcs: DataFrame | None = None, circles: DataFrame | None = None, old: Drawing | None = None, **how) -> tuple[DataFrame, DataFrame]:
    """The four candidates ranked for each drawing, and their tagged lines; all are scored in one pass.

    A repair moves lines; a drawing's arcs and circles stay as they are in every candidate, and count for its symmetry and size.
    old is the analysis of these drawings, if there is one already.
    """
    kind = segments.schema["drawing_id"].dataType.simpleString()
    old = old or Drawing(segments, arcs=arcs, circles=circles, **how)
    old.ready("boxes", "corner_size")
    lines = stored(repair.candidate_lines(segments, old.loops, old.boxes, old.corner_size, straighten, zones), "candidate-lines")
    new = Drawing(lines, arcs=None if arcs is None else repair.tagged(arcs), circles=None if circles is None else repair.tagged(circles), **how)
    rows = repair.tagged(old.drawings)
    parts = together(
        lambda: stored(new.quality().select("drawing_id", "quality", F.col("symmetry").alias("score")), "quality"), lambda: stored(new.validate(repair.tagged(old.boxes)).select("drawing_id", "is_valid"), "valid"),
        lambda: stored(repair.change_ratio(repair.tagged(segments), lines), "change"),
    )
    for part in parts:
        rows = rows.join(part, "drawing_id", "left")
    rows = rows.withColumn("has_lines", F.col("is_valid").isNotNull()).na.fill({"quality": 0.0, "score": 0.0, "is_valid": False, "change": 100.0})
    return stored(repair.rank_candidates(repair.untagged(rows, kind)), "candidates"), lines


def recommend(segments: DataFrame, zones: DataFrame | None = None, straighten: bool = True, **how) -> tuple[DataFrame, DataFrame]:
    """The recommended candidate of each drawing and its lines."""
    old = Drawing(segments, **how)
    (ranked, lines), own = together(lambda: candidates(segments, zones, straighten, old=old, **how), lambda: stored(old.quality().select("drawing_id", "quality"), "quality"))
    best = stored(repair.recommended(ranked, own), "recommended")
    own = repair.untagged(lines, segments.schema["drawing_id"].dataType.simpleString())
    return best, own.join(best.select("drawing_id", "candidate_id"), ["drawing_id", "candidate_id"], "left_semi").drop("candidate_id")


def cached_candidates(kept: Results, segments: DataFrame, arcs: DataFrame | None = None, circles: DataFrame | None = None, zones: DataFrame | None = None, straighten: bool = True, **how) -> tuple[DataFrame, DataFrame, DataFrame]:
    """candidates() of drawings whose entities, zones or options have changed, what is kept of all others; and the recommended one of each.

    Returned are the ranked candidates, the recommended ones and the lines of all candidates (with candidate_id), each with `cached`.
    """
    own = {"segments": segments, "arcs": arcs, "circles": circles, "zones": zones}

    def make(some: dict[str, DataFrame]) -> dict[str, DataFrame]:
        whole = {k: some.get(k) for k in ("arcs", "circles")}
        old = Drawing(some["segments"], **whole, **how)
        (ranked, lines), quality_ = together(lambda: candidates(some["segments"], some.get("zones"), straighten, old=old, **whole, **how), lambda: stored(old.quality().select("drawing_id", "quality"), "quality"))
        return {"ranked": ranked, "recommended": repair.recommended(ranked, quality_), "lines": repair.untagged(lines, segments.schema["drawing_id"].dataType.simpleString())}

    got = kept.get("candidates", {k: df for k, df in own.items() if df is not None}, make, repr((straighten, sorted(how.items()))))
    return got["ranked"], got["recommended"], got["lines"]


def applied(recommended: DataFrame, lines: DataFrame) -> DataFrame:
    """The lines of each drawing's recommended candidate, from what is kept."""
    return lines.join(recommended.select("drawing_id", "candidate_id"), ["drawing_id", "candidate_id"], "left_semi").drop("candidate_id", "cached")


def once_each(make: Callable[[dict[str, DataFrame]], DataFrame], **entities: DataFrame | None) -> DataFrame:
    """make(entities)'s table (with drawing_id) for all drawings, where those of equal content, as plansheet.plans.cache tells them, are worked on once.

    make must depend on what is in a drawing alone, not on its number. Where most drawings differ, it gets them all as they are.
    """
    own = {k: df for k, df in entities.items() if df is not None}
    named = stored(contents(own).withColumn("_null", F.col("drawing_id").isNull()), "contents")  # a drawing without a number is none of the others
    first = stored(named.groupBy("content", "_null").agg(F.min("drawing_id").alias("_of")), "first-alike")
    if 2 * first.count() > named.count():
        return make(own)
    like = stored(named.join(first, ["content", "_null"]).select("drawing_id", "_of"), "alike")
    few = dict(zip(own, together(*(lambda k=k, df=df: stored(df.join(first.select("_of"), F.col("drawing_id").eqNullSafe(F.col("_of")), "left_semi"), f"few-{k}") for k, df in own.items()))))
    made = make(few)
    kind = made.schema["drawing_id"].dataType
    like = like.select(F.col("drawing_id").cast(kind).alias("_own"), F.col("_of").cast(kind).alias("_of"))
    rows = made.join(like, F.col("drawing_id").eqNullSafe(F.col("_of")))
    return rows.select(*(F.col("_own").alias(c) if c == "drawing_id" else c for c in made.columns))


def repaired(segments: DataFrame, strategy: str, zones: DataFrame | None = None, straighten: bool = True, **how) -> DataFrame:
    """The lines of a repair by one strategy, welded; drawings without loops stay as they are."""
    d = Drawing(segments, **how)
    axes = d.best.join(d.boxes, "drawing_id").select("drawing_id", S.repair_axis(S.axis_angle(F.col("a")), F.col("b")).alias("a")) if strategy not in repair.STRATEGIES else None
    out = repair.rings_to_lines(repair.repair_rings(d.loops, d.boxes, strategy, axes, straighten), segments)
    if zones is not None:
        out = repair.apply_zones(out, segments, zones)
    bare = segments.join(d.loops.select("drawing_id").distinct(), "drawing_id", "left_anti")
    return repair.weld(out).unionByName(bare.select(*out.columns))
