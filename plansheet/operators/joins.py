"""Joins by distance inside a drawing: range, nearest, k nearest, grid candidates, nearest segment.

A grid makes each an equi-join on (drawing, cell), so a drawing that holds a large share of all rows is dealt over many
tasks. Ranges look into the cells that the range overlaps. Nearest neighbours are exact: a first pass looks into the nine
cells around a point, in cells that hold about `per_cell` points of the drawing; what it can't settle (too little found, or
farther than a cell) is joined with the cells of a coarser grid, each pass four times as wide, until one cell spans the
drawing. Segments are in the cells that they cross, found by a walk along them, so that a long one costs a row for each
cell on its way and not for each cell of its box. Boxes meet on a hierarchy of grids: a segment stands on the level of its
own length, in four cells at most, and is looked up on the levels above.

Drawings with few enough pairs of rows are compared in one array kernel where that costs less; both ways give the same
rows (tested).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plansheet.functions import scalar as S
from plansheet.operators.tables import each_pair, stored

NINE = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
#: Pairs of rows of a drawing that one kernel compares.
PAIRS = 1 << 22
SEG = ("x1", "y1", "x2", "y2")


def cell(x: Column, size: Column | float) -> Column:
    return F.floor(x / size).cast("bigint")


def around(df: DataFrame, x: str, y: str, size: Column | float) -> DataFrame:
    """A row for each of the nine cells around (x, y), as _cx and _cy."""
    near = F.array(*(F.struct((cell(F.col(x), size) + i).alias("_cx"), (cell(F.col(y), size) + j).alias("_cy")) for i, j in NINE))
    return df.withColumn("_near", F.explode(near)).withColumn("_cx", F.col("_near._cx")).withColumn("_cy", F.col("_near._cy")).drop("_near")


def overlapped(df: DataFrame, x: tuple[Column, Column], y: tuple[Column, Column], size: Column | float) -> DataFrame:
    """A row for each cell that a box (low and high of x and y) overlaps, as _cx and _cy."""
    cells = lambda low, high: F.explode(F.sequence(cell(low, size), cell(high, size)))
    return df.withColumn("_cx", cells(*x)).withColumn("_cy", cells(*y))


def range_join(left: DataFrame, right: DataFrame, radius: float, key: str = "drawing_id") -> DataFrame:
    """Pairs within radius. left has key, id, x, y; right key, rid, rx, ry. Adds dist."""
    size, reach = 3 * radius, radius * (1 + 1e-9) + 1e-9  # of cells three times the range, about three are overlapped
    a = overlapped(left, (F.col("x") - reach, F.col("x") + reach), (F.col("y") - reach, F.col("y") + reach), size)
    b = right.withColumn("_cx", cell(F.col("rx"), size)).withColumn("_cy", cell(F.col("ry"), size))
    out = a.join(b, [key, "_cx", "_cy"]).withColumn("dist", S.distance(*(F.col(c) for c in ("x", "y", "rx", "ry"))))
    return out.where(F.col("dist") <= radius).drop("_cx", "_cy")


def large_keys(left: DataFrame, right: DataFrame, key: str, pairs: int) -> DataFrame | None:
    """The keys with more than so many pairs of rows; none, if there is no such key."""
    count = lambda df, name: df.groupBy(key).agg(F.count(F.lit(1)).alias(name))
    out = stored(count(left, "_l").join(count(right, "_r"), key).where(F.col("_l") * F.col("_r") > pairs).select(key), "large-keys")
    return None if out.isEmpty() else out


def split(left: DataFrame, right: DataFrame, key: str, pairs: int, few, many) -> DataFrame:
    """few(left, right) for keys with at most so many pairs of rows, many(left, right) for the others."""
    large = large_keys(left, right, key, pairs)
    if large is None:
        return few(left, right)
    part = lambda how: (df.join(large, key, how) for df in (left, right))
    return few(*part("left_anti")).unionByName(many(*part("left_semi")))


def kernel(left: DataFrame, right: DataFrame, key: str, columns: list[str], run) -> DataFrame:
    """run(left, right) of each key's rows as Arrow tables, giving (places in left, other columns); a row of (key, columns of left, others)."""
    schema = ", ".join([f"`{c}` {left.schema[c].dataType.simpleString()}" for c in (key, "id")] + columns)

    names = [f"_r{k}" for k, c in enumerate(right.columns) if c != key]
    own = [c for c in right.columns if c != key]

    def both(a: pa.Table, b: pa.Table) -> pa.Table:
        at, others = run(a, b.rename_columns([key, *own]))
        at = pa.array(at)
        held = (a.column(c).take(at) for c in (key, "id"))
        return pa.Table.from_arrays([c.cast(_nullable(c.type)) if pa.types.is_struct(c.type) else c for c in (*held, *others)], names=[key, "id", *(c.split()[0] for c in columns)])

    return each_pair(left, right.select(key, *(F.col(c).alias(n) for c, n in zip(own, names))), both, schema, key)


def _nullable(kind: pa.DataType) -> pa.DataType:
    """kind with all fields nullable, as a schema written as text has them."""
    return pa.struct([pa.field(f.name, _nullable(f.type)) for f in kind]) if pa.types.is_struct(kind) else kind


def _spans(right: DataFrame, key: str, x: tuple[str, str], y: tuple[str, str], per_cell: float, levels: int, more: Column | None = None) -> DataFrame:
    """(key, _size, _wide, _x0, _x1, _y0, _y1): the box of each drawing and a first cell that holds about per_cell rows, by the box's area if it has one."""
    low, high = (lambda c: F.least(*c) if len(set(c)) > 1 else F.col(c[0])), (lambda c: F.greatest(*c) if len(set(c)) > 1 else F.col(c[0]))
    span = right.groupBy(key).agg(F.min(low(x)).alias("_x0"), F.max(high(x)).alias("_x1"), F.min(low(y)).alias("_y0"), F.max(high(y)).alias("_y1"), F.count(F.lit(1)).alias("_n"), (F.sum(more) if more is not None else F.lit(0.0)).alias("_more"))
    wide = F.greatest(F.col("_x1") - F.col("_x0"), F.col("_y1") - F.col("_y0"), F.lit(1e-9))
    thin = F.greatest(F.least(F.col("_x1") - F.col("_x0"), F.col("_y1") - F.col("_y0")), wide / (F.col("_n") / per_cell))  # a strip is cut along its length alone
    size = F.least(wide, F.sqrt(wide * thin * per_cell / F.col("_n")))
    return stored(span.select(key, F.greatest(size, wide / (4.0**levels), F.col("_more") / (4 * F.col("_n"))).alias("_size"), wide.alias("_wide"), "_x0", "_x1", "_y0", "_y1"), "spans")


def _outwards(left: DataFrame, span: DataFrame, grid, key: str, levels: int, best, distance: str) -> DataFrame:
    """(key, id, _best) by passes over coarser and coarser cells.

    grid(level) is the other side with _cx and _cy on that level; best is the aggregate over a point's pairs; distance is
    what of it has to be under a cell's width to be settled.
    """
    todo = left.select(key, "id", "x", "y").join(span, key)
    # a point outside the box looks from the nearest place on its edge: what is nearer than d to the point is nearer than sqrt(d^2 - off^2) to that
    todo = stored(todo.withColumn("_px", F.greatest("_x0", F.least("_x1", "x"))).withColumn("_py", F.greatest("_y0", F.least("_y1", "y"))), "nearest-todo")
    done = None
    for level in range(levels + 1):
        size = F.col("_size") * (4.0**level)
        a = around(todo, "_px", "_py", size)
        found = a.join(grid(level), [key, "_cx", "_cy"]).groupBy(key, "id", "x", "y").agg(best.alias("_best"))
        off2 = S.distance_squared(*(F.col(c) for c in ("x", "y", "_px", "_py")))
        d = F.expr(distance)
        every = stored(todo.join(found, [key, "id", "x", "y"], "left").withColumn("_sure", d * d - off2 <= size * size).withColumn("_last", size >= F.col("_wide")), "nearest-pass")
        settled = F.coalesce(F.col("_sure"), F.lit(False)) | F.col("_last")
        out = every.where(settled).select(key, "id", "_best")
        done = out if done is None else done.unionByName(out)
        todo = stored(every.where(~settled).drop("_best", "_sure", "_last"), "nearest-todo")
        if todo.isEmpty():
            break
    return done


def nearest(left: DataFrame, right: DataFrame, key: str = "drawing_id", per_cell: float = 2.0, levels: int = 12) -> DataFrame:
    """(key, id, rid, dist): the nearest right point (key, rid, rx, ry) of each left one (key, id, x, y), the smaller rid on ties.

    Points without any right point in their drawing get null and an infinite distance.
    """
    span, at = _point_grid(right, key, per_cell, levels)
    d = S.distance(*(F.col(c) for c in ("x", "y", "rx", "ry")))
    done = _outwards(left, span, at, key, levels, F.min(F.struct(d.alias("dist"), F.col("rid"))), "_best.dist").select(key, "id", "_best.rid", "_best.dist")
    none = left.select(key, "id").join(span.select(key), key, "left_anti").select(key, "id", F.lit(None).cast(right.schema["rid"].dataType).alias("rid"), F.lit(float("inf")).alias("dist"))
    return done.unionByName(none)


def _point_grid(right: DataFrame, key: str, per_cell: float, levels: int):
    span = _spans(right, key, ("rx", "rx"), ("ry", "ry"), per_cell, levels)
    grid = stored(right.select(key, "rid", "rx", "ry").join(span.select(key, "_size"), key), "nearest-grid")

    def at(level: int) -> DataFrame:
        size = F.col("_size") * (4.0**level)
        return grid.select(key, "rid", "rx", "ry", cell(F.col("rx"), size).alias("_cx"), cell(F.col("ry"), size).alias("_cy"))

    return span, at


class _KNearest:
    """The k nearest of each of a drawing's points, in blocks."""

    def __init__(self, k: int):
        self.k = k

    def __call__(self, a: pa.Table, b: pa.Table):
        if pa.types.is_integer(b.schema.field("rid").type):
            ids = b.column("rid").to_numpy()
            if (ids[1:] < ids[:-1]).any():
                b = b.take(pa.array(np.argsort(ids, kind="stable")))
        else:
            b = b.sort_by("rid")
        p, q = (np.column_stack([t.column(c).to_numpy() for c in names]) for t, names in ((a, "xy"), (b, ("rx", "ry"))))
        k, near, dist = min(self.k, len(q)), [], []
        for i in range(0, len(p), block := max(1, (1 << 16) // len(q))):
            d = np.sqrt((p[i : i + block, :1] - q[:, 0]) ** 2 + (p[i : i + block, 1:] - q[:, 1]) ** 2)
            near.append(d.argmin(1)[:, None] if k == 1 else np.argsort(d, axis=1, kind="stable")[:, :k])
            dist.append(np.take_along_axis(d, near[-1], 1))
        near, dist = np.concatenate(near), np.concatenate(dist)
        return np.repeat(np.arange(len(p)), k), [pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(p))), b.column("rid").take(pa.array(near.ravel())), pa.array(dist.ravel())]


def k_nearest(left: DataFrame, right: DataFrame, k: int, key: str = "drawing_id", pairs: int = PAIRS, per_cell: float = 2.0, levels: int = 12) -> DataFrame:
    """(key, id, rank, rid, dist): the k nearest of each, ties to the smaller rid; all, if a drawing has fewer.

    A point is settled when its k-th distance is under the width of the cells around it; what a pass found is kept as the
    k least pairs of distance and rid alone.
    """
    d = S.distance(*(F.col(c) for c in ("x", "y", "rx", "ry")))
    right = right.select(key, "rid", "rx", "ry")

    def grid(a: DataFrame, b: DataFrame) -> DataFrame:
        if k == 1:  # the least pair, whose partial results don't grow with what a cell holds
            near_one = nearest(a, b, key, per_cell, levels).where("rid is not null")
            return near_one.select(key, "id", F.lit(1).alias("rank"), "rid", "dist")
        span, at = _point_grid(b, key, max(per_cell, k / 4), levels)
        pair = F.struct(d.alias("dist"), F.col("rid"))
        best = F.slice(F.array_sort(F.collect_list(pair)), 1, k)  # of nine cells' points
        done = _outwards(a, span, at, key, levels, best, f"if(size(_best) >= {k}, _best[{k - 1}].dist, null)")
        return done.select(key, "id", F.posexplode("_best").alias("rank", "b")).select(key, "id", (F.col("rank") + 1).alias("rank"), "b.rid", "b.dist")

    rid = right.schema["rid"].dataType.simpleString()
    few = lambda a, b: kernel(a.select(key, "id", "x", "y"), b, key, ["rank int", f"rid {rid}", "dist double"], _KNearest(k))
    return split(left.select(key, "id", "x", "y"), right, key, pairs, few, grid)


def cells_of(segments: DataFrame, size: float) -> DataFrame:
    """A row for each cell that a segment's box overlaps (cell size at least 1)."""
    size = max(1.0, size)
    xs = F.sequence(cell(F.least("x1", "x2"), size), cell(F.greatest("x1", "x2"), size))
    ys = F.sequence(cell(F.least("y1", "y2"), size), cell(F.greatest("y1", "y2"), size))
    return segments.withColumn("cell_x", F.explode(xs)).withColumn("cell_y", F.explode(ys))


def meeting_boxes(left: DataFrame, right: DataFrame, keys: list[str], size: float) -> DataFrame:
    """Pairs of rows of left (keys, a, its box as _ax0, _ax1, _ay0, _ay1) and right (keys, b, _bx0, ...) whose boxes meet, each once.

    A box stands on the level whose cells are as wide as the box at least, so in four cells at most, and is looked up on
    its drawing's levels above: rows don't grow with a box's size, and a long line among short ones costs these four rows each.
    """
    level = lambda s: F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(F.col(f"_{s}x1") - F.col(f"_{s}x0"), F.col(f"_{s}y1") - F.col(f"_{s}y0"), F.lit(1e-12)) / size))).cast("int")
    a, b = left.withColumn("_al", level("a")), right.withColumn("_bl", level("b"))
    held = a.select(*keys, F.col("_al").alias("_l")).unionByName(b.select(*keys, F.col("_bl").alias("_l"))).groupBy(*keys).agg(F.collect_set("_l").alias("_levels"))
    held = stored(held, "levels")

    def on(df: DataFrame, s: str, above: bool) -> DataFrame:
        """df on its own level, or on all levels above."""
        own = F.col(f"_{s}l")
        df = df.join(held, keys).withColumn("_l", F.explode(F.filter("_levels", lambda x: x > own))).drop("_levels") if above else df.withColumn("_l", own)
        wide = F.pow(F.lit(2.0), F.col("_l")) * size
        return overlapped(df, (F.col(f"_{s}x0"), F.col(f"_{s}x1")), (F.col(f"_{s}y0"), F.col(f"_{s}y1")), wide)

    def pairs(x: DataFrame, y: DataFrame) -> DataFrame:
        wide = F.pow(F.lit(2.0), F.col("_l")) * size
        first = lambda k: F.greatest(cell(F.col(f"_a{k}0"), wide), cell(F.col(f"_b{k}0"), wide))
        meet = (F.col("_ax1") >= F.col("_bx0")) & (F.col("_bx1") >= F.col("_ax0")) & (F.col("_ay1") >= F.col("_by0")) & (F.col("_by1") >= F.col("_ay0"))
        return x.join(y, [*keys, "_l", "_cx", "_cy"]).where(meet & (F.col("_cx") == first("x")) & (F.col("_cy") == first("y")))

    low_a, low_b = on(a, "a", False), on(b, "b", False)
    out = pairs(low_a, low_b).unionByName(pairs(on(a, "a", True), low_b)).unionByName(pairs(low_a, on(b, "b", True)))
    return out.drop("_l", "_cx", "_cy", "_al", "_bl", *(f"_{s}{k}{i}" for s in "ab" for k in "xy" for i in "01"))


def bounds(s: str, names: tuple[str, ...] = SEG, pad: Column | float = 0.0) -> list[Column]:
    """A segment's box, widened by pad, as the columns that meeting_boxes takes."""
    pad = F.lit(pad) if isinstance(pad, float) else pad
    x1, y1, x2, y2 = (F.col(c) for c in names)
    return [(F.least(x1, x2) - pad).alias(f"_{s}x0"), (F.greatest(x1, x2) + pad).alias(f"_{s}x1"), (F.least(y1, y2) - pad).alias(f"_{s}y0"), (F.greatest(y1, y2) + pad).alias(f"_{s}y1")]


def box_pairs(segments: DataFrame, size: float, key: str = "drawing_id", tol: float = 1e-6) -> DataFrame:
    """Pairs of segments (suffixes _a and _b, a before b) whose boxes, widened by tol on one side, meet; each once."""
    names = [c for c in segments.columns if c != key]
    a = segments.select(key, *(F.col(c).alias(f"{c}_a") for c in names), *bounds("a", pad=tol))
    b = segments.select(key, *(F.col(c).alias(f"{c}_b") for c in names), *bounds("b"))
    return meeting_boxes(a, b, [key], max(1.0, size)).where("seg_id_a < seg_id_b")


class _NearestSegment:
    """The nearest of a drawing's segments for each of its points, in blocks."""

    def __call__(self, a: pa.Table, b: pa.Table):
        ids = b.column("seg_id").to_numpy()
        if (ids[1:] < ids[:-1]).any():
            b = b.take(pa.array(np.argsort(ids, kind="stable")))
        x, y = (a.column(c).to_numpy()[:, None] for c in "xy")
        x1, y1, x2, y2 = (b.column(c).to_numpy() for c in SEG)
        dx, dy = x2 - x1, y2 - y1
        length = dx * dx + dy * dy
        near, dist = np.empty(len(a), np.int64), np.empty(len(a))
        for i in range(0, len(a), block := max(1, (1 << 15) // len(b))):
            part = slice(i, i + block)
            t = np.where(length < 1e-24, 0.0, ((x[part] - x1) * dx + (y[part] - y1) * dy) / np.where(length < 1e-24, 1.0, length))
            t = np.clip(t, 0.0, 1.0)
            d = np.sqrt((x1 + t * dx - x[part]) ** 2 + (y1 + t * dy - y[part]) ** 2)
            near[part] = d.argmin(1)
            dist[part] = d.min(1)
        return np.arange(len(a)), [*(b.column(c).take(pa.array(near)) for c in ("seg_id", "layer")), pa.array(dist)]


def walked(segments: DataFrame, size: Column) -> DataFrame:
    """A row for each cell that a segment crosses, as _cx and _cy: column by column, the rows between where it enters and leaves."""
    x1, y1, x2, y2 = (F.col(c) for c in SEG)
    low, high, edge = F.least(x1, x2), F.greatest(x1, x2), 1e-9 * size
    df = segments.withColumn("_cx", F.explode(F.sequence(cell(low - edge, size), cell(high + edge, size))))
    y_at = lambda x: F.when(high - low > 0, y1 + (x - x1) / (x2 - x1) * (y2 - y1))
    enter, leave = F.greatest(low, F.col("_cx") * size), F.least(high, (F.col("_cx") + 1) * size)
    steep = high - low <= 1e-9 * F.abs(y2 - y1)  # all of it in one column
    a, b = F.when(steep, y1).otherwise(y_at(enter)), F.when(steep, y2).otherwise(y_at(leave))
    return df.withColumn("_cy", F.explode(F.sequence(cell(F.least(a, b) - edge, size), cell(F.greatest(a, b) + edge, size))))


def nearest_segment(pts: DataFrame, segments: DataFrame, key: str = "drawing_id", cap: float | None = None, pairs: int = PAIRS, per_cell: float = 2.0, levels: int = 12) -> DataFrame:
    """(key, id, seg_id, layer, dist): the segment nearest to each point, the first on ties; under cap, if there is one."""
    d = S.point_segment_distance(*(F.col(c) for c in (*SEG, "x", "y")))
    segments = segments.select(key, "seg_id", "layer", *SEG)

    def grid(a: DataFrame, b: DataFrame) -> DataFrame:
        length = S.distance(*(F.col(c) for c in SEG))
        span = _spans(b, key, ("x1", "x2"), ("y1", "y2"), per_cell, levels, length)
        base = stored(walked(b.join(span.select(key, "_size"), key), F.col("_size")).drop("_size"), "segment-grid")

        def at(level: int) -> DataFrame:
            up = lambda c: F.shiftright(F.col(c), 2 * level).alias(c)
            return base if level == 0 else base.withColumns({"_cx": up("_cx"), "_cy": up("_cy")}).distinct()

        best = F.min(F.struct(d.alias("dist"), F.col("seg_id"), F.col("layer")))
        return _outwards(a, span, at, key, levels, best, "_best.dist").select(key, "id", "_best.seg_id", "_best.layer", "_best.dist")

    kinds = [f"{c} {segments.schema[c].dataType.simpleString()}" for c in ("seg_id", "layer")]
    out = split(pts.select(key, "id", "x", "y"), segments, key, pairs, lambda a, b: kernel(a, b, key, [*kinds, "dist double"], _NearestSegment()), grid)
    return out.where(F.col("dist") < cap) if cap else out


def nearest_one(left: DataFrame, right: DataFrame, key: str = "drawing_id") -> DataFrame:
    """nearest() where a kernel takes the small drawings; points without any right point are left out."""
    return k_nearest(left, right, 1, key).drop("rank")
