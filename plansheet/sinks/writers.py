"""Sinks: drawings as DXF text and JSON, and reports as JSON; each a column, written by Spark's own writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plansheet.functions import scalar as S

#: Colours of the layers that every file has.
COLOURS = {"OUTER_FRAME": 5, "CNC_CUTOUT": 7, "CNC_POCKET": 3, "SYMMETRY_AXIS": 1}
#: The file format's name of each release.
VERSIONS = {"R12": "AC1009", "R2000": "AC1015", "R2004": "AC1018", "R2007": "AC1021", "R2010": "AC1024", "R2013": "AC1027", "R2018": "AC1032"}


def _pairs(*items: tuple[int, Column | str | int]) -> Column:
    """Group codes and values, a line each."""
    return F.concat_ws("\n", *(x for code, v in items for x in (F.lit(str(code)), v.cast("string") if isinstance(v, Column) else F.lit(str(v)))))


def _collected(df: DataFrame, key: str, record: Column, most: int | None) -> DataFrame:
    own = [] if most is None else [F.floor(F.col(key) / most).cast("bigint").alias("sheet")]
    return df.select("drawing_id", *own, F.struct(F.col(key).alias("k"), record.alias("v")).alias("r"), F.coalesce("layer", F.lit("0")).alias("layer")).groupBy("drawing_id", *["sheet"][: len(own)]).agg(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["v"]).alias("rows"), F.collect_set("layer").alias("layers"))


def dxf_text(segments: DataFrame, arcs: DataFrame | None = None, circles: DataFrame | None = None, version: str = "R2013", most: int | None = None) -> DataFrame:
    """(drawing_id, text): a DXF file in millimetres for each drawing. Clockwise arcs are written from their end.

    With `most`, (drawing_id, sheet, text): a file for each run of so many numbers, so that a file and the task that writes
    or reads it don't grow with the drawing. Readers refuse files of over entities.MOST_ENTITIES.
    """
    by = ["drawing_id"] if most is None else ["drawing_id", "sheet"]
    layer = F.coalesce("layer", F.lit("0"))
    parts = [_collected(segments, "seg_id", _pairs((0, "LINE"), (8, layer), (10, F.col("x1")), (20, F.col("y1")), (11, F.col("x2")), (21, F.col("y2"))), most)]
    if arcs is not None:
        a, b = F.when(F.col("is_ccw"), F.col("a0")).otherwise(F.col("a1")), F.when(F.col("is_ccw"), F.col("a1")).otherwise(F.col("a0"))
        parts.append(_collected(arcs, "arc_id", _pairs((0, "ARC"), (8, layer), (10, F.col("cx")), (20, F.col("cy")), (40, F.col("r")), (50, F.degrees(a)), (51, F.degrees(b))), most))
    if circles is not None:
        parts.append(_collected(circles, "circle_id", _pairs((0, "CIRCLE"), (8, layer), (10, F.col("cx")), (20, F.col("cy")), (40, F.col("r"))), most))
    out = parts[0].select(*by, F.col("rows").alias("r0"), F.col("layers").alias("l0"))
    for k, p in enumerate(parts[1:], 1):
        out = out.join(p.select(*by, F.col("rows").alias(f"r{k}"), F.col("layers").alias(f"l{k}")), by, "full")
    none = F.array().cast("array<string>")
    rows = F.concat(*(F.coalesce(f"r{k}", none) for k in range(len(parts))))
    used = F.array_sort(F.array_union(F.array(*map(F.lit, COLOURS)), F.array_distinct(F.concat(*(F.coalesce(f"l{k}", none) for k in range(len(parts)))))))
    colours = F.create_map(*(F.lit(x) for pair in COLOURS.items() for x in pair))
    tables = F.array_join(F.transform(used, lambda n: _pairs((0, "LAYER"), (2, n), (70, 0), (62, F.coalesce(F.try_element_at(colours, n), F.lit(7))), (6, "CONTINUOUS"))), "\n")
    version = version.upper() if version and version.upper() in VERSIONS else "R2013"
    head = [(0, "SECTION"), (2, "HEADER"), (9, "$ACADVER"), (1, VERSIONS[version]), *([(9, "$INSUNITS"), (70, 4)] if version != "R12" else []), (9, "$MEASUREMENT"), (70, 1), (0, "ENDSEC")]
    text = F.concat_ws("\n", _pairs(*head, (0, "SECTION"), (2, "TABLES"), (0, "TABLE"), (2, "LAYER"), (70, F.size(used))), tables, _pairs((0, "ENDTAB"), (0, "ENDSEC"), (0, "SECTION"), (2, "ENTITIES")), F.array_join(rows, "\n"), _pairs((0, "ENDSEC"), (0, "EOF")))
    return out.select(*by, text.alias("text"))


def write_dxf(files: DataFrame, path: str) -> None:
    """A folder for each drawing with one DXF file."""
    files.repartition("drawing_id").sortWithinPartitions("drawing_id").write.partitionBy("drawing_id").option("maxRecordsPerFile", 1).text(path)


def drawing_json(segments: DataFrame, arcs: DataFrame | None = None, circles: DataFrame | None = None) -> DataFrame:
    """(drawing_id, json): lines and arcs rounded to 3 places, angles to 4, circles as full arcs, and the box of the lines to 2."""
    r = lambda c, n=3: F.round(c, n)
    line = F.struct("seg_id", *(r(c).alias(c) for c in ("x1", "y1", "x2", "y2")), "layer")
    out = segments.groupBy("drawing_id").agg(
        F.array_sort(F.collect_list(line)).alias("lines"),
        F.struct(r(F.min(F.least("x1", "x2")), 2).alias("min_x"), r(F.max(F.greatest("x1", "x2")), 2).alias("max_x"), r(F.min(F.least("y1", "y2")), 2).alias("min_y"), r(F.max(F.greatest("y1", "y2")), 2).alias("max_y")).alias("box"),
    )
    both = None
    if arcs is not None:
        both = arcs.select("drawing_id", F.struct("arc_id", r("cx").alias("cx"), r("cy").alias("cy"), r("r").alias("radius"), r("a0", 4).alias("start_ang"), r("a1", 4).alias("end_ang"), "is_ccw", "layer").alias("a"))
    if circles is not None:
        full = circles.select("drawing_id", F.struct(F.col("circle_id").alias("arc_id"), "cx", "cy", F.col("r").alias("radius"), F.lit(0.0).alias("start_ang"), F.lit(S.TAU).alias("end_ang"), F.lit(True).alias("is_ccw"), "layer").alias("a"))
        both = full if both is None else both.unionByName(full)
    if both is not None:
        out = out.join(both.groupBy("drawing_id").agg(F.array_sort(F.collect_list("a")).alias("arcs")), "drawing_id", "full")
    return out.select("drawing_id", F.to_json(F.struct(*(c for c in out.columns if c != "drawing_id"))).alias("json"))


def report_json(report: DataFrame, places: int = 4) -> DataFrame:
    """(drawing_id, json) of any report with a row for each drawing, doubles rounded."""
    cols = [F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in report.dtypes if c != "drawing_id"]
    return report.select("drawing_id", F.to_json(F.struct(*cols)).alias("json"))
