"""Reading drawings: files or program texts to entity rows, a file's failure being a row of its own."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plansheet.shipping import ship
from plansheet.sources import dxf, gcode, hpgl, svg
from plansheet.sources.entities import ENTITY, FORMATS, MOST_BYTES, NAMES, Sheet, Unreadable

READERS = {"dxf": dxf.read, "svg": svg.read, "hpgl": hpgl.read, "gcode": gcode.read}
EXTRA = "source_format string, error string, warnings array<string>, skipped map<string,int>"


def formats(spark: SparkSession) -> DataFrame:
    """(extension, reader, available): DWG needs an outside converter, which isn't part of this."""
    return spark.createDataFrame([(k, v, v != "dwg") for k, v in FORMATS.items()], "extension string, reader string, available boolean")


def read_one(extension: str, data: bytes, readers: dict[str, Callable[[str], Sheet]] = READERS) -> tuple[list[tuple], str | None, list[str], dict[str, int]]:
    """Entity rows, error, warnings and counts of what was left out."""
    kind = FORMATS.get(extension.lower())
    try:
        if kind is None:
            raise Unreadable("unknown format")
        if len(data) > MOST_BYTES:
            raise Unreadable("file too large")
        if kind == "dwg":
            raise Unreadable("converter unavailable" if data[:4] == b"AC10" and data[4:6].isdigit() else "bad signature")
        sheet = readers[kind](data.decode("utf-8-sig", "strict" if kind != "dxf" else "replace"))
        sheet.check()
        return sheet.rows, None, sheet.warnings, sheet.skipped
    except Unreadable as e:
        return [], str(e), [], {}
    except (ValueError, IndexError, KeyError, ArithmeticError, RecursionError) as e:
        return [], f"broken file: {type(e).__name__}", [], {}


def parse(programs: DataFrame, readers: dict[str, Callable[[str], Sheet]] = READERS) -> DataFrame:
    """programs (drawing_id, extension, content) as entities; an unreadable one gives a row with its error and no entity."""
    ship(programs.sparkSession)
    kind = programs.schema["drawing_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for key, extension, content in zip(pdf.drawing_id, pdf.extension, pdf.content):
                rows, error, warnings, skipped = read_one(extension or "", bytes(content or b""), readers)
                out = pd.DataFrame(rows or [(None,) * len(NAMES)], columns=NAMES)
                out["ent_id"] = out["ent_id"].astype("Int64")
                yield out.assign(drawing_id=key, source_format=extension.lower().lstrip(".") if extension else None, error=error, warnings=[warnings] * len(out), skipped=[skipped] * len(out))

    return programs.select("drawing_id", "extension", F.col("content").cast("binary").alias("content")).mapInPandas(run, f"{ENTITY}, drawing_id {kind}, {EXTRA}")


def read(spark: SparkSession, path: str) -> DataFrame:
    """All drawings below path, by their path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return parse(files.select(F.col("path").alias("drawing_id"), F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).alias("extension"), "content"))


def entities(parsed: DataFrame, kind: str) -> DataFrame:
    """segments, arcs or circles (kind line, arc, circle) of parsed drawings."""
    own = {"line": ("seg_id", "x1", "y1", "x2", "y2"), "arc": ("arc_id", "cx", "cy", "r", "a0", "a1", "is_ccw"), "circle": ("circle_id", "cx", "cy", "r")}[kind]
    return parsed.where(F.col("kind") == kind).select("drawing_id", F.col("ent_id").alias(own[0]), *own[1:], "layer")


def skipped_counts(parsed: DataFrame) -> DataFrame:
    """(drawing_id, kind, n): entities left out of each drawing."""
    return parsed.groupBy("drawing_id").agg(F.any_value("skipped").alias("s")).select("drawing_id", F.explode("s").alias("kind", "n"))


def edited(lines_json: DataFrame, least: float = 1e-4) -> DataFrame:
    """(drawing_id, json) of edited lines as segments, those next to nothing left out."""
    rows = lines_json.select("drawing_id", F.posexplode(F.from_json("json", "array<struct<x1:double,y1:double,x2:double,y2:double,layer:string>>")).alias("seg_id", "l"))
    out = rows.select("drawing_id", F.col("seg_id").cast("bigint").alias("seg_id"), "l.*")
    return out.where(F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")) > least).na.fill({"layer": "0"})
