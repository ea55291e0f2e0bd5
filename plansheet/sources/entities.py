"""The rows that every reader gives, and what a drawing must keep to."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

#: Extensions and the reader of each.
FORMATS = {".dxf": "dxf", ".dwg": "dwg", ".svg": "svg", ".plt": "hpgl", ".hpgl": "hpgl", ".hpg": "hpgl", ".nc": "gcode", ".cnc": "gcode", ".tap": "gcode", ".gcode": "gcode", ".ngc": "gcode"}
MOST_BYTES = 50 * 1024 * 1024
MOST_ENTITIES = 100_000
ENTITY = "kind string, ent_id bigint, x1 double, y1 double, x2 double, y2 double, cx double, cy double, r double, a0 double, a1 double, is_ccw boolean, layer string"
NAMES = [c.split()[0] for c in ENTITY.split(", ")]


class Unreadable(Exception):
    """A drawing that can't be read whole; its message goes to the error column."""


@dataclass
class Sheet:
    """What a reader collects from one file."""

    rows: list[tuple] = field(default_factory=list)
    skipped: dict[str, int] = field(default_factory=dict)
    warnings: list[str] = field(default_factory=list)
    dots: bool = False  # whether lines without length are kept

    def _add(self, row: tuple) -> None:
        self.rows.append(row)
        if len(self.rows) > MOST_ENTITIES:
            raise Unreadable("too many entities")

    def line(self, a: tuple[float, float], b: tuple[float, float], layer: str = "0") -> None:
        if self.dots or math.dist(a, b) > 1e-9:
            self._add(("line", len(self.rows), *map(float, (*a, *b)), None, None, None, None, None, None, layer))

    def arc(self, cx: float, cy: float, r: float, a0: float, a1: float, ccw: bool, layer: str = "0") -> None:
        self._add(("arc", len(self.rows), None, None, None, None, *map(float, (cx, cy, r, a0, a1)), ccw, layer))

    def circle(self, cx: float, cy: float, r: float, layer: str = "0") -> None:
        self._add(("circle", len(self.rows), None, None, None, None, float(cx), float(cy), float(r), None, None, None, layer))

    def bulged(self, a: tuple[float, float], b: tuple[float, float], bulge: float, layer: str = "0") -> None:
        """An edge of a polyline: an arc if its bulge and chord aren't next to nothing."""
        chord = math.dist(a, b)
        if abs(bulge) < 1e-6 or chord < 1e-6:
            return self.line(a, b, layer)
        half = 2 * math.atan(bulge)
        d = chord / 2 / math.tan(half)
        cx, cy = (a[0] + b[0]) / 2 - (b[1] - a[1]) / chord * d, (a[1] + b[1]) / 2 + (b[0] - a[0]) / chord * d
        self.arc(cx, cy, abs(chord / 2 / math.sin(half)), math.atan2(a[1] - cy, a[0] - cx) % math.tau, math.atan2(b[1] - cy, b[0] - cx) % math.tau, bulge > 0, layer)

    def check(self) -> None:
        if not self.rows:
            raise Unreadable("no 2D geometry")
        for row in self.rows:
            if not all(math.isfinite(v) and abs(v) < 1e9 for v in row[2:11] if v is not None):
                raise Unreadable("coordinates out of range")
