"""Steps of a pen or cutter over the sheet, whatever program they come from.

A reader turns its program into steps with a table of its modes; `trace` is the one fold over them, and holds the place
of the tool. The plane is that of complex numbers.
"""

from __future__ import annotations

import cmath
import math
from collections.abc import Iterable
from dataclasses import dataclass

from plansheet.sources.entities import Sheet, Unreadable

#: What counts as no distance, and how far an arc's end may be off its circle (mm, and share of the radius).
NOWHERE, OFF_CIRCLE, OFF_SHARE = 1e-9, 0.01, 1e-4


@dataclass(frozen=True)
class Turn:
    """An arc to the step's end: by a radius, negative for the long way round, or by its centre."""

    ccw: bool
    radius: float | None = None
    x: float | None = None
    y: float | None = None
    from_start: bool = True

    def pivot(self, p: complex, q: complex) -> complex:
        given = [v is not None for v in (self.x, self.y)]
        if self.radius is not None:
            chord, r = abs(q - p), abs(self.radius)
            if any(given) or not NOWHERE < chord <= 2 * r:
                raise Unreadable("arc radius")
            left = self.ccw == (self.radius >= 0)
            return (p + q) / 2 + 1j * (q - p) / chord * math.sqrt(max(0.0, r * r - chord * chord / 4)) * (1 if left else -1)
        if not (any(given) if self.from_start else all(given)):
            raise Unreadable("arc centre")
        c = complex(self.x or 0.0, self.y or 0.0) + self.from_start * p
        r = abs(p - c)
        if r <= NOWHERE or abs(abs(q - c) - r) > max(OFF_CIRCLE, OFF_SHARE * r):
            raise Unreadable("arc centre and end don't agree")
        return c


@dataclass(frozen=True)
class Step:
    """Where to go (None: stay, in mm), from the origin or from here, and the layer to draw on, if any."""

    x: float | None = None
    y: float | None = None
    z: float | None = None
    relative: bool = False
    layer: str | None = None
    turn: Turn | None = None


def _bend(sheet: Sheet, p: complex, q: complex, turn: Turn, layer: str) -> None:
    c = turn.pivot(p, q)
    angles = [cmath.phase(p - c), cmath.phase(q - c)]
    if abs(q - p) < NOWHERE:  # once round: two halves
        angles = [angles[0], angles[0] + (math.pi if turn.ccw else -math.pi), angles[0]]
    for a, b in zip(angles, angles[1:]):
        sheet.arc(c.real, c.imag, abs(p - c), a, b, turn.ccw, layer)


def trace(steps: Iterable[Step], sheet: Sheet) -> Sheet:
    here, height = 0j, 0.0
    for s in steps:
        x, y, z = (old if v is None else v + s.relative * old for v, old in ((s.x, here.real), (s.y, here.imag), (s.z, height)))
        there = complex(x, y)
        if s.layer is not None and s.turn is None:
            sheet.line((here.real, here.imag), (x, y), s.layer)
        elif s.layer is not None:
            if z != height:
                raise Unreadable("helical arc")
            _bend(sheet, here, there, s.turn, s.layer)
        here, height = there, z
    return sheet
