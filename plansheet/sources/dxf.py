"""DXF as text: group codes to entities, blocks expanded, units made millimetres."""

from __future__ import annotations

import math
from collections.abc import Iterator

from plansheet.operators.curves import approximate, ellipse, spline
from plansheet.sources.entities import Sheet, Unreadable

#: Millimetres for each value of $INSUNITS.
UNITS = {0: 1.0, 1: 25.4, 2: 304.8, 3: 1609344.0, 4: 1.0, 5: 10.0, 6: 1000.0}
DEEPEST = 32
Matrix = tuple[float, float, float, float, float, float]


class Entity:
    """A record's type and its group codes in order."""

    def __init__(self, kind: str):
        self.kind, self.codes, self.parts = kind, [], []

    def get(self, code: int, default=0.0):
        return next((type(default)(v) if not isinstance(default, int) else int(float(v)) for c, v in self.codes if c == code), default)

    def all(self, code: int) -> list[float]:
        return [float(v) for c, v in self.codes if c == code]


def pairs(text: str) -> Iterator[tuple[int, str]]:
    lines = text.removeprefix("﻿").splitlines()
    for k in range(0, len(lines) - 1, 2):
        try:
            yield int(lines[k]), lines[k + 1].strip()
        except ValueError:
            raise Unreadable("group code") from None


def sections(text: str) -> tuple[dict[str, str], dict[str, tuple[tuple[float, float], list[Entity]]], list[Entity]]:
    """Header values, blocks with their base points, and the entities of the model."""
    header, blocks, model = {}, {}, []
    section = name = ""
    into: list[Entity] | None = None
    block: Entity | None = None
    now: Entity | None = None
    owner: Entity | None = None
    for code, value in pairs(text):
        if code == 0:
            now = None
            if value in ("SECTION", "ENDSEC", "EOF"):
                section, into = "", None
            elif value == "BLOCK":
                block, into = Entity("BLOCK"), []
                now = block
            elif value == "ENDBLK":
                if block is not None and into is not None:
                    blocks[block.get(2, "")] = ((block.get(10), block.get(20)), into)
                into = None
            elif section == "ENTITIES" or into is not None:
                now = Entity(value)
                if value in ("VERTEX", "SEQEND", "ATTRIB") and owner is not None:
                    owner.parts += [now] if value == "VERTEX" else []
                    owner = None if value == "SEQEND" else owner
                else:
                    (model if section == "ENTITIES" else into).append(now)
                    owner = now if value == "POLYLINE" or value == "INSERT" and owner is None else None
        elif code == 2 and section == "" and now is None:
            section = value
        elif section == "HEADER":
            if code == 9:
                name = value
            else:
                header.setdefault(name, value)
        elif now is not None:
            now.codes.append((code, value))
    return header, blocks, model


def _times(m: Matrix, k: Matrix) -> Matrix:
    return (m[0] * k[0] + m[1] * k[3], m[0] * k[1] + m[1] * k[4], m[0] * k[2] + m[1] * k[5] + m[2], m[3] * k[0] + m[4] * k[3], m[3] * k[1] + m[4] * k[4], m[3] * k[2] + m[4] * k[5] + m[5])


def _at(m: Matrix, x: float, y: float) -> tuple[float, float]:
    return m[0] * x + m[1] * y + m[2], m[3] * x + m[4] * y + m[5]


def expand(entities: list[Entity], blocks: dict, m: Matrix, layer: str = "0", depth: int = 0) -> Iterator[tuple[Entity, Matrix, str]]:
    """Entities with the map to the model and their layer; those of a block on layer 0 take that of its insert."""
    if depth > DEEPEST:
        raise Unreadable("blocks nested too deep")
    for e in entities:
        own = e.get(8, "0")
        own = layer if own == "0" else own
        if e.kind != "INSERT":
            yield e, m, own
            continue
        base, inner = blocks.get(e.get(2, ""), ((0.0, 0.0), []))
        a, sx, sy = math.radians(e.get(50)), e.get(41, 1.0), e.get(42, 1.0)
        c, s = math.cos(a), math.sin(a)
        for row in range(max(1, e.get(71, 1))):
            for column in range(max(1, e.get(70, 1))):
                dx, dy = column * e.get(44), row * e.get(45)
                put = (c * sx, -s * sy, e.get(10) + c * dx - s * dy, s * sx, c * sy, e.get(20) + s * dx + c * dy)
                yield from expand(inner, blocks, _times(m, _times(put, (1.0, 0.0, -base[0], 0.0, 1.0, -base[1]))), own, depth + 1)


def _arc(sheet: Sheet, m: Matrix, cx: float, cy: float, r: float, a0: float, a1: float, layer: str) -> None:
    """A counter-clockwise arc through the map: an arc where that keeps angles, else pieces of an ellipse."""
    if abs(m[0] * m[1] + m[3] * m[4]) < 1e-9 and abs(math.hypot(m[0], m[3]) - math.hypot(m[1], m[4])) < 1e-9:
        x, y = _at(m, cx, cy)
        p, q = (_at(m, cx + r * math.cos(a), cy + r * math.sin(a)) for a in (a0, a1))
        sheet.arc(x, y, r * math.hypot(m[0], m[3]), math.atan2(p[1] - y, p[0] - x) % math.tau, math.atan2(q[1] - y, q[0] - x) % math.tau, m[0] * m[4] - m[1] * m[3] > 0, layer)
    else:
        _curve(sheet, lambda t: _at(m, cx + r * math.cos(t), cy + r * math.sin(t)), a0, a1 if a1 > a0 else a1 + math.tau, layer)


def _curve(sheet: Sheet, curve, t0: float, t1: float, layer: str) -> None:
    for kind, x1, y1, x2, y2, cx, cy, r, a0, a1, ccw in approximate(curve, t0, t1):
        sheet.line((x1, y1), (x2, y2), layer) if kind == "line" else sheet.arc(cx, cy, r, a0, a1, ccw, layer)


def read(text: str) -> Sheet:
    header, blocks, model = sections(text)
    unit = UNITS.get(int(float(header.get("$INSUNITS", "0") or 0)), 1.0)
    sheet, raised = Sheet(), False
    for e, m, layer in expand(model, blocks, (unit, 0.0, 0.0, 0.0, unit, 0.0)):
        kind = e.kind
        if kind in ("ARC", "CIRCLE", "LWPOLYLINE", "POLYLINE") and (e.get(210), e.get(220), e.get(230, 1.0)) != (0.0, 0.0, 1.0):
            sheet.skipped[f"{kind} off the XY plane"] = sheet.skipped.get(f"{kind} off the XY plane", 0) + 1
            continue
        raised |= any(e.all(c) and e.all(c)[0] for c in (30, 31, 38))
        flips = m[0] * m[4] - m[1] * m[3] < 0
        if kind == "LINE":
            sheet.line(_at(m, e.get(10), e.get(20)), _at(m, e.get(11), e.get(21)), layer)
        elif kind == "ARC":
            _arc(sheet, m, e.get(10), e.get(20), e.get(40), math.radians(e.get(50)), math.radians(e.get(51)), layer)
        elif kind == "CIRCLE":
            if abs(math.hypot(m[0], m[3]) - math.hypot(m[1], m[4])) < 1e-9:
                sheet.circle(*_at(m, e.get(10), e.get(20)), e.get(40) * math.hypot(m[0], m[3]), layer)
            else:
                _arc(sheet, m, e.get(10), e.get(20), e.get(40), 0.0, math.tau, layer)
        elif kind in ("LWPOLYLINE", "POLYLINE"):
            if kind == "POLYLINE" and e.get(70, 0) & (16 | 64):
                sheet.skipped["MESH"] = sheet.skipped.get("MESH", 0) + 1
                continue
            points = []
            for v in [e] if kind == "LWPOLYLINE" else e.parts:
                for code, value in v.codes:
                    if code == 10:
                        points.append([float(value), 0.0, 0.0])
                    elif code in (20, 42) and points:
                        points[-1][1 if code == 20 else 2] = float(value)
            ring = points + points[:1] if e.get(70, 0) & 1 else points
            for p, q in zip(ring, ring[1:]):
                sheet.bulged(_at(m, *p[:2]), _at(m, *q[:2]), -p[2] if flips else p[2], layer)
        elif kind == "ELLIPSE":
            one = ellipse(e.get(10), e.get(20), e.get(11), e.get(21), e.get(40, 1.0))
            t0, t1 = e.get(41), e.get(42, math.tau)
            _curve(sheet, lambda t: _at(m, *one(t)), t0, t1 if t1 > t0 else t1 + math.tau, layer)  # noqa: B023
        elif kind == "SPLINE":
            points, knots = list(zip(e.all(10), e.all(20))), e.all(40)
            degree = e.get(71, 3)
            if len(points) > degree and len(knots) >= len(points) + degree + 1:
                one = spline(points, knots, degree)
                _curve(sheet, lambda t: _at(m, *one(t)), knots[degree], knots[len(points)] - 1e-12, layer)  # noqa: B023
            else:
                sheet.skipped[kind] = sheet.skipped.get(kind, 0) + 1
        else:
            sheet.skipped[kind] = sheet.skipped.get(kind, 0) + 1
    sheet.warnings += ["entities were left out"] * bool(sheet.skipped) + ["no unit; taken as millimetres"] * ("$INSUNITS" not in header or float(header["$INSUNITS"]) == 0) + ["heights were left out"] * raised
    return sheet
