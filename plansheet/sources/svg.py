"""SVG shapes and paths as chords, 96 pixels an inch, Y turned upwards."""

from __future__ import annotations

import math
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

from plansheet.sources.entities import Sheet, Unreadable

MM = 25.4 / 96
UNITS = {"": 1.0, "px": 1.0, "mm": 96 / 25.4, "cm": 960 / 25.4, "in": 96.0, "pt": 96 / 72, "pc": 16.0}
# Elements whose outlines a reader of contours must not guess, pixels to millimetres at 96 an inch, and the longest chord of a curve.
REFUSED = {"text", "image", "use", "clipPath", "mask", "filter", "style", "script", "foreignObject"}
CHORD = 0.5
_NUMBER = r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?"
#: Coordinates that each path command takes at a time.
TAKES = {"M": 2, "L": 2, "H": 1, "V": 1, "C": 6, "S": 4, "Q": 4, "T": 2, "A": 7, "Z": 0}
Point = complex


def length(text: str | None, default: float = 0.0) -> float:
    m = re.fullmatch(rf"\s*({_NUMBER})\s*([a-z]*)\s*", text or "")
    return float(m[1]) * UNITS.get(m[2], 1.0) if m else default


def transform(text: str | None) -> tuple[float, ...]:
    """The attribute's maps multiplied, as a, b, c, d, e, f."""
    out = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
    for name, args in re.findall(r"(\w+)\s*\(([^)]*)\)", text or ""):
        v = [float(x) for x in re.findall(_NUMBER, args)]
        if name == "matrix":
            k = tuple(v)
        elif name == "translate":
            k = (1.0, 0.0, 0.0, 1.0, v[0], v[1] if len(v) > 1 else 0.0)
        elif name == "scale":
            k = (v[0], 0.0, 0.0, v[-1], 0.0, 0.0)
        elif name == "rotate":
            c, s, x, y = math.cos(math.radians(v[0])), math.sin(math.radians(v[0])), *(v[1:3] if len(v) > 2 else (0.0, 0.0))
            k = (c, s, -s, c, x - c * x + s * y, y - s * x - c * y)
        elif name in ("skewX", "skewY"):
            t = math.tan(math.radians(v[0]))
            k = (1.0, 0.0, t, 1.0, 0.0, 0.0) if name == "skewX" else (1.0, t, 0.0, 1.0, 0.0, 0.0)
        else:
            raise Unreadable(f"transform {name}")
        out = times(out, k)
    return out


def times(m, k) -> tuple[float, ...]:
    return (m[0] * k[0] + m[2] * k[1], m[1] * k[0] + m[3] * k[1], m[0] * k[2] + m[2] * k[3], m[1] * k[2] + m[3] * k[3], m[0] * k[4] + m[2] * k[5] + m[4], m[1] * k[4] + m[3] * k[5] + m[5])


def elliptic(p: Point, rx: float, ry: float, turn: float, large: bool, clockwise: bool, q: Point):
    """An elliptic arc between two points as a function of [0, 1]."""
    rx, ry, way = abs(rx), abs(ry), complex(math.cos(math.radians(turn)), math.sin(math.radians(turn)))
    if p == q or not rx or not ry:
        return lambda t: p + (q - p) * t
    flat = lambda z: complex((z / way).real / rx, (z / way).imag / ry)
    a, b = flat(p), flat(q)
    grow = max(1.0, abs(b - a) / 2)
    a, b = a / grow, b / grow
    off = math.sqrt(max(0.0, 1 - abs(b - a) ** 2 / 4)) * (b - a) / abs(b - a) * 1j
    centre = (a + b) / 2 + (off if large != clockwise else -off)
    t0, t1 = math.atan2((a - centre).imag, (a - centre).real), math.atan2((b - centre).imag, (b - centre).real)
    sweep = (t1 - t0) % math.tau if clockwise else (t1 - t0) % math.tau - math.tau

    def at(t: float) -> Point:
        z = (centre + complex(math.cos(t0 + sweep * t), math.sin(t0 + sweep * t))) * grow
        return complex(z.real * rx, z.imag * ry) * way

    return at


def bezier(*p: Point):
    def at(t: float) -> Point:
        q = list(p)
        while len(q) > 1:
            q = [a + (b - a) * t for a, b in zip(q, q[1:])]
        return q[0]

    return at


def path(d: str) -> Iterator[tuple[bool, object]]:
    """(whether straight, function of [0, 1]) for each stroke."""
    tokens = re.findall(rf"[A-Za-z]|{_NUMBER}|[^\s,]", d)
    at = start = 0j
    held: tuple[str, Point] | None = None
    k, command = 0, ""
    while k < len(tokens):
        if tokens[k].isalpha():
            command, k = tokens[k], k + 1
        elif not command or command in "Zz":
            raise Unreadable("path data")
        up = command.upper()
        if up not in TAKES or k + TAKES[up] > len(tokens):
            raise Unreadable("path data")
        try:
            v = [float(x) for x in tokens[k : k + TAKES[up]]]
        except ValueError:
            raise Unreadable("path data") from None
        k += TAKES[up]
        base = at if command.islower() else 0j
        if up in "HV":
            points = [complex(v[0] + base.real, at.imag) if up == "H" else complex(at.real, v[0] + base.imag)]
        elif up == "A":
            points = [complex(v[5], v[6]) + base]
        else:
            points = [complex(x, y) + base for x, y in zip(v[::2], v[1::2])]
        mirrored = 2 * at - held[1] if held else at
        was, held = held, None
        if up == "M":
            at = start = points[0]
            command = "l" if command == "m" else "L"
            continue
        if up == "Z":
            yield True, bezier(at, start)
            at = start
            continue
        if up in "LHV":
            yield True, bezier(at, points[0])
        elif up == "A":
            yield False, elliptic(at, v[0], v[1], v[2], bool(v[3]), bool(v[4]), points[0])
        else:
            if up in "ST":
                points = [mirrored if was and was[0] == ("C" if up == "S" else "Q") else at, *points]
            held = ("C" if up in "CS" else "Q", points[-2])
            yield False, bezier(at, *points)
        at = points[-1]


def shape(tag: str, e: ET.Element) -> str:
    """A basic shape as path data."""
    n = lambda k, default=0.0: length(e.get(k), default)
    if tag == "path":
        return e.get("d", "")
    if tag == "rect":
        return f"M{n('x')} {n('y')}h{n('width')}v{n('height')}h{-n('width')}Z"
    if tag == "line":
        return f"M{n('x1')} {n('y1')}L{n('x2')} {n('y2')}"
    if tag in ("polyline", "polygon"):
        return "M" + " ".join(re.findall(_NUMBER, e.get("points", ""))) + ("Z" if tag == "polygon" else "")
    rx, ry = (n("r"), n("r")) if tag == "circle" else (n("rx"), n("ry"))
    return f"M{n('cx') + rx} {n('cy')}A{rx} {ry} 0 0 1 {n('cx') - rx} {n('cy')}A{rx} {ry} 0 0 1 {n('cx') + rx} {n('cy')}Z"


def read(text: str) -> Sheet:
    if "<!DOCTYPE" in text.upper() or "<!ENTITY" in text.upper():
        raise Unreadable("document type or entity")
    try:
        root = ET.fromstring(text)
    except ET.ParseError:
        raise Unreadable("not XML") from None
    name = lambda e: e.tag.rpartition("}")[2] if isinstance(e.tag, str) else ""
    if name(root) != "svg":
        raise Unreadable("not SVG")
    for e in root.iter():
        if name(e) in REFUSED or {"clip-path", "mask", "filter"} & set(e.attrib):
            raise Unreadable(f"{name(e)} or an effect")
    view = [float(x) for x in re.findall(_NUMBER, root.get("viewBox", ""))]
    m = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
    if len(view) == 4 and view[2] and view[3]:
        s = min(length(root.get("width"), view[2]) / view[2], length(root.get("height"), view[3]) / view[3])
        m = (s, 0.0, 0.0, s, -view[0] * s, -view[1] * s)
    sheet = Sheet(warnings=["96 pixels an inch; curves as chords of 0.5 mm at most"])

    def walk(e: ET.Element, m) -> None:
        m = times(m, transform(e.get("transform")))
        if name(e) in ("path", "rect", "line", "polyline", "polygon", "circle", "ellipse"):
            place = lambda z: ((m[0] * z.real + m[2] * z.imag + m[4]) * MM, -(m[1] * z.real + m[3] * z.imag + m[5]) * MM)
            for straight, curve in path(shape(name(e), e)):
                probes = [place(curve(k / 64)) for k in range(65)]
                long = sum(map(math.dist, probes, probes[1:]))
                if not math.isfinite(long) or long > 50_000:
                    raise Unreadable("stroke too long")
                n = 1 if straight else max(8, math.ceil(long / CHORD))
                points = [place(curve(k / n)) for k in range(n + 1)]
                for a, b in zip(points, points[1:]):
                    sheet.line(a, b, e.get("id") or "SVG")
        for child in e:
            if name(child) != "defs":
                walk(child, m)

    walk(root, m)
    return sheet
