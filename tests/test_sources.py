"""Readers and writers on program texts."""

import math

import pytest

from plansheet.sinks import writers
from plansheet.sources import drawings
from plansheet.sources.drawings import read_one


def read(extension, text):
    rows, error, _, skipped = read_one(extension, text if isinstance(text, bytes) else text.encode())
    return rows, error, skipped


def pens(rows):
    return [(*r[2:6], r[-1]) for r in rows]


def test_pen_strokes():
    program = "DF; SP3; PA 0,0; PD 80,0 80,40; PR; PD -40,0; PU 0,-40; SP; PD 400,0; SP2 PD"
    rows, error, _ = read(".plt", program.removesuffix(" PD"))
    assert error is None
    assert pens(rows) == [(0, 0, 2, 0, "PEN_3"), (2, 0, 2, 1, "PEN_3"), (2, 1, 1, 1, "PEN_3")]
    back, _, _ = read(".hpg", "pd120,0;in;pd0,120;vs10;fs;pw0.3;")
    assert pens(back) == [(0, 0, 3, 0, "PEN_1"), (0, 0, 0, 3, "PEN_1")]  # a reset goes back to the origin without a stroke
    assert len(read(".hpgl", "PD40,0\n40,40;;\n")[0]) == 2


@pytest.mark.parametrize("program", ["PD1,2,3;", "PD1,inf;", "PDx,2;", "CI40;", "PD10,0 PU;", "?;"])
def test_pen_programs_refused(program):
    assert read(".plt", program)[1]


def test_cutter_moves():
    rows, error, _ = read(".ngc", "%\n(a plate) G21\ng0 x3 y4 ; start\nG1 Y6.5 F40\nX-.5\nG91 X1 Z-2\nG20 Y1\nG80 M5\nM2\nX9")
    assert error is None
    assert [r[2:6] for r in rows] == [pytest.approx(v) for v in [(3, 4, 3, 6.5), (3, 6.5, -0.5, 6.5), (-0.5, 6.5, 0.5, 6.5), (0.5, 6.5, 0.5, 31.9)]]
    assert {r[-1] for r in rows} == {"FEED_XY"}


@pytest.mark.parametrize(
    ("move", "centre", "ccw"),
    [("G2 X8 Y8 I8 J0", (8, 0), False), ("G3 X8 Y8 I0 J8", (0, 8), True), ("G2 X8 Y8 R8", (8, 0), False), ("G3 X8 Y8 R8", (0, 8), True), ("G2 X8 Y8 R-8", (0, 8), False), ("G90.1 G3 X8 Y8 I0 J8", (0, 8), True)],
)
def test_cutter_arcs(move, centre, ccw):
    (arc,), error, _ = read(".nc", move)
    assert error is None and arc[6:9] == pytest.approx((*centre, 8)) and arc[11] is ccw
    ends = [(arc[6] + arc[8] * math.cos(t), arc[7] + arc[8] * math.sin(t)) for t in arc[9:11]]
    assert ends[0] == pytest.approx((0, 0), abs=1e-9) and ends[1] == pytest.approx((8, 8))


def test_a_whole_turn_is_two_halves():
    halves, _, _ = read(".tap", "G0 X7 Y2\nG2 I0 J3")
    assert [(r[6:9], r[11]) for r in halves] == [((7, 5, 3), False)] * 2
    assert halves[0][9] - halves[0][10] == pytest.approx(math.pi) and halves[1][10] == pytest.approx(halves[0][9])


@pytest.mark.parametrize(
    "program",
    ["G19", "G92.1", "G83 X1", "M97", "G1 X=2", "G1 X1 Q3", "G1 Y2 Y3", "G0 G1 X2", "G20 G21", "G1 X3 I2", "G80\nY4", "G2 X6 Y0 I1", "G2 X6 Y0", "G90.1 G2 X6 Y0 I3", "G2 X30 R4", "G2 X6 R3 I3", "G3 X6 I3 Z1", "G1 X1 % 2", "%%"],
)
def test_cutter_programs_refused(program):
    assert read(".cnc", program)[1]


def test_svg_shapes():
    sheet = '<svg xmlns="http://www.w3.org/2000/svg" width="60mm" height="30mm" viewBox="0 0 120 60"><g transform="scale(2)"><polygon points="1,2 9,2 9,6"/></g><rect x="100" y="40" width="10" height="4"/></svg>'
    rows, error, _ = read(".svg", sheet)
    assert error is None and len(rows) == 7
    assert rows[0][2:6] == pytest.approx((1, -2, 9, -2)) and min(r[3] for r in rows) == pytest.approx(-22) and max(r[2] for r in rows) == pytest.approx(55)
    arch, _, _ = read(".svg", '<svg><path d="M10 60C10 20 90 20 90 60"/></svg>')
    assert len(arch) > 8 and max(r[5] for r in arch) == pytest.approx(-30 * 25.4 / 96, abs=0.01)
    ring, _, _ = read(".svg", '<svg><ellipse cx="30" cy="20" rx="8" ry="4"/></svg>')
    assert all(((r[2] / 25.4 * 96 - 30) / 8) ** 2 + ((-r[3] / 25.4 * 96 - 20) / 4) ** 2 == pytest.approx(1, abs=1e-6) for r in ring)


@pytest.mark.parametrize("sheet", ['<svg><image href="a.png"/></svg>', "<svg><text>A</text></svg>", '<!DOCTYPE svg SYSTEM "x"><svg/>', '<svg><path d="M1 1 Lfoo"/></svg>', "<p/>", "<svg><line"])
def test_svg_refused(sheet):
    assert read(".svg", sheet)[1]


def dxf(*entities):
    pairs = [(0, "SECTION"), (2, "ENTITIES"), *(p for e in entities for p in e), (0, "ENDSEC"), (0, "EOF")]
    return "\n".join(f"{a}\n{b}" for a, b in pairs)


def test_dxf_polylines_with_bulges():
    light = [(0, "LWPOLYLINE"), (8, "P"), (70, 1), (10, 0), (20, 0), (10, 6), (20, 0), (42, 1), (10, 6), (20, 4)]
    rows, error, _ = read(".dxf", dxf(light))
    assert error is None and [r[0] for r in rows] == ["line", "arc", "line"] and rows[2][2:6] == (6, 4, 0, 0)
    assert rows[1][6:9] == pytest.approx((6, 2, 2)) and rows[1][11] is True  # half a turn, to the left of its chord's way
    assert rows[1][9] == pytest.approx(3 * math.pi / 2) and rows[1][10] == pytest.approx(math.pi / 2)
    vertices = [[(0, "VERTEX"), (10, x), (20, y), (42, b)] for x, y, b in ((0, 0, -0.5), (8, 0, 0), (8, 8, 0))]
    rows, error, _ = read(".dxf", dxf([(0, "POLYLINE"), (8, "Q"), (70, 0)], *vertices, [(0, "SEQEND")]))
    assert error is None and [r[0] for r in rows] == ["arc", "line"] and rows[0][11] is False and rows[0][8] == pytest.approx(5)
    mesh, error, skipped = read(".dxf", dxf([(0, "POLYLINE"), (70, 64)], *vertices, [(0, "SEQEND")], [(0, "LINE"), (11, 1), (21, 0)]))
    assert len(mesh) == 1 and skipped == {"MESH": 1}


def ends(row):
    return (row[2:4], row[4:6]) if row[0] == "line" else tuple((row[6] + row[8] * math.cos(t), row[7] + row[8] * math.sin(t)) for t in row[9:11])


def test_dxf_ellipse_and_spline():
    rows, error, _ = read(".dxf", dxf([(0, "ELLIPSE"), (10, 5), (20, 1), (11, 12), (21, 0), (40, 0.5), (41, 0), (42, math.tau)]))
    assert error is None and len(rows) >= 4
    for row in rows:
        for x, y in ends(row):
            assert ((x - 5) / 12) ** 2 + ((y - 1) / 6) ** 2 == pytest.approx(1, abs=1e-3)
    assert math.dist(ends(rows[0])[0], ends(rows[-1])[1]) < 1e-6
    control, knots = [(0, 0), (2, 6), (8, 6), (10, 0)], [0, 0, 0, 0, 1, 1, 1, 1]
    rows, error, _ = read(".dxf", dxf([(0, "SPLINE"), (71, 3), *((40, k) for k in knots), *(p for x, y in control for p in ((10, x), (20, y)))]))
    assert error is None and ends(rows[0])[0] == pytest.approx((0, 0), abs=1e-6) and ends(rows[-1])[1] == pytest.approx((10, 0), abs=1e-3)
    assert max(y for r in rows for _, y in ends(r)) == pytest.approx(4.5, abs=0.3)  # the curve's top
    _, _, skipped = read(".dxf", dxf([(0, "SPLINE"), (71, 3), (40, 0), (10, 0), (20, 0)], [(0, "LINE"), (11, 1), (21, 0)]))
    assert skipped == {"SPLINE": 1}


def test_dxf_entities_off_the_plane_are_left_out():
    tilted = [(0, "CIRCLE"), (10, 0), (20, 0), (40, 3), (210, 1), (220, 0), (230, 0)]
    flat = [(0, "ARC"), (10, 1), (20, 1), (40, 2), (50, 0), (51, 90), (230, 1)]
    rows, error, skipped = read(".dxf", dxf(tilted, flat))
    assert error is None and [r[0] for r in rows] == ["arc"] and skipped == {"CIRCLE off the XY plane": 1}


def test_dxf_blocks():
    """A bar in a frame in a row of two, scaled, turned by 30 degrees and with a base point off the origin; a hatch and a point are counted."""
    bar = [(0, "BLOCK"), (2, "BAR"), (10, 1), (20, 2), (0, "LINE"), (8, "0"), (10, 1), (20, 2), (11, 1), (21, 6), (0, "ENDBLK")]
    frame = [(0, "BLOCK"), (2, "FRAME"), (10, 0), (20, 0), (0, "INSERT"), (2, "BAR"), (8, "0"), (10, 0), (20, -3), (41, 2), (42, 2), (0, "ENDBLK")]
    drawn = [(0, "INSERT"), (2, "FRAME"), (8, "CUT"), (10, 100), (20, -40), (50, 30), (0, "HATCH"), (8, "0"), (0, "POINT"), (10, 1), (20, 1)]
    pairs = [(0, "SECTION"), (2, "BLOCKS"), *bar, *frame, (0, "ENDSEC"), (0, "SECTION"), (2, "ENTITIES"), *drawn, (0, "ENDSEC"), (0, "EOF")]
    rows, error, skipped = read(".dxf", "\n".join(f"{a}\n{b}" for a, b in pairs))
    assert error is None and skipped == {"HATCH": 1, "POINT": 1} and rows[0][-1] == "CUT" and len(rows) == 1
    at = lambda x, y: (100 + x * math.cos(math.pi / 6) - y * math.sin(math.pi / 6), -40 + x * math.sin(math.pi / 6) + y * math.cos(math.pi / 6))
    assert rows[0][2:6] == pytest.approx((*at(0, -3), *at(0, 5)))


@pytest.mark.parametrize("content, error", [(b"AC1018" + bytes(40), "converter unavailable"), (b"AC1027", "converter unavailable"), (b"PK\x03\x04", "bad signature"), (b"", "bad signature")])
def test_dwg_needs_a_converter(content, error):
    assert read(".dwg", content)[1] == error


def test_unknown_extension():
    assert read(".stp", b"ISO-10303-21;")[1]


def test_dxf_round_trip(spark):
    seg = spark.createDataFrame([(1, 0, 0.0, 0.0, 10.0, 5.0, "L")], "drawing_id bigint, seg_id bigint, x1 double, y1 double, x2 double, y2 double, layer string")
    arc = spark.createDataFrame([(1, 0, 5.0, 5.0, 2.0, 1.0, 0.5, False, None)], "drawing_id bigint, arc_id bigint, cx double, cy double, r double, a0 double, a1 double, is_ccw boolean, layer string")
    circle = spark.createDataFrame([(2, 0, 1.0, 2.0, 3.0, "C")], "drawing_id bigint, circle_id bigint, cx double, cy double, r double, layer string")
    for version in ("R12", "R2018", "other"):
        files = writers.dxf_text(seg, arc, circle, version)
        back = drawings.parse(files.selectExpr("drawing_id", "'.dxf' as extension", "text as content"))
        assert [tuple(r)[2:] for r in drawings.entities(back, "line").collect()] == [(0.0, 0.0, 10.0, 5.0, "L")]
        a = drawings.entities(back, "arc").first()
        assert (a["cx"], a["r"], round(a["a0"], 9), round(a["a1"], 9), a["is_ccw"]) == (5.0, 2.0, 0.5, 1.0, True)
        assert drawings.entities(back, "circle").first()["drawing_id"] == 2


def test_files_are_read_by_extension(spark, tmp_path):
    (tmp_path / "a.nc").write_text("G1 X10")
    (tmp_path / "b.PLT").write_text("PD40,0;")
    (tmp_path / "c.svg").write_text("<svg/>")
    out = {r["drawing_id"].rsplit("/", 1)[1]: (r["kind"], r["error"]) for r in drawings.read(spark, f"file://{tmp_path}").collect()}
    assert out == {"a.nc": ("line", None), "b.PLT": ("line", None), "c.svg": (None, "no 2D geometry")}
