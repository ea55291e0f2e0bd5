"""HPGL: strokes of a pen plotter."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

from plansheet.sources.entities import Sheet, Unreadable
from plansheet.sources.toolpath import Step, trace

# A unit in mm, and the instructions that are understood with the modes they set.
UNIT = 0.025
RESET = {"relative": False, "down": False, "pen": 1}
INSTRUCTIONS: dict[str, dict[str, object]] = {
    "IN": RESET, "DF": RESET, "PA": {"relative": False}, "PR": {"relative": True}, "PU": {"down": False}, "PD": {"down": True},
    "SP": {"pen": 0}, "VS": {}, "FS": {}, "PW": {},
}
WITH_PLACES = ("PA", "PR", "PU", "PD")

_INSTRUCTION = re.compile(r"\s*(?P<name>[A-Z]{2})(?P<rest>[^;]*)(?:;|\Z)|\s*;|\s+\Z|(?P<other>.)", re.DOTALL)


def figures(text: str) -> list[float]:
    out = []
    for word in text.replace(",", " ").split():
        try:
            out.append(float(word))
        except ValueError:
            raise Unreadable("number") from None
    if not all(math.isfinite(v) for v in out):
        raise Unreadable("number")
    return out


def steps(text: str) -> Iterator[Step]:
    state = dict(RESET)
    for found in _INSTRUCTION.finditer(text.upper()):
        name = found["name"]
        if found["other"] or name and name not in INSTRUCTIONS:
            raise Unreadable(f"instruction {name or found['other']}")
        if not name:
            continue
        values = figures(found["rest"])
        state |= INSTRUCTIONS[name]
        if name == "SP" and values:
            state["pen"] = int(values[0])
        elif name == "IN":
            yield Step(0.0, 0.0)
        elif name in WITH_PLACES:
            if len(values) % 2:
                raise Unreadable("odd number of coordinates")
            layer = f"PEN_{state['pen']}" if state["down"] and state["pen"] else None
            for k in range(0, len(values), 2):
                yield Step(values[k] * UNIT, values[k + 1] * UNIT, relative=state["relative"], layer=layer)


def read(text: str) -> Sheet:
    return trace(steps(text.removeprefix("﻿")), Sheet(warnings=["0.025 mm a unit; strokes with the pen down"]))
