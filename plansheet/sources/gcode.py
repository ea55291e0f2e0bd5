"""G-code: the XY projection of feed moves and arcs.

A program is a stream of tokens, a block of it a set of words; a word either sets a mode, by the table below, or is a
parameter of the block's step.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from plansheet.sources.entities import Sheet, Unreadable
from plansheet.sources.toolpath import Step, Turn, trace

# The codes that are understood and what they mean, parameters, and the layer of feed moves.
MODES = {
    "motion": {0: "rapid", 1: "feed", 2: "clockwise", 3: "counterclockwise", 80: "none"},
    "scale": {20: 25.4, 21: 1.0},
    "relative": {90: False, 91: True},
    "centre_from_start": {90.1: False, 91.1: True},
}
WITHOUT_EFFECT = {17, 40, 49, 54, 94}
MACHINE, LAST = {0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 30}, {2, 30}
PARAMETERS = set("XYZIJRFSTN")
LAYER = "FEED_XY"

_SETS = {code: (mode, value) for mode, codes in MODES.items() for code, value in codes.items()}
_TOKEN = re.compile(r"(?P<skip>\([^()\n]*\)|;[^\n]*|[^\S\n]+)|(?P<end>\n)|(?P<letter>[A-Z])[^\S\n]*(?P<number>[+-]?(?:\d+\.?\d*|\.\d+))|(?P<other>.)")


def blocks(text: str) -> Iterator[list[tuple[str, float]]]:
    """The words of each block that has any. A line of a percent sign alone is a tape mark."""
    block, marks = [], 0
    for token in _TOKEN.finditer("\n".join(text.upper().splitlines()) + "\n"):
        if token["letter"]:
            block.append((token["letter"], float(token["number"])))
        elif token["other"]:
            marks += 1
            if token["other"] != "%" or marks > 1:
                raise Unreadable("unknown syntax")
        elif token["end"]:
            if block and marks:
                raise Unreadable("unknown syntax")
            if block:
                yield block
            block, marks = [], 0


def understood(block: list[tuple[str, float]]) -> tuple[dict[str, object], dict[str, float], bool]:
    """Modes that a block sets, its parameters, and whether the program ends with it."""
    modes: dict[str, object] = {}
    given: dict[str, float] = {}
    ends = False
    for letter, number in block:
        if letter == "G" and number in _SETS:
            mode, value = _SETS[number]
            if mode in modes:
                raise Unreadable("two codes of a group")
            modes[mode] = value
        elif letter == "M" and number in MACHINE:
            ends |= number in LAST
        elif letter in PARAMETERS and letter not in given:
            given[letter] = number
        elif letter != "G" or number not in WITHOUT_EFFECT:
            raise Unreadable("unknown code")
    return modes, given, ends


def steps(text: str) -> Iterator[Step]:
    state: dict[str, object] = {"motion": "rapid", "scale": 1.0, "relative": False, "centre_from_start": True}
    for block in blocks(text):
        modes, given, ends = understood(block)
        state |= modes
        motion, turns = state["motion"], state["motion"] in ("clockwise", "counterclockwise")
        x, y, z, i, j, r = (given[k] * state["scale"] if k in given else None for k in "XYZIJR")
        if not turns and not i is j is r is None:
            raise Unreadable("I, J or R without an arc")
        if not x is y is z is i is j is r is None:
            if motion == "none":
                raise Unreadable("a move while motion is off")
            turn = Turn(motion == "counterclockwise", r, i, j, state["centre_from_start"]) if turns else None
            yield Step(x, y, z, state["relative"], None if motion == "rapid" else LAYER, turn)
        if ends:
            return


def read(text: str, dots: bool = False) -> Sheet:
    """dots: a feed move to where the tool is counts as a line."""
    return trace(steps(text.removeprefix("﻿")), Sheet(warnings=["XY projection of feed moves; rapid moves are left out"], dots=dots))
