"""Cells of a row that belong together: what extraction has split, and what stands in several lines of one column.

A cell is a struct with top, left, right, height, text, style (any string) and space (the width of a space). Whether a
cell joins depends on what has been joined before, so each row is one loop, in an Arrow pass over rows.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .stacks import over
from .words import judged

# Signs of currencies; a column's gap in spaces, how many of them still join, and what a justified text adds.
CURRENCIES = ("$", "€", "£")
COLUMN_GAP, JOINING = 2.8, 1.5
FIELDS = ("top", "left", "right", "height", "text", "style", "space")
TYPE = pa.list_(pa.struct([(f, pa.string() if f in ("text", "style") else pa.float64()) for f in FIELDS]))
SQL = "array<struct<top:double,left:double,right:double,height:double,text:string,style:string,space:double>>"
CLOSING, OPENING = ")]},.;:!?%”’", "([{“‘"


def glued(a: str, b: str) -> str:
    """Two texts with a space between, but for brackets and marks."""
    return a + ("" if not a or a[-1] in OPENING or b[:1] in CLOSING else " ") + b


def joined(a: dict, b: dict, text: str | None = None) -> dict:
    """Two cells as one: the first one's place, the second one's right, as high as both together."""
    top, bottom = min(a["top"], b["top"]), max(a["top"] + a["height"], b["top"] + b["height"])
    height = max(a["height"], b["height"]) if a["top"] == b["top"] else bottom - top
    return a | {"right": b["right"], "height": height, "text": glued(a["text"], b["text"]) if text is None else text, "style": a["style"] if len(a["text"]) > 1 else b["style"]}


def _is_number(text: str) -> bool:
    words = text.split()
    return len(words) == 1 and bool(judged(words[0], True).number)


def _touch(a: dict, b: dict, is_row: bool) -> bool:
    """Whether b goes on a by its place: near enough, in a's line, and no sign that opens another cell."""
    limit = COLUMN_GAP * max(a["space"], b["space"]) * (1 if is_row and " " in a["text"].strip() else JOINING)
    in_line = abs(b["top"] - a["top"]) < 2 or abs(b["top"] + b["height"] - a["top"] - a["height"]) < 2 or b["top"] < a["top"] + a["height"]
    marks = a["text"].strip()[-1:] in (*CURRENCIES, "%") and b["text"].strip()[:1] in (*CURRENCIES, "%")
    lone_percent = is_row and len(b["text"].strip()) > 1 and b["text"].strip()[0] == "%"
    return b["left"] - a["right"] < limit and in_line and b["text"].strip() not in CURRENCIES and not marks and not lone_percent


def merged(cells: list[dict], is_row: bool = True) -> list[dict]:
    """A row's cells without splits: a currency sign joins the amount behind it, wherever it was; near cells of one style join, two numbers don't."""
    out: list[dict] = []
    for cell in cells:
        if not cell["text"].strip():
            continue
        if not out:
            out.append(cell)
            continue
        before = out[-1]["text"].strip()
        if len(before) > 1 and before[-1] in CURRENCIES and not before[-2].isspace():
            cell, out[-1] = cell | {"text": before[-1] + cell["text"]}, out[-1] | {"text": before[:-1]}
        if before in CURRENCIES and cell["text"].strip()[0] not in (*CURRENCIES, "%"):
            out[-1] = joined(out[-1], cell, before + cell["text"].strip())
            continue
        restyled = cell["style"] != out[-1]["style"] and len(cell["text"]) > 1 and len(out[-1]["text"]) > 1
        if not restyled and not (_is_number(cell["text"]) and _is_number(out[-1]["text"])) and _touch(out[-1], cell, is_row):
            out[-1] = joined(out[-1], cell)
        else:
            out.append(cell)
    return out


def stacked(cells: list[dict]) -> list[dict]:
    """A row's cells, those in several lines of one column joined: lower, and up to 20 points to the right of the first line; so is a small cell close behind."""
    if all(abs(b["top"] - a["top"]) <= 5 for a, b in zip(cells, cells[1:])):
        cells = sorted(cells, key=lambda c: c["left"])
    out: list[dict] = []
    first: dict = {}  # of the lines of the cell that is open
    for cell in cells:
        if out:
            below = cell["top"] - first["top"] > 5 and 0 < cell["left"] - first["left"] < 20
            small = 0 < cell["left"] - out[-1]["right"] < 1.5 * out[-1]["space"] and cell["height"] <= 0.75 * out[-1]["height"]
            if below or small:
                out[-1] = joined(out[-1], cell)
                continue
        out.append(cell)
        first = cell
    return out


def merged_cells(cells: Column) -> Column:
    return over(cells, merged, TYPE, SQL)


def stacked_cells(cells: Column) -> Column:
    return over(cells, stacked, TYPE, SQL)


def row_into(row: Column, target: Column, above: bool) -> Column:
    """The cells of a row with those of a one-cell row put in: behind the target's (above: the target is the row above), or before.

    Only the first cell goes, or the last one of a row as long; null if neither is the one with text.
    """
    place = F.array_max(F.transform(row, lambda c, i: F.when(F.coalesce(c, F.lit("")) != "", i)))
    fits = (place == 0) | ((place == F.size(row) - 1) & (F.size(target) == F.size(row)))
    own = F.get(row, place)
    both = lambda c: F.concat_ws(" ", c, own) if above else F.concat_ws(" ", own, c)
    return F.when(fits, F.transform(target, lambda c, i: F.when(i == place, both(c)).otherwise(c)))
