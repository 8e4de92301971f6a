"""Well-known binary of points and polygons, through Arrow."""

from __future__ import annotations

import re
import struct

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_SHAPE = re.compile(r"\s*(?:SRID\s*=\s*(\d+)\s*;)?\s*(POINT|POLYGON|MULTIPOLYGON)\s*Z?\s*(\(.*\))\s*$", re.IGNORECASE | re.DOTALL)
POINT, POLYGON, MULTIPOLYGON, HAS_SRID = 1, 3, 6, 0x20000000


def _position(text: str) -> tuple[float, float]:
    x, y = text.split()[:2]
    return float(x), float(y)


def _rings(text: str) -> bytes:
    rings = [[_position(p) for p in r.split(",")] for r in re.findall(r"\(([^()]+)\)", text)]
    return struct.pack("<I", len(rings)) + b"".join(struct.pack("<I", len(r)) + b"".join(struct.pack("<dd", *p) for p in r) for r in rings)


def encode(text: str | None) -> bytes | None:
    """Little-endian binary of well-known text, with its SRID if it names one; null for other text."""
    m = _SHAPE.match(text) if text else None
    if m is None:
        return None
    kind = {"POINT": POINT, "POLYGON": POLYGON, "MULTIPOLYGON": MULTIPOLYGON}[m[2].upper()]
    head = struct.pack("<BI", 1, kind | HAS_SRID) + struct.pack("<I", int(m[1])) if m[1] else struct.pack("<BI", 1, kind)
    try:
        if kind == POINT:
            return head + struct.pack("<dd", *_position(m[3].strip("() \n\t")))
        if kind == POLYGON:
            return head + _rings(m[3])
        parts = re.findall(r"\(\s*\([^()]+\)(?:\s*,\s*\([^()]+\))*\s*\)", m[3])
        return head + struct.pack("<I", len(parts)) + b"".join(struct.pack("<BI", 1, POLYGON) + _rings(p) for p in parts)
    except ValueError:
        return None


def decode(data: bytes | None) -> str | None:
    """Well-known text of binary of either byte order, with its SRID; null for other kinds or broken data."""
    if not data:
        return None
    at = 0

    def read(form: str) -> tuple:
        nonlocal at
        out = struct.unpack_from(order + form, data, at)
        at += struct.calcsize("<" + form)
        return out

    def shape() -> tuple[int, str, str]:
        nonlocal at, order
        order = "<" if data[at] == 1 else ">"
        at += 1
        (kind,) = read("I")
        srid = f"SRID={read('I')[0]};" if kind & HAS_SRID else ""
        kind &= 0xFF
        ring = lambda: "(" + ", ".join("{!r} {!r}".format(*read("dd")) for _ in range(read("I")[0])) + ")"
        if kind == POINT:
            return kind, srid, "({!r} {!r})".format(*read("dd"))
        if kind == POLYGON:
            return kind, srid, "(" + ", ".join(ring() for _ in range(read("I")[0])) + ")"
        if kind == MULTIPOLYGON:
            return kind, srid, "(" + ", ".join(shape()[2] for _ in range(read("I")[0])) + ")"
        raise ValueError(kind)

    order = "<"
    try:
        kind, srid, body = shape()
    except (struct.error, ValueError, IndexError):
        return None
    name = {POINT: "POINT", POLYGON: "POLYGON", MULTIPOLYGON: "MULTIPOLYGON"}[kind]
    return f"{srid}{name} {body}"


def as_wkb(geom: Column) -> Column:
    """``encode`` of a column."""

    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: encode(x) if isinstance(x, str) else None)

    return F.pandas_udf(run, "binary")(geom)


def from_wkb(data: Column) -> Column:
    """``decode`` of a column."""

    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: decode(bytes(x)) if x is not None else None)

    return F.pandas_udf(run, "string")(data)
