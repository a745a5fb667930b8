"""Buffers and boundaries as geometry: a buffer is the union of a piece for each segment, bend and end."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import SHAPE
from .overlay import union_rings

RINGS = SHAPE.split("parts: array<")[1][:-2]


def _point(x: Column, y: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"))


def _shifted(p: Column, d: Column, along: Column | float, across: Column | float) -> Column:
    """A point moved along a direction and to the left of it."""
    return _point(p["x"] + d["x"] * along - d["y"] * across, p["y"] + d["y"] * along + d["x"] * across)


def _disc(p: Column, d: Column, reach: float, quarter: int) -> Column:
    """A regular polygon on the circle, with vertices straight ahead and to both sides of a direction."""
    turns = [2 * math.pi * k / (4 * quarter) for k in range(4 * quarter)]
    return F.array(*[_shifted(p, d, reach * math.cos(a), reach * math.sin(a)) for a in turns])


def buffer_pieces(lines: DataFrame, keys: list[str], reach: float, line: str = "line", cap: str = "round", join: str = "round", quarter: int = 8, mitre_limit: float = 5.0, closed: bool = False) -> DataFrame:
    """Polygons whose union is the buffer of each line: ``keys`` and ``rings``, one row for each segment, bend and end.

    ``cap`` is ``round``, ``flat`` or ``square``; ``join`` is ``round``, ``mitre`` or ``bevel``, where a mitre longer than ``mitre_limit`` times the reach is
    bevelled. Circles are polygons of 4 * ``quarter`` corners. Vertices that repeat the one before are left out; with ``closed`` the line is a ring
    and has bends alone. A line of one place is a disc, or a square, or nothing with flat caps.
    """
    if cap not in ("round", "flat", "square") or join not in ("round", "mitre", "bevel"):
        raise ValueError("cap is round, flat or square; join is round, mitre or bevel")
    v = F.col(line)
    v = F.when(F.lit(closed), F.concat(v, F.slice(v, 1, 1))).otherwise(v) if closed else v
    own = lines.where(F.size(line) > 0).select(*keys, v.alias("__v"))
    own = own.withColumn("__v", F.filter("__v", lambda p, k: (k == 0) | (p != F.get("__v", k - 1))))
    n = F.size("__v")
    at = lambda k: F.get("__v", k)

    def direction(a: Column, b: Column) -> Column:
        far = F.hypot(b["x"] - a["x"], b["y"] - a["y"])
        return _point((b["x"] - a["x"]) / far, (b["y"] - a["y"]) / far)

    segments = own.where(n > 1).withColumn("__d", F.transform(F.sequence(F.lit(1), n - 1), lambda k: direction(at(k - 1), at(k))))
    s = segments.select(*keys, F.size("__d").alias("__n"), F.posexplode(F.arrays_zip(F.col("__v").alias("a"), F.slice("__v", 2, 1 << 30).alias("b"), F.col("__d").alias("d"))).alias("__k", "__s")).where("__s.d is not null")
    a, b, d = (F.col(f"__s.{c}") for c in "abd")
    square = cap == "square" and not closed
    before, after = (F.when(F.col("__k") == 0, reach).otherwise(0.0), F.when(F.col("__k") == F.col("__n") - 1, reach).otherwise(0.0)) if square else (F.lit(0.0), F.lit(0.0))
    pieces = [s.select(*keys, F.array(_shifted(a, d, -before, -reach), _shifted(b, d, after, -reach), _shifted(b, d, after, reach), _shifted(a, d, -before, reach)).alias("ring"))]
    m = F.size("__d")
    last = m if closed else m - 1
    bends = segments.where(last > 0).select(*keys, F.explode(F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda k: F.struct(at(k % m).alias("p") if closed else at(k).alias("p"), F.get("__d", k - 1).alias("d"), F.get("__d", k % m).alias("e")))).alias("__s"))
    p, d, e = (F.col(f"__s.{c}") for c in "pde")
    if join == "round":
        pieces.append(bends.select(*keys, _disc(p, d, reach, quarter).alias("ring")))
    else:
        turn, cosine = d["x"] * e["y"] - d["y"] * e["x"], d["x"] * e["x"] + d["y"] * e["y"]
        side = F.when(turn > 0, -reach).otherwise(reach)  # the outer side of the bend
        one, two = _shifted(p, d, 0.0, side), _shifted(p, e, 0.0, side)
        share = side / (1 + cosine)
        tip = _point(p["x"] - (d["y"] + e["y"]) * share, p["y"] + (d["x"] + e["x"]) * share)
        mitred = F.lit(join == "mitre") & (2 / (1 + cosine) <= mitre_limit**2)
        pieces.append(bends.where(turn != 0).select(*keys, F.when(mitred, F.array(p, one, tip, two)).otherwise(F.array(p, one, two)).alias("ring")))
    if cap == "round" and not closed:
        ends = segments.select(*keys, F.explode(F.array(F.struct(at(F.lit(0)).alias("p"), F.get("__d", F.lit(0)).alias("d")), F.struct(at(n - 1).alias("p"), F.get("__d", m - 1).alias("d")))).alias("__s"))
        pieces.append(ends.select(*keys, _disc(F.col("__s.p"), F.col("__s.d"), reach, quarter).alias("ring")))
    if cap != "flat" or closed:
        alone, east = own.where(n == 1), _point(F.lit(1.0), F.lit(0.0))
        corner = [_shifted(at(F.lit(0)), east, x * reach, y * reach) for x, y in ((-1, -1), (1, -1), (1, 1), (-1, 1))]
        pieces.append(alone.select(*keys, (F.array(*corner) if cap == "square" else _disc(at(F.lit(0)), east, reach, quarter)).alias("ring")))
    out = pieces[0]
    for more in pieces[1:]:
        out = out.unionByName(more)
    return out.select(*keys, F.array("ring").alias("rings"))


def polygon_pieces(polygons: DataFrame, keys: list[str], reach: float, **how) -> DataFrame:
    """Polygons (``rings``) and the pieces around their rings: the union is the buffer."""
    own = polygons.select(*keys, "rings")
    edges = own.select(*keys, F.explode("rings").alias("line"))
    return own.unionByName(buffer_pieces(edges, keys, reach, closed=True, **how))


def buffer(lines: DataFrame, keys: list[str], reach: float, size: float | None = None, **how) -> DataFrame:
    """Rings of the buffer of each group's lines (``line``): ``keys``, ``ring``, ``hole``, ``area``; ``how`` as in ``buffer_pieces``. Squares for the union have a
    side of ``size``, or eight times the reach."""
    return union_rings(buffer_pieces(lines, keys, reach, **how), keys, size or 8 * reach)


def boundary_lines(polygons: DataFrame, keys: list[str]) -> DataFrame:
    """Each ring of each polygon (``rings``) as a closed line: ``keys``, ``line``, ``hole``. Rings without three vertices give none."""
    rings = polygons.select(*keys, F.posexplode("rings").alias("__k", "line")).where(F.size("line") > 2)
    first = F.get("line", F.lit(0))
    return rings.select(*keys, F.when(F.element_at("line", -1) == first, F.col("line")).otherwise(F.concat("line", F.array(first))).alias("line"), (F.col("__k") > 0).alias("hole"))
