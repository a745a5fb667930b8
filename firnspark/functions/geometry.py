"""One type for shapes of one or many parts, and their text form.

A shape is a struct of ``kind`` (point, line, polygon) and ``parts``: of each part the rings, of each ring the vertices (x, y). A line has one ring
a part and a point one vertex in it; a polygon's first ring is the outer one and the others are holes.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

VERTICES = "array<struct<x: double, y: double>>"
SHAPE = f"struct<kind: string, parts: array<array<{VERTICES}>>>"
#: Kinds by their names in texts, and how many brackets stand around a vertex.
KINDS = {"POINT": ("point", 1), "MULTIPOINT": ("point", 2), "LINESTRING": ("line", 2), "MULTILINESTRING": ("line", 3), "POLYGON": ("polygon", 3), "MULTIPOLYGON": ("polygon", 4)}


def _vertices(pairs: Column) -> Column:
    """Pairs of numbers as text, or of numbers, as vertices."""
    return F.transform(pairs, lambda v: F.struct(v[0].cast("double").alias("x"), v[1].cast("double").alias("y")))


def parts_of(name: Column, text: Column, element: str = "string") -> Column:
    """``parts`` from nested arrays as JSON text, as deep as the kind called ``name`` has them; null for others."""
    nested = lambda depth: F.from_json(text, "array<" * depth + element + ">" * depth)
    rings = lambda a: F.transform(a, _vertices)
    each = lambda a: F.transform(a, lambda line: F.array(_vertices(line)))
    alone = lambda a: F.transform(a, lambda v: F.array(F.array(F.struct(v[0].cast("double").alias("x"), v[1].cast("double").alias("y")))))
    return (
        F.when(name == "POINT", alone(F.array(nested(1)))).when(name == "MULTIPOINT", alone(nested(2))).when(name == "LINESTRING", F.array(F.array(_vertices(nested(2)))))
        .when(name == "MULTILINESTRING", each(nested(3))).when(name == "POLYGON", F.array(rings(nested(3)))).when(name == "MULTIPOLYGON", F.transform(nested(4), rings))
    )


def kind_of(name: Column) -> Column:
    out = F.lit(None).cast("string")
    for k, (kind, _) in KINDS.items():
        out = F.when(name == k, kind).otherwise(out)
    return out


def parse_shape(c: str) -> Column:
    """Shape of a text such as ``MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)), ...)``, with all its parts and rings; further coordinates of a vertex are left out.

    ``EMPTY`` has no parts. A kind that isn't one of ``KINDS``, a collection among them, and text that can't be read are null.
    """
    text = F.trim(F.regexp_replace(F.col(c) if isinstance(c, str) else c, r"(?i)^\s*srid=\d+;", ""))
    name = F.upper(F.regexp_extract(text, r"^([A-Za-z]+)", 1))
    body = F.translate(F.regexp_extract(text, r"(?s)(\(.*\))", 1), "()", "[]")
    number = r"([-+.0-9eE]+)"
    body = F.regexp_replace(body, rf"{number}\s+{number}(?:\s+[-+.0-9eE]+)*", '["$1","$2"]')
    # a point has a bracket too many, and in a multipoint each vertex may stand in brackets of its own
    body = F.when(name == "POINT", F.regexp_extract(body, r"\[\s*(\[.*\])\s*\]", 1)).when(name == "MULTIPOINT", F.regexp_replace(body, r"\[\s*(\[[^\[\]]*\])\s*\](?=\s*[,\]])", "$1")).otherwise(body)
    parts = F.when(F.rlike(text, F.lit(r"(?i)\bempty$")), F.array().cast(SHAPE.split("parts: ")[1][:-1])).otherwise(parts_of(name, body))
    return F.when(kind_of(name).isNotNull() & parts.isNotNull(), F.struct(kind_of(name).alias("kind"), parts.alias("parts")))


def shape_text(shape: str) -> Column:
    """Text of a shape; of one part without ``MULTI``."""
    kind, parts = F.col(f"{shape}.kind"), F.col(f"{shape}.parts")
    vertex = lambda v: F.concat_ws(" ", v["x"].cast("string"), v["y"].cast("string"))
    ring = lambda r: F.concat(F.lit("("), F.concat_ws(", ", F.transform(r, vertex)), F.lit(")"))
    polygon = lambda p: F.concat(F.lit("("), F.concat_ws(", ", F.transform(p, ring)), F.lit(")"))
    one = lambda p: F.when(kind == "polygon", polygon(p)).otherwise(ring(p[0]))
    name = F.when(kind == "line", "LINESTRING").otherwise(F.upper(kind))
    many = F.concat(F.lit("MULTI"), name, F.lit(" ("), F.concat_ws(", ", F.transform(parts, one)), F.lit(")"))
    return F.when(F.size(parts) == 0, F.concat(name, F.lit(" EMPTY"))).when(F.size(parts) == 1, F.concat(name, F.lit(" "), one(F.get(parts, F.lit(0))))).otherwise(many)


def ring_area(ring: Column) -> Column:
    """Area within a ring, positive whichever way it runs."""
    n, first = F.size(ring), F.get(ring, F.lit(0))
    at = lambda k: F.get(ring, k)
    cross = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda k: (at(k - 1)["x"] - first["x"]) * (at(k)["y"] - first["y"]) - (at(k)["x"] - first["x"]) * (at(k - 1)["y"] - first["y"]))
    return F.when(n > 2, F.abs(F.aggregate(cross, F.lit(0.0), lambda s, v: s + v)) / 2).otherwise(F.lit(0.0))


def shape_area(shape: str) -> Column:
    """Area of all parts less that of their holes; 0 for points and lines."""
    areas = F.transform(F.col(f"{shape}.parts"), lambda p: F.aggregate(F.transform(p, lambda r, k: F.when(k == 0, ring_area(r)).otherwise(-ring_area(r))), F.lit(0.0), lambda s, v: s + v))
    return F.when(F.col(f"{shape}.kind") == "polygon", F.aggregate(areas, F.lit(0.0), lambda s, v: s + v)).when(F.col(shape).isNotNull(), F.lit(0.0))
