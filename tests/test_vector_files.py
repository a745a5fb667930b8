"""Shapes of many parts through texts, GeoJSON and shape files: nothing is lost on the way."""

from __future__ import annotations

import json
import struct

import pytest
from pyspark.sql import functions as F

from firnspark.functions import geometry
from firnspark.operators import overlay
from firnspark.sources import shapefiles, sinks, tables

SQUARE, HOLE, FAR = [(0.0, 0.0), (0.0, 4.0), (4.0, 4.0), (4.0, 0.0), (0.0, 0.0)], [(1.0, 1.0), (2.0, 1.0), (2.0, 2.0), (1.0, 2.0), (1.0, 1.0)], [(9.0, 9.0), (9.0, 10.0), (10.0, 9.0), (9.0, 9.0)]


def plain(shape):
    return shape and (shape.kind, [[[(v.x, v.y) for v in ring] for ring in p] for p in shape.parts])


TEXTS = {
    "POINT (1 2)": ("point", [[[(1.0, 2.0)]]]),
    "point z(1 -2.5e1 7)": ("point", [[[(1.0, -25.0)]]]),
    "MULTIPOINT ((1 2), (3 4))": ("point", [[[(1.0, 2.0)]], [[(3.0, 4.0)]]]),
    "MULTIPOINT (1 2, 3 4)": ("point", [[[(1.0, 2.0)]], [[(3.0, 4.0)]]]),
    "SRID=4326;LINESTRING(0 0,  .5 +4)": ("line", [[[(0.0, 0.0), (0.5, 4.0)]]]),
    "MULTILINESTRING ((0 0, 1 1), (2 2, 3 3, 4 4))": ("line", [[[(0.0, 0.0), (1.0, 1.0)]], [[(2.0, 2.0), (3.0, 3.0), (4.0, 4.0)]]]),
    "POLYGON ((0 0, 0 4, 4 4, 4 0, 0 0), (1 1, 2 1, 2 2, 1 2, 1 1))": ("polygon", [[SQUARE, HOLE]]),
    "MULTIPOLYGON (((0 0, 0 4, 4 4, 4 0, 0 0), (1 1, 2 1, 2 2, 1 2, 1 1)), ((9 9, 9 10, 10 9, 9 9)))": ("polygon", [[SQUARE, HOLE], [FAR]]),
    "POLYGON EMPTY": ("polygon", []),
    "GEOMETRYCOLLECTION (POINT (1 2))": None, "nothing": None, "": None,
}


def test_texts(spark):
    df = spark.createDataFrame([(t,) for t in [*TEXTS, None]], "t string").withColumn("s", geometry.parse_shape("t"))
    got = {r.t: r for r in df.select("t", "s", geometry.shape_text("s").alias("again"), geometry.shape_area("s").alias("area"), tables.parse_wkt("t").alias("line")).collect()}
    assert {t: plain(r.s) for t, r in got.items()} == TEXTS | {None: None}
    back = spark.createDataFrame([(r.t, r.again) for r in got.values() if r.s], "t string, again string").withColumn("s", geometry.parse_shape("again"))
    assert {r.t: plain(r.s) for r in back.collect()} == {t: s for t, s in TEXTS.items() if s}
    areas = {t: r.area for t, r in got.items() if r.s and r.s.kind == "polygon"}
    assert list(areas.values()) == [15.0, 15.5, 0.0] and got["POINT (1 2)"].area == 0.0 and got["nothing"].area is None
    assert got["MULTILINESTRING ((0 0, 1 1), (2 2, 3 3, 4 4))"].line is None and len(got["SRID=4326;LINESTRING(0 0,  .5 +4)"].line) == 2


def test_geojson_of_all_kinds(spark, tmp_path):
    kinds = [("Point", [1, 2]), ("MultiPoint", [[1, 2], [3, 4]]), ("LineString", [[0, 0], [0.5, 4]]), ("MultiLineString", [[[0, 0], [1, 1]], [[2, 2], [3, 3], [4, 4]]]), ("Polygon", [SQUARE, HOLE]), ("MultiPolygon", [[SQUARE, HOLE], [FAR]])]
    features = [{"type": "Feature", "geometry": {"type": k, "coordinates": c}, "properties": {"n": j}} for j, (k, c) in enumerate(kinds)] + [{"type": "Feature", "geometry": {"type": "GeometryCollection", "geometries": []}, "properties": {"n": 6}}]
    (tmp_path / "a.json").write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    (tmp_path / "b.jsonl").write_text("".join(f"\x1e{json.dumps(f)}\n" for f in features) + "\n")
    want = [TEXTS[t] for t in ("POINT (1 2)", "MULTIPOINT (1 2, 3 4)", "SRID=4326;LINESTRING(0 0,  .5 +4)", "MULTILINESTRING ((0 0, 1 1), (2 2, 3 3, 4 4))")] + [("polygon", [[SQUARE, HOLE]]), ("polygon", [[SQUARE, HOLE], [FAR]]), None]
    for rows in (tables.read_geojson(spark, f"{tmp_path}/a.json"), tables.read_geojson(spark, f"{tmp_path}/b.jsonl", lines=True)):
        got = {int(r.properties["n"]): r for r in rows.collect()}
        assert [plain(got[k].shape) for k in range(7)] == want
        assert [got[k].line is not None for k in range(7)] == [True, False, True, False, True, False, False]
    lines = spark.createDataFrame([([(0.0, 1.0), (2.0, 3.5)], "a")], "line array<struct<x: double, y: double>>, where string")
    sinks.write_geojson(lines, f"{tmp_path}/c")
    row = tables.read_geojson(spark, f"{tmp_path}/c", lines=True).first()
    assert [(v.x, v.y) for v in row.line] == [(0.0, 1.0), (2.0, 3.5)] and row.properties["where"] == "a"


def record(kind, parts):
    points = [v for p in parts for v in p]
    if kind % 10 == 1:
        return struct.pack("<i2d", kind, *points[0]) + b"\0" * 16 * (kind > 10)
    box = struct.pack("<4d", 0, 0, 0, 0)
    body = b"".join(struct.pack("<2d", *v) for v in points) + b"\0" * (16 + 8 * len(points)) * (kind > 10)
    if kind % 10 == 8:
        return struct.pack("<i", kind) + box + struct.pack("<i", len(points)) + body
    at, first = 0, []
    for p in parts:
        first.append(at)
        at += len(p)
    return struct.pack("<i", kind) + box + struct.pack("<ii", len(parts), at) + struct.pack(f"<{len(parts)}i", *first) + body


def write_shapefile(stem, records, rows=None):
    shp, shx = b"", b""
    for k, r in enumerate(records):
        shx += struct.pack(">ii", (100 + len(shp)) // 2, len(r) // 2)
        shp += struct.pack(">ii", k + 1, len(r) // 2) + r
    for ext, body in (("shp", shp), ("shx", shx)):
        with open(f"{stem}.{ext}", "wb") as f:
            f.write(struct.pack(">i20xi", 9994, (100 + len(body)) // 2) + struct.pack("<ii", 1000, 5) + b"\0" * 64 + body)
    if rows:
        fields = [("name", 12), ("size", 6)]
        head = struct.pack("<B3BIHH20x", 3, 120, 1, 1, len(rows), 32 + 32 * len(fields) + 1, 1 + sum(w for _, w in fields))
        head += b"".join(struct.pack("<11sc4xBB14x", n.encode(), b"C", w, 0) for n, w in fields) + b"\r"
        with open(f"{stem}.dbf", "wb") as f:
            f.write(head + b"".join(b" " + b"".join(str(v).encode().ljust(w)[:w] for v, (_, w) in zip(r, fields, strict=True)) for r in rows) + b"\x1a")


def test_shape_files(spark, tmp_path):
    inner = [(1.2, 1.2), (1.2, 1.8), (1.8, 1.8), (1.8, 1.2), (1.2, 1.2)]  # an island in the hole, clockwise as outer rings are
    records = [
        record(5, [HOLE, SQUARE, FAR, inner]), record(15, [FAR]), struct.pack("<i", 0), record(3, [[(0.0, 0.0), (1.0, 1.0)], [(2.0, 2.0), (3.0, 3.0), (4.0, 4.0)]]),
        record(1, [[(1.0, 2.0)]]), record(11, [[(1.0, 2.0)]]), record(8, [[(1.0, 2.0), (3.0, 4.0)]]), record(5, [HOLE]), record(23, [[(0.0, 0.0), (0.5, 4.0)]]),
    ]
    write_shapefile(tmp_path / "a", records, [(f"né {k}", k if k else "") for k in range(len(records))])
    write_shapefile(tmp_path / "b", records[:2])
    rows = shapefiles.read_shapefile(spark, f"file://{tmp_path}", records_per_task=4)
    assert rows.rdd.getNumPartitions() == 4
    got = {(r.file.rsplit("/", 1)[-1], r.record): r for r in rows.collect()}
    want = [("polygon", [[SQUARE, HOLE], [FAR], [inner]]), ("polygon", [[FAR]]), None, TEXTS["MULTILINESTRING ((0 0, 1 1), (2 2, 3 3, 4 4))"], TEXTS["POINT (1 2)"], TEXTS["POINT (1 2)"], TEXTS["MULTIPOINT (1 2, 3 4)"], ("polygon", [[HOLE]]), ("line", [[[(0.0, 0.0), (0.5, 4.0)]]])]
    assert [plain(got["a.shp", k].shape) for k in range(9)] == want
    assert got["a.shp", 3].properties == {"name": "né 3", "size": "3"} and got["a.shp", 0].properties["size"] is None and got["b.shp", 1].properties is None
    area = rows.where("shape.kind = 'polygon' and file like '%a.shp' and record = 0").select(F.lit(1).alias("g"), F.explode("shape.parts").alias("rings"))
    assert overlay.union_measures(area, ["g"], 3.0).first().area == pytest.approx(15 + 0.5 + 0.36)
    with pytest.raises(Exception, match="none.shp"):
        shapefiles.read_shapefile(spark, f"{tmp_path}/none.shp").count()
    write_shapefile(tmp_path / "c", [struct.pack("<i", 31) + b"\0" * 40])
    with pytest.raises(Exception, match="31"):
        shapefiles.read_shapefile(spark, f"{tmp_path}/c.shp").count()
