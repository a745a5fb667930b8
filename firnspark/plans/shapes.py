"""Lines, polygons and boxes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry
from ..operators import buffers, grid, nearest, overlay, shapes
from ..sources.tables import read_table
from .joins import _POINTS, _points
from .rasters import _GRID, _LINE, _cells
from .registry import query

#: A line of three vertices from the first six components, and for each label a triangle of the next six of its first row.
_SHAPES = """
    l AS (SELECT vec_id, s, embedding[2 * s - 1]::DOUBLE AS ax, embedding[2 * s]::DOUBLE AS ay, embedding[2 * s + 1]::DOUBLE AS bx, embedding[2 * s + 2]::DOUBLE AS b_y FROM embeddings, (VALUES (1), (2)) AS t(s)),
    e AS (SELECT label, arg_min(embedding, vec_id) AS v FROM embeddings GROUP BY label),
    r AS (SELECT label, t.j, v[t.j]::DOUBLE AS cx, v[t.j + 1]::DOUBLE AS cy, v[t.k]::DOUBLE AS dx, v[t.k + 1]::DOUBLE AS dy FROM e, (VALUES (7, 9), (9, 11), (11, 7)) AS t(j, k))"""

_MEET = f"""
    WITH {_SHAPES},
    x AS (SELECT vec_id, label,
        (NOT (greatest(ax, bx) < least(cx, dx) OR greatest(cx, dx) < least(ax, bx) OR greatest(ay, b_y) < least(cy, dy) OR greatest(cy, dy) < least(ay, b_y))
            AND sign((bx - ax) * (cy - ay) - (b_y - ay) * (cx - ax)) * sign((bx - ax) * (dy - ay) - (b_y - ay) * (dx - ax)) <= 0
            AND sign((dx - cx) * (ay - cy) - (dy - cy) * (ax - cx)) * sign((dx - cx) * (b_y - cy) - (dy - cy) * (bx - cx)) <= 0) AS crossed,
        (s = 1 AND ((cy > ay) <> (dy > ay)) AND ax < (dx - cx) * (ay - cy) / (dy - cy) + cx) AS odd
        FROM l CROSS JOIN r),
    m AS (SELECT vec_id, label FROM x GROUP BY ALL HAVING bool_or(crossed) OR count(*) FILTER (WHERE odd) % 2 = 1)"""


def _vertices(first: int, n: int):
    return F.array(*[F.struct(F.col("embedding")[first + 2 * k].cast("double").alias("x"), F.col("embedding")[first + 2 * k + 1].cast("double").alias("y")) for k in range(n)])


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "embeddings").select("vec_id", _vertices(0, 3).alias("line"))


def _rings(spark: SparkSession, d: str) -> DataFrame:
    first = read_table(spark, d, "embeddings").groupBy("label").agg(F.min_by("embedding", "vec_id").alias("embedding"))
    return first.select("label", _vertices(6, 3).alias("ring"))


@query(_MEET + " SELECT vec_id, label FROM (SELECT DISTINCT vec_id FROM l) LEFT JOIN m USING (vec_id)")
def line_polygon_join(spark: SparkSession, d: str) -> DataFrame:
    return shapes.lines_with_polygons(_lines(spark, d), _rings(spark, d), "vec_id", "label", 0.2).select("vec_id", "label")


@query(_MEET + " SELECT DISTINCT label FROM m")
def polygons_met_by_lines(spark: SparkSession, d: str) -> DataFrame:
    return shapes.polygons_met(_rings(spark, d), _lines(spark, d), "label", "vec_id", 0.2).select("label")


@query(f"""
    WITH i AS (SELECT vec_id, px - 0.02 AS x0, px + 0.02 AS x1, py - 0.02 AS y0, py + 0.02 AS y1 FROM {_POINTS}),
    r AS (SELECT vec_id, t.* FROM i, LATERAL (VALUES (x0, y0, x1, y0), (x1, y0, x1, y1), (x1, y1, x0, y1), (x0, y1, x0, y0)) AS t(cx, cy, dx, dy)),
    l AS (SELECT * FROM (VALUES (-0.3::DOUBLE, -0.2::DOUBLE, 0.1::DOUBLE, 0.05::DOUBLE), (0.1, 0.05, 0.3, -0.1)) AS t(ax, ay, bx, b_y))
    SELECT DISTINCT vec_id FROM (SELECT vec_id FROM r, l WHERE NOT (greatest(ax, bx) < least(cx, dx) OR greatest(cx, dx) < least(ax, bx) OR greatest(ay, b_y) < least(cy, dy) OR greatest(cy, dy) < least(ay, b_y))
        AND sign((bx - ax) * (cy - ay) - (b_y - ay) * (cx - ax)) * sign((bx - ax) * (dy - ay) - (b_y - ay) * (dx - ax)) <= 0
        AND sign((dx - cx) * (ay - cy) - (dy - cy) * (ax - cx)) * sign((dx - cx) * (b_y - cy) - (dy - cy) * (bx - cx)) <= 0
        UNION ALL SELECT vec_id FROM i WHERE -0.3 BETWEEN x0 AND x1 AND -0.2 BETWEEN y0 AND y1)""")
def catalog_meets_line(spark: SparkSession, d: str) -> DataFrame:
    """Items, as boxes around points, that a line meets."""
    items = _points(spark, d).select("vec_id", shapes.box_ring(F.col("px") - 0.02, F.col("px") + 0.02, F.col("py") - 0.02, F.col("py") + 0.02).alias("ring"))
    line = spark.createDataFrame([(1, [(-0.3, -0.2), (0.1, 0.05), (0.3, -0.1)])], "line_id int, line array<struct<x: double, y: double>>")
    return shapes.polygons_met(items, line, "vec_id", "line_id", 0.1).select("vec_id")


@query(f"""
    WITH b AS (SELECT label, px - 0.03 AS x0, px + 0.03 AS x1, py - 0.02 AS y0, py + 0.02 AS y1 FROM {_POINTS}),
    xs AS (SELECT label, unnest([x0, x1]) AS a FROM b), st AS (SELECT label, a, lead(a) OVER (PARTITION BY label ORDER BY a) AS z FROM (SELECT DISTINCT label, a FROM xs)),
    o AS (SELECT label, a, z, y0, y1, greatest(y0, coalesce(max(y1) OVER (PARTITION BY label, a ORDER BY y0, y1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), y0)) AS low FROM st JOIN b USING (label) WHERE x0 <= a AND x1 >= z),
    p AS (SELECT label, (z - a) * (y1 - low) AS w, (a + z) / 2 AS x, (y1 + low) / 2 AS y FROM o WHERE y1 > low)
    SELECT label, round(sum(w), 9) AS area, round(sum(w * x) / sum(w), 9) AS cx, round(sum(w * y) / sum(w), 9) AS cy FROM p GROUP BY label""")
def union_area_centroid(spark: SparkSession, d: str) -> DataFrame:
    p = _points(spark, d)
    boxes = p.select("label", *[(F.col(c) + s).alias(n) for c, s, n in (("px", -0.03, "x0"), ("px", 0.03, "x1"), ("py", -0.02, "y0"), ("py", 0.02, "y1"))])
    return shapes.union_of_boxes(boxes, ["label"]).select("label", *[F.round(c, 9).alias(c) for c in ("area", "cx", "cy")])


_TURNED = f"""
    WITH b AS (SELECT label, px - 0.03 AS x0, px + 0.03 AS x1, py - 0.02 AS y0, py + 0.02 AS y1 FROM {_POINTS}),
    xs AS (SELECT label, unnest([x0, x1]) AS a FROM b), st AS (SELECT label, a, lead(a) OVER (PARTITION BY label ORDER BY a) AS z FROM (SELECT DISTINCT label, a FROM xs)),
    o AS (SELECT label, a, z, y0, y1, greatest(y0, coalesce(max(y1) OVER (PARTITION BY label, a ORDER BY y0, y1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), y0)) AS low FROM st JOIN b USING (label) WHERE x0 <= a AND x1 >= z),
    p AS (SELECT label, (z - a) * (y1 - low) AS w, (a + z) / 2 AS x, (y1 + low) / 2 AS y FROM o WHERE y1 > low),
    m AS (SELECT label, sum(w) AS area, sum(w * x) / sum(w) AS cx, sum(w * y) / sum(w) AS cy FROM p GROUP BY label)"""


def _turned(spark: SparkSession, d: str) -> DataFrame:
    """Boxes around points, turned about the origin so that no edge is upright."""
    p = _points(spark, d)
    corners = [(F.col("px") + a, F.col("py") + b) for a, b in ((-0.03, -0.02), (0.03, -0.02), (0.03, 0.02), (-0.03, 0.02))]
    ring = F.array(*[F.struct((x * 0.8 - y * 0.6).alias("x"), (x * 0.6 + y * 0.8).alias("y")) for x, y in corners])
    return p.select("label", F.array(ring).alias("rings"))


@query(_TURNED + " SELECT label, round(area, 5) AS area, round(0.8 * cx - 0.6 * cy, 5) AS cx, round(0.6 * cx + 0.8 * cy, 5) AS cy FROM m")
def union_of_polygons(spark: SparkSession, d: str) -> DataFrame:
    out = overlay.union_measures(_turned(spark, d), ["label"], 0.25)
    return out.select("label", *[F.round(c, 5).alias(c) for c in ("area", "cx", "cy")])


@query(_TURNED + " SELECT label, round(area, 5) AS area FROM m")
def dissolved_rings(spark: SparkSession, d: str) -> DataFrame:
    """The area of each label's rings, holes taken off."""
    rings = overlay.union_rings(_turned(spark, d), ["label"], 0.25)
    return rings.groupBy("label").agg(F.round(F.sum(F.when(F.col("hole"), -F.col("area")).otherwise(F.col("area"))), 5).alias("area"))


def _far(p: tuple[str, str], a: tuple[str, str], b: tuple[str, str]) -> str:
    along = f"greatest(0, least(1, (({p[0]} - {a[0]}) * ({b[0]} - {a[0]}) + ({p[1]} - {a[1]}) * ({b[1]} - {a[1]})) / (({b[0]} - {a[0]}) ** 2 + ({b[1]} - {a[1]}) ** 2)))"
    return f"sqrt(({p[0]} - {a[0]} - {along} * ({b[0]} - {a[0]})) ** 2 + ({p[1]} - {a[1]} - {along} * ({b[1]} - {a[1]})) ** 2)"


_A, _B, _C, _D = ("ax", "ay"), ("bx", "b_y"), ("cx", "cy"), ("dx", "dy")
#: A short line and a small triangle from each row, near its first two components and its seventh and eighth.
_SHORT = "embedding[{f}]::DOUBLE + {w} * (embedding[{k}]::DOUBLE - embedding[{f}]::DOUBLE)"
_NEAR = f"""
    WITH v AS (SELECT vec_id, {", ".join(f"{_SHORT.format(f=1 + c, k=k + c, w=0 if k == 1 else 0.1)} AS l{n}{'xy'[c]}" for n, k in enumerate((1, 3, 5)) for c in (0, 1))},
        {", ".join(f"{_SHORT.format(f=7 + c, k=k + c, w=0 if k == 7 else 0.05)} AS r{n}{'xy'[c]}" for n, k in enumerate((7, 9, 11)) for c in (0, 1))} FROM embeddings),
    l AS (SELECT vec_id, t.* FROM v, LATERAL (VALUES (1, l0x, l0y, l1x, l1y), (2, l1x, l1y, l2x, l2y)) AS t(s, ax, ay, bx, b_y)),
    r AS (SELECT vec_id AS other, t.* FROM v, LATERAL (VALUES (r0x, r0y, r1x, r1y), (r1x, r1y, r2x, r2y), (r2x, r2y, r0x, r0y)) AS t(cx, cy, dx, dy)),
    x AS (SELECT vec_id, other, least({_far(_A, _C, _D)}, {_far(_B, _C, _D)}, {_far(_C, _A, _B)}, {_far(_D, _A, _B)}) AS far,
        (NOT (greatest(ax, bx) < least(cx, dx) OR greatest(cx, dx) < least(ax, bx) OR greatest(ay, b_y) < least(cy, dy) OR greatest(cy, dy) < least(ay, b_y))
            AND sign((bx - ax) * (cy - ay) - (b_y - ay) * (cx - ax)) * sign((bx - ax) * (dy - ay) - (b_y - ay) * (dx - ax)) <= 0
            AND sign((dx - cx) * (ay - cy) - (dy - cy) * (ax - cx)) * sign((dx - cx) * (b_y - cy) - (dy - cy) * (bx - cx)) <= 0) AS crossed,
        (s = 1 AND ((cy > ay) <> (dy > ay)) AND ax < (dx - cx) * (ay - cy) / (dy - cy) + cx) AS odd FROM l CROSS JOIN r),
    m AS (SELECT vec_id, other, CASE WHEN bool_or(crossed) OR count(*) FILTER (WHERE odd) % 2 = 1 THEN 0 ELSE min(far) END AS distance FROM x GROUP BY ALL)
    SELECT vec_id, other, round(distance, 9) AS distance FROM m QUALIFY distance = min(distance) OVER (PARTITION BY vec_id)"""


@query(_NEAR)
def nearest_shapes(spark: SparkSession, d: str) -> DataFrame:
    """The nearest triangles of each line; those that it meets are all at no distance."""
    e = read_table(spark, d, "embeddings")

    def drawn(first: int, share: float):
        part = lambda k: F.col("embedding")[k].cast("double")
        return F.array(*[F.struct(*[(part(first + c) + F.lit(share if k else 0.0) * (part(first + 2 * k + c) - part(first + c))).alias("xy"[c]) for c in (0, 1)]) for k in range(3)])

    lines, triangles = e.select("vec_id", drawn(0, 0.1).alias("shape")), e.select(F.col("vec_id").alias("other"), drawn(6, 0.05).alias("shape"))
    return nearest.nearest_shapes(lines, triangles, "vec_id", "other").select("vec_id", "other", F.round("distance", 9).alias("distance"))


@query("SELECT vec_id, round(0.1 * (sqrt((embedding[3]::DOUBLE - embedding[1]::DOUBLE) ** 2 + (embedding[4]::DOUBLE - embedding[2]::DOUBLE) ** 2) + 0.1), 4) AS area FROM embeddings")
def buffer_areas(spark: SparkSession, d: str) -> DataFrame:
    """Buffers with square ends of a segment from each row."""
    segments = read_table(spark, d, "embeddings").select("vec_id", _vertices(0, 2).alias("line"))
    pieces = buffers.buffer_pieces(segments, ["vec_id"], 0.05, cap="square", join="mitre")
    return overlay.union_measures(pieces, ["vec_id"], 0.5).select("vec_id", F.round("area", 4).alias("area"))


_CROSS = "abs((embedding[{b}]::DOUBLE - embedding[{a}]::DOUBLE) * (embedding[{c} + 1]::DOUBLE - embedding[{a} + 1]::DOUBLE) - (embedding[{c}]::DOUBLE - embedding[{a}]::DOUBLE) * (embedding[{b} + 1]::DOUBLE - embedding[{a} + 1]::DOUBLE)) / 2"


@query(f"SELECT vec_id, 2 AS parts, round(0.75 * {_CROSS.format(a=1, b=3, c=5)} + {_CROSS.format(a=7, b=9, c=11)}, 9) AS area FROM embeddings")
def multi_part_areas(spark: SparkSession, d: str) -> DataFrame:
    """Shapes of two parts, one with a hole, by way of their texts."""
    e = read_table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("v"))

    def ring(first: int, share: float = 1.0):
        at = lambda k, c: F.col("v")[first + c] + (F.col("v")[first + 2 * k + c] - F.col("v")[first + c]) * share
        return F.concat(F.lit("("), F.concat_ws(", ", *[F.concat_ws(" ", at(k, 0).cast("string"), at(k, 1).cast("string")) for k in (0, 1, 2, 0)]), F.lit(")"))

    text = F.concat(F.lit("MULTIPOLYGON (("), ring(0), F.lit(", "), ring(0, 0.5), F.lit("), ("), ring(6), F.lit("))"))
    shape = e.select("vec_id", geometry.parse_shape(text).alias("shape"))
    return shape.select("vec_id", F.size("shape.parts").alias("parts"), F.round(geometry.shape_area("shape"), 9).alias("area"))


@query("""
    WITH l AS (SELECT vec_id, s, s - 1.0::DOUBLE AS ax, embedding[s]::DOUBLE AS ay, s::DOUBLE AS bx, embedding[s + 1]::DOUBLE AS b_y FROM embeddings, (VALUES (1), (2), (3)) AS t(s)),
    m AS (SELECT *, sqrt((bx - ax) ** 2 + (b_y - ay) ** 2) AS len FROM l),
    c AS (SELECT *, coalesce(sum(len) OVER (PARTITION BY vec_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s0, sum(len) OVER (PARTITION BY vec_id) AS total FROM m)
    SELECT vec_id, k, round(ax + (bx - ax) * (total * k / 100 - s0) / len, 6) AS px, round(ay + (b_y - ay) * (total * k / 100 - s0) / len, 6) AS py
    FROM c, (SELECT unnest(range(100))::INT AS k) WHERE total * k / 100 >= s0 AND total * k / 100 < s0 + len""")
def normalised_points(spark: SparkSession, d: str) -> DataFrame:
    line = F.array(*[F.struct(F.lit(float(k)).alias("x"), F.col("embedding")[k].cast("double").alias("y")) for k in range(4)])
    p = shapes.points_by_share(read_table(spark, d, "embeddings").select("vec_id", line.alias("line")), "line", 100)
    return p.select("vec_id", "k", F.round("px", 6).alias("px"), F.round("py", 6).alias("py"))


@query("""
    WITH v AS (SELECT vec_id, [round(x * 4)::INT for x in embedding[1:3]] AS a, [round(x * 4)::INT for x in embedding[4:6]] AS b FROM embeddings)
    SELECT vec_id, (a = b OR a = list_reverse(b)) AS same FROM v""")
def line_equality(spark: SparkSession, d: str) -> DataFrame:
    part = lambda first: F.transform(F.slice("embedding", first, 3), lambda x: F.round(x * 4).cast("int"))
    return read_table(spark, d, "embeddings").select("vec_id", shapes.lines_equal(part(1), part(4)).alias("same"))


@query("""
    WITH p AS (SELECT vec_id, label, embedding[1] AS c, row_number() OVER w AS n, embedding[1] - lag(embedding[1]) OVER w AS step FROM embeddings WINDOW w AS (PARTITION BY label ORDER BY vec_id))
    SELECT vec_id, (CASE WHEN coalesce(bool_or(n = 2 AND step < 0) OVER (PARTITION BY label), false) THEN count(*) OVER (PARTITION BY label) + 1 - n ELSE n END)::INT AS place FROM p""")
def axis_flip(spark: SparkSession, d: str) -> DataFrame:
    p = read_table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding")[0].alias("c"))
    return shapes.flip_axis(p, ["label"], ["vec_id"], "c").select("vec_id", "place")


@query("SELECT s_suppkey, s_name AS ref_s_name, s_acctbal AS ref_s_acctbal, s_name AS to_reg_s_name FROM supplier")
def prefixed_attributes(spark: SparkSession, d: str) -> DataFrame:
    s = read_table(spark, d, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    return shapes.prefix_columns(s, ["s_name", "s_acctbal"], "ref_").join(shapes.prefix_columns(s.select("s_suppkey", "s_name"), ["s_name"], "to_reg_"), "s_suppkey")


@query("SELECT event_type, median(value) AS med, round(1.4826 * mad(value), 9) AS nmad FROM events GROUP BY event_type UNION ALL SELECT 'reference', 0, 0")
def reference_row(spark: SparkSession, d: str) -> DataFrame:
    from .trends import nmad

    return shapes.with_reference(nmad(spark, d), {"event_type": "reference"})


@query(f"SELECT y, x, CASE WHEN x % 4 = 1 THEN z END AS z FROM {_GRID}")
def mask_to_null(spark: SparkSession, d: str) -> DataFrame:
    return _cells(spark, d).select("y", "x", shapes.keep_where("z", F.col("x") % 4 == 1).alias("z"))


@query(f"SELECT x, round(avg(z), 9) AS mean FROM {_GRID} GROUP BY x")
def time_mean(spark: SparkSession, d: str) -> DataFrame:
    return _cells(spark, d).groupBy("x").agg(F.round(F.avg("z"), 9).alias("mean"))


_OUTER, _HOLE, _SECOND = ((2.5, 3.5), (50.5, 20.5), (30.5, 300.5)), ((20.5, 40.5), (32.5, 45.5), (28.5, 120.5)), ((0.5, 250.5), (60.5, 250.5), (60.5, 450.5), (0.5, 450.5))


def _inside_sql(ring: tuple) -> str:
    edges = zip(ring, (*ring[1:], ring[0]), strict=True)
    return "(" + " + ".join(f"(CASE WHEN ({ay} > y) <> ({by} > y) AND x < ({bx - ax})::DOUBLE * (y - {ay}) / ({by - ay or 1}) + {ax} THEN 1 ELSE 0 END)" for (ax, ay), (bx, by) in edges) + ") % 2 = 1"


def _ring(points: tuple):
    return F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in points])


@query(f"SELECT y, x, CASE WHEN {_inside_sql(_OUTER)} AND NOT ({_inside_sql(_HOLE)}) THEN 1 WHEN {_inside_sql(_SECOND)} THEN 2 END AS id FROM {_GRID}")
def polygon_id_raster(spark: SparkSession, d: str) -> DataFrame:
    return shapes.polygon_ids(_cells(spark, d).select("y", "x"), [(1, _ring(_OUTER), F.array(_ring(_HOLE))), (2, _ring(_SECOND), None)])


def _square_sql(reach: float) -> str:
    pts = list(_LINE)
    for end, other in ((0, 1), (-1, -2)):
        (x, y), (ox, oy) = _LINE[end], _LINE[other]
        far = ((x - ox) ** 2 + (y - oy) ** 2) ** 0.5
        pts[end] = (x + (x - ox) * reach / far, y + (y - oy) * reach / far)
    parts = []
    for (ax, ay), (bx, by) in zip(pts, pts[1:], strict=False):
        along = f"(((x - {ax!r}::DOUBLE) * {bx - ax!r}::DOUBLE + (y - {ay!r}::DOUBLE) * {by - ay!r}::DOUBLE) / {(bx - ax) ** 2 + (by - ay) ** 2!r}::DOUBLE)"
        parts.append(f"CASE WHEN {along} BETWEEN 0 AND 1 THEN sqrt((x - {ax!r}::DOUBLE - {along} * {bx - ax!r}::DOUBLE) ** 2 + (y - {ay!r}::DOUBLE - {along} * {by - ay!r}::DOUBLE) ** 2) END")
    return f"least({', '.join(parts)})"


@query(f"SELECT y, x, coalesce(CASE WHEN {_square_sql(5.5)} <= 5.5 THEN 1 END, 0) AS mask FROM {_GRID}")
def buffer_mask_square(spark: SparkSession, d: str) -> DataFrame:
    return grid.buffer_mask(_cells(spark, d).select("y", "x"), shapes.square_caps(_ring(_LINE), 5.5), 5.5)


@query("""
    WITH p AS (SELECT s_suppkey, k, radians((s_suppkey * 7 + k * 3) % 90 - 90 + 45)::DOUBLE AS lam, radians(60 + (s_suppkey * 3 + k) % 25)::DOUBLE AS phi FROM supplier, (VALUES (0), (1), (2)) AS t(k)),
    c AS (SELECT 0.0818191908426215::DOUBLE AS e, 6378137.0::DOUBLE AS a, radians(70)::DOUBLE AS p1),
    t AS (SELECT *, tan(pi() / 4 - phi / 2) / ((1 - e * sin(phi)) / (1 + e * sin(phi))) ** (e / 2) AS t, tan(pi() / 4 - p1 / 2) / ((1 - e * sin(p1)) / (1 + e * sin(p1))) ** (e / 2) AS t1, cos(p1) / sqrt(1 - (e * sin(p1)) ** 2) AS m1 FROM p, c)
    SELECT s_suppkey, k, round(a * m1 * t / t1 * sin(lam), 3) AS x, round(-a * m1 * t / t1 * cos(lam), 3) AS y FROM t""")
def reproject_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of three vertices in degrees, projected vertex by vertex."""
    s = read_table(spark, d, "supplier").select("s_suppkey")
    vertex = [F.struct(((F.col("s_suppkey") * 7 + k * 3) % 90 - 90).cast("double").alias("x"), (60 + (F.col("s_suppkey") * 3 + k) % 25).cast("double").alias("y")) for k in range(3)]
    out = s.select("s_suppkey", F.posexplode(shapes.reproject_vertices(F.array(*vertex))).alias("k", "v"))
    return out.select("s_suppkey", "k", F.round("v.x", 3).alias("x"), F.round("v.y", 3).alias("y"))
