"""Grids, lines over grids and numerics by group. Embeddings stand for a raster: a row is y, a component x."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import grid, numeric
from ..sources.tables import read_table
from .joins import _GRID
from .registry import query


def _cells(spark: SparkSession, d: str) -> DataFrame:
    return grid.cells_of(read_table(spark, d, "embeddings"), "vec_id", "embedding")


@query(f"SELECT y, x, z FROM {_GRID} WHERE x BETWEEN 5 AND 20 AND y BETWEEN 10 AND 100")
def clip_box(spark: SparkSession, d: str) -> DataFrame:
    return grid.clip_box(_cells(spark, d), 5, 20, 10, 100)


@query(f"WITH c AS {_GRID} SELECT f.y, f.x, coalesce(z, -9999) AS z FROM (SELECT y, unnest(range(-2, 11))::INT AS x FROM (SELECT unnest(range(-3, 51)) AS y)) f LEFT JOIN c USING (y, x)")
def pad_box(spark: SparkSession, d: str) -> DataFrame:
    return grid.pad_box(_cells(spark, d), -2, 10, -3, 50, "z", -9999.0)


@query(f"WITH c AS {_GRID} SELECT c.y, c.x, CASE WHEN c.z = -9999 OR m.z > 0 THEN -9999 ELSE c.z END AS z FROM c LEFT JOIN (SELECT y - 1 AS y, x, z FROM c WHERE label < 5) m USING (y, x)")
def bitmask_apply(spark: SparkSession, d: str) -> DataFrame:
    e = read_table(spark, d, "embeddings")
    bits = grid.cells_of(e.where("label < 5"), "vec_id", "embedding").select((F.col("y") - 1).alias("y"), "x", F.col("z").alias("bits"))
    return grid.mask_bits(_cells(spark, d), bits, "z", -9999.0)


@query(f"SELECT y, x, nullif(CASE WHEN x % 7 = 0 THEN -9999 ELSE z END, -9999) AS z FROM {_GRID}")
def nodata_to_null(spark: SparkSession, d: str) -> DataFrame:
    c = _cells(spark, d).withColumn("z", F.when(F.col("x") % 7 == 0, -9999.0).otherwise(F.col("z")))
    return c.withColumn("z", grid.no_data("z", -9999.0))


@query(f"SELECT y, x, z FROM {_GRID} WHERE label <> 1 AND x % 2 = 1 AND z IS NOT NULL")
def cell_mask_sample(spark: SparkSession, d: str) -> DataFrame:
    e = read_table(spark, d, "embeddings")
    c = grid.cells_of(e, "vec_id", "embedding").join(e.select(F.col("vec_id").alias("y"), "label"), "y")
    return c.where((F.col("label") != 1) & (F.col("x") % 2 == 1)).dropna(subset=["z"]).select("y", "x", "z")


@query(f"WITH c AS {_GRID} SELECT label AS y, a.x, coalesce(CASE WHEN median(CASE WHEN a.z + b.z <> 0 THEN (a.z - b.z) / (a.z + b.z) END) < 0 THEN 1 END, 0) AS mask FROM (FROM c WHERE x < 32) a JOIN (SELECT y, x - 32 AS x, z FROM c WHERE x >= 32) b USING (y, x) GROUP BY ALL")
def stable_terrain_mask(spark: SparkSession, d: str) -> DataFrame:
    # two bands side by side in a row; rows of one label are one place at several times
    e = read_table(spark, d, "embeddings").select(F.col("label").alias("y"), F.slice("embedding", 1, 32).alias("g"), F.slice("embedding", 33, 32).alias("n"))
    both = e.select("y", F.posexplode(F.arrays_zip("g", "n")).alias("x", "v")).select("y", "x", F.col("v.g").cast("double").alias("green"), F.col("v.n").cast("double").alias("nir"))
    return grid.stable_mask(both, "green", "nir")


@query(f"WITH v AS (SELECT y, count(*) FILTER (WHERE z > 0) AS valid FROM {_GRID} GROUP BY y) SELECT y, valid, y = (SELECT y FROM v ORDER BY valid DESC, y LIMIT 1) AS is_reference FROM v")
def valid_count_reference(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.stats import argmax_reference

    return argmax_reference(_cells(spark, d), "y", F.col("z") > 0)


@query(f"SELECT y // 10 AS y, (x // 8)::BIGINT AS x, round(avg(z), 9) AS z, median(z) AS med, count(z) AS n FROM {_GRID} GROUP BY ALL")
def block_downsample(spark: SparkSession, d: str) -> DataFrame:
    c = _cells(spark, d).withColumns({"y": F.floor(F.col("y") / 10) * 8 + F.col("y") % 10 * 0.8})
    return grid.block_mean(c, 8, "z").withColumn("z", F.round("z", 9))


@query()
def triangle_downsample(spark: SparkSession, d: str) -> DataFrame:
    return grid.triangle_resample(_cells(spark, d), 8, "z")


def _bilinear(points: str) -> str:
    return f"""
        WITH c AS {_GRID}, p AS ({points}),
        f AS (SELECT *, least(floor(px), 62)::INT AS x0, least(floor(py), (SELECT max(vec_id) - 1 FROM embeddings))::BIGINT AS y0 FROM p),
        s AS (SELECT f.k, sum(c.z * (CASE WHEN c.x = x0 THEN 1 - (px - x0) ELSE px - x0 END) * (CASE WHEN c.y = y0 THEN 1 - (py - y0) ELSE py - y0 END)) AS z
            FROM f JOIN c ON c.x BETWEEN x0 AND x0 + 1 AND c.y BETWEEN y0 AND y0 + 1 GROUP BY f.k HAVING count(*) = 4)
        SELECT p.k, round(s.z, 9) AS z FROM p LEFT JOIN s USING (k)"""


@query(_bilinear("SELECT vec_id AS k, (vec_id * 37 % 6300 / 100.0)::DOUBLE AS px, (vec_id * 0.997)::DOUBLE AS py FROM embeddings"))
def regrid_bilinear(spark: SparkSession, d: str) -> DataFrame:
    e, last = read_table(spark, d, "embeddings").select(F.col("vec_id").alias("k")), _last_row(spark, d)
    p = e.select("k", (F.col("k") * 37 % 6300 / 100.0).alias("px"), (F.col("k") * 0.997).alias("py"))
    return grid.sample_bilinear(_cells(spark, d), p, "z", 63, last).select("k", F.round("z", 9).alias("z"))


def _last_row(spark: SparkSession, d: str) -> int:
    return int(read_table(spark, d, "embeddings").agg(F.max("vec_id")).first()[0])


_LINE = ((2.0, 10.0), (40.0, 90.0), (60.0, 400.0))


def _line(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(1, list(_LINE))], "line_id int, line array<struct<x: double, y: double>>")


_LINE_SQL = """
    WITH v AS (SELECT * FROM (VALUES (2.0::DOUBLE, 10.0::DOUBLE, 40.0::DOUBLE, 90.0::DOUBLE, 0), (40.0, 90.0, 60.0, 400.0, 1)) AS t(ax, ay, bx, b_y, s)),
    l AS (SELECT *, sqrt((bx - ax) ** 2 + (b_y - ay) ** 2) AS len FROM v),
    c AS (SELECT *, coalesce(sum(len) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s0, sum(len) OVER () AS total FROM l),
    k AS (SELECT unnest(range(0, (SELECT ceil(max(total) / 25)::BIGINT FROM c) + 1))::INT AS step),
    q AS (SELECT step, least(step * 25.0::DOUBLE, (SELECT max(total) FROM c)) AS dist FROM k),
    p AS (SELECT step, dist, ax + (bx - ax) * (dist - s0) / len AS px, ay + (b_y - ay) * (dist - s0) / len AS py FROM q JOIN c ON dist >= s0 AND (dist < s0 + len OR s = 1))"""


#: Lines of three vertices from the first six components of each row, a thousand times as large.
_LINES_SQL = """
    WITH l AS (SELECT vec_id, s, 1000 * embedding[2 * s - 1]::DOUBLE AS ax, 1000 * embedding[2 * s]::DOUBLE AS ay, 1000 * embedding[2 * s + 1]::DOUBLE AS bx, 1000 * embedding[2 * s + 2]::DOUBLE AS b_y FROM embeddings, (VALUES (1), (2)) AS t(s)),
    m AS (SELECT *, sqrt((bx - ax) ** 2 + (b_y - ay) ** 2) AS len FROM l),
    c AS (SELECT *, coalesce(sum(len) OVER (PARTITION BY vec_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s0, sum(len) OVER (PARTITION BY vec_id) AS total FROM m)"""


def _lines(spark: SparkSession, d: str) -> DataFrame:
    vertex = lambda k: F.struct(*[(F.col("embedding")[2 * k + c].cast("double") * 1000).alias("xy"[c]) for c in (0, 1)])
    return read_table(spark, d, "embeddings").select("vec_id", F.array(*[vertex(k) for k in range(3)]).alias("line"))


@query(_LINES_SQL + """,
    q AS (SELECT vec_id, k::INT AS step, least(k * 50.0::DOUBLE, total) AS dist FROM (SELECT vec_id, total, unnest(range(0, ceil(total / 50)::BIGINT + 1)) AS k FROM (SELECT DISTINCT vec_id, total FROM c)))
    SELECT vec_id, step, round(dist / 1000, 2) AS distance, round(ax + (bx - ax) * (dist - s0) / len, 6) AS px, round(ay + (b_y - ay) * (dist - s0) / len, 6) AS py FROM q JOIN c USING (vec_id) WHERE dist >= s0 AND (dist < s0 + len OR s = 2)""")
def densify_line(spark: SparkSession, d: str) -> DataFrame:
    p = grid.points_along(_lines(spark, d), "line", 50.0)
    return p.select("vec_id", "step", "distance", F.round("px", 6).alias("px"), F.round("py", 6).alias("py"))


@query(_LINE_SQL.replace("WITH v AS", f"WITH g AS {_GRID}, v AS") + """,
    f AS (SELECT *, least(floor(px), 62)::INT AS x0, least(floor(py), (SELECT max(vec_id) - 1 FROM embeddings))::BIGINT AS y0 FROM p)
    SELECT step, round(dist / 1000, 2) AS distance, round(sum(g.z * (CASE WHEN g.x = x0 THEN 1 - (px - x0) ELSE px - x0 END) * (CASE WHEN g.y = y0 THEN 1 - (py - y0) ELSE py - y0 END)), 6) AS z
    FROM f JOIN g ON g.x BETWEEN x0 AND x0 + 1 AND g.y BETWEEN y0 AND y0 + 1 GROUP BY ALL""")
def sample_line_bilinear(spark: SparkSession, d: str) -> DataFrame:
    p = grid.points_along(_line(spark), "line", 25.0).select("step", "distance", "px", "py")
    return grid.sample_bilinear(_cells(spark, d), p, "z", 63, _last_row(spark, d)).select("step", "distance", F.round("z", 6).alias("z"))


@query(_LINE_SQL.replace("WITH v AS", f"WITH g AS {_GRID}, v AS") + """,
    f AS (SELECT *, least(floor(px), 62)::INT AS x0, least(floor(py), (SELECT max(vec_id) - 1 FROM embeddings))::BIGINT AS y0 FROM p)
    SELECT cube, step, round(dist / 1000, 2) AS distance, round(sum(m * g.z * (CASE WHEN g.x = x0 THEN 1 - (px - x0) ELSE px - x0 END) * (CASE WHEN g.y = y0 THEN 1 - (py - y0) ELSE py - y0 END)), 6) AS v
    FROM f JOIN g ON g.x BETWEEN x0 AND x0 + 1 AND g.y BETWEEN y0 AND y0 + 1 CROSS JOIN (VALUES (0, 1), (1, 2)) AS t(cube, m) GROUP BY ALL""")
def sample_cube_line(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.robust import union_all

    p, c = grid.points_along(_line(spark), "line", 25.0).select("step", "distance", "px", "py"), _cells(spark, d)
    last = _last_row(spark, d)
    cubes = [grid.sample_bilinear(c.withColumn("v", F.col("z") * (k + 1)), p, "v", 63, last).withColumn("cube", F.lit(k)) for k in (0, 1)]
    return union_all(cubes).select("cube", "step", "distance", F.round("v", 6).alias("v"))


def _segment_sql() -> str:
    parts = []
    for (ax, ay), (bx, by) in zip(_LINE, _LINE[1:], strict=False):
        along = f"(((x - {ax}) * {bx - ax} + (y - {ay}) * {by - ay}) / {(bx - ax) ** 2 + (by - ay) ** 2})"
        parts.append(f"CASE WHEN {along} BETWEEN 0 AND 1 THEN sqrt((x - {ax} - {along} * {bx - ax}) ** 2 + (y - {ay} - {along} * {by - ay}) ** 2) END")
    return f"least({', '.join(parts)})"


@query(f"SELECT y, x, coalesce(CASE WHEN {_segment_sql()} <= 5.5 THEN 1 END, 0) AS mask FROM {_GRID}")
def buffer_mask(spark: SparkSession, d: str) -> DataFrame:
    line = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in _LINE])
    return grid.buffer_mask(_cells(spark, d).select("y", "x"), line, 5.5)


@query(_LINES_SQL + " SELECT vec_id, round(sum(len), 6) AS length, round(sum(len * (ax + bx) / 2) / sum(len), 6) AS cx, round(sum(len * (ay + b_y) / 2) / sum(len), 6) AS cy FROM c GROUP BY vec_id")
def line_length_centroid(spark: SparkSession, d: str) -> DataFrame:
    c = grid.line_centroid(F.col("line"))
    return _lines(spark, d).select("vec_id", F.round(grid.line_length(F.col("line")), 6).alias("length"), F.round(c["x"], 6).alias("cx"), F.round(c["y"], 6).alias("cy"))


@query(f"""
    WITH c AS (SELECT label, x::DOUBLE AS x, y::DOUBLE AS y, z FROM {_GRID}),
    g AS (SELECT label, count(*) AS n, avg(x) AS mx, avg(y) AS my, avg(z) AS mz, var_pop(x) AS xx, var_pop(y) AS yy, covar_pop(x, y) AS xy, covar_pop(x, z) AS xz, covar_pop(y, z) AS yz FROM c GROUP BY 1),
    s AS (SELECT *, (xz * yy - yz * xy) / (xx * yy - xy * xy) AS a, (yz * xx - xz * xy) / (xx * yy - xy * xy) AS b FROM g)
    SELECT label, round(a, 9) AS a, round(b, 9) AS b, round(mz - a * mx - b * my, 9) AS c, n FROM s""")
def tilt_fit(spark: SparkSession, d: str) -> DataFrame:
    e = read_table(spark, d, "embeddings")
    c = e.select("label", F.col("vec_id").alias("y"), F.posexplode("embedding").alias("x", "z"))
    return numeric.plane_fit(c, ["label"], "x", "y", "z").select("label", *[F.round(v, 9).alias(v) for v in "abc"], "n")


@query()
def streamline(spark: SparkSession, d: str) -> DataFrame:
    c = _cells(spark, d)
    field = c.select(F.floor(F.col("y") / 64).alias("site"), (F.col("y") % 64).alias("y"), "x", (F.col("z") + 0.1).alias("vx"), F.cos(F.col("z") * 20).alias("vy"))
    seeds = field.groupBy("site").agg(F.lit(1).alias("seed"), F.lit(30.0).alias("sx"), (F.max("y") / 2).alias("sy"))
    return numeric.streamlines(field, seeds)


@query()
def gap_fill(spark: SparkSession, d: str) -> DataFrame:
    c = _cells(spark, d).withColumn("site", F.lit(0)).withColumn("z", F.when((F.col("x") + F.col("y")) % 5 != 0, F.col("z")))
    return numeric.fill_gaps(c, "z", ["site"])


@query()
def coregister(spark: SparkSession, d: str) -> DataFrame:
    """A smooth surface, roughened by the table's components, against the smooth one moved."""
    shape = lambda x, y: F.sin(x / 5) * 10 + F.cos(y / 7) * 8
    spots = _cells(spark, d)
    ref = spots.select("y", "x", (shape(F.col("x"), F.col("y")) + F.col("z")).alias("z"), F.lit(1).alias("mask"))
    moves = [(1, 0.6, -0.4, 2.0), (2, -1.2, 0.8, -1.0)]
    moves = F.explode(F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("dem_id", "mx", "my", "mz"), m, strict=True)]) for m in moves]))
    others = spots.select("y", "x", moves.alias("m")).select("m.dem_id", "y", "x", (shape(F.col("x") - F.col("m.mx"), F.col("y") - F.col("m.my")) - F.col("m.mz")).alias("z"))
    return numeric.coregister(ref, others)
