"""Joins, pairs, set operations and places."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import filters, grid, robust, stats
from ..operators.numeric import random_points as draw_points
from ..operators.shapes import sorted_places
from ..sources.tables import read_table, search_items
from .registry import query
from .trends import _YEARS, _theil


@query("""
    WITH e AS (SELECT user_id, ts::DATE AS day, event_type, max(value) AS v FROM events GROUP BY ALL)
    SELECT user_id, day, a.v AS click, b.v AS view FROM (FROM e WHERE event_type = 'click') a JOIN (FROM e WHERE event_type = 'view') b USING (user_id, day)""")
def band_pair_join(spark: SparkSession, d: str) -> DataFrame:
    e = read_table(spark, d, "events").groupBy("user_id", F.to_date("ts").alias("day"), "event_type").agg(F.max("value").alias("v"))
    a, b = (e.where(F.col("event_type") == n).select("user_id", "day", F.col("v").alias(n)) for n in ("click", "view"))
    return a.join(b, ["user_id", "day"])


@query("SELECT l_orderkey, l_linenumber, l_partkey, o_orderdate, s_name FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey")
def two_hop_join(spark: SparkSession, d: str) -> DataFrame:
    lines = read_table(spark, d, "lineitem").join(read_table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return lines.join(read_table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select("l_orderkey", "l_linenumber", "l_partkey", "o_orderdate", "s_name")


@query("""
    WITH e AS (SELECT date_trunc('hour', ts)::TIMESTAMP AS h, event_type, median(value) AS v FROM events GROUP BY ALL)
    SELECT h, a.v AS click, b.v AS view, c.v AS error FROM (FROM e WHERE event_type = 'click') a FULL JOIN (FROM e WHERE event_type = 'view') b USING (h) FULL JOIN (FROM e WHERE event_type = 'error') c USING (h)""")
def outer_merge_bands(spark: SparkSession, d: str) -> DataFrame:
    e = read_table(spark, d, "events").groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("h"), "event_type").agg(F.median("value").alias("v"))
    return grid.merge_grids([e.where(F.col("event_type") == n).select("h", F.col("v").alias(n)) for n in ("click", "view", "error")], ["h"])


_ANNUAL = "(SELECT l_suppkey, year(l_shipdate)::DOUBLE AS x, median(l_extendedprice) AS y FROM lineitem GROUP BY ALL)"


@query(f"""
    WITH t AS ({_theil(f"SELECT l_suppkey, x, y FROM {_ANNUAL}", "l_suppkey")}), f AS (SELECT l_suppkey, regr_slope(y, x) AS trend FROM {_ANNUAL} GROUP BY 1)
    SELECT round(l_suppkey / 100.0, 2) AS distance, round(slope, 6) AS slope, round(trend, 6) AS trend, round(slope - trend, 6) AS difference FROM t JOIN f USING (l_suppkey)""")
def slope_compare(spark: SparkSession, d: str) -> DataFrame:
    annual = read_table(spark, d, "lineitem").groupBy("l_suppkey", F.year("l_shipdate").alias("x")).agg(F.median("l_extendedprice").alias("y"))
    key = F.round(F.col("l_suppkey") / 100, 2).alias("distance")
    t = robust.theil_sen(annual, ["l_suppkey"], "y", "x", per_year=False).select(key, "slope")
    f = stats.linear_fit(annual, ["l_suppkey"], "x", "y").select(key, F.col("slope").alias("trend"))
    return t.join(f, "distance").select("distance", F.round("slope", 6).alias("slope"), F.round("trend", 6).alias("trend"), F.round(F.col("slope") - F.col("trend"), 6).alias("difference"))


@query("SELECT s_suppkey, s_name, n_name, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def dim_lookup(spark: SparkSession, d: str) -> DataFrame:
    # nations and regions keep 25 and 5 rows at any size
    places = read_table(spark, d, "nation").join(F.broadcast(read_table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return read_table(spark, d, "supplier").join(F.broadcast(places), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "s_name", "n_name", "r_name")


@query("""
    WITH q AS (SELECT l_suppkey, l_linestatus, median(l_extendedprice) AS med FROM lineitem GROUP BY ALL)
    SELECT l_suppkey, o.med AS med_O, f.med AS med_F, o.med - f.med AS difference FROM (FROM q WHERE l_linestatus = 'O') o JOIN (FROM q WHERE l_linestatus = 'F') f USING (l_suppkey)""")
def lake_land_pairs(spark: SparkSession, d: str) -> DataFrame:
    q = read_table(spark, d, "lineitem").groupBy("l_suppkey", "l_linestatus").agg(F.median("l_extendedprice").alias("med"))
    return stats.paired_levels(q, ["l_suppkey"], "l_linestatus", ("O", "F"), ["med"])


_POINTS = "(SELECT vec_id, label, embedding[1]::DOUBLE AS px, embedding[2]::DOUBLE AS py FROM embeddings)"
_BOXES = "(VALUES (1, -0.1, 0.1, -0.1, 0.1), (2, 0.0, 0.3, -0.3, 0.05), (3, -0.4, -0.05, 0.0, 0.4)) AS b(box, x0, x1, y0, y1)"


def _points(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding")[0].cast("double").alias("px"), F.col("embedding")[1].cast("double").alias("py"))


def _boxes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(1, -0.1, 0.1, -0.1, 0.1), (2, 0.0, 0.3, -0.3, 0.05), (3, -0.4, -0.05, 0.0, 0.4)], "box int, x0 double, x1 double, y0 double, y1 double")


@query(f"SELECT vec_id, box FROM {_POINTS} p LEFT JOIN {_BOXES} ON px BETWEEN x0 AND x1 AND py BETWEEN y0 AND y1")
def point_in_box(spark: SparkSession, d: str) -> DataFrame:
    return grid.point_in_box(_points(spark, d), _boxes(spark), 0.1, "left").select("vec_id", "box")


@query(f"""
    WITH l AS (SELECT vec_id, px - 0.05 AS x0, px + 0.05 AS x1, py - 0.05 AS y0, py + 0.05 AS y1 FROM {_POINTS})
    SELECT vec_id FROM l WHERE EXISTS (SELECT 1 FROM (SELECT 0.05 AS bx0, 0.1 AS bx1, 0.0 AS by0, 0.1 AS by1) WHERE l.x0 <= bx1 AND l.x1 >= bx0 AND l.y0 <= by1 AND l.y1 >= by0)""")
def bbox_semi(spark: SparkSession, d: str) -> DataFrame:
    l = _points(spark, d).select("vec_id", *[(F.col(c) + s).alias(n) for c, s, n in (("px", -0.05, "x0"), ("px", 0.05, "x1"), ("py", -0.05, "y0"), ("py", 0.05, "y1"))])  # noqa: E741
    box = spark.createDataFrame([(0.05, 0.1, 0.0, 0.1)], "x0 double, x1 double, y0 double, y1 double")
    return grid.boxes_touching(l, box, 0.1).select("vec_id")


@query(f"""
    WITH p AS {_POINTS}, q AS (SELECT vec_id AS place, px AS qx, py AS qy FROM p WHERE vec_id % 25 = 0)
    SELECT vec_id, place, round(sqrt((px - qx) ** 2 + (py - qy) ** 2), 9) AS distance FROM p CROSS JOIN q QUALIFY rank() OVER (PARTITION BY vec_id ORDER BY (px - qx) ** 2 + (py - qy) ** 2) = 1""")
def nearest_spatial(spark: SparkSession, d: str) -> DataFrame:
    p = _points(spark, d).select("vec_id", "px", "py")
    q = p.where("vec_id % 25 = 0").select(F.col("vec_id").alias("place"), F.col("px").alias("qx"), F.col("py").alias("qy"))
    return grid.nearest_place(p, q, "vec_id", 0.1).select("vec_id", "place", F.round("distance", 9).alias("distance"))


_TRIANGLE = ((0.0, 0.3), (-0.3, -0.2), (0.25, -0.25))


@query("SELECT vec_id FROM (SELECT vec_id, px, py, " + " + ".join(f"((({ay} > py) <> ({by} > py)) AND px < ({bx} - {ax})::DOUBLE * (py - {ay}) / ({by} - {ay}) + {ax})::INT" for (ax, ay), (bx, by) in zip(_TRIANGLE, _TRIANGLE[1:] + _TRIANGLE[:1], strict=True)).replace("0.0", "0.0::DOUBLE") + f" AS n FROM {_POINTS}) WHERE n % 2 = 1")
def point_in_polygon(spark: SparkSession, d: str) -> DataFrame:
    ring = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in _TRIANGLE])
    return _points(spark, d).where(grid.in_polygon(F.col("px"), F.col("py"), ring)).select("vec_id")


@query("WITH r AS (SELECT s_suppkey FROM supplier ORDER BY s_acctbal DESC, s_suppkey LIMIT 1) SELECT r.s_suppkey AS reference, s.s_suppkey AS other FROM supplier s, r WHERE s.s_suppkey <> r.s_suppkey")
def ref_pairs(spark: SparkSession, d: str) -> DataFrame:
    s = read_table(spark, d, "supplier")
    best = s.agg(F.max_by("s_suppkey", F.struct(F.col("s_acctbal"), -F.col("s_suppkey"))).alias("reference"))  # one row
    return s.join(F.broadcast(best), F.col("s_suppkey") != F.col("reference")).select("reference", F.col("s_suppkey").alias("other"))


@query("SELECT event_id, value FROM events WHERE value = (SELECT arg_min(value, (abs(value - 100), event_id)) FROM events)")
def nearest_value(spark: SparkSession, d: str) -> DataFrame:
    return stats.nearest_value_rows(read_table(spark, d, "events").select("event_id", "value"), "value", 100.0, "event_id")


@query("""
    WITH v AS (SELECT unnest([10.0, 100.0, 250.0]) AS target),
    n AS (SELECT target, (SELECT arg_min(user_id, (abs(m - target), user_id)) FROM (SELECT user_id, median(value) AS m FROM events GROUP BY 1)) AS user_id FROM v)
    SELECT target::DOUBLE AS target, event_id, e.user_id, value FROM n JOIN events e USING (user_id)""")
def nearest_series(spark: SparkSession, d: str) -> DataFrame:
    e = read_table(spark, d, "events").select("event_id", "user_id", "value")
    med = e.groupBy("user_id").agg(F.median("value").alias("m"))
    targets = F.array(*[F.lit(v) for v in (10.0, 100.0, 250.0)])
    best = med.select("user_id", "m", F.explode(targets).alias("target")).groupBy("target").agg(F.min_by("user_id", F.struct(F.abs(F.col("m") - F.col("target")), F.col("user_id"))).alias("user_id"))
    return e.join(F.broadcast(best), "user_id").select("target", "event_id", "user_id", "value")


@query("""
    WITH top AS (SELECT ts::DATE AS day, arg_max(user_id, (value, -user_id)) AS user_id FROM events GROUP BY 1),
    m AS (SELECT user_id FROM top GROUP BY user_id ORDER BY count(*) DESC, user_id LIMIT 1),
    e AS (SELECT event_id, ts, e.user_id, value, median(value) OVER () AS md FROM events e JOIN m USING (user_id)),
    f AS (SELECT *, median(abs(value - md)) OVER () AS mad FROM e)
    SELECT event_id, ts, user_id, value FROM f WHERE value - md < 5 * mad""")
def peak_distance_series(spark: SparkSession, d: str) -> DataFrame:
    e = read_table(spark, d, "events").select("event_id", "ts", "user_id", "value")
    own = e.join(F.broadcast(stats.modal_argmax(e, F.to_date("ts"), "user_id", "value")), "user_id")
    return filters.mad_filter(own, ["user_id"], "value", drop=True)


_GRID = "(SELECT vec_id AS y, unnest(range(len(embedding)))::INT AS x, unnest(embedding)::DOUBLE AS z, label FROM embeddings)"


@query(f"WITH c AS {_GRID} SELECT y, x, a.z AS trend, b.z AS n FROM (FROM c WHERE x < 20 AND y % 3 = 0) a FULL JOIN (FROM c WHERE x >= 10 AND x < 30 AND y % 2 = 0) b USING (y, x)")
def grid_outer_merge(spark: SparkSession, d: str) -> DataFrame:
    c = grid.cells_of(read_table(spark, d, "embeddings"), "vec_id", "embedding")
    return grid.merge_grids([c.where("x < 20 and y % 3 = 0").select("y", "x", F.col("z").alias("trend")), c.where("x >= 10 and x < 30 and y % 2 = 0").select("y", "x", F.col("z").alias("n"))], ["y", "x"])


@query(f"WITH c AS {_GRID} SELECT y, x, coalesce(a.z, b.z) AS z FROM (FROM c WHERE x < 20) a FULL JOIN (FROM c WHERE x >= 10 AND x < 30) b USING (y, x)")
def grid_first_wins(spark: SparkSession, d: str) -> DataFrame:
    c = grid.cells_of(read_table(spark, d, "embeddings"), "vec_id", "embedding")
    return grid.merge_grids([c.where("x < 20"), c.where("x >= 10 and x < 30")], ["y", "x"])


@query(f"WITH c AS {_GRID} SELECT a.y, x, a.z - b.z AS z FROM c a JOIN (SELECT y - 1 AS y, x, z FROM c) b USING (y, x)")
def grid_diff(spark: SparkSession, d: str) -> DataFrame:
    c = grid.cells_of(read_table(spark, d, "embeddings"), "vec_id", "embedding")
    return grid.subtract(c, c.withColumn("y", F.col("y") - 1), ["y", "x"], "z")


@query("""
    WITH b AS (SELECT *, floor(l_extendedprice / 2000)::BIGINT AS bin FROM lineitem),
    k AS (SELECT bin FROM b GROUP BY bin HAVING count(DISTINCT l_returnflag) = (SELECT count(DISTINCT l_returnflag) FROM b))
    SELECT l_orderkey, l_linenumber, l_partkey, bin FROM b WHERE bin IN (SELECT bin FROM k) AND l_quantity < 5""")
def common_bins_semi(spark: SparkSession, d: str) -> DataFrame:
    b = read_table(spark, d, "lineitem").withColumn("bin", F.floor(F.col("l_extendedprice") / 2000))
    return b.where("l_quantity < 5").join(stats.common_values(b, "l_returnflag", "bin"), "bin", "left_semi").select("l_orderkey", "l_linenumber", "l_partkey", "bin")


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def anti_join_done(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "orders").join(read_table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey")


@query("SELECT l_suppkey, y.year, n FROM (SELECT l_suppkey, year(l_shipdate)::INT AS year, count(*) AS n FROM lineitem GROUP BY ALL) y JOIN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) s ON l_suppkey = s_suppkey")
def lookup_skip_missing(spark: SparkSession, d: str) -> DataFrame:
    y = read_table(spark, d, "lineitem").groupBy("l_suppkey", F.year("l_shipdate").alias("year")).agg(F.count("*").alias("n"))
    return y.join(read_table(spark, d, "supplier").where("s_acctbal > 0"), F.col("l_suppkey") == F.col("s_suppkey")).select("l_suppkey", "year", "n")


@query("SELECT event_id, value, 'click' AS band FROM events WHERE event_type = 'click' UNION ALL SELECT event_id, value, 'view' FROM events WHERE event_type = 'view'")
def union_bands(spark: SparkSession, d: str) -> DataFrame:
    e = read_table(spark, d, "events")
    return robust.union_all([e.where(F.col("event_type") == b).select("event_id", "value", F.lit(b).alias("band")) for b in ("click", "view")])


@query("SELECT o_custkey FROM orders WHERE o_orderstatus = 'O' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def intersect_keys(spark: SparkSession, d: str) -> DataFrame:
    o = read_table(spark, d, "orders")
    return o.where("o_orderstatus = 'O'").select("o_custkey").intersect(o.where("o_orderstatus = 'F'").select("o_custkey"))


@query("SELECT p_partkey FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity >= 48")
def except_keys(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "part").select("p_partkey").subtract(read_table(spark, d, "lineitem").where("l_quantity >= 48").select("l_partkey"))


@query("SELECT l_suppkey, arg_max(med, year) AS med, max(year) AS year FROM (SELECT l_suppkey, year(l_shipdate)::INT AS year, median(l_extendedprice) AS med FROM lineitem GROUP BY ALL) GROUP BY 1")
def latest_year(spark: SparkSession, d: str) -> DataFrame:
    y = read_table(spark, d, "lineitem").groupBy("l_suppkey", F.year("l_shipdate").alias("year")).agg(F.median("l_extendedprice").alias("med"))
    return y.groupBy("l_suppkey").agg(F.max_by("med", "year").alias("med"), F.max("year").alias("year"))


@query("SELECT s_suppkey, s_acctbal, row_number() OVER (ORDER BY abs(s_acctbal) DESC, s_suppkey)::INT AS place FROM supplier")
def abs_sort(spark: SparkSession, d: str) -> DataFrame:
    return sorted_places(read_table(spark, d, "supplier").select("s_suppkey", "s_acctbal"), -F.abs("s_acctbal"), [F.col("s_suppkey")], "place")


@query("SELECT vec_id FROM (SELECT vec_id, px - 0.05 AS x0, px + 0.05 AS x1, py - 0.05 AS y0, py + 0.05 AS y1, TIMESTAMP '2024-01-01' + INTERVAL (vec_id % 60) DAY AS time, vec_id % 40 AS cloud_cover FROM " + _POINTS + ") WHERE x0 <= 0.2 AND x1 >= 0 AND y0 <= 0.2 AND y1 >= 0 AND time >= TIMESTAMP '2024-01-10' AND time < TIMESTAMP '2024-02-10' AND cloud_cover < 20")
def item_search(spark: SparkSession, d: str) -> DataFrame:
    items = _points(spark, d).select(
        "vec_id", *[(F.col(c) + s).alias(n) for c, s, n in (("px", -0.05, "x0"), ("px", 0.05, "x1"), ("py", -0.05, "y0"), ("py", 0.05, "y1"))],
        F.timestamp_add("DAY", (F.col("vec_id") % 60).cast("int"), F.lit("2024-01-01").cast("timestamp_ntz")).alias("time"), (F.col("vec_id") % 40).alias("cloud_cover"),
    )
    return search_items(items, (0.0, 0.2, 0.0, 0.2), "2024-01-10", "2024-02-10", 20).select("vec_id")


@query()
def random_points(spark: SparkSession, d: str) -> DataFrame:
    return draw_points(_points(spark, d), "px", "py", 200)
