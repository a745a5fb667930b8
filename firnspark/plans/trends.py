"""Filters, robust trends and quality gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import days_between
from ..operators import filters, grid, robust
from ..sources.tables import read_table
from .registry import query

_YEARS = "date_diff('microsecond', {a}, {b}) / 31557600000000.0"


def _theil(rows: str, key: str, ci: bool = False, out: str | None = None) -> str:
    """``rows``: SQL for (key, x, y), y not null."""
    ties = lambda c: f"(SELECT {key}, sum(k * (k - 1.0) * (2 * k + 5)) AS s FROM (SELECT {key}, count(*) AS k FROM obs GROUP BY {key}, {c}) GROUP BY {key})"
    limits = f"""
        , lim AS (SELECT m.{key}, m.n, len(l.s) AS nt, l.s AS s, sqrt((m.n * (m.n - 1.0) * (2 * m.n + 5) - tx.s - ty.s) / 18) AS sg
            FROM mid m JOIN (SELECT {key}, list(s ORDER BY s) AS s FROM pairs GROUP BY {key}) l USING ({key}) JOIN {ties("x")} tx USING ({key}) JOIN {ties("y")} ty USING ({key}))""" if ci else ""
    more = """, s[greatest(round_even((nt + -1.959963984540054 * sg) / 2, 0)::BIGINT - 1, 0) + 1] AS low_slope,
            s[least(round_even((nt - -1.959963984540054 * sg) / 2, 0)::BIGINT, nt - 1) + 1] AS high_slope""" if ci else ""
    return f"""
        WITH obs AS ({rows}),
        pairs AS (SELECT a.{key}, (b.y - a.y) / (b.x - a.x) AS s FROM obs a JOIN obs b ON a.{key} = b.{key} AND b.x > a.x),
        slopes AS (SELECT {key}, median(s) AS slope FROM pairs GROUP BY {key}),
        mid AS (SELECT {key}, median(x) AS mx, median(y) AS my, count(*) AS n FROM obs GROUP BY {key}){limits}
        SELECT {out or "mid." + key}, slope, my - slope * mx AS intercept, mid.n{more}
        FROM mid LEFT JOIN slopes USING ({key}){f" LEFT JOIN lim USING ({key})" if ci else ""}"""


_USERS = f"SELECT user_id, {_YEARS.format(a='min(ts) OVER (PARTITION BY user_id)', b='ts')} AS x, value AS y FROM events"


@query(_theil(_USERS, "user_id"))
def theil_sen(spark: SparkSession, d: str) -> DataFrame:
    return robust.theil_sen(read_table(spark, d, "events"), ["user_id"], "value", "ts")


@query(_theil(f"SELECT l_partkey, {_YEARS.format(a='min(l_shipdate) OVER (PARTITION BY l_partkey)', b='l_shipdate')} AS x, l_quantity::DOUBLE AS y FROM lineitem", "l_partkey", ci=True))
def theil_sen_ci(spark: SparkSession, d: str) -> DataFrame:
    return robust.theil_sen(read_table(spark, d, "lineitem"), ["l_partkey"], "l_quantity", "l_shipdate", ci=True)


@query(_theil(f"SELECT l_suppkey, {_YEARS.format(a='min(l_shipdate) OVER (PARTITION BY l_suppkey)', b='l_shipdate')} AS x, l_extendedprice::DOUBLE AS y FROM lineitem", "l_suppkey", ci=True))
def theil_sen_large(spark: SparkSession, d: str) -> DataFrame:
    return robust.theil_sen(read_table(spark, d, "lineitem"), ["l_suppkey"], "l_extendedprice", "l_shipdate", "numpy", ci=True)


@query(_theil("SELECT unnest(range(len(embedding))) AS px, vec_id::DOUBLE AS x, unnest(embedding)::DOUBLE AS y FROM embeddings", "px"))
def theil_sen_pixel(spark: SparkSession, d: str) -> DataFrame:
    cells = grid.cells_of(read_table(spark, d, "embeddings"), "vec_id", "embedding").withColumnRenamed("x", "px")
    return robust.theil_sen(cells, ["px"], "z", "y", "numpy", per_year=False).withColumn("px", F.col("px").cast("long"))


_WINDOW = "ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-25'"


@query(_theil(f"SELECT user_id, {_YEARS.format(a='min(ts) OVER (PARTITION BY user_id)', b='ts')} AS x, value AS y FROM events WHERE {_WINDOW}", "user_id", ci=True))
def centreline_trend(spark: SparkSession, d: str) -> DataFrame:
    own = filters.filter_ranges(read_table(spark, d, "events"), ts=(F.lit("2024-01-05").cast("timestamp_ntz"), F.lit("2024-01-25").cast("timestamp_ntz")))
    return robust.theil_sen(own.where("value is not null"), ["user_id"], "value", "ts", ci=True)


@query(_theil(f"SELECT event_type || '/' || user_id AS k, event_type, user_id, {_YEARS.format(a='min(ts) OVER (PARTITION BY event_type, user_id)', b='ts')} AS x, value AS y FROM events WHERE {_WINDOW}", "k", out="split_part(mid.k, '/', 1) AS event_type, split_part(mid.k, '/', 2)::BIGINT AS user_id"))
def spatial_trend(spark: SparkSession, d: str) -> DataFrame:
    own = filters.filter_ranges(read_table(spark, d, "events"), ts=(F.lit("2024-01-05").cast("timestamp_ntz"), F.lit("2024-01-25").cast("timestamp_ntz")))
    return robust.theil_sen(own, ["event_type", "user_id"], "value", "ts")


@query(_theil(f"SELECT l_suppkey, {_YEARS.format(a='min(m) OVER (PARTITION BY l_suppkey)', b='m')} AS x, y FROM (SELECT l_suppkey, date_trunc('month', l_shipdate)::TIMESTAMP AS m, median(l_extendedprice) AS y FROM lineitem GROUP BY ALL)", "l_suppkey"))
def theil_sen_binned(spark: SparkSession, d: str) -> DataFrame:
    return robust.theil_sen(robust.binned(read_table(spark, d, "lineitem"), ["l_suppkey"], "l_extendedprice", "l_shipdate"), ["l_suppkey"], "l_extendedprice", "l_shipdate")


@query(f"""
    WITH a AS (SELECT l_suppkey, year(l_shipdate) AS x, median(l_extendedprice) AS y, count(*) AS n FROM lineitem GROUP BY ALL),
    t AS ({_theil("SELECT l_suppkey, x::DOUBLE AS x, y FROM (SELECT l_suppkey, year(l_shipdate) AS x, median(l_extendedprice) AS y FROM lineitem GROUP BY ALL)", "l_suppkey")})
    SELECT l_suppkey, round(slope, 6) AS slope, round(intercept, 4) AS intercept, counts FROM t JOIN (SELECT l_suppkey, string_agg(x || '=' || n, ',' ORDER BY x) AS counts FROM a GROUP BY 1) USING (l_suppkey)""")
def trend_year_counts(spark: SparkSession, d: str) -> DataFrame:
    """The trend of annual medians, and beside it how many rows each year has."""
    out = robust.trend_with_counts(read_table(spark, d, "lineitem"), ["l_suppkey"], "l_extendedprice", "l_shipdate")
    return out.select("l_suppkey", F.round("slope", 6).alias("slope"), F.round("intercept", 4).alias("intercept"), "counts")


@query("SELECT event_type, median(value) AS med, round(1.4826 * mad(value), 9) AS nmad FROM events GROUP BY event_type")
def nmad(spark: SparkSession, d: str) -> DataFrame:
    return robust.nmad(read_table(spark, d, "events"), ["event_type"], "value", large=True).withColumn("nmad", F.round("nmad", 9))


@query("SELECT user_id, median(value) AS med, mad(value) AS mad FROM events GROUP BY user_id")
def mad_by_group(spark: SparkSession, d: str) -> DataFrame:
    return filters.mad_bounds(read_table(spark, d, "events"), ["user_id"], "value")


_CELLS = "(SELECT vec_id AS y, unnest(range(len(embedding)))::INT AS x, unnest(embedding)::DOUBLE AS z, label FROM embeddings)"


@query(f"""
    WITH c AS {_CELLS}, ref AS (SELECT x, z FROM c WHERE y = 0),
    diff AS (SELECT c.y, r.z - c.z AS d FROM c JOIN ref r USING (x) WHERE c.y > 0 AND c.x % 2 = 0)
    SELECT y, round(median(d), 9) AS med, round(1.4826 * mad(d), 9) AS nmad FROM diff GROUP BY y""")
def coreg_stats(spark: SparkSession, d: str) -> DataFrame:
    cells = grid.cells_of(read_table(spark, d, "embeddings"), "vec_id", "embedding")
    out = robust.difference_stats(cells.where("y = 0"), cells.where("y > 0"), ["x"], "z", ["y"], F.col("x") % 2 == 0)
    return out.select("y", F.round("med", 9).alias("med"), F.round("nmad", 9).alias("nmad"))


@query("""
    SELECT l_suppkey, year(l_shipdate)::INT AS year, round(median(l_extendedprice), 6) AS med, round(median(l_extendedprice) + 1.4826 * mad(l_extendedprice), 6) AS y1,
        round(median(l_extendedprice) - 1.4826 * mad(l_extendedprice), 6) AS y2 FROM lineitem GROUP BY ALL""")
def annual_profile(spark: SparkSession, d: str) -> DataFrame:
    own = read_table(spark, d, "lineitem").select("l_suppkey", F.year("l_shipdate").alias("year"), "l_extendedprice")
    out = robust.profile(own, ["l_suppkey", "year"], "l_extendedprice")
    return out.select("l_suppkey", "year", *[F.round(c, 6).alias(c) for c in ("med", "y1", "y2")])


@query(f"SELECT user_id, unnest(['slope', 'intercept']) AS result, unnest([slope, intercept]) AS sec FROM ({_theil(_USERS, 'user_id')})")
def trend_results(spark: SparkSession, d: str) -> DataFrame:
    return robust.flatten_results(theil_sen(spark, d), ["user_id"])


# filters

_PAIRS = "SELECT l_orderkey, l_linenumber, l_partkey, o_orderdate, l_shipdate, l_quantity, date_diff('microsecond', o_orderdate, l_shipdate) / 86400000000.0 AS date_dt FROM lineitem JOIN orders ON l_orderkey = o_orderkey"


def _image_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Two dates and the days between them: each line's ship date after its order."""
    orders = read_table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    lines = read_table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate", "l_quantity")
    return lines.join(orders, "l_orderkey").select("l_orderkey", "l_linenumber", "l_partkey", "o_orderdate", "l_shipdate", "l_quantity", days_between("o_orderdate", "l_shipdate").alias("date_dt"))


@query(f"SELECT * FROM ({_PAIRS}) WHERE date_dt >= 30 AND date_dt < 60")
def range_filter_halfopen(spark: SparkSession, d: str) -> DataFrame:
    return filters.filter_ranges(_image_pairs(spark, d), date_dt=(30, 60))


@query(f"SELECT * FROM ({_PAIRS}) WHERE date_dt BETWEEN 30 AND 60")
def range_filter_closed(spark: SparkSession, d: str) -> DataFrame:
    return _image_pairs(spark, d).where(F.col("date_dt").between(30, 60))


@query(f"SELECT * FROM ({_PAIRS}) WHERE date_dt >= 335 AND date_dt < 395 AND l_shipdate >= TIMESTAMP '1997-01-01' AND l_shipdate < TIMESTAMP '1999-01-01'")
def filter_middate_datedt(spark: SparkSession, d: str) -> DataFrame:
    return filters.filter_ranges(_image_pairs(spark, d), date_dt=(335, 395), l_shipdate=(F.lit("1997-01-01").cast("timestamp_ntz"), F.lit("1999-01-01").cast("timestamp_ntz")))


_MAD = "SELECT event_id, event_type, value, median(value) OVER (PARTITION BY event_type) AS m FROM events"
_MAD = f"SELECT *, median(abs(value - m)) OVER (PARTITION BY event_type) AS mad FROM ({_MAD})"


@query(f"SELECT event_id, event_type, CASE WHEN value - m < 5 * mad THEN value END AS value FROM ({_MAD})")
def mad_filter_null(spark: SparkSession, d: str) -> DataFrame:
    return filters.mad_filter(read_table(spark, d, "events").select("event_id", "event_type", "value"), ["event_type"], "value", large=True)


@query(f"SELECT event_id, event_type, value FROM ({_MAD}) WHERE value - m < 5 * mad")
def mad_filter_drop(spark: SparkSession, d: str) -> DataFrame:
    return filters.mad_filter(read_table(spark, d, "events").select("event_id", "event_type", "value"), ["event_type"], "value", drop=True, large=True)


@query("""
    WITH m AS (SELECT l_suppkey, l_quantity AS vx, l_discount * 500 AS vy, median(l_quantity) OVER w AS mx, median(l_discount * 500) OVER w AS my FROM lineitem WINDOW w AS (PARTITION BY l_suppkey)),
    d AS (SELECT *, median(abs(vx - mx)) OVER w AS dx, median(abs(vy - my)) OVER w AS dy FROM m WINDOW w AS (PARTITION BY l_suppkey)),
    f AS (SELECT l_suppkey, CASE WHEN vx - mx < 1.5 * dx THEN vx END AS vx, CASE WHEN vy - my < 1.5 * dy THEN vy END AS vy FROM d)
    SELECT l_suppkey, count(vx) AS n_vx, count(vy) AS n_vy, count(vx + vy) AS n_v, round(median(sqrt(vx * vx + vy * vy)), 6) AS v FROM f GROUP BY l_suppkey""")
def filter_v_components(spark: SparkSession, d: str) -> DataFrame:
    own = read_table(spark, d, "lineitem").select("l_suppkey", F.col("l_quantity").alias("vx"), (F.col("l_discount") * 500).alias("vy"))
    out = filters.filter_components(own, ["l_suppkey"], "vx", "vy", 1.5)
    return out.groupBy("l_suppkey").agg(F.count("vx").alias("n_vx"), F.count("vy").alias("n_vy"), F.count("v").alias("n_v"), F.round(F.median("v"), 6).alias("v"))


_WANTED = "date_dt >= 10 AND date_dt < 90 AND l_shipdate >= TIMESTAMP '1993-01-01' AND l_shipdate < TIMESTAMP '1998-01-01'"


def _velocities(spark: SparkSession, d: str) -> DataFrame:
    """Image pairs with two components and a speed, which is null for a tenth of the rows."""
    orders = read_table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    lines = read_table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_shipdate", F.col("l_quantity").alias("vx"), (F.col("l_discount") * 500).alias("vy"))
    own = lines.join(orders, "l_orderkey").withColumn("date_dt", days_between("o_orderdate", "l_shipdate"))
    return own.withColumn("v", F.when(F.col("vy") != 50, F.hypot("vx", "vy"))).select("l_orderkey", "l_linenumber", "l_suppkey", "l_shipdate", "date_dt", "vx", "vy", "v")


_VELOCITIES = "SELECT l_orderkey, l_linenumber, l_suppkey, l_shipdate, l_quantity AS vx, l_discount * 500 AS vy, date_diff('microsecond', o_orderdate, l_shipdate) / 86400000000.0 AS date_dt FROM lineitem JOIN orders ON l_orderkey = o_orderkey"


def _years() -> dict:
    return {"date_dt": (10, 90), "l_shipdate": tuple(F.lit(t).cast("timestamp_ntz") for t in ("1993-01-01", "1998-01-01"))}


@query(f"""
    WITH m AS (SELECT *, median(vx) OVER w AS mx, median(vy) OVER w AS my FROM ({_VELOCITIES}) WHERE {_WANTED} WINDOW w AS (PARTITION BY l_suppkey)),
    d AS (SELECT *, median(abs(vx - mx)) OVER w AS dx, median(abs(vy - my)) OVER w AS dy FROM m WINDOW w AS (PARTITION BY l_suppkey)),
    f AS (SELECT l_orderkey, l_linenumber, l_suppkey, CASE WHEN vx - mx < 1.5 * dx THEN vx END AS vx, CASE WHEN vy - my < 1.5 * dy THEN vy END AS vy FROM d)
    SELECT l_orderkey, l_linenumber, l_suppkey, vx, vy, round(sqrt(vx * vx + vy * vy), 9) AS v FROM f""")
def filtered_velocities(spark: SparkSession, d: str) -> DataFrame:
    """Both ranges, then outliers of each component, row by row."""
    own, _ = filters.filter_velocities(_velocities(spark, d), ["l_suppkey"], "vx", "vy", 1.5, **_years())
    return own.select("l_orderkey", "l_linenumber", "l_suppkey", "vx", "vy", F.round("v", 9).alias("v"))


@query(f"SELECT l_orderkey, l_linenumber, round(sqrt(vx * vx + vy * vy), 9) AS v FROM ({_VELOCITIES}) WHERE {_WANTED} AND vy <> 50")
def filtered_line_samples(spark: SparkSession, d: str) -> DataFrame:
    """The samples along a line that the same filter leaves: in both ranges and not null."""
    _, line = filters.filter_velocities(_velocities(spark, d), ["l_suppkey"], "vx", "vy", 1.5, line=_velocities(spark, d), **_years())
    return line.select("l_orderkey", "l_linenumber", F.round("v", 9).alias("v"))


@query("""
    SELECT user_id, med, nmad FROM (SELECT user_id, round(median(value) - 100, 9) AS med, round(1.4826 * mad(value), 9) AS nmad FROM events GROUP BY user_id)
    WHERE nmad < 60 AND abs(med) < 70""")
def quality_gate(spark: SparkSession, d: str) -> DataFrame:
    s = robust.nmad(read_table(spark, d, "events"), ["user_id"], "value")
    return filters.quality_gate(s.select("user_id", F.round(F.col("med") - 100, 9).alias("med"), F.round("nmad", 9).alias("nmad")), "nmad", "med", 60, 70)


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_shipdate FROM lineitem WHERE month(l_shipdate) IN (6, 7, 8, 9)")
def month_filter(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "lineitem").where(F.month("l_shipdate").isin(6, 7, 8, 9)).select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate")


@query("""
    WITH b AS (SELECT event_type, round(quantile_cont(value, 0.05), 6) AS lo, round(quantile_cont(value, 0.95), 6) AS hi FROM events GROUP BY event_type)
    SELECT event_id, event_type, value FROM events JOIN b USING (event_type) WHERE value > lo AND value < hi""")
def trimmed_by_group(spark: SparkSession, d: str) -> DataFrame:
    return filters.trim_by_quantiles(read_table(spark, d, "events").select("event_id", "event_type", "value"), ["event_type"], "value", large=True)


@query("""
    SELECT o_orderkey, nullif(o_orderstatus, 'F') IS NULL AS is_reference, coalesce(nullif(o_orderstatus, 'F'), o_orderpriority) AS to_reg_status,
        coalesce(CASE WHEN o_orderstatus <> 'F' THEN o_orderdate END, TIMESTAMP '2000-01-01') AS to_reg_date FROM orders""")
def coalesce_reference(spark: SparkSession, d: str) -> DataFrame:
    o = read_table(spark, d, "orders").select(
        "o_orderkey", F.nullif("o_orderstatus", F.lit("F")).alias("to_reg_status"), F.when(F.col("o_orderstatus") != "F", F.col("o_orderdate")).alias("to_reg_date"),
        F.col("o_orderpriority").alias("ref_status"), F.lit("2000-01-01").cast("timestamp_ntz").alias("ref_date"),
    )
    return filters.coalesce_reference(o, ["status", "date"]).select("o_orderkey", "is_reference", "to_reg_status", "to_reg_date")


@query("SELECT o_custkey, o_orderkey, o_orderdate FROM orders WHERE o_orderstatus = 'O' QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1")
def first_per_group(spark: SparkSession, d: str) -> DataFrame:
    own = read_table(spark, d, "orders").where("o_orderstatus = 'O'").select("o_custkey", "o_orderkey", "o_orderdate")
    return filters.first_per_group(own, ["o_custkey"], ["o_orderkey"])


@query()
def piecewise_fit(spark: SparkSession, d: str) -> DataFrame:
    own = read_table(spark, d, "lineitem").groupBy("l_suppkey", F.year("l_shipdate").alias("year")).agg(F.median("l_extendedprice").alias("v"))
    return robust.piecewise_fit(own, ["l_suppkey"], "year", "v", 3)
