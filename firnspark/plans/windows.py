"""Ordered rows: differences, events and rolling medians."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import filters, stats
from ..operators.shapes import sorted_places
from ..sources.tables import read_table
from .registry import query


@query("SELECT event_id, user_id, value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS delta FROM events")
def first_difference(spark: SparkSession, d: str) -> DataFrame:
    return stats.first_difference(read_table(spark, d, "events"), ["user_id"], ["ts", "event_id"], "value").select("event_id", "user_id", "delta")


@query("""
    WITH m AS (SELECT l_suppkey, date_trunc('month', l_shipdate)::TIMESTAMP AS t, median(l_extendedprice) AS v FROM lineitem GROUP BY ALL),
    d AS (SELECT l_suppkey, t, year(t)::INT AS year, v - lag(v) OVER (PARTITION BY l_suppkey ORDER BY t) AS delta FROM m),
    g AS (SELECT l_suppkey, year, arg_min(t, (delta, t)) FILTER (WHERE month(t) <= 7 AND delta IS NOT NULL) AS a, arg_min(t, (delta, t)) FILTER (WHERE month(t) > 7 AND delta IS NOT NULL) AS b FROM d GROUP BY ALL)
    SELECT l_suppkey, year, dayofyear(a)::INT AS thaw_doy, dayofyear(b)::INT AS freeze_doy FROM g WHERE a IS NOT NULL AND b IS NOT NULL""")
def futo_events(spark: SparkSession, d: str) -> DataFrame:
    m = read_table(spark, d, "lineitem").groupBy("l_suppkey", F.date_trunc("month", "l_shipdate").cast("timestamp_ntz").alias("t")).agg(F.median("l_extendedprice").alias("v"))
    return stats.steepest_falls(m, ["l_suppkey"], "t", "v")


@query("""
    SELECT event_id, CASE WHEN count(value) OVER w >= 3 THEN quantile_cont(value, 0.5) OVER w END AS rolling FROM events
    WINDOW w AS (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL 215999999999 MICROSECOND PRECEDING AND INTERVAL 216000000000 MICROSECOND FOLLOWING)""")
def rolling_median_centred(spark: SparkSession, d: str) -> DataFrame:
    return stats.rolling_median(read_table(spark, d, "events").select("event_id", "event_type", "ts", "value"), ["event_type"], "ts", "value", 5, True, 3, large=True).select("event_id", "rolling")


@query("""
    SELECT event_id, quantile_cont(value, 0.5) OVER (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL 431999999999 MICROSECOND PRECEDING AND CURRENT ROW) AS rolling FROM events""")
def rolling_median_trailing(spark: SparkSession, d: str) -> DataFrame:
    return stats.rolling_median(read_table(spark, d, "events").select("event_id", "event_type", "ts", "value"), ["event_type"], "ts", "value", 5, False, large=True).select("event_id", "rolling")


@query("""
    SELECT event_id, CASE WHEN count(value) OVER w >= 5 THEN quantile_cont(value, 0.5) OVER w END AS rolling FROM events
    WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 907199999999 MICROSECOND PRECEDING AND INTERVAL 907200000000 MICROSECOND FOLLOWING)""")
def rolling_median_line(spark: SparkSession, d: str) -> DataFrame:
    return stats.rolling_median(read_table(spark, d, "events"), ["user_id"], "ts", "value", 21, True, 5).select("event_id", "rolling")


_MONTH = "ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-28'"
_ROLL = """
    o AS (SELECT target, event_id, value, ts, median(value) OVER (PARTITION BY target) AS md FROM e),
    f AS (SELECT *, median(abs(value - md)) OVER (PARTITION BY target) AS mad FROM o)
    SELECT target, event_id, CASE WHEN count(value) OVER w >= 5 THEN quantile_cont(value, 0.5) OVER w END AS rolling FROM f WHERE value - md < 2 * mad"""


def _series(spark: SparkSession, d: str, targets: list[float] | None, centred: bool) -> DataFrame:
    month = tuple(F.lit(t).cast("timestamp_ntz") for t in ("2024-01-03", "2024-01-28"))
    own = filters.line_series(read_table(spark, d, "events").select("event_id", "ts", "user_id", "value"), "value", "user_id", "ts", targets, 2, ts=month)
    return stats.rolling_median(own, ["target"], "ts", "value", 21, centred, 5).select("target", "event_id", "rolling")


@query(f"""
    WITH s AS (SELECT * FROM events WHERE {_MONTH}), v AS (SELECT unnest([3.0, 7.4, 1000000.0]) AS target),
    n AS (SELECT target::DOUBLE AS target, (SELECT arg_min(user_id, (abs(user_id - target), user_id)) FROM (SELECT DISTINCT user_id FROM s)) AS user_id FROM v),
    e AS (SELECT target, event_id, ts, value FROM n JOIN s USING (user_id)), {_ROLL}
    WINDOW w AS (PARTITION BY target ORDER BY ts RANGE BETWEEN INTERVAL 907199999999 MICROSECOND PRECEDING AND INTERVAL 907200000000 MICROSECOND FOLLOWING)""")
def rolling_at_places(spark: SparkSession, d: str) -> DataFrame:
    """Range, the places nearest to some, outliers, and then the centred rolling median of each."""
    return _series(spark, d, [3.0, 7.4, 1e6], True)


@query(f"""
    WITH s AS (SELECT * FROM events WHERE {_MONTH}),
    top AS (SELECT ts::DATE AS day, arg_max(user_id, (value, -user_id)) AS user_id FROM s GROUP BY 1),
    m AS (SELECT user_id FROM top GROUP BY user_id ORDER BY count(*) DESC, user_id LIMIT 1),
    e AS (SELECT user_id::DOUBLE AS target, event_id, ts, value FROM s JOIN m USING (user_id)), {_ROLL}
    WINDOW w AS (PARTITION BY target ORDER BY ts RANGE BETWEEN INTERVAL 1814399999999 MICROSECOND PRECEDING AND CURRENT ROW)""")
def rolling_at_peak(spark: SparkSession, d: str) -> DataFrame:
    """The same for the place that is fastest on most days, with a trailing window."""
    return _series(spark, d, None, False)


@query("""
    WITH y AS (SELECT l_suppkey, year(l_shipdate)::INT AS year, median(l_extendedprice) AS v FROM lineitem GROUP BY ALL)
    SELECT l_suppkey, year, v * 100 / first_value(v) OVER (PARTITION BY l_suppkey ORDER BY year) AS pct FROM y""")
def pct_of_first(spark: SparkSession, d: str) -> DataFrame:
    y = read_table(spark, d, "lineitem").groupBy("l_suppkey", F.year("l_shipdate").alias("year")).agg(F.median("l_extendedprice").alias("v"))
    return stats.share_of_first(y, ["l_suppkey"], ["year"], "v").select("l_suppkey", "year", "pct")


@query("""
    SELECT vec_id, round(gap, 9) AS gap FROM (SELECT vec_id, sqrt((lead(x, 2) OVER w - x) ** 2 + (lead(y, 2) OVER w - y) ** 2) AS gap
        FROM (SELECT vec_id, label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings) WINDOW w AS (PARTITION BY label ORDER BY vec_id)) WHERE gap > 0.2""")
def fix_stream(spark: SparkSession, d: str) -> DataFrame:
    p = read_table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    return stats.keep_spaced(p, ["label"], ["vec_id"], "x", "y", 0.2).select("vec_id", F.round("gap", 9).alias("gap"))


@query("SELECT user_id, event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS seen FROM events")
def running_count(spark: SparkSession, d: str) -> DataFrame:
    return stats.running_sum(read_table(spark, d, "events").withColumn("one", F.lit(1).cast("long")), ["user_id"], ["ts", "event_id"], "one", "seen").select("user_id", "event_id", "seen")


@query("""
    WITH s AS (SELECT event_id, ts, value FROM events WHERE event_type = 'click' UNION ALL SELECT event_id, ts, value FROM events WHERE event_type = 'view')
    SELECT event_id, row_number() OVER (ORDER BY ts, event_id)::INT AS place FROM s""")
def stack_sort(spark: SparkSession, d: str) -> DataFrame:
    e = read_table(spark, d, "events").select("event_id", "ts", "event_type")
    s = e.where("event_type = 'click'").unionByName(e.where("event_type = 'view'"))
    micros = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("ts"))
    return sorted_places(s, micros, [F.col("event_id")], "place").select("event_id", "place")
