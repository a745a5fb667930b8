"""Composites, binned statistics, fitted lines, modes and histograms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import decibels
from ..operators import grid, stats
from ..sources.tables import read_table
from .registry import query

_QUARTILES = {"q25": 0.25, "q50": 0.5, "q75": 0.75}


@query("""
    SELECT l_suppkey, year(l_shipdate)::INT AS year, round(quantile_cont(l_extendedprice, 0.25), 6) AS q25, round(quantile_cont(l_extendedprice, 0.5), 6) AS q50,
        round(quantile_cont(l_extendedprice, 0.75), 6) AS q75, count(l_extendedprice) AS n FROM lineitem GROUP BY ALL""")
def annual_quantiles(spark: SparkSession, d: str) -> DataFrame:
    own = read_table(spark, d, "lineitem").select("l_suppkey", F.year("l_shipdate").alias("year"), "l_extendedprice")
    return stats.group_quantiles(own, ["l_suppkey", "year"], "l_extendedprice", _QUARTILES, "n", 6)


@query("""
    WITH o AS (SELECT * FROM lineitem WHERE month(l_shipdate) IN (7, 8)),
    m AS (SELECT l_linestatus AS s FROM o GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
    SELECT year(l_shipdate)::INT AS year, l_returnflag AS band, median(l_quantity) AS med FROM o WHERE l_linestatus = (SELECT s FROM m) GROUP BY ALL""")
def annual_median_mosaic(spark: SparkSession, d: str) -> DataFrame:
    own = read_table(spark, d, "lineitem").where(F.month("l_shipdate").isin(7, 8))
    most = stats.modal(own, [], "l_linestatus", "s")
    return own.join(F.broadcast(most), F.col("l_linestatus") == F.col("s")).groupBy(F.year("l_shipdate").alias("year"), F.col("l_returnflag").alias("band")).agg(F.median("l_quantity").alias("med"))


@query("""
    SELECT day, max(CASE WHEN event_type = 'click' THEN q05 END) AS click_q05, max(CASE WHEN event_type = 'click' THEN q5 END) AS click_q50, max(CASE WHEN event_type = 'click' THEN q95 END) AS click_q95,
        max(CASE WHEN event_type = 'view' THEN q05 END) AS view_q05, max(CASE WHEN event_type = 'view' THEN q5 END) AS view_q50, max(CASE WHEN event_type = 'view' THEN q95 END) AS view_q95
    FROM (SELECT ts::DATE AS day, event_type, round(quantile_cont(value, 0.05), 6) AS q05, round(quantile_cont(value, 0.5), 6) AS q5, round(quantile_cont(value, 0.95), 6) AS q95 FROM events GROUP BY ALL)
    WHERE event_type IN ('click', 'view') GROUP BY day""")
def backscatter_quantiles(spark: SparkSession, d: str) -> DataFrame:
    own = read_table(spark, d, "events").withColumn("day", F.to_date("ts"))
    return stats.pivot_quantiles(own, ["day"], "event_type", ["click", "view"], "value", {"q05": 0.05, "q50": 0.5, "q95": 0.95}, 6)


@query("SELECT event_id, round(CASE WHEN value > 0 THEN 10 * log10(value) END, 6) AS db FROM events")
def db_transform(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "events").select("event_id", F.round(decibels("value"), 6).alias("db"))


_BIN = "CASE WHEN value > 12.5 AND value <= 1787.5 THEN (12.5 + (ceil((value - 12.5) / 25) - 0.5) * 25)::INT END"


@query(f"""
    SELECT event_type, mid_bin, round(q25, 6) AS q25, med, round(q75, 6) AS q75, n, round(med - q25, 6) AS err_low, round(q75 - med, 6) AS err_high
    FROM (SELECT event_type, {_BIN} AS mid_bin, quantile_cont(value, 0.25) AS q25, median(value) AS med, quantile_cont(value, 0.75) AS q75, count(value) AS n FROM events WHERE {_BIN} IS NOT NULL GROUP BY ALL)""")
def binned_quartiles(spark: SparkSession, d: str) -> DataFrame:
    out = stats.binned_quartiles(read_table(spark, d, "events"), ["event_type"], "value", "value", 12.5, 1787.5, 25)
    return out.withColumns({c: F.round(c, 6) for c in ("q25", "q75", "err_low", "err_high")})


@query("SELECT n_regionkey, count(DISTINCT s_suppkey) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY GROUPING SETS ((n_regionkey), ())")
def distinct_ids(spark: SparkSession, d: str) -> DataFrame:
    nation = F.broadcast(read_table(spark, d, "nation").select("n_nationkey", "n_regionkey"))  # 25 rows at any size
    s = read_table(spark, d, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    return s.groupingSets([["n_regionkey"], []], "n_regionkey").agg(F.countDistinct("s_suppkey").alias("n"))


@query("SELECT round(avg(n), 6) AS mean_n, median(n) AS median_n, min(n) AS min_n, max(n) AS max_n FROM (SELECT o_custkey, count(DISTINCT o_orderkey) AS n FROM orders GROUP BY 1)")
def two_level_agg(spark: SparkSession, d: str) -> DataFrame:
    return stats.two_level(read_table(spark, d, "orders"), "o_custkey", "o_orderkey").withColumn("mean_n", F.round("mean_n", 6))


@query("SELECT o_custkey, mode FROM (SELECT o_custkey, o_orderpriority AS mode, count(*) AS n FROM orders GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, mode) = 1")
def mode_tie_smallest(spark: SparkSession, d: str) -> DataFrame:
    return stats.modal(read_table(spark, d, "orders"), ["o_custkey"], "o_orderpriority")


@query("SELECT year(l_shipdate)::INT AS year, count(*) FILTER (WHERE l_returnflag = 'A') AS A, count(*) FILTER (WHERE l_returnflag = 'N') AS N, count(*) FILTER (WHERE l_returnflag = 'R') AS R FROM lineitem GROUP BY 1")
def year_counts(spark: SparkSession, d: str) -> DataFrame:
    out = read_table(spark, d, "lineitem").groupBy(F.year("l_shipdate").alias("year")).pivot("l_returnflag", ["A", "N", "R"]).count()
    return out.na.fill(0, ["A", "N", "R"])


@query("""
    WITH top AS (SELECT ts::DATE AS day, arg_max(user_id, (value, -user_id)) AS user_id FROM events GROUP BY 1)
    SELECT user_id FROM top GROUP BY user_id ORDER BY count(*) DESC, user_id LIMIT 1""")
def modal_argmax(spark: SparkSession, d: str) -> DataFrame:
    return stats.modal_argmax(read_table(spark, d, "events"), F.to_date("ts"), "user_id", "value")


@query("SELECT event_type, user_id, n, rank() OVER (PARTITION BY event_type ORDER BY n DESC)::INT AS place FROM (SELECT event_type, user_id, count(*) AS n FROM events GROUP BY ALL)")
def value_counts(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    n = read_table(spark, d, "events").groupBy("event_type", "user_id").agg(F.count("*").alias("n"))
    return n.withColumn("place", F.rank().over(Window.partitionBy("event_type").orderBy(F.desc("n"))))


@query("""
    SELECT l_suppkey, count(*) AS n, round(regr_slope(l_extendedprice, l_quantity), 6) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(corr(l_extendedprice, l_quantity), 6) AS r,
        round(sqrt((1 - corr(l_extendedprice, l_quantity) ** 2) * regr_syy(l_extendedprice, l_quantity) / regr_sxx(l_extendedprice, l_quantity) / (count(*) - 2)), 6) AS stderr
    FROM lineitem GROUP BY l_suppkey""")
def linregress_group(spark: SparkSession, d: str) -> DataFrame:
    out = stats.linear_fit(read_table(spark, d, "lineitem"), ["l_suppkey"], "l_quantity", "l_extendedprice")
    return out.select("l_suppkey", "n", *[F.round(c, k).alias(c) for c, k in (("slope", 6), ("intercept", 4), ("r", 6), ("stderr", 6))])


@query()
def ols_ci(spark: SparkSession, d: str) -> DataFrame:
    own = read_table(spark, d, "events").select("event_type", F.hour("ts").alias("x"), "value")
    fits = stats.linear_fit(own, ["event_type"], "x", "value")
    return stats.fitted_interval(stats.with_p_values(fits), own.select("event_type", "x").distinct(), ["event_type"])


@query("SELECT l_suppkey, round(regr_slope(v, year), 6) AS trend FROM (SELECT l_suppkey, year(l_shipdate)::DOUBLE AS year, median(l_extendedprice) AS v FROM lineitem GROUP BY ALL) GROUP BY l_suppkey")
def polyfit_trend(spark: SparkSession, d: str) -> DataFrame:
    annual = read_table(spark, d, "lineitem").groupBy("l_suppkey", F.year("l_shipdate").alias("year")).agg(F.median("l_extendedprice").alias("v"))
    return stats.linear_fit(annual, ["l_suppkey"], "year", "v").select("l_suppkey", F.round("slope", 6).alias("trend"))


@query("SELECT bin FROM (SELECT floor(l_extendedprice / 2000)::BIGINT AS bin, l_returnflag FROM lineitem) GROUP BY bin HAVING count(DISTINCT l_returnflag) = (SELECT count(DISTINCT l_returnflag) FROM lineitem)")
def common_bins(spark: SparkSession, d: str) -> DataFrame:
    own = read_table(spark, d, "lineitem").select(F.floor(F.col("l_extendedprice") / 2000).alias("bin"), "l_returnflag")
    return stats.common_values(own, "l_returnflag", "bin")


@query("SELECT event_type, floor(value / 0.5) * 0.5 AS bin_low, count(*) AS n FROM events WHERE value >= 0 AND value < 500 GROUP BY ALL")
def fixed_histogram(spark: SparkSession, d: str) -> DataFrame:
    return stats.histogram(read_table(spark, d, "events"), ["event_type"], "value", 0.0, 0.5, 500.0)


@query("SELECT floor((x + 0.5) / (1.0 / 30))::BIGINT AS ix, floor((y + 0.5) / (1.0 / 30))::BIGINT AS iy, count(*) AS n FROM (SELECT embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings) WHERE x >= -0.5 AND x < 0.5 AND y >= -0.5 AND y < 0.5 GROUP BY ALL")
def density_2d(spark: SparkSession, d: str) -> DataFrame:
    own = read_table(spark, d, "embeddings").select(F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    return stats.density_2d(own, "x", "y", (-0.5, 0.5, -0.5, 0.5), 30)


@query("""
    WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS q1, median(value) AS med, quantile_cont(value, 0.75) AS q3 FROM events GROUP BY 1)
    SELECT event_type, round(q1, 6) AS q1, med, round(q3, 6) AS q3, min(value) FILTER (WHERE ok) AS low, max(value) FILTER (WHERE ok) AS high, count(*) FILTER (WHERE NOT ok) AS fliers
    FROM (SELECT q.*, value, value >= q1 - (q3 - q1) * 1.5 AND value <= q3 + (q3 - q1) * 1.5 AS ok FROM events JOIN q USING (event_type)) GROUP BY event_type, q1, med, q3""")
def box_stats(spark: SparkSession, d: str) -> DataFrame:
    out = stats.box_stats(read_table(spark, d, "events"), ["event_type"], "value", large=True)
    return out.withColumns({c: F.round(c, 6) for c in ("q1", "q3")})


@query("SELECT user_id, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd FROM events GROUP BY 1")
def mean_sd_profile(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "events").groupBy("user_id").agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_samp("value"), 6).alias("sd"))


@query("SELECT user_id, med, row_number() OVER (ORDER BY med DESC, user_id)::INT AS place FROM (SELECT user_id, median(value) AS med FROM events GROUP BY 1)")
def group_median_order(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.shapes import sorted_places

    med = read_table(spark, d, "events").groupBy("user_id").agg(F.median("value").alias("med"))
    return sorted_places(med, -F.col("med"), [F.col("user_id")], "place")


@query()
def density_curve(spark: SparkSession, d: str) -> DataFrame:
    return stats.density_curve(read_table(spark, d, "events"), ["event_type"], "value", 0.0, 500.0)


@query("SELECT label, min(embedding[1])::DOUBLE AS x0, max(embedding[1])::DOUBLE AS x1, min(embedding[2])::DOUBLE AS y0, max(embedding[2])::DOUBLE AS y1, count(*) AS n FROM embeddings GROUP BY label")
def dissolve_bbox(spark: SparkSession, d: str) -> DataFrame:
    own = read_table(spark, d, "embeddings").select("label", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    return grid.envelope(own, ["label"], "x", "y")


@query("SELECT min(ts) AS first_ts, max(ts) AS last_ts FROM events")
def mid_date_range(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "events").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query("SELECT user_id, string_agg(event_type || '=' || n, ',' ORDER BY event_type) AS counts FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) GROUP BY user_id")
def meta_map(spark: SparkSession, d: str) -> DataFrame:
    n = read_table(spark, d, "events").groupBy("user_id", "event_type").count()
    pairs = F.sort_array(F.collect_list(F.struct("event_type", "count")))
    return n.groupBy("user_id").agg(F.concat_ws(",", F.transform(pairs, lambda p: F.concat(p["event_type"], F.lit("="), p["count"]))).alias("counts"))
