"""Reshaping and column functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import grid
from ..sources.tables import read_catalog, read_table
from .registry import query


@query("SELECT l_suppkey, unnest(['dB_hh', 'dB_hv']) AS variable, unnest([q, p]) AS value FROM (SELECT l_suppkey, sum(l_quantity)::DOUBLE AS q, median(l_extendedprice) AS p FROM lineitem GROUP BY 1)")
def melt_bands(spark: SparkSession, d: str) -> DataFrame:
    g = read_table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.sum("l_quantity").cast("double").alias("dB_hh"), F.median("l_extendedprice").alias("dB_hv"))
    return g.unpivot("l_suppkey", ["dB_hh", "dB_hv"], "variable", "value")


@query("SELECT l_suppkey, median(l_quantity) FILTER (WHERE l_returnflag = 'A') AS A, median(l_quantity) FILTER (WHERE l_returnflag = 'N') AS N, median(l_quantity) FILTER (WHERE l_returnflag = 'R') AS R FROM lineitem GROUP BY 1")
def demote_coords(spark: SparkSession, d: str) -> DataFrame:
    g = read_table(spark, d, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.median("l_quantity").alias("v"))
    return grid.labels_to_columns(g, ["l_suppkey"], "l_returnflag", ["A", "N", "R"], "v")


@query("SELECT event_id, CASE WHEN value > 12.5 AND value <= 1787.5 THEN (12.5 + (ceil((value - 12.5) / 25) - 0.5) * 25)::INT END AS mid_bin FROM events")
def cut_right_closed(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "events").select("event_id", S.cut_right_closed("value", 12.5, 1787.5, 25).alias("mid_bin"))


@query("SELECT o_orderkey, year(o_orderdate)::INT AS y, month(o_orderdate)::INT AS m, dayofyear(o_orderdate)::INT AS doy, strftime(o_orderdate, '%Y-%m-%d') AS text FROM orders")
def date_parts(spark: SparkSession, d: str) -> DataFrame:
    t = "o_orderdate"
    return read_table(spark, d, "orders").select("o_orderkey", F.year(t).alias("y"), F.month(t).alias("m"), F.dayofyear(t).alias("doy"), F.date_format(t, "yyyy-MM-dd").alias("text"))


@query("SELECT event_id, round(date_diff('microsecond', min(ts) OVER (PARTITION BY user_id), ts) / 31557600000000.0, 9) AS years FROM events")
def years_since_first(spark: SparkSession, d: str) -> DataFrame:
    e = read_table(spark, d, "events").select("event_id", "user_id", "ts")
    first = e.groupBy("user_id").agg(F.min("ts").alias("t0"))
    return e.join(first, "user_id").select("event_id", F.round(S.years_between("t0", "ts"), 9).alias("years"))


@query("SELECT page_id, replace(replace(u, '.json', '_dem.tif'), '_dem', '_bitmask') AS bitmaskurl, replace(u, '.json', '_dem.tif') AS downloadurl FROM (SELECT page_id, url || '.json' AS u FROM pages)")
def url_rewrite(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "pages").select("page_id", F.concat("url", F.lit(".json")).alias("u")).select("page_id", *[c.alias(n) for n, c in S.sibling_urls("u").items()])


@query("SELECT p_partkey, split_part(v, '_', 1) AS head, upper(substr(t, 1, 1)) || lower(substr(t, 2)) AS tail FROM (SELECT p_partkey, v, split_part(v, '_', 2) AS t FROM (SELECT p_partkey, replace(p_name, ' ', '_') AS v FROM part))")
def split_variable(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "part").select("p_partkey", F.replace("p_name", F.lit(" "), F.lit("_")).alias("v")).select("p_partkey", *[c.alias(n) for n, c in S.split_label("v").items()])


@query("SELECT s_suppkey, CASE WHEN s_acctbal > 0 THEN 'north' WHEN s_acctbal < 0 THEN 'south' ELSE 'equator' END AS label FROM supplier")
def hemisphere_label(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "supplier").select("s_suppkey", S.hemisphere_label("s_acctbal").alias("label"))


@query("SELECT s_suppkey, (floor((s_suppkey * 7 % 360 - 180 + 180) / 6.0) + 1)::INT AS zone FROM supplier")
def utm_zone(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "supplier").select("s_suppkey", S.utm_zone(F.col("s_suppkey") * 7 % 360 - 180).alias("zone"))


@query("SELECT s_suppkey, 'id' || s_suppkey || '_' || round_even(s_acctbal, 0)::BIGINT || 'x_' || round_even(s_acctbal / 2, 0)::BIGINT || 'y' AS name FROM supplier")
def site_dirname(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "supplier").select("s_suppkey", S.site_dirname("s_suppkey", F.col("s_acctbal"), F.col("s_acctbal") / 2).alias("name"))


@query("SELECT o_orderkey, o_orderdate AS acqdate1, replace('s3://dem/' || o_orderkey || '.json', '.json', '_dem.tif') AS downloadurl FROM orders WHERE month(o_orderdate) IN (6, 7, 8, 9)")
def catalog_scan(spark: SparkSession, d: str) -> DataFrame:
    c = read_table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").alias("acqdate1"), F.concat(F.lit("s3://dem/"), "o_orderkey", F.lit(".json")).alias("s3url"))
    return read_catalog(c).select("o_orderkey", "acqdate1", "downloadurl")


_DOT = "list_sum(list_transform(range(1, len(embedding) + 1), lambda i: embedding[i]::DOUBLE * r[i]::DOUBLE))"
_LEN = "sqrt(list_sum(list_transform({v}, lambda v: v::DOUBLE * v::DOUBLE)))"


@query(f"SELECT vec_id, round({_DOT}, 9) AS dot, round({_LEN.format(v='embedding')}, 9) AS length, round(atan2(embedding[2]::DOUBLE, embedding[1]::DOUBLE), 9) AS bearing FROM embeddings, (SELECT embedding AS r FROM embeddings WHERE vec_id = 0)")
def vector_math(spark: SparkSession, d: str) -> DataFrame:
    e = read_table(spark, d, "embeddings")
    v = F.col("embedding")
    one = F.broadcast(e.where("vec_id = 0").select(v.alias("r")))  # one row
    return e.join(one).select("vec_id", F.round(S.dot(v, F.col("r")), 9).alias("dot"), F.round(S.length_of(v), 9).alias("length"), F.round(F.atan2(v[1].cast("double"), v[0].cast("double")), 9).alias("bearing"))


@query(f"SELECT vec_id, round(acos(least(1.0, greatest(-1.0, {_DOT} / ({_LEN.format(v='embedding')} * {_LEN.format(v='r')})))), 6) AS angle FROM embeddings, (SELECT embedding AS r FROM embeddings WHERE vec_id = 1) WHERE vec_id <> 1")
def angle_between(spark: SparkSession, d: str) -> DataFrame:
    e = read_table(spark, d, "embeddings")
    one = F.broadcast(e.where("vec_id = 1").select(F.col("embedding").alias("r")))  # one row
    return e.where("vec_id <> 1").join(one).select("vec_id", F.round(S.angle_between(F.col("embedding"), F.col("r")), 6).alias("angle"))


@query()
def reproject_points(spark: SparkSession, d: str) -> DataFrame:
    s = read_table(spark, d, "supplier").select("s_suppkey", (F.col("s_suppkey") % 90 - 90).cast("double").alias("lon"), (60 + F.col("s_suppkey") % 25).cast("double").alias("lat"))
    x, y = S.polar_stereographic(F.col("lon"), F.col("lat"))
    out = s.withColumns({"x": x, "y": y})
    lon, lat = S.polar_stereographic_inverse(F.col("x"), F.col("y"))
    return out.withColumns({"lon_back": lon, "lat_back": lat})
