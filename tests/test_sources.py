from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from firnspark.sources import sinks, tables
from firnspark.streaming import windows


def test_geojson_notes_and_grid(spark, tmp_path):
    (tmp_path / "id3_1x_2y_line.json").write_text(json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": {"type": "LineString", "coordinates": [[0, 1], [2, 3.5]]}, "properties": {"where": "west"}}]}))
    row = tables.read_geojson(spark, f"file://{tmp_path}/id3_1x_2y_line.json").withColumn("site", tables.site_of_path()).first()
    assert [(v.x, v.y) for v in row.line] == [(0.0, 1.0), (2.0, 3.5)] and row.properties["where"] == "west" and row.site == 3
    (tmp_path / "note.txt").write_text('{"centreline": "LINESTRING (0 0, 3 4)"}')
    note = tables.read_notes(spark, f"file://{tmp_path}/note.txt", "centreline").select(tables.parse_wkt("value").alias("l")).first()
    assert [(v.x, v.y) for v in note.l] == [(0.0, 0.0), (3.0, 4.0)]
    (tmp_path / "g.asc").write_text("ncols 2\nnrows 2\nxllcorner 0\nyllcorner 0\ncellsize 1\nNODATA_value -9999\n1 2\n-9999 4\n")
    assert {(r.y, r.x, r.z) for r in tables.read_ascii_grids(spark, f"file://{tmp_path}/g.asc").collect()} == {(0, 0, 1.0), (0, 1, 2.0), (1, 0, None), (1, 1, 4.0)}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "n int, site string")
    path = f"file://{tmp_path}/out"
    assert sinks.write_once(df, path) and not sinks.write_once(df.limit(0), path)
    assert spark.read.parquet(path).count() == 2
    sinks.write_with_meta(df, path, {"ids": [1, 2]})
    assert sinks.read_meta(path, spark) == {"ids": "[1, 2]"}
    sinks.write_by_site(df, f"{path}2")
    assert tables.exists(spark, f"{path}2/site=a")
    assert sinks.write_if_folder(df, f"file://{tmp_path}/none", "x") is not None
    site = tables.Site(spark, f"file://{tmp_path}", {"out": "out", "gone": "gone.parquet"})
    assert set(site.paths) == {"out"}
    with pytest.raises(AttributeError):
        site.gone  # noqa: B018


def test_stream_windows(spark, tmp_path):
    spark.sql("SELECT TIMESTAMP_NTZ '2024-01-01 00:10:00' AS ts, 1 AS k, 1.0D AS v UNION ALL SELECT TIMESTAMP_NTZ '2024-01-01 00:20:00', 1, 3.0D").write.parquet(f"{tmp_path}/in")
    s = windows.read_stream(spark, f"{tmp_path}/in", "ts timestamp_ntz, k int, v double")
    q = windows.windowed_quantiles(s, "ts", ["k"], "v").writeStream.format("memory").queryName("wq").outputMode("complete").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    row = spark.table("wq").first()
    assert row.n == 2 and row.quantiles[1] == 2.0


def test_nan_becomes_null(spark):
    df = spark.createDataFrame([(float("nan"), 1.0)], "a double, b double")
    assert tables.nan_to_null(df).select(F.isnull("a"), "b").first() == (True, 1.0)


def test_cube_reads_only_what_is_asked_for(spark, tmp_path):
    from firnspark.sources.sinks import write_cube
    from firnspark.sources.tables import read_cube

    cells = spark.range(4000).selectExpr("id % 5 AS cube_id", "timestamp_ntz'2019-06-01' + make_interval(int(id % 4)) AS time", "id % 50 AS y", "int(id % 40) AS x", "double(id) AS v")
    write_cube(cells, f"{tmp_path}/cubes")
    got = read_cube(spark, f"{tmp_path}/cubes", [1, 3], (2020, 2021), (0, 19, 10, 20))
    want = cells.where("cube_id in (1, 3) and year(time) between 2020 and 2021 and x between 0 and 19 and y between 10 and 20")
    assert sorted(r.v for r in got.collect()) == sorted(r.v for r in want.collect()) != []
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "cube_id" in plan.split("PartitionFilters: [")[1].split("]")[0] and "GreaterThanOrEqual(x,0)" in plan
    assert len({r.f for r in got.selectExpr("_metadata.file_path AS f").collect()}) <= 4


def test_write_once_and_geojson_and_csv(spark, tmp_path):
    from firnspark.sources.sinks import write_once
    from firnspark.sources.tables import read_old_metadata

    assert write_once(spark.range(3), f"{tmp_path}/once") and not write_once(spark.range(5), f"{tmp_path}/once") and spark.read.parquet(f"{tmp_path}/once").count() == 3
    (tmp_path / "old.csv").write_text("a,t\n1,2020-05-06 07:08:09\n2,\n")
    rows = read_old_metadata(spark, f"{tmp_path}/old.csv", "a int, t string", ("t",)).orderBy("a").collect()
    assert str(rows[0].t) == "2020-05-06 07:08:09" and rows[1].t is None


def scanned(df):
    """Rows that the scans of a query gave, from their metrics."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.executedPlan() if "Adaptive" in plan.getClass().getName() else plan
    leaves, total = plan.collectLeaves(), 0
    for k in range(leaves.size()):
        total += leaves.apply(k).metrics().apply("numOutputRows").value()
    return total


def test_items_along_a_curve_are_skipped(spark, tmp_path):
    items = spark.range(60_000).selectExpr("id", "sin(id * 12.9898) * 1000 AS x0", "sin(id * 78.233) * 1000 AS y0", "timestamp_ntz'2020-01-01' + make_dt_interval(0, 0, int(id * 7919 % 1000000)) AS time", "double(id * 31 % 100) AS cloud_cover")
    items = items.selectExpr("id", "x0", "x0 + 5 AS x1", "y0", "y0 + 5 AS y1", "time", "cloud_cover").unionByName(spark.sql("SELECT -1L AS id, CAST(NULL AS DOUBLE) AS x0, 0D AS x1, 0D AS y0, 0D AS y1, CAST(NULL AS TIMESTAMP_NTZ) AS time, 1D AS cloud_cover"))
    path = f"{tmp_path}/items"
    sinks.write_items(items, path, files=32, group_rows=500)
    held = spark.read.parquet(path)
    assert held.columns == [*items.columns, "time_us"] and held.count() == 60_001
    box, far = (300.0, 400.0, 300.0, 400.0), ("2020-06-01", "2020-09-01")
    for where, start, end, cloud in ((box, "2000-01-01", "2100-01-01", None), (box, *far, None), ((-2000.0, 2000.0, -2000.0, 2000.0), *far, 50.0)):
        got = tables.search_items(held, where, start, end, cloud)
        want = tables.search_items(items, where, start, end, cloud)
        assert sorted(r.id for r in got.collect()) == sorted(r.id for r in want.collect()) != []
    everywhere = scanned(tables.search_items(held, (-2000.0, 2000.0, -2000.0, 2000.0), "2000-01-01", "2100-01-01"))
    near, soon = scanned(tables.search_items(held, box, "2000-01-01", "2100-01-01")), scanned(tables.search_items(held, box, *far))
    assert everywhere > 59_000 and near < everywhere / 5 and soon < near / 1.5
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = tables.search_items(held, box, *far, 50.0)._jdf.queryExecution().executedPlan().toString()
    assert all(x in plan for x in ("LessThanOrEqual(x0,400.0)", "GreaterThanOrEqual(y1,300.0)", "LessThan(cloud_cover,50.0)")) and "GreaterThanOrEqual(time_us," in plan
    spark.conf.unset("spark.sql.maxMetadataStringLength")
