"""Cases worked out by hand."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from firnspark.functions import scalars as S
from firnspark.functions import student
from firnspark.operators import filters, grid, numeric, robust, stats


def trend(spark, xs, ys, **kw):
    df = spark.createDataFrame([(1, float(x), None if y is None else float(y)) for x, y in zip(xs, ys, strict=True)], "k int, x double, y double")
    return robust.theil_sen(df, ["k"], "y", "x", per_year=False, **kw).first()


@pytest.mark.parametrize("strategy", ["native", "numpy"])
def test_theil_sen(spark, strategy):
    assert trend(spark, [0, 1, 2, 3], [1, 3, 5, 7], strategy=strategy)[1:3] == (2.0, 1.0)
    assert trend(spark, [0, 1, 2, 3], [1, 3, 5, 100], strategy=strategy)["slope"] == 17.5
    tied = trend(spark, [0, 0, 1], [0, 2, 4], strategy=strategy)
    assert (tied["slope"], tied["intercept"]) == (3.0, 2.0)
    assert trend(spark, [1], [5], strategy=strategy)["slope"] is None
    assert trend(spark, [1, 2], [None, None], strategy=strategy)["slope"] is None


def test_interval_brackets_slope_and_strategies_agree(spark):
    rng = np.random.default_rng(0)
    x, y = rng.integers(0, 15, 40), rng.integers(0, 9, 40)
    a, b = (trend(spark, x, y, strategy=s, ci=True) for s in ("native", "numpy"))
    assert a["low_slope"] <= a["slope"] <= a["high_slope"]
    assert all(a[c] == b[c] for c in ("slope", "intercept", "low_slope", "high_slope", "n"))


def test_null_value_at_first_time_still_sets_the_start(spark):
    df = spark.sql("SELECT * FROM VALUES (1, TIMESTAMP_NTZ '2000-01-01', CAST(NULL AS DOUBLE)), (1, TIMESTAMP_NTZ '2000-12-31 06:00:00', 1.0D), (1, TIMESTAMP_NTZ '2001-12-31 12:00:00', 2.0D) AS t(k, t, y)")
    got = robust.theil_sen(df, ["k"], "y", "t").first()
    assert got["slope"] == pytest.approx(1) and got["intercept"] == pytest.approx(0)


def test_mad_filter(spark):
    keep = lambda v, **kw: sorted(r.v for r in filters.mad_filter(spark.createDataFrame([(1, float(x)) for x in v], "k int, v double"), ["k"], "v", drop=True, **kw).collect())
    assert keep([1, 2, 3, 4, 100]) == [1, 2, 3, 4]
    assert keep([-100, 2, 3, 4, 5])[0] == -100
    assert keep([-100, 2, 3, 4, 5], two_sided=True)[0] == 2
    assert keep([3, 3, 3, 3, 1, 9]) == [1]


def test_ranges_bins_and_names(spark):
    assert [r.d for r in filters.filter_ranges(spark.createDataFrame([(335,), (394,), (395,)], "d int"), d=(335, 395)).collect()] == [335, 394]
    df = spark.createDataFrame([(v,) for v in (37.5, 37.50001, 12.5, 1787.5, 1787.6)], "v double")
    assert [r[0] for r in df.select(S.cut_right_closed("v", 12.5, 1787.5, 25)).collect()] == [25, 50, None, 1775, None]
    row = spark.createDataFrame([(1, 2.5, -0.5)], "n int, x double, y double").select(S.site_dirname("n", F.col("x"), F.col("y"))).first()
    assert row[0] == "id1_2x_0y"


def test_rolling_windows(spark):
    df = spark.sql("SELECT * FROM VALUES (1, TIMESTAMP_NTZ '2024-01-01', 1.0D), (1, TIMESTAMP_NTZ '2024-01-06', 10.0D), (1, TIMESTAMP_NTZ '2024-01-11', 100.0D), (1, TIMESTAMP_NTZ '2024-01-16', 1000.0D) AS v(k, t, v)")
    got = lambda centred: [r.rolling for r in stats.rolling_median(df, ["k"], "t", "v", 10, centred).orderBy("t").collect()]
    assert got(True) == [5.5, 55.0, 550.0, 1000.0]
    assert got(False) == [1.0, 5.5, 55.0, 550.0]


def test_nmad_mode_and_gate(spark):
    df = spark.createDataFrame([(1, float(v)) for v in (1, 2, 3, 4, 100)], "k int, v double")
    assert robust.nmad(df, ["k"], "v").first()["nmad"] == pytest.approx(1.4826)
    assert stats.modal(spark.createDataFrame([(1, c) for c in (5, 5, 3, 3, 9)], "k int, c int"), ["k"], "c").first()["mode"] == 3


def test_lines_and_bilinear(spark):
    line = spark.createDataFrame([([(0.0, 0.0), (600.0, 0.0)],)], "line array<struct<x: double, y: double>>")
    got = grid.points_along(line, "line", 250.0).orderBy("step").collect()
    assert [(r.distance, r.px) for r in got] == [(0.0, 0.0), (0.25, 250.0), (0.5, 500.0), (0.6, 600.0)]
    cells = spark.range(5).select(F.col("id").alias("y"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("x")).withColumn("z", F.col("x") * 2.0 + F.col("y") * 3.0)
    points = spark.createDataFrame([(1, 0.5, 0.25), (2, 4.0, 4.0), (3, 4.1, 0.0), (4, 2.0, 3.0)], "k int, px double, py double")
    got = {r.k: r.z for r in grid.sample_bilinear(cells, points, "z", 4, 4).collect()}
    assert got == {1: 1.75, 2: 20.0, 3: None, 4: 13.0}


def test_stable_mask_without_data_is_zero(spark):
    df = spark.createDataFrame([(0, 0, None, 1.0), (0, 1, 1.0, 3.0)], "y int, x int, g double, n double")
    assert {(r.x, r.mask) for r in grid.stable_mask(df, "g", "n").collect()} == {(0, 0), (1, 1)}


def test_projection_round_trip(spark):
    df = spark.createDataFrame([(-45.0, 70.0), (10.0, 80.0), (-170.0, 62.5)], "lon double, lat double")
    x, y = S.polar_stereographic(F.col("lon"), F.col("lat"))
    lon, lat = S.polar_stereographic_inverse(F.col("x"), F.col("y"))
    for r in df.withColumns({"x": x, "y": y}).withColumns({"a": (lon + 540) % 360 - 180, "b": lat}).collect():
        assert r.a == pytest.approx(r.lon) and r.b == pytest.approx(r.lat)


def test_student():
    assert student.quantile(0.975, 10) == pytest.approx(2.2281388520, abs=1e-8)
    assert student.two_sided(2.2281388520, 10) == pytest.approx(0.05, abs=1e-9)
    assert student.two_sided(1.0, 0) is None


def test_shift_and_plane(spark):
    surface = lambda x, y: math.sin(x / 5) * 10 + math.cos(y / 7) * 8
    spots = [(y, x) for y in range(60) for x in range(60)]
    ref = spark.createDataFrame([(y, x, surface(x, y), 1) for y, x in spots], "y int, x int, z double, mask int")
    moves = {1: (0.6, -0.4, 2.0), 2: (-1.2, 0.8, -1.0), 3: (0.0, 0.0, 0.0)}
    others = [(k, y, x, surface(x - dx, y - dy) - dz) for k, (dx, dy, dz) in moves.items() for y, x in spots if k < 3 or (y, x) < (0, 2)]
    others = spark.createDataFrame([*others, (None, 1, 1, 1.0), (1, 70, 70, None)], "dem_id int, y int, x int, z double")
    got = {r.dem_id: r for r in numeric.coregister(ref, others).collect()}
    assert set(got) == {1, 2, 3} and (got[3].dx, got[3].dy, got[3].dz) == (0, 0, 0)
    for k in (1, 2):
        assert (got[k].dx, got[k].dy, got[k].dz) == tuple(pytest.approx(v, abs=0.05) for v in moves[k]) and got[k].n > 3000
    df = spark.createDataFrame([(float(x), float(y), 2.0 * x - 3.0 * y + 1) for x in range(4) for y in range(3)], "x double, y double, z double")
    got = numeric.plane_fit(df, [], "x", "y", "z").first()
    assert (got.a, got.b, got.c) == (pytest.approx(2), pytest.approx(-3), pytest.approx(1))


def test_piecewise_finds_the_bend():
    x = np.linspace(0, 10, 41)
    px, py, mse = robust.piecewise_knots(x, np.where(x < 4, x, 4 - (x - 4)), 2)
    assert mse < 1e-3 and px[1] == pytest.approx(4, abs=0.2)


def test_flow_line_follows_the_flow():
    u, v = np.ones((20, 20)), np.zeros((20, 20))
    xs, ys = [5.0], [5.0]
    assert numeric.trace(u, v, xs, ys, 1, 100)
    assert (xs[1], ys[1]) == (6.0, 5.0) and xs[-1] == 20.0 and math.isclose(ys[-1], 5.0)
    xs, ys = [5.0], [5.0]
    assert not numeric.trace(u[:, :9], v[:, :9], xs, ys, 1, 100, bounds=(0, 19, 0, 19)) and xs == [5.0, 6.0, 7.0, 8.0]


def test_flow_lines_do_not_depend_on_the_squares(spark):
    field = spark.createDataFrame([(s, y, x, float(y - 14 + s), float(14 - x)) for s in (0, 1) for y in range(3, 30) for x in range(-5, 30) if (y, x) != (20, 20)], "site int, y int, x int, vx double, vy double")
    seeds = spark.createDataFrame([(0, 1, 14.5, 8.5), (0, 2, 20.0, 14.0), (0, 2, 20.0, 14.0), (1, 1, 0.2, 9.9), (1, 5, 99.0, 9.0), (1, 6, None, 2.0), (7, 1, 1.0, 1.0)], "site int, seed int, sx double, sy double")
    rows = lambda tile: sorted((r.site, r.seed, r.k, repr(r.px), repr(r.py)) for r in numeric.streamlines(field, seeds, steps=40, tile=tile).collect())
    whole = rows(1000)
    assert rows(8) == whole and {r[:2] for r in whole} == {(0, 1), (0, 2), (1, 1), (1, 5), (1, 6)}
    assert [r[2:] for r in whole if r[1] in (5, 6)] == [(0, "99.0", "9.0"), (0, "None", "2.0")]
    # steps along a circle lead outwards, from a radius of 5.5 to the cells beside the missing one, 7.1 to 9.9 away
    last = max(r for r in whole if r[:2] == (0, 1))
    assert last[2] < 40 and abs(float(last[3]) - 20) < 1 and abs(float(last[4]) - 20) < 1


def test_gap_filling_and_widened_kernel_by_brute_force(spark):
    z = {(y, x): (y * 7 + x * 3) % 11 + 0.5 for y in range(9) for x in range(10)}
    gone = {(y, x) for y, x in z if (y + 2 * x) % 4 == 0}
    cells = spark.createDataFrame([(0, y, x, None if (y, x) in gone else v) for (y, x), v in z.items()], "site int, y int, x int, z double")
    got = {(r.y, r.x): r.z for r in numeric.fill_gaps(cells, "z", ["site"], reach=3).collect()}
    for y, x in z:
        near = [(z[p], 1 / d) for p in z if p not in gone and 0 < (d := (p[0] - y) ** 2 + (p[1] - x) ** 2) <= 9]
        assert got[y, x] == (z[y, x] if (y, x) not in gone else pytest.approx(sum(v * w for v, w in near) / sum(w for _, w in near)))
    got = {(r.y, r.x): r.z for r in grid.triangle_resample(cells, 3, "z").collect()}
    assert set(got) == {(y, x) for y in range(3) for x in range(4)}
    for y, x in got:
        w = {p: max(0, 1 - abs((p[0] + 0.5) / 3 - 0.5 - y)) * max(0, 1 - abs((p[1] + 0.5) / 3 - 0.5 - x)) for p in z if p not in gone}
        assert got[y, x] == pytest.approx(sum(z[p] * v for p, v in w.items()) / sum(w.values()))


def test_nearest_place_searches_wider(spark):
    p = spark.createDataFrame([(1, 0.0, 0.0), (2, 9.0, 9.0)], "k int, px double, py double")
    q = spark.createDataFrame([(7, 0.0, 5.0), (8, 5.0, 0.0)], "place int, qx double, qy double")
    got = sorted((r.k, r.place) for r in grid.nearest_place(p, q, "k", 0.5).collect())
    assert got == [(1, 7), (1, 8), (2, 7), (2, 8)]


def test_lines_against_polygons(spark):
    from firnspark.operators import shapes

    square = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]
    rings = spark.createDataFrame([(1, square), (2, [(10.0, 10.0), (12.0, 10.0), (11.0, 12.0)]), (3, None)], "poly int, ring array<struct<x: double, y: double>>")
    cases = {
        "inside": ([(1.0, 1.0), (2.0, 2.0)], {1}), "through": ([(-1.0, 2.0), (5.0, 2.0)], {1}), "touches a corner": ([(-1.0, 1.0), (1.0, -1.0)], {1}), "along an edge": ([(1.0, 4.0), (9.0, 4.0)], {1}),
        "past": ([(5.0, 0.0), (5.0, 9.0)], {None}), "both": ([(2.0, 2.0), (11.0, 11.0)], {1, 2}), "box only": ([(9.9, 11.5), (10.2, 11.9)], {None}), "none": (None, {None}), "a point": ([(4.0, 4.0)], {1}),
    }
    lines = spark.createDataFrame([(k, v[0]) for k, v in cases.items()], "name string, line array<struct<x: double, y: double>>")
    for size in (0.7, 50.0):
        got = shapes.lines_with_polygons(lines, rings, "name", "poly", size).collect()
        assert {k: {r.poly for r in got if r.name == k} for k in cases} == {k: v[1] for k, v in cases.items()} and len(got) == 10
    assert {r.poly for r in shapes.polygons_met(rings, lines, "poly", "name", 1.0).collect()} == {1, 2}


def test_piecewise_fit_finds_the_bend(spark):
    from firnspark.operators import robust

    rows = [(1, float(x), float(abs(x - 20))) for x in range(41)]
    knots = robust.piecewise_fit(spark.createDataFrame(rows, "k int, x double, y double"), ["k"], "x", "y", most=3).orderBy("px").collect()
    assert any(abs(r.px - 20) < 1 and abs(r.py) < 1 for r in knots) and knots[0].px == 0 and knots[-1].px == 40


def test_places_in_ranges(spark):
    from firnspark.operators import shapes

    df = spark.range(5000).selectExpr("id", "if(id % 97 = 0, null, (id * 7919) % 500) AS v")
    got = {r.id: r.place for r in shapes.sorted_places(df, F.col("v"), [F.col("id")], "place").collect()}
    want = sorted(range(5000), key=lambda k: (k % 97 != 0, -1 if k % 97 == 0 else (k * 7919) % 500, k))
    assert [got[k] for k in want] == list(range(1, 5001))
    assert shapes.sorted_places(df.limit(0), F.col("v"), [F.col("id")], "place").count() == 0


def test_density_curve_is_near_the_plain_sum(spark):
    rng = np.random.default_rng(2)
    groups = {1: rng.normal(0, 1, 80), 2: rng.normal(1, 0.5, 50), 3: np.ones(4)}
    df = spark.createDataFrame([(k, float(v)) for k, vs in groups.items() for v in vs] + [(1, None)], "k int, v double")
    got = stats.density_curve(df, ["k"], "v", -6.0, 6.0, 60).collect()
    assert {r.k for r in got} == {1, 2} and len(got) == 120
    for r in got:
        v = groups[r.k]
        h = v.std(ddof=1) * len(v) ** -0.2
        assert r.density == pytest.approx(np.exp(-(((r.x - v) / h) ** 2) / 2).sum() / (len(v) * h * math.sqrt(2 * math.pi)), abs=0.02)


def test_random_points(spark):
    df = spark.createDataFrame([(float(k), float(1000 + k)) for k in range(40)] + [(7.0, 1007.0)] * 40, "x double, y double").repartition(5)
    one, deep = (numeric.random_points(df, "x", "y", 1500, seed=3, leaf=leaf).orderBy("xy").collect() for leaf in (10**9, 3))
    assert one == deep and len(one) == 1500 and [r.xy for r in one] == list(range(1500))
    assert numeric.random_points(df.repartition(2), "x", "y", 1500, seed=3).orderBy("xy").collect() == one
    assert numeric.random_points(df, "x", "y", 1500, seed=4).orderBy("xy").collect() != one
    px, py = np.array([r.px for r in one]), np.array([r.py for r in one])
    for v in (px, py - 1000):
        share = np.bincount(v.astype(int), minlength=40) / 1500
        assert abs(share[7] - 41 / 80) < 0.05 and (np.delete(share, 7) > 0).all() and np.delete(share, 7).max() < 0.03
    assert abs(np.corrcoef(px == 7, py == 1007)[0, 1]) < 0.1  # drawn by themselves
    assert numeric.random_points(df.limit(0), "x", "y", 5).count() == 0


def test_piecewise_lines_of_many_groups_at_once():
    rng = np.random.default_rng(2)
    x = np.sort(rng.uniform(0, 9, (40, 7)), axis=1)
    y = np.concatenate([rng.normal(0, 1, (20, 7)), np.abs(x[20:39] - 4), np.zeros((1, 7))])
    for count in (1, 2, 3):
        px, py, mse = robust.piecewise_knots_abreast(x, y, count)
        for k in (0, 7, 20, 33, 39):
            one = robust.piecewise_knots(x[k], y[k], count)
            assert (one[0] == px[k]).all() and (one[1] == py[k]).all() and one[2] == mse[k]
            assert mse[k] == pytest.approx(((np.interp(x[k], px[k], py[k]) - y[k]) ** 2).mean(), abs=1e-15)
    assert (mse[20:] < 0.05).all()
