"""Exact quantiles of large groups and medians by blocks of time, against Spark's own over whole groups."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import functions as F

from firnspark.operators import filters, quantiles, stats

QS = [0.0, 0.05, 0.25, 0.5, 0.9, 1.0]


def both(df, keys, cells):
    plain = df.groupBy(*keys).agg(F.percentile("v", QS).alias("q"), F.count("v").alias("n"))
    large = quantiles.large_group_quantiles(df, keys, "v", QS, cells)
    rows = lambda d: sorted(repr(([r[k] for k in keys], list(r.q) if r.q else [None] * len(QS), r.n)) for r in d.collect())
    return rows(large), rows(plain)


def test_large_group_quantiles(spark):
    rng = random.Random(3)
    rows = [("a", rng.gauss(0, 1)) for _ in range(3001)] + [("a", 0.25)] * 1500 + [("b", rng.paretovariate(0.3)) for _ in range(2000)]
    rows += [(None, float(rng.randrange(3))) for _ in range(1000)] + [("one", 4.0), ("none", None), ("pair", 1.0), ("pair", 2.0), ("pair", None)]
    rows += [("ends", v) for v in (float("-inf"), -1.7e308, 0.0, 1.7e308, float("inf"))]
    df = spark.createDataFrame(rows, "k string, v double").repartition(7)
    for cells in (1, 16, 4096):
        got, want = both(df, ["k"], cells)
        assert got == want
    got, want = both(df.where("k <> 'ends'"), [], 64)
    assert got == want
    assert both(df.limit(0), ["k"], 16) == ([], [])
    assert quantiles.large_group_quantiles(df.limit(0), [], "v", QS).first().n == 0


def test_more_groups_than_are_broadcast(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "MOST_GROUPS", 3)
    df = spark.createDataFrame([(k % 11, float(k * k % 101)) for k in range(900)], "k int, v double")
    got, want = both(df, ["k"], 8)
    assert got == want


def test_large_filters_equal_plain(spark, monkeypatch):
    rng = random.Random(5)
    df = spark.createDataFrame([(k, None if k % 17 == 0 else "xyz"[k % 3], rng.gauss(10, 3) ** 3 if k % 13 else None) for k in range(4000)], "id int, k string, v double")
    for f in (lambda **a: filters.mad_bounds(df, ["k"], "v", **a), lambda **a: filters.mad_filter(df, ["k"], "v", 2, **a), lambda **a: filters.trim_by_quantiles(df, ["k"], "v", **a), lambda **a: stats.box_stats(df, ["k"], "v", **a)):
        for one_task in (0, 10_000):
            monkeypatch.setattr(quantiles, "ONE_TASK", one_task)
            assert sorted(map(repr, f(large=True).collect())) == sorted(map(repr, f().collect()))
    assert not quantiles.exceeds_a_task(df.limit(0), ["k"], "v")


def test_rolling_median_over_many_blocks(spark):
    rng, start = random.Random(7), datetime(2024, 1, 1)
    rows = [(k, k % 2, start + timedelta(microseconds=rng.randrange(200 * 86_400_000_000)), rng.random()) for k in range(600)]
    rows += [(600 + k, 0, start + timedelta(days=k), 0.5) for k in range(0, 200, 4)] + [(900, 0, None, 2.0), (901, 0, None, 4.0)]
    rows += [(1000, 0, start + timedelta(days=50), None)]
    df = spark.createDataFrame(rows, "id int, k int, t timestamp_ntz, v double")
    for centred, large in ((True, False), (False, False), (True, True), (False, True)):
        out = stats.rolling_median(df, ["k"], "t", "v", 2, centred, 2, large=large)
        assert out.columns == ["id", "k", "t", "v", "rolling"]
        got = {r.id: r.rolling for r in out.collect()}
        assert len(got) == len(rows) and got[900] == got[901] == 3.0
        us = timedelta(microseconds=1)
        timed = [r for r in rows if r[2]]
        for i, k, t, _ in timed:
            low, high = (t - timedelta(days=1), t + timedelta(days=1)) if centred else (t - timedelta(days=2), t)
            near = [v for _, k2, t2, v in timed if v is not None and k2 == k and low + us <= t2 <= high]
            assert got[i] == (None if len(near) < 2 else np.percentile(near, 50)) or abs(got[i] - np.percentile(near, 50)) < 1e-12


def test_places_in_runs_of_any_length():
    """A window of half of 200,000 rows for each of them: where one sorted window slides, each step moves a hundred thousand values."""
    rng = np.random.default_rng(8)
    v = np.round(rng.normal(0, 1, 500), 1)
    first, n = rng.integers(0, 400, 300), rng.integers(1, 100, 300)
    k = rng.integers(0, n)
    got = quantiles.ranked(v, first, first + n, k)
    assert got.tolist() == [sorted(v[a : a + m])[p] for a, m, p in zip(first, n, k, strict=True)]
    us, v = np.arange(200_000), rng.normal(0, 1, 200_000)
    v[::7] = np.nan
    got = quantiles.sliding_medians(us, v, us % 2 == 0, 50_000, 49_999, 3)
    for k in (0, 2, 70_000, 123_456, 199_998):
        assert got[k] == np.nanmedian(v[max(0, k - 50_000) : k + 50_000])
    assert np.ma.getmaskarray(got)[1::2].all() and not np.ma.getmaskarray(got)[::2].any()
    few = quantiles.sliding_medians(np.arange(4), np.array([1.0, np.nan, 2.0, np.nan]), np.ones(4, bool), 1, 0, 2)
    assert np.ma.getmaskarray(few).all()
