"""Selection of slopes against all pairs: ties in x and y, few and many points, ranks at both ends."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from firnspark.operators import robust, slopes


def test_inversions_against_loops():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 8, 37, 64, 65):
        p = rng.permutation(n)
        want = {(p[i], p[j]) for i in range(n) for j in range(i + 1, n) if p[i] > p[j]}
        big, small = slopes.inverted_pairs(p) if n > 1 else (np.zeros(0), np.zeros(0))
        assert slopes.inversions(p) == len(want) and set(zip(big, small, strict=True)) == want


@pytest.mark.parametrize("kind", range(6))
def test_ranks_against_all_pairs(kind, monkeypatch):
    monkeypatch.setattr(slopes, "FEW_PAIRS", 60)
    rng = np.random.default_rng(kind)
    for _ in range(25):
        n = int(rng.integers(2, 260))
        x = [rng.normal(size=n), rng.integers(0, 15, n).astype(float), np.arange(n) / 365.25, np.full(n, 2.0), np.exp(rng.normal(size=n) * 6), rng.integers(0, 3, n).astype(float)][kind]
        for y in (rng.normal(size=n), rng.integers(0, 9, n).astype(float), 3 * x + rng.normal(size=n) * 1e-3, np.zeros(n)):
            pairs = slopes.Slopes(x, y)
            every = np.sort([(y[j] - y[i]) / (x[j] - x[i]) for i in range(n) for j in range(n) if x[i] < x[j]])
            assert pairs.total == len(every)
            if len(every):
                ranks = [0, len(every) - 1, (len(every) - 1) // 2, len(every) // 2, int(rng.integers(0, len(every)))]
                assert pairs.at(ranks) == pytest.approx(every[ranks], rel=1e-9, abs=1e-12)


def test_large_groups(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(g, float(x), None if k % 17 == 0 else float(y)) for g, n in ((1, 1500), (2, 900)) for k, (x, y) in enumerate(zip(rng.integers(0, 400, n), rng.integers(0, 50, n) + rng.normal(size=n) * (g - 1), strict=True))]
    df = spark.createDataFrame(rows, "g int, x double, y double")
    got = {r.g: r for r in robust.theil_sen(df, ["g"], "y", "x", "numpy", ci=True, per_year=False).collect()}
    monkeypatch.setattr(slopes, "FEW_PAIRS", 1 << 40)
    for g in (1, 2):
        own = [(x, y) for k, x, y in rows if k == g and y is not None]
        want = robust.theil_sen_numpy(np.array([r[0] for r in own]), np.array([r[1] for r in own]))
        assert tuple(got[g][c] for c in robust.RESULTS) == want and got[g].n == len(own)


def test_many_points():
    rng = np.random.default_rng(4)
    n = 60_000
    x, y = np.floor(rng.uniform(0, 4000, n)), np.round(rng.normal(size=n), 2)
    pairs = slopes.Slopes(x, y)
    r = pairs.total // 3
    (got,) = pairs.at([r])
    assert pairs.below(got - 1e-12) <= r < pairs.below(got + 1e-12)


def test_native_equals_numpy_on_groups_with_ties(spark):
    rng = np.random.default_rng(6)
    df = spark.createDataFrame([(int(rng.integers(5)), float(rng.integers(12)), float(rng.integers(7))) for _ in range(300)], "g int, x double, y double")
    a, b = ({r.g: tuple(r) for r in robust.theil_sen(df, ["g"], "y", "x", s, ci=True, per_year=False).select("g", *robust.RESULTS, F.col("n")).collect()} for s in ("native", "numpy"))
    assert a == b
