"""Buffers against distances on a fine grid, and areas that have a formula."""

from __future__ import annotations

import math

import numpy as np
import pytest

from firnspark.operators import buffers, overlay

LINES = {1: [(0.0, 0.0), (4.0, 0.0), (4.0, 3.0)], 2: [(0.0, 0.0), (5.0, 1.0), (0.5, 2.0), (0.5, 2.0), (3.0, 3.0)], 3: [(0.0, 0.0), (3.0, 0.0), (1.0, 0.0)], 4: [(7.0, 7.0)], 5: [(0.0, 0.0), (6.0, 0.0), (3.0, 2.0), (3.0, -2.0)]}


def frame(spark, lines=LINES):
    return spark.createDataFrame([(k, v) for k, v in lines.items()], "k int, line array<struct<x: double, y: double>>")


def far(p, v):
    """Distances of points from a line."""
    out = np.full(len(p), np.inf)
    for a, b in zip(v, v[1:] or v, strict=False):
        a, d = np.array(a), np.subtract(b, a)
        t = np.clip(((p - a) @ d) / max(d @ d, 1e-300), 0, 1)
        out = np.minimum(out, np.hypot(*(p - a - t[:, None] * d).T))
    return out


def inside(p, rings):
    odd = np.zeros(len(p), bool)
    for r in rings:
        v = np.array([(q.x, q.y) for q in r])
        for a, b in zip(v, v[1:], strict=False):
            cross = (a[1] > p[:, 1]) != (b[1] > p[:, 1])
            with np.errstate(divide="ignore", invalid="ignore"):
                odd ^= cross & (p[:, 0] < (b[0] - a[0]) * (p[:, 1] - a[1]) / (b[1] - a[1]) + a[0])
    return odd


def test_round_buffers_against_distances(spark):
    got = {}
    for r in buffers.buffer(frame(spark), ["k"], 0.6, quarter=16).collect():
        got.setdefault(r.k, []).append(r)
    x, y = np.meshgrid(np.arange(-1.5, 9, 0.043), np.arange(-3.5, 8.5, 0.041))
    p = np.column_stack([x.ravel(), y.ravel()])
    for k, v in LINES.items():
        d = far(p, v)
        sure = np.abs(d - 0.6) > 0.004  # a polygon of 64 corners is within that of the circle
        assert (inside(p[sure], [r.ring for r in got[k]]) == (d[sure] < 0.6)).all()
        assert sum(-r.area if r.hole else r.area for r in got[k]) == pytest.approx((d < 0.6).sum() * 0.043 * 0.041, rel=0.02)


def area(spark, lines, **how):
    rows = overlay.union_measures(buffers.buffer_pieces(frame(spark, lines), ["k"], 0.5, **how), ["k"], 3.0).collect()
    return {r.k: r.area for r in rows}


def test_areas_with_a_formula(spark):
    bend = {1: [(0.0, 0.0), (4.0, 0.0), (4.0, 3.0)], 2: [(0.0, 0.0), (5.0, 0.0)], 3: [(2.0, 2.0)]}
    flat, square = area(spark, bend, cap="flat", join="mitre"), area(spark, bend, cap="square", join="mitre")
    assert flat == pytest.approx({1: 7.0, 2: 5.0}) and square == pytest.approx({1: 8.0, 2: 6.0, 3: 1.0})
    assert area(spark, bend, cap="flat", join="bevel")[1] == pytest.approx(7.0 - 0.125)
    disc = lambda n: n / 2 * 0.25 * math.sin(2 * math.pi / n)
    assert area(spark, bend, cap="round", join="mitre", quarter=4) == pytest.approx({1: 7.0 + disc(16), 2: 5.0 + disc(16), 3: disc(16)})
    sharp = {1: [(0.0, 0.0), (4.0, 0.0), (0.0, 0.2)]}
    assert area(spark, sharp, cap="flat", join="mitre")[1] == pytest.approx(area(spark, sharp, cap="flat", join="bevel")[1])
    assert area(spark, sharp, cap="flat", join="mitre", mitre_limit=100.0)[1] > area(spark, sharp, cap="flat", join="bevel")[1] + 5
    with pytest.raises(ValueError):
        buffers.buffer_pieces(frame(spark), ["k"], 1.0, cap="pointed")


def test_buffers_and_boundaries_of_polygons(spark):
    square, hole = [(0.0, 0.0), (6.0, 0.0), (6.0, 6.0), (0.0, 6.0)], [(2.0, 2.0), (4.0, 2.0), (4.0, 4.0), (2.0, 4.0), (2.0, 2.0)]
    df = spark.createDataFrame([(1, [square, hole]), (2, [square[:2]])], "k int, rings array<array<struct<x: double, y: double>>>")
    got = overlay.union_measures(buffers.polygon_pieces(df, ["k"], 0.5, join="mitre"), ["k"], 2.5).where("k = 1").first()
    assert got.area == pytest.approx(49 - 1) and got.cx == pytest.approx(3)
    lines = buffers.boundary_lines(df, ["k"]).collect()
    assert {(r.hole, len(r.line)) for r in lines} == {(False, 5), (True, 5)} and all(r.line[0] == r.line[-1] for r in lines)


def test_no_lines(spark):
    none = frame(spark, {1: [], 2: None})
    assert buffers.buffer(none, ["k"], 1.0).count() == 0 and buffers.buffer(frame(spark).limit(0), ["k"], 1.0).count() == 0
