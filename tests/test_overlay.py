"""Unions of polygons against slices of the plane, boxes against strips, and cases worked out by hand."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from firnspark.operators import overlay, shapes

SCHEMA = "g int, rings array<array<struct<x: double, y: double>>>"


def box(x0, x1, y0, y1):
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]


def frame(spark, polygons):
    """polygons: (group, outer, *holes)"""
    return spark.createDataFrame([(g, [list(map(tuple, r)) for r in rings]) for g, *rings in polygons], SCHEMA)


def slices(polygons, n=4000):
    """Area and centroid by many vertical lines, on each of which the polygons' even-odd intervals are joined."""
    xs = [v[0] for p in polygons for r in p for v in r]
    lo, hi = min(xs), max(xs)
    area = mx = my = 0.0
    for k in range(n):
        x, parts = lo + (hi - lo) * (k + 0.5) / n, []
        for rings in polygons:
            cuts = sorted(a[1] + (b[1] - a[1]) * (x - a[0]) / (b[0] - a[0]) for r in rings for a, b in zip(r, r[1:] + r[:1], strict=True) if (a[0] > x) != (b[0] > x))
            parts += zip(cuts[::2], cuts[1::2], strict=True)
        top = -math.inf
        for a, b in sorted(parts):
            a = max(a, top)
            if b > a:
                area, mx, my, top = area + (b - a), mx + (b - a) * x, my + (b * b - a * a) / 2, b
    w = (hi - lo) / n
    return area * w, mx / area, my / area


def star(rng, cx, cy, r):
    n = rng.integers(3, 12)
    at = np.sort(rng.uniform(0, 2 * math.pi, n)) if n > 5 else np.arange(n) * 2 * math.pi / n + rng.uniform(0, 1)
    far = rng.uniform(0.3, 1, n) * r
    return [(float(cx + f * math.cos(a)), float(cy + f * math.sin(a))) for a, f in zip(at, far, strict=True)]


def many(seed, n):
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        cx, cy, r = rng.uniform(-3, 3), rng.uniform(-2, 2), rng.uniform(0.3, 1.5)
        outer = star(rng, cx, cy, r)
        if rng.random() < 0.5:
            outer = [(float(cx + r * math.cos(a)), float(cy + r * math.sin(a))) for a in np.arange(8) * math.pi / 4]
            out.append((outer, star(rng, cx, cy, 0.6 * r)))
        else:
            out.append((outer,))
    return out


@pytest.mark.parametrize("size", [0.7, 20.0])
def test_union_against_slices(spark, size):
    groups = {k: many(k, 14) for k in range(3)}
    df = frame(spark, [(g, *p) for g, own in groups.items() for p in own] + [(g, *reversed_rings(p)) for g, own in groups.items() for p in own[:5]])
    got = {r.g: r for r in overlay.union_measures(df, ["g"], size).collect()}
    rings = overlay.union_rings(df, ["g"], size).collect()
    for g, own in groups.items():
        area, cx, cy = slices(own)
        assert (got[g].area, got[g].cx, got[g].cy) == pytest.approx((area, cx, cy), rel=2e-3, abs=2e-3)
        assert sum(-r.area if r.hole else r.area for r in rings if r.g == g) == pytest.approx(got[g].area, rel=1e-6)
    assert all(r.ring[0] == r.ring[-1] and len(r.ring) > 3 for r in rings) and any(r.hole for r in rings)


def reversed_rings(p):
    return [list(reversed(r)) for r in p]


def test_boxes_against_strips(spark):
    rng = np.random.default_rng(4)
    boxes = [(int(k % 4), *(float(v) for v in (x, x + w, y, y + h))) for k, (x, y, w, h) in enumerate(np.column_stack([rng.integers(0, 12, (60, 2)) / 2, rng.integers(1, 6, (60, 2)) / 2]))]
    want = {r.g: r for r in shapes.union_of_boxes(spark.createDataFrame(boxes, "g int, x0 double, x1 double, y0 double, y1 double"), ["g"]).collect()}
    df = frame(spark, [(g, box(*b)) for g, *b in boxes])
    for size in (0.9, 3.0):
        for r in overlay.union_measures(df, ["g"], size).collect():
            assert (r.area, r.cx, r.cy) == pytest.approx((want[r.g].area, want[r.g].cx, want[r.g].cy), abs=1e-7)


def test_by_hand(spark):
    unit = box(0.0, 1.0, 0.0, 1.0)
    cases = {
        1: [[unit], [unit], [list(reversed(unit))]],  # repeated
        2: [[unit], [box(1.0, 2.0, 0.0, 1.0)]],  # an edge in common
        3: [[unit], [box(1.0, 2.0, 1.0, 2.0)]],  # a point in common
        4: [[box(0.0, 3.0, 0.0, 3.0), box(1.0, 2.0, 1.0, 2.0)]],  # a hole
        5: [[box(0.0, 3.0, 0.0, 3.0), box(1.0, 2.0, 1.0, 2.0)], [box(1.0, 2.0, 1.0, 2.0)]],  # a hole filled
        6: [[box(0.0, 3.0, 0.0, 3.0), box(1.0, 2.0, 1.0, 2.0)], [box(1.25, 1.5, 1.25, 1.5)]],  # an island
        7: [[box(0.0, 3.0, 0.0, 1.0)], [box(0.0, 3.0, 2.0, 3.0)], [box(0.0, 1.0, 0.0, 3.0)], [box(2.0, 3.0, 0.0, 3.0)]],  # a frame of four
        8: [[[(0.0, 0.0), (1.0, 0.0)]], [unit + unit[:1]]],  # too few vertices; a closed ring
    }
    df = frame(spark, [(g, *p) for g, own in cases.items() for p in own]).unionByName(spark.sql("SELECT 9 AS g, NULL AS rings UNION ALL SELECT 1, array()").select("g", F.col("rings").cast(SCHEMA.split("rings ")[1])))
    area = {1: 1, 2: 2, 3: 2, 4: 8, 5: 9, 6: 8.0625, 7: 8, 8: 1}
    rings = {1: (1, 0), 2: (1, 0), 3: (2, 0), 4: (1, 1), 5: (1, 0), 6: (2, 1), 7: (1, 1), 8: (1, 0)}
    for size in (10.0, 1.0, 0.375):
        assert {r.g: round(r.area, 6) for r in overlay.union_measures(df, ["g"], size).collect()} == area
        got = overlay.union_rings(df, ["g"], size).groupBy("g").agg(F.count_if(~F.col("hole")).alias("outer"), F.count_if("hole").alias("holes")).collect()
        assert {r.g: (r.outer, r.holes) for r in got} == rings


def test_far_from_the_origin_and_no_rows(spark):
    far = [(1, [(x + 3e6, y - 4e6) for x, y in r]) for r in (box(0.0, 3.0, 0.0, 3.0), box(2.0, 5.0, 1.0, 2.0))]
    r = overlay.union_measures(frame(spark, far), ["g"], 2.0).first()
    assert (r.area, r.cx - 3e6, r.cy + 4e6) == pytest.approx((11.0, (9 * 1.5 + 2 * 4) / 11, 1.5), abs=1e-5)
    none = frame(spark, far).limit(0)
    assert overlay.union_measures(none, ["g"], 2.0).count() == 0 and overlay.union_rings(none, ["g"], 2.0).count() == 0


def test_nodes_of_random_segments():
    rng = np.random.default_rng(3)
    s = rng.integers(0, 30, (120, 4))
    s = s[(s[:, :2] != s[:, 2:]).any(axis=1)]
    cut = overlay.noded(s)
    a, b = cut[:, :2], cut[:, 2:]
    for k in range(len(cut)):
        d = [overlay._turn(*x) for x in ((a[k], b[k], a), (a[k], b[k], b), (a, b, a[k][None]), (a, b, b[k][None]))]
        assert not ((np.sign(d[0]) * np.sign(d[1]) < 0) & (np.sign(d[2]) * np.sign(d[3]) < 0)).any()


def turned(n):
    """Boxes that lie deep upon each other, turned so that no edge is upright, and the same ones upright."""
    at = np.random.default_rng(n).normal(0, 0.1, (n, 2))
    boxes = [(x - 0.03, x + 0.03, y - 0.02, y + 0.02) for x, y in at.tolist()]
    return [[[(x * 0.8 - y * 0.6, x * 0.6 + y * 0.8) for x, y in box(*b)]] for b in boxes], boxes


def test_crossings_of_deep_polygons_are_not_made(monkeypatch):
    """All pairs of the edges cross some 300,000 times; only what few polygons cover is noded, and two layers of the same rows change nothing."""
    made, plain = [], overlay.noded

    def noded(s):
        got = plain(s)
        made.append(len(got))
        return got

    monkeypatch.setattr(overlay, "noded", noded)
    polygons, boxes = turned(3000)
    x0, y0 = (min(v[k] for p in polygons for v in p[0]) - 0.01 for k in (0, 1))
    p = np.array([p[0] for p in polygons])
    s = np.rint((np.concatenate([p, np.roll(p, -1, axis=1)], axis=2).reshape(-1, 4) - (x0, y0) * 2) / 2 * overlay.STEPS).astype(np.int64)
    edges = overlay.united(s, np.repeat(np.arange(len(p)), 4), overlay.STEPS)
    assert sum(made) < 20_000 and len(edges) < 2_000
    x1, y1, x2, y2 = edges.T * (2 / overlay.STEPS)
    assert ((x1 * y2 - x2 * y1) / 2).sum() == pytest.approx(strips(boxes), abs=1e-6)
    a, b = (np.sort(e[:, 0].astype(np.float64) * overlay.STEPS + e[:, 1]) for e in (edges[:, :2], edges[:, 2:]))
    assert (a == b).all()  # closed


def strips(boxes):
    xs, area = sorted({x for b in boxes for x in b[:2]}), 0.0
    for a, z in zip(xs, xs[1:], strict=False):
        top = -math.inf
        for y0, y1 in sorted((b[2], b[3]) for b in boxes if b[0] <= a and b[1] >= z):
            area, top = area + (z - a) * max(0.0, y1 - max(y0, top)), max(y1, top)
    return area


def test_measures_of_deep_polygons(spark):
    """A square with 3000 polygons: noded whole, its edges would be compared by the ten thousand millions."""
    polygons, boxes = turned(3000)
    area = strips(boxes)
    assert overlay.union_measures(frame(spark, [(1, *p) for p in polygons] * 2), ["g"], 4.0).first().area == pytest.approx(area, abs=1e-6)


def test_boxes_deep_upon_each_other(spark):
    """By strips these make some two million rows; here each box goes to few cells, and the cells are small."""
    boxes = turned(3000)[1]
    got = shapes.boxes_union(np.array(boxes))
    assert got[0] == pytest.approx(strips(boxes), rel=1e-12)
    bars = [(float(k), k + 0.5, 0.0, 60.0) for k in range(60)] + [(0.0, 60.0, float(k), k + 0.5) for k in range(60)]
    assert shapes.boxes_union(np.array(bars))[0] == pytest.approx(3600 * 0.75)
    df = spark.createDataFrame([(k % 2, *b) for k, b in enumerate(boxes)] + [(None, 0.0, 1.0, 0.0, 1.0), (5, 1.0, 1.0, 0.0, 1.0)], "g int, x0 double, x1 double, y0 double, y1 double")
    many = {r.g: r for r in shapes.union_of_boxes(df, ["g"], 50).collect()}
    assert many.keys() == {0, 1}
    for g in (0, 1):
        area, mx, my = shapes.boxes_union(np.array(boxes[g::2]))
        assert (many[g].area, many[g].cx, many[g].cy) == pytest.approx((area, mx / area, my / area), rel=1e-12, abs=1e-12)


def test_one_polygon_many_times():
    b = np.array([(0.1, 0.1), (0.5, 0.2), (0.4, 0.6), (0.05, 0.5)]) * overlay.STEPS
    s = np.rint(np.concatenate([b, np.roll(b, -1, axis=0)], axis=1)).astype(np.int64)
    edges = overlay.united(np.tile(s, (2000, 1)), np.repeat(np.arange(2000), 4), overlay.STEPS)
    assert sorted(edges.tolist()) == sorted(s.tolist())
    assert len(overlay.united(np.zeros((0, 4), np.int64), np.zeros(0, np.int64), overlay.STEPS)) == 0
