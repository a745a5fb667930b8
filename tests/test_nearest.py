"""The nearest join of shapes against all pairs, by distances made of plain loops."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pytest

from firnspark.operators import nearest

SCHEMA = "{k} int, shape array<struct<x: double, y: double>>, distance string"


def plain_distance(v, w):
    """Line or point v, polygon (or point, or two-vertex line) w."""

    def pieces(s, closed):
        return list(zip(s, s[1:] + (s[:1] if closed and len(s) > 2 else []), strict=False)) or [(s[0], s[0])]

    def far(p, a, b):
        d = (b[0] - a[0]) ** 2 + (b[1] - a[1]) ** 2
        t = 0.0 if d == 0 else max(0.0, min(1.0, ((p[0] - a[0]) * (b[0] - a[0]) + (p[1] - a[1]) * (b[1] - a[1])) / d))
        return math.hypot(p[0] - a[0] - t * (b[0] - a[0]), p[1] - a[1] - t * (b[1] - a[1]))

    def turn(a, b, c):
        return np.sign((b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0]))

    def meet(a, b, c, d):
        if any(max(a[i], b[i]) < min(c[i], d[i]) or max(c[i], d[i]) < min(a[i], b[i]) for i in (0, 1)):
            return False
        return turn(a, b, c) * turn(a, b, d) <= 0 and turn(c, d, a) * turn(c, d, b) <= 0

    s, r = pieces(v, False), pieces(w, True)
    p, odd = v[0], False
    for a, b in r if len(w) > 2 else ():
        if (a[1] > p[1]) != (b[1] > p[1]) and p[0] < (b[0] - a[0]) * (p[1] - a[1]) / (b[1] - a[1]) + a[0]:
            odd = not odd
    if odd or any(meet(*x, *y) for x in s for y in r):
        return 0.0
    return min(min(far(p, *y) for x in s for p in x for y in r), min(far(p, *x) for y in r for p in y for x in s))


def shapes(rng, n, sizes, spread=10.0, extent=1.0):
    out = []
    for _ in range(n):
        c = rng.uniform(-spread, spread, 2)
        m = int(rng.choice(sizes))
        if m > 2:
            at = np.sort(rng.uniform(0, 2 * math.pi, m))
            v = c + extent * np.column_stack([np.cos(at), np.sin(at)]) * rng.uniform(0.2, 1, (m, 1))
        else:
            v = c + rng.normal(0, extent, (m, 2))
        out.append([tuple(map(float, p)) for p in v])
    return out


@pytest.mark.parametrize("ranges, rows", [(1, 20_000), (7, 20_000), (7, 15)])
def test_nearest_against_all_pairs(spark, ranges, rows, monkeypatch):
    monkeypatch.setattr(nearest, "LEFT_ROWS", rows)
    rng = np.random.default_rng(ranges)
    left = shapes(rng, 90, (1, 2, 2, 5), extent=0.8) + shapes(rng, 40, (2,), spread=0.5, extent=0.1)
    right = shapes(rng, 110, (1, 2, 3, 6), extent=0.9)
    right += right[:6]
    a = spark.createDataFrame([(k, v, "x") for k, v in enumerate(left)] + [(500, None, "x"), (501, [], None)], SCHEMA.format(k="a"))
    b = spark.createDataFrame([(k, v, "y") for k, v in enumerate(right)] + [(900, None, "y")], SCHEMA.format(k="b"))
    want = {}
    for k, v in enumerate(left):
        d = [plain_distance(v, w) for w in right]
        want |= {(k, j): x for j, x in enumerate(d) if x <= min(d) + 1e-12}
    got = {(r.a, r.b): r.distance for r in nearest.nearest_shapes(a, b, "a", "b", ranges=ranges).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - v) < 1e-9 for k, v in want.items())
    assert len(got) > len(left) and 0.0 in got.values()
    if ranges == 1:
        some = {(r.a, r.b) for r in nearest.nearest_shapes(a, b, "a", "b", ranges=3, most=0.3).collect()}
        assert some == {k for k, v in want.items() if v <= 0.3} != want.keys()


def test_nearest_of_nothing(spark):
    a = spark.createDataFrame([(1, [(0.0, 0.0)], "x")], SCHEMA.format(k="a"))
    b = spark.createDataFrame([(1, None, "x")], SCHEMA.format(k="b"))
    assert nearest.nearest_shapes(a, b, "a", "b").count() == 0 and nearest.nearest_shapes(a, b, "a", "b").columns == ["a", "b", "distance"]
    assert nearest.nearest_shapes(a.limit(0), a.withColumnRenamed("a", "b"), "a", "b").count() == 0


def test_tree_opens_few_boxes():
    rng = np.random.default_rng(2)
    p = rng.uniform(0, 1, (5000, 2))
    order = np.lexsort((p[:, 1], np.floor(p[:, 0] * 70)))
    p, opened = p[order], []
    tree = nearest.PackedTree(np.column_stack([p[:, 0], p[:, 0], p[:, 1], p[:, 1]]))

    def distance(k):
        opened.append(k)
        return float(np.hypot(*(p[k] - q)))

    for q in rng.uniform(0, 1, (20, 2)):
        best, hits = tree.nearest(np.array([q[0], q[0], q[1], q[1]]), distance, math.inf)
        d = np.hypot(*(p - q).T)
        assert best == d.min() and hits == [int(d.argmin())]
    assert len(opened) < 20 * 100


def test_pairs_at_once():
    """Distances of pairs of all kinds taken together, and leaves found for many boxes at once, against one by one."""
    rng = np.random.default_rng(6)
    kind = pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))
    own, theirs = shapes(rng, 40, (1, 2, 3, 5), 3.0, 0.7), shapes(rng, 50, (1, 2, 3, 6), 3.0, 0.7)
    a, b = (nearest.Shapes(pa.array([[{"x": x, "y": y} for x, y in v] for v in s], kind), closed) for s, closed in ((own, False), (theirs, True)))
    i, j = (v.ravel() for v in np.indices((40, 50)))
    want = np.array([nearest.shape_distance(np.array(own[p]), False, np.array(theirs[q]), True) for p, q in zip(i, j, strict=True)])
    assert (nearest.shape_distances(a, b, i, j) == want).all() and ((nearest.shape_distances(a, b, i, j, True) == 0) == (want == 0)).all()
    box = lambda s: np.array([[min(p[0] for p in v), max(p[0] for p in v), min(p[1] for p in v), max(p[1] for p in v)] for v in s])
    got = set(zip(*(v.tolist() for v in nearest.PackedTree(box(theirs)).candidates(box(own), np.full(40, math.inf))[:2]), strict=True))
    d = want.reshape(40, 50)
    assert {(p, q) for p in range(40) for q in np.flatnonzero(d[p] == d[p].min()).tolist()} <= got and len(got) < 40 * 50
