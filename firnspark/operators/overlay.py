"""Unions of polygons of any shape: their boundary, area, centroid and rings, square by square.

Polygons are rows with ``rings``, an array of rings, the outer one first and then its holes; a ring is an array of (x, y) structs and may leave out
its first vertex at the end. They must not cross themselves. Coordinates are rounded to ``size`` / 2**29, where ``size`` is the side of the squares.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.sinks import scratch_folder
from .grid import _squares

#: Steps of a square's side; products of two differences fit 64 bits.
BITS = 29
STEPS = 1 << BITS
ENDS = ("x1", "y1", "x2", "y2")
#: Edges within a cell from which on it is cut into four, halvings in a row that part few of them before it is left whole, and segments that are cut at once.
LEAF, STUCK, AT_ONCE = 16, 3, 400_000


def parted(s: np.ndarray, own: np.ndarray, axis: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Segments cut where they cross the lines ``at``, parallel to the other axis, and whose they are. A point on a line is made in the same way
    from either direction; it is rounded where the coordinates are whole."""
    a, b = s[:, axis], s[:, axis + 2]
    crossing = (np.minimum(a, b) < at) & (np.maximum(a, b) > at)
    if not crossing.any():
        return s, own
    k = np.flatnonzero(crossing)
    up = (a[k] < b[k])[:, None]
    lo, hi = np.where(up, s[k, :2], s[k, 2:]), np.where(up, s[k, 2:], s[k, :2])
    point = lo + (hi - lo) * ((at[k] - lo[:, axis]) / (hi[:, axis] - lo[:, axis]))[:, None]
    point = np.rint(point).astype(s.dtype) if s.dtype.kind == "i" else point
    point[:, axis] = at[k]
    first = np.arange(len(s)) + np.cumsum(crossing) - crossing
    out = np.empty((len(s) + len(k), 4), s.dtype)
    out[first] = s
    out[first[k], 2:] = point
    out[first[k] + 1] = np.column_stack([point, s[k, 2:]])
    return out, np.repeat(own, 1 + crossing)


def pressed(s: np.ndarray, axis: int, at: np.ndarray, below: bool) -> np.ndarray:
    """Segments that cross no line with what is beyond it moved onto it: a closed line stays closed, and winds about the points on this side as before."""
    s = s.copy()
    for k in (axis, axis + 2):
        s[:, k] = np.minimum(s[:, k], at) if below else np.maximum(s[:, k], at)
    return s


def netted(line: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of directed pieces ``a`` to ``b`` along numbered lines what is left where those of opposite directions cancel: line, from, to."""
    where, at, d = np.concatenate([line, line]), np.concatenate([a, b]), np.concatenate([np.ones(len(a), np.int64), np.full(len(b), -1, np.int64)])
    order = np.lexsort((at, where))
    where, at, d = where[order], at[order], d[order]
    first = np.ones(len(at), bool)
    first[1:] = (where[1:] != where[:-1]) | (at[1:] != at[:-1])
    d = np.add.reduceat(d, np.flatnonzero(first)) if len(d) else d
    where, at = where[first][d != 0], at[first][d != 0]
    net = np.cumsum(d[d != 0])[:-1]  # of a line it ends at nothing
    where, lo, hi = where[:-1], at[:-1], at[1:]
    many = np.abs(net)
    where, lo, hi, up = (np.repeat(v, many) for v in (where, lo, hi, net > 0))
    return where, np.where(up, lo, hi), np.where(up, hi, lo)


def _on_border(s: np.ndarray, corner: np.ndarray, side: np.ndarray) -> np.ndarray:
    """Of segments in square cells the side of the cell that they run along: 0 left, 1 right, 2 low, 3 high, or -1."""
    out = np.full(len(s), -1)
    for axis in (1, 0):
        for far in (1, 0):
            at = corner[:, axis] + far * side
            out[(s[:, axis] == at) & (s[:, axis + 2] == at)] = 2 * axis + far
    return out


def _without_turns(s: np.ndarray, own: np.ndarray, corner: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Segments of polygons in cells (``corner`` and ``side`` for each segment) without those of no length and with the pieces along the borders netted for each polygon; also which are along a border."""
    some = (s[:, :2] != s[:, 2:]).any(axis=1)
    s, own, corner, side = s[some], own[some], corner[some], side[some]
    border = _on_border(s, corner, side)
    edge, k = border >= 0, np.flatnonzero(border >= 0)
    axis = 1 - border[k] // 2  # along which it runs
    rows = np.arange(len(k))
    line, a, b = netted(own[k] * 4 + border[k], s[k][rows, axis], s[k][rows, axis + 2])
    its = line // 4
    begin = np.searchsorted(own, its)  # a polygon's segments are together
    which, upright = line % 4, line % 4 < 2
    at = np.where(upright, corner[begin, 0], corner[begin, 1]) + which % 2 * side[begin] if len(line) else line
    new = np.column_stack([np.where(upright, at, a), np.where(upright, a, at), np.where(upright, at, b), np.where(upright, b, at)])
    s, own = np.concatenate([s[~edge], new]), np.concatenate([own[~edge], its])
    along = np.concatenate([np.zeros((~edge).sum(), bool), np.ones(len(new), bool)])
    order = np.argsort(own, kind="stable")
    return s[order], own[order], along[order]


def _loops(corner: np.ndarray, side: np.ndarray) -> np.ndarray:
    """Borders of cells, with the cell to the left."""
    x0, y0, x1, y1 = corner[:, 0], corner[:, 1], corner[:, 0] + side, corner[:, 1] + side
    return np.concatenate([np.column_stack(c) for c in ((x0, y0, x1, y0), (x1, y0, x1, y1), (x1, y1, x0, y1), (x0, y1, x0, y0))])


def united(s: np.ndarray, own: np.ndarray, side: int) -> np.ndarray:
    """Like ``boundary`` for the polygons ``own`` (numbers that ascend) in a square cell from 0 to ``side``.

    A cell that a polygon covers whole is done, whatever else is in it; one with more than ``LEAF`` edges inside is cut into four, and only those with
    fewer, or whose edges do not part, are noded. So where polygons lie deep upon each other their crossings are not made. Borders of cells cancel.
    """
    out: list[np.ndarray] = []
    borders: list[np.ndarray] = []

    def done(edges: np.ndarray, corner: np.ndarray, width: np.ndarray) -> None:
        along = _on_border(edges, corner, width) >= 0
        out.append(edges[~along])
        borders.append(edges[along])

    # of polygons that are the same one is enough
    cuts = np.flatnonzero(np.diff(own)) + 1
    once = {part.tobytes(): (part, k) for part, k in zip(np.split(s, cuts), np.split(own, cuts), strict=True)}
    s, own = np.concatenate([v[0] for v in once.values()]), np.concatenate([v[1] for v in once.values()])
    order = np.argsort(own, kind="stable")
    s, own, along = _without_turns(s[order], own[order], np.zeros((len(s), 2), np.int64), np.full(len(s), side))
    # cells: corner, side, halvings without effect, edges before; polygons: the cell of each
    todo = [(s, own, along, np.zeros(int(own[-1]) + 1 if len(own) else 0, np.int64), np.array([[0, 0, side, 0, 0]], np.int64))]
    while todo:
        s, own, along, cell, cells = todo.pop()
        if not len(s):
            continue
        # polygons without an edge inside cover their cell or nothing of it
        polygons = len(cell)
        inside = np.bincount(own[~along], minlength=polygons)
        corner, width = cells[cell[own], :2], cells[cell[own], 2]
        x1, y1, x2, y2 = (s - np.tile(corner, 2)).T.astype(np.float64)
        area = np.bincount(own, x1 * y2 - x2 * y1, polygons)
        full = np.zeros(len(cells), bool)
        full[cell[(inside == 0) & (area > cells[cell, 2].astype(np.float64) ** 2)]] = True
        done(_loops(cells[full, :2], cells[full, 2]), np.tile(cells[full, :2], (4, 1)), np.tile(cells[full, 2], 4))
        live = (inside > 0) & ~full[cell]
        here = live[own]
        s, own, along = s[here], own[here], along[here]
        edges = np.bincount(cell[own[~along]], minlength=len(cells))
        # of a cell's quarters one still has nearly all edges, and others have them too
        again = np.tile(edges.reshape(4, -1).sum(axis=0), 4) if len(cells) > 1 else edges
        stuck = np.where((edges * 10 > cells[:, 4] * 9) & (again * 2 > cells[:, 4] * 3) & (cells[:, 4] > 0), cells[:, 3] + 1, 0)
        leaf = (edges <= LEAF) | (stuck >= STUCK) | (cells[:, 2] < 4)
        by_cell = cell[own]
        order = np.argsort(by_cell, kind="stable")
        ends = np.searchsorted(by_cell[order], np.arange(len(cells) + 1))
        for c in np.flatnonzero(leaf & (edges > 0)):
            got = boundary(s[order[ends[c] : ends[c + 1]]])
            done(got, np.broadcast_to(cells[c, :2], (len(got), 2)), np.broadcast_to(cells[c, 2], len(got)))
        go = np.flatnonzero(~leaf & (edges > 0))
        # so many cells at a time as have AT_ONCE segments
        batch = np.cumsum((ends[1:] - ends[:-1])[go]) // AT_ONCE
        for n in np.unique(batch):
            which = go[batch == n]
            k = np.concatenate([np.arange(ends[c], ends[c + 1]) for c in which])
            k = np.sort(order[k])
            todo.append(_quarters(s[k], own[k], cell, np.column_stack([cells[which, :3], stuck[which], edges[which]]), which))
    along_all = np.concatenate(borders) if borders else np.zeros((0, 4), np.int64)
    upright = along_all[:, 0] == along_all[:, 2]
    for axis, b in ((0, along_all[upright]), (1, along_all[~upright])):
        at, p, q = netted(b[:, axis], b[:, 1 - axis], b[:, 3 - axis])
        out.append(np.column_stack([at, p, at, q] if axis == 0 else [p, at, q, at]))
    return np.concatenate(out)


def _quarters(s: np.ndarray, own: np.ndarray, cell: np.ndarray, cells: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What lies in the four quarters of cells, of which ``which`` has the numbers in ``cell``: segments, whose, whether along a border, the cell of each polygon, cells."""
    for axis in (0, 1):
        own, number = np.unique(own, return_inverse=True)[::-1]
        place = np.searchsorted(which, cell[number])  # the cell of each polygon
        middle = cells[:, axis] + cells[:, 2] // 2
        s, own = parted(s, own, axis, middle[place[own]])
        n, at = len(number), middle[place[own]]
        s = np.concatenate([pressed(s, axis, at, True), pressed(s, axis, at, False)])
        own, cell = np.concatenate([own, own + n]), np.concatenate([place, place + len(cells)])
        far = cells.copy()
        far[:, axis] = middle
        cells, which = np.concatenate([cells, far]), np.arange(2 * len(cells))
    cells[:, 2] //= 2
    s, own, along = _without_turns(s, own, cells[cell[own], :2], cells[cell[own], 2])
    return s, own, along, cell, cells


def _turn(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (b[..., 0] - a[..., 0]) * (c[..., 1] - a[..., 1]) - (b[..., 1] - a[..., 1]) * (c[..., 0] - a[..., 0])


def _distinct(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows in order, and which of them each row is."""
    order = np.lexsort(rows.T[::-1])
    own = rows[order]
    new = np.ones(len(own), bool)
    new[1:] = own[1:, 0] != own[:-1, 0]
    for k in range(1, rows.shape[1]):
        new[1:] |= own[1:, k] != own[:-1, k]
    which = np.empty(len(own), np.int64)
    which[order] = np.cumsum(new) - 1
    return own[new], which


def _spans(first: np.ndarray, many: np.ndarray, most: int = 2_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (k, first[k] + 0, 1, ... many[k] - 1), about ``most`` at a time."""
    batch = np.cumsum(many) // most
    for n in np.unique(batch):
        k = np.flatnonzero(batch == n)
        m = many[k]
        yield np.repeat(k, m), np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m) + np.repeat(first[k], m)


def noded(s: np.ndarray) -> np.ndarray:
    """Segments (x1, y1, x2, y2, in whole steps) cut where they meet, until none meets another but at its ends. Places where two cross are
    rounded, which can make new ones; those are found in the next round."""
    for _ in range(20):
        s = s[np.argsort(np.minimum(s[:, 0], s[:, 2]), kind="stable")]
        a, b = s[:, :2], s[:, 2:]
        low, high = np.minimum(a, b), np.maximum(a, b)
        lx, ly, hy = (np.ascontiguousarray(v) for v in (low[:, 0], low[:, 1], high[:, 1]))
        nodes: list[np.ndarray] = []
        here = np.arange(len(s))
        for i, j in _spans(here + 1, np.searchsorted(lx, high[:, 0], "right") - here - 1):
            near = (ly[i] <= hy[j]) & (ly[j] <= hy[i])
            i, j = i[near], j[near]
            d1, d2, d3, d4 = _turn(a[i], b[i], a[j]), _turn(a[i], b[i], b[j]), _turn(a[j], b[j], a[i]), _turn(a[j], b[j], b[i])
            for own, d, p in ((i, d1, a[j]), (i, d2, b[j]), (j, d3, a[i]), (j, d4, b[i])):  # an end on the other segment
                k = np.flatnonzero(d == 0)
                own, p = own[k], p[k]
                on = (p[:, 0] >= low[own, 0]) & (p[:, 1] >= low[own, 1]) & (p[:, 0] <= high[own, 0]) & (p[:, 1] <= high[own, 1])
                nodes.append(np.column_stack([own[on], p[on]]))
            proper = (np.sign(d1) * np.sign(d2) < 0) & (np.sign(d3) * np.sign(d4) < 0)
            i, j, d3, d4 = i[proper], j[proper], d3[proper].astype(np.float64), d4[proper].astype(np.float64)
            p = np.rint(a[i] + (b[i] - a[i]) * (d3 / (d3 - d4))[:, None]).astype(np.int64)
            nodes += [np.column_stack([i, p]), np.column_stack([j, p])]
        found = np.concatenate(nodes) if nodes else np.zeros((0, 3), np.int64)
        own, p = found[:, 0], found[:, 1:]
        found = found[((p[:, 0] != a[own, 0]) | (p[:, 1] != a[own, 1])) & ((p[:, 0] != b[own, 0]) | (p[:, 1] != b[own, 1]))]
        if not len(found):
            return s
        found = _distinct(found)[0]
        own, p = found[:, 0], found[:, 1:]
        every = np.concatenate([np.arange(len(s)), own, np.arange(len(s))])
        points = np.concatenate([a, p, b])
        along = np.concatenate([np.full(len(s), -np.inf), ((p - a[own]).astype(np.float64) * (b[own] - a[own])).sum(axis=1), np.full(len(s), np.inf)])
        order = np.lexsort((along, every))
        every, points = every[order], points[order]
        same = every[1:] == every[:-1]
        s = np.column_stack([points[:-1], points[1:]])[same]
        s = s[(s[:, 0] != s[:, 2]) | (s[:, 1] != s[:, 3])]
    return s


def boundary(segments: np.ndarray) -> np.ndarray:
    """Of directed segments, each with its polygon to the left, those parts that bound the area of all polygons together, with that area to the left."""
    s = noded(segments[(segments[:, :2] != segments[:, 2:]).any(axis=1)])
    back = (s[:, 0] > s[:, 2]) | (s[:, 0] == s[:, 2]) & (s[:, 1] > s[:, 3])
    edges, which = _distinct(np.where(back[:, None], s[:, [2, 3, 0, 1]], s))
    weight = np.bincount(which, np.where(back, -1, 1), len(edges)).astype(np.int64)
    edges, weight = edges[weight != 0], weight[weight != 0]
    a, b = 2 * edges[:, :2], 2 * edges[:, 2:]
    middle, step = (a + b) // 2, edges[:, 2:] - edges[:, :2]
    steep = np.abs(step[:, 1]) >= np.abs(step[:, 0])
    beyond = np.zeros(len(edges), np.int64)
    for axis, rows in ((1, np.flatnonzero(steep)), (0, np.flatnonzero(~steep))):  # a ray to the right of steep edges, upwards from flat ones
        # each edge meets the rays of a run of middles in their order along the axis
        rows = rows[np.argsort(middle[rows, axis], kind="stable")]
        at = middle[rows, axis]
        first, last = np.searchsorted(at, np.minimum(a[:, axis], b[:, axis])), np.searchsorted(at, np.maximum(a[:, axis], b[:, axis]))
        rising = b[:, axis] > a[:, axis]
        for k, r in _spans(first, last - first):
            own = rows[r]
            left = _turn(a[k], b[k], middle[own])
            hit = (left > 0).astype(np.int64) * rising[k] - (left < 0) * ~rising[k] if axis else (left > 0).astype(np.int64) * ~rising[k] - (left < 0) * rising[k]
            beyond += np.bincount(own, np.where(own == k, 0, hit * weight[k]), len(edges)).astype(np.int64)
    is_right = steep & (step[:, 1] > 0)  # an edge's far side along its ray is its right side if it rises steeply
    on_left = np.where(is_right, beyond + weight, beyond)
    on_right = np.where(is_right, beyond, beyond - weight)
    keep, flip = (on_left > 0) != (on_right > 0), on_left <= 0
    return np.where(flip[:, None], edges[:, [2, 3, 0, 1]], edges)[keep]


def _segments(rings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Directed segments of polygons, each with its polygon to the left, and the polygon's number; rings of fewer than three vertices have none."""
    ring = rings.flatten()
    counts, many = (v.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for v in (rings, ring))
    xy = ring.flatten()
    p = np.column_stack([xy.field(n).to_numpy(zero_copy_only=False) for n in ("x", "y")]).astype(np.float64)
    polygon, begin = np.repeat(np.arange(len(rings)), counts), np.cumsum(many) - many
    outer = np.arange(len(ring)) == np.repeat(np.cumsum(counts) - counts, counts)
    of = np.repeat(np.arange(len(ring)), many)
    after = np.arange(len(p)) + 1
    after[(begin + many - 1)[many > 0]] = begin[many > 0]
    q = p[after]
    low = p[begin[of]]
    turn = (p[:, 0] - low[:, 0]) * (q[:, 1] - low[:, 1]) - (q[:, 0] - low[:, 0]) * (p[:, 1] - low[:, 1])
    back = ((np.bincount(of, turn, len(ring)) > 0) != outer)[of]
    s = np.where(back[:, None], np.column_stack([q, p]), np.column_stack([p, q]))
    some = (many > 2)[of]
    return s[some], polygon[of][some]


def _edges(polygons: DataFrame, keys: list[str], size: float) -> DataFrame:
    """Boundary of each group's union, by squares: ``keys``, ``__gx``, ``__gy``, ``x1``, ``y1``, ``x2``, ``y2`` in steps. Squares also have their own borders where area lies beside them."""
    box = {f"__{n}{k}": f(F.get("rings", F.lit(0)).getField(n)) for n in ("x", "y") for k, f in ((0, F.array_min), (1, F.array_max))}
    dealt = polygons.where(F.size(F.get("rings", F.lit(0))) > 2).select(*keys, "rings").withColumns(box)
    dealt = dealt.withColumn("__g", F.explode(_squares(F.col("__x0"), F.col("__x1"), F.col("__y0"), F.col("__y1"), size)))
    dealt = dealt.select(*keys, F.col("__g.gx").alias("__gx"), F.col("__g.gy").alias("__gy"), "rings")
    head = ", ".join(f"`{k}` {polygons.schema[k].dataType.simpleString()}" for k in keys)

    def unite(key: tuple, rows: pa.Table) -> pa.Table:
        gx, gy = key[-2].as_py(), key[-1].as_py()
        s, own = _segments(rows["rings"].combine_chunks())
        for axis, at, below in ((0, gx * size, False), (0, (gx + 1) * size, True), (1, gy * size, False), (1, (gy + 1) * size, True)):
            s, own = parted(s, own, axis, np.full(len(s), at))
            s = pressed(s, axis, np.full(len(s), at), below)
        s = np.clip(np.rint((s - (gx * size, gy * size) * 2) / size * STEPS), 0, STEPS).astype(np.int64)
        edges = united(s, own, STEPS) + np.array([gx, gy, gx, gy], np.int64) * STEPS
        own = [pa.repeat(k, len(edges)) for k in key]
        return pa.Table.from_arrays([*own, *(pa.array(edges[:, k]) for k in range(4))], names=[*keys, "__gx", "__gy", *ENDS])

    return dealt.groupBy(*keys, "__gx", "__gy").applyInArrow(unite, f"{head}, __gx long, __gy long, x1 long, y1 long, x2 long, y2 long")


def union_measures(polygons: DataFrame, keys: list[str], size: float) -> DataFrame:
    """Area and centroid of the union of each group's polygons: ``keys``, ``area``, ``cx``, ``cy``; null centroid of no area.

    Squares of ``size`` that a polygon's box touches each unite what lies in them, in a task of their own; what they say of the edges is
    summed, and borders of squares cancel out. Repeated polygons, holes, and edges that touch or coincide count once. Polygons that are null or have
    fewer than three vertices have no area; a group that has only such has no row. A square with many segments is cut into smaller cells in its
    task. Choose ``size`` so that a task can hold the polygons of a square.
    """
    e = _edges(polygons, keys, size)
    # the edges of a square are closed, so areas and moments are taken from its corner and moved; no large numbers are subtracted
    x1, y1, x2, y2 = ((F.col(c) - F.shiftleft("__gx" if c[0] == "x" else "__gy", BITS)).cast("double") * (size / STEPS) for c in ENDS)
    area = (x1 - x2) * (y1 + y2) / 2
    mx, my = (y2 - y1) * (x1 * x1 + x1 * x2 + x2 * x2) / 6, (x1 - x2) * (y1 * y1 + y1 * y2 + y2 * y2) / 6
    out = e.groupBy(*keys).agg(F.sum(area).alias("area"), F.sum(mx + area * F.col("__gx") * size).alias("__mx"), F.sum(my + area * F.col("__gy") * size).alias("__my"))
    return out.select(*keys, "area", *[F.try_divide(F.col(m), F.col("area")).alias(c) for m, c in (("__mx", "cx"), ("__my", "cy"))])


def union_boundary(polygons: DataFrame, keys: list[str], size: float) -> DataFrame:
    """Directed edges of each group's union, with the area to their left and without the squares' borders: ``keys``, ``x1``, ``y1``, ``x2``, ``y2`` in steps.

    What two squares say of the border between them is summed along it: where both have area it cancels out, and what
    is left bounds the union.
    """
    e = _edges(polygons, keys, size)
    line = lambda c: F.when((F.col(f"{c}1") == F.col(f"{c}2")) & (F.col(f"{c}1") % STEPS == 0), F.shiftright(F.col(f"{c}1"), BITS))
    e = e.withColumns({"__v": line("x"), "__h": line("y")})
    inner = e.where("__v is null and __h is null").select(*keys, *ENDS)
    upright = F.col("__v").isNotNull()
    a, b = (F.when(upright, F.col(f"y{k}")).otherwise(F.col(f"x{k}")) for k in (1, 2))
    border = e.where("__v is not null or __h is not null").select(*keys, upright.alias("__up"), F.coalesce("__v", "__h").alias("__line"), F.least(a, b).alias("__a"), F.greatest(a, b).alias("__b"), F.when(b > a, 1).otherwise(-1).alias("__d"))
    border = border.withColumn("__cell", F.shiftright("__a", BITS))
    on = [*keys, "__up", "__line", "__cell"]
    ends = border.select(*on, F.explode(F.array(F.struct(F.col("__a").alias("at"), F.col("__d").alias("d")), F.struct(F.col("__b").alias("at"), (-F.col("__d")).alias("d")))).alias("e"))
    ends = ends.groupBy(*on, F.col("e.at").alias("__at")).agg(F.sum("e.d").alias("__d"))
    w = Window.partitionBy(*on).orderBy("__at")
    run = ends.select(*on, "__at", F.sum("__d").over(w).alias("__net"), F.lead("__at").over(w).alias("__to")).where("__net != 0 and __to is not null")
    lo, hi = F.when(F.col("__net") > 0, F.col("__at")).otherwise(F.col("__to")), F.when(F.col("__net") > 0, F.col("__to")).otherwise(F.col("__at"))
    at = F.shiftleft(F.col("__line"), BITS)
    left = run.select(*keys, *[F.when(F.col("__up"), at if c[0] == "x" else v).otherwise(v if c[0] == "x" else at).alias(c) for c, v in (("x1", lo), ("y1", lo), ("x2", hi), ("y2", hi))])
    return inner.unionByName(left)


def chained(lines: list[list[tuple[int, int]]]) -> list[list[tuple[int, int]]]:
    """Lines put together end to start until none goes on; where several go on, the one that turns most to the left, so rings whose areas touch at a point stay apart."""
    starts: dict[tuple[int, int], list[int]] = defaultdict(list)
    for k, line in enumerate(lines):
        if line[0] != line[-1]:
            starts[line[0]].append(k)
    ends = {line[-1] for line in lines if line[0] != line[-1]}
    out, used = [line for line in lines if line[0] == line[-1]], set()

    def turn(line: list[tuple[int, int]], k: int) -> float:
        (ax, ay), (bx, by), (cx, cy) = line[-2], line[-1], lines[k][1]
        u, v = complex(bx - ax, by - ay), complex(cx - bx, cy - by)
        return float(np.angle(v / u))

    # lines that nothing leads to come first, so that open ones are followed from their beginning
    for first in sorted(range(len(lines)), key=lambda k: lines[k][0] in ends):
        if first in used or lines[first][0] == lines[first][-1]:
            continue
        used.add(first)
        line = list(lines[first])
        while line[-1] != line[0]:
            after = [k for k in starts[line[-1]] if k not in used]
            if not after:
                break
            k = max(after, key=lambda k: turn(line, k)) if len(after) > 1 else after[0]
            used.add(k)
            line += lines[k][1:]
        out.append(line)
    return out


def union_rings(polygons: DataFrame, keys: list[str], size: float) -> DataFrame:
    """Rings of each group's union: ``keys``, ``ring`` (array of x, y, the first vertex again at the end), ``hole``, ``area`` (of the ring by itself).

    The edges of each square are chained there; lines that stay open meet those of the neighbours in squares twice as large, and so on until all are
    closed, so a task has the open lines of one square at a time. Each level is written to the shared folder.
    """
    spark = polygons.sparkSession
    schema = ", ".join(f"`{k}` {polygons.schema[k].dataType.simpleString()}" for k in keys) + ", line array<struct<x: long, y: long>>, closed boolean"

    def chain(key: tuple, rows: pa.Table) -> pa.Table:
        got = chained([[(v["x"], v["y"]) for v in line] for line in rows["line"].to_pylist()])
        lines = pa.array([[{"x": x, "y": y} for x, y in line] for line in got], pa.list_(pa.struct([("x", pa.int64()), ("y", pa.int64())])))
        return pa.Table.from_arrays([*(pa.repeat(k, len(got)) for k in key[:-2]), lines, pa.array([line[0] == line[-1] for line in got])], names=[*keys, "line", "closed"])

    def kept(df: DataFrame, name: str) -> DataFrame:
        path = scratch_folder(spark, name)
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    pair = lambda k: F.struct(F.col(f"x{k}").alias("x"), F.col(f"y{k}").alias("y"))
    edges = kept(union_boundary(polygons, keys, size), "edges")
    low = edges.agg(*[F.min(F.least(f"{n}1", f"{n}2")).alias(n) for n in ("x", "y")]).first()
    level, done, shift = edges.select(*keys, F.array(pair(1), pair(2)).alias("line"), F.lit(False).alias("closed")), [], BITS
    while True:
        cell = [F.shiftright(F.array_min(f"line.{n}") - F.lit(low[n]).cast("long"), shift).alias(f"__g{n}") for n in ("x", "y")]
        level = kept(level.groupBy(*keys, *cell).applyInArrow(chain, schema), "lines")
        done.append(level.where("closed"))
        level, shift = level.where("not closed"), shift + 1
        if shift > 62 or level.isEmpty():  # all of 64 bits: what is open now stays open
            break
    rings = done[0]
    for d in done[1:]:
        rings = rings.unionByName(d)
    unit = size / STEPS
    ring = F.transform("line", lambda v: F.struct((v["x"] * unit).alias("x"), (v["y"] * unit).alias("y")))
    rings = rings.select(*keys, ring.alias("ring"))
    n, first = F.size("ring"), F.col("ring")[0]
    cross = F.transform(F.sequence(F.lit(1), n - 1), lambda k: (F.col("ring")[k - 1]["x"] - first["x"]) * (F.col("ring")[k]["y"] - first["y"]) - (F.col("ring")[k]["x"] - first["x"]) * (F.col("ring")[k - 1]["y"] - first["y"]))
    signed = F.aggregate(cross, F.lit(0.0), lambda s, v: s + v) / 2
    return rings.withColumn("__s", signed).select(*keys, "ring", (F.col("__s") < 0).alias("hole"), F.abs("__s").alias("area"))
