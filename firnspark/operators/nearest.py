"""Nearest join of points, lines and polygons: packed trees of boxes over ranges of a space-filling order, searched best first.

Shapes are arrays of (x, y) structs; one vertex is a point. A polygon's ring is closed whether or not its first vertex stands at the end again.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.sinks import scratch_folder

#: Boxes below one box of a tree.
FAN = 16
#: Rows of the left side that one task searches a range for; more are dealt out to several, each with the range's tree.
LEFT_ROWS = 20_000
#: Shapes of the left side that go down a tree together, and pairs of segments that are compared at once.
ABREAST, AT_ONCE = 1_000, 500_000


def _segments(v: np.ndarray, closed: bool) -> tuple[np.ndarray, np.ndarray]:
    if len(v) == 1:
        return v, v
    return (v, np.roll(v, -1, axis=0)) if closed else (v[:-1], v[1:])


def _inside(p: np.ndarray, a: np.ndarray, b: np.ndarray) -> bool:
    """Even-odd rule for one point and a ring's segments."""
    cross = (a[:, 1] > p[1]) != (b[:, 1] > p[1])
    a, b = a[cross], b[cross]
    return bool((p[0] < (b[:, 0] - a[:, 0]) * (p[1] - a[:, 1]) / (b[:, 1] - a[:, 1]) + a[:, 0]).sum() % 2)


def _to_segments(p: np.ndarray, a: np.ndarray, b: np.ndarray) -> float:
    """Least distance of points from segments."""
    d = b - a
    square = (d * d).sum(axis=1)
    along = ((p[:, None] - a[None]) * d[None]).sum(axis=2)
    t = np.clip(np.divide(along, square, out=np.zeros_like(along), where=square > 0), 0.0, 1.0)
    off = p[:, None] - a[None] - t[..., None] * d[None]
    return float(np.hypot(off[..., 0], off[..., 1]).min())


def _meet(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> bool:
    """Whether any segment a-b crosses or touches any c-d."""
    a, b, c, d = a[:, None], b[:, None], c[None], d[None]
    turn = lambda p, q, r: np.sign((q[..., 0] - p[..., 0]) * (r[..., 1] - p[..., 1]) - (q[..., 1] - p[..., 1]) * (r[..., 0] - p[..., 0]))
    near = (np.minimum(a, b) <= np.maximum(c, d)).all(axis=2) & (np.minimum(c, d) <= np.maximum(a, b)).all(axis=2)
    return bool((near & (turn(a, b, c) * turn(a, b, d) <= 0) & (turn(c, d, a) * turn(c, d, b) <= 0)).any())


def shape_distance(v: np.ndarray, v_closed: bool, w: np.ndarray, w_closed: bool) -> float:
    """Distance of two shapes; 0 where they have a point in common, as a polygon has with what lies in it."""
    (a, b), (c, d) = _segments(v, v_closed and len(v) > 2), _segments(w, w_closed and len(w) > 2)
    if _meet(a, b, c, d) or (w_closed and len(w) > 2 and _inside(v[0], c, d)) or (v_closed and len(v) > 2 and _inside(w[0], a, b)):
        return 0.0
    return min(_to_segments(np.concatenate([a, b[-1:]]), c, d), _to_segments(np.concatenate([c, d[-1:]]), a, b))


class Shapes:
    """Shapes as one array of vertices, to compare many pairs at once."""

    def __init__(self, shapes: pa.Array, closed: bool):
        xy = shapes.flatten()
        self.v = np.column_stack([xy.field(n).to_numpy(zero_copy_only=False) for n in ("x", "y")]).astype(np.float64)
        self.many, self.closed = shapes.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), closed
        self.first = np.cumsum(self.many) - self.many

    def __getitem__(self, k: int) -> np.ndarray:
        return self.v[self.first[k] : self.first[k] + self.many[k]]

    def alike(self, k: np.ndarray, n: int) -> np.ndarray:
        """Vertices of shapes that all have ``n``."""
        return self.v[self.first[k][:, None] + np.arange(n)]


def shape_distances(a: Shapes, b: Shapes, i: np.ndarray, j: np.ndarray, met: bool = False) -> np.ndarray:
    """``shape_distance`` of the pairs ``i``, ``j``; with ``met`` 0 for those that have a point in common and 1 for others."""
    out = np.empty(len(i))
    kind = a.many[i] * (int(b.many.max()) + 1 if len(b.many) else 1) + b.many[j]
    order = np.argsort(kind, kind="stable")
    cuts = np.flatnonzero(np.diff(kind[order])) + 1
    for run in np.split(order, cuts) if len(order) else ():
        n, m = int(a.many[i[run[0]]]), int(b.many[j[run[0]]])
        if n * m > AT_ONCE:
            for k in run:
                d = shape_distance(a[i[k]], a.closed, b[j[k]], b.closed)
                out[k] = float(d > 0) if met else d
            continue
        for at in range(0, len(run), max(1, AT_ONCE // (n * m))):
            k = run[at : at + max(1, AT_ONCE // (n * m))]
            out[k] = _alike_distances(a.alike(i[k], n), a.closed, b.alike(j[k], m), b.closed, met)
    return out


def _ends(v: np.ndarray, closed: bool) -> tuple[np.ndarray, np.ndarray]:
    if v.shape[1] == 1:
        return v, v
    return (v, np.roll(v, -1, axis=1)) if closed and v.shape[1] > 2 else (v[:, :-1], v[:, 1:])


def _alike_distances(v: np.ndarray, v_closed: bool, w: np.ndarray, w_closed: bool, met: bool) -> np.ndarray:
    (a, b), (c, d) = _ends(v, v_closed), _ends(w, w_closed)
    part = lambda s, far: (s[:, :, None] if not far else s[:, None])
    (ax, ay), (bx, by), (cx, cy), (dx, dy) = ((part(s[..., 0], far), part(s[..., 1], far)) for s, far in ((a, 0), (b, 0), (c, 1), (d, 1)))
    near = (np.minimum(ax, bx) <= np.maximum(cx, dx)) & (np.minimum(cx, dx) <= np.maximum(ax, bx)) & (np.minimum(ay, by) <= np.maximum(cy, dy)) & (np.minimum(cy, dy) <= np.maximum(ay, by))
    turn = lambda px, py, qx, qy, rx, ry: np.sign((qx - px) * (ry - py) - (qy - py) * (rx - px))
    near &= turn(ax, ay, bx, by, cx, cy) * turn(ax, ay, bx, by, dx, dy) <= 0
    near &= turn(cx, cy, dx, dy, ax, ay) * turn(cx, cy, dx, dy, bx, by) <= 0
    meet = near.any(axis=(1, 2))
    for one, s, (p, q), closed in ((v, w, (c, d), w_closed), (w, v, (a, b), v_closed)):
        if closed and s.shape[1] > 2:
            x, y = one[:, :1, 0], one[:, :1, 1]
            cross = (p[..., 1] > y) != (q[..., 1] > y)
            with np.errstate(divide="ignore", invalid="ignore"):
                right = x < (q[..., 0] - p[..., 0]) * (y - p[..., 1]) / (q[..., 1] - p[..., 1]) + p[..., 0]
            meet |= (cross & right).sum(axis=1) % 2 == 1
    out = (~meet).astype(np.float64)
    if met or meet.all():
        return out
    k = ~meet
    a, b, c, d = a[k], b[k], c[k], d[k]
    own = []
    for p, s, e in ((np.concatenate([a, b[:, -1:]], axis=1), c, d), (np.concatenate([c, d[:, -1:]], axis=1), a, b)):
        step = e - s
        square = (step[..., 0] * step[..., 0] + step[..., 1] * step[..., 1])[:, None]
        offx, offy, sx, sy = p[:, :, None, 0] - s[:, None, :, 0], p[:, :, None, 1] - s[:, None, :, 1], step[:, None, :, 0], step[:, None, :, 1]
        along = offx * sx + offy * sy
        t = np.clip(np.divide(along, square, out=np.zeros_like(along), where=square > 0), 0.0, 1.0)
        own.append(np.hypot(offx - t * sx, offy - t * sy).min(axis=(1, 2)))
    out[k] = np.minimum(*own)
    return out


class PackedTree:
    """Boxes (x0, x1, y0, y1) in the order of a curve, and above each ``FAN`` of them the box around them, up to one."""

    def __init__(self, boxes: np.ndarray):
        self.levels = [boxes]
        while len(self.levels[-1]) > 1:
            b = self.levels[-1]
            at = np.arange(0, len(b), FAN)
            low, high = np.minimum.reduceat(b[:, [0, 2]], at), np.maximum.reduceat(b[:, [1, 3]], at)
            self.levels.append(np.column_stack([low[:, 0], high[:, 0], low[:, 1], high[:, 1]]))

    def nearest(self, box: np.ndarray, distance, bound: float) -> tuple[float, list[int]]:
        """The least distance that is at most ``bound``, and all leaves that have it. Boxes are opened nearest first, and none beyond the best so far."""
        best, hits = bound, []
        queue = [(0.0, len(self.levels) - 1, 0)]
        while queue:
            far, level, k = heapq.heappop(queue)
            if far > best:
                break
            if level < 0:
                d = distance(k)
                if d < best or not hits and d == best:
                    best, hits = d, [k]
                elif d == best:
                    hits.append(k)
                continue
            here = slice(k * FAN, (k + 1) * FAN) if level < len(self.levels) - 1 else slice(0, 1)
            gaps = box_distance(box, self.levels[level][here])
            for j in np.flatnonzero(gaps <= best).tolist():
                heapq.heappush(queue, (float(gaps[j]), level - 1, here.start + j))
        return best, hits


    def candidates(self, boxes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each of many boxes the leaves that can be nearest to what it holds, if they are no farther than its bound: box, leaf, least distance."""
        i, j, bounds = np.arange(len(boxes)), np.zeros(len(boxes), np.int64), bounds.copy()
        for level in range(len(self.levels) - 1, -1, -1):
            if level < len(self.levels) - 1:
                i, j = np.repeat(i, FAN), (j[:, None] * FAN + np.arange(FAN)).ravel()
                there = j < len(self.levels[level])
                i, j = i[there], j[there]
            own, there = boxes[i], self.levels[level][j]
            far = np.hypot(np.maximum(there[:, 1] - own[:, 0], own[:, 1] - there[:, 0]), np.maximum(there[:, 3] - own[:, 2], own[:, 3] - there[:, 2]))
            np.minimum.at(bounds, i, far * (1 + 1e-12))
            least = np.hypot(np.maximum(0.0, np.maximum(there[:, 0] - own[:, 1], own[:, 0] - there[:, 1])), np.maximum(0.0, np.maximum(there[:, 2] - own[:, 3], own[:, 2] - there[:, 3])))
            near = least <= bounds[i] * (1 + 1e-12)
            i, j, least = i[near], j[near], least[near]
        return i, j, least

def box_distance(box: np.ndarray, boxes: np.ndarray) -> np.ndarray:
    dx = np.maximum(0.0, np.maximum(boxes[:, 0] - box[1], box[0] - boxes[:, 1]))
    dy = np.maximum(0.0, np.maximum(boxes[:, 2] - box[3], box[2] - boxes[:, 3]))
    return np.hypot(dx, dy)


def _curve(x: Column, y: Column, box: tuple[float, float, float, float]) -> Column:
    """Place of a point along a Z-order of 2**16 by 2**16 cells over a box (x0, x1, y0, y1)."""

    def spread(c: Column, lo: float, hi: float) -> Column:
        v = F.least(F.greatest(F.floor((c - lo) / max(hi - lo, 1e-300) * 65535), F.lit(0)), F.lit(65535)).cast("long")
        for by, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
            v = v.bitwiseOR(F.shiftleft(v, by)).bitwiseAND(F.lit(mask).cast("long"))
        return v

    return spread(x, *box[:2]).bitwiseOR(F.shiftleft(spread(y, *box[2:]), 1))


def _boxed(df: DataFrame, key: str, shape: str) -> DataFrame:
    own = df.where(F.size(shape) > 0).select(F.col(key).alias("k"), F.col(shape).alias("s"))
    return own.withColumns({"x0": F.array_min("s.x"), "x1": F.array_max("s.x"), "y0": F.array_min("s.y"), "y1": F.array_max("s.y")}).where("x0 is not null and y0 is not null")


def nearest_shapes(left: DataFrame, right: DataFrame, left_key: str, right_key: str, left_shape: str = "shape", right_shape: str = "shape", left_closed: bool = False, right_closed: bool = True, ranges: int | None = None, most: float = float("inf")) -> DataFrame:
    """For each shape of ``left`` the nearest of ``right`` and the ``distance``: ``left_key``, ``right_key``, ``distance``. Equally near ones give
    several rows; a null or empty shape, or one without another within ``most``, gives none. Keys must be unique and have different names.

    ``right`` is written once in ranges of a space-filling order of its centres (as many as Spark has shuffle partitions, or ``ranges``). A shape of ``left`` first
    asks the range that its own centre falls in, which bounds the distance; then only ranges whose box is within that bound.
    The driver sees a box and an end of the order for each range. Ranges that many ask are searched by several tasks.
    """
    spark = right.sparkSession
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    b = _boxed(right, right_key, right_shape)
    span = b.agg(*[F.min(c) if c.endswith("0") else F.max(c) for c in ("x0", "x1", "y0", "y1")]).first()
    lk, rk = (df.schema[key].dataType.simpleString() for df, key in ((left, left_key), (right, right_key)))
    schema = f"`{left_key}` {lk}, `{right_key}` {rk}, distance double"
    if span[0] is None:
        return left.limit(0).select(F.col(left_key), F.lit(None).cast(rk).alias(right_key), F.lit(None).cast("double").alias("distance"))
    curve = _curve((F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2, tuple(span))
    path = scratch_folder(spark, "ranges")
    b.withColumn("z", curve).repartitionByRange(ranges, "z", "k").sortWithinPartitions("z").withColumn("range", F.spark_partition_id()).write.parquet(path)
    held = spark.read.parquet(path)
    tops = sorted(held.groupBy("range").agg(F.min("x0"), F.max("x1"), F.min("y0"), F.max("y1"), F.max("z")).collect())
    names, boxes, ends = np.array([r[0] for r in tops]), np.array([r[1:5] for r in tops], np.float64), np.array([r[5] for r in tops])
    known = spark.sparkContext.broadcast((names, boxes, ends))

    def deal(asked: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Both sides by range and, where more than ``LEFT_ROWS`` ask, by one of several parts."""
        parts = F.broadcast(asked.groupBy("range").agg(F.ceil(F.count("*") / LEFT_ROWS).cast("int").alias("parts")))  # a row for each range
        a = asked.join(parts, "range").withColumn("part", F.pmod(F.xxhash64("k"), F.col("parts")).cast("int")).drop("parts")
        return a, held.join(parts, "range").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")

    def box_of(table: pa.Table) -> np.ndarray:
        return np.column_stack([table[c].to_numpy() for c in ("x0", "x1", "y0", "y1")]).astype(np.float64)

    def search(a: pa.Table, b: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Rows of ``a`` and of ``b`` and their distance. Shapes that meet are found first, and only for what meets nothing are distances taken."""
        order = np.argsort(b["z"].to_numpy(), kind="stable")
        b = b.take(pa.array(order))
        own, theirs = Shapes(a["s"].combine_chunks(), left_closed), Shapes(b["s"].combine_chunks(), right_closed)
        tree, at, bounds = PackedTree(box_of(b)), box_of(a), a["bound"].to_numpy()
        for begin in range(0, len(at), ABREAST):
            some = slice(begin, begin + ABREAST)
            best = bounds[some].copy()
            i, j, least = tree.candidates(at[some], best)
            touch = least == 0
            ti, tj = i[touch], j[touch]
            meet = shape_distances(own, theirs, begin + ti, tj, True) == 0
            yield begin + ti[meet], order[tj[meet]], np.zeros(meet.sum())
            apart = np.ones(len(best), bool)
            apart[ti[meet]] = False
            i, j, least = (v[apart[i]] for v in (i, j, least))
            # the pair that looks nearest bounds the others
            by = np.lexsort((least, i))
            i, j, least = i[by], j[by], least[by]
            first = np.ones(len(i), bool)
            first[1:] = i[1:] != i[:-1]
            d = np.full(len(i), np.inf)
            d[first] = shape_distances(own, theirs, begin + i[first], j[first])
            best[i[first]] = np.minimum(best[i[first]], d[first])
            more = ~first & (least <= best[i] * (1 + 1e-12))
            d[more] = shape_distances(own, theirs, begin + i[more], j[more])
            np.minimum.at(best, i, d)
            hit = d <= best[i]
            yield begin + i[hit], order[j[hit]], d[hit]

    def results(a: pa.Table, b: pa.Table, found: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> list[pa.Array]:
        k, j, d = (pa.array(np.concatenate(v)) for v in zip(*found, strict=True))
        return [a["k"].combine_chunks().take(k), b["k"].combine_chunks().take(j), d]

    def home(key: tuple, a: pa.Table, b: pa.Table) -> pa.Table:
        if not len(a) or not len(b):
            return pa.Table.from_arrays([a["k"].combine_chunks()[:0], b["k"].combine_chunks()[:0], pa.array([], pa.float64())], names=[left_key, right_key, "distance"])
        return pa.Table.from_arrays(results(a, b, search(a, b)), names=[left_key, right_key, "distance"])

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, _, ends = known.value
        for batch in batches:
            at = np.minimum(np.searchsorted(ends, batch.column(batch.schema.get_field_index("z")).to_numpy()), len(names) - 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names[at], pa.int32())], names=[*batch.schema.names, "range"])

    mine = _boxed(left, left_key, left_shape).withColumn("z", curve)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in mine.schema.fields)
    mine = mine.mapInArrow(places, f"{kinds}, range int").withColumn("bound", F.lit(float(most)))
    a, b = deal(mine)
    first = scratch_folder(spark, "nearest")
    a.groupBy("range", "part").cogroup(b.groupBy("range", "part")).applyInArrow(home, schema).write.parquet(first)
    first = spark.read.schema(schema).parquet(first)

    def beyond(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, boxes, _ = known.value
        for batch in batches:
            column = {n: batch.column(k) for k, n in enumerate(batch.schema.names)}
            own = np.column_stack([column[c].to_numpy() for c in ("x0", "x1", "y0", "y1")])
            rows, to = [], []
            for k, (box, bound, at) in enumerate(zip(own, column["bound"].to_numpy(), column["range"].to_numpy(), strict=True)):
                others = names[(box_distance(box, boxes) <= bound) & (names != at)]
                rows += [k] * len(others)
                to += others.tolist()
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([*(c.take(take) for n, c in column.items() if n != "range"), pa.array(to, pa.int32())], names=[*(n for n in column if n != "range"), "range"])

    bound = first.groupBy(F.col(left_key).alias("k")).agg(F.min("distance").alias("best"))
    asked = mine.join(bound, "k", "left").withColumn("bound", F.coalesce("best", "bound")).drop("best")
    names_ = [n for n in asked.columns if n != "range"]
    asked = asked.mapInArrow(beyond, ", ".join(f"{n} {asked.schema[n].dataType.simpleString()}" for n in names_) + ", range int")
    a, b = deal(asked)
    more = scratch_folder(spark, "beyond")  # read twice
    a.groupBy("range", "part").cogroup(b.groupBy("range", "part")).applyInArrow(home, schema).write.parquet(more)
    both = first.unionByName(spark.read.schema(schema).parquet(more))
    least = both.groupBy(left_key).agg(F.min("distance").alias("__d"))
    return both.join(least, left_key).where(F.col("distance") == F.col("__d")).select(left_key, right_key, "distance")
