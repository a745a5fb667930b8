"""Lines against polygons, points at shares of a line, unions of boxes, and small frames around them.

Lines and rings are arrays of (x, y) structs; a ring may leave out its first vertex at the end.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import polar_stereographic
from .grid import _squares, in_polygon, line_length


def _turn(a: Column, b: Column, c: Column) -> Column:
    return (b["x"] - a["x"]) * (c["y"] - a["y"]) - (b["y"] - a["y"]) * (c["x"] - a["x"])


def segments_meet(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Whether the segments a-b and c-d have a point in common, ends included."""
    apart = F.lit(False)
    for n in ("x", "y"):
        apart = apart | (F.greatest(a[n], b[n]) < F.least(c[n], d[n])) | (F.greatest(c[n], d[n]) < F.least(a[n], b[n]))
    return ~apart & (F.signum(_turn(a, b, c)) * F.signum(_turn(a, b, d)) <= 0) & (F.signum(_turn(c, d, a)) * F.signum(_turn(c, d, b)) <= 0)


def line_meets_polygon(line: Column, ring: Column) -> Column:
    """Whether a line has a point in a polygon or on its ring: it crosses the ring, or begins inside."""
    n = F.size(ring)
    crossed = F.exists(F.sequence(F.lit(1), F.greatest(F.size(line) - 1, F.lit(1))), lambda k: F.exists(F.sequence(F.lit(0), n - 1), lambda j: segments_meet(F.get(line, k - 1), F.coalesce(F.get(line, k), line[0]), F.get(ring, j), F.get(ring, (j + 1) % n))))
    return crossed | in_polygon(line[0]["x"], line[0]["y"], ring)


def _bounds(shape: str, prefix: str) -> dict[str, Column]:
    return {f"{prefix}{n}{k}": f(F.col(f"{shape}.{n}")) for n in ("x", "y") for k, f in ((0, F.array_min), (1, F.array_max))}


def meeting_pairs(lines: DataFrame, polygons: DataFrame, line_key: str, polygon_key: str, size: float) -> DataFrame:
    """``line_key`` and ``polygon_key`` of the lines (``line``) and polygons (``ring``) that meet; null and empty shapes meet nothing.

    Both are keyed by the squares of ``size`` that their boxes touch, and a pair is looked at in one square alone, that of the lower left corner of what
    their boxes share, so nothing is compared twice and no distinct is needed. Choose ``size`` about as large as a usual box.
    """

    def keyed(df: DataFrame, key: str, shape: str, p: str) -> DataFrame:
        own = df.where(F.size(shape) > 0).select(key, shape).withColumns(_bounds(shape, p))
        return own.withColumn("__g", F.explode(_squares(F.col(f"{p}x0"), F.col(f"{p}x1"), F.col(f"{p}y0"), F.col(f"{p}y1"), size)))

    pairs = keyed(lines, line_key, "line", "__l").join(keyed(polygons, polygon_key, "ring", "__r"), "__g")
    corner = {n: F.greatest(f"__l{n}0", f"__r{n}0") for n in ("x", "y")}
    share = (corner["x"] <= F.least("__lx1", "__rx1")) & (corner["y"] <= F.least("__ly1", "__ry1"))
    once = (F.floor(corner["x"] / size) == F.col("__g.gx")) & (F.floor(corner["y"] / size) == F.col("__g.gy"))
    return pairs.where(share & once).where(line_meets_polygon(F.col("line"), F.col("ring"))).select(line_key, polygon_key)


def lines_with_polygons(lines: DataFrame, polygons: DataFrame, line_key: str, polygon_key: str, size: float) -> DataFrame:
    """Left join of lines with all polygons that they meet; a line without one stays, with nulls."""
    pairs = meeting_pairs(lines, polygons, line_key, polygon_key, size)
    return lines.join(pairs, line_key, "left").join(polygons, polygon_key, "left")


def polygons_met(polygons: DataFrame, lines: DataFrame, polygon_key: str, line_key: str, size: float) -> DataFrame:
    """The polygons, or catalogue items given as rings, that any of the lines meets."""
    return polygons.join(meeting_pairs(lines, polygons, line_key, polygon_key, size), polygon_key, "left_semi")


def box_ring(x0: Column, x1: Column, y0: Column, y1: Column) -> Column:
    return F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1))])


def in_polygon_with_holes(px: Column, py: Column, ring: Column, holes: Column) -> Column:
    """Inside the ring and in none of the holes (an array of rings)."""
    return in_polygon(px, py, ring) & ~F.exists(holes, lambda h: in_polygon(px, py, h))


def polygon_ids(cells: DataFrame, polygons: list[tuple[int, Column, Column | None]]) -> DataFrame:
    """``cells`` with ``id``: of the polygons (number, ring, holes), in their order, the first that the cell's centre is in, or null."""
    px, py = F.col("x").cast("double"), F.col("y").cast("double")
    inside = [F.when(in_polygon(px, py, ring) if holes is None else in_polygon_with_holes(px, py, ring, holes), number) for number, ring, holes in polygons]
    return cells.withColumn("id", F.coalesce(*inside, F.lit(None).cast("int")))


def keep_where(value: str, condition: Column) -> Column:
    """The value where the condition holds, else null."""
    return F.when(condition, F.col(value))


def square_caps(line: Column, reach: float) -> Column:
    """The line made longer by ``reach`` at both ends: with flat caps its buffer has square ones."""

    def moved(end: Column, other: Column) -> Column:
        far = F.hypot(end["x"] - other["x"], end["y"] - other["y"])
        return F.struct(*[(end[c] + F.coalesce(F.try_divide((end[c] - other[c]) * reach, far), F.lit(0.0))).alias(c) for c in ("x", "y")])

    n = F.size(line)
    inner = F.slice(line, 2, F.greatest(n - 2, F.lit(0)))
    return F.when(n > 1, F.concat(F.array(moved(line[0], line[1])), inner, F.array(moved(line[n - 1], line[n - 2])))).otherwise(line)


def points_by_share(lines: DataFrame, line: str, many: int = 100) -> DataFrame:
    """``many`` points at the shares k / ``many`` of each line's length, the end left out: ``k``, ``px``, ``py``."""
    n = F.size(line)
    lengths = F.transform(F.sequence(F.lit(1), n - 1), lambda k: F.hypot(F.col(line)[k]["x"] - F.col(line)[k - 1]["x"], F.col(line)[k]["y"] - F.col(line)[k - 1]["y"]))
    p = lines.where(n > 1).withColumns({"__s": lengths, "__l": line_length(F.col(line))})
    ends = F.transform("__s", lambda v, k: F.aggregate(F.slice("__s", 1, k + 1), F.lit(0.0), lambda s, x: s + x))
    p = p.withColumn("__e", ends).select("*", F.explode(F.sequence(F.lit(0), F.lit(many - 1))).alias("k")).withColumn("__d", F.col("__l") * F.col("k") / many)
    at = F.least(F.size(F.filter("__e", lambda e: e <= F.col("__d"))), n - 2)
    p = p.withColumn("__at", at)
    begin, own = F.when(F.col("__at") > 0, F.get("__e", F.col("__at") - 1)).otherwise(0.0), F.get("__s", F.col("__at"))
    share = F.coalesce(F.try_divide(F.col("__d") - begin, own), F.lit(0.0))
    a, b = F.get(line, F.col("__at")), F.get(line, F.col("__at") + 1)
    return p.select(*lines.columns, "k", (a["x"] + (b["x"] - a["x"]) * share).alias("px"), (a["y"] + (b["y"] - a["y"]) * share).alias("py"))


def lines_equal(a: Column, b: Column) -> Column:
    """Whether two lines have the same vertices, in the one direction or the other."""
    return (a == b) | (a == F.reverse(b))


def reproject_vertices(line: Column) -> Column:
    """A line or ring, in degrees, on the polar stereographic plane, vertex by vertex."""

    def moved(v: Column) -> Column:
        x, y = polar_stereographic(v["x"], v["y"])
        return F.struct(x.alias("x"), y.alias("y"))

    return F.transform(line, moved)


#: Boxes in a piece of the plane up to which it is laid out whole, and cells that are laid out at once.
FEW_BOXES, LAID_OUT = 24, 4_000_000


def _laid_out(b: np.ndarray) -> np.ndarray:
    """Area and moments (x, y) of the union of boxes (x0, x1, y0, y1), by a grid of all their edges, some columns at a time."""
    xs, ys = np.unique(b[:, :2]), np.unique(b[:, 2:])
    at = [np.searchsorted(v, b[:, k]) for k, v in enumerate((xs, xs, ys, ys))]
    dy, my = np.diff(ys), (ys[1:] + ys[:-1]) / 2
    out, columns = np.zeros(3), max(1, LAID_OUT // len(ys))
    for begin in range(0, len(xs) - 1, columns):
        end = min(begin + columns, len(xs) - 1)
        depth = np.zeros((end - begin + 1, len(ys)), np.int32)
        i0, i1 = np.clip(at[0], begin, end) - begin, np.clip(at[1], begin, end) - begin
        for i, j, d in ((i0, at[2], 1), (i1, at[2], -1), (i0, at[3], -1), (i1, at[3], 1)):
            np.add.at(depth, (i, j), d)
        size = (depth.cumsum(axis=0).cumsum(axis=1)[:-1, :-1] > 0) * np.diff(xs[begin : end + 1])[:, None] * dy
        across = size.sum(axis=1)
        out += across.sum(), (across * (xs[begin + 1 : end + 1] + xs[begin:end]) / 2).sum(), (size.sum(axis=0) * my).sum()
    return out


def boxes_union(b: np.ndarray) -> np.ndarray:
    """Area and moments (x, y) of the union of boxes (x0, x1, y0, y1). The plane is halved until one box covers a piece, which is then done, or few
    are left; where boxes lie deep upon each other most pieces are done at once."""
    out, todo = np.zeros(3), [(b, 0)]
    while todo:
        b, stuck = todo.pop()
        if not len(b):
            continue
        x0, x1, y0, y1 = b[:, 0].min(), b[:, 1].max(), b[:, 2].min(), b[:, 3].max()
        if ((b[:, 0] == x0) & (b[:, 1] == x1) & (b[:, 2] == y0) & (b[:, 3] == y1)).any():
            area = (x1 - x0) * (y1 - y0)
            out += area, area * (x0 + x1) / 2, area * (y0 + y1) / 2
        elif len(b) <= FEW_BOXES or stuck > 3:
            out += _laid_out(b)
        else:
            wide, high = (b[:, 1] - b[:, 0]).mean() / (x1 - x0), (b[:, 3] - b[:, 2]).mean() / (y1 - y0)
            k, middle = (0, (x0 + x1) / 2) if wide <= high else (2, (y0 + y1) / 2)
            low, far = b[b[:, k] < middle].copy(), b[b[:, k + 1] > middle].copy()
            low[:, k + 1], far[:, k] = np.minimum(low[:, k + 1], middle), np.maximum(far[:, k], middle)
            stuck = stuck + 1 if 10 * min(len(low), len(far)) > 9 * len(b) else 0
            todo += [(low, stuck), (far, stuck)]
    return out


def union_of_boxes(boxes: DataFrame, keys: list[str], of_cell: int = 2_000) -> DataFrame:
    """Area and centroid of the union of each group's boxes (``x0``, ``x1``, ``y0``, ``y1``): ``keys``, ``area``, ``cx``, ``cy``.

    A group's extent is cut into so many cells that one has about ``of_cell`` boxes, but none narrower or lower than the mean box, so a box
    is dealt out to few; the cells are united apart from each other (``boxes_union``) and add up. Groups with a null key or without area have no row.
    """
    own = boxes.select(*keys, *[F.col(c).cast("double").alias(c) for c in ("x0", "x1", "y0", "y1")]).where("x1 > x0 and y1 > y0")
    g = F.ceil(F.sqrt(F.count("*") / of_cell))
    stats = [f.alias(f"__{n}{c}") for c in "xy" for n, f in (("lo", F.min(f"{c}0")), ("hi", F.max(f"{c}1")), ("n", F.greatest(F.lit(1), F.least(g, F.floor((F.max(f"{c}1") - F.min(f"{c}0")) / F.avg(F.col(f"{c}1") - F.col(f"{c}0")))))))]
    dealt = own.join(own.groupBy(*keys).agg(*stats), keys)
    for c in "xy":
        lo, hi, n, k = (F.col(f"__{v}{c}") for v in ("lo", "hi", "n", "g"))
        step = (hi - lo) / n
        cell = lambda v, d: F.least(F.greatest(F.floor((F.col(v) - lo) / step + d), F.lit(0)), n - 1)
        dealt = dealt.withColumn(f"__g{c}", F.explode(F.sequence(cell(f"{c}0", -1e-9), cell(f"{c}1", 1e-9))))
        # neighbours make the border between them in the same way; the outer ones are the boxes' own
        clipped = {f"{c}0": F.when(k > 0, F.greatest(f"{c}0", lo + k * step)).otherwise(F.col(f"{c}0")), f"{c}1": F.when(k < n - 1, F.least(f"{c}1", lo + (k + 1) * step)).otherwise(F.col(f"{c}1"))}
        dealt = dealt.withColumns(clipped).where(f"{c}1 > {c}0")
    head = ", ".join(f"`{k}` {boxes.schema[k].dataType.simpleString()}" for k in keys)

    def unite(key: tuple, rows: pa.Table) -> pa.Table:
        area, mx, my = boxes_union(np.column_stack([rows[c].to_numpy() for c in ("x0", "x1", "y0", "y1")]))
        return pa.Table.from_arrays([*(pa.repeat(k, 1) for k in key[: len(keys)]), *(pa.array([v], pa.float64()) for v in (area, mx, my))], names=[*keys, "area", "mx", "my"])

    cells = dealt.select(*keys, "__gx", "__gy", "x0", "x1", "y0", "y1").groupBy(*keys, "__gx", "__gy").applyInArrow(unite, f"{head}, area double, mx double, my double")
    out = cells.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("area", "mx", "my")])
    return out.select(*keys, "area", (F.col("mx") / F.col("area")).alias("cx"), (F.col("my") / F.col("area")).alias("cy"))


def flip_axis(df: DataFrame, keys: list[str], order: list[str], coord: str) -> DataFrame:
    """``place`` of each row along its group's axis, from 1, ascending: where the first step of ``coord``, in ``order``, goes down the axis is flipped."""
    w = Window.partitionBy(*keys).orderBy(*order)
    placed = df.withColumns({"__n": F.row_number().over(w), "__d": F.col(coord) - F.lag(coord).over(w)})
    whole = Window.partitionBy(*keys)
    down = F.max(F.when(F.col("__n") == 2, F.col("__d") < 0)).over(whole)
    return placed.withColumn("place", F.when(F.coalesce(down, F.lit(False)), F.count("*").over(whole) + 1 - F.col("__n")).otherwise(F.col("__n")).cast("int")).drop("__n", "__d")


def prefix_columns(df: DataFrame, names: list[str], prefix: str) -> DataFrame:
    return df.withColumnsRenamed({n: f"{prefix}{n}" for n in names})


def with_reference(stats: DataFrame, reference: dict[str, object]) -> DataFrame:
    """``stats`` and one row for the reference itself: its statistics are zero but for those given, other columns null."""
    row = [F.lit(reference[f.name]).cast(f.dataType) if f.name in reference else F.lit(0 if f.dataType.typeName() in ("double", "float") else None).cast(f.dataType) for f in stats.schema.fields]
    one = stats.sparkSession.range(1).select(*[c.alias(f.name) for c, f in zip(row, stats.schema.fields, strict=True)])
    return stats.unionByName(one)


def sorted_places(df: DataFrame, key: Column, order: list[Column], name: str, ranges: int = 64) -> DataFrame:
    """The place of each row in the whole order, from 1, by a sort in ranges: ``key`` is a number by which the order begins.

    Quantiles of the key cut the table into ranges; each is sorted by itself and begins after the rows of those before it, so no task
    sorts all rows. Rows of one key are in one range; rows without a key come first.
    """
    keyed = df.withColumn("__k", key.cast("double"))
    bounds = sorted(set(keyed.agg(F.percentile_approx("__k", [i / ranges for i in range(1, ranges)], 100 * ranges).alias("b")).first().b or []))
    keyed = keyed.withColumn("__r", F.when(F.col("__k").isNull(), -1).otherwise(F.size(F.filter(F.lit(bounds), lambda b: b < F.col("__k"))) if bounds else F.lit(0)))
    counts = keyed.groupBy("__r").agg(F.count("*").alias("__c"))
    before = counts.select("__r", F.coalesce(F.sum("__c").over(Window.orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__b"))  # a row for each range
    w = Window.partitionBy("__r").orderBy(F.col("__k").asc_nulls_first(), *order)
    return keyed.join(F.broadcast(before), "__r").withColumn(name, (F.col("__b") + F.row_number().over(w)).cast("int")).drop("__k", "__r", "__b")
