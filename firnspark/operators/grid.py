"""Grids as tables of cells, and lines, boxes and polygons over them.

A grid is rows (``y``, ``x``, values) with integer cell numbers or coordinates; a missing cell or a null is no data. Lines and
polygons are arrays of (x, y) structs or, where a whole table is given, rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import normalised_difference


def nan_to_null(df: DataFrame, *names: str) -> DataFrame:
    """Null for NaN, in the columns named or in all of floating point. Every source goes through this: NaN ranks as the largest number otherwise."""
    own = names or [f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")]
    return df.withColumns({n: F.when(~F.isnan(n), F.col(n)) for n in own})


def cells_of(df: DataFrame, row: str, array: str, name: str = "z") -> DataFrame:
    """One row for each element of an array column: ``y``, ``x`` (from 0), value in double precision."""
    return df.select(F.col(row).alias("y"), F.posexplode(array).alias("x", "__v")).select("y", "x", F.col("__v").cast("double").alias(name))


def clip_box(cells: DataFrame, x0, x1, y0, y1) -> DataFrame:
    return cells.where((F.col("x") >= x0) & (F.col("x") <= x1) & (F.col("y") >= y0) & (F.col("y") <= y1))


def pad_box(cells: DataFrame, x0: int, x1: int, y0: int, y1: int, value: str, fill: float) -> DataFrame:
    """All cells of the box, those that aren't there with the fill. Rows of the box are made where they are needed, so only cells move."""
    spark = cells.sparkSession
    frame = spark.range(y0, y1 + 1).select(F.col("id").alias("y"), F.explode(F.sequence(F.lit(x0), F.lit(x1))).alias("x"))
    return frame.join(cells.select("y", "x", value), ["y", "x"], "left").withColumn(value, F.coalesce(value, F.lit(fill)))


def mask_bits(cells: DataFrame, bits: DataFrame, value: str, fill: float) -> DataFrame:
    """The fill where the value is the fill already or the bit mask is above 0; a cell without a mask stays."""
    joined = cells.join(bits.select("y", "x", F.col("bits").alias("__b")), ["y", "x"], "left")
    return joined.withColumn(value, F.when((F.col(value) == fill) | (F.col("__b") > 0), F.lit(fill)).otherwise(F.col(value))).drop("__b")


def no_data(c: Column | str, fill: float) -> Column:
    return F.nullif(F.col(c) if isinstance(c, str) else c, F.lit(fill))


def stable_mask(cells: DataFrame, green: str, nir: str) -> DataFrame:
    """1 where the median over time of the normalised difference is below 0, else 0; a cell without data is 0."""
    med = cells.groupBy("y", "x").agg(F.median(normalised_difference(green, nir)).alias("m"))
    return med.select("y", "x", F.coalesce(F.when(F.col("m") < 0, 1), F.lit(0)).alias("mask"))


def block_mean(cells: DataFrame, factor: int, value: str) -> DataFrame:
    """Mean and count by block of ``factor`` by ``factor`` cells: an approximation of bilinear down-sampling."""
    by = [F.floor(F.col(c) / factor).cast("long").alias(c) for c in ("y", "x")]
    return cells.groupBy(*by).agg(F.avg(value).alias(value), F.median(value).alias("med"), F.count(value).alias("n"))


def triangle_resample(cells: DataFrame, factor: int, value: str) -> DataFrame:
    """Down-sampling with the bilinear kernel widened to the factor: a triangle-weighted mean around each block's centre."""
    def weights(c: str) -> Column:
        centre = (F.col(c) + 0.5) / factor - 0.5
        low = F.floor(centre).cast("long")
        return F.array(*[F.struct((low + k).alias("k"), (1 - F.abs(centre - (low + k))).alias("w")) for k in (0, 1)])

    spread = cells.where(F.col(value).isNotNull()).select(value, F.explode(weights("y")).alias("b"), weights("x").alias("a")).select(value, "b", F.explode("a").alias("a"))
    w = F.col("a.w") * F.col("b.w")
    out = spread.groupBy(F.col("b.k").alias("y"), F.col("a.k").alias("x")).agg((F.sum(F.col(value) * w) / F.sum(w)).alias(value))
    last = cells.agg((F.floor(F.max("y") / factor)).alias("my"), (F.floor(F.max("x") / factor)).alias("mx"))
    return out.join(F.broadcast(last), (F.col("y") >= 0) & (F.col("x") >= 0) & (F.col("y") <= F.col("my")) & (F.col("x") <= F.col("mx"))).select("y", "x", value)


def merge_grids(frames: list[DataFrame], on: list[str]) -> DataFrame:
    """Full outer join on the coordinates; of a column that several grids have the first one's value counts."""

    def two(a: DataFrame, b: DataFrame) -> DataFrame:
        both = [c for c in b.columns if c in a.columns and c not in on]
        out = a.join(b.withColumnsRenamed({c: f"__{c}" for c in both}), on, "full")
        return out.withColumns({c: F.coalesce(c, f"__{c}") for c in both}).drop(*[f"__{c}" for c in both])

    return reduce(two, frames)


def subtract(new: DataFrame, old: DataFrame, on: list[str], value: str) -> DataFrame:
    """New less old where both have the cell."""
    return new.select(*on, F.col(value).alias("__n")).join(old.select(*on, F.col(value).alias("__o")), on).select(*on, (F.col("__n") - F.col("__o")).alias(value))


def labels_to_columns(df: DataFrame, keys: list[str], label: str, labels: list, value: str) -> DataFrame:
    """One column for each label of a dimension."""
    return df.groupBy(*keys).pivot(label, labels).agg(F.first(value))


# points between cells


def sample_bilinear(cells: DataFrame, points: DataFrame, value: str, last_x: int, last_y: int) -> DataFrame:
    """``points`` (with ``px``, ``py`` in cell units) and the bilinear value among its four cells; null outside the grid and beside no data.

    A point on the last row or column is between it and the one before. Each point asks for four cells by key, so points and cells
    both move once.
    """
    inside = F.col("px").between(0, last_x) & F.col("py").between(0, last_y)
    p = points.withColumn("__id", F.struct(*points.columns))
    p = p.withColumns({"__x": F.least(F.floor("px"), F.lit(last_x - 1)).cast("int"), "__y": F.least(F.floor("py"), F.lit(last_y - 1)).cast("long")})
    fx, fy = F.col("px") - F.col("__x"), F.col("py") - F.col("__y")
    corners = [(dx, dy, (fx if dx else 1 - fx) * (fy if dy else 1 - fy)) for dx in (0, 1) for dy in (0, 1)]
    asked = p.where(inside).select("__id", F.explode(F.array(*[F.struct((F.col("__x") + dx).alias("x"), (F.col("__y") + dy).alias("y"), w.alias("w")) for dx, dy, w in corners])).alias("c"))
    asked = asked.select("__id", "c.x", "c.y", "c.w")
    got = asked.join(cells.select("y", "x", F.col(value).alias("__v")), ["y", "x"]).groupBy("__id").agg(F.sum(F.col("w") * F.col("__v")).alias("__s"), F.count("__v").alias("__n"))
    got = got.select("__id", F.when(F.col("__n") == 4, F.col("__s")).alias(value))
    return p.join(got, "__id", "left").select(*points.columns, value)


def _vertex_lengths(line: Column) -> Column:
    n = F.size(line)
    return F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda k: F.when(n > 1, F.hypot(line[k]["x"] - line[k - 1]["x"], line[k]["y"] - line[k - 1]["y"])).otherwise(F.lit(0.0)))


def line_length(line: Column) -> Column:
    return F.aggregate(_vertex_lengths(line), F.lit(0.0), lambda s, v: s + v)


def line_centroid(line: Column) -> Column:
    """Centre of mass of the line's segments, as a struct."""
    lengths = _vertex_lengths(line)

    def mean(c: str) -> Column:
        mids = F.transform(lengths, lambda v, k: v * (line[k][c] + line[k + 1][c]) / 2)
        return F.try_divide(F.aggregate(mids, F.lit(0.0), lambda s, v: s + v), line_length(line))

    return F.struct(mean("x").alias("x"), mean("y").alias("y"))


def points_along(lines: DataFrame, line: str, every: float) -> DataFrame:
    """Points each ``every`` units from the line's start, and its end: ``step``, ``distance`` (in thousands, two decimals), ``px``, ``py``.

    The last point is that at the first multiple beyond the length, moved back to the end.
    """
    cum = F.aggregate(
        _vertex_lengths(F.col(line)), F.struct(F.array(F.lit(0.0)).alias("a"), F.lit(0.0).alias("s")),
        lambda acc, v: F.struct(F.concat(acc["a"], F.array(acc["s"] + v)).alias("a"), (acc["s"] + v).alias("s")), lambda acc: acc["a"],
    )
    p = lines.withColumn("__c", cum).withColumn("__l", F.element_at("__c", -1))
    p = p.select("*", F.posexplode(F.sequence(F.lit(0), F.ceil(F.col("__l") / every).cast("int"))).alias("step", "__k"))
    p = p.withColumn("__d", F.least(F.col("__k") * F.lit(float(every)), F.col("__l")))
    at = F.least(F.greatest(F.size(F.filter("__c", lambda c: c <= F.col("__d"))), F.lit(1)), F.greatest(F.size(line) - 1, F.lit(1)))
    p = p.withColumn("__s", at)
    a, b = F.col(line)[F.col("__s") - 1], F.coalesce(F.get(line, F.col("__s")), F.col(line)[F.col("__s") - 1])
    share = F.coalesce(F.try_divide(F.col("__d") - F.col("__c")[F.col("__s") - 1], F.get("__c", F.col("__s")) - F.col("__c")[F.col("__s") - 1]), F.lit(0.0))
    at_of = lambda c: a[c] + (b[c] - a[c]) * share
    return p.select(*lines.columns, "step", F.round(F.col("__d") / 1000, 2).alias("distance"), at_of("x").alias("px"), at_of("y").alias("py"))


def segment_distance(px: Column, py: Column, line: Column, flat: bool = False) -> Column:
    """Least distance of a point from the line's segments; with ``flat`` ends, points beyond both ends of a segment don't count for it."""
    n = F.size(line)

    def one(k: Column) -> Column:
        a, b = line[k - 1], line[k]
        dx, dy = b["x"] - a["x"], b["y"] - a["y"]
        along = F.coalesce(F.try_divide((px - a["x"]) * dx + (py - a["y"]) * dy, dx * dx + dy * dy), F.lit(0.0))
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), along))
        far = F.hypot(px - a["x"] - t * dx, py - a["y"] - t * dy)
        return F.when((along >= 0) & (along <= 1), far) if flat else far

    return F.array_min(F.transform(F.sequence(F.lit(1), n - 1), one))


def buffer_mask(cells: DataFrame, line: Column, reach: float, flat: bool = True) -> DataFrame:
    """1 for cells whose centre is within ``reach`` of the line, else 0."""
    d = segment_distance(F.col("x").cast("double"), F.col("y").cast("double"), line, flat)
    return cells.withColumn("mask", F.coalesce(F.when(d <= reach, 1), F.lit(0)))


def in_polygon(px: Column, py: Column, ring: Column) -> Column:
    """Even-odd rule."""
    def crosses(k: Column) -> Column:
        a, b = ring[k - 1], ring[k % F.size(ring)]
        return ((a["y"] > py) != (b["y"] > py)) & (px < (b["x"] - a["x"]) * F.try_divide(py - a["y"], b["y"] - a["y"]) + a["x"])

    return F.size(F.filter(F.sequence(F.lit(1), F.size(ring)), crosses)) % 2 == 1


# spatial joins


def _squares(x0: Column, x1: Column, y0: Column, y1: Column, size: float) -> Column:
    side = lambda lo, hi: F.sequence(F.floor(lo / size).cast("long"), F.floor(hi / size).cast("long"))
    return F.flatten(F.transform(side(x0, x1), lambda gx: F.transform(side(y0, y1), lambda gy: F.struct(gx.alias("gx"), gy.alias("gy")))))


def point_in_box(points: DataFrame, boxes: DataFrame, size: float, how: str = "inner") -> DataFrame:
    """Points (``px``, ``py``) in boxes (``x0``, ``x1``, ``y0``, ``y1``, edges included); a point may be in several.

    Both sides are keyed by squares of ``size``, so the join is an equality and not a comparison of all with all.
    Points without a box stay with ``how='left'``.
    """
    b = boxes.withColumn("__g", F.explode(_squares(F.col("x0"), F.col("x1"), F.col("y0"), F.col("y1"), size))).withColumns({"__gx": F.col("__g.gx"), "__gy": F.col("__g.gy")}).drop("__g")
    p = points.withColumns({"__px": F.floor(F.col("px") / size).cast("long"), "__py": F.floor(F.col("py") / size).cast("long")})
    on = (F.col("__px") == F.col("__gx")) & (F.col("__py") == F.col("__gy")) & F.col("px").between(F.col("x0"), F.col("x1")) & F.col("py").between(F.col("y0"), F.col("y1"))
    return p.join(b, on, how).drop("__px", "__py", "__gx", "__gy")


def boxes_touching(left: DataFrame, right: DataFrame, size: float) -> DataFrame:
    """Rows of ``left`` whose box overlaps one of ``right``'s."""
    names = ("x0", "x1", "y0", "y1")
    key = lambda df: df.withColumn("__g", F.explode(_squares(*[F.col(n) for n in names], size)))
    r = key(right).select("__g", *[F.col(n).alias(f"r_{n}") for n in names])
    hit = (F.col("x0") <= F.col("r_x1")) & (F.col("x1") >= F.col("r_x0")) & (F.col("y0") <= F.col("r_y1")) & (F.col("y1") >= F.col("r_y0"))
    le = key(left)
    return le.join(r, (le["__g"] == r["__g"]) & hit, "left_semi").drop("__g").distinct()


def nearest_place(points: DataFrame, places: DataFrame, key: str, size: float) -> DataFrame:
    """The nearest places (``qx``, ``qy``, ``place``) of each point, with ``distance``; equally near ones give several rows, a point without coordinates none.

    Rings of squares are searched: a point that finds a place within its ring's reach is done, the others go on with a ring
    twice as wide, so no step compares all with all.
    """
    spark, found = points.sparkSession, []
    span = points.agg(F.max(F.abs("px")), F.max(F.abs("py"))).crossJoin(places.agg(F.max(F.abs("qx")), F.max(F.abs("qy")))).first()
    if None in span:
        return points.limit(0).select("*", F.lit(None).cast(places.schema["place"].dataType).alias("place"), F.lit(None).cast("double").alias("distance"))
    limit = 4 * max(1.0, *span)
    left = points.where("px is not null and py is not null")
    while True:
        q = places.withColumns({"__gx": F.floor(F.col("qx") / size).cast("long"), "__gy": F.floor(F.col("qy") / size).cast("long")})
        p = left.withColumn("__g", F.explode(_squares(F.col("px") - size, F.col("px") + size, F.col("py") - size, F.col("py") + size, size)))
        near = p.join(q, (F.col("__g.gx") == F.col("__gx")) & (F.col("__g.gy") == F.col("__gy"))).withColumn("distance", F.hypot(F.col("px") - F.col("qx"), F.col("py") - F.col("qy")))
        near = near.where(F.col("distance") <= size)
        best = near.groupBy(key).agg(F.min("distance").alias("__best"))
        found.append(near.join(best, key).where(F.col("distance") == F.col("__best")).select(*points.columns, "place", "distance"))
        left = left.join(best, key, "left_anti").persist()  # so a ring's plan doesn't hold those before it
        if size > limit or left.isEmpty():
            break
        size *= 4
    return reduce(lambda a, b: a.unionByName(b), found) if spark else left


def envelope(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Box around each group's points. A union of shapes is only given as this box."""
    return df.groupBy(*keys).agg(F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1"), F.count("*").alias("n"))
