"""Iterative numerics by group: flow lines, gap filling, planes and co-registration."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _bilinear(part: np.ndarray, x: float, y: float, i: int, j: int) -> float:
    fy, fx = y - i, x - j
    return float(part[0, 0] * (1 - fx) * (1 - fy) + part[0, 1] * fx * (1 - fy) + part[1, 0] * (1 - fx) * fy + part[1, 1] * fx * fy)


def trace(u: np.ndarray, v: np.ndarray, xs: list[float], ys: list[float], sign: int, steps: int, step: float = 1.0, corner: tuple[int, int] = (0, 0), bounds: tuple[int, int, int, int] | None = None) -> bool:
    """Half a flow line, added to its points so far (the seed is the first): steps along the flow's angle until past the field's edge (that point is the
    last), no data, or, looked for at every tenth step, a point within 0.9 steps of an earlier one. ``u`` and ``v`` are the field from ``corner`` (y, x) on,
    which may be a part of that within ``bounds`` (first and last x, first and last y). False where the next step needs cells of another part."""
    rows, cols = u.shape
    x0, x1, y0, y1 = bounds or (0, cols - 1, 0, rows - 1)
    while len(xs) <= steps:
        x, y = xs[-1], ys[-1]
        if not (x0 <= x <= x1 and y0 <= y <= y1):
            return True
        i, j = min(math.floor(y), y1 - 1), min(math.floor(x), x1 - 1)
        r, c = i - corner[0], j - corner[1]
        if not (0 <= r <= rows - 2 and 0 <= c <= cols - 2):
            return min(x1 - x0, y1 - y0) < 1
        a, b = (_bilinear(f[r : r + 2, c : c + 2], x, y, i, j) for f in (u, v))
        if np.isnan(a) or np.isnan(b):
            return True
        angle = np.arctan2(b, a)
        x, y = x + sign * step * np.cos(angle), y + sign * step * np.sin(angle)
        xs.append(float(x))
        ys.append(float(y))
        if (len(xs) - 1) % 10 == 0 and any(np.hypot(x - px, y - py) < 0.9 * step for px, py in zip(xs[1:-1], ys[1:-1], strict=True)):
            return True
    return True


def _kept(df: DataFrame) -> DataFrame:
    """Made once: written where the session names a checkpoint folder, else held."""
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df.persist()


def streamlines(cells: DataFrame, seeds: DataFrame, key: str = "site", steps: int = 100, step: float = 1.0, tile: int = 256) -> DataFrame:
    """Flow lines through seeds (``key``, ``seed``, ``sx``, ``sy``) over fields (``key``, ``y``, ``x``, ``vx``, ``vy``): ``key``,
    ``seed``, ``k`` (0 at the seed, negative upstream), ``px``, ``py``. A seed outside its field is a line of one point; one without a field gives no row.

    A field is cut into squares of ``tile`` cells, so a task holds a square and the lines that are in it; a line that leaves
    is handed on with its points. There are as many rounds as the line that crosses most squares needs.
    """
    kinds = {c: df.schema[c].dataType.simpleString() for c, df in ((key, cells), ("seed", seeds))}
    edges = ["x0", "x1", "y0", "y1"]
    bounds = cells.groupBy(key).agg(*[f(c).cast("long").alias(n) for n, f, c in zip(edges, (F.min, F.max) * 2, "xxyy", strict=True)])
    # the first row and column of a square belong to those before it too
    squares = lambda c: F.array_distinct(F.array(F.floor(F.col(c) / tile), F.floor((F.col(c) - 1) / tile)))
    # renamed to themselves: seeds may be made from the cells, and the two sides of a group have to be told apart
    parts = cells.select(F.col(key).alias(key), F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), F.col("vx").cast("double").alias("vx"), F.col("vy").cast("double").alias("vy"))
    parts = parts.withColumn("ty", F.explode(squares("y"))).withColumn("tx", F.explode(squares("x")))
    state = [key, "seed", "sign", "xs", "ys", *edges]
    live = seeds.join(bounds, key).select(F.col(key).alias(key), F.col("seed").alias("seed"), F.explode(F.array(F.lit(-1), F.lit(1))).alias("sign"), F.array(F.col("sx").cast("double")).alias("xs"), F.array(F.col("sy").cast("double")).alias("ys"), *edges)

    def run(field: pd.DataFrame, lines: pd.DataFrame) -> pd.DataFrame:
        out = lines[state].copy()
        out["done"] = True
        if len(field) and len(lines):
            ty, tx = int(field["ty"].iloc[0]) * tile, int(field["tx"].iloc[0]) * tile
            u, v = np.full((2, tile + 1, tile + 1), np.nan)
            at = field["y"].to_numpy() - ty, field["x"].to_numpy() - tx
            u[at], v[at] = field["vx"].to_numpy(), field["vy"].to_numpy()
            rows = []
            for r in lines[["sign", "xs", "ys", *edges]].itertuples(index=False):
                xs, ys = list(r.xs), list(r.ys)
                done = trace(u, v, xs, ys, r.sign, steps, step, (ty, tx), (r.x0, r.x1, r.y0, r.y1))
                rows.append((xs, ys, done))
            out["xs"], out["ys"], out["done"] = ([row[k] for row in rows] for k in range(3))
        return out

    schema = f"`{key}` {kinds[key]}, seed {kinds['seed']}, sign int, xs array<double>, ys array<double>, x0 long, x1 long, y0 long, y1 long, done boolean"
    by, ended = [key, "ty", "tx"], []
    while True:
        own = lambda c: F.floor(F.least(F.floor(F.element_at(f"{c}s", -1)), F.col(f"{c}1") - 1) / tile)
        here = live.withColumns({"ty": own("y"), "tx": own("x")})
        field = parts.join(here.select(*by).distinct(), by, "left_semi")
        out = _kept(field.groupBy(*by).cogroup(here.groupBy(*by)).applyInPandas(run, schema))
        ended.append(out.where("done"))
        live = out.where("not done").drop("done")
        if live.isEmpty():
            break
    lines = reduce(DataFrame.unionByName, ended)
    points = lines.select(key, "seed", "sign", F.posexplode(F.arrays_zip("xs", "ys")).alias("pos", "p")).where("sign > 0 or pos > 0")
    return points.select(key, "seed", (F.col("sign") * F.col("pos")).alias("k"), F.col("p.xs").alias("px"), F.col("p.ys").alias("py"))


def fill_gaps(cells: DataFrame, value: str, keys: list[str], reach: int = 4) -> DataFrame:
    """Cells without a value get the inverse-square-distance mean of those up to ``reach`` away; others stay, and a cell with no value near stays null.

    Only values move, each to the gaps around it. An approximation: the cubic surface through scattered points has no such local form.
    """
    around = [(dy, dx) for dy in range(-reach, reach + 1) for dx in range(-reach, reach + 1) if (dy or dx) and dy * dy + dx * dx <= reach * reach]
    offsets = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx"), F.lit(1.0 / (dy * dy + dx * dx)).alias("w")) for dy, dx in around])
    gaps = cells.where(F.col(value).isNull()).select(*keys, F.col("y").alias("gy"), F.col("x").alias("gx"), F.explode(offsets).alias("o"))
    gaps = gaps.select(*keys, "gy", "gx", (F.col("gy") + F.col("o.dy")).alias("y"), (F.col("gx") + F.col("o.dx")).alias("x"), F.col("o.w").alias("w"))
    got = gaps.join(cells.where(F.col(value).isNotNull()).select(*keys, "y", "x", F.col(value).alias("__v")), [*keys, "y", "x"])
    got = got.groupBy(*keys, F.col("gy").alias("y"), F.col("gx").alias("x")).agg((F.sum(F.col("w") * F.col("__v")) / F.sum("w")).alias("__f"))
    return cells.join(got, [*keys, "y", "x"], "left").withColumn(value, F.coalesce(value, "__f")).drop("__f").select(*cells.columns)


def plane_fit(df: DataFrame, keys: list[str], x: str, y: str, z: str) -> DataFrame:
    """Least-squares plane z = a x + b y + c: ``a``, ``b``, ``c``, ``n``. Sums of centred products in one aggregation, then a 2 by 2 system."""
    xd, yd, zd = (F.col(c).cast("double") for c in (x, y, z))
    own = df.where(xd.isNotNull() & yd.isNotNull() & zd.isNotNull())
    g = own.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(xd).alias("mx"), F.avg(yd).alias("my"), F.avg(zd).alias("mz"),
        F.var_pop(xd).alias("xx"), F.var_pop(yd).alias("yy"), F.covar_pop(xd, yd).alias("xy"), F.covar_pop(xd, zd).alias("xz"), F.covar_pop(yd, zd).alias("yz"),
    )
    det = F.col("xx") * F.col("yy") - F.col("xy") * F.col("xy")
    a = F.try_divide(F.col("xz") * F.col("yy") - F.col("yz") * F.col("xy"), det)
    b = F.try_divide(F.col("yz") * F.col("xx") - F.col("xz") * F.col("xy"), det)
    return g.withColumns({"a": a, "b": b}).withColumn("c", F.col("mz") - F.col("a") * F.col("mx") - F.col("b") * F.col("my")).select(*keys, "a", "b", "c", "n")


def remove_plane(df: DataFrame, planes: DataFrame, keys: list[str], x: str, y: str, z: str) -> DataFrame:
    p = planes.select(*keys, *[F.col(c).alias(f"__{c}") for c in "abc"])
    joined = df.join(p, keys) if keys else df.crossJoin(F.broadcast(p))
    return joined.withColumn(z, F.col(z) - (F.col("__a") * F.col(x) + F.col("__b") * F.col(y) + F.col("__c"))).drop("__a", "__b", "__c")


def coregister(reference: DataFrame, others: DataFrame, key: str = "dem_id", cell: float = 1.0, rounds: int = 10) -> DataFrame:
    """Shift of each surface (``key``, ``y``, ``x``, ``z``) against the reference (``y``, ``x``, ``z``, ``mask``): ``key``, ``dx``, ``dy``, ``dz``, ``n``
    (the cells of the last round).

    The difference over the tangent of the slope follows a cosine of the aspect (Nuth and Kääb 2011), which is fitted by least
    squares until the step is small. In a round each cell of a surface goes to the reference's cells around it and one aggregation makes the
    sums of the normal equations; only these, a row for each surface, reach the driver. Slopes are central differences, one-sided
    beside an edge or a missing cell. A surface with less than three cells in common stays where it is; one without a key takes no part.
    """
    spark, kind = reference.sparkSession, others.schema[key].dataType.simpleString()
    own = reference.select(F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), F.col("z").cast("double").alias("rz"), "mask")

    def slope(along: str, across: str) -> Column:
        w = Window.partitionBy(across).orderBy(along)
        before, after = (F.when(f(along).over(w) == F.col(along) + k, f("rz").over(w)) for f, k in ((F.lag, -1), (F.lead, 1)))
        return F.coalesce((after - before) / (2 * cell), (after - F.col("rz")) / cell, (F.col("rz") - before) / cell)

    own = own.withColumns({"gx": slope("x", "y"), "gy": slope("y", "x")})
    own = own.where("mask = 1 and rz is not null and gx * gx + gy * gy > 1e-12").drop("mask").persist()
    table = others.where(F.col(key).isNotNull()).select(key, F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), F.col("z").cast("double").alias("z"))
    shifts = {r[0]: np.zeros(3) for r in table.select(key).distinct().collect()}
    used, moving = dict.fromkeys(shifts, 0), set(shifts)
    table = table.where("z is not null")
    w = {c: (1 - F.col(f"f{c}"), F.col(f"f{c}")) for c in "xy"}
    corners = F.array(*[F.struct((F.col("y") - F.col("oy") - dy).alias("y"), (F.col("x") - F.col("ox") - dx).alias("x"), (w["x"][dx] * w["y"][dy]).alias("w")) for dy in (0, 1) for dx in (0, 1)])
    terms = [("gx", "gx"), ("gx", "gy"), ("gx", "o"), ("gy", "gy"), ("gy", "o"), ("o", "o"), ("gx", "d"), ("gy", "d"), ("o", "d")]
    for _ in range(rounds):
        if not moving:
            break
        rows = [(k, *(int(math.floor(s / cell)) for s in shifts[k][:2]), *(float(s / cell - math.floor(s / cell)) for s in shifts[k][:2]), float(shifts[k][2])) for k in moving]
        now = spark.createDataFrame(rows, f"`{key}` {kind}, ox long, oy long, fx double, fy double, dz double")
        asked = table.join(now, key).withColumn("c", F.filter(corners, lambda c: c["w"] > 0)).withColumn("m", F.size("c"))
        asked = asked.select(key, "dz", "m", "z", F.explode("c").alias("c")).select(key, "dz", "m", "c.y", "c.x", (F.col("c.w") * F.col("z")).alias("v")).repartition("y", "x")
        moved = asked.groupBy(key, "y", "x", "dz", "m").agg(F.sum("v").alias("v"), F.count("*").alias("n")).where("n = m")
        both = moved.join(own, ["y", "x"]).select(key, "gx", "gy", F.lit(1.0).alias("o"), (F.col("rz") - F.col("v") - F.col("dz")).alias("d"))
        sums = both.groupBy(key).agg(*[F.sum(F.col(a) * F.col(b)).alias(f"{a}_{b}") for a, b in terms]).collect()
        going = set()
        for r in sums:
            used[r[key]] = int(r.o_o)
            if r.o_o < 3:
                continue
            normal = np.array([[r.gx_gx, r.gx_gy, r.gx_o], [r.gx_gy, r.gy_gy, r.gy_o], [r.gx_o, r.gy_o, r.o_o]])
            move, *_ = np.linalg.lstsq(normal, np.array([r.gx_d, r.gy_d, r.o_d]), rcond=1e-12)
            shifts[r[key]] += move
            if np.abs(move).max() >= 1e-6:
                going.add(r[key])
        moving = going
    own.unpersist()
    return spark.createDataFrame([(k, *map(float, s), used[k]) for k, s in shifts.items()], f"`{key}` {kind}, dx double, dy double, dz double, n long")


def random_points(df: DataFrame, x: str, y: str, n: int, seed: int = 1, leaf: int = 100_000) -> DataFrame:
    """``n`` points with replacement, x and y drawn by themselves: ``xy``, ``px``, ``py``. The same for a seed, however the table is split; none of an empty table.

    Rows are ordered by a seeded hash and 2 ``n`` ranks are drawn first. Counts by the next twelve bits of the hash lead each rank down until its
    part of the table has at most ``leaf`` rows, and only such parts are sorted; repeated rows are counted, not sorted. The driver holds the ranks.
    """
    spark, schema = df.sparkSession, "xy long, axis int, r long, path long, size long"
    own = df.select(F.col(x).cast("double").alias("vx"), F.col(y).cast("double").alias("vy"), F.xxhash64(x, y, F.lit(seed)).alias("h"))
    total = own.count()
    if not total or n < 1:
        return spark.createDataFrame([], "xy long, px double, py double")
    rank = F.pmod(F.xxhash64("id", F.lit(seed), F.col("axis")), F.lit(total))
    draws = spark.range(n).select("id", F.explode(F.array(F.lit(0), F.lit(1))).alias("axis")).select("id", "axis", rank, F.lit(0), F.lit(total)).collect()
    depth, at = 0, lambda k: F.shiftrightunsigned("h", 64 - 12 * k) if k else F.lit(0).cast("long")
    while True:
        asked = spark.createDataFrame([tuple(r) for r in draws], schema)
        rows = own.withColumn("path", at(depth)).join(F.broadcast(asked.select("path").distinct()), "path")  # as many rows as draws at most
        if depth == 5 or max(r[4] for r in draws) <= leaf:
            break
        depth += 1
        parts = rows.groupBy("path", at(depth).alias("child")).agg(F.count("*").alias("many"))
        parts = parts.withColumn("upto", F.sum("many").over(Window.partitionBy("path").orderBy("child")))
        hit = (F.col("r") < F.col("upto")) & (F.col("r") >= F.col("upto") - F.col("many"))
        draws = asked.join(parts, "path").where(hit).select("xy", "axis", F.col("r") - F.col("upto") + F.col("many"), "child", "many").collect()
    unsigned = F.col("h").bitwiseXOR(F.lit(-(1 << 63)))
    held = rows.groupBy("path", "h", "vx", "vy").agg(F.count("*").alias("many"))
    held = held.withColumn("upto", F.sum("many").over(Window.partitionBy("path").orderBy(unsigned, "vx", "vy")))
    got = asked.join(held, "path").where((F.col("r") < F.col("upto")) & (F.col("r") >= F.col("upto") - F.col("many")))
    return got.groupBy("xy").agg(F.max(F.when(F.col("axis") == 0, F.col("vx"))).alias("px"), F.max(F.when(F.col("axis") == 1, F.col("vy"))).alias("py"))


def incidence(normal: Column, sight: Column) -> Column:
    """Angle between a surface's normal and the line of sight, in radians."""
    from ..functions.scalars import angle_between

    return angle_between(normal, sight)
