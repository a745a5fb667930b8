"""Robust trends and dispersion."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import NMAD, YEAR_US
from .filters import mad_bounds
from .slopes import Slopes

RESULTS = ["slope", "intercept", "low_slope", "high_slope"]


def _middle(sorted_values: Column) -> Column:
    """Median of a sorted array; null if it is empty."""
    n = F.size(sorted_values)
    low, high = F.try_element_at(sorted_values, F.greatest(F.floor((n + 1) / 2), F.lit(1)).cast("int")), F.try_element_at(sorted_values, F.greatest(F.floor(n / 2) + 1, F.lit(1)).cast("int"))
    return F.when(n > 0, F.when(low == high, low).otherwise((low + high) / 2))


def _tie_term(values: Column) -> Column:
    counts = F.transform(F.array_distinct(values), lambda v: F.size(F.filter(values, lambda w: w == v)).cast("double"))
    return F.aggregate(counts, F.lit(0.0), lambda s, k: s + k * (k - 1) * (2 * k + 5))


def theil_sen_numpy(x: np.ndarray, y: np.ndarray, alpha: float = 0.95) -> tuple[float | None, ...]:
    """Slope, intercept and the slope's confidence limits over all pairs with different x. Pairs are built only for few points; for more, the
    slopes of the ranks wanted are selected by counting."""
    pairs = Slopes(x, y)
    nt, n = pairs.total, len(x)
    if not nt:
        return None, None, None, None
    ties = sum(float((k * (k - 1.0) * (2 * k + 5)).sum()) for k in (np.unique(v, return_counts=True)[1] for v in (x, y)))
    var = (n * (n - 1.0) * (2 * n + 5) - ties) / 18
    z, sigma = NormalDist().inv_cdf((1 - alpha) / 2), max(var, 0.0) ** 0.5
    high, low = min(int(np.rint((nt - z * sigma) / 2)), nt - 1), max(int(np.rint((nt + z * sigma) / 2)) - 1, 0)
    a, b, *limits = pairs.at([(nt - 1) // 2, nt // 2, *((low, high) if var >= 0 else ())])
    slope = a if a == b else (a + b) / 2
    return slope, float(np.median(y)) - slope * float(np.median(x)), *(limits or (None, None))


def theil_sen(df: DataFrame, keys: list[str], y: str, t: str, strategy: str = "native", ci: bool = False, alpha: float = 0.95, per_year: bool = True) -> DataFrame:
    """Theil-Sen trend of each group: ``keys``, ``slope``, ``intercept``, ``n`` and, with ``ci``, ``low_slope``, ``high_slope``.

    x is Julian years since the group's first ``t``, rows without a ``y`` included (or ``t`` itself, if not ``per_year``);
    the slope is the median over all pairs with different x, the intercept median(y) - slope * median(x). Null without such
    a pair. ``native`` keeps pairs in arrays inside one aggregation and suits groups of up to about a hundred
    rows, as pixels and stations have, and grows with the square of a group's rows; ``numpy`` takes one group at a time and selects slopes in n log n
    steps, so groups of a million rows are in reach. Sum up still larger ones by time first (``binned``).
    """
    x = F.timestamp_diff("MICROSECOND", F.col("__t0"), F.col(t)) / F.lit(YEAR_US) if per_year else F.col(t).cast("double")
    value = F.col(y).cast("double")
    if strategy == "numpy":
        schema = ", ".join([*(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys), *(f"{r} double" for r in RESULTS), "n long"])

        def fit(group: pd.DataFrame) -> pd.DataFrame:
            own = group[group["y"].notna()]
            at = (own["t"] - group["t"].min()).to_numpy("float64") if per_year else own["t"].to_numpy("float64")
            out = theil_sen_numpy(at / YEAR_US if per_year else at, own["y"].to_numpy("float64"), alpha)
            head = {k: [group[k].iloc[0]] for k in keys}
            return pd.DataFrame(head | {r: [v] for r, v in zip(RESULTS, out, strict=True)} | {"n": [len(own)]})

        when = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col(t)) if per_year else F.col(t).cast("double")
        rows = df.where(F.col(t).isNotNull()).select(*keys, when.alias("t"), value.alias("y"))
        out = rows.groupBy(*keys).applyInPandas(fit, schema)
        return out if ci else out.drop("low_slope", "high_slope")
    pair = F.struct(F.col(t).alias("t"), value.alias("y"))
    g = df.where(F.col(t).isNotNull()).groupBy(*keys).agg(F.min(t).alias("__t0"), F.collect_list(F.when(F.col(y).isNotNull(), pair)).alias("__p"))
    year = (lambda p: F.timestamp_diff("MICROSECOND", F.col("__t0"), p["t"]) / F.lit(YEAR_US)) if per_year else (lambda p: p["t"].cast("double"))
    g = g.withColumn("__p", F.transform("__p", lambda p: F.struct(year(p).alias("x"), p["y"].alias("y"))))
    slopes = F.flatten(F.transform("__p", lambda a: F.transform(F.filter("__p", lambda b: b["x"] > a["x"]), lambda b: (b["y"] - a["y"]) / (b["x"] - a["x"]))))
    g = g.withColumn("__s", F.sort_array(slopes)).withColumns({"slope": _middle(F.col("__s")), "__xs": F.sort_array("__p.x"), "__ys": F.sort_array("__p.y"), "n": F.size("__p").cast("long")})
    g = g.withColumn("intercept", _middle(F.col("__ys")) - F.col("slope") * _middle(F.col("__xs")))
    out = ["slope", "intercept", "n"]
    if ci:
        n, nt, z = F.col("n").cast("double"), F.size("__s"), NormalDist().inv_cdf((1 - alpha) / 2)
        sigma = F.sqrt((n * (n - 1) * (2 * n + 5) - _tie_term(F.col("__xs")) - _tie_term(F.col("__ys"))) / 18)
        high = F.least(F.rint((nt - z * sigma) / 2).cast("int"), nt - 1)
        low = F.greatest(F.rint((nt + z * sigma) / 2).cast("int") - 1, F.lit(0))
        g = g.withColumns({"low_slope": F.try_element_at("__s", low + 1), "high_slope": F.try_element_at("__s", F.greatest(high + 1, F.lit(1)))})
        out += ["low_slope", "high_slope"]
    return g.select(*keys, *out)


def binned(df: DataFrame, keys: list[str], y: str, t: str, unit: str = "month") -> DataFrame:
    """Median of ``y`` by group and calendar unit, to bound a group before the pairs of ``theil_sen``."""
    return df.groupBy(*keys, F.date_trunc(unit, F.col(t)).cast("timestamp_ntz").alias(t)).agg(F.median(y).alias(y))


def trend_with_counts(df: DataFrame, keys: list[str], y: str, t: str) -> DataFrame:
    """Theil-Sen trend of the annual medians: ``keys``, ``slope``, ``intercept``, ``n`` and ``counts``, the rows of each year as text (``year=rows``, by year)."""
    annual = df.groupBy(*keys, F.year(t).alias("__x")).agg(F.median(y).alias("__y"), F.count("*").alias("__n"))
    trend = theil_sen(annual, keys, "__y", "__x", per_year=False)
    counts = annual.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("__x", "__n"))).alias("c"))
    return trend.join(counts.select(*keys, F.concat_ws(",", F.transform("c", lambda p: F.concat(p["__x"].cast("string"), F.lit("="), p["__n"].cast("string")))).alias("counts")), keys)


def nmad(df: DataFrame, keys: list[str], value: str, scale: float = NMAD, large: bool = False) -> DataFrame:
    """``keys``, ``med``, ``nmad``: median and scaled median absolute deviation. ``large`` is for few groups of many rows."""
    return mad_bounds(df, keys, value, large).select(*keys, "med", (F.col("mad") * scale).alias("nmad"))


def difference_stats(reference: DataFrame, other: DataFrame, on: list[str], value: str = "z", keys: list[str] | None = None, mask: Column | None = None) -> DataFrame:
    """Median and NMAD of reference minus other over the cells that both have, by ``keys`` of the other."""
    keys = keys or []
    r = reference.select(*on, F.col(value).alias("__r"))
    d = other.join(r, on).where(F.col("__r").isNotNull() & F.col(value).isNotNull())
    d = (d if mask is None else d.where(mask)).withColumn("d", F.col("__r") - F.col(value))
    return nmad(d, keys, "d")


def profile(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``med`` and the band of one NMAD on both sides, ``y1`` above and ``y2`` below."""
    s = nmad(df, keys, value)
    return s.select(*keys, "med", (F.col("med") + F.col("nmad")).alias("y1"), (F.col("med") - F.col("nmad")).alias("y2"))


def flatten_results(df: DataFrame, keys: list[str], results: list[str] = RESULTS) -> DataFrame:
    """One row for each result: ``keys``, ``result``, ``sec``."""
    return df.unpivot(keys, [r for r in results if r in df.columns], "result", "sec")


def _interpolated(x: np.ndarray, px: np.ndarray, py: np.ndarray) -> np.ndarray:
    """``np.interp`` for many rows: places ``x`` within knots ``px`` that ascend, values ``py``."""
    out = np.repeat(py[:, :1], x.shape[1], axis=1)
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        slope = np.diff(py, axis=1) / np.diff(px, axis=1)
        for k in range(px.shape[1] - 1):
            np.copyto(out, slope[:, k : k + 1] * (x - px[:, k : k + 1]) + py[:, k : k + 1], where=x >= px[:, k : k + 1])
    np.copyto(out, py[:, -1:], where=x >= px[:, -1:])
    return out


def piecewise_knots_abreast(x: np.ndarray, y: np.ndarray, count: int, rounds: int = 2000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Continuous lines of ``count`` segments with least mean squared error for many rows (groups by values) at once, by Nelder-Mead on the knots:
    knots and error of each. A row takes the steps that it would take by itself, and rows that have settled take none."""
    low, high = x.min(axis=1), x.max(axis=1)
    span = np.where(high > low, high - low, 1.0)
    inner = np.linspace(low, high, count + 1, axis=1)
    level = np.empty_like(inner)
    for k in range(count + 1):
        near = np.abs(x - inner[:, k : k + 1]) < 0.1 * span[:, None]
        n = near.sum(axis=1)
        level[:, k] = np.where(n > 0, np.where(near, y, 0.0).sum(axis=1) / np.maximum(n, 1), y.mean(axis=1))
    start = np.concatenate([np.repeat((span / count)[:, None], count - 1, axis=1), level], axis=1)

    def knots(p: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        steps = np.concatenate([p[:, : count - 1], (span[own] - p[:, : count - 1].sum(axis=1))[:, None]], axis=1)
        return np.concatenate([low[own, None], low[own, None] + np.cumsum(steps, axis=1)], axis=1), p[:, count - 1 :]

    def error(p: np.ndarray, own: np.ndarray) -> np.ndarray:
        px, py = knots(p, own)
        good = (np.diff(px, axis=1) > 0).all(axis=1)
        return np.where(good, ((_interpolated(x[own], px, py) - y[own]) ** 2).mean(axis=1), np.inf)

    m = start.shape[1]
    simplex = np.repeat(start[:, None], m + 1, axis=1)
    for k in range(m):
        step = 0.05 * start[:, k]
        simplex[:, k + 1, k] += np.where(step != 0, step, 0.00025)
    every = np.arange(len(x))
    cost = np.stack([error(simplex[:, k], every) for k in range(m + 1)], axis=1)
    best, least = simplex[:, 0].copy(), cost[:, 0].copy()
    own = every  # the rows that still move
    for _ in range(rounds):
        order = np.argsort(cost, axis=1, kind="stable")
        simplex, cost = np.take_along_axis(simplex, order[:, :, None], axis=1), np.take_along_axis(cost, order, axis=1)
        with np.errstate(invalid="ignore"):
            settled = (cost[:, -1] - cost[:, 0] <= 1e-10 * np.maximum(1.0, np.abs(cost[:, 0]))) & (np.abs(simplex[:, 1:] - simplex[:, :1]).max(axis=(1, 2)) <= 1e-8)
        if settled.any():
            best[own[settled]], least[own[settled]] = simplex[settled, 0], cost[settled, 0]
            own, simplex, cost = own[~settled], simplex[~settled], cost[~settled]
            if not len(own):
                break
        centre = simplex[:, :-1].mean(axis=1)
        worst = simplex[:, -1]
        reflected = 2 * centre - worst
        value = error(reflected, own)
        better, inside = value < cost[:, 0], value >= cost[:, -2]
        other = np.where(better[:, None], 3 * centre - 2 * worst, centre + 0.5 * (np.where((value < cost[:, -1])[:, None], reflected, worst) - centre))
        further = np.full(len(own), np.inf)
        tried = better | inside
        further[tried] = error(other[tried], own[tried])
        takes = np.where(better, further < value, inside & (further < np.minimum(value, cost[:, -1])))
        shrinks = inside & ~takes & ~better
        moves = ~shrinks
        simplex[moves, -1] = np.where(takes[:, None], other, reflected)[moves]
        cost[moves, -1] = np.where(takes, further, value)[moves]
        if shrinks.any():
            simplex[shrinks, 1:] = simplex[shrinks, :1] + 0.5 * (simplex[shrinks, 1:] - simplex[shrinks, :1])
            cost[shrinks, 1:] = np.stack([error(simplex[shrinks, k], own[shrinks]) for k in range(1, m + 1)], axis=1)
    best[own], least[own] = simplex[:, 0], cost[:, 0]
    px, py = knots(best, every)
    return px, py, least


def piecewise_knots(x: np.ndarray, y: np.ndarray, count: int, rounds: int = 2000) -> tuple[np.ndarray, np.ndarray, float]:
    """``piecewise_knots_abreast`` for one group."""
    px, py, mse = piecewise_knots_abreast(np.asarray(x, np.float64)[None], np.asarray(y, np.float64)[None], count, rounds)
    return px[0], py[0], float(mse[0])


#: Values of groups that are fitted together.
FITTED_ABREAST = 100_000


def piecewise_fit(df: DataFrame, keys: list[str], x: str, y: str, most: int = 4) -> DataFrame:
    """Knots of a continuous piecewise line for each group: ``keys``, ``knot``, ``px``, ``py``. One segment more is taken as
    long as both information criteria improve; the mixed logarithms of the criteria are the published ones. Groups of as many values are fitted together."""
    point = "array<struct<knot: int, px: double, py: double>>"
    schema = ", ".join([*(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys), f"__knots {point}"])

    def fitted(xs: np.ndarray, ys: np.ndarray) -> list[list[dict[str, float]]]:
        n, own = xs.shape[1], np.arange(len(xs))
        out: list[list[dict[str, float]]] = [[] for _ in own]
        scores = np.full((len(xs), 2), np.inf)
        for count in range(1, most + 1):
            px, py, mse = piecewise_knots_abreast(xs[own], ys[own], count)
            fit = n * np.log10(np.maximum(mse, 1e-300))
            new = np.column_stack([fit + 4 * count, fit + 2 * count * np.log(n)])
            improved = (new < scores[own]).all(axis=1)
            for k in np.flatnonzero(improved):
                out[own[k]] = [{"knot": j, "px": a, "py": b} for j, (a, b) in enumerate(zip(px[k].tolist(), py[k].tolist(), strict=True))]
            own, new = own[improved], new[improved]
            scores[own] = new
            if not len(own):
                break
        return out

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("knot", pa.int32()), ("px", pa.float64()), ("py", pa.float64())]))
        for batch in batches:
            lists = batch.column(len(keys))
            xy, many = lists.flatten(), lists.value_lengths().to_numpy()
            xs, ys = (xy.field(c).to_numpy() for c in ("x", "y"))
            first, out = np.cumsum(many) - many, [[]] * len(batch)
            for n in np.unique(many):
                rows = np.flatnonzero(many == n)
                for part in np.array_split(rows, max(1, len(rows) * int(n) // FITTED_ABREAST)):
                    at = first[part][:, None] + np.arange(n)
                    for k, knots in zip(part, fitted(xs[at], ys[at]), strict=True):
                        out[k] = knots
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], pa.array(out, kind)], names=[*keys, "__knots"])

    rows = df.select(*keys, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).dropna(subset=["x", "y"])
    groups = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("x", "y"))).alias("__v"))
    return groups.mapInArrow(fit, schema).select(*keys, F.inline("__knots"))


def union_all(frames: Iterator[DataFrame] | list[DataFrame]) -> DataFrame:
    """Rows of all frames, columns by name; a missing one is null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
