"""Grouped statistics: quantiles, composites, fitted lines, histograms, modes and calendar windows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import student
from ..functions.scalars import cut_right_closed, fixed_bin
from .keys import null_safe_join
from .quantiles import exceeds_a_task, in_time_blocks, large_group_quantiles, rolling_median_of_blocks


def group_quantiles(df: DataFrame, keys: list[str], value: str, qs: dict[str, float], count: str | None = "n", digits: int | None = None, large: bool = False) -> DataFrame:
    """Exact quantiles with linear interpolation, as one column each, and the count of values that aren't null. ``large`` is for few groups of many rows."""
    if large and exceeds_a_task(df, keys, value):
        out = large_group_quantiles(df, keys, value, list(qs.values())).withColumnsRenamed({"q": "__q", "n": "__n"})
    else:
        out = df.groupBy(*keys).agg(F.percentile(value, list(qs.values())).alias("__q"), F.count(value).alias("__n"))
    picked = [F.col("__q")[k] for k in range(len(qs))]
    picked = [(F.round(c, digits) if digits is not None else c).alias(name) for name, c in zip(qs, picked, strict=True)]
    return out.select(*keys, *picked, *([F.col("__n").alias(count)] if count else []))


def pivot_quantiles(df: DataFrame, keys: list[str], band: str, bands: list, value: str, qs: dict[str, float], digits: int | None = None) -> DataFrame:
    """Quantiles of each band as columns ``{band}_{quantile}``; the bands are given, so no job looks for them."""
    out = group_quantiles(df.where(F.col(band).isin(bands)), [*keys, band], value, qs, None, digits)
    return out.groupBy(*keys).pivot(band, bands).agg(*[F.first(q).alias(q) for q in qs])


def binned_quartiles(df: DataFrame, keys: list[str], value: str, bin_of: str, first: float, last: float, width: float) -> DataFrame:
    """Median, quartiles and one-sided error bars by group and right-closed bin; rows outside all bins are left out."""
    binned = df.withColumn("mid_bin", cut_right_closed(bin_of, first, last, width)).where("mid_bin is not null")
    q = group_quantiles(binned, [*keys, "mid_bin"], value, {"q25": 0.25, "med": 0.5, "q75": 0.75})
    return q.withColumns({"err_low": F.col("med") - F.col("q25"), "err_high": F.col("q75") - F.col("med")})


def paired_levels(df: DataFrame, keys: list[str], level: str, pair: tuple, values: list[str]) -> DataFrame:
    """Values of two levels side by side, as ``{value}_{level}``, and their difference; keys that lack one are left out."""
    a, b = pair
    out = df.where(F.col(level).isin(a, b)).groupBy(*keys).pivot(level, [a, b]).agg(*[F.first(v).alias(v) for v in values])
    if len(values) == 1:
        out = out.withColumnsRenamed({str(x): f"{x}_{values[0]}" for x in pair})
    out = out.withColumnsRenamed({f"{x}_{v}": f"{v}_{x}" for x in pair for v in values})
    out = out.where(F.col(f"{values[0]}_{a}").isNotNull() & F.col(f"{values[0]}_{b}").isNotNull())
    return out.withColumn("difference", F.col(f"{values[0]}_{a}") - F.col(f"{values[0]}_{b}"))


def common_values(df: DataFrame, group: str, value: str) -> DataFrame:
    """Values that every group has."""
    groups = df.agg(F.countDistinct(group).alias("g"))
    return df.groupBy(value).agg(F.countDistinct(group).alias("n")).join(F.broadcast(groups), F.col("n") == F.col("g")).select(value)


def modal(df: DataFrame, keys: list[str], value: str, name: str = "mode") -> DataFrame:
    """Most frequent value of each group, the smallest of equally frequent ones."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).count()
    return counts.groupBy(*keys).agg(F.min_by(value, F.struct(-F.col("count"), F.col(value))).alias(name))


def two_level(df: DataFrame, outer: str, inner: str) -> DataFrame:
    """Mean, median, least and most of the number of distinct inner values by outer value."""
    each = df.groupBy(outer).agg(F.countDistinct(inner).alias("n"))
    return each.agg(F.avg("n").alias("mean_n"), F.median("n").alias("median_n"), F.min("n").alias("min_n"), F.max("n").alias("max_n"))


def linear_fit(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Least squares by group: ``n``, ``slope``, ``intercept``, ``r``, ``stderr`` of the slope and the sums that intervals need."""
    xd, yd = F.col(x).cast("double"), F.col(y).cast("double")
    g = df.where(xd.isNotNull() & yd.isNotNull()).groupBy(*keys).agg(
        F.count("*").alias("n"), F.regr_slope(yd, xd).alias("slope"), F.regr_intercept(yd, xd).alias("intercept"), F.corr(xd, yd).alias("r"),
        F.regr_sxx(yd, xd).alias("sxx"), F.regr_syy(yd, xd).alias("syy"), F.avg(xd).alias("mean_x"),
    )
    left = (1 - F.col("r") * F.col("r")) * F.col("syy")
    return g.withColumn("stderr", F.when(F.col("n") > 2, F.sqrt(F.try_divide(F.try_divide(left, F.col("sxx")), F.col("n") - 2))))


def with_p_values(fits: DataFrame, level: float = 0.95) -> DataFrame:
    """Two-sided p and the slope's confidence limits, from one row for each group."""

    def add(batches):
        for b in batches:
            dof = b["n"] - 2
            t = b["slope"] / b["stderr"]
            b["p"] = [student.two_sided(v, d) for v, d in zip(t, dof, strict=True)]
            half = pd.Series([student.quantile((1 + level) / 2, d) for d in dof], index=b.index, dtype=float) * b["stderr"]
            yield b.assign(low_slope=b["slope"] - half, high_slope=b["slope"] + half)

    return fits.mapInPandas(add, fits.schema.simpleString()[7:-1] + ",p:double,low_slope:double,high_slope:double")


def fitted_interval(fits: DataFrame, at: DataFrame, keys: list[str], x: str = "x", level: float = 0.95) -> DataFrame:
    """Fitted mean at each ``x`` and its confidence half-width."""
    joined = null_safe_join(at, fits, keys)
    residual = F.col("stderr") * F.sqrt("sxx")
    out = joined.select(*at.columns, (F.col("intercept") + F.col("slope") * F.col(x)).alias("fit"), (residual * F.sqrt(1 / F.col("n") + F.pow(F.col(x) - F.col("mean_x"), 2) / F.col("sxx"))).alias("se"), (F.col("n") - 2).alias("dof"))

    def add(batches):
        for b in batches:
            b["half"] = [s * (student.quantile((1 + level) / 2, d) or float("nan")) for s, d in zip(b["se"], b["dof"], strict=True)]
            yield b

    return out.mapInPandas(add, out.schema.simpleString()[7:-1] + ",half:double")


def histogram(df: DataFrame, keys: list[str], value: str, low: float, width: float, high: float | None = None) -> DataFrame:
    """Counts by left-closed bin of fixed width: ``bin_low``, ``n``."""
    own = df.where((F.col(value) >= low) & (F.lit(True) if high is None else F.col(value) < high))
    return own.groupBy(*keys, (F.lit(low) + fixed_bin(value, low, width) * width).alias("bin_low")).agg(F.count("*").alias("n"))


def density_2d(df: DataFrame, x: str, y: str, extent: tuple, bins: int = 30) -> DataFrame:
    """Counts by cell of a ``bins`` by ``bins`` grid over (x0, x1, y0, y1)."""
    x0, x1, y0, y1 = extent
    own = df.where((F.col(x) >= x0) & (F.col(x) < x1) & (F.col(y) >= y0) & (F.col(y) < y1))
    return own.groupBy(fixed_bin(x, x0, (x1 - x0) / bins).alias("ix"), fixed_bin(y, y0, (y1 - y0) / bins).alias("iy")).agg(F.count("*").alias("n"))


def box_stats(df: DataFrame, keys: list[str], value: str, large: bool = False) -> DataFrame:
    """Quartiles, the outermost values within 1.5 interquartile ranges of the box, and how many lie beyond. ``large`` is for few groups of many rows."""
    q = group_quantiles(df, keys, value, {"q1": 0.25, "med": 0.5, "q3": 0.75}, None, large=large)
    v, reach = F.col(value), (F.col("q3") - F.col("q1")) * 1.5
    inside = (v >= F.col("q1") - reach) & (v <= F.col("q3") + reach)
    joined = null_safe_join(df.select(*keys, value), q, keys)
    return joined.groupBy(*keys, "q1", "med", "q3").agg(F.min(F.when(inside, v)).alias("low"), F.max(F.when(inside, v)).alias("high"), F.count_if(~inside).alias("fliers"))


def density_curve(df: DataFrame, keys: list[str], value: str, low: float, high: float, points: int = 100) -> DataFrame:
    """Gaussian kernel density with Scott's bandwidth at even points: values meet points through a fine histogram, so
    each group costs bins times points, not rows times points."""
    step = (high - low) / (points * 4)
    s = df.groupBy(*keys).agg(F.count(value).alias("n"), F.stddev_samp(value).alias("sd"))
    bins = histogram(df, keys, value, low, step, high).withColumnRenamed("n", "m").withColumn("c", F.col("bin_low") + step / 2)
    at = F.explode(F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda k: F.lit(low) + k * ((high - low) / (points - 1)))).alias("x")
    h = F.col("sd") * F.pow(F.col("n"), F.lit(-0.2))
    rows = null_safe_join(bins, s.where("sd > 0"), keys).select(*keys, "m", "c", "n", h.alias("h"), at)
    kernel = F.col("m") * F.exp(-F.pow((F.col("x") - F.col("c")) / F.col("h"), 2) / 2) / (F.col("n") * F.col("h") * 2.5066282746310002)
    return rows.groupBy(*keys, "x").agg(F.sum(kernel).alias("density"))


# ordered rows


def first_difference(df: DataFrame, keys: list[str], order: list, value: str, name: str = "delta") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.col(value) - F.lag(value).over(w))


def rolling_median(df: DataFrame, keys: list[str], t: str, value: str, days: float, centred: bool = True, least: int = 1, name: str = "rolling", large: bool = False) -> DataFrame:
    """Median over (t - w / 2, t + w / 2], or over (t - w, t]; null where the window holds fewer than ``least`` values.

    Each group is sorted by blocks of time, with copies of the rows in reach of a border, so a task holds a block of a group at most.
    ``large`` is for windows of many rows: a block's values are ranked once, where the plain form sorts each window anew."""
    part = ", ".join(f"`{k}`" for k in [*keys, "__block"])
    us = round(days * 86_400e6)
    before, after = (us // 2 - 1, us // 2) if centred else (us - 1, 0)
    if large:
        return rolling_median_of_blocks(df, keys, t, value, before, after, least, name)
    over = f"over (partition by {part} order by `{t}` range between interval '{before / 1e6:.6f}' second preceding and " + (f"interval '{after / 1e6:.6f}' second following)" if after else "current row)")
    blocks = in_time_blocks(df, t, before, after, "__block", "__own")
    return blocks.withColumn(name, F.expr(f"case when count(`{value}`) {over} >= {least} then percentile(`{value}`, 0.5) {over} end")).where("__own").drop("__block", "__own", "__us")


def share_of_first(df: DataFrame, keys: list[str], order: list, value: str, name: str = "pct") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.try_divide(F.col(value) * 100, F.first(value).over(w)))


def steepest_falls(df: DataFrame, keys: list[str], t: str, value: str, split_month: int = 7) -> DataFrame:
    """Day of year of the largest fall from row to row in either part of the year: ``thaw_doy`` up to the month, ``freeze_doy`` after it.

    Ties go to the earlier time; a group without one of the two is left out.
    """
    d = first_difference(df, keys[:1], [t], value).where("delta is not null").withColumn("year", F.year(t))
    early = F.month(t) <= split_month
    best = lambda part: F.min(F.when(part, F.struct("delta", t)))
    g = d.groupBy(*keys[:1], "year").agg(best(early).alias("a"), best(~early).alias("b")).where("a is not null and b is not null")
    return g.select(*keys[:1], "year", F.dayofyear(f"a.{t}").alias("thaw_doy"), F.dayofyear(f"b.{t}").alias("freeze_doy"))


def keep_spaced(df: DataFrame, keys: list[str], order: list, x: str, y: str, least: float) -> DataFrame:
    """Rows farther than ``least`` from the second row after them; the last two of a line always go."""
    w = Window.partitionBy(*keys).orderBy(*order)
    far = F.hypot(F.lead(x, 2).over(w) - F.col(x), F.lead(y, 2).over(w) - F.col(y))
    return df.withColumn("gap", far).where(F.col("gap") > least)


def running_sum(df: DataFrame, keys: list[str], order: list, value: str, name: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(name, F.sum(value).over(w))


def modal_argmax(df: DataFrame, moment: Column, place: str, value: str) -> DataFrame:
    """The place that most often holds a moment's largest value, ties going to the smallest place."""
    top = df.where(F.col(value).isNotNull()).groupBy(moment.alias("moment")).agg(F.max_by(place, F.struct(F.col(value), -F.col(place))).alias(place))
    return modal(top, [], place, place)


def nearest_value_rows(df: DataFrame, column: str, target: float, order: str) -> DataFrame:
    """All rows whose ``column`` equals the value closest to ``target``; of two equally close the one first in ``order``."""
    best = df.where(F.col(column).isNotNull()).agg(F.min_by(column, F.struct(F.abs(F.col(column) - target), F.col(order))).alias("__v"))
    return df.join(F.broadcast(best), F.col(column) == F.col("__v")).drop("__v")


def argmax_reference(df: DataFrame, key: str, valid: Column) -> DataFrame:
    """Valid cells of each key, and whether it is the reference: that with the most, the smallest key of equal ones."""
    counts = df.groupBy(key).agg(F.count_if(valid).alias("valid"))
    best = counts.agg(F.max_by(key, F.struct(F.col("valid"), -F.col(key))).alias("__r"))
    return counts.join(F.broadcast(best)).select(key, "valid", (F.col(key) == F.col("__r")).alias("is_reference"))
