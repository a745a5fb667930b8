"""Range filters, robust outlier filters and quality gates."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import in_range
from .keys import null_safe_join
from .quantiles import exceeds_a_task, large_group_quantiles
from .stats import modal_argmax


def filter_ranges(df: DataFrame, **ranges: tuple | None) -> DataFrame:
    """Rows whose columns are in all of the half-open ranges given; None puts no condition."""
    conditions = [in_range(name, *r) for name, r in ranges.items() if r is not None]
    return df.where(reduce(and_, conditions, F.lit(True)))


def mad_bounds(df: DataFrame, keys: list[str], value: str, large: bool = False) -> DataFrame:
    """``keys``, ``med`` and ``mad`` (unscaled) of each group. Two aggregations; nulls take no part. ``large`` is for few groups that may have too many rows for a task."""
    if large and exceeds_a_task(df, keys, value):
        med = large_group_quantiles(df, keys, value, [0.5]).select(*keys, F.col("q")[0].alias("med"))
        far = null_safe_join(df.select(*keys, value), med, keys).withColumn("__far", F.abs(F.col(value) - F.col("med")))
        mad = large_group_quantiles(far, keys, "__far", [0.5]).select(*keys, F.col("q")[0].alias("mad"))
        return null_safe_join(med, mad, keys)
    med = df.groupBy(*keys).agg(F.median(value).alias("med"))
    far = null_safe_join(df.select(*keys, value), med, keys)
    mad = far.groupBy(*keys).agg(F.median(F.abs(F.col(value) - F.col("med"))).alias("mad"))
    return null_safe_join(med, mad, keys)


def mad_keeps(value: Column, med: Column, mad: Column, n: float = 5, two_sided: bool = False) -> Column:
    """Whether a value lies less than ``n`` median absolute deviations above the median (or from it, if two-sided)."""
    far = F.abs(value - med) if two_sided else value - med
    return far < mad * n


def mad_filter(df: DataFrame, keys: list[str], value: str, n: float = 5, drop: bool = False, two_sided: bool = False, large: bool = False) -> DataFrame:
    """Set outliers of ``value`` to null, or drop their rows. One-sided unless asked otherwise: only high values are outliers.

    The comparison is multiplied out, so a deviation of 0 keeps what lies below the median. ``large`` is for few groups of many rows.
    """
    joined = null_safe_join(df, mad_bounds(df, keys, value, large), keys)
    keep = mad_keeps(F.col(value), F.col("med"), F.col("mad"), n, two_sided)
    out = joined.where(keep) if drop else joined.withColumn(value, F.when(keep, F.col(value)))
    return out.select(*df.columns)


def filter_components(df: DataFrame, keys: list[str], vx: str, vy: str, n: float = 5, speed: str = "v") -> DataFrame:
    """Filter both components by themselves, then take the speed of what is left; a null component makes it null."""
    out = mad_filter(mad_filter(df, keys, vx, n), keys, vy, n)
    return out.withColumn(speed, F.hypot(vx, vy))


def filter_velocities(cells: DataFrame, keys: list[str], vx: str, vy: str, n: float | None = None, speed: str = "v", line: DataFrame | None = None, **ranges) -> tuple[DataFrame, DataFrame | None]:
    """Rows in all ``ranges``; with ``n`` outliers among those are null in each component and the speed is taken anew. Of ``line``, samples along a line, the rows in
    the ranges that have a speed: outliers stay there."""
    own = filter_ranges(cells, **ranges)
    if n is not None:
        own = filter_components(own, keys, vx, vy, n, speed)
    return own, None if line is None else filter_ranges(line, **ranges).where(F.col(speed).isNotNull())


def line_series(df: DataFrame, value: str, place: str, t: str, targets: list[float] | None = None, n: float = 5, **ranges) -> DataFrame:
    """Series at places along a line, in all ``ranges`` and without outliers or nulls: ``target`` and the columns of ``df``.

    For each of ``targets`` the place nearest to it (the smaller of two equally near); without targets the place, given as ``target``, that most often has the
    day's greatest value. Two targets with one place have its series each. Outliers are more than ``n`` median absolute deviations above a place's median.
    """
    own = filter_ranges(df, **ranges)
    if targets is None:
        best = modal_argmax(own.where(F.col(value).isNotNull()), F.to_date(t), place, value).select(F.col(place).cast("double").alias("target"), place)
    else:
        places = own.where(F.col(place).isNotNull()).select(place).distinct().select(place, F.explode(F.array(*[F.lit(float(v)) for v in targets])).alias("target"))
        best = places.groupBy("target").agg(F.min_by(place, F.struct(F.abs(F.col(place) - F.col("target")), F.col(place))).alias(place))
    return mad_filter(own.join(F.broadcast(best), place), ["target"], value, n, drop=True).select("target", *df.columns)


def quality_gate(df: DataFrame, spread: str, offset: str, most_spread: float = 2.0, most_offset: float = 1.0) -> DataFrame:
    return df.where((F.col(spread) < most_spread) & (F.abs(offset) < most_offset))


def trim_by_quantiles(df: DataFrame, keys: list[str], value: str, low: float = 0.05, high: float = 0.95, digits: int = 6, large: bool = False) -> DataFrame:
    """Rows strictly between their group's quantiles, which are rounded. ``large`` is for few groups of many rows."""
    bounds = large_group_quantiles(df, keys, value, [low, high]) if large and exceeds_a_task(df, keys, value) else df.groupBy(*keys).agg(F.percentile(value, [low, high]).alias("q"))
    bounds = bounds.select(*keys, F.round(F.col("q")[0], digits).alias("lo"), F.round(F.col("q")[1], digits).alias("hi"))
    return null_safe_join(df, bounds, keys).where((F.col(value) > F.col("lo")) & (F.col(value) < F.col("hi"))).select(*df.columns)


def coalesce_reference(df: DataFrame, names: list[str], own: str = "to_reg_", other: str = "ref_") -> DataFrame:
    """Fill each ``own`` column from its ``other`` one; ``is_reference`` marks rows that lacked the first."""
    out = df.withColumn("is_reference", F.col(f"{own}{names[0]}").isNull())
    return out.withColumns({f"{own}{n}": F.coalesce(f"{own}{n}", f"{other}{n}") for n in names})


def first_per_group(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
