"""Exact quantiles of few groups with many rows, and rows by blocks of time, so that no group is held or sorted in one task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .keys import null_safe_join

CELLS, MOST_GROUPS, ONE_TASK = 4096, 10_000, 1_000_000


def bounded(df: DataFrame, most: int) -> DataFrame:
    """A copy of ``df`` to broadcast, if it has no more than ``most`` rows; else ``df`` itself, which joins by a shuffle."""
    rows = df.limit(most + 1).collect()
    return df if len(rows) > most else F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))


def exceeds_a_task(df: DataFrame, keys: list[str], value: str) -> bool:
    """Whether a group has more values than one task should hold. One job, whose result is a row; both ways give equal quantiles."""
    most = df.groupBy(*keys).agg(F.count(value).alias("n")).agg(F.max("n")).first()[0]
    return (most or 0) > ONE_TASK


def large_group_quantiles(df: DataFrame, keys: list[str], value: str, qs: list[float], cells: int = CELLS) -> DataFrame:
    """``keys``, ``q`` (exact quantiles with linear interpolation, an array in the order of ``qs``) and ``n``, the count of values that aren't null.

    Rows are counted by group and cell (equal widths between the group's least and largest finite value), then by value in the cells alone
    that hold a wanted place. Both counts are combined before the shuffle, ties included; a window sees the cells of a group, or the
    distinct values of one cell. The jobs run at once and hand the driver a row for each group, up to MOST_GROUPS of them; more groups
    than that join by shuffles. A group without values has nulls and n = 0. NaN counts as the largest value.
    """
    own = df.select(*keys, F.col(value).cast("double").alias("__v"))
    finite = F.when(F.abs("__v") < float("inf"), F.col("__v") / 2)
    groups = own.groupBy(*keys).agg(F.min(finite).alias("__lo"), F.max(finite).alias("__hi"), F.count("__v").alias("n"))
    groups = bounded(groups, MOST_GROUPS)
    wide = F.when(F.col("__hi") > F.col("__lo"), (F.col("__v") / 2 - F.col("__lo")) / (F.col("__hi") - F.col("__lo")) * cells).otherwise(0.0)
    cell = F.when(F.abs("__v") < float("inf"), F.floor(F.least(wide, F.lit(cells - 1.0)))).when(F.col("__v") < 0, -1).otherwise(cells)
    placed = null_safe_join(own.where("__v is not null"), groups, keys).select(*keys, "n", "__v", cell.cast("int").alias("__cell"))
    position = [(F.col("n") - 1) * F.lit(float(q)) for q in qs]
    ranks = F.array(*[f(p) for p in position for f in (F.floor, F.ceil)])
    running = Window.partitionBy(*keys).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy(*keys, "n", "__cell").agg(F.count("*").alias("__c")).withColumn("__before", F.coalesce(F.sum("__c").over(running), F.lit(0)))
    wanted = counts.where(F.exists(ranks, lambda r: (r >= F.col("__before")) & (r < F.col("__before") + F.col("__c")))).select(*keys, "__cell", "__before")
    wanted = bounded(wanted, 2 * len(qs) * MOST_GROUPS)
    inside = null_safe_join(placed, wanted, [*keys, "__cell"]).groupBy(*keys, "n", "__cell", "__before", "__v").agg(F.count("*").alias("__c"))
    above = Window.partitionBy(*keys, "__cell").orderBy("__v").rowsBetween(Window.unboundedPreceding, -1)
    inside = inside.withColumn("__first", F.col("__before") + F.coalesce(F.sum("__c").over(above), F.lit(0)))
    at = lambda r: F.max(F.when((F.col("__first") <= r) & (r < F.col("__first") + F.col("__c")), F.col("__v")))
    found = inside.groupBy(*keys, "n").agg(*[at(f(p)).alias(f"__{e}{k}") for k, p in enumerate(position) for e, f in (("a", F.floor), ("b", F.ceil))])
    parts = [(F.col(f"__a{k}"), F.col(f"__b{k}"), p) for k, p in enumerate(position)]
    between = [F.when(a == b, a).otherwise((F.ceil(p) - p) * a + (p - F.floor(p)) * b) for a, b, p in parts]
    found = found.select(*keys, F.array(*between).alias("q"))
    none = F.array(*[F.lit(None).cast("double")] * len(qs))
    every = groups.select(*keys, "n")
    if keys:
        out = null_safe_join(every, found, keys, "left")
    else:
        out = every.join(F.broadcast(found), F.lit(True), "left")  # one row on both sides
    return bounded(out.select(*keys, F.coalesce("q", none).alias("q"), "n"), MOST_GROUPS)


def in_time_blocks(df: DataFrame, t: str, before: int, after: int, block: str, own: str) -> DataFrame:
    """Rows by blocks of time, twice the reach wide: ``block`` is the block, ``own`` whether it is the row's own, ``__us`` the microseconds since 1970.

    A row comes again in each block that holds a time at which it is in reach, ``before`` to ``after`` microseconds around that time.
    A row without a time is alone with its like in the null block.
    """
    width = 2 * max(before + after, 1)
    us = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast(df.schema[t].dataType), F.col(t))
    place = lambda shift: F.floor((us + shift) / width)
    out = df.withColumn("__us", us).withColumn(block, F.explode_outer(F.sequence(place(-after), place(before))))
    return out.withColumn(own, F.col(block).eqNullSafe(place(0)))


def ranked(values: np.ndarray, first: np.ndarray, last: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Of each run ``values[first:last]`` the value at its place, from 0, in their order.

    The values' ranks are parted bit by bit, highest first, and each run is followed into the part that holds its place: so many
    steps as ranks have bits, each over all runs at once, whatever the runs' lengths.
    """
    distinct, rank = np.unique(values, return_inverse=True)
    rank = rank.astype(np.int32)
    at = np.int32 if len(values) < 2**31 - 1 else np.int64
    lo, hi, k, out = first.astype(at), last.astype(at), places.astype(at), np.zeros(len(first), np.int32)
    low = np.zeros(len(values) + 1, at)
    for bit in range(max(len(distinct) - 1, 0).bit_length() - 1, -1, -1):
        high = (rank >> bit & 1).astype(bool)
        np.cumsum(~high, out=low[1:])
        a, b = low[lo], low[hi]
        up = k >= b - a
        k -= np.where(up, b - a, 0).astype(at)
        out |= up.astype(np.int32) << bit
        lo, hi = np.where(up, low[-1] + lo - a, a), np.where(up, low[-1] + hi - b, b)
        rank = np.concatenate([rank[~high], rank[high]])
    return distinct[out]


def sliding_medians(us: np.ndarray, values: np.ndarray, wanted: np.ndarray, before: int, after: int, least: int) -> np.ma.MaskedArray:
    """Median of the values from ``us - before`` to ``us + after`` for the wanted rows of a sorted run, masked where there are fewer than ``least``; NaN is no value."""
    there = ~np.isnan(values)
    times, own = us[there], np.flatnonzero(wanted)
    first, last = np.searchsorted(times, us[own] - before, "left"), np.searchsorted(times, us[own] + after, "right")
    n = last - first
    enough = n >= max(least, 1)
    own, first, last, n = own[enough], first[enough], last[enough], n[enough]
    even = np.flatnonzero(n % 2 == 0)
    got = ranked(values[there], np.concatenate([first, first[even]]), np.concatenate([last, last[even]]), np.concatenate([(n - 1) // 2, n[even] // 2]))
    out = np.ma.masked_all(len(us), np.float64)
    median = got[: len(n)]
    median[even] = median[even] * 0.5 + got[len(n) :] * 0.5
    out[own] = median
    return out


def rolling_median_of_blocks(df: DataFrame, keys: list[str], t: str, value: str, before: int, after: int, least: int, name: str) -> DataFrame:
    """``df`` with the rolling median of each row, a block of a group at a time: the values of a block are
    ranked once for all its windows, where a window expression sorts each frame anew. A task holds three reaches of one group."""
    kept = [c for c in df.columns if c != name]
    blocks = in_time_blocks(df, t, before, after, "__block", "__own").withColumn("__v", F.col(value).cast("double"))
    rows = blocks.select(*kept, "__block", "__own", "__us", "__v")

    def slide(table: pa.Table) -> pa.Table:
        table = table.sort_by("__us")
        us = table["__us"].combine_chunks().fill_null(0).to_numpy()
        values = table["__v"].combine_chunks().fill_null(float("nan")).to_numpy()
        own = table["__own"].combine_chunks()
        medians = sliding_medians(us, values, own.to_numpy(zero_copy_only=False), before, after, least)
        return table.select(kept).append_column(name, pa.array(medians.data, pa.float64(), mask=np.ma.getmaskarray(medians))).filter(own)

    schema = df.select(*kept).schema.add(name, "double")
    return rows.groupBy(*keys, "__block").applyInArrow(slide, schema)
