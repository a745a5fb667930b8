"""Connected components by repeated joins."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (a, b) of each batch as stars around the smallest id of each of its components."""
    for batch in batches:
        a, b = (batch.column(k).to_numpy() for k in (0, 1))
        ids, at = np.unique(np.concatenate((a, b)), return_inverse=True)
        x, y = at[: len(a)], at[len(a) :]
        label = np.arange(len(ids))
        while len(x):
            low = np.minimum(label[x], label[y])
            before = label.copy()
            for side in (x, y, before[x], before[y]):
                np.minimum.at(label, side, low)
            label = label[label]
            if (label == before).all():
                break
        root = label
        own = np.flatnonzero(root != np.arange(len(ids)))
        yield pa.RecordBatch.from_arrays([pa.array(ids[root[own]]), pa.array(ids[own])], names=["a", "b"])


def _stars(edges: DataFrame) -> bool:
    """Whether each ``b`` has one ``a`` and none is an ``a`` itself."""
    ends = edges.select(F.col("b").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("a").alias("id"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("id").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up + down > 1 and up > 0").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """``id`` and ``component`` (the smallest id reachable) for each id of ``edges`` (``a``, ``b``, both long).

    Large-star and small-star steps alternate until all that is left are stars around the smallest ids; each is one
    aggregation and one join, so no component has to fit into a task, and a hub's rows are summed up before they
    move. Edges are first reduced to forests batch by batch. Nulls and loops take no part.
    """
    edges = edges.where("a <> b").select("a", "b").mapInArrow(_forest, "a long, b long").distinct()
    edges = materialize(edges, "edges")
    while not _stars(edges):
        # large star: neighbours above a node join the smallest of its neighbourhood
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        large = both.where("b > a").join(low, "a").select(F.col("low").alias("a"), "b").where("a <> b").distinct()
        # small star: a node and its neighbours below it join the smallest of them
        low = large.groupBy("b").agg(F.min("a").alias("low"))
        small = large.join(low, "b").select(F.col("low").alias("x"), F.explode(F.array("a", "b")).alias("y")).where("x <> y")
        edges = materialize(small.select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "edges")
    nodes = edges.select(F.col("b").alias("id"), F.col("a").alias("component"))
    return nodes.unionByName(edges.select(F.col("a").alias("id"), F.col("a").alias("component")).distinct())
