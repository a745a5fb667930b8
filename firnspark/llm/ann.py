"""Nearest vectors by inner product: cross-polytope hashing with multiprobe tables and exact reranking."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from .common import materialize, partitions

#: Rows of a block of candidates and of queries; a cell with more is cut into several.
BLOCK, QUERY_BLOCK = 8192, 4096
#: Rows of a cell, on average, beyond which one axis more is joined to the hash.
CELL = 8192
#: Vectors whose joint cells are made together.
TOGETHER = 1024
#: Norms that differ by less are taken as equal.
EVEN = 1e-4


def hadamard(x: np.ndarray) -> np.ndarray:
    """Each row times the normalised Hadamard matrix, by log2(columns) rounds of sums and differences."""
    n, half = x.shape[1], 1
    while half < n:
        pairs = x.reshape(len(x), -1, 2, half)
        x = np.concatenate((pairs[:, :, :1] + pairs[:, :, 1:], pairs[:, :, :1] - pairs[:, :, 1:]), axis=2).reshape(len(x), n)
        half *= 2
    return x / np.sqrt(n)


def rotated(x: np.ndarray, table: int) -> np.ndarray:
    """A pseudo-rotation: three rounds of random signs and Hadamard."""
    rng = np.random.default_rng(1000 + table)
    for _ in range(3):
        x = hadamard(x * rng.choice([-1.0, 1.0], x.shape[1]))
    return x


def nearest_axes(x: np.ndarray, many: int) -> np.ndarray:
    """The ``many`` signed axes nearest to each row, nearest first: axis number times 2, plus 1 for its negative side."""
    if many == 1:
        at = np.abs(x).argmax(axis=1)[:, None]
    else:
        order = np.argsort(-np.abs(x), axis=1, kind="stable")
        at = np.concatenate((order, order[:, ::-1]), axis=1)[:, :many]  # beyond all axes, their far sides
    far = np.arange(at.shape[1]) >= x.shape[1]
    return at * 2 + ((np.take_along_axis(x, at, axis=1) < 0) ^ far)


def cells_of(y: np.ndarray, table: int, axes: int, probes: int) -> np.ndarray:
    """The ``probes`` joint cells nearest to each row, nearest first. A cell is a signed axis of each of ``axes`` pseudo-rotations; of the
    nearest axes' combinations those with the largest coordinates together come first."""
    sides = 2 * y.shape[1]
    if axes == 1:
        return nearest_axes(rotated(y, table), min(probes, sides))
    if len(y) > TOGETHER:
        return np.concatenate([cells_of(y[k : k + TOGETHER], table, axes, probes) for k in range(0, len(y), TOGETHER)])
    each = min(sides, 2 * math.ceil(probes ** (1 / axes))) if probes > 1 else 1
    cell, score = np.zeros((len(y), 1), np.int64), np.zeros((len(y), 1))
    for a in range(axes):
        x = rotated(y, table * 64 + a)
        own = nearest_axes(x, each)
        near = np.take_along_axis(x, own >> 1, axis=1) * np.where(own & 1, -1, 1)
        cell = (cell[:, :, None] * sides + own[:, None, :]).reshape(len(y), -1)
        score = (score[:, :, None] + near[:, None, :]).reshape(len(y), -1)
        best = np.argsort(-score, axis=1, kind="stable")[:, :probes]
        cell, score = np.take_along_axis(cell, best, axis=1), np.take_along_axis(score, best, axis=1)
    return cell


def axes_for(rows: int, size: int) -> int:
    """Axes of a joint hash of vectors of ``size`` components: as many as leave ``CELL`` rows to a cell."""
    axes, cells = 1, 2 * size
    while rows > CELL * cells:
        axes, cells = axes + 1, cells * 2 * size
    return axes


def spread(x: np.ndarray, largest: float, even: bool, query: bool) -> np.ndarray:
    """Unit vectors whose angles order as the inner products do, filled up to a power of two. Where norms differ,
    another coordinate makes up for what a candidate's norm lacks to the ``largest``."""
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    if even or query:
        x, rest = x / norm, np.zeros_like(norm)
    else:
        x, rest = x / largest, np.sqrt(np.maximum(0, 1 - (norm / largest) ** 2))
    x = x if even else np.concatenate((x, rest), axis=1)
    size = 1 << max(1, (x.shape[1] - 1).bit_length())
    return np.pad(x, ((0, 0), (0, size - x.shape[1])))


def exact_products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of one query and rows in double precision, summed in the order of the components."""
    out = np.zeros(len(x))
    for k in range(len(q)):
        out += q[k] * x[:, k]
    return out


def block_top(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> tuple[list, list, list]:
    """The ``k`` best distinct ids of the candidates for each query. Products by matrix choose all that may be among them, ties included; exact ones decide."""
    queries, found, scores = [], [], []
    order = np.argsort(ids, kind="stable")
    ids, x = ids[order], x[order]
    starts = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
    slack = 1e-9 * (np.abs(x).max() * np.abs(q).max() * x.shape[1] + 1e-300)
    for lo in range(0, len(q), 256):
        products = q[lo : lo + 256] @ x.T
        products[q_ids[lo : lo + 256, None] == ids[None]] = -np.inf
        by_id = products if len(starts) == len(ids) else np.maximum.reduceat(products, starts, axis=1)
        least = np.partition(by_id, -k, axis=1)[:, -k] - slack if by_id.shape[1] > k else np.full(len(products), -np.inf)
        for i in range(len(products)):
            near = np.flatnonzero((products[i] >= least[i]) & (products[i] > -np.inf))
            exact = exact_products(q[lo + i], x[near])
            order = np.lexsort((ids[near], -exact))
            if len(starts) < len(ids):
                order = order[np.sort(np.unique(ids[near][order], return_index=True)[1])]
            order = order[:k]
            queries.append(np.full(len(order), q_ids[lo + i]))
            found.append(ids[near][order])
            scores.append(exact[order])
    return queries, found, scores


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, tables: int = 8, probes: int = 16, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The ``k`` rows of ``vectors`` with the largest inner products for each of ``queries``: ``query_id``, ``rank``, ``vec_id``, ``score``.

    ``queries`` has the same columns; a row with the query's id isn't its candidate. Each vector is in one cell of each
    table, that of its nearest signed axis; a query looks into the ``probes`` nearest cells. Larger tables are hashed by several
    axes jointly (``axes_for``), so cells don't grow with them; each axis more doubles the tables and takes ``probes`` times as many of
    2 * length times as many cells. All that it meets there is
    ranked by exact products in double precision, equal ones by id. A query that meets fewer than ``k`` is compared with every
    cell of a table, so with all vectors. Vectors that are null, zero or hold null or non-finite components, and rows without an
    id, take no part; only vectors of equal length are compared; repeated ids count once per query. An empty table gives no rows.

    A full cell is cut into blocks, and so are its queries, so no task gets more than a block of each. The driver gets the number of rows by cell alone.
    """
    spark = vectors.sparkSession
    kind = vectors.schema[vector_col].dataType
    assert isinstance(kind, ArrayType)
    v = F.col(vector_col)
    good = F.col(id_col).isNotNull() & v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(v, lambda c: c != 0)
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double")))

    def clean(df: DataFrame) -> DataFrame:
        # equal rows count once; components in double precision
        return df.where(F.coalesce(good, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), v.cast("array<double>").alias("v")).distinct()

    stats = vectors.where(F.coalesce(good, F.lit(False))).groupBy(F.size(v).alias("d")).agg(F.max(norm).alias("hi"), F.min(norm).alias("lo"), F.count("*").alias("n")).collect()
    norms = {r.d: (r.hi, r.hi - r.lo <= EVEN * r.hi, r.n) for r in stats}

    size_of = lambda d: 1 << max(1, (d + (not norms[d][1]) - 1).bit_length())
    axes_of = {d: axes_for(n, size_of(d)) for d, (_, _, n) in norms.items()}

    def search(asked: DataFrame, tables: int, probes: int, joint: bool = True) -> DataFrame:
        several = joint and max(axes_of.values(), default=1) > 1

        def hashed(query: bool):
            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    lists, ids = batch.column(1), batch.column(0).to_numpy()
                    sizes = np.diff(lists.offsets.to_numpy())
                    flat, begin = lists.values.to_numpy(), lists.offsets.to_numpy()
                    for d in np.unique(sizes).tolist():
                        if d not in norms:
                            continue
                        own = np.flatnonzero(sizes == d)
                        x = flat[begin[own][:, None] + np.arange(d)]
                        y = spread(x, norms[d][0], norms[d][1], query)
                        blobs = pa.array([r.tobytes() for r in x], pa.binary())
                        axes = axes_of[d] if joint else 1
                        for t in range(tables << (axes - 1)):
                            cells = cells_of(y, t, axes, probes**axes if query else 1)
                            n = len(own) * cells.shape[1]
                            at = np.repeat(np.arange(len(own)), cells.shape[1])
                            yield pa.RecordBatch.from_arrays(
                                [pa.array(np.full(n, d, np.int32)), pa.array(np.full(n, t, np.int32)), pa.array(cells.ravel().astype(np.int64)), pa.array(ids[own][at]), blobs.take(pa.array(at))],
                                names=["d", "t", "cell", "id", "x"],
                            )

            return run

        schema = "d int, t int, cell long, id long, x binary"
        rows, asks = clean(vectors).mapInArrow(hashed(False), schema), clean(asked).mapInArrow(hashed(True), schema)
        cell = ["d", "t", "cell"]
        sizes = rows.groupBy(*cell).agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
        asked_sizes = asks.groupBy(*cell).agg(F.ceil(F.count("*") / QUERY_BLOCK).alias("q_blocks"))
        cut = materialize(sizes.join(asked_sizes, cell), "cells")
        if not several:  # as many rows as cells: tables times twice the length, for each length
            cut = F.broadcast(cut)
        rows = rows.join(cut, cell).withColumn("b", F.pmod(F.xxhash64("id", "x"), "blocks")).withColumn("q", F.explode(F.sequence(F.lit(0).cast("long"), F.col("q_blocks") - 1)))
        asks = asks.join(cut, cell).withColumn("q", F.pmod(F.xxhash64("id"), "q_blocks")).withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        names = [*cell, "b", "q", "asks", "id", "x"]
        both = rows.withColumn("asks", F.lit(0)).select(*names).unionByName(asks.withColumn("asks", F.lit(1)).select(*names))

        def top(table: pa.Table) -> pa.Table:
            asks, ids = table.column("asks").to_numpy(), table.column("id").to_numpy()
            d = table.column("d")[0].as_py()
            x = np.frombuffer(b"".join(table.column("x").to_pylist()), float).reshape(-1, d)
            mine, theirs = asks == 1, asks == 0
            schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
            if not mine.any() or not theirs.any():
                return schema.empty_table()
            found = block_top(ids[mine], x[mine], ids[theirs], x[theirs], k)
            return pa.Table.from_arrays([pa.array(np.concatenate(f)) for f in found], schema=schema)

        out = both.repartition(max(partitions(spark), 2 * tables), *cell, "b", "q").groupBy(*cell, "b", "q").applyInArrow(top, "query_id long, vec_id long, score double")
        out = out.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return materialize(out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), "nearest")

    out = search(queries, tables, probes)
    full = out.groupBy("query_id").count().where(F.col("count") >= k).select(F.col("query_id").alias(id_col))
    short = materialize(queries.where(F.coalesce(good, F.lit(False))).select(id_col, vector_col).join(full, id_col, "left_anti"), "short")
    if not short.isEmpty():
        rest = search(short, 1, 1 << 30, joint=False)
        out = out.join(rest.select("query_id").distinct(), "query_id", "left_anti").unionByName(rest)
    return out.select("query_id", "rank", F.col("vec_id").cast(vectors.schema[id_col].dataType).alias("vec_id"), "score")
