"""Near duplicates by a MinHash LSH forest, confirmed on full shingle sets."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_since, mark, materialize, partitions, settle
from .graph import components
from .words import hashes, mix, shingles, text_blocks

#: Minima of a signature, sorted orders of the forest, and levels of an order's key.
MINIMA, TREES, LEVELS = 64, 40, 8
#: Neighbours share this many levels at least. A region of more than CROWD rows is cut deeper, level by level, for its
#: nearest pairs; what these leave apart is compared in full.
SHALLOW, CROWD = 5, 32
#: Rows of a region that are held together while a sorted partition is read.
HELD = 200_000
#: Part of the minima in which two signatures must agree before full sets are compared: six standard deviations below 0.8.
AGREE = 0.5
#: Bytes of full sets in a block, on either side, where a crowded region's rows are compared.
ACROSS = (1 << 20, 1 << 23)


def _orders() -> np.ndarray:
    rng = np.random.default_rng(20)
    return np.stack([rng.permutation(MINIMA)[:LEVELS] for _ in range(TREES)])


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Rows of ``MINIMA`` 16-bit digests of minima for non-empty sets of 64-bit hashes."""
    rng = np.random.default_rng(19)
    factors = rng.integers(0, 2**31, MINIMA, np.uint32) * np.uint32(2) + np.uint32(1)
    offsets = rng.integers(0, 2**32, MINIMA, np.uint32)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    values = (np.concatenate(sets) >> np.uint64(17)).astype(np.uint32)
    out = np.empty((len(sets), MINIMA), np.uint32)
    scratch = np.empty_like(values)
    for k in range(MINIMA):
        np.multiply(values, factors[k], out=scratch)
        np.add(scratch, offsets[k], out=scratch)
        out[:, k] = np.minimum.reduceat(scratch, starts)
    out = (out ^ (out >> np.uint32(15))) * np.uint32(0x85EBCA6B)
    return (out >> np.uint32(16)).astype("<u2")


def signed_documents(docs: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """``id``, ``n_shingles``, ``digest`` (of the whole set, null if empty) and ``sig`` for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in text_blocks(batch.column(1)):
                of = hashes().of
                sets = [np.unique(shingles(of(t), size)) for t in texts]
                full = [s for s in sets if len(s)]
                sig = iter(signatures(full)) if full else iter(())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, len(texts)),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                        pa.array([next(sig).tobytes() if len(s) else None for s in sets], pa.binary()),
                    ],
                    names=["id", "n_shingles", "digest", "sig"],
                )

    return docs.select(F.col(id_col).cast("long").alias("id"), text_col).mapInArrow(run, "id long, n_shingles long, digest binary, sig binary")


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each order: its first levels as two longs that sort as the levels do."""
    orders = _orders()
    for batch in batches:
        n = len(batch)
        if not n:
            continue
        sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u2").reshape(n, MINIMA)
        levels = sig[:, orders].astype(">u2")  # n, TREES, LEVELS
        keys = np.ascontiguousarray(levels).view(">i8").astype(np.int64).reshape(n * TREES, 2)
        tree = np.tile(np.arange(TREES, dtype=np.int16), n)
        yield pa.RecordBatch.from_arrays([pa.array(tree), pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array(np.repeat(batch.column(0).to_numpy(), TREES))], names=["tree", "k1", "k2", "id"])


def _shared_levels(tree: np.ndarray, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
    """Levels that each row shares with the row before it."""
    if not len(tree):
        return np.zeros(0, np.int64)
    out = np.zeros(len(tree), np.int64)
    x1, x2 = (k[1:] ^ k[:-1] for k in (k1, k2))
    same = tree[1:] == tree[:-1]
    for level in range(1, LEVELS + 1):
        x, by = (x1, 64 - 16 * level) if level <= 4 else (x2, 128 - 16 * level)
        same = same & (x.view(np.uint64) >> np.uint64(by) == 0) if level != 5 else same & (x1 == 0) & (x.view(np.uint64) >> np.uint64(by) == 0)
        out[1:][same] = level
    return out


def _runs(shared: np.ndarray, depth: int, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and sizes of runs of rows that share ``depth`` levels, among the rows marked in ``inside``."""
    joined = (shared >= depth) & inside
    joined[0] = False
    joined[1:] &= inside[:-1]
    starts = np.flatnonzero(~joined)
    sizes = np.diff(np.append(starts, len(shared)))
    return starts, sizes


def _region_pairs(tree: np.ndarray, k1: np.ndarray, k2: np.ndarray, ids: np.ndarray, crowded: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Candidate pairs (a, b) of sorted rows, and which rows are in a crowded region: one of more than ``CROWD`` rows, or
    with a row that is marked as ``crowded`` because the region goes on elsewhere."""
    shared = _shared_levels(tree, k1, k2)
    near = np.flatnonzero(shared >= SHALLOW)
    left, right = [near - 1], [near]
    inside = np.ones(len(ids), bool)
    out = np.zeros(len(ids), bool)
    for depth in range(SHALLOW, LEVELS + 1):
        starts, sizes = _runs(shared, depth, inside)
        if depth == SHALLOW:
            out = np.repeat((sizes > CROWD) | np.maximum.reduceat(crowded, starts), sizes)
        for g in np.unique(sizes[(sizes > 2) & (sizes <= CROWD)]).tolist():
            i, j = np.triu_indices(g, 1)
            own = starts[sizes == g]
            if depth > SHALLOW:
                own = own[inside[own]]
            left.append((own[:, None] + i).ravel())
            right.append((own[:, None] + j).ravel())
        large = sizes > CROWD
        inside = np.zeros(len(ids), bool)
        for s, n in zip(starts[large].tolist(), sizes[large].tolist(), strict=True):
            inside[s : s + n] = True
            if depth == LEVELS:
                left.append(np.full(n - 1, s))
                right.append(np.arange(s + 1, s + n))
        if not large.any():
            break
    a, b = ids[np.concatenate(left)], ids[np.concatenate(right)]
    return np.minimum(a, b), np.maximum(a, b), out


def _region(tree: np.ndarray, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
    """A hash of the order and its first ``SHALLOW`` levels."""
    return mix(mix(k1.view(np.uint64)) ^ (k2.view(np.uint64) >> np.uint64(48)) ^ (tree.astype(np.uint64) << np.uint64(32))).view(np.int64)


def _compared(rows: list[np.ndarray], crowded: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of sorted rows (tree, k1, k2, id): kind 0, pairs (a, b); kind 1, rows a of the crowded region b."""
    if len(rows[3]):
        a, b, inside = _region_pairs(*rows, crowded)
        if len(a):
            pairs = np.unique(np.stack((a, b)), axis=1)
            yield 0, pairs[0], pairs[1]
        if inside.any():
            tree, k1, k2, ids = (x[inside] for x in rows)
            yield 1, ids, _region(tree, k1, k2)


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Walk a sorted partition region by region. Kinds: 0 and 1 as in ``_compared``; 2 a row at one of the partition's ends, b its
    number; 3 the same where the whole partition is one region."""

    def batch_of(kind: int, a: np.ndarray, b: np.ndarray, more: list | None = None) -> pa.RecordBatch:
        n = len(a)
        tree, k1, k2 = more if more is not None else (np.zeros(n, np.int16), np.zeros(n, np.int64), np.zeros(n, np.int64))
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int8)), pa.array(a), pa.array(b), pa.array(tree), pa.array(k1), pa.array(k2)], names=["kind", "a", "b", "tree", "k1", "k2"])

    def done(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        crowded = np.zeros(len(rows[3]), bool)
        crowded[0] = goes_on
        for found in _compared(rows, crowded):
            yield batch_of(*found)

    part = TaskContext.get().partitionId()
    held: list[np.ndarray] | None = None
    head: list[np.ndarray] = []
    goes_on, one = False, True  # whether the first region held has begun in rows that are done; whether there is but one
    for batch in batches:
        if not len(batch):
            continue
        rows = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(4)]
        if held is not None:
            rows = [np.concatenate(x) for x in zip(held, rows, strict=True)]
        shared = _shared_levels(*rows[:3])
        if held is None:
            head = [x[:CROWD] for x in rows]
        elif len(head[3]) < CROWD and one and not goes_on:
            head = [x[:CROWD] for x in rows]
        cuts = np.flatnonzero(shared < SHALLOW)
        cut = int(cuts[-1])
        one = one and cut == 0
        if len(shared) - cut > HELD:  # a region too large to hold goes on from its last row
            yield from done(rows)
            cut, goes_on = len(shared) - 1, True
        elif cut:
            yield from done([x[:cut] for x in rows])
            goes_on = False
        held = [x[cut:] for x in rows]
    if held is not None:
        goes_on = goes_on or one
        yield from done(held)
        for rows, edge in ((head, 2 * part - 1), ([x[-CROWD:] for x in held], 2 * part + 1)):
            yield batch_of(3 if one else 2, rows[3], np.full(len(rows[3]), edge), rows[:3])


def candidate_pairs(reps: DataFrame, parts: int) -> tuple[DataFrame, DataFrame]:
    """Pairs (``a``, ``b``) of neighbours in the forest's sorted orders, and rows (``a``, region ``b``) of crowded regions.

    ``reps`` has ``id`` and ``sig``. Every order is dealt out by ranges of (order, key, id), so equal keys spread over
    tasks. Each task walks its rows once: those that share ``SHALLOW`` levels form a region and all its pairs are
    candidates. Of a crowded region the pairs of its deeper levels and neighbours are, and all its rows are returned
    with it. Regions that lie across tasks are completed from the rows at the tasks' ends.
    """
    rows = reps.select("id", "sig").mapInArrow(_keys, "tree short, k1 long, k2 long, id long")
    rows = rows.repartitionByRange(parts, "tree", "k1", "k2", "id").sortWithinPartitions("tree", "k1", "k2", "id")
    found = materialize(rows.mapInArrow(_neighbours, "kind byte, a long, b long, tree short, k1 long, k2 long"), "neighbours")

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [[b.column(k).to_numpy(zero_copy_only=False) for k in range(6)] for b in batches if len(b)]
        if not kept:
            return
        edge, *rows, kind = [np.concatenate(x) for x in zip(*kept, strict=True)]
        for e in np.unique(edge):
            own = edge == e
            for which, a, b in _compared([x[own] for x in rows], kind[own] == 3):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a), which, np.int8)), pa.array(a), pa.array(b)], names=["kind", "a", "b"])

    ends = found.where("kind >= 2").select("b", "tree", "k1", "k2", F.col("a").alias("id"), "kind")
    ends = ends.repartition(parts, "b").sortWithinPartitions("b", "tree", "k1", "k2", "id").mapInArrow(across, "kind byte, a long, b long")
    every = found.where("kind < 2").select("kind", "a", "b").unionByName(ends).where("kind = 1 or a < b").distinct()
    every = materialize(every, "candidates")
    return every.where("kind = 0").select("a", "b"), every.where("kind = 1").select("a", "b")


def _estimates(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """Pairs whose signatures agree in ``AGREE`` of the minima at least, with how many do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), "<u2").reshape(-1, MINIMA) for k in (2, 3))
            same = (x == y).sum(axis=1)
            good = np.flatnonzero(same >= AGREE * MINIMA)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(good)), batch.column(1).take(pa.array(good)), pa.array(same[good].astype(np.int32))], names=["a", "b", "same"])

    x, y = (reps.select(F.col("id").alias(c), F.col("sig").alias(f"sig_{c}")) for c in ("a", "b"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a long, b long, same int")


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets have 100 * intersection >= percent * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for k, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                x, y = (np.frombuffer(v.as_buffer(), "<u8") for v in (x, y))
                if len(x) > len(y):
                    x, y = y, x
                if 100 * len(x) < percent * len(y):
                    continue
                at = np.searchsorted(y, x)
                both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
                if 100 * both >= percent * (len(x) + len(y) - both):
                    good.append(k)
            yield pa.RecordBatch.from_arrays([batch.column(k).take(pa.array(good, pa.int64())) for k in (0, 1)], names=["a", "b"])

    x, y = (sets.select(F.col("id").alias(c), F.col("full").alias(f"set_{c}")) for c in ("a", "b"))
    return pairs.select("a", "b").join(x, "a").join(y, "b").select("a", "b", "set_a", "set_b").mapInArrow(run, "a long, b long")


def _across(left: DataFrame, right: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (``a``, ``b``) between rows of ``left`` and ``right`` (``g``, ``id``, ``component``) with the same ``g`` and different components.

    Both sides are cut into blocks by the bytes of their sets, and each pair of blocks meets in a task: rows move, pairs
    don't. Rows whose signatures agree with one of the other side's in ``AGREE`` of the minima have their shingles
    counted over an index of that side. A row gives one link for each component that it is linked with.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        side = table.column("side").to_numpy()
        ids, component = table.column("id").to_numpy(), table.column("component").to_numpy()
        sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), "<u2").reshape(-1, MINIMA)
        full = [np.frombuffer(v.as_buffer(), "<u8") for v in table.column("full")]
        mine, theirs = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        if not len(mine) or not len(theirs):
            return schema.empty_table()
        sizes = np.array([len(full[k]) for k in theirs])
        values = np.concatenate([full[k] for k in theirs])
        order = np.argsort(values, kind="stable")
        values, owner = values[order], np.repeat(np.arange(len(theirs)), sizes)[order]
        other_sig = sig[theirs]
        out = []
        for k in mine:
            x = full[k]
            apart = component[theirs] != component[k]
            if not (((other_sig == sig[k]).sum(axis=1) >= AGREE * MINIMA) & apart).any():
                continue
            lo, hi = np.searchsorted(values, x, "left"), np.searchsorted(values, x, "right")
            n = hi - lo
            at = np.repeat(lo - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
            both = np.bincount(owner[at], minlength=len(theirs))
            good = (100 * both >= percent * (len(x) + sizes - both)) & apart
            other = theirs[good]
            for first in np.unique(component[other], return_index=True)[1]:
                a, b = sorted((int(ids[k]), int(ids[other[first]])))
                out.append((a, b))
        return pa.Table.from_arrays([pa.array([r[c] for r in out], pa.int64()) for c in (0, 1)], schema=schema)

    left, right = (df.join(sets, "id") for df in (left, right))
    blocks = [df.groupBy("g").agg(F.ceil(F.sum(F.octet_length("full")) / size).alias(name)) for df, size, name in ((left, ACROSS[0], "nl"), (right, ACROSS[1], "nr"))]
    cut = materialize(blocks[0].join(blocks[1], "g"), "blocks")
    own = []
    for df, side, mine, theirs in ((left, 0, "nl", "nr"), (right, 1, "nr", "nl")):
        d = df.join(cut, "g").withColumn("mine", F.pmod(F.xxhash64("id"), mine)).withColumn("theirs", F.explode(F.sequence(F.lit(0).cast("long"), F.col(theirs) - 1)))
        names = ("mine", "theirs") if side == 0 else ("theirs", "mine")
        own.append(d.select("g", F.col(names[0]).alias("x"), F.col(names[1]).alias("y"), F.lit(side).alias("side"), "id", "component", "sig", "full"))
    return own[0].unionByName(own[1]).groupBy("g", "x", "y").applyInArrow(run, "a long, b long").distinct()


def _full_sets(docs: DataFrame, wanted: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """``id`` and ``full`` (sorted 64-bit hashes of the distinct shingles) of the documents in ``wanted``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in text_blocks(batch.column(1)):
                of = hashes().of
                full = [np.unique(shingles(of(t), size)).astype("<u8").tobytes() for t in texts]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), pa.array(full, pa.binary())], names=["id", "full"])

    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(wanted.hint("merge"), "id", "left_semi")
    return own.mapInArrow(run, "id long, full binary")


def _relabelled(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """``pairs`` with the components of both ends, an id without one being its own."""
    for c in ("a", "b"):
        own = groups.select(F.col("id").alias(c), F.col("component").alias(f"c{c}"))
        pairs = pairs.join(own, c, "left").withColumn(f"c{c}", F.coalesce(f"c{c}", c))
    return pairs


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Components of documents whose sets of ``size``-word shingles have a Jaccard similarity of ``percent`` or more.

    Columns: ``id_col``, ``n_shingles``, ``component_id`` (smallest id reachable), ``kept`` (whether that is its own).
    A text with fewer words is one shingle; without words, or null, the set is empty and linked with nothing. A row
    without an id is linked with nothing: its component is null and it is kept. Rows with equal ids are one document
    if their texts agree; otherwise all of their texts take part and share the id's component. Repeated rows come
    back as often; an empty table gives no rows; other columns are not read.

    Documents with the same set are one from the start, so copies make no pairs. Candidates come from the forest; each
    id's best one by signature is confirmed on full sets first, and of the others only those that still join two
    components, so a group of near copies costs about as many comparisons as it has members. In a region of many
    texts, those outside its largest component are compared with all of that component and with each other, block by
    block. So a link is lost only where two texts share ``SHALLOW`` levels in none of the orders, or agree in less than ``AGREE`` of
    the minima: at a similarity of 0.8 with a chance of about 1e-4 (simulated with these orders), and less above.
    """
    spark = docs.sparkSession
    parts, begin = partitions(spark), mark()
    signed = materialize(signed_documents(docs, size, id_col, text_col), "signed")
    full = signed.where("digest is not null and id is not null")
    reps = materialize(full.groupBy("digest").agg(F.min("id").alias("id"), F.first("sig").alias("sig")), "reps")
    # ids with several texts have several rows here; they are linked through the id itself
    copies = full.select("digest", F.col("id").alias("b")).join(reps.select("digest", F.col("id").alias("a")), "digest").where("a < b").select("a", "b")

    pairs, crowded = candidate_pairs(reps, parts)
    near = materialize(_estimates(pairs, reps), "near")
    each = near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b"), "same"))
    best = each.groupBy("a").agg(F.max(F.struct("same", (-F.col("b")).alias("low"))).alias("x")).select("a", (-F.col("x.low")).alias("b"))
    best = materialize(best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "best")
    wanted = near.select(F.explode(F.array("a", "b")).alias("id")).unionByName(crowded.select(F.col("a").alias("id"))).distinct()
    sets = materialize(_full_sets(docs, wanted, size, id_col, text_col).distinct(), "sets")
    settle(spark)

    links = materialize(_confirm(best, sets, percent), "links")
    groups = materialize(components(links), "groups")
    # of the pairs that would join components each component's best comes first
    open_ = materialize(_relabelled(near.join(best, ["a", "b"], "left_anti"), groups).where("ca <> cb"), "open")
    ends = open_.select(F.col("ca").alias("c"), "a", "b", "same").unionByName(open_.select(F.col("cb").alias("c"), "a", "b", "same"))
    best = materialize(ends.groupBy("c").agg(F.max(F.struct("same", "a", "b")).alias("x")).select("x.a", "x.b").distinct(), "best")
    more = materialize(_confirm(best, sets, percent), "links")
    links = links.unionByName(more)
    if not more.isEmpty():
        groups = materialize(components(links), "groups")
    settle(spark)
    open_ = _relabelled(open_.select("a", "b").join(best, ["a", "b"], "left_anti"), groups).where("ca <> cb").select("a", "b")
    links = links.unionByName(materialize(_confirm(open_, sets, percent), "links"))
    # crowded regions: rows outside the region's main component against all of that component, and against each other
    inside = crowded.select(F.col("b").alias("region"), F.col("a").alias("id")).join(groups, "id", "left").select("region", "id", F.coalesce("component", "id").alias("component"))
    inside = materialize(inside, "crowded")
    main = inside.groupBy("region", "component").count().groupBy("region").agg(F.max(F.struct("count", "component")).alias("m"), F.count("*").alias("n")).where("n > 1").select("region", F.col("m.component").alias("main"))
    odd = materialize(inside.join(main, "region").where("component <> main"), "odd")
    if not odd.isEmpty():
        signed_sets = materialize(sets.join(reps.select("id", "sig"), "id"), "signed_sets")
        targets = odd.select(F.col("main").alias("g")).distinct()
        members = inside.select(F.col("component").alias("g"), "id", "component").distinct().join(targets, "g", "left_semi")
        links = links.unionByName(materialize(_across(odd.select(F.col("main").alias("g"), "id", "component").distinct(), members, signed_sets, percent), "links"))
        each = odd.select(F.col("region").alias("g"), "id", "component")
        links = links.unionByName(materialize(_across(each, each, signed_sets, percent), "links"))
    links = materialize(links.unionByName(copies), "links")
    drop_since(begin, signed, links)
    settle(spark)

    groups = components(links)
    own = signed.select("id", "n_shingles").join(groups, "id", "left")
    component = F.coalesce("component", "id")
    return own.select(F.col("id").cast(docs.schema[id_col].dataType).alias(id_col), "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))
