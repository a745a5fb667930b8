"""SimHash fingerprints by DataFrame functions alone."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Bits of a fingerprint, kept as this many longs.
BITS, WORDS = 128, 2
#: Terms that are added up in 16-bit lanes before the sums move to 32-bit ones; MOST * SEGMENT stays below 2 ** 15.
SEGMENT, MOST = 2048, 15
#: Rows of a cell of neighbours, and the most cells.
CELL_ROWS, MOST_CELLS = 2000, 65536
#: Fingerprints with one front that meet in a task, on either side.
FRONT_ROWS = 1000

_SPREAD, _LANES16, _LANES32 = 0x0000200040008001, 0x0001000100010001, 0x0000FFFF0000FFFF


def _terms(text: Column) -> Column:
    """Pairs of neighbouring words; the last word stands alone."""
    words = F.split(F.translate(F.lower(text), "\n\t\r\f\x0b", "     "), " ")
    words = F.array_remove(words, "")
    return F.arrays_zip(words.alias("a"), F.slice(words, 2, F.greatest(F.size(words), F.lit(1))).alias("b"))


def fingerprints(df: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    """``keys`` and ``f0``, ``f1`` (the fingerprint as two longs) for each row; ``keys`` tell rows apart.

    A term is a pair of neighbouring lower-case words. Each occurrence votes with its length, ``MOST`` at most, for the
    bits of its hash that are set and against the others. Bits of four terms' hashes are spread over lanes of one long,
    so a plain sum adds four votes at once. Null and empty texts have no votes and so the fingerprint zero.
    """
    terms = df.select(*keys, F.posexplode_outer(_terms(F.col(text_col))).alias("pos", "t"))
    a, b = F.coalesce("t.a", F.lit("")), F.coalesce("t.b", F.lit(""))
    terms = terms.select(
        *keys,
        F.shiftright(F.coalesce("pos", F.lit(0)), 11).alias("seg"),
        F.when(F.col("t").isNull(), 0).otherwise(F.least(F.length(a) + F.length(b), F.lit(MOST))).cast("long").alias("w"),
        F.xxhash64(a, b).alias("h0"),
        F.xxhash64(b, F.lit(7), a).alias("h1"),
    )
    votes = [
        F.sum((F.shiftrightunsigned(f"h{k}", 4 * n).bitwiseAND(F.lit(15)) * F.lit(_SPREAD)).bitwiseAND(F.lit(_LANES16)) * F.col("w")).alias(f"v{k}_{n}")
        for k in range(WORDS)
        for n in range(16)
    ]
    sums = terms.groupBy(*keys, "seg").agg(*votes, F.sum("w").alias("w"))
    wide = [
        F.sum((F.shiftrightunsigned(f"v{k}_{n}", 16 * odd)).bitwiseAND(F.lit(_LANES32))).alias(f"s{k}_{n}_{odd}")
        for k in range(WORDS)
        for n in range(16)
        for odd in range(2)
    ]
    sums = sums.groupBy(*keys).agg(*wide, F.sum("w").alias("w"))

    def bit(k: int, n: int, lane: int) -> Column:
        # lanes 0 and 2 of a 16-bit long are lanes 0 and 1 of its even half, 1 and 3 of its odd one
        vote = F.shiftrightunsigned(f"s{k}_{n}_{lane & 1}", 32 * (lane >> 1)).bitwiseAND(F.lit(0xFFFFFFFF))
        return F.when(vote * 2 > F.col("w"), F.shiftleft(F.lit(1).cast("long"), 4 * n + lane)).otherwise(F.lit(0).cast("long"))

    def word(k: int) -> Column:
        out = F.lit(0).cast("long")
        for n in range(16):
            for lane in range(4):
                out = out.bitwiseOR(bit(k, n, lane))
        return out

    return sums.select(*keys, *[word(k).alias(f"f{k}") for k in range(WORDS)])


def hex_of(f0: str, f1: str) -> Column:
    return F.lower(F.concat(*[F.lpad(F.hex(F.col(c)), 16, "0") for c in (f0, f1)]))


def likeness(a: tuple[str, str], b: tuple[str, str]) -> Column:
    far = sum((F.bit_count(F.col(x).bitwiseXOR(F.col(y))) for x, y in zip(a, b, strict=True)), F.lit(0))
    return F.lit(1.0) - far / F.lit(float(BITS))


def _cells(docs: DataFrame, id_col: str) -> tuple[DataFrame, int]:
    """``docs`` with a column ``cell``: ranges of ids, from the highest ids on, of about ``CELL_ROWS`` rows."""
    rows = docs.count()
    n = max(1, min(MOST_CELLS, rows // CELL_ROWS))
    bounds = docs.agg(F.percentile_approx(id_col, [k / n for k in range(1, n)], 4 * n + 100).alias("b")).first().b if n > 1 else []
    bounds = sorted(set(bounds or []), reverse=True)
    step = 64 if len(bounds) <= 4096 else 256
    key = F.col(id_col)
    if not bounds:
        return docs.withColumn("cell", F.lit(0)), 1
    every = F.lit(bounds)
    coarse = F.size(F.filter(F.lit(bounds[step - 1 :: step] or [bounds[0]]), lambda x: x > key)) * step if len(bounds) >= step else F.lit(0)
    cell = coarse + F.size(F.filter(F.slice(every, coarse + 1, step), lambda x: x > key))
    return docs.withColumn("cell", F.when(key.isNull(), len(bounds)).otherwise(cell)), len(bounds) + 1


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint each whole text and its edited text: the last half of its code points gives way to the first as many
    of the next document's, in descending order of ids (after the last comes the first).

    Columns: ``id_col``, ``n_chars``, ``edited_sha256``, ``fingerprint``, ``edited_fingerprint``, ``near_edited``,
    ``near_next``. Null texts count as empty. Rows with equal ids follow each other in the order of their texts; with
    a single document it is its own next; an empty table gives no rows; other columns are not read.

    Ids are cut into ranges of some thousand rows by quantiles, and texts move once, to their range; the window, both
    fingerprints and the neighbour's fingerprint are then made where the rows are. Only the first row of each range
    is fetched for the range before it.
    """
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    celled, _ = _cells(base, "id")
    ordered = celled.select("id", "text", "cell", F.char_length("text").alias("n_chars"), F.xxhash64("text").alias("tie"))
    order = [F.col("id").desc_nulls_last(), "tie", "n_chars", "text"]
    by_cell = Window.partitionBy("cell").orderBy(*order)

    # the first row of each range, by ids and hashes, and the range that it follows
    firsts = ordered.groupBy("cell").agg(F.max(F.struct(F.col("id"), (-F.col("tie")).alias("tie"), (-F.col("n_chars")).alias("n"))).alias("m"))
    ring = Window.orderBy("cell")
    chain = firsts.select("cell", "m", F.coalesce(F.lag("cell").over(ring), F.max("cell").over(ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("follows"))
    heads = ordered.join(F.broadcast(chain.hint("broadcast")), (ordered.cell == chain.cell) & ordered.id.eqNullSafe(F.col("m.id")) & (ordered.tie == -F.col("m.tie")) & (ordered.n_chars == -F.col("m.n")), "left_semi")
    heads = materialize(heads.dropDuplicates(["cell"]).join(F.broadcast(chain.select("cell", "follows")), "cell").select(F.col("follows").alias("cell"), F.col("text").alias("head")), "heads")

    w = ordered.withColumn("rn", F.row_number().over(by_cell)).withColumn("next", F.lead("text").over(by_cell))
    w = w.join(heads, "cell").withColumn("next", F.coalesce("next", "head")).drop("head")
    half = F.floor(F.col("n_chars") / 2).cast("int")
    w = w.withColumn("edited", F.concat(F.expr("left(text, n_chars - int(floor(n_chars / 2)))"), F.substring("next", F.lit(1), half)))
    w = w.select("cell", "rn", "id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("text")), F.struct(F.lit(1).alias("kind"), F.col("edited").alias("text")))).alias("x"))
    w = w.select("cell", "rn", "id", "n_chars", "edited_sha256", "x.kind", "x.text")
    same = ["cell", "rn", "id", "n_chars", "edited_sha256"]
    both = fingerprints(w, [*same, "kind"], "text").groupBy(*same).agg(*[F.max(F.when(F.col("kind") == k, F.col(f"f{n}"))).alias(f"{name}{n}") for k, name in ((0, "f"), (1, "e")) for n in range(WORDS)])
    both = materialize(both, "fingerprints")

    after = Window.partitionBy("cell").orderBy("rn")
    out = both.withColumns({f"n{n}": F.lead(f"f{n}").over(after) for n in range(WORDS)})
    heads = both.where("rn = 1").join(F.broadcast(chain.select("cell", "follows")), "cell").select(F.col("follows").alias("cell"), *[F.col(f"f{n}").alias(f"h{n}") for n in range(WORDS)])
    out = out.join(heads, "cell").withColumns({f"n{n}": F.coalesce(f"n{n}", f"h{n}") for n in range(WORDS)})
    return out.select(
        F.col("id").alias(id_col), F.col("n_chars").cast("long").alias("n_chars"), "edited_sha256", hex_of("f0", "f1").alias("fingerprint"), hex_of("e0", "e1").alias("edited_fingerprint"),
        likeness(("f0", "f1"), ("e0", "e1")).alias("near_edited"), likeness(("f0", "f1"), ("n0", "n1")).alias("near_next"),
    )


def near_fingerprints(prints: DataFrame, radius: int = 3, key: str = "fingerprint") -> DataFrame:
    """All pairs of different fingerprints within ``radius`` bits: ``a``, ``b``, ``distance``, with a < b.

    ``prints`` has fingerprints as 32 hex digits; equal ones count once, so copies add no pairs. The bits are cut into
    ``radius`` + 2 blocks; two fingerprints within the radius agree on two blocks at least, so each table permutes one
    pair of blocks to the front and a join on them finds every such pair; it is returned from the first of its tables alone. A front
    that more than ``FRONT_ROWS`` fingerprints share is dealt out to the cells of a square, so no task meets all of them. Nulls
    take no part; an empty table gives no rows; other columns are not read.
    """
    blocks = radius + 2
    edges = [round(k * 32 / blocks) for k in range(blocks + 1)]
    if blocks > 32:
        raise ValueError("the radius leaves less than a hex digit to a block")
    own = prints.select(F.col(key).alias("f")).where("f is not null").distinct()
    block = lambda c, x: F.substring(c, edges[x] + 1, edges[x + 1] - edges[x])
    pairs_of = list(combinations(range(blocks), 2))
    tables = F.array(*[F.struct(F.lit(n).alias("table"), F.concat_ws("-", *[block("f", x) for x in pair]).alias("front")) for n, pair in enumerate(pairs_of)])
    rows = own.select("f", F.inline(tables))
    cut = rows.groupBy("table", "front").agg(F.count("*").alias("n")).where("n > 1").select("table", "front", F.ceil(F.col("n") / FRONT_ROWS).alias("parts"))
    rows = rows.join(cut, ["table", "front"])
    mine, every = F.pmod(F.xxhash64("f"), F.col("parts")), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    a = rows.withColumns({"x": mine}).withColumn("y", every).select("table", "front", "x", "y", F.col("f").alias("a"))
    b = rows.withColumns({"y": mine}).withColumn("x", every).select("table", "front", "x", "y", F.col("f").alias("b"))
    part = lambda c, at: F.conv(F.substring(c, at, 8), 16, 10).cast("long")
    far = sum((F.bit_count(part("a", at).bitwiseXOR(part("b", at))) for at in (1, 9, 17, 25)), F.lit(0))
    first = F.coalesce(*[F.when((block("a", x) == block("b", x)) & (block("a", y) == block("b", y)), n) for n, (x, y) in enumerate(pairs_of)])
    pairs = a.join(b, ["table", "front", "x", "y"]).where("a < b").withColumn("distance", far)
    return pairs.where((F.col("distance") <= radius) & (first == F.col("table"))).select("a", "b", "distance")
