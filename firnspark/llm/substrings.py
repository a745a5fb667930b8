"""Passages that documents share, found by collinear chaining of k-mer seeds."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop, free_name, materialize, partitions, settle
from .words import block_hashes, mix, shingles, text_blocks

#: Words of a k-mer; k-mers of which the least is a seed, so that 14 equal words in a row always share one.
KMER, WINDOW = 5, 10
#: Seeds on end of which one in SHARE is a seed of its own: its first holder is the first text with all of that stretch.
RUN, SHARE = 3, 3
#: Words of a gap cost one matched word; a chain breaks at gaps of more words.
GAP_COST, MOST_GAP = 0.1, 60
#: Words beside a chain that are aligned too; slices begin and end at multiples of GRID.
BESIDE, GRID = 32, 32
#: Cost of a word without a partner: for a similarity of 0.8, and at the ends of a passage; a passage with more of them in a row is cut there if both parts are passages.
MISS, END_MISS, LONG_MISS = 4, 2, 10
#: Bytes of a word's hash that slices hold.
HASH = 5
#: Words of the slices whose equal words are counted together.
PAIR_WORDS = 50_000


class PrefixMax:
    """Fenwick tree: the best (score, item) among keys up to a given one."""

    def __init__(self, size: int):
        self.best: list[tuple[float, int]] = [(float("-inf"), -1)] * (size + 1)

    def put(self, key: int, score: float, item: int) -> None:
        at, best, new = key + 1, self.best, (score, item)
        while at < len(best):
            if new > best[at]:
                best[at] = new
            at += at & -at

    def up_to(self, key: int) -> tuple[float, int]:
        at, out, best = key + 1, (float("-inf"), -1), self.best
        while at:
            if best[at] > out:
                out = best[at]
            at &= at - 1
        return out


def block_seeds(words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts (by number), values and positions of the seeds of word sequences, of ``counts`` words each, that follow on each other: the least k-mer of each window.
    Where one is a seed several times on end, as in words that repeat with a period, its number in that run goes into its value, so runs meet in order.
    Of the stretches of ``RUN`` seeds those that a hash chooses are seeds too. Ordered by text and position."""
    none = np.zeros(0, np.int64)
    if not (counts >= KMER).any():
        return none, np.zeros(0, np.uint64), none
    first = np.cumsum(counts) - counts
    values = shingles(words, KMER)  # those that reach into the next text are in no window
    low, least = np.arange(len(values)), values
    done = 1
    while done < WINDOW:  # of windows twice as long each time; of equal values the first
        step = min(done, WINDOW - done)
        least, more = least[: max(0, len(least) - step)], least[step:]
        lower = more < least
        low, least = np.where(lower, low[step:], low[: len(least)]), np.where(lower, more, least)
        done += step
    text = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(len(words)) - first[text]
    own = np.flatnonzero(place + KMER + WINDOW - 1 <= counts[text])  # windows inside of a text
    low = low[own]
    short = np.flatnonzero((counts >= KMER) & (counts < KMER + WINDOW - 1))
    if len(short):
        ends = (first[short] + counts[short] - KMER + 1).tolist()
        low = np.sort(np.append(low, [s + int(values[s:e].argmin()) for s, e in zip(first[short].tolist(), ends, strict=True)]))
    at = low[np.append(True, low[1:] != low[:-1])]
    values, text = values[at], text[at]
    at -= first[text]
    nth = np.arange(len(at))
    head = np.append(True, (values[1:] != values[:-1]) | (text[1:] != text[:-1]))
    again = nth - np.maximum.accumulate(np.where(head, nth, 0))
    if again.any():
        values = np.where(again > 0, mix(values + again.astype(np.uint64)), values)
    if len(values) >= RUN:
        long = shingles(values, RUN)
        own = np.flatnonzero((long % np.uint64(SHARE) == 0) & (text[RUN - 1 :] == text[: len(long)]))
        # both are in order, so each stretch goes right behind its first seed
        values, at, text = (np.insert(x, own + 1, y) for x, y in ((values, long[own]), (at, at[own]), (text, text[own])))
    return text, values, at


def seeds(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values, ascending, and positions of the seeds of one word sequence."""
    _, values, at = block_seeds(words, np.array([len(words)]))
    order = np.argsort(values, kind="stable")
    return values[order], at[order]


def _by_value(value: np.ndarray) -> np.ndarray:
    """What a stable argsort gives. Most values are different, so ties are put in order afterwards."""
    order = np.argsort(value)
    got = value[order]
    same = got[1:] == got[:-1]
    tied = np.flatnonzero(np.append(same, False) | np.append(False, same))
    own = order[tied]
    order[tied] = own[np.lexsort((own, got[tied]))]
    return order


def _postings(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Seeds as (``kmer``, ``b``, ``pb``). Of a block's documents with a seed the first has a row with its further places in ``more``; there ``pb`` is twice the place, plus one if others
    hold it too. The others have a row for each place with its number there, ``nth``, so a seed that a third of all documents hold has few rows of the first kind in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for first, texts in text_blocks(batch.column(1)):
                own = ids[first : first + len(texts)]
                by_id = np.argsort(own, kind="stable")
                own = own[by_id]
                text, value, at = block_seeds(*block_hashes([texts[k] for k in by_id.tolist()]))
                if not len(value):
                    continue
                value, doc = value.view(np.int64), own[text]
                # seeds are in the order of texts and places: that of ids and places too where no id is there twice
                order = _by_value(value) if (own[1:] != own[:-1]).all() else np.lexsort((at, doc, value))
                value, doc, at = value[order], doc[order], at[order].astype(np.int32)
                once = np.append(True, (value[1:] != value[:-1]) | (doc[1:] != doc[:-1]) | (at[1:] != at[:-1]))
                value, doc, at = value[once], doc[once], at[once]
                place = np.arange(len(value))
                head = np.append(True, value[1:] != value[:-1])
                lead = np.maximum.accumulate(np.where(head, place, 0))
                nth = place - np.maximum.accumulate(np.where(head | np.append(True, doc[1:] != doc[:-1]), place, 0))
                own = doc == doc[lead]
                held = np.bincount(lead[own], minlength=len(value))  # places in the first document
                many = np.bincount(lead, minlength=len(value))
                keep = np.flatnonzero(head | ~own)
                sizes = np.where(head, held - 1, 0)[keep]
                more = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.array(at[own & (nth > 0)]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(value[keep]), pa.array(doc[keep]), pa.array(np.where(head, at * 2 + (many > held), at)[keep].astype(np.int32)), more, pa.array(nth[keep].astype(np.int32), mask=head[keep])],
                    names=["kmer", "b", "pb", "more", "nth"],
                )

    return docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), text_col).mapInArrow(run, "kmer long, b long, pb int, more array<int>, nth int")


def anchors(pb: np.ndarray, pa_: np.ndarray) -> np.ndarray:
    """Rows (start in b, start in a, words): seeds on one diagonal that are at most ``MOST_GAP`` / 2 words apart, together."""
    order = np.lexsort((pb, pa_ - pb))
    pb, pa_ = pb[order], pa_[order]
    new = np.append(True, (np.diff(pa_ - pb) != 0) | (np.diff(pb) > MOST_GAP // 2))
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], len(pb)) - 1
    return np.stack((pb[starts], pa_[starts], pb[ends] - pb[starts] + KMER), axis=1)


def chains(found: np.ndarray) -> list[list[int]]:
    """Anchors (rows as of ``anchors``) in collinear chains, the best chain first; each anchor is in one.

    A chain's score is its anchors' words less ``GAP_COST`` for each word that is left out on either side. The last
    k-mer of an anchor has to begin before the next one does, on both sides, by ``MOST_GAP`` words at most.
    """
    if len(found) == 1:
        return [[0]]
    rows = found.tolist()
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0], rows[k][1]))
    tail = [(b + n - KMER, a + n - KMER) for b, a, n in rows]
    keys = sorted({a for _, a in tail})
    tree, waiting, at = PrefixMax(len(keys)), sorted(range(len(rows)), key=lambda k: tail[k]), 0
    old = 0
    score, back = [0.0] * len(rows), [-1] * len(rows)
    for k in order:
        b, a, n = rows[k]
        while at < len(waiting) and tail[waiting[at]][0] < b:
            j = waiting[at]
            tree.put(bisect_left(keys, tail[j][1]), score[j] + GAP_COST * sum(tail[j]), j)
            at += 1
        best, j = tree.up_to(bisect_left(keys, a) - 1)
        best -= GAP_COST * (a + b)
        near = j >= 0 and max(b - tail[j][0], a - tail[j][1]) <= MOST_GAP
        while b - tail[waiting[old]][0] > MOST_GAP:
            old += 1
        if j >= 0 and not near:  # the best of those in reach
            own = [(score[i] - GAP_COST * (a + b - sum(tail[i])), i) for i in waiting[old:at] if 0 < a - tail[i][1] <= MOST_GAP]
            best, j = max(own, default=(0.0, -1))
            near = j >= 0
        score[k], back[k] = (n + best, j) if best > 0 and near else (n, -1)
    used, out = [False] * len(rows), []
    for k in sorted(range(len(rows)), key=lambda k: -score[k]):
        chain = []
        while k >= 0 and not used[k]:
            used[k] = True
            chain.append(k)
            k = back[k]
        if chain:
            out.append(chain[::-1])
    return out


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links sorted by (b, a) to chains: both ends in both documents and the anchors as int32 triples."""

    def done(b: np.ndarray, a: np.ndarray, pb: np.ndarray, pa_: np.ndarray) -> Iterator[pa.RecordBatch]:
        edges = np.append(np.flatnonzero(np.append(True, (b[1:] != b[:-1]) | (a[1:] != a[:-1]))), len(b)).tolist()
        out = []
        for lo, hi in zip(edges, edges[1:], strict=False):
            found = anchors(pb[lo:hi].astype(np.int64), pa_[lo:hi].astype(np.int64)) if hi - lo > 1 else np.array([[pb[lo], pa_[lo], KMER]], np.int64)
            for chain in chains(found):
                own = found[chain]
                out.append((b[lo], a[lo], own[0, 0], own[-1, 0] + own[-1, 2], own[0, 1], own[-1, 1] + own[-1, 2], own.astype("<i4").tobytes()))
        if out:
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["b", "a", "b0", "b1", "a0", "a1", "anchors"])

    held: list[np.ndarray] | None = None
    for batch in batches:
        if not len(batch):
            continue
        rows = [batch.column(k).to_numpy() for k in range(4)]
        if held is not None:
            rows = [np.concatenate(x) for x in zip(held, rows, strict=True)]
        same = np.flatnonzero((rows[0] != rows[0][-1]) | (rows[1] != rows[1][-1]))
        cut = int(same[-1]) + 1 if len(same) else 0
        if cut:
            yield from done(*[x[:cut] for x in rows])
        held = [x[cut:] for x in rows]
    if held is not None:
        yield from done(*held)


def _matches(x: np.ndarray, y: np.ndarray) -> tuple[list[int], list[int]]:
    """Positions in x and in y of a longest common subsequence. A row of its table is a number, whose bit j is 0 where the length grows with word j of y."""
    where: dict[int, int] = {}
    for j, w in enumerate(y.tolist()):
        where[w] = where.get(w, 0) | 1 << j
    rows = [(i, own) for i, w in enumerate(x.tolist()) if (own := where.get(w))]
    table = [row := (whole := (1 << len(y)) - 1)]
    for _, own in rows:
        row = (row + (row & own) | row & ~own) & whole
        table.append(row)
    left, i_out, j_out = whole, [], []
    for k in range(len(rows) - 1, -1, -1):
        i, own = rows[k]
        # the last equal word on the left is a partner if it is the last word there, or if the word of x makes the length grow
        if (own := own & left) and (own > left >> 1 or (table[k] & left).bit_count() > (table[k + 1] & left).bit_count()):
            j = own.bit_length() - 1
            i_out.append(i)
            j_out.append(j)
            left = (1 << j) - 1
    return i_out[::-1], j_out[::-1]


def align(x: np.ndarray, y: np.ndarray, found: np.ndarray) -> np.ndarray:
    """The position in y of each word's partner in x, or -1: equal words along the anchors, longest common subsequences
    in the gaps between them and in the words beside the chain."""
    partner = np.full(len(x), -1, np.int64)

    def between(i0: int, i1: int, j0: int, j1: int) -> None:
        if i1 > i0 and j1 > j0:
            i, j = _matches(x[i0:i1], y[j0:j1])
            if i:
                partner[i0:i1][i] = np.add(j, j0)

    i = j = None
    for b, a, n in found.tolist():
        if i is None:
            between(max(0, b - BESIDE), b, max(0, a - BESIDE), a)
        else:
            cut = max(0, i - b, j - a)
            b, a, n = b + cut, a + cut, n - cut
            between(i, b, j, a)
        same = x[b : b + n] == y[a : a + n]
        at = np.flatnonzero(same)
        partner[b + at] = a + at
        i, j = b + n, a + n
    between(i, i + BESIDE, j, j + BESIDE)
    return partner


def passages(partner: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(start, end, words with a partner) of the stretches with a similarity of 0.8 or more and ``least`` words.

    Each stretch that can't be made longer counts; of those that overlap the fewest that cover the same words stay. Ends of which
    less than two thirds have a partner are taken off as far as ``least`` words are left.
    """
    good = partner >= 0
    places = np.flatnonzero(good)
    if 5 * len(places) < 4 * least:
        return []
    known = np.concatenate(([0], np.cumsum(good)))
    score, ends = (known - m * (np.arange(len(known)) - known) for m in (MISS, END_MISS))
    # of each start the farthest end that keeps the score up: the last suffix maximum that isn't below it
    high = np.maximum.accumulate(score[::-1])[::-1]
    far = places[np.searchsorted(places + 1, np.searchsorted(-high, -score[places], side="right") - 1, side="right") - 1] + 1
    longest: list[tuple[int, int]] = []
    for s, e in zip(places.tolist(), far.tolist(), strict=True):
        if e - s >= least and (not longest or e > longest[-1][1]):
            if len(longest) > 1 and s <= longest[-2][1]:
                longest.pop()
            longest.append((s, e))

    def holds(s: int, e: int) -> bool:
        return e - s >= least and score[e] >= score[s]

    out: dict[tuple[int, int], None] = {}
    for s, e in longest:
        e = s + least + int(ends[s + least : e + 1].argmax())
        s = e - least - int(ends[s : e - least + 1][::-1].argmin())
        at = places[(places >= s) & (places < e)]
        for k in np.flatnonzero(np.diff(at) > LONG_MISS).tolist():
            if holds(s, int(at[k]) + 1) and holds(int(at[k + 1]), e):
                out[s, int(at[k]) + 1] = None
                s = int(at[k + 1])
        out[s, e] = None
    return [(s, e, int(known[e] - known[s])) for s, e in out]


def _hashes(blobs: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of slices, one after the other, and where each begins and the last one ends."""
    blobs = blobs.cast(pa.large_binary())
    edges = np.frombuffer(blobs.buffers()[1], np.int64)[blobs.offset : blobs.offset + len(blobs) + 1]
    data = blobs.buffers()[2]
    held = np.frombuffer(data, np.uint8)[edges[0] : edges[-1]].reshape(-1, HASH) if edges[-1] > edges[0] else np.zeros((0, HASH), np.uint8)
    out = np.zeros((len(held), 8), np.uint8)
    out[:, :HASH] = held
    return out.view("<u8")[:, 0], (edges - edges[0]) // HASH


def _equal_words(x: np.ndarray, x_edges: np.ndarray, y: np.ndarray, y_edges: np.ndarray) -> np.ndarray:
    """How many words of each slice in x have an equal in the slice of that number in y. Less than 2 ** 24 slices are told apart by the bits above a hash's."""
    number = np.arange(len(x_edges) - 1, dtype=np.uint64) << np.uint64(8 * HASH)
    x = x | np.repeat(number, np.diff(x_edges))
    y = np.sort(y | np.repeat(number, np.diff(y_edges)))
    if not len(y):
        return np.zeros(len(number), np.int64)
    known = np.append(0, np.cumsum(y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x))
    return known[x_edges[1:]] - known[x_edges[:-1]]


def _slices(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Word hashes of each (``doc``, ``lo``, ``hi``) in ``wanted``; a document's text is split once."""
    grouped = wanted.groupBy("doc").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in text_blocks(batch.column(1)):
                words, counts = block_hashes(texts)
                held = np.ascontiguousarray(words.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8)[:, :HASH]).tobytes()
                spans = batch.column(2).slice(first, len(texts))
                many = spans.value_lengths().to_numpy()
                lo, hi = (spans.flatten().field(c).to_numpy() for c in ("lo", "hi"))
                begin, count = (np.repeat(v, many) for v in (np.cumsum(counts) - counts, counts))
                cut = [held[s:e] for s, e in zip(*[(HASH * (begin + np.minimum(v, count))).tolist() for v in (lo, hi)], strict=True)]
                doc = np.repeat(batch.column(0).slice(first, len(texts)).to_numpy(), many)
                yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(lo), pa.array(hi), pa.array(cut, pa.binary())], names=["doc", "lo", "hi", "words"])

    own = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text")).join(grouped.hint("merge"), "doc")
    return own.select("doc", "text", "spans").mapInArrow(run, "doc long, lo int, hi int, words binary")


def shared_passages(docs: DataFrame, least: int = 45, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stretches of ``least`` words or more that are found in a document with a smaller id too, word for word or with a
    similarity of 0.8 or more.

    Columns: ``id_col``, ``start`` and ``n_words`` (place in the document, in words), ``other_id``, ``other_start``,
    ``other_words``, ``n_equal`` (words with an equal partner in the alignment). Words are lower-case A-Z and end at
    ASCII white space. A stretch is compared with the first document, by id, that holds each of its seeds, whatever the
    table's layout; seeds are short and longer stretches, so phrases that stand elsewhere before don't hide a text with the whole. A passage that
    thousands share gives a row or a few for each of them but the first, not for each pair. Null and short texts, and
    rows without an id, give no rows; repeated rows and rows with one id are not compared with each other; other
    columns are not read. Ids tell texts apart: where rows with one id have different texts, a place may be that of
    any of them.
    """
    spark = docs.sparkSession
    parts = partitions(spark)
    found = materialize(_postings(docs, id_col, text_col), "seeds")
    order = Window.partitionBy("kmer").orderBy("b", "pb")
    # of each seed the first holder in the table (fb, its places fp and fm); both uses read the same columns, so the seeds move once
    heads = found.where("nth is null and kmer is not null").select("kmer", "b", "pb", "more")
    heads = heads.select("*", *[F.first(c).over(order).alias(f) for c, f in (("b", "fb"), ("pb", "fp"), ("more", "fm"))], F.lead("b").over(order).alias("later"), F.row_number().over(order).alias("place"))
    first = heads.where("place = 1 and (fp % 2 = 1 or later is not null)").select("kmer", "fb", F.expr("fp div 2").cast("int").alias("fp"), "fm")
    across = heads.where("place > 1").select("b", "fb", F.expr("fp div 2").cast("int").alias("fp"), "fm", F.posexplode(F.concat(F.array(F.expr("pb div 2").cast("int")), "more")).alias("n", "pb"))
    others = found.where("nth is not null").select("kmer", "b", F.col("nth").alias("n"), "pb").join(first, "kmer").select("b", "fb", "fp", "fm", "n", "pb")
    nth = F.expr("if(n = 0 or size(fm) = 0, fp, element_at(fm, least(n, size(fm))))")
    links = across.unionByName(others).where("fb < b").select("b", F.col("fb").alias("a"), "pb", nth.alias("pa"))
    chained = links.repartition(parts, "b", "a").sortWithinPartitions("b", "a", "pb", "pa").mapInArrow(_chained, "b long, a long, b0 int, b1 int, a0 int, a1 int, anchors binary")
    for c in ("b", "a"):
        # most chains are a single seed: those have slices of their own, as short as can be
        grid = F.when(F.col("b1") - F.col("b0") > KMER, GRID).otherwise(1)
        lo = F.greatest(F.floor((F.col(f"{c}0") - BESIDE) / grid) * grid, F.lit(0))
        chained = chained.withColumns({f"{c}_lo": lo.cast("int"), f"{c}_hi": (F.ceil((F.col(f"{c}1") + BESIDE) / grid) * grid).cast("int")})
    # what a chain and the words beside it cover has to hold a passage
    chained = materialize(chained.where((F.col("b1") - F.col("b0") + 2 * BESIDE >= least) & (F.col("a1") - F.col("a0") + 2 * BESIDE >= least)), "chains")
    drop(found)
    spans = [chained.select(F.col(c).alias("doc"), F.col(f"{c}_lo").alias("lo"), F.col(f"{c}_hi").alias("hi")) for c in ("b", "a")]
    settle(spark)
    slices = materialize(_slices(docs, spans[0].unionByName(spans[1]).distinct(), id_col, text_col), "slices")
    pairs = chained
    for c in ("b", "a"):
        own = slices.select(F.col("doc").alias(c), F.col("lo").alias(f"{c}_lo"), F.col("hi").alias(f"{c}_hi"), F.col("words").alias(f"{c}_words"))
        pairs = pairs.join(own.hint("merge"), [c, f"{c}_lo", f"{c}_hi"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            out = []
            # slices of about PAIR_WORDS words together
            size = np.cumsum(sum(pc.binary_length(batch.column(k)).to_numpy() // HASH for k in (5, 6)) + 1)
            cuts = np.append(np.flatnonzero(np.append(True, np.diff(size // PAIR_WORDS) > 0)), batch.num_rows).tolist()
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                part = batch.slice(lo, hi - lo)
                (x, x_at), (y, y_at) = _hashes(part.column(5)), _hashes(part.column(6))
                enough = 5 * np.minimum(_equal_words(x, x_at, y, y_at), np.diff(y_at)) >= 4 * least  # where fewer words have an equal than a passage needs there is none
                own = part.filter(pa.array(enough))
                at = zip(*[v[k][enough].tolist() for v in (x_at, y_at) for k in (slice(None, -1), slice(1, None))], strict=True)
                for b, a, b_lo, a_lo, blob, (x0, x1, y0, y1) in zip(*[own.column(k).to_pylist() for k in range(5)], at, strict=True):
                    partner = align(x[x0:x1], y[y0:y1], np.frombuffer(blob, "<i4").reshape(-1, 3).astype(np.int64) - np.array([b_lo, a_lo, 0]))
                    for s, e, n in passages(partner, least):
                        there = partner[s:e][partner[s:e] >= 0]
                        out.append((b, s + b_lo, e - s, a, int(there[0]) + a_lo, int(there[-1] - there[0]) + 1, n))
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
            columns = list(zip(*out, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], names=["id", "start", "n_words", "other_id", "other_start", "other_words", "n_equal"])

    out = pairs.select("b", "a", "b_lo", "a_lo", "anchors", "b_words", "a_words").mapInArrow(run, "id long, start int, n_words int, other_id long, other_start int, other_words int, n_equal int")
    kind = docs.schema[id_col].dataType
    return out.distinct().select(F.col("id").cast(kind).alias(id_col), "start", "n_words", F.col("other_id").cast(kind).alias("other_id"), "other_start", "other_words", "n_equal")


def without_passages(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the words in ``spans`` (``id_col``, ``start``, ``n_words``), and without documents that have no word left because of it.

    What stands between the words that stay is kept as it is. Documents without spans, null texts and rows without an
    id stay as they are; other columns stay.
    """
    own = free_name(docs, "ranges")
    ranges = spans.groupBy(id_col).agg(F.sort_array(F.collect_set(F.struct("start", (F.col("start") + F.col("n_words")).alias("end")))).alias(own))
    joined = docs.join(ranges, id_col, "left")

    @F.pandas_udf("string")
    def cut(texts, ranges):
        import pandas as pd

        out = []
        for text, own in zip(texts, ranges, strict=True):
            at = word_places(text)
            kept, last = [], 0
            for r in own:
                s, e = int(r["start"]), min(int(r["end"]), len(at))
                if s < e and at[e - 1][1] > last:
                    kept.append(text[last : max(last, at[s][0])])
                    last = at[e - 1][1]
            kept.append(text[last:])
            out.append("".join(kept))
        return pd.Series(out)

    touched = joined.where(f"`{own}` is not null and `{text_col}` is not null").withColumn(text_col, cut(text_col, own))
    touched = touched.where(F.trim(F.translate(text_col, "\t\n\x0b\f\r", "     ")) != "")
    plain = joined.where(f"`{own}` is null or `{text_col}` is null")
    return touched.select(*docs.columns).unionByName(plain.select(*docs.columns))


def word_places(text: str) -> list[tuple[int, int]]:
    """Start and end, in characters, of each word."""
    import re

    return [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
