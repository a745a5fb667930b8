"""Packing of documents into sequences with minimum bin slack: each window takes those remaining lengths that fill it best."""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .bpe import blocks
from .packing import tokenizer_ids

#: Tokens that a task packs together.
BLOCK_TOKENS = 1 << 22
FIELDS = "start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def closest_fill(lengths: list[int], counts: dict[int, int], target: int) -> dict[int, int]:
    """How many of each of ``lengths`` (ascending, at most ``counts``) have the largest sum that doesn't exceed ``target``.

    Bit s of the set of sums says that s can be had; a length with a count goes in by powers of two, and the walk back through the
    sets that stood before each step says what was taken. Long lengths come first, so short ones are left for later windows.
    """
    sums, mask, steps = 1, (1 << target + 1) - 1, []
    for k in range(bisect_right(lengths, target) - 1, -1, -1):
        length = lengths[k]
        left, many = min(counts[length], target // length), 1
        while left:
            many = min(many, left)
            steps.append((length, many, sums))
            sums |= (sums << length * many) & mask
            left, many = left - many, 2 * many
        if sums >> target & 1:
            break
    at, taken = sums.bit_length() - 1, {}
    for length, many, before in reversed(steps):
        if not before >> at & 1:
            taken[length] = taken.get(length, 0) + many
            at -= length * many
    return taken


class Slack:
    """Pieces that are not placed yet, by their lengths. A piece is (document, its tokens, start, ids)."""

    def __init__(self, capacity: int):
        self.capacity, self.total = capacity, 0
        self.lengths: list[int] = []
        self.counts: dict[int, int] = {}
        self.pieces: dict[int, list[tuple]] = {}

    def add(self, piece: tuple) -> None:
        length = len(piece[3]) // 4
        if length not in self.pieces:
            insort(self.lengths, length)
            self.pieces[length], self.counts[length] = [], 0
        self.pieces[length].append(piece)
        self.counts[length] += 1
        self.total += length

    def take(self, length: int) -> tuple:
        piece = self.pieces[length].pop()
        self.counts[length] -= 1
        self.total -= length
        if not self.counts[length]:
            del self.pieces[length], self.counts[length]
            del self.lengths[bisect_left(self.lengths, length)]
        return piece

    def window(self, size: int) -> Iterator[list[tuple]]:
        """Windows of exactly ``size`` tokens, one for each time that the best fill can be had. The longest piece that
        fits is in it; what no fill reaches comes from the shortest longer piece, which is cut."""
        fits = bisect_right(self.lengths, size)
        seed = self.lengths[fits - 1] if fits else 0
        taken = {}
        if seed:
            self.counts[seed] -= 1
            taken = closest_fill(self.lengths, self.counts, size - seed)
            self.counts[seed] += 1
            taken[seed] = taken.get(seed, 0) + 1
        slack = size - sum(k * n for k, n in taken.items())
        for _ in range(1 if slack else min(self.counts[k] // n for k, n in taken.items())):
            out = [self.take(k) for k, n in taken.items() for _ in range(n)]
            if slack:
                doc, tokens, start, ids = self.take(self.lengths[bisect_right(self.lengths, slack)])
                out.append((doc, tokens, start, ids[: 4 * slack]))
                self.add((doc, tokens, start + slack, ids[4 * slack :]))
            yield out

    def windows(self, last: bool) -> Iterator[list[tuple]]:
        """Full windows while there are tokens for one; with ``last`` also the rest, in sequences whose lengths are powers of two."""
        while self.total >= self.capacity:
            yield from self.window(self.capacity)
        while last and self.total:
            size = 1 << self.total.bit_length() - 1
            yield next(self.window(size))


def pack_min_slack(docs: DataFrame, tokenizer_path: str, pattern: str, capacity: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack every document into sequences of ``capacity`` tokens without padding.

    A document is its ids, as the ``tokenizers`` library gives them without adding special tokens, and then ``end_id``; a null text has
    that token alone. One longer than ``capacity`` is cut into full pieces and a rest. Each window takes the multiset of remaining lengths
    that comes closest to its capacity, found by subset sums in a bitset; a document is cut where no multiset fills the window. The last
    tokens of a task, fewer than ``capacity``, become sequences whose lengths are powers of two, which need no padding either.

    A row for each piece: ``id_col``, ``start``, ``length``, ``doc_tokens``, ``sequence_id``, ``offset`` and ``ids`` (little-endian
    32-bit). Each task packs what it reads, by blocks of ``BLOCK_TOKENS`` whose rest goes on into the next, so nothing is
    shuffled, no plan passes the driver, and a task that is run again gives the same pieces. Repeated rows are packed as often as they come; null ids
    stay; an empty table gives no rows; other columns are not read.
    """
    if capacity & capacity - 1:
        raise ValueError("the capacity must be a power of two")
    kind = docs.schema[id_col].dataType.simpleString()
    names = [id_col, *(f.split()[0] for f in FIELDS.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end, sequence = end_id.to_bytes(4, "little"), TaskContext.get().partitionId() << 40
        waiting, id_type = Slack(capacity), None

        def packed(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal sequence
            rows = []
            for window in waiting.windows(last):
                offset = 0
                for doc, tokens, start, ids in window:
                    rows.append((doc, start, len(ids) // 4, tokens, sequence, offset, ids))
                    offset += len(ids) // 4
                sequence += 1
            for k in range(0, len(rows), 1 << 16):
                types = (id_type, *[pa.int64()] * 5, pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows[k : k + (1 << 16)], strict=True), types, strict=True)], names=names)

        for batch in batches:
            id_type, k = batch.column(0).type, -1
            for block in blocks(batch.column(1)):
                keys = batch.column(0).slice(k + 1, len(block)).to_pylist()
                k += len(block)
                for key, ids in zip(keys, tokenizer_ids(tokenizer_path, pattern)(block), strict=True):
                    ids += end
                    tokens, step = len(ids) // 4, 4 * capacity
                    for at in range(0, len(ids), step):
                        waiting.add((key, tokens, at // 4, ids[at : at + step]))
                    if waiting.total >= BLOCK_TOKENS:
                        yield from packed(last=False)
        if waiting.total:
            yield from packed(last=True)

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, {FIELDS}")
