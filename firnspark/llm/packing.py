"""Best-fit decreasing packing of documents into sequences of a fixed number of tokens."""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import TextEncoder, blocks
from .common import materialize, worker_cache

PIECES = "piece int, start long, length long, ids_crc32 long, part int, nth long"


class TokenizerIds:
    """Ids of whole texts by a ``tokenizers`` file: pre-tokens go to its model, and a text that holds one of the file's
    added tokens goes to the library whole, which gives such a string its id wherever it stands."""

    def __init__(self, path: str, pattern: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenize = self.tokenizer.model.tokenize
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # the byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in set(plain)]
        self.alphabet = np.arange(256, dtype="<u2")
        self.alphabet[others] = np.arange(256, 256 + len(others))
        self.texts = TextEncoder(pattern, self.pretokens)

    def shown(self, pretokens: list[str]) -> list[str]:
        """Pretokens in the byte-level alphabet. No text has a byte of 255, which stands for itself, so it parts them."""
        joined = b"\xff".join([p.encode("utf-8") for p in pretokens])
        return self.alphabet[np.frombuffer(joined, np.uint8)].tobytes().decode("utf-16-le").split("\xff") if pretokens else []

    def pretokens(self, new: list[str]) -> list[bytes]:
        tokenize = self.tokenize
        return [array("I", [t.id for t in tokenize(p)]).tobytes() for p in self.shown(new)]

    def encode(self, texts: list[str]) -> list[bytes]:
        whole = [k for k, t in enumerate(texts) if any(a in t for a in self.added)]
        out = self.texts.encode(["" if k in set(whole) else t for k, t in enumerate(texts)] if whole else texts)
        for k in whole:
            out[k] = array("I", self.tokenizer.encode(texts[k], add_special_tokens=False).ids).tobytes()
        return out


def tokenizer_ids(path: str, pattern: str) -> Callable[[list[str]], list[bytes]]:
    """Encoder (texts to little-endian uint32 ids) of one worker process, with no special tokens added to a text."""
    # nothing here is cyclic; walks over the large caches cost more than the work
    return worker_cache(("tokenizer", path, pattern), lambda: TokenizerIds(path, pattern), collect=False).encode


class CapacityTree:
    """Segment tree over remaining capacities; a leaf counts the open groups of bins that have that much room."""

    def __init__(self, capacity: int):
        self.size = 1 << (capacity + 1 - 1).bit_length()
        if self.size < capacity + 1:
            self.size *= 2
        self.count = [0] * (2 * self.size)

    def add(self, room: int, by: int) -> None:
        at = room + self.size
        while at:
            self.count[at] += by
            at >>= 1

    def tightest(self, need: int) -> int | None:
        """The smallest room of at least ``need``, or None."""
        count, at = self.count, need + self.size
        if count[at]:
            return need
        while at > 1:
            if not at & 1 and count[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at if count[2 * at] else 2 * at + 1
                return at - self.size
            at >>= 1
        return None


def best_fit_plan(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Best-fit decreasing over how many pieces have each length.

    Rows (length, first, copies, sequence, offset, bins): of the pieces of this length, numbered from 0, those from
    ``first`` on go ``copies`` to each of ``bins`` sequences from ``sequence`` on, at ``offset`` and further. Bins that
    are filled alike are kept as one group, so the plan's size depends on the number of lengths, not of pieces, and
    each step finds the tightest group by the tree as best fit would for a single piece. Also returns the number of
    sequences.
    """
    tree = CapacityTree(capacity)
    open_: dict[int, list[tuple[int, int]]] = {}
    rows, bins = [], 0

    def put(room: int, sequence: int, many: int) -> None:
        if room and many:
            open_.setdefault(room, []).append((sequence, many))
            tree.add(room, 1)

    for length in sorted(histogram, reverse=True):
        left, first = histogram[length], 0
        while left:
            room = tree.tightest(length)
            if room is None:
                room = capacity
                sequence, many = bins, -(-left // (capacity // length))
                bins += many
            else:
                sequence, many = open_[room].pop()
                tree.add(room, -1)
            copies = room // length
            full = min(many, left // copies)
            if full:
                rows.append((length, first, copies, sequence, capacity - room, full))
                put(room - copies * length, sequence, full)
                first, left = first + full * copies, left - full * copies
            if left and full < many:  # fewer are left than fit into one more bin
                rows.append((length, first, left, sequence + full, capacity - room, 1))
                put(room - left * length, sequence + full, 1)
                first, left, full = first + left, 0, full + 1
            put(room, sequence + full, many - full)
    return rows, bins


def token_pieces(docs: DataFrame, encoder: Callable[[], Callable[[list[str]], list[bytes]]], capacity: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """One row for each piece of a document, with its number among those of the same length in its task (``part``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end, part = end_id.to_bytes(4, "little"), TaskContext.get().partitionId()
        seen = [0] * (capacity + 1)
        for batch in batches:
            keys, rows, k = [], [], -1
            for block in blocks(batch.column(1)):
                for ids in encoder()(block):
                    k += 1
                    ids += end
                    total, start, piece = len(ids) // 4, 0, 0
                    while start < total:
                        length = (total - start) % capacity or capacity
                        keys.append(k)
                        rows.append((piece, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), part, seen[length]))
                        seen[length] += 1
                        start, piece = start + length, piece + 1
            if rows:
                columns = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keys)), *columns], names=[id_col, "piece", "start", "length", "ids_crc32", "part", "nth"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, {PIECES}")


def pack_best_fit(docs: DataFrame, tokenizer_path: str, pattern: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack every document into sequences of at most ``capacity`` tokens.

    A document is its ids, as the ``tokenizers`` library gives them without adding special tokens (strings of the file's added
    tokens become their ids), and then ``end_id``; a null text counts as empty, so it has the one token. Only documents
    longer than ``capacity`` are cut, the first piece being the one that may be shorter. Columns: ``id_col``, ``piece``,
    ``start``, ``length``, ``ids_crc32``, ``sequence_id``, ``offset``. Repeated rows are packed as often as they come;
    an empty table gives no rows; other columns are not read.

    The pieces are written once with their place among those of equal length in their task. A count by task and length
    makes that a place among all; the histogram of lengths (at most ``capacity`` rows) is all that the driver sees, and
    best-fit decreasing over it gives a plan of a few thousand rows, by which each task places its own pieces.
    """
    spark = docs.sparkSession
    pieces = materialize(token_pieces(docs, lambda: tokenizer_ids(tokenizer_path, pattern), capacity, end_id, id_col, text_col), "pieces")
    counts = pieces.groupBy("length", "part").agg((F.max("nth") + 1).alias("many"))
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("many").alias("n")).collect()}
    plan, _ = best_fit_plan(histogram, capacity)
    table = spark.sparkContext.broadcast(np.array(sorted(plan), np.int64).reshape(-1, 6))
    before = counts.withColumn("before", F.sum("many").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    placed = pieces.join(before.select("length", "part", F.coalesce("before", F.lit(0)).alias("before")), ["length", "part"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = table.value
        key = rows[:, 0] << 44 | rows[:, 1]
        for batch in batches:
            length, nth = (batch.column(k).to_numpy() for k in (3, 5))
            x = rows[np.searchsorted(key, length << 44 | nth, side="right") - 1]
            more = nth - x[:, 1]
            sequence, offset = x[:, 3] + more // x[:, 2], x[:, 4] + more % x[:, 2] * length
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    names = [id_col, "piece", "start", "length", "ids_crc32"]
    kind = docs.schema[id_col].dataType.simpleString()
    return placed.select(*names, (F.col("nth") + F.col("before")).alias("nth")).mapInArrow(place, f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
