"""Byte-level BPE with a hierarchical-bitmap rank queue, and a cached walk over whole texts."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator
from itertools import filterfalse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, worker_cache

#: Pair keys are left << SHIFT | right.
SHIFT = 20
#: Pieces that a worker's cache holds before those not met again are dropped.
CACHE_PIECES = 400_000
#: Characters of text that are looked up together.
BLOCK_CHARS = 8_000_000
#: Marks that are one pretoken after a word's last letter, up to the next white space; an apostrophe may begin one of letters.
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


class RankQueue:
    """Set of merge ranks as three levels of 64-bit words; ``pop`` finds the lowest by find-first-set."""

    def __init__(self, size: int):
        self.low = [0] * ((size >> 6) + 1)
        self.mid = [0] * ((size >> 12) + 1)
        self.top = 0
        self.buckets: dict[int, list[np.ndarray]] = {}

    def push(self, rank: int, positions: np.ndarray) -> None:
        held = self.buckets.get(rank)
        if held is not None:
            held.append(positions)
            return
        self.buckets[rank] = [positions]
        self.low[rank >> 6] |= 1 << (rank & 63)
        self.mid[rank >> 12] |= 1 << (rank >> 6 & 63)
        self.top |= 1 << (rank >> 12)

    def pop(self) -> tuple[int, np.ndarray] | None:
        if not self.top:
            return None
        a = (self.top & -self.top).bit_length() - 1
        word = self.mid[a]
        b = a << 6 | (word & -word).bit_length() - 1
        word = self.low[b]
        rank = b << 6 | (word & -word).bit_length() - 1
        word &= word - 1
        self.low[b] = word
        if not word:
            self.mid[a] &= self.mid[a] - 1
            if not self.mid[a]:
                self.top &= self.top - 1
        held = self.buckets.pop(rank)
        return rank, held[0] if len(held) == 1 else np.concatenate(held)


class ByteBPE:
    """Encoder and decoder for a file of ranks (base64 bytes and rank a line)."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        size = max(ranks.values()) + 1
        self.vocab: list[bytes] = [b""] * size
        for token, rank in ranks.items():
            self.vocab[rank] = token
        self.decimal = [str(i) for i in range(size)]
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        keys, merged = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    keys.append(left << SHIFT | right)
                    merged.append(rank)
        order = np.argsort(np.array(keys, np.int64), kind="stable")
        self.pair_keys = np.append(np.array(keys, np.int64)[order], np.iinfo(np.int64).max)
        self.pair_rank = np.append(np.array(merged, np.int64)[order], -1)
        self.queue = RankQueue(size)

    @classmethod
    def load(cls, path: str) -> ByteBPE:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << SHIFT | right
        at = np.searchsorted(self.pair_keys, key)
        return np.where(self.pair_keys[at] == key, self.pair_rank[at], -1)

    def _push(self, ranks: np.ndarray, positions: np.ndarray) -> None:
        order = np.argsort(ranks, kind="stable")
        ranks, positions = ranks[order], positions[order]
        cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
        begin = 0
        firsts = ranks[np.append(0, cuts)].tolist()
        for rank, end in zip(firsts, [*cuts.tolist(), len(ranks)], strict=True):
            self.queue.push(rank, positions[begin:end])
            begin = end

    def encode(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece (a pre-token) as little-endian uint32. All pieces share one linked list; no pair crosses from piece to piece.

        The queue yields the lowest rank; its bucket holds the positions at which that pair was seen. Those whose pair
        has changed meanwhile are stale and skipped; of overlapping ones (``aaa``) the left one merges.
        """
        sizes = np.array([len(p) for p in pieces], np.int64)
        data = np.frombuffer(b"".join(pieces), np.uint8)
        n = len(data)
        if not n:
            return [b""] * len(pieces)
        tok = np.append(self.byte_id[data], 0)
        owner = np.append(np.repeat(np.arange(len(pieces)), sizes), -1)
        after = np.append(np.arange(1, n + 1), n)
        before = np.append(np.arange(-1, n - 1), n - 1)
        rank_at = np.full(n + 1, -1, np.int64)  # -1: no merge here; -2: merged into its left neighbour
        inner = np.flatnonzero(owner[:-1] == owner[1:])
        found = self._pairs(tok[inner], tok[inner + 1])
        rank_at[inner] = found
        if (found >= 0).any():
            self._push(found[found >= 0], inner[found >= 0])
        while (popped := self.queue.pop()) is not None:
            rank, at = popped
            at = at[rank_at[at] == rank]
            if not len(at):
                continue
            if len(at) > 1:
                at.sort()
                at = at[np.append(True, at[1:] != at[:-1])]
                touching = after[at[:-1]] == at[1:]
                if touching.any():
                    index = np.arange(len(at))
                    first = np.maximum.accumulate(np.where(np.append(True, ~touching), index, 0))
                    at = at[(index - first) & 1 == 0]
            gone = after[at]
            following = after[gone]
            tok[at] = rank
            after[at] = following
            before[following] = at
            rank_at[gone] = -2
            previous = before[at]
            previous = previous[previous >= 0]
            look = np.concatenate((at, previous[owner[previous] == owner[after[previous]]]))
            right = after[look]
            new = self._pairs(tok[look], tok[right])
            new[owner[look] != owner[right]] = -1
            rank_at[look] = new
            good = new >= 0
            if good.any():
                self._push(new[good], look[good])
        alive = np.flatnonzero(rank_at[:n] != -2)
        counts = np.bincount(owner[alive], minlength=len(pieces))
        ids, ends = tok[alive].astype("<u4").tobytes(), np.cumsum(counts * 4).tolist()
        return [ids[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def decode(self, ids: list[int]) -> bytes:
        vocab = self.vocab
        return b"".join([vocab[i] for i in ids])


def mark_text(text: str) -> str | None:
    """A text whose pieces are parted by single spaces, each standing after a space there, but for the first, which is marked by ``\\0``,
    and those that begin with a line end. None if the text has more white space in one place."""
    if "  " in text or " \n" in text or "\n " in text or "\n\n" in text or "\0" in text:
        return None
    return "\0" + text.replace("\n", " \n")


def piece_text(piece: str) -> str | None:
    """What stands in the text for a piece of ``mark_text``; None if white space at one of its ends may join what is beside it."""
    body = piece[1:] if piece[:1] in ("\n", "\0") else piece
    if body and (body[0].isspace() or body[-1].isspace()):
        return None
    return body if piece[:1] == "\0" else piece if piece[:1] == "\n" else " " + piece


class TextEncoder:
    """Whole texts to ids (bytes of little-endian uint32), with a bounded cache of pieces in two generations.

    A text is cut where a single space or line end stands between two other characters: there the pre-token pattern
    always starts a new match, so each piece can be encoded, and kept, by itself. Texts with other white space next
    to such a place are cut by the pattern alone.
    """

    def __init__(self, pattern: str, encode_pretokens: Callable[[list[str]], list[bytes]], limit: int = CACHE_PIECES):
        import regex

        self.pattern = regex.compile(pattern)
        self.encode_pretokens = encode_pretokens
        self.limit = limit
        self.pieces: dict[str, bytes | None] = {}
        self.pretokens: dict[str, bytes] = {}
        #: pieces and pretokens of the time before; those that are met again move over
        self.before: tuple[dict[str, bytes | None], dict[str, bytes]] = ({}, {})

    def _fill(self, found: list[str]) -> None:
        """Add the pretokens that aren't there yet, encoded together."""
        new, pieces, before = [], self.pieces, self.before[1]
        for p in set(found).difference(self.pretokens):
            ids = pieces.get(p[1:]) if p[0] == " " and p[1:].isalpha() else None
            ids = before.get(p) if ids is None else ids
            if ids is None:
                new.append(p)
            else:
                self.pretokens[p] = ids
        self.pretokens.update(zip(new, self.encode_pretokens(new), strict=True))

    def _add(self, missing: set[str]) -> None:
        """Add pieces. A word of letters alone is one pretoken, and so are the marks that follow it in others; the rest are matched in one text, where
        a pretoken that begins with a space begins a piece."""
        pieces, before, findall = self.pieces, self.before[0], self.pattern.findall
        words, marked, rest = [], [], []
        for p in missing:
            if p.isalpha():
                words.append(p)
            elif (word := p.rstrip(MARKS)).isalpha():
                marked.append((p, word))
            else:
                rest.append(p)
        new = {w for _, w in marked if w not in pieces}.difference(words)
        again = new.intersection(before)
        pieces.update({w: before[w] for w in again})
        words += new.difference(again)
        pieces.update(zip(words, self.encode_pretokens([" " + p for p in words]), strict=True))
        spaced, found = [], []
        for p in rest:
            body = piece_text(p)
            if body is None:
                pieces[p] = None
            elif p and body[:1] == " ":
                spaced.append(p)
            else:
                found.append((p, findall(body)))
        all_ = findall(" " + " ".join(spaced)) if spaced else []
        starts = [k for k, p in enumerate(all_) if p[0] == " "]
        if len(starts) == len(spaced):
            found += [(p, all_[a:b]) for p, a, b in zip(spaced, starts, [*starts[1:], len(all_)], strict=False)]
        else:
            found += [(p, findall(" " + p)) for p in spaced]
        self._fill([*{p[len(w) :] for p, w in marked}, *(x for _, own in found for x in own)])
        get = self.pretokens.__getitem__
        for p, own in found:
            pieces[p] = b"".join(map(get, own))
        for p, word in marked:
            pieces[p] = pieces[word] + get(p[len(word) :])

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.pieces) + len(self.pretokens) > self.limit:
            self.before, self.pieces, self.pretokens = (self.pieces, self.pretokens), {}, {}
        pieces = self.pieces
        marked = [mark_text(t) for t in texts]
        cut = [k for k, t in enumerate(marked) if t is not None]
        out: list[bytes | None] = [None] * len(texts)
        if cut:
            whole = [t for t in marked if t is not None]
            ends = np.cumsum([t.count(" ") + 1 for t in whole])
            coded = pc.split_pattern(pa.array([" ".join(whole)], pa.large_string()), " ").flatten().dictionary_encode()
            names = pc.binary_join(pa.ListArray.from_arrays([0, len(coded.dictionary)], coded.dictionary), pa.scalar(" ", pa.large_string()))[0].as_py().split(" ")
            missing = set(filterfalse(pieces.__contains__, names))
            again = missing.intersection(self.before[0])
            pieces.update({p: self.before[0][p] for p in again})
            self._add(missing.difference(again))
            ids = pa.array(map(pieces.__getitem__, names), pa.large_binary()).take(coded.indices)
            _, offsets, data = ids.buffers()
            begins = ends - np.diff(ends, prepend=0)
            bounds = np.frombuffer(offsets, np.int64)[np.append(0, ends)].tolist()
            # a null piece's white space joins its neighbour's
            joined = np.logical_or.reduceat(ids.is_null().to_numpy(zero_copy_only=False), begins).tolist() if ids.null_count else [False] * len(cut)
            raw = data.to_pybytes() if data else b""
            for k, a, b, j in zip(cut, bounds, bounds[1:], joined, strict=False):
                if not j:
                    out[k] = raw[a:b]
        slow = [k for k, x in enumerate(out) if x is None]
        if slow:
            found = [self.pattern.findall(texts[k]) for k in slow]
            self._fill([x for own in found for x in own])
            get = self.pretokens.__getitem__
            for k, own in zip(slow, found, strict=True):
                out[k] = b"".join(map(get, own))
        return out


def blocks(column: pa.Array, most: int = BLOCK_CHARS) -> Iterator[list[str]]:
    """Consecutive texts of about ``most`` characters together; null counts as empty. Only a block's texts are Python objects at a time."""
    held, size = [], 0
    for k in range(0, len(column), 64):
        for text in column.slice(k, 64).to_pylist():
            held.append(text or "")
            size += len(held[-1])
            if size >= most:
                yield held
                held, size = [], 0
    if held:
        yield held
    del held
    give_back()


def loaded(path: str, pattern: str) -> tuple[ByteBPE, TextEncoder]:
    """One encoder for each worker process."""

    def make() -> tuple[ByteBPE, TextEncoder]:
        bpe = ByteBPE.load(path)
        return bpe, TextEncoder(pattern, lambda new: bpe.encode([p.encode("utf-8") for p in new]))

    return worker_cache(("bpe", path, pattern), make, collect=False)  # nothing here is cyclic; walks over the large caches cost more than the work


def bpe_round_trip(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text and decode the ids again.

    Columns: ``id_col``, ``ids`` (array of int), ``decoded`` (binary). A null text counts as empty: no ids. One row for
    each row of ``docs``, in any order; repeated rows stay repeated, other columns are not read. The work is a map
    without a shuffle, so no key or source can pile up in a task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, encoder = loaded(ranks_path, pattern)
        for batch in batches:
            keys = batch.column(0)
            begin = 0
            for block in blocks(batch.column(1)):
                ids = [np.frombuffer(x, "<u4").astype(np.int32) for x in encoder.encode(block)]
                decoded = [bpe.decode(x.tolist()) for x in ids]
                offsets = np.append(0, np.cumsum([len(x) for x in ids])).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [keys.slice(begin, len(block)), pa.ListArray.from_arrays(offsets, np.concatenate(ids)), pa.array(decoded, pa.binary())],
                    names=[id_col, "ids", "decoded"],
                )
                begin += len(block)

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>, decoded binary")


def bpe_digests(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As ``bpe_round_trip``, with the digests of ids and decoded bytes made in the same task instead of the values.

    Columns: ``id_col``, ``n_tokens``, ``ids_sha256`` (of decimal ids joined by a space), ``decoded_sha256``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, encoder = loaded(ranks_path, pattern)
        decimal = bpe.decimal
        for batch in batches:
            keys = batch.column(0)
            counts, coded, decoded = [], [], []
            for block in blocks(batch.column(1)):
                for x in encoder.encode(block):
                    ids = np.frombuffer(x, "<u4").tolist()
                    counts.append(len(ids))
                    coded.append(hashlib.sha256(" ".join([decimal[i] for i in ids]).encode()).hexdigest())
                    decoded.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([keys, pa.array(counts, pa.int64()), pa.array(coded, pa.string()), pa.array(decoded, pa.string())], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
