"""Words of texts as 64-bit hashes, for batches inside tasks.

A word is a run of characters other than ASCII white space, with A-Z in lower case: what ``bytes.lower`` and
``bytes.split`` make of the UTF-8 text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .common import give_back, worker_cache

#: Words that a worker keeps the hashes of before it starts anew.
CACHE_WORDS = 250_000
#: Bytes of text that are worked on together.
BLOCK_BYTES = 4_000_000
#: Constants of xxh64; from so many bytes on it takes another course.
P1, P2, P3, P4, P5 = map(np.uint64, (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
STRIPE = 32
#: 1 for the bytes of words, 0 for white space.
IN_WORD = bytes(b not in b" \t\n\x0b\f\r" for b in range(256))


class WordHashes(dict):
    """64-bit hash by word, made when first asked for."""

    def __init__(self):
        import xxhash

        super().__init__()
        self.digest = xxhash.xxh64_intdigest

    def __missing__(self, word: bytes) -> int:
        got = self[word] = self.digest(word)
        return got

    def of(self, text: bytes) -> np.ndarray:
        found = text.lower().split()
        return np.fromiter(map(self.__getitem__, found), np.uint64, len(found))

    def trim(self) -> None:
        if len(self) > CACHE_WORDS:
            self.clear()


def hashes() -> WordHashes:
    """One for each worker process."""
    out = worker_cache("word hashes", WordHashes)
    out.trim()
    return out


def _turn(x: np.ndarray, by: int) -> np.ndarray:
    return x << np.uint64(by) | x >> np.uint64(64 - by)


def block_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """What ``WordHashes.of`` gives for each of the texts, one after the other, and their numbers of words. Words of one length are hashed together."""
    import xxhash

    worker_cache("block hashes", bool)  # nothing is kept from batch to batch
    joined = b" ".join(texts).lower() + b" " * 8
    inside = np.frombuffer(joined.translate(IN_WORD), np.bool_)
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        edges = np.append(0, edges)
    starts, ends = edges[::2], edges[1::2]
    counts = np.diff(np.searchsorted(starts, np.cumsum([len(t) + 1 for t in texts])), prepend=0)
    sizes = np.minimum(ends - starts, STRIPE).astype(np.uint8)
    order = np.argsort(sizes, kind="stable")
    bounds = np.append(0, np.cumsum(np.bincount(sizes, minlength=STRIPE + 1))).tolist()
    words8, words4 = (np.ndarray(len(joined) - n + 1, f"<u{n}", joined, strides=1) for n in (8, 4))
    single = np.frombuffer(joined, np.uint8)
    out = np.empty(len(starts), np.uint64)
    for n in range(1, STRIPE):
        own = order[bounds[n] : bounds[n + 1]]
        if not len(own):
            continue
        at, end = starts[own], n
        h = np.full(len(own), P5 + np.uint64(n))
        while end >= 8:
            h = _turn(h ^ _turn(words8[at] * P2, 31) * P1, 27) * P1 + P4
            at, end = at + 8, end - 8
        if end >= 4:
            h = _turn(h ^ words4[at] * P1, 23) * P2 + P3
            at, end = at + 4, end - 4
        for k in range(end):
            h = _turn(h ^ single[at + k] * P5, 11) * P1
        h = (h ^ h >> np.uint64(33)) * P2
        h = (h ^ h >> np.uint64(29)) * P3
        out[own] = h ^ h >> np.uint64(32)
    for k in order[bounds[STRIPE] :].tolist():
        out[k] = xxhash.xxh64_intdigest(joined[starts[k] : ends[k]])
    return out, counts


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(32))


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the runs of ``size`` words; of the whole sequence if it is shorter; none if it is empty."""
    if not len(words):
        return words
    size = min(size, len(words))
    out = words[: len(words) - size + 1]
    for k in range(1, size):
        out = mix(out) + words[k : len(words) - size + 1 + k]
    return mix(out)


def text_blocks(column: pa.Array, most: int = BLOCK_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """Consecutive texts of about ``most`` bytes together, with the number of the first; null counts as empty. Only a
    block's texts are Python objects at a time."""
    first, held, size = 0, [], 0
    for k in range(0, len(column), 64):
        for text in column.slice(k, 64).cast(pa.large_binary()).to_pylist():
            held.append(text or b"")
            size += len(held[-1])
            if size >= most:
                yield first, held
                first, held, size = first + len(held), [], 0
    if held:
        yield first, held
    del held
    give_back()
