"""Maximal runs of periodic word sequences in texts, found by probing a harmonic grid, and texts without their repetitions."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import worker_cache
from .words import text_blocks

#: Texts of up to so many words are probed by one table of grid pairs (160,000 of them); longer ones period by period.
TABLE_WORDS = 1 << 14
#: Words between ASCII white space.
SPACES = "[\\x20\\x09-\\x0D]+"
RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


@lru_cache(maxsize=1)
def grid_pairs() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (jp, (j+1)p) of all periods p, by their end; and how many pairs there are below each end."""
    periods = np.arange(1, TABLE_WORDS, dtype=np.int32)
    many = (TABLE_WORDS - 1) // periods
    period = np.repeat(periods, many)
    end = period * (np.arange(len(period), dtype=np.int32) - np.repeat(np.cumsum(many) - many, many).astype(np.int32) + 1)
    order = np.argsort(end, kind="stable")
    period, end = period[order], end[order]
    return end - period, end, np.searchsorted(end, np.arange(TABLE_WORDS + 1))


def _likely(w: np.ndarray, a: np.ndarray, p: np.ndarray | int) -> np.ndarray:
    """Which of the matches at ``a`` have two more equal words beside them, as every run of six words or more has.
    ``w`` has two words on either side that equal nothing."""
    a = a + 2
    b = a + p
    right, left = w[a + 1] == w[b + 1], w[a - 1] == w[b - 1]
    return np.flatnonzero(right & (left | (w[a + 2] == w[b + 2])) | left & (w[a - 2] == w[b - 2]))


def _reach(w: np.ndarray, i: int, p: int, step: int) -> int:
    """How many words from ``i`` on, forwards or backwards, equal those ``p`` later; compared in chunks that grow."""
    n, done, chunk = len(w), 0, 16
    most = n - p - i if step > 0 else i + 1
    while done < most:
        size = min(chunk, most - done)
        at = i + done if step > 0 else i - done - size + 1
        odd = w[at : at + size] != w[at + p : at + p + size]
        if odd.any():
            return done + int(odd.argmax() if step > 0 else odd[::-1].argmax())
        done, chunk = done + size, min(4 * chunk, 1 << 16)
    return done


def maximal_runs(words: np.ndarray, least: int = 12) -> list[tuple[int, int, int]]:
    """(start, length, period) of every stretch with a smallest period p and a length of at least ``least`` and 2p that can't be extended.

    A stretch of 2p words with period p holds jp and (j+1)p for some j, both the same word, so those n ln n places are
    all that is probed. Matches with equal words beside them are extended. A match inside a run whose period divides p belongs to that
    run and is passed over; a longer stretch there would have the smaller period throughout.
    """
    n, found = len(words), []
    if n < max(least, 2):
        return found
    w = np.concatenate([[-1, -2], words, [-3, -4]])
    inside: dict[int, list[tuple[int, int]]] = defaultdict(list)  # by period: runs whose own period divides it
    near = least >= 5

    def probe(p: int, hits: np.ndarray) -> None:
        if known := inside.pop(p, None):
            known.sort()
            start, end = np.array(known).T
            at = np.searchsorted(start, hits, side="right") - 1
            hits = hits[(at < 0) | (np.maximum.accumulate(end)[at] <= hits + p)]
        beyond = 0
        for i in hits.tolist():
            if i < beyond:
                continue
            first, beyond = i - _reach(words, i, p, -1) + 1, i + _reach(words, i, p, 1)
            length = beyond - first + p
            if length >= 2 * p:
                if length >= least:
                    found.append((first, length, p))
                for multiple in range(2 * p, length, p):
                    inside[multiple].append((first, first + length))

    if n <= TABLE_WORDS:
        a, b, below = grid_pairs()
        hits = np.flatnonzero(words[a[: below[n]]] == words[b[: below[n]]])
        a, p = a[hits], b[hits] - a[hits]
        if near:
            kept = _likely(w, a, p)
            a, p = a[kept], p[kept]
        order = np.lexsort((a, p))
        a, p = a[order], p[order]
        cuts = np.flatnonzero(np.diff(p)) + 1
        for hits in np.split(np.arange(len(a)), cuts) if len(a) else ():
            probe(int(p[hits[0]]), a[hits])
    else:
        for period in range(1, n // 2 + 1):
            hits = np.flatnonzero(words[: n - period : period] == words[period::period]) * period
            if near and len(hits):
                hits = hits[_likely(w, hits, period)]
            if len(hits):
                probe(period, hits)
    return sorted((s, size, p) for s, size, p in found)


def word_numbers(words: list[bytes]) -> np.ndarray:
    """Equal numbers for equal words of one text."""
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(x, len(seen)) for x in words), np.int64, len(words))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words without those that a run repeats after its first period, joined by spaces."""
    if not runs:
        return b" ".join(words)
    kept = np.ones(len(words), bool)
    for start, length, period in runs:
        kept[start + period : start + length] = False
    return b" ".join([words[k] for k in np.flatnonzero(kept).tolist()])


def periodic_runs(docs: DataFrame, least: int = 12, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: ``id_col``, ``n_words``, ``runs`` (start, length, period; by start, then period) and ``collapsed``.

    A word is a run of characters other than ASCII white space; words are equal if their bytes are. A run is a stretch
    of at least ``least`` words and two periods with one smallest period that no neighbouring word extends. ``collapsed`` is what
    stays without the words that any run holds after its first period. A null or empty text has no words, no
    runs and an empty ``collapsed``; repeated rows and null ids are kept as they are; an empty table gives no rows; other
    columns are not read. Texts are worked on one by one where they are read, without a shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("periodic runs", dict)
        for batch in batches:
            for first, texts in text_blocks(batch.column(1)):
                many, runs, left = [], [], []
                for text in texts:
                    words = text.split()
                    got = maximal_runs(word_numbers(words), least)
                    many.append(len(words))
                    runs.append([dict(zip(("start", "length", "period"), x, strict=True)) for x in got])
                    left.append(collapsed(words, got))
                columns = [batch.column(0).slice(first, len(texts)), pa.array(many, pa.int64()), pa.array(runs, RUNS), pa.array(left, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=[id_col, "n_words", "runs", "collapsed"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def planted_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``text_col``, with a tenth of the texts made periodic from some word on, both by the checksum of the id. A null
    text has no words and a null id no checksum; both stay as they are."""
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))
    words = F.filter(F.split(F.col(text_col), SPACES), lambda x: x != "")
    rows = docs.select(id_col, text_col, F.when(h % 10 == 0, words).alias("_words"), F.floor(h / 10).alias("_g"))
    n = F.size("_words")
    a = (F.col("_g") % n).cast("int")
    period = (F.lit(1) + F.floor((n - a) / (F.lit(3) + F.col("_g") % 8))).cast("int")
    again = F.flatten(F.array_repeat(F.slice("_words", a + 1, period), F.ceil((n - a) / period).cast("int")))
    made: Column = F.array_join(F.concat(F.slice("_words", F.lit(1), a), F.slice(again, F.lit(1), n - a)), " ")
    return rows.select(id_col, F.when(n > 0, made).otherwise(F.col(text_col)).alias(text_col))
