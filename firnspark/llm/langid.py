"""Language by a convolutional network over bytes, trained in numpy and applied to windows of fixed length."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .averaging import MOVES, blocks, flat, move, moves, shaped
from .common import drop, free_name, give_back, materialize, worker_cache
from .words import text_blocks

#: Bytes of a window, filter widths, filters of each width, and windows that are convolved together.
WINDOW, WIDTHS, FILTERS, CHUNK = 256, (2, 3, 4), 12, 256
#: Share of the right predictions of held-out documents that may fall below the least score of a known language.
LOST = 0.005
#: Windows that a task mixes before it learns from them.
MIXED = 4096


@dataclass
class Model:
    languages: list[str]
    #: for each width, what each byte at each place adds to each filter: (width, 256, FILTERS)
    filters: list[np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray


def windows(text: bytes) -> np.ndarray:
    """The whole text, A-Z in lower case, in rows of ``WINDOW`` bytes, the last one filled up with spaces."""
    text = text.lower()
    text = text.ljust(max(1, -(-len(text) // WINDOW)) * WINDOW)
    return np.frombuffer(text, np.uint8).reshape(-1, WINDOW)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(rows: np.ndarray, labels: np.ndarray, languages: list[str], epochs: int = 3, rate: float = 0.1, batch: int = 64, seed: int = 5) -> Model:
    """Fit by Adagrad on cross entropy, languages weighted alike."""
    return _trained(rows, labels, languages, epochs, rate, batch, seed)[0]


def _trained(rows: np.ndarray, labels: np.ndarray, languages: list[str], epochs: int = 3, rate: float = 0.1, batch: int = 64, seed: int = 5) -> tuple[Model, list[np.ndarray]]:
    """The model of ``train`` and its sums of squared gradients."""
    rng = np.random.default_rng(seed)
    f32, n_out = np.float32, len(languages)
    model = Model(
        languages, [rng.normal(0, 0.3, (w, 256, FILTERS)).astype(f32) for w in WIDTHS], np.zeros(FILTERS * len(WIDTHS), f32),
        rng.normal(0, 0.2, (FILTERS * len(WIDTHS), n_out)).astype(f32), np.zeros(n_out, f32),
    )
    squares = [np.full_like(p, 1e-4) for p in _arrays(model)]
    counts = np.bincount(labels, minlength=n_out)
    weight = (len(labels) / (np.count_nonzero(counts) * np.maximum(counts, 1)))[labels].astype(f32)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for lo in range(0, len(order), batch):
            own = order[lo : lo + batch]
            _step(model, squares, rows[own], labels[own], weight[own], rate)
    return model, squares


def _arrays(model: Model) -> list[np.ndarray]:
    return [*model.filters, model.bias, model.out, model.out_bias]


def _step(model: Model, squares: list[np.ndarray], x: np.ndarray, labels: np.ndarray, weight: np.ndarray, rate: float) -> None:
    """An Adagrad step over windows ``x``. Gradients pass only where a filter was largest."""
    places, values = [], []
    for width, filt in zip(WIDTHS, model.filters, strict=True):
        n = WINDOW - width + 1
        conv = sum(filt[k][x[:, k : n + k]] for k in range(width))
        at = conv.argmax(axis=1)
        places.append(at)
        values.append(np.take_along_axis(conv, at[:, None], axis=1)[:, 0])
    pre = np.concatenate(values, axis=1) + model.bias
    hidden = np.maximum(pre, 0)
    error = _softmax(hidden @ model.out + model.out_bias)
    error[np.arange(len(x)), labels] -= 1
    error *= weight[:, None] / len(x)
    d_pre = (error @ model.out.T) * (pre > 0)
    grads = [np.zeros_like(f) for f in model.filters] + [d_pre.sum(axis=0), hidden.T @ error, error.sum(axis=0)]
    for j, width in enumerate(WIDTHS):
        d = d_pre[:, j * FILTERS : (j + 1) * FILTERS]
        for k in range(width):
            seen = np.take_along_axis(x, places[j] + k, axis=1)
            np.add.at(grads[j][k], (seen, np.broadcast_to(np.arange(FILTERS), seen.shape)), d)
    for value, square, grad in zip(_arrays(model), squares, grads, strict=True):
        square += grad * grad
        value -= rate * grad / np.sqrt(square)


def letter_search():
    """Finds a letter (Unicode category L) in a text."""
    import regex

    return regex.compile(r"\p{L}").search


class Predictor:
    """Probabilities of whole texts in a worker. Filters of two bytes and more become tables of byte pairs."""

    def __init__(self, model: Model):
        self.model, self.letter = model, letter_search()
        pair = lambda f: (f[0][:, None] + f[1][None, :]).reshape(65536, FILTERS)
        two, three, four = model.filters
        self.first = [pair(two), pair(three), pair(four)]
        self.third, self.second = three[2], pair(four[2:])

    def windows(self, rows: np.ndarray) -> np.ndarray:
        """Probabilities of each window."""
        model, out = self.model, []
        for lo in range(0, len(rows), CHUNK):
            x = rows[lo : lo + CHUNK].astype(np.int32)
            pairs = x[:, :-1] << 8 | x[:, 1:]
            parts = [self.first[0][pairs].max(axis=1)]
            conv = self.first[1][pairs[:, :-1]]
            conv += self.third[x[:, 2:]]
            parts.append(conv.max(axis=1))
            conv = self.first[2][pairs[:, :-2]]
            conv += self.second[pairs[:, 2:]]
            parts.append(conv.max(axis=1))
            hidden = np.maximum(np.concatenate(parts, axis=1) + model.bias, 0)
            out.append(_softmax(hidden @ model.out + model.out_bias))
        return np.concatenate(out)

    def __call__(self, texts: list[bytes]) -> tuple[list[str], np.ndarray]:
        own = [windows(t) for t in texts]
        starts = np.cumsum([0, *map(len, own[:-1])])
        mean = np.add.reduceat(self.windows(np.concatenate(own)).astype(float), starts, axis=0) / np.array([len(x) for x in own])[:, None]
        letters = np.array([self.letter(t.decode()) is not None for t in texts])
        names = [self.model.languages[k] if ok else "und" for k, ok in zip(mean.argmax(axis=1).tolist(), letters, strict=True)]
        return names, np.where(letters, np.clip(mean.max(axis=1), 0, 1), 0.0)


def _sampled(known: DataFrame, most: int, id_col: str, lang: str) -> DataFrame:
    """About ``most`` rows at most of each language in ``known``: those whose hash is below a bound, set by how many there are."""
    counts = known.groupBy(F.col(lang).alias("l")).agg(F.count("*").alias("n"))
    bounds = F.broadcast(counts.select("l", (F.least(F.lit(1.0), F.lit(float(most)) / F.col("n")) * (1 << 30)).cast("long").alias("bound")))  # a row for each language
    return known.join(bounds, known[lang] == F.col("l")).where(F.pmod(F.xxhash64(id_col), F.lit(1 << 30)) < F.col("bound")).drop("l", "bound")


def _known(docs: DataFrame, held_out: int, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """``id_col``, ``lang`` and ``text`` of all documents to learn from."""
    key = F.col(id_col)
    mine = F.pmod(F.crc32(key.cast("string")), F.lit(4)) != held_out
    return docs.where(F.col(lang_col).isNotNull() & key.isNotNull() & mine).select(key, F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))


def training_windows(known: DataFrame, most: int, each: int, id_col: str) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Windows to start from, of about ``most`` documents of each language: all of a text's, or ``each`` of them, evenly spread, if it has more."""
    chosen = _sampled(known, most, id_col, "lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("langid", dict)  # other operators' caches go
        letter = letter_search()
        for batch in batches:
            out = []
            for k, lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if text is not None and letter(text):
                    rows = windows(text.encode())
                    rows = rows[np.unique(np.linspace(0, len(rows) - 1, min(each, len(rows))).astype(int))]
                    out.append((k, lang, rows.tobytes()))
            columns = list(zip(*out, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.string(), pa.binary()), strict=True)], names=["k", "lang", "rows"])

    got = chosen.select(F.xxhash64(id_col), "lang", "text").mapInArrow(run, "k long, lang string, rows binary").collect()
    got = sorted(got, key=lambda r: (r.k, r.lang, r.rows))
    names = sorted({r.lang for r in got})
    rows = [np.frombuffer(r.rows, np.uint8).reshape(-1, WINDOW) for r in got]
    if not rows:
        return np.zeros((0, WINDOW), np.uint8), np.zeros(0, int), []
    number = {name: k for k, name in enumerate(names)}
    return np.concatenate(rows), np.repeat([number[r.lang] for r in got], [len(x) for x in rows]), names


def languages(docs: DataFrame, most: int = 1500, each: int = 8, held_out: int = 2, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Predict the language of every whole text: ``id_col``, ``held_out``, ``lang_pred``, ``score`` (mean probability over the text's windows).

    Learns from whole text and language of all documents whose crc32 of the id as text leaves another remainder by 4 than ``held_out``; ``most`` documents of
    a language and ``each`` windows of one bound only what the model starts from (``_learned``). A text that is null or has no letter is ``und`` with
    score 0, as is every text if there is nothing to learn from. Repeated rows come back as often, an empty table gives no rows, a null id is
    not held out; other columns are not read.
    """
    out = _predicted(docs.select(id_col, text_col), _learned(docs, most, each, held_out, id_col, text_col, lang_col), text_col, ("lang_pred", "score"))
    held = F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(4)) == held_out, F.lit(False))
    return out.select(id_col, held.alias("held_out"), "lang_pred", "score")


def _learned(docs: DataFrame, most: int, each: int, held_out: int, id_col: str, text_col: str, lang_col: str) -> Model | None:
    """A model learned from all windows, or None without any. About ``most`` documents at most of each language and ``each`` windows of a text give it a start;
    then, where there are more, tasks go on from that model over all windows of their own documents, and the mean of what they make of it is the model."""
    known = _known(docs, held_out, id_col, text_col, lang_col)
    pieces = F.greatest(F.lit(1), F.ceil(F.octet_length("text") / WINDOW))
    sizes = known.where(F.col("text").rlike(r"\p{L}")).groupBy("lang").agg(F.count("*").alias("n"), F.sum(pieces).alias("windows"), F.max(pieces).alias("longest")).collect()
    x, labels, begun = training_windows(known, most, each, id_col)
    languages = sorted({*begun, *(r.lang for r in sizes)})
    if not languages:
        return None
    model, squares = _trained(x, np.array([languages.index(n) for n in begun], int)[labels] if begun else labels, languages)
    del x
    if any(r.n > most or r.longest > each for r in sizes):
        counts = np.maximum(1, [{r.lang: r.windows for r in sizes}.get(n, 0) for n in languages])
        model = _pass(known, model, squares, counts.sum() / (len(languages) * counts), blocks(sum(r.n for r in sizes)), id_col)
    give_back()
    return model


def _pass(known: DataFrame, model: Model, squares: list[np.ndarray], weights: np.ndarray, tasks: int, id_col: str, batch: int = 64, rate: float = 0.1) -> Model:
    """The mean by windows of what tasks make of ``model`` by steps over all windows of their texts, mixed ``MIXED`` at a time."""
    languages, shapes, begin = model.languages, [a.shape for a in squares], flat(_arrays(model))
    number = {name: k for k, name in enumerate(languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("langid", dict)  # other operators' caches go
        letter = letter_search()
        arrays = shaped(begin, shapes)
        own = Model(languages, arrays[: len(WIDTHS)], *arrays[len(WIDTHS) :])
        sums = [s.copy() for s in squares]
        block, done = TaskContext.get().partitionId(), 0
        rng = np.random.default_rng(block)
        held, labels, size = [], [], 0

        def steps(x: np.ndarray, y: np.ndarray) -> None:
            order = rng.permutation(len(x))
            for lo in range(0, len(x), batch):
                at = order[lo : lo + batch]
                _step(own, sums, x[at], y[at], weights[y[at]], rate)

        for got in batches:
            for lo in range(0, len(got), 64):
                some = got.slice(lo, 64)
                for text, lang in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True):
                    if text is None or lang not in number or not letter(text):
                        continue
                    rows = windows(text.encode())
                    while len(rows):
                        held.append(rows[: MIXED - size])
                        labels.append(np.full(len(held[-1]), number[lang]))
                        rows, size = rows[len(held[-1]) :], size + len(held[-1])
                        if size == MIXED:
                            steps(np.concatenate(held), np.concatenate(labels))
                            held, labels, size, done = [], [], 0, done + size
        if held:
            steps(np.concatenate(held), np.concatenate(labels))
        if done + size:
            yield from moves(0, block, flat(_arrays(own)) - begin, np.full(len(begin), done + size))

    dealt = known.repartition(tasks, id_col).sortWithinPartitions(F.xxhash64(id_col, "text"), id_col, "text", "lang").select("text", "lang")
    made = [begin.copy()]
    move(made, dealt.mapInArrow(run, MOVES))
    arrays = shaped(made[0], shapes)
    return Model(languages, arrays[: len(WIDTHS)], *arrays[len(WIDTHS) :])


def least_score(docs: DataFrame, model: Model, held_out: int, id_col: str, text_col: str, lang_col: str) -> float:
    """The score that all but ``LOST`` of the right predictions reach, over all held-out documents of the languages learned. It is
    a quarter of the way from that of a guess to 1 at least."""
    key, lang = F.col(id_col), F.col(lang_col)
    held = docs.where(lang.isin(model.languages) & key.isNotNull() & (F.pmod(F.crc32(key.cast("string")), F.lit(4)) == held_out)).select(F.col(text_col).alias("text"), lang.alias("lang"))
    guess = 1 / len(model.languages)
    floor = guess + (1 - guess) / 4
    right = materialize(_predicted(held, model, "text", ("pred", "score")).where("pred = lang").select("score"), "language_scores")
    least = lower_quantile(right, LOST)
    drop(right)
    return floor if least is None else max(floor, least)


def lower_quantile(values: DataFrame, share: float, bins: int = 4096) -> float | None:
    """Of the numbers in the one column, n without nulls, the one that has place floor(``share`` (n - 1)) from 0, exactly; None if there is none.
    Counts by bin lead to the bin that holds it, then to a bin within that, until all numbers of a bin are one."""
    x = F.col(values.columns[0])
    n, low, high = values.agg(F.count(x), F.min(x), F.max(x)).first()
    place = math.floor(share * (n - 1))
    while n and low < high:
        at = F.least(F.floor((x - low) / (high - low) * bins), F.lit(bins - 1))
        for r in sorted(values.where(x.between(low, high)).groupBy(at.alias("at")).agg(F.count("*").alias("n"), F.min(x).alias("low"), F.max(x).alias("high")).collect(), key=lambda r: r["at"]):
            if place < r["n"]:
                low, high = r["low"], r["high"]
                break
            place -= r["n"]
    return low


def _predicted(rows: DataFrame, model: Model | None, text_col: str, new: tuple[str, str]) -> DataFrame:
    """``rows`` with columns ``new`` for language and score."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    at, names, shared_id = rows.columns.index(text_col), [*rows.columns, *new], uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        # a worker keeps the tables from task to task
        predict = worker_cache(("langid", shared_id), lambda: Predictor(model)) if model is not None else lambda texts: (["und"] * len(texts), np.zeros(len(texts)))
        for batch in batches:
            for first, texts in text_blocks(batch.column(at), 2_000_000):
                found, score = predict(texts)
                yield pa.RecordBatch.from_arrays([*batch.slice(first, len(texts)).columns, pa.array(found, pa.string()), pa.array(score, pa.float64())], names=names)

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField(new[0], StringType()), StructField(new[1], DoubleType())]))


def in_known_language(docs: DataFrame, least: float | None = None, most: int = 1500, each: int = 8, held_out: int = 2, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``docs``, all columns, without the rows to which ``languages`` gives ``und`` or a score below ``least``, or below ``least_score`` if that is
    not given. Rows are judged where they are read; none moves. Null and letterless texts go; a null id or language is no reason to; repeated rows go
    or stay together. Where there is nothing to learn from all rows with a letter stay."""
    model = _learned(docs, most, each, held_out, id_col, text_col, lang_col)
    if model is None:
        return docs.where(F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)))
    if least is None:
        least = least_score(docs, model, held_out, id_col, text_col, lang_col)
    new = (free_name(docs, "lang_pred"), free_name(docs, "lang_score"))
    return _predicted(docs, model, text_col, new).where((F.col(new[0]) != "und") & (F.col(new[1]) >= least)).drop(*new)
