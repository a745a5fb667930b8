"""Toxicity by a convolutional classifier over hashed word embeddings, trained in numpy."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .averaging import MOVES, blocks, flat, move, moves, shaped
from .common import drop, free_name, give_back, materialize, worker_cache
from .words import text_blocks

#: Rows of the embedding table (row 0 stands between texts), its columns, filter widths and filters of each width.
BUCKETS, DIM, WIDTHS, FILTERS = 1 << 16, 16, (1, 2, 3), 16
#: Shapes of a model's arrays: embedding, filters, bias, weights of the output and its bias.
SHAPES = [(BUCKETS, DIM), *((w, DIM, FILTERS) for w in WIDTHS), (FILTERS * len(WIDTHS),), (FILTERS * len(WIDTHS),), (1,)]
#: Rows of padding behind a text: windows over its last words reach into them, and each text, an empty one too, has a window of padding alone.
GAP = max(WIDTHS)
#: Characters that are taken off a word's ends.
PUNCTUATION = b".,;:!?\"'()[]{}<>*#$%&|-_=+/\\~`"
#: Toxic and clean rows that a language needs for a threshold of its own; labelled rows up to which the driver learns from all, and its folds.
OWN_ROWS, FEW, FOLDS = 25, 4000, 4
#: Passes over more labelled rows, and bins of their scores.
PASSES, BINS = 2, 1 << 14
#: Words that a worker keeps before it starts anew, and words that are convolved together.
CACHE_WORDS, CHUNK = 100_000, 1 << 15


def bucket(word: bytes) -> int:
    return zlib.crc32(word.strip(PUNCTUATION)) % (BUCKETS - 1) + 1


def token_rows(text: str | None) -> np.ndarray:
    found = (text or "").lower().encode().split()
    return np.fromiter(map(bucket, found), np.int32, len(found))


@dataclass
class Model:
    embedding: np.ndarray
    #: for each width, (width, DIM, FILTERS)
    filters: list[np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    #: raw score at which a text counts as toxic, by group of languages; the first is for all texts without words of a group
    thresholds: np.ndarray | None = None
    #: for each row of the embedding, the logarithm of its share in each group's words
    votes: np.ndarray | None = None

    def products(self, rows: np.ndarray) -> np.ndarray:
        """Each row's part in every filter: (rows, sum of WIDTHS, FILTERS)."""
        vectors = self.embedding[rows]
        return np.stack([vectors @ f[k] for f in self.filters for k in range(len(f))], axis=1)


def spans(index: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Ends of the texts' windows in what ``_padded`` gives: those that would reach into the next text are left out."""
    return np.append(starts[1:], len(index) - GAP) - (max(WIDTHS) - 1)


def pooled(products: np.ndarray, index: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Largest value of each filter over the windows of each text, whatever stands beside it; ``index`` and ``starts`` as from ``_padded``."""
    parts, slot = [], 0
    borders = np.stack([starts, spans(index, starts)], axis=1).ravel()
    for width in WIDTHS:
        n = len(index) - width + 1
        conv = products[index[:n], slot]
        for k in range(1, width):
            conv += products[index[k : n + k], slot + k]
        slot += width
        parts.append(np.maximum.reduceat(conv, borders, axis=0)[::2])
    return np.concatenate(parts, axis=1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _padded(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Texts one after the other, with ``GAP`` rows of padding, number 0, behind each and once more at the end; and where they start."""
    gap = np.zeros(GAP, np.int32)
    index = np.concatenate([*(x for t in texts for x in (t, gap)), gap])
    starts = np.cumsum([0, *(len(t) + GAP for t in texts[:-1])])
    return index, starts


def raw_scores(model: Model, texts: list[np.ndarray]) -> np.ndarray:
    out = []
    begin = 0
    while begin < len(texts):
        end, size = begin, 0
        while end < len(texts) and (end == begin or size + len(texts[end]) <= CHUNK):
            size += len(texts[end])
            end += 1
        index, starts = _padded(texts[begin:end])
        rows, at = np.unique(index, return_inverse=True)
        features = np.maximum(pooled(model.products(rows), at, starts) + model.bias, 0)
        out.append(_sigmoid(features @ model.out + model.out_bias))
        begin = end
    return np.concatenate(out) if out else np.zeros(0)


class Learner:
    """Adagrad steps on logistic loss. Gradients pass only where a filter was largest."""

    def __init__(self, model: Model, squares: list[np.ndarray] | None = None, rate: float = 0.05):
        self.model, self.rate = model, rate
        self.squares = [np.full_like(x, 1e-4) for x in (model.embedding, *model.filters, model.bias, model.out)] if squares is None else squares
        #: steps that have moved a row of the embedding
        self.steps = np.zeros(BUCKETS, np.int32)

    def step(self, texts: list[np.ndarray], labels: np.ndarray, weight: np.ndarray) -> None:
        model, squares, rate, f32 = self.model, self.squares, self.rate, np.float32
        index, starts = _padded(texts)
        ends = spans(index, starts)
        places, values = [], []
        for width, filt in zip(WIDTHS, model.filters, strict=True):
            at = np.empty((len(texts), FILTERS), np.int64)
            best = np.empty((len(texts), FILTERS), f32)
            # short texts together, long ones in pieces
            for first, last, begin, end in _stretches(starts, ends):
                vectors = model.embedding[index[begin : end + width - 1]]
                conv = sum(vectors[k : end - begin + k] @ filt[k] for k in range(width))
                for t in range(first, last):
                    lo, hi = max(starts[t], begin) - begin, min(ends[t], end) - begin
                    found = conv[lo:hi].argmax(axis=0)
                    top = np.take_along_axis(conv[lo:hi], found[None], axis=0)[0]
                    more = np.ones(FILTERS, bool) if begin <= starts[t] else top > best[t]
                    at[t, more], best[t, more] = found[more] + lo + begin, top[more]
            places.append(at)
            values.append(best)
        pre = np.concatenate(values, axis=1) + model.bias
        hidden = np.maximum(pre, 0)
        error = ((_sigmoid(hidden @ model.out + model.out_bias) - labels) * weight).astype(f32) / len(texts)
        d_out = hidden.T @ error
        d_pre = np.outer(error, model.out) * (pre > 0)
        grads: list = [None, *(np.zeros_like(f) for f in model.filters), d_pre.sum(axis=0), d_out]
        touched, moved = [], []
        for j, (width, filt) in enumerate(zip(WIDTHS, model.filters, strict=True)):
            d = d_pre[:, j * FILTERS : (j + 1) * FILTERS]
            for k in range(width):
                rows = index[places[j] + k]
                grads[1 + j][k] = np.einsum("bfd,bf->df", model.embedding[rows], d)
                touched.append(rows.ravel())
                moved.append((d[:, :, None] * filt[k].T[None]).reshape(-1, DIM))
        rows, at = np.unique(np.concatenate(touched), return_inverse=True)
        g = np.zeros((len(rows), DIM), f32)
        np.add.at(g, at, np.concatenate(moved))
        g[rows == 0] = 0
        squares[0][rows] += g * g
        model.embedding[rows] -= rate * g / np.sqrt(squares[0][rows])
        self.steps[rows[rows > 0]] += 1
        for value, square, grad in zip((*model.filters, model.bias, model.out), squares[1:], grads[1:], strict=True):
            square += grad * grad
            value -= rate * grad / np.sqrt(square)
        model.out_bias -= rate * float(error.sum())


def _stretches(starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """Texts from a first up to a last, and windows of theirs from a begin up to an end: several whole texts, or a piece of one of more than ``CHUNK`` windows."""
    t = 0
    while t < len(starts):
        last = t + 1
        while last < len(starts) and ends[last] - starts[t] <= CHUNK:
            last += 1
        for begin in range(starts[t], ends[last - 1], CHUNK):
            yield t, last, begin, min(begin + CHUNK, ends[last - 1])
        t = last


def train(texts: list[np.ndarray], labels: np.ndarray, epochs: int | None = None, rate: float = 0.05, batch: int = 32, seed: int = 7) -> Model:
    """Fit by ``Learner``, classes weighted alike. Small tables are gone over more often."""
    return _trained(texts, labels, epochs, rate, batch, seed).model


def _trained(texts: list[np.ndarray], labels: np.ndarray, epochs: int | None = None, rate: float = 0.05, batch: int = 32, seed: int = 7) -> Learner:
    epochs = epochs or 8 * max(1, min(8, 2000 // max(1, len(texts))))
    rng = np.random.default_rng(seed)
    f32 = np.float32
    model = Model(
        rng.normal(0, 0.05, (BUCKETS, DIM)).astype(f32), [rng.normal(0, 0.3, (w, DIM, FILTERS)).astype(f32) for w in WIDTHS],
        np.zeros(FILTERS * len(WIDTHS), f32), rng.normal(0, 0.1, FILTERS * len(WIDTHS)).astype(f32), 0.0,
    )
    model.embedding[0] = 0
    learner = Learner(model, rate=rate)
    weight = np.where(labels == 1, 0.5 / max(1, labels.sum()), 0.5 / max(1, (1 - labels).sum())) * len(labels)
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for lo in range(0, len(order), batch):
            own = order[lo : lo + batch]
            learner.step([texts[k] for k in own], labels[own], weight[own])
    return learner


def language_votes(texts: list[np.ndarray], languages: list[str], labels: np.ndarray) -> np.ndarray:
    """Columns of ``Model.votes``, learned from labelled rows' words: one for each language with ``OWN_ROWS`` rows of both labels, and one for
    all other rows together if there are any."""
    names = np.array(languages)
    own = [x for x in sorted(set(languages)) if min(np.bincount(labels[names == x], minlength=2)[:2]) >= OWN_ROWS]
    group = np.array([own.index(x) if x in own else len(own) for x in languages])
    counts = [np.bincount(np.concatenate([*(texts[k] for k in np.flatnonzero(group == g)), np.zeros(0, np.int32)]), minlength=BUCKETS) for g in range(len(own) + 1) if not own or (group == g).any()]
    return _votes(np.stack(counts))


def _votes(counts: np.ndarray) -> np.ndarray:
    """Columns of ``Model.votes`` from how often each group has each row of the embedding."""
    counts = counts.T + 0.05
    votes = np.log(counts / counts.sum(axis=0)).astype(np.float32)
    votes -= votes.mean(axis=1, keepdims=True)
    votes[0] = 0
    return votes


def groups(votes: np.ndarray, index: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Number of each text's threshold: that of its likeliest group, from 1 on, or 0 without a word that tells."""
    sums = np.add.reduceat(votes[index], starts, axis=0)
    return np.where(np.abs(sums).sum(axis=1) > 0, sums.argmax(axis=1) + 1, 0)


def best_threshold(raw: np.ndarray, labels: np.ndarray, weight: np.ndarray | None = None) -> float:
    """The raw score, half-way between two rows, at which F0.5 is largest; of equal ones the middle of the widest gap. A row counts as ``weight`` rows.

    A clean text counts for more than a toxic one that is missed: where at no score half of the rows above it are toxic, hardly any text passes.
    """
    order = np.argsort(-raw, kind="stable")
    weight = np.ones(len(raw)) if weight is None else weight[order]
    raw, labels = raw[order].astype(float), labels[order] * weight
    hits, flagged = np.cumsum(labels), np.cumsum(weight)
    score = 1.25 * hits / (flagged + 0.25 * labels.sum())
    after = np.append(raw[1:], 0.0)
    score = np.where((raw > after) & (2 * hits >= flagged), score, -1)
    if score.max() <= 0:
        return 0.98
    best = np.flatnonzero(score >= score.max() - 1e-9)
    k = best[np.argmax((raw - after)[best])]
    return float(np.clip((raw[k] + after[k]) / 2, 0.02, 0.98))


def fit(rows: list[tuple[np.ndarray, str, int]], seed: int = 7) -> Model | None:
    """A model with thresholds by group of languages from few (rows of the embedding, language, label): it learns from all, and thresholds are
    set on all, fold by fold, by models that have not learned from the fold. None without rows of both labels."""
    labels = np.array([y for _, _, y in rows], np.int64)
    if len(set(labels.tolist())) < 2:
        return None
    texts = [t for t, _, _ in rows]
    fold = np.zeros(len(rows), int)
    for y in (0, 1):  # each label on every side
        own = np.flatnonzero(labels == y)
        fold[own] = np.arange(len(own)) % FOLDS
    raw = np.full(len(rows), np.nan)
    for k in range(FOLDS):
        learn, check = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
        if len(set(labels[learn].tolist())) == 2 and len(check):
            model = train([texts[i] for i in learn], labels[learn], seed=seed)
            raw[check] = raw_scores(model, [texts[i] for i in check])
    model = train(texts, labels, seed=seed)
    check = np.flatnonzero(~np.isnan(raw))
    model.votes = language_votes(texts, [x for _, x, _ in rows], labels)
    group = groups(model.votes, *_padded([texts[k] for k in check])) if len(check) else np.zeros(0, int)
    model.thresholds = _thresholds(raw[check], labels[check], np.ones(len(check)), group, model.votes.shape[1])
    give_back()
    return model


def _thresholds(raw: np.ndarray, labels: np.ndarray, weight: np.ndarray, group: np.ndarray, n_groups: int) -> np.ndarray:
    """That of all rows, then those of the groups from 1 on; a group of fewer than five rows of a label has that of all."""
    out = np.full(n_groups + 1, best_threshold(raw, labels, weight) if len(raw) else 0.98)
    for g in range(1, len(out)):
        own = group == g
        if min(np.bincount(labels[own], weight[own], minlength=2)) >= 5:
            out[g] = best_threshold(raw[own], labels[own], weight[own])
    return out


def calibrated(raw: float, at: float, cut: float) -> float:
    """``raw`` moved so that ``at`` comes to ``cut``; order is kept."""
    return cut * raw / at if raw < at else cut + (1 - cut) * (raw - at) / (1 - at)


class Scorer:
    """Scores whole texts in a worker; what filters make of a word is kept from text to text."""

    def __init__(self, model: Model | None, cut: float):
        self.model, self.cut = model, cut
        self.clear()

    def clear(self) -> None:
        self.number: dict[bytes, int] = {b"": 0}
        self.products: np.ndarray | None = None
        self.votes: np.ndarray | None = None

    def __call__(self, texts: list[bytes]) -> np.ndarray:
        model = self.model
        if model is None:
            return np.zeros(len(texts))
        if len(self.number) > CACHE_WORDS:
            self.clear()
        words = [t.decode().lower().encode().split() for t in texts]
        number = self.number
        new: dict[bytes, None] = {}
        for own in words:
            new.update((w, None) for w in own if w not in number)
        added = [0] * (self.products is None)
        for w in new:
            number[w] = len(number)
            added.append(bucket(w))
        if added:
            made, votes = model.products(np.array(added)), model.votes[np.array(added)]
            self.products = made if self.products is None else np.concatenate((self.products, made))
            self.votes = votes if self.votes is None else np.concatenate((self.votes, votes))
        out, group = np.empty(len(texts)), np.zeros(len(texts), int)
        get = number.__getitem__
        begin = 0
        while begin < len(texts):
            end, size = begin, 0
            while end < len(texts) and (end == begin or size + len(words[end]) <= CHUNK):
                size += len(words[end])
                end += 1
            index, starts = _padded([np.fromiter(map(get, w), np.int32, len(w)) for w in words[begin:end]])
            features = np.maximum(pooled(self.products, index, starts) + model.bias, 0)
            out[begin:end] = _sigmoid(features @ model.out + model.out_bias)
            group[begin:end] = groups(self.votes, index, starts)
            begin = end
        return np.array([calibrated(x, t, self.cut) for x, t in zip(out.tolist(), model.thresholds[group].tolist(), strict=True)])


def training_rows(docs: DataFrame, labels: DataFrame, held_out: int, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """All labelled rows that aren't held out, written as a table: ``k``, ``toxic``, ``rows`` of the embedding for the text's words, ``language`` and ``fold``,
    which equal texts share."""
    key = F.col(id_col)
    mine = F.pmod(F.crc32(key.cast("string")), F.lit(3)) != held_out
    known = labels.where(F.col(id_col).isNotNull() & F.col("toxic").isin(0, 1) & mine).groupBy(id_col).agg(F.max("toxic").cast("int").alias("toxic")).select(key.cast("long").alias("k"), "toxic")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = worker_cache("toxicity words", _Buckets)
        for batch in batches:
            for first, texts in text_blocks(batch.column(2), 2_000_000):
                number.trim()
                rows = [number.of(t).tobytes() for t in texts]
                own = batch.slice(first, len(texts))
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array(rows, pa.binary()), own.column(3)], names=["k", "toxic", "rows", "language"])

    language = F.coalesce(F.col(lang_col).cast("string"), F.lit("")) if lang_col in docs.columns else F.lit("")
    texts = docs.where(key.isNotNull() & mine).select(key.cast("long").alias("k"), F.col(text_col).alias("t"), language.alias("language"))
    found = texts.join(known.hint("merge"), "k").select("k", "toxic", "t", "language").mapInArrow(run, "k long, toxic int, rows binary, language string")
    return materialize(found.withColumn("fold", F.pmod(F.xxhash64("rows"), F.lit(2)).cast("int")), "toxicity_rows")


class _Buckets(dict):
    """``bucket`` by word, made when first asked for; what a worker keeps."""

    def __missing__(self, word: bytes) -> int:
        got = self[word] = bucket(word)
        return got

    def of(self, text: bytes) -> np.ndarray:
        found = text.decode().lower().encode().split()
        return np.fromiter(map(self.__getitem__, found), np.int32, len(found))

    def trim(self) -> None:
        if len(self) > CACHE_WORDS:
            self.clear()


def learned(table: DataFrame, most: int, longest: int, seed: int = 7) -> Model | None:
    """A model with thresholds from all rows of a ``training_rows`` table.

    Up to ``FEW`` rows go to ``fit``. Of more about ``most`` at most, half of the room for toxic ones and of at most ``longest`` words, only give
    the passes a start: ``PASSES`` times tasks go on from one model, each over its own rows, and the mean of what they make of it is the next. Two more models, that
    learn from one fold each, go along; thresholds come from the other fold's scores, counted by bin, over all rows. Word counts cover all rows too.
    """
    words = F.length("rows") / 4
    sizes = {(r.fold, r.toxic): (r.n, r.words) for r in table.groupBy("fold", "toxic").agg(F.count("*").alias("n"), F.sum(words).alias("words")).collect()}
    seen = np.array([[sizes.get((f, y), (0, 0))[0] for y in (0, 1)] for f in (0, 1)])
    if min(seen.sum(axis=0)) == 0:
        return None

    def local(rows: DataFrame) -> list[tuple[np.ndarray, str, int, int]]:
        got = rows.select("k", "toxic", "rows", "language", "fold").collect()
        return [(np.frombuffer(bytes(r.rows), np.int32), r.language, r.toxic, r.fold) for r in sorted(got, key=lambda r: (r.k, r.rows, r.language))]

    if seen.sum() <= FEW and sum(x for _, x in sizes.values()) <= FEW * longest:
        return fit([x[:3] for x in local(table)], seed)
    bounds = [int(min(1.0, most / 2 / max(1, n)) * (1 << 30)) for n in seen.sum(axis=0)]
    start = local(table.where((F.pmod(F.xxhash64("k"), F.lit(1 << 30)) < F.when(F.col("toxic") == 1, bounds[1]).otherwise(bounds[0])) & (words <= longest)))
    begun = []
    for fold in (0, 1, None):  # the last learns from both
        own = [x for x in start if fold is None or x[3] != fold]
        begun.append(_trained([x[0] for x in own], np.array([x[2] for x in own], np.int64), seed=seed))
    models = [flat([m.embedding, *m.filters, m.bias, m.out, np.array([m.out_bias])]) for m in (x.model for x in begun)]
    squares = [flat(x.squares) for x in begun]
    del begun, start
    counts = np.stack([seen[1], seen[0], seen.sum(axis=0)])
    weights = 0.5 * counts.sum(axis=1, keepdims=True) / np.maximum(1, counts)
    for _ in range(PASSES):
        _pass(table, models, squares, weights, blocks(int(seen.sum())))
    model = _model(models[2])
    model.votes = _table_votes(table)
    model.thresholds = _table_thresholds(table, [_model(x) for x in models[:2]], [min(x) > 0 for x in counts[:2]], model.votes)
    give_back()
    return model


def _model(lines: np.ndarray) -> Model:
    embedding, *filters, bias, out, out_bias = shaped(lines, SHAPES)
    return Model(embedding, filters, bias, out, float(out_bias[0]))


def _pass(table: DataFrame, models: list[np.ndarray], squares: list[np.ndarray], weights: np.ndarray, tasks: int, batch: int = 32) -> None:
    """Move each of ``models`` by the mean of what tasks make of it over their rows: the first two over those of the other fold, the third over all.
    A row of the embedding counts by the steps that moved it, the rest by the task's rows."""
    shared = table.sparkSession.sparkContext.broadcast((models, squares))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("toxicity", dict)  # other operators' caches go
        begin, old = shared.value
        learners = [Learner(_model(x), shaped(y, SHAPES[:-1])) for x, y in zip(begin, old, strict=True)]
        held: list[list[tuple[np.ndarray, int]]] = [[] for _ in learners]
        rows = [0] * len(learners)

        def step(m: int) -> None:
            labels = np.array([y for _, y in held[m]])
            learners[m].step([t for t, _ in held[m]], labels, weights[m][labels])
            rows[m] += len(labels)
            held[m] = []

        for got in batches:
            for lo in range(0, len(got), batch):
                own = got.slice(lo, batch)
                for text, label, fold in zip(own.column(0).to_pylist(), own.column(1).to_pylist(), own.column(2).to_pylist(), strict=True):
                    for m in (1 - fold, 2):
                        held[m].append((np.frombuffer(text, np.int32), label))
                        if len(held[m]) == batch:
                            step(m)
        for m, learner in enumerate(learners):
            if held[m]:
                step(m)
            if rows[m]:
                model = learner.model
                change = flat([model.embedding, *model.filters, model.bias, model.out, np.array([model.out_bias])]) - begin[m]
                yield from moves(m, TaskContext.get().partitionId(), change, np.append(learner.steps, np.full(len(change) - BUCKETS, rows[m])))

    dealt = table.repartition(tasks, "k").sortWithinPartitions(F.xxhash64("k", "rows"), "k", "rows", "toxic").select("rows", "toxic", "fold")
    move(models, dealt.mapInArrow(run, MOVES))
    shared.destroy()


def _table_votes(table: DataFrame) -> np.ndarray:
    """``language_votes`` of all rows of a table."""
    toxic = F.sum("toxic")
    own = sorted(r.language for r in table.groupBy("language").agg(F.least(toxic, F.count("*") - toxic).alias("n")).where(F.col("n") >= OWN_ROWS).select("language").collect())
    group = {x: g for g, x in enumerate(own)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(group) + 1, BUCKETS), np.int64)
        rows = np.zeros(len(group) + 1, np.int64)
        for batch in batches:
            for lo in range(0, len(batch), 64):
                own = batch.slice(lo, 64)
                for text, language in zip(own.column(0).to_pylist(), own.column(1).to_pylist(), strict=True):
                    g = group.get(language, len(group))
                    np.add.at(counts[g], np.frombuffer(text, np.int32), 1)
                    rows[g] += 1
        # bucket -1 counts the rows
        for g in np.flatnonzero(rows).tolist():
            at = np.flatnonzero(counts[g])
            columns = [np.full(len(at) + 1, g, np.int32), np.append(-1, at).astype(np.int32), np.append(rows[g], counts[g][at])]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["g", "bucket", "n"])

    got = table.select("rows", "language").mapInArrow(run, "g int, bucket int, n long").groupBy("g", "bucket").agg(F.sum("n").alias("n")).toArrow()
    g, at, n = (got[c].to_numpy() for c in ("g", "bucket", "n"))
    counts = np.zeros((len(group) + 1, BUCKETS))
    word = at >= 0
    counts[g[word], at[word]] = n[word]
    return _votes(counts[[x for x in range(len(group) + 1) if x in set(g[~word].tolist()) or not group]])


def _table_thresholds(table: DataFrame, models: list[Model], usable: list[bool], votes: np.ndarray) -> np.ndarray:
    """Thresholds from the scores that each row has from the model of ``models`` that has not learned from its fold, to a ``BINS``-th."""
    shared = table.sparkSession.sparkContext.broadcast((models, votes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models, votes = shared.value
        for batch in batches:
            for lo in range(0, len(batch), 64):
                own = batch.slice(lo, 64)
                for f in (0, 1):
                    mine = own.filter(pa.array(np.equal(own.column(2).to_numpy(), f)))
                    if len(mine) and usable[f]:
                        texts = [np.frombuffer(t, np.int32) for t in mine.column(0).to_pylist()]
                        at = np.minimum(raw_scores(models[f], texts) * BINS, BINS - 1).astype(np.int32)
                        columns = [pa.array(groups(votes, *_padded(texts)).astype(np.int32)), mine.column(1), pa.array(at)]
                        yield pa.RecordBatch.from_arrays(columns, names=["g", "toxic", "bin"])

    got = table.select("rows", "toxic", "fold").mapInArrow(run, "g int, toxic int, bin int").groupBy("g", "toxic", "bin").agg(F.count("*").alias("n")).orderBy("g", "bin", "toxic").toArrow()
    shared.destroy()
    group, toxic, at, n = (got[c].to_numpy() for c in ("g", "toxic", "bin", "n"))
    return _thresholds((at + 0.5) / BINS, toxic.astype(np.int64), n.astype(float), group, votes.shape[1])


def toxicity_scores(
    docs: DataFrame, labels: DataFrame, cut: float = 0.7, most: int = 12_000, longest: int = 4000, held_out: int = 1, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"
) -> DataFrame:
    """Score every whole text: ``id_col``, ``held_out``, ``score`` (0 to 1), ``predicted`` (1 from ``cut`` on).

    Learns from all rows of ``labels`` (``id_col``, ``toxic``) whose crc32 of the id as text leaves another remainder by 3 than ``held_out``; the
    model has a fixed size. ``most`` and ``longest`` bound only what it starts from (``learned``). Ids, labels, language and
    source columns are not read for a score. The threshold that maps to ``cut`` is that of the text's group of languages, as its words
    tell; which words tell is learned from the same labelled rows and their ``lang_col``, where there is one; thresholds come from scores out of fold of all of them. Null texts count as empty
    and have the score of a text without words. Without labelled rows of both kinds every score is 0. Repeated rows come back as often,
    with the same score; an empty table gives no rows; a null id is not held out.
    """
    scored = _scored(docs.select(id_col, text_col), docs, labels, cut, most, longest, held_out, id_col, text_col, lang_col, "score")
    held = F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(3)) == held_out, F.lit(False))
    return scored.select(id_col, held.alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def _scored(rows: DataFrame, docs: DataFrame, labels: DataFrame, cut: float, most: int, longest: int, held_out: int, id_col: str, text_col: str, lang_col: str, name: str) -> DataFrame:
    """``rows`` with a column ``name`` for the score; the model is learned from ``docs``."""
    table = training_rows(docs, labels, held_out, id_col, text_col, lang_col)
    shared = rows.sparkSession.sparkContext.broadcast(learned(table, most, longest))
    drop(table)
    at, names = rows.columns.index(text_col), [*rows.columns, name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("toxicity", dict)  # other operators' caches go
        scorer = Scorer(shared.value, cut)
        for batch in batches:
            for first, texts in text_blocks(batch.column(at), 2_000_000):
                yield pa.RecordBatch.from_arrays([*batch.slice(first, len(texts)).columns, pa.array(scorer(texts), pa.float64())], names=names)

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField(name, DoubleType())]))


def without_toxic(
    docs: DataFrame, labels: DataFrame, cut: float = 0.7, most: int = 12_000, longest: int = 4000, held_out: int = 1, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"
) -> DataFrame:
    """``docs``, all columns, without the rows that ``toxicity_scores`` gives a score of ``cut`` or more. Rows are judged where they are read;
    none moves. Null and empty texts, and rows without an id, are judged as others are; repeated rows go or stay together."""
    name = free_name(docs, "score")
    return _scored(docs, docs, labels, cut, most, longest, held_out, id_col, text_col, lang_col, name).where(F.col(name) < cut).drop(name)
