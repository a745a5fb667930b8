"""A hidden Markov language model: Baum-Welch counts summed over partitions, likelihoods by the scaled forward recursion.

States emit classes of words. The ``OWN`` most frequent words and the end of a text are classes of their own; every
other word belongs to one of ``FORMS`` classes by its last three bytes, and within that class its share comes from its
count, one being added to each and one kept for words that were never seen.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, worker_cache
from .words import text_blocks

#: Words with a class each, classes of the others, and words whose counts every task knows.
OWN, FORMS, KNOWN = 4096, 256, 65_536
#: Hidden states, and tokens of a segment; segments of all texts are worked on side by side.
STATES, SEGMENT = 8, 128
#: Segments that are worked on together.
TOGETHER = 4000
#: Texts with a segment in one place that go on abreast, token by token; fewer are cut into segments that don't wait for each other.
WIDE = 64
CLASSES = 1 + OWN + FORMS
#: Bytes of text whose words are counted before they leave a task.
COUNT_BYTES = 16_000_000


def form(word: bytes) -> int:
    return 1 + OWN + zlib.crc32(word[-3:]) % FORMS


@dataclass
class Model:
    start: np.ndarray
    move: np.ndarray
    #: (CLASSES, STATES)
    emit: np.ndarray


def segments(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Classes in rows of ``SEGMENT``, filled up with -1; which text each row is of; whether it is that text's first."""
    rows = [np.append(x, np.full(-len(x) % SEGMENT, -1, x.dtype)).reshape(-1, SEGMENT) for x in texts]
    owner = np.repeat(np.arange(len(texts)), [len(x) for x in rows])
    first = np.append(True, owner[1:] != owner[:-1])
    return np.concatenate(rows).astype(np.int32), owner, first


def _emitted(model: Model, column: np.ndarray) -> np.ndarray:
    return model.emit[np.maximum(column, 0)]


def transfers(model: Model, rows: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What each segment does to the states before it, as a scaled matrix, and the logarithm of the scale."""
    n, s = len(rows), STATES
    lengths = (rows >= 0).sum(axis=1)
    order = np.argsort(-lengths, kind="stable")
    rows, first, lengths = rows[order], first[order], lengths[order]
    matrix = np.broadcast_to(np.eye(s, dtype=model.move.dtype), (n, s, s)).copy()
    scale = np.zeros(n)
    for t in range(SEGMENT):
        m = int(np.searchsorted(-lengths, -t, side="left"))  # segments with a token here
        if not m:
            break
        step = (matrix[:m].reshape(-1, s) @ model.move).reshape(m, s, s)
        if t == 0:
            step[first[:m]] = model.start
        step *= _emitted(model, rows[:m, t])[:, None, :]
        if t % 4 == 3 or t == SEGMENT - 1 or m < n:
            top = step.max(axis=(1, 2))
            step /= top[:, None, None]
            scale[:m] += np.log(top)
        matrix[:m] = step
    top = matrix.max(axis=(1, 2))
    back = np.empty_like(order)
    back[order] = np.arange(n)
    return (matrix / top[:, None, None])[back], (scale + np.log(top))[back]


class Abreast:
    """Segments that are worked on side by side, the longest first, with their tokens one step after the other: ``sizes`` of the steps, ``classes`` and,
    by state, what each class's emission is."""

    def __init__(self, model: Model, rows: np.ndarray, at: np.ndarray):
        self.at, by_step = at, rows[at].T
        on = by_step >= 0
        self.sizes, self.classes = on.sum(axis=1).tolist(), by_step[on]
        self.emitted = np.take(np.ascontiguousarray(model.emit.T), self.classes, axis=1)

    def ahead(self, model: Model, before: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The states' shares after each segment, and the logarithm of its probability. ``alpha`` keeps the shares after each token; emissions are divided by the token's probability."""
        self.alpha, end, v, log = np.empty_like(self.emitted), 0, before, np.zeros(len(self.at))
        for t, m in enumerate(self.sizes):
            if not m:
                break
            emitted, alpha = self.emitted[:, end : end + m], self.alpha[:, end : end + m]
            np.matmul(model.move.T, v[:, :m], out=alpha)
            if t == 0:
                alpha[:, first] = model.start[:, None]
            norm = np.einsum("sn,sn->n", alpha, emitted)
            emitted /= norm
            alpha *= emitted
            log[:m] += np.log(norm)
            v = alpha if m == v.shape[1] else np.concatenate([alpha, v[:, m:]], axis=1)
            end += m
        return v, log

    def back(self, model: Model, before: np.ndarray, after: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Expected starts, moves and emissions, and what follows the segments before these: the likelihoods by state, the largest being 1. After ``ahead``."""
        end, beta, pairs = len(self.classes), after, np.zeros((STATES, STATES))
        gamma = np.empty_like(self.alpha)
        for t in reversed(range(SEGMENT)):
            m = self.sizes[t]
            if not m:
                continue
            end -= m
            own = beta[:, :m]
            shares = np.multiply(self.alpha[:, end : end + m], own, out=gamma[:, end : end + m])
            norm = 1 / shares.sum(axis=0)
            shares *= norm
            came = self.emitted[:, end : end + m] * own
            # the emissions being divided by the tokens' probabilities, ``norm`` makes the pairs of states add up to 1 as well
            if t:
                before_it = end - self.sizes[t - 1]
                pairs += self.alpha[:, before_it : before_it + m] @ (came * norm).T
            else:
                pairs += np.where(first, 0, before) @ np.where(first, 0, came * norm).T
            came = model.move @ came
            came /= came.max(axis=0)
            beta = came if m == beta.shape[1] else np.concatenate([came, beta[:, m:]], axis=1)
        start = gamma[:, : len(self.at)][:, first].sum(axis=1)
        emit = np.stack([np.bincount(self.classes, g, CLASSES) for g in gamma])
        return start, model.move * pairs, emit, beta


def _places(rows: np.ndarray, owner: np.ndarray, first: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Segment numbers of the texts' first segments, second ones and so on, the longest first: as long as ``WIDE`` texts have one, and those of the other places."""
    starts = np.flatnonzero(first)
    place = np.arange(len(owner)) - np.repeat(starts, np.diff(np.append(starts, len(owner))))
    order = np.lexsort((-(rows >= 0).sum(axis=1), place))
    sizes = np.bincount(place)
    parts = np.split(order, np.cumsum(sizes)[:-1])
    wide = int((sizes >= WIDE).sum())
    return parts[:wide], parts[wide:]


def forward(model: Model, rows: np.ndarray, owner: np.ndarray, first: np.ndarray, counted: bool = False) -> tuple[np.ndarray, np.ndarray, list[tuple[Abreast, np.ndarray]]]:
    """Natural logarithm of each text's probability; the states' shares before each segment (by state); with ``counted``, segments
    that have gone ahead together, and what follows each of the last of them.

    Places that many texts have go one after the other, all texts abreast; those that only a few long texts have by matrices, all of them at a time.
    """
    wide, narrow = _places(rows, owner, first)
    total = np.zeros(owner[-1] + 1)
    before = np.full((STATES, len(rows)), 1 / STATES, model.move.dtype)
    last = np.append(first[1:], True)
    held = []
    for at in wide:
        group = Abreast(model, rows, at)
        v, log = group.ahead(model, before[:, at], first[at])
        total[owner[at]] += log
        more = np.flatnonzero(~last[at])
        before[:, at[more] + 1] = v[:, more]
        if counted:
            held.append((group, None))
    if not narrow:
        return total, before, held
    rest = np.concatenate(narrow)
    rest = rest[np.argsort(-(rows[rest] >= 0).sum(axis=1), kind="stable")]
    matrix, scale = transfers(model, rows[rest], first[rest])
    np.add.at(total, owner[rest], scale)
    where = np.zeros(len(rows), int)
    where[rest] = np.arange(len(rest))
    for at in narrow:
        v = np.einsum("sn,nst->tn", before[:, at], matrix[where[at]])
        norm = v.sum(axis=0)
        total[owner[at]] += np.log(norm)
        more = np.flatnonzero(~last[at])
        before[:, at[more] + 1] = v[:, more] / norm[more]
    if counted:
        after = np.ones((STATES, len(rows)), model.move.dtype)
        for at in reversed(narrow[1:]):
            x = np.einsum("nst,tn->sn", matrix[where[at]], after[:, at])
            after[:, at - 1] = x / x.max(axis=0)
        group = Abreast(model, rows, rest)
        group.ahead(model, before[:, rest], first[rest])
        held.append((group, after[:, rest]))
    return total, before, held


def expected(model: Model, rows: np.ndarray, owner: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Expected starts, moves and emissions, and the log-likelihood."""
    total, before, held = forward(model, rows, owner, first, counted=True)
    start, move, emit = np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros((STATES, CLASSES))
    after = np.ones((STATES, len(rows)), model.move.dtype)
    while held:
        group, known = held.pop()
        at = group.at
        *sums, beta = group.back(model, before[:, at], after[:, at] if known is None else known, first[at])
        for s, x in zip((start, move, emit), sums, strict=True):
            s += x
        more = np.flatnonzero(~first[at])
        after[:, at[more] - 1] = beta[:, more]
    return start, move, emit, float(total.sum())


def for_counts(model: Model) -> Model:
    """The model in single precision, each class's emissions relative to its likeliest state: expected counts are the same, likelihoods are not."""
    return Model(model.start.astype(np.float32), model.move.astype(np.float32), (model.emit / model.emit.max(axis=1, keepdims=True)).astype(np.float32))


def re_estimated(start: np.ndarray, move: np.ndarray, emit: np.ndarray, prior: np.ndarray) -> Model:
    """``prior``: the classes' shares, which count as one token for each state."""
    start, move, emit = start + 0.1, move + 0.1, emit + prior
    return Model(start / start.sum(), move / move.sum(axis=1, keepdims=True), np.ascontiguousarray((emit / emit.sum(axis=1, keepdims=True)).T))


def started(texts: list[np.ndarray], prior: np.ndarray, rounds: int = 12, seed: int = 3) -> Model:
    """A first model from some texts: each state's emissions are the texts' own, unevenly weighted; moves favour staying."""
    rng = np.random.default_rng(seed)
    group = rng.integers(0, STATES, len(texts))
    emit = np.stack([np.bincount(np.concatenate([texts[k] for k in np.flatnonzero(group == s)] or [np.zeros(0, int)]), minlength=CLASSES) + 0.0 for s in range(STATES)])
    model = re_estimated(np.ones(STATES), np.eye(STATES) * 50 + 1, emit + 50 * prior, prior)
    for _ in range(rounds if texts else 0):
        sums = [np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros((STATES, CLASSES))]
        for part in _together(texts):
            for held, x in zip(sums, expected(model, *segments(part)), strict=False):
                held += x
        model = re_estimated(*sums, prior)
    return model


def _together(texts: list[np.ndarray]) -> Iterator[list[np.ndarray]]:
    held, size = [], 0
    for x in texts:
        held.append(x)
        size += -(-len(x) // SEGMENT)
        if size >= TOGETHER:
            yield held
            held, size = [], 0
    if held:
        yield held


def token_counts(docs: DataFrame, text_col: str) -> DataFrame:
    """``word`` (the end of a text is the empty one) and ``n``. Words are counted in the task before they are dealt out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("hmm", dict)  # other operators' caches go
        for batch in batches:
            for _, texts in text_blocks(batch.column(0), COUNT_BYTES):
                counts = Counter({b"": len(texts)})
                for text in texts:
                    counts.update(text.lower().split())
                yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    return docs.select(text_col).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent(counts: DataFrame, most: int) -> list:
    """The most frequent words, about ``most`` and no more: a histogram of counts by eighths of powers of two shows where the cut is, and of the
    class in which it falls a hash chooses, so no task sends many words that aren't wanted."""
    step = F.floor(F.log2("n") * 8).cast("int")
    sizes = sorted(((r.s, r.c) for r in counts.groupBy(step.alias("s")).agg(F.count("*").alias("c")).collect()), reverse=True)
    taken, wanted = 0, F.lit(False)
    for s, c in sizes:
        # all above the class in which the cut falls, so the condition is as short for many classes as for one
        wanted = (step > s) | ((step == s) & (F.pmod(F.xxhash64("word"), F.lit(1 << 30)) < int(min(1.0, (most - taken) / c) * (1 << 30))))
        taken += c
        if taken >= most:
            break
    return sorted(counts.where(wanted).collect(), key=lambda r: (-r.n, bytes(r.word)))[:most]


class Numbers(dict):
    """Number by known word; that of another word's form, the word being kept in ``rare``."""

    def __missing__(self, word: bytes) -> int:
        self.rare.append(word)
        return self.forms + zlib.crc32(word[-3:]) % FORMS


class Coder:
    """Classes of a text's tokens in a worker."""

    def __init__(self, known: list[tuple[bytes, int]]):
        self.size = len(known)
        # number of a token: 0 the end, then known words by frequency, then forms
        self.number = Numbers((w, k) for k, (w, _) in enumerate(known))
        self.number.forms = self.size
        self.log = np.log10(np.array([n for _, n in known] + [0] * FORMS, float) + 1)
        code = np.arange(self.size + FORMS)
        code[OWN + 1 :] = [form(w) for w, _ in known[OWN + 1 :]] + list(range(1 + OWN, CLASSES)) if self.size > OWN else 0
        if self.size <= OWN + 1:
            code[self.size :] = np.arange(1 + OWN, CLASSES)
        self.code = code.astype(np.uint16)

    def __call__(self, text: bytes) -> tuple[np.ndarray, list[bytes]]:
        """Numbers of the tokens and the words without a number of their own."""
        words = text.lower().split()
        self.number.rare = rare = []
        found = np.zeros(len(words) + 1, np.int64)
        found[:-1] = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))
        return found, rare


def hmm_scores(docs: DataFrame, passes: int = 2, start_docs: int = 1000, longest: int = 2000, divisor: int = 7, held_out: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score every whole text: ``id_col``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``
    (log10 by add-one counts of single tokens) and ``score`` (log10 by the hidden Markov model).

    Learns from rows whose crc32 of the id as text leaves another remainder by ``divisor`` than ``held_out``. Tokens are words
    (A-Z in lower case, ending at ASCII white space) and one end; null texts count as empty. All training tokens are
    counted; ``passes`` Baum-Welch passes go over all of them, starting from a model of about ``start_docs`` texts of a hash's choice
    among those of ``longest`` tokens at most, which only sets where the passes begin. Tasks know the ``KNOWN`` most frequent
    words; counts of the others are joined by a 64-bit hash, and none of them is frequent enough to pile up. A row without an id is in training. Repeated rows count as often;
    an empty table gives no rows; other columns are not read.
    """
    import xxhash

    spark = docs.sparkSession
    key = F.col(id_col)
    held = F.coalesce(F.pmod(F.crc32(key.cast("string")), F.lit(divisor)) == held_out, F.lit(False))
    base = docs.select(key, F.col(text_col).alias("text"), held.alias("held_out"))
    counts = materialize(token_counts(base.where(~F.col("held_out")), "text"), "counts")
    total = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    tokens, distinct = total.n or 0, total.v
    top = frequent(counts.where("word <> X''"), KNOWN)
    ends = counts.where("word = X''").first()
    known = [(b"", ends.n if ends else 0), *((bytes(r.word), r.n) for r in top)]
    by_form = [(0, 0)] * FORMS
    # the forms' counts: of all words less those that are classes of their own
    forms = counts.where("word <> X''").groupBy(F.pmod(F.crc32(F.substring("word", -3, 3)), F.lit(FORMS)).cast("int").alias("f")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()
    for r in forms:
        by_form[r.f] = (r.n, r.v)
    for w, n in known[1 : OWN + 1]:
        k = form(w) - 1 - OWN
        by_form[k] = (by_form[k][0] - n, by_form[k][1] - 1)
    sizes = np.array([n + v + 1 for n, v in by_form], float)
    share = np.zeros(CLASSES)
    share[: min(len(known), OWN + 1)] = [n for _, n in known[: OWN + 1]]
    share[1 + OWN :] = [n for n, _ in by_form]
    share = (share + 1) / (share.sum() + CLASSES)
    table = spark.sparkContext.broadcast(known)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("hmm", dict)  # other operators' caches go
        coder, digest, row = Coder(table.value), xxhash.xxh64_intdigest, TaskContext.get().partitionId() << 40
        in_class = np.append(np.arange(coder.size) > OWN, np.zeros(FORMS, bool))
        for batch in batches:
            for first, texts in text_blocks(batch.column(1)):
                out, rare_all, sizes_ = [], [], []
                for text in texts:
                    number, rare = coder(text)
                    log = coder.log[number]
                    out.append((row, len(number), len(number) - len(rare), float(log.sum()), float(log[in_class[number]].sum()), coder.code[number].astype("<u2").tobytes()))
                    rare_all += [digest(w, 42) for w in rare]
                    sizes_.append(len(rare))
                    row += 1
                columns = [pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary()), strict=True)]
                rare_column = pa.ListArray.from_arrays(np.append(0, np.cumsum(sizes_)).astype(np.int32), pa.array(np.array(rare_all, np.uint64).view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), batch.column(2).slice(first, len(texts)), *columns, rare_column], names=["id", "held_out", "row", "n_tokens", "n_known", "log", "log_in_class", "classes", "rare"])

    kind = docs.schema[id_col].dataType.simpleString()
    coded = materialize(base.select(key, "text", "held_out").mapInArrow(encode, f"id {kind}, held_out boolean, row long, n_tokens long, n_known long, log double, log_in_class double, classes binary, rare array<long>"), "coded")

    train = coded.where("not held_out").select("classes")
    # a hash below a bound set by the number of rows, so a task sends few rows however many there are
    fit = coded.where(~F.col("held_out") & (F.col("n_tokens") <= longest))
    bound = int(min(1.0, start_docs / max(1, fit.count())) * (1 << 30))
    begin = fit.where(F.pmod(F.xxhash64("id", "row"), F.lit(1 << 30)) < bound).select("row", "classes").collect()
    texts = [np.frombuffer(bytes(r.classes), "<u2").astype(np.int64) for r in sorted(begin, key=lambda r: r.row)]
    model = started(texts, share)
    for _ in range(passes if texts else 0):
        shared = spark.sparkContext.broadcast(model)

        def gather(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            sums, single = np.zeros(STATES + STATES * STATES + STATES * CLASSES), for_counts(shared.value)
            for batch in batches:
                for part in _together([np.frombuffer(x.as_buffer(), "<u2") for x in batch.column(0)]):
                    sums += np.concatenate([x.ravel() for x in expected(single, *segments([x.astype(np.int32) for x in part]))[:3]])
            own = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(sums[own])], names=["cell", "x"])

        cells = train.mapInArrow(gather, "cell int, x double").groupBy("cell").agg(F.sum("x").alias("x")).collect()
        sums = np.zeros(STATES + STATES * STATES + STATES * CLASSES)
        sums[[r.cell for r in cells]] = [r.x for r in cells]
        a, b = STATES, STATES + STATES * STATES
        model = re_estimated(sums[:a], sums[a:b].reshape(STATES, STATES), sums[b:].reshape(STATES, CLASSES), share)
    shared = spark.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        log_size = np.append(np.zeros(1 + OWN), np.log10(sizes))
        for batch in batches:
            out = []
            for part in _together([np.frombuffer(x.as_buffer(), "<u2") for x in batch.column(5)]):
                total, _, _ = forward(shared.value, *segments([x.astype(np.int32) for x in part]))
                out += [t / np.log(10) - log_size[x].sum() for t, x in zip(total, part, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(5)), pa.array(np.array(out) + batch.column(6).to_numpy(), pa.float64())], names=["id", "held_out", "row", "n_tokens", "n_known", "score"])

    names = ["id", "held_out", "row", "n_tokens", "n_known", "classes", "log_in_class"]
    scored = coded.select(*names[:5], "classes", "log_in_class").mapInArrow(score, f"id {kind}, held_out boolean, row long, n_tokens long, n_known long, score double")
    scored = scored.join(coded.select("row", "log"), "row")
    # what the words that tasks don't know add: nothing, where they were never seen
    rest = counts.select(F.xxhash64("word").alias("h"), "n")
    rare = coded.select("row", F.explode("rare").alias("h")).join(rest, "h")
    rare = rare.groupBy("row").agg(F.sum(F.log10(F.col("n") + 1)).alias("more"), F.count("*").alias("seen"))
    more, unit = F.coalesce("more", F.lit(0.0)), F.log10(F.lit(float(tokens + distinct + 1)))
    return scored.join(rare, "row", "left").select(
        F.col("id").alias(id_col), "held_out", "n_tokens", (F.col("n_known") + F.coalesce("seen", F.lit(0))).alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("log") + more - F.col("n_tokens") * unit).alias("base_score"), (F.col("score") + more).alias("score"),
    )
