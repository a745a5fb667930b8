"""Operators against brute force, exact round trips and hand-made cases, with nulls, empty and repeated rows, and extra columns."""

from __future__ import annotations

import base64
import collections
import hashlib
import itertools
import os
import random
import time
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from firnspark.llm import ann, bpe, chat, common, graph, hmm, langid, minhash, packing, queries, simhash, substrings, toxicity, words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, id long"


def documents(spark, texts, langs=None):
    return spark.createDataFrame([(k, t, (langs or {}).get(k), "s", len(t or ""), 0.5, 1) for k, t in enumerate(texts)], SCHEMA)


def sentence(rng, n, stem="w", size=400):
    return " ".join(f"{stem}{rng.randrange(size)}" for _ in range(n))


def near_texts():
    rng = random.Random(4)
    base = [sentence(rng, 80) for _ in range(12)]
    texts = [None, "", " \n ", "one", "ONE", "two words"]
    for b in base:
        for _ in range(4):
            w = b.split()
            for _ in range(rng.randrange(6)):
                w[rng.randrange(len(w))] = f"x{rng.randrange(99)}"
            texts.append(" ".join(w))
    return [*texts, base[0], base[0].upper()]


def test_near_duplicates_against_all_pairs(spark):
    texts = near_texts()
    got = {r.doc_id: r for r in minhash.near_duplicates(documents(spark, texts), size=2).collect()}
    sets = {}
    for k, t in enumerate(texts):
        w = (t or "").encode().lower().split()
        sets[k] = frozenset(zip(w, w[1:], strict=False)) if len(w) > 1 else frozenset(w)
    parent = {k: k for k in sets}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    assert {k: (r.n_shingles, r.component_id, r.kept) for k, r in got.items()} == {k: (len(sets[k]), root(k), root(k) == k) for k in sets}


def brute_force_components(texts, size=2):
    """Component by place, by all pairs of full sets."""
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        n = min(size, len(w))
        sets.append(frozenset(zip(*(w[k:] for k in range(n)), strict=False)) if n else frozenset())
    parent = list(range(len(sets)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for j, k in itertools.combinations(range(len(sets)), 2):
        both = len(sets[j] & sets[k])
        if both and 100 * both >= 80 * (len(sets[j]) + len(sets[k]) - both):
            x, y = sorted((root(j), root(k)))
            parent[y] = x
    return [root(k) for k in range(len(sets))]


def test_single_links_into_a_crowd(spark):
    rng = random.Random(21)
    base = [f"w{k}" for k in range(500)]
    texts = []
    for _ in range(60):
        w = base.copy()
        for at in rng.sample(range(500), 5):
            w[at] = f"x{rng.randrange(10**6)}"
        texts.append(w)
    for k in range(600):  # one stretch is changed so that it is just near enough to one of the copies, or to few
        w = texts[k % 60].copy()
        at, n = rng.randrange(380), rng.choice((52, 53, 54, 55, 58))
        w[at : at + n] = [f"y{rng.randrange(10**6)}" for _ in range(n)]
        texts.append(w)
    texts = [" ".join(w) for w in texts]
    want = brute_force_components(texts)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(documents(spark, texts), size=2).collect()}
    assert len(set(want)) > 20 and [got[k] for k in range(len(texts))] == want


def test_regions_that_lie_across_tasks(spark):
    rng = np.random.default_rng(3)
    sig = rng.integers(0, 1 << 16, minhash.MINIMA).astype("<u2").tobytes()
    for n, parts in ((40, 30), (20, 3), (400, 50)):
        reps = spark.createDataFrame([(k, bytearray(sig)) for k in range(n)], "id long, sig binary")
        pairs, crowded = minhash.candidate_pairs(reps, parts)
        inside = collections.defaultdict(set)
        for r in crowded.collect():
            inside[r.b].add(r.a)
        found = {(r.a, r.b) for r in pairs.collect()}
        met = found | {p for own in inside.values() for p in itertools.combinations(sorted(own), 2)}
        assert met == set(itertools.combinations(range(n), 2))


def test_crowded_region_is_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "ACROSS", (2400, 4000))
    full = {k: np.sort(np.arange(100, dtype=np.uint64) + np.uint64(k * 10)) for k in range(12)}
    sets = spark.createDataFrame([(k, bytearray(128), bytearray(v.astype("<u8").tobytes())) for k, v in full.items()], "id long, sig binary, full binary")
    rows = spark.createDataFrame([(1, k, k) for k in full], "g long, id long, component long")
    got = {(r.a, r.b) for r in minhash._across(rows, rows, sets, 80).collect()}
    assert got == {(k, k + 1) for k in range(11)}


def test_near_duplicates_with_repeated_and_null_ids(spark):
    rng = random.Random(5)
    one, other = sentence(rng, 60), sentence(rng, 60)
    rows = [(1, one), (1, one), (2, other), (2, one + " end"), (None, one), (3, other), (4, None), (5, " ".join(f"v{k}" for k in range(200_000)))]
    docs = spark.createDataFrame([(k, t, 1, b"x") for k, t in rows], "doc_id long, text string, component_id int, sig binary")
    got = collections.Counter((r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(docs, size=2).collect())
    assert got == {(1, 1, True): 2, (2, 1, False): 2, (None, None, True): 1, (3, 1, False): 1, (4, 4, True): 1, (5, 5, True): 1}


def test_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 101), (101, 102), (7, 7)]
    got = {r.id: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, **{k: 100 for k in (100, 101, 102)}}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_shared_passages(spark):
    rng = random.Random(1)
    passage = sentence(rng, 70, "p")
    edited = passage.split()
    edited[30], edited[50] = "other", "words"
    texts = [sentence(rng, 50) + " " + passage + " " + sentence(rng, 30), None, "", sentence(rng, 200, "q"), sentence(rng, 10, "r") + " " + passage, " ".join(edited) + " " + sentence(rng, 40, "s"), "a " * 3000]
    docs = documents(spark, texts)
    spans = substrings.shared_passages(docs)
    got = {r.doc_id: r for r in spans.collect()}
    assert set(got) == {4, 5}
    assert (got[4].start, got[4].n_words, got[4].other_id, got[4].other_start, got[4].n_equal) == (10, 70, 0, 50, 70)
    assert (got[5].start, got[5].n_words, got[5].n_equal) == (0, 70, 68)
    kept = {r.doc_id: r.text for r in substrings.without_passages(docs, spans).collect()}
    assert set(kept) == set(range(7)) and kept[0] == texts[0] and kept[1] is None
    assert kept[4].split() == texts[4].split()[:10] and kept[5].split() == texts[5].split()[70:]


def test_chains_and_alignment():
    pb, pa_ = np.array([0, 3, 6, 40, 43]), np.array([10, 13, 16, 52, 55])
    found = substrings.anchors(pb, pa_)
    assert [sorted(c) for c in substrings.chains(found)] == [[0, 1]]
    x, y = np.arange(60, dtype=np.uint64), np.delete(np.arange(60, dtype=np.uint64), [20])
    partner = substrings.align(x, y, np.array([[0, 0, 10], [40, 39, 20]]))
    assert partner[20] == -1 and (partner >= 0).sum() == 59
    tree = substrings.PrefixMax(8)
    for key, score in ((5, 2.0), (1, 1.0), (3, 9.0)):
        tree.put(key, score, key)
    assert [tree.up_to(k)[1] for k in (0, 1, 2, 4, 7)] == [-1, 1, 1, 3, 3]


def test_words_of_a_block_are_hashed_together():
    """The hashes and counts of texts one by one, whatever the words' lengths and the white space at their ends; no word is looked up by itself but for very long ones."""
    rng = random.Random(31)
    texts = [b"", b" \n", "\x0b\u00c4bc\x1cd  E\te ".encode(), b"a" * 31 + b" " + b"B" * 32 + b"\r" + b"c" * 1000]
    for _ in range(200):
        texts.append(rng.choice(["", " ", "\f"]).join(" " * rng.randrange(3) + rng.choice("xYz\u00e9\u4e2d") * rng.randrange(1, 45) for _ in range(rng.randrange(20))).encode())
    for own in (texts, texts[::-1], [b""], [b"", b" "]):
        h = words.WordHashes()
        plain = [h.of(t) for t in own]
        got, counts = words.block_hashes(own)
        assert counts.tolist() == [len(x) for x in plain] and got.tolist() == np.concatenate(plain).tolist()


def test_seeds_of_a_block_are_those_of_each_text():
    """Against a plain search of each window of each text, with short, empty and periodic ones; texts beside each other share no seed."""

    def plain(own):
        values = words.shingles(own, substrings.KMER).tolist() if len(own) >= substrings.KMER else []
        at = []
        for s in range(max(1, len(values) - substrings.WINDOW + 1) if values else 0):
            window = values[s : s + substrings.WINDOW]
            if not at or at[-1] != s + window.index(min(window)):
                at.append(s + window.index(min(window)))
        found, run = [], 0
        for k, p in enumerate(at):
            run = run + 1 if k and values[p] == values[at[k - 1]] else 0
            found.append(int(words.mix(np.array([values[p] + run & (1 << 64) - 1], np.uint64))[0]) if run else values[p])
        long = words.shingles(np.array(found, np.uint64), substrings.RUN).tolist() if len(found) >= substrings.RUN else []
        return sorted([*zip(found, at, strict=True), *((v, p) for v, p in zip(long, at, strict=False) if v % substrings.SHARE == 0)])

    rng = np.random.default_rng(32)
    for _ in range(60):
        texts = [rng.integers(0, rng.choice([1, 2, 3, 1000]), rng.choice([0, 1, 4, 5, 6, 13, 14, 15, 40, 120])).astype(np.uint64) for _ in range(rng.integers(1, 8))]
        text, values, at = substrings.block_seeds(np.concatenate(texts), np.array([len(t) for t in texts]))
        for k, own in enumerate(texts):
            assert sorted(zip(values[text == k].tolist(), at[text == k].tolist(), strict=True)) == plain(own)
        assert (np.diff(text) >= 0).all() and all((np.diff(at[text == k]) >= 0).all() for k in range(len(texts)))


def test_common_subsequences_and_equal_words():
    """Partners are those of the plain table: of ways of one length, the last equal words first, then what the word of x doesn't need is left out. Equal words are counted slice by slice."""
    rng = np.random.default_rng(33)
    for _ in range(400):
        x, y = (rng.integers(0, rng.integers(1, 30), rng.integers(0, 70)).astype(np.uint64) for _ in range(2))
        table = np.zeros((len(x) + 1, len(y) + 1), int)
        for i, j in itertools.product(range(len(x)), range(len(y))):
            table[i + 1, j + 1] = table[i, j] + 1 if x[i] == y[j] else max(table[i, j + 1], table[i + 1, j])
        i, j, pairs = len(x), len(y), []
        while i and j:
            if x[i - 1] == y[j - 1]:
                i, j = i - 1, j - 1
                pairs.append((i, j))
            elif table[i - 1, j] >= table[i, j - 1]:
                i -= 1
            else:
                j -= 1
        assert list(zip(*substrings._matches(x, y), strict=True)) == pairs[::-1]
    sides = [[rng.integers(0, 12, n).astype(np.uint64) for n in rng.integers(0, 9, 300)] for _ in range(2)]
    args = [a for own in sides for a in (np.concatenate(own), np.append(0, np.cumsum([len(x) for x in own])))]
    assert substrings._equal_words(*args).tolist() == [int(np.isin(x, y).sum()) for x, y in zip(*sides, strict=True)]


def test_byte_bpe(spark):
    tiktoken = pytest.importorskip("tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    coder = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = [None, "", "Hello  world\n\n x", "aaaaaaaaaaaaaaaaaaa" * 50, "naïve — ünïcode　 x 12345 don't", "a\tb \n c", "<|endoftext|>"]
    for r in bpe.bpe_digests(documents(spark, texts), queries.RANKS, P.PATTERN).collect():
        ids = coder.encode_ordinary(texts[r.doc_id] or "")
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()


def test_packing(spark):
    texts = [None, "", "some words", "long text " * 5000, *["short one"] * 40]
    got = packing.pack_best_fit(documents(spark, texts), queries.TOKENIZER, P.PATTERN).collect()
    bins = collections.defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for v in bins.values():
        v.sort()
        assert v[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(v, v[1:], strict=False)) and sum(n for _, n in v) <= 2048
    assert {r.doc_id for r in got} == set(range(len(texts)))
    assert len(bins) == -(-sum(r.length for r in got) // 2048)


def test_packed_ids_are_those_of_the_tokenizers_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    coder, rng = tokenizers.Tokenizer.from_file(queries.TOKENIZER), random.Random(7)
    parts = ["<|endoftext|>", "<|endoftext", " ", "\n", "  ", "a", "é", "\0", "\u3000", "\x1c", "word", "'s", "1", "漢", "\t", ".", "½", "\x85", " other,words"]
    texts = [None, "", "end <|endoftext|> of", "<|endoftext|>" * 3000, *("".join(rng.choice(parts) for _ in range(rng.randrange(1, 60))) for _ in range(300)), "x " * 5000]
    docs = documents(spark, texts)
    docs = docs.unionByName(docs.where("doc_id = 2")).unionByName(docs.where("doc_id = 5").withColumn("doc_id", F.lit(None).cast("long")))
    got = collections.defaultdict(list)
    for r in packing.pack_best_fit(docs, queries.TOKENIZER, P.PATTERN).collect():
        got[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
    for k, t in [*enumerate(texts), (None, texts[5])]:
        ids = np.array([*coder.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        first = len(ids) % 2048 or 2048
        starts = [0, *range(first, len(ids), 2048)]
        want = [(i, s, e - s, zlib.crc32(ids[s:e].tobytes())) for i, (s, e) in enumerate(zip(starts, [*starts[1:], len(ids)], strict=True))]
        assert sorted(got[k]) == sorted(want * (2 if k == 2 else 1))


def test_encoder_keeps_pieces_that_are_met_again():
    coder = packing.TokenizerIds(queries.TOKENIZER, P.PATTERN)
    texts = [f"alpha beta, {k} gamma\nx{k}y" for k in range(60)]
    whole = coder.encode(texts)
    coder.texts.limit = 10
    assert [x for t in texts for x in coder.encode([t])] == whole


def test_a_written_table_leaves_no_shuffle_files(spark):
    dirs = list(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())

    def files():
        return {f for d in dirs for _, _, names in os.walk(d) for f in names if f.startswith("shuffle_")}

    setting, before = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", files()
    was = spark.conf.get(setting)
    shuffled = spark.range(5000).repartition(3, "id").join(spark.range(4000).hint("merge"), "id").groupBy("id").count()
    table = common.materialize(shuffled, "shuffled")
    end = time.time() + 10
    while files() - before and time.time() < end:
        time.sleep(0.1)
    assert not files() - before and spark.conf.get(setting) == was
    assert table.count() == shuffled.count() == 4000  # what was written, and the plan again


def test_encoder_looks_a_piece_of_a_block_up_once():
    class Counted(dict):
        gets = 0

        def __getitem__(self, key):
            self.gets += 1
            return super().__getitem__(key)

    coder = packing.TokenizerIds(queries.TOKENIZER, P.PATTERN)
    coder.texts.pieces, asked, tokenize = Counted(), [], coder.tokenize
    coder.tokenize = lambda p: asked.append(p) or tokenize(p)
    texts = ["alpha alpha, Alpha. beta! alpha's" + " alpha beta," * 2000] * 3
    assert coder.encode(texts) == [np.array(coder.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert coder.texts.pieces.gets < 20 and len(asked) == len(set(asked)) < 15


def test_encoder_of_words_with_marks():
    coder, rng = packing.TokenizerIds(queries.TOKENIZER, P.PATTERN), random.Random(17)
    parts = ["word", "Élan", "ß", "漢字", "e\u0301", "n3", "ªº", "<|endoftext", "'s", "'", "’", "...", "!?", "|", "_", "-", "\\", '"', "…", "€", "\x85", "\xa0", "\x00", "ÿ", "\xff", " ", " ", "\n", "\t", "  "]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(3000)]
    for some in (["", ""], [" "], ["\n"], ["  "], texts, texts[::-1], [texts[0]]):
        assert coder.encode(some) == [np.array(coder.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in some]
        coder.texts.limit = 500


def test_best_fit_plan_packs_each_piece_once():
    rng = random.Random(2)
    histogram = {n: rng.randrange(1, 9) for n in rng.sample(range(1, 101), 40)}
    rows, bins = packing.best_fit_plan(histogram, 100)
    fill, count = collections.Counter(), collections.Counter()
    for length, _, copies, sequence, offset, many in sorted(rows, key=lambda r: r[4]):
        for k in range(many):
            assert fill[sequence + k] == offset
            fill[sequence + k] += copies * length
        count[length] += copies * many
    assert count == histogram and max(fill.values()) <= 100 and len(fill) == bins


def test_chat(spark):
    hard = ["</s>[INST] ok [/INST]", "\\b\\e \\", "", None, "plain"]
    turns = spark.createDataFrame([(1, k, "assistant" if k % 2 else "user", t, "x") for k, t in enumerate(hard)], "conv_id long, turn long, role string, text string, formatted string")
    r = chat.format_chat(turns).withColumn("loss", chat.loss_text()).withColumn("back", chat.parse(F.col("formatted"))).first()
    assert r.round_trip and r.n_turns == 5 and r.loss == "\\b\\e \\"
    assert [(t.role, t.text) for t in r.back] == [("assistant" if k % 2 else "user", t or "") for k, t in enumerate(hard)]


def test_simhash(spark):
    texts = ["alpha beta gamma delta epsilon zeta " * 5, "alpha beta gamma delta epsilon zeta " * 5, None, "", "other words entirely here now"]
    got = {r.doc_id: r for r in simhash.edited_fingerprints(documents(spark, texts)).collect()}
    assert got[0].fingerprint == got[1].fingerprint and got[1].near_next == 1.0 and got[2].fingerprint == got[3].fingerprint
    for k, r in got.items():
        t, n = texts[k] or "", texts[k - 1 if k else 4] or ""
        half = len(t) // 2
        assert r.edited_sha256 == hashlib.sha256((t[: len(t) - half] + n[:half]).encode()).hexdigest()
    prints = spark.createDataFrame([("0" * 32,), ("0" * 31 + "7",), ("f" * 32,), (None,)], "fingerprint string")
    assert [(r.a, r.b, r.distance) for r in simhash.near_fingerprints(prints, 3).collect()] == [("0" * 32, "0" * 31 + "7", 3)]


def plain_fingerprint(spark, text):
    """Votes term by term, with hashes from Spark."""
    words_ = [w for w in (text or "").lower().translate(str.maketrans("\n\t\r\f\x0b", "     ")).split(" ") if w]
    terms = [(w, words_[k + 1] if k + 1 < len(words_) else "") for k, w in enumerate(words_)]
    if not terms:
        return "0" * 32
    rows = spark.createDataFrame([(k, *t) for k, t in enumerate(terms)], "k int, a string, b string").select("k", F.xxhash64("a", "b").alias("h0"), F.xxhash64("b", F.lit(7), "a").alias("h1")).orderBy("k").collect()
    out = ""
    for h in ("h0", "h1"):
        votes = [0] * 64
        for r, (a, b) in zip(rows, terms, strict=True):
            for n in range(64):
                votes[n] += min(15, len(a) + len(b)) * (1 if r[h] >> n & 1 else -1)
        out += f"{sum(1 << n for n in range(64) if votes[n] > 0):016x}"
    return out


def test_fingerprints_against_plain_votes(spark):
    rng = random.Random(17)
    texts = [sentence(rng, 50), "a " * 5000 + "b", "One two\nTHREE", None, " \t", sentence(rng, 3000, "véry")]
    rows = [*enumerate(texts), (None, texts[0]), (2, texts[2]), (2, "other text")]
    docs = spark.createDataFrame([(k, t, 1, "x") for k, t in rows], "doc_id long, text string, cell int, fingerprint string")
    got = simhash.edited_fingerprints(docs).collect()
    order = sorted(rows, key=lambda r: -1 if r[0] is None else r[0], reverse=True)
    assert len(got) == 9 and {(r.doc_id, r.n_chars) for r in got} == {(k, len(t or "")) for k, t in order}
    prints = {t: plain_fingerprint(spark, t) for t in {t for _, t in rows}}
    assert collections.Counter((r.doc_id, r.fingerprint) for r in got) == collections.Counter((k, prints[t]) for k, t in rows)
    one = next(r for r in got if r.doc_id == 1)
    half = len(texts[1]) // 2
    edited = texts[1][: len(texts[1]) - half] + texts[0][:half]
    bits = lambda a, b: 1 - (int(a, 16) ^ int(b, 16)).bit_count() / 128
    assert one.edited_fingerprint == plain_fingerprint(spark, edited) and one.near_edited == bits(one.fingerprint, one.edited_fingerprint) and one.near_next == bits(one.fingerprint, prints[texts[0]])


def test_all_fingerprints_within_a_radius(spark, monkeypatch):
    monkeypatch.setattr(simhash, "FRONT_ROWS", 7)
    rng = random.Random(18)
    base = [rng.getrandbits(128) for _ in range(5)]
    prints = set()
    for b in base:
        for _ in range(60):
            x = b
            for bit in rng.sample(range(128), rng.randrange(5)):
                x ^= 1 << bit
            prints.add(x)
    prints = sorted(prints)
    df = spark.createDataFrame([(f"{x:032x}", 1) for x in prints] + [(None, 1), (f"{prints[0]:032x}", 2)], "fingerprint string, front int")
    for radius in (1, 3):
        got = [(r.a, r.b, r.distance) for r in simhash.near_fingerprints(df, radius).collect()]
        want = {(f"{a:032x}", f"{b:032x}", (a ^ b).bit_count()) for a, b in itertools.combinations(prints, 2) if (a ^ b).bit_count() <= radius}
        assert len(got) == len(set(got)) and set(got) == want
    assert simhash.near_fingerprints(df.limit(0)).count() == 0


def test_hidden_markov_forward_is_exact():
    rng = np.random.default_rng(0)
    model = hmm.Model(rng.dirichlet(np.ones(hmm.STATES)), rng.dirichlet(np.ones(hmm.STATES), hmm.STATES), rng.dirichlet(np.ones(hmm.CLASSES), hmm.STATES).T)
    texts = [rng.integers(0, hmm.CLASSES, n) for n in (1, 5, 128, 129, 400)]
    got, _, _ = hmm.forward(model, *hmm.segments(texts))
    for t, x in zip(got, texts, strict=True):
        v, log = model.start * model.emit[x[0]], 0.0
        for c in x[1:]:
            log += np.log(v.sum())
            v = v / v.sum() @ model.move * model.emit[c]
        assert t == pytest.approx(log + np.log(v.sum()), rel=1e-10)
    start, move, emit, _ = hmm.expected(hmm.for_counts(model), *hmm.segments(texts))
    assert start.sum() == pytest.approx(5, rel=1e-4) and emit.sum() == pytest.approx(sum(map(len, texts)), rel=1e-4) and move.sum() == pytest.approx(sum(map(len, texts)) - 5, rel=1e-4)


def test_hidden_markov_counts_of_texts_abreast(monkeypatch):
    """Likelihoods and expected counts against a plain recursion in both directions; matrices only for places that few texts have."""
    rng = np.random.default_rng(5)
    model = hmm.Model(rng.dirichlet(np.ones(hmm.STATES)), rng.dirichlet(np.ones(hmm.STATES), hmm.STATES), rng.dirichlet(np.ones(hmm.CLASSES), hmm.STATES).T)
    sizes = [1, 2, 127, 128, 129, 256, 257] * 30 + [700, 1500]
    texts = [rng.integers(0, hmm.CLASSES, n) for n in rng.permutation(sizes)]
    start, move, emit, total = np.zeros(hmm.STATES), np.zeros((hmm.STATES, hmm.STATES)), np.zeros((hmm.STATES, hmm.CLASSES)), []
    for x in texts:
        alpha, log = [model.start * model.emit[x[0]]], 0.0
        for c in x[1:]:
            log += np.log(alpha[-1].sum())
            alpha[-1] = alpha[-1] / alpha[-1].sum()
            alpha.append(alpha[-1] @ model.move * model.emit[c])
        total.append(log + np.log(alpha[-1].sum()))
        beta = np.ones(hmm.STATES)
        for t in reversed(range(len(x))):
            gamma = alpha[t] * beta / (alpha[t] @ beta)
            emit[:, x[t]] += gamma
            if not t:
                start += gamma
                break
            pairs = alpha[t - 1][:, None] * model.move * (model.emit[x[t]] * beta)
            move += pairs / pairs.sum()
            beta = model.move @ (model.emit[x[t]] * beta)
            beta = beta / beta.sum()
    by_matrices, transfers = [], hmm.transfers
    monkeypatch.setattr(hmm, "transfers", lambda m, rows, first: by_matrices.append(len(rows)) or transfers(m, rows, first))
    parts = hmm.segments(texts)
    assert hmm.forward(model, *parts)[0] == pytest.approx(total, rel=1e-10)
    got = hmm.expected(hmm.for_counts(model), *parts)
    for x, y in zip(got, (start, move, emit), strict=False):
        assert np.abs(x - y).max() <= 1e-4 * y.max()
    # 92 texts have a second segment; third ones, which 32 have, and later ones are too few to go abreast
    assert by_matrices == [30 + 4 + 10] * 2


def test_hidden_markov_scores(spark):
    rng = random.Random(3)
    texts = [None, "", "Rare", *(sentence(rng, 60, s, 30) for s in "ab" * 30)]
    got = {r.doc_id: r for r in hmm.hmm_scores(documents(spark, texts)).collect()}
    tokens = {k: [*(t or "").encode().lower().split(), b""] for k, t in enumerate(texts)}
    count = collections.Counter(w for k, r in got.items() if not r.held_out for w in tokens[k])
    total, distinct = sum(count.values()), len(count)
    for k, r in got.items():
        assert r.n_tokens == len(tokens[k]) and r.train_tokens == total and r.n_known == sum(count[w] > 0 for w in tokens[k])
        assert r.base_score == pytest.approx(sum(np.log10((count[w] + 1) / (total + distinct + 1)) for w in tokens[k]))
    assert sum(r.score for r in got.values()) > sum(r.base_score for r in got.values())


def test_frequent_words_of_one_count(spark):
    counts = spark.createDataFrame([(bytearray(f"w{k}".encode()), 3) for k in range(5000)] + [(bytearray(b"top"), 90)], "word binary, n long")
    got = hmm.frequent(counts, 1000)
    assert bytes(got[0].word) == b"top" and 800 <= len(got) <= 1000 and len({bytes(r.word) for r in got}) == len(got)
    assert len(hmm.frequent(counts, 5001)) == 5001


def test_frequent_words_by_one_comparison(spark, monkeypatch):
    """However many classes of counts are above the cut, a word's class is looked at a few times only."""
    counts = spark.createDataFrame([(bytearray(f"w{k}".encode()), k * k + 1) for k in range(1, 400)], "word binary, n long")
    asked, where = [], type(counts).where
    monkeypatch.setattr(type(counts), "where", lambda df, condition: asked.append(str(condition)) or where(df, condition))
    got = hmm.frequent(counts, 350)
    assert 340 <= len(got) <= 350 and [r.n for r in got[:300]] == [k * k + 1 for k in range(399, 99, -1)]
    assert len(asked) == 1 and asked[0].lower().count("log2") == 2


def test_hidden_markov_scores_against_the_plain_recursion(spark):
    """``score`` again from the model that the query ends with: states emit classes, a class's words share by count."""
    rng = random.Random(13)
    texts = [sentence(rng, 50, s, 40) for s in "ab" * 40] + ["zz yy", None, "unseen words"]
    rows = [(k, t) for k, t in enumerate(texts)] + [(1, texts[1]), (None, texts[2])]
    docs = spark.createDataFrame([(k, t, 1.0) for k, t in rows], "doc_id long, text string, score double")
    held, model_of = {}, hmm.re_estimated

    def kept(*x):
        held["model"] = model_of(*x)
        return held["model"]

    hmm.re_estimated = kept
    try:
        got = hmm.hmm_scores(docs).collect()
    finally:
        hmm.re_estimated = model_of
    assert len(got) == len(rows) and sum(r.doc_id is None and not r.held_out for r in got) == 1
    count = collections.Counter(w for k, t in rows if k is None or zlib.crc32(str(k).encode()) % 7 != 2 for w in (t or "").encode().lower().split())
    known = sorted(count, key=lambda w: (-count[w], w))
    place = {w: k + 1 for k, w in enumerate(known)}
    size = np.zeros(hmm.FORMS)
    model = held["model"]
    for r in got:
        tokens = [*next((t or "").encode().lower().split() for k, t in rows if k == r.doc_id), b""]
        v, log = None, 0.0
        for w in tokens:
            c = 0 if w == b"" else place.get(w, hmm.form(w))
            v = (model.start if v is None else v @ model.move) * model.emit[c]
            log += np.log(v.sum())
            v = v / v.sum()
            if c > hmm.OWN:  # no word of this form is known: the one that is kept for words never seen
                log -= np.log(size[c - 1 - hmm.OWN] + 1)
        assert r.score == pytest.approx(log / np.log(10), rel=1e-6)


def test_nearest_vectors(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 8))
    x[7], x[250] = x[20], x[20]
    rows = [(k, v.tolist(), "x") for k, v in enumerate(x)] + [(900, None, "x"), (901, [0.0] * 8, "x"), (902, [float("nan")] * 8, "x"), (903, [1.0] * 7 + [None], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    got = collections.defaultdict(list)
    for r in ann.nearest(df, df.where("vec_id % 20 = 0"), k=10).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    hits = 0
    for q in range(0, 300, 20):
        s = x @ x[q]
        s[q] = -np.inf
        best = np.lexsort((np.arange(300), -s))[:10]
        hits += len(set(best.tolist()) & {v for v, _ in got[q]})
        assert all(v == pytest.approx(float(x[q] @ x[k])) for k, v in got[q]) and len(got[q]) == 10
    assert hits >= 0.9 * 150 and [v for v, _ in got[20][:2]] == [7, 250] and set(got) == set(range(0, 300, 20))
    few = spark.createDataFrame(rows[:3], df.schema)
    assert ann.nearest(few, few, k=10).count() == 6


def test_language(spark):
    rng = random.Random(5)
    pools = {"xx": "the of and that with thing wh".split(), "yy": "der und schein pfl zu üb ver".split()}
    texts = [" ".join(rng.choice(pools[k]) for _ in range(rng.randrange(5, 200))) for k in ("xx", "yy") * 60] + [None, "", "12 34 !?"]
    langs = {k: ("xx", "yy")[k % 2] for k in range(120)}
    got = {r.doc_id: r for r in langid.languages(documents(spark, texts, langs)).collect()}
    assert sum(got[k].lang_pred == langs[k] for k in range(120)) >= 114
    assert all(got[k].lang_pred == "und" for k in (120, 121, 122)) and all(0 <= r.score <= 1 for r in got.values())
    kept = langid.in_known_language(documents(spark, texts, langs))
    assert kept.columns == documents(spark, []).columns and {120, 121, 122}.isdisjoint(r.doc_id for r in kept.collect())


def test_languages_are_many_and_numerals_no_letters(spark):
    rng = random.Random(15)
    names = [f"l{k:02d}" for k in range(70)]
    pools = {n: ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(3, 7))) for _ in range(4)] for n in names}
    texts = [" ".join(rng.choice(pools[names[k % 70]]) for _ in range(120)) for k in range(70 * 30)] + ["½", "² ³ Ⅷ", "٣", "ª", " ".join(pools["l05"] * 30_000)]
    got = {r.doc_id: r for r in langid.languages(documents(spark, texts, {k: names[k % 70] for k in range(2100)})).collect()}
    assert all(got[k].lang_pred == "und" and got[k].score == 0 for k in (2100, 2101, 2102)) and got[2103].lang_pred != "und"
    assert len({r.lang_pred for r in got.values()}) > 64
    held = [k for k in range(2100) if got[k].held_out]
    assert sum(got[k].lang_pred == names[k % 70] for k in held) >= 0.8 * len(held)


def test_language_with_repeated_and_null_ids(spark):
    text = {"xx": "the of and that with thing wh " * 9, "yy": "der und schein pfl zu üb ver " * 9}
    rows = [(k, text[("xx", "yy")[k % 2]], ("xx", "yy")[k % 2], 1) for k in range(60)] + [(None, text["xx"], "xx", 1), (7, text["yy"], "yy", 1), (None, None, None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred int")
    got = collections.Counter((r.doc_id, r.held_out, r.lang_pred) for r in langid.languages(docs).collect())
    assert got[None, False, "xx"] == 1 and got[None, False, "und"] == 1 and sum(n for (k, _, lang), n in got.items() if k == 7 and lang == "yy") == 2 and sum(got.values()) == 63
    assert langid.in_known_language(docs).columns == docs.columns


def test_language_learns_from_all_windows(spark):
    rng = random.Random(25)
    letters = "abcdefghijklmnopqrstuvwxyz"
    common = ["".join(rng.choice(letters) for _ in range(5)) for _ in range(40)]
    # each language has 30 scripts of its own, of which a start of four texts and of one window sees few
    scripts = {name: [chr(at + 40 * k) for k in range(30)] for name, at in (("xx", 0x4E00), ("yy", 0x6E00))}
    texts, langs = [], {}
    for k in range(1600):
        langs[k] = ("xx", "yy")[k % 2]
        own = scripts[langs[k]][k // 2 % 30]
        texts.append(" ".join(rng.choice(common) for _ in range(rng.choice((5, 60)))) + f" {own * 3}" * 8)
    docs = documents(spark, texts, langs)
    got = {r.doc_id: r for r in langid.languages(docs, most=4, each=1).collect()}
    held = [k for k in got if got[k].held_out]
    assert sum(got[k].lang_pred == langs[k] for k in held) >= 0.97 * len(held)
    again = {r.doc_id: r.score for r in langid.languages(docs.repartition(5), most=4, each=1).collect()}
    assert again == pytest.approx({k: r.score for k, r in got.items()}, abs=1e-5)


def test_least_score_is_that_of_all_held_out_documents(spark):
    rng = random.Random(26)
    pools = {"xx": "the of and that with thing wh".split(), "yy": "der und schein pfl zu üb ver".split()}
    texts = [" ".join(rng.choice(pools[("xx", "yy")[k % 2]] if rng.random() < 0.7 else pools[("yy", "xx")[k % 2]]) for _ in range(12)) for k in range(1600)]
    langs = {k: ("xx", "yy")[k % 2] for k in range(1600)}
    docs = documents(spark, texts, langs)
    model = langid._learned(docs, 20, 1, 2, "doc_id", "text", "lang")
    scores = [r.score for r in langid._predicted(docs.select("doc_id", "text"), model, "text", ("pred", "score")).collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2 and r.pred == langs[r.doc_id]]
    want = float(np.quantile(scores, langid.LOST, method="lower"))
    assert langid.least_score(docs, model, 2, "doc_id", "text", "lang") == pytest.approx(max(0.625, want), abs=1e-6) and len(scores) > 300
    values = [rng.random() ** 3 for _ in range(500)] + [0.25] * 300 + [np.nextafter(0.25, 1)] * 40
    table = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double")
    for share in (0.0, 0.005, 0.4, 0.62, 0.7, 1.0):
        assert langid.lower_quantile(table, share, bins=8) == np.quantile(values, share, method="lower")
    assert langid.lower_quantile(table.where("v > 2"), 0.5) is None


def test_toxicity(spark):
    rng = random.Random(6)
    texts = [sentence(rng, 60) + (" " + rng.choice(["badword", "awful"]) + " " + sentence(rng, 20) if k % 4 == 0 else "") for k in range(400)] + [None, ""]
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(400)], "doc_id long, toxic int")
    docs = documents(spark, texts)
    got = {r.doc_id: r for r in toxicity.toxicity_scores(docs, labels).collect()}
    held = [k for k in range(400) if got[k].held_out]
    assert len(got) == 402 and sum(got[k].predicted == (k % 4 == 0) for k in held) >= 0.9 * len(held)
    assert all(r.predicted == int(r.score >= 0.7) and 0 <= r.score <= 1 for r in got.values())
    assert toxicity.toxicity_scores(docs, labels.limit(0)).where("score > 0").count() == 0


def test_toxicity_by_language_with_repeated_and_null_ids(spark):
    rng = random.Random(16)
    pools = {"xx": [f"a{k}" for k in range(50)], "yy": [f"b{k}" for k in range(50)]}
    # what is toxic in one language is common in the other
    bad = {"xx": "slur", "yy": "schimpf"}
    rows = []
    for k in range(1200):
        lang = ("xx", "yy")[k % 2]
        toxic = k % 8 < 2
        words = [rng.choice(pools[lang]) for _ in range(30)] + ([bad[lang]] if toxic else [])
        rng.shuffle(words)
        rows.append((k, " ".join(words), lang, int(toxic)))
    extra = [(None, rows[0][1], "xx", 1), (8, rows[8][1], "xx", 1), (2000, "a1 " * 300_000, None, None), (2001, None, None, None)]
    docs = spark.createDataFrame([(*r[:3], 0.5) for r in [*rows, *extra]], "doc_id long, text string, lang string, score double")
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows] + [(8, 1), (None, 1), (5, None)], "doc_id long, toxic int")
    got = toxicity.toxicity_scores(docs, labels, longest=100).collect()
    assert len(got) == 1204 and len({round(r.score, 3) for r in got if r.doc_id == 8}) == 1
    found = {r.doc_id: r.predicted for r in got}
    assert sum(found[r[0]] == r[3] for r in rows) >= 0.95 * 1200
    assert toxicity.without_toxic(docs, labels, longest=100).columns == docs.columns
    votes = toxicity.language_votes([toxicity.token_rows(r[1]) for r in rows], [r[2] for r in rows], np.array([r[3] for r in rows]))
    index, starts = toxicity._padded([toxicity.token_rows(t) for t in ("a1 a2", "b3", "")])
    assert toxicity.groups(votes, index, starts).tolist() == [1, 2, 0]


def test_empty_tables(spark):
    none = documents(spark, [])
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    for out in (
        minhash.near_duplicates(none), substrings.shared_passages(none), bpe.bpe_digests(none, queries.RANKS, P.PATTERN), packing.pack_best_fit(none, queries.TOKENIZER, P.PATTERN),
        simhash.edited_fingerprints(none), hmm.hmm_scores(none), langid.languages(none), toxicity.toxicity_scores(none, labels),
        chat.format_chat(spark.createDataFrame([], "conv_id long, turn long, role string, text string")),
    ):
        assert out.count() == 0
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert ann.nearest(vectors, vectors).count() == 0


def test_words_are_ascii_spaced():
    h = words.WordHashes()
    assert len(h.of("A b c\x0bd\x1ce".encode())) == 3 and h.of(b"AbC")[0] == h.of(b"aBc")[0]


def test_fuzzy_passages_are_whole():
    rng = np.random.default_rng(1)
    for n, edits in ((50, 5), (60, 12), (100, 20)):
        for _ in range(100):
            partner = np.full(n + 80, -1)
            partner[40 : 40 + n] = np.arange(n)
            partner[40 + rng.choice(np.arange(1, n - 1), edits, replace=False)] = -1
            assert substrings.passages(partner, 45)
    for _ in range(100):
        partner = np.where(rng.random(120) < rng.choice([0.7, 0.8, 0.9]), np.arange(120), -1)
        score = np.concatenate(([0], np.cumsum(np.where(partner >= 0, 1, -4))))
        whole = np.zeros(120, bool)
        for s, e in itertools.combinations(range(121), 2):
            if e - s >= 45 and score[e] >= score[s] and partner[s] >= 0 and partner[e - 1] >= 0:
                whole[s:e] = True
        got = substrings.passages(partner, 45)
        assert bool(got) == whole.any() and all(whole[s:e].all() and score[e] >= score[s] and e - s >= 45 for s, e, _ in got)


def test_passage_with_one_seed(spark, monkeypatch):
    monkeypatch.setattr(substrings, "RUN", 10**9)  # k-mers alone
    rng = random.Random(11)
    passage = [f"p{k}" for k in range(48)]
    values, at = substrings.seeds(words.hashes().of(" ".join(passage)))
    begin = int(np.sort(at)[len(at) // 2])
    edited = [w if begin <= k < begin + 5 or k % 6 else f"x{k}" for k, w in enumerate(passage)]
    texts = [sentence(rng, 30, "q") + " " + " ".join(passage), sentence(rng, 30, "r") + " " + " ".join(edited)]
    links = [dict(zip(*map(list, substrings.seeds(words.hashes().of(t))), strict=True)) for t in texts]
    assert len(set(links[0]) & set(links[1])) == 1
    assert [(r.doc_id, r.other_id) for r in substrings.shared_passages(documents(spark, texts)).collect()] == [(1, 0)]


def test_toxicity_thresholds_hold_at_the_share_of_the_table(spark):
    rng = random.Random(9)
    raw, label = np.array([0.9, 0.8, 0.7, 0.6, 0.5, 0.2]), np.array([1, 0, 1, 1, 0, 0])
    weight = np.where(label == 1, 1, 9)
    assert toxicity.best_threshold(raw, label, weight) == toxicity.best_threshold(np.repeat(raw, weight), np.repeat(label, weight))
    # an edgy word is in all toxic documents and in three tenths of the clean ones, of which there are nine times as many
    toxic = [k % 10 == 0 for k in range(3000)]
    texts = [f"{sentence(rng, 10)}{' edgy' if bad or k % 10 < 4 else ''}{' badword' if bad and k % 20 else ''} {sentence(rng, 4)}" for k, bad in enumerate(toxic)]
    labels = spark.createDataFrame([(k, int(bad)) for k, bad in enumerate(toxic)], "doc_id long, toxic int")
    got = {r.doc_id: r.predicted for r in toxicity.toxicity_scores(documents(spark, texts), labels, most=300).collect()}
    assert sum(got[k] for k in got if not toxic[k]) <= 0.05 * 2700 and sum(got[k] for k in got if toxic[k]) >= 100


def test_toxicity_learns_from_all_rows_of_large_tables(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "FEW", 100)
    rng = random.Random(19)
    # 80 words tell, each in 15 documents; a text of more than ``longest`` words counts too
    toxic = [k % 4 == 0 for k in range(4800)]
    texts = [f"{sentence(rng, 10)}{f' bad{k // 4 % 80}' if bad else ''} {sentence(rng, 4)}{' plain' * 60 if k % 8 < 4 else ''}" for k, bad in enumerate(toxic)]
    labels = spark.createDataFrame([(k, int(bad)) for k, bad in enumerate(toxic)], "doc_id long, toxic int")
    docs = documents(spark, texts)
    got = {r.doc_id: r for r in toxicity.toxicity_scores(docs, labels, most=60, longest=50).collect()}
    held = [k for k in got if got[k].held_out]
    assert sum(got[k].predicted for k in held if toxic[k]) >= 0.9 * sum(toxic[k] for k in held)
    assert sum(got[k].predicted for k in held if not toxic[k]) <= 0.02 * len(held)
    again = {r.doc_id: r.score for r in toxicity.toxicity_scores(docs.repartition(5), labels.repartition(3), most=60, longest=50).collect()}
    assert again == pytest.approx({k: r.score for k, r in got.items()}, abs=1e-6)


def test_toxicity_steps_take_long_texts_in_pieces(monkeypatch):
    rng = np.random.default_rng(4)
    texts = [rng.integers(1, 60, n).astype(np.int32) for n in (0, 40, 3, 9, 1, 17)]
    labels = np.array([0, 1, 0, 1, 0, 1])
    whole = toxicity.train(texts, labels, epochs=3)
    monkeypatch.setattr(toxicity, "CHUNK", 7)
    pieces = toxicity.train(texts, labels, epochs=3)
    np.testing.assert_allclose(pieces.embedding, whole.embedding, atol=1e-4)
    np.testing.assert_allclose(pieces.out, whole.out, atol=1e-4)


def test_nearest_vectors_with_repeated_ids(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 8))
    query = x[0]
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(1, (query + rng.normal(0, 0.01, 8)).tolist()) for _ in range(30)] + [(2, (query * 1.1).tolist())] * 30
    best = collections.defaultdict(lambda: -np.inf)
    for k, v in rows:
        best[k] = max(best[k], float(query @ v))
    expected = sorted((k for k in best if k), key=lambda k: (-best[k], k))[:10]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.nearest(df, df.where("vec_id = 0"), k=10, probes=64).orderBy("rank").collect()
    assert [r.vec_id for r in got] == expected and all(r.score == pytest.approx(best[r.vec_id]) for r in got)


def test_joint_hash_compares_less_and_finds_as_much(spark, monkeypatch):
    """Two sizes of a table of loose clusters: recall by one axis and by two, and how many pairs meet."""
    rng = np.random.default_rng(4)
    shares = {}
    for n in (1500, 6000):
        centres = rng.normal(size=(n // 30, 16))
        x = centres[rng.integers(0, len(centres), n)] + rng.normal(0, 0.35, (n, 16))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
        asked = range(0, n, 20)
        best = {q: set(np.argsort(-np.where(np.arange(n) == q, -np.inf, x @ x[q]), kind="stable")[:10].tolist()) for q in asked}
        for cell in (10**6, 8):
            monkeypatch.setattr(ann, "CELL", cell)
            axes = ann.axes_for(n, 16)
            assert axes == (1 if cell > 8 else 2)
            got = collections.defaultdict(set)
            for r in ann.nearest(df, df.where("vec_id % 20 = 0"), k=10, tables=8, probes=5).collect():
                got[r.query_id].add(r.vec_id)
            assert sum(len(best[q] & got[q]) for q in asked) >= 0.9 * 10 * len(asked)
            meet = 0
            for t in range(8 << (axes - 1)):
                mine, theirs = ann.cells_of(x[:: 20], t, axes, 5**axes), ann.cells_of(x, t, axes, 1)[:, 0]
                counts = collections.Counter(theirs.tolist())
                meet += sum(counts[c] for c in mine.ravel().tolist())
            shares[n, axes] = meet / (len(asked) * n)
    assert shares[6000, 2] < 0.6 * shares[6000, 1]


def test_near_anchors_chain_after_a_long_match():
    found = np.array([[0, 0, 500], [620, 621, 5], [640, 642, 5]])
    assert sorted(map(sorted, substrings.chains(found))) == [[0], [1, 2]]


def test_passage_that_stands_twice(spark):
    rng = random.Random(12)
    passage = sentence(rng, 60, "p")
    texts = [sentence(rng, 30, "q") + " " + passage, sentence(rng, 20, "r") + " " + passage + " " + sentence(rng, 100, "s") + " " + passage, "ab cd " * 100, sentence(rng, 10, "t") + " ab cd" * 80]
    docs = documents(spark, texts)
    for df in (docs.coalesce(1), docs.repartition(4, "doc_id")):
        got = {(r.doc_id, r.start, r.n_words, r.other_id) for r in substrings.shared_passages(df).collect()}
        assert {(1, 20, 60, 0), (1, 180, 60, 0)} <= got and {k for k, *_ in got} == {1, 3}
        assert sum(n for k, _, n, _ in got if k == 3) >= 150


def test_passages_are_the_same_for_every_layout(spark):
    rng = random.Random(22)
    shared = [sentence(rng, 70, f"p{k}_") for k in range(8)]
    texts = []
    for _ in range(240):
        parts = [sentence(rng, rng.randrange(10, 60), "w", 3000)]
        for _ in range(rng.randrange(3)):
            w = rng.choice(shared).split()
            for at in rng.sample(range(70), rng.randrange(8)):
                w[at] = f"e{rng.randrange(99)}"
            parts += [" ".join(w), sentence(rng, 15, "w", 3000)]
        texts.append(" ".join(parts))
    docs = documents(spark, texts)
    got = [{tuple(r) for r in substrings.shared_passages(docs.repartition(n, "doc_id")).collect()} for n in (1, 3, 7)]
    assert got[0] and got[0] == got[1] == got[2]


def test_passage_whose_phrases_stand_elsewhere_before(spark):
    rng = random.Random(23)
    passage = [f"p{k}" for k in range(80)]
    phrases = [" ".join(passage[k : k + 14]) for k in range(0, 80, 7)]
    texts = [sentence(rng, 12, f"c{k}_") + " " + p + " " + sentence(rng, 12, f"d{k}_") for k, p in enumerate(phrases)]
    n = len(texts)
    texts += [sentence(rng, 30, "q") + " " + " ".join(passage), sentence(rng, 30, "r") + " " + " ".join(passage)]
    got = [(r.doc_id, r.n_words, r.other_id) for r in substrings.shared_passages(documents(spark, texts)).collect() if r.doc_id > n]
    assert (n + 1, 80, n) in got


def test_recall_of_fuzzy_passages(spark):
    """Passages of 60 to 120 words with similarities of 0.8 to 0.95 among texts of frequent words: more than nine tenths of their words are found, at 0.8 itself four fifths."""
    rng = random.Random(24)
    weights = [1 / (k + 2) for k in range(4000)]
    words_ = [f"w{k}" for k in range(4000)]
    prose = lambda n: rng.choices(words_, weights, k=n)
    texts, planted = [], {}
    for k in range(300):
        texts.append(prose(rng.randrange(100, 300)))
    for k in range(200):
        like, n = (0.8, 0.85, 0.9, 0.95)[k % 4], rng.randrange(60, 120)
        source = texts[rng.randrange(300)]
        at = rng.randrange(max(1, len(source) - n))
        w = source[at : at + n].copy()
        for x in rng.sample(range(len(w)), int((1 - like) * len(w))):
            w[x] = rng.choice(words_)
        before = prose(rng.randrange(20, 80))
        planted[len(texts)] = (like, len(before), len(before) + len(w))
        texts.append(before + w + prose(40))
    covered = collections.defaultdict(set)
    for r in substrings.shared_passages(documents(spark, [" ".join(t) for t in texts])).collect():
        covered[r.doc_id].update(range(r.start, r.start + r.n_words))
    share = collections.defaultdict(list)
    for k, (like, s, e) in planted.items():
        share[like].append(len(covered[k] & set(range(s, e))) / (e - s))
    found = {like: np.mean(x) for like, x in share.items()}
    assert np.mean([*found.values()]) >= 0.91 and found[0.8] >= 0.78 and min(found[x] for x in (0.85, 0.9, 0.95)) >= 0.9


def test_passages_with_repeated_and_null_ids(spark):
    rng = random.Random(25)
    passage = sentence(rng, 60, "p")
    rows = [(1, passage), (2, "a b c " + passage), (2, "a b c " + passage), (None, passage), (3, None), (4, ""), (5, " ".join(f"v{k}" for k in range(150_000)) + " " + passage)]
    docs = spark.createDataFrame([(k, t, "x", 1) for k, t in rows], "doc_id long, text string, ranges string, start int")
    spans = substrings.shared_passages(docs)
    got = sorted({(r.doc_id, r.start, r.n_words, r.other_id) for r in spans.collect()})
    assert got == [(2, 3, 60, 1), (5, 150_000, 60, 1)]
    kept = substrings.without_passages(docs, spans)
    assert kept.columns == docs.columns
    assert collections.Counter((r.doc_id, len((r.text or "").split())) for r in kept.collect()) == {(1, 60): 1, (2, 3): 2, (None, 60): 1, (3, 0): 1, (4, 0): 1, (5, 150_000): 1}
