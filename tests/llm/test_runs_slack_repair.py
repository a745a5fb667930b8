"""Periodic runs, minimum bin slack and conversation repair against brute force, with nulls, empty and repeated rows, and extra columns."""

from __future__ import annotations

import collections
import hashlib
import itertools
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from firnspark.llm import minslack, periodic, queries, repair

SPLIT = b" \t\n\x0b\x0c\r"


def plain_runs(w, least=12):
    n, out = len(w), {}
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and w[j] == w[j + p]:
                j += 1
            if j > i and j - i >= p and j - i + p >= least:
                out.setdefault((i, j - i + p), p)
            i = j + 1 if j == i else j
    return sorted((s, size, p) for (s, size), p in out.items())


@pytest.mark.parametrize("table", [periodic.TABLE_WORDS, 4])
def test_maximal_runs_against_every_place(table, monkeypatch):
    monkeypatch.setattr(periodic, "TABLE_WORDS", table)
    periodic.grid_pairs.cache_clear()
    rng = random.Random(2)
    for _ in range(1200):
        n, letters = rng.randrange(90), rng.choice((1, 2, 2, 3, 5, 50))
        w = [rng.randrange(letters) for _ in range(n)]
        for _ in range(rng.randrange(4) if n else 0):
            s, p = rng.randrange(n), rng.randrange(1, 12)
            for i in range(s + p, min(n, s + rng.randrange(60))):
                w[i] = w[i - p]
        for least in (12, 2):
            assert periodic.maximal_runs(np.array(w, np.int64), least) == plain_runs(w, least)
    periodic.grid_pairs.cache_clear()


def run_texts():
    rng = random.Random(8)
    texts = [None, "", " \t\n", "one", " ".join(["a"] * 30), "\x0ba b " * 9, "x\x0cy\rz " * 4, "a\xa0b " * 20, " ".join(str(k) for k in range(3000))]
    for _ in range(60):
        w = [rng.choice("abcdefgh") + rng.choice("xyz") for _ in range(rng.randrange(1, 120))]
        if rng.random() < 0.5:
            at = rng.randrange(len(w))
            w[at:at] = w[at : at + rng.randrange(1, 9)] * rng.randrange(2, 9)
        texts.append(rng.choice((" ", "\n", "  \t")).join(w))
    return texts


def plain_op11(key, text):
    words = (text or "").encode().split()
    n = len(words)
    if key is not None and n and zlib.crc32(str(key).encode()) % 10 == 0:
        g = zlib.crc32(str(key).encode()) // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    gone = {i for s, size, p in runs for i in range(s + p, s + size)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    shown = "".join(f"{s},{size},{p}\n" for s, size, p in runs)
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    return key, len(runs), *best, 1000 * best[1] // best[2] if runs else None, hashlib.sha256(shown.encode()).hexdigest(), hashlib.sha256(kept).hexdigest()


def stored(spark, tmp_path, name, df):
    df.coalesce(2).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_op11_against_every_place(spark, tmp_path):
    texts = run_texts()
    rows = [(k, t, 1, "x") for k, t in enumerate(texts)] + [(3, "one", 2, "y"), (None, "a " * 40, 1, None), (20, texts[20], 1, None)]
    d = stored(spark, tmp_path, "documents", spark.createDataFrame(rows, "doc_id long, text string, n_words int, runs string"))
    got = collections.Counter(tuple(r) for r in queries.op11_periodic_runs(spark, d).collect())
    assert got == collections.Counter(plain_op11(r[0], r[1]) for r in rows)
    assert sum(r[1] > 0 for r in got) > 20 and any(zlib.crc32(str(r[0]).encode()) % 10 == 0 for r in rows)


def test_a_very_long_periodic_text(spark):
    rows = [(1, "start " + "a b c " * 60_000 + "end"), (2, " ".join(str(k) for k in range(50_000)))]
    got = {r.doc_id: r for r in periodic.periodic_runs(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [tuple(x) for x in got[1].runs] == [(1, 180_000, 3)] and got[1].collapsed == "start a b c end" and got[2].runs == []


def best_sum(lengths, target):
    return max(s for n in range(len(lengths) + 1) for c in itertools.combinations(lengths, n) if (s := sum(c)) <= target)


def test_closest_fill_against_every_subset():
    rng = random.Random(4)
    for _ in range(300):
        lengths = [rng.randrange(1, 40) for _ in range(rng.randrange(10))]
        target, counts = rng.randrange(80), collections.Counter(lengths)
        taken = minslack.closest_fill(sorted(counts), counts, target)
        assert all(counts[k] >= n for k, n in taken.items()) and sum(k * n for k, n in taken.items()) == best_sum(lengths, target)


def pack_texts():
    rng = random.Random(9)
    texts = [None, "", " ", "a", "<|endoftext|> x <|endoftext|>", " ".join(f"w{k}" for k in range(9000))]
    return texts + [" ".join(f"v{rng.randrange(99)}" for _ in range(rng.randrange(1200))) for _ in range(40)]


def check_packing(rows, want, capacity):
    """rows: (doc_id, start, length, crc, doc_tokens, sequence, offset). Every id once, sequences gapless and without padding."""
    parts, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for doc, start, length, crc, tokens, sequence, offset in rows:
        assert length > 0 and len(want[doc]) == tokens and crc == zlib.crc32(np.array(want[doc][start : start + length], "<u4").tobytes())
        parts[doc].append((start, length))
        sequences[sequence].append((offset, length))
    for doc, ids in want.items():
        at = 0
        for start, length in sorted(parts[doc]):
            assert start == at
            at += length
        assert at == len(ids)
    for held in sequences.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= capacity and at & at - 1 == 0
    return sum(len(v) == 1 for v in parts.values()), len(sequences)


def test_op12_against_the_tokenizers_library(spark, tmp_path):
    texts, library = pack_texts(), Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    d = stored(spark, tmp_path, "documents", spark.createDataFrame([(k, t, "x", 0) for k, t in enumerate(texts)], "doc_id long, text string, ids string, offset int"))
    want = {k: [*library.encode(t or "", add_special_tokens=False).ids, 1] for k, t in enumerate(texts)}
    got = queries.op12_min_slack_packing(spark, d)
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    check_packing([tuple(r) for r in got.collect()], want, 2048)


def test_small_capacities_and_blocks(spark, monkeypatch):
    texts, library = pack_texts(), Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = {k: [*library.encode(t or "", add_special_tokens=False).ids, 7] for k, t in enumerate(texts)}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    out = minslack.pack_min_slack(docs, P.path("byte_bpe_50k.json"), P.PATTERN, capacity=256, end_id=7)
    rows = [tuple(r) for r in out.select("doc_id", "start", "length", F.crc32("ids"), "doc_tokens", "sequence_id", "offset").collect()]
    whole, many = check_packing(rows, want, 256)
    total = sum(map(len, want.values()))
    assert many <= total // 256 + 8 and whole >= 1
    for doc, start, *_, tokens, _, _ in rows:  # documents that fit are cut only to fill a window
        assert start < tokens
    assert sum(1 for r in rows if r[4] <= 256) <= sum(len(v) <= 256 for v in want.values()) + 12


def test_packing_with_repeated_null_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c"), (None, None)], "doc_id long, text string")
    out = minslack.pack_min_slack(docs, P.path("byte_bpe_50k.json"), P.PATTERN, capacity=16)
    got = collections.Counter((r.doc_id, r.doc_tokens) for r in out.groupBy("doc_id", "doc_tokens", "sequence_id", "start").count().collect())
    assert sum(r.length for r in out.collect()) == 3 + 3 + 2 + 1 and {k for k, _ in got} == {1, None}
    assert minslack.pack_min_slack(docs.limit(0), P.path("byte_bpe_50k.json"), P.PATTERN).count() == 0
    with pytest.raises(ValueError):
        minslack.pack_min_slack(docs, P.path("byte_bpe_50k.json"), P.PATTERN, capacity=100)


ARCS = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}


def plain_repair(rows, insert=5):
    """rows in order: (role, text). Every edit from every state, from the last row to the first."""
    seen, marks = set(), []
    for role, text in rows:
        solid = text.strip(" \t\n\x0b\x0c\r")
        marks.append("b" if not solid else "d" if (role, text) in seen else "t" if solid[-1] not in ".!?" else "")
        seen.add((role, text))
    inf = (10**9, "")
    after = [(0, ""), inf, inf, (0, "")]

    def with_insertions(best):
        for _ in range(6):
            for q in range(4):
                for r in "ua":
                    if (r, q) in ARCS and best[ARCS[r, q]] != inf:
                        cost, audit = best[ARCS[r, q]]
                        best[q] = min(best[q], (cost + insert, "I" + audit))
        return best

    after = with_insertions(after)
    layers = [after]
    for (role, _), mark in zip(reversed(rows), reversed(marks), strict=True):
        best = []
        for q in range(4):
            options = [(after[q][0] + 2, "D" + after[q][1])]
            if mark not in ("b", "d"):
                more = 5 if mark == "t" else 0
                if (role[:1], q) in ARCS:
                    options.append((after[ARCS[role[:1], q]][0] + more, "K" + after[ARCS[role[:1], q]][1]))
                options += [(after[ARCS[r, q]][0] + 1 + more, "R" + after[ARCS[r, q]][1]) for r in "ua" if (r, q) in ARCS]
            best.append(min(options))
        after = with_insertions(best)
        layers.append(after)
    cost, audit = after[0]
    out, q, k = [], 0, 0
    for x in audit:
        name = {0: "user", 1: "user", 2: "assistant", 3: "user"}[q]
        if x == "I":
            out.append(f"{name}:")
            q = ARCS[name[0], q]
            continue
        role, text = rows[k]
        k += 1
        if x != "D":
            role = name if x == "R" else role
            out.append(f"{role}:{text}")
            q = ARCS[role[0], q]
    initials = [r[:1] for r, _ in rows]
    illegal = sum(p not in ("su", "ua", "au") for p in map("".join, zip(initials, initials[1:], strict=False)))
    return marks.count("b"), marks.count("d"), marks.count("t"), illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()


def plain_op13(rows):
    """rows: (conv, turn, role, text) as they were."""
    out, show = {}, lambda x: " " if x is None else str(x)
    convs = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        h = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
        convs[conv]  # noqa: B018
        if h:
            role, text = show(role), show(text)
            text = "" if h == 1 else "".join(c for c in text if c not in ".!?") if h == 2 else text
            convs[conv] += [(turn, "user" if h == 4 else role, text)] * (2 if h == 3 else 1)
    for conv, held in convs.items():
        held.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        turns = {r[0] for r in held} - {None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out[conv] = (gaps, *plain_repair([r[1:] for r in held]))
    return out


def conversations():
    rng, rows = random.Random(11), []
    texts = ["Yes.", "No!", "And then", "ok?", "", " \n", "Fine. ", "é.", "a\x0b"]
    for conv in range(400):
        for turn in range(rng.randrange(1, 10)):
            role = rng.choice(("system", "user", "assistant", "user", "assistant", "tool", None, "umpire", "")) if rng.random() < 0.5 else ("user", "assistant")[turn % 2]
            text = f"{conv} {turn}." if rng.random() < 0.5 else rng.choice([*texts, None])
            rows.append((conv, None if rng.random() < 0.05 else turn * rng.choice((1, 1, 2)), role, text))
    rows += [(None, k, ("user", "assistant")[k % 2], "Same.") for k in range(5)] + [(1000, None, "user", None)] * 3
    return rows


def test_op13_against_every_edit(spark, tmp_path):
    rows = conversations()
    d = stored(spark, tmp_path, "conversations", spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, cost int, audit string"))
    got = {r.conv_id: tuple(r)[1:] for r in queries.op13_conversation_repair(spark, d).collect()}
    want = plain_op13(rows)
    assert {k: (got[k], v) for k, v in want.items() if got.get(k) != v} == {} and len(got) == len(want)
    assert {x for v in want.values() for x in v[6]} == set("KRD") and any(v[6] == "" for v in want.values())


@pytest.mark.parametrize("insert", [1, 2, 5])
def test_automaton_against_every_edit(insert, monkeypatch):
    monkeypatch.setattr(repair, "INSERT", insert)
    rng, automaton, letters = random.Random(insert), repair.Automaton(), set()
    for _ in range(1500):
        rows = [(rng.choice(("user", "assistant", "system", "tool")), rng.choice(("a.", "b", "", "c!", f"{rng.random()}."))) for _ in range(rng.randrange(10))]
        seen, codes = set(), []
        for role, text in rows:
            must = not text or (role, text) in seen
            codes.append(repair.MUST if must else {"s": 0, "u": 1, "a": 2}.get(role[0], 3) + (0 if text[-1] in ".!" else repair.TRUNC))
            seen.add((role, text))
        states, added, ends = automaton.scan(list(repair.START), codes)
        steps, _ = automaton.trace(states, codes, (0, repair.NEVER, repair.NEVER, 0), True)
        audit, out, q = repair.follow(steps, len(codes), 0)
        shown = "\n".join(f"{given or rows[k][0]}:{rows[k][1] if k >= 0 else ''}" for k, given in out)
        assert (ends[q], audit, hashlib.sha256(shown.encode()).hexdigest()) == plain_repair(rows, insert)[4:]
        letters |= set(audit)
    assert letters >= set("KRD") and ("I" in letters) == (insert < 5) and len(automaton.vectors) < 200


def test_conversations_across_ranges(spark):
    rng = random.Random(12)
    rows = [(1, k // 2, rng.choice(("user", "assistant", "user", "assistant", "system")), rng.choice(("a.", "b", f"{k}.", f"{k}.", ""))) for k in range(3000)]
    rows += [(0, 1, "user", "x."), (2, None, "user", "y")] + [(3, 5, "user", "same.")] * 2000 + [(4, k, ("user", "assistant")[k % 2], f"{k}.") for k in range(1500)]
    was = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        report, made = repair.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
        got = {r.conv_id: tuple(r)[1:] for r in report.join(repair.digests(made), "conv_id", "left").collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", was)
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    for conv in range(5):
        held = sorted([r for r in rows if r[0] == conv], key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        turns = {r[1] for r in held} - {None}
        want = plain_repair([r[2:] for r in held])
        assert got[conv][0] == (max(turns) - min(turns) + 1 - len(turns) if turns else 0)
        assert got[conv][1:-1] == want[:-1] and (got[conv][-1] or hashlib.sha256(b"").hexdigest()) == want[-1]


def test_repair_of_no_rows(spark):
    report, made = repair.repair(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))
    assert report.count() == 0 and made.count() == 0 and repair.digests(made).count() == 0
