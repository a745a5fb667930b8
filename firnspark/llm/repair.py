"""Repair of conversations at the least cost: a weighted automaton over roles, made deterministic as rows ask for it."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: ASCII white space.
SPACE = " \t\n\x0b\x0c\r"
#: Characters of a text that order rows of one turn and role, before its digest does.
PREFIX = 64
#: States of (s?(ua)+)?: nothing yet, a system turn, a user's turn, an assistant's turn. Kept or given roles lead on by these arcs.
STATES, FINAL = 4, (0, 3)
ARCS = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}
#: Roles that a turn can be given or that can be inserted, by state.
GIVEN = {0: ("user", 2), 1: ("user", 2), 2: ("assistant", 3), 3: ("user", 2)}
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: Cost of what can't be.
NEVER = 1 << 60
START = (0, NEVER, NEVER, NEVER)
#: Codes of rows: role initial (s, u, a, another) and whether the text is truncated; or a row that must go.
MUST, TRUNC = 8, 4
INITIALS = "sua"


def inserted(v: list[int]) -> list[int]:
    """Costs after any insertions."""
    v = list(v)
    for _ in range(2):
        for q, (_, to) in GIVEN.items():
            v[to] = min(v[to], v[q] + INSERT)
    return v


def pruned(v: list[int]) -> list[int]:
    """Without states that are worse for every continuation, ties excepted: what follows nothing can follow an assistant's turn if a
    system turn at its head is deleted; what follows a system turn can follow an assistant's turn as it is. Costs so stay near each other."""
    if v[0] > v[3] + DELETE:
        v[0] = NEVER
    if v[1] > v[3]:
        v[1] = NEVER
    return v


def moves(q: int, code: int) -> list[tuple[str, int, int]]:
    """Edits of a row in state ``q``: letter, next state, cost."""
    out = [("D", q, DELETE)]
    if code != MUST:
        more, initial = (TRUNCATED if code & TRUNC else 0), code & 3
        if initial < 3 and (INITIALS[initial], q) in ARCS:
            out.append(("K", ARCS[INITIALS[initial], q], KEEP + more))
        out.append(("R", GIVEN[q][1], REROLE + more))
    return out


MOVES = [[moves(q, code) for code in range(9)] for q in range(STATES)]


class Automaton:
    """States are normalised vectors of costs; a row's code leads to the next one and adds to the cost. Both are made when first
    asked for and then looked up. The same holds for steps of the trace back."""

    def __init__(self):
        self.vectors: list[tuple[int, ...]] = []
        self.numbers: dict[tuple[int, ...], int] = {}
        self.table: dict[int, tuple[int, int]] = {}
        self.traces: dict[tuple[int, int, int], tuple[int, tuple]] = {}

    def number(self, vector: list[int]) -> tuple[int, int]:
        """State of a vector of costs, and what it is above the normalised one."""
        least = min(vector)
        key = tuple(x - least if x < NEVER else NEVER for x in vector)
        if key not in self.numbers:
            self.numbers[key] = len(self.vectors)
            self.vectors.append(key)
        return self.numbers[key], least

    def step(self, state: int, code: int) -> tuple[int, int]:
        after = [NEVER] * STATES
        for q, cost in enumerate(self.vectors[state]):
            if cost < NEVER:
                for _, to, more in MOVES[q][code]:
                    after[to] = min(after[to], cost + more)
        got = self.table[state << 4 | code] = self.number(pruned(inserted(after)))
        return got

    def scan(self, start: list[int], codes: list[int]) -> tuple[list[int], list[int], list[int]]:
        """State before each row and after the last, what each row adds, and the final costs."""
        state, total = self.number(pruned(inserted(start)))
        states, added, table = [state], [], self.table
        for code in codes:
            got = table.get(state << 4 | code)
            state, more = got if got is not None else self.step(state, code)
            states.append(state)
            added.append(more)
        total += sum(added)
        return states, added, [x + total if x < NEVER else NEVER for x in self.vectors[state]]

    def back(self, state: int, code: int, mask: int) -> tuple[int, tuple]:
        """States before a row that lie on a cheapest path to ``mask`` after it, and for each the least letter that stays on one."""
        vector, (after, more) = self.vectors[state], self.table[state << 4 | code]
        beyond = self.vectors[after]
        best: list[tuple[str, int] | None] = [None] * STATES
        for q, cost in enumerate(vector):
            if cost < NEVER:
                tight = [(letter, to) for letter, to, w in MOVES[q][code] if mask >> to & 1 and cost + w == beyond[to] + more]
                best[q] = min(tight, default=None)
        got = self.traces[state, code, mask] = self.with_insertions(vector, best)
        return got

    def with_insertions(self, vector: tuple[int, ...], best: list) -> tuple[int, tuple]:
        for _ in range(STATES):
            for q, (_, to) in GIVEN.items():
                if vector[q] < NEVER and best[to] is not None and vector[q] + INSERT == vector[to] and (best[q] is None or best[q][0] > "I"):
                    best[q] = ("I", to)
        return sum(1 << q for q in range(STATES) if best[q] is not None), tuple(best)

    def trace(self, states: list[int], codes: list[int], togo: tuple[int, ...], final: bool) -> tuple[list[tuple], list[int]]:
        """For each row, and for the end of a conversation, the letter and next state from each state on a cheapest path; and the first states on one."""
        vector = self.vectors[states[-1]]
        least = min(x + y for x, y in zip(vector, togo, strict=True))
        mask, steps, traces = sum(1 << q for q in range(STATES) if vector[q] + togo[q] == least), [], self.traces
        if final:
            mask, end = self.with_insertions(vector, [("", q) if mask >> q & 1 and q in FINAL else None for q in range(STATES)])
            steps.append(end)
        for k in range(len(codes) - 1, -1, -1):
            key = (states[k], codes[k], mask)
            mask, best = traces.get(key) or self.back(*key)
            steps.append(best)
        return steps[::-1], [q for q in range(STATES) if mask >> q & 1]


def follow(steps: list[tuple], rows: int, q: int) -> tuple[str, list[tuple[int, str | None]], int]:
    """Letters from state ``q`` on; what comes out, as (row or -1, role given or None); the state at the end."""
    audit, out, k = [], [], 0
    while k < len(steps):
        letter, to = steps[k][q]
        if letter == "I":
            out.append((-1, GIVEN[q][0]))
        elif k < rows:
            if letter != "D":
                out.append((k, GIVEN[q][0] if letter == "R" else None))
            k += 1
        else:
            break
        audit.append(letter)
        q = to
    return "".join(audit), out, q


@dataclass
class Piece:
    """What the rest of its conversation says to rows that lie in one range of the order: the costs before them and behind them."""

    into: tuple[int, ...] = START
    togo: tuple[int, ...] = (0, NEVER, NEVER, 0)
    first: bool = True
    final: bool = True


@dataclass
class Border:
    """First or last rows of a range that belong to one conversation."""

    conv: object
    at: int
    costs: list[list[int]]
    initials: tuple[str, str]
    turns: tuple[int | None, int | None]


LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}
BORDERS = "part long, at long, initial string, last_initial string, turn long, last_turn long, costs array<long>"
AUDITS = "at long, alone boolean, enter int, exit int, cost long, audit string, out array<struct<pos: long, role: string>>, blank long, duplicate long, truncated long, illegal long, least long, most long, turns long"


def coded(rows: DataFrame) -> DataFrame:
    """``pos``, ``part``, conversation, turn, initial, fault and code of each row. Copies of a role and text are found by one aggregation, whose
    first rows meet the others by their place, so no key gathers rows."""
    first = rows.groupBy("conv", "role", F.sha2("text", 256).alias("digest")).agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("first"))
    end = F.substring(F.rtrim("text", F.lit(SPACE)), -1, 1)
    flags = rows.select("conv", F.col("turn").cast("long").alias("turn"), "pos", F.substring("role", 1, 1).alias("initial"), (end == "").alias("blank"), (~end.isin(".", "!", "?")).alias("cut"))
    fault = F.when(F.col("blank"), "blank").when(F.col("first").isNull(), "duplicate").when(F.col("cut"), "truncated")
    initial = F.when(F.col("initial") == "s", 0).when(F.col("initial") == "u", 1).when(F.col("initial") == "a", 2).otherwise(3)
    code = F.when(F.coalesce(fault.isin("blank", "duplicate"), F.lit(False)), MUST).otherwise(initial + F.when(fault == "truncated", TRUNC).otherwise(0))
    return flags.join(first, "pos", "left").select("conv", "turn", "pos", F.shiftright("pos", 33).alias("part"), "initial", fault.alias("fault"), code.cast("int").alias("code"))


def stretches(table: pa.Table) -> tuple[dict[str, list], list[tuple[int, int]]]:
    """Columns of a range in order, and the first and last row of each conversation in it."""
    table = table.take(pa.array(np.argsort(table["pos"].to_numpy(), kind="stable")))
    conv = table["conv"].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    cuts = [0, *(np.flatnonzero(np.diff(conv)) + 1).tolist(), len(conv)]
    return {c: table[c].to_pylist() for c in table.column_names}, list(zip(cuts, cuts[1:], strict=False))


def borders(marked: DataFrame) -> list[list[Border]]:
    """Conversations that lie in more than one range, as their pieces. The driver sees at most two rows for each range."""
    conv = marked.schema["conv"].dataType.simpleString()

    def run(table: pa.Table) -> pa.Table:
        automaton = Automaton()
        rows, found = stretches(table)
        out = []
        for lo, hi in dict.fromkeys((found[0], found[-1])):
            costs = [x for q in range(STATES) for x in automaton.scan([0 if p == q else NEVER for p in range(STATES)], rows["code"][lo:hi])[2]]
            out.append((rows["conv"][lo], rows["part"][lo], rows["pos"][lo], rows["initial"][lo], rows["initial"][hi - 1], rows["turn"][lo], rows["turn"][hi - 1], costs))
        return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types(table), strict=True)], names=["conv", *(f.split()[0] for f in BORDERS.split(", "))])

    def types(table: pa.Table) -> list[pa.DataType]:
        return [table["conv"].type, pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64())]

    chains, last = [], -1
    for r in sorted(marked.groupBy("part").applyInArrow(run, f"conv {conv}, {BORDERS}").collect(), key=lambda r: r["at"]):
        piece = Border(r["conv"], r["at"], [r["costs"][STATES * q : STATES * q + STATES] for q in range(STATES)], (r["initial"], r["last_initial"]), (r["turn"], r["last_turn"]))
        if chains and r["part"] != last and chains[-1][-1].conv == piece.conv:
            chains[-1].append(piece)
        else:
            chains.append([piece])
        last = r["part"]
    return [c for c in chains if len(c) > 1]


def pieces_of(chain: list[Border]) -> dict[int, Piece]:
    into, togo = [START], [(0, NEVER, NEVER, 0)]
    for x in chain[:-1]:
        into.append(tuple(min(min(into[-1][p] + x.costs[p][q] for p in range(STATES)), NEVER) for q in range(STATES)))
    for x in chain[:0:-1]:
        togo.append(tuple(min(min(x.costs[p][q] + togo[-1][q] for q in range(STATES)), NEVER) for p in range(STATES)))
    return {x.at: Piece(i, t, x is chain[0], x is chain[-1]) for x, i, t in zip(chain, into, reversed(togo), strict=True)}


def audited(marked: DataFrame, pieces: dict[int, Piece]) -> DataFrame:
    """A row for each conversation in a range; for a piece of a longer one, a row for each state that a cheapest path may enter it in."""
    conv = marked.schema["conv"].dataType.simpleString()
    known = marked.sparkSession.sparkContext.broadcast(pieces)

    def run(table: pa.Table) -> pa.Table:
        automaton, whole = Automaton(), Piece()
        rows, found = stretches(table)
        out = []
        for lo, hi in found:
            at, codes, own = rows["pos"][lo], rows["code"][lo:hi], rows["fault"][lo:hi]
            piece = known.value.get(at, whole)
            states, _, ends = automaton.scan(list(piece.into), codes)
            begins = pruned(inserted(list(piece.into)))
            steps, enters = automaton.trace(states, codes, piece.togo, piece.final)
            turns = [x for x in rows["turn"][lo:hi] if x is not None]
            initials = rows["initial"][lo:hi]
            illegal = sum(x not in LEGAL for x in zip(initials, initials[1:], strict=False))
            counts = (*(own.count(x) for x in ("blank", "duplicate", "truncated")), illegal, *((turns[0], turns[-1]) if turns else (None, None)), len(set(turns)))
            for enter in [0] if piece.first else enters:
                audit, made, q = follow(steps, len(codes), enter)
                out.append((rows["conv"][lo], at, at not in known.value, enter, q, ends[q] - begins[enter], audit, [{"pos": None if k < 0 else rows["pos"][lo + k], "role": role} for k, role in made], *counts))
        kinds = [table["conv"].type, pa.int64(), pa.bool_(), pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.list_(pa.struct([("pos", pa.int64()), ("role", pa.string())])), *[pa.int64()] * 7]
        return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["conv", *AUDIT_NAMES])

    return marked.groupBy("part").applyInArrow(run, f"conv {conv}, {AUDITS}")


AUDIT_NAMES = ["at", "alone", "enter", "exit", "cost", "audit", "out", "blank", "duplicate", "truncated", "illegal", "least", "most", "turns"]


def repair(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Repair each conversation at the least cost, so that the initials of its roles are an optional s and then ua once or more, or nothing.

    Rows follow each other by turn, nulls first, then by role, the first 64 characters of the text and its digest; null roles and texts are one space. A row's first fault counts: ``blank``
    (ASCII white space alone), ``duplicate`` (role and text stood earlier), ``truncated`` (doesn't end in ``.``, ``!`` or ``?``). Keeping a row costs 0,
    another role 1, deleting 2, inserting an empty turn 5; truncated rows that stay cost 5 more; blank and duplicate ones must go.

    First result, a row for each conversation: ``conv_col``, ``gaps`` (turn numbers between the least and the greatest that are missing; 0 without any),
    ``blank``, ``duplicate``, ``truncated``, ``illegal`` (neighbouring initials other than su, ua, au), ``cost`` and ``audit`` (initials of the
    edits Keep, Rerole, Delete, Insert in order, the least in ASCII of the cheapest). Second result, the repaired turns: ``conv_col``, ``at`` and
    ``nth`` (their order), ``role``, ``text``. A null conversation is one of its own; one without rows isn't there, so
    an empty table gives no rows; other columns are not read.

    Rows are sorted into ranges, each scanned by one task with the automaton. Of a conversation that lies in several ranges each piece
    gives the cost from each state to each; the driver chains these, at most two rows a range, and each piece is traced on its own
    between the costs that come in and those to go. An audit is one string, which holds a letter for each row.
    """
    spark = turns.sparkSession
    rows = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit(" ")).alias("role"), F.coalesce(text_col, F.lit(" ")).alias("text"))
    # no key is long, as the driver sees samples of them; the last one lets equal rows lie in several ranges
    keys = ["conv", "turn", "role", F.substring("text", 1, PREFIX), F.sha2("text", 256), "nth"]
    rows = rows.withColumn("nth", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys).select("conv", "turn", "role", "text")
    rows = materialize(rows.withColumn("pos", F.monotonically_increasing_id()), "turns")
    marked = materialize(coded(rows), "marked")
    chains = borders(marked)
    audits = materialize(audited(marked, {k: v for c in chains for k, v in pieces_of(c).items()}), "audits")
    if chains:
        exits = {(r["at"], r["enter"]): r["exit"] for r in audits.where("not alone").select("at", "enter", "exit").collect()}
        taken = []
        for chain in chains:
            q, before = 0, None
            for x in chain:
                odd = before is not None and (before.initials[1], x.initials[0]) not in LEGAL
                twice = before is not None and x.turns[0] is not None and before.turns[1] == x.turns[0]
                taken.append((x.at, q, int(odd), int(twice)))
                q, before = exits[x.at, q], x
        taken = spark.createDataFrame(taken, "at long, enter int, odd long, twice long")
        audits = audits.where("alone").select("*", F.lit(0).alias("odd"), F.lit(0).alias("twice")).unionByName(audits.where("not alone").join(taken, ["at", "enter"]))
    else:
        audits = audits.select("*", F.lit(0).alias("odd"), F.lit(0).alias("twice"))
    audit = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "audit"))), lambda x: x["audit"]), "")
    gaps = F.max("most") - F.min("least") + 1 - F.sum(F.col("turns") - F.col("twice"))
    report = audits.groupBy(F.col("conv").alias(conv_col)).agg(
        F.coalesce(gaps, F.lit(0)).alias("gaps"), *(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")), F.sum(F.col("illegal") + F.col("odd")).alias("illegal"), F.sum("cost").alias("cost"), audit.alias("audit")
    )
    made = audits.select("conv", "at", F.posexplode("out").alias("nth", "made")).select("conv", "at", "nth", "made.pos", F.col("made.role").alias("given"))
    made = made.join(rows.select("pos", "role", "text"), "pos", "left").select(F.col("conv").alias(conv_col), "at", "nth", F.coalesce("given", "role").alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return report, made


def digests(repaired: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """``conv_col`` and ``sha256`` of the lines ``role:text`` of each conversation. A digest of all its turns can only be made in their order, so they
    pass one task; it holds one batch of them at a time."""
    kind = repaired.schema[conv_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, own, ids = None, None, None

        def done(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], ids), pa.array([r[1] for r in rows], pa.string())], names=[conv_col, "sha256"])

        for batch in batches:
            ids, rows = batch.column(0).type, []
            for conv, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if digest is not None and conv == own:
                    digest.update(b"\n")
                else:
                    if digest is not None:
                        rows.append((own, digest.hexdigest()))
                    digest, own = hashlib.sha256(), conv
                digest.update(line.encode("utf-8"))
            yield done(rows)
        if digest is not None:
            yield done([(own, digest.hexdigest())])

    rows = repaired.repartition(conv_col).sortWithinPartitions(conv_col, "at", "nth").select(conv_col, F.concat("role", F.lit(":"), "text"))
    return rows.mapInArrow(run, f"`{conv_col}` {kind}, sha256 string")


def damaged(turns: DataFrame) -> DataFrame:
    """Conversations with faults put in by the checksum of conversation and turn; nulls are one space there."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    role, text = F.coalesce("role", space), F.coalesce("text", space)
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.crc32(key.cast("binary")) % 20).alias("_h")).where("_h != 0")
    text = F.when(F.col("_h") == 1, "").when(F.col("_h") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(F.col("_h") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(F.col("_h") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))).alias("_n"))
    return rows.select("conv_id", "turn", "role", "text", F.explode("_n").alias("_n")).drop("_n")
