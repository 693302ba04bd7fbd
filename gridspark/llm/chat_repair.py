"""Conversation structure repair by Four-Russians block tables.

The turns of a conversation are symbols; a cheapest list of edits makes their role initials match ``(s?(ua)+)?``. The four
states of that expression carry a vector of least costs. Less its minimum, and without states that can never be on a
cheapest path, only a few such vectors exist, so the step of every vector over every block of ``BLOCK`` symbols is
worked out once. A conversation is read block by block through that table; its blocks are then expanded from the last to
the first, marking the states on cheapest paths, and the edits are read off from the front, always the least letter.

One row a turn goes through the solver, without its text: a digest stands for it, and equal rows travel as one with their
number. Rows of a conversation pass one task in order, as the digest of its repaired text is a sequence; that task keeps
keys and symbols of one conversation, never its texts, which are hashed as they stream by.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 4
KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 1, 2, 5, 5  # costs; CUT_OFF for a truncated row that stays
ROLES = ("user", "assistant")
# States: nothing yet, after s, after u, after a. Class of a role: s, u, a, any other.
START, SYSTEM, USER, ASSISTANT = range(4)
AFTER = {(START, 0): SYSTEM, (START, 1): USER, (SYSTEM, 1): USER, (USER, 2): ASSISTANT, (ASSISTANT, 1): USER}
TURN = (1, 1, 2, 1)  # the class of the only user or assistant turn that may follow a state
NEXT = tuple(AFTER[p, TURN[p]] for p in range(4))
DOOMED = 8  # symbol of a row that has to go; others are class + 4 if truncated
SYMBOLS = 9
LEGAL = np.zeros((4, 4), bool)
for _pair in ((0, 1), (1, 2), (2, 1)):
    LEGAL[_pair] = True
FAR = 1 << 40


def choices(state: int, symbol: int) -> Iterator[tuple[str, int, int]]:
    """Edits of one row as (letter, cost, next state), in the order of their letters."""
    yield "D", DELETE, state
    if symbol != DOOMED:
        extra, klass = (CUT_OFF, symbol - 4) if symbol >= 4 else (0, symbol)
        if (state, klass) in AFTER:
            yield "K", KEEP + extra, AFTER[state, klass]
        yield "R", REROLE + extra, NEXT[state]


def settled(costs: list[int]) -> tuple[tuple[int, ...], int]:
    """The vector after insertions, less its minimum; states that never lie on a cheapest path are FAR.

    What follows a system turn may as well follow an assistant turn, and what follows the start too, but for a system turn
    that it may keep and the other deletes.
    """
    v = list(costs)
    for _ in range(2):  # two insertions lead from any state to any that insertions reach
        for p in range(4):
            v[NEXT[p]] = min(v[NEXT[p]], v[p] + INSERT)
    if v[SYSTEM] > v[ASSISTANT]:
        v[SYSTEM] = FAR
    if v[START] > v[ASSISTANT] + DELETE:
        v[START] = FAR
    low = min(v)
    return tuple(FAR if c >= FAR else c - low for c in v), low


def step(vector: tuple[int, ...], symbol: int) -> tuple[tuple[int, ...], int]:
    out = [FAR] * 4
    for p, cost in enumerate(vector):
        if cost < FAR:
            for _, more, q in choices(p, symbol):
                out[q] = min(out[q], cost + more)
    return settled(out)


class BlockTables:
    """All vectors that can occur, their steps by symbol, and by block of ``BLOCK`` symbols."""

    def __init__(self, block: int = BLOCK):
        first, base = settled([0, FAR, FAR, FAR])
        self.base, self.block, self.vectors = base, block, [first]
        known, steps = {first: 0}, []
        for vector in self.vectors:  # grows while new vectors turn up
            row = []
            for symbol in range(SYMBOLS):
                after, cost = step(vector, symbol)
                if after not in known:
                    known[after] = len(self.vectors)
                    self.vectors.append(after)
                row.append((known[after], cost))
            steps.append(row)
        one = np.array(steps, np.int64)
        self.one_next, self.one_cost = one[..., 0].tolist(), one[..., 1].tolist()
        after, cost = one[..., 0], one[..., 1]
        for _ in range(block - 1):  # the block's code is its symbols as digits
            cost = (cost[..., None] + one[after, :, 1]).reshape(len(one), -1)
            after = one[after, :, 0].reshape(len(one), -1)
        self.next, self.cost = after.tolist(), cost.tolist()
        self.back = lru_cache(None)(self._back)
        self.read = lru_cache(None)(self._read)

    def _widen(self, vector: int, marked: int) -> int:
        """Add the states from which insertions lead, at no loss, to a marked state."""
        v = self.vectors[vector]
        for _ in range(2):
            for p in range(4):
                if v[p] < FAR and marked >> NEXT[p] & 1 and v[p] + INSERT == v[NEXT[p]]:
                    marked |= 1 << p
        return marked

    def _back(self, vector: int, symbol: int, marked: int) -> int:
        """States before a symbol on cheapest paths, given those after it."""
        v, after, cost = self.vectors[vector], self.vectors[self.one_next[vector][symbol]], self.one_cost[vector][symbol]
        found = 0
        for p in range(4):
            if v[p] < FAR and any(marked >> q & 1 and v[p] + more == after[q] + cost for _, more, q in choices(p, symbol)):
                found |= 1 << p
        return self._widen(vector, found)

    def _read(self, vector: int, symbol: int, here: int, marked: int, state: int) -> tuple[str, str, int, int]:
        """Least letters from a marked state over one symbol: insertions, the edit, the turn's class, the next state."""
        v, after, cost = self.vectors[vector], self.vectors[self.one_next[vector][symbol]], self.one_cost[vector][symbol]
        inserted = ""
        while True:
            fits = [(letter, q) for letter, more, q in choices(state, symbol) if marked >> q & 1 and v[state] + more == after[q] + cost]
            goes_on = here >> NEXT[state] & 1 and v[state] + INSERT == v[NEXT[state]]
            if goes_on and (not fits or fits[0][0] > "I"):
                inserted += str(TURN[state])
                state = NEXT[state]
                continue
            letter, q = fits[0]
            return inserted, letter, TURN[state], q

    def repair(self, symbols: np.ndarray) -> tuple[int, list[tuple[str, str, int]], str]:
        """Least cost, one (inserted classes, letter, class of a rerolled turn) a symbol, and classes inserted at the end."""
        size, whole = len(symbols), len(symbols) // self.block * self.block
        digits = SYMBOLS ** np.arange(self.block - 1, -1, -1)
        codes = (symbols[:whole].astype(np.int64).reshape(-1, self.block) @ digits).tolist()
        symbols = symbols.tolist()
        edges, vector, cost = [], 0, self.base
        for code in codes:
            edges.append(vector)
            cost += self.cost[vector][code]
            vector = self.next[vector][code]
        if whole < size:
            edges.append(vector)
            for s in symbols[whole:]:
                cost += self.one_cost[vector][s]
                vector = self.one_next[vector][s]
        v = self.vectors[vector]
        best = min(v[START], v[ASSISTANT])
        cost += best
        end = self._widen(vector, sum(1 << q for q in (START, ASSISTANT) if v[q] == best))
        marks, vectors = [end], []
        for k in range(len(edges) - 1, -1, -1):
            inside, vector = [], edges[k]
            part = symbols[k * self.block:(k + 1) * self.block]
            for s in part:
                inside.append(vector)
                vector = self.one_next[vector][s]
            for vector, s in zip(reversed(inside), reversed(part)):
                marks.append(self.back(vector, s, marks[-1]))
                vectors.append(vector)
        edits, state = [], START
        for i, s in enumerate(symbols):
            inserted, letter, turn, state = self.read(vectors[size - 1 - i], s, marks[size - i], marks[size - 1 - i], state)
            edits.append((inserted, letter, turn))
        tail = ""
        while v[state] != best or state not in (START, ASSISTANT):
            tail += str(TURN[state])
            state = NEXT[state]
        return cost, edits, tail


# Damage and faults, as expressions ---------------------------------------------------------------------------------

SPACES = r"\x20\x09-\x0D"


def damaged(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv, turn, role, text) after the damage that crc32 of ``conv:turn``, modulo 20, selects.

    0 drops a row, 1 empties its text, 2 removes its ``[.!?]``, 3 repeats it, 4 makes it a user turn. NULL roles, texts
    and parts of the key read as one space.
    """
    c, t, space = F.col(f"`{conv}`"), F.col(f"`{turn}`"), F.lit(" ")
    part = lambda x: F.coalesce(x.cast("string"), space)
    kind = F.crc32(F.concat(part(c), F.lit(":"), part(t))) % 20
    body = part(F.col(f"`{text}`"))
    out = rows.select(
        c.alias("conv"), t.cast("bigint").alias("turn"),
        F.when(kind == 4, F.lit("user")).otherwise(part(F.col(f"`{role}`"))).alias("role"),
        F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace(body, "[.!?]", "")).otherwise(body).alias("text"),
        kind.alias("kind")).where("kind <> 0")
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return out.withColumn("_copy", F.explode(copies)).drop("kind", "_copy")


def _mark(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


ORDER = ["conv", "rank", "turn", "role", "mark"]


def _keys(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """One row for equal turns, with their number, class and fault, and one row of number 0 for each conversation."""
    blank = ~F.col("text").rlike(f"[^{SPACES}]")
    cut = ~F.col("text").rlike(rf"[.!?][{SPACES}]*\z")
    counted = rows.select("conv", "turn", "role", _mark(F.col("text")).alias("mark"),
                          F.when(blank, 1).when(cut, 3).otherwise(0).alias("fault")).groupBy(
        "conv", "turn", "role", "mark").agg(F.count(F.lit(1)).alias("n"), F.first("fault").alias("fault"))
    # The turn at which a role first says a text; NULL turns come first.
    earliest = counted.groupBy("conv", "role", "mark").agg(
        F.min(F.struct(F.col("turn").isNotNull().alias("b"), "turn")).alias("least"))
    same = [F.col(f"k.{c}").eqNullSafe(F.col(f"e.{c}")) for c in ("conv", "role", "mark")]
    joined = counted.alias("k").join(earliest.alias("e"), same[0] & same[1] & same[2])
    again = ~F.col("k.turn").eqNullSafe(F.col("e.least.turn"))
    initial = F.substring("k.role", 1, 1)
    klass = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    out = joined.select("k.conv", F.lit(1).alias("rank"), "k.turn", "k.role", "k.mark", "k.n", klass.alias("klass"),
                        F.when((F.col("k.fault") != 1) & again, 2).otherwise(F.col("k.fault")).alias("fault"))
    marker = ids.select("conv", F.lit(0).alias("rank"), F.lit(None).cast("bigint").alias("turn"), F.lit("").alias("role"),
                        F.lit(None).cast("binary").alias("mark"), F.lit(0).cast("bigint").alias("n"),
                        F.lit(3).alias("klass"), F.lit(0).alias("fault"))
    return out.unionByName(marker)


# Inserted turns, the edit, and the class of a changed turn.
LETTERS = re.compile("([12]*)([DKR]?)([12]?)")
EDIT = "conv {0}, rank int, turn bigint, role string, mark binary, kind int, letters string, summary struct<{1}>, text string"
SUMMARY = ("gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string")


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole conversations; each conversation begins with its row of rank 0."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        starts = np.flatnonzero(batch.column("rank").to_numpy() == 0)
        if len(starts):
            last = int(starts[-1])
            held.append(batch.slice(0, last))
            yield pa.Table.from_batches(held)
            held, batch = [], batch.slice(last)
        held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def _solve(tables: BlockTables, n: np.ndarray, klass: np.ndarray, fault: np.ndarray, turns: np.ndarray) -> tuple[dict, list[str]]:
    """The summary of one conversation, and the letters for the first copy of each of its rows and for its end."""
    first = np.cumsum(n) - n
    live = n > 0
    symbols = np.full(int(n.sum()), DOOMED)
    symbols[first[live]] = np.where((fault == 1) | (fault == 2), DOOMED, klass + 4 * (fault == 3))[live]
    classes = np.repeat(klass, n)
    cost, edits, tail = tables.repair(symbols)
    counts = lambda k: int(n[fault == k].sum())
    summary = {
        "gaps": int(turns.max() - turns.min()) + 1 - len(np.unique(turns)) if len(turns) else 0, "blank": counts(1),
        "duplicate": counts(2) + int((n[live & (fault != 1) & (fault != 2)] - 1).sum()), "truncated": int((live & (fault == 3)).sum()),
        "illegal": int((~LEGAL[classes[:-1], classes[1:]]).sum()), "cost": cost,
        "audit": "".join("I" * len(i) + letter for i, letter, _ in edits) + "I" * len(tail)}
    letters, pending = [], ""
    for at, many in zip(first.tolist(), n.tolist()):  # later copies are deleted; turns inserted before them stand before the next row
        if many:
            inserted, letter, turn = edits[at]
            letters.append(pending + inserted + letter + (str(turn) if letter == "R" else ""))
            pending = "".join(i for i, _, _ in edits[at + 1:at + many]) if many > 1 else ""
        else:
            letters.append("")
    return summary, [*letters, pending + tail]


def repair_conversations(rows: DataFrame, conv: str, turn: str, role: str, text: str, ids: DataFrame) -> DataFrame:
    """Find and mend faults of the turns of each conversation.

    ``rows`` has one row a turn (NULL role or text: one space), ordered by turn with NULL turns first, then by role and
    digest of the text; ``ids`` has, in ``conv``, each conversation to report, also those without rows. Returns one row for each: (conv, turns in sequence
    that are missing as ``gaps``, rows by first fault ``blank``, ``duplicate``, ``truncated``, ``illegal`` neighbours, least
    ``cost``, its ``audit``, and ``repaired_sha256`` of the ``role:text`` lines that the edits leave). A NULL id is a
    conversation like others, and an unknown or empty role has to be changed or deleted.
    """
    name = f"`{conv}`"
    rows = rows.select(F.col(name).alias("conv"), F.col(f"`{turn}`").cast("bigint").alias("turn"),
                       F.coalesce(F.col(f"`{role}`"), F.lit(" ")).alias("role"), F.coalesce(F.col(f"`{text}`"), F.lit(" ")).alias("text"))
    ids = ids.select(F.col(name).alias("conv")).distinct()
    kind = rows.schema["conv"].dataType.simpleString()
    schema = EDIT.format(kind, SUMMARY)
    keys = _keys(rows, ids).repartition("conv").sortWithinPartitions(*ORDER)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = BlockTables()
        for part in _whole(batches):
            rank, n, klass, fault = (part[c].to_numpy() for c in ("rank", "n", "klass", "fault"))
            known, turns = part["turn"].is_valid().to_numpy(), part["turn"].fill_null(0).to_numpy()
            starts = np.flatnonzero(rank == 0)
            letters, tails, summaries = [], [], []
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(rank)]):
                summary, own = _solve(tables, n[a:b], klass[a:b], fault[a:b], turns[a:b][known[a:b]])
                letters += own[:-1]
                tails.append(own[-1])
                summaries.append(summary)
            rows, ends = len(rank), len(starts)
            body = [*(part[c].combine_chunks() for c in ORDER), pa.array(np.zeros(rows, np.int32)), pa.array(letters, pa.string()),
                    pa.nulls(rows, SUMMARY_ARROW), pa.nulls(rows, pa.string())]
            end = [part["conv"].take(pa.array(starts)).combine_chunks(), pa.array(np.full(ends, 2, np.int32)), pa.nulls(ends, pa.int64()),
                   pa.array([""] * ends, pa.string()), pa.nulls(ends, pa.binary()), pa.array(np.zeros(ends, np.int32)),
                   pa.array(tails, pa.string()), pa.array(summaries, SUMMARY_ARROW), pa.nulls(ends, pa.string())]
            for columns in (body, end):
                yield pa.RecordBatch.from_arrays(columns, names=[*ORDER, "kind", "letters", "summary", "text"])

    edits = keys.mapInArrow(solve, schema).where("rank > 0")
    texts = rows.select("conv", F.lit(1).alias("rank"), "turn", "role", _mark(F.col("text")).alias("mark"), F.lit(1).alias("kind"),
                        F.lit(None).cast("string").alias("letters"), F.lit(None).cast(f"struct<{SUMMARY}>").alias("summary"), "text")
    stream = edits.unionByName(texts).repartition("conv").sortWithinPartitions(*ORDER, "kind")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, letters, sha, lines = [], None, hashlib.sha256(), 0
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("conv", "rank", "kind", "letters", "summary", "role", "text")]
            for key, rank, kind, edit, summary, who, said in zip(*columns):
                if kind == 0:
                    letters = edit
                if letters is None or (kind == 0 and rank == 1):
                    continue  # a later copy, or letters for the text that comes next
                inserted, letter, turn = LETTERS.match(letters).groups()
                written = [f"{ROLES[int(c) - 1]}:" for c in inserted]
                if letter in ("K", "R"):
                    written.append(f"{ROLES[int(turn) - 1] if turn else who}:{said}")
                letters = None
                for line in written:
                    sha.update((b"\n" if lines else b"") + line.encode())
                    lines += 1
                if rank == 2:
                    out.append((key, *summary.values(), sha.hexdigest()))
                    sha, lines = hashlib.sha256(), 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)
                out = []

    result = f"conv {kind}, {SUMMARY}, repaired_sha256 string"
    names = [f.split()[0] for f in result.split(", ")]
    types = [_PLAIN[kind], *[_PLAIN[f.split()[1]] for f in SUMMARY.split(", ")], pa.string()]
    return stream.mapInArrow(digest, result)


_PLAIN = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
SUMMARY_ARROW = pa.struct([(f.split()[0], _PLAIN[f.split()[1]]) for f in SUMMARY.split(", ")])
