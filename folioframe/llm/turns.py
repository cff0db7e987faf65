"""Repair of the turn structure of conversations: cheapest edits by Four-Russians block tables.

A repaired conversation has the roles ``(system? (user assistant)+)?``. Edits, in the order of ties: D(elete) 2, I(nsert) 5,
K(eep) 0, R(erole) 1; a truncated turn that stays adds 5; blank and duplicate turns must go. A turn is one of nine symbols (its
role's initial u, a, s or another, truncated or not; or one that must go). The cost from a position to the end is a vector over
four states (start, after s, after u, after a). Less its minimum it is one of a few dozen vectors, so the transition of every
vector by every block of ``BLOCK`` symbols is a table made once per task. A conversation is walked from its end, a block a
look-up, which leaves the vector behind each block; from the start on each block is then expanded backward into its positions'
vectors and the least letter that keeps to the optimum is taken. A letter fixes the next state, so the tracing never branches.

How rows move: faults and symbols come from windows over light rows (digests instead of texts) of a conversation, and a task
holds one byte a turn of one conversation while it walks, no more than the audit, which is one value of the result. Texts are
shuffled once, sorted behind their conversation's audit, and streamed row by row. SHA-256 of a whole conversation can only be
computed in order, by one task, however long it is; nothing is gathered for it.

Defined results: null conversation, role or text counts as one space in checks and in the repaired text (a null conversation is
one conversation, its id stays null); a null turn comes first. Rows of one turn are ordered by role, then by the SHA-256 of the
text. Repeated rows are duplicates. A role that is empty or has another initial cannot be kept. An empty table gives no rows.
Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..session import materialize

BLOCK = 4
DELETE, INSERT, REROLE, TRUNCATED = 2, 5, 1, 5
SPACE = " \t\n\x0b\x0c\r"
START, AFTER_S, AFTER_U, AFTER_A = range(4)
TURNS = {"u": AFTER_U, "a": AFTER_A}
# state -> (role that comes next by rerole or insert, state after it)
NEXT = {START: ("user", AFTER_U), AFTER_S: ("user", AFTER_U), AFTER_U: ("assistant", AFTER_A), AFTER_A: ("user", AFTER_U)}
# symbols: 2 * initial + truncated, and the turn that must go
INITIALS = "uas"
MUST_GO = 8
SYMBOLS = 9
MEMORY = 200_000


def after_keep(state: int, initial: int) -> int | None:
    """State after a kept turn of that initial (index in INITIALS, 3 for another), or None where it may not stand."""
    if initial == 2:
        return AFTER_S if state == START else None
    target = (AFTER_U, AFTER_A, None)[initial] if initial < 2 else None
    return target if target is not None and NEXT[state][1] == target else None


def with_inserts(costs: list) -> tuple:
    """Costs of a position once empty turns may be inserted before what follows; two in a row at most pay."""
    for _ in range(2):
        costs = [min(c, INSERT + costs[NEXT[s][1]]) for s, c in enumerate(costs)]
    return tuple(costs)


END = with_inserts([0, 10 ** 6, 10 ** 6, 0])


def before(costs: tuple, symbol: int) -> tuple:
    """Costs in front of a turn from those behind it."""
    out = [DELETE + c for c in costs]
    if symbol != MUST_GO:
        initial, more = symbol // 2, TRUNCATED * (symbol % 2)
        for s in range(4):
            kept = after_keep(s, initial)
            if kept is not None:
                out[s] = min(out[s], more + costs[kept])
            out[s] = min(out[s], more + REROLE + costs[NEXT[s][1]])
    return with_inserts(out)


class Tables:
    """All vectors reachable from the end, and their transitions by one symbol and by a block."""

    def __init__(self, block: int = BLOCK):
        self.block = block
        floor = min(END)
        self.vectors = [tuple(c - floor for c in END)]
        at = {self.vectors[0]: 0}
        one, paid = [], []
        for v in self.vectors:              # grows while it is read
            row, costs = [], []
            for symbol in range(SYMBOLS):
                new = before(v, symbol)
                low = min(new)
                key = tuple(c - low for c in new)
                if key not in at:
                    at[key] = len(self.vectors)
                    self.vectors.append(key)
                row.append(at[key])
                costs.append(low)
            one.append(row)
            paid.append(costs)
        self.one, self.one_cost = np.array(one), np.array(paid)
        moves, costs = self.one, self.one_cost
        for _ in range(block - 1):          # a block's last symbol is applied first
            costs = (costs[self.one] + self.one_cost[:, :, None]).transpose(0, 2, 1).reshape(len(one), -1)
            moves = moves[self.one].transpose(0, 2, 1).reshape(len(one), -1)
        self.moves, self.costs = moves.tolist(), costs.tolist()
        self.weights = SYMBOLS ** np.arange(block - 1, -1, -1)
        self.memory: dict = {}

    def expand(self, symbols: tuple, vector: int, state: int) -> tuple[str, int]:
        """Edits of the symbols in front of ``vector``, and the state behind them."""
        key = (symbols, vector, state)
        if key in self.memory:
            return self.memory[key]
        costs = [self.vectors[vector]]
        for symbol in reversed(symbols):
            costs.append(before(costs[-1], symbol))
        costs.reverse()
        letters = []
        for i, symbol in enumerate(symbols):
            initial, more = symbol // 2, TRUNCATED * (symbol % 2)
            while True:
                left, behind = costs[i][state], costs[i + 1]
                kept = after_keep(state, initial) if symbol != MUST_GO else None
                if left == DELETE + behind[state]:
                    letters.append("D")
                    break
                if left == INSERT + costs[i][NEXT[state][1]]:
                    letters.append("I")
                    state = NEXT[state][1]
                    continue
                if kept is not None and left == more + behind[kept]:
                    letters.append("K")
                    state = kept
                else:
                    letters.append("R")
                    state = NEXT[state][1]
                break
        if len(self.memory) >= MEMORY:
            self.memory.clear()
        self.memory[key] = "".join(letters), state
        return self.memory[key]

    def solve(self, symbols: np.ndarray) -> tuple[int, str]:
        """Cost and letters of the cheapest edits."""
        head = len(symbols) % self.block
        blocks = symbols[head:].reshape(-1, self.block)
        numbers = (blocks @ self.weights).tolist()
        vector, cost, behind = 0, min(END), []
        for number in reversed(numbers):
            behind.append(vector)
            cost += self.costs[vector][number]
            vector = self.moves[vector][number]
        first = vector
        for symbol in reversed(symbols[:head].tolist()):
            cost += int(self.one_cost[vector, symbol])
            vector = int(self.one[vector, symbol])
        cost += self.vectors[vector][START]
        letters, state = self.expand(tuple(symbols[:head].tolist()), first, START)
        parts = [letters]
        for i, row in enumerate(blocks.tolist()):
            letters, state = self.expand(tuple(row), behind[len(numbers) - 1 - i], state)
            parts.append(letters)
        while END[state]:
            parts.append("I")
            state = NEXT[state][1]
        return cost, "".join(parts)


def damage(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The rows with faults planted by a checksum of conversation and turn: columns conv, turn, role, text, copies."""
    as_text = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(as_text(conv), F.lit(":"), as_text(turn))) % 20
    rows = df.select(F.col(f"`{conv}`").alias("conv"), F.col(f"`{turn}`").alias("turn"), as_text(role).alias("role"), as_text(text).alias("text"), fault.alias("fault"))
    body = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return rows.where("fault <> 0").select(
        "conv", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"), body.alias("text"), F.when(F.col("fault") == 3, 2).otherwise(1).alias("copies"))


def turns_of(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A table of turns in the columns that the functions below take."""
    as_text = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    return df.select(F.col(f"`{conv}`").alias("conv"), F.col(f"`{turn}`").alias("turn"), as_text(role).alias("role"), as_text(text).alias("text"), F.lit(1).alias("copies"))


def _digest() -> Column:
    return F.unhex(F.sha2("text", 256))


def plan_edits(rows: DataFrame) -> DataFrame:
    """One row per conversation: conv, gaps, blank, duplicate, truncated, illegal, cost and audit."""
    body = F.rtrim(F.col("text"), F.lit(SPACE))
    initial = F.substring("role", 1, 1)
    light = rows.select("conv", "turn", "role", initial.alias("initial"), "copies", _digest().alias("digest"), (body == "").alias("blank"),
                        (~F.right(body, F.lit(1)).isin(".", "!", "?")).alias("cut")).repartition("conv")
    same = Window.partitionBy("conv", "role", "digest").orderBy("turn")
    line = Window.partitionBy("conv").orderBy("turn", "role", "digest")
    light = light.withColumn("again", F.row_number().over(same) > 1)
    symbol = F.when(F.col("blank") | F.col("again"), MUST_GO).otherwise(
        2 * F.when(F.col("initial") == "u", 0).when(F.col("initial") == "a", 1).when(F.col("initial") == "s", 2).otherwise(3) + F.col("cut").cast("int"))
    pair = F.concat(F.lag("initial").over(line), F.col("initial"))
    state = light.select(
        "conv", "turn", "role", "digest", "copies", symbol.alias("symbol"), "blank", "again",
        F.coalesce(~pair.isin("su", "ua", "au"), F.lit(False)).alias("illegal"), (F.row_number().over(line) == 1).alias("first"),
        (F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(F.lag("turn").over(line))).alias("new_turn"))
    state = state.sortWithinPartitions("conv", "turn", "role", "digest").select(
        "conv", F.col("turn").cast("long").alias("turn"), "copies", "symbol", "blank", "again", "illegal", "first", "new_turn")
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    schema = StructType([rows.schema["conv"], *[StructField(n, LongType()) for n in numbers], StructField("audit", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = Tables()
        open_conv, parts, sums = None, [], None

        def close() -> tuple:
            cost, audit = tables.solve(np.concatenate(parts))
            low, high, distinct, blank, again, cut, illegal = sums
            return (0 if low is None else high - low + 1 - distinct, blank, again, cut, illegal, cost, audit)

        for batch in batches:
            ids, done_ids, done = batch.column(0), [], []
            turn, known = batch.column(1).fill_null(0).to_numpy(), batch.column(1).is_valid().to_numpy(zero_copy_only=False)
            copies, symbol = batch.column(2).to_numpy(), batch.column(3).to_numpy().astype(np.int64)
            blank, again, illegal, first, new_turn = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4, 9))
            cuts = np.nonzero(first)[0].tolist()
            for k, (lo, hi) in enumerate(zip([0, *cuts], [*cuts, len(symbol)])):
                if k:           # a conversation begins; the rows before the first cut belong to the open one
                    if open_conv is not None:
                        done_ids.append(open_conv)
                        done.append(close())
                    open_conv, parts, sums = ids.slice(lo, 1), [], [None, None, 0, 0, 0, 0, 0]
                if lo == hi:
                    continue
                part = slice(lo, hi)
                # of the copies of a row all but the first are duplicates
                spread = np.repeat(symbol[part], copies[part])
                starts = np.cumsum(copies[part]) - copies[part]
                later = np.ones(len(spread), dtype=bool)
                later[starts] = False
                spread[later] = MUST_GO
                parts.append(spread.astype(np.uint8))
                extra, b = copies[part] - 1, blank[part]
                if known[part].any():
                    seen = turn[part][known[part]]
                    sums[0] = int(seen[0]) if sums[0] is None else sums[0]
                    sums[1] = int(seen[-1])
                sums[2] += int(new_turn[part].sum())
                sums[3] += int((b * copies[part]).sum())
                sums[4] += int((~b & again[part]).sum() + (~b * extra).sum())
                sums[5] += int(((symbol[part] < MUST_GO) & (symbol[part] % 2 == 1)).sum())
                sums[6] += int(illegal[part].sum() + extra.sum())
            if done:
                yield _batch(done_ids, done)
        if open_conv is not None:
            yield _batch([open_conv], [close()])

    def _batch(ids: list, done: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.concat_arrays(ids), *[pa.array([d[i] for d in done], pa.int64()) for i in range(6)], pa.array([d[6] for d in done], pa.string())],
                                          names=[schema.fields[0].name, *numbers, "audit"])

    return state.mapInArrow(run, schema)


def _edited(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """Texts behind their conversation's audit, sorted, with a mark where a conversation begins."""
    heads = plans.select("conv", F.lit(0).alias("part"), F.lit(None).cast(rows.schema["turn"].dataType).alias("turn"), F.lit(None).cast("string").alias("role"),
                         F.lit(None).cast("binary").alias("digest"), F.col("audit").alias("text"), F.lit(0).alias("copies"))
    both = heads.unionByName(rows.select("conv", F.lit(1).alias("part"), "turn", "role", _digest().alias("digest"), "text", "copies"))
    return both.repartition("conv").sortWithinPartitions("conv", "part", "turn", "role", "digest").select("conv", "part", "role", "text", "copies")


def _follow(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
    """Per batch the events of its conversations in order: (conv,) at a start, (edit, role, text) for a turn that stays, () at an end."""
    audit, at, state, inside = "", 0, START, False

    def inserts() -> Iterator[tuple]:
        nonlocal at, state
        while at < len(audit) and audit[at] == "I":
            role, state = NEXT[state]
            at += 1
            yield "I", role, ""

    for batch in batches:
        ids, events = batch.column(0), []
        for i, (part, role, text, copies) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(1, 5)))):
            if part == 0:
                if inside:
                    events.extend(inserts())
                    events.append(())
                audit, at, state, inside = text, 0, START, True
                events.append((ids.slice(i, 1),))
                continue
            for _ in range(copies):
                events.extend(inserts())
                letter = audit[at]
                at += 1
                if letter == "R":
                    role_now, state = NEXT[state]
                    events.append(("R", role_now, text))
                elif letter == "K":
                    state = TURNS.get(role[0], AFTER_S)
                    events.append(("K", role, text))
        yield events
    if inside:
        yield [*inserts(), ()]


def repaired(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """The repaired conversations, a row a turn: conv, step (from 0), edit (K, R or I), role and text."""
    schema = StructType([rows.schema["conv"], StructField("step", LongType()), *[StructField(c, StringType()) for c in ("edit", "role", "text")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, step = None, 0
        for events in _follow(batches):
            ids, out = [], []
            for event in events:
                if len(event) == 1:
                    conv, step = event[0], 0
                elif event:
                    ids.append(conv)
                    out.append((step, *event))
                    step += 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(ids), *[pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.string(), pa.string(), pa.string()))]],
                                                 names=schema.names)

    return _edited(rows, plans).mapInArrow(run, schema)


def digests(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """SHA-256 of each repaired conversation, its ``role:text`` joined by newlines: conv, repaired_sha256."""
    schema = StructType([rows.schema["conv"], StructField("repaired_sha256", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state, started = None, None, False
        for events in _follow(batches):
            ids, out = [], []
            for event in events:
                if len(event) == 1:
                    conv, state, started = event[0], hashlib.sha256(), False
                elif event:
                    state.update(f"{chr(10) if started else ''}{event[1]}:{event[2]}".encode())
                    started = True
                else:
                    ids.append(conv)
                    out.append(state.hexdigest())
            if out:
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(ids), pa.array(out, pa.string())], names=schema.names)

    return _edited(rows, plans).mapInArrow(run, schema)


def report(df: DataFrame, label: str = "turns") -> DataFrame:
    """Audit and digest of every conversation of ``df`` (conv_id, turn, role, text) after the planted damage."""
    rows = damage(df)
    plans = materialize(plan_edits(rows), label)
    names = [c for c in plans.columns if c not in ("conv", "audit")]
    empty = hashlib.sha256(b"").hexdigest()
    out = df.select(F.col("conv_id").alias("id")).distinct()
    for found in (plans, digests(rows, plans)):
        out = out.join(found, F.col("id").eqNullSafe(F.col("conv")), "left").drop("conv")
    return out.select(F.col("id").alias("conv_id"), *[F.coalesce(n, F.lit(0).cast("long")).alias(n) for n in names],
                      F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"))
