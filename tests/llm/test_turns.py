import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import numpy as np
from pyspark.sql.types import DateType, LongType, StringType, StructField, StructType

from folioframe.llm import turns
from folioframe.llm.queries import QUERIES

SPACE = " \t\n\x0b\x0c\r"
ROWS = StructType([StructField("conv_id", LongType()), StructField("turn", LongType()), StructField("role", StringType()), StructField("text", StringType())])


def cheapest(rows):
    """(cost, audit, lines) by trying states and edits row by row, keeping the least (cost, audit) of each state."""
    best = {"": (0, "", ())}        # state: role initial that came last, "" at the start

    def insert(best):
        for _ in range(2):
            for state, (cost, audit, lines) in list(best.items()):
                role = "assistant" if state == "u" else "user"
                new = (cost + 5, audit + "I", (*lines, f"{role}:"))
                if role[0] not in best or new < best[role[0]]:
                    best[role[0]] = new
        return best

    for role, text, fault in rows:
        best, now = insert(dict(best)), {}
        for state, (cost, audit, lines) in best.items():
            options = [(state, 2, "D", ())]
            if fault not in ("blank", "duplicate"):
                more, need = 5 * (fault == "truncated"), "assistant" if state == "u" else "user"
                options.append((need[0], more + 1, "R", (f"{need}:{text}",)))
                if role[:1] == need[0] or (role[:1] == "s" and state == ""):
                    options.append((role[0], more, "K", (f"{role}:{text}",)))
            for to, paid, letter, line in options:
                new = (cost + paid, audit + letter, lines + line)
                if to not in now or new < now[to]:
                    now[to] = new
        best = now
    best = insert(dict(best))
    return min(best[s] for s in ("", "a") if s in best)


def exhaustive(rows):
    """The same by trying every string of edits with few inserts; for short conversations only."""
    found = []
    for places in itertools.chain.from_iterable(itertools.combinations_with_replacement(range(len(rows) + 1), k) for k in range(4)):
        slots = []
        for i in range(len(rows) + 1):
            slots += [None] * places.count(i) + ([rows[i]] if i < len(rows) else [])
        for edits in itertools.product(*[("ua",) if s is None else ("D",) if s[2] in ("blank", "duplicate") else ("D", "K", "ru", "ra") for s in slots]):
            for inserted in itertools.product("ua", repeat=sum(s is None for s in slots)):
                left, out, audit, cost = list(inserted), "", "", 0
                for slot, edit in zip(slots, edits):
                    if slot is None:
                        out, audit, cost = out + left.pop(0), audit + "I", cost + 5
                    elif edit == "D":
                        audit, cost = audit + "D", cost + 2
                    else:
                        out += slot[0][:1] if edit == "K" else edit[1]
                        audit, cost = audit + ("K" if edit == "K" else "R"), cost + (edit != "K") + 5 * (slot[2] == "truncated")
                if re.fullmatch("(s?(ua)+)?", out):
                    found.append((cost, audit))
    return min(found)


def plain(table):
    """What ``report`` must return, computed conversation by conversation."""
    convs = defaultdict(list)
    for conv, turn, role, text in table:
        rows = convs[conv]
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if fault:
            text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
            rows += [(turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    out = {}
    for conv, rows in convs.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
        seen, marked = set(), []
        for _, role, text in rows:
            body = text.rstrip(SPACE)
            fault = "blank" if not body.strip(SPACE) else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
            seen.add((role, text))
            marked.append((role, text, fault))
        known = [t for t, _, _ in rows if t is not None]
        cost, audit, lines = cheapest(marked)
        count = lambda f: sum(m[2] == f for m in marked)
        out[conv] = (max(known) - min(known) + 1 - len(set(known)) if known else 0, count("blank"), count("duplicate"), count("truncated"),
                     sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(marked, marked[1:])), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def as_dict(df):
    return {r[0]: tuple(r[1:]) for r in df.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()}


def test_plain_version_is_the_definition():
    rng = random.Random(3)
    for _ in range(60):
        rows = [(rng.choice(["user", "assistant", "system", "tool"]), "x.", rng.choice(["", "", "blank", "truncated"])) for _ in range(rng.randint(0, 3))]
        assert cheapest(rows)[:2] == exhaustive(rows)


def test_tables_against_plain_search():
    rng = random.Random(5)
    roles = ["user", "assistant", "system", "tool"]
    for block in (1, 2, 4):
        tables = turns.Tables(block)
        for n in [*range(10), 57, 200]:
            for _ in range(12):
                symbols = [rng.choice(range(9)) for _ in range(n)]
                rows = [("x", "", "blank") if s == 8 else (roles[s // 2], "", "truncated" if s % 2 else "") for s in symbols]
                assert tables.solve(np.array(symbols, dtype=np.uint8)) == cheapest(rows)[:2]


def test_query_on_given_table(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    got = QUERIES["op11_turns"](spark, sf_dir)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert as_dict(got) == plain([tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()])


def test_odd_rows(spark):
    rng = random.Random(1)
    values = [None, "", " ", "\n\t", "word", "Done.", "Done.  \n", "long " * 20_000, "é?", "a\nb!"]
    rows = [(rng.choice([None, *range(12)]), rng.choice([None, None, 1, 2, 3, 5, 9, 9]), rng.choice([None, "", "user", "assistant", "system", "tool", "useful"]), rng.choice(values)) for _ in range(300)]
    rows += rows[:40] + [(77, i, "user" if i % 2 else "assistant", f"turn {i % 50}.") for i in range(3_000)] + [(78, 1, "user", "same.")] * 500
    names = ["conv", "symbol", "digest", "part", "copies", "again", "audit", "id"]
    odd = StructType([*ROWS.fields, *[StructField(n, DateType()) for n in names]])
    df = spark.createDataFrame([(*r, *[None] * len(names)) for r in rows], odd).repartition(5)
    assert as_dict(turns.report(df)) == plain(rows)
    assert turns.report(spark.createDataFrame([], odd)).count() == 0


def test_whole_conversation_dropped_and_repaired_rows(spark):
    gone = next(c for c in range(10_000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(gone, 0, "user", "Hello.")], ROWS)
    assert as_dict(turns.report(df)) == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    rows = turns.turns_of(spark.createDataFrame([(1, 0, "assistant", "Hi."), (1, 1, "assistant", "Yes."), (1, 2, "user", "And?"), (1, 3, "assistant", ""), (2, 0, "user", "")], ROWS))
    plans = turns.plan_edits(rows)
    assert {r["conv"]: r["audit"] for r in plans.collect()} == {1: "RKDD", 2: "D"}
    assert [tuple(r) for r in turns.repaired(rows, plans).orderBy("conv", "step").collect()] == [(1, 0, "R", "user", "Hi."), (1, 1, "K", "assistant", "Yes.")]
