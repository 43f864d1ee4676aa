import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.llm import turn_repair
from spanloom.llm.turn_repair import END, NEXT, STEP, TAIL, BlockTables

SCHEMA = "conv_id long, turn long, role string, text string, audit string"
SPACES = " \t\n\x0b\x0c\r"


def cheapest(symbols):
    """Every edit before every turn, without tables: (cost, edits)."""
    states = {0: (0, "")}
    for s in symbols:
        new = {}
        for state, (cost, text) in states.items():
            at = state
            for k in range(4):
                options = [("D", at, 3)]
                if s != 8:
                    options.append(("R", NEXT[at], 2 + s // 4))
                    if (at, s % 4) in STEP:
                        options.append(("K", STEP[at, s % 4], s // 4))
                for edit, to, price in options:
                    found = (cost + 2 * k + price, text + "I" * k + edit)
                    if to not in new or found < new[to]:
                        new[to] = found
                at = NEXT[at]
        states = new
    return min((cost + END[0][q], text + TAIL[q]) for q, (cost, text) in states.items())


def brute(rows):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, sha) of one conversation."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
    seen, symbols, counts = set(), [], [0, 0, 0, 0]
    for _, role, text in rows:
        ended = text.rstrip(SPACES)
        fault = 1 if not ended else 2 if (role, text) in seen else 3 if ended[-1] not in ".!?" else 0
        seen.add((role, text))
        counts[fault] += 1
        kind = "sua".index(role[0]) if role[:1] in ("s", "u", "a") else 3
        symbols.append(8 if fault in (1, 2) else kind + 4 * (fault == 3))
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    turns = [r[0] for r in rows if r[0] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    cost, audit = cheapest(symbols)
    lines, left, last = [], iter(rows), ""
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(left)[1:]
        if edit in "IR":
            role = "assistant" if last == "u" else "user"
        if edit != "D":
            lines.append(f"{role}:{text}")
            last = role[:1]
    assert re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in lines))
    return gaps, *counts[1:], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def report(spark, rows, ids=None):
    turns = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)
    ids = turns.select("conv_id").distinct() if ids is None else spark.createDataFrame([(i,) for i in ids], "conv_id long")
    return {r[0]: tuple(r)[1:] for r in turn_repair.whole_report(ids, turns).collect()}


def test_tables_against_plain_search():
    tables, rng = BlockTables(), random.Random(1)
    for _ in range(1500):
        symbols = [rng.choice([0, 1, 2, 1, 2, 3, 4, 5, 6, 7, 8]) for _ in range(rng.randrange(0, 14))]
        assert tables.solve(np.array(symbols, dtype=np.uint8)) == cheapest(symbols)


def test_long_conversation_is_linear():
    tables, rng = BlockTables(), random.Random(2)
    symbols = np.array([rng.randrange(9) for _ in range(40_000)], dtype=np.uint8)
    cost, audit = tables.solve(symbols)
    assert len(audit.replace("I", "")) == len(symbols) and cost > 0


def test_against_brute_force(spark):
    rng = random.Random(3)
    texts = ["Yes.", "No", "", " \t", "Why?  ", "So!\n", "Ärger.", "end "]
    rows = []
    for conv in range(60):
        for _ in range(rng.randrange(1, 12)):
            turn = rng.choice([None, *range(6)])
            rows.append((conv, turn, rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", "Ursel"]), rng.choice(texts)))
    got = report(spark, rows)
    for conv in range(60):
        assert got[conv] == brute([r[1:] for r in rows if r[0] == conv]), conv


def test_missing_values_empty_tables_and_repeats(spark):
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert report(spark, [], ids=[7, 8]) == {7: nothing, 8: nothing}
    assert report(spark, []) == {}
    got = report(spark, [(None, None, None, None), (None, 1, "user", "Hi."), (None, 1, "user", "Hi."), (None, 2, "assistant", "Yes" * 200_000)])
    assert got[None][:7] == (0, 1, 1, 1, 2, 7, "DKDK")


@pytest.mark.parametrize("n", [0, 20_000])
def test_damage(spark, n):
    rows = [(i, i % 7, "assistant", "One. Two!") for i in range(n // 10)] + [(None, None, None, None)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = sorted(map(tuple, turn_repair.damage(turns, F.col("conv_id"), F.col("turn")).collect()), key=str)
    want = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = role or " ", text or " "
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        want += [(conv, turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    assert got == sorted(want, key=str)
