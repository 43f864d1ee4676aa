"""Repair of damaged conversations with Four-Russians block tables.

A conversation is repaired by edits of least cost: keep a turn (K), give it
another role (R), delete it (D), insert an empty turn (I), such that the roles'
initials read ``(s?(ua)+)?``. The automaton of that pattern has four states, so
a prefix of a conversation is known by its costs in the four states; less their
least they form few vectors. For every vector and every block of four turn
symbols the next vector and the added cost stand in a table; a conversation is
priced by one lookup a block. The edits follow from the last block to the first:
each is expanded turn by turn against the cost and the order among the rests of
the edit text, which is all that is needed to break ties towards the smallest text.

Spark deals conversations by their id and sorts them. A conversation is held
as one byte a turn, no more than the edit text that it must give back; turns and
texts only stream by.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.session import cut_lineage

SPACES = " \t\n\x0b\x0c\r"
BLOCK = 4
#: Turn symbols: initial s, u, a or another, plus 4 if truncated; a turn that must go; no turn.
MUST_GO, NO_TURN = 8, 9
SYMBOLS = 10
RETAIN, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: States: nothing yet, after s, after u, after a. Where an initial leads, and where an inserted or reroled turn does.
STEP = {(0, 0): 1, (0, 1): 2, (1, 1): 2, (2, 2): 3, (3, 1): 2}
NEXT = (2, 2, 3, 2)
#: Cost and rank of the inserts that end a conversation.
TAIL = ("", "II", "I", "")
END = ((0, 4, 2, 0), (0, 2, 1, 0))
#: A state this much above the least cost can be replaced by another state for any rest, so it takes part in no cheapest edit.
FAR = 8
NEVER = 99
REPORT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def moves(symbol: int) -> list[list[tuple[str, int, int]]]:
    """By state: (edits up to and with this turn, next state, cost)."""
    out = []
    for state in range(4):
        found, at = [], state
        if symbol == NO_TURN:
            found.append(("", state, 0))
        for k in range(3 if symbol != NO_TURN else 0):
            found.append(("I" * k + "D", at, INSERT * k + DELETE))
            if symbol != MUST_GO:
                extra = INSERT * k + TRUNCATED * (symbol // 4)
                if (at, symbol % 4) in STEP:
                    found.append(("I" * k + "K", STEP[at, symbol % 4], extra + RETAIN))
                found.append(("I" * k + "R", NEXT[at], extra + REROLE))
            at = NEXT[at]
        out.append(found)
    return out


class BlockTables:
    """Transitions of normalised cost vectors for every block, and blocks expanded backwards as they occur."""

    def __init__(self) -> None:
        self.moves = [moves(s) for s in range(SYMBOLS)]
        vectors = [(0, NEVER, NEVER, NEVER)]
        known = {vectors[0]: 0}
        one: list[list[tuple[int, int]]] = []
        for vector in vectors:  # grows until no new vector appears
            row = []
            for symbol in range(SYMBOLS):
                new = [NEVER] * 4
                for state, options in enumerate(self.moves[symbol]):
                    for _, to, cost in options:
                        new[to] = min(new[to], vector[state] + cost)
                least = min(new)
                vector_id = tuple(c - least if c - least <= FAR else NEVER for c in new)
                if vector_id not in known:
                    known[vector_id] = len(vectors)
                    vectors.append(vector_id)
                row.append((known[vector_id], least))
            one.append(row)
        step = np.array(one)
        self.after = np.tile(np.arange(len(vectors))[:, None], (1, 1))
        self.added = np.zeros((len(vectors), 1), dtype=np.int64)
        for _ in range(BLOCK):
            longer = step[self.after]
            self.added = (self.added[:, :, None] + longer[:, :, :, 1]).reshape(len(vectors), -1)
            self.after = longer[:, :, :, 0].reshape(len(vectors), -1)
        self.vectors = vectors
        self.expanded: dict = {}

    def blocks(self, symbols: np.ndarray) -> np.ndarray:
        padded = np.full(-(-len(symbols) // BLOCK) * BLOCK, NO_TURN, dtype=np.int64)
        padded[: len(symbols)] = symbols
        return padded.reshape(-1, BLOCK) @ (SYMBOLS ** np.arange(BLOCK - 1, -1, -1))

    def expand(self, block: int, rest: tuple) -> tuple[tuple, list[tuple[str, int]]]:
        """From costs and ranks of the rests behind a block those before it, and by state its edits and last state."""
        found = self.expanded.get((block, rest))
        if found is None:
            costs, ranks = rest
            texts, last = [""] * 4, list(range(4))
            for j in range(BLOCK):
                symbol = block // SYMBOLS**j % SYMBOLS
                best = [min((cost + costs[to], edits, ranks[to], to) for edits, to, cost in self.moves[symbol][s]) for s in range(4)]
                order = sorted({b[1:3] for b in best})
                costs = tuple(b[0] for b in best)
                ranks = tuple(order.index(b[1:3]) for b in best)
                texts = [best[s][1] + texts[best[s][3]] for s in range(4)]
                last = [last[best[s][3]] for s in range(4)]
            least = min(costs)
            found = self.expanded[block, rest] = (tuple(c - least for c in costs), ranks), list(zip(texts, last))
        return found

    def solve(self, symbols: np.ndarray) -> tuple[int, str]:
        """Least cost and the smallest edit text of that cost."""
        blocks = self.blocks(symbols).tolist()
        vector, cost = 0, 0
        for block in blocks:
            cost += int(self.added[vector, block])
            vector = int(self.after[vector, block])
        cost += min(a + b for a, b in zip(self.vectors[vector], END[0]))
        rest, traced = END, []
        for block in reversed(blocks):
            rest, by_state = self.expand(block, rest)
            traced.append(by_state)
        state, edits = 0, []
        for by_state in reversed(traced):
            text, state = by_state[state]
            edits.append(text)
        return cost, "".join(edits) + TAIL[state]


def spans(ids: pa.Array) -> tuple[list, np.ndarray]:
    """Ids of the runs of equal ids (null equals null), and where they begin, with the end."""
    missing = ids.is_null().to_numpy(zero_copy_only=False)
    values = ids.fill_null(0).to_numpy(zero_copy_only=False)
    new = np.ones(len(values), dtype=bool)
    new[1:] = (values[1:] != values[:-1]) | (missing[1:] != missing[:-1])
    at = np.flatnonzero(new)
    return [None if missing[i] else int(values[i]) for i in at], np.append(at, len(values))


class Conversation:
    """What is kept of a conversation while its turns stream by."""

    def __init__(self) -> None:
        self.symbols: list[np.ndarray] = []
        self.faults = np.zeros(4, dtype=np.int64)
        self.illegal = self.distinct = 0
        self.first = self.last = self.before = None

    def add(self, turns: np.ndarray, known: np.ndarray, kinds: np.ndarray, faults: np.ndarray) -> None:
        self.symbols.append(np.where((faults == 1) | (faults == 2), MUST_GO, kinds + 4 * (faults == 3)).astype(np.uint8))
        self.faults += np.bincount(faults, minlength=4)
        pair = kinds if self.before is None else np.append(self.before, kinds)
        legal = ((pair[:-1] == 0) & (pair[1:] == 1)) | ((pair[:-1] == 1) & (pair[1:] == 2)) | ((pair[:-1] == 2) & (pair[1:] == 1))
        self.illegal += int((~legal).sum())
        self.before = kinds[-1]
        turns = turns[known]
        if len(turns):
            self.distinct += int((turns[1:] != turns[:-1]).sum()) + (turns[0] != self.last)
            self.first = int(turns[0]) if self.first is None else self.first
            self.last = int(turns[-1])

    def row(self, tables: BlockTables) -> tuple:
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.distinct
        cost, audit = tables.solve(np.concatenate(self.symbols))
        return int(gaps), *(int(x) for x in self.faults[1:]), self.illegal, cost, audit


def price(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Report of every conversation from sorted rows (conv_id, turn, kind, fault)."""
    tables = BlockTables()
    done: list[tuple] = []
    open_id, held = None, None

    def out() -> pa.RecordBatch:
        kinds = [pa.int64()] * 7 + [pa.string()]
        names = [x.split()[0] for x in REPORT.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*done), kinds)], names=names)

    for batch in batches:
        if not batch.num_rows:
            continue
        turn = batch.column(1)
        known = ~turn.is_null().to_numpy(zero_copy_only=False)
        turns, kinds, faults = turn.fill_null(0).to_numpy(), batch.column(2).to_numpy().astype(np.int64), batch.column(3).to_numpy().astype(np.int64)
        ids, at = spans(batch.column(0))
        for i, name in enumerate(ids):
            if held is not None and name != open_id:
                done.append((open_id, *held.row(tables)))
                held = None
            if held is None:
                open_id, held = name, Conversation()
            s = slice(at[i], at[i + 1])
            held.add(turns[s], known[s], kinds[s], faults[s])
        if len(done) >= 1000:
            yield out()
            done = []
    if held is not None:
        done.append((open_id, *held.row(tables)))
    if done:
        yield out()


def prepared(turns: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    """conv_id, turn, role, text and the key that orders equal turns of one role."""
    role_of, text_of = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (role, text))
    base = turns.select(F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), role_of.alias("role"), text_of.alias("text"))
    return base.withColumn("key", F.md5(F.col("text").cast("binary")))


def inspect(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit.

    Turns are taken by number, nulls first; equal numbers by role and text. Ids
    and numbers are integers; a null id is a conversation of its own. A null
    role or text counts as one space. A role with another initial than s, u or
    a, or none, must be replaced or deleted. Repeated rows are duplicate turns.
    Other columns are not read. An empty table gives no row.
    """
    ended = F.rtrim(F.col("text"), F.lit(SPACES))
    initial = F.left("role", F.lit(1))
    kind = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    light = prepared(turns, conv_id, turn, role, text).select(
        "conv_id", "turn", "role", "key", kind.cast("byte").alias("kind"), (ended == "").alias("blank"),
        F.right(ended, F.lit(1)).isin(".", "!", "?").alias("ended"),
    )
    # both orders stay within the partitions of the conversations
    again = F.row_number().over(Window.partitionBy("conv_id", "role", "key").orderBy(F.asc_nulls_first("turn"))) > 1
    fault = F.when(F.col("blank"), 1).when(F.col("again"), 2).when(~F.col("ended"), 3).otherwise(0)
    marked = light.repartition("conv_id").withColumn("again", again)
    ordered = marked.sortWithinPartitions(F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "role", "key", "again")
    return ordered.select("conv_id", "turn", "kind", fault.cast("byte").alias("fault")).mapInArrow(price, REPORT)


def apply_edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repaired turns from sorted rows (conv_id, head, role, text): the head row's text holds the edits."""
    edits, at, place, last = "", 0, 0, ""
    for batch in batches:
        heads, roles, texts = (batch.column(i).to_pylist() for i in (1, 2, 3))
        ids = batch.column(0).to_pylist()
        out: list[tuple] = []

        def put(name, role, text):
            nonlocal place, last
            last = role[:1]
            out.append((name, place, role, text))
            place += 1

        def inserts(name):
            nonlocal at
            while at < len(edits) and edits[at] == "I":
                put(name, "assistant" if last == "u" else "user", "")
                at += 1

        for name, head, role, text in zip(ids, heads, roles, texts):
            if head:
                edits, at, place, last = text, 0, 0, ""
            else:
                edit = edits[at]
                at += 1
                if edit == "K":
                    put(name, role, text)
                elif edit == "R":
                    put(name, "assistant" if last == "u" else "user", text)
            inserts(name)
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
        columns = list(zip(*out)) or [(), (), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=["conv_id", "pos", "role", "text"])


def repair(turns: DataFrame, report: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The repaired turns: conv_id, pos (from 0), role, text; those of one conversation follow each other in one partition.

    ``report`` is that of ``inspect`` on the same turns. Every conversation is
    sorted behind the row with its edits, so turns stream by.
    """
    rows = prepared(turns, conv_id, turn, role, text).select("conv_id", F.lit(False).alias("head"), "turn", "role", "key", "text")
    none = F.lit(None).cast("string")
    heads = report.select("conv_id", F.lit(True).alias("head"), F.lit(None).cast("long").alias("turn"), none.alias("role"), none.alias("key"), F.col("audit").alias("text"))
    ordered = rows.union(heads).repartition("conv_id").sortWithinPartitions(
        F.asc_nulls_first("conv_id"), F.desc("head"), F.asc_nulls_first("turn"), "role", "key"
    )
    return ordered.select("conv_id", "head", "role", "text").mapInArrow(apply_edits, "conv_id long, pos long, role string, text string")


def hash_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    open_id, digest = None, None
    for batch in batches:
        done = []
        for name, pos, role, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if digest is None or name != open_id:
                if digest is not None:
                    done.append((open_id, digest.hexdigest()))
                open_id, digest = name, hashlib.sha256()
            digest.update((f"\n{role}:{text}" if pos else f"{role}:{text}").encode("utf-8", "surrogatepass"))
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.string())], names=["conv_id", "sha256"])
    if digest is not None:
        yield pa.RecordBatch.from_arrays([pa.array([open_id], pa.int64()), pa.array([digest.hexdigest()], pa.string())], names=["conv_id", "sha256"])


def line_digests(repaired: DataFrame) -> DataFrame:
    """SHA-256 of the lines ``role:text`` of every conversation, straight from the rows of ``repair`` as they stream."""
    return repaired.mapInArrow(hash_lines, "conv_id long, sha256 string")


def whole_report(ids: DataFrame, turns: DataFrame) -> DataFrame:
    """The report and the digest of the repaired lines for every conversation of ``ids``, also those without turns."""
    report = cut_lineage(inspect(turns))
    digests = line_digests(repair(turns, report))
    same = lambda a, b: a["conv_id"].eqNullSafe(b["conv_id"])
    joined = ids.join(report, same(ids, report), "left").join(digests, same(ids, digests), "left")
    counts = [F.coalesce(report[c], F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    nothing = hashlib.sha256(b"").hexdigest()
    return joined.select(
        ids["conv_id"], *counts, F.coalesce(report["audit"], F.lit("")).alias("audit"), F.coalesce(digests["sha256"], F.lit(nothing)).alias("repaired_sha256")
    )


def damage(turns: DataFrame, conv_id: Column, turn: Column) -> DataFrame:
    """Turns (conv_id, turn, role, text) damaged by a checksum of ``conv_id:turn``; missing values are one space."""
    value = lambda c: F.coalesce(c.cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(value(conv_id), F.lit(":"), value(turn)).cast("binary")) % 20
    rows = turns.select(conv_id.alias("conv_id"), turn.alias("turn"), value(F.col("role")).alias("role"), value(F.col("text")).alias("text"), kind.alias("kind"))
    rows = rows.where("kind != 0").withColumn("copy", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"))
