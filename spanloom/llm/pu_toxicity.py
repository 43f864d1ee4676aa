"""Toxicity by non-negative positive-unlabelled learning.

Features are hashes of whole words and of their beginnings. Spark counts in how
many texts of the whole learning fold, and in how many of its confirmed toxic
ones, each feature slot occurs; the slots that
tell the two apart best become the inputs. A logistic model over log rates is fitted in numpy on
at most ``MOST_POSITIVE`` toxic and ``MOST_OTHER`` other texts of the fold, with
the risk estimator that corrects by the class prior and keeps the negative
part from going below zero. Other texts are all that are not known to be toxic,
labelled or not. The prior is the share of toxic texts among the labelled ones of
the fold, kept ``LEAST_PRIOR`` away from 0 and 1; without a text labelled 0 it
is a half, or the share of texts known to be toxic if that is more.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm.texts import LOWER, U64, runs, span_hashes
from spanloom.session import cut_lineage

BITS = 18
#: Marks by which texts that cannot be toxic are left out before a join.
MARKS = 1 << 23
SLOTS = 1 << BITS
CHUNK = 1 << 12
HEADS = (4, 5, 6, 7)
INPUTS = 2048
MOST_POSITIVE, MOST_OTHER = 4000, 12_000
LEAST_PRIOR = 1e-4
STEPS, RATE, DECAY = 400, 0.05, 1e-4
THRESHOLD = 0.7
#: Values of an input for occurring at all, to choose from; its rate in percent adds its logarithm.
PRESENT = (0.0, 0.3, 0.6)

LETTER = np.zeros(256, dtype=bool)
LETTER[97:123] = LETTER[128:] = True


def features(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of texts: first and last row, feature slots, their rows in the run, words of each row."""
    for first, data, offsets in runs(column):
        data = LOWER[data]
        # the lower case of two-byte Latin capitals differs in one bit
        capital = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) if len(data) > 1 else []
        data[np.asarray(capital, dtype=np.int64) + 1] |= 0x20
        word = LETTER[data]
        edge = np.zeros(len(data) + 1, dtype=bool)
        edge[offsets] = True
        size = len(offsets) - 1
        if not len(data):
            yield first, first + size, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(size, np.int64)
            continue
        starts = np.flatnonzero(word & (np.concatenate(([True], ~word[:-1])) | edge[:-1]))
        ends = np.flatnonzero(word & (np.concatenate((~word[1:], [True])) | edge[1:])) + 1
        rows = np.searchsorted(offsets, starts, side="right") - 1
        slots, owner = [(span_hashes(data, starts, ends) >> U64(64 - BITS)).astype(np.int64)], [rows]
        for n in HEADS:
            long = ends - starts > n
            if long.any():
                slots.append((span_hashes(data, starts[long], starts[long] + n) * U64(2 * n + 1) >> U64(64 - BITS)).astype(np.int64))
                owner.append(rows[long])
        yield first, first + size, np.concatenate(slots), np.concatenate(owner), np.bincount(rows, minlength=size)


def count_slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of each class (0 all, 1 toxic) by slot, as chunks of the whole table."""
    counts = np.zeros((2, SLOTS), dtype=np.int64)
    for batch in batches:
        toxic = batch.column("positive").to_numpy(zero_copy_only=False).astype(np.int64)
        for first, _, slots, rows, _ in features(batch.column("text")):
            pairs = np.unique(rows * SLOTS + slots)
            kind = toxic[first + pairs // SLOTS]
            for k in (0, 1):
                counts[k] += np.bincount(pairs[kind == k] % SLOTS, minlength=SLOTS)
    rows = [(k, c) for k in (0, 1) for c in range(0, SLOTS, CHUNK) if counts[k, c : c + CHUNK].any()]
    yield pa.RecordBatch.from_arrays(
        [pa.array([k for k, _ in rows], pa.int32()), pa.array([c for _, c in rows], pa.int32()), pa.array([counts[k, c : c + CHUNK].astype("<i8").tobytes() for k, c in rows], pa.binary())],
        names=["kind", "chunk", "counts"],
    )


def add_chunks(key, table):
    total = sum(np.frombuffer(x.as_py(), "<i8") for x in table.column("counts"))
    return pa.table({"kind": pa.array([key[0].as_py()], pa.int32()), "chunk": pa.array([key[1].as_py()], pa.int32()), "counts": pa.array([total.astype("<i8").tobytes()], pa.binary())})


@dataclass
class Model:
    """Input number by slot (-1: none), weights, bias, value for occurring at all."""

    inputs: np.ndarray
    weights: np.ndarray
    bias: float
    present: float = 0.0


def inputs_of(column: pa.Array, inputs: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of texts: first and last row, then row in the run, input and value of what is not zero."""
    width = int(inputs.max(initial=-1)) + 1
    for first, last, slots, rows, words in features(column):
        at = inputs[slots]
        known = at >= 0
        pair, n = np.unique(rows[known] * max(1, width) + at[known], return_counts=True)
        row, at = pair // max(1, width), pair % max(1, width)
        yield first, last, row, at, np.log1p(100.0 * n / np.maximum(words[row], 10))


def collect_inputs(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inputs = np.frombuffer(shared.value, "<i4")
        for batch in batches:
            toxic = batch.column("positive")
            for first, last, row, at, value in inputs_of(batch.column("text"), inputs):
                cut = np.searchsorted(row, np.arange(last - first + 1))
                yield pa.RecordBatch.from_arrays(
                    [toxic.slice(first, last - first), pa.array([at[a:b].astype("<u2").tobytes() for a, b in zip(cut, cut[1:])], pa.binary()), pa.array([value[a:b].astype("<f4").tobytes() for a, b in zip(cut, cut[1:])], pa.binary())],
                    names=["positive", "at", "value"],
                )

    return run


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_risk(rows: np.ndarray, at: np.ndarray, value: np.ndarray, positive: np.ndarray, prior: float, width: int, steps: int = STEPS, rate: float = RATE, decay: float = DECAY, known: float = 0.0) -> tuple[np.ndarray, float]:
    """Logistic weights and bias that minimise the non-negative positive-unlabelled risk (Adam, whole batches).

    ``known`` is the share of all texts that are known to be positive and so
    missing among the others, which makes ``prior - known`` that of positives among the rest.
    """
    hidden = max(0.0, prior - known)
    weights = np.zeros(width + 1)
    weights[width] = np.log(prior / (1 - prior))
    m, v = np.zeros(width + 1), np.zeros(width + 1)
    p, u = np.flatnonzero(positive), np.flatnonzero(~positive)
    for step in range(1, steps + 1):
        score = np.bincount(rows, weights=value * weights[at], minlength=len(positive)) + weights[width]
        chance = sigmoid(score)
        # risk of calling the other texts toxic, less the part that toxic texts among them would bear
        negative = (1 - known) * np.logaddexp(0, score[u]).mean() - hidden * np.logaddexp(0, score[p]).mean()
        slope = np.zeros(len(positive))
        if negative >= 0:
            slope[p] = prior * (chance[p] - 1) / len(p) - hidden * chance[p] / len(p)
            slope[u] = (1 - known) * chance[u] / len(u)
        else:
            # the part below zero is over-fitting: go back along it
            slope[p] = hidden * chance[p] / len(p)
            slope[u] = -(1 - known) * chance[u] / len(u)
        gradient = np.bincount(at, weights=value * slope[rows], minlength=width + 1)
        gradient[width] = slope.sum()
        gradient[:width] += decay * weights[:width]
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        weights -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return weights[:width], float(weights[width])


def marked(rows: DataFrame, ids: DataFrame, marks: int = MARKS) -> DataFrame:
    """``rows`` whose ``id`` may be among ``ids`` (column ``__of``): all of these and few others while the ids are fewer than ``marks``.

    The marks are bits, 64 a row, so what is sent to every task is bounded.
    """

    def mark(c: str) -> Column:
        return F.pmod(F.xxhash64(c), F.lit(marks))

    words = ids.select(mark("__of").alias("m")).groupBy(F.shiftright("m", 6).alias("__word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(m & 63 as int))")).alias("__bits")
    )
    met = rows.withColumn("__m", mark("id")).join(F.broadcast(words), F.shiftright("__m", 6) == F.col("__word"))
    return met.where(F.getbit("__bits", F.col("__m").bitwiseAND(F.lit(63)).cast("int")) == 1).select(*rows.columns)


def learn(
    docs: DataFrame, labels: DataFrame, train: Column | None = None, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic",
    most_positive: int = MOST_POSITIVE, most_other: int = MOST_OTHER, width: int = INPUTS,
) -> Model:
    """A model from texts labelled toxic and all other texts (where ``train`` holds).

    Null texts are not learned from. Without a toxic text every score is 0; if
    all texts are toxic, or no feature tells, every score is the prior.
    """
    given = labels.where(F.col(toxic).isNotNull()).groupBy(F.col(doc_id).alias("__of")).agg(F.max(F.col(toxic).cast("int")).alias("__toxic"))
    base = docs.where(F.lit(True) if train is None else train).select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text")).where(F.col("text").isNotNull())
    # only ids meet the labels
    known = cut_lineage(base.select("id").join(given, F.col("id") == F.col("__of"), "left").select("id", "__toxic"))
    size = {row["__toxic"]: row["count"] for row in known.groupBy("__toxic").count().collect()}  # toxic, not toxic, unlabelled
    if not size.get(1):
        return Model(np.full(SLOTS, -1, dtype="<i4"), np.zeros(0), -40.0)
    every = sum(size.values())
    known_share = size[1] / every
    labelled = sum(n for kind, n in size.items() if kind is not None)
    prior = size[1] / labelled if labelled > size[1] else max(0.5, known_share)
    prior = min(1 - LEAST_PRIOR, max(LEAST_PRIOR, prior))
    lot = F.pmod(F.xxhash64("id"), F.lit(1 << 20))
    positive = F.coalesce(F.col("__toxic") == 1, F.lit(False))
    few = F.when(positive, lot < (1 << 20) * min(1.0, most_positive / size[1])).otherwise(
        lot < (1 << 20) * min(1.0, most_other / max(1, every - size[1]))
    )
    # the parameters bound this table, so it may be sent to every task
    sample = F.broadcast(known.where(few).groupBy(F.col("id").alias("__of")).agg(F.max(positive).alias("positive")))
    picked = base.join(sample, F.col("id") == F.col("__of")).select("text", "positive")
    # An inner join, as toxic ids are distinct: a semi join would go below the marks and move all texts.
    listed = given.where("__toxic = 1")
    toxic_texts = marked(base, listed).join(listed, F.col("id") == F.col("__of")).select("text", F.lit(True).alias("positive"))
    sums = base.select("text", F.lit(False).alias("positive")).union(toxic_texts).mapInArrow(count_slots, "kind int, chunk int, counts binary").groupBy("kind", "chunk").applyInArrow(add_chunks, "kind int, chunk int, counts binary")
    counts = np.zeros((2, SLOTS))
    for row in sums.toLocalIterator():  # two tables of SLOTS numbers
        counts[row.kind, row.chunk : row.chunk + CHUNK] = np.frombuffer(row.counts, "<i8")
    n = np.array([every, size[1]], dtype=float)
    share = np.minimum((counts + 0.5) / (n + 1)[:, None], 1.0)
    spread = np.sqrt(share[0] * (1 - share[0]) / n[0] + share[1] * (1 - share[1]) / n[1])
    telling = np.abs(share[1] - share[0]) / spread * (counts[1] + counts[0] >= 3)
    best = np.argsort(-telling, kind="stable")[:width]
    best = np.sort(best[telling[best] > 2])
    inputs = np.full(SLOTS, -1, dtype="<i4")
    inputs[best] = np.arange(len(best))
    shared = docs.sparkSession.sparkContext.broadcast(inputs.tobytes())
    sample = picked.mapInArrow(collect_inputs(shared), "positive boolean, at binary, value binary").toArrow()
    positive = np.array(sample.column("positive").to_pylist(), dtype=bool)
    if positive.all() or not positive.any() or not len(best):
        return Model(inputs, np.zeros(len(best)), float(np.log(prior / (1 - prior))))
    at = [np.frombuffer(x.as_buffer(), "<u2") for x in sample.column("at")]
    value = np.concatenate([np.frombuffer(x.as_buffer(), "<f4") for x in sample.column("value")]).astype(float)
    rows = np.repeat(np.arange(len(at)), [len(x) for x in at])
    at = np.concatenate(at).astype(np.int64)
    present = choose_present(rows, at, value, positive, prior, len(best), known_share)
    weights, bias = fit_risk(rows, at, value + present, positive, prior, len(best), known=known_share)
    return Model(inputs, weights, bias, present)


def choose_present(rows: np.ndarray, at: np.ndarray, value: np.ndarray, positive: np.ndarray, prior: float, width: int, known: float = 0.0) -> float:
    """The value of occurrence with the least positive-unlabelled risk on every fourth text of the sample."""
    tested = np.arange(len(positive)) % 4 == 0
    kept = ~tested[rows]
    if min(positive[tested].sum(), (~positive)[tested].sum(), positive[~tested].sum(), (~positive)[~tested].sum()) == 0:
        return PRESENT[0]
    place = np.cumsum(~tested) - 1
    risks = []
    for present in PRESENT:
        weights, bias = fit_risk(place[rows[kept]], at[kept], value[kept] + present, positive[~tested], prior, width, known=known)
        score = np.bincount(rows, weights=(value + present) * weights[at], minlength=len(positive)) + bias
        called = sigmoid(score) >= THRESHOLD
        caught = called[tested & positive].mean()
        risks.append(prior * (1 - caught) + max(0.0, (1 - known) * called[tested & ~positive].mean() - (prior - known) * caught))
    return PRESENT[int(np.argmin(risks))]


def score_all(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inputs, weights, bias, present = shared.value
        for batch in batches:
            score = np.full(batch.num_rows, sigmoid(np.array([bias]))[0])
            for first, last, row, at, value in inputs_of(batch.column(0), inputs):
                score[first:last] = sigmoid(np.bincount(row, weights=(value + present) * weights[at], minlength=last - first) + bias)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(score)], names=[*batch.schema.names[1:], "score"])

    return run


def score(docs: DataFrame, model: Model, keep: list[Column], text: str = "text") -> DataFrame:
    """``keep`` beside the score (0 to 1) of every whole text; null and empty texts get the model's base rate."""
    shared = docs.sparkSession.sparkContext.broadcast((model.inputs, model.weights, model.bias, model.present))
    rows = docs.select(F.col(text).cast("string").alias("__text"), *keep)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:])
    return rows.mapInArrow(score_all(shared), f"{kinds}{', ' if kinds else ''}score double")
