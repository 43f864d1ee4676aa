"""Language identification with interpolated Kneser-Ney character models.

Every language gets a model of order four over lower-cased letters (anything
else is one space). Four-gram counts over all training texts are summed in
Spark; continuation counts, discounts and back-off weights follow by grouping.
A model is a table of discounted probabilities by n-gram and back-off weights by
context, keyed by the whole packed n-gram. Up to ``MOST_KEYS`` entries it is sent
to the tasks as sorted arrays; a larger one stays in Spark, and the n-grams of
the texts are joined with it, with the same result. A text takes the language with the lowest cross-entropy a character.
Whether it is rejected is decided against the cross-entropies of training
texts of the same language and order of length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm.texts import U64, mix
from spanloom.session import cut_lineage

#: Entries of a model that is held as arrays, 12 bytes each.
MOST_KEYS = 4_000_000
ORDERS = (4, 3, 2, 1)
PAD, BLANK = 1, 32
UNKNOWN = "und"
CACHE_BITS = 16
#: The private codes below 2**16, for letters above it.
WIDE, WIDE_CODES = 0xE000, 0x1900
#: Robust deviations above the median that are rejected, the least deviation as a share of the median, the least rows of a median, and cells of entropy a nat.
TAIL, LEAST_SPREAD, LEAST_ROWS, CELLS = 6.0, 0.08, 64, 1024


def letter_table() -> np.ndarray:
    table = np.zeros(0x110000, dtype=bool)
    table[[i for i in range(0x110000) if chr(i).isalpha()]] = True
    return table


def char_runs(texts: list, letters: np.ndarray, at_most: int = 1 << 17) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of texts: first and last row, packed four-grams, their rows, and whether a row has letters."""
    first = 0
    while first < len(texts):
        last, size = first, 0
        while last < len(texts) and (last == first or size + len(texts[last] or "") <= at_most):
            size += len(texts[last] or "")
            last += 1
        some = [(t or "").replace("\x01", " ").lower() for t in texts[first:last]]
        codes = np.frombuffer("".join("\x01\x01\x01" + t for t in some).encode("utf-32-le", "surrogatepass"), dtype="<u4")
        rows = np.repeat(np.arange(last - first), [len(t) + 3 for t in some])
        letter = letters[codes]
        has = np.bincount(rows[letter], minlength=last - first) > 0
        # letters beyond 16 bits share the codes that no letter has, so none is taken for a letter of another script
        short = np.where(codes > 0xFFFF, WIDE + codes % WIDE_CODES, codes)
        code = np.where(letter, short, np.where(codes == PAD, PAD, BLANK)).astype(U64)
        keep = np.ones(len(code), dtype=bool)
        keep[1:] = (code[1:] != BLANK) | (code[:-1] != BLANK)
        code, rows = code[keep], rows[keep]
        gram = code[3:] | (code[2:-1] << U64(16)) | (code[1:-2] << U64(32)) | (code[:-3] << U64(48))
        real = code[3:] != PAD
        yield first, last, gram[real], rows[3:][real], has
        first = last


def count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram, n), summed within the task as far as memory allows."""
    letters = letter_table()
    held: dict[str, list] = {}
    entries = 0

    def merged(parts: list) -> tuple[np.ndarray, np.ndarray]:
        gram, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        return gram, np.bincount(at, weights=np.concatenate([p[1] for p in parts])).astype(np.int64)

    def out() -> Iterator[pa.RecordBatch]:
        for lang, parts in held.items():
            gram, n = merged(parts)
            for k in range(0, len(gram), 100_000):
                g = gram[k : k + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g)), pa.array(g.view(np.int64)), pa.array(n[k : k + 100_000])], names=["lang", "gram", "n"])
        held.clear()

    for batch in batches:
        langs = np.array(batch.column("lang").to_pylist(), dtype=object)
        texts = batch.column("text").to_pylist()
        for lang in dict.fromkeys(langs):
            for _, _, gram, _, _ in char_runs([texts[i] for i in np.flatnonzero(langs == lang)], letters):
                gram, n = np.unique(gram, return_counts=True)
                held.setdefault(lang, []).append((gram, n))
                entries += len(gram)
            if len(held.get(lang, ())) > 8:
                entries -= sum(len(p[0]) for p in held[lang])
                held[lang] = [merged(held[lang])]
                entries += len(held[lang][0][0])
        if entries > 1_000_000:
            yield from out()
            entries = 0
    yield from out()


@dataclass
class Models:
    """By language the sorted arrays of each order, single characters, and the limits of rejection.

    A model too large for arrays has those of order 1 only, and ``table``: lang
    (its place in ``langs``), n, kind (0 n-grams, 1 contexts), key, value.
    """

    langs: list[str]
    grams: dict[tuple[str, int], tuple[np.ndarray, np.ndarray]]
    backs: dict[tuple[str, int], tuple[np.ndarray, np.ndarray]]
    floor: dict[str, float]
    limits: dict[tuple[str, int], float]
    table: DataFrame | None = None

    @staticmethod
    def look(table: tuple[np.ndarray, np.ndarray], packed: np.ndarray, missing: float) -> np.ndarray:
        keys, values = table
        key = packed.view(np.int64)
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        return np.where(keys[at] == key, values[at], missing)

    def log_probability(self, gram: np.ndarray) -> np.ndarray:
        """Natural logarithms, one column per language."""
        out = np.empty((len(gram), len(self.langs)), dtype=np.float32)
        part = {n: gram & U64((1 << 16 * n) - 1) if n < 4 else gram for n in ORDERS}
        for j, lang in enumerate(self.langs):
            p = self.look(self.grams[lang, 1], part[1], 0.0) + self.floor[lang]
            for n in (2, 3, 4):
                p = self.look(self.grams[lang, n], part[n], 0.0) + self.look(self.backs[lang, n], part[n] >> U64(16), 1.0) * p
            out[:, j] = np.log(p)
        return out


def fit(docs: DataFrame, train: Column | None = None, text: str = "text", lang: str = "lang") -> Models:
    """Models of all rows with a language (where ``train`` holds)."""
    base = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & (F.lit(True) if train is None else train))
    base = base.select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))
    counted = base.mapInArrow(count_grams, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("c"))
    level, tables = cut_lineage(counted), []
    for order in ORDERS:
        shorter = F.shiftrightunsigned("gram", 16)
        gaps = level.groupBy("lang").agg(F.sum((F.col("c") == 1).cast("double")).alias("n1"), F.sum((F.col("c") == 2).cast("double")).alias("n2"))
        # half is taken off where counts of one and two say nothing
        gaps = gaps.select(F.col("lang").alias("of"), F.when(F.col("n1") > 0, F.col("n1") / (F.col("n1") + 2 * F.col("n2"))).otherwise(0.5).alias("off"))
        gaps = gaps.withColumn("off", F.greatest(F.lit(0.1), F.least(F.lit(0.9), "off")))
        contexts = level.groupBy(F.col("lang").alias("l"), shorter.alias("context")).agg(F.sum("c").alias("total"), F.count("*").alias("types"))
        priced = level.join(contexts, (level.lang == F.col("l")) & (shorter == F.col("context"))).join(gaps, level.lang == F.col("of"))
        value = F.greatest(F.col("c") - F.col("off"), F.lit(0.0)) / F.col("total")
        tables.append(priced.select("lang", F.lit(order).cast("byte").alias("n"), F.lit(0).cast("byte").alias("kind"), F.col("gram").alias("key"), value.cast("float").alias("value")))
        backs = contexts.join(gaps, F.col("l") == F.col("of"))
        value = F.col("off") * F.col("types") / F.col("total")
        tables.append(backs.select(F.col("l").alias("lang"), F.lit(order).cast("byte").alias("n"), F.lit(1).cast("byte").alias("kind"), F.col("context").alias("key"), value.cast("float").alias("value")))
        if order > 1:
            level = cut_lineage(level.groupBy("lang", F.col("gram").bitwiseAND(F.lit((1 << 16 * (order - 1)) - 1)).alias("gram")).agg(F.count("*").alias("c")))
    whole = tables[0]
    for table in tables[1:]:
        whole = whole.union(table)
    whole = cut_lineage(whole)
    langs = sorted(r["lang"] for r in whole.where("n = 1 and kind = 1").select("lang").collect())  # one row a language
    place = F.array_position(F.array(*[F.lit(x) for x in langs]), F.col("lang")) - 1 if langs else F.lit(0)
    whole = whole.withColumn("lang", place.cast("int"))
    large = whole.count() > MOST_KEYS
    found = (whole.where("n = 1") if large else whole).toArrow()
    frame = {c: found.column(c).to_numpy() for c in ("lang", "n", "kind", "key", "value")}
    models = Models(langs, {}, {}, {}, {}, whole if large else None)
    characters = len(np.unique(frame["key"][(frame["n"] == 1) & (frame["kind"] == 0)])) + 1
    for j, name in enumerate(langs):
        for n in (1,) if large else ORDERS:
            for kind, into in ((0, models.grams), (1, models.backs)):
                rows = np.flatnonzero((frame["lang"] == j) & (frame["n"] == n) & (frame["kind"] == kind))
                rows = rows[np.argsort(frame["key"][rows])]
                into[name, n] = frame["key"][rows], frame["value"][rows]
        models.floor[name] = float(models.backs[name, 1][1][0]) / characters
    return models


def score_texts(shared):
    """Per text the best language, its cross-entropy, length and share of the evidence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = Models(*shared.value)
        letters = letter_table()
        known = np.full(1 << CACHE_BITS, np.iinfo(np.uint64).max, dtype=U64)
        prices = np.zeros((1 << CACHE_BITS, max(1, len(models.langs))), dtype=np.float32)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            n = len(texts)
            best, entropy, length, share = [UNKNOWN] * n, np.full(n, np.nan), np.zeros(n, np.int64), np.zeros(n)
            for first, last, gram, rows, has in char_runs(texts, letters):
                size = last - first
                slot = (mix(gram) >> U64(64 - CACHE_BITS)).astype(np.int64)
                new = np.flatnonzero(known[slot] != gram)
                if len(new) and models.langs:
                    fresh, at = np.unique(gram[new], return_index=True)
                    known[slot[new[at]]] = fresh
                    prices[slot[new[at]]] = models.log_probability(fresh)
                again = np.flatnonzero(known[slot] != gram)  # slots that two of this run's n-grams share
                counts = np.bincount(rows, minlength=size)
                length[first:last] = counts
                if not models.langs:
                    continue
                fresh, at = np.unique(gram[again], return_inverse=True)
                fresh = models.log_probability(fresh)
                sums = np.empty((size, len(models.langs)))
                for j in range(len(models.langs)):
                    price = prices[slot, j]
                    price[again] = fresh[at, j]
                    sums[:, j] = np.bincount(rows, weights=price, minlength=size)
                mean = -sums / np.maximum(counts, 1)[:, None]
                win = np.argmin(mean, axis=1)
                low = mean[np.arange(size), win]
                with np.errstate(over="ignore", under="ignore"):
                    weight = np.exp(-(mean - low[:, None]) * np.minimum(counts, 10_000)[:, None])
                for i in np.flatnonzero(has):
                    best[first + i] = models.langs[win[i]]
                entropy[first:last] = np.where(has, low, np.nan)
                share[first:last] = np.where(has, 1 / weight.sum(axis=1), 0.0)
            out = [*batch.columns[1:], pa.array(best), pa.array(entropy, from_pandas=True), pa.array(length), pa.array(share)]
            yield pa.RecordBatch.from_arrays(out, names=[*batch.schema.names[1:], "lang_pred", "entropy", "length", "score"])

    return run


def text_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, gram, n, has): the distinct n-grams of each text, and whether it has letters."""
    letters = letter_table()
    for batch in batches:
        numbers = batch.column("__row").to_numpy()
        for first, _, gram, rows, has in char_runs(batch.column("__text").to_pylist(), letters):
            order = np.lexsort((gram, rows))
            gram, rows = gram[order], rows[order]
            new = np.ones(len(gram), dtype=bool)
            new[1:] = (gram[1:] != gram[:-1]) | (rows[1:] != rows[:-1])
            at = np.flatnonzero(new)
            n = np.diff(np.append(at, len(gram)))
            for k in range(0, len(at), 100_000):
                some = at[k : k + 100_000]
                parts = [numbers[first + rows[some]], gram[some].view(np.int64), n[k : k + 100_000], has[rows[some]]]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in parts], names=["row", "gram", "n", "has"])


def priced_grams(models: Models, grams: DataFrame) -> DataFrame:
    """(gram, p): natural logarithms by language of the distinct ``grams``, by joins with the model's table."""
    langs = range(len(models.langs))

    def entries(n: int, kind: int, missing: float, name: str) -> DataFrame:
        some = models.table.where((F.col("n") == n) & (F.col("kind") == kind)).groupBy(F.col("key").alias(f"{name}_key"))
        return some.agg(F.array(*[F.coalesce(F.max(F.when(F.col("lang") == j, F.col("value").cast("double"))), F.lit(missing)) for j in langs]).alias(name))

    out = grams.withColumn("p", F.array(*[F.lit(models.floor[x]) for x in models.langs]))
    for n in sorted(ORDERS):
        part = F.col("gram").bitwiseAND(F.lit((1 << 16 * n) - 1)) if n < 4 else F.col("gram")
        out = out.join(entries(n, 0, 0.0, "own"), part == F.col("own_key"), "left")
        own = F.coalesce("own", F.array(*[F.lit(0.0) for _ in langs]))
        if n > 1:
            out = out.join(entries(n, 1, 1.0, "back"), F.shiftrightunsigned(part, 16) == F.col("back_key"), "left")
            out = out.withColumn("p", F.zip_with(F.coalesce("back", F.array(*[F.lit(1.0) for _ in langs])), "p", lambda a, b: a * b))
        out = out.select("gram", F.zip_with(own, "p", lambda a, b: a + b).alias("p"))
    return out.withColumn("p", F.transform("p", lambda x: F.ln(x)))


def identify_by_joins(rows: DataFrame, models: Models) -> DataFrame:
    """The result of ``score_texts`` for a model that stays in Spark."""
    names = rows.columns[1:]
    rows = cut_lineage(rows.withColumn("__row", F.monotonically_increasing_id()))
    each = cut_lineage(rows.select("__row", "__text").mapInArrow(text_grams, "row long, gram long, n long, has boolean"))
    prices = priced_grams(models, each.select("gram").distinct())
    sums = each.join(prices, "gram").groupBy("row").agg(
        F.max("has").alias("__has"), F.sum("n").alias("__length"), F.array(*[F.sum(F.col("n") * F.get("p", F.lit(j))) for j in range(len(models.langs))]).alias("__sums"),
    )
    sums = sums.withColumn("__mean", F.transform("__sums", lambda x: -x / F.col("__length"))).withColumn("__low", F.array_min("__mean"))
    weight = F.aggregate("__mean", F.lit(0.0), lambda s, x: s + F.exp(-(x - F.col("__low")) * F.least(F.col("__length"), F.lit(10_000))))
    best = F.element_at(F.array(*[F.lit(x) for x in models.langs]), F.array_position("__mean", F.col("__low")).cast("int"))
    sums = sums.select(F.col("row").alias("__of"), "__has", "__length", "__low", weight.alias("__weight"), best.alias("__best"))
    has = F.coalesce("__has", F.lit(False))
    return rows.join(sums, F.col("__row") == F.col("__of"), "left").select(
        *[F.col(f"`{c}`") for c in names], F.when(has, F.col("__best")).otherwise(UNKNOWN).alias("lang_pred"), F.when(has, F.col("__low")).alias("entropy"),
        F.coalesce("__length", F.lit(0)).cast("long").alias("length"), F.when(has, 1 / F.col("__weight")).otherwise(0.0).alias("score"),
    )


def identify(docs: DataFrame, models: Models, keep: list[Column], text: str = "text") -> DataFrame:
    """``keep`` beside lang_pred, entropy (nats a character), length and score of every row.

    A text that is null or has no letter is ``und`` with score 0 and no entropy.
    """
    rows = docs.select(F.col(text).cast("string").alias("__text"), *keep)
    if models.table is not None:
        return identify_by_joins(rows, models)
    shared = docs.sparkSession.sparkContext.broadcast((models.langs, models.grams, models.backs, models.floor, {}))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:])
    return rows.mapInArrow(score_texts(shared), f"{kinds}{', ' if kinds else ''}lang_pred string, entropy double, length long, score double")


def calibrate(docs: DataFrame, models: Models, train: Column | None = None, text: str = "text", lang: str = "lang") -> Models:
    """Limits of rejection by language and power of two of length, from the entropies of training texts.

    Median plus ``TAIL`` robust deviations (median deviation, ``LEAST_SPREAD`` of
    the median at least), which less than half of junk rows cannot move. A group
    of fewer than ``LEAST_ROWS`` rows is pooled with the nearest lengths of its
    language, so that no row is held against little but itself.
    """
    base = docs.where(F.col(lang).isNotNull() & (F.lit(True) if train is None else train))
    seen = identify(base, models, [F.col(lang).cast("string").alias("lang")], text).where("lang = lang_pred and entropy is not null")
    cells = seen.groupBy("lang", F.floor(F.log2("length")).cast("int").alias("size"), F.floor(F.col("entropy") * CELLS).cast("long").alias("cell")).agg(F.count("*").alias("n"))
    found: dict[str, dict[int, list]] = {}
    for row in cells.collect():  # languages times orders of length times cells
        found.setdefault(row["lang"], {}).setdefault(row["size"], []).append((row["cell"], row["n"]))
    for name, sizes in found.items():
        for size in sizes:
            pooled: list = []
            for away in range(max(sizes) - min(sizes) + 1):
                pooled += [x for s in {size - away, size + away} for x in sizes.get(s, ())]
                if sum(n for _, n in pooled) >= LEAST_ROWS:
                    break
            entropy, n = (np.array(x) for x in zip(*pooled))
            entropy = (entropy + 0.5) / CELLS
            middle = weighted_median(entropy, n)
            spread = 1.4826 * weighted_median(np.abs(entropy - middle), n)
            models.limits[name, size] = middle + TAIL * max(spread, LEAST_SPREAD * middle)
    return models


def weighted_median(values: np.ndarray, n: np.ndarray) -> float:
    order = np.argsort(values, kind="stable")
    upto = np.cumsum(n[order])
    return float(values[order][np.searchsorted(upto, upto[-1] / 2)])


def rejected(models: Models, lang: Column, entropy: Column, length: Column) -> Column:
    """Whether a text fits no model; one of a length that no training text had is judged by the nearest known length."""
    out = lang == UNKNOWN
    for name in models.langs:
        known = sorted(s for l, s in models.limits if l == name)
        if not known:
            continue
        size = F.least(F.greatest(F.floor(F.log2(length)).cast("int"), F.lit(known[0])), F.lit(known[-1]))
        limit = F.lit(None).cast("double")
        for s in reversed(known):
            limit = F.when(size >= s, F.lit(models.limits[name, s])) if s == known[-1] else F.when(size < known[known.index(s) + 1], F.lit(models.limits[name, s])).otherwise(limit)
        out = out | ((lang == name) & (entropy > limit))
    return F.coalesce(out, F.lit(False))


def drop_foreign(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """Rows of ``docs`` whose text fits a model learned from the table's own languages.

    Columns stay as they are. Without a single labelled text nothing can be
    learned and every row stays. Null and letterless texts are rejected.
    """
    models = calibrate(docs, fit(docs, None, text, lang), None, text, lang)
    if not models.langs:
        return docs
    names = docs.columns
    inner = docs.toDF(*[f"c{i}" for i in range(len(names))])
    at = f"c{names.index(text)}"
    found = identify(inner, models, [F.col(c) for c in inner.columns], at)
    kept = found.where(~rejected(models, F.col("lang_pred"), F.col("entropy"), F.col("length")))
    return kept.select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(names)])
