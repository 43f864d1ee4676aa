"""Quality rules and robust multivariate outliers, in DataFrame operations only.

Every text gets exact counts and a first set of rules. Texts that pass become
vectors of transformed statistics; for each language and source the minimum
covariance determinant estimate of their centre and spread is found by
concentration: distances, the closest ``SHARE`` of the group, their mean and
covariance, again. A step is two aggregates that combine before the shuffle
(counts by distance cell, then moments), so a group of any size is spread over
all tasks. Texts far from the centre by Mahalanobis distance are rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.session import cut_lineage

WORD = r"([^\x20\x09-\x0D]+)"
BLANKS = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
SHARE = 0.75
STEPS = 6
#: Squared distance that one in ten thousand normal vectors of five statistics passes, and the median for none to five statistics.
LIMIT, MEDIANS = 25.745, (0.0, 0.455, 1.386, 2.366, 3.357, 4.351)
LEAST_ROWS = 20
CELL = 32.0
#: Spread that each statistic has at least, the noise of counting: a few words more, one symbol, one repeated passage or line in a text of usual length.
FLOOR = {"x1": 0.1, "x2": 0.05, "x3": 0.2, "x4": 0.5, "x5": 0.6}


def without(text: Column, symbols: str) -> Column:
    return F.translate(text, symbols, "")


def counted(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keys: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """doc_id, keys as ``g0``, ``g1`` …, and the exact counts of every text; a null text counts as empty."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), *[F.col(k).cast("string").alias(f"g{i}") for i, k in enumerate(keys)], t.alias("t"))
    filled = F.filter(F.split("t", "\n", -1), lambda line: F.length(without(line, BLANKS)) > 0)
    rows = rows.select(
        "doc_id", *[f"g{i}" for i in range(len(keys))],
        F.regexp_extract_all("t", F.lit(WORD), F.lit(1)).alias("words"),
        F.length(without(F.col("t"), BLANKS)).cast("long").alias("word_chars"),
        (F.length("t") - F.length(without(F.col("t"), SYMBOLS))).cast("long").alias("n_symbols"),
        filled.alias("lines"),
    )
    places = F.when(F.size("words") >= WINDOW, F.sequence(F.lit(1), F.size("words") - (WINDOW - 1))).otherwise(F.array().cast("array<int>"))
    rows = rows.select(
        *[c for c in rows.columns if c not in ("words", "lines")],
        F.size("words").cast("long").alias("n_words"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform(places, lambda i: F.xxhash64(F.slice("words", i, F.lit(WINDOW)))).alias("windows"),
    )
    return rows.select(*[c for c in rows.columns if c != "windows"], repeated("windows").alias("n_repeat_words"))


def repeated(windows: str) -> Column:
    """Words inside windows whose hash comes twice or more.

    Windows are sorted with their places, equal neighbours keep both places,
    and each place adds the words up to the next one.
    """
    w = F.col(windows)
    ordered = F.sort_array(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    later = F.concat(F.slice(ordered, 2, F.greatest(F.size(w) - 1, F.lit(0))), F.array(F.lit(None).cast("struct<h:bigint,i:int>")))
    twice = F.zip_with(ordered, later, lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
    where = F.sort_array(F.array_distinct(F.flatten(F.filter(twice, lambda x: x.isNotNull()))))
    gaps = F.aggregate(where, F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("sum")), lambda s, i: F.struct(i.alias("last"), (s["sum"] + F.least(F.lit(WINDOW), i - s["last"])).alias("sum")), lambda s: s["sum"])
    return F.when(F.size(F.array_distinct(w)) < F.size(w), gaps).otherwise(F.lit(0)).cast("long")


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def statistics() -> dict[str, Column]:
    """Logarithms, so that shares and sizes are nearer to normal."""
    words = F.col("n_words").cast("double")
    return {
        "x1": F.log1p(words),
        "x2": F.log(F.col("word_chars") / words),
        "x3": F.log1p(100.0 * F.col("n_symbols") / F.col("word_chars")),
        "x4": F.log1p(100.0 * F.col("n_repeat_words") / words),
        "x5": F.log1p(100.0 * F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))),
    }


def distance(rows: DataFrame, names: list[str]) -> DataFrame:
    """Add ``d2`` by forward substitution through the factor ``l_…`` around ``m_…``."""
    for i, a in enumerate(names):
        z = F.col(a) - F.col(f"m_{a}")
        for b in names[:i]:
            z = z - F.col(f"l_{a}_{b}") * F.col(f"z_{b}")
        rows = rows.withColumn(f"z_{a}", z / F.col(f"l_{a}_{a}"))
    total = sum((F.col(f"z_{a}") * F.col(f"z_{a}") for a in names[1:]), F.col(f"z_{names[0]}") * F.col(f"z_{names[0]}"))
    return rows.withColumn("d2", total).drop(*[f"z_{a}" for a in names])


def factor(moments: DataFrame, names: list[str], keys: list[str]) -> DataFrame:
    """Triangular factor of the covariance columns ``c_…``, with the floor as least diagonal, and ``free``, how many statistics are above it."""
    out = moments.withColumn("free", F.lit(0))
    for i, a in enumerate(names):
        for j, b in enumerate(names[: i + 1]):
            value = F.col(f"c_{a}_{b}")
            for c in names[:j]:
                value = value - F.col(f"l_{a}_{c}") * F.col(f"l_{b}_{c}")
            if a == b:
                least = F.lit(FLOOR[a] ** 2)
                out = out.withColumns({f"l_{a}_{a}": F.sqrt(F.greatest(value, least)), "free": F.col("free") + (value > least).cast("int")})
            else:
                out = out.withColumn(f"l_{a}_{b}", value / F.col(f"l_{b}_{b}"))
    return out.select(*keys, "free", *[f"m_{a}" for a in names], *[f"l_{a}_{b}" for i, a in enumerate(names) for b in names[: i + 1]])


def shared(rows: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """Attach one row per group; missing keys match each other."""
    named = table.select(*[F.col(k).alias(f"{k}_") for k in keys], *[c for c in table.columns if c not in keys])
    match = F.lit(True)
    for k in keys:
        match = match & rows[k].eqNullSafe(named[f"{k}_"])
    return rows.join(named, match).drop(*[f"{k}_" for k in keys])


def level(rows: DataFrame, value: Column, share: float, keys: list[str]) -> DataFrame:
    """By group the lowest cell of ``value`` up to which ``share`` of the rows lie."""
    cells = rows.groupBy(*keys, F.floor(value).alias("cell")).agg(F.count("*").alias("n"))
    up = Window.partitionBy(*keys).orderBy("cell")
    cells = cells.select(*keys, "cell", F.sum("n").over(up).alias("upto"), F.sum("n").over(Window.partitionBy(*keys)).alias("all"))
    return cells.where(F.col("upto") >= F.ceil(F.lit(share) * F.col("all"))).groupBy(*keys).agg(F.min("cell").alias("cell"))


def estimate(rows: DataFrame, names: list[str], keys: list[str], steps: int = STEPS) -> DataFrame:
    """By group centre ``m_…`` and factor ``l_…`` of the minimum covariance determinant estimate, and ``rows``."""
    # start: medians and median deviations, to a cell
    start = None
    for a in names:
        middle = level(rows, F.col(a) * CELL, 0.5, keys).select(*keys, ((F.col("cell") + 0.5) / CELL).alias(f"m_{a}"))
        away = shared(rows.select(*keys, a), middle, keys)
        apart = level(away, F.abs(F.col(a) - F.col(f"m_{a}")) * CELL, 0.5, keys)
        apart = apart.select(*keys, F.pow((F.col("cell") + 0.5) / CELL * 1.4826, 2).alias(f"c_{a}_{a}"))
        both = shared(middle, apart, keys)
        start = both if start is None else shared(start, both, keys)
    for i, a in enumerate(names):
        for b in names[:i]:
            start = start.withColumn(f"c_{a}_{b}", F.lit(0.0))
    model = cut_lineage(factor(start, names, keys))
    close = CELL * F.log1p("d2")
    for _ in range(max(1, steps)):
        near = distance(shared(rows, model, keys), names).select(*keys, *names, "d2")
        chosen = shared(near, level(near, close, SHARE, keys), keys).where(F.floor(close) <= F.col("cell"))
        # sums around zero would lose digits; the group's rows are close to each other, so pairs of deviations are fine
        moments = cut_lineage(chosen.groupBy(*keys).agg(
            *[F.avg(a).alias(f"m_{a}") for a in names],
            *[F.covar_pop(a, b).alias(f"c_{a}_{b}") for i, a in enumerate(names) for b in names[: i + 1]],
        ))
        model = cut_lineage(factor(moments, names, keys))
    near = distance(shared(rows, model, keys), names)
    middle = level(near, close, 0.5, keys).select(*keys, F.expm1((F.col("cell") + 1) / CELL).alias("middle"))
    size = rows.groupBy(*keys).agg(F.count("*").alias("rows"))
    # the spread of the closest rows becomes that of all by the median distance, up or down; floors stay what they are
    usual = F.element_at(F.array(*[F.lit(m) for m in MEDIANS]), F.col("free") + 1)
    ratio = F.when(F.col("free") > 0, F.col("middle") / F.greatest(usual, F.lit(MEDIANS[1]))).otherwise(1.0)
    ratio = shared(model.select(*keys, "free"), middle, keys).select(*keys, ratio.alias("ratio"))
    wide = shared(moments, ratio, keys)
    wide = wide.withColumns({c: F.col(c) * F.col("ratio") for c in moments.columns if c.startswith("c_")})
    return shared(factor(wide, names, keys), size, keys)


def judge(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keys: tuple[str, ...] = ("lang", "source"), steps: int = STEPS) -> DataFrame:
    """One row per input row: doc_id, the counts, base_failed, d2 and kept.

    Null keys form groups like any value. A null or empty text fails the base
    rules. In groups of fewer than ``LEAST_ROWS`` passing rows all are kept.
    Repeated rows are judged each; other columns are not read; an empty table
    gives an empty result. ``d2`` is null where the base rules failed.
    """
    groups = [f"g{i}" for i in range(len(keys))]
    rows = cut_lineage(counted(docs, doc_id, text, keys).withColumn("base_failed", base_failed()))
    names = list(FLOOR)
    passed = rows.where(~F.col("base_failed")).select(*groups, *[c.alias(n) for n, c in statistics().items()])
    model = estimate(cut_lineage(passed), names, groups, steps)
    named = model.select(*[F.col(g).alias(f"{g}_") for g in groups], *[c for c in model.columns if c not in groups])
    match = ~F.col("base_failed")
    for g in groups:
        match = match & F.col(g).eqNullSafe(F.col(f"{g}_"))
    vectors = rows.select("*", *[F.when(~F.col("base_failed"), c).alias(n) for n, c in statistics().items()])
    far = distance(vectors.join(named, match, "left"), names)
    kept = ~F.col("base_failed") & ((F.coalesce("rows", F.lit(0)) < LEAST_ROWS) | ~(F.coalesce("d2", F.lit(0.0)) > LIMIT))
    return far.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "d2")
