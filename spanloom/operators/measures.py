"""Composite measures built from the basic operators."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.operators import joins as J
from spanloom.operators import ranks as W
from spanloom.operators import reshape as R
from spanloom.operators import summaries as A
from spanloom.operators.cluster import kmeans_1d
from spanloom.operators.columns import if_else, rule_value
from spanloom.operators.expect import verified


def eligible(df: DataFrame, baseline: str, above: float, *conditions: Column) -> DataFrame:
    """Rows of the main section whose baseline is known and high enough."""
    for condition in (F.col(baseline).isNotNull(), F.col(baseline) > above, *conditions):
        df = df.where(condition)
    return df


def ratio_to_baseline(
    df: DataFrame, keys: Sequence[str], baseline: str, cols: Sequence[str], prefix: str = "", var: str = "time", out: str = "ratio"
) -> DataFrame:
    """Each later measure as a ratio of the baseline, in long form.

    The baseline must be known and positive; reading a row that breaks this
    raises. A missing measure gives a missing ratio.
    """
    df = verified(df.select(baseline, *keys, *cols), F.col(baseline) > 0, f"{baseline} must be positive")
    ratios = {c: F.col(c) / F.col(baseline) for c in cols}
    long = R.to_long(df.withColumns(ratios), keys, cols, var, out)
    return long.withColumn(var, F.expr(f"substr({var}, {len(prefix) + 1})"))


def relative_content(
    df: DataFrame,
    keys: Sequence[str],
    full: str,
    empty: str,
    cols: Sequence[str],
    bounds: tuple[float, float] = (-0.25, 1.25),
    var: str = "time",
    out: str = "content",
) -> DataFrame:
    """``(w - empty) / (full - empty)`` per measure, outliers beyond the bounds dropped."""
    long = R.to_long(df, [*keys, full, empty], cols, var, "__w")
    content = F.try_divide(F.col("__w") - F.col(empty), F.col(full) - F.col(empty))
    scored = long.withColumn(out, content).select(*keys, var, out)
    return scored.where((F.col(out) > bounds[0]) & (F.col(out) < bounds[1]))


def reference_treatment(
    summary: DataFrame, other: DataFrame, on: Sequence[str], keep: Sequence[Column]
) -> DataFrame:
    """Summary rows of the reference treatment (or its exceptions), second summary attached."""
    chosen = summary.where(rule_value([(k, True) for k in keep], False))
    return J.join_null_safe(chosen, other, list(on))


def exposure_by_occurrence(
    occurrences: DataFrame, site_means: DataFrame, site_keys: Sequence[str], by: Sequence[str], col: str
) -> DataFrame:
    """Mean exposure over the sites where a group occurs; sites without sensor are skipped."""
    return A.summarise(J.join_null_safe(occurrences, site_means, list(site_keys)), by, [col])


def exposure_by_abundance(
    community: DataFrame, site_means: DataFrame, site_keys: Sequence[str], by: Sequence[str], col: str, abundance: str
) -> DataFrame:
    """Abundance-weighted exposure over sites that have a sensor."""
    joined = J.join_null_safe(community, site_means, list(site_keys)).where(F.col(col).isNotNull())
    return A.weighted_summary(joined, by, col, abundance)


def community_long(
    matrix: DataFrame, site: str, sites: DataFrame, suffixes: Mapping[str, str], var: str, value: str, stage: str = "stage"
) -> DataFrame:
    """Site-by-taxon matrix -> long table with the stage taken from the site suffix."""
    long = R.to_long(matrix, [site], [c for c in matrix.columns if c != site], var, value)
    tagged = long.withColumn(stage, rule_value([(F.contains(F.col(site), F.lit(s)), v) for s, v in suffixes.items()]))
    for s in suffixes:
        tagged = tagged.withColumn(site, F.replace(F.col(site), F.lit(s), F.lit("")))
    return J.semi(tagged, sites, site)


def stage_ranges(df: DataFrame, by: Sequence[str], stage: str, col: str) -> DataFrame:
    return df.groupBy(*by, stage).agg(
        F.min(col).alias("low"), F.max(col).alias("high"), F.avg(col).alias("mid"), F.count(F.lit(1)).alias("n")
    )


def range_overhang(ranges: DataFrame, by: Sequence[str], stage: str, base: str, other: str) -> DataFrame:
    """How far the range of one stage reaches beyond that of the base stage.

    The overhang at each end is floored at zero, and zero where the other
    stage was not observed; the two ends are summed. It is missing where only
    the base stage is unknown.
    """
    wide = R.to_wide(ranges, by, stage, ["low", "high", "mid", "n"], [base, other], name="{level}_{value}")
    low, high = (F.col(f"{other}_{end}") for end in ("low", "high"))
    bottom, top = F.col(f"{base}_low") - low, high - F.col(f"{base}_high")

    def floored(seen: Column, gap: Column) -> Column:
        return F.when(seen.isNull() | (gap < 0), F.lit(0.0)).otherwise(gap.cast("double"))

    return wide.withColumn("overhang", floored(low, bottom) + floored(high, top))


def extend_ranges(wide: DataFrame, base: str, other: str) -> DataFrame:
    """Stretch the base range so that it covers the other one as well."""
    return wide.withColumns(
        {
            f"{base}_low": F.least(f"{base}_low", f"{other}_low"),
            f"{base}_high": F.greatest(f"{base}_high", f"{other}_high"),
        }
    )


def batch_membership(
    df: DataFrame,
    unit: str,
    number: str,
    known: Sequence[tuple[float, float, int]],
    batch_times: DataFrame,
    pre: str,
    post: str,
    k: int,
    labels: DataFrame,
) -> DataFrame:
    """Treatment batch of every unit.

    Units whose number lies in a known range ``[low, high)`` take that batch
    and its start and end from ``batch_times(cluster, pre, post)``. The others
    are clustered by start time into ``k`` batches numbered after the known
    ones. ``labels`` adds a label per unit and must list each unit once.
    """
    batch = rule_value([((F.col(number) >= lo) & (F.col(number) < hi), c) for lo, hi, c in known])
    marked = df.withColumn("cluster", batch.cast("int"))
    first = J.join_null_safe(marked.where(F.col("cluster").isNotNull()).select(unit, "cluster"), batch_times, "cluster")
    timed = marked.where(F.col("cluster").isNull()).select(unit, F.col(pre).alias("pre"), F.col(post).alias("post"))
    timed = timed.where(F.col("pre").isNotNull() & F.col("post").isNotNull())
    offset = max((c for *_, c in known), default=0)
    later = kmeans_1d(timed, [], "pre", k, "cluster").withColumn("cluster", F.col("cluster") + offset)
    members = first.select(unit, "pre", "post", "cluster").unionByName(later.select(unit, "pre", "post", "cluster"))
    return J.join_guarded(members, labels, unit)


def session_times(df: DataFrame, by: Sequence[str], start: str, end: str, k: int) -> DataFrame:
    """Mean start and end of each cluster of sessions."""
    clustered = kmeans_1d(df, by, start, k, "cluster")
    return A.mean_time(clustered, [*by, "cluster"], [start, end])


def segment_by_date(df: DataFrame, ts: str, cuts: Sequence[str], out: str = "segment") -> DataFrame:
    """Number the parts of a series between given dates, so lines do not bridge gaps."""
    days = [F.lit(c).cast("date") for c in sorted(cuts)]
    passed = sum((F.when(F.to_date(ts) >= d, 1).otherwise(0) for d in days), F.lit(1))
    return df.withColumn(out, passed)


def recompute_yield(df: DataFrame, f: str, fm: str, reported: str, out: str = "yield", error: str = "yield_error") -> DataFrame:
    """``(fm - f) / fm`` clamped at zero; flag where the device reported no value (``-``)."""
    value = F.try_divide(F.col(fm) - F.col(f), F.col(fm))
    return df.withColumns(
        {error: if_else(F.col(reported) == "-", True, False), out: if_else(value < 0, F.lit(0.0), value)}
    )


def reconcile(
    df: DataFrame, manual: str, device: str, note: str, tolerance: float, out: str, strict: bool = True
) -> DataFrame:
    """One value from a manual and a device entry.

    A note may force either source; otherwise the device value wins when it
    exists. Entries further apart than the tolerance with no such note fail.
    """
    text = F.coalesce(F.col(note), F.lit("none"))
    use_manual, use_device = F.contains(text, F.lit("use manual")), F.contains(text, F.lit("use device"))
    apart = F.abs(F.col(device) - F.col(manual)) > tolerance
    ok = F.coalesce(~(apart & ~use_manual & ~use_device), F.lit(True))
    checked = verified(df, ok, f"{manual} and {device} disagree") if strict else df.withColumn("pass_check", ok)
    choice = rule_value(
        [(use_manual, F.col(manual)), (use_device, F.col(device)), (F.col(device).isNull(), F.col(manual))], F.col(device)
    )
    return checked.withColumn(out, choice)


def correction_table(df: DataFrame, recorded: str, offset: str, manual: str, out: str) -> DataFrame:
    """Corrected number: the manual one, else the recorded one plus its offset."""
    known = df.where(F.col(recorded).isNotNull())
    return known.withColumn(out, F.coalesce(F.col(manual), F.col(recorded) + F.coalesce(F.col(offset), F.lit(0))))


def assemble_series(
    series: Sequence[DataFrame],
    metadata: DataFrame,
    on: Sequence[str],
    status: str,
    exclusions: Sequence[Column] = (),
    relabel: Mapping[str, Sequence[tuple[Column, object]]] | None = None,
) -> DataFrame:
    """Sensor series from several sources with logger metadata attached.

    Rows not marked ``keep`` or met by an exclusion are dropped; ``relabel``
    rewrites columns by time-dependent rules, first match wins.
    """
    tagged = J.join_null_safe(R.bind_rows(*series), metadata, list(on))
    state = rule_value([(e, "exclude") for e in exclusions], F.col(status))
    kept = tagged.where(state == "keep").drop(status)
    return kept.withColumns({c: rule_value(rules, F.col(c)) for c, rules in (relabel or {}).items()})


def flag_listed(df: DataFrame, listed: DataFrame, on: Sequence[str], out: str = "outlier") -> DataFrame:
    """Flag the rows a reviewer listed; repeated listings count once."""
    marks = listed.select(*on).distinct().withColumn("__hit", F.lit(True))
    joined = J.join_null_safe(df, marks, list(on))
    return joined.withColumn(out, F.coalesce("__hit", F.lit(False))).drop("__hit")


def relabel_by_count(df: DataFrame, by: Sequence[str], label: str, few: int, suffix: str) -> DataFrame:
    """Append a suffix to the label of groups with at most ``few`` rows."""
    counted = W.with_group_count(df, by, "__n")
    text = F.when(F.col("__n") <= few, F.concat(F.col(label), F.lit(suffix))).otherwise(F.col(label))
    return counted.withColumn(label, text).drop("__n")
