"""Micro-fixtures with answers worked out by hand, and properties of the operators."""

from datetime import datetime, timedelta

import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spanloom.functions import scalar as S
from spanloom.operators import columns as C
from spanloom.operators import expect as X
from spanloom.operators import joins as J
from spanloom.operators import measures as M
from spanloom.operators import ranks as W
from spanloom.operators import reshape as R
from spanloom.operators import summaries as A


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_null_keys_match(spark):
    left = spark.createDataFrame([("x", None, 1), ("y", "d", 2)], "k string, d string, v int")
    right = spark.createDataFrame([("x", None, 10), ("y", "d", 20)], "k string, d string, w int")
    assert {r.w for r in J.join_null_safe(left, right, ["k", "d"]).collect()} == {10, 20}
    assert {r.w for r in J.natural_join(left, right).collect()} == {10, 20}
    assert J.anti(left, right, ["k", "d"]).count() == 0
    full = J.join_null_safe(left, right.where("w = 20"), ["k", "d"], "full")
    assert full.count() == 2 and full.columns == ["k", "d", "v", "w"]


def test_guarded_join_raises_on_repeated_key(spark):
    left = spark.createDataFrame([(1,), (2,)], "k int")
    right = spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string")
    with pytest.raises(Exception, match="not unique"):
        J.join_guarded(left, right, "k").collect()
    assert J.join_guarded(left, right.where("v = 'a'"), "k").count() == 2


def test_unknown_membership_keeps_row(spark):
    df = spark.createDataFrame([(1963,), (None,)], "m int")
    assert rows(C.exclude(df, F.col("m").isin(1963))) == [(None,)]
    assert df.where(C.if_else(F.col("m") == 1963, 1, 0).isNull()).count() == 1


def test_weights_equal_replication(spark):
    df = spark.createDataFrame([("a", 1.0, 2), ("a", 3.0, 1)], "g string, x double, w int")
    r = A.weighted_summary(df, ["g"], "x", "w").first()
    assert (r.x_mean, r.x_sd, r.x_n) == (pytest.approx(1.666667, abs=1e-6), pytest.approx(1.154701, abs=1e-6), 3)
    s = A.summarise(R.replicate(df, "w"), ["g"], ["x"]).first()
    assert tuple(s) == pytest.approx(tuple(r)) if isinstance(r[0], float) else s.x_sd == pytest.approx(r.x_sd)
    with pytest.raises(Exception, match="whole"):
        R.replicate(df.withColumn("w", F.lit(1.5)), "w").collect()


def test_ratio_and_content(spark):
    df = spark.createDataFrame([("a", 0.8, 0.4, None, 0.76)], "id string, y_pre double, y_30min double, y_24hr double, y_48hr double")
    got = {r.time: r.ratio for r in M.ratio_to_baseline(df, ["id"], "y_pre", ["y_30min", "y_24hr", "y_48hr"], "y_").collect()}
    assert got["30min"] == pytest.approx(0.5) and got["24hr"] is None and got["48hr"] == pytest.approx(0.95)
    with pytest.raises(Exception, match="positive"):
        M.ratio_to_baseline(df.withColumn("y_pre", F.lit(0.0)), ["id"], "y_pre", ["y_30min"]).collect()
    w = spark.createDataFrame([("a", 10.0, 2.0, 3.0, 13.0, 9.0)], "id string, pre double, dry double, a double, b double, c double")
    assert {r.time: r.content for r in M.relative_content(w, ["id"], "pre", "dry", ["a", "b", "c"]).collect()} == {"a": 0.125, "c": 0.875}


def test_mean_skips_nulls_but_n_counts_rows(spark):
    df = spark.createDataFrame([("g", None), ("g", 0.8)], "g string, x double")
    r = A.summarise(df, ["g"], ["x"]).first()
    assert (r.x_mean, r.x_sd, r.x_n) == (0.8, None, 2)
    assert A.summarise(df, ["g"], ["x"], ("mean",), na="strict").first().x_mean is None


T0 = datetime(2024, 1, 1, 10)


def test_interval_join_touching_sessions(spark):
    spans = spark.createDataFrame([("a", T0, T0 + timedelta(minutes=5)), ("b", T0 + timedelta(minutes=5), T0 + timedelta(minutes=10))], "id string, t0 timestamp, t1 timestamp")
    points = spark.createDataFrame([(1, T0 + timedelta(minutes=5)), (2, T0 + timedelta(minutes=20))], "p int, ts timestamp")
    got = sorted((r.p, r.id or "") for r in J.interval_join(points, spans, "ts", "t0", "t1").collect())
    assert got == [(1, "a"), (1, "b"), (2, "")]


def test_interval_join_agrees_with_brute_force(spark):
    import random

    rng = random.Random(3)
    spans = [(i, "ab"[i % 2], T0 + timedelta(seconds=rng.randrange(9000)), rng.choice([3, 40, 7000])) for i in range(40)]
    spans = [(i, d, s, s + timedelta(seconds=n)) for i, d, s, n in spans]
    points = [(i, "abc"[i % 3], T0 + timedelta(seconds=rng.randrange(16000))) for i in range(120)]
    want = sorted((p, i) for p, d, t in points for i, e, s, f in spans if d == e and s <= t <= f)
    want += [(p, -1) for p, *_ in points if p not in {w[0] for w in want}]
    sdf = spark.createDataFrame(spans, "id int, dev string, t0 timestamp, t1 timestamp")
    pdf = spark.createDataFrame(points, "p int, dev string, ts timestamp")
    out = J.interval_join(pdf, sdf, "ts", "t0", "t1", ["dev"])
    assert sorted((r.p, -1 if r.id is None else r.id) for r in out.collect()) == sorted(want)
    empty = J.interval_join(pdf, sdf.limit(0), "ts", "t0", "t1", ["dev"])
    assert empty.count() == len(points) and empty.where("id is not null").count() == 0


def test_numbering(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "a")], "o int, n string")
    assert [r.u for r in W.number_duplicates(df, "n", ["o"], "u").orderBy("o").collect()] == ["a", "a.1", "b", "a.2"]
    clash = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a.1"), (4, "a")], "o int, n string")
    assert [r.u for r in W.number_duplicates(clash, "n", ["o"], "u").orderBy("o").collect()] == ["a", "a.2", "a.1", "a.3"]
    assert W.keep_extreme(spark.createDataFrame([("g", 5), ("g", 5), ("g", 3)], "g string, s int"), ["g"], "s").count() == 2


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("aaaab"), st.integers(0, 6)), min_size=1, max_size=60))
def test_segmented_numbers_equal_window(spark, items):
    frame = pd.DataFrame([(g, v, i) for i, (g, v) in enumerate(items)], columns=["g", "v", "i"])
    df = spark.createDataFrame(frame)
    for by in (["g"], []):
        plain = W.row_numbers(df, by, ["v", "i"], "n").toPandas()
        cut = W.row_numbers(df, by, ["v", "i"], "n", hot_rows=3, segments=5).toPandas()
        key = ["g", "v", "i"]
        assert plain.sort_values(key).n.tolist() == cut.sort_values(key).n.tolist()


def test_pairs(spark):
    marks = [("start", 0), ("end", 1), ("start", 2)]
    df = spark.createDataFrame([("f", s, T0 + timedelta(minutes=m)) for s, m in marks], "f string, s string, ts timestamp")
    got = W.pair_events(df, ["f"], "ts", "s", "start", "end").orderBy("pair_id").collect()
    assert [r.alternates for r in got] == [True, False]


def test_box_statistics(spark):
    df = spark.createDataFrame([("g", float(v)) for v in (1, 2, 3, 4, 20)], "g string, v double")
    for kw in ({}, {"hot_rows": 2, "segments": 4}):
        r = A.box_stats(df, ["g"], "v", **kw).first()
        assert (r.q1, r.median, r.q3, r.whisker_low, r.whisker_high, r.n_outliers) == (2, 3, 4, 1, 4, 1)


def test_range_overhang(spark):
    data = [("x", "S", 400, 800), ("x", "G", 200, 900), ("y", "S", 400, 800), ("z", "S", 400, 800), ("z", "G", 500, 600)]
    df = spark.createDataFrame(data, "sp string, stage string, low int, high int").withColumns({"mid": F.lit(0.0), "n": F.lit(1)})
    assert {r.sp: r.overhang for r in M.range_overhang(df, ["sp"], "stage", "S", "G").collect()} == {"x": 300, "y": 0, "z": 0}


def test_scalars(spark):
    df = spark.createDataFrame([("173250", "1732.881", "1495030")], "a string, b string, c string")
    r = df.select(S.dms_to_degrees("a", 2, "S"), S.dms_to_degrees("b", 2, "S"), S.dms_to_degrees("c", 3, "W")).first()
    assert tuple(r) == pytest.approx((-17.547222, -17.548017, -149.841667), abs=1e-6)
    texts = spark.createDataFrame([("missing",), ("1,234 g",), ("-0.5x",)], "t string")
    assert [x[0] for x in texts.select(S.parse_number("t")).collect()] == [None, 1234.0, -0.5]
    y = spark.createDataFrame([("-", 120.0, 100.0), (None, 50.0, 100.0)], "y string, f double, fm double")
    out = M.recompute_yield(y, "f", "fm", "y", "q").collect()
    assert (out[0].q, out[0].yield_error) == (0.0, True) and (out[1].q, out[1].yield_error) == (0.5, None)


def test_reshape(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (1, "b", None), (2, "a", 3.0)], "k int, v string, x double")
    wide = R.to_wide(df, ["k"], "v", ["x"], ["a", "b"], name="{level}")
    assert rows(R.to_long(wide, ["k"], ["a", "b"], "v", "x").where("x is not null")) == [(1, "a", 1.0), (2, "a", 3.0)]
    with pytest.raises(Exception, match="several rows"):
        R.to_wide(df.union(df), ["k"], "v", ["x"], ["a"]).collect()
    many = spark.range(50).selectExpr("id % 2 as g", "id as v")
    assert rows(R.unnest(R.nest(many, ["g"], ["v"], parts=5), "data").drop("part")) == rows(many)
    split = R.split_column(spark.createDataFrame([("a_b",), ("a",), ("a_b_c_d",)], "s string"), "s", ["x", "y"], "_")
    assert sorted(split.collect(), key=str) == sorted([("a", "b"), ("a", None), ("a", "b")], key=str)


def test_gates(spark):
    df = spark.createDataFrame([(1, 5.0), (1, None), (3, 50.0)], "k int, v double")
    rules = [*X.not_null("k", "v"), X.within("v", 0, 10), X.unique("k"), X.single_value("k")]
    got = {(r.rule, r.column): r.n_failed for r in X.report(df, rules).collect()}
    assert got == {("not_null", "k"): 0, ("not_null", "v"): 1, ("within", "v"): 1, ("unique", "k"): 2, ("single_value", "k"): 1}
    with pytest.raises(X.GateError, match="unique"):
        X.expect(df, [X.unique("k")])
    assert X.expect(df, X.not_null("k"))[0] is df


def test_rename_rules(spark):
    df = spark.createDataFrame([(1, 2)], "`light_curve_mem` int, `yield_24_hr` int")
    got = C.rename_by_rules(df, [(["light_curve", "_mem"], "memory_pre"), (["24_hr", "yield"], "yield_24hr"), (["48_hr"], "none")])
    assert got.columns == ["memory_pre", "yield_24hr"]
    with pytest.raises(ValueError, match="several"):
        C.rename_by_rules(df, [(["_"], "x")])


def test_streaming_daily_max_equals_batch(spark, tmp_path):
    from spanloom.streaming.daily import daily_max

    data = [("a", T0 + timedelta(hours=6 * i), float(i % 5)) for i in range(20)]
    schema = "k string, ts timestamp, v double"
    spark.createDataFrame(data, schema).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = daily_max(stream, ["k"], "ts", "v").writeStream.format("memory").queryName("daily").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    batch = spark.createDataFrame(data, schema).groupBy("k", F.to_date("ts").alias("day")).agg(F.max("v").alias("v_max"))
    assert rows(spark.table("daily")) == rows(batch)
