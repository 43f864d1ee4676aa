import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from spanloom.llm import plans
from spanloom.llm import pu_toxicity as T
from tests.compare import DATA


def test_held_out_accuracy(spark):
    folder = f"{DATA}/sf0.1"
    found = plans.QUERIES["op6_pu_toxicity"](spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("held_out")
    row = found.agg(
        F.avg(F.when(F.col("toxic") == 1, F.col("predicted"))).alias("caught"), F.avg(F.when(F.col("toxic") == 0, F.col("predicted"))).alias("false"),
        F.min("score").alias("low"), F.max("score").alias("high"),
    ).first()
    assert row.caught > 0.85 and row.false < 0.01 and 0 <= row.low <= row.high <= 1


def test_risk_recovers_a_boundary_from_positive_and_unlabelled():
    draw = np.random.default_rng(1)
    n, prior = 4000, 0.3
    truth = np.concatenate((np.ones(1000), draw.random(n) < prior)).astype(bool)
    x = draw.normal(size=(len(truth), 2)) + np.where(truth, 2.0, -2.0)[:, None]
    positive = np.arange(len(truth)) < 1000
    rows, at = np.repeat(np.arange(len(truth)), 2), np.tile([0, 1], len(truth))
    weights, bias = T.fit_risk(rows, at, x.ravel(), positive, prior, 2)
    called = T.sigmoid(x @ weights + bias) > 0.5
    assert (called == truth)[1000:].mean() > 0.97


def test_features_do_not_depend_on_case_or_neighbours():
    def slots(texts, row):
        first, last, found, rows, words = next(T.features(pa.array(texts)))
        return sorted(found[rows == row]), int(words[row])

    assert slots(["Trash, ÉCOLE!"], 0) == slots(["other", "trash école"], 1)
    assert slots(["", None, "ab"], 0) == ([], 0)


def test_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "some words"), (3, "some words"), (None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(3, 1), (2, 0), (9, None)], "doc_id long, toxic int")
    for known in (labels, labels.limit(0)):
        model = T.learn(docs, known)
        got = T.score(docs, model, [F.col("doc_id")]).collect()
        assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    assert T.score(docs.limit(0), model, [F.col("doc_id")]).count() == 0


def test_every_text_labelled(spark):
    rows = [(i, f"the {'vile trash' if i % 5 == 0 else 'calm river'} of place {i} and more {i % 7}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(400)], "doc_id long, toxic int")
    model = T.learn(docs, labels)
    for r in T.score(docs, model, [F.col("doc_id")]).collect():
        assert (r.score >= T.THRESHOLD) == (r.doc_id % 5 == 0)
    only = T.learn(docs.where("doc_id % 5 = 0"), labels)
    assert {round(r.score, 3) for r in T.score(docs, only, []).collect()} == {1.0}


def test_rows_without_id_are_scored_and_not_held_out(spark, tmp_path):
    rows = [(i, f"the {'vile trash' if i % 5 == 0 else 'calm river'} of place {i}", "en", "a", 1) for i in range(300)] + [(None, "vile trash", "en", "a", 1), (None, None, None, None, 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(0, 300, 2)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name in ("op6_pu_toxicity", "op10_kneser_ney"):
        got = plans.QUERIES[name](spark, str(tmp_path)).where("doc_id is null").collect()
        assert len(got) == 2 and all(r.held_out is False for r in got)


def test_toxic_counts_cover_the_fold(spark):
    """The inputs are those of all toxic texts, however few of them are fitted on."""
    rows = [(i, f"{'vile' if i % 2 else 'calm'} word") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(600)], "doc_id long, toxic int")
    whole, few = T.learn(docs, labels), T.learn(docs, labels, most_positive=40, most_other=40)
    assert (whole.inputs == few.inputs).all()


def test_marks_keep_all_listed_texts_and_few_others(spark):
    rows = spark.range(20_000).select((F.col("id") - 10_000).alias("id"), F.lit("t").alias("text"))
    ids = rows.where("id % 50 = 0").select(F.col("id").alias("__of"))
    kept = {r.id for r in T.marked(rows, ids.union(ids)).collect()}
    assert {i for i in range(-10_000, 10_000) if i % 50 == 0} <= kept and len(kept) < 500
    # with as many ids as marks none is lost either, and no row comes twice
    assert T.marked(rows, rows.select(F.col("id").alias("__of")), 128).count() == 20_000
    assert T.marked(rows, ids.limit(0)).count() == 0
    named = spark.createDataFrame([("a", "x"), (None, "y")], "id string, text string")
    assert [r.text for r in T.marked(named, spark.createDataFrame([("a",)], "__of string")).collect()] == ["x"]
