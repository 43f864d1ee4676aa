import numpy as np
from pyspark.sql import functions as F

from spanloom.llm import lang_id as L
from tests.compare import DATA


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    models = L.fit(docs, ~held)
    found = L.identify(docs.where(held), models, [F.col("lang")])
    row = found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")).alias("right"), F.min("score").alias("low"), F.max("score").alias("high")).first()
    assert row.right > 0.97 and 0 <= row.low and row.high <= 1


def test_probabilities_sum_to_one(spark):
    docs = spark.createDataFrame([("abab abba baba", "x"), ("cdcd dcdc ccdd", "y")], "text string, lang string")
    models = L.fit(docs)
    letters = np.array([ord(c) for c in "abcd "], dtype=np.uint64)
    context = np.uint64((ord("a") << 48) | (ord("b") << 32) | (ord("a") << 16))
    p = np.exp(models.log_probability(context | letters).astype(float))
    # one more share is set aside for characters never seen
    spare = models.floor["x"] * models.backs["x", 2][1].max()
    assert (p.sum(axis=0) <= 1 + 1e-5).all() and p[:, 0].sum() > 1 - spare - 0.05
    assert p[1, 0] > p[2, 0]


def test_cross_entropy_matches_direct_sum(spark):
    docs = spark.createDataFrame([("the cat the dog", "x"), ("le chat le chien", "y")], "text string, lang string")
    models = L.fit(docs)
    text = "The dog, le chat!"
    row = L.identify(spark.createDataFrame([(text,)], "text string"), models, []).first()
    grams = next(L.char_runs([text], L.letter_table()))[2]
    assert row.length == len(grams)
    assert abs(row.entropy + models.log_probability(grams)[:, models.langs.index(row.lang_pred)].mean()) < 1e-5


def test_edges(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "12 !?", "x"), (4, "abc " * 50_000, "x"), (5, "zyx zyx", None), (5, "zyx zyx", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    models = L.fit(docs)
    got = {r.doc_id: r.lang_pred for r in L.identify(docs, models, [F.col("doc_id")]).collect()}
    assert got == {1: "und", 2: "und", 3: "und", 4: "x", 5: "x"}
    assert L.fit(docs.limit(0)).langs == []
    assert L.drop_foreign(docs.limit(0)).count() == 0


def test_foreign_script_is_rejected_and_clean_texts_stay(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    odd = spark.createDataFrame([(-1, "Съешь ещё этих мягких французских булок да выпей чаю " * 5, None), (-2, "xq zvk jjw qqp wvx kzj " * 30, None), (-3, None, "en")], docs.schema)
    kept = [r.doc_id for r in L.drop_foreign(docs.union(odd)).select("doc_id").collect()]
    assert not {-1, -2, -3} & set(kept) and len(kept) >= 0.998 * docs.count()


def test_unseen_grams_take_no_strangers_entry(spark):
    seen, far = "\u4e00\u4e10", "\u4e40\u4e0d"
    models = L.fit(spark.createDataFrame([(seen * 3, "x"), ("abc", "y")], "text string, lang string"))
    packed = [np.array([(ord(t[0]) << 16) | ord(t[1])], dtype=np.uint64) for t in (seen, far)]
    # the two differ by a multiple of 4,194,301
    assert int(packed[1][0] - packed[0][0]) % 4_194_301 == 0
    assert models.look(models.grams["x", 2], packed[0], 0.0)[0] > 0 and models.look(models.grams["x", 2], packed[1], 0.0)[0] == 0
    assert len(models.grams["x", 4][0]) == len(np.unique(next(L.char_runs([seen * 3], L.letter_table()))[2]))


def test_model_in_spark_scores_like_arrays(spark, monkeypatch):
    rows = [(-1, None, "en"), (-2, "12 !?", "en"), (-3, "\u4e40\u8e0d\uac00 " * 50, None), (-3, "\u4e40\u8e0d\uac00 " * 50, None)]
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").select(F.col("doc_id").cast("long"), "text", "lang")
    docs = docs.union(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    found = []
    for most in (L.MOST_KEYS, 0):
        monkeypatch.setattr(L, "MOST_KEYS", most)
        models = L.fit(docs)
        assert (models.table is None) == (most > 0)
        found.append(sorted(map(tuple, L.identify(docs, models, [F.col("doc_id")]).collect()), key=lambda r: r[0]))
    assert len(found[0]) == len(found[1]) == docs.count()
    for a, b in zip(*found):
        assert a[:2] == b[:2] and a[3] == b[3] and abs(a[4] - b[4]) < 1e-3
        assert a[2] is b[2] is None or abs(a[2] - b[2]) < 1e-4


def test_labelled_junk_is_rejected_in_small_groups_and_in_mass(spark):
    draw = np.random.default_rng(7)

    def junk(n):
        return "".join(draw.choice(list("abcdefghijklmnopqrstuvwxyz     "), n))

    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet").select(F.col("doc_id").cast("long"), "text", "lang")
    # one very long row, a few of a rare length, and some per cent of the common lengths
    rows = [(-1, junk(140_000), "en")] + [(-2 - i, junk(33_000), "de") for i in range(3)] + [(-10 - i, junk(int(draw.integers(600, 4000))), "en") for i in range(25)]
    kept = [r.doc_id for r in L.drop_foreign(docs.union(spark.createDataFrame(rows, docs.schema))).select("doc_id").collect()]
    assert not [i for i in kept if i < 0] and len(kept) >= 0.998 * docs.count()
