import random
import re

import numpy as np
from pyspark.sql import functions as F

from spanloom.llm import robust_outliers as R


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    marked = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(marked)


def test_counts_match_brute_force(spark):
    draw = random.Random(1)
    texts = [None, "", " \n\t", "one", "a b c d e", "a b c d e a b c d e", "x\nx\n\n \nx é#|", "|a| <b>\x0bc\x0cd\re"]
    for _ in range(60):
        texts.append(draw.choice([" ", "\n"]).join(draw.choices("a b c dd é# * lorem".split(" "), k=draw.randint(1, 80))))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").withColumn("lang", F.lit(None).cast("string")).withColumn("source", F.lit("s"))
    for r in R.counted(docs).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain(texts[r.doc_id]), texts[r.doc_id]


def test_planted_outliers_go_and_clean_texts_stay(spark):
    draw = random.Random(2)
    words = ["lorem", "ipsum", "dolor", "sit", "amet", "consectetur", "elit"] + [f"w{i}" for i in range(500)]
    rows = [(i, " ".join(draw.choices(words, k=draw.randint(30, 400))), "en", draw.choice(["a", "a", "b"])) for i in range(400)]
    rows += [(1000 + i, " ".join(w + "%%%" for w in draw.choices(words, k=100)), "en", "a") for i in range(10)]
    rows += [(2000 + i, " ".join("".join(draw.choices(words, k=30)) for _ in range(50)), "en", "a") for i in range(10)]
    rows += [(3000, "few words", "en", "a"), (3001, None, None, None), (3002, "", "en", None), (3003, " ".join(draw.choices(words, k=50)), None, None)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, lang string, source string")
    kept = {r.doc_id: r.kept for r in R.judge(docs).collect()}
    assert len(kept) == len(rows)
    assert not any(kept[i] for i in kept if 1000 <= i < 3003)
    assert sum(not kept[i] for i in range(400)) <= 2 and kept[3003]


def test_estimate_matches_dense_concentration(spark):
    draw = np.random.default_rng(3)
    x = draw.normal(size=(600, 5)) * [1, 0.5, 1, 2, 1] + [5, 2, 1, 0, 3]
    x[:100] += 15
    rows = spark.createDataFrame([(f"g{i % 2}", *map(float, v)) for i, v in enumerate(x)], "g0 string, x1 double, x2 double, x3 double, x4 double, x5 double")
    names = list(R.FLOOR)
    for r in R.estimate(rows, names, ["g0"]).collect():
        clean = x[100:][[i % 2 == int(r.g0[1]) for i in range(100, 600)]]
        assert np.allclose([r[f"m_{n}"] for n in names], clean.mean(axis=0), atol=0.5)


def test_empty_table_and_other_columns(spark):
    docs = spark.createDataFrame([(1, "a b", "en", "s", 3)], "doc_id int, text string, lang string, source string, n_words int")
    assert R.judge(docs.limit(0)).count() == 0
    assert R.judge(docs).first().kept is False


def test_rows_extreme_in_one_statistic_go(spark):
    draw = random.Random(4)
    words = [f"wo{i:03}" for i in range(900)]

    def text(n):
        return [draw.choice(words) for _ in range(n)]

    rows = [(i, " ".join(text(draw.randint(80, 300)))) for i in range(300)]
    rows += [(1000, " ".join(w + "%" if i % 4 == 0 else w for i, w in enumerate(text(200))))]  # symbols: some 5 %
    rows += [(1001, " ".join((w := text(180)) + w[:18]))]  # 18 % repeated words
    rows += [(1002, "\n".join((w := [" ".join(text(4)) for _ in range(30)]) + w[17::-1]))]  # 37 % repeated lines
    rows += [(1003, " ".join(w + "abc" for w in text(200)))]  # words longer by 60 %
    rows += [(1004, " ".join(draw.choices([f"{a:05}" for a in range(100_000)], k=30_000)))]  # length
    docs = spark.createDataFrame([(*r, "en", "s") for r in rows], "doc_id int, text string, lang string, source string")
    found = R.judge(docs).collect()
    assert not [r.doc_id for r in found if r.doc_id >= 1000 and (r.kept or r.base_failed)]
    assert sum(not r.kept for r in found if r.doc_id < 1000) <= 1
