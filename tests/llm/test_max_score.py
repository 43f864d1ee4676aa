import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.llm import max_score as X


def plain(rows, k):
    whole = {i: np.floor(64 * np.array(v, dtype=np.float32).astype(float)).astype(np.int64) for i, v in rows}
    out = set()
    for q in whole:
        if q % 20 == 0:
            scored = sorted((-int(whole[q] @ v), i) for i, v in whole.items() if i != q and len(v) == len(whole[q]))[:k]
            out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)}
    return out


@pytest.mark.parametrize("seed,scale,spread", [(1, 0.1, 300), (2, 1e6, 60), (3, 0.02, 300)])
def test_matches_brute_force(spark, monkeypatch, seed, scale, spread):
    monkeypatch.setattr(X, "SHARD", 64)
    draw = np.random.default_rng(seed)
    rows = [(int(i), [float(x) for x in np.float32(draw.normal(size=16) * scale)]) for i in range(spread)]
    rows += [(1000 + i, rows[i][1]) for i in range(20)]
    vectors = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, v string")
    got = X.top_k(vectors, vectors.where(F.col("vec_id") % 20 == 0), query_block=7, group=100)
    assert {tuple(r) for r in got.collect()} == plain(rows, 20)


def test_search_skips_what_cannot_compete(monkeypatch):
    monkeypatch.setattr(X, "SHARD", 32)
    draw = np.random.default_rng(4)
    vectors = draw.integers(-3, 4, size=(500, 24))
    vectors[:, 0] *= np.linspace(40, 1, 500).astype(int)
    q, i, s = X.search(np.array([7]), vectors[7:8], np.arange(500), vectors, 10)
    scored = sorted((-int(vectors[7] @ v), j) for j, v in enumerate(vectors) if j != 7)[:10]
    assert sorted(zip(-s, i)) == scored


def test_edges(spark):
    rows = [(0, [0.5, 1.0]), (20, None), (40, [1.0, None]), (60, [float("nan"), 1.0]), (1, [1.0, 1.0]), (1, [2.0, 0.0]), (2, []), (None, [1.0, 1.0]), (3, [1.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = X.top_k(vectors, vectors.where("vec_id % 20 = 0")).collect()
    assert [tuple(r) for r in got] == [(0, 1, 1, 32 * 64 + 64 * 64)]
    assert X.top_k(vectors.limit(0), vectors.limit(0)).count() == 0
