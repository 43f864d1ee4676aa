import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from spanloom.llm import best_fit_lp as B
from spanloom.llm import packed_rows as R
from spanloom.llm.tokens import cuts, encoder
from tests.compare import DATA

TEXTS = ["", None, "one", "Grüße, <|endoftext|> and  spaces\n\n\t x", "it's 12345 " * 900, "a" * 3000, "!?" * 10]


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [2]


def test_ids_match_the_tokenizer(spark, tokenizer):
    texts = [r.text for r in spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").collect()] + [t for t in TEXTS if t]
    encode = encoder()
    assert all(encode(t) == tokenizer.encode(t, add_special_tokens=False).ids for t in texts)


def test_cuts():
    assert cuts(1024, 1024) == [(0, 1024)]
    assert cuts(2048, 1024) == [(0, 1024), (1024, 1024)]
    assert cuts(2050, 1024) == [(0, 2), (2, 1024), (1026, 1024)]


def test_pieces_and_places(spark, tokenizer):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(2, "one"), (None, "no id")]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, length int, number int")
    got = B.pack(docs).collect()
    by_doc, by_sequence = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, text in enumerate(TEXTS):
        ids = ids_of(tokenizer, text)
        for r in by_doc[i]:
            part = np.array(ids[r.start : r.start + r.length], dtype="<u4")
            assert r.ids_crc32 == zlib.crc32(part.tobytes())
        if i != 2:
            assert sorted((r.piece, r.start, r.length) for r in by_doc[i]) == [(k, s, n) for k, (s, n) in enumerate(cuts(len(ids), 1024))]
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    total = sum(r.length for r in got)
    assert len(by_sequence) <= -(-total // 1024) + 1
    assert B.pack(docs.limit(0)).count() == 0


def histogram(seed, n, capacity=256):
    draw = random.Random(seed)
    demand = np.zeros(capacity + 1, dtype=np.int64)
    for _ in range(n):
        demand[min(capacity, max(1, int(draw.lognormvariate(4, 1))))] += 1
    return demand


@pytest.mark.parametrize("seed,n", [(1, 50), (2, 3000), (3, 200_000)])
def test_plan_is_near_the_lower_bound(seed, n):
    demand = histogram(seed, n)
    plan = B.solve(demand, 256)
    got = np.zeros_like(demand)
    for inside, times in plan:
        assert 0 < sum(inside) <= 256
        for length in inside:
            got[length] += times
    assert (got == demand).all()
    bound = -(-int((demand * np.arange(257)).sum()) // 256)
    plain = sum(times for _, times in B.best_fit_decreasing(demand, [], 256))
    assert sum(times for _, times in plan) <= max(plain, int(1.002 * bound) + 2)


def test_knapsack_matches_brute_force():
    draw = random.Random(5)
    lengths, prices = np.array([2, 3, 7, 11]), np.array([draw.random() for _ in range(4)])
    best, last = B.knapsack(lengths, prices, 30)
    plain = [0.0]
    for c in range(1, 31):
        plain.append(max([plain[c - 1]] + [plain[c - n] + p for n, p in zip(lengths, prices) if n <= c]))
    assert np.allclose(best, plain)
    used = B.trace(last, 30)
    assert sum(n * k for n, k in used.items()) <= 30
    assert np.isclose(sum(prices[list(lengths).index(n)] * k for n, k in used.items()), best[30])


def test_segment_tree_is_best_fit():
    draw = random.Random(7)
    lengths = [draw.randint(1, 100) for _ in range(500)]
    rows = R.best_fit_decreasing(lengths, 100)
    room, plain = [], []
    for i in sorted(range(500), key=lambda i: (-lengths[i], i)):
        fits = [r for r in room if r >= lengths[i]]
        if fits:
            room.remove(min(fits))
            room.append(min(fits) - lengths[i])
        else:
            room.append(100 - lengths[i])
        plain.append(i)
    assert sorted(i for row in rows for i in row) == list(range(500))
    assert sorted(100 - sum(lengths[i] for i in row) for row in rows) == sorted(room)


def test_packed_rows_round_trip(spark, tokenizer):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "no id")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, input_ids string")
    for capacity, window in ((64, 500), (2048, 1 << 22)):
        parts = {}
        for r in R.pack_rows(docs, capacity=capacity, window=window).collect():
            assert len(r.input_ids) == len(r.position_ids) == capacity and r.cu_seqlens[-1] == r.n_tokens and len(r.doc_ids) == r.n_segments
            assert all(x == R.PADDING for x in r.input_ids[r.n_tokens :])
            for k, (a, b) in enumerate(zip(r.cu_seqlens, r.cu_seqlens[1:])):
                assert r.position_ids[a:b] == list(range(b - a))
                parts.setdefault(r.doc_ids[k], []).append((r.starts[k], r.pieces[k], r.input_ids[a:b]))
        for i, text in rows:
            assert [x for _, _, ids in sorted(parts[i]) for x in ids] == ids_of(tokenizer, text)
    assert R.pack_rows(docs.limit(0)).count() == 0


def test_program_runs_for_few_pieces(monkeypatch):
    runs, whole = [], B.fractional
    monkeypatch.setattr(B, "fractional", lambda *a: runs.append(a) or whole(*a))
    B.solve(histogram(1, 50), 256)
    assert runs
