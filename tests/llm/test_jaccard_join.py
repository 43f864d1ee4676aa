import random
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spanloom.llm import graph
from spanloom.llm import jaccard_join as J
from spanloom.llm.graph import components
from spanloom.llm.texts import shingle_sets


def plain_set(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def plain_components(texts):
    sets = {i: plain_set(t) for i, t in texts}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                    a, b = find(i), find(j)
                    root[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def corpus(seed, groups, size):
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    out = []
    for _ in range(groups):
        base = draw.choices(words, k=draw.randint(3, 80))
        for _ in range(draw.randint(1, size)):
            copy = list(base)
            for _ in range(draw.randint(0, 4)):
                copy[draw.randrange(len(copy))] = draw.choice(words)
            out.append(draw.choice([" ", "\n", " \t "]).join(copy))
    passage = " ".join(draw.choices(words, k=30))
    out += [passage + " " + " ".join(draw.choices(words, k=draw.randint(1, 40))) for _ in range(20)]
    return list(enumerate(out + ["", None, " \n", "A b C", "a B c", "É é", "one"], start=10))


def test_shingles_match_plain_sets():
    texts = ["a b c d e f", "A  B\tc\nD e f", "x", "", None, "é ü ß a b c", "a b c d", " ".join(["r"] * 50)]
    found = dict(shingle_sets(pa.array(texts)))
    assert {i: len(v) for i, v in found.items()} == {i: len(plain_set(t)) for i, t in enumerate(texts) if plain_set(t)}
    assert found[0].tolist() == found[1].tolist() and found[0].tolist() != found[5].tolist()


def test_shingles_do_not_depend_on_slicing():
    texts = pa.array([f"doc {i} with some words in it {i % 7}" for i in range(50)])
    whole = dict(shingle_sets(texts))
    part = dict(shingle_sets(texts.slice(20, 10)))
    assert all(part[i].tolist() == whole[20 + i].tolist() for i in range(10))


@pytest.mark.parametrize("seed,hot", [(1, 48), (2, 3), (3, 4)])
def test_components_match_brute_force(spark, seed, hot):
    texts = corpus(seed, 25, 12)
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.jaccard_components(docs, hot=hot).collect()}
    assert got == plain_components(texts)


def test_edge_rows_and_clashing_columns(spark):
    rows = [(1, "a b c d e f", "x", 5), (1, "a b c d e f", "x", 5), (2, "A b c d e f", "y", 6), (None, "a b c d e f", "z", 7), (3, None, "n", 8), (4, "", "m", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, sig string, n int")
    got = sorted((r.doc_id or -1, r.component_id or -1) for r in J.jaccard_components(docs).collect())
    assert got == [(-1, 1), (1, 1), (1, 1), (2, 1), (3, 3), (4, 4)]
    kept = sorted((r.doc_id or -1) for r in J.keep_one(docs).collect())
    assert kept == [-1, 1, 1, 3, 4] and J.keep_one(docs).columns == docs.columns
    assert J.jaccard_components(docs.limit(0)).count() == 0


def test_long_chain_closes(spark):
    edges = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r.root for r in components(edges).collect()} == {0}
    assert components(edges.limit(0)).count() == 0


def test_text_without_id_links_its_neighbours(spark):
    words = [f"w{i}" for i in range(60)]
    steps = [J.PERCENT, J.WIDTH]
    chain = [" ".join(words[i : i + 40]) for i in range(0, 12)]
    sets = [{tuple(c.split()[k : k + steps[1]]) for k in range(41 - steps[1])} for c in chain]
    near = lambda i, j: 100 * len(sets[i] & sets[j]) >= steps[0] * len(sets[i] | sets[j])
    b = max(i for i in range(6) if near(0, i))
    assert b and near(b, 2 * b) and not near(0, 2 * b)
    docs = spark.createDataFrame([(1, chain[0]), (None, chain[b]), (3, chain[2 * b])], "doc_id long, text string")
    assert sorted((r.doc_id or -1, r.component_id) for r in J.jaccard_components(docs).collect()) == [(-1, 1), (1, 1), (3, 1)]


def test_components_take_few_checkpoints(spark, monkeypatch):
    cuts, plain = [], graph.settled
    monkeypatch.setattr(graph, "settled", lambda df: cuts.append(1) or plain(df))
    # hubs in a chain, and loose pairs; names fall along the chain
    hubs = [(1000 - 10 * h, 1000 - 10 * h + k) for h in range(50) for k in range(1, 11)]
    loose = [(2000 + 2 * i, 2001 + 2 * i) for i in range(50)]
    want = {n: 510 for e in hubs for n in e} | {n: a for a, b in loose for n in (a, b)}
    for parts, most in ((1, 2), (7, 8)):
        cuts.clear()
        got = components(spark.createDataFrame(hubs + loose, "a long, b long").repartition(parts)).collect()
        assert {r.node: r.root for r in got} == want and len(got) == len(want)
        assert len(cuts) <= most, (parts, len(cuts))


def test_shuffle_files_of_rounds_are_deleted(spark):
    def kept():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {name for i in range(files.size()) if (name := files.apply(i).getName()).startswith("shuffle_") and name.endswith(".data")}

    before, key = kept(), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    as_set = spark.conf.get(key)
    out = components(spark.range(1000).select(F.col("id").alias("a"), (F.col("id") + 5).alias("b")).repartition(5))
    until = time.time() + 20
    while kept() - before and time.time() < until:
        time.sleep(0.2)
    assert not kept() - before and spark.conf.get(key) == as_set
    assert {(r.node, r.root) for r in out.collect()} == {(i, i % 5) for i in range(1005)}


def left_over_case(spark, sets, cluster=None):
    members = [(sig, (cluster or {}).get(sig, 0)) for sig in sets]
    tokens = [(sig, np.array(sorted(x), "<u8").tobytes()) for sig, x in sets.items()]
    return spark.createDataFrame(members, "node long, cluster long"), spark.createDataFrame([], "node long, root long"), spark.createDataFrame(tokens, "sig long, tokens binary")


def test_members_with_shingles_of_their_own_are_not_dealt_to_blocks(spark, monkeypatch):
    # strangers that share a passage: blocks of all by all would take a row per member and block
    sets = {i: {*range(100), *(1000 * i + k for k in range(1000, 1040))} for i in range(3 * J.BLOCK)}
    for i in (5, 700):  # near copies of strangers, in the same cluster
        sets[10_000 + i] = sets[i] - {50} | {999_999_000 + i}
    monkeypatch.setattr(J, "verify_blocks", lambda percent: lambda key, table: pa.table({"a": table.column("sig"), "b": table.column("root")}))
    dealt = [r.a for r in J.left_over_links(*left_over_case(spark, sets), 75).collect()]
    assert set(dealt) == {5, 700, 10_005, 10_700} and len(dealt) < 3 * 4
    monkeypatch.undo()
    assert {(min(r), max(r)) for r in J.left_over_links(*left_over_case(spark, sets), 75).collect()} == {(5, 10_005), (700, 10_700)}


def test_left_over_links_are_those_of_brute_force(spark):
    draw, percent = random.Random(5), 75
    for size in (40, 41):  # own shingles from none to just over the limit, and on it
        sets, base = {}, set(range(size))
        for i in range(1, 60):
            gone = set(draw.sample(sorted(base), draw.randrange(0, 16)))
            sets[i] = base - gone | {1000 * i + k for k in range(len(gone))}
        cluster = {i: i % 2 for i in sets}
        found = J.left_over_links(*left_over_case(spark, sets, cluster), percent)
        got = {r.sig: r.root for r in components(found).selectExpr("node AS sig", "root").collect()}
        want = {i: i for i in sets}
        for _ in sets:
            for i in sets:
                for j in sets:
                    both = len(sets[i] & sets[j])
                    if i % 2 == j % 2 and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                        want[i] = want[j] = min(want[i], want[j])
        assert {i: got.get(i, i) for i in sets} == want
