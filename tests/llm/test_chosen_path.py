import random
import re

import pyarrow as pa

from spanloom.llm import chosen_path

SCHEMA = "doc_id long, text string, n string, component_id long"


def shingles(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < width:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def brute(rows, width=3, percent=85):
    sets = [shingles(t, width) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            both = len(x & sets[j])
            if x and sets[j] and 100 * both >= percent * (len(x) + len(sets[j]) - both):
                root[find(i)] = find(j)
    out = []
    for i, (doc, _) in enumerate(rows):
        group = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        least = min(group) if sets[i] and group else doc
        out.append((doc, len(sets[i]), least, least == doc))
    return sorted(out, key=str)


def run(spark, rows, **kw):
    table = spark.createDataFrame([(d, t, "clash", None) for d, t in rows], SCHEMA)
    return sorted(map(tuple, chosen_path.similar_components(table, **kw).collect()), key=str)


def varied(words, rng, changes):
    words = list(words)
    for _ in range(changes):
        words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
    return " ".join(words)


def test_against_brute_force(spark):
    rng = random.Random(1)
    rows = []
    for family in range(40):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(5, 120))]
        rows += [(len(rows) + k, varied(words, rng, rng.randrange(0, 4))) for k in range(rng.randrange(1, 6))]
    rows += [(9000, None), (9001, ""), (9002, " \t"), (9003, "Two Words"), (9004, "two words"), (None, "two  words"), (9005, rows[0][1]), (3, rows[3][1])]
    assert run(spark, rows) == brute(rows)


def test_large_nodes_of_near_copies_and_of_strangers(spark):
    rng = random.Random(2)
    near = [f"n{i}" for i in range(150)]
    shared = [f"s{i}" for i in range(60)]
    rows = [(i, varied(near, rng, rng.randrange(1, 6))) for i in range(150)]
    rows += [(1000 + i, " ".join(shared + [f"own{i}_{k}" for k in range(25)])) for i in range(150)]
    assert run(spark, rows) == brute(rows)


def test_chain_through_a_row_without_id_and_repeats(spark):
    words = [f"a{i}" for i in range(60)]
    first, middle, last = " ".join(words), " ".join(["z", *words[1:]]), " ".join(["z", *words[1:-3], "q", "r", "s"])
    rows = [(5, first), (5, first), (None, middle), (9, last)]
    assert run(spark, rows) == brute(rows)


def test_long_text_and_empty_table(spark):
    long = " ".join(f"w{i}" for i in range(300_000))
    got = run(spark, [(1, long), (2, long + " more"), (3, "short")])
    assert [(r[0], r[2]) for r in got] == [(1, 1), (2, 1), (3, 3)]
    assert run(spark, []) == []


def test_recall_of_pairs_at_the_limit(spark):
    rng = random.Random(4)
    rows, similar = [], 0
    for i in range(300):
        words = [f"p{i}_{k}" for k in range(102)]
        # two of 100 shingles' neighbourhoods change: 92 of 108 in common
        other = list(words)
        for at in (20, 60):
            other[at] = "changed"
        other[101] = "end"
        similar += len(shingles(" ".join(words), 3) & shingles(" ".join(other), 3)) * 100 >= 85 * 107
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other))]
    found = sum(r[0] != r[2] for r in run(spark, rows))
    assert similar == 300 and found >= 0.99 * similar


def test_meeting_chance_falls_slowly_and_sketch_is_whole():
    chances = [chosen_path.meeting_chance(d, 0.85) for d in range(1, 30)]
    assert all(a >= b for a, b in zip(chances, chances[1:])) and chances[-1] > 0.2
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(["a b c d", None])], names=["doc_id", "text"])
    out = next(chosen_path.summarise(3)([batch]))
    assert out.column("n").to_pylist() == [2, 0] and len(out.column("sketch")[0].as_py()) == 4 * chosen_path.SKETCH


def test_small_nodes_of_all_depths_meet_in_one_plan(spark, monkeypatch):
    rng = random.Random(6)
    shared = [f"s{i}" for i in range(60)]
    rows = [(i, " ".join(shared + [f"own{i}_{k}" for k in range(25)])) for i in range(60)]
    rows += [(100 + i, varied(rows[i][1].split(), rng, 1)) for i in range(6)]
    plans, plain = [], chosen_path.pairs_of_small
    monkeypatch.setattr(chosen_path, "pairs_of_small", lambda percent: plans.append(percent) or plain(percent))
    assert run(spark, rows) == brute(rows)
    assert len(plans) == 1


def test_pairs_of_a_node_with_many_rows_are_whole():
    # two nodes of like name may lie beside each other
    batch = pa.RecordBatch.from_arrays([pa.array([7] * 40), pa.array([100] * 40), pa.array(range(40))], names=["node", "n", "sig"])
    assert sum(b.num_rows for b in chosen_path.pairs_of_small(85)([batch])) == 40 * 39 // 2


def test_a_class_in_many_large_nodes_is_joined_with_its_sketch_once(spark, monkeypatch):
    rng = random.Random(7)
    shared = [f"s{i}" for i in range(60)]
    rows = [(i, " ".join(shared + [f"own{i}_{k}" for k in range(25)])) for i in range(60)]
    rows += [(100 + i, varied(rows[i][1].split(), rng, 1)) for i in range(6)]
    plain = chosen_path.branch

    def once(similarity, depth, trees=None):
        inner = plain(similarity, depth, trees)

        def run(batches):
            def seen():
                for batch in batches:
                    assert len(set(batch.column(0).to_pylist())) == batch.num_rows
                    yield batch

            yield from inner(seen())

        return run

    monkeypatch.setattr(chosen_path, "branch", once)
    assert run(spark, rows) == brute(rows)


def test_children_do_not_depend_on_how_entries_are_dealt(monkeypatch):
    rng = random.Random(8)
    sketch = [rng.randbytes(4 * chosen_path.SKETCH) for _ in range(5)]
    nodes = [[{"node": rng.randrange(2**62), "m": 30 + k} for k in range(9)] for _ in range(5)]
    kind = pa.list_(pa.struct([("node", pa.int64()), ("m", pa.int64())]))

    def found(lists):
        sig, n = list(range(5)), [100 + k for k in range(5)]
        batch = pa.RecordBatch.from_arrays([pa.array(sig), pa.array(n), pa.array(sketch, pa.binary()), pa.array(lists, kind)], names=["sig", "n", "sketch", "nodes"])
        return [row for part in chosen_path.branch(0.85, 3)([batch.slice(0, 2), batch.slice(2)]) for row in zip(*part.to_pydict().values())]

    whole = sorted(found(nodes))
    assert len(whole) >= 45 and len({r[1] for r in whole}) == 5
    assert sorted(r for k in range(9) for r in found([[x[k]] for x in nodes])) == whole
    monkeypatch.setattr(chosen_path, "AT_ONCE", 4)
    assert sorted(found(nodes)) == whole
