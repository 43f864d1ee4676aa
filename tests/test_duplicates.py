"""Suffixes of repeated names against a walk by hand."""

import random

import pytest

from spanloom.operators.ranks import number_duplicates


def by_hand(names):
    """The next free suffix for each later copy, in order."""
    present, last, out = set(names), {}, []
    for name in names:
        if name not in last:
            last[name] = 0
            out.append(name)
            continue
        n = last[name] + 1
        while f"{name}.{n}" in present:
            n += 1
        last[name] = n
        out.append(f"{name}.{n}")
    return out


@pytest.mark.parametrize("hot_rows", [2_000_000, 3])
def test_suffixes_equal_a_walk(spark, hot_rows):
    draw = random.Random(5)
    names = ["a"] * 12 + [f"a.{n}" for n in (1, 2, 5, 9, 11, 40)] + ["a.1"] * 2 + ["a.1.2", "b", "b", "b.01", "b.0", "", "", ".1", "c.7", "a." + "9" * 30]
    draw.shuffle(names)
    df = spark.createDataFrame(list(enumerate(names)), "i int, name string")
    got = number_duplicates(df, "name", ["i"], "unique", hot_rows=hot_rows).orderBy("i").collect()
    assert [r.unique for r in got] == by_hand(names)
    assert number_duplicates(df.limit(0), "name", ["i"], "unique").count() == 0
