"""Many rooted trees, one text per row, to one edge table."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

EDGES = "tree_id {kind}, parent string, child string, length double, label string, support double, is_tip boolean, pos int"
_TOKEN = re.compile(r"[(),;]|[^(),;]+")


def tree_edges(text: str) -> list[tuple]:
    """Edges of one bracketed tree; inner nodes are numbered in reading order."""
    stack, edges, closed, opened, count = [], [], None, {}, 0

    def attach(node: str, mark: str, tip: bool) -> None:
        name, _, length = mark.partition(":")
        name = name.strip().strip("'")
        support = None if tip or not re.fullmatch(r"[0-9.]+", name) else float(name)
        parent = stack[-1] if stack else None
        pos = at if tip else opened[node]
        edges.append((parent, node, float(length) if length else None, name or None, support, tip, pos))

    for at, token in enumerate(_TOKEN.findall(text.strip())):
        if token == "(":
            stack.append(f"n{count}")
            opened[stack[-1]] = at
            count += 1
        elif token in "),;":
            if closed is not None:
                attach(closed, "", False)
            closed = stack.pop() if token == ")" else None
        elif closed is not None:
            attach(closed, token, False)
            closed = None
        elif token.strip():
            attach(token.partition(":")[0].strip().strip("'"), token, True)
    return edges


def edges_of(df: DataFrame, tree_id: str, text: str) -> DataFrame:
    """One row per node; the root has no parent, ``pos`` is the place in the text."""
    kind = df.schema[tree_id].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["tree_id", "parent", "child", "length", "label", "support", "is_tip", "pos"]
        for batch in batches:
            rows = [(key, *edge) for key, tree in zip(batch["tree_id"], batch["text"]) for edge in tree_edges(tree)]
            yield pd.DataFrame(rows, columns=names).astype({"length": float, "support": float})

    return df.selectExpr(f"`{tree_id}` as tree_id", f"`{text}` as text").mapInPandas(run, EDGES.format(kind=kind))


def read_trees(spark: SparkSession, path: str) -> DataFrame:
    """Edge table of text files with one tree per line."""
    from spanloom.sources.lines import read_lines

    lines = read_lines(spark, path).where("trim(line) != ''").selectExpr("concat(file, '#', line_no) as id", "line")
    return edges_of(lines, "id", "line")
