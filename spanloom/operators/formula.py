"""Model formulas as text, expanded to the columns of a design.

``a + b`` lists terms, ``a:b`` is an interaction, ``a*b`` stands for both terms
and their interaction, ``1`` for the intercept alone, which is always kept.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations

from pyspark.sql import Column
from pyspark.sql import functions as F

Term = tuple[str, ...]


def parse_formula(text: str) -> tuple[str, list[Term]]:
    """Response and terms of ``response ~ terms``, each term once, lower orders first."""
    response, tilde, right = text.partition("~")
    if not tilde or not right.strip():
        raise ValueError(f"no terms in {text!r}")
    terms: dict[frozenset, Term] = {}
    for part in right.split("+"):
        if part.strip() == "1":
            continue
        crossed = [tuple(f.strip() for f in piece.split(":")) for piece in part.split("*")]
        if not all(f.isidentifier() for piece in crossed for f in piece):
            raise ValueError(f"cannot read {part.strip()!r} in {text!r}")
        for size in range(1, len(crossed) + 1):
            for chosen in combinations(crossed, size):
                term = tuple(dict.fromkeys(f for piece in chosen for f in piece))
                terms.setdefault(frozenset(term), term)
    return response.strip(), sorted(terms.values(), key=len)


def formula_columns(text: str, levels: Mapping[str, Sequence]) -> dict[str, Column]:
    """Design columns of a formula over factors, the first level being the reference.

    In a term a factor goes without its reference level where the term without
    that factor is in the model too, else with all levels. A null factor gives
    zeros.
    """
    _, terms = parse_formula(text)
    known = {frozenset(t) for t in terms} | {frozenset()}
    columns: dict[str, Column] = {"(Intercept)": F.lit(1.0)}
    for term in terms:
        combos: list[tuple[str, Column]] = [("", F.lit(1.0))]
        for factor in term:
            used = levels[factor][1:] if frozenset(term) - {factor} in known else levels[factor]
            hit = {lv: F.when(F.col(factor) == lv, 1.0).otherwise(0.0) for lv in used}
            combos = [(f"{name}:{factor}{lv}".lstrip(":"), value * hit[lv]) for name, value in combos for lv in used]
        columns.update(combos)
    return columns
