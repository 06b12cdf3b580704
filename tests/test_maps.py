"""Corpus maps on small tables."""

import numpy as np
import pytest

from quarry.operators import maps as M


def test_consensus_is_average_linkage(spark):
    rng = np.random.default_rng(1)
    labels = np.concatenate([np.repeat([[0, 1, 2]], 7, 0), np.repeat([[1, 0, 0]], 5, 0), np.repeat([[0, 1, 0]], 2, 0), [[-1, 3, 3]]])
    rows = [(int(i), r, int(x)) for i, line in enumerate(labels) for r, x in enumerate(line)]
    rng.shuffle(rows)
    got = {r.item: r.cluster for r in M.consensus(spark.createDataFrame(rows, "item long, run int, label int"), 3).collect()}
    groups = {frozenset(i for i in got if got[i] == c) for c in set(got.values())}
    assert groups == {frozenset([*range(7), 12, 13]), frozenset(range(7, 12)), frozenset([14])}


def test_too_many_combinations_are_refused(spark, monkeypatch):
    monkeypatch.setattr(M, "MOST_COMBINATIONS", 3)
    rows = [(i, 0, i) for i in range(6)]
    with pytest.raises(ValueError):
        M.consensus(spark.createDataFrame(rows, "item long, run int, label int"), 2)


def test_map_of_two_themes(spark):
    rng = np.random.default_rng(0)
    rows, terms = [], []
    for k in range(60):
        centre = np.zeros(16)
        centre[0 if k % 2 else 8] = 1
        theme = ("river", "bridge") if k % 2 else ("market", "price")
        rows.append((k, [float(x) for x in centre + rng.normal(0, 0.05, 16)], f"{theme[0]} {theme[1]} study {k % 5}", f"{theme[1]} theory"))
        terms += [(k, t, 2) for t in theme]
    records = spark.createDataFrame(rows, "base long, embedding array<double>, title string, literature string")
    counts = spark.createDataFrame(terms, "base long, term string, tf long")
    found = {r.base: r.main for r in M.clustered(records, counts, text_cols=["title", "literature"], wanted=4).collect()}
    assert len(found) == 60
    odd, even = {found[k] for k in range(1, 60, 2)}, {found[k] for k in range(0, 60, 2)}
    assert not odd & even


def test_sections_within_a_budget(spark):
    rows = [("a", k, 10 - k, 700) for k in range(8)] + [("b", 1, 1, 10**6)]
    found = M.budgeted_sections(spark.createDataFrame(rows, "by string, key long, n long, chars long"), budget=2000, most=3).collect()
    assert sum(r.by == "a" for r in found) == 2 and [r.key for r in found if r.by == "b"] == [1]


def test_style_matches(spark):
    index = spark.createDataFrame([(k, f"t{k}", [float(k == j) for j in range(4)]) for k in range(4)], "id long, text string, embedding array<double>")
    assert [r.id for r in M.style_matches(index, [0.0, 1.0, 0.5, 0.0], 2).collect()] == [1, 2]
