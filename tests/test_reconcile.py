"""Proportional scaling to two margins."""

import numpy as np
import pytest

from linework.operators import reconcile as rc


def test_margins_hold_and_odds_ratios_stay():
    rng = np.random.default_rng(1)
    cells = rng.uniform(0.5, 3.0, (7, 4))
    truth = cells * rng.uniform(0.5, 2.0, (7, 1)) * rng.uniform(0.5, 2.0, (1, 4))
    got, rounds, gap = rc.proportional(cells, truth.sum(1), truth.sum(0), 1e-12, 1000)
    assert np.allclose(got, truth, rtol=1e-9) and gap <= 1e-12 and 0 < rounds < 1000


def test_margins_that_are_missing_or_cannot_be_met():
    cells = np.array([[1.0, 1.0], [0.0, 0.0], [2.0, 4.0]])
    got, _, gap = rc.proportional(cells, np.array([4.0, 3.0, np.nan]), np.array([np.nan, np.nan]), 1e-9, 50)
    assert got.tolist() == [[2.0, 2.0], [0.0, 0.0], [2.0, 4.0]] and gap == pytest.approx(3 / 7)
    same, rounds, gap = rc.proportional(cells, np.full(3, np.nan), np.full(2, np.nan), 1e-9, 50)
    assert (same == cells).all() and rounds == 0 and gap == 0.0
    # Columns that sum to another total are scaled to the rows'.
    got, _, gap = rc.proportional(np.ones((2, 2)), np.array([1.0, 3.0]), np.array([50.0, 50.0]), 1e-9, 50)
    assert np.allclose(got, [[0.5, 0.5], [1.5, 1.5]]) and gap <= 1e-9


def test_each_game_by_itself(spark):
    cells = spark.createDataFrame([(1, "a", "x", 1.0), (1, "a", "y", 1.0), (1, "b", "x", 1.0), (1, "b", "y", None), (1, "b", "x", 1.0), (2, "a", "x", 5.0), (2, None, "x", 5.0), (3, "a", "x", -1.0)], "g int, p string, k string, value double")
    rows = spark.createDataFrame([(1, "a", 3.0), (1, "b", 4.0), (2, "a", None)], "g int, p string, total double")
    columns = spark.createDataFrame([(1, "x", 6.0), (1, "y", 1.0), (2, "x", 20.0)], "g int, k string, total double")
    got = {(r.g, r.p, r.k): r for r in rc.reconcile(cells, rows, columns, by="g", row="p", column="k").collect()}
    assert len(got) == 7 and got[1, "b", "x"].value == 2.0 and got[1, "b", "y"].adjusted == 0.0 and got[1, "a", "x"].gap <= 1e-9
    assert got[1, "a", "x"].adjusted == pytest.approx(2.0) and got[1, "a", "y"].adjusted == pytest.approx(1.0) and got[1, "b", "x"].adjusted == pytest.approx(4.0)
    assert got[2, "a", "x"].adjusted == got[2, None, "x"].adjusted == pytest.approx(10.0) and got[3, "a", "x"].adjusted == 0.0
    assert rc.reconcile(cells.limit(0), rows, columns, by="g", row="p", column="k").collect() == []
