"""The bust matrix, its model and the sealed hold-out."""

import random
from datetime import datetime as t

import pytest
from pyspark.sql import functions as F

from linework.operators import availability as av


@pytest.fixture(scope="module")
def matrix(spark):
    """Busts follow last week's volume; all other features say nothing, and some never change."""
    rng = random.Random(2)
    rows = []
    for k in range(900):
        low = rng.random() < 0.4
        values = {c: 0.0 for c in av.COLUMNS} | {"last_week_vol": rng.uniform(0, 2) if low else rng.uniform(4, 9), "trail_mean": rng.random(), "week_no": float(rng.randint(1, 17))}
        rows.append((f"p{k % 60}", 2020 + k % 4, k // 60, *values.values(), float(rng.random() < (0.85 if low else 0.1))))
    return spark.createDataFrame(rows, f"player_id string, season int, week int, {', '.join(f'{c} double' for c in av.COLUMNS)}, bust double").persist()


def test_rows_that_are_left_out(spark):
    formed = spark.createDataFrame([("a", 2024, "T", 2, 8.0, 3, 1, 6.0, 8, 0.0, 2, 7, 0), ("a", 2024, "T", 3, 8.0, 0, 0, 6.0, 8, 0.0, 3, 5, 1), ("a", 2024, "T", 1, 8.0, 5, 1, None, None, None, 0, None, 0), ("a", 2024, "T", 4, 8.0, 5, 1, 5.0, 8, 0.2, 4, 4, 0)],
        "player_id string, season int, team string, week int, baseline_vol double, volume long, played int, trail_mean double, trail_max long, trail_zero_rate double, trail_n long, last_week_vol long, bust int")
    early, late = t(2024, 1, 1), t(2024, 1, 2)
    reports = spark.createDataFrame([("a", 2024, 2, 1, early, "Out", None), ("a", 2024, 2, 2, late, "Questionable", "Limited Participation in Practice"), ("a", 2024, 3, 3, early, "Out", None)], "player_id string, season int, week int, report_id int, knowledge_time timestamp, report_status string, practice_status string")
    context = spark.createDataFrame([(2024, w, "T", 3.0, 24.0, 1) for w in (1, 2, 3)], "season int, week int, team string, abs_spread double, implied_total double, is_home int")
    got = av.bust_matrix(formed, reports, context).collect()
    # Week 1 has no form, week 3 is Out, week 4 has no game; week 2's last report counts.
    assert [(r.week, r.report_questionable, r.report_none, r.practice_limited, r.practice_none, r.vol_vs_baseline, r.bust) for r in got] == [(2, 1.0, 0.0, 1.0, 0.0, 7 / 8, 0.0)]


def test_model_beats_the_base_rate_by_the_feature_that_matters(matrix):
    train, test = matrix.filter("season < 2023"), matrix.filter("season = 2023")
    model = av.fit(train, trees=False)
    e = av.evaluation(model, train, test).first()
    assert (e.n_train, e.n_test) == (675, 225) and e.beats_base and e.brier < e.brier_baseline - 0.05 and e.ece < 0.2
    found = {r.feature: r.importance for r in av.permutation_importance(model, test).collect()}
    assert set(found) == set(av.COLUMNS) and max(found, key=found.get) == "last_week_vol" and found["last_week_vol"] > 0.05
    assert all(abs(v) < 0.02 for c, v in found.items() if c != "last_week_vol")
    again = {r.feature: r.importance for r in av.permutation_importance(model, test).collect()}
    assert again == pytest.approx(found)


def test_correlations_without_spread_are_null(matrix):
    got = {r.feature: (r.corr, r.suspicious) for r in av.closest_features(matrix.withColumn("trail_max", F.col("bust"))).collect()}
    assert got["is_home"] == (None, False) and got["trail_max"] == (pytest.approx(1.0), True) and not got["last_week_vol"][1] and got["last_week_vol"][0] < -0.5


def test_hold_out_opens_once(matrix, tmp_path):
    seal = f"{tmp_path}/seal"
    assert av.held_out_once(matrix, [2022, 2023], seal).select("season").distinct().count() == 2
    with pytest.raises(PermissionError):
        av.held_out_once(matrix, [2023], seal)
