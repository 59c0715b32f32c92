"""The practice panel by hand, and that its model finds a signal where there is one and none where there is none."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from linework.operators import practice

REPORT = "report_id long, player_id string, season int, week int, report_status string, practice_status string, season_type string, position string, knowledge_time timestamp"
WHEN = dt.datetime(2020, 1, 1)


def report(k, player="P1", season=2015, week=1, status=None, practised="FP", kind=None, position="WR"):
    return (k, player, season, week, status, practised, kind, position, WHEN)


def weeks(spark, rows, usage=(), snaps=(), crosswalk=None):
    usage = spark.createDataFrame(list(usage), "player_id string, season int, week int, usage_share double")
    snaps = spark.createDataFrame(list(snaps), f"{'source_id' if crosswalk is not None else 'player_id'} string, season int, week int, snap_pct double")
    cross = spark.createDataFrame(crosswalk, "source_id string, player_id string") if crosswalk is not None else None
    return practice.reported_weeks(spark.createDataFrame(rows, REPORT), usage, snaps, cross)


def test_final_reports_of_skill_positions_meet_usage_and_snaps(spark):
    rows = [report(1), report(2, practised="DNP"), report(3, week=2, kind="POST"), report(4, week=3, position="S"), report(5, player=None), report(6, week=4, practised="resting")]
    got = {r.report_id: (r.practice, r.usage_share, r.snap_pct) for r in weeks(spark, rows, [("P1", 2015, 1, 0.25), ("P1", 2015, 1, 0.5)], [("x1", 2015, 1, 0.4), ("x9", 2015, 4, 0.9)], [("x1", "P1")]).collect()}
    assert got == {2: ("none", 0.75, 0.4), 6: (None, 0.0, None)}


def test_one_meaning_of_active(spark):
    rows = [report(k, season=2010 + k, week=1) for k in range(6)]
    usage = [("P1", 2010 + k, 1, 0.5) for k in range(6)]
    snapped = practice.practice_panel(weeks(spark, rows, usage, [("P1", 2012, 1, 0.5), ("P1", 2013, 1, 0.0), ("P1", 2014, 1, 0.6)])).orderBy("season").collect()
    assert [(r.season, r.active) for r in snapped] == [(2013, 0), (2014, 1), (2015, 0)]  # from 2012 on, less its first week
    assert [r.prior_active_3 for r in snapped] == [1.0, 0.5, pytest.approx(2 / 3)]
    touched = practice.practice_panel(weeks(spark, rows, usage, [("P1", 2010, 1, 0.5)])).orderBy("season").collect()
    assert [(r.season, r.active) for r in touched] == [(2011 + k, 1) for k in range(5)]


def test_form_never_sees_its_own_or_later_weeks(spark):
    rows = [report(k, week=k) for k in range(1, 6)]
    shares = [("P1", 2015, k, 0.1 * k) for k in range(1, 6)]
    panel = lambda usage: {r.week: r.prior_usage_3 for r in practice.practice_panel(weeks(spark, rows, usage)).collect()}
    changed = [*shares[:3], ("P1", 2015, 4, 9.0), ("P1", 2015, 5, 9.0)]
    assert panel(shares)[4] == panel(changed)[4] == pytest.approx(0.2)
    assert set(panel(shares)) == {2, 3, 4, 5}


def test_columns_do_not_depend_on_what_occurs(spark):
    one = practice.practice_panel(weeks(spark, [report(1), report(2, week=2)]))
    none = practice.practice_panel(weeks(spark, [report(1)]).limit(0))
    assert one.columns == none.columns and set(practice.BASE + practice.PRACTICE) <= set(one.columns)
    assert none.count() == 0


def test_coverage_is_asked_for(spark):
    rows = [report(1, practised="FP"), report(2, week=2, practised="who knows"), report(3, week=3, practised=None)]
    got = {r.name: (round(r.value, 3), r.passed) for r in practice.coverage(weeks(spark, rows, snaps=[("P1", 2015, 1, 0.5), ("P1", 2015, 2, 0.5)])).collect()}
    assert got == {"practice_understood": (0.333, False), "practice_kinds": (1.0, False), "snaps_in_era": (0.667, True)}
    assert {r.passed for r in practice.coverage(weeks(spark, rows).limit(0)).collect()} == {False}


def test_signal_is_found_and_not_invented(spark):
    ids = spark.range(3000).withColumn("season", (2015 + F.col("id") % 5).cast("int")).withColumn("week", (F.col("id") % 17).cast("int"))
    luck = F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000.0
    fed = ids.withColumn("practice_full", (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(2)) == 0).cast("double")).withColumn("u", luck)
    panel = fed.select("season", "week", F.when(F.col("u") < F.lit(0.3) + 0.6 * F.col("practice_full"), 1).otherwise(0).alias("active"), (F.lit(0.2) + 0.1 * F.col("practice_full")).alias("usage_share"), "practice_full", *[F.lit(0.0).alias(c) for c in practice.BASE + practice.PRACTICE if c != "practice_full"])
    gain = practice.practice_gain(practice.practice_signal(panel, least_train=3)).collect()
    assert {r.season for r in gain} == {2018, 2019} and all(r.helped and r.d_auc > 0.2 and r.d_usage_mae < -0.03 for r in gain)
    # Without practice the best guess of usage is 0.275 for 0.3 (three of four) and 0.2: 0.0375 off.
    idle = practice.practice_gain(practice.practice_signal(panel.withColumn("practice_full", (F.col("week") % 2).cast("double")), least_train=3)).collect()
    assert all(abs(r.d_auc) < 0.1 for r in idle)
    with pytest.raises(ValueError):
        practice.practice_signal(panel, least_train=5)
