import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from linework.operators import identity, metrics, models, ops, panel, ratings, validate, warehouse
from linework.functions.names import normal_name
from linework.sources.fixtures import view


def test_player_with_rushes_only_keeps_keys(spark):
    rows = [(1, 1996, 1, 10, "T1", "T2", "rush", 0.5, 1, 50, None, "P1"), (2, 1996, 1, 10, "T1", "T2", "pass", 0.1, 1, 50, 7, "P2")]
    plays = spark.createDataFrame(rows, "play_id int, season int, week int, game_id int, offense string, defense string, play_class string, epa double, down int, yardline_100 int, air_yards int, player_id string")
    got = {r.player_id: r for r in warehouse.player_weeks(warehouse.plays(plays)).collect()}
    assert (got["P1"].season, got["P1"].week, got["P1"].team, got["P1"].carry_share) == (1996, 1, "T1", 1.0)


def test_ratings_equal_a_dense_solve(spark, small):
    plays = warehouse.plays(view(spark, "/root/testdata/sf0.01", "fx_plays"))
    got = ratings.unit_ratings(plays).filter("season = 1996 and week = 9 and play_class = 'all'").orderBy("team").toPandas()
    rows = plays.filter("season = 1996 and week < 9").select("week", "offense", "defense", "epa").toPandas()
    teams = list(got["team"])
    k, n = len(teams), len(rows)
    x = np.zeros((n, 2 * k + 1))
    x[np.arange(n), rows["offense"].map(teams.index)] = 1
    x[np.arange(n), rows["defense"].map(teams.index) + k] = 1
    x[:, -1] = 1
    w = 0.93 ** (9 - rows["week"].to_numpy())
    ridge = np.diag([60.0] * (2 * k) + [0.0])
    want = np.linalg.solve(x.T @ (x * w[:, None]) + ridge, x.T @ (w * rows["epa"].to_numpy()))
    assert np.allclose(got["off_rating"], want[:k], atol=1e-9) and np.allclose(got["def_rating"], want[k : 2 * k], atol=1e-9)


def test_later_weeks_do_not_move_earlier_ratings(spark):
    plays = warehouse.plays(view(spark, "/root/testdata/sf0.01", "fx_plays")).filter("season = 1996")
    changed = plays.withColumn("epa", F.when(F.col("week") >= 9, F.col("epa") + 100).otherwise(F.col("epa")))
    pick = lambda df: ratings.decayed_sums(df).filter("cutoff <= 9").orderBy("cutoff", "play_class", "offense", "defense").collect()
    assert pick(plays) == pick(changed)


def test_shrink_is_half_at_k(spark):
    from linework.functions.odds import shrink

    lit = lambda v: F.lit(float(v))
    got = spark.range(1).select(shrink(lit(0.9), lit(0), lit(0.2), lit(240)), shrink(lit(0.9), lit(240), lit(0.1), lit(240)), shrink(lit(0.9), lit(5), lit(0.1), lit(0))).first()
    assert tuple(got) == pytest.approx((0.2, 0.5, 0.9))


def test_absence_is_a_row_with_zero(spark):
    rows = [("P1", 2024, "T1", w, 3, 0.1) for w in (1, 2, 4, 6)] + [("P2", 2024, "T1", w, 5, 0.1) for w in range(1, 8)]
    usage = spark.createDataFrame(rows, "player_id string, season int, team string, week int, volume long, snap_pct double")
    got = {r.week: (r.volume, r.played) for r in panel.player_panel(usage).filter("player_id = 'P1'").collect()}
    assert got == {1: (3, 1), 2: (3, 1), 3: (0, 0), 4: (3, 1), 5: (0, 0), 6: (3, 1)}


def test_trailing_form_excludes_the_week_itself(spark):
    rows = [("P1", 2024, w, v, 3.0, 1) for w, v in ((1, 4), (2, 0), (3, 8))]
    df = spark.createDataFrame(rows, "player_id string, season int, week int, volume long, baseline_vol double, played int")
    got = {r.week: (r.trail_mean, r.trail_n) for r in panel.trailing_form(df).collect()}
    assert got == {1: (None, 0), 2: (4.0, 1), 3: (2.0, 2)}


def test_certain_forecasts_fall_in_no_bin(spark):
    df = spark.createDataFrame([(1.0, 1), (0.95, 1), (0.3, 0)], "p double, y int")
    assert sorted(r.bin for r in metrics.calibration_table(df, "y", "p").collect()) == [0.3, 0.9]


def test_auc_counts_ties_half(spark):
    df = spark.createDataFrame([(0.5, 1), (0.5, 0), (0.9, 1), (0.1, 0)], "p double, y int")
    assert metrics.auc(df, "y", "p").first().auc == pytest.approx(0.875)


@pytest.mark.parametrize(("a", "b", "same"), [
    ("D.K. Metcalf", "DK Metcalf", True), ("Odell Beckham Jr.", "Odell Beckham", True), ("Amon-Ra St. Brown", "Amon Ra St Brown", True), ("Ja'Marr Chase", "JaMarr Chase", True), ("D K Metcalf", "DK Metcalf", True), ("Brian Robinson", "Bryan Robinson", False), ("José Díaz", "Jose Diaz", False),
])
def test_names(spark, a, b, same):
    x, y = spark.createDataFrame([(a,), (b,)], "n string").select(normal_name(F.col("n"))).collect()
    assert (x == y) == same


def test_ambiguous_names_are_never_guessed(spark):
    players = spark.createDataFrame([("1", "Mike Williams", "A"), ("2", "Mike Williams", "B"), ("3", "Sole Name", "A")], "player_id string, player_name string, team string")
    records = spark.createDataFrame([("sleeper:9", "Mike Williams", "C"), ("sleeper:8", "Mike Williams Jr.", "B"), ("sleeper:7", "Sole Name", None), ("sleeper:6", "Nobody", "A"), ("00-1", "Mike Williams", "A")], "player_id string, player_name string, team string")
    got = {r.player_id: (r.resolved_id, r.status) for r in identity.resolve_players(records, players).collect()}
    assert got == {"sleeper:9": ("sleeper:9", "ambiguous"), "sleeper:8": ("2", "by_name_team"), "sleeper:7": ("3", "by_name"), "sleeper:6": ("sleeper:6", "unresolved"), "00-1": ("00-1", "native")}


def test_alerts_once_on_break_and_once_on_recovery(spark):
    rows = [("a", f"2024-01-01 00:0{k}:00", k, f) for k, f in enumerate([False, True, True, False, False])]
    df = spark.createDataFrame(rows, "alert_key string, at string, seq int, firing boolean")
    assert [r.event for r in ops.alert_transitions(df).orderBy("seq").collect()] == ["broke", "recovered"]


def test_digest_ignores_order_and_small_moves(spark):
    picks = spark.createDataFrame([(1, 7, "h2h", "home", 0.0, 4.1)], "pick_id int, game_id int, market_type string, side string, line double, edge_pct double")
    facts = lambda *f: spark.createDataFrame([(7, x) for x in f], "game_id int, fact string")
    digest = lambda p, f: ops.review_digest(p, f).first().digest
    base = digest(picks, facts("a", "b"))
    assert base == digest(picks, facts("b", "a")) == digest(picks.withColumn("edge_pct", F.lit(5.9)), facts("a", "b"))
    assert base != digest(picks, facts("a", "c")) and base != digest(picks.withColumn("edge_pct", F.lit(6.1)), facts("a", "b"))


def test_budget_ladder_is_strict(spark):
    df = spark.createDataFrame([(30.0,), (30.1,), (15.0,), (5.0,), (5.1,)], "x double").select(ops.allowed_sources(F.col("x")))
    assert [r[0] for r in df.collect()] == ["no_props", "all", "featured", "none", "featured"]


def test_poll_bounds_are_inclusive(spark):
    df = spark.createDataFrame([(2.0,), (2.1,), (72.0,), (72.5,)], "h double").select(ops.interval_minutes(F.col("h"), "props"))
    assert [r[0] for r in df.collect()] == [20, 60, 360, None]


def test_alerts_over_days_equal_one_ordered_walk(spark):
    rows = [(f"k{k % 3}" if k % 5 else None, None if k % 17 == 0 else f"2024-01-{1 + (k * 7) % 9:02d} {k % 24:02d}:30:00", k, (k * k) % 3 == 1) for k in range(300)]
    df = spark.createDataFrame(rows, "alert_key string, at string, seq int, firing boolean").withColumn("at", F.col("at").cast("timestamp"))
    want, was = set(), {}
    for key, at, seq, firing in sorted(rows, key=lambda x: (x[1] or "", x[2])):
        if firing != was.get(key, False):
            want.add((key, seq, "broke" if firing else "recovered"))
        was[key] = firing
    assert {(r.alert_key, r.seq, r.event) for r in ops.alert_transitions(df).collect()} == want
    assert ops.alert_transitions(df.limit(0)).collect() == []


def test_ranks_by_ranges_equal_one_window(spark):
    df = spark.range(3000).selectExpr("id", "cast(id % 2 * (id % 3) as int) as season", "id * 7 % 11 as y")
    plain = df.withColumn("k", F.row_number().over(Window.partitionBy("season").orderBy(F.xxhash64(F.lit(4), *df.columns), *df.columns)))
    assert {tuple(r) for r in validate.ranked(df, 4).collect()} == {tuple(r) for r in plain.collect()}
    moved = validate.shuffled(df, "y")
    sums = lambda x: sorted(map(tuple, x.groupBy("season", "y").count().collect()))
    assert moved.columns == df.columns and sums(moved) == sums(df) and moved.exceptAll(df).count() > 1000
    assert sums(models.permuted(df, "y")) == sums(df)
