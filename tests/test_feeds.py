import json

import pytest
from pyspark.sql import functions as F

from linework.operators import identity, panel, validate
from linework.sources import feeds, tables, teams


def one(spark, payload):
    return spark.createDataFrame([(json.dumps(payload),)], "json string")


def test_odds_events(spark):
    event = {"id": "e1", "home_team": "Kansas City Chiefs", "away_team": "Buffalo Bills", "bookmakers": [
        {"key": "dk", "last_update": "t0", "markets": [
            {"key": "h2h", "outcomes": [{"name": "Kansas City Chiefs", "price": -120}, {"name": "Buffalo Bills", "price": None}]},
            {"key": "totals", "last_update": "t1", "outcomes": [{"name": "Over", "price": -110, "point": 48.5}]},
            {"key": "player_rush_yds", "outcomes": [{"name": "Under", "description": " J. Cook ", "price": 105, "point": 60.5}]}]}]}
    got = {(r.market_type, r.side, r.line, r.price, r.player_name, r.updated_at) for r in feeds.flatten_odds_events(one(spark, event)).collect()}
    assert got == {("h2h", "home", 0.0, -120, "", "t0"), ("totals", "over", 48.5, -110, "", "t1"), ("player_rush_yds", "under", 60.5, 105, "J. Cook", "t0")}


def test_injury_map_skips_the_healthy(spark):
    payload = {"1": {"gsis_id": "00-1", "full_name": "A B", "injury_status": "Out"}, "2": {"first_name": "C", "last_name": "D", "practice_participation": "Limited"}, "3": {"full_name": "E F"}, "4": {"injury_status": "IR"}}
    got = {r.player_id: (r.player_name, r.game_status, r.practice_status) for r in feeds.flatten_injury_map(one(spark, payload), 2024, 3).collect()}
    assert got == {"00-1": ("A B", "Out", None), "sleeper:2": ("C D", None, "LP")}


def test_injury_groups(spark):
    payload = [{"team": "KC", "injuries": [{"id": "9", "name": "A B", "status": "Q", "detail": "knee"}, {"id": "8", "name": None}]}]
    assert [(r.player_id, r.game_status) for r in feeds.flatten_injury_groups(one(spark, payload)).collect()] == [("espn:9", "Questionable")]


def test_nearest_hour(spark):
    payload = {"hourly": {"time": ["2024-01-01T17:00", "2024-01-01T18:00", "bad"], "temperature_2m": [1.0, -2.0, 9.0], "wind_speed_10m": [10.0, 20.0, 1.0], "wind_gusts_10m": [12.0, 40.0, 1.0], "precipitation": [0.0, 0.5, 0.0]}}
    df = one(spark, payload).withColumn("kickoff_utc", F.lit("2024-01-01 18:10:00").cast("timestamp")).withColumn("roof", F.lit("outdoors"))
    got = feeds.weather_flags(feeds.nearest_hour_weather(df)).first()
    assert (got.temp_c, got.high_wind, got.freezing, got.wet) == (-2.0, True, True, True)
    indoor = feeds.weather_flags(feeds.nearest_hour_weather(df.withColumn("roof", F.lit("dome")))).first()
    assert (indoor.temp_c, indoor.high_wind, indoor.wet) == (21.0, False, False)


def test_scoreboard(spark):
    payload = {"events": [{"date": "2024-10-06T17:00Z", "competitions": [{"status": {"period": 2, "displayClock": "3:00", "type": {"state": "in"}}, "competitors": [{"homeAway": "home", "score": "14", "team": {"displayName": "Kansas City Chiefs"}}, {"homeAway": "away", "score": None, "team": {"displayName": "Bills"}}]}]}]}
    games = spark.createDataFrame([("g1", "KC", "BUF", "2024-10-06 17:00:00")], "game_id string, home_team string, away_team string, k string").withColumn("kickoff_utc", F.col("k").cast("timestamp"))
    got = feeds.flatten_scoreboard(one(spark, payload), teams.team_aliases(spark), games).first()
    assert (got.game_id, got.home_score, got.away_score, got.period, got.state) == ("g1", 14, 0, 2, "in")


def test_teams(spark):
    assert teams.team_dim(spark).count() == 32 and teams.team_aliases(spark).groupBy("alias").count().filter("count > 1").isEmpty()


@pytest.mark.parametrize(("day", "want"), [("2026-10-25", "17:00"), ("2026-11-15", "18:00")])
def test_schedule_follows_daylight_saving(spark, tmp_path, day, want):
    path = tmp_path / "games.csv"
    path.write_text("game_id,season,week,game_type,gameday,gametime,home_team,away_team,home_score,away_score,spread_line,total_line,roof\n" f"g1,2026,8,REG,{day},13:00,KC,BUF,,,3.0,48.5,dome\n" f"g2,2026,8,REG,{day},,KC,BUF,20,x,,,\n")
    got = {r.game_id: r for r in feeds.load_schedule(spark, str(path)).withColumn("t", F.date_format("kickoff_utc", "HH:mm")).collect()}
    assert got["g1"].t == want and got["g1"].status == "scheduled" and got["g2"].kickoff_utc is None and got["g2"].away_score is None


def test_repair_is_idempotent(spark):
    df = spark.createDataFrame([("2026-10-25T13:00:00",), ("2026-10-25T17:00:00+00:00",), (None,)], "kickoff string")
    once = feeds.repair_kickoffs(df)
    assert [r[0] for r in once.collect()] == ["2026-10-25T17:00:00+00:00"] * 2 + [None]
    assert feeds.repair_kickoffs(once).collect() == once.collect()


def test_drifting_columns(spark, tmp_path):
    spark.createDataFrame([(1, "A")], "id int, name string").write.parquet(f"{tmp_path}/s_2001.parquet")
    spark.createDataFrame([(2, "B", 3)], "id int, name string, extra int").write.parquet(f"{tmp_path}/s_2002.parquet")
    df = tables.scan_source(spark, str(tmp_path), "*.parquet")
    assert set(df.columns) == {"id", "name", "extra"} and df.count() == 2
    out, missing = feeds.resolve_columns(df, {"player_id": ["gsis_id", "id"], "team": ["team"]})
    assert missing == ["team"] and out.columns == ["player_id", "team"]


def test_upsert_and_append(spark):
    rows = lambda *r: spark.createDataFrame(list(r), "k int, v string, at int")
    got = tables.upsert(rows((1, "old", 1), (2, "keep", 5)), rows((1, "new", 1), (2, "late", 3), (3, "add", 1)), ["k"], ["at"])
    assert {(r.k, r.v) for r in got.collect()} == {(1, "new"), (2, "keep"), (3, "add")}
    assert tables.append_new(rows((1, "x", 1)), rows((1, "y", 1), (2, "z", 1), (2, "z", 1)), ["k"]).count() == 1


def test_warehouse_build(spark, tmp_path):
    from linework.sources.fixtures import view

    got = {r.table: r.n for r in tables.build_warehouse(spark, view(spark, "/root/testdata/sf0.001", "fx_plays"), str(tmp_path)).collect()}
    assert set(got) == {"plays", "team_weeks", "defense_depth_weeks", "player_weeks"} and all(got.values())


def test_links_within_a_day(spark):
    events = spark.createDataFrame([("e1", "KC", "BUF", "2024-10-07 00:10:00"), ("e2", "KC", "BUF", "2024-12-01 00:00:00")], "event_id string, home_team string, away_team string, t string").withColumn("commence_at", F.col("t").cast("timestamp"))
    games = spark.createDataFrame([("g1", "KC", "BUF", "2024-10-06 23:00:00")], "game_id string, home_team string, away_team string, t string").withColumn("kickoff_utc", F.col("t").cast("timestamp"))
    assert {r.event_id: r.game_id for r in identity.link_events(events, games).collect()} == {"e1": "g1", "e2": None}


def test_context_is_what_was_known(spark):
    reports = spark.createDataFrame([("p", 1, "Questionable", "2024-01-01 10:00:00"), ("p", 2, "Out", "2024-01-01 12:00:00")], "player_id string, report_id long, report_status string, t string").withColumn("knowledge_time", F.col("t").cast("timestamp")).drop("t")
    when = spark.createDataFrame([("p", "2024-01-01 09:00:00"), ("p", "2024-01-01 11:00:00"), ("p", "2024-01-01 12:00:00")], "player_id string, t string").withColumn("at", F.col("t").cast("timestamp")).drop("t")
    got = panel.known_as_of(when, reports, "player_id", "at").orderBy("at").collect()
    assert [r.known_report_status for r in got] == [None, "Questionable", "Out"]


def test_a_leaky_feature_fails(spark):
    rows = [(s, float(k % 2), float(k % 2) + 0.01 * (k % 7), float((k * 37) % 11)) for s in range(2000, 2008) for k in range(60)]
    df = spark.createDataFrame(rows, "season int, y double, leak double, noise double")
    guess = lambda train, test: test.withColumn("p", (F.col("leak") > 0.5).cast("double"))
    got = {r.name: r.passed for r in validate.leakage_report(df, ["leak", "noise"], "y", guess).collect()}
    assert not got["corr:leak"] and not got["accuracy"] and got["corr:noise"]


def test_a_model_that_answers_for_other_seasons_is_stopped(spark):
    df = spark.createDataFrame([(s, 1.0) for s in range(2000, 2008)], "season int, y double")
    with pytest.raises(Exception, match="is not true"):
        validate.walk_forward(df, lambda train, test: train.withColumn("p", F.lit(0.5))).collect()


def test_teams_by_any_name(spark):
    said = {"kc": "KC", " OAK ": "LV", "new york giants": "NYG", "Jets": "NYJ", "The 49ers": "SF", "New York": None, "": None, None: None, "LA": "LAR", "wft": "WAS"}
    df = spark.createDataFrame([(k,) for k in said], "t string")
    assert {r.t: r.team for r in df.select("t", teams.resolve_team(F.col("t")).alias("team")).collect()} == said
    fields = spark.createDataFrame([(1, "DEN"), (2, "DET"), (3, "XXX")], "game_id int, home_team string")
    got = {r.game_id: (r.roof, r.tz) for r in teams.with_home_field(fields).collect()}
    assert got == {1: ("outdoor", "America/Denver"), 2: ("dome", "America/New_York"), 3: (None, None)}


def test_unreviewed_picks_are_those_no_review_reached(spark):
    from datetime import datetime as t

    from linework.operators import board

    rows = [
        (1, 1, 1, "pending", None, "OK"), (2, 1, 1, "pending", None, ""), (3, 1, 1, "pending", None, None),  # open and unseen; a failed call leaves OK
        (4, 1, 1, "pending", "h", "OK"), (5, 1, 1, "pending", None, "FLAG"), (6, 1, 1, "pending", None, "KILL"), (7, 1, 1, "win", None, "OK"), (8, 1, 0, "pending", None, "OK"), (9, 2, 1, "pending", None, "OK"), (10, 3, 1, "pending", None, "OK"),
    ]
    picks = spark.createDataFrame(rows, "pick_id int, game_id int, published int, result string, review_hash string, verdict string")
    games = spark.createDataFrame([(1, t(2024, 1, 2)), (2, t(2023, 12, 31)), (3, None)], "game_id int, kickoff_utc timestamp")
    runs = spark.createDataFrame([("ok", t(2024, 1, 1, 10))], "status string, finished_at timestamp")
    calls = spark.createDataFrame([(t(2024, 1, 1, 9),)], "at timestamp")
    assert tuple(board.review_coverage(runs, picks, games, calls, "2024-01-01 12:00:00").first()) == (1, 1, 4)
    assert tuple(board.review_coverage(runs, picks, games, calls, "2024-01-01 20:00:00").first()) == (0, 0, 0)
