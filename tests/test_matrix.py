"""The feature matrix on small tables whose answers are known by hand."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from linework.operators import features, validate


def at(text):
    return dt.datetime.fromisoformat(text)


GAMES = "game_id long, season int, week int, home_team string, away_team string, kickoff_utc timestamp, home_score int, away_score int, spread_line double, total_line double"


@pytest.fixture(scope="module")
def games(spark):
    return spark.createDataFrame([
        (1, 2020, 1, "A", "B", at("2020-09-06 17:00"), 20, 10, 3.0, 41.0),
        (2, 2020, 2, "B", "A", at("2020-09-17 00:20"), 14, 17, -2.5, 44.0),
        (3, 2020, 3, "A", "C", None, 3, 6, 1.0, 40.0),
        (4, 2020, 4, "C", "A", at("2020-09-27 20:00"), None, None, 1.0, 40.0),
        (5, 2021, 1, "A", "C", at("2021-09-06 20:00"), 7, 7, None, 40.0),
    ], GAMES)


def test_rest_counts_days_within_a_season(games):
    got = {r.game_id: (r.home_rest, r.away_rest) for r in features.with_rest(games).collect()}
    assert got == {1: (None, None), 2: (11, 11), 3: (None, None), 4: (None, 10), 5: (None, None)}
    own = games.withColumn("home_rest", F.lit(4)).withColumn("away_rest", F.lit(5))
    assert {(r.home_rest, r.away_rest) for r in features.with_rest(own).collect()} == {(4, 5)}


QUOTE = "game_id long, market_type string, player_id string, side string, line double, book string, price int, observed_at timestamp, seq long"


def quotes(spark, more=()):
    base = [
        (1, "h2h", "", "home", 0.0, "pinnacle", -150, at("2020-09-05 12:00"), 1), (1, "h2h", "", "away", 0.0, "pinnacle", 130, at("2020-09-05 12:00"), 2),
        (1, "h2h", "", "home", 0.0, "soft", 100, at("2020-09-05 12:00"), 3), (1, "h2h", "", "away", 0.0, "soft", 100, at("2020-09-05 12:00"), 4),
        (1, "spreads", "", "home", -3.0, "soft", -110, at("2020-09-01 12:00"), 5), (1, "spreads", "", "home", -4.5, "soft", -110, at("2020-09-06 16:00"), 6), (1, "spreads", "", "home", -3.5, "keen", -110, at("2020-09-06 16:00"), 7),
    ]
    return spark.createDataFrame(base + list(more), QUOTE)


def market(spark, games, more=()):
    return {r.game_id: r.asDict() for r in features.game_market(quotes(spark, more), games, method="multiplicative").collect()}


def test_market_is_that_of_kickoff(spark, games):
    row = market(spark, games)[1]
    keen = 0.6 / (0.6 + 100 / 230)
    assert row["market_home_prob"] == pytest.approx(keen)  # the keen book has five sixths of the weight
    assert row["sharp_soft_delta"] == pytest.approx(0.0)
    assert row["line_move_spread"] == pytest.approx(-0.75) and row["book_dispersion"] == pytest.approx(0.5)


def test_quotes_and_readings_after_kickoff_change_nothing(spark, games):
    late = [(1, "h2h", "", "home", 0.0, "pinnacle", -900, at("2020-09-06 17:01"), 8), (1, "h2h", "", "away", 0.0, "pinnacle", 600, at("2020-09-06 17:01"), 9), (1, "spreads", "", "home", -9.0, "soft", -110, at("2020-09-06 18:00"), 10), (3, "h2h", "", "home", 0.0, "soft", 100, at("2020-09-06 17:01"), 11)]
    assert market(spark, games, late) == market(spark, games)
    schema = "reading_id long, game_id long, knowledge_time timestamp, temp_c double, wind_kph double, gust_kph double, precip_mm double"
    rows = [(1, 1, at("2020-09-06 10:00"), 10.0, 8.0, 9.0, 0.0), (2, 1, at("2020-09-06 15:30"), 12.0, 40.0, None, 1.0), (3, 1, at("2020-09-06 17:30"), 30.0, 0.0, 0.0, 0.0), (4, 3, at("2020-09-06 10:00"), 30.0, 0.0, 0.0, 0.0)]
    readings = spark.createDataFrame(rows, schema)
    assert [r.reading_id for r in features.weather_at_kickoff(readings, games).collect()] == [2]
    assert [r.reading_id for r in features.weather_at_kickoff(readings, games, 3.0).collect()] == [1]


RATINGS = "season int, week int, team string, play_class string, off_rating double, def_rating double, confident boolean"


def test_matrix_fills_defaults_and_keeps_its_width(spark, games):
    rated = spark.createDataFrame([(2020, 1, "A", "all", 0.2, 0.1, True), (2020, 1, "B", "all", 0.1, -0.1, True)], RATINGS)
    plain = features.training_matrix(games, rated)
    rows = {r.game_id: r.asDict() for r in plain.collect()}
    assert set(rows) == {1, 2, 3}  # 4 has no score, 5 no spread
    assert plain.columns[-len(features.NAMES) :] == features.NAMES
    assert rows[1]["market_home_prob"] == 0.5 and rows[1]["temp_c"] == 15.0 and rows[1]["home_rest"] == 7.0 and rows[1]["is_dome"] == 0.0
    assert rows[1]["net_edge"] == pytest.approx((0.2 + 0.1) - (0.1 - 0.1)) and rows[1]["ratings_confident"] == 1.0
    assert rows[1]["residual"] == 7.0 and rows[1]["home_cover"] == 1 and rows[1]["over"] == 0
    assert rows[2]["home_rest"] == 11.0 and rows[2]["kickoff_slot"] == 1.0 and rows[2]["residual"] == -0.5
    assert set(r.game_id for r in features.training_matrix(games, rated, require_market=False).collect()) == {1, 2, 3, 5}


def test_weather_under_a_roof_is_fixed(spark, games):
    rated = spark.createDataFrame([], RATINGS)
    readings = spark.createDataFrame([(1, 40.0, None, -3.0, 2.0), (2, 40.0, None, -3.0, 2.0)], "game_id long, wind_kph double, gust_kph double, temp_c double, precip_mm double")
    roofs = games.withColumn("roof", F.when(F.col("game_id") == 1, "Dome").when(F.col("game_id") == 2, "outdoors"))
    rows = {r.game_id: r for r in features.training_matrix(roofs, rated, weather=readings).collect()}
    assert (rows[1].is_dome, rows[1].wind_kph, rows[1].high_wind, rows[1].temp_c, rows[1].precip_mm) == (1.0, 0.0, 0.0, 21.0, 0.0)
    assert (rows[2].is_dome, rows[2].wind_kph, rows[2].high_wind, rows[2].temp_c, rows[2].precip_mm) == (0.0, 40.0, 1.0, -3.0, 2.0)
    assert (rows[3].wind_kph, rows[3].high_wind, rows[3].temp_c) == (0.0, 0.0, 15.0)


def test_features_known_too_late_are_named():
    assert features.validate_availability(1.0) == []
    spec = [features.Feature("a", 0.0), features.Feature("score_at_half", 0.0, "in_game"), features.Feature("inactives", 0.0, lag_hours=1.5)]
    assert [x.split(":")[0] for x in features.validate_availability(1.0, spec)] == ["score_at_half", "inactives"]
    assert [x.split(":")[0] for x in features.validate_availability(2.0, spec)] == ["score_at_half"]


def test_timing_checks_find_what_is_wrong(spark):
    rows = spark.createDataFrame([(1, 2020), (1, 2020), (2, None)], "game_id long, season int")
    got = {r.name: (r.value, r.passed) for r in validate.timing_checks(rows, ["x: in_game"], "game_id").collect()}
    assert got == {"late_features": (1.0, False), "rows_without_season": (1.0, False), "repeated_keys": (1.0, False)}
    assert all(r.passed for r in validate.timing_checks(rows.filter("game_id = 2").fillna(0), [], "game_id").collect())


def test_empty_schedule(spark, games):
    none = games.limit(0)
    rated = spark.createDataFrame([], RATINGS)
    assert features.training_matrix(none, rated, market=features.game_market(quotes(spark), none)).count() == 0
    assert features.sanity(features.training_matrix(none, rated)).count() == 5


def test_correlation_of_what_never_varies(spark):
    from linework.functions.stats import correlation

    rows = spark.createDataFrame([(1.0, 2.0, 3.0), (2.0, 4.0, 3.0), (3.0, 6.0, 3.0), (9.0, None, 3.0)], "x double, y double, k double")
    got = rows.agg(correlation("x", "y").alias("xy"), correlation("x", "k").alias("xk")).first()
    assert got.xy == pytest.approx(1.0) and got.xk is None


def test_market_equals_the_general_consensus(spark, games):
    from linework.operators.consensus import fair_prices
    from linework.operators.grading import closing_quotes

    more = [
        (1, "h2h", "", "home", 0.0, "soft", 105, at("2020-09-05 12:00"), 3), (1, "h2h", "", "away", 0.0, "soft", -120, at("2020-09-05 13:00"), 1),  # the higher price of one time and seq; a later one
        (1, "h2h", "", "home", 0.0, "broken", -5000, at("2020-09-05 12:00"), 5), (1, "h2h", "", "away", 0.0, "broken", -5000, at("2020-09-05 12:00"), 6),
        (1, "h2h", "", "home", 0.0, "alone", 100, at("2020-09-05 12:00"), 7), (1, "h2h", "someone", "home", 0.0, "pinnacle", 900, at("2020-09-06 12:00"), 9),
        (2, "h2h", "", "home", 0.0, "alone", 100, at("2020-09-05 12:00"), 7), (4, "spreads", "", "home", -1.0, "soft", 100, at("2020-09-05 12:00"), 7),
    ]
    rows = quotes(spark, more)
    money = closing_quotes(rows.filter("market_type = 'h2h'"), games)
    for method in ("multiplicative", "power", "shin"):
        fair = {r.game_id: r for r in fair_prices(money, sharp=("pinnacle",), method=method).filter("side = 'home' and player_id = ''").collect()}
        got = {r.game_id: r for r in features.game_market(rows, games, method=method).collect()}
        assert set(fair) == {1} and set(got) == {1, 4}
        assert got[1].market_home_prob == pytest.approx(fair[1].fair_prob) and got[1].sharp_soft_delta == pytest.approx(fair[1].sharp_prob - fair[1].fair_prob)
        assert got[4].market_home_prob is None and got[4].book_dispersion == 0.0


def test_quotes_are_shuffled_once_and_plays_read_once(spark, games, small, capsys):
    from linework.operators import ratings
    from linework.sources.fixtures import view

    features.game_market(view(spark, small, "fx_quote_obs"), games).explain()
    market = capsys.readouterr().out
    assert market.count("FileScan parquet") == 1
    ratings.decayed_sums(view(spark, small, "fx_plays")).explain()
    plays = capsys.readouterr().out
    assert plays.count("FileScan parquet") == 1 and "isnotnull(concat" not in plays


def test_cells_of_unknown_units_or_seasons_count_for_nothing(spark):
    from linework.operators import ratings

    rows = [(2020, 1, "A", "B", "pass", 1.0), (2020, 1, "A", "B", "rush", 3.0), (2020, 2, "B", "A", "pass", 1.0), (2020, 5, None, "A", "pass", 1.0), (2020, 1, "A", None, "pass", 9.0), (None, 1, "A", "B", "pass", 9.0), (None, 2, "A", "B", "pass", 9.0)]
    got = ratings.decayed_sums(spark.createDataFrame(rows, "season int, week int, offense string, defense string, play_class string, epa double"), 0.5)
    assert sorted((r.season, r.cutoff, r.play_class, r.offense, r.defense, r.w, r.w_epa, r.n) for r in got.collect()) == [
        (2020, 2, "all", "A", "B", 1.0, 2.0, 2), (2020, 2, "pass", "A", "B", 0.5, 0.5, 1), (2020, 2, "rush", "A", "B", 0.5, 1.5, 1)]
