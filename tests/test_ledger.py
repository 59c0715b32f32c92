"""Open bets and history rows on hand-made cases."""

from datetime import datetime as t

from pyspark.sql import functions as F

from linework.operators import ledger


def test_where_open_bets_stand(spark):
    cases = [  # market, side, line, home, away, value -> status, cushion, note
        ("h2h", "home", 0.0, 21, 14, None, "winning", 7.0, "up 7"), ("h2h", "away", 0.0, 21, 14, None, "losing", -7.0, "down 7"), ("h2h_h1", "away", None, 3, 3, None, "tied", 0.0, "tied 0"),
        ("spreads", "home", -3.5, 24, 21, None, "losing", -0.5, "needs 0.5"), ("spreads", "away", 3.5, 24, 21, None, "winning", 0.5, "covering by 0.5"), ("alternate_spreads", "home", -7.0, 24, 17, None, "tied", 0.0, "needs 0"),
        ("totals", "over", 40.5, 24, 17, None, "winning", 0.5, "41 of 40.5"), ("totals", "under", 44.0, 24, 17, None, "winning", 3.0, "41 of 44"),
        ("player_receptions", "over", 4.5, 24, 17, 3.0, "losing", -1.5, "3 of 4.5"), ("player_receptions", "under", 4.5, 24, 17, 3.0, "winning", 1.5, "3 of 4.5"), ("player_receptions", "over", 4.5, 24, 17, None, "unknown", None, "stat unavailable"),
        ("spreads", "home", -3.5, None, None, None, "pending", None, "not started"), ("coin_toss", "home", 0.0, 1, 0, None, "unknown", None, ""),
    ]
    df = spark.createDataFrame([(k, *c[:6]) for k, c in enumerate(cases)], "k int, market string, side string, line double, home int, away int, value double")
    got = df.select("k", ledger.standing(*[F.col(c) for c in ("market", "side", "line", "home", "away", "value")]).alias("s")).orderBy("k").select("s.*").collect()
    assert [tuple(r) for r in got] == [c[6:] for c in cases]


def test_open_bets_keep_bets_of_games_that_have_not_begun(spark):
    bets = spark.createDataFrame([(1, "u", 1, "dk", 100, 2.0, "pending"), (2, "u", 2, "dk", 100, 3.0, "pending"), (3, "u", 1, "dk", 100, 1.0, "win"), (4, "v", 9, "dk", 100, 1.0, "pending")], "bet_id int, user_id string, pick_id int, book string, price int, stake double, result string")
    picks = spark.createDataFrame([(1, 7, "h2h", "", "home", 0.0, "A"), (2, 8, "totals", "", "over", 40.0, "B")], "pick_id int, game_id int, market_type string, player_id string, side string, line double, tier string")
    games = spark.createDataFrame([(7, "KC", "BUF", t(2024, 1, 1)), (8, "NE", "NYJ", t(2024, 1, 2))], "game_id int, home_team string, away_team string, kickoff_utc timestamp")
    live = spark.createDataFrame([(7, 10, 3, 2, "in")], "game_id int, home_score int, away_score int, period int, state string")
    stats = spark.createDataFrame([], "game_id int, player_id string, stat_key string, value double")
    rows = ledger.open_bets(bets, picks, games, live, stats)
    assert {r.bet_id: (r.status, r.live, r.note, r.home_team) for r in rows.collect()} == {1: ("winning", True, "up 7", "KC"), 2: ("pending", False, "not started", "NE")}
    assert [tuple(r) for r in ledger.open_summary(rows).collect()] == [("u", 2, 1, 1, 5.0)]


def test_history_leaves_demo_rows_out_and_keeps_unnamed_players(spark):
    graded = spark.createDataFrame([(1, 7, "p1", 100, 2.0, "win", 0), (2, 7, "", -110, None, "loss", None), (3, 7, "p9", 100, 1.0, "pending", 0), (4, 7, "p1", 100, 5.0, "win", 1)], "pick_id int, game_id int, player_id string, price int, stake double, result string, demo int")
    games = spark.createDataFrame([(7, 2024, 3, "KC", "BUF", t(2024, 1, 1), 21, 14)], "game_id int, season int, week int, home_team string, away_team string, kickoff_utc timestamp, home_score int, away_score int")
    players = spark.createDataFrame([("p1", "Ann Onymous"), ("p1", "Ann Onymous")], "player_id string, player_name string")
    got = {r.pick_id: (r.player_name, r.payout) for r in ledger.history_rows(graded, games, players).collect()}
    assert got == {1: ("Ann Onymous", 2.0), 2: (None, 0.0), 3: (None, 0.0)}
    assert ledger.history_rows(graded, games, players, include_demo=True).count() == 4
    bets = spark.createDataFrame([(1, "u", 1, 120, 1.0), (2, "u", 2, -120, 1.0)], "bet_id int, user_id string, pick_id int, price int, stake double")
    own = {r.bet_id: (r.payout, r.slippage_cents) for r in ledger.user_history_rows(bets, graded, games, players).collect()}
    assert {k: (round(v[0], 9), v[1]) for k, v in own.items()} == {1: (1.2, 20), 2: (-1.0, -10)}
