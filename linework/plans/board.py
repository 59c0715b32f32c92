"""Registered queries of the board, users' bets and the training matrix."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import markets, names
from ..operators import board, features, grading, quotes, ratings, warehouse
from ..sources.fixtures import view, with_views
from .market import AS_OF, CHANGES, DECIMAL, GRADED, r

QUERIES, ORACLES = {}, {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = with_views(oracle)
        return f

    return add


@query("SELECT pick_id, CASE market_type WHEN 'h2h' THEN 'Moneyline' WHEN 'spreads' THEN 'Spread' ELSE 'Total' END AS label, 'game' AS bet_class, 'full' AS period, true AS two_sided, CASE market_type WHEN 'h2h' THEN 'all,moneyline' WHEN 'spreads' THEN 'all,spread' ELSE 'all,total' END AS groups FROM fx_picks")
def described_markets(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("market_type")
    return view(spark, d, "fx_picks").withColumn("m", markets.describe(k)).select("pick_id", "m.label", "m.bet_class", "m.period", "m.two_sided", F.concat_ws(",", markets.filter_groups(k)).alias("groups"))


@query("""SELECT pick_id, CASE WHEN market_type = 'h2h' THEN (CASE side WHEN 'home' THEN home_team ELSE away_team END) || ' to win' WHEN market_type = 'spreads' THEN (CASE side WHEN 'home' THEN home_team ELSE away_team END) || ' ' || CASE WHEN line > 0 THEN '+' || CAST(line AS INT)::VARCHAR WHEN line < 0 THEN CAST(line AS INT)::VARCHAR ELSE 'PK' END ELSE CASE side WHEN 'over' THEN 'Over ' ELSE 'Under ' END || CAST(line AS INT)::VARCHAR END AS label,
 CASE WHEN price > 0 THEN '+' || price::VARCHAR ELSE price::VARCHAR END AS price_text FROM fx_picks JOIN fx_games USING (game_id)""")
def bet_labels(spark: SparkSession, d: str) -> DataFrame:
    rows = view(spark, d, "fx_picks").join(view(spark, d, "fx_games").select("game_id", "home_team", "away_team"), "game_id")
    label = names.side_label(F.col("market_type"), F.col("side"), F.col("line"), F.col("home_team"), F.col("away_team"))
    return rows.select("pick_id", label.alias("label"), names.price_text(F.col("price")).alias("price_text"))


@query(f"SELECT game_id, season, week FROM fx_games WHERE kickoff_utc > TIMESTAMP '{AS_OF}' AND epoch(kickoff_utc - TIMESTAMP '{AS_OF}') / 3600.0 <= 72")
def games_in_window(spark: SparkSession, d: str) -> DataFrame:
    return board.games_in_window(view(spark, d, "fx_games"), AS_OF).select("game_id", "season", "week")


@query(f"SELECT season, week FROM (SELECT *, row_number() OVER (PARTITION BY season ORDER BY kickoff_utc, game_id) AS rn FROM fx_games WHERE kickoff_utc > TIMESTAMP '{AS_OF}') WHERE rn = 1")
def current_week(spark: SparkSession, d: str) -> DataFrame:
    return board.current_week(view(spark, d, "fx_games"), AS_OF)


@query(f"""WITH rq AS (SELECT bet_id AS request_id, user_id, pick_id, price, stake FROM fx_bets UNION ALL SELECT bet_id + 1000000000000, user_id, CASE WHEN bet_id % 3 = 0 THEN -1 ELSE pick_id END, NULL, NULL FROM fx_bets),
f AS (SELECT user_id, pick_id, min(request_id) AS first_id FROM rq GROUP BY ALL), had AS (SELECT DISTINCT user_id, pick_id FROM fx_bets WHERE stake = 2.0)
SELECT request_id, coalesce(rq.price, p.price) AS price, coalesce(rq.stake, p.stake) AS stake, CASE WHEN p.price IS NULL THEN 'no_pick' WHEN g.kickoff_utc <= TIMESTAMP '{AS_OF}' THEN 'started' WHEN had.user_id IS NOT NULL OR request_id <> first_id THEN 'duplicate' ELSE 'ok' END AS reason
FROM rq LEFT JOIN fx_picks p USING (pick_id) LEFT JOIN fx_games g ON g.game_id = p.game_id LEFT JOIN had ON had.user_id = rq.user_id AND had.pick_id = rq.pick_id JOIN f ON f.user_id = rq.user_id AND f.pick_id = rq.pick_id""")
def accepted_bets(spark: SparkSession, d: str) -> DataFrame:
    bets = view(spark, d, "fx_bets")
    asked = bets.select(F.col("bet_id").alias("request_id"), "user_id", "pick_id", "price", "stake")
    again = bets.select((F.col("bet_id") + 10**12).alias("request_id"), "user_id", F.when(F.col("bet_id") % 3 == 0, F.lit(-1)).otherwise(F.col("pick_id")).cast("long").alias("pick_id"), F.lit(None).cast("int").alias("price"), F.lit(None).cast("double").alias("stake"))
    out = board.accept_bets(asked.unionByName(again), view(spark, d, "fx_picks"), view(spark, d, "fx_games"), bets.filter("stake = 2.0"), AS_OF)
    return out.select("request_id", "price", "stake", "reason")


USER = f"ub AS (SELECT b.*, result, game_id, CASE result WHEN 'win' THEN b.stake * (({DECIMAL.format('b.price')}) - 1.0) WHEN 'loss' THEN -b.stake ELSE 0.0 END AS user_profit FROM fx_bets b JOIN (SELECT pick_id, result, game_id FROM graded) g USING (pick_id))"


def _user_bets(spark: SparkSession, d: str) -> DataFrame:
    graded = grading.grade_picks(view(spark, d, "fx_picks"), view(spark, d, "fx_games"))
    return board.grade_user_bets(view(spark, d, "fx_bets"), graded)


@query(f"WITH {GRADED}, {USER} SELECT bet_id, result, round(user_profit, 6) AS profit FROM ub")
def graded_user_bets(spark: SparkSession, d: str) -> DataFrame:
    return _user_bets(spark, d).select("bet_id", "result", r("profit"))


@query(f"WITH {GRADED}, {USER} SELECT user_id, count(*) AS bets, round(sum(stake), 4) AS staked, round(sum(user_profit), 4) AS profit, CAST(sum(CASE WHEN result = 'win' THEN 1 ELSE 0 END) AS BIGINT) AS wins FROM ub GROUP BY user_id")
def user_history(spark: SparkSession, d: str) -> DataFrame:
    return board.user_history(_user_bets(spark, d)).select("user_id", "bets", r("staked", 4), r("profit", 4), "wins")


@query(f"WITH {GRADED}, {USER} SELECT bet_id, result FROM ub JOIN fx_games g USING (game_id) WHERE epoch(TIMESTAMP '{AS_OF}' - g.kickoff_utc) / 3600.0 BETWEEN 0 AND 240")
def settled_recent(spark: SparkSession, d: str) -> DataFrame:
    return board.settled_recent(_user_bets(spark, d), view(spark, d, "fx_games"), AS_OF, 240.0).select("bet_id", "result")


@query("SELECT p.pick_id, home_team, away_team, EXISTS (SELECT 1 FROM fx_bets b WHERE b.pick_id = p.pick_id AND b.user_id = 'u7') AS mine FROM fx_picks p LEFT JOIN fx_games USING (game_id)")
def slate_view(spark: SparkSession, d: str) -> DataFrame:
    return board.slate_view(view(spark, d, "fx_picks"), view(spark, d, "fx_games"), view(spark, d, "fx_bets"), "u7").select("pick_id", "home_team", "away_team", "mine")


@query(f"""WITH {CHANGES}, b AS (SELECT c.game_id, book, arg_min(line, observed_at::VARCHAR || lpad(seq::VARCHAR, 12, '0')) AS o, arg_max(line, observed_at::VARCHAR || lpad(seq::VARCHAR, 12, '0')) AS c FROM chg c JOIN fx_games g ON g.game_id = c.game_id WHERE market_type = 'spreads' AND side = 'home' AND observed_at <= g.kickoff_utc GROUP BY ALL)
SELECT game_id, round(avg(c - o), 6) AS line_move_spread, round(stddev_pop(c), 6) AS book_dispersion, count(*) AS books FROM b GROUP BY game_id""")
def market_features(spark: SparkSession, d: str) -> DataFrame:
    changes = quotes.price_changes(view(spark, d, "fx_quote_obs"))
    return features.market_features(changes, view(spark, d, "fx_games")).select("game_id", r("line_move_spread"), r("book_dispersion"), "books")


@query()
def training_matrix(spark: SparkSession, d: str) -> DataFrame:
    games = view(spark, d, "fx_games").withColumn("season", F.col("season").cast("int")).withColumn("week", F.col("week").cast("int"))
    matrix = features.training_matrix(games, ratings.unit_ratings(warehouse.plays(view(spark, d, "fx_plays"))))
    return matrix.select("game_id", "season", "margin", "residual", "home_cover", "total_residual", "over", *[r(c) for c in features.NAMES])
