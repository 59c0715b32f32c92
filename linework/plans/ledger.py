"""Registered queries of open bets, of the history row by row, and of projections that agree with totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import grading, ledger, reconcile
from ..sources.fixtures import view, with_views
from .market import DECIMAL, GRADED, r

QUERIES, ORACLES = {}, {}


def query(oracle: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, with_views(oracle)
        return f

    return add


PICKED = """pk AS (SELECT pick_id, game_id, CASE WHEN pick_id % 7 = 0 THEN 'player_receptions' WHEN pick_id % 31 = 0 THEN 'team_yards' ELSE market_type END AS market_type, CASE WHEN pick_id % 7 = 0 THEN concat('P', pick_id % 900) ELSE '' END AS player_id, CASE WHEN pick_id % 7 <> 0 THEN side WHEN pick_id % 2 = 0 THEN 'over' ELSE 'under' END AS side, CASE WHEN pick_id % 7 = 0 THEN 4.5::DOUBLE ELSE line END AS line, tier FROM fx_picks),
lv AS (SELECT game_id, CAST(floor(home_score / 2) AS INT) AS hs, CAST(floor(away_score / 2) AS INT) AS aws, CASE WHEN game_id % 5 = 0 THEN 'post' ELSE 'in' END AS state FROM fx_games WHERE game_id % 3 <> 0),
st AS (SELECT game_id, player_id, market_type, max(CAST(pick_id % 9 AS DOUBLE)) AS value FROM pk WHERE pick_id % 14 = 0 GROUP BY 1, 2, 3),
ob AS (SELECT b.bet_id, b.user_id, b.stake, p.*, hs, aws, state, value, CASE WHEN side = 'home' THEN hs - aws ELSE aws - hs END AS m FROM fx_bets b JOIN pk p USING (pick_id) JOIN fx_games g USING (game_id) LEFT JOIN lv USING (game_id) LEFT JOIN st USING (game_id, player_id, market_type) WHERE b.bet_id % 2 = 0),
cu AS (SELECT *, CASE WHEN hs IS NULL THEN NULL WHEN market_type = 'player_receptions' THEN CASE WHEN side = 'over' THEN value - line ELSE line - value END WHEN market_type = 'h2h' THEN m WHEN market_type = 'spreads' THEN m + line WHEN market_type = 'totals' THEN CASE WHEN side = 'over' THEN hs + aws - line ELSE line - hs - aws END END AS cushion FROM ob),
sb AS (SELECT *, CASE WHEN hs IS NULL THEN 'pending' WHEN cushion IS NULL THEN 'unknown' WHEN cushion > 0 THEN 'winning' WHEN cushion < 0 THEN 'losing' ELSE 'tied' END AS status, coalesce(state = 'in', false) AS live FROM cu)"""
G = "CASE WHEN {0} = floor({0}) THEN CAST(CAST({0} AS BIGINT) AS VARCHAR) ELSE CAST(round({0}, 4) AS VARCHAR) END"


def _open(spark: SparkSession, d: str) -> DataFrame:
    prop = F.col("pick_id") % 7 == 0
    picks = view(spark, d, "fx_picks").withColumns({
        "player_id": F.when(prop, F.concat(F.lit("P"), (F.col("pick_id") % 900).cast("string"))).otherwise(""), "side": F.when(~prop, F.col("side")).when(F.col("pick_id") % 2 == 0, "over").otherwise("under"),
        "line": F.when(prop, F.lit(4.5)).otherwise(F.col("line")), "market_type": F.when(prop, "player_receptions").when(F.col("pick_id") % 31 == 0, "team_yards").otherwise(F.col("market_type")),
    })
    games = view(spark, d, "fx_games")
    live = games.filter("game_id % 3 <> 0").select("game_id", F.floor(F.col("home_score") / 2).cast("int").alias("home_score"), F.floor(F.col("away_score") / 2).cast("int").alias("away_score"), F.lit(2).alias("period"), F.when(F.col("game_id") % 5 == 0, "post").otherwise("in").alias("state"))
    stats = picks.filter("pick_id % 14 = 0").groupBy("game_id", "player_id", F.col("market_type").alias("stat_key")).agg(F.max((F.col("pick_id") % 9).cast("double")).alias("value"))
    bets = view(spark, d, "fx_bets").withColumn("result", F.when(F.col("bet_id") % 2 == 0, "pending").otherwise("win")).withColumn("book", F.lit("dk"))
    return ledger.open_bets(bets, picks, games, live, stats)


@query(f"""WITH {PICKED} SELECT bet_id, user_id, game_id, market_type, status, round(cushion, 1) AS cushion, live, CASE WHEN hs IS NULL THEN 'not started' WHEN market_type = 'player_receptions' AND value IS NULL THEN 'stat unavailable' WHEN market_type = 'player_receptions' THEN concat({G.format('value')}, ' of ', {G.format('line')})
  WHEN market_type = 'h2h' THEN concat(CASE WHEN m > 0 THEN 'up' WHEN m < 0 THEN 'down' ELSE 'tied' END, ' ', abs(m)) WHEN market_type = 'spreads' THEN CASE WHEN cushion > 0 THEN concat('covering by ', {G.format('cushion')}) ELSE concat('needs ', {G.format('abs(cushion)')}) END WHEN market_type = 'totals' THEN concat(hs + aws, ' of ', {G.format('line')}) ELSE '' END AS note FROM sb""")
def open_bets(spark: SparkSession, d: str) -> DataFrame:
    return _open(spark, d).select("bet_id", "user_id", "game_id", "market_type", "status", "cushion", "live", "note")


@query(f"WITH {PICKED} SELECT user_id, count(*) AS bets, count(*) FILTER (live) AS live, count(*) FILTER (status = 'winning') AS winning, round(sum(stake), 4) AS at_risk FROM sb GROUP BY 1")
def open_bets_by_user(spark: SparkSession, d: str) -> DataFrame:
    return ledger.open_summary(_open(spark, d)).select("user_id", "bets", "live", "winning", r("at_risk", 4))


def _graded(spark: SparkSession, d: str) -> DataFrame:
    named = view(spark, d, "fx_picks").withColumn("player_id", F.when(F.col("market_type") == "totals", F.concat(F.lit("P"), (F.col("pick_id") % 2000).cast("string"))))
    return grading.grade_picks(named, view(spark, d, "fx_games")).drop("home_score", "away_score")


NAMED = GRADED + """, who AS (SELECT g.*, CASE WHEN market_type = 'totals' THEN concat('P', pick_id % 2000) END AS player_id FROM graded g WHERE coalesce(demo, 0) = 0), named AS (SELECT w.*, pl.player_name, gm.season, gm.week, gm.home_team, gm.away_team FROM who w JOIN fx_games gm USING (game_id) LEFT JOIN fx_players pl ON pl.player_id = w.player_id)"""


@query(f"WITH {NAMED} SELECT pick_id, season, week, home_team, away_team, player_name, result, round(profit, 6) AS payout FROM named")
def history_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = ledger.history_rows(_graded(spark, d), view(spark, d, "fx_games"), view(spark, d, "fx_players"))
    return rows.select("pick_id", "season", "week", "home_team", "away_team", "player_name", "result", r("payout"))


@query(f"WITH {NAMED} SELECT bet_id, user_id, pick_id, season, week, player_name, result, round(CASE result WHEN 'win' THEN b.stake * (({DECIMAL.format('b.price')}) - 1.0) WHEN 'loss' THEN -b.stake ELSE 0.0 END, 6) AS payout, b.price - n.price AS slippage_cents FROM fx_bets b JOIN named n USING (pick_id)")
def user_history_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = ledger.user_history_rows(view(spark, d, "fx_bets"), _graded(spark, d), view(spark, d, "fx_games"), view(spark, d, "fx_players"))
    return rows.select("bet_id", "user_id", "pick_id", "season", "week", "player_name", "result", r("payout"), "slippage_cents")


def _reconciled(spark: SparkSession, d: str) -> DataFrame:
    plays = view(spark, d, "fx_plays")
    cells = plays.groupBy("game_id", "player_id", "play_class").agg(F.sum(1.0 + F.col("yardline_100") % 5).alias("value"))
    rows = plays.groupBy("game_id", "player_id").agg(F.count(F.lit(1)).cast("double").alias("total"))
    columns = plays.groupBy("game_id", "play_class").agg(F.count(F.lit(1)).cast("double").alias("total"))
    return reconcile.reconcile(cells, rows, columns, by="game_id", row="player_id", column="play_class", tolerance=1e-7, most=2000)


@query("SELECT game_id, play_class, CAST(count(*) AS DOUBLE) AS total FROM fx_plays GROUP BY 1, 2")
def reconciled_classes(spark: SparkSession, d: str) -> DataFrame:
    """What players' adjusted numbers sum to by class: the totals that they were to meet."""
    return _reconciled(spark, d).groupBy("game_id", "play_class").agg(F.round(F.sum("adjusted"), 4).alias("total"))


@query("SELECT game_id, player_id, CAST(count(*) AS DOUBLE) AS total FROM fx_plays GROUP BY 1, 2")
def reconciled_players(spark: SparkSession, d: str) -> DataFrame:
    return _reconciled(spark, d).groupBy("game_id", "player_id").agg(F.round(F.sum("adjusted"), 4).alias("total"))
