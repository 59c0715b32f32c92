"""Bets and picks row by row: where open ones stand now, and what became of the others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import odds
from ..functions.markets import describe
from .grading import SETTLED

STANDING = "struct<status:string,cushion:double,note:string>"


def spoken(x: Column) -> Column:
    """A number as people write it: 3, not 3.0; at most four decimals."""
    return F.when(x == F.floor(x), F.floor(x).cast("string")).otherwise(F.round(x, 4).cast("string"))


def standing(market: Column, side: Column, line: Column, home: Column, away: Column, value: Column) -> Column:
    """struct<status, cushion, note> of an open bet at the present score (``value`` is the player's, for props).

    The cushion is by how much the bet is ahead; a null line counts as 0. Before the start the status is
    pending, without the player's number or for a market that scores say nothing of it is unknown.
    """
    line = F.coalesce(line, F.lit(0.0))
    margin = (home - away).cast("double") * F.when(side == "home", 1).otherwise(-1)
    total = (home + away).cast("double")
    ahead = lambda x: F.when(side == "over", x - line).otherwise(line - x)
    made = lambda status, cushion, note: F.struct(status.alias("status"), cushion.cast("double").alias("cushion"), note.alias("note")).cast(STANDING)

    def stands(cushion: Column, note: Column) -> Column:
        return made(F.when(cushion > 0, "winning").when(cushion < 0, "losing").otherwise("tied"), F.round(cushion, 1), note)

    nothing = F.lit(None).cast("double")
    lead = F.concat(F.when(margin > 0, "up").when(margin < 0, "down").otherwise("tied"), F.lit(" "), spoken(F.abs(margin)))
    cover = margin + line
    covers = F.when(cover > 0, F.concat(F.lit("covering by "), spoken(cover))).otherwise(F.concat(F.lit("needs "), spoken(F.abs(cover))))
    of = lambda x: F.concat(spoken(x), F.lit(" of "), spoken(line))
    prop = describe(market)["bet_class"] == "prop"
    return (
        F.when(home.isNull() | away.isNull(), made(F.lit("pending"), nothing, F.lit("not started")))
        .when(prop & value.isNull(), made(F.lit("unknown"), nothing, F.lit("stat unavailable")))
        .when(prop, stands(ahead(value), of(value)))
        .when(market.startswith("h2h"), stands(margin, lead))
        .when(market.contains("spreads"), stands(cover, covers))
        .when(market.contains("totals"), stands(ahead(total), of(total)))
        .otherwise(made(F.lit("unknown"), nothing, F.lit("")))
    )


def open_bets(bets: DataFrame, picks: DataFrame, games: DataFrame, live: DataFrame, stats: DataFrame) -> DataFrame:
    """Every pending bet with its game, the score and where it stands: ``status``, ``cushion``, ``note``, ``live``.

    ``live`` has a row for each game that has begun, ``stats`` is (game_id, player_id, stat_key, value).
    Bets of unknown picks or games have no row; ``live`` is whether the game is being played.
    """
    own = bets.filter("result = 'pending'").select("bet_id", "user_id", "pick_id", "book", F.col("price").alias("own_price"), F.col("stake").alias("own_stake"))
    rows = own.join(picks.select("pick_id", "game_id", "market_type", "player_id", "side", "line", "tier"), "pick_id")
    rows = rows.join(games.select("game_id", "home_team", "away_team", "kickoff_utc"), "game_id").join(live.select("game_id", "home_score", "away_score", "period", "state"), "game_id", "left")
    rows = rows.join(stats.select("game_id", "player_id", F.col("stat_key").alias("market_type"), F.col("value").alias("_value")), ["game_id", "player_id", "market_type"], "left")
    now = standing(F.col("market_type"), F.col("side"), F.col("line"), F.col("home_score"), F.col("away_score"), F.col("_value"))
    return rows.withColumn("_s", now).select("*", "_s.*", F.coalesce(F.col("state") == "in", F.lit(False)).alias("live")).drop("_s", "_value")


def open_summary(rows: DataFrame) -> DataFrame:
    """(user_id, bets, live, winning, at_risk) of open bets."""
    return rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("bets"), F.count_if("live").alias("live"), F.count_if(F.col("status") == "winning").alias("winning"), F.coalesce(F.sum("own_stake"), F.lit(0.0)).alias("at_risk"))


def _with_game(rows: DataFrame, games: DataFrame, players: DataFrame) -> DataFrame:
    named = players.select("player_id", "player_name").dropDuplicates(["player_id"])
    return rows.join(games.select("game_id", "season", "week", "home_team", "away_team", "kickoff_utc", "home_score", "away_score"), "game_id").join(named, "player_id", "left")


def _real(rows: DataFrame, include_demo: bool) -> DataFrame:
    return rows if include_demo else rows.filter(F.coalesce("demo", F.lit(0)) == 0)


def history_rows(graded: DataFrame, games: DataFrame, players: DataFrame, *, include_demo: bool = False) -> DataFrame:
    """Every pick with its game, the player's name where there is one, and ``payout`` (0 until settled).

    ``graded`` has pick_id, game_id, player_id, price, stake, result and demo (null counts as 0).
    """
    rows = _with_game(_real(graded, include_demo), games, players)
    return rows.withColumn("payout", F.when(F.col("result").isin(*SETTLED), odds.payout(F.col("result"), F.coalesce("stake", F.lit(0.0)), F.col("price"))).otherwise(0.0))


def user_history_rows(bets: DataFrame, graded: DataFrame, games: DataFrame, players: DataFrame, *, include_demo: bool = False) -> DataFrame:
    """Every bet of users at their own price, with its pick, game, player, payout and ``slippage_cents``: own less the pick's price."""
    kept = [c for c in ("pick_id", "game_id", "player_id", "market_type", "side", "line", "tier", "result", "demo") if c in graded.columns]
    own = bets.select("bet_id", "user_id", "pick_id", F.col("price").alias("own_price"), F.col("stake").alias("own_stake"))
    rows = _with_game(_real(own.join(graded.select(*kept, F.col("price").alias("pick_price")), "pick_id"), include_demo), games, players)
    paid = F.when(F.col("result").isin(*SETTLED), odds.payout(F.col("result"), F.coalesce("own_stake", F.lit(0.0)), F.col("own_price"))).otherwise(0.0)
    return rows.withColumn("payout", paid).withColumn("slippage_cents", F.col("own_price") - F.col("pick_price"))
