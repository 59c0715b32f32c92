"""The board and the book of users: windows of games, accepted bets, history, settlement."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import odds
from .shop import upcoming

ZONE = "America/New_York"


def games_in_window(games: DataFrame, as_of: str, hours: float = 72.0) -> DataFrame:
    """Games with a kickoff after ``as_of`` and within so many hours."""
    now = F.lit(as_of).cast("timestamp")
    ahead = (F.unix_timestamp("kickoff_utc") - F.unix_timestamp(now)) / 3600.0
    return games.filter((F.col("kickoff_utc") > now) & (ahead <= hours))


def games_today(games: DataFrame, as_of: str, zone: str = ZONE) -> DataFrame:
    """Games not started on the local day of ``as_of``; a late kickoff is still today's."""
    now = F.lit(as_of).cast("timestamp")
    day = lambda t: F.from_utc_timestamp(t, zone).cast("date")
    return games.filter((F.col("kickoff_utc") > now) & (day(F.col("kickoff_utc")) == day(now)))


def current_week(games: DataFrame, as_of: str) -> DataFrame:
    """(season, week) of the earliest game not played yet, for each season."""
    left = games.filter(F.col("kickoff_utc") > F.lit(as_of).cast("timestamp"))
    return left.groupBy("season").agg(F.min_by("week", F.struct("kickoff_utc", "game_id")).alias("week"))


def accept_bets(requests: DataFrame, picks: DataFrame, games: DataFrame, bets: DataFrame, as_of: str) -> DataFrame:
    """Requests (request_id, user_id, pick_id, book, price, stake) with ``reason``: ok or why not.

    Price and stake default to the pick's. Of several requests of a user for a pick the first counts.
    """
    known = picks.select("pick_id", "game_id", F.col("price").alias("_price"), F.col("stake").alias("_stake"))
    started = games.filter(F.col("kickoff_utc") <= F.lit(as_of).cast("timestamp")).select("game_id", F.lit(True).alias("_started"))
    had = bets.select("user_id", "pick_id", F.lit(True).alias("_had")).distinct()
    first = requests.groupBy("user_id", "pick_id").agg(F.min("request_id").alias("_first"))
    met = requests.join(known, "pick_id", "left").join(started, "game_id", "left").join(had, ["user_id", "pick_id"], "left").join(first, ["user_id", "pick_id"])
    reason = F.when(F.col("_price").isNull(), "no_pick").when(F.col("_started"), "started").when(F.col("_had") | (F.col("request_id") != F.col("_first")), "duplicate").otherwise("ok")
    return met.withColumn("reason", reason).withColumn("price", F.coalesce("price", "_price")).withColumn("stake", F.coalesce("stake", "_stake")).select(*requests.columns, "game_id", "reason")


def grade_user_bets(bets: DataFrame, graded: DataFrame) -> DataFrame:
    """Bets with the result of their pick, paid at the user's own price."""
    rows = bets.join(graded.select("pick_id", "game_id", "result"), "pick_id")
    return rows.withColumn("profit", odds.payout(F.col("result"), F.col("stake"), F.col("price")))


def settled_recent(graded_bets: DataFrame, games: DataFrame, as_of: str, hours: float = 24.0) -> DataFrame:
    """Settled bets whose game began in the last hours before ``as_of``, newest first."""
    now = F.lit(as_of).cast("timestamp")
    age = (F.unix_timestamp(now) - F.unix_timestamp("kickoff_utc")) / 3600.0
    rows = graded_bets.filter(F.col("result") != "pending").join(games.select("game_id", "kickoff_utc"), "game_id")
    return rows.filter(age.between(0.0, hours)).orderBy(F.desc("kickoff_utc"), "bet_id")


def user_history(graded_bets: DataFrame) -> DataFrame:
    """Bets, stake and profit of each user."""
    return graded_bets.groupBy("user_id").agg(F.count(F.lit(1)).alias("bets"), F.sum("stake").alias("staked"), F.sum("profit").alias("profit"), F.sum((F.col("result") == "win").cast("long")).alias("wins"))


def slate_view(picks: DataFrame, games: DataFrame, bets: DataFrame, user_id: str) -> DataFrame:
    """Picks with their teams and whether the user has bet them."""
    mine = bets.filter(F.col("user_id") == user_id).select("pick_id", F.lit(True).alias("mine")).distinct()
    rows = picks.join(games.select("game_id", "home_team", "away_team", "kickoff_utc"), "game_id", "left").join(mine, "pick_id", "left")
    return rows.withColumn("mine", F.coalesce("mine", F.lit(False)))


def order_board(rows: DataFrame, key: str) -> DataFrame:
    """By probability, edge or kickoff (unknown last); withdrawn picks last of all."""
    by = {"probability": F.desc_nulls_last("fair_prob"), "edge": F.desc_nulls_last("edge_pct"), "kickoff": F.asc_nulls_last("kickoff_utc")}[key]
    return rows.orderBy(F.desc("published"), by, "pick_id")


def by_severity(reports: DataFrame, n: int = 25) -> DataFrame:
    """The ``n`` gravest reports: Out, Doubtful, Questionable, then others, by player and report."""
    status = F.col("report_status")
    rank = F.when(status == "Out", 0).when(status == "Doubtful", 1).when(status == "Questionable", 2).otherwise(3)
    return reports.withColumn("severity", rank).orderBy("severity", "player_id", "report_id").limit(n)


def review_candidates(picks: DataFrame, games: DataFrame, as_of: str, n: int = 60) -> DataFrame:
    """The ``n`` pending picks of most edge that no review stopped and whose game has not started."""
    open_ = picks.filter((F.col("result") == "pending") & (F.coalesce("verdict", F.lit("")).isin("OK", "")))
    return upcoming(open_, games, as_of).orderBy(F.desc_nulls_last("edge_pct"), "pick_id").limit(n)


def review_coverage(runs: DataFrame, picks: DataFrame, games: DataFrame, calls: DataFrame, as_of: str, hours: float = 6.0) -> DataFrame:
    """One row: reviews that succeeded and calls (``at``) in the last hours before ``as_of``, and, where a
    review did, the picks that a user can still bet and that no review has reached; else 0.

    Those are published, pending and not started, and have no ``review_hash``, which only a review that
    reached the model writes: a failed call leaves the verdict OK. A pick that a review objected to
    is not looked at again and does not count.
    """
    now = F.lit(as_of).cast("timestamp")
    recent = lambda t: (F.col(t) <= now) & (F.unix_timestamp(now) - F.unix_timestamp(t) <= hours * 3600)
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    done = runs.agg(count((F.col("status") == "ok") & recent("finished_at")).alias("reviews"))
    made = calls.agg(count(recent("at")).alias("calls"))
    unseen = (F.col("published") == 1) & (F.col("result") == "pending") & F.col("review_hash").isNull() & F.coalesce("verdict", F.lit("")).isin("OK", "")
    missed = upcoming(picks.filter(unseen), games, as_of).agg(F.count(F.lit(1)).alias("_open"))
    one = done.join(made).join(missed)
    return one.select("reviews", "calls", F.when(F.col("reviews") > 0, F.col("_open")).otherwise(0).alias("unreviewed"))
