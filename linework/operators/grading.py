"""Grading of picks from final scores, profit, closing lines, track record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import odds
from ..functions.stats import wilson
from .quotes import current_quotes
from .shop import SIDE

TIE = 1e-9
SETTLED = ("win", "loss", "push")


def grade_game(market: Column, side: Column, line: Column, home: Column, away: Column) -> Column:
    """win, loss or push of a full-game market; pending for other markets or without a score.

    The line is that of the side that was bet: home -3.5 covers when home wins by 4 or more.
    Markets of a half or quarter, and team totals, need scores of their own, so they stay pending.
    """
    margin, total = (home - away).cast("double"), (home + away).cast("double")
    by_margin = F.when(side == "home", margin).otherwise(-margin)
    spread = by_margin + line
    over = F.when(side == "over", total - line).otherwise(line - total)
    decide = lambda x: F.when(F.abs(x) < TIE, "push").when(x > 0, "win").otherwise("loss")
    return (
        F.when(home.isNull() | away.isNull(), "pending").when(market == "h2h", decide(by_margin))
        .when(market.isin("spreads", "alternate_spreads"), decide(spread)).when(market.isin("totals", "alternate_totals"), decide(over)).otherwise("pending")
    )


def grade_prop(side: Column, line: Column, actual: Column, one_sided: Column) -> Column:
    gap = actual - line
    yes = F.when((side.isin("yes", "over")) == (actual >= 1), "win").otherwise("loss")
    two = F.when(F.abs(gap) < TIE, "push").when((side == "over") == (gap > 0), "win").otherwise("loss")
    return F.when(actual.isNull(), "pending").when(one_sided, yes).otherwise(two)


def grade_picks(picks: DataFrame, games: DataFrame) -> DataFrame:
    """Picks with ``result`` and ``profit``; games are few beside picks, and broadcast only by Spark's own size check."""
    rows = picks.join(games.select("game_id", "home_score", "away_score"), "game_id")
    rows = rows.withColumn("result", grade_game(F.col("market_type"), F.col("side"), F.col("line"), F.col("home_score"), F.col("away_score")))
    return rows.withColumn("profit", odds.payout(F.col("result"), F.col("stake"), F.col("price")))


def grade_props(picks: DataFrame, stats: DataFrame) -> DataFrame:
    """Props (player_id, season, week, stat, side, line, price, stake, one_sided) with ``result`` and ``profit``.

    ``stats`` is (player_id, season, week, stat, value), one row each. A prop without a value stays pending.
    """
    rows = picks.join(stats.withColumnRenamed("value", "actual"), ["player_id", "season", "week", "stat"], "left")
    rows = rows.withColumn("result", grade_prop(F.col("side"), F.col("line"), F.col("actual"), F.col("one_sided")))
    return rows.withColumn("profit", odds.payout(F.col("result"), F.col("stake"), F.col("price")))


def closing_quotes(observed: DataFrame, games: DataFrame) -> DataFrame:
    """The last quote of each key at or before its own game's kickoff, by time of observation.

    What was seen after kickoff changes nothing, whenever it arrives; games without a kickoff have no
    closing quotes. The closing price and the closing consensus are both made of these.
    """
    kickoffs = games.filter("kickoff_utc is not null").select("game_id", "kickoff_utc")
    return current_quotes(observed.join(kickoffs, "game_id").filter(F.col("observed_at") <= F.col("kickoff_utc")))


def closing_lines(picks: DataFrame, closing: DataFrame, fair: DataFrame) -> DataFrame:
    """Closing price and probability of each pick at its own line, and the value of its price over them.

    ``closing`` are the closing quotes and ``fair`` the consensus of the same. The closing price is the
    best of all books at the pick's market, player, side and line. ``clv_pct`` is the edge of the pick's
    price less that of the closing price, both at the fair probability of that line (the sharp
    books' where there is one); null where either is missing.
    """
    close = closing.groupBy(*SIDE).agg(F.max("price").alias("closing_price"), F.count(F.lit(1)).alias("closing_books"))
    prob = fair.select(*SIDE, F.when(F.col("sharp_prob") > 0, F.col("sharp_prob")).otherwise(F.col("fair_prob")).alias("closing_prob"))
    met = picks.join(close, SIDE, "left").join(prob, SIDE, "left")
    return met.withColumn("clv_pct", closing_value(F.col("closing_prob"), F.col("price"), F.col("closing_price")))


def closing_value(prob: Column, price: Column, closing_price: Column) -> Column:
    return odds.edge_pct(prob, price) - odds.edge_pct(prob, closing_price)


def user_closing_value(bets: DataFrame, closed: DataFrame) -> DataFrame:
    """Bets with the closing price of their pick and the value of the user's own price over it; bets of unknown picks have neither."""
    met = bets.join(closed.select("pick_id", "closing_price", "closing_prob"), "pick_id", "left")
    return met.withColumn("clv_pct", closing_value(F.col("closing_prob"), F.col("price"), F.col("closing_price")))


def track_record(graded: DataFrame, closed: DataFrame, bets: DataFrame, *by: str) -> DataFrame:
    """The record with closing value: (by, picks, ..., roi_pct, n_closed, avg_clv_pct, beat_close, n_bets, slippage_pct).

    Slippage is what users' prices paid less than the pick's, in percent of the stake, over all bets on those picks.
    """
    value = closing_value_by(closed, *by).withColumnRenamed("n", "n_closed")
    taken = bets.select("pick_id", F.col("price").alias("_own")).join(graded.select("pick_id", F.col("price").alias("_price"), *by), "pick_id")
    slipped = taken.groupBy(*by).agg(F.count(F.lit(1)).alias("n_bets"), F.avg((odds.decimal_odds(F.col("_price")) - odds.decimal_odds(F.col("_own"))) * 100.0).alias("slippage_pct"))
    return performance(graded, *by).join(value, [*by], "left").join(slipped, [*by], "left")


def performance(graded: DataFrame, *by: str) -> DataFrame:
    """Record, profit and Wilson interval of settled picks, over all or by columns."""
    settled, decided = F.col("result").isin(*SETTLED), F.col("result").isin("win", "loss")
    count = lambda c: F.sum(c.cast("long"))
    agg = graded.groupBy(*by).agg(
        F.count(F.lit(1)).alias("picks"), count(settled).alias("settled"), count(F.col("result") == "win").alias("wins"), count(F.col("result") == "loss").alias("losses"), count(F.col("result") == "push").alias("pushes"),
        F.sum(F.when(settled, F.col("stake")).otherwise(0.0)).alias("staked"), F.sum(F.when(settled, F.col("profit")).otherwise(0.0)).alias("profit"), count(decided).alias("decided"),
    )
    n, w = F.col("decided").cast("double"), F.col("wins").cast("double")
    return agg.select(
        *by, "picks", "settled", "wins", "losses", "pushes", "staked", "profit",
        F.when(n > 0, w / n).alias("win_rate"), wilson(w, n, False).alias("win_low"), wilson(w, n, True).alias("win_high"), F.when(F.col("staked") > 0, 100.0 * F.col("profit") / F.col("staked")).alias("roi_pct"),
    )


#: Overlapping filters of a track record: name and condition.
FILTERS = {
    "all": "true", "moneyline": "market_type = 'h2h'", "spread": "market_type = 'spreads'", "total": "market_type = 'totals'",
    "favourite": "price < 0", "underdog": "price > 0", "home": "side = 'home'", "tier_a": "tier = 'A'", "big_edge": "edge_pct >= 5",
}


def performance_by_filter(graded: DataFrame) -> DataFrame:
    """The record under each filter; a pick counts under all that it matches."""
    names = F.array_compact(F.array(*[F.when(F.expr(cond), F.lit(name)) for name, cond in FILTERS.items()]))
    return performance(graded.withColumn("filter", F.explode(names)), "filter")


def open_exposure(bets: DataFrame, live: DataFrame) -> DataFrame:
    """Units at risk by local day and standing of pending bets on games in play."""
    rows = bets.join(live, "game_id")
    standing = grade_game(F.col("market_type"), F.col("side"), F.col("line"), F.col("home_score"), F.col("away_score"))
    label = F.when(standing == "win", "winning").when(standing == "loss", "losing").when(standing == "push", "level").otherwise("open")
    day = F.from_utc_timestamp(F.col("kickoff_utc"), "America/New_York").cast("date")
    return rows.groupBy(day.alias("day"), label.alias("standing")).agg(F.count(F.lit(1)).alias("bets"), F.sum("stake").alias("units"))


def grade_counts(graded: DataFrame) -> DataFrame:
    return graded.groupBy("result").agg(F.count(F.lit(1)).alias("n"))


def closing_value_by(closed: DataFrame, *by: str) -> DataFrame:
    """Mean closing-line value and share of picks that beat the close, by columns."""
    has = closed.filter("clv_pct is not null")
    return has.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg("clv_pct").alias("avg_clv_pct"), F.avg((F.col("clv_pct") > 0).cast("double")).alias("beat_close"))


def next_blend_weight(closed: DataFrame, weights: DataFrame, *, step: float = 0.02, least: int = 30, most: float = 0.6) -> DataFrame:
    """(market_type, weight, n): a step up where picks beat the close on average, two down where not;
    unchanged under ``least`` picks, never outside [0, most]."""
    value = closing_value_by(closed, "market_type")
    met = weights.join(value, "market_type", "left")
    moved = F.when(F.coalesce("n", F.lit(0)) < least, F.col("weight")).when(F.col("avg_clv_pct") > 0, F.col("weight") + step).otherwise(F.col("weight") - 2 * step)
    return met.select("market_type", F.greatest(F.lit(0.0), F.least(F.lit(most), moved)).alias("weight"), F.coalesce("n", F.lit(0)).alias("n"))
