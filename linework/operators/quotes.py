"""Observed quotes: current state, change log, pairing of the two sides."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import odds

MARKET = ["game_id", "market_type", "player_id"]
QUOTE = [*MARKET, "side", "line", "book"]
#: A two-sided quote with more hold than this is broken, not expensive.
MAX_HOLD_PCT = 25.0


def current_quotes(observed: DataFrame) -> DataFrame:
    """The latest quote of each key, later ``seq`` first among equal times, then the higher price; one partial aggregation."""
    latest = F.max_by(F.struct("price", "observed_at", "seq"), F.struct("observed_at", "seq", "price")).alias("q")
    return observed.groupBy(*QUOTE).agg(latest).select(*QUOTE, "q.price", "q.observed_at", "q.seq")


def price_changes(observed: DataFrame) -> DataFrame:
    """Quotes whose price differs from the one before under the same key; the first is a change."""
    w = Window.partitionBy(*QUOTE).orderBy("observed_at", "seq")
    before = F.lag("price").over(w)
    return observed.withColumn("prev_price", before).filter(F.col("prev_price").isNull() | (F.col("prev_price") != F.col("price")))


def pair_quotes(quotes: DataFrame) -> DataFrame:
    """A row for each book and pair line: prices of the first and second side, null where one is missing."""
    keyed = quotes.withColumn("pair_line", odds.pair_line(F.col("market_type"), F.col("side"), F.col("line")))
    return keyed.groupBy(*MARKET, "pair_line", "book").agg(
        F.max(F.when(F.col("side").isin(*odds.FIRST_SIDES), F.col("price"))).alias("price_a"),
        F.max(F.when(F.col("side").isin(*odds.SECOND_SIDES), F.col("price"))).alias("price_b"),
        F.max(F.when(F.col("side").isin(*odds.FIRST_SIDES), F.col("side"))).alias("side_a"),
        F.max(F.when(F.col("side").isin(*odds.SECOND_SIDES), F.col("side"))).alias("side_b"),
    )


def priced_pairs(quotes: DataFrame) -> DataFrame:
    """Two-sided quotes with implied probabilities and hold; ``plausible`` is false for broken ones."""
    return with_hold(pair_quotes(quotes).filter("price_a is not null and price_b is not null"))


def with_hold(pairs: DataFrame) -> DataFrame:
    """Pairs with ``prob_a``, ``prob_b``, ``hold_pct`` and ``plausible``, null where a price is missing."""
    pairs = pairs.withColumn("prob_a", odds.implied_probability(F.col("price_a"))).withColumn("prob_b", odds.implied_probability(F.col("price_b")))
    pairs = pairs.withColumn("hold_pct", odds.hold_pct(F.col("prob_a"), F.col("prob_b")))
    return pairs.withColumn("plausible", F.col("hold_pct") <= MAX_HOLD_PCT)


def book_moves(changes: DataFrame) -> DataFrame:
    """First and last line and price of each book on a market side, and the number of its changes."""
    key = F.struct("observed_at", "seq")
    return changes.groupBy(*MARKET, "side", "book").agg(
        F.min_by("line", key).alias("first_line"), F.max_by("line", key).alias("last_line"), F.min_by("price", key).alias("first_price"), F.max_by("price", key).alias("last_price"), F.count(F.lit(1)).alias("n_changes"),
    )


def net_move(changes: DataFrame, significant: float = 1.0) -> DataFrame:
    """The move at the busiest book of each market side; a tie goes to the first book by name."""
    busiest = book_moves(changes).groupBy(*MARKET, "side").agg(F.min_by(F.struct("book", "first_line", "last_line", "first_price", "last_price", "n_changes"), F.struct(-F.col("n_changes"), "book")).alias("m"))
    out = busiest.select(*MARKET, "side", "m.*")
    move = F.col("last_line") - F.col("first_line")
    toward = F.when(F.col("side") == "under", -move).otherwise(move)
    return out.withColumn("move", move).withColumn("direction", F.when(toward > 0, "up").when(toward < 0, "down").otherwise("none")).withColumn("size", F.when(F.abs(move) >= significant, "significant").when(move != 0, "minor").otherwise("none"))


def recent_changes(changes: DataFrame, n: int = 12, shown: int = 6) -> DataFrame:
    """Of the last ``n`` changes of each market the last ``shown``, numbered from the oldest shown."""
    w = Window.partitionBy(*MARKET).orderBy(F.desc("observed_at"), F.desc("seq"))
    recent = changes.withColumn("back", F.row_number().over(w)).filter(F.col("back") <= min(n, shown))
    return recent.withColumn("position", F.row_number().over(Window.partitionBy(*MARKET).orderBy("observed_at", "seq"))).drop("back")


def book_latency(changes: DataFrame) -> DataFrame:
    """Seconds by which each book follows the first mover of its market and side on one line."""
    key = [*MARKET, "side", "line"]
    first = changes.groupBy(*key, "book").agg(F.min("observed_at").alias("at"))
    lead = first.groupBy(*key).agg(F.min("at").alias("lead_at"))
    lag = F.col("at").cast("timestamp").cast("long") - F.col("lead_at").cast("timestamp").cast("long")
    return first.join(lead, key).groupBy("book").agg(F.count(F.lit(1)).alias("n_markets"), F.sum((lag == 0).cast("int")).alias("n_first"), F.avg(lag).alias("mean_lag_s"))


def active_moves(changes: DataFrame, current: DataFrame) -> DataFrame:
    """Changes of books that quote the market now."""
    return changes.join(current.select(*MARKET, "book").distinct(), [*MARKET, "book"], "left_semi")
