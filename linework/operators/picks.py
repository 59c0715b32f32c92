"""Picks: tiers, stakes under exposure caps, repricing that only withdraws."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import odds
from .shop import MAX_EDGE_PCT, SIDE, anchored, upcoming

# What a tier asks for, and how classes of markets scale it.
TIERS = {"A": (5.0, 15, True, 0.03), "B": (3.0, 10, False, 0.05), "C": (2.0, 8, False, 1.0)}
EDGE_SCALE = {"game": 1.0, "period": 1.3, "team": 1.3, "alt": 1.5, "prop": 1.6}
BOOK_SCALE = {"game": 1.0, "period": 0.7, "team": 0.7, "alt": 0.6, "prop": 0.55}
MAX_DISPERSION = 0.15
GAME_CAP, SLATE_CAP = 0.04, 0.25


def market_class(market: Column) -> Column:
    """game, period, team, alt or prop, from the key of a market."""
    return (
        F.when(market.startswith("alternate_"), "alt").when(market.startswith("team_totals"), "team")
        .when(market.rlike("_(h1|h2|q[1-4])$"), "period").when(market.isin("h2h", "h2h_3_way", "spreads", "totals"), "game").otherwise("prop")
    )


def thresholds(kind: str, tier: str) -> tuple[float, int, bool, float]:
    """Least edge, least books (halves to even, 4 at least), sharp anchor asked for, most dispersion."""
    edge, books, sharp, spread = TIERS[tier]
    return edge * EDGE_SCALE[kind], max(4, round(books * BOOK_SCALE[kind])), sharp and kind == "game", spread * (1.5 if kind == "prop" else 1.0)


def loosest_books() -> int:
    """The least books that any class asks for: what a search of opportunities for all classes must let through."""
    return min(thresholds(kind, "C")[1] for kind in BOOK_SCALE)


def assign_tier(opps: DataFrame) -> DataFrame:
    """``bet_class`` and ``tier``: the first of A, B, C whose bar for the class is cleared, else null."""
    kind, spread = F.col("bet_class"), F.coalesce("dispersion", F.lit(0.0))
    tier = F.lit(None).cast("string")
    for name in reversed(TIERS):
        clears = F.lit(False)
        for k in EDGE_SCALE:
            edge, books, sharp, most = thresholds(k, name)
            clears = clears | (kind == k) & (F.col("edge_pct") >= edge) & (F.col("book_count") >= books) & (spread <= most) & ((F.col("anchor") == "sharp") if sharp else F.lit(True))
        tier = F.when(clears, name).otherwise(tier)
    return opps.withColumn("bet_class", market_class(F.col("market_type"))).withColumn("tier", F.when(spread <= MAX_DISPERSION, tier))


def visibility(tier: Column, source: Column, publish_model: bool = False) -> Column:
    """admin, premium or all."""
    hidden = F.lit(False) if publish_model else source == "model"
    return F.when(hidden, "admin").when(tier == "C", "premium").otherwise("all")


def exposure_caps(picks: DataFrame, *, game_cap: float = GAME_CAP, slate_cap: float = SLATE_CAP) -> DataFrame:
    """``stake`` scaled so that a game, and then the slate, stays under its cap; never up.

    The slate's total is one aggregate row joined back, not a window over all rows.
    """
    games = picks.groupBy("game_id").agg(F.sum("stake").alias("_game"))
    scaled = picks.join(games, "game_id").withColumn("game_scale", F.when(F.col("_game") > game_cap, game_cap / F.col("_game")).otherwise(1.0))
    slate = games.agg(F.sum(F.least("_game", F.lit(game_cap))).alias("_slate"))
    both = scaled.join(F.broadcast(slate))
    both = both.withColumn("slate_scale", F.when(F.col("_slate") > slate_cap, slate_cap / F.col("_slate")).otherwise(1.0))
    return both.withColumn("stake", F.col("stake") * F.col("game_scale") * F.col("slate_scale")).drop("_game", "_slate")


def size_slate(tiered: DataFrame, *, fraction: float = 0.25, cap_pct: float = 2.0) -> DataFrame:
    sized = tiered.filter("tier is not null").withColumn("stake", odds.stake(F.col("anchor_prob"), F.col("best_price"), fraction=fraction, cap_pct=cap_pct))
    return exposure_caps(sized)


def new_picks(sized: DataFrame, pending: DataFrame) -> DataFrame:
    """Sized opportunities whose market side and line have no pending pick."""
    return sized.join(pending.select(*SIDE).distinct(), SIDE, "left_anti")


def reprice(pending: DataFrame, quotes_best: DataFrame, fair: DataFrame) -> DataFrame:
    """Pending picks with their price and edge now, on the anchor of new picks; a pick is withdrawn
    when it no longer clears a bar of its class, never published again, and left alone where
    nothing is quoted."""
    priced = assign_tier(anchored(fair.join(quotes_best, SIDE)))
    now = priced.select(*SIDE, F.col("best_price").alias("new_price"), F.col("edge_pct").alias("new_edge"), F.col("tier").alias("_tier"))
    met = pending.join(now, SIDE, "left")
    fine = F.col("_tier").isNotNull() & (F.col("new_edge") <= MAX_EDGE_PCT)
    met = met.withColumn("_fine", fine).drop("_tier")
    fine = F.col("_fine")
    return met.withColumn("still_published", F.col("published") & F.when(F.col("new_price").isNull(), F.lit(True)).otherwise(fine)).drop("_fine")


def current_slate(picks: DataFrame, games: DataFrame, as_of: str, *, include_unpublished: bool = False) -> DataFrame:
    """Picks not started yet, by tier and then edge."""
    rows = picks if include_unpublished else picks.filter("published = 1")
    return upcoming(rows, games, as_of).orderBy("tier", F.desc("edge_pct"), "pick_id")
