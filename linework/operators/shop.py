"""Line shopping: best prices, main lines, and where the best price beats the fair one."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import odds
from .metrics import order_statistics
from .quotes import MARKET

SIDE = [*MARKET, "side", "line"]
#: A larger edge is a quote for another event, not an opportunity.
MAX_EDGE_PCT = 25.0


def best_prices(quotes: DataFrame, books: Sequence[str] | None = None) -> DataFrame:
    """Highest price of each market side and line; a tie goes to the first book by name."""
    rows = quotes if books is None else quotes.filter(F.col("book").isin(*books))
    best = F.min_by(F.struct("price", "book"), F.struct(-F.col("price"), "book")).alias("b")
    return rows.groupBy(*SIDE).agg(best).select(*SIDE, F.col("b.price").alias("best_price"), F.col("b.book").alias("best_book"))


def main_lines(quotes: DataFrame) -> DataFrame:
    """The line most books quote, by its absolute value; a tie goes to the smaller one.

    Books are counted for each signed line and the larger count stands for both signs.
    """
    signed = quotes.groupBy(*MARKET, "line").agg(F.count_distinct("book").alias("n"))
    absolute = signed.groupBy(*MARKET, F.abs("line").alias("main_line")).agg(F.max("n").alias("n"))
    return absolute.groupBy(*MARKET).agg(F.min_by(F.struct("main_line", "n"), F.struct(-F.col("n"), "main_line")).alias("m")).select(*MARKET, "m.main_line", F.col("m.n").alias("n_books"))


def not_begun(as_of: str) -> Column:
    return F.col("kickoff_utc").isNull() | (F.col("kickoff_utc") > F.lit(as_of).cast("timestamp"))


def upcoming(df: DataFrame, games: DataFrame, as_of: str) -> DataFrame:
    """Rows whose game has not started at ``as_of``; those without a kickoff or a game row stay."""
    return df.join(games.select("game_id", "kickoff_utc"), "game_id", "left").filter(not_begun(as_of))


def anchored(priced: DataFrame) -> DataFrame:
    """``priced`` with anchor_prob, anchor and edge_pct: the sharp books' probability where there is one, else the consensus."""
    anchor = F.when(F.col("sharp_prob") > 0, F.col("sharp_prob")).otherwise(F.col("fair_prob"))
    rows = priced.withColumn("anchor_prob", anchor).withColumn("anchor", F.when(F.col("sharp_prob") > 0, "sharp").otherwise("consensus"))
    return rows.filter("anchor_prob > 0").withColumn("edge_pct", odds.edge_pct(F.col("anchor_prob"), F.col("best_price")))


def opportunities(
    fair: DataFrame, quotes: DataFrame, games: DataFrame, as_of: str, *, books: Sequence[str] | None = None, least_edge: float = 2.0, least_books: int = 8, main_only: bool = True
) -> DataFrame:
    """Market sides whose best price at a bettable book beats the fair price, ``rejected`` if implausibly.

    The anchor is the sharp books' probability where there is one, else the consensus.
    """
    rows = fair.filter(F.col("book_count") >= least_books).join(best_prices(quotes, books), SIDE)
    if main_only:
        lines = main_lines(quotes).select(*MARKET, F.col("main_line").alias("_main"))
        rows = rows.withColumn("_main", F.abs("line")).join(lines, [*MARKET, "_main"], "left_semi").drop("_main")
    return upcoming(anchored(rows).filter(F.col("edge_pct") >= least_edge), games, as_of).withColumn("rejected", F.col("edge_pct") > MAX_EDGE_PCT).drop("kickoff_utc")


def top(opps: DataFrame, n: int) -> DataFrame:
    return opps.orderBy(F.desc("edge_pct"), *SIDE).limit(n)


def price_ladder(quotes: DataFrame) -> DataFrame:
    """Each book's price on its market side and line, and its gap to the best in decimal odds."""
    value = odds.decimal_odds(F.col("price"))
    best = F.max(value).over(Window.partitionBy(*SIDE))
    return quotes.select(*SIDE, "book", "price", (best - value).alias("gap"), (best == value).alias("is_best"))


def shopping_value(quotes: DataFrame) -> DataFrame:
    """Of each book: sides quoted with another book, how often it has the best price (ties count), and the mean gain of best over worst there."""
    value = odds.decimal_odds(F.col("price"))
    rows = quotes.withColumn("d", value)
    group = rows.groupBy(*SIDE).agg(F.max("d").alias("hi"), F.min("d").alias("lo"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    met = rows.join(group, SIDE)
    return met.groupBy("book").agg(F.count(F.lit(1)).alias("n_quotes"), F.sum((F.col("d") == F.col("hi")).cast("long")).alias("n_best"), F.avg((F.col("hi") / F.col("lo") - 1.0) * 100.0).alias("avg_gain_pct"), F.max((F.col("hi") / F.col("lo") - 1.0) * 100.0).alias("max_gain_pct"))


#: Lower bounds of the bins of edges, in percent.
EDGE_BINS = (-100.0, -10.0, -5.0, -2.0, 0.0, 1.0, 2.0, 5.0, 10.0)


def edge_distribution(opps: DataFrame) -> DataFrame:
    """Count, share of sharp anchors and mean edge in each bin of edges."""
    low = F.greatest(*[F.when(F.col("edge_pct") >= b, F.lit(b)) for b in EDGE_BINS])
    return opps.groupBy(low.alias("edge_from")).agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("anchor") == "sharp").cast("long")).alias("n_sharp"), F.avg("edge_pct").alias("mean_edge"))


def edge_summary(opps: DataFrame, *by: str) -> DataFrame:
    """Order statistics of edges: (by, n, median, p90, p99, max, positive_pct, sharp_pct).

    The value for a share q is that of rank floor(q n) + 1; no sort of all edges is made.
    """
    n = F.col("n")
    ranks = {"median": F.floor(n * 0.5) + 1, "p90": F.floor(n * 0.9) + 1, "p99": F.floor(n * 0.99) + 1, "max": n}
    stats = order_statistics(opps, "edge_pct", ranks, *by)
    shares = opps.groupBy(*by).agg((F.avg((F.col("edge_pct") > 0).cast("double")) * 100.0).alias("positive_pct"), (F.avg((F.col("anchor") == "sharp").cast("double")) * 100.0).alias("sharp_pct"))
    return stats.join(shares, list(by)) if by else stats.join(shares)


#: Edges, in percent, at which the curve of opportunities is read.
CURVE = (0.0, 1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 8.0)


def edge_curve(opps: DataFrame, pairs: DataFrame, needed: Mapping[str, int], *by: str) -> DataFrame:
    """Why there are few opportunities: (by, paired, one_sided, pair_rate, markets, at_<edge>..., best_books, median_books, reach_<tier>...).

    ``pairs`` are the book pairs with ``price_a`` and ``price_b`` null where a side is missing, and ``needed``
    the books that each tier asks for: a tier is reachable if some market has so many. All counts of
    the curve come from one aggregate over ``opps``; the median of books is that of rank floor(n / 2) + 1 from the most.
    """
    two = F.col("price_a").isNotNull() & F.col("price_b").isNotNull()
    paired = pairs.groupBy(*by).agg(F.count_if(two).alias("paired"), F.count_if(~two).alias("one_sided"), F.avg(two.cast("double")).alias("pair_rate"))
    at = [F.count_if(F.col("edge_pct") >= c).alias(f"at_{c:g}") for c in CURVE]
    counted = opps.groupBy(*by, "book_count").agg(F.count(F.lit(1)).alias("markets"), *at)  # as many rows as books
    curve = counted.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("markets", *(f"at_{c:g}" for c in CURVE))], F.max("book_count").alias("best_books"))
    middle = order_statistics(opps, "book_count", {"median_books": F.col("n") - F.floor(F.col("n") / 2)}, *by).drop("n")
    rows = paired.join(curve, list(by), "left").join(middle, list(by), "left")
    return rows.select(*by, "paired", "one_sided", "pair_rate", "markets", *[f"at_{c:g}" for c in CURVE], "best_books", "median_books", *[(F.coalesce("best_books", F.lit(0)) >= n).alias(f"reach_{tier}") for tier, n in needed.items()])


def _by_books(sides: DataFrame, name: str) -> DataFrame:
    """Of ``sides`` as (market_type, book_count, n): the most books of a side and those at rank floor(n / 2) + 1 from the most."""
    down = Window.partitionBy("market_type").orderBy(F.desc("book_count")).rowsBetween(Window.unboundedPreceding, 0)
    ranked = sides.filter("n > 0").withColumns({"_up_to": F.sum("n").over(down), "_all": F.sum("n").over(Window.partitionBy("market_type"))})
    middle = F.max(F.when(F.col("_up_to") > F.floor(F.col("_all") / 2), F.col("book_count")))
    return ranked.groupBy("market_type").agg(F.max("book_count").alias(f"{name}_books"), middle.alias(f"{name}_middle"))


def funnel(
    kinds: DataFrame, games: DataFrame, quotes: DataFrame, pairs: DataFrame, fair: DataFrame, bettable: DataFrame, picks: DataFrame, *, least_edge: float = 2.0, least_books: int = 8
) -> DataFrame:
    """Where market sides go on their way from quotes to picks: (stage, market_type, n, beside, books, median_books, latest, first_zero).

    All stages are of the same ``games``, which the caller chooses, or a fall would be a change of subject; and
    each kind of market in ``kinds`` has all stages, as one that falls to zero is what is looked for.

    | stage | n | beside | books |
    |---|---|---|---|
    | 0 games | games | | |
    | 1 quotes | current quotes, the ``latest`` of them | | that quote |
    | 2 pairs | of a book, both sides | one side only | |
    | 3 plausible | of these with a hold that can be | the others | |
    | 4 fair | sides with a fair price | | of a side: most, median |
    | 5 bettable | ``bettable``: opportunities at any edge | rejected | of a side: most, median |
    | 6 edge c | of these with an edge of c or more | | |
    | 7 opportunities | of these with ``least_edge`` and ``least_books`` | | |
    | 8 picks | published | withdrawn | |

    ``first_zero`` marks the first stage with none; those after it follow from it. The curve of edges is no link of the chain.
    """
    two, accepted, edge = F.col("price_a").isNotNull() & F.col("price_b").isNotNull(), ~F.col("rejected"), F.col("edge_pct")
    at = {f"6 edge {c:g}": accepted & (edge >= c) for c in CURVE}
    counts = {"5 bettable": accepted, "5 beside": ~accepted, **at, "7 opportunities": accepted & (edge >= least_edge) & (F.col("book_count") >= least_books)}
    kind = lambda df: df.groupBy("market_type")
    fair_sides = fair.groupBy("market_type", "book_count").agg(F.count(F.lit(1)).alias("n"))
    bet_sides = bettable.groupBy("market_type", "book_count").agg(*[F.count_if(c).alias(name) for name, c in counts.items()])  # as many rows as books
    parts = [
        kind(quotes).agg(F.count(F.lit(1)).alias("1 quotes"), F.count_distinct("book").alias("1 books"), F.max("observed_at").alias("latest")),
        kind(pairs).agg(F.count_if(two).alias("2 pairs"), F.count_if(~two).alias("2 beside"), F.count_if(two & F.col("plausible")).alias("3 plausible")),
        kind(fair_sides).agg(F.sum("n").alias("4 fair")), _by_books(fair_sides, "4"),
        kind(bet_sides).agg(*[F.sum(name).alias(name) for name in counts]), _by_books(bet_sides.withColumn("n", F.col("5 bettable")), "5"),
        kind(picks).agg(F.count_if(F.col("published") == 1).alias("8 picks"), F.count(F.lit(1)).alias("8 all")),
    ]
    rows = kinds.select("market_type").distinct()
    for part in parts:
        rows = rows.unionByName(part, allowMissingColumns=True)
    held = [c for c in rows.columns if c not in ("market_type", "latest")]
    one = kind(rows).agg(F.max("latest").alias("latest"), *[F.coalesce(F.max(c), F.lit(0)).alias(c) for c in held]).join(F.broadcast(games.agg(F.count(F.lit(1)).alias("0 games"))))
    none = F.lit(None).cast("long")
    beside = {"2 pairs": F.col("2 beside"), "3 plausible": F.col("2 pairs") - F.col("3 plausible"), "5 bettable": F.col("5 beside"), "8 picks": F.col("8 all") - F.col("8 picks")}
    books = {"1 quotes": F.col("1 books"), "4 fair": F.col("4_books"), "5 bettable": F.col("5_books")}
    middle = {"4 fair": F.col("4_middle"), "5 bettable": F.col("5_middle")}
    chain = ["0 games", "1 quotes", "2 pairs", "3 plausible", "4 fair", "5 bettable", "7 opportunities", "8 picks"]
    first = F.coalesce(*[F.when(F.col(stage) == 0, stage) for stage in chain], F.lit(""))
    stages = [
        F.struct(
            F.lit(stage).alias("stage"), "market_type", F.col(stage).alias("n"), beside.get(stage, none).alias("beside"), books.get(stage, none).alias("books"), middle.get(stage, none).alias("median_books"),
            F.when(F.lit(stage == "1 quotes"), F.col("latest")).alias("latest"), (first == stage).alias("first_zero"),
        )
        for stage in sorted([*chain, *at])
    ]
    return one.select(F.inline(F.array(*stages)))
