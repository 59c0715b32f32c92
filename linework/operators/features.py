"""The matrix that models train on: a fixed, ordered contract of features over games."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import odds
from ..functions.stats import correlation, weighted_median
from ..sources.feeds import weather_flags
from .consensus import BOOK_WEIGHTS, book_weight
from .panel import kickoff_slot
from .quotes import with_hold
from .ratings import matchups

SLOTS = ("early", "late", "primetime")
_SIDES = ("home", "away")

class Feature(NamedTuple):
    """``availability`` is pregame, or in_game for what is only known once the game runs; ``lag_hours`` is how long before kickoff a decision must be for it to lack the value."""

    name: str
    default: float
    availability: str = "pregame"
    lag_hours: float = 0.0


# The features in order with what stands for a missing one.
SPEC = [
    Feature("market_spread", 0.0), Feature("market_total", 44.0), Feature("market_home_prob", 0.5), Feature("line_move_spread", 0.0), Feature("book_dispersion", 0.0), Feature("sharp_soft_delta", 0.0),
    Feature("home_rest", 7.0), Feature("away_rest", 7.0), Feature("rest_diff", 0.0), Feature("div_game", 0.0), Feature("is_dome", 0.0), Feature("kickoff_slot", 0.0), Feature("week", 1.0),
    Feature("wind_kph", 0.0), Feature("gust_kph", 0.0), Feature("high_wind", 0.0), Feature("temp_c", 15.0), Feature("precip_mm", 0.0),
    *[Feature(f"{s}_{u}_{c}", 0.0) for c in ("all", "pass", "rush") for s in _SIDES for u in ("off", "def")],
    *[Feature(f"{s}_edge_{c}", 0.0) for c in ("pass", "rush") for s in _SIDES], Feature("net_edge", 0.0), Feature("ratings_confident", 0.0),
    *[Feature(f"{s}_{m}", 0.0) for m in ("n_out", "n_questionable", "qb_out", "snap_share_out") for s in _SIDES], Feature("availability_known", 0.0),
]
NAMES = [f.name for f in SPEC]
ROOFED = ("dome", "closed", "retractable")


def no_post_columns(columns: list[str]) -> None:
    """Refuse columns that describe the game already played."""
    bad = [c for c in columns if c.startswith("post_")]
    if bad:
        raise ValueError(f"known only after the game: {', '.join(bad)}")


def validate_availability(hours: float, spec: list[Feature] = SPEC) -> list[str]:
    """What must not be used in a decision ``hours`` before kickoff, each with its reason."""
    late = [f"{f.name}: {f.availability}" for f in spec if f.availability != "pregame"]
    return late + [f"{f.name}: known {f.lag_hours:g} h before kickoff, decided {hours:g} h before" for f in spec if f.availability == "pregame" and f.lag_hours > hours]


def pick_features(df: DataFrame, spec: list[Feature] = SPEC) -> DataFrame:
    """The features in their order, null as the default, absent as the default; other columns first."""
    names = [f.name for f in spec]
    no_post_columns(names)
    value = lambda f: F.coalesce(F.col(f.name).cast("double"), F.lit(float(f.default))) if f.name in df.columns else F.lit(float(f.default))
    return df.select(*[c for c in df.columns if c not in names], *[value(f).alias(f.name) for f in spec])


def with_rest(games: DataFrame) -> DataFrame:
    """Games with ``home_rest`` and ``away_rest``, the days since the team's game before in the season.

    Null for a team's first game and for games without a kickoff, which are no games before either.
    A schedule that has the columns keeps its own. A window holds one team's season.
    """
    if {"home_rest", "away_rest"} <= set(games.columns):
        return games
    side = lambda who: F.struct(F.col(f"{who}_team").alias("team"), F.lit(who).alias("who"))
    played = games.filter("kickoff_utc is not null").select("game_id", "season", "kickoff_utc", F.explode(F.array(*[side(w) for w in _SIDES])).alias("s"))
    before = F.lag("kickoff_utc").over(Window.partitionBy("season", "s.team").orderBy("kickoff_utc", "game_id"))
    days = played.withColumn("days", F.datediff("kickoff_utc", before))
    rest = days.groupBy("game_id").agg(*[F.max(F.when(F.col("s.who") == w, F.col("days"))).alias(f"{w}_rest") for w in _SIDES])
    return games.drop("home_rest", "away_rest").join(rest, "game_id", "left")


def weather_at_kickoff(readings: DataFrame, games: DataFrame, lead_hours: float = 0.0) -> DataFrame:
    """(game_id, reading): the newest reading of each game that was known ``lead_hours`` before its kickoff.

    ``reading_id`` breaks ties. What came later changes nothing; games without a kickoff have no reading.
    """
    starts = games.filter("kickoff_utc is not null").select("game_id", "kickoff_utc")
    lead = F.make_dt_interval(secs=F.lit(lead_hours * 3600.0).cast("decimal(18, 6)"))
    known = readings.join(starts, "game_id").filter(F.col("knowledge_time") <= F.col("kickoff_utc") - lead)
    rest = [c for c in readings.columns if c != "game_id"]
    return known.groupBy("game_id").agg(F.max_by(F.struct(*rest), F.struct("knowledge_time", "reading_id")).alias("r")).select("game_id", "r.*")


def game_market(observed: DataFrame, games: DataFrame, *, sharp: tuple[str, ...] = ("pinnacle",), method: str = "power") -> DataFrame:
    """(game_id, market_home_prob, sharp_soft_delta, line_move_spread, book_dispersion) of what was quoted by kickoff.

    The consensus is that of the moneyline, of each book's last price; the move is the mean over books of the last
    home spread less the first, the dispersion the spread of the last ones. One join with the schedule deals the
    quotes by game; they are reduced to a row a book and then to one a game where they are, without another
    shuffle. The consensus of home is what ``fair_prices`` makes of ``closing_quotes``. Games without
    quotes have no row.
    """
    money, spread = (F.col("market_type") == "h2h") & (F.col("player_id") == "") & F.col("side").isin(*_SIDES), (F.col("market_type") == "spreads") & (F.col("side") == "home")
    kind = F.when(spread, 2).when(F.col("side") == "home", 0).otherwise(1)
    used = observed.filter(money | spread).select("game_id", kind.alias("kind"), "book", "line", "price", "observed_at", "seq")
    starts = games.filter("kickoff_utc is not null").select("game_id", "kickoff_utc").hint("merge")  # sorts by game, as the aggregates after it do
    known = used.join(starts, "game_id").filter(F.col("observed_at") <= F.col("kickoff_utc"))
    ends = known.groupBy("game_id", "kind", "book").agg(
        F.max(F.struct("observed_at", "seq", "price", "line")).alias("last"), F.min(F.when(F.col("kind") == 2, F.struct("observed_at", "seq", "line"))).alias("first"))
    of = lambda k, c: F.max(F.when(F.col("kind") == k, F.col(c)))
    by_book = ends.groupBy("game_id", "book").agg(of(0, "last.price").alias("price_a"), of(1, "last.price").alias("price_b"), of(2, "first.line").alias("first"), of(2, "last.line").alias("last"), F.max(F.col("kind") == 2).alias("moved"))
    whole = F.col("plausible")
    fair = with_hold(by_book).withColumns({"w": book_weight(BOOK_WEIGHTS), "p": F.when(whole, odds.devig(F.col("prob_a"), F.col("prob_b"), method))})
    out = fair.groupBy("game_id").agg(
        F.collect_list(F.when(whole, F.struct(F.col("p").alias("v"), "w"))).alias("entries"), F.avg(F.when(whole & F.col("book").isin(*sharp), F.col("p"))).alias("sharp_prob"),
        F.avg(F.col("last") - F.col("first")).alias("line_move_spread"), F.stddev_pop("last").alias("book_dispersion"), F.max("moved").alias("moved"),
    ).filter("size(entries) > 0 or moved")
    prob = out.withColumn("market_home_prob", F.explode(F.array(weighted_median(F.col("entries")))))  # a generator, so that it is worked out once
    return prob.select("game_id", "market_home_prob", (F.col("sharp_prob") - F.col("market_home_prob")).alias("sharp_soft_delta"), "line_move_spread", "book_dispersion")


def training_matrix(
    games: DataFrame, ratings: DataFrame, availability: DataFrame | None = None, market: DataFrame | None = None, weather: DataFrame | None = None, *, require_market: bool = True
) -> DataFrame:
    """A row for each game with a score: key, features in order, targets.

    ``market`` is that of ``game_market`` and ``weather`` that of ``weather_at_kickoff``; without one of the
    inputs its features have their defaults and the width stays. With ``require_market`` games without a spread
    or total are left out. The schedule's line is positive where home is favoured, so it is subtracted from the
    margin. Every join is by the game or by the team's week, each side with one row a key.
    """
    played = games.filter("home_score is not null and away_score is not null")
    if require_market:
        played = played.filter("spread_line is not null and total_line is not null")
    # Rest comes from the whole schedule: a game without a score is a game before all the same.
    rested = with_rest(games).select("game_id", *[f"{s}_rest" for s in _SIDES])
    rows = matchups(played.drop(*[f"{s}_rest" for s in _SIDES]).join(rested, "game_id", "left"), ratings)
    slot = F.lit(0.0)
    for i, name in enumerate(SLOTS):
        slot = F.when(kickoff_slot(F.col("kickoff_utc")) == name, float(i + 1)).otherwise(slot)
    rest = [F.coalesce(f"{s}_rest", F.lit(7)) for s in _SIDES]
    rows = rows.withColumns({
        "market_spread": F.col("spread_line"), "market_total": F.col("total_line"), "kickoff_slot": slot, "ratings_confident": F.col("confident").cast("double"),
        "rest_diff": rest[0] - rest[1], **({"is_dome": F.lower("roof").isin(*ROOFED)} if "roof" in rows.columns else {}),
    })
    if market is not None:
        rows = rows.join(market.select("game_id", "market_home_prob", "line_move_spread", "book_dispersion", "sharp_soft_delta"), "game_id", "left")
    if weather is not None:
        readings = ["temp_c", "wind_kph", "gust_kph", "precip_mm"]
        rows = rows.join(weather.select("game_id", *readings), "game_id", "left")
        rows = weather_flags(rows if "roof" in rows.columns else rows.withColumn("roof", F.lit(None).cast("string")))
    if availability is not None:
        for s in _SIDES:
            own = availability.select("season", "week", F.col("team").alias(f"{s}_team"), *[F.col(m).alias(f"{s}_{m}") for m in ("n_out", "n_questionable", "qb_out", "snap_share_out")])
            rows = rows.join(own, ["season", "week", f"{s}_team"], "left")
        rows = rows.withColumn("availability_known", (F.col("home_n_out").isNotNull() | F.col("away_n_out").isNotNull()).cast("double"))
    margin, total = F.col("home_score") - F.col("away_score"), F.col("home_score") + F.col("away_score")
    spread, over = F.coalesce("spread_line", F.lit(0.0)), F.coalesce("total_line", F.lit(44.0))
    rows = rows.withColumns({
        "margin": margin, "residual": margin - spread, "home_cover": (margin - spread > 0).cast("int"), "push": F.abs(margin - spread) < 1e-9, "total_residual": total - over, "over": (total > over).cast("int"),
    })
    keep = ["game_id", "season", "home_team", "away_team", "margin", "residual", "home_cover", "push", "total_residual", "over"]
    return pick_features(rows.select(*keep, *[c for c in NAMES if c in rows.columns]))


def sanity(matrix: DataFrame) -> DataFrame:
    """Checks (name, value, lo, hi, passed) of a matrix, in one aggregate.

    The line must rise with the margin and the total with the points; games are rows; the mean residual and the
    share of covers lie within four standard errors of 0 and one half.
    """
    n = F.count(F.lit(1)).cast("double")
    some = lambda c: F.coalesce(c, F.lit(0.0))
    checks = {
        "duplicate_games": (n - F.count_distinct("game_id"), 0.0, 0.0),
        "spread_margin_corr": (some(correlation("market_spread", "margin")), 1e-9, 1.0),
        "total_points_corr": (some(correlation("market_total", F.col("total_residual") + F.col("market_total"))), 1e-9, 1.0),
        "mean_residual_se": (some(F.avg("residual") / (F.stddev_samp("residual") / F.sqrt(n))), -4.0, 4.0),
        "home_cover_se": (some((F.avg("home_cover") - 0.5) * 2.0 * F.sqrt(n)), -4.0, 4.0),
    }
    wide = matrix.agg(*[value.alias(name) for name, (value, _, _) in checks.items()])
    rows = wide.select(F.explode(F.array(*[F.struct(F.lit(name).alias("name"), F.col(name).alias("value"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi")) for name, (_, lo, hi) in checks.items()])).alias("c"))
    return rows.select("c.*").withColumn("passed", F.col("value").between(F.col("lo"), F.col("hi")))


def market_features(changes: DataFrame, games: DataFrame) -> DataFrame:
    """Move of home's spread from the first to the last price before kickoff, and how the books differ then."""
    spread = changes.filter("market_type = 'spreads' and side = 'home'").join(games.filter("kickoff_utc is not null").select("game_id", "kickoff_utc"), "game_id").filter(F.col("observed_at") <= F.col("kickoff_utc"))
    key = F.struct("observed_at", "seq")
    by_book = spread.groupBy("game_id", "book").agg(F.min_by("line", key).alias("open"), F.max_by("line", key).alias("close"))
    return by_book.groupBy("game_id").agg(F.avg(F.col("close") - F.col("open")).alias("line_move_spread"), F.coalesce(F.stddev_pop("close"), F.lit(0.0)).alias("book_dispersion"), F.count(F.lit(1)).alias("books"))
