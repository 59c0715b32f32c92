"""Player panels with absences as rows, trailing form, reports joined as they were known."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def active_players(usage: DataFrame, *, least_weeks: int = 4, least_volume: float = 1.0) -> DataFrame:
    """(player, season, team) with weeks active, median volume, first and last week."""
    return usage.groupBy("player_id", "season", "team").agg(
        F.count(F.lit(1)).alias("n_active"), F.median("volume").alias("baseline_vol"), F.min("week").alias("first_wk"), F.max("week").alias("last_wk"),
    ).filter((F.col("n_active") >= least_weeks) & (F.col("baseline_vol") >= least_volume))


def player_panel(usage: DataFrame, *, least_weeks: int = 4) -> DataFrame:
    """A row for each week of the team between a player's first and last; a missing week is zero volume.

    The range join is an equi join on (season, team): a team has one row for each week.
    """
    weeks = usage.select("season", "team", "week").distinct()
    tenure = active_players(usage, least_weeks=least_weeks).join(weeks, ["season", "team"]).filter(F.col("week").between(F.col("first_wk"), F.col("last_wk")))
    met = tenure.join(usage.select("player_id", "season", "team", "week", "volume", F.lit(1).alias("played")), ["player_id", "season", "team", "week"], "left")
    return met.select("player_id", "season", "team", "week", "baseline_vol", F.coalesce("volume", F.lit(0)).cast("long").alias("volume"), F.coalesce("played", F.lit(0)).alias("played"))


def trailing_form(panel: DataFrame, n: int = 4) -> DataFrame:
    """Mean, most, zero rate and count of the ``n`` weeks before; the week itself never counts."""
    order = Window.partitionBy("player_id", "season").orderBy("week")
    before = order.rowsBetween(-n, -1)
    return panel.withColumns({
        "trail_mean": F.avg("volume").over(before), "trail_max": F.max("volume").over(before),
        "trail_zero_rate": F.avg((F.col("volume") == 0).cast("double")).over(before), "trail_n": F.count("volume").over(before), "last_week_vol": F.lag("volume").over(order),
        "bust": (F.col("volume") < 0.5 * F.col("baseline_vol")).cast("int"),
    })


def prior_form(usage: DataFrame, short: int = 3, long: int = 8) -> DataFrame:
    """Mean snap share of the last 3 and 8 games before, across seasons."""
    order = Window.partitionBy("player_id").orderBy("season", "week")
    mean = lambda k: F.avg("snap_pct").over(order.rowsBetween(-k, -1))
    return usage.withColumn("form_short", mean(short)).withColumn("form_long", mean(long))


def panel_summary(formed: DataFrame) -> DataFrame:
    """Absence and bust rates, and by how much counting only those present understates busts."""
    present = F.col("played") == 1
    out = formed.agg(
        F.count(F.lit(1)).alias("rows"), F.avg(1.0 - F.col("played")).alias("absence_rate"), F.avg(F.col("bust").cast("double")).alias("bust_rate"), F.avg(F.when(present, F.col("bust").cast("double"))).alias("present_bust_rate"))
    return out.withColumn("understatement", F.col("bust_rate") / F.col("present_bust_rate"))


def regular_season(season_type: Column) -> Column:
    """A missing season type means the regular season."""
    return season_type.isNull() | (season_type == "REG")


def latest_reports(reports: DataFrame, *keys: str) -> DataFrame:
    """The latest known report of each key; ``report_id`` breaks ties."""
    others = [c for c in reports.columns if c not in keys]
    latest = reports.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct("knowledge_time", "report_id")).alias("r"))
    return latest.select(*keys, "r.*")


def known_as_of(decisions: DataFrame, reports: DataFrame, key: str, at: str) -> DataFrame:
    """Each decision with the latest report of its key known at its time; decisions without one stay.

    Decisions and reports are one ordered sequence for each key, so a key costs a sort and not
    the product of both sides.
    """
    columns = [c for c in reports.columns if c not in (key, "knowledge_time")]
    left = decisions.withColumn("_t", F.col(at).cast("timestamp")).withColumn("_kind", F.lit(1)).withColumn("_r", F.lit(None).cast(reports.select(F.struct("knowledge_time", *columns).alias("r")).schema["r"].dataType))
    right = reports.select(key, F.col("knowledge_time").cast("timestamp").alias("_t"), F.lit(0).alias("_kind"), F.struct("knowledge_time", *columns).alias("_r"), F.col("report_id").alias("_tie"))
    both = left.withColumn("_tie", F.lit(None).cast("long")).unionByName(right, allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy("_t", "_kind", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("_known", F.last("_r", ignorenulls=True).over(w)).filter("_kind = 1")
    return out.select(*decisions.columns, *[F.col(f"_known.{c}").alias(f"known_{c}") for c in ("knowledge_time", *columns)])


def prior_snap_share(reports: DataFrame, usage: DataFrame, weeks: int = 4) -> DataFrame:
    """Mean snap share of the reported player over the weeks before the report's week.

    The range is an equi join: each usage row is handed to the weeks that look back on it.
    """
    seen = usage.select("player_id", "season", "snap_pct", F.explode(F.sequence(F.col("week") + 1, F.col("week") + weeks)).alias("week"))
    share = seen.groupBy("player_id", "season", "week").agg(F.avg("snap_pct").alias("prior_snap"))
    return reports.join(share, ["player_id", "season", "week"], "left")


def availability_summary(reports: DataFrame, usage: DataFrame) -> DataFrame:
    """Per team and week: players out and questionable, whether a quarterback is out, snap share missing."""
    needed = reports.filter(regular_season(F.col("season_type"))).select("report_id", "player_id", "season", "week", "team", "report_status", "position", "knowledge_time")
    met = prior_snap_share(latest_reports(needed, "player_id", "season", "week"), usage)
    out = F.col("report_status") == "Out"
    return met.groupBy("season", "week", "team").agg(
        F.count_if(out).alias("n_out"), F.count_if(F.col("report_status") == "Questionable").alias("n_questionable"),
        F.max(F.when(out & (F.col("position") == "QB"), 1).otherwise(0)).alias("qb_out"), F.coalesce(F.sum(F.when(out, F.col("prior_snap"))), F.lit(0.0)).alias("snap_share_out"))


def report_crosstab(reports: DataFrame, usage: DataFrame) -> DataFrame:
    """Active rate and mean snap share by status and practice of the final report."""
    final = latest_reports(reports, "player_id", "season", "week")
    met = final.join(usage.select("player_id", "season", "week", "snap_pct"), ["player_id", "season", "week"], "left")
    return met.groupBy("report_status", "practice_status").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("snap_pct").isNotNull().cast("double")).alias("active_rate"), F.avg("snap_pct").alias("mean_snap"))


def team_game_context(games: DataFrame) -> DataFrame:
    """A row for each side of a game, with its implied total from the closing line (home favoured is positive)."""
    half = F.col("spread_line") / 2.0
    side = lambda team, other, home, sign: F.struct(F.col(team).alias("team"), F.col(other).alias("opponent"), F.lit(home).alias("is_home"), (F.col("total_line") / 2.0 + sign * half).alias("implied_total"))
    both = games.withColumn("s", F.explode(F.array(side("home_team", "away_team", 1, 1.0), side("away_team", "home_team", 0, -1.0))))
    return both.select("game_id", "season", "week", "s.*", F.abs("spread_line").alias("abs_spread"))


def kickoff_slot(kickoff: Column) -> Column:
    """early before 17, late before 21, else primetime, by the hour of the session's time zone; early without a kickoff."""
    h = F.hour(kickoff)
    return F.when(kickoff.isNull() | (h < 17), "early").when(h < 21, "late").otherwise("primetime")


def report_panel(reports: DataFrame, usage: DataFrame) -> DataFrame:
    """The final report of each player-week with form before it and whether the player was active.

    Only seasons with any usage count: there a missing usage row means inactive, elsewhere nothing.
    """
    final = latest_reports(reports.filter(regular_season(F.col("season_type"))), "player_id", "season", "week")
    known = final.join(F.broadcast(usage.select("season").distinct()), "season", "left_semi")
    form = prior_snap_share(known, usage).join(usage.select("player_id", "season", "week", "snap_pct"), ["player_id", "season", "week"], "left")
    return form.withColumn("active", F.col("snap_pct").isNotNull().cast("int"))


def resolve_by_unique_name(reports: DataFrame, players: DataFrame, name_key: str = "name_key") -> DataFrame:
    """Null player ids filled from names that belong to exactly one id."""
    unique = players.groupBy(name_key).agg(F.min("player_id").alias("_id"), F.max("player_id").alias("_max")).filter(F.col("_id") == F.col("_max"))
    return reports.join(unique.select(name_key, "_id"), name_key, "left").withColumn("player_id", F.coalesce("player_id", "_id")).drop("_id")
