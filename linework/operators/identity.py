"""Names to ids: never guessed. What is ambiguous is kept and counted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import normal_name


def name_index(players: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """(name_key, player_id, team) of players and aliases."""
    own = players.select(normal_name(F.col("player_name")).alias("name_key"), "player_id", "team")
    if aliases is not None:
        own = own.unionByName(aliases.select(normal_name(F.col("alias")).alias("name_key"), "player_id", F.lit(None).cast("string").alias("team")))
    return own.filter("name_key <> ''").distinct()


def resolve_players(records: DataFrame, players: DataFrame, aliases: DataFrame | None = None, *, foreign: str = "^(sleeper|espn):") -> DataFrame:
    """``records`` (player_id, player_name, team, ...) with ``resolved_id`` and ``status``.

    A native id stays; else a name with one id; else the one id of that name on the record's
    team; else the record is ambiguous or unresolved and keeps what it had. Candidates are
    counted before the join, so a common name adds one row to a record, not one for each player.
    """
    index = name_index(players, aliases)
    by_name = index.groupBy("name_key").agg(F.count_distinct("player_id").alias("n_name"), F.min("player_id").alias("name_id"))
    by_team = index.filter("team is not null").groupBy("name_key", F.col("team").alias("_team")).agg(F.count_distinct("player_id").alias("n_team"), F.min("player_id").alias("team_id"))
    rows = records.withColumn("name_key", normal_name(F.col("player_name"))).join(by_name, "name_key", "left")
    rows = rows.join(by_team.withColumnRenamed("name_key", "_key"), (F.col("name_key") == F.col("_key")) & (F.col("team") == F.col("_team")), "left")
    native = F.col("player_id").isNotNull() & ~F.col("player_id").rlike(foreign)
    status = F.when(native, "native").when(F.col("n_name").isNull(), "unresolved").when(F.col("n_name") == 1, "by_name").when(F.col("n_team") == 1, "by_name_team").otherwise("ambiguous")
    rows = rows.withColumn("status", status)
    found = F.when(F.col("status") == "by_name", F.col("name_id")).when(F.col("status") == "by_name_team", F.col("team_id")).otherwise(F.col("player_id"))
    return rows.withColumn("resolved_id", found).select(*records.columns, "resolved_id", "status")


def resolution_counts(resolved: DataFrame) -> DataFrame:
    return resolved.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def link_events(events: DataFrame, games: DataFrame) -> DataFrame:
    """Feed events (event_id, home_team, away_team, commence_at) with their game within a day, or null.

    The day range is three equi keys; of several games the nearest kickoff, then the least id, wins.
    """
    days = events.withColumn("day", F.explode(F.array(*[F.date_add(F.to_date("commence_at"), k) for k in (-1, 0, 1)])))
    met = days.join(games.filter("kickoff_utc is not null").select("game_id", "home_team", "away_team", "kickoff_utc", F.to_date("kickoff_utc").alias("day")), ["home_team", "away_team", "day"])
    gap = F.abs(F.unix_timestamp("kickoff_utc") - F.unix_timestamp("commence_at"))
    best = met.groupBy("event_id").agg(F.min_by("game_id", F.struct(gap, "game_id")).alias("game_id"))
    return events.join(best, "event_id", "left")


def map_quotes(rows: DataFrame, links: DataFrame, players: DataFrame) -> DataFrame:
    """Flattened quotes with game and player ids; ``mapped`` says ok, no_game, no_player or ambiguous_player."""
    ids = name_index(players).groupBy("name_key").agg(F.count_distinct("player_id").alias("n"), F.min("player_id").alias("_pid"))
    met = rows.join(links.select("event_id", "game_id"), "event_id", "left").withColumn("name_key", normal_name(F.col("player_name"))).join(ids, "name_key", "left")
    prop = F.col("player_name") != ""
    mapped = F.when(F.col("game_id").isNull(), "no_game").when(prop & F.col("n").isNull(), "no_player").when(prop & (F.col("n") > 1), "ambiguous_player").otherwise("ok")
    return met.withColumn("player_id", F.when(prop, F.when(F.col("n") == 1, F.col("_pid"))).otherwise("")).withColumn("mapped", mapped).drop("name_key", "n", "_pid")


def missing_weather(games: DataFrame, readings: DataFrame) -> DataFrame:
    """Games without a reading; unlike NOT IN, a null game id among the readings hides nothing."""
    return games.join(readings.select("game_id"), "game_id", "left_anti")
