"""Landed feeds (CSV, JSON) to rows. Schemas are stated, never inferred; drifting columns are reported."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import names

_STRING = T.StringType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


# The shapes of the feeds.
OUTCOME = _struct(name=_STRING, description=_STRING, price=T.DoubleType(), point=T.DoubleType())
MARKET = _struct(key=_STRING, last_update=_STRING, outcomes=T.ArrayType(OUTCOME))
BOOKMAKER = _struct(key=_STRING, last_update=_STRING, markets=T.ArrayType(MARKET))
EVENT = _struct(id=_STRING, home_team=_STRING, away_team=_STRING, commence_time=_STRING, bookmakers=T.ArrayType(BOOKMAKER))
PLAYER = _struct(gsis_id=_STRING, full_name=_STRING, first_name=_STRING, last_name=_STRING, team=_STRING, position=_STRING, injury_status=_STRING, practice_participation=_STRING, injury_body_part=_STRING)
HOURLY = _struct(time=T.ArrayType(_STRING), temperature_2m=T.ArrayType(T.DoubleType()), wind_speed_10m=T.ArrayType(T.DoubleType()), wind_gusts_10m=T.ArrayType(T.DoubleType()), precipitation=T.ArrayType(T.DoubleType()))


def resolve_columns(df: DataFrame, wanted: dict[str, list[str]]) -> tuple[DataFrame, list[str]]:
    """Each wanted column from the first candidate that exists, else null; and those that had none."""
    columns, missing = [], []
    for name, candidates in wanted.items():
        found = next((c for c in candidates if c in df.columns), None)
        columns.append((F.col(f"`{found}`") if found else F.lit(None)).alias(name))
        if not found:
            missing.append(name)
    return df.select(*columns), missing


def load_players(df: DataFrame) -> DataFrame:
    """(player_id, full_name, team, position) as text from drifting columns, without null ids."""
    out, _ = resolve_columns(df, {"player_id": ["gsis_id", "player_id", "id"], "full_name": ["display_name", "full_name", "player_name", "name"], "team": ["latest_team", "team", "team_abbr"], "position": ["position", "pos"]})
    return out.select(*[F.col(c).cast("string") for c in out.columns]).filter("player_id is not null and player_id <> ''")


SCHEDULE = _struct(game_id=_STRING, season=_STRING, week=_STRING, game_type=_STRING, gameday=_STRING, gametime=_STRING, home_team=_STRING, away_team=_STRING, home_score=_STRING, away_score=_STRING, spread_line=_STRING, total_line=_STRING, roof=_STRING)


def eastern_to_utc(day: Column, time: Column) -> Column:
    """Kickoff in UTC from a day and an Eastern wall clock; null without a time."""
    return F.to_utc_timestamp(F.try_to_timestamp(F.concat_ws(" ", day, time), F.lit("yyyy-MM-dd HH:mm")), "America/New_York")


def load_schedule(spark: SparkSession, path: str) -> DataFrame:
    """Typed games from a schedule CSV with a header, in the column order of ``SCHEDULE``."""
    raw = spark.read.schema(SCHEDULE).csv(path, header=True)
    number = lambda c, kind: F.expr(f"try_cast({c} as {kind})").alias(c)
    final = F.expr("try_cast(home_score as int) is not null and try_cast(away_score as int) is not null")
    return raw.select(
        "game_id", number("season", "int"), number("week", "int"), F.col("game_type").alias("season_type"), "home_team", "away_team", number("home_score", "int"), number("away_score", "int"), number("spread_line", "double"), number("total_line", "double"), "roof",
        F.to_date("gameday").alias("game_day"), F.when(F.col("gametime") != "", eastern_to_utc(F.col("gameday"), F.col("gametime"))).alias("kickoff_utc"), F.when(final, "final").otherwise("scheduled").alias("status"),
    )


def repair_kickoffs(games: DataFrame, column: str = "kickoff") -> DataFrame:
    """Naive Eastern text to UTC text with an offset; text that has one stays, so a second run changes nothing."""
    naive = F.col(column).rlike(r"^\d{4}-\d\d-\d\d[T ]\d\d:\d\d(:\d\d)?$")
    utc = F.to_utc_timestamp(F.to_timestamp(F.regexp_replace(column, "T", " ")), "America/New_York")
    return games.withColumn(column, F.when(naive, F.concat(F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))).otherwise(F.col(column)))


def flatten_odds_events(events: DataFrame, json: str = "json") -> DataFrame:
    """A row for each priced outcome of each market of each bookmaker; a missing point is line 0."""
    ev = events.withColumn("e", F.from_json(json, EVENT))
    books = ev.select(*[c for c in events.columns if c != json], "e.id", "e.home_team", "e.away_team", F.explode("e.bookmakers").alias("b"))
    markets = books.select("*", F.explode("b.markets").alias("m"))
    rows = markets.select("*", F.explode("m.outcomes").alias("o")).filter("o.price is not null")
    name = F.trim(F.coalesce("o.name", F.lit("")))
    side = F.when(F.lower(name).isin("over", "under", "yes", "no"), F.lower(name)).when(name == F.col("home_team"), "home").when(name == F.col("away_team"), "away").when(name == "", "unknown").otherwise(F.lower(name))
    return rows.select(
        *[c for c in events.columns if c != json], F.col("id").alias("event_id"), "home_team", "away_team", F.col("m.key").alias("market_type"), F.trim(F.coalesce("o.description", F.lit(""))).alias("player_name"),
        side.alias("side"), F.coalesce("o.point", F.lit(0.0)).alias("line"), F.col("b.key").alias("book"), F.col("o.price").cast("int").alias("price"), F.coalesce("m.last_update", "b.last_update").alias("updated_at"),
    )


def flatten_injury_map(payload: DataFrame, season: int, week: int, json: str = "json", prefix: str = "sleeper") -> DataFrame:
    """A row for each player of a map keyed by the source's id who has a status or a practice note."""
    rows = payload.select(*[c for c in payload.columns if c != json], F.explode(F.from_json(json, T.MapType(_STRING, PLAYER))).alias("key", "p"))
    name = F.coalesce("p.full_name", F.trim(F.concat_ws(" ", "p.first_name", "p.last_name")))
    some = (F.coalesce("p.injury_status", F.lit("")) != "") | (F.coalesce("p.practice_participation", F.lit("")) != "")
    return rows.filter(some & (name != "")).select(
        *[c for c in payload.columns if c != json], F.coalesce("p.gsis_id", F.concat(F.lit(prefix + ":"), "key")).alias("player_id"), name.alias("player_name"), F.col("p.team").alias("team"), F.lit(season).alias("season"), F.lit(week).alias("week"),
        names.game_status(F.col("p.injury_status")).alias("game_status"), names.practice_status(F.col("p.practice_participation")).alias("practice_status"), F.col("p.injury_body_part").alias("body_part"),
    )


GROUP = _struct(team=_STRING, injuries=T.ArrayType(_struct(id=_STRING, name=_STRING, status=_STRING, detail=_STRING)))


def flatten_injury_groups(payload: DataFrame, json: str = "json", prefix: str = "espn") -> DataFrame:
    """The nested form: an array of teams, each with an array of players."""
    rows = payload.select(F.explode(F.from_json(json, T.ArrayType(GROUP))).alias("g")).select("g.team", F.explode("g.injuries").alias("i")).filter("i.name is not null")
    return rows.select(F.concat(F.lit(prefix + ":"), "i.id").alias("player_id"), F.col("i.name").alias("player_name"), "team", names.game_status(F.col("i.status")).alias("game_status"), F.col("i.detail").alias("detail"))


def nearest_hour_weather(payload: DataFrame, json: str = "json", at: str = "kickoff_utc") -> DataFrame:
    """The reading closest to kickoff from parallel hourly arrays; the earlier of two as close."""
    h = payload.withColumn("h", F.from_json(F.get_json_object(json, "$.hourly"), HOURLY))
    hours = F.arrays_zip("h.time", "h.temperature_2m", "h.wind_speed_10m", "h.wind_gusts_10m", "h.precipitation")
    stamped = F.filter(F.transform(hours, lambda x: F.struct(F.abs(F.unix_timestamp(F.try_to_timestamp(F.regexp_replace(x["time"], "T", " "), F.lit("yyyy-MM-dd HH:mm"))) - F.unix_timestamp(at)).alias("gap"), x["time"].alias("time"), x["temperature_2m"].alias("temp_c"), x["wind_speed_10m"].alias("wind_kph"), x["wind_gusts_10m"].alias("gust_kph"), x["precipitation"].alias("precip_mm"))), lambda x: x["gap"].isNotNull())
    best = h.withColumn("w", F.array_min(stamped))
    return best.select(*[c for c in payload.columns if c != json], F.col("w.time").alias("reading_at"), "w.temp_c", "w.wind_kph", "w.gust_kph", "w.precip_mm")


def weather_flags(df: DataFrame) -> DataFrame:
    """Indoor roofs get fixed readings; then high wind, freezing and wet."""
    indoor = F.lower("roof").isin("dome", "closed")
    fixed = df.withColumns({"temp_c": F.when(indoor, 21.0).otherwise(F.col("temp_c")), "wind_kph": F.when(indoor, 0.0).otherwise(F.col("wind_kph")), "gust_kph": F.when(indoor, 0.0).otherwise(F.col("gust_kph")), "precip_mm": F.when(indoor, 0.0).otherwise(F.col("precip_mm"))})
    return fixed.withColumns({"high_wind": F.greatest("wind_kph", "gust_kph") >= 32.0, "freezing": F.col("temp_c") <= 0.0, "wet": F.col("precip_mm") > 0.0})


SIDE = _struct(homeAway=_STRING, score=_STRING, team=_struct(displayName=_STRING))
COMPETITION = _struct(competitors=T.ArrayType(SIDE), status=_struct(period=T.IntegerType(), displayClock=_STRING, type=_struct(state=_STRING)))
SCOREBOARD = _struct(events=T.ArrayType(_struct(date=_STRING, competitions=T.ArrayType(COMPETITION))))


def flatten_scoreboard(payload: DataFrame, teams: DataFrame, games: DataFrame, json: str = "json") -> DataFrame:
    """Live scores, one row for each game that is known by home team, away team and day.

    ``teams`` is (alias, team), a bounded dimension.
    """
    comp = payload.select(F.explode(F.from_json(json, SCOREBOARD)["events"]).alias("e")).select(F.substring("e.date", 1, 10).alias("day"), F.get("e.competitions", F.lit(0)).alias("c"))
    pick = lambda who: F.get(F.filter("c.competitors", lambda s: s["homeAway"] == who), F.lit(0))
    rows = comp.select("day", pick("home").alias("h"), pick("away").alias("a"), F.col("c.status").alias("s")).filter("h is not null and a is not null")
    alias = lambda who: teams.select(F.col("alias").alias(f"{who}_alias"), F.col("team").alias(f"{who}_team"))
    met = rows.withColumn("home_alias", F.col("h.team.displayName")).withColumn("away_alias", F.col("a.team.displayName")).join(alias("home"), "home_alias").join(alias("away"), "away_alias")
    known = games.select("game_id", "home_team", "away_team", F.date_format("kickoff_utc", "yyyy-MM-dd").alias("day"))
    score = lambda who: F.coalesce(F.expr(f"try_cast({who}.score as int)"), F.lit(0))
    return met.join(known, ["home_team", "away_team", "day"]).select("game_id", score("h").alias("home_score"), score("a").alias("away_score"), F.col("s.period").alias("period"), F.col("s.displayClock").alias("clock"), F.col("s.type.state").alias("state"))
