"""The teams: names, roof, place and time zone of the home field, and what feeds call them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Abbreviation, name, roof, latitude, longitude and time zone.
TEAMS = (
    ("ARI", "Arizona Cardinals", "retractable", 33.5277, -112.2626, "America/Phoenix"),
    ("ATL", "Atlanta Falcons", "retractable", 33.7554, -84.4008, "America/New_York"),
    ("BAL", "Baltimore Ravens", "outdoor", 39.2780, -76.6227, "America/New_York"),
    ("BUF", "Buffalo Bills", "outdoor", 42.7738, -78.7870, "America/New_York"),
    ("CAR", "Carolina Panthers", "outdoor", 35.2258, -80.8528, "America/New_York"),
    ("CHI", "Chicago Bears", "outdoor", 41.8623, -87.6167, "America/Chicago"),
    ("CIN", "Cincinnati Bengals", "outdoor", 39.0955, -84.5161, "America/New_York"),
    ("CLE", "Cleveland Browns", "outdoor", 41.5061, -81.6995, "America/New_York"),
    ("DAL", "Dallas Cowboys", "retractable", 32.7473, -97.0945, "America/Chicago"),
    ("DEN", "Denver Broncos", "outdoor", 39.7439, -105.0201, "America/Denver"),
    ("DET", "Detroit Lions", "dome", 42.3400, -83.0456, "America/New_York"),
    ("GB", "Green Bay Packers", "outdoor", 44.5013, -88.0622, "America/Chicago"),
    ("HOU", "Houston Texans", "retractable", 29.6847, -95.4107, "America/Chicago"),
    ("IND", "Indianapolis Colts", "retractable", 39.7601, -86.1639, "America/New_York"),
    ("JAX", "Jacksonville Jaguars", "outdoor", 30.3239, -81.6373, "America/New_York"),
    ("KC", "Kansas City Chiefs", "outdoor", 39.0489, -94.4839, "America/Chicago"),
    ("LAC", "Los Angeles Chargers", "dome", 33.9535, -118.3392, "America/Los_Angeles"),
    ("LAR", "Los Angeles Rams", "dome", 33.9535, -118.3392, "America/Los_Angeles"),
    ("LV", "Las Vegas Raiders", "dome", 36.0909, -115.1833, "America/Los_Angeles"),
    ("MIA", "Miami Dolphins", "outdoor", 25.9580, -80.2389, "America/New_York"),
    ("MIN", "Minnesota Vikings", "dome", 44.9736, -93.2575, "America/Chicago"),
    ("NE", "New England Patriots", "outdoor", 42.0909, -71.2643, "America/New_York"),
    ("NO", "New Orleans Saints", "dome", 29.9511, -90.0812, "America/Chicago"),
    ("NYG", "New York Giants", "outdoor", 40.8135, -74.0745, "America/New_York"),
    ("NYJ", "New York Jets", "outdoor", 40.8135, -74.0745, "America/New_York"),
    ("PHI", "Philadelphia Eagles", "outdoor", 39.9008, -75.1675, "America/New_York"),
    ("PIT", "Pittsburgh Steelers", "outdoor", 40.4468, -80.0158, "America/New_York"),
    ("SEA", "Seattle Seahawks", "outdoor", 47.5952, -122.3316, "America/Los_Angeles"),
    ("SF", "San Francisco 49ers", "outdoor", 37.4033, -121.9694, "America/Los_Angeles"),
    ("TB", "Tampa Bay Buccaneers", "outdoor", 27.9759, -82.5033, "America/New_York"),
    ("TEN", "Tennessee Titans", "outdoor", 36.1665, -86.7713, "America/Chicago"),
    ("WAS", "Washington Commanders", "outdoor", 38.9077, -76.8645, "America/New_York"),
)
# Abbreviations of other feeds and of teams before they moved.
MOVED = {"OAK": "LV", "SD": "LAC", "STL": "LAR", "LA": "LAR", "WSH": "WAS", "WFT": "WAS", "ARZ": "ARI", "BLT": "BAL", "CLV": "CLE", "HST": "HOU", "SL": "LAR", "PHO": "ARI"}


def team_dim(spark: SparkSession) -> DataFrame:
    """(team, full_name, nickname, roof, lat, lon, tz), a row for each of the 32 teams."""
    rows = spark.createDataFrame(list(TEAMS), "team string, full_name string, roof string, lat double, lon double, tz string")
    return rows.select("team", "full_name", F.element_at(F.split("full_name", " "), -1).alias("nickname"), "roof", "lat", "lon", "tz")


def team_aliases(spark: SparkSession) -> DataFrame:
    """(alias, team) over abbreviation, former abbreviation, full name and nickname."""
    named = team_dim(spark).select(F.explode(F.array("team", "full_name", "nickname")).alias("alias"), "team")
    return named.unionByName(spark.createDataFrame(list(MOVED.items()), "alias string, team string")).distinct()


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[key]


def resolve_team(value: Column) -> Column:
    """The team that a feed means, else null: by abbreviation, former abbreviation, full name, then last word.

    Case and outer blanks do not count. A city alone names no team.
    """
    bare = F.trim(value)
    upper, lower = F.upper(bare), F.lower(bare)
    full = {name.lower(): abbr for abbr, name, *_ in TEAMS}
    last = {name.split()[-1].lower(): abbr for abbr, name, *_ in TEAMS}
    return F.coalesce(_lookup({abbr: abbr for abbr, *_ in TEAMS}, upper), _lookup(MOVED, upper), _lookup(full, lower), _lookup(last, F.element_at(F.split(lower, r"\s+"), -1)))


def with_home_field(games: DataFrame, team_col: str = "home_team") -> DataFrame:
    """Games with ``roof``, ``lat``, ``lon`` and ``tz`` of the home team's field; null for unknown teams."""
    spots = team_dim(games.sparkSession).select(F.col("team").alias(team_col), *[F.col(c) for c in ("roof", "lat", "lon", "tz") if c not in games.columns])
    return games.join(spots, team_col, "left")
