"""Point-in-time unit ratings: decayed sums, one small ridge solve for each cutoff, priors, shrinkage."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.odds import shrink

# Fitted shrinkage, in plays.
FITTED_K = {"all": 240.0, "pass": 240.0, "rush": 120.0}
REGRESSION = 0.55


def with_all_class(plays: DataFrame) -> DataFrame:
    return plays.withColumn("play_class", F.explode(F.array("play_class", F.lit("all"))))


def decayed_sums(plays: DataFrame, decay: float = 0.93) -> DataFrame:
    """For each cutoff week and pair of units: decayed weight, weighted epa and plays of earlier weeks.

    Plays are summed by week first, once; the class of all plays adds up these cells. Each weekly cell is
    then handed to the later weeks of its season, at most a season's weeks for a cell. The last week
    comes from the cells too: a window holds a season's, as many as pairs of units and weeks. Cells of
    unknown units or seasons count for nothing; they go after the window, as a filter before it would work
    out the keys of every play twice.
    """
    cell = ["season", "week", "play_class", "offense", "defense"]
    known = F.col("season").isNotNull() & F.col("offense").isNotNull() & F.col("defense").isNotNull()
    summed = plays.groupBy(*cell).agg(F.sum("epa").alias("epa"), F.count(F.lit(1)).alias("n"))
    weekly = with_all_class(summed).groupBy(*cell).agg(F.sum("epa").alias("epa"), F.sum("n").alias("n"))
    last = weekly.withColumn("last_week", F.max(F.when(known, F.col("week"))).over(Window.partitionBy("season")))
    later = last.filter(known & (F.col("week") < F.col("last_week"))).withColumn("cutoff", F.explode(F.sequence(F.col("week") + 1, F.col("last_week"))))
    w = F.pow(F.lit(decay), F.col("cutoff") - F.col("week"))
    return later.groupBy("season", "cutoff", "play_class", "offense", "defense").agg(F.sum(w * F.col("n")).alias("w"), F.sum(w * F.col("epa")).alias("w_epa"), F.sum("n").alias("n"))


def unit_ratings(plays: DataFrame, *, alpha: float = 60.0, decay: float = 0.93, least_plays: int = 200) -> DataFrame:
    """(season, week, play_class, team, off_rating, def_rating, off_plays, def_plays, confident).

    Weighted ridge of epa on offense + defense + an unpenalised intercept. The sums by pair of
    units are the normal equations, so only cells move between tasks, and a group is as large as
    the square of the number of teams.
    """

    def solve(cells: pd.DataFrame) -> pd.DataFrame:
        if cells["n"].sum() < least_plays:
            return pd.DataFrame(columns=["season", "week", "play_class", "team", "off_rating", "def_rating", "off_plays", "def_plays"])
        teams = sorted({*cells["offense"], *cells["defense"]})
        place, k = {t: i for i, t in enumerate(teams)}, len(teams)
        off, dfn = cells["offense"].map(place).to_numpy(), cells["defense"].map(place).to_numpy() + k
        a, b = np.zeros((2 * k + 1, 2 * k + 1)), np.zeros(2 * k + 1)
        ones = np.full(len(cells), 2 * k)
        for i in (off, dfn, ones):
            np.add.at(b, i, cells["w_epa"].to_numpy())
            for j in (off, dfn, ones):
                np.add.at(a, (i, j), cells["w"].to_numpy())
        a[np.arange(2 * k), np.arange(2 * k)] += alpha
        x = np.linalg.solve(a, b)
        n_off = cells.groupby("offense")["n"].sum().reindex(teams, fill_value=0).to_numpy()
        n_def = cells.groupby("defense")["n"].sum().reindex(teams, fill_value=0).to_numpy()
        head = cells.iloc[0]
        return pd.DataFrame({"season": int(head["season"]), "week": int(head["cutoff"]), "play_class": head["play_class"], "team": teams, "off_rating": x[:k], "def_rating": x[k : 2 * k], "off_plays": n_off, "def_plays": n_def})

    schema = "season int, week int, play_class string, team string, off_rating double, def_rating double, off_plays long, def_plays long"
    rated = decayed_sums(plays, decay).groupBy("season", "cutoff", "play_class").applyInPandas(solve, schema)
    return rated.withColumn("confident", (F.col("off_plays") >= 120) & (F.col("def_plays") >= 120))


def build_priors(ratings: DataFrame, regression: float = REGRESSION) -> DataFrame:
    """(season, team, play_class, off_prior, def_prior): last season's final ratings, regressed."""
    final = ratings.groupBy("season", "team", "play_class").agg(F.max_by(F.struct("off_rating", "def_rating"), "week").alias("r"))
    return final.select((F.col("season") + 1).alias("season"), "team", "play_class", (F.col("r.off_rating") * regression).alias("off_prior"), (F.col("r.def_rating") * regression).alias("def_prior"))


def rating_as_of(ratings: DataFrame, priors: DataFrame, k: dict[str, float] = FITTED_K) -> DataFrame:
    """Ratings shrunk to last season's prior by the plays behind them; ``prior_weight`` is the prior's share."""
    strength = F.lit(k["all"])
    for name, value in k.items():
        strength = F.when(F.col("play_class") == name, F.lit(value)).otherwise(strength)
    met = ratings.join(priors, ["season", "team", "play_class"], "left").withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("off_prior", "def_prior")}).withColumn("k", strength)
    return met.withColumns({
        "off_rating": shrink(F.col("off_rating"), F.col("off_plays").cast("double"), F.col("off_prior"), F.col("k")),
        "def_rating": shrink(F.col("def_rating"), F.col("def_plays").cast("double"), F.col("def_prior"), F.col("k")),
        "prior_weight": F.col("k") / (F.col("off_plays") + F.col("k")),
    }).drop("k")


def fit_k(ratings: DataFrame, priors: DataFrame, outcomes: DataFrame, candidates: tuple[float, ...] = (30.0, 60.0, 120.0, 240.0, 480.0)) -> DataFrame:
    """Mean absolute error of shrunken ratings against what came after, by class and candidate.

    ``outcomes`` is (season, week, team, play_class, actual). Candidates are a fixed short list.
    """
    met = ratings.join(priors, ["season", "team", "play_class"], "left").join(outcomes, ["season", "week", "team", "play_class"])
    tried = met.withColumn("k", F.explode(F.array(*[F.lit(float(c)) for c in candidates])))
    guess = shrink(F.col("off_rating"), F.col("off_plays").cast("double"), F.coalesce("off_prior", F.lit(0.0)), F.col("k"))
    return tried.groupBy("play_class", "k").agg(F.avg(F.abs(guess - F.col("actual"))).alias("mae"), F.count(F.lit(1)).alias("n"))


def matchups(games: DataFrame, ratings: DataFrame) -> DataFrame:
    """Each game with both teams' ratings by class, the edge of each offense over the other defense, and the net."""
    classes = ["all", "pass", "rush"]
    wide = ratings.groupBy("season", "week", "team").agg(
        *[F.max(F.when(F.col("play_class") == c, F.col(f"{u}_rating"))).alias(f"{u}_{c}") for c in classes for u in ("off", "def")], F.min(F.col("confident").cast("int")).alias("sure"))
    side = lambda who: wide.select("season", "week", F.col("team").alias(f"{who}_team"), *[F.col(c).alias(f"{who}_{c}") for c in wide.columns[3:]])
    met = games.join(side("home"), ["season", "week", "home_team"], "left").join(side("away"), ["season", "week", "away_team"], "left")
    for c in classes:
        met = met.withColumn(f"home_edge_{c}", F.col(f"home_off_{c}") - F.col(f"away_def_{c}")).withColumn(f"away_edge_{c}", F.col(f"away_off_{c}") - F.col(f"home_def_{c}"))
    return met.withColumn("net_edge", F.col("home_edge_all") - F.col("away_edge_all")).withColumn("confident", F.coalesce((F.col("home_sure") == 1) & (F.col("away_sure") == 1), F.lit(False)))
