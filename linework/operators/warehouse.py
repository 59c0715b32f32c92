"""Tables derived from play-by-play: flagged plays, team and player weeks, identity checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def depth_bucket(air_yards: Column) -> Column:
    """behind, short, intermediate or deep; null stays null."""
    return F.when(air_yards < 0, "behind").when(air_yards <= 9, "short").when(air_yards <= 19, "intermediate").when(air_yards.isNotNull(), "deep")


def plays(raw: DataFrame) -> DataFrame:
    """Plays of both known teams and a known class, with the flags that the aggregates use.

    ``neutral`` is a win chance from 10 to 90 percent and ``explosive`` a gain of 20 yards or more; both are 0 where
    the source has no ``wp`` or ``yards_gained``.
    """
    known = lambda name, test: F.coalesce(test, F.lit(False)).cast("int") if name in raw.columns else F.lit(0)
    real = raw.filter(F.col("offense").isNotNull() & F.col("defense").isNotNull() & F.col("play_class").isin("pass", "rush"))
    return real.withColumns({
        "success": (F.coalesce(F.col("epa"), F.lit(0.0)) > 0).cast("int"), "early_down": (F.col("down") <= 2).cast("int"),
        "red_zone": (F.col("yardline_100") <= 20).cast("int"), "depth_bucket": depth_bucket(F.col("air_yards")),
        "neutral": known("wp", F.col("wp").between(0.10, 0.90)), "explosive": known("yards_gained", F.col("yards_gained") >= 20),
    })


def _mean(value: str, *conditions: Column) -> Column:
    test = F.lit(True)
    for c in conditions:
        test = test & c
    return F.avg(F.when(test, F.col(value).cast("double")))


def team_weeks(flagged: DataFrame) -> DataFrame:
    """Measures of each offense in each game: counts, conditional means, pass rate."""
    passes, rushes = F.col("play_class") == "pass", F.col("play_class") == "rush"
    return flagged.groupBy("season", "week", F.col("offense").alias("team"), F.col("defense").alias("opponent"), "game_id").agg(
        F.count(F.lit(1)).alias("plays"), F.avg("epa").alias("off_epa"), _mean("epa", passes).alias("off_pass_epa"), _mean("epa", rushes).alias("off_rush_epa"),
        _mean("epa", F.col("early_down") == 1).alias("off_epa_early"), F.avg(F.col("success").cast("double")).alias("off_success"),
        _mean("success", passes).alias("off_pass_success"), _mean("success", rushes).alias("off_rush_success"), _mean("epa", F.col("red_zone") == 1).alias("off_epa_redzone"),
        (F.sum(passes.cast("double")) / F.count(F.lit(1))).alias("pass_rate"), _mean("air_yards", passes).alias("avg_air_yards"),
    )


def defense_depth_weeks(flagged: DataFrame) -> DataFrame:
    rows = flagged.filter("play_class = 'pass' and depth_bucket is not null")
    return rows.groupBy("season", "week", F.col("defense").alias("team"), "game_id", "depth_bucket").agg(
        F.count(F.lit(1)).alias("plays"), F.avg("epa").alias("epa_allowed"), F.avg(F.col("success").cast("double")).alias("success_allowed"))


def team_totals(flagged: DataFrame) -> DataFrame:
    """Attributable targets, carries and air yards of each offense in each game."""
    passes, rushes = (F.col("play_class") == "pass") & F.col("player_id").isNotNull(), (F.col("play_class") == "rush") & F.col("player_id").isNotNull()
    return flagged.groupBy("game_id", F.col("offense").alias("team")).agg(
        F.sum(passes.cast("long")).alias("team_targets"), F.sum(rushes.cast("long")).alias("team_carries"), F.sum(F.when(passes, F.coalesce("air_yards", F.lit(0))).otherwise(0)).alias("team_air_yards"))


def receiving_usage(flagged: DataFrame) -> DataFrame:
    rows = flagged.filter("play_class = 'pass' and player_id is not null")
    return rows.groupBy("game_id", "season", "week", F.col("offense").alias("team"), "player_id").agg(
        F.count(F.lit(1)).alias("targets"), F.sum(F.coalesce("air_yards", F.lit(0))).alias("air_yards"), F.avg("epa").alias("epa_per_target"))


def rushing_usage(flagged: DataFrame) -> DataFrame:
    rows = flagged.filter("play_class = 'rush' and player_id is not null")
    return rows.groupBy("game_id", "season", "week", F.col("offense").alias("team"), "player_id").agg(F.count(F.lit(1)).alias("carries"), F.avg("epa").alias("epa_per_carry"))


def player_weeks(flagged: DataFrame) -> DataFrame:
    """Usage and shares of each player in each game; keys come from either side of the full join."""
    key = ["game_id", "season", "week", "team", "player_id"]
    both = receiving_usage(flagged).join(rushing_usage(flagged), key, "full").join(team_totals(flagged), ["game_id", "team"], "left")
    share = lambda part, whole: F.when(F.col(whole) != 0, F.coalesce(part, F.lit(0)).cast("double") / F.col(whole))
    return both.select(
        *key, *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("targets", "carries", "air_yards")], "epa_per_target", "epa_per_carry",
        share("targets", "team_targets").alias("target_share"), share("carries", "team_carries").alias("carry_share"), share("air_yards", "team_air_yards").alias("air_yards_share"),
    )


def id_crosswalk(pairs: DataFrame, source: str, target: str) -> DataFrame:
    """(source, target) where a source id has exactly one target; ambiguous ones are left out."""
    return pairs.filter(F.col(source).isNotNull() & F.col(target).isNotNull()).groupBy(source).agg(F.min(target).alias(target), F.max(target).alias("_max")).filter(F.col(target) == F.col("_max")).drop("_max")


def crosswalk_coverage(rows: DataFrame, crosswalk: DataFrame, source: str, target: str) -> DataFrame:
    """Ids used, ids matched and the rate."""
    used = rows.select(source).distinct().join(crosswalk, source, "left")
    return used.agg(F.count(F.lit(1)).alias("ids"), F.count(target).alias("matched"), (F.count(target) / F.count(F.lit(1))).alias("rate"))


def verify(flagged: DataFrame, weeks: DataFrame) -> DataFrame:
    """Checks as rows (name, value, lo, hi, passed): no table is trusted by its row count alone."""
    base = flagged.agg(F.count(F.lit(1)).cast("double").alias("plays"), F.avg("epa").alias("mean_epa"), F.avg(F.col("success").cast("double")).alias("success_rate"))
    shares = weeks.groupBy("game_id", "team").agg(F.sum("target_share").alias("s"), F.count(F.lit(1)).alias("n"), F.count_distinct("player_id").alias("d"))
    shares = shares.agg(F.avg("s").alias("target_share_sum"), F.sum(F.col("n") - F.col("d")).cast("double").alias("duplicate_keys"))
    limits = [("plays", 1.0, 1e15), ("mean_epa", -0.5, 0.5), ("success_rate", 0.3, 0.6), ("target_share_sum", 0.999, 1.001), ("duplicate_keys", 0.0, 0.0)]
    wide = base.join(F.broadcast(shares))
    rows = wide.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("value"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi")) for n, lo, hi in limits])).alias("c"))
    return rows.select("c.*").withColumn("passed", F.coalesce(F.col("value").between(F.col("lo"), F.col("hi")), F.lit(False)))


def team_situations(flagged: DataFrame) -> DataFrame:
    """(season, team): plays, those in neutral situations and their mean epa, and the share of explosive ones."""
    neutral = F.col("neutral") == 1
    return flagged.groupBy("season", F.col("offense").alias("team")).agg(
        F.count(F.lit(1)).alias("plays"), F.count_if(neutral).alias("neutral_plays"), _mean("epa", neutral).alias("off_epa_neutral"), _mean("explosive").alias("off_explosive_rate"))
