"""What practice reports add to the game status: chance to play, and usage of those who do."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .metrics import auc, binary_metrics
from .panel import latest_reports, regular_season
from .validate import seasons_of

# Positions whose usage is measured, and what practices and game statuses are called, with their codes.
POSITIONS = ("QB", "RB", "WR", "TE")
PRACTICES = {"full": ("full participation in practice", "full", "fp"), "limited": ("limited participation in practice", "limited", "lp"), "none": ("did not participate in practice", "out (definitely will not play)", "dnp")}
STATUSES = ("Out", "Doubtful", "Questionable", "Probable")
FORM = ["prior_usage_3", "prior_usage_8", "prior_active_3"]
BASE = [*FORM, *[f"pos_{p.lower()}" for p in POSITIONS], *[f"status_{s.lower()}" for s in STATUSES], "status_none"]
PRACTICE = [*[f"practice_{p}" for p in PRACTICES], "practice_missing"]
#: Least share of reports with a practice status that is understood.
LEAST_PRACTICE = 0.5
#: Least share of the rows of an era with snap counts for these to say who was active.
LEAST_SNAPS = 0.5


def practice_norm(status: Column) -> Column:
    """full, limited or none, by what the feeds call them; else null."""
    said = F.lower(F.trim(status))
    return reduce(lambda out, name: out.when(said.isin(*PRACTICES[name]), name), PRACTICES, F.when(F.lit(False), F.lit(None).cast("string")))


def reported_weeks(reports: DataFrame, usage: DataFrame, snaps: DataFrame, crosswalk: DataFrame | None = None) -> DataFrame:
    """The final regular-season report of each player's week with usage share and snap share.

    ``reports`` need a player_id; ``usage`` is (player_id, season, week, usage_share) and a missing row is none.
    ``snaps`` has player_id, or ``source_id`` that ``crosswalk`` (source_id, player_id) maps: snaps of unknown
    ids are left out, as a player without snaps would be taken for inactive. Several rows of one key are added up for usage,
    and the greatest counts for snaps, so that joins never multiply reports.
    """
    key = ["player_id", "season", "week"]
    final = latest_reports(reports.filter(regular_season(F.col("season_type")) & F.col("player_id").isNotNull()), *key)
    skilled = final.filter(F.col("position").isin(*POSITIONS))
    share = usage.groupBy(*key).agg(F.sum("usage_share").alias("usage_share"))
    if crosswalk is not None:
        snaps = snaps.drop("player_id").join(crosswalk.groupBy("source_id").agg(F.min("player_id").alias("player_id")), "source_id")
    played = snaps.groupBy(*key).agg(F.max("snap_pct").alias("snap_pct"))
    met = skilled.join(share, key, "left").join(played, key, "left")
    return met.select("report_id", *key, "position", "report_status", practice_norm(F.col("practice_status")).alias("practice"), F.coalesce("usage_share", F.lit(0.0)).alias("usage_share"), "snap_pct")


def coverage(weeks: DataFrame) -> DataFrame:
    """Checks (name, value, least, passed): practices that are understood, kinds of them, and snaps within their era."""
    era = weeks.join(weeks.filter("snap_pct is not null").agg(F.min("season").alias("_era")), F.lit(True))  # one row
    wide = era.agg(
        F.coalesce(F.avg(F.col("practice").isNotNull().cast("double")), F.lit(0.0)).alias("practice_understood"), F.count_distinct("practice").cast("double").alias("practice_kinds"),
        F.coalesce(F.avg(F.when(F.col("season") >= F.col("_era"), F.col("snap_pct").isNotNull().cast("double"))), F.lit(0.0)).alias("snaps_in_era"),
    )
    least = {"practice_understood": LEAST_PRACTICE, "practice_kinds": 2.0, "snaps_in_era": LEAST_SNAPS}
    rows = wide.select(F.explode(F.array(*[F.struct(F.lit(k).alias("name"), F.col(k).alias("value"), F.lit(v).alias("least")) for k, v in least.items()])).alias("c")).select("c.*")
    return rows.withColumn("passed", F.col("value") >= F.col("least"))


def practice_panel(weeks: DataFrame) -> DataFrame:
    """``reported_weeks`` with who was active, form before and one column for each position, status and practice.

    Where snaps cover their era, only its seasons count and active means any snap; else all seasons count and
    active means any usage: two meanings never mix. Form is of the player's reported weeks before, so the first
    one has none and goes. The columns are the same whatever values occur.
    """
    era = weeks.filter("snap_pct is not null").agg(F.min("season").alias("_era"))
    share = weeks.join(era, F.lit(True)).agg(F.first("_era").alias("_era"), F.avg(F.when(F.col("season") >= F.col("_era"), F.col("snap_pct").isNotNull().cast("double"))).alias("_share"))
    met = weeks.join(share, F.lit(True)).withColumn("_snaps", F.coalesce(F.col("_share") > LEAST_SNAPS, F.lit(False)))  # one row
    kept = met.filter(~F.col("_snaps") | (F.col("season") >= F.col("_era")))
    active = F.when(F.col("_snaps"), F.coalesce("snap_pct", F.lit(0.0)) > 0).otherwise(F.col("usage_share") > 0).cast("int")
    order = Window.partitionBy("player_id").orderBy("season", "week")
    before = lambda c, n: F.avg(c).over(order.rowsBetween(-n, -1))
    formed = kept.withColumn("active", active).withColumns({"prior_usage_3": before("usage_share", 3), "prior_usage_8": before("usage_share", 8), "prior_active_3": before("active", 3)})
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    flags = {f"pos_{p.lower()}": flag(F.col("position") == p) for p in POSITIONS} | {f"status_{s.lower()}": flag(F.col("report_status") == s) for s in STATUSES}
    flags |= {"status_none": flag(F.coalesce(~F.col("report_status").isin(*STATUSES), F.lit(True)))}
    flags |= {f"practice_{p}": flag(F.col("practice") == p) for p in PRACTICES} | {"practice_missing": F.col("practice").isNull().cast("double")}
    return formed.filter("prior_usage_3 is not null").withColumns(flags).select("report_id", "player_id", "season", "week", "report_status", "practice", "active", "usage_share", *BASE, *PRACTICE)


def hurdle(train: DataFrame, test: DataFrame, features: list[str]) -> DataFrame:
    """``test`` with ``p`` (chance to be active), ``usage_if_active`` and ``expected_usage``, their product."""
    seen = VectorAssembler(inputCols=features, outputCol="features")
    chance = Pipeline(stages=[seen, LogisticRegression(labelCol="active", regParam=0.001, predictionCol="_class", rawPredictionCol="_raw", probabilityCol="_chance")]).fit(train)
    amount = LinearRegression(labelCol="usage_share", regParam=0.001, solver="normal", predictionCol="usage_if_active").fit(seen.transform(train.filter("active = 1")))
    out = amount.transform(chance.transform(test)).withColumn("p", vector_to_array("_chance")[1])
    return out.withColumn("expected_usage", F.col("p") * F.greatest("usage_if_active", F.lit(0.0))).drop("features", "_class", "_raw", "_chance")


def practice_signal(panel: DataFrame, *, least_train: int = 3, least_test: int = 50) -> DataFrame:
    """Both arms by season, each by the seasons before it: (season, n, arm, brier, log_loss, auc, usage_mae).

    The arms differ in the practice columns only. ``usage_mae`` is over those who were active. Seasons with fewer
    than ``least_test`` rows are not tested. The loop is over seasons; all rows stay on the executors.
    """
    seasons, parts = seasons_of(panel), []
    sizes = {row["season"]: row["count"] for row in panel.groupBy("season").count().collect()}  # one row a season
    for s in seasons[least_train:]:
        if sizes[s] < least_test:
            continue
        train, test = panel.filter(F.col("season") < s), panel.filter(F.col("season") == s)
        for arm, features in (("status", BASE), ("practice", BASE + PRACTICE)):
            parts.append(hurdle(train, test, features).select("season", "active", "usage_share", "p", "usage_if_active", F.lit(arm).alias("arm")))
    if not parts:
        raise ValueError(f"needs more than {least_train} seasons with {least_test} rows, has {len(seasons)}")
    scored = reduce(DataFrame.unionByName, parts)
    losses = binary_metrics(scored, "active", "p", "arm", "season").select("arm", "season", "n", "brier", "log_loss")
    missed = scored.groupBy("arm", "season").agg(F.avg(F.when(F.col("active") == 1, F.abs(F.col("usage_share") - F.col("usage_if_active")))).alias("usage_mae"))
    return losses.join(auc(scored, "active", "p", "arm", "season"), ["arm", "season"], "left").join(missed, ["arm", "season"]).select("season", "n", "arm", "brier", "log_loss", "auc", "usage_mae")


def practice_gain(signal: DataFrame) -> DataFrame:
    """By season what practice adds: (season, n, d_brier, d_log_loss, d_auc, d_usage_mae, helped); less loss is a negative difference."""
    measures = ["brier", "log_loss", "auc", "usage_mae"]
    of = lambda arm, m: F.max(F.when(F.col("arm") == arm, F.col(m)))
    gain = signal.groupBy("season").agg(F.max("n").alias("n"), *[(of("practice", m) - of("status", m)).alias(f"d_{m}") for m in measures])
    return gain.withColumn("helped", F.col("d_brier") < 0)
