"""The chance that a player's coming game is a bust, from reports and form known before it."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .metrics import calibration_table, expected_calibration_error
from .panel import latest_reports
from .validate import ranked

# What reports and practices say, and the seasons of training, development and hold-out.
REPORTS = {"Doubtful": "report_doubtful", "Questionable": "report_questionable", "Probable": "report_probable"}
PRACTICES = {"Did Not Participate In Practice": "practice_dnp", "Out (Definitely Will Not Play)": "practice_dnp", "Limited Participation in Practice": "practice_limited", "Full Participation in Practice": "practice_full"}
FORM = ("trail_mean", "trail_max", "trail_zero_rate", "last_week_vol", "baseline_vol", "vol_vs_baseline", "trail_n", "week")
CONTEXT = ("abs_spread", "implied_total", "is_home")
FEATURES = (*dict.fromkeys(REPORTS.values()), "report_none", *dict.fromkeys(PRACTICES.values()), "practice_none", *FORM, *CONTEXT)
TRAIN_MAX, DEV_SEASON = 2022, 2023


def bust_matrix(formed: DataFrame, reports: DataFrame, context: DataFrame) -> DataFrame:
    """(player_id, season, week, features, bust): the panel with form before each week, its final report and its game.

    Left out are weeks of players listed Out, on whom nothing is quoted, those without form
    before them, and those whose team has no game context. ``context`` has one row a team and week.
    """
    final = latest_reports(reports.select("player_id", "season", "week", "report_id", "knowledge_time", "report_status", "practice_status"), "player_id", "season", "week").select("player_id", "season", "week", "report_status", "practice_status")
    rows = formed.filter("trail_n > 0").join(final, ["player_id", "season", "week"], "left").filter(F.coalesce("report_status", F.lit("")) != "Out")
    rows = rows.join(context.select("season", "week", "team", *CONTEXT), ["season", "week", "team"])

    def flags(column: str, names: dict[str, str], none: str) -> dict:
        said = F.trim(F.coalesce(column, F.lit("")))
        each = {flag: said.isin(*[k for k, v in names.items() if v == flag]).cast("double") for flag in dict.fromkeys(names.values())}
        return each | {none: (~said.isin(*names)).cast("double")}

    wide = rows.withColumns(flags("report_status", REPORTS, "report_none") | flags("practice_status", PRACTICES, "practice_none") | {"vol_vs_baseline": F.col("last_week_vol") / F.col("baseline_vol")})
    return wide.select("player_id", "season", "week", *[F.col(c).cast("double").alias(c if c != "week" else "week_no") for c in FEATURES], F.col("bust").cast("double").alias("bust"))


COLUMNS = [c if c != "week" else "week_no" for c in FEATURES]


def fit(train: DataFrame, *, trees: bool = True) -> PipelineModel:
    learner = GBTClassifier(labelCol="bust", maxDepth=3, maxIter=20, seed=7) if trees else LogisticRegression(labelCol="bust", regParam=0.01)
    return Pipeline(stages=[VectorAssembler(inputCols=COLUMNS, outputCol="features"), learner]).fit(train)


def scored(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """``rows`` with ``p``, within [0.001, 0.999]."""
    p = F.least(F.greatest(vector_to_array("probability")[1], F.lit(0.001)), F.lit(0.999))
    return model.transform(rows).withColumn("p", p).drop("features", "rawPrediction", "probability", "prediction")


def evaluation(model: PipelineModel, train: DataFrame, test: DataFrame) -> DataFrame:
    """One row: n_train, n_test, base_rate, brier, brier_baseline, log_loss, ece, beats_base.

    The baseline says the base rate of the training rows everywhere; accuracy would flatter it.
    """
    rate = train.agg(F.count(F.lit(1)).alias("n_train"), F.avg("bust").alias("_rate"))
    rows = scored(model, test)
    sums = rows.crossJoin(rate).agg(  # one row
        F.max("n_train").alias("n_train"), F.count(F.lit(1)).alias("n_test"), F.avg("bust").alias("base_rate"), F.avg(F.pow(F.col("p") - F.col("bust"), F.lit(2.0))).alias("brier"),
        F.avg(F.pow(F.col("_rate") - F.col("bust"), F.lit(2.0))).alias("brier_baseline"), F.avg(-F.log(F.when(F.col("bust") == 1, F.col("p")).otherwise(1.0 - F.col("p")))).alias("log_loss"),
    )
    table = calibration_table(rows, "bust", "p", least=20)
    return sums.join(expected_calibration_error(table)).withColumn("beats_base", F.col("brier_baseline") - F.col("brier") > 0.002)


def permutation_importance(model: PipelineModel, test: DataFrame, *, seed: int = 0) -> DataFrame:
    """(feature, importance): how much the Brier score rises when a feature comes from another row of the season.

    One join gives every row the features of another; each row is then scored once as it is and once
    for each feature exchanged, in one pass, and one aggregate compares them.
    """
    own = ranked(test, seed + 1)
    other = ranked(test, seed + 2).select("season", "_k", *[F.col(c).alias(f"_{c}") for c in COLUMNS])
    both = own.join(other, ["season", "_k"]).withColumn("feature", F.explode(F.array(F.lit(""), *[F.lit(c) for c in COLUMNS])))
    changed = both.withColumns({c: F.when(F.col("feature") == c, F.col(f"_{c}")).otherwise(F.col(c)) for c in COLUMNS})
    losses = scored(model, changed.select("feature", "bust", *COLUMNS)).groupBy("feature").agg(F.avg(F.pow(F.col("p") - F.col("bust"), F.lit(2.0))).alias("brier"))
    plain = losses.filter("feature = ''").select(F.col("brier").alias("_plain"))
    return losses.filter("feature <> ''").crossJoin(plain).select("feature", (F.col("brier") - F.col("_plain")).alias("importance"))  # one row on the right


def held_out_once(matrix: DataFrame, seasons: list[int], seal: str) -> DataFrame:
    """The rows of the held-out seasons, one time only.

    ``seal`` is a folder that all machines see; the first call writes it and every later one is
    refused, since a hold-out that is looked at twice is part of the tuning.
    """
    spark = matrix.sparkSession
    try:
        spark.createDataFrame([(",".join(map(str, seasons)),)], "seasons string").coalesce(1).write.mode("errorifexists").parquet(seal)
    except Exception as e:
        if "PATH_ALREADY_EXISTS" in str(e):
            raise PermissionError(f"the hold-out was opened before: {seal}") from e
        raise
    return matrix.filter(F.col("season").isin(*seasons))


def closest_features(matrix: DataFrame, most: float = 0.75) -> DataFrame:
    """(feature, corr, suspicious) of each feature with the outcome; null without spread. One scan."""
    corr = lambda c: F.covar_pop(c, "bust") / F.nullif(F.stddev_pop(c) * F.stddev_pop("bust"), F.lit(0.0))
    wide = matrix.agg(*[corr(c).alias(c) for c in COLUMNS])
    long = wide.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("corr")) for c in COLUMNS])).alias("f")).select("f.*")
    return long.withColumn("suspicious", F.coalesce(F.abs("corr") > most, F.lit(False)))
