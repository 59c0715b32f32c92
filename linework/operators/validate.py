"""Walk-forward validation and leakage checks."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import correlation
from ..sources.cuts import written
from .metrics import binary_metrics

#: Accuracy against the market above which a result is not believed.
TRIPWIRE = 0.55
FitPredict = Callable[[DataFrame, DataFrame], DataFrame]


def seasons_of(df: DataFrame) -> list[int]:
    return [row["season"] for row in df.select("season").distinct().orderBy("season").collect()]  # one row a season


def walk_forward(df: DataFrame, fit_predict: FitPredict, *, least_train: int = 5) -> DataFrame:
    """Predictions of each season by a model of the seasons before it.

    ``fit_predict(train, test)`` returns the test rows with ``p``. Raises if it returns other seasons.
    """
    seasons, parts = seasons_of(df), []
    for s in seasons[least_train:]:
        train, test = df.filter(F.col("season") < s), df.filter(F.col("season") == s)
        parts.append(fit_predict(train, test).withColumn("p", F.when(F.assert_true(F.col("season") == s).isNull(), F.col("p"))))
    if not parts:
        raise ValueError(f"needs more than {least_train} seasons, has {len(seasons)}")
    return reduce(DataFrame.unionByName, parts)


def summary(predicted: DataFrame, y: str, market: str | None = None) -> DataFrame:
    out = binary_metrics(predicted, y, "p", "season")
    if market:
        out = out.join(binary_metrics(predicted, y, market, "season").select("season", F.col("brier").alias("market_brier")), "season")
    return out.withColumn("suspicious", F.col("accuracy") > TRIPWIRE)


def ranked(df: DataFrame, seed: int) -> DataFrame:
    """Rows with ``_k``, 1 to n within each season by a seeded hash of the row.

    Rows are numbered within 65,536 ranges of the hash and each range starts where those before it
    end, so no task sorts a whole season.
    """
    rows = df.withColumn("_hash", F.xxhash64(F.lit(seed), *df.columns)).withColumn("_range", F.shiftright("_hash", 48))
    before = F.sum("count").over(Window.partitionBy("season").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    first = rows.groupBy("season", "_range").count().select("season", "_range", F.coalesce(before, F.lit(0)).alias("_first"))
    within = F.row_number().over(Window.partitionBy("season", "_range").orderBy("_hash", *df.columns))
    return rows.withColumn("_within", within).join(first, ["season", "_range"]).select(*[rows[c] for c in df.columns], (F.col("_first") + F.col("_within")).alias("_k"))


def shuffled(df: DataFrame, y: str, seed: int = 11) -> DataFrame:
    """The outcome of another row of the same season, by a seeded order; features stay."""
    other = ranked(df, seed + 1).select("season", F.col(y).alias("_y"), "_k")
    return ranked(df, seed).join(other, ["season", "_k"]).withColumn(y, F.col("_y")).select(*df.columns)


def leakage_report(df: DataFrame, features: list[str], y: str, fit_predict: FitPredict, *, least_train: int = 5, most_corr: float = 0.5) -> DataFrame:
    """Checks (name, value, limit, passed): features too close to the outcome, accuracy too good, and skill on shuffled outcomes.

    Every fold reads ``df`` several times, so it should be a table; the shuffled rows are written once.
    """
    wide = df.agg(*[F.abs(correlation(c, y)).alias(c) for c in features])
    corr = wide.select(F.explode(F.array(*[F.struct(F.concat(F.lit("corr:"), F.lit(c)).alias("name"), F.coalesce(F.col(c), F.lit(0.0)).alias("value"), F.lit(most_corr).alias("limit")) for c in features])).alias("c")).select("c.*")
    accuracy = lambda rows, name, limit: binary_metrics(walk_forward(rows, fit_predict, least_train=least_train), y, "p").select(F.lit(name).alias("name"), F.col("accuracy").alias("value"), F.lit(limit).alias("limit"))
    every = corr.unionByName(accuracy(df, "accuracy", 0.70)).unionByName(accuracy(written(shuffled(df, y)), "shuffled_accuracy", TRIPWIRE))
    return every.withColumn("passed", F.col("value") < F.col("limit"))


def timing_checks(df: DataFrame, late: list[str], key: str) -> DataFrame:
    """Checks (name, value, limit, passed) of order in time, in the shape of ``leakage_report``.

    ``late`` are the features that a decision would come too early for; rows need a season, and
    ``key`` must not repeat.
    """
    count = lambda c: c.cast("double")
    values = {
        "late_features": F.lit(float(len(late))), "rows_without_season": count(F.count_if(F.col("season").isNull())), "repeated_keys": count(F.count(F.lit(1)) - F.count_distinct(key)),
    }
    wide = df.agg(F.count(F.lit(1)).alias("_n"), *[v.alias(k) for k, v in values.items()])
    rows = wide.select(F.explode(F.array(*[F.struct(F.lit(k).alias("name"), F.col(k).alias("value"), F.lit(1.0).alias("limit")) for k in values])).alias("c")).select("c.*")
    return rows.withColumn("passed", F.col("value") < F.col("limit"))
