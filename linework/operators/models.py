"""Models over feature tables with MLlib: cover probabilities from residuals, busts, two-arm tests."""

from __future__ import annotations

import hashlib
import json

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import normal_cdf
from ..sources.cuts import written
from .metrics import auc, binary_metrics
from .validate import ranked, walk_forward

# Spread of results around the closing line, in points.
SD = {"spread": 13.5, "total": 10.5}


def _assembled(features: list[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep")


def residual_model(features: list[str], residual: str, sd: float, *, linear: bool = False, depth: int = 3, rounds: int = 20):
    """A ``fit_predict`` whose ``p`` is the chance of a residual over 0, normal around the predicted one."""

    def fit_predict(train: DataFrame, test: DataFrame) -> DataFrame:
        learner = LinearRegression(labelCol=residual, regParam=1.0) if linear else GBTRegressor(labelCol=residual, maxDepth=depth, maxIter=rounds, seed=7)
        model = Pipeline(stages=[_assembled(features), learner]).fit(train.filter(F.col(residual).isNotNull()).fillna(0.0, features))
        return model.transform(test.fillna(0.0, features)).withColumn("p", normal_cdf(F.col("prediction") / sd)).drop("features", "prediction")

    return fit_predict


def residual_importances(train: DataFrame, features: list[str], residual: str, *, depth: int = 3, rounds: int = 20) -> DataFrame:
    """(feature, importance) of boosted trees on the residual, one row a feature, 0 for one that no tree splits on."""
    learner = GBTRegressor(labelCol=residual, maxDepth=depth, maxIter=rounds, seed=7)
    model = Pipeline(stages=[_assembled(features), learner]).fit(train.filter(F.col(residual).isNotNull()).fillna(0.0, features))
    weights = model.stages[-1].featureImportances.toArray()
    return train.sparkSession.createDataFrame([(f, float(w)) for f, w in zip(features, weights, strict=True)], "feature string, importance double")


def probability_model(features: list[str], y: str, *, trees: bool = False):
    def fit_predict(train: DataFrame, test: DataFrame) -> DataFrame:
        learner = GBTClassifier(labelCol=y, maxDepth=3, maxIter=20, seed=7) if trees else LogisticRegression(labelCol=y, regParam=0.01)
        model = Pipeline(stages=[_assembled(features), learner]).fit(train.fillna(0.0, features))
        scored = model.transform(test.fillna(0.0, features))
        return scored.withColumn("p", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")

    return fit_predict


def two_arm(df: DataFrame, base: list[str], extra: list[str], y: str, *, least_train: int = 2) -> DataFrame:
    """AUC and Brier score of each season with and without the extra features, and what they add."""
    arms, df = {}, written(df.select("season", y, *base, *extra))  # read by every fold of both arms
    for name, features in (("base", base), ("full", base + extra)):
        scored = written(walk_forward(df, probability_model(features, y), least_train=least_train).select("season", y, "p"))
        arms[name] = auc(scored, y, "p", "season").join(binary_metrics(scored, y, "p", "season").select("season", "brier"), "season").select("season", F.col("auc").alias(f"auc_{name}"), F.col("brier").alias(f"brier_{name}"))
    return arms["base"].join(arms["full"], "season").withColumn("auc_gain", F.col("auc_full") - F.col("auc_base"))


def permuted(df: DataFrame, column: str, seed: int = 5) -> DataFrame:
    """The column of another row of the same season."""
    other = ranked(df, seed + 1).select("season", F.col(column).alias("_v"), "_k")
    return ranked(df, seed).join(other, ["season", "_k"]).withColumn(column, F.col("_v")).select(*df.columns)


def spec_hash(spec: list[dict]) -> str:
    """16 hex digits over the ordered name, type, default and availability of each feature."""
    body = [[f["name"], f["dtype"], f["default"], f["availability"]] for f in spec]
    return hashlib.sha256(json.dumps(body, separators=(",", ":")).encode()).hexdigest()[:16]


def export_bundle(model, path: str, spec: list[dict], checks: DataFrame, weights: dict[str, float]) -> None:
    """Write a fitted pipeline and its manifest; refused if any leakage check failed."""
    failed = [row["name"] for row in checks.filter(~F.col("passed")).select("name").collect()]
    if failed:
        raise ValueError(f"leakage checks failed: {', '.join(failed)}")
    model.write().overwrite().save(f"{path}/model")
    manifest = json.dumps({"spec_hash": spec_hash(spec), "weights": weights})
    checks.sparkSession.createDataFrame([(manifest,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")


def load_bundle(spark, path: str, spec: list[dict]):
    """(model, manifest); refused if the features are not the ones it was trained with."""
    from pyspark.ml import PipelineModel

    manifest = json.loads(spark.read.text(f"{path}/manifest").first()[0])
    if manifest["spec_hash"] != spec_hash(spec):
        raise ValueError(f"bundle was trained with features {manifest['spec_hash']}, these are {spec_hash(spec)}")
    return PipelineModel.load(f"{path}/model"), manifest


def bundle_registry(spark, root: str, spec: list[dict], registered: DataFrame) -> DataFrame:
    """(version, spec_hash, weights, spec_matches, active), the newest version first: every bundle that was exported under ``root``.

    ``registered`` is (version, active). A manifest that is no JSON or has no hash is passed over; a bundle
    that nobody registered is not active. One small file a bundle is read.
    """
    files = spark.read.text(f"{root}/*/manifest").select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -3).alias("version"), F.from_json("value", "spec_hash string, weights map<string, double>").alias("m"))
    rows = files.filter("m.spec_hash is not null").select("version", "m.*")
    known = registered.groupBy("version").agg(F.bool_or("active").alias("active"))
    met = rows.join(known, "version", "left").withColumns({"spec_matches": F.col("spec_hash") == spec_hash(spec), "active": F.coalesce("active", F.lit(False))})
    return met.select("version", "spec_hash", "weights", "spec_matches", "active").orderBy(F.desc("version"))


def active_weights(registry: DataFrame) -> DataFrame:
    """(name, weight) of the newest active bundle; none if it was trained with other features, so that nothing is blended in."""
    newest = registry.filter("active").agg(F.max_by(F.struct("spec_matches", "weights"), "version").alias("b"))
    return newest.filter("b.spec_matches").select(F.explode("b.weights").alias("name", "weight"))


def blend_weight(weights: DataFrame, picks: DataFrame) -> DataFrame:
    """Weight of each pick by its market, else its class, else 0; ``weights`` is (name, weight)."""
    by_market = weights.select(F.col("name").alias("market_type"), F.col("weight").alias("_m"))
    by_class = weights.select(F.col("name").alias("bet_class"), F.col("weight").alias("_c"))
    return picks.join(by_market, "market_type", "left").join(by_class, "bet_class", "left").withColumn("weight", F.coalesce("_m", "_c", F.lit(0.0))).drop("_m", "_c")
