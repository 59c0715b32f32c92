"""Bundles of models: exported once their checks pass, listed, and used only with the features they were trained with."""

import pytest
from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression

from linework.operators import models

SPEC = [{"name": "x", "dtype": "float", "default": 0.0, "availability": "pregame"}]
OTHER = [{"name": "z", "dtype": "float", "default": 0.0, "availability": "pregame"}]
CHECK = "name string, passed boolean"


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("bundles")
    rows = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (3.0, 6.0)], "x double, y double")
    model = Pipeline(stages=[VectorAssembler(inputCols=["x"], outputCol="features"), LinearRegression(labelCol="y")]).fit(rows)
    fine = spark.createDataFrame([("shuffled", True)], CHECK)
    models.export_bundle(model, f"{folder}/2024-01", SPEC, fine, {"totals": 0.2, "game": 0.1})
    models.export_bundle(model, f"{folder}/2024-02", OTHER, fine, {"totals": 0.5})
    (folder / "2024-03" / "manifest").mkdir(parents=True)
    (folder / "2024-03" / "manifest" / "part").write_text("{not json")
    with pytest.raises(ValueError, match="shuffled"):
        models.export_bundle(model, f"{folder}/2024-04", SPEC, spark.createDataFrame([("shuffled", False)], CHECK), {})
    assert not (folder / "2024-04").exists()
    return str(folder)


def test_loaded_only_with_its_own_features(spark, root):
    model, manifest = models.load_bundle(spark, f"{root}/2024-01", SPEC)
    assert manifest["weights"] == {"totals": 0.2, "game": 0.1}
    assert model.transform(spark.createDataFrame([(4.0,)], "x double")).first().prediction == pytest.approx(8.0)
    with pytest.raises(ValueError, match="trained with"):
        models.load_bundle(spark, f"{root}/2024-02", SPEC)


def registry(spark, root, *active):
    return models.bundle_registry(spark, root, SPEC, spark.createDataFrame([(v, True) for v in active], "version string, active boolean"))


def test_registry_lists_what_can_be_read(spark, root):
    rows = registry(spark, root, "2024-01", "gone").collect()
    assert [(r.version, r.spec_matches, r.active) for r in rows] == [("2024-02", False, False), ("2024-01", True, True)]


def test_weight_by_market_then_class_then_nothing(spark, root):
    picks = spark.createDataFrame([(1, "totals", "game"), (2, "spreads", "game"), (3, "player_receptions", "prop")], "pick_id int, market_type string, bet_class string")
    weigh = lambda *active: {r.pick_id: r.weight for r in models.blend_weight(models.active_weights(registry(spark, root, *active)), picks).collect()}
    assert weigh("2024-01") == {1: 0.2, 2: 0.1, 3: 0.0}
    assert weigh() == {1: 0.0, 2: 0.0, 3: 0.0}
    assert weigh("2024-01", "2024-02") == {1: 0.0, 2: 0.0, 3: 0.0}  # the newest one has other features
