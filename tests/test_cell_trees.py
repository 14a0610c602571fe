"""Trees fitted on cells: equal to Spark's own fit, scored alike, odd inputs, and the settings of the registered detectors."""

import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from flowtriage.operators import cell_trees, models
from flowtriage.plans import models as plans

FOLDER = "/root/testdata/sf0.001"
WHOLE = models.DetectorSettings()


def table(spark, n=900, seed=3, values=13):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        a, b, c = rnd.randrange(values), rnd.choice([0.5, 1.5, 2.5, 7.0]), rnd.randrange(5)
        rows.append((i, float(a), b, c, int((a > 6) ^ (b > 2 and c < 2) ^ (rnd.random() < 0.15))))
    return spark.createDataFrame(rows, "id long, a double, b double, c int, y int")


def p_of(model, df):
    scored = model.transform(df).select("id", vector_to_array("probability")[1].alias("p"), F.col("prediction").cast("int"))
    return {r[0]: (r[1], r[2]) for r in scored.collect()}


def test_a_fit_on_cells_equals_sparks_own(spark):
    df = table(spark)
    settings = models.DetectorSettings(rounds=12, depth=4, row_share=1.0, feature_share="all", min_gain=0.001)
    mine = models.train_detector(df, ["a", "b", "c"], "y", settings)
    rows = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(models.with_class_weight(df, "y"))
    theirs = GBTClassifier(
        labelCol="y", weightCol="weight", maxIter=12, maxDepth=4, stepSize=0.08, minInstancesPerNode=7, minInfoGain=0.001, seed=42
    ).fit(rows)
    assert mine.stages[-1].getNumTrees == theirs.getNumTrees == 12
    assert list(mine.stages[-1].featureImportances.toArray()) == pytest.approx(list(theirs.featureImportances.toArray()))
    ours, spark_own = p_of(mine, df), p_of(theirs, rows)
    for key, (p, predicted) in spark_own.items():
        assert ours[key] == (pytest.approx(p, abs=1e-9), predicted)


def test_a_sampled_fit_reads_about_its_share_of_rows_and_repeats_itself(spark):
    df = table(spark, values=200).withColumn("a", F.col("a") + F.rand(5))
    settings = models.DetectorSettings(rounds=6, depth=5)
    first, second = (models.train_detector(d, ["a", "b", "c"], "y", settings).stages[-1] for d in (df, df.repartition(3)))
    assert first.toDebugString.split("\n", 1)[1] == second.toDebugString.split("\n", 1)[1]
    counts = [t._java_obj.rootNode().impurityStats().rawCount() for t in first.trees]
    assert len(set(counts)) > 1 and all(0.65 * 900 < n < 0.85 * 900 for n in counts)


def test_rows_that_do_not_fall_into_few_cells_are_all_fitted(spark, monkeypatch):
    monkeypatch.setattr(cell_trees, "MAX_CELLS", 10)
    model = models.train_detector(table(spark), ["a", "b", "c"], "y", models.DetectorSettings(rounds=3, depth=3, row_share=1.0))
    assert model.stages[-1].getNumTrees == 3
    assert model.stages[-1].trees[0]._java_obj.rootNode().impurityStats().rawCount() == 900


@pytest.mark.parametrize("known", [1_000_000, 20])
def test_scores_equal_the_models_transform(spark, monkeypatch, known):
    monkeypatch.setattr(cell_trees, "KNOWN_CELLS", known)
    df = table(spark, values=300).withColumn("a", F.col("a") + F.rand(5))
    model = models.train_detector(df, ["a", "b", "c"], "y", models.DetectorSettings(rounds=20, depth=6))
    found = {r.id: (r.raw_score, r.predicted) for r in models.score_flows(df, model).collect()}
    for key, (p, predicted) in p_of(model, df).items():
        assert found[key] == (pytest.approx(p, abs=1e-12), predicted)
    trees = cell_trees.flat_trees(model.stages[-1])
    columns = [np.array([r[c] for r in df.collect()], float) for c in "abc"]
    expected = trees.margins(trees.bins(columns))
    for _ in range(2):
        for at in (slice(0, 400), slice(300, 900)):  # met, new and both
            assert np.array_equal(cell_trees.margins(trees, [c[at] for c in columns]), expected[at])


def test_odd_rows(spark):
    df = table(spark)
    settings = models.DetectorSettings(rounds=2, depth=3)
    model = models.train_detector(df, ["a", "b"], "y", settings)
    broken = df.withColumn("a", F.when(F.col("id") == 5, None).otherwise(F.col("a")))
    with pytest.raises(Exception):
        models.train_detector(broken, ["a", "b"], "y", settings)
    with pytest.raises(Exception):
        models.score_flows(broken, model).select("raw_score").collect()
    assert models.score_flows(df.limit(0), model).count() == 0
    far = spark.createDataFrame([(1, float("inf"), -1e300)], "id long, a double, b double")
    assert 0 <= models.score_flows(far, model).first()["raw_score"] <= 1
    for y in (0, 1):
        alone = models.train_detector(df.withColumn("y", F.lit(y)), ["a", "b"], "y", settings)
        assert models.score_flows(df, alone).where(F.col("raw_score").between(0, 1)).count() == 900
    constant = models.train_detector(df.withColumn("a", F.lit(1.0)), ["a"], "y", settings)
    assert models.score_flows(df, constant).select("raw_score").distinct().count() == 1


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="test tables are absent")
@pytest.mark.parametrize("name,fits", [
    ("l02_train_detector", 1), ("t03_top_importance", 1), ("l09_feature_importance", 1), ("l10_specialist_detectors", 3),
])
def test_registered_detectors_are_fitted_with_all_rounds_and_depth(spark, tmp_path, monkeypatch, name, fits):
    for source in Path(FOLDER).iterdir():  # a folder of its own, so no stored detector is met
        (tmp_path / source.name).symlink_to(source)
    real, seen = models.train_detector, []

    def short(df, features, truth, settings=WHOLE):
        seen.append(settings)
        return real(df, features, truth, models.DetectorSettings(rounds=2, depth=2))

    monkeypatch.setattr(models, "train_detector", short)
    assert plans.QUERIES[name](spark, str(tmp_path)).count() > 0
    assert seen == [models.DetectorSettings(rounds=250, depth=8)] * fits


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="test tables are absent")
def test_a_registered_detector_has_all_its_trees(spark):
    trees = plans._item_detector(spark, FOLDER).stages[-1]
    assert trees.getNumTrees == 250 and max(t.depth for t in trees.trees) == 8
