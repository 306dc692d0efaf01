"""Names, runs and reports of experiments."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewave.operators import experiments, forests


def test_expansion_and_names():
    groups = {"eye": ("eye.csv", 1), "ecg": ("ecg.csv", 2)}
    found = experiments.expanded([{"name": "both", "feature_groups": ["ecg", "eye"], "n_seeds": 3}, {"name": "one", "feature_groups": ["eye"]}], groups, {"n_seeds": 20, "class_config": "all"})
    assert found["both"] == {"name": "both", "feature_groups": ["ecg", "eye"], "n_seeds": 3, "class_config": "all", "files": [("ecg.csv", 2), ("eye.csv", 1)]}
    assert found["one"]["n_seeds"] == 20
    with pytest.raises(ValueError, match="unknown feature groups"):
        experiments.expanded([{"name": "x", "feature_groups": ["gsr"]}], groups, {})
    plain = {"class_config": "all", "feature_selection": "backward"}
    assert experiments.folder_name("procrustes_global", plain) == "procrustes_global_all_backward_zscore"
    odd = {"class_config": "L_vs_H", "use_pose_derivatives": False, "use_time_features": True, "normalize_features": False, "include_order": True, "sampling_strategy": "temporal", "tune_hyperparameters": True, "use_pca": True}
    assert experiments.folder_name("original", odd) == "original_L_vs_H_none_noderiv_time_nonorm_order_temporal_hyp_pca"
    assert experiments.file_suffix(odd) == "_none_hyp_pca_noderiv_time_nonorm_order_LvH"
    assert experiments.file_suffix(plain) == "_backward_zscore" and experiments.file_suffix({}) == ""


@pytest.fixture(scope="module")
def people(spark):
    rng = np.random.default_rng(1)
    rows = [(i, int(i % 7), "LMH"[int(rng.integers(0, 3))] if i % 7 != 6 else "L", float(rng.normal())) for i in range(300)]
    rows += [(300, None, "L", 1.0), (301, 1, None, 1.0)]
    return spark.createDataFrame(rows, "id long, person int, label string, x double")


def test_held_out(people):
    found = experiments.held_out(people, "person", [4, 5]).toPandas()
    assert len(found) == 301 * 7 * 2
    assert ((found.side == "test") == (found.person == found.fold)).all()
    assert experiments.held_out(people.limit(0), "person", [1]).count() == 0


def test_drawn_sides(people):
    found = experiments.drawn_sides(people, ["person"], "label", "id", [2, 5, 40], [0, 1]).toPandas()
    assert set(found.person.dropna()) == {0, 1, 2, 3, 4, 5} and set(found.train_size) == {2, 5}
    counted = found[found.side == "train"].groupby(["person", "label", "seed", "train_size"]).size()
    assert (counted == counted.index.get_level_values("train_size")).all()
    draws = {s: set(found[(found.side == "train") & (found.seed == s) & (found.train_size == 5)].id) for s in (0, 1)}
    assert draws[0] != draws[1]
    small, large = (set(found[(found.side == "train") & (found.seed == 0) & (found.train_size == n)].id) for n in (2, 5))
    assert small < large


def test_reports(spark, people):
    sided = experiments.seeded(people.dropna(), "label", "id", 0.8, [1, 2, 3])
    predicted = forests.fitted_runs(sided, ["seed"], "id", "label", ["x"], forests.Settings(trees=5))
    pdf = predicted.toPandas()
    accuracy = (pdf.label == pdf.predicted).groupby(pdf.seed).mean()
    one = experiments.over_runs(predicted, ["seed"], [], "label").first()
    assert one["runs"] == 3 and one["accuracy_mean"] == pytest.approx(accuracy.mean()) and one["accuracy_std"] == pytest.approx(accuracy.std())
    recall = pdf[pdf.label == "L"].groupby("seed").apply(lambda g: (g.predicted == "L").mean(), include_groups=False)
    by_class = {r["class"]: r for r in experiments.classes_over_runs(predicted, ["seed"], [], "label").collect()}
    assert set(by_class) == set("LMH") and by_class["L"]["recall_mean"] == pytest.approx(recall.mean())
    drawn = experiments.drawn_sides(people, ["person"], "label", "id", [2, 5], [0, 1])
    told = drawn.where("side = 'test'").withColumn("predicted", F.when(F.col("person") < 3, F.col("label")).otherwise("L"))
    points = {r["train_size"]: r for r in experiments.curve(told, "person", "label").collect()}
    assert points[2]["people"] == points[5]["people"] == 6 and points[2]["balanced_accuracy_mean"] == pytest.approx((3 + 3 / 3) / 6)
