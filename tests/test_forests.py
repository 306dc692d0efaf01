"""Forests fitted as tasks."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewave.operators import evaluation, forests, splits
from tidewave.plans import models

SMALL = forests.Settings(trees=30, depth=8)


def blobs(n, seed, width=6, apart=2.5):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 3, n)
    return rng.normal(size=(n, width)) + apart * np.eye(3, width)[y], y


def plain_tree(x, y, w, split, leaf, depth):
    """The root's best split over all features, by looking at each cut."""
    def gini(s):
        total = sum(w[i] for i in s)
        return total - sum(sum(w[i] for i in s if y[i] == c) ** 2 for c in set(y)) / total if total else 0

    rows, best = range(len(y)), None
    for f in range(x.shape[1]):
        values = sorted(set(x[:, f]))
        for a, b in zip(values, values[1:], strict=False):
            low, high = [i for i in rows if x[i, f] <= a], [i for i in rows if x[i, f] > a]
            if min(len(low), len(high)) >= leaf:
                g = gini(low) + gini(high)
                if best is None or g < best[0] - 1e-9:
                    best = g, f, (a + b) / 2
    return best


def test_a_split_is_the_best_one():
    x, y = blobs(60, 1, width=2)
    for leaf in (1, 2, 20):
        forest = forests.Forest(x, y, forests.Settings(trees=1, depth=1, leaf=leaf), 5)
        rng = np.random.default_rng(5)
        drawn = np.bincount(rng.integers(0, 60, 60), minlength=60)
        tried = rng.random((1, 2)).argpartition(0, axis=1)[0, :1]
        rows = np.flatnonzero(drawn)
        weights = drawn[rows] * forest.weights[y[rows]]
        g, f, threshold = plain_tree(x[rows][:, tried], y[rows], weights, 5, leaf, 1)
        _, feature, thresholds, left, shares = forest.parts[0]
        assert feature[0] == tried[f] and thresholds[0] == pytest.approx(threshold) and left[0] == 1 and np.allclose(shares.sum(axis=1), 1)


def test_no_small_node_is_split_and_no_leaf_is_small():
    x, y = blobs(300, 2, apart=0.5)
    forest = forests.Forest(x, y, forests.Settings(trees=1, depth=30, split=12, leaf=4), 3)
    drawn = np.flatnonzero(np.bincount(np.random.default_rng(3).integers(0, 300, 300), minlength=300))
    _, feature, threshold, left, _ = forest.parts[0]
    node, seen = np.zeros(len(drawn), int), {0: len(drawn)}
    for _ in range(31):
        inner = feature[node] >= 0
        at = node[inner]
        node[inner] = left[at] + (x[drawn][inner, feature[at]] > threshold[at])
        seen |= dict(zip(*np.unique(node[inner], return_counts=True), strict=True))
    assert all(seen[i] >= 12 for i in np.flatnonzero(feature >= 0)) and min(seen.values()) >= 4 and (feature >= 0).sum() > 5


def test_forests_learn_and_repeat():
    x, y = blobs(400, 4)
    z, truth = blobs(400, 5)
    forest = forests.Forest(x, y, SMALL, 1)
    assert (forest.predict(z) == truth).mean() > 0.85
    assert (forests.Forest(x, y, SMALL, 1).shares_of(z) == forest.shares_of(z)).all()
    assert (forests.Forest(x, np.where(y == 2, 1, y), SMALL, 1).shares_of(z).shape) == (400, 2)
    one = forests.Forest(x, np.zeros(400), SMALL, 1)
    assert (one.predict(z) == 0).all()
    train, test = forests.prepared(np.array([[1, np.nan], [3, 5.0], [2, 7]]), np.array([[np.nan, np.inf]]), None)
    assert np.allclose(train.mean(axis=0), 0) and np.allclose(test, 0)
    assert forests.prepared(x, z, 0.5)[1].shape[1] < 6


def frame(spark, n=240):
    x, y = blobs(n, 7, width=4)
    pdf = pd.DataFrame(x, columns=list("abcd"))
    pdf.loc[::17, "a"] = np.nan
    pdf["id"], pdf["label"], pdf["person"] = range(n), np.array(["L", "M", "H"])[y], np.arange(n) % 5
    return spark.createDataFrame(pdf).withColumn("a", F.when(~F.isnan("a"), F.col("a")))


def test_runs_equal_a_serial_fit(spark):
    df = frame(spark)
    runs = [splits.stratified(df, "label", "id", 0.7, seed=s).withColumn("seed", F.lit(s)).withColumn("fold", F.lit("all")) for s in (1, 2)]
    for p in range(5):
        runs.append(df.withColumns({"side": F.when(F.col("person") == p, "test").otherwise("train"), "seed": F.lit(1), "fold": F.lit(f"p{p}")}))
    sided = runs[0]
    for r in runs[1:]:
        sided = sided.unionByName(r)
    keys = ["seed", "fold"]
    found = forests.fitted_runs(sided.repartition(7), keys, "id", "label", list("abcd"), SMALL)
    got = {(r["seed"], r["fold"], r["id"]): r["predicted"] for r in found.collect()}
    pdf, expected = sided.toPandas(), {}
    for _, rows in pdf.groupby(keys):
        out = forests.fit_run(rows.sample(frac=1, random_state=3), keys, "id", "label", list("abcd"), SMALL)
        expected |= {(r.seed, r.fold, r.id): r.predicted for r in out.itertuples()}
    assert got == expected and len(got) == sided.where("side = 'test'").count()
    scored = evaluation.fold_scores(found, keys, "label", "predicted").collect()
    assert len(scored) == 7 and min(r["balanced_accuracy"] for r in scored) > 0.6


def test_bounds_and_odd_runs(spark):
    df = frame(spark, 40).withColumns({"side": F.when(F.col("id") < 30, "train").otherwise("test"), "run": F.lit(1)})
    with pytest.raises(ValueError, match="use evaluation.fitted"):
        forests.fitted_runs(df, ["run"], "id", "label", list("abcd"), SMALL, most=39)
    alone = df.where("side = 'test'").unionByName(df.where("id < 5").withColumn("run", F.lit(2)))
    found = forests.fitted_runs(alone, ["run"], "id", "label", list("abcd"), SMALL).collect()
    assert len(found) == 10 and {r["predicted"] for r in found} == {None}
    assert forests.fitted_runs(df.limit(0), ["run"], "id", "label", list("abcd"), SMALL).count() == 0


def test_large_runs_are_dealt_by_trees(spark):
    df = frame(spark, 240).withColumn("side", F.when(F.col("id") % 4 == 0, "test").otherwise("train"))
    both = df.withColumn("run", F.lit("large")).unionByName(df.where("id < 60").withColumn("run", F.lit("small")))
    args = (["run"], "id", "label", list("abcd"), SMALL)
    got = {(r["run"], r["id"]): r["predicted"] for r in forests.fitted(both, *args, most=100).collect()}
    assert got == {(r["run"], r["id"]): r["predicted"] for r in forests.fitted(both.repartition(5), *args, most=100).collect()}
    small = {("small", r["id"]): r["predicted"] for r in forests.fitted_runs(both.where("run = 'small'"), *args).collect()}
    assert {k: v for k, v in got.items() if k[0] == "small"} == small and len(got) == 75
    truth = {r["id"]: r["label"] for r in df.collect()}
    assert np.mean([truth[i] == p for (run, i), p in got.items() if run == "large"]) > 0.8
    none = forests.fitted(both.where("side = 'test' or run = 'small'"), *args, most=59)
    assert {r["predicted"] for r in none.where("run = 'large'").collect()} == {None}


def test_runs_have_no_call_each_and_places_are_stable(spark):
    df = frame(spark, 40).withColumns({"side": F.lit("train"), "run": F.col("id") % 9})
    assert "InPandas" not in forests.fitted_runs(df, ["run"], "id", "label", list("abcd"), SMALL)._jdf.queryExecution().toString()
    values = np.random.default_rng(3).integers(0, 9, 500)
    assert (forests.sorted_places(values, 9) == np.argsort(values, kind="stable")).all() and (forests.sorted_places(values, 1 << 60) == np.argsort(values, kind="stable")).all()


def test_large_runs_alone_are_read_once(spark):
    df = frame(spark, 240).withColumns({"side": F.when(F.col("id") % 4 == 0, "test").otherwise("train"), "run": F.lit(1)})
    found = forests.fitted(df, ["run"], "id", "label", list("abcd"), SMALL, most=100)
    assert "Union" not in found._jdf.queryExecution().toString() and found.count() == 60
    assert models._texts(spark, "/root/testdata/sf0.001").storageLevel.useMemory
