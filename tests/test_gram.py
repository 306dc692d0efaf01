"""Sums of products of many columns, and order statistics without sorting."""

import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewave.operators import gram, statistics


def test_moments_of_known_values(spark, monkeypatch):
    monkeypatch.setattr(gram, "ROWS_AT_ONCE", 7)
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame(rng.normal(size=(200, 5)) + 1e6, columns=["a", "b", "c", "d x", "e"])
    pdf["b"] = pdf["a"] * 2 + rng.normal(size=200) * 0.1
    pdf.loc[::3, "c"], pdf.loc[::5, "a"], pdf.loc[3, "d x"], pdf["e"] = np.nan, np.nan, np.inf, 4.0
    df = spark.createDataFrame(pdf).withColumn("c", F.when(~F.isnan("c"), F.col("c"))).repartition(6)
    found = gram.moments(df, list(pdf.columns))
    clean = pdf.replace(np.inf, np.nan)
    assert np.allclose(found.variances(), clean.var(ddof=0))
    both = clean[["a", "c"]].dropna()
    assert found.covariances()[0, 2] == pytest.approx(np.cov(both["a"], both["c"], ddof=0)[0, 1]) and found.counts[0, 2] == len(both)
    kept = {r["column"]: (r["variance"], r["kept"]) for r in gram.correlated_columns(df, list(pdf.columns), 1e-8, 0.95).collect()}
    assert [c for c, (_, k) in kept.items() if k] == ["b", "c", "d x"] and kept["e"] == (0.0, False)
    empty = gram.correlated_columns(df.limit(0), ["a", "b"], 1e-8, 0.95).collect()
    assert [tuple(r) for r in empty] == [("a", None, False), ("b", None, False)]
    with pytest.raises(ValueError, match="more than"):
        gram.moments(df, ["a"] * (gram.MOST_COLUMNS + 1))


def test_as_many_columns_as_all_modalities_have(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1_900, 415))
    x[:, 7] = x[:, 400] * 3 + 1
    x[:, 9] = -x[:, 8] + rng.normal(size=1_900) * 0.01
    df = spark.createDataFrame(pd.DataFrame(x, columns=[f"f{i}" for i in range(415)])).repartition(4).cache()
    df.count()
    began = time.time()
    rows = gram.correlated_columns(df, df.columns, 1e-8, 0.95).collect()
    assert [r["column"] for r in rows if not r["kept"]] == ["f7", "f8"] and time.time() - began < 60


def test_order_statistics(spark, monkeypatch):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"even": rng.normal(size=5000), "heavy": np.exp(rng.normal(size=5000) * 8), "tied": rng.integers(0, 3, 5000).astype(float), "same": np.full(5000, 2.5), "tiny": rng.integers(0, 2, 5000) * 5e-324})
    df = spark.createDataFrame(pdf).repartition(5)
    for fetched in (100_000, 40, 0):
        monkeypatch.setattr(statistics, "FETCHED", fetched)
        found = {r["column"]: r for r in statistics.described(df, list(pdf.columns)).collect()}
        for c in pdf:
            assert [found[c][k] for k in ("p25", "p50", "p75")] == pytest.approx(np.quantile(pdf[c], [0.25, 0.5, 0.75]), rel=1e-12), (c, fetched)
            assert found[c]["n"] == 5000 and found[c]["max"] == pdf[c].max()
    one = statistics.described(spark.createDataFrame([(1.0, None), (None, None), (float("nan"), None)], "a double, b double"), ["a", "b"]).collect()
    assert [tuple(r) for r in one] == [("a", 1, 1.0, None, 1.0, 1.0, 1.0, 1.0, 1.0), ("b", 0, *[None] * 7)]
