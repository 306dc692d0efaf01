"""High-pass filters, the split and cleaning of skin conductance, and names of metrics."""

import numpy as np
import pytest

from tidewave.operators import features, fusion, physiology, signal


def test_high_pass_gain():
    for order in (2, 4, 5):
        b, a = signal.butterworth(order, 3.0, 20.0, high=True)
        gain = lambda f, b=b, a=a: abs(np.polyval(b, np.exp(2j * np.pi * f / 20)) / np.polyval(a, np.exp(2j * np.pi * f / 20)))
        assert gain(1e-9) == pytest.approx(0, abs=1e-9) and gain(10) == pytest.approx(1) and gain(3) == pytest.approx(np.sqrt(0.5))


def test_skin_conductance(spark):
    rate, t = 20.0, np.arange(4000) / 20.0
    slow, fast, noise = 2 + 0.5 * np.sin(2 * np.pi * 0.01 * t), 0.3 * np.sin(2 * np.pi * 0.5 * t), 0.2 * np.sin(2 * np.pi * 8 * t)
    df = spark.createDataFrame([("a", float(at), i, float(v)) for i, (at, v) in enumerate(zip(t, slow + fast + noise, strict=True))], "k string, t double, id long, x double")
    clean = physiology.eda_cleaned(df, "k", ["t", "id"], "x", rate)
    assert np.abs(clean.toPandas().sort_values("id").x_clean.to_numpy() - slow - fast)[200:-200].max() < 0.02
    split = physiology.eda_high_pass(clean.drop("x").withColumnRenamed("x_clean", "x"), "k", ["t", "id"], "x", rate).toPandas().sort_values("id")
    assert np.abs(split.phasic.to_numpy() - fast)[800:-800].max() < 0.05 and np.abs(split.tonic.to_numpy() - slow)[800:-800].max() < 0.06
    assert physiology.eda_cleaned(df, "k", ["t", "id"], "x", 5.0).where("x_clean <> x").count() == 0


def test_metrics_and_orders(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0, "a", 3.0, 4.0)], "participant int, b double, a_rms double, kind string, C_MEAN_ABS_VEL double, window_index double")
    assert features.metric_columns(df) == ["a_rms", "C_MEAN_ABS_VEL", "b"]
    assert features.default_metric(["x", "Mouth_Aperture_RMS", "y_rms"]) == "Mouth_Aperture_RMS"
    assert features.default_metric(["x", "y_rms"]) == "y_rms" and features.default_metric(["x"]) == "x" and features.default_metric([]) is None
    info = spark.createDataFrame([(1, "Low", "M1", "High"), (2, "H", "M", "L"), (3, "L", None, "M")], "p int, s1 string, s2 string, s3 string")
    found = {r["participant"]: (r["session_order"], r["session_order_numeric"]) for r in fusion.session_order(info, "p", ["s1", "s2", "s3"], fusion.SIX_ORDERS).collect()}
    assert found == {1: ("LMH", 1), 2: ("HML", 6), 3: (None, None)}
    assert {r["session_order_numeric"] for r in fusion.session_order(info, "p", ["s1", "s2", "s3"], fusion.TWO_ORDERS).collect()} == {1, None}
