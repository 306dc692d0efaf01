"""Sliced forms of ordered functions equal the plain ones, over 64 slices of one recording."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewave.operators import calculus, physiology, signal, slices, windows

SIZE, ROWS = 50, 3200


@pytest.fixture(scope="module")
def one(spark):
    """One hot recording of 64 slices, a short one, and one without a name."""
    rng = np.random.default_rng(3)
    rows = [("hot", float(t), i, float(v) if rng.random() > 0.1 and not 700 < i < 960 else None) for i, (t, v) in enumerate(zip(np.sort(rng.uniform(0, 1000, ROWS)), np.cumsum(rng.normal(size=ROWS)), strict=True))]
    rows += [("short", 5.0, 9000, 1.0), ("short", 7.0, 9001, None), (None, 1.0, 9002, 2.0), (None, 3.0, 9003, 4.0), ("none", 1.0, 9004, None), ("untimed", None, 9005, 1.0), ("untimed", 2.0, 9006, 3.0)]
    return spark.createDataFrame(rows, "who string, t double, id long, x double").repartition(5).cache()


@pytest.fixture(scope="module")
def framed(one):
    return slices.framed(one, ["who"], "t", ["t", "id"], 10.0).cache()


def same(a, b, columns, places=9):
    values = lambda df: sorted(tuple(round(v, places) if isinstance(v, float) else v for v in r) for r in df.select("id", *columns).fillna(-1e9).collect())
    assert values(a) == values(b)


def test_frames(one, framed):
    part = Window.partitionBy("who")
    plain = one.withColumns({"frame": F.row_number().over(part.orderBy("t", "id")) - 1, "frames": F.count("*").over(part)})
    same(framed, plain, ["frame", "frames"])
    assert framed.columns == [*one.columns, "frames", "frame"]


def test_no_slice_is_larger_than_it_may_be(framed):
    held = slices.over(framed, ["who"], lambda d, keys, order: d.withColumn("held", F.count("*").over(Window.partitionBy(*keys))), 3, 2, SIZE)
    assert held.agg(F.max("held")).first()[0] == SIZE + 5 and held.count() == ROWS + 7


def test_derivatives_and_medians(one, framed):
    order = ["t", "id"]
    same(slices.derivatives(framed, "x", ["who"], 3.0, SIZE), calculus.derivatives(one, "x", ["who"], order, 3.0), ["x_vel", "x_acc"])
    same(slices.finite_differences(framed, "x", "t", ["who"], SIZE), calculus.finite_differences(one, "x", "t", ["who"], order), ["x_vel", "x_acc"])
    for reach in (1, 2, 70):  # further than a slice
        same(slices.rolling_median(framed, "x", "m", ["who"], reach, SIZE), one.withColumn("m", calculus.rolling_median("x", ["who"], order, reach)), ["m"])
        same(slices.median_filter(framed, "x", "m", ["who"], reach, SIZE), one.withColumn("m", calculus.median_filter("x", ["who"], order, reach)), ["m"])


def test_runs(one, framed):
    for flag in (F.col("x") > 0, F.col("x").isNull(), F.lit(True)):
        key = lambda df: sorted(map(tuple, df.collect()), key=str)
        assert key(slices.runs(framed, flag, ["who"], "t", SIZE)) == key(calculus.runs(one, flag, ["who"], ["t", "id"], "t"))


def test_interpolation(one, framed):
    plain = one.withColumn("frame", F.row_number().over(Window.partitionBy("who").orderBy("t", "id")) - 1)
    for longest in (None, 2, 300):  # gaps longer than slices
        same(slices.interpolated(framed, "x", ["who"], longest, SIZE), calculus.interpolated(plain, "x", "frame", ["who"], longest), ["x_filled"])


def test_windows_of_rows(one, framed):
    key = lambda df: sorted((r["id"], r["frame"], r["window_index"]) for r in df.collect())
    for size, hop in ((64, 32), (10, 0)):
        assert key(windows.by_frame(framed, size, hop)) == key(windows.by_count(one, ["who"], ["t", "id"], size, hop))


def test_segments_and_filter(one, framed):
    rows = lambda df: sorted((r["id"], round(r["x_smooth"] or 0.0, 9)) for r in df.collect())
    df = one.where("who in ('hot', 'short')")
    assert rows(signal.low_pass(df, "who", ["t", "id"], "x", 5.0, 60.0, width=10.0, slice_rows=SIZE)) == rows(signal.low_pass(df, "who", ["t", "id"], "x", 5.0, 60.0))
    spans = slices.segments(framed.withColumn("ok", F.col("x").isNotNull()), "ok", ["who"], SIZE)
    bad = spans.groupBy("who", "__segment").agg(F.count("*").alias("n"), F.max("__at").alias("last"), F.max("__of").alias("of"), F.countDistinct("ok").alias("kinds")).where("n <> of or last <> n - 1 or kinds <> 1")
    assert bad.count() == 0


def test_beats(spark):
    t = np.arange(0, 120, 0.01)
    x = np.exp(-(((t % 0.8) - 0.4) ** 2) / 2e-4) + 0.01 * np.random.default_rng(4).normal(size=len(t))
    df = spark.createDataFrame([("hot", float(a), i, float(v)) for i, (a, v) in enumerate(zip(t, x, strict=True))], "who string, t double, id long, x double")
    plain = sorted(map(tuple, physiology.r_peaks(df, ["who"], ["t", "id"], "x", 100.0).collect()))
    beats = slices.framed(df, ["who"], "t", ["t", "id"], 5.0)
    assert beats.count() == len(t) and len(plain) == 150
    assert sorted(map(tuple, physiology.r_peaks(df, ["who"], ["t", "id"], "x", 100.0, width=5.0, slice_rows=187).collect())) == plain
