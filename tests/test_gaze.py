"""Change of rate and fixations in blocks against whole recordings."""

import numpy as np
import pytest

from tidewave.operators import gaze, matching, slices


def plain_resample(x, up, down):
    taps = gaze.low_pass_taps(up, down)
    wide = np.zeros(len(x) * up)
    wide[::up] = x
    full = np.convolve(wide, taps)[len(taps) // 2 :]
    return full[: len(x) * up : down]


def test_resampling_equals_direct_convolution(spark):
    rng = np.random.default_rng(1)
    series = {"a": rng.normal(size=537), "b": rng.normal(size=3), "c": rng.normal(size=100)}
    df = spark.createDataFrame([(k, float(i), float(v), float(v) * 2 if i != 50 else None) for k, x in series.items() for i, v in enumerate(x)], "k string, t double, x double, y double").repartition(4)
    framed = slices.framed(df, ["k"], "t", ["t"], 40.0)
    for up, down in ((1, 4), (3, 2), (2, 7), (5, 1)):
        found = gaze.resampled(framed, ["k"], ["x", "y"], up, down, 64).toPandas().sort_values(["k", "frame"])
        for k, x in series.items():
            own, expected = found[found.k == k], plain_resample(x, up, down)
            assert own.frame.tolist() == list(range(-(-len(x) * up // down)))
            assert np.allclose(own.x, expected[: len(own)])
        near = found[(found.k == "a") & found.y.isna()].frame * down / up
        assert len(near) and (np.abs(near - 50) <= 10 * max(up, down) / up).all()


def test_a_sine_keeps_its_amplitude(spark):
    t = np.arange(4000)
    x = 3 * np.sin(2 * np.pi * t / 80)
    df = spark.createDataFrame([("a", float(i), float(v)) for i, v in zip(t, x, strict=True)], "k string, t double, x double")
    found = gaze.resampled(slices.framed(df, ["k"], "t", ["t"], 500.0), ["k"], ["x"], 1, 4, 300).toPandas().sort_values("frame")
    inner = found.x.to_numpy()[60:-60]
    assert len(found) == 1000 and np.abs(inner - 3 * np.sin(2 * np.pi * np.arange(60, 940) * 4 / 80)).max() < 0.02


@pytest.mark.parametrize("keep_last", [False, True])
def test_fixations_in_blocks_equal_the_fold(spark, keep_last):
    rng = np.random.default_rng(2)
    rows = []
    for who, n, move in (("calm", 400, 0.6), ("quick", 300, 30.0), ("mixed", 350, None), ("one", 1, 1.0), ("still", 120, 0.0)):
        step = np.where(rng.random(n) < 0.08, 60.0, 0.8) if move is None else np.full(n, move)
        x, y = np.cumsum(rng.normal(size=n) * step), np.cumsum(rng.normal(size=n) * step)
        rows += [(who, float(i), float(a) if rng.random() > 0.05 else None, float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))]
    df = spark.createDataFrame(rows, "who string, t double, x double, y double").repartition(5)
    framed = slices.framed(df, ["who"], "t", ["t"], 50.0)
    key = lambda d: sorted(map(tuple, d.collect()))
    expected = key(matching.fixations(df, ["who"], "t", "x", "y", 8.0, 3.0, keep_last))
    for size in (7, 64, 100_000):
        assert key(gaze.fixations(framed, ["who"], "t", "x", "y", 8.0, 3.0, keep_last, size)) == expected, size
    assert len(expected) > 20


def test_small_blocks_have_no_call_each(spark):
    df = slices.framed(spark.createDataFrame([(k, float(i), float(i % 3)) for k in range(300) for i in range(5)], "k long, t double, x double"), ["k"], "t", ["t"], 4.0)
    found = gaze.fixations(df, ["k"], "t", "x", "x", 5.0, 0.5, size=2)
    assert "InPandas" not in found._jdf.queryExecution().toString() and found.select("k").distinct().count() == 300


def test_a_place_that_is_no_number_is_left_out(spark):
    rows = [(1, float(i), float("nan") if i % 4 == 1 else float(i // 6), 0.0) for i in range(40)]
    df = spark.createDataFrame(rows, "k long, t double, x double, y double")
    found = gaze.fixations(slices.framed(df, ["k"], "t", ["t"], 5.0), ["k"], "t", "x", "y", 1.5, 2.0, True, 7)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, matching.fixations(df, ["k"], "t", "x", "y", 1.5, 2.0, True).collect()))


def test_small_slices_have_no_call_each(spark):
    df = slices.framed(spark.createDataFrame([(k, float(i), float(i % 3)) for k in range(300) for i in range(5)], "k long, t double, x double"), ["k"], "t", ["t"], 4.0)
    found = gaze.resampled(df, ["k"], ["x"], 1, 2, 2)
    assert "InPandas" not in found._jdf.queryExecution().toString() and found.count() == 900


def test_slices_resampled_together_equal_direct_convolution():
    rng = np.random.default_rng(3)
    series = [rng.normal(size=n) for n in (90, 41, 3)]
    for up, down in ((1, 2), (3, 2), (2, 7)):
        taps, size = gaze.low_pass_taps(up, down), 16
        around = len(taps) // 2 // up + 1
        x, starts, first, low, high = [], [], [], [], []
        for own in series:
            for at in range(0, len(own), size):
                starts.append(sum(map(len, x)))
                first.append(max(0, at - around))
                x.append(own[first[-1] : at + size + around])
                low.append(-(-at * up // down))
                high.append(-(-min(at + size, len(own)) * up // down))
        x[0] = np.where(np.arange(len(x[0])) == 0, np.nan, x[0])  # of the first slice's samples, those that hear it are missing, and no others
        lengths, places, (found,) = gaze.resampled_parts([np.concatenate(x)], *map(np.array, (starts, first, low, high)), taps, up, down)
        assert lengths.tolist() == [b - a for a, b in zip(low, high, strict=True)]
        assert places.tolist() == [p for a, b in zip(low, high, strict=True) for p in range(a, b)]
        expected = np.concatenate([plain_resample(own, up, down) for own in series])
        missing = np.isnan(found)
        assert missing[0] and not missing[lengths[0] :].any() and np.allclose(found[~missing], expected[~missing])


def test_slices_are_dealt_as_pieces_of_many_samples(spark):
    rng = np.random.default_rng(5)
    series = {"a": rng.normal(size=537), "b": rng.normal(size=3), None: rng.normal(size=130)}
    df = spark.createDataFrame([(k, float(i), float(v) if i != 50 else None) for k, x in series.items() for i, v in enumerate(x)], "k string, t double, x double").repartition(4)
    framed = slices.framed(df, ["k"], "t", ["t"], 40.0)
    for up, down, size in ((1, 2, 100), (3, 2, 17), (2, 7, 65_536)):
        resampled = gaze.resampled(framed, ["k"], ["x"], up, down, size)
        plan = resampled._jdf.queryExecution().optimizedPlan().toString()
        assert 0 <= plan.find("Generate explode") < plan.find("collect_list")  # rows are copied to slices after they are collected
        found = resampled.toPandas().sort_values("frame")
        for k, x in series.items():
            own = found[found.k.isna() if k is None else found.k == k]
            far = np.abs(np.arange(len(own)) * down / up - 50) > 10 * max(up, down) / up
            assert own.frame.tolist() == list(range(-(-len(x) * up // down))) and own.x[far | (len(x) < 50)].notna().all()
            assert own.x.isna().any() == (len(x) > 50) and np.allclose(own.x[far], plain_resample(x, up, down)[far])


def test_sums_are_taken_in_steps(monkeypatch):
    rng = np.random.default_rng(6)
    x, taps = rng.normal(size=400), gaze.low_pass_taps(3, 2)
    for terms in (1, 1000, 1 << 20):
        monkeypatch.setattr(gaze, "TERMS", terms)
        _, places, (found,) = gaze.resampled_parts([x], np.array([0]), np.array([0]), np.array([0]), np.array([600]), taps, 3, 2)
        assert places.tolist() == list(range(600)) and np.allclose(found, plain_resample(x, 3, 2))
