import numpy as np
from pyspark.sql import functions as F

from tidewave.operators import calculus, evaluation, features, matching, physiology, selection, signal, splits, statistics, windows


def test_count_windows_are_complete_ones(spark):
    df = spark.range(10).select(F.lit(1).alias("r"), F.col("id"))
    found = windows.by_count(df, ["r"], ["id"], 4, 2).groupBy("window_index").count().collect()
    assert sorted((r["window_index"], r["count"]) for r in found) == [(0, 4), (1, 4), (2, 4), (3, 4)]


def test_butterworth_keeps_a_constant_and_short_segments(spark):
    b, a = signal.butterworth(4, 10.0, 60.0)
    assert np.allclose(signal.zero_phase([np.full(100, 3.0)], b, a)[0], 3.0)
    x = np.arange(15.0)
    assert (signal.zero_phase([x], b, a)[0] == x).all()
    t = np.arange(300) / 60
    wave = np.sin(2 * np.pi * t) + np.sin(2 * np.pi * 25 * t)
    assert np.abs(signal.zero_phase([x, wave, wave[:200]], b, a)[1][50:-50] - np.sin(2 * np.pi * t)[50:-50]).max() < 0.02


def test_consumed_answers_are_taken_once(spark):
    rows = [(1, 0.0, 1, "s"), (1, 1.0, 2, "s"), (1, 2.0, 3, "a"), (1, 3.0, 4, "a"), (1, 90.0, 5, "s"), (2, 0.0, 6, "a"), (2, 1.0, 7, "s")]
    df = spark.createDataFrame(rows, "k long, t double, row long, kind string")
    found = matching.consumed(df, "k", "t", "row", F.col("kind") == "s", F.col("kind") == "a", 36.0).collect()
    assert sorted((r["start_row"], r["answer_row"]) for r in found if r["answer_row"]) == [(1, 3), (2, 4)]
    assert {r["start_row"] for r in found} == {1, 2, 5, 7}


def test_fixations_need_their_duration(spark):
    rows = [(1, 0.1 * i, 0.0 if i < 5 else 9.0, 0.0) for i in range(7)]
    found = matching.fixations(spark.createDataFrame(rows, "k long, t double, x double, y double"), ["k"], "t", "x", "y", 1.0, 0.2).collect()
    assert [(round(r["start"], 1), round(r["end"], 1)) for r in found] == [(0.0, 0.4)]


def test_splits_do_not_leak(spark):
    df = spark.range(200).select(F.col("id"), (F.col("id") % 7).alias("g"))
    sides = splits.by_group(df, "g", 0.2).groupBy("g").agg(F.countDistinct("side").alias("n")).collect()
    assert {r["n"] for r in sides} == {1}
    timed = splits.temporal(df, ["g"], ["id"], 5).where("side = 'train'").groupBy("g").count().collect()
    assert {r["count"] for r in timed} == {5}


def test_holm_has_no_running_maximum(spark):
    df = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03)], "n string, p double")
    found = {r["n"]: round(r["p_holm"], 6) for r in calculus.holm(df, "p", [], ["n"]).collect()}
    assert found == {"a": 0.03, "c": 0.06, "b": 0.04}


def test_r_peaks_are_the_spikes(spark):
    at = [40 + 50 * i for i in range(10)]
    rows = [(1, i, 10.0 if i in at else 4.0 if i - 1 in at or i + 1 in at else 0.01 * (i % 3)) for i in range(600)]
    found = physiology.r_peaks(spark.createDataFrame(rows, "k long, i long, x double"), ["k"], ["i"], "x", 60.0).collect()
    assert sorted(r["frame"] for r in found) == at
    assert {r["height"] for r in found} == {10.0}
    empty = spark.createDataFrame([(1, 0, None), (1, 1, None)], "k long, i long, x double")
    assert physiology.r_peaks(empty, ["k"], ["i"], "x", 60.0).count() == 0


def test_power_lies_in_the_band_of_the_rhythm(spark):
    t, rows = 0.0, []
    for _ in range(150):
        rr = float(800 + 50 * np.sin(2 * np.pi * 0.25 * t))
        t += rr / 1000
        rows.append((1, t, rr))
    found = physiology.hrv_frequency(spark.createDataFrame(rows, "k long, t double, rr double"), ["k"], "t", steps=64).first()
    assert found["n_rr"] == 150 and found["hrv_hfn"] > 0.95
    assert 0.6 < found["hrv_hf"] / (50 * 50 / 2) < 1.4  # the variance of the rhythm


def test_sample_entropy_counts_all_pairs():
    x = np.random.default_rng(1).normal(size=80)
    within, n = 0.2 * x.std(ddof=1), 78
    plain = [sum(max(abs(x[i + k] - x[j + k]) for k in range(m)) <= within for i in range(n) for j in range(i + 1, n)) for m in (2, 3)]
    assert np.isclose(physiology.sample_entropy(x), -np.log(plain[1] / plain[0]))
    assert physiology.sample_entropy(np.arange(3.0)) is None


def test_scaling_exponent_of_noise_and_walk():
    noise = np.random.default_rng(2).normal(size=4000)
    assert abs(physiology.scaling_exponent(noise) - 0.55) < 0.12
    assert physiology.scaling_exponent(np.cumsum(noise)) > 1.3
    assert physiology.scaling_exponent(np.full(100, 1.0)) is None


def test_responses_rise_from_their_trough(spark):
    x = [0.0, -1.0, 4.0, 1.0, 1.3, 0.9, 0.0, 2.0, 0.0]
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(x)], "k long, i long, x double")
    found = physiology.scr_peaks(df, ["k"], ["i"], "x").where("scr_peak").collect()
    assert {r["i"]: round(r["scr_amplitude"], 6) for r in found} == {2: 5.0, 7: 2.0}


def test_a_permuted_column_keeps_its_values(spark):
    df = spark.range(500).select(F.col("id"), (F.col("id") * 2).alias("x"), F.lit(1).alias("y"))
    found = selection.permuted(df, "id", "x", groups=4).collect()
    assert sorted(r["x"] for r in found) == [2 * i for i in range(500)] and {r["id"] for r in found} == set(range(500))
    assert sum(r["x"] == 2 * r["id"] for r in found) < 50


def test_lent_values_are_those_of_permuted_columns(spark):
    df = spark.range(300).select("id", (F.col("id") % 3).cast("int").alias("fold"), (F.col("id") * 2).alias("x"), (F.col("id") * 5).alias("y"))
    groups = F.when(F.col("fold") == 0, 1).otherwise(4)
    found = {r["id"]: r["__other"] for r in selection.partnered(df, "id", ["x", "y"], F.col("fold"), groups, ["fold"]).collect()}
    for fold in range(3):
        own = df.where(F.col("fold") == fold)
        for c in ("x", "y"):
            permuted = selection.permuted(own, "id", c, fold, 4 if fold else 1).collect()
            assert len(permuted) == 100 and all(found[r["id"]][c] == r[c] for r in permuted)
    assert len(found) == 300


def test_selection_drops_noise(spark):
    rng = np.random.default_rng(3)
    rows = [(i, float(i % 2), 1.0, i % 2 + 0.1 * float(rng.normal()), float(rng.normal())) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, label double, weight double, good double, noise double")
    make = lambda features: selection.forest(features, trees=5, depth=3)
    steps = selection.backward_elimination(df, "id", ["good", "noise"], folds=2, make=make)
    assert [(s[1], s[4]) for s in steps] == [(2, ["noise"]), (1, [])]
    assert steps[-1][2] > 0.95


def test_components_explain_their_share(spark):
    rows = [(float(i % 17), 2.0 * (i % 17), float(i * 7 % 13)) for i in range(200)]
    out, shares = selection.principal_components(spark.createDataFrame(rows, "a double, b double, c double"), ["a", "b", "c"], 0.95)
    assert len(shares) == 2 and sum(shares) > 0.95
    assert out.columns == ["a", "b", "c", "components"] and out.first()["components"].size == 2


def test_blocks_are_filtered_as_the_whole_segment(spark):
    rng = np.random.default_rng(5)
    x = np.cumsum(rng.normal(size=1500))
    rows = [(1, i, None if i in (3, 700) else float(v)) for i, v in enumerate(x)]
    found = signal.low_pass(spark.createDataFrame(rows, "k long, i long, x double"), "k", ["i"], "x", 10.0, 60.0, block=128).orderBy("i").collect()
    b, a = signal.butterworth(4, 10.0, 60.0)
    got = np.array([np.nan if r["x_smooth"] is None else r["x_smooth"] for r in found])
    assert len(found) == 1500 and np.isnan(got[[3, 700]]).all()
    for lo, hi in ((0, 3), (4, 700), (701, 1500)):
        assert np.allclose(got[lo:hi], signal.zero_phase([x[lo:hi]], b, a)[0], atol=1e-8)


def test_matching_in_order_equals_the_plain_form(spark):
    rng = np.random.default_rng(6)
    rows = [(int(rng.integers(0, 3)), float(rng.integers(0, 300)), i, str(rng.choice(["s", "a", "x"]))) for i in range(500)]
    found = {r["start_row"]: r["answer_row"] for r in matching.consumed(spark.createDataFrame(rows, "k long, t double, row long, kind string"), "k", "t", "row", F.col("kind") == "s", F.col("kind") == "a", 7.0).collect()}
    taken, want = set(), {}
    for k, t, row, _ in sorted((r for r in rows if r[3] == "s"), key=lambda r: (r[0], r[1], r[2])):
        free = sorted((u, a) for own, u, a, kind in rows if kind == "a" and own == k and t <= u <= t + 7 and a not in taken)
        want[row] = free[0][1] if free else None
        taken.add(want[row])
    assert found == want


def test_answers_keep_equal_starts(spark):
    starts = spark.createDataFrame([(1, 5.0), (1, 5.0), (1, 50.0)], "k long, t double")
    answers = spark.createDataFrame([(1, 9.0), (1, 9.5)], "k long, t double")
    assert matching.with_answer(starts, answers, "k", "t", 10.0).count() == 2


def test_quantiles_are_exact(spark):
    rng = np.random.default_rng(7)
    for values in (rng.normal(size=501), rng.integers(0, 4, 300).astype(float), np.array([2.0]), np.full(50, 1.5)):
        df = spark.createDataFrame([(float(v), None) for v in values], "x double, y double")
        row = {r["column"]: r for r in statistics.described(df, ["x", "y"]).collect()}
        assert np.allclose([row["x"][f"p{q}"] for q in (25, 50, 75)], np.percentile(values, [25, 50, 75]))
        assert row["y"]["n"] == 0 and row["y"]["p50"] is None


def test_class_means_need_training_rows(spark):
    train = spark.createDataFrame([(1, "a", 0.0), (1, "b", 4.0), (1, "b", 6.0)], "fold int, label string, x double")
    test = spark.createDataFrame([(1, "a", 1.0), (1, "b", 9.0), (2, "a", 0.0)], "fold int, label string, x double")
    found = evaluation.by_class_means(train, test, ["fold"], "label", ["x"])
    assert sorted((r["fold"], r["x"], r["predicted"]) for r in found.collect()) == [(1, 1.0, "a"), (1, 9.0, "b"), (2, 0.0, None)]


def test_folds_are_fitted_without_their_rows(spark):
    rows = [(i, i % 3, float(i % 2), 1.0, float(i % 2)) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, part int, label double, weight double, x double")
    found = evaluation.fitted(df, "part", [0, 1, 2], lambda: selection.forest(["x"], trees=3, depth=2))
    assert found.count() == 60 and found.where("prediction <> label").count() == 0


def test_hops_are_at_least_one_row():
    assert [features.hop_of(60, 0.5), features.hop_of(1, 0.9), features.hop_of(60, 1.0), features.hop_of(1, 2.0)] == [30, 1, 30, 1]
