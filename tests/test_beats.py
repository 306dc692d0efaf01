"""Cleaning, classes and repair of beats, the monotone rate and its spectrum."""

import numpy as np
import pytest

from tidewave.operators import beats


def beat_times(n=300, seed=1):
    rng = np.random.default_rng(seed)
    return np.cumsum(0.85 + 0.05 * np.sin(np.arange(n) / 6) + rng.normal(size=n) * 0.002)


@pytest.fixture(scope="module")
def planted(spark):
    truth = beat_times()
    broken = {"missed": np.delete(truth, [60, 150]), "extra": np.sort(np.append(truth, [truth[80] + 0.4, truth[200] + 0.5])), "shifted": truth.copy(), "fine": truth}
    broken["shifted"][[70, 180]] += [0.25, -0.3]
    rows = [(k, float(t)) for k, ts in broken.items() for t in ts]
    return truth, broken, spark.createDataFrame(rows, "kind string, t double").repartition(5)


def test_planted_beats_are_found_and_repaired(planted):
    truth, broken, df = planted
    told = beats.classified(df, ["kind"], "t").toPandas()
    found = {k: g[g["class"] != "normal"] for k, g in told.groupby("kind")}
    at = lambda kind, name: sorted(found[kind][found[kind]["class"] == name].t.round(6))
    assert len(found["fine"]) == 0
    assert at("missed", "missed") == [round(truth[i], 6) for i in (61, 151)]
    assert at("extra", "extra") == [round(truth[i] + x, 6) for i, x in ((80, 0.4), (200, 0.5))]
    assert at("shifted", "ectopic") == sorted(round(x, 6) for x in broken["shifted"][[70, 180]])
    mended = beats.repaired(df, ["kind"], "t").toPandas()
    for kind, g in mended.groupby("kind"):
        ts = np.sort(g.t)
        assert len(ts) == len(truth) and np.abs(ts - truth).max() < 0.09, kind
        assert set(g.status) == {"missed": {"kept", "inserted"}, "extra": {"kept"}, "shifted": {"kept", "moved"}, "fine": {"kept"}}[kind]
        assert np.array_equal(ts[:50], truth[:50])
    again = beats.classified(mended_frame(df.sparkSession, mended), ["kind"], "t")
    assert again.where("class in ('missed', 'extra')").count() == 0


def mended_frame(spark, pdf):
    return spark.createDataFrame(pdf[["kind", "t"]])


def test_few_beats_have_no_class(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 1.0)], "k string, t double")
    assert {r["class"] for r in beats.classified(df, ["k"], "t").collect()} == {"normal"}
    assert beats.repaired(df, ["k"], "t").count() == 3 and beats.repaired(df.limit(0), ["k"], "t").count() == 0


def plain_slopes(t, y):
    h, s = np.diff(t), np.diff(y) / np.diff(t)
    if len(t) == 2:
        return np.array([s[0], s[0]])
    m = np.zeros(len(t))
    for i in range(1, len(t) - 1):
        if s[i - 1] * s[i] > 0:
            a, b = 2 * h[i] + h[i - 1], h[i] + 2 * h[i - 1]
            m[i] = (a + b) / (a / s[i - 1] + b / s[i])
    for i, (h0, h1, s0, s1) in ((0, (h[0], h[1], s[0], s[1])), (-1, (h[-1], h[-2], s[-1], s[-2]))):
        d = ((2 * h0 + h1) * s0 - h0 * s1) / (h0 + h1)
        m[i] = 0 if d * s0 <= 0 else 3 * s0 if s0 * s1 <= 0 and abs(d) > 3 * abs(s0) else d
    return m


def test_monotone_cubic(spark):
    rng = np.random.default_rng(4)
    series = {"a": (np.sort(rng.uniform(0, 20, 30)), rng.normal(size=30)), "b": (np.array([1.0, 2.5]), np.array([3.0, 4.0])), "c": (np.array([0.5]), np.array([1.0])), "d": (np.arange(10.0), np.cumsum(rng.uniform(0, 1, 10)))}
    rows = [(k, float(t), float(y)) for k, (ts, ys) in series.items() for t, y in zip(ts, ys, strict=True)] + [("d", 4.5, None)]
    found = beats.monotone_cubic(spark.createDataFrame(rows, "k string, time double, v double").repartition(4), ["k"], "time", "v", 0.25).toPandas()
    for k, (t, y) in series.items():
        own = found[found.k == k].sort_values("n")
        grid = [n for n in range(0, 90) if t[0] <= n * 0.25 <= t[-1]] if len(t) > 1 else []
        assert own.n.tolist() == grid
        m = plain_slopes(t, y) if len(t) > 1 else None
        for at, value in zip(own.t, own.y, strict=True):
            i = min(int(np.searchsorted(t, at, side="right")) - 1, len(t) - 2)
            h = t[i + 1] - t[i]
            u = (at - t[i]) / h
            expected = (1 + 2 * u) * (1 - u) ** 2 * y[i] + u * (1 - u) ** 2 * h * m[i] + u * u * (3 - 2 * u) * y[i + 1] + u * u * (u - 1) * h * m[i + 1]
            assert value == pytest.approx(expected)
    assert (np.diff(found[found.k == "d"].sort_values("n").y) >= -1e-12).all()


def test_welch(spark):
    rate, size = 4.0, 64
    t = np.arange(300) / rate
    x = 5 + 2 * np.sin(2 * np.pi * 0.25 * t) + np.random.default_rng(5).normal(size=300) * 0.1
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(x)] + [("short", 0, 1.0)], "k string, n int, x double").repartition(3)
    found = beats.welch(df, ["k"], ["n"], "x", rate, size).toPandas().sort_values("f")
    taper = np.hanning(size + 1)[:-1]
    segments = [x[i : i + size] for i in range(0, 300 - size + 1, size // 2)]
    plain = np.mean([np.abs(np.fft.rfft((s - s.mean()) * taper)) ** 2 / (rate * (taper**2).sum()) for s in segments], axis=0)
    plain[1:-1] *= 2
    assert set(found.k) == {"a"} and set(found.segments) == {len(segments)} and np.allclose(found.density, plain)
    power = beats.band_powers(spark.createDataFrame(found), ["k"], rate / size).first()
    assert power["hrv_hf"] == pytest.approx(2.0, rel=0.05) and power["hrv_hfn"] > 0.95  # a sine of amplitude 2
    assert power["hrv_tp"] == pytest.approx(sum(power[f"hrv_{b}"] for b in beats.BANDS)) and power["hrv_lnhf"] == pytest.approx(np.log(power["hrv_hf"]))


def test_cleaning(spark):
    rate = 250.0
    t = np.arange(2500) / rate
    beat = np.exp(-(((t % 0.8) - 0.4) ** 2) / 5e-4)
    x = beat + 3 * np.sin(2 * np.pi * 0.1 * t) + 0.5 * np.sin(2 * np.pi * 50 * t)
    df = spark.createDataFrame([("a", float(a), i, float(v) if i != 1300 else None) for i, (a, v) in enumerate(zip(t, x, strict=True))], "k string, t double, id int, x double")
    found = beats.cleaned(df, "k", ["t", "id"], "x", rate).toPandas().sort_values("id")
    clean = found.x_clean.to_numpy()
    assert np.isnan(clean[1300]) and abs(np.nanmean(clean[300:900])) < 0.05
    assert np.corrcoef(clean[300:900], beat[300:900])[0, 1] > 0.97
    sliced = beats.cleaned(df, "k", ["t", "id"], "x", rate, width=1.0).toPandas().sort_values("id")
    assert np.allclose(sliced.x_clean, clean, equal_nan=True, atol=1e-9)


def test_averaged_beat(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=1000) * 0.01
    places = list(range(50, 950, 60))
    for p in places:
        x[p - 2 : p + 3] += [0.2, 0.6, 1, 0.5, 0.1]
    x[places[4] - 2 : places[4] + 3] = [1, 0, 0, 0, 1]
    samples = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(x)], "k string, frame int, x double")
    found = {r["frame"]: r for r in beats.averaged_beat(samples, spark.createDataFrame([("a", p) for p in places], "k string, frame int"), ["k"], "x", 2, 2).collect()}
    epochs = np.stack([x[p - 2 : p + 3] for p in places])
    distances = np.sqrt(((epochs - epochs.mean(axis=0)) ** 2).sum(axis=1))
    assert [found[p]["distance"] for p in places] == pytest.approx(list(distances))
    assert found[places[4]]["quality"] == 0 and min(found[p]["quality"] for p in places if p != places[4]) > 0.8


def test_more_columns(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=120) * 40 + 800
    df = spark.createDataFrame([("a", float(v), float(d) if i else None) for i, (v, d) in enumerate(zip(x, np.diff(x, prepend=0), strict=True))], "k string, rr double, drr double")
    r = beats.hrv_more(df, ["k"]).first()
    d = np.diff(x)
    rmssd, sdnn, sd1 = np.sqrt((d**2).mean()), x.std(ddof=1), d.std(ddof=1) / np.sqrt(2)
    sd2 = np.sqrt(2 * sdnn**2 - d.std(ddof=1) ** 2 / 2)
    mad = np.median(np.abs(x - np.median(x))) * 1.4826
    expected = {"cvsd": rmssd / x.mean(), "sdrmssd": sdnn / rmssd, "madnn": mad, "mcvnn": mad / np.median(x), "prc20nn": np.quantile(x, 0.2), "prc80nn": np.quantile(x, 0.8), "hti": 120 / np.bincount((x // 7.8125).astype(int)).max(), "s": np.pi * sd1 * sd2, "csi": sd2 / sd1, "cvi": np.log10(16 * sd1 * sd2), "csi_modified": 4 * sd2**2 / sd1}
    assert {k: r[f"hrv_{k}"] for k in expected} == pytest.approx(expected)


def test_fragments(spark):
    rng = np.random.default_rng(8)
    series = {"a": np.round(rng.normal(size=200) * 20 + 800, 0), "b": np.array([800.0, 810, 800, 810, 800, 810, 820, 830, 840, 840])}
    rows = [(k, float(i), float(v), float(v - x[i - 1]) if i else None) for k, x in series.items() for i, v in enumerate(x)]
    found = {r["k"]: r for r in beats.hrv_fragments(spark.createDataFrame(rows, "k string, t double, rr double, drr double").repartition(3), ["k"], "t").collect()}
    for k, v in series.items():
        d, x, y, mean = np.diff(v), v[:-1], v[1:], v.mean()
        angle = np.abs(np.arctan2(y, x) - np.pi / 4)
        area, s = angle * (x**2 + y**2) / 2, np.sign(d)
        up, down, along = s > 0, s < 0, (x + y - 2 * mean) ** 2
        halves = [(d[m] ** 2 + along[m]).sum() + along[s == 0].sum() / 2 for m in (up, down)]
        runs, turns, at = [], [], 0
        for i in range(1, len(s) + 1):
            if i == len(s) or s[i] != s[i - 1]:
                runs.append((s[at], i - at))
                at = i
        at = 0
        for i in range(1, len(s) + 1):
            if i == len(s) or s[i] * s[i - 1] >= 0:
                turns.append(i - at)
                at = i
        runs = [n for sign, n in runs if sign]
        expected = {
            "si": 100 * angle[up].sum() / angle[s != 0].sum(), "ai": 100 * area[up].sum() / area[s != 0].sum(), "c1d": 100 * (d[up] ** 2).sum() / (d**2).sum(), "cd": 100 * halves[0] / sum(halves), "ca": 100 * halves[1] / sum(halves),
            "ials": len(runs) / sum(runs), "pss": 100 - 100 * sum(n for n in runs if n >= 3) / len(d), "pas": 100 * sum(n for n in turns if n >= 4) / len(d),
        }
        assert {c: found[k][f"hrv_{c}"] for c in expected} == pytest.approx(expected), k
