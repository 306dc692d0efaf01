"""Entropies, dimensions and exponents against plain forms and known values."""

import math
from collections import Counter

import numpy as np
import pytest

from tidewave.operators import complexity, physiology

RNG = np.random.default_rng(12)
NOISE, WALK = RNG.normal(size=3000), np.cumsum(RNG.normal(size=3000))
SERIES = [RNG.normal(size=60), np.round(RNG.normal(size=80) * 3), np.sin(np.arange(90) / 5) + RNG.normal(size=90) * 0.1]


def distance(a, b):
    return max(abs(p - q) for p, q in zip(a, b, strict=True))


def plain_pairs(x, m, n, r):
    at = [x[i : i + m] for i in range(n)]
    return sum(distance(at[i], at[j]) <= r for i in range(n) for j in range(i + 1, n))


def test_entropies_equal_plain_forms():
    for x in SERIES:
        r, n = 0.2 * x.std(ddof=1), len(x) - 2
        assert complexity.sample_counts(x, 2, r) == (plain_pairs(x, 2, n, r), plain_pairs(x, 3, n, r))
        phi = []
        for m in (2, 3):
            at = [x[i : i + m] for i in range(len(x) - m + 1)]
            phi.append(np.mean([math.log(sum(distance(a, b) <= r for b in at) / len(at)) for a in at]))
        assert complexity.approximate_entropy(x) == pytest.approx(phi[0] - phi[1])
        like = []
        for m in (2, 3):
            at = [x[i : i + m] - x[i : i + m].mean() for i in range(n)]
            like.append(sum(math.exp(-((distance(at[i], at[j]) / r) ** 2)) for i in range(n) for j in range(i + 1, n)))
        assert complexity.fuzzy_entropy(x) == pytest.approx(math.log(like[0] / like[1]), rel=1e-6)


def test_multiscale():
    x = SERIES[2]
    r, plain, refined = 0.2 * x.std(ddof=1), [], []
    for s in complexity.SCALES:
        counts = []
        for k in range(s):
            y = np.array([x[i : i + s].mean() for i in range(k, len(x) - s + 1, s)])
            counts.append((plain_pairs(y, 2, len(y) - 2, r), plain_pairs(y, 3, len(y) - 2, r)))
        if min(counts[0]):
            plain.append(math.log(counts[0][0] / counts[0][1]))
        a, b = np.sum(counts, axis=0)
        if a and b:
            refined.append(math.log(a / b))
    found = complexity.multiscale(x)
    assert found[0] == pytest.approx(np.mean(plain)) and found[2] == pytest.approx(np.mean(refined)) and found[1] is not None
    assert complexity.multiscale(np.ones(50)) == (None, None, None)


def test_known_exponents_and_dimensions():
    two = list(complexity.MOMENTS).index(2)
    for sizes in (complexity.SHORT, complexity.LONG):
        assert complexity.scaling(NOISE, sizes)[two] == pytest.approx(0.5, abs=0.12)
        assert complexity.scaling(WALK, sizes)[two] == pytest.approx(1.5, abs=0.12)
    assert complexity.scaling(NOISE, complexity.SHORT)[two] == pytest.approx(physiology.scaling_exponent(NOISE), abs=1e-9)
    assert complexity.correlation_dimension(NOISE) == pytest.approx(2, abs=0.25) and complexity.correlation_dimension(np.linspace(0, 1, 500)) == pytest.approx(1, abs=0.1)
    assert complexity.lempel_ziv(NOISE) == pytest.approx(1, abs=0.12) and complexity.lempel_ziv(np.sin(np.arange(3000) / 9)) < 0.15
    assert complexity.parsed_phrases(np.array([0, 0, 0, 1, 1, 0, 1, 0, 0, 1, 0, 0, 0, 1, 0, 1])) == 6  # 0 001 10 100 1000 101
    h = complexity.scaling(NOISE, complexity.LONG)
    named = dict(zip(complexity.SPECTRUM, complexity.spectrum(h), strict=True))
    assert 0 < named["Width"] < 0.5 and named["Max"] == pytest.approx(1, abs=0.05) and -0.5 <= named["Asymmetry"] <= 0.5
    multifractal = np.exp(np.cumsum(RNG.normal(size=3000)) * 0.02) * RNG.normal(size=3000)
    assert complexity.spectrum(complexity.scaling(multifractal, complexity.LONG))[0] > named["Width"]
    assert complexity.scaling(NOISE[:100], complexity.LONG) is None


def test_triangle():
    x = np.concatenate([np.full(n, 800 + 7.8125 * (i + 0.5)) for i, n in enumerate([10, 20, 30, 40, 30, 20, 10])])
    assert complexity.triangle_base(x) == pytest.approx(7.8125 * 8)
    assert complexity.triangle_base(np.full(5, 800.0)) == pytest.approx(2 * 7.8125) and complexity.triangle_base(np.ones(1)) is None


@pytest.fixture(scope="module")
def windows(spark):
    rows = []
    for w, x in enumerate([*SERIES, NOISE[:300] * 20 + 800, np.full(30, 800.0), np.arange(40.0)]):
        rows += [(w, float(i), float(v)) for i, v in enumerate(x)]
    return spark.createDataFrame([*rows, (9, 0.0, 1.0), (9, 1.0, None)], "w int, t double, rr double").repartition(6)


def test_columns_of_windows(windows):
    found = {r["w"]: r.asDict() for r in complexity.hrv_complexity(windows, ["w"], "t").collect()}
    assert set(found) == set(range(6)) and len(complexity.COLUMNS) == 25
    for w, x in enumerate(SERIES):
        for c, v in complexity.measured(x).items():
            assert (found[w][c] is None) == (v is None) and (v is None or found[w][c] == pytest.approx(v)), c
    assert found[4]["hrv_apen"] is None and found[4]["n_rr"] == 30


def test_a_window_has_a_bound(windows, monkeypatch):
    monkeypatch.setattr(complexity, "MOST_INTERVALS", 200)
    with pytest.raises(Exception, match="more than 200 intervals"):
        complexity.hrv_complexity(windows, ["w"], "t").collect()


def test_symbols(windows):
    found = {r["w"]: r for r in complexity.hrv_symbols(windows, ["w"], "t", 0.5).collect()}
    for w, x in enumerate(SERIES):
        counts = Counter(np.floor(np.abs(x) / 0.5 + 0.5) * np.sign(x) + 0.0)
        p = np.array(list(counts.values())) / len(x)
        assert found[w]["hrv_shanen"] == pytest.approx(-(p * np.log2(p)).sum())
        orders = Counter(tuple(sorted(range(3), key=lambda j, i=i: (x[i + j], j))) for i in range(len(x) - 2))
        p = np.array(list(orders.values())) / (len(x) - 2)
        assert found[w]["hrv_permen"] == pytest.approx(-(p * np.log2(p)).sum() / math.log2(6))
    assert found[9]["hrv_permen"] is None and found[9]["hrv_shanen"] == 0


def test_curves(spark, windows):
    found = {r["w"]: r for r in complexity.hrv_curves(windows, ["w"], "t").collect()}
    for w, x in enumerate(SERIES):
        n, logs = len(x), []
        for k in range(1, 9):
            lengths = []
            for m in range(k):
                steps = np.abs(np.diff(x[m::k]))
                lengths.append(steps.sum() * (n - 1) / len(steps) / k / k)
            logs.append((math.log(1 / k), math.log(np.mean(lengths))))
        assert found[w]["hrv_hfd"] == pytest.approx(np.polyfit(*zip(*logs, strict=True), 1)[0])
        path, far = np.abs(np.diff(x)).sum(), np.abs(x - x[0]).max()
        assert found[w]["hrv_kfd"] == pytest.approx(math.log(n - 1) / (math.log(n - 1) + math.log(far / path)))
    assert found[5]["hrv_hfd"] == pytest.approx(1) and found[5]["hrv_kfd"] == pytest.approx(1)
    assert found[3]["hrv_hfd"] == pytest.approx(2, abs=0.15) and found[4]["hrv_kfd"] is None and found[9]["hrv_hfd"] is None
