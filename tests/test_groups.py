"""Functions of many small groups in a task."""

import numpy as np

from tidewave.operators import groups, matching


def test_groups_are_whole_whatever_the_batches(spark):
    rng = np.random.default_rng(4)
    rows = [(None if k % 7 == 0 else f"k{k % 11}", int(k % 3) if k % 5 else None, float("nan") if k % 13 == 0 else float(k % 2), float(v)) for k, v in enumerate(rng.integers(0, 50, 900))]
    df = spark.createDataFrame(rows, "a string, b long, c double, v double").repartition(6)
    expected: dict[tuple, list] = {}
    for a, b, c, v in rows:
        expected.setdefault((a, b, str(c)), []).append(v)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for size in ("1", "3", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            found = groups.applied(df, ["a", "b", "c"], ["v"], lambda v: [[float(v.sum())], [len(v)], [float((np.diff(v) >= 0).all())]], {"s": "double", "n": "long", "sorted": "double"}).collect()
        finally:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
        assert {(r["a"], r["b"], str(r["c"])): (r["s"], r["n"], r["sorted"]) for r in found} == {k: (sum(v), len(v), 1.0) for k, v in expected.items()}
        assert len(found) == len(expected)
    assert groups.applied(df.limit(0), ["a"], ["v"], lambda v, b, c: [[1]], {"n": "long"}).count() == 0


def test_whole_groups_are_worked_on_together(spark):
    df = spark.createDataFrame([(f"k{k}", i, float(k * i)) for k in range(300) for i in range(k % 5 + 1)], "k string, i long, v double").repartition(6)

    def each(rows, starts):
        v = rows.column("v").to_numpy()
        return np.ones(len(starts), int), [np.add.reduceat(v, starts), np.diff(np.append(starts, len(v))), np.full(len(starts), len(starts))]

    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for size in ("2", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            found = groups.together(df, ["k"], ["i"], each, {"s": "double", "n": "long", "at_once": "long"}).collect()
        finally:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
        assert sorted((r["k"], r["s"], r["n"]) for r in found) == sorted((f"k{k}", float(k * sum(range(k % 5 + 1))), k % 5 + 1) for k in range(300))
    assert max(r["at_once"] for r in found) > 10


def test_fixations_have_no_call_a_group(spark):
    df = spark.createDataFrame([(k, float(i), 0.0, 0.0) for k in range(400) for i in range(2)], "k long, t double, x double, y double")
    found = matching.fixations(df, ["k"], "t", "x", "y", 1.0, 0.5)
    assert "FlatMapGroupsInPandas" not in found._jdf.queryExecution().toString() and found.count() == 400


def test_overlapping_windows_are_counted_without_remembering_them(spark):
    from tidewave.plans import registry

    found = registry.queries()["hops_of_overlap"](spark, "/root/testdata/sf0.001")
    assert "distinct" not in found._jdf.queryExecution().optimizedPlan().toString().lower() and found.where("windows * 10 != rows").count() == 0


def test_frequencies_are_sums_over_one_row_an_interval(spark):
    from tidewave.operators import physiology

    rows = [(k, float(i) + 0.01 * ((i * 7) % 5), float(800.0 + 50 * np.sin(i * (k + 1)))) for k in range(3) for i in range(40)]
    found = physiology.hrv_frequency(spark.createDataFrame(rows, "k long, t double, rr double"), ["k"], "t")
    assert "Generate" not in found._jdf.queryExecution().optimizedPlan().toString()
    for r in found.collect():
        t, x = np.array([(b, c) for a, b, c in rows if a == r["k"]]).T
        for band, (lo, hi) in physiology.BANDS.items():
            f = lo + (hi - lo) * (np.arange(8) + 0.5) / 8
            turn = 2 * np.pi * f[:, None] * (t - t.min())
            power = 2 * ((((x - x.mean()) * np.cos(turn)).sum(1)) ** 2 + (((x - x.mean()) * np.sin(turn)).sum(1)) ** 2) * x.sum() / 1000 / len(x) ** 2
            assert abs(r[f"hrv_{band}"] - (power * (hi - lo) / 8).sum()) < 1e-6 * max(1, power.sum())
