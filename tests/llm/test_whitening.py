"""Whitening against the eigenvectors of the whole covariance matrix."""

from decimal import Decimal

import numpy as np
import pytest

from tidewave.llm import whitening

SCHEMA = "vec_id long, embedding array<double>, component string, n string"


def frame(spark, vectors, ids=None):
    ids = range(len(vectors)) if ids is None else ids
    return spark.createDataFrame([(i, v if v is None else [None if x is None else float(x) for x in v], "c", None) for i, v in zip(ids, vectors, strict=True)], SCHEMA)


def plain(vectors, most=8):
    """n, sums, x, eigenvalues and eigenvectors, falling; sums and products in long doubles."""
    x = np.floor(1024 * np.array(vectors, float)).astype(np.int64) + 100_000
    n, sums = len(x), x.sum(axis=0)
    c = ((n * x - sums).astype(np.longdouble) / n)
    values, right = np.linalg.eigh((c.T @ c / n).astype(float))
    return n, sums, x, values[::-1], right[:, ::-1]


def check(spark, vectors, most=8, rank=None, exact=1e-9):
    n, sums, x, values, right = plain(vectors)
    found = whitening.whiten(frame(spark, vectors).repartition(3), most=most).collect()
    k = min(most, x.shape[1] if rank is None else rank)
    assert len(found) == n * k
    at = {(r["vec_id"], r["component"]): r for r in found}
    for j in range(k):
        y = np.array([at[i, j + 1]["whitened"] for i in range(n)])
        expected = (n * x - sums) / n @ right[:, j] / np.sqrt(values[j])
        assert min(np.abs(y - expected).max(), np.abs(y + expected).max()) < exact
        assert abs(at[0, j + 1]["explained"] / (values[j] / values.sum()) - 1) < 1e-9
    for i in range(n):
        assert at[i, 1]["deviation"] == sum(int(v) ** 2 for v in n * x[i] - sums) and at[i, 1]["n"] == n
    assert len({r["identity_error"] for r in found}) == 1 and found[0]["identity_error"] < 1e-9


def test_against_the_covariance(spark):
    rng = np.random.default_rng(2)
    check(spark, rng.normal(size=(700, 40)) * np.linspace(0.2, 3, 40))
    check(spark, rng.normal(size=(300, 3)) * [1, 2, 4])


def test_ill_conditioned(spark):
    rng = np.random.default_rng(3)
    check(spark, rng.normal(size=(400, 10)) * np.logspace(6, -2, 10) + 1e5, exact=1e-7)


def test_directions_without_variance(spark):
    rng = np.random.default_rng(4)
    base = np.round(rng.normal(size=(300, 4)) * 4)
    check(spark, np.hstack([base, base[:, :2], base[:, :1] + base[:, 1:2], np.ones((300, 1))]), rank=4)  # repeated, summed and constant
    few = rng.normal(size=(4, 30))
    check(spark, few, rank=3)  # fewer rows than entries


def test_rows_that_take_no_part_and_repeat(spark):
    rng = np.random.default_rng(5)
    good = rng.normal(size=(50, 4))
    nan, inf = float("nan"), float("inf")
    bad = [None, [1, 2, None, 4], [nan, 1, 2, 3], [1, 2, inf, 3], [-inf, 1, 2, 3]]
    df = frame(spark, [*good, *bad, good[0]], [*range(50), 90, 91, 92, 93, 94, None]).repartition(4)
    found = whitening.whiten(df).collect()
    assert len(found) == 51 * 4 and {r["vec_id"] for r in found} == {*range(50), None} and found[0]["n"] == 51
    one = {r["component"]: r["whitened"] for r in found if r["vec_id"] == 0}
    assert one == {r["component"]: r["whitened"] for r in found if r["vec_id"] is None}
    assert whitening.whiten(frame(spark, [[1, 2], [1, 2]])).count() == 0
    assert whitening.whiten(frame(spark, [None, [nan, 1]])).count() == 0
    assert whitening.whiten(frame(spark, [])).count() == 0
    with pytest.raises(Exception, match="different lengths"):
        whitening.whiten(frame(spark, [[1, 2], [1, 2, 3]]).repartition(1))
    with pytest.raises(Exception, match="doesn't fit"):
        whitening.whiten(frame(spark, [[1e300, 2], [1, 2]]))


def test_wide_deviations_and_factors(spark):
    found = whitening.whiten(frame(spark, [[2.0**34, 0], [-(2.0**34), 1], [0, 0]])).collect()
    assert {r["deviation"] for r in found if r["vec_id"] == 0} == {Decimal((3 * 2**44) ** 2 + 1024**2)}
    rng = np.random.default_rng(6)
    factor, rows = np.triu(rng.normal(size=(70, 70))) + 9 * np.eye(70), rng.normal(size=(20, 70))
    assert np.allclose(whitening.solved(rows, factor) @ factor, rows, atol=1e-10)
