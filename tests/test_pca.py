"""Principal components against a dense solver, and what has few directions or rows."""

import numpy as np
import pytest

from framelake.operators import pca


def table(spark, x):
    return spark.createDataFrame([(i, r) for i, r in enumerate(x.tolist())], "id int, x array<double>").repartition(3)


@pytest.mark.parametrize("n,width,k", [(400, 30, 3), (60, 300, 4), (900, 64, 2)])
def test_components_and_variances(spark, n, width, k):
    x = np.random.default_rng(n).standard_normal((n, width)) * np.linspace(1, 3, width) + 1e4
    mean, axes, value, total = pca.principal(table(spark, x), "x", k)
    want, vectors = np.linalg.eigh(np.cov(x.T, bias=True))
    assert np.allclose(value, want[::-1][:k], rtol=1e-8) and np.isclose(total, want.sum()) and np.allclose(mean, x.mean(0))
    assert np.allclose(np.abs((axes * vectors[:, ::-1][:, :k]).sum(0)), 1, atol=1e-6)
    assert (axes[np.abs(axes).argmax(0), range(k)] > 0).all() and np.allclose(axes.T @ axes, np.eye(k), atol=1e-10)
    got = pca.project(table(spark, x), "x", "pc", mean, axes).toPandas().sort_values("id")
    assert np.allclose(np.stack(got["pc"].to_list()), (x - x.mean(0)) @ axes, atol=1e-6)


def test_few_directions_and_rows(spark):
    line = np.outer(np.arange(5.0), [3, 0, 4])
    _, axes, value, total = pca.principal(table(spark, line), "x", 2)
    assert np.allclose(value, [50]) and np.isclose(total, 50) and np.allclose(axes[:, 0], [0.6, 0, 0.8])
    assert pca.principal(table(spark, line[:1]), "x", 2)[2].size == 0
    assert pca.principal(spark.createDataFrame([], "id int, x array<double>"), "x", 2)[3] == 0.0


def test_rows_of_bytes_are_as_rows_of_arrays(spark):
    x = np.random.default_rng(2).integers(0, 256, (200, 40))
    packed = spark.createDataFrame([(i, bytes(r)) for i, r in enumerate(x.astype(np.uint8).tolist())], "id int, x binary").repartition(3)
    for a, b in zip(pca.principal(packed, "x", 3), pca.principal(table(spark, x.astype(float)), "x", 3), strict=True):
        assert np.allclose(a, b)
