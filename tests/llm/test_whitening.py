"""Whitening against numpy's eigenvectors and Python's integers."""

import math

import numpy as np
import pytest

from sluice.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(vectors):
    """x, deviations, variances (falling), axes and trace of a list of vectors."""
    x = [[math.floor(1024 * float(np.float32(c))) + 100_000 for c in v] for v in vectors]
    n, s = len(x), [sum(c) for c in zip(*x)]
    dev = [sum((n * a - b) ** 2 for a, b in zip(row, s)) for row in x]
    c = np.array([[a - b / n for a, b in zip(row, s)] for row in x])
    v = c.T @ c / n
    values, axes = np.linalg.eigh(v)
    return c, dev, values[::-1], axes[:, ::-1], np.trace(v)


def compare(found, ids, vectors, count=8):
    c, dev, values, axes, trace = plain(vectors)
    k = min(count, c.shape[1])
    by = {}
    for r in found:
        by.setdefault(r.vec_id, {})[r.component] = r
    assert sorted(by) == sorted(ids) and all(sorted(b) == [*range(1, k + 1)] for b in by.values())
    z = np.array([[by[i][j + 1].whitened for j in range(k)] for i in ids])
    want = c @ axes[:, :k] / np.sqrt(values[:k])
    want *= np.sign((want * z).sum(0))
    np.testing.assert_allclose(z, want, rtol=0, atol=1e-7)
    assert [by[i][1].deviation for i in ids] == dev
    assert {r.n for r in found} == {len(ids)}
    for j in range(k):
        assert abs(by[ids[0]][j + 1].explained - values[j] / trace) <= 1e-10
    errors = {r.identity_error for r in found}
    assert len(errors) == 1 and errors.pop() <= 1e-9


def test_close_spectrum_expands_to_full_dimension(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = df.collect()
    compare(whitening.whitened(df).collect(), [r.vec_id for r in rows], [r.embedding for r in rows])
    assert whitening.fit(whitening.quantised(df)).full


def test_steep_spectrum_needs_no_expansion(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(400, 40)) * 0.1 ** np.minimum(np.arange(40) / 2, 20)
    v[:, 16:] = 0
    df = spark.createDataFrame([(i, [float(c) for c in row], 0) for i, row in enumerate(v)], SCHEMA).repartition(5)
    model = whitening.fit(whitening.quantised(df), count=4)
    assert not model.full
    _, _, values, axes, trace = plain(v)
    np.testing.assert_allclose(model.variances, values[:4], rtol=1e-10)
    np.testing.assert_allclose(np.abs((model.axes * axes[:, :4]).sum(0)), 1, atol=1e-10)
    assert abs(model.trace - trace) < 1e-6 * trace


@pytest.mark.parametrize("dim", [1, 3])
def test_few_dimensions(spark, dim):
    rng = np.random.default_rng(dim)
    v = rng.normal(size=(50, dim)).astype(np.float32)
    df = spark.createDataFrame([(i, row.tolist(), 0) for i, row in enumerate(v)], SCHEMA)
    compare(whitening.whitened(df).collect(), [*range(50)], v)


def test_odd_rows(spark):
    rows = [
        (1, [1.0, 2.0], 5), (1, [1.0, 2.0], 5), (None, [0.5, -3.0], 0), (2, None, 0), (3, [1.0, None], 0), (4, [float("nan"), 0.0], 0), (5, [float("inf"), 0.0], 0), (6, [7.0], 0), (7, [], 0),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, component int")
    found = whitening.whitened(df).collect()
    # short vectors are filled up with zeros; repeated and null ids count
    assert sorted((r.vec_id is not None, r.vec_id, r.component) for r in found if r.vec_id) == sorted((True, i, c) for i in (1, 1, 6, 7) for c in (1, 2))
    assert len(found) == 10 and {r.n for r in found} == {5}
    x = [[101024, 102048], [101024, 102048], [100512, 96928], [107168, 100000], [100000, 100000]]
    s = [sum(c) for c in zip(*x)]
    assert sorted({r.deviation for r in found}) == sorted({sum((5 * a - b) ** 2 for a, b in zip(row, s)) for row in x})


def test_without_variance_or_rows(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0)], SCHEMA)
    assert {(r.whitened, r.explained, r.identity_error, r.deviation) for r in whitening.whitened(df).collect()} == {(None, 0.0, 0.0, 0)}
    line = spark.createDataFrame([(i, [float(i), 2.0 * i], 0) for i in range(9)], SCHEMA)
    second = [r for r in whitening.whitened(line).collect() if r.component == 2]
    assert {r.whitened for r in second} == {None} and all(r.identity_error < 1e-9 for r in second)
    assert whitening.whitened(df.limit(0)).collect() == []
    assert whitening.whitened(spark.createDataFrame([(1, [], 0), (2, None, 0)], SCHEMA)).collect() == []


def test_numbers_that_a_long_cannot_hold(spark):
    df = spark.createDataFrame([(i, [3e38 if i == 1 else 0.0, float(i)]) for i in range(4)], "vec_id long, embedding array<double>")
    found = {r.vec_id: r for r in whitening.whitened(df).collect() if r.component == 1}
    assert found[1].deviation is None and len(found) == 4
    big = spark.createDataFrame([(i, [float(i) * 1e6]) for i in range(4)], "vec_id long, embedding array<double>")
    x = [int(i * 1e6 * 1024) + 100_000 for i in range(4)]
    assert {r.vec_id: r.deviation for r in whitening.whitened(big).collect()} == {i: (e if (e := (4 * a - sum(x)) ** 2) < 1 << 63 else None) for i, a in enumerate(x)}
