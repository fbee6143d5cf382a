"""Whitening against plain linear algebra, and on awkward rows."""

from __future__ import annotations

import numpy as np
import pytest

from cohortlens.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, part int, n string, whitened string, y string"


def table(spark, rows, slices=3):
    return spark.createDataFrame(spark.sparkContext.parallelize([(i, v, 1, 7, "x", "x", "x") for i, v in rows], slices), SCHEMA)


def plain(vectors, most=32):
    x = np.floor(64 * np.array(vectors, np.float32).astype(float)).astype(np.int64) + 1_000_000
    n, sums = len(x), x.sum(0)
    deviation = ((n * x - sums).astype(object) ** 2).sum(1)
    c = x - sums / n
    values, vecs = np.linalg.eigh(c.T @ c / n)
    keep = np.flatnonzero(values[::-1] > values[-1] * 1e-12)[:most]
    return deviation, c @ vecs[:, ::-1][:, keep] / np.sqrt(values[::-1][keep]), values[::-1][keep] / values.sum()


@pytest.mark.parametrize("n, d, most", [(500, 40, 32), (60, 6, 4)])
def test_equals_plain_linear_algebra(spark, monkeypatch, n, d, most):
    monkeypatch.setattr(whitening, "BLOCK_BYTES", 8 * d * 7)  # many blocks, the last one short
    monkeypatch.setattr(whitening, "BLOCKS_A_TASK", 2)
    r = np.random.default_rng(n)
    vectors = (r.normal(size=(n, d)) @ r.normal(size=(d, d))).astype(np.float32)
    got = whitening.whiten(table(spark, [(k, v.tolist()) for k, v in enumerate(vectors)]), most).toPandas()
    deviation, coordinates, explained = plain(vectors, most)
    assert len(got) == n * min(most, d) and (got["n"] == n).all()
    assert all(int(deviation[i]) == x for i, x in zip(got.vec_id, got.deviation))
    assert np.allclose(got.explained, explained[got.component - 1], rtol=1e-10)
    placed = np.zeros_like(coordinates)
    placed[got.vec_id, got.component - 1] = got.whitened
    assert np.allclose(placed * np.sign((placed * coordinates).sum(0)), coordinates, atol=1e-8)
    assert got.identity_error.nunique() == 1 and got.identity_error.iloc[0] < 1e-10


def test_odd_vectors_are_dropped_and_others_kept(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, [0.5, 1.0]), (2, None), (3, [None, 1.0]), (4, [inf, 0.0]), (5, [nan, 0.0]), (6, [3e38, 0.0]), (7, []), (8, [1.0, 2.0, 3.0]), (None, [0.25, -1.0]), (1, [0.5, 1.0]),
            (9, [-2.0, 0.125])]
    got = whitening.whiten(table(spark, rows)).collect()
    assert sorted((r.vec_id or 0, r.component) for r in got) == [(0, 1), (0, 2), (1, 1), (1, 1), (1, 2), (1, 2), (9, 1), (9, 2)]
    assert {r.n for r in got} == {4}


def test_directions_without_variance_have_no_rows(spark):
    rows = [(k, [k / 8, 1.0, k / 4]) for k in range(9)]
    got = whitening.whiten(table(spark, rows)).collect()
    assert {r.component for r in got} == {1} and len(got) == 9 and abs(got[0].explained - 1) < 1e-9
    for few in ([], [(1, [1.0, 2.0])], [(1, [1.0, 2.0])] * 3, [(1, None)]):
        assert whitening.whiten(table(spark, few)).count() == 0


def test_deviations_beyond_a_long(spark):
    got = whitening.whiten(table(spark, [(1, [1e12, 0.0]), (2, [0.0, 1.0]), (3, [-1e12, 4.0])])).collect()
    y = np.floor(64 * np.array([[1e12, 0], [0, 1], [-1e12, 4]], np.float32).astype(float)).astype(np.int64).astype(object)
    want = ((3 * y - y.sum(0)) ** 2).sum(1)
    assert all(r.deviation is None and int(r.deviation_decimal) == want[r.vec_id - 1] for r in got if r.vec_id != 2) and len(got) == 3  # the second direction is below rounding
