"""Whitening against dense linear algebra."""

import math
import random

import numpy as np
import pytest

from tenderloom.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, key string, index int, x int, n int, part string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "k", 2, 3, 4, "p") for i, v in rows], SCHEMA).repartition(3)


def expected(rows):
    rows = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    d = max(len(v) for _, v in rows)
    grid = [(i, [math.floor(256 * float(np.float32(c))) for c in v] + [0] * (d - len(v))) for i, v in rows]
    fit = np.unique(np.array([x for _, x in grid]), axis=0)
    n, s = len(fit), fit.sum(axis=0)
    centred = fit - s / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    return grid, n, s, values[::-1], axes[:, ::-1]


def check(spark, rows, components=4):
    got = whitening.whitened_vectors(frame(spark, rows), components).collect()
    grid, n, s, values, axes = expected(rows)
    width = min(components, len(s))
    assert len(got) == len(grid) * width
    by_id = {}
    for i, x in grid:
        by_id.setdefault(i, []).append(x)
    signs = {}
    for r in got:
        k = r.component - 1
        x = np.array(by_id[r.vec_id][0])
        assert r.n == n and r.deviation == int(((n * x - s) ** 2).sum())
        assert r.explained == pytest.approx(values[k] / values.sum(), rel=1e-9)
        want = (x - s / n) @ axes[:, k] / np.sqrt(values[k])
        assert abs(r.whitened) == pytest.approx(abs(want), abs=1e-6)
        if abs(want) > 1e-3:
            signs.setdefault(k, set()).add(want * r.whitened > 0)
        assert r.identity_error < 1e-9
    assert all(len(x) == 1 for x in signs.values())
    return got


def vectors(n, d, seed=1):
    rng = random.Random(seed)
    return [(i, [rng.gauss(0, 1 + j) for j in range(d)]) for i in range(n)]


def test_against_dense(spark):
    check(spark, vectors(300, 9))


def test_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK_CELLS", 64)
    check(spark, vectors(301, 8))


def test_odd_vectors(spark):
    rows = vectors(60, 5)
    rows += [(100, None), (101, [1.0, None, 2.0, 0.0, 1.0]), (102, [1.0, math.nan, 2.0, 0.0, 1.0])]
    rows += [(103, [math.inf, 0.0, 0.0, 0.0, 0.0]), (104, [-0.0, 0.25]), (105, []), (None, [0.5] * 5), (7, rows[7][1])]
    rows += [(200 + i, rows[3][1]) for i in range(40)]
    got = check(spark, rows)
    assert sum(r.vec_id == 7 for r in got) == 8 and not any(r.vec_id in (100, 101, 102, 103) for r in got)


def test_copies_weigh_nothing(spark):
    rows = vectors(50, 4)
    copied = rows + [(1_000 + i, rows[0][1]) for i in range(200)]
    a = {(r.vec_id, r.component): abs(r.whitened) for r in check(spark, rows)}
    b = {(r.vec_id, r.component): abs(r.whitened) for r in check(spark, copied)}
    assert all(b[k] == pytest.approx(v, abs=1e-8) for k, v in a.items())


def test_fewer_dimensions_than_components(spark):
    assert {r.component for r in check(spark, vectors(20, 2))} == {1, 2}


def test_no_variance(spark):
    got = whitening.whitened_vectors(frame(spark, [(1, [0.5, 1.0]), (2, [0.5, 1.0])])).collect()
    assert len(got) == 4
    assert all(r.n == 1 and r.deviation == 0 and r.whitened is None and r.identity_error is None for r in got)
    flat = whitening.whitened_vectors(frame(spark, [(1, [0.5, 1.0]), (2, [1.5, 1.0])])).collect()
    assert all((r.whitened is None) == (r.component == 2) and r.identity_error < 1e-9 for r in flat)


def test_empty(spark):
    assert whitening.whitened_vectors(frame(spark, [(1, None)]).where("false")).collect() == []
    assert whitening.whitened_vectors(frame(spark, [(1, None), (2, [])])).collect() == []


def test_large_entries(spark):
    got = whitening.whitened_vectors(frame(spark, [(1, [1e30, 0.0]), (2, [0.0, 3.0]), (3, [-1e9, 2.0])])).collect()
    assert {r.vec_id for r in got} == {1, 2, 3}
    one = [r for r in got if r.vec_id == 1 and r.component == 1][0]
    assert one.deviation is None and math.isfinite(one.whitened)
