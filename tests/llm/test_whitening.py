import math

import numpy as np
import pytest

from calendrix.llm import whitening

SCHEMA = "vec_id long, embedding array<float>"


def usable(rows):
    return [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]


def whole(v):
    return tuple(math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v)


def plain(rows, components=16):
    """{(vec_id, component): (n, deviation, |whitened|, explained)} by the covariance matrix in long doubles."""
    xs = sorted({whole(v) for _, v in usable(rows)})
    n, sums = len(xs), [sum(c) for c in zip(*xs)]
    x = np.array(xs, float) - 1_000_000
    mean = np.array([s - n * 1_000_000 for s in sums]) / n
    values, vectors = np.linalg.eigh((x - mean).T @ (x - mean) / n)
    order = np.argsort(values)[::-1][:components]
    out = {}
    for i, v in usable(rows):
        own = whole(v)
        z = (np.array(own, float) - 1_000_000 - mean) @ vectors[:, order] / np.sqrt(values[order])
        deviation = sum((n * c - s) ** 2 for c, s in zip(own, sums))
        for k in range(len(order)):
            out[i, k + 1] = (n, deviation, z[k], values[order][k] / values.sum())
    return out


def random_rows(n=700, dim=24, seed=9):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, dim)) @ (rng.normal(size=(dim, dim)) * np.linspace(0.05, 2, dim)) + 3
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(base)]
    rows += [(1000 + i, rows[5][1]) for i in range(400)]
    rows += [(2000, None), (2001, [None] + [0.0] * (dim - 1)), (2002, [float("nan")] * dim), (2003, [float("inf")] + [0.0] * (dim - 1)), (2004, [])]
    return rows


@pytest.mark.parametrize("partitions,fan,chunk", [(1, 16, 4096), (40, 3, 7)])
def test_rows_are_the_plain_ones(spark, monkeypatch, partitions, fan, chunk):
    """Merged in many levels of few rows each, or decomposed at once: the same components."""
    monkeypatch.setattr(whitening, "FAN", fan)
    monkeypatch.setattr(whitening, "CHUNK", chunk)
    rows = random_rows()
    df = spark.createDataFrame(rows, SCHEMA).repartition(partitions).selectExpr("*", "1 AS x", "2 AS n", "3 AS dim")
    got = whitening.whiten(df)
    assert [f.name for f in got.schema] == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    expected = plain([r for r in rows if r[1] != []])
    own = {(r.vec_id, r.component): r for r in got.collect()}
    assert own.keys() == expected.keys()
    signs = {k: np.sign(own[0, k].whitened * expected[0, k][2]) for k in range(1, 17)}
    for (i, k), (n, deviation, z, explained) in expected.items():
        r = own[i, k]
        assert (r.n, int(r.deviation)) == (n, deviation)
        assert r.whitened == pytest.approx(signs[k] * z, abs=1e-6)
        assert r.explained == pytest.approx(explained, rel=1e-9)
        assert r.identity_error < 1e-9


def test_summaries_lose_no_dimension():
    """Directions whose variances differ by 16 decimal orders keep their digits through many merges."""
    rng = np.random.default_rng(2)
    axes = np.linalg.qr(rng.normal(size=(12, 12)))[0]
    rows = np.floor(rng.normal(size=(3000, 12)) * 10.0 ** np.linspace(8, 0.5, 12) @ axes.T * 64).astype(np.int64) + 1_000_000
    held = None
    for at in range(0, 3000, 37):
        own = whitening.Summary.of(rows[at : at + 37])
        held = held.merged(own) if held else own
    assert held.n == 3000 and held.sums.tolist() == [int(s) for s in rows.astype(object).sum(axis=0)]
    space = whitening.Space.of(held, 12)
    d = (rows * 3000 - rows.sum(axis=0)).astype(np.longdouble) / 3000
    z = np.asarray(d @ space.axes.astype(np.longdouble), float) / np.sqrt(space.values)
    assert np.abs(z.T @ z / 3000 - np.eye(12)).max() < 1e-6
    assert np.abs(space.axes.T @ space.axes - np.eye(12)).max() < 1e-12


def test_odd_tables(spark):
    make = lambda rows: whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    assert make([]) == [] and make([(1, None)]) == [] and make([(1, [])]) == []
    # One distinct vector: no variance, all whiten to 0.
    assert [(r.vec_id, r.component, r.n, int(r.deviation), r.whitened, r.explained, r.identity_error) for r in make([(1, [2.0]), (None, [2.0])])] == [
        (1, 1, 1, 0, 0.0, 0.0, 0.0), (None, 1, 1, 0, 0.0, 0.0, 0.0),
    ]
    # A constant dimension, vectors of two lengths and an entry beyond whole numbers.
    got = make([(1, [0.0, 1.0]), (2, [1.0, 1.0]), (3, [5.0]), (4, [7.0]), (5, [3e38, 0.0, 0.0]), (6, [0.0, 0.0, 0.0])])
    by = {(r.vec_id, r.component): r for r in got}
    assert abs(by[1, 1].whitened) == pytest.approx(1) and by[1, 2].whitened == 0 and by[1, 1].explained == 1
    assert by[3, 1].n == 2 and by[3, 1].whitened == -by[4, 1].whitened
    assert by[5, 1].deviation == (2 * (2**50 + 10**6) - (2**50 + 2 * 10**6)) ** 2
    assert all(r.identity_error < 1e-9 for r in got)


def test_deviations_are_exact_on_both_ways():
    rows = np.array([[1_000_003, 999_990], [1_000_064, 1_000_000]])
    for n in (5, 10**10):
        space = whitening.Space(n, np.array([1_000_001 * n, 999_999 * n + 3], object), np.ones(2), np.eye(2), 2.0)
        assert space.deviations(rows) == [sum((n * int(c) - int(s)) ** 2 for c, s in zip(row, space.sums)) for row in rows]
