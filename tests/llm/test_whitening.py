"""Rank-one updates, merges and the query's rows against numpy on the whole matrix."""

import math

import numpy as np
import pytest

from qaflow.llm import whitening as W
from qaflow.llm.queries import Q
from tests.conftest import SF_SMALL

SCHEMA = "vec_id bigint, embedding array<float>, label int, x string, n string, key int, component string"


@pytest.mark.parametrize("seed", range(40))
def test_rank_one(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(1, 9))
    d = np.sort(rng.random(n) * 10.0 ** rng.integers(-8, 2, n) if seed % 2 else rng.integers(0, 3, n).astype(float))
    z = rng.normal(size=n) * 10.0 ** rng.integers(-9, 2, n) if seed % 2 else rng.integers(-1, 3, n).astype(float)
    basis = np.linalg.qr(rng.normal(size=(n, n)))[0]
    for rho in (0.0, 1e-3, 50.0):
        whole = basis * d @ basis.T + rho * np.outer(z, z)
        values, vectors = W.rank_one(d, basis, z, rho)
        assert (np.diff(values) >= 0).all()
        assert np.abs(vectors.T @ vectors - np.eye(n)).max() < 1e-13
        assert np.abs(vectors * values @ vectors.T - whole).max() <= 1e-13 * max(np.abs(whole).max(), 1e-300)


@pytest.mark.parametrize("block", [1, 7, 500])
def test_spectrum(block):
    rng = np.random.default_rng(1)
    rows = np.floor(rng.normal(size=(500, 12)) * np.linspace(1, 40, 12) * 100) + 900
    rows[50:200] = rows[3]  # copies
    rows[:, 5] = 17  # no variance
    parts = [W.Spectrum(12) for _ in range(3)]
    for k, part in enumerate(parts):
        own = rows[k::3]
        for at in range(0, len(own), block):
            part.add(own[at : at + block])
    for other in parts[1:]:
        parts[0].merge(W.Spectrum.load(other.dump()))
    got, centred = parts[0], rows - rows.mean(0)
    want = np.linalg.eigvalsh(centred.T @ centred)
    assert got.n == 500 and np.allclose(got.mean, rows.mean(0))
    assert np.abs(got.d - want).max() < 1e-12 * want.max()
    assert np.abs(got.u.T @ got.u - np.eye(12)).max() < 1e-11


def expected(vectors):
    x = np.floor(np.array(vectors, np.float64) * 1024).astype(np.int64) + 100_000
    n, s = len(x), x.sum(0)
    dev = ((x * n - s).astype(object) ** 2).sum(1)
    c = x - s / n
    values, basis = np.linalg.eigh(c.T @ c / n)
    return dev, c, values[::-1], basis[:, ::-1]


def compare(rows, vectors, ids, k):
    dev, c, values, basis = expected(vectors)
    got = {}
    for r in rows:
        got.setdefault(r.vec_id, []).append(r)
    assert len(rows) == len(ids) * k
    for j in range(k):
        mine = np.array([next(r.whitened for r in got[i] if r.component == j + 1) for i in ids])
        if values[j] < 1e-6:
            assert not mine.any()
            continue
        want = c @ basis[:, j] / math.sqrt(values[j])
        assert min(np.abs(mine - want).max(), np.abs(mine + want).max()) < 1e-7
    for i, dv in zip(ids, dev, strict=True):
        for r in got[i]:
            assert r.n == len(ids) and int(r.deviation) == int(dv) and r.identity_error < 1e-9
            assert abs(r.explained - max(values[r.component - 1], 0) / values.sum()) < 1e-9


def test_query_equals_numpy(spark):
    rows = Q["op11_whitening"](spark, SF_SMALL).collect()
    table = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").collect()
    compare(rows, [r.embedding for r in table], [r.vec_id for r in table], 8)


def test_edges(spark):
    rng = np.random.default_rng(5)
    good = [(i, [float(v) for v in np.float32(rng.normal(size=3))]) for i in range(40)]
    good += [(100 + i, [0.5, 0.25, -0.125]) for i in range(30)]  # copies
    bad = [(200, None), (201, []), (202, [1.0, None, 2.0]), (203, [1.0, float("nan"), 0.0]), (204, [float("inf"), 0.0, 0.0]), (205, [1.0, 2.0])]
    rows = [(i, v, 1, "x", "n", 7, "c") for i, v in good + bad]
    df = spark.createDataFrame(rows, SCHEMA)
    for parts in (1, 5, 37):
        out = W.whiten(df.repartition(parts))
        assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
        compare(out.collect(), [v for _, v in good], [i for i, _ in good], 3)
    assert W.whiten(df.limit(0)).count() == 0
    assert W.whiten(df.filter("vec_id >= 200 AND vec_id < 205")).count() == 0
    one = W.whiten(df.filter("vec_id = 1")).collect()  # no variance at all
    assert [(r.component, r.n, int(r.deviation), r.whitened, r.explained) for r in sorted(one, key=lambda r: r.component)] == [(k, 1, 0, 0.0, 0.0) for k in (1, 2, 3)]
    nobody = spark.createDataFrame([(None, v, 0, "", "", 0, "") for _, v in good], SCHEMA)
    assert W.whiten(nobody).filter("vec_id IS NULL").count() == 3 * len(good)
