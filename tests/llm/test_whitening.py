import math
import random
from fractions import Fraction

import numpy as np
import pytest

from flowquarry.llm import catalog
from flowquarry.llm import whitening as W

SCHEMA = "vec_id long, embedding array<float>, x string, component string, n string"


def symmetric(values, seed=0):
    q, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(values), len(values))))
    return (q * np.array(values, float)) @ q.T


SPECTRA = {
    "apart": [100, 50, 20, 10, 5, 1, 0.5, 0.1],
    "near": [3, 3 - 1e-9, 3 - 2e-9, 1, 1 - 1e-12, 0.5],
    "equal": [4, 4, 4, 2, 2, 1],
    "wide": [1e12, 1e6, 1, 1e-3, 1e-6],
    "flat": [7] * 6,
    "one": [9, 0, 0, 0],
}


@pytest.mark.parametrize("name", SPECTRA)
def test_leading_pairs(name):
    v = symmetric(SPECTRA[name])
    v = (v + v.T) / 2
    values, vectors = W.leading_pairs(v, 4)
    true = np.sort(np.linalg.eigvalsh(v))[::-1]
    wanted = true[:4][true[:4] > 4 * len(v) * W.EPS * true[0] * 4]
    assert len(values) >= len(wanted)
    assert np.allclose(values[: len(wanted)], wanted, rtol=0, atol=1e-13 * true[0])
    assert np.abs(v @ vectors - vectors * values).max() <= 1e-13 * true[0] * len(v)
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() <= 1e-9


@pytest.mark.parametrize("seed", range(20))
def test_counts_equal_eigenvalues_above(seed):
    rng = np.random.default_rng(seed)
    a = rng.integers(-3, 4, (9, 9)).astype(float)
    a = a + a.T if seed % 2 else np.triu(a, 1) + np.triu(a, 1).T
    true = np.linalg.eigvalsh(a)
    for shift in rng.uniform(true.min() - 1, true.max() + 1, 12):
        if np.abs(true - shift).min() > 1e-9:
            assert W.count_above(a, shift) == (true > shift).sum()


def brute(rows, components):
    kept = [(i, [math.floor(64 * c) + 1_000_000 for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(x) for _, x in kept}), dtype=object)
    n, sums = len(fit), fit.sum(axis=0)
    mean = [Fraction(int(s), n) for s in sums]
    y = np.array([[float(Fraction(int(c)) - m) for c, m in zip(x, mean, strict=True)] for x in fit])
    v = y.T @ y / n
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    out = {}
    for i, x in kept:
        own = np.array([float(Fraction(int(c)) - m) for c, m in zip(x, mean, strict=True)])
        deviation = sum((n * c - int(s)) ** 2 for c, s in zip(x, sums, strict=True))
        out[i] = (n, deviation, own @ vectors / np.sqrt(values), values / np.trace(v))
    return out


def check(found, expected, components):
    by_component = {}
    assert len(found) == len(expected) * components
    for r in found:
        n, deviation, white, share = expected[r.vec_id]
        assert (r.n, r.deviation) == (n, deviation)
        assert r.explained == pytest.approx(share[r.component - 1], rel=1e-9)
        assert 0 <= r.identity_error < 1e-9
        by_component.setdefault(r.component, []).append((r.whitened, white[r.component - 1]))
    assert len({r.identity_error for r in found}) == 1
    for pairs in by_component.values():
        a, b = np.array(pairs).T
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-7


def vectors(seed, n, width=20):
    rng = random.Random(seed)
    return [(i, [float(np.float32(rng.gauss(0.3, 1 / (1 + k)))) for k in range(width)]) for i in range(n)]


def test_equals_brute_force(spark):
    rows = vectors(1, 300)
    rows += [(400 + i, rows[0][1]) for i in range(50)]
    hard = [(500, None), (501, [math.nan] * 20), (502, [math.inf] + [0.0] * 19), (503, [None] + [0.0] * 19)]
    df = spark.createDataFrame([(i, v, "a", "b", "c") for i, v in rows + hard + [(504, [1.0, 2.0]), (505, [])]], SCHEMA)
    check(W.whiten(df).collect(), brute(rows + hard, 16), 16)


def test_repeated_rows_and_null_ids(spark):
    rows = vectors(2, 40, 5)
    df = spark.createDataFrame([(i, v, "", "", "") for i, v in [*rows, rows[3], (None, rows[4][1])]], SCHEMA)
    found = W.whiten(df).collect()
    assert len(found) == 42 * 5
    assert len([r for r in found if r.vec_id == 3]) == 10
    assert sorted(r.whitened for r in found if r.vec_id is None) == sorted(r.whitened for r in found if r.vec_id == 4)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, []), (2, [])]])
def test_nothing_to_whiten(spark, rows):
    assert W.whiten(spark.createDataFrame([(i, v, "", "", "") for i, v in rows], SCHEMA)).collect() == []


def test_few_directions_give_few_components(spark):
    rows = [(i, [float(i % 7), float(i % 7) * 2, 1.0, 1.0]) for i in range(30)]
    found = W.whiten(spark.createDataFrame([(i, v, "", "", "") for i, v in rows], SCHEMA)).collect()
    assert {r.component for r in found} == {1}
    assert found[0].n == 7
    assert found[0].explained == pytest.approx(1)


def test_extreme_entries(spark):
    rows = [(i, [1e300 * (-1) ** i, float(i), 1e-300]) for i in range(6)]
    found = W.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {r.component for r in found} >= {1}
    assert all(math.isfinite(r.whitened) for r in found)
    assert {r.deviation for r in found} == {None}


def test_query_equals_brute_force(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    check(catalog.op12_embedding_whitening(spark, sf).collect(), brute(rows, 16), 16)
