"""Whitening against exact fractions and an eigenvalue routine."""

from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from deklara.llm import whitening

NAN, INF = float("nan"), float("inf")


def vectors(n, d, seed):
    rng = np.random.default_rng(seed)
    return (rng.normal(size=(n, d)) @ (rng.normal(size=(d, d)) * 0.3)).astype(np.float32).tolist()


def brute(rows, components):
    """The contract in exact arithmetic, but for the eigenvectors."""
    x = [[int(np.floor(64 * float(c))) + 1_000_000 for c in v] for _, v in rows]
    distinct = [list(t) for t in {tuple(v) for v in x}]
    n, d = len(distinct), len(x[0])
    s = [sum(v[k] for v in distinct) for k in range(d)]
    cov = [[float(sum(Fraction(n * v[i] - s[i], n) * Fraction(n * v[j] - s[j], n) for v in distinct) / n) for j in range(d)] for i in range(d)]
    e, q = np.linalg.eigh(np.array(cov))
    e, q = e[::-1][:components], q[:, ::-1][:, :components]
    far = [[n * v[k] - s[k] for k in range(d)] for v in x]
    return n, [sum(f * f for f in r) for r in far], (np.array(far, float) / n) @ (q / np.sqrt(e)), e / np.trace(cov)


def test_whitening_against_brute_force(spark):
    good = [(i, v) for i, v in enumerate(vectors(60, 6, 1))]
    good += [(100, good[0][1]), (100, good[0][1]), (None, good[1][1])]
    odd = [(200, None), (201, [1.0] * 5 + [None]), (202, [NAN] * 6), (203, [INF] + [0.0] * 5), (204, []), (205, [1.0, 2.0])]
    docs = spark.createDataFrame([(i, v, "x") for i, v in good + odd], "vec_id bigint, embedding array<float>, component string").repartition(5)
    got = whitening.by_component(whitening.whiten(docs, components=4)).collect()
    n, deviation, whitened, explained = brute(good, 4)
    assert len(got) == 4 * len(good) and {r["n"] for r in got} == {n} and n == 60
    key = lambda i, dev: (-1 if i is None else i, dev)
    by = {}
    for r in got:
        by.setdefault(key(r["vec_id"], r["deviation"]), {}).setdefault(r["component"], []).append(r["whitened"])
        assert abs(r["explained"] - explained[r["component"] - 1]) < 1e-9 and r["identity_error"] < 1e-9
    signs = None
    for (i, _), dev, w in zip(good, deviation, whitened, strict=True):
        own = np.array([by[key(i, dev)][c][0] for c in range(1, 5)])
        signs = np.sign(own * w) if signs is None else signs
        assert np.allclose(own, w * signs, atol=1e-8)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [0.5, 0.25])], [(1, [0.5]), (2, [0.5])]])
def test_nothing_to_whiten(spark, rows):
    found = whitening.by_component(whitening.whiten(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")))
    assert found.count() == 0
    assert found.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_one_dimension_and_rank(spark):
    rows = [(i, [float(i), 2.0 * i, 0.0]) for i in range(9)]
    got = whitening.by_component(whitening.whiten(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"))).collect()
    assert {r["component"] for r in got} == {1} and len(got) == 9
    assert all(abs(r["explained"] - 1) < 1e-12 and r["identity_error"] < 1e-12 for r in got)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 24), st.integers(0, 10**6), st.sampled_from(["random", "repeated", "steep", "tied"]))
def test_components_against_an_eigenvalue_routine(d, seed, kind):
    rng = np.random.default_rng(seed)
    q = np.linalg.qr(rng.normal(size=(d, d)))[0]
    e = {"random": rng.normal(size=d), "repeated": rng.integers(0, 3, d).astype(float), "steep": 10.0 ** -np.arange(d), "tied": 1 + 1e-14 * rng.normal(size=d)}[kind]
    v = q @ np.diag(e) @ q.T
    v = (v + v.T) / 2
    values, axes = whitening.spectral_components(v)
    size = max(1e-300, np.abs(e).max())
    assert np.allclose(values, np.linalg.eigvalsh(v)[::-1], atol=1e-13 * d * size)
    assert np.linalg.norm(v @ axes - axes * values) < 1e-13 * d * size
    assert np.linalg.norm(axes.T @ axes - np.eye(d)) < 1e-13 * d


def test_polar_factor():
    a = np.diag([3.0, -2.0, 1e-9, -1e-7])
    assert np.allclose(whitening.polar(a), np.diag([1, -1, 1, -1]), atol=1e-12)


def test_sums_beyond_64_bits_are_exact():
    x = np.full((3, 2), 1 << 25, np.int64)
    assert whitening._products(np.zeros(2, np.int64), x).tolist() == [3 << 50] * 4
    with pytest.raises(OverflowError):
        whitening._products(np.zeros(2, np.int64), x << 10)
