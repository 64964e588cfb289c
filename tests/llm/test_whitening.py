"""Whitening against numpy's eigenvalues and exact integers."""

from __future__ import annotations

import math

import numpy as np
import pytest

from gazette.llm import whitening
from gazette.llm.common import prepare
from gazette.llm.queries import QUERIES


def brute(rows, scale=256, wanted=4):
    """(vec_id, component) -> (n, deviation, whitened up to its sign, explained), for one vector length."""
    sound = [(i, tuple(math.floor(scale * c) for c in v)) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    distinct = sorted({x for _, x in sound})
    n, dim = len(distinct), len(distinct[0])
    sums = [sum(x[k] for x in distinct) for k in range(dim)]
    fit = np.array(distinct, dtype=float) - np.array(sums) / n
    values, vectors = np.linalg.eigh(fit.T @ fit / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    out = []
    for i, x in sound:
        deviation = sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True))
        y = (np.array(x, dtype=float) - np.array(sums) / n) @ vectors[:, :wanted] / np.sqrt(values[:wanted])
        out += [(i, k + 1, n, deviation, y[k], values[k] / values.sum()) for k in range(min(wanted, dim))]
    return sorted(out, key=lambda r: (r[0], r[1]))


def agree(found, expected):
    found = sorted(found, key=lambda r: (r["vec_id"], r["component"]))
    assert [(r["vec_id"], r["component"], r["n"], r["deviation"]) for r in found] == [r[:4] for r in expected]
    for k in {r["component"] for r in found}:
        mine = np.array([r["whitened"] for r in found if r["component"] == k])
        theirs = np.array([r[4] for r in expected if r[1] == k])
        assert min(np.abs(mine - theirs).max(), np.abs(mine + theirs).max()) < 1e-8
    assert all(abs(r["explained"] - e[5]) < 1e-10 for r, e in zip(found, expected, strict=True))
    assert all(r["identity_error"] < 1e-10 for r in found)


def test_query_on_its_table(spark):
    given = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()
    agree(QUERIES["op11_whitening"](spark, "/root/testdata/sf0.001").collect(), brute([(r["vec_id"], r["embedding"]) for r in given]))


@pytest.mark.parametrize("dim", [1, 2, 5, 40])
def test_repeats_and_unsound_vectors(spark, dim):
    prepare(spark)
    random = np.random.default_rng(dim)
    base = (random.normal(size=(60, dim)) * np.arange(1, dim + 1)).tolist()
    rows = [(i, v) for i, v in enumerate(base)] + [(100 + i, base[i % 3]) for i in range(40)]
    odd = [(900, None), (901, [None] * dim), (902, [math.nan] * dim), (903, [math.inf] * dim), (904, [])]
    given = spark.createDataFrame([(i, v, "x", 0.5) for i, v in rows + odd], "vec_id bigint, embedding array<double>, n string, x double")
    agree(whitening.whitening(given).collect(), brute(rows))


def test_without_variance(spark):
    prepare(spark)
    make = lambda rows: spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    assert whitening.whitening(make([])).count() == 0
    assert whitening.whitening(make([(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0
    line = whitening.whitening(make([(1, [0.0, 0.0]), (None, [1.0, 1.0]), (3, [3.0, 3.0])])).collect()
    assert sorted((r["vec_id"] or 0, r["component"]) for r in line) == [(0, 1), (1, 1), (3, 1)]
    assert all(abs(r["explained"] - 1) < 1e-12 for r in line)
    # Lengths are fitted apart; a negative zero is zero.
    mixed = whitening.whitening(make([(1, [0.0]), (2, [2.0]), (3, [-0.0, 1.0]), (4, [0.0, 2.0])])).collect()
    assert {(r["vec_id"], r["n"], round(abs(r["whitened"]), 12)) for r in mixed} == {(i, 2, 1.0) for i in (1, 2, 3, 4)}


def test_huge_entries(spark):
    prepare(spark)
    rows = [(1, [1e300, 1.0]), (2, [-1e300, 2.0]), (3, [0.0, 3.0])]
    found = whitening.whitening(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()
    assert {r["vec_id"] for r in found} == {1, 2, 3} and all(math.isfinite(r["whitened"]) for r in found)
    assert max(r["deviation"] for r in found) == 2**63 - 1


@pytest.mark.parametrize("dim", [1, 3, 4, 30, 90])
@pytest.mark.parametrize("kind", ["apart", "close", "equal", "few"])
def test_eigenpairs(dim, kind):
    random = np.random.default_rng(dim)
    values = {
        "apart": np.geomspace(1, 1e-6, dim),
        "close": 1 - np.arange(dim) * 1e-4,
        "equal": np.array([2.0] * min(3, dim) + [1.0] * max(0, dim - 3)),
        "few": np.array([1.0, 0.5] + [0.0] * dim)[:dim],
    }[kind]
    turn = np.linalg.qr(random.normal(size=(dim, dim)))[0]
    matrix = turn * values @ turn.T
    asked = 0

    def product(y):
        nonlocal asked
        asked += 1
        return matrix @ y

    vectors, found, residuals = whitening.jacobi_davidson(product, dim, 4)
    assert np.allclose(found, values[: len(found)], atol=1e-13) and len(found) == min(4, dim)
    assert residuals.max() < 1e-13 and np.allclose(vectors.T @ vectors, np.eye(len(found)), atol=1e-13)
    assert asked < 400


def test_sums_are_added_in_a_tree(spark, monkeypatch):
    prepare(spark)
    monkeypatch.setattr(whitening, "BLOCK_ROWS", 7)
    monkeypatch.setattr(whitening, "FAN_IN", 2)
    rows = [(i, v) for i, v in enumerate(np.random.default_rng(3).normal(size=(90, 6)).tolist())]
    agree(whitening.whitening(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect(), brute(rows))
