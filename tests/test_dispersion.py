"""Residual dispersion by moments of the topics, against all document-word cells in numpy."""

import math

import numpy as np
import pytest

from themeloom.operators import topics


def given(spark, k, docs=60, words=300, seed=3):
    """Documents of very different lengths; one word is frequent, and a third of the words are equally rare."""
    rng = np.random.default_rng(seed)
    beta = rng.dirichlet(np.full(words, 0.3), k)
    beta[:, 0] += 0.4
    beta[:, words // 3 : 2 * words // 3] = 1e-5
    beta /= beta.sum(1, keepdims=True)
    theta = rng.dirichlet(np.full(k, 0.5), docs)
    counts = rng.poisson((theta @ beta) * rng.choice([5, 60, 2000], docs)[:, None])
    counts[:, 0] += 1
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    dtm = frame([(int(i), f"w{w}", int(counts[i, w])) for i, w in zip(*counts.nonzero(), strict=True)], "id long, word string, n long")
    shares = frame([(i, f"V{t}", float(theta[i, t])) for i in range(docs) for t in range(k)], "id long, topic string, p double")
    rates = frame([(f"V{t}", f"w{w}", float(beta[t, w])) for t in range(k) for w in range(words)], "topic string, word string, p double")
    return dtm, shares, rates, counts, theta, beta


def dense(counts, theta, beta, tol):
    m, q = counts.sum(1, keepdims=True), theta @ beta
    d = ((counts - m * q) ** 2 / (m * q * (1 - q))).sum()
    freedom = (m * q > tol).sum() - (len(theta) * (theta.shape[1] - 1) + len(beta) * (beta.shape[1] - 1))
    return d, freedom


@pytest.mark.parametrize(("k", "cells"), [(2, 1 << 22), (5, 400), (30, 1 << 22)])
def test_equals_all_cells(spark, monkeypatch, k, cells):
    monkeypatch.setattr(topics, "GROUP_CELLS", cells)  # few cells: several groups of documents and blocks of words
    dtm, shares, rates, *arrays = given(spark, k)
    for tol in (0.01, 0.5):
        d, freedom = dense(*arrays, tol)
        found = topics.residual_dispersion(dtm, shares, rates, tol=tol, rest=1e-12).first()
        assert found.avvik == pytest.approx(d, abs=6e-4)  # three decimals
        assert found.frihetsgrader == freedom
        assert found.dispersion == pytest.approx(d / freedom, rel=1e-6)


def test_rest_bounds_the_error(spark):
    dtm, shares, rates, *arrays = given(spark, 5)
    d, freedom = dense(*arrays, 0.01)
    found = topics.residual_dispersion(dtm, shares, rates, rest=1e-3).first()
    assert found.frihetsgrader == freedom
    assert abs(found.avvik - d) < 1e-3 * arrays[0].sum() / (1 - 1e-3 ** (1 / topics.series_order(5))) + 1e-3


def test_moments_are_sums_over_tuples_of_topics():
    shares = np.random.default_rng(1).dirichlet(np.ones(4), 3)
    beta = np.random.default_rng(2).dirichlet(np.ones(50), 4)
    times = list(topics._times_drawn(4, 4))
    by_word = list(topics._monomials(beta.T, 4))
    by_row = list(topics._monomials(shares, 4))
    for r in range(4):
        assert len(times[r]) == math.comb(4 + r, r + 1)
        found = by_row[r] @ (by_word[r].sum(0) * times[r])
        assert found == pytest.approx(((shares @ beta) ** (r + 1)).sum(1), rel=1e-12)


def test_order_follows_the_number_of_topics():
    assert [topics.series_order(k) for k in (1, 4, 30, 100, 2000)] == [8, 8, 4, 3, 1]


def test_no_rows(spark):
    dtm, shares, rates, *_ = given(spark, 2, docs=3, words=9)
    found = topics.residual_dispersion(dtm.limit(0), shares, rates).first()
    assert found.dispersion is None or found.frihetsgrader < 0
