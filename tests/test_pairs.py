"""Pairs of stated queries and a library in files, against brute force."""

import numpy as np
import pytest

from crateflow.operators import similarity

N = 210


@pytest.fixture(scope="module")
def given():
    rng = np.random.default_rng(11)
    raw = rng.standard_normal((N, 16)).astype(np.float32)
    vector = rng.standard_normal((N, 20)) + 0.5 * raw[:, :1]
    raw[50], vector[50] = raw[40], vector[40]
    raw[60] = 0
    return raw, vector


def rows(spark, raw, vector):
    data = [(i, v.tolist(), x.tolist()) for i, (x, v) in enumerate(zip(raw, vector, strict=True))]
    return spark.createDataFrame(data, "id bigint, vector array<double>, raw array<float>").repartition(3)


def brute(raw, vector):
    """The two distances of each stated query to every other row."""
    out = []
    for m in (raw.astype(float), vector):
        z = m / m.std(axis=0)
        d = np.sqrt(((z[::20, None] - z[None]) ** 2).mean(axis=2))
        out.append(np.where(np.arange(0, N, 20)[:, None] == np.arange(N)[None], np.nan, np.round(d, 12)))
    return out


def ranks(v):
    _, place, n = np.unique(v, return_inverse=True, return_counts=True)
    return (np.cumsum(n) - (n - 1) / 2)[place]


def test_rank_correlation_of_pairs_without_keeping_them(spark, given, monkeypatch):
    a, b = (d[~np.isnan(d)] for d in brute(*given))
    for most, off in ((similarity.RANKED, 1e-12), (0, 1e-5)):
        monkeypatch.setattr(similarity, "RANKED", most)
        r = similarity.pair_correlation(similarity.Pairs(rows(spark, *given))).first()
        assert r.n == len(a) and r.rho == pytest.approx(np.corrcoef(ranks(a), ranks(b))[0, 1], abs=off)


def test_rank_correlation_of_too_few_or_constant_pairs(spark, given):
    raw, vector = given
    assert tuple(similarity.pair_correlation(similarity.Pairs(rows(spark, raw[:1], vector[:1]))).first()) == (0, None)
    assert tuple(similarity.pair_correlation(similarity.Pairs(rows(spark, raw[:0], vector[:0]))).first()) == (0, None)
    assert tuple(similarity.pair_correlation(similarity.Pairs(rows(spark, raw[:1].repeat(4, 0), vector[:4]))).first()) == (3, 0.0)


@pytest.mark.parametrize("most", [similarity.RANKED, 0])
def test_rank_correlation_does_not_depend_on_how_many_pairs_are_ranked_in_memory(spark, monkeypatch, most):
    rng = np.random.default_rng(3)
    raw, vector = rng.integers(0, 3, (N, 4)).astype(np.float32), rng.integers(0, 2, (N, 20)).astype(float)
    a, b = (d[~np.isnan(d)] for d in brute(raw, vector))
    assert len(np.unique(a)) < len(a) / 10
    monkeypatch.setattr(similarity, "RANKED", most)
    r = similarity.pair_correlation(similarity.Pairs(rows(spark, raw, vector))).first()
    assert r.n == len(a) and r.rho == pytest.approx(np.corrcoef(ranks(a), ranks(b))[0, 1], abs=1e-11)


def test_ranks_inside_bins_are_from_their_middle_and_tie():
    bins, values = np.array([4, 2, 4, 4, 2, 7]), np.array([3.0, 1.0, 1.0, 3.0, 2.0, 9.0])
    assert similarity._inside(bins, values).tolist() == [0.5, -0.5, -1.0, 0.5, 0.5, 0.0]
    assert not len(similarity._inside(bins[:0], values[:0]))


def test_the_fullest_bins_are_ranked_by_value_and_number(spark, given):
    rng = np.random.default_rng(3)
    pairs = similarity.Pairs(rows(spark, rng.integers(0, 3, (N, 4)).astype(np.float32), rng.integers(0, 2, (N, 20)).astype(float) + np.arange(N)[:, None] % 3 * 1e-9))
    try:
        total, layouts, sides, _ = similarity._summed(pairs)
        more, inside = similarity._fullest(pairs, layouts, sides, 1)
        all_, all_inside = similarity._ranked(pairs, layouts, sides)
        assert total == 11 * (N - 1) and all_inside[1] > 0
        assert inside == pytest.approx(all_inside, rel=1e-9, abs=1e-12) and abs(more - all_) <= np.sqrt(all_inside[0] * all_inside[1]) + 1e-9
        assert similarity._fullest(pairs, layouts, sides, 254)[1][1] < inside[1]
    finally:
        pairs.shelf.drop()
