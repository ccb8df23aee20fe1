"""Mean distances of stated queries to a library in files, against brute force."""

import numpy as np
import pytest

from crateflow.operators import blocks, similarity

N = 400


@pytest.mark.parametrize("kind", ["spread", "copies", "uneven", "zeros", "far out", "two"])
def test_means(spark, kind, monkeypatch):
    rng = np.random.default_rng(9)
    raw, vector = rng.standard_normal((N, 16)).astype(np.float32), rng.standard_normal((N, 20))
    if kind == "copies":
        at = rng.integers(0, 5, N)
        raw, vector = raw[at], vector[at]
    elif kind == "uneven":
        raw *= np.logspace(-3, 3, 16, dtype=np.float32)
    elif kind == "zeros":
        raw[[20, 33, 60]] = 0
    elif kind == "far out":
        raw[41] *= 1e5
        raw = raw + np.float32(30)
    elif kind == "two":
        raw, vector = raw[:2], vector[:2]
    monkeypatch.setattr(similarity, "MET", 64)
    rows = [(i, v.tolist(), x.tolist()) for i, (x, v) in enumerate(zip(raw, vector, strict=True))]
    got = similarity.pair_means(similarity.Pairs(spark.createDataFrame(rows, "id bigint, vector array<double>, raw array<float>").repartition(3)))
    z = [m.astype(float) / np.where(m.std(axis=0, dtype=float) > 1e-12, m.std(axis=0, dtype=float), 1.0) for m in (raw, vector)]
    x = raw.astype(float)
    length = np.sqrt((x * x).sum(axis=1))
    u, zero = np.divide(x, length[:, None], out=np.zeros_like(x), where=length[:, None] > 0), length == 0
    want = []
    for i in range(0, len(x), 20):
        others = np.arange(len(x)) != i
        cosine = np.where(zero[i] & zero, 0.0, np.round(1 - np.clip(u @ u[i], -1, 1), 12))
        want.append((i, others.sum(), cosine[others].mean(), *(np.sqrt(((m[i] - m[others]) ** 2).mean(axis=1)).mean() for m in z), cosine[others].min()))
    rows = sorted(map(tuple, got.collect()))
    assert [r[:2] for r in rows] == [r[:2] for r in want]
    a, b = (np.array([r[2:] for r in y]) for y in (rows, want))
    assert a[:, [0, 2, 3]] == pytest.approx(b[:, [0, 2, 3]], abs=3e-12)
    assert a[:, 1] == pytest.approx(b[:, 1], rel=1e-6, abs=1e-7)
    assert [f"{y:.6f}" for y in a[:, 1]] == [f"{y:.6f}" for y in b[:, 1]]


def test_means_need_no_pair_of_blocks(spark, monkeypatch):
    """The library stands in files: no block of it is sent to meet each block of queries."""
    monkeypatch.setattr(blocks, "_met", None)
    rng = np.random.default_rng(2)
    rows = [(i, v.tolist(), x.tolist()) for i, (x, v) in enumerate(zip(rng.standard_normal((50, 8)), rng.standard_normal((50, 20)), strict=True))]
    assert similarity.pair_means(similarity.Pairs(spark.createDataFrame(rows, "id bigint, vector array<double>, raw array<double>"))).count() == 3
