"""Quantile bands of stated queries over a library in files, against brute force."""

from math import ceil

import numpy as np
import pytest

from crateflow.operators import blocks, similarity

N = 500


@pytest.mark.parametrize("kind", ["spread", "copies", "close", "two", "apart"])
def test_bands(spark, kind, monkeypatch):
    rng = np.random.default_rng(3)
    raw, ids = rng.standard_normal((N, 16)).astype(np.float32), np.arange(N)
    if kind == "copies":
        raw = raw[rng.integers(0, 6, N)]
        raw[40:44] = 0
    elif kind == "close":
        raw = (raw[:1] + 1e-5 * raw).astype(np.float32)
    elif kind == "two":
        raw, ids = raw[:2], ids[:2]
    elif kind == "apart":
        ids = np.where(ids % 20, ids * 10**13 + 1, ids * 20)
    monkeypatch.setattr(similarity, "HELD", 2 * N)
    got = similarity.band_report(spark.createDataFrame([(int(i), x.tolist()) for i, x in zip(ids, raw, strict=True)] + [(10**6 + 20, None)], "id bigint, raw array<float>").repartition(3))
    x = raw.astype(float)
    length = np.sqrt((x * x).sum(axis=1))[:, None]
    x, want = np.divide(x, length, out=np.zeros_like(x), where=length > 0), []
    for i in np.flatnonzero(ids % 20 == 0):
        sim = np.round(x @ x[i], 12)
        order = np.array([j for j in np.lexsort((ids, -sim)) if j != i])
        n = len(order)
        e = [0, ceil(n * 0.1), ceil(n * 0.4), n]
        want += [(ids[i], b, e[k + 1] - e[k], e[k] + 1, ids[order[e[k] : e[k + 1]]].sum(), sim[order[e[k]]], sim[order[e[k + 1] - 1]]) for k, b in enumerate(("Near", "Mid", "Far")) if e[k + 1] > e[k]]
    rows = sorted(map(tuple, got.collect()))
    want = sorted(want)
    assert [r[:5] for r in rows] == [r[:5] for r in want]
    assert np.array([r[5:] for r in rows]) == pytest.approx(np.array([r[5:] for r in want]), abs=2e-12)


def test_no_pair_leaves_a_task(spark, monkeypatch):
    """Bands are ranked where the pairs are: no kernel sends rows of pairs, of which a band's bin may hold any number."""
    for name in ("cross", "tally"):
        monkeypatch.setattr(blocks, name, None)
    raw = np.random.default_rng(1).standard_normal((60, 8))
    assert similarity.band_report(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(raw)], "id bigint, raw array<double>")).count() == 9
