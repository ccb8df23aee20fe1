"""The nearest rows by two distances over a library in files, against brute force."""

import numpy as np
import pytest

from crateflow.operators import metrics, similarity

N = 420


def given(kind):
    rng = np.random.default_rng(5)
    raw, vector = rng.standard_normal((N, 16)).astype(np.float32), rng.standard_normal((N, 20))
    if kind == "copies":
        at = rng.integers(0, 7, N)
        raw, vector = raw[at], vector[at]
    elif kind == "close":
        raw, vector = (raw[:1] + 1e-6 * raw).astype(np.float32), vector[:1] + 1e-9 * vector
        raw[33], vector[33] = 50.0, 50.0
    elif kind == "few":
        raw, vector = raw[:3], vector[:3]
    return raw, vector


@pytest.mark.parametrize("kind", ["spread", "copies", "close", "few"])
def test_nearest(spark, kind, monkeypatch):
    raw, vector = given(kind)
    monkeypatch.setattr(similarity, "MET", 64)
    monkeypatch.setattr(similarity, "WAITING", 4)
    lib = spark.createDataFrame([(i, v.tolist(), x.tolist()) for i, (x, v) in enumerate(zip(raw, vector, strict=True))], "id bigint, vector array<double>, raw array<float>").repartition(3)
    near = similarity.pair_nearest(similarity.Pairs(lib))
    for c, m in (("d_clap", raw.astype(float)), ("d_essentia", vector)):
        z = m / np.where(m.std(axis=0) > 1e-12, m.std(axis=0), 1.0)
        want = []
        for i in range(0, len(z), 20):
            d = np.round(np.sqrt(((z[i] - z) ** 2).mean(axis=1)), 12)
            d[i] = np.inf
            order = np.lexsort((np.arange(len(d)), d))
            want += [(i, int(j), k + 1) for k, j in enumerate(order[: min(3, len(z) - 1)])]
        assert sorted(map(tuple, metrics.nearest(near.where(f"{c} < double('inf')"), c).collect())) == sorted(want)


def test_no_more_rows_than_wanted_leave_the_tasks(spark, monkeypatch):
    """Each query's rows are decided where they are found: ``k`` by each distance, however many parts the library has."""
    raw, vector = given("spread")
    monkeypatch.setattr(similarity, "MET", 16)
    lib = spark.createDataFrame([(i, v.tolist(), x.tolist()) for i, (x, v) in enumerate(zip(raw, vector, strict=True))], "id bigint, vector array<double>, raw array<float>").repartition(4)
    assert similarity.pair_nearest(similarity.Pairs(lib)).count() == N // 20 * 2 * 3
