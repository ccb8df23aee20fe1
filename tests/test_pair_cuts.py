"""The cuts of the pairs' distances against brute force, with many values in the bin of a cut."""

import numpy as np
import pytest

from crateflow.operators import similarity


def brute(v, asked, sigma, shares=(0.33, 0.66)):
    d = [np.round(np.sqrt((((v[i] - np.delete(v, i, axis=0)) / sigma) ** 2).mean(axis=1)), 12) for i in asked]
    every = np.sort(np.concatenate(d))
    return [every[min(int(s * len(every)), len(every) - 1)] for s in shares]


def cuts(spark, v, asked):
    lib = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id bigint, raw array<double>").repartition(3).cache()
    mean, sigma = similarity.column_stats(lib, "raw")
    return similarity.pair_cuts(lib.where(f"id in ({','.join(map(str, asked))})"), lib, sigma, mean), brute(v, asked, sigma)


@pytest.mark.parametrize("kind", ["spread", "one bin", "copies", "far out", "tiny", "two rows"])
def test_cuts(spark, kind):
    rng = np.random.default_rng(7)
    v = rng.standard_normal((140, 24))
    if kind == "one bin":
        # orthogonal rows of almost one length: all distances within a few millionths
        v = np.eye(140)[:, :140] * (1 + 1e-6 * rng.standard_normal((140, 1)))
    elif kind == "copies":
        v = v[rng.integers(0, 5, 140)]
    elif kind == "far out":
        v = v + 1e4
        v[3] *= 1e5
    elif kind == "tiny":
        v = np.vstack([v * 1e-9 + 5.0, rng.standard_normal((2, 24)) * 1e5])
    elif kind == "two rows":
        v = v[:2]
    got, want = cuts(spark, v, range(0, len(v), 2))
    assert got == pytest.approx(want, abs=2e-12, rel=1e-12)


def test_values_of_a_bin_stay_with_the_executors(spark, monkeypatch):
    """The cut's bin is ranked where it lies: the driver is sent no value but the cuts."""
    from pyspark.sql import DataFrame

    def refused(*_, **__):
        raise AssertionError("values are brought to the driver")

    monkeypatch.setattr(DataFrame, "toLocalIterator", lambda self, *a, **k: refused() if "v" in self.columns else original(self, *a, **k))
    got, want = cuts(spark, np.eye(90) * (1 + 1e-6 * np.random.default_rng(1).standard_normal((90, 1))), range(0, 90, 2))
    assert got == pytest.approx(want, abs=2e-12)


original = __import__("pyspark.sql", fromlist=["DataFrame"]).DataFrame.toLocalIterator
