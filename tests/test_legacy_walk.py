"""The legacy walk gives the rows that all pairs give, and computes few pairs' distances in full."""

import numpy as np
import pyarrow as pa
import pytest

from crateflow.functions import columns as C
from crateflow.operators import blocks, walk

HOLD = C.AXIS_NAMES.index("tempo.bpm")
SCHEDULE = ("Near", "Mid", "Far", "Mid", "Near")


def library(n, seed=3):
    rng = np.random.default_rng(seed)
    v = rng.standard_normal((30, 20))[rng.integers(0, 30, n)] * 2 + rng.standard_normal((n, 20)) * rng.choice([0.15, 0.6], (n, 1))
    v[:, HOLD] = np.round(v[:, HOLD] * 10 + 120)
    v[n // 2 : n // 2 + 40] = v[:40]
    v[5:9] = 500.0
    return v


def brute(v, seeds, limit, weights):
    sigma = v.std(axis=0)
    out = []
    for seed in seeds:
        at, visited = seed, [seed]
        for step in range(limit):
            sched = SCHEDULE[step % 5]
            d, free, raw = (x[0] for x in walk.legacy_distances(v[[at]], v, sigma, HOLD, weights))
            fits = {"Near": (d > 0) & (d <= 0.3), "Mid": (d > 0.3) & (d <= 0.7), "Far": (free > 0.7) & (raw <= 0.3)}[sched]
            best = min((0 if fits[j] else 1, d[j], j) for j in range(len(v)) if j not in visited)
            at = best[2]
            visited.append(at)
            out.append((seed, step + 1, at, round(float(best[1]), 4)))
    return sorted(out)


@pytest.mark.parametrize("weights", [(), (2.0, 0.0, 0.5), (-0.5,)])
def test_every_step_is_that_of_all_pairs(spark, weights):
    v = library(1501)
    seeds = [0, 5, 17, len(v) // 2 + 3, len(v) - 1]
    lib = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id bigint, vector array<double>")
    got = walk.legacy_walk(lib, spark.createDataFrame([(s, s) for s in seeds], "walk_id bigint, id bigint"), 6, weights=weights)
    full = np.array([*weights, *[1.0] * (20 - len(weights))])
    assert sorted((r.walk_id, r.position, r.id, r.distance) for r in got.collect()) == brute(v, seeds, 6, full)


def test_few_distances_are_computed_in_full(monkeypatch):
    parts, seen, whole = {}, [], walk._legacy
    monkeypatch.setattr(blocks, "tally", lambda asked, packed, start, add, end, schema: parts.update(start=start, add=add, end=end))
    monkeypatch.setattr(blocks, "packed_queries", lambda state: state)
    v = library(20_000)
    packed = [pa.table({"id": np.arange(at, at + 1000), "vector": v[at : at + 1000].tolist()}) for at in range(0, len(v), 1000)]
    at = np.arange(0, len(v), 100)
    q = pa.table({"walk_id": at, "id": at, "vector": v[at].tolist(), "visited": [[i] for i in at.tolist()]})

    def counted(axes, *rest):
        out = whole(axes, *rest)
        seen.append(out[0].size)
        return out

    monkeypatch.setattr(walk, "_legacy", counted)
    for sched in ("Near", "Mid", "Far"):
        walk.legacy_best(None, None, v.std(axis=0), v.mean(axis=0), sched, HOLD)
        state = parts["start"](q)
        for x in packed:
            parts["add"](state, q, x)
        assert parts["end"](state, q).num_rows
    assert sum(seen) < 0.05 * 3 * len(at) * len(v), sum(seen) / (3 * len(at) * len(v))
