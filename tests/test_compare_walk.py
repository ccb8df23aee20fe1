"""The compare walk over the whole library against brute force in plain numpy."""

import numpy as np
import pytest

from crateflow.operators import metrics
from crateflow.plans import catalog

N, DIM, SCHEMA = 130, 512, "id bigint, file_path string, title string, artist string, duration_sec double, feature_json string, clap_embedding array<float>"


def embeddings():
    rng = np.random.default_rng(5)
    v = (rng.standard_normal((N, DIM)) + 2 * rng.standard_normal((7, DIM))[rng.integers(0, 7, N)]).astype(np.float32)
    v[[8, 9]] = 0
    v[11] = v[10]
    return v


def distances(v):
    v = v.astype(float)
    norm = np.linalg.norm(v, axis=1)
    unit = v / np.where(norm > 0, norm, 1)[:, None]
    d = np.round(1 - np.clip(unit @ unit.T, -1, 1), 12)
    d[np.ix_(norm == 0, norm == 0)] = 0
    return d


def cuts(d):
    every = np.sort(d[np.triu_indices(len(d), 1)])
    return every[int(0.33 * len(every))], every[int(0.66 * len(every))]


def brute(d, seed, limit):
    low, high = cuts(d)
    at, visited, out = seed, {seed}, []
    for step in range(limit):
        band = ("Near", "Mid", "Far", "Mid", "Near")[step % 5]
        open_ = [j for j in range(len(d)) if j not in visited]
        if not open_:
            break
        fits = [j for j in open_ if {"Near": d[at, j] <= low + 1e-12, "Mid": low < d[at, j] <= high, "Far": d[at, j] > high}[band]]
        best = min(fits or open_, key=lambda j: (-d[at, j] if fits and band == "Far" else d[at, j], j))
        out.append((seed, step + 1, best, band, round(d[at, best], 4)))
        at = best
        visited.add(best)
    return out


def test_walks_visit_all_tracks_with_cuts_of_all_pairs(spark, tmp_path):
    v = embeddings()
    rows = [(i, f"/m/{i}", "t", "a", 1.0, None, x.tolist()) for i, x in enumerate(v)] + [(N + 10, "/m/x", "t", "a", 1.0, None, None)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(tmp_path / "tracks.parquet"))
    got = sorted(tuple(r) for r in catalog.queries()["compare_walk"](spark, str(tmp_path)).collect())
    d = distances(v)
    want = sorted(r for s in range(0, N, 20) for r in brute(d, s, 9))
    assert [r[:4] for r in got] == [r[:4] for r in want]
    assert [r[4] for r in got] == pytest.approx([r[4] for r in want], abs=1e-4)
    assert any(r[2] % 20 for r in got)


def test_cuts_are_exact_and_small_libraries_end(spark):
    v = embeddings().astype(float)
    norm = np.linalg.norm(v, axis=1)
    unit = v / np.where(norm > 0, norm, 1)[:, None]
    lib = spark.createDataFrame([(i, u.tolist()) for i, u in enumerate(unit)], "id bigint, unit array<double>")
    assert metrics.all_pair_cuts(lib.repartition(4)) == pytest.approx(cuts(distances(v)), abs=2e-12)
    seeds = spark.createDataFrame([(0, 0)], "walk_id bigint, id bigint")
    assert metrics.compare_walk(lib.where("id = 0"), seeds).collect() == []
    assert [r.id for r in metrics.compare_walk(lib.where("id < 3"), seeds).orderBy("position").collect()] in ([1, 2], [2, 1])
    assert metrics.compare_walk(lib, seeds, schedule=("near?",)).collect() == []


def test_cuts_and_walks_over_several_files_of_stored_vectors(spark):
    v = embeddings()
    v[20] *= np.float32(1e-30)
    d = distances(v.astype(float) * np.where(np.arange(N) == 20, 1e30, 1)[:, None])
    lib = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(N + 1, None)], "id bigint, raw array<float>").repartition(5)
    assert metrics.all_pair_cuts(lib) == pytest.approx(cuts(d), abs=2e-12)
    seeds = spark.createDataFrame([(s, s) for s in (3, 20, N + 1)], "walk_id bigint, id bigint")
    got = sorted(tuple(r)[:4] for r in metrics.compare_walk(lib, seeds, 4).collect())
    assert got == [r[:4] for s in (3, 20) for r in brute(d, s, 4)]
