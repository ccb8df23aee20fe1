"""Walks over a library in files: counts without comparisons, places told from a sample."""

import numpy as np
import pytest

from crateflow.operators import shelf, walk

N, DIM = 1500, 12


@pytest.fixture(scope="module")
def files(spark):
    rng = np.random.default_rng(7)
    x = rng.standard_normal((N, DIM)).astype(np.float32)
    x[40:60] = x[20:40]
    x[60] = 0
    x[61] *= np.float32(1e-35)
    rows = [(i, None if i % 13 == 0 else int(rng.integers(0, 24)), 0.0 if i % 9 == 0 else float(np.round(60 + 60 * rng.random(), 1)), True, *[float(rng.random())] * len(walk.C.MOODS), i % 31 > 0, None if i % 31 == 0 else x[i].tolist()) for i in range(N)]
    names = [c for c in walk._SLIM if c != "unit"]
    schema = ", ".join(f"{c} {t}" for c, t in zip(names, ["bigint", "int", "double", "boolean", *["double"] * len(walk.C.MOODS)], strict=True))
    rows = spark.createDataFrame(rows, f"{schema}, there boolean, x array<float>").repartition(3)
    s = walk.Sampler(mood_box={"sad": {"min": 0.95}})
    made = shelf.shelve(rows, "x", walk._prepared(s), "bpm")
    yield made.open(), s
    made.drop()


def brute(lib, gates, at, k, visited):
    """(row's place, cosine) of each survivor in order, pair by pair."""
    found = []
    for p in np.flatnonzero(lib.known):
        b, c, now = gates.bpm[p], gates.bpm[at], gates.bpm[at]
        if lib.plain["id"][p] in visited or not gates.open[gates.slot[at], gates.slot[p]] or not gates.bits[p] >> k & 1 or (now > 0 and b > 0 and not abs(b - c) / c <= 0.1):
            continue
        found.append(p)
    p = np.array(found, np.int64)
    v = lib.cosines(lib.units(np.array([at])), np.zeros(len(p), np.int64), p)
    return [(-a, gates.verdict[gates.slot[at], gates.slot[q]], lib.plain["id"][q]) for a, q in zip(v, p, strict=True)]


def test_sampled_picks_are_exact(files, monkeypatch):
    lib, s = files
    gates = walk._Gates(lib, s)
    at = np.flatnonzero(lib.known)[::37]
    slot, now = gates.slot[at], gates.bpm[at]
    low, high = walk._tempo_ends(now, now, 0.1)
    closed = lib.places(lib.plain["id"][at][:, None])
    _, known = gates.counts(slot, low, high, closed)
    for k in range(gates.levels):
        want = [sorted(brute(lib, gates, a, k, {lib.plain["id"][a]})) for a in at]
        assert [len(w) for w in want] == known[:, k].tolist()
    k = gates.levels - 1
    want = [sorted(brute(lib, gates, a, k, {lib.plain["id"][a]})) for a in at]
    has = np.array([len(w) > 0 for w in want])
    for sampled, stride in ((10**9, 16), (20, 3)):
        monkeypatch.setattr(walk, "SAMPLED", sampled)
        monkeypatch.setattr(walk, "STRIDE", stride)
        for share in (0.0, 0.1, 0.4, 1.0):
            rank = np.array([max(1, int(share * len(w))) for w in want])
            chunk = walk._Chunk(gates, lib.units(at), slot, low, high, rank, known[:, k], k, closed)
            place, sim = chunk.picks()
            got = [(-sim[i], lib.plain["id"][place[i]]) if place[i] >= 0 else None for i in range(len(at))]
            assert got == [(w[r - 1][0], w[r - 1][2]) if h else None for w, r, h in zip(want, rank, has, strict=True)]


def test_tempo_ends_are_those_of_the_comparison():
    now = np.array([100.0, 83.7, 0.0, 61.3])
    low, high = walk._tempo_ends(now, now, 0.1)
    for v in np.round(np.arange(40, 140, 0.1), 1):
        far = np.array([n > 0 and not abs(v - n) / n <= 0.1 for n in now])
        assert (~far == ((v >= low) & (v <= high))).all()


def test_a_window_that_misses_is_looked_at_again(files, monkeypatch):
    lib, s = files
    gates = walk._Gates(lib, s)
    at = np.flatnonzero(lib.known)[:5]
    everything = np.full(5, int(lib.known.sum()))
    closed = (np.zeros(0, np.int64), np.zeros(0, np.int64))
    chunk = walk._Chunk(gates, lib.units(at), gates.slot[at], np.zeros(5), np.zeros(5), np.full(5, 300), everything, None, closed)
    place, sim = chunk.picks()
    monkeypatch.setattr(walk._Chunk, "window", lambda self: (np.full(5, 0.9, np.float32), np.full(5, 0.95, np.float32)))
    again = chunk.picks()
    assert (again[0] == place).all() and (again[1] == sim).all()


def test_gates_alone_need_no_embeddings(spark):
    from crateflow.operators import blocks

    rows = [(i, i % 24, 100.0 + i, False, *[None] * len(walk.C.MOODS), i != 2) for i in range(1, 7)]
    names = [c for c in walk._SLIM if c != "unit"]
    types = ["bigint", "int", "double", "boolean", *["double"] * len(walk.C.MOODS)]
    lib = spark.createDataFrame(rows, ", ".join(f"{c} {t}" for c, t in zip(names, types, strict=True)) + ", there boolean")
    state = lib.where("id = 1").selectExpr("id as walk_id", "slot", "bpm", "bpm as centre", "array(id) as visited")
    got = sorted(map(tuple, blocks.cross(state, lib, walk.gate_kernel(walk.Sampler()), walk.GATED).collect()))
    assert got == [(1, 3, 0), (1, 4, 1), (1, 5, 1)]
