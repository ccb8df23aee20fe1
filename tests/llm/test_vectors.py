import numpy as np
import pytest
from pyspark.sql import functions as F

from crateflow.llm import markov_clusters as M
from crateflow.llm import pruned_graph as G
from crateflow.llm import similar_vectors as V

DIM = 16
SCHEMA = "id bigint, clap_embedding array<float>, node string, v int, bpm double"


def table(spark, vectors, bpm=None):
    rows = [(i, None if v is None else [float(x) for x in v], "x", 1, None if bpm is None else bpm[k]) for k, (i, v) in enumerate(vectors)]
    return spark.createDataFrame(rows, SCHEMA)


def brute(vectors, k, least):
    good = [(i, np.array(v, np.float32).astype(float)) for i, v in vectors if v is not None and len(v) == DIM and not np.isnan(v).any() and np.any(v)]
    unit = {i: v / np.linalg.norm(v) for i, v in good}
    out = set()
    for i in unit:
        near = sorted(((-round(float(unit[i] @ unit[j]), 5), j) for j in unit if j != i))[:k]
        out |= {(i, j) for s, j in near if -s >= least}
    return out


def clustered(n, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((n // 8, DIM))
    return [(i + 1, centres[i % len(centres)] + 0.2 * rng.standard_normal(DIM)) for i in range(n)]


def test_recall_against_brute_force(spark):
    data = clustered(600)
    got = {(r.id, r.near_id) for r in V.most_similar(table(spark, data), k=5, least=0.75, dim=DIM).collect()}
    want = brute(data, 5, 0.75)
    assert len(got & want) >= 0.97 * len(want) and len(got) <= 1.02 * len(want)


def test_several_shards(spark, monkeypatch):
    monkeypatch.setattr(V, "SHARD", 100)
    monkeypatch.setattr(V, "SHARD_MOST", 60)
    data = clustered(600, 2)
    got = {(r.id, r.near_id) for r in V.most_similar(table(spark, data), k=5, least=0.75, dim=DIM).collect()}
    want = brute(data, 5, 0.75)
    assert len(got & want) >= 0.9 * len(want)


def test_a_crowded_place_is_split_with_its_queries(spark, monkeypatch):
    monkeypatch.setattr(V, "SHARD", 100)
    monkeypatch.setattr(V, "SHARD_MOST", 200)
    rng = np.random.default_rng(9)
    bunches = np.eye(DIM)[0] + 0.15 * rng.standard_normal((250, DIM))
    dense = np.repeat(bunches, 8, axis=0) + 0.01 * rng.standard_normal((2000, DIM))
    data = [(i, v) for i, v in enumerate(np.vstack([dense, rng.standard_normal((500, DIM))]).tolist())] + [(10_000 + i, dense[0].tolist()) for i in range(1000)]
    df = table(spark, data)
    routed = V.route(V.nodes(df, "id", "clap_embedding"), len(data), DIM)
    per = {r.shard: r.n for r in routed.groupBy("shard").agg(F.count("*").alias("n")).collect()}
    # ten times SHARD_MOST in one place, and 1,000 copies of one vector: no shard holds more than a few times SHARD_MOST
    assert len(per) > 10 and max(n for s, n in per.items() if s >= 0) < 3 * V.SHARD_MOST
    assert sum(n for s, n in per.items() if s < 0) == len(data)
    got = {(r.id, r.near_id) for r in V.most_similar(df.where("id < 10000"), k=5, least=0.75, dim=DIM).where("id % 50 = 0").collect()}
    want = {p for p in brute([(i, v) for i, v in data if i < 10_000 and i < 2000], 5, 0.75) if p[0] % 50 == 0}
    assert len(got & want) >= 0.9 * len(want)


def test_centroids_of_a_sample_that_cannot_be_split():
    same = np.tile(np.eye(DIM)[0], (100, 1)).astype(np.float16)
    assert len(V.fit_centroids(same, 10**6)) <= V.SPLIT
    assert V.fit_centroids(np.zeros((0, DIM), np.float16), 0).shape == (1, DIM)


def test_copies_and_bad_vectors(spark):
    a, b = np.eye(DIM)[0], np.eye(DIM)[1]
    nan = a.copy()
    nan[3] = np.nan
    data = [(9, a), (2, a), (5, a), (7, a), (1, a), (3, a), (4, a), (6, a), (8, a), (10, b), (11, None), (12, []), (13, a[:4]), (14, nan), (15, np.zeros(DIM))]
    df = table(spark, data)
    got = {(r.id, r.near_id, r.rank) for r in V.most_similar(df.union(df.limit(3)), k=3, least=0.5, dim=DIM).collect()}
    assert {(r, n) for i, n, r in got if i == 9} == {(1, 1), (2, 2), (3, 3)}
    assert {(r, n) for i, n, r in got if i == 2} == {(1, 1), (2, 3), (3, 4)}
    assert not {i for i, *_ in got} & {10, 11, 12, 13, 14, 15}


def test_empty(spark):
    assert V.most_similar(table(spark, []), dim=DIM).count() == 0
    assert M.groups(table(spark, []), F.col("bpm"), dim=DIM).count() == 0


def test_graph_keeps_every_node_reachable():
    pts = G.project(np.stack([v / np.linalg.norm(v) for _, v in clustered(400)]).astype(np.float32))
    g = G.build(pts)
    seen, todo = {0}, [0]
    while todo:
        for x in g[todo.pop()]:
            if x >= 0 and x not in seen:
                seen.add(int(x))
                todo.append(int(x))
    assert len(seen) > 390
    assert ((g >= 0).sum(axis=1) <= G.DEGREE).all()


def test_groups_need_the_same_tempo(spark):
    a, b = np.ones(DIM), np.eye(DIM)[0]
    data = [(1, a), (2, a * 2), (3, a + 0.01 * b), (4, a), (5, b), (6, a), (7, a)]
    df = table(spark, data, [100.0, 105.0, 104.0, 150.0, 100.0, None, 0.0])
    got = {r.id: r.cluster for r in M.groups(df, F.col("bpm"), dim=DIM).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5}
    described = {r.cluster: (r.size, len(r.typical)) for r in M.describe(M.groups(df, F.col("bpm"), dim=DIM)).collect()}
    assert described == {1: (3, 3), 4: (1, 1), 5: (1, 1)}
    assert {(r.id_a, r.id_b) for r in M.pairs(M.groups(df, F.col("bpm"), dim=DIM)).collect()} == {(1, 2), (1, 3), (2, 3)}


@pytest.mark.parametrize("block", [2000, 1])
def test_block_and_distributed_flow_agree(spark, monkeypatch, block):
    monkeypatch.setattr(M, "BLOCK_NODES", block)
    edges = [(1, 2, 0.9), (2, 3, 0.9), (1, 3, 0.9), (4, 5, 0.9), (5, 6, 0.9), (4, 6, 0.9), (8, 9, 0.8)]
    got = M.cluster(spark.createDataFrame(edges, "node bigint, near bigint, cos double")).collect()
    parts = {}
    for r in got:
        parts.setdefault(r.cluster, set()).add(r.node)
    assert sorted(map(sorted, parts.values())) == [[1, 2, 3], [4, 5, 6], [8, 9]]


def test_both_ways_of_squaring_agree(spark):
    rng = np.random.default_rng(6)
    edges = {}
    for _ in range(4):
        for i, j in rng.integers(0, 60, (150, 2)).tolist():
            a, b = sorted((i % 20 + 20 * (j % 3), j % 20 + 20 * (j % 3)))
            if a != b:
                edges[a, b] = round(0.75 + 0.2 * float(rng.random()), 3)
    edges |= {(3, 23): 0.75, (25, 45): 0.75}
    df = spark.createDataFrame([(a, b, w) for (a, b), w in edges.items()], "node bigint, near bigint, cos double")
    here, apart = ({r.node: (r.cluster, round(r.flow, 6), r.settled) for r in M.cluster(df, block, rounds=4).collect()} for block in (2000, 1))

    def parts(x):
        out = {}
        for node, (c, *_) in x.items():
            out.setdefault(c, set()).add(node)
        return sorted(map(sorted, out.values()))

    # so few rounds that the flow hasn't come to rest: both say so
    assert parts(here) == parts(apart) and not any(s for *_, s in here.values())
    assert {n: v[1:] for n, v in here.items()} == {n: v[1:] for n, v in apart.items()}


def test_sparse_and_dense_blocks_agree():
    rng = np.random.default_rng(8)
    m = np.where(rng.random((40, 40)) < 0.2, rng.random((40, 40)), 0)
    i, j = np.nonzero(m)
    a, b, v = M._squared(40, i, j, m[i, j])
    full = np.zeros((40, 40))
    full[a, b] = v
    assert np.allclose(full, m @ m)


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "node bigint, near bigint")
    assert {(r.node, r.comp) for r in M.components(edges).collect()} == {(i, 0) for i in range(41)} | {(100, 100), (101, 100)}
