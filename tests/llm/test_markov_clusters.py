"""Groups of similar vectors: no partner may be lost to others that stand nearer."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from crateflow.llm import markov_clusters, similar_vectors

SCHEMA = "id bigint, clap_embedding array<float>, bpm double"
DIM = 16


def crowd(n, noise, seed):
    rng = np.random.default_rng(seed)
    base = np.zeros(DIM)
    base[0] = 1.0
    return base + noise * rng.standard_normal((n, DIM))


def test_partners_behind_a_crowd_of_another_tempo_share_a_group(spark):
    a, b = np.zeros(DIM), np.zeros(DIM)
    a[:2], b[:2] = [0.94, 0.34], [0.94, -0.34]
    rows = [(1, a.tolist(), 100.0), (2, b.tolist(), 101.0)] + [(10 + i, v.tolist(), 180.0) for i, v in enumerate(crowd(200, 0.01, 1))]
    got = markov_clusters.groups(spark.createDataFrame(rows, SCHEMA), F.col("bpm"), dim=DIM)
    cluster = {r.id: r.cluster for r in got.collect()}
    assert cluster[1] == cluster[2] != cluster[10]


def test_every_link_of_a_shard_is_found():
    rng = np.random.default_rng(2)
    v = crowd(300, 0.2, 3)
    attr = rng.uniform(80, 130, 300)
    packed = np.rint(v / np.abs(v).max(axis=1)[:, None] * 32767).astype("<i2")
    table = pa.table({"node": np.arange(300), "attr": attr, "home": np.arange(300) % 2 == 0, "vec": pa.array([x.tobytes() for x in packed], pa.binary())})
    found = similar_vectors.linked_shard(table, 0.75, 1.08, DIM).to_pylist()
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    want = {(i, j) for i in range(300) for j in range(i + 1, 300) if unit[i] @ unit[j] >= 0.75 and max(attr[i], attr[j]) <= 1.08 * min(attr[i], attr[j])}
    assert max(np.bincount(np.array(list(want)).ravel())) > 32
    got = [(r["node"], r["near"]) for r in found if r["node"] != r["near"]]
    assert set(got) == want and len(got) == len(want)
    assert {r["node"] for r in found if r["node"] == r["near"]} == set(range(0, 300, 2))
