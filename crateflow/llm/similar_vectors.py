"""The most similar vectors for every vector, by cosine.

Vectors are routed to shards around centroids fitted on a bounded sample; a vector nearly as close to
other centroids goes to their shards too, so that close pairs share one. In each shard a robust-pruned
directed graph is built and beam search from every member proposes neighbours, which are ranked with
the full vectors. Centroids come from splitting: a cell of the sample that stands for too many vectors is
split by k-means, again and again, so a crowded place gets as many centroids as it needs and no shard
holds many more than ``SHARD_MOST``. Equal vectors are one node, so a group of copies, however large,
costs one search; their ids travel beside, spread by their own hash, and come back in a narrow join.

Vectors travel as 16-bit integers with a scale of their own: a cosine is exact to about 1e-6. The
driver holds the sample in 16-bit floats and k centroids, and compares them in blocks; executors get
the centroids (2 KB each) and nothing of size k x k.

Defined cases: null, empty, wrong-sized, NaN or all-zero vectors have no neighbours. Equal cosines (9
decimals) go to the lower id; copies have cosine 1. Repeated rows of one id count once. Empty tables
give empty results. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from crateflow.llm.pruned_graph import BLOCK, beam_search, build, project
from crateflow.llm.vectors import matrix
from crateflow.session import durable

#: Rows of the sample on which centroids are fitted: a 32nd, between these bounds.
SAMPLE, SAMPLE_MOST = 6000, 100_000
#: Vectors of a cell after a split, and at most before one.
SHARD, SHARD_MOST = 8000, 20_000
#: Centroids of one split, and the fewest sampled vectors that say where to split.
SPLIT, FEWEST = 32, 32
#: A vector also goes to centroids whose cosine is below its best by at most this share of the distance
#: between the two centroids: about two and a half deviations of what parts two vectors of cosine 0.8.
MARGIN = 0.015
QUERY_BEAM = 48
DIM = 512
#: Ids of one node table that travel together, about.
IDS = 200_000
#: ``cos`` null: ``near`` is the id of a row whose vector is the node.
FOUND = "node bigint, near bigint, cos double"


def nearest_centre(points: np.ndarray, centres: np.ndarray, block: int = 4096) -> np.ndarray:
    """Each point's centre, a block of points at a time."""
    out = np.zeros(len(points), np.int64)
    for s in range(0, len(points), block):
        out[s : s + block] = (points[s : s + block].astype(np.float32) @ centres.T).argmax(axis=1)
    return out


def kmeans(sample: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means on unit rows."""
    rng = np.random.default_rng(3)
    if len(sample) <= k:
        return sample.astype(np.float32)
    centres = sample[rng.choice(len(sample), k, replace=False)].astype(np.float32)
    for _ in range(rounds):
        own = nearest_centre(sample, centres)
        order = np.argsort(own, kind="stable")
        first = np.flatnonzero(np.r_[True, own[order][1:] != own[order][:-1]])
        sums = np.add.reduceat(sample[order].astype(np.float32), first, axis=0)
        norm = np.linalg.norm(sums, axis=1)
        there = own[order][first]
        centres[there[norm > 0]] = sums[norm > 0] / norm[norm > 0][:, None]
    return centres


def fit_centroids(sample: np.ndarray, rows: int) -> np.ndarray:
    """Centroids of cells of at most about ``SHARD_MOST`` of the ``rows`` vectors that the sample stands for."""
    if not len(sample):
        return np.zeros((1, sample.shape[1]), np.float32)
    weight, open_, done = rows / len(sample), [(np.arange(len(sample)), None)], []
    while open_:
        own, centre = open_.pop()
        load = len(own) * weight
        if centre is not None and (load <= SHARD_MOST or len(own) < FEWEST):
            done.append(centre)
            continue
        k = int(min(SPLIT, max(1, load // SHARD), max(1, len(own) // 16)))
        centres = kmeans(sample[own], k)
        cell = nearest_centre(sample[own], centres)
        parts = [own[cell == c] for c in range(len(centres))]
        # what can't be parted any more stays one cell
        whole = max(map(len, parts)) == len(own)
        for c, part in enumerate(parts):
            if len(part):
                if whole:
                    done.append(centres[c])
                else:
                    open_.append((part, centres[c]))
    return np.array(done, np.float32)


def _sample(vectors: DataFrame, rows: int, dim: int) -> np.ndarray:
    """Distinct unit vectors in 16 bits, picked by a hash of the vector: a bounded number, the same each time."""
    share = min(1.0, min(max(rows / 32, SAMPLE), SAMPLE_MOST) / max(rows, 1))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, m = matrix(b.column(0), dim)
            unit = (m / np.linalg.norm(m, axis=1)[:, None]).astype("<f2")
            yield pa.RecordBatch.from_arrays([b.column(1).take(pa.array(at)), pa.array([r.tobytes() for r in unit], pa.binary())], names=["node", "v"])

    picked = vectors.where(F.pmod(F.xxhash64("node"), F.lit(1 << 20)) < int(share * (1 << 20))).select("v", "node")
    raw = picked.mapInArrow(pack, "node bigint, v binary").dropDuplicates(["node"]).orderBy("node").select("v").toArrow().column(0)
    return np.frombuffer(b"".join(raw.to_pylist()), "<f2").reshape(-1, dim)


def nodes(rows: DataFrame, id_col: str, vector: str, attribute: Column | None = None) -> DataFrame:
    """(id, v, attr, node): ``node`` is equal for rows with equal vector and attribute."""
    attr = F.lit(0.0) if attribute is None else attribute.cast("double")
    return rows.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector).alias("v"), attr.alias("attr")).select("id", "v", "attr", F.xxhash64("v", "attr").alias("node"))


def route(vectors: DataFrame, rows: int, dim: int = DIM, sample_from: DataFrame | None = None) -> DataFrame:
    """(shard, node, attr, home, vec, id): each node at least once with its vector, and each row's id with its node under a negative shard.

    ``vectors``: (id, v, attr, node); ``sample_from``: (v, node) for the centroids, else these. A partition sends
    the vector of a node once, not once per copy (beyond a million nodes it may be sent again, which changes nothing).
    """
    sample = _sample(vectors if sample_from is None else sample_from, rows, dim)
    shared = vectors.sparkSession.sparkContext.broadcast(fit_centroids(sample, rows))
    tables = max(1, rows // IDS)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = shared.value
        sent: set[int] = set()
        names = ["shard", "node", "attr", "home", "vec", "id"]
        for b in batches:
            at, m = matrix(b.column(0), dim)
            if not len(at):
                continue
            node, attr, ids = b.column(1).to_numpy(), b.column(2).to_numpy(zero_copy_only=False), b.column(3).to_numpy()
            n = len(at)
            table = -1 - (ids[at].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % tables
            yield pa.RecordBatch.from_arrays([pa.array(table.astype(np.int32)), pa.array(node[at]), pa.nulls(n, pa.float64()), pa.nulls(n, pa.bool_()), pa.nulls(n, pa.binary()), pa.array(ids[at])], names=names)
            fresh = np.unique(node[at], return_index=True)[1]
            fresh = np.array([x for x in fresh if node[at[x]] not in sent], np.int64)
            if len(sent) < 1_000_000:
                sent.update(node[at[fresh]].tolist())
            at, m = at[fresh], m[fresh]
            for s in range(0, len(at), 2048):
                yield from _sent(at[s : s + 2048], m[s : s + 2048], node, attr, centres, names, dim)

    return vectors.select("v", "node", "attr", "id").mapInArrow(send, "shard int, node bigint, attr double, home boolean, vec binary, id bigint")


def _sent(at: np.ndarray, m: np.ndarray, node: np.ndarray, attr: np.ndarray, centres: np.ndarray, names: list[str], dim: int) -> Iterator[pa.RecordBatch]:
    unit = (m / np.linalg.norm(m, axis=1)[:, None]).astype(np.float32)
    close = unit @ centres.T
    home = close.argmax(axis=1)
    best = close.max(axis=1)
    # two unit vectors are at most 2 apart: only centroids within that margin are looked at closely
    r, c = np.nonzero(close >= best[:, None] - 2 * MARGIN - 1e-7)
    apart = np.linalg.norm(centres[c] - centres[home[r]], axis=1)
    near = close[r, c] >= best[r] - MARGIN * apart - 1e-7
    r, c = r[near], c[near]
    packed = np.rint(m / np.abs(m).max(axis=1)[:, None] * 32767).astype("<i2")
    raw = pa.FixedSizeBinaryArray.from_buffers(pa.binary(dim * 2), len(packed), [None, pa.py_buffer(packed.tobytes())]).cast(pa.binary())
    for s in range(0, len(r), 4096):
        p = slice(s, s + 4096)
        who = at[r[p]]
        yield pa.RecordBatch.from_arrays([pa.array(c[p].astype(np.int32)), pa.array(node[who]), pa.array(attr[who]), pa.array((c == home[r])[p]), raw.take(pa.array(r[p])), pa.nulls(len(who), pa.int64())], names=names)


def _unpacked(table: pa.Table, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(nodes, attributes, unit vectors, nodes at home) of a shard, each node once."""
    node = table.column("node").to_numpy()
    first = np.unique(node, return_index=True)[1]
    table = table.take(pa.array(first))
    node, attr = node[first], table.column("attr").to_numpy()
    raw = b"".join(table.column("vec").to_pylist())
    full = np.frombuffer(raw, "<i2").reshape(-1, dim).astype(np.float32)
    full /= np.linalg.norm(full, axis=1)[:, None]
    return node, attr, full, node[table.column("home").to_numpy(zero_copy_only=False)]


def _ids(table: pa.Table) -> pa.Table:
    return pa.table({"node": table.column("node"), "near": table.column("id"), "cos": pa.nulls(table.num_rows, pa.float64())})


def by_shard(routed: DataFrame, search: Callable[[pa.Table], pa.Table]) -> DataFrame:
    """FOUND rows of every shard, and the ids of every node."""
    return routed.groupBy("shard").applyInArrow(lambda t: _ids(t) if t.column("shard")[0].as_py() < 0 else search(t), FOUND)


def _found(parts: list[tuple[np.ndarray, ...]], own: np.ndarray) -> pa.Table:
    a, b, c = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    return pa.table({"node": pa.array(np.concatenate([a, own])), "near": pa.array(np.concatenate([b, own])), "cos": pa.array(np.concatenate([np.minimum(c, 1.0), np.ones(len(own))]))})


def search_shard(table: pa.Table, k: int, least: float, dim: int) -> pa.Table:
    """(node, near, cos) of the best ``k`` candidates of every node of a shard."""
    node, _, full, own = _unpacked(table, dim)
    out: list[tuple[np.ndarray, ...]] = []
    points = project(full)
    graph = build(points)
    beam = max(QUERY_BEAM, k + 16)
    for s in range(0, len(node), BLOCK):
        o = np.arange(s, min(len(node), s + BLOCK))
        cand, _ = beam_search(points, graph, points[o], o[:, None], beam)
        safe = np.where(cand < 0, 0, cand)
        cos = np.matmul(full[safe], full[o][:, :, None])[:, :, 0].astype(np.float64)
        good = (cand >= 0) & (safe != o[:, None]) & (cos >= least)
        cos = np.where(good, cos, -np.inf)
        top = np.argsort(-cos, axis=1, kind="stable")[:, :k]
        cos = np.take_along_axis(cos, top, axis=1)
        r, c = np.nonzero(np.isfinite(cos))
        out.append((node[o][r], node[np.take_along_axis(safe, top, axis=1)[r, c]], cos[r, c]))
    return _found(out, own)


def linked_shard(table: pa.Table, least: float, ratio: float, dim: int) -> pa.Table:
    """(node, near, cos), node < near: every pair of a shard of cosine ``least`` or more and attributes within ``ratio``.

    Exact: in the order of the attribute, a block of nodes meets the nodes after it that its attributes allow.
    """
    node, attr, full, own = _unpacked(table, dim)
    order = np.argsort(attr, kind="stable")
    node, attr, full, ratio = node[order], attr[order], full[order], ratio * (1 + 1e-12)
    out: list[tuple[np.ndarray, ...]] = []
    for s in range(0, len(node), BLOCK):
        e = min(s + BLOCK, len(node))
        high = np.searchsorted(attr, attr[e - 1] * ratio * (1 + 1e-9), side="right")
        cos = full[s:e] @ full[s:high].T
        r, c = np.nonzero(cos >= least)
        r, c = r[c > r], c[c > r]
        good = attr[s + c] <= ratio * attr[s + r]
        r, c = r[good], c[good]
        a, b = node[s + r], node[s + c]
        out.append((np.minimum(a, b), np.maximum(a, b), cos[r, c].astype(np.float64)))
    return _found(out, own)


def neighbours(vectors: DataFrame, rows: int, k: int, least: float = -1.0, dim: int = DIM) -> DataFrame:
    """(node, near, cos): up to ``k`` nearest per node and shard, a row of itself for each valid node, and its ids (``cos`` null)."""
    return by_shard(route(vectors, rows, dim), lambda t: search_shard(t, k, least, dim))


def linked(vectors: DataFrame, rows: int, least: float, ratio: float, dim: int = DIM, sample_from: DataFrame | None = None) -> DataFrame:
    """(node, near, cos), node < near: all pairs per shard of cosine ``least`` or more and attributes within ``ratio``; also a row of itself for each valid node, and its ids (``cos`` null)."""
    return by_shard(route(vectors, rows, dim, sample_from), lambda t: linked_shard(t, least, ratio, dim))


def most_similar(rows: DataFrame, id_col: str = "id", vector: str = "clap_embedding", k: int = 5, least: float = -1.0, dim: int = DIM) -> DataFrame:
    """(id, near_id, cos, rank): for every valid row the ``k`` other rows most similar to it, cosine ``least`` or more."""
    both = durable(neighbours(nodes(rows, id_col, vector), rows.count(), k, least, dim))
    found = both.where("cos is not null")
    # the k+1 lowest ids stand for all copies of a node: no other can be among anybody's k nearest
    copies = both.where("cos is null").select(F.col("near").alias("id"), "node").distinct()
    low = copies.withColumn("r", F.row_number().over(W.partitionBy("node").orderBy("id"))).where(F.col("r") <= k + 1).select(F.col("node").alias("near"), F.col("id").alias("near_id"))
    best = found.groupBy("node", "near").agg(F.max("cos").alias("cos"))
    wide = best.join(low, "near").select("node", "near_id", F.round("cos", 9).alias("cos"))
    near = F.struct((-F.col("cos")).alias("d"), F.col("near_id").alias("id"))
    lists = (
        wide.withColumn("r", F.row_number().over(W.partitionBy("node").orderBy(F.col("cos").desc(), "near_id")))
        .where(F.col("r") <= k + 1)
        .groupBy("node")
        .agg(F.sort_array(F.collect_list(near)).alias("near"))
    )
    others = F.slice(F.filter("near", lambda x: x["id"] != F.col("id")), 1, k)
    return copies.join(lists, "node").select("id", F.posexplode(others).alias("p", "n")).select("id", F.col("n.id").alias("near_id"), (-F.col("n.d")).alias("cos"), (F.col("p") + 1).alias("rank"))
