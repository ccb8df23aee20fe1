"""Groups of mutually similar records, by Markov clustering of a similarity graph.

The graph links records whose vectors have a cosine of at least ``least`` and whose attribute (the
tempo) differs by at most a ratio; every such pair of a shard of the vector routing is a link. A flow
matrix over it is squared, inflated (powers, columns scaled to sum 1) and pruned until it stands still; the attractor that
holds most of a column's flow names its cluster, and the members with the strongest flow represent it.

The matrix is block-diagonal over connected components, and squaring keeps it so. Components are found
on the executors. A block of up to ``BLOCK_NODES`` rows is squared where it lies, by its nonzero entries or,
where most are nonzero, as a whole; a larger one is a table of entries squared by a join and a sum. Rules
and end are the same in both: no entry changes by ``STILL`` or more. What hasn't come to rest after
``ROUNDS`` squarings is marked as not ``settled``.

Defined cases: records without a valid vector or a positive attribute take no part. Records with equal
vector and attribute are one node and so always share a cluster. A record without a link is a cluster of
its own. Ties go to the lower node. Empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from crateflow.llm import similar_vectors as V
from crateflow.session import durable

INFLATION = 1.4
PRUNE = 1e-4
ROUNDS, STILL = 40, 1e-6
BLOCK_NODES = 2000
#: A member belongs to every attractor that holds more than this share of its flow; those are one cluster.
SHARE = 0.05


def components(links: DataFrame) -> DataFrame:
    """(node, comp): connected components of (node, near), by least-label spreading with shortcuts.

    Labels move in joins; each round is checkpointed. Nothing is gathered on the driver but a count.
    """
    both = durable(links.select("node", "near").union(links.select("near", "node")).distinct())
    labels = durable(both.groupBy("node").agg(F.least(F.col("node"), F.min("near")).alias("comp")))
    while True:
        near = both.join(labels.select(F.col("node").alias("near"), F.col("comp").alias("c")), "near").groupBy("node").agg(F.min("c").alias("c"))
        spread = labels.join(near, "node", "left").select("node", F.least("comp", F.coalesce("c", "comp")).alias("comp"), F.col("comp").alias("was"))
        up = labels.select(F.col("node").alias("comp"), F.col("comp").alias("root"))
        jumped = durable(spread.join(up, "comp", "left").select("node", F.least("comp", F.coalesce("root", "comp")).alias("comp"), "was"))
        labels = jumped.select("node", "comp")
        if not jumped.where("comp <> was").limit(1).count():
            return labels


def _squared(n: int, i: np.ndarray, j: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nonzero entries of a sparse matrix times itself."""
    order = np.argsort(j, kind="stable")
    count = np.bincount(j, minlength=n)
    start = np.cumsum(count) - count
    # each entry (x, j) meets all entries (i, x)
    times = count[i]
    mine = np.repeat(np.arange(len(i)), times)
    other = order[np.repeat(start[i], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)]
    at, place = np.unique(i[other] * n + j[mine], return_inverse=True)
    return at // n, at % n, np.bincount(place, w[other] * w[mine], len(at))


def _normal(n: int, j: np.ndarray, w: np.ndarray) -> np.ndarray:
    return w / np.bincount(j, w, n)[j]


def flow(n: int, i: np.ndarray, j: np.ndarray, w: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, bool]:
    """(cluster attractor of each node, its flow, whether it came to rest) of one block."""
    at = np.concatenate([i * n + j, j * n + i])
    at, place = np.unique(at, return_inverse=True)
    both = np.zeros(len(at))
    np.maximum.at(both, place, np.concatenate([w, w]))
    loop = np.zeros(n)
    np.maximum.at(loop, at % n, both)
    i, j, w = np.concatenate([at // n, np.arange(n)]), np.concatenate([at % n, np.arange(n)]), np.concatenate([both, np.maximum(loop, 1e-9)])
    w = _normal(n, j, w)
    settled = False
    for _ in range(rounds):
        if len(i) * 4 > n * n:
            m = np.zeros((n, n))
            m[i, j] = w
            m = m @ m
            a, b = np.nonzero(m)
            v = m[a, b]
        else:
            a, b, v = _squared(n, i, j, w)
        v = _normal(n, b, v**INFLATION)
        kept = v >= PRUNE
        a, b, v = a[kept], b[kept], v[kept]
        v = _normal(n, b, v)
        keys, place = np.unique(np.concatenate([i * n + j, a * n + b]), return_inverse=True)
        change = np.bincount(place, np.concatenate([-w, v]), len(keys))
        i, j, w = a, b, v
        if settled := bool(np.abs(change).max(initial=0) < STILL):
            break
    order = np.lexsort((i, -w, j))
    best = np.zeros(n, np.int64)
    first = np.flatnonzero(np.r_[True, j[order][1:] != j[order][:-1]])
    best[j[order][first]] = i[order][first]
    root = np.arange(n)
    # attractors that share columns' flow are one cluster: follow them to the lowest
    shared = w > SHARE
    for a, col in zip(i[shared].tolist(), j[shared].tolist(), strict=True):
        x, y = _find(root, a), _find(root, int(best[col]))
        root[max(x, y)] = min(x, y)
    return np.array([_find(root, x) for x in best.tolist()]), np.bincount(i, w, n), settled


def _find(root: np.ndarray, x: int) -> int:
    while root[x] != x:
        root[x] = root[root[x]]
        x = root[x]
    return x


def _blocks(pdf: pd.DataFrame, rounds: int) -> pd.DataFrame:
    out = []
    for _, rows in pdf.groupby("comp", sort=False):
        ids, at = np.unique(np.concatenate([rows["node"], rows["near"]]), return_inverse=True)
        cluster, strength, settled = flow(len(ids), at[: len(rows)], at[len(rows) :], rows["cos"].to_numpy(), rounds)
        out.append(pd.DataFrame({"node": ids, "cluster": ids[cluster], "flow": strength, "settled": settled}))
    return pd.concat(out) if out else pd.DataFrame({"node": [], "cluster": [], "flow": [], "settled": []})


def distributed_flow(entries: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(node, cluster, flow, settled) for components too large for one block: the same rules over (i, j, w) entries."""
    sym = entries.select(F.col("node").alias("i"), F.col("near").alias("j"), F.col("cos").alias("w")).union(entries.select("near", "node", "cos")).groupBy("i", "j").agg(F.max("w").alias("w"))
    loops = sym.groupBy("j").agg(F.greatest(F.max("w"), F.lit(1e-9)).alias("w")).select(F.col("j").alias("i"), "j", "w")
    m = durable(_columns(sym.union(loops)))
    settled = False
    for _ in range(rounds):
        left, right = m.select("i", F.col("j").alias("x"), F.col("w").alias("a")), m.select(F.col("i").alias("x"), "j", F.col("w").alias("b"))
        square = left.join(right, "x").groupBy("i", "j").agg(F.sum(F.col("a") * F.col("b")).alias("w"))
        new = durable(_columns(_columns(square.withColumn("w", F.pow("w", INFLATION))).where(F.col("w") >= PRUNE)))
        change = new.union(m.select("i", "j", -F.col("w"))).groupBy("i", "j").agg(F.abs(F.sum("w")).alias("w")).agg(F.max("w").alias("w")).first().w
        m = new
        if settled := (change or 0) < STILL:
            break
    best = m.groupBy("j").agg(F.max_by("i", F.struct("w", -F.col("i"))).alias("top")).select(F.col("j").alias("node"), "top")
    shared = m.where(F.col("w") > SHARE).join(best, F.col("j") == F.col("node")).select(F.col("i").alias("node"), F.col("top").alias("near"))
    roots = components(shared.union(best.select(F.col("top").alias("node"), F.col("top").alias("near"))))
    strength = m.groupBy(F.col("i").alias("node")).agg(F.sum("w").alias("flow"))
    named = best.join(roots.select(F.col("node").alias("top"), F.col("comp").alias("cluster")), "top")
    return named.join(strength, "node", "left").select("node", "cluster", F.coalesce("flow", F.lit(0.0)).alias("flow"), F.lit(settled).alias("settled"))


def _columns(entries: DataFrame) -> DataFrame:
    total = entries.groupBy("j").agg(F.sum("w").alias("t"))
    return entries.join(total, "j").select("i", "j", (F.col("w") / F.col("t")).alias("w"))


def cluster(links: DataFrame, block: int | None = None, rounds: int = ROUNDS) -> DataFrame:
    """(node, cluster, flow, settled) from (node, near, cos) links, which should be cheap to read twice."""
    block = BLOCK_NODES if block is None else block
    labels = components(links)
    size = labels.groupBy("comp").agg(F.count("*").alias("size"))
    tagged = links.join(labels, "node").join(size, "comp")
    small = tagged.where(F.col("size") <= block).select("comp", "node", "near", "cos")
    done = small.repartition("comp").sortWithinPartitions("comp").mapInPandas(lambda batches: _runs(batches, rounds), "node bigint, cluster bigint, flow double, settled boolean")
    if size.where(F.col("size") > block).limit(1).count():
        done = done.unionByName(distributed_flow(tagged.where(F.col("size") > block).select("node", "near", "cos"), rounds))
    return done


def _runs(batches, rounds: int):
    """Blocks of whole components out of rows sorted by component."""
    rest = None
    for pdf in batches:
        pdf = pdf if rest is None else pd.concat([rest, pdf])
        last = pdf["comp"].iloc[-1] if len(pdf) else None
        rest = pdf[pdf["comp"] == last]
        yield _blocks(pdf[pdf["comp"] != last], rounds)
    if rest is not None and len(rest):
        yield _blocks(rest, rounds)


def groups(rows: DataFrame, attribute: Column, id_col: str = "id", vector: str = "clap_embedding", least: float = 0.75, ratio: float = 1.08, dim: int = V.DIM) -> DataFrame:
    """(id, cluster, flow, settled): each record's group, named by a record's id, how much flow it attracts, and whether its flow came to rest."""
    vectors = V.nodes(rows, id_col, vector, attribute).where("attr > 0")
    # centroids don't need the attribute: their sample is read without computing it
    plain = rows.select(F.col(vector).alias("v"), F.xxhash64(vector).alias("node"))
    both = durable(V.linked(vectors, rows.count(), least, ratio, dim, plain))
    found = both.where("cos is not null")
    links = durable(found.where("node <> near").groupBy("node", "near").agg(F.max("cos").alias("cos")))
    named = cluster(links)
    # an id's node comes from the search itself: the table is read once
    ids = both.where("cos is null").select(F.col("near").alias("id"), "node").distinct()
    members = durable(ids.join(named, "node", "left").select("id", F.coalesce("cluster", "node").alias("c"), F.coalesce("flow", F.lit(1.0)).alias("flow"), F.coalesce("settled", F.lit(True)).alias("settled")))
    name = members.groupBy("c").agg(F.min("id").alias("cluster"))
    return members.join(name, "c").select("id", "cluster", "flow", "settled")


def describe(members: DataFrame, typical: int = 3) -> DataFrame:
    """(cluster, size, settled, typical): each group's size, whether its flow came to rest, and the ids of its strongest-flow members."""
    top = members.withColumn("r", F.row_number().over(W.partitionBy("cluster").orderBy(F.col("flow").desc(), "id"))).where(F.col("r") <= typical)
    names = top.groupBy("cluster").agg(F.transform(F.sort_array(F.collect_list(F.struct("r", "id"))), lambda x: x["id"]).alias("typical"))
    return members.groupBy("cluster").agg(F.count("*").alias("size"), F.min("settled").alias("settled")).join(names, "cluster")


def pairs(members: DataFrame) -> DataFrame:
    """(id_a, id_b), id_a < id_b: all pairs within a group."""
    a, b = members.select("cluster", F.col("id").alias("id_a")), members.select("cluster", F.col("id").alias("id_b"))
    return a.join(b, "cluster").where("id_a < id_b").select("id_a", "id_b")
