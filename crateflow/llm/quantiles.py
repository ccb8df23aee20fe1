"""Percentiles of very large numeric columns, per group, from mergeable dyadic-tree counts (q-digest).

A value is quantised to an ordered universe of 2**BITS integers (the leading bits of its ordered
float form). A partition keeps, per group and measure, a tree of counts over that universe: node 1 is
the root, node v has children 2v and 2v+1. A node whose count together with its parent's and sibling's
is at most n/k is folded into the parent. Digests of partitions, volumes or days merge by adding the
counts of equal nodes and compressing again. Rank error is at most BITS/k of n for any order of merging.

Defined cases: nulls and NaN aren't counted; infinities are ordered at the ends; a group without values
has no row; repeated rows count as often as they occur; ties have one quantised value.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Depth of the universe: sign, exponent and 15 bits of the mantissa of a 32-bit float.
BITS = 24
K = 2400


def quantise(values: np.ndarray) -> np.ndarray:
    """Order-preserving map of doubles to 0 .. 2**BITS-1; equal or greater stays equal or greater."""
    with np.errstate(over="ignore"):
        raw = (values + 0.0).astype(np.float32).view(np.int32).astype(np.int64)
    ordered = np.where(raw < 0, ~raw & 0xFFFFFFFF, raw + 0x80000000)
    return ordered >> (32 - BITS)


def bounds(cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest float32 of each quantised value."""
    edges = []
    for x in (cell << (32 - BITS), ((cell + 1) << (32 - BITS)) - 1):
        raw = np.where(x >= 0x80000000, x - 0x80000000, ~x & 0xFFFFFFFF)
        edges.append(raw.astype(np.uint32).view(np.float32).astype(np.float64))
    return edges[0], edges[1]


def compress(nodes: np.ndarray, counts: np.ndarray, n: int, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """Fold light nodes upwards, level by level; counts stay whole."""
    least = n // k
    order = np.argsort(nodes)
    nodes, counts = nodes[order], counts[order]
    level = np.frexp(nodes.astype(np.float64))[1] - 1
    by_level = {d: [nodes[level == d], counts[level == d]] for d in range(BITS + 1)}
    kept: list[tuple[np.ndarray, np.ndarray]] = []
    for d in range(BITS, 0, -1):
        own, c = by_level[d]
        if not len(own):
            continue
        parent, start = np.unique(own >> 1, return_index=True)
        pair = np.add.reduceat(c, start)
        up, cu = by_level[d - 1]
        at = np.searchsorted(up, parent)
        has = (at < len(up)) & (up[np.minimum(at, max(len(up) - 1, 0))] == parent) if len(up) else np.zeros(len(parent), bool)
        total = pair + np.where(has, cu[np.minimum(at, max(len(up) - 1, 0))] if len(up) else 0, 0)
        fold = total <= least
        whole = np.repeat(fold, np.diff(np.append(start, len(own))))
        kept.append((own[~whole], c[~whole]))
        merged = np.concatenate([up, parent[fold]]), np.concatenate([cu, pair[fold]])
        u, inv = np.unique(merged[0], return_inverse=True)
        by_level[d - 1] = [u, np.bincount(inv, merged[1], len(u)).astype(np.int64) if len(u) else merged[1]]
    kept.append(tuple(by_level[0]))
    return np.concatenate([x for x, _ in kept]).astype(np.int64), np.concatenate([c for _, c in kept]).astype(np.int64)


def digest(values: DataFrame, keys: list[str], value: str = "value", k: int = K) -> DataFrame:
    """(keys, node, n): one mergeable digest per group. Only digests are shuffled, not values."""
    types = dict(values.dtypes)
    shape = ", ".join(f"`{c}` {types[c]}" for c in keys) + ", node bigint, n bigint"

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trees: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}
        for pdf in batches:
            for key, rows in pdf.groupby(keys, dropna=False, sort=False):
                cells, c = np.unique(quantise(rows[value].to_numpy(np.float64)) + (1 << BITS), return_counts=True)
                old = trees.get(key)
                if old is not None:
                    cells, inv = np.unique(np.concatenate([old[0], cells]), return_inverse=True)
                    c = np.bincount(inv, np.concatenate([old[1], c])).astype(np.int64)
                trees[key] = compress(cells, c, int(c.sum()), k) if len(cells) > 6 * k else (cells, c)
            if len(trees) > 4096:  # groups without end are passed on early; adding merges them
                yield from dump(trees)
                trees = {}
        yield from dump(trees)

    def dump(trees: dict) -> Iterator[pd.DataFrame]:
        for key, (nodes, c) in trees.items():
            nodes, c = compress(nodes, c, int(c.sum()), k)
            yield pd.DataFrame(dict(zip(keys, ([x] * len(nodes) for x in key), strict=True)) | {"node": nodes, "n": c})

    parts = values.select(*keys, value).where(F.col(value).isNotNull() & ~F.isnan(value)).mapInPandas(local, shape)
    return merge(parts, keys, k)


def merge(digests: DataFrame, keys: list[str], k: int = K) -> DataFrame:
    """Merge digests: add the counts of equal nodes, then compress each group's tree again."""
    types = dict(digests.dtypes)
    shape = ", ".join(f"`{c}` {types[c]}" for c in keys) + ", node bigint, n bigint"

    def again(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        nodes, c = compress(pdf["node"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64), int(pdf["n"].sum()), k)
        return pd.DataFrame(dict(zip(keys, ([x] * len(nodes) for x in key), strict=True)) | {"node": nodes, "n": c})

    return digests.groupBy(*keys, "node").agg(F.sum("n").alias("n")).groupBy(*keys).applyInPandas(again, shape)


def quantiles(digests: DataFrame, keys: list[str], percents: tuple[float, ...], k: int = K) -> DataFrame:
    """(keys, q, total, low, high, estimate): bounds that surely hold the ceil(total*q/100)-th smallest.

    A node stands for values anywhere below it: counting each node at its greatest value gives the
    fewest, at its least value the most values that can be at or below a cell.
    """
    types = dict(digests.dtypes)
    shape = ", ".join(f"`{c}` {types[c]}" for c in keys) + ", q double, total bigint, low double, high double, estimate double"

    def read(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        nodes, c = pdf["node"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64)
        depth = BITS - (np.frexp(nodes.astype(np.float64))[1] - 1)
        first = (nodes << depth) - (1 << BITS)
        last = first + (1 << depth) - 1
        n, out = int(c.sum()), []
        for q in percents:
            rank = max(1, int(np.ceil(round(n * q / 100, 9))))
            by = np.lexsort((depth, last))
            high = last[by][np.searchsorted(np.cumsum(c[by]), rank)]
            by2 = np.argsort(first, kind="stable")
            low = first[by2][np.searchsorted(np.cumsum(c[by2]), rank)]
            out.append((q, n, bounds(np.array([low]))[0][0], bounds(np.array([high]))[1][0], bounds(np.array([high]))[0][0]))
        return pd.DataFrame(dict(zip(keys, ([x] * len(out) for x in key), strict=True)) | dict(zip(("q", "total", "low", "high", "estimate"), map(list, zip(*out, strict=True)), strict=True)))

    return digests.groupBy(*keys).applyInPandas(read, shape)


def exact(values: DataFrame, brackets: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """(keys, q, exact): the ceil(total*q/100)-th smallest value itself.

    Values below a bracket are only counted (partial sums before the shuffle); those inside, at most
    twice the rank error of the group, are counted by value, and running sums find the rank.
    """
    inside = F.broadcast(brackets) if brackets.count() * (len(keys) + 4) * 32 < 8 << 20 else brackets
    cell = F.col(value).cast("float").cast("double")
    joined = values.join(inside, keys).where(cell <= F.col("high"))
    counted = joined.groupBy(*keys, "q", "total", F.when(cell >= F.col("low"), F.col(value)).alias("v")).agg(F.count("*").alias("n"))
    # cumulative counts over the distinct values of a bracket; null, the values below, comes first
    from pyspark.sql import Window as W

    run = F.sum("n").over(W.partitionBy(*keys, "q").orderBy(F.col("v").asc_nulls_first()))
    ranked = counted.withColumn("upto", run).where((F.col("upto") >= F.greatest(F.lit(1), F.ceil(F.round(F.col("total") * F.col("q") / 100, 9)))) & F.col("v").isNotNull())
    return ranked.groupBy(*keys, "q").agg(F.min("v").alias("exact"))
