"""Filling fixed-capacity containers with items, window by window in target proportions.

Deficit round-robin over source queues: in every window of containers each source gets a quantum, its
share of the window's tokens, and sends items while they fit its deficit, which is carried on. An item
is thus sent in the first window by whose end its source's quanta reach the item's end in its queue, so
the window follows from a running sum of tokens; running sums over hash buckets carry the deficits
across windows and partitions without a sequential pass. Where a source runs out, the quanta of the
others grow in proportion. A window's items are packed best fit, largest first.

An item is split only if it exceeds the capacity: into full containers and a rest that is packed.

Defined cases: items without tokens need no container. Sources without a target come when those with
one have run out, in equal shares. Repeated rows are items of their own. Ties in size go to the lower id.
Texts of any length are packed whole. Empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from crateflow.session import durable

#: Containers per window: a bounded group for one task, wide enough to leave little space.
WINDOW = 512
#: Items per hash bucket of a source's queue, about.
BUCKET = 4000


def phases(totals: dict[str, int], shares: dict[str, float], window: int) -> dict[str, list[tuple[float, float, float]]]:
    """Per source: (tokens sent before, first window, quantum) of each phase, until it runs out."""
    left, at, sent = {s: float(n) for s, n in totals.items() if n > 0}, 0.0, {s: 0.0 for s in totals}
    out: dict[str, list[tuple[float, float, float]]] = {s: [] for s in left}
    while left:
        weight = {s: shares.get(s, 0.0) for s in left}
        if sum(weight.values()) <= 0:
            weight = dict.fromkeys(left, 1.0)
        quantum = {s: window * w / sum(weight.values()) for s, w in weight.items() if w > 0}
        length = min(left[s] / q for s, q in quantum.items())
        for s, q in quantum.items():
            out[s].append((sent[s], at, q))
            sent[s] += q * length
            left[s] -= q * length
        at += length
        left = {s: n for s, n in left.items() if n > 1e-6 * totals[s]}
    return out


def best_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Container of each item, largest item first, into the fullest container that holds it."""
    out = np.zeros(len(sizes), np.int64)
    space: list[tuple[int, int]] = []
    n = 0
    for i in np.argsort(-sizes, kind="stable"):
        size = int(sizes[i])
        at = bisect_left(space, (size, -1))
        if at < len(space):
            room, box = space.pop(at)
        else:
            room, box, n = capacity, n, n + 1
        out[i] = box
        if room > size:
            insort(space, (room - size, box))
    return out


def _queued(sized: DataFrame) -> DataFrame:
    """Items with the tokens of their source up to their end, in the order of the hash."""
    items = sized.where("tokens > 0")
    buckets = max(1, ceil(items.count() / BUCKET))
    items = items.withColumn("b", F.floor((F.shiftrightunsigned("h", 33) / F.lit(float(1 << 31))) * buckets))
    base = items.groupBy("source", "b").agg(F.sum("tokens").alias("n"))
    before = base.withColumn("before", F.sum("n").over(W.partitionBy("source").orderBy("b")) - F.col("n")).select("source", "b", "before")
    own = F.sum("tokens").over(W.partitionBy("source", "b").orderBy(F.shiftrightunsigned("h", 1), "h", "id").rowsBetween(W.unboundedPreceding, W.currentRow))
    return items.withColumn("own", own).join(before, ["source", "b"]).select("id", "source", "tokens", (F.col("before") + F.col("own")).alias("end"))


def _filler(c: int, name: str):
    """Packs the items of one window into containers of ``c`` tokens."""

    def fill(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["tokens", "id"], ascending=[False, True], kind="stable")
        n = pdf["tokens"].to_numpy(np.int64)
        full, rest = n // c, n % c
        boxes = np.full(len(n), -1)
        small = rest > 0
        boxes[small] = best_fit(rest[small], c)
        rows: list[tuple] = []
        own = int(boxes.max(initial=-1)) + 1
        for i, (item, source) in enumerate(zip(pdf["id"], pdf["source"], strict=True)):
            for k in range(full[i]):
                rows.append((name, f"{key[0]}-{own}", item, source, k, k * c, c))
                own += 1
            if rest[i]:
                rows.append((name, f"{key[0]}-{boxes[i]}", item, source, int(full[i]), int(full[i]) * c, int(rest[i])))
        return pd.DataFrame(rows, columns=["pack_name", "container", "id", "source", "piece", "start", "tokens"])

    return fill


def packed(sized: DataFrame, targets: DataFrame, limits: DataFrame, window: int = WINDOW) -> DataFrame:
    """(pack_name, container, id, source, piece, start, tokens): where each piece of each item stands.

    ``sized``: (id, source, h, tokens); ``limits``: (pack_name, capacity_tokens), one row per pack.
    """
    shares = {r.source: r.target_share for r in targets.select("source", "target_share").distinct().collect() if r.source is not None}
    queue = durable(_queued(sized))
    totals = {r.source: r.n for r in queue.groupBy("source").agg(F.sum("tokens").alias("n")).collect()}
    packs = [r for r in limits.select("pack_name", "capacity_tokens").distinct().collect() if r.pack_name is not None and (r.capacity_tokens or 0) > 0]
    shape = "pack_name string, container string, id bigint, source string, piece int, start bigint, tokens bigint"
    out = None
    for pack in packs:
        c = int(pack.capacity_tokens)
        when = F.lit(0.0)
        for s, steps in phases(totals, shares, c * window).items():
            place = F.lit(0.0)
            for sent, first, q in steps:
                place = F.when(F.col("end") > sent, F.lit(first) + (F.col("end") - F.lit(sent)) / F.lit(q)).otherwise(place)
            when = F.when(F.col("source") == s, place).otherwise(when)
        placed = queue.withColumn("window", F.greatest(F.ceil(when - 1e-9) - 1, F.lit(0)).cast("bigint"))

        one = placed.select("window", "id", "source", "tokens").groupBy("window").applyInPandas(_filler(c, pack.pack_name), shape)
        out = one if out is None else out.unionByName(one)
    return out if out is not None else sized.sparkSession.createDataFrame([], shape)


def report(pieces: DataFrame, limits: DataFrame) -> DataFrame:
    """(pack_name, capacity_tokens, containers, used_tokens, fill): how full the containers are."""
    per = pieces.groupBy("pack_name", "container").agg(F.sum("tokens").alias("t")).groupBy("pack_name").agg(F.count("*").alias("containers"), F.sum("t").alias("used_tokens"))
    return per.join(limits.select("pack_name", "capacity_tokens").distinct(), "pack_name").select("pack_name", "capacity_tokens", "containers", "used_tokens", (F.col("used_tokens") / (F.col("containers") * F.col("capacity_tokens"))).alias("fill"))
