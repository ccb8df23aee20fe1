"""Rank statistics and playlist quality."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from crateflow.functions import columns as C
from crateflow.operators import blocks, shelf
from crateflow.session import durable


def spearman(rows: DataFrame, a: str, b: str) -> DataFrame:
    """(n, rho): rank correlation with average ranks; 0 where a side is constant, null below two rows."""
    ranked = blocks.ordered_ranks(blocks.ordered_ranks(durable(rows.select(a, b)), a, "ra"), b, "rb")
    rho = F.coalesce(F.try_divide(F.covar_pop("ra", "rb"), F.stddev_pop("ra") * F.stddev_pop("rb")), F.lit(0.0))
    return ranked.agg(F.count("*").alias("n"), F.when(F.count("*") >= 2, rho).alias("rho"))


def nearest(pairs: DataFrame, distance: str, k: int = 3) -> DataFrame:
    """(query_id, id, rank): the ``k`` nearest rows of each query, ties to the lower id."""
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(distance, "id"))
    return pairs.select("query_id", "id", distance).withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "id", "rank")


def nn_agreement(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """(n, exact_match, top3_overlap): how far two distances agree on nearest rows; overlap is always over 3.

    ``pairs`` may leave out rows that aren't among the nearest, or give them an infinite distance.
    """
    x, y = (nearest(pairs.where(F.col(c) < float("inf")), c) for c in (a, b))
    both = x.select("query_id", "id", F.col("rank").alias("ra")).join(y.select("query_id", "id", F.col("rank").alias("rb")), ["query_id", "id"])
    hits = both.groupBy("query_id").agg(F.count("*").alias("both"), F.max(((F.col("ra") == 1) & (F.col("rb") == 1)).cast("int")).alias("same"))
    all_ = x.select("query_id").distinct().join(hits, "query_id", "left")
    return all_.agg(F.count("*").alias("n"), F.avg(F.coalesce("same", F.lit(0)).cast("double")).alias("exact_match"), F.avg(F.coalesce("both", F.lit(0)) / 3.0).alias("top3_overlap"))


def distance_cuts(pairs: DataFrame, distance: str) -> tuple[float, float]:
    """The distances at a third and two thirds of the sorted list of pairs."""
    n = pairs.count()
    at = [min(max(int(q * n), 0), max(n - 1, 0)) for q in (0.33, 0.66)]
    low, high = blocks.at_positions(pairs, distance, at)
    return low, high


#: Bins of distances 0 to 2, and how far beyond a bin's ends the value at its place is looked for at first.
BINS, BESIDE = 1 << 18, 2e-6
#: Rows that meet the library together.
TOGETHER = 1024


def _distances(lib: shelf.Opened, units: np.ndarray, r: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Cosine distances of pairs, 12 decimals; 0 between two zero vectors."""
    d = np.round(1 - np.clip(lib.cosines(units, r, places), -1.0, 1.0), 12)
    d[~units.any(axis=1)[r] & (lib.inverse[places] == 0)] = 0.0
    return d


def _whole(lib: shelf.Opened, units: np.ndarray, first: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, cosines in single precision) of all rows with a vector from a place on; 1 between two zero vectors."""

    def spans() -> Iterator[tuple[int, int, slice | np.ndarray]]:
        for k in range(len(lib.starts) - 1):
            for at in range(max(int(lib.starts[k]), first), int(lib.starts[k + 1]), shelf.WIDE):
                known = lib.known[at : min(at + shelf.WIDE, int(lib.starts[k + 1]))]
                if known.any():
                    yield k, at - int(lib.starts[k]), slice(0, len(known)) if known.all() else np.flatnonzero(known)

    zero = np.flatnonzero(~units.any(axis=1))
    for places, s in lib.products(units, spans()):
        if len(zero):
            s[np.ix_(zero, lib.inverse[places] == 0)] = 1
        yield places, s


def _all_pairs(shelved: shelf.Shelf, spark: SparkSession, start: Callable[[], object], add: Callable[[object, shelf.Opened, np.ndarray, int, np.ndarray, np.ndarray], None], end: Callable[[object], pa.Table], schema: str) -> DataFrame:
    """A state of each task, over all unordered pairs of rows; ``add`` has units, their first place, places and cosines, NaN where a pair isn't its block's."""
    rows, tasks = sum(n for _, n in shelved.files), 2 * max(spark.sparkContext.defaultParallelism, 1)
    size = max(16, min(TOGETHER, -(-rows // (4 * tasks))))
    parts = -(-rows // size)
    # the first block meets all others, the last none: two and two are as much work as any
    items = -(-parts // 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lib, state = shelved.open(), start()
        for b in batches:
            for item in b.column(0).to_pylist():
                for part in {item, parts - 1 - item}:
                    first = part * size
                    own = np.arange(first, min(first + size, rows))
                    units = lib.units(own)
                    for places, s in _whole(lib, units, first):
                        if places[0] <= own[-1]:
                            s[places[None, :] <= own[:, None]] = np.nan
                        s[~lib.known[own]] = np.nan
                        add(state, lib, units, first, places, s)
        yield from end(state).to_batches(max_chunksize=100_000)

    return spark.range(0, items, 1, min(tasks, max(items, 1))).mapInArrow(run, schema)


def all_pair_cuts(library: DataFrame) -> tuple[float, float]:
    """``distance_cuts`` over all n(n-1)/2 pairs of the library's vectors (``raw`` or ``unit``), exact, no pair outside a task.

    Single precision counts pairs by bin. The second pass counts what lies below a cut's bin and sends the
    values in it, in double wherever single precision can't tell; the counts say whether the place is in it.
    """
    shelved = _shelved(library)
    try:
        return _cuts(shelved, library.sparkSession)
    finally:
        shelved.drop()


def _shelved(library: DataFrame) -> shelf.Shelf:
    vector = "raw" if "raw" in library.columns else "unit"
    return shelf.shelve(library.where(F.col(vector).isNotNull()).select("id", F.col(vector).alias("x")), "x")


def _cuts(shelved: shelf.Shelf, spark: SparkSession) -> tuple[float, float]:
    if not shelved.files:
        return float("nan"), float("nan")

    def count(state: np.ndarray, lib: shelf.Opened, units: np.ndarray, first: int, places: np.ndarray, s: np.ndarray) -> None:
        s = s[~np.isnan(s)] if np.isnan(s[:, 0]).any() or np.isnan(s[:, -1]).any() else s.ravel()
        s = np.clip((1 - s) * np.float32(BINS / 2), 0, BINS - 1).astype(np.int32)
        state += np.bincount(s, minlength=BINS)

    def counts(state: np.ndarray) -> pa.Table:
        b = np.flatnonzero(state)
        return pa.table({"b": b, "n": state[b]})

    binned = _all_pairs(shelved, spark, lambda: np.zeros(BINS, np.int64), count, counts, "b bigint, n bigint").groupBy("b").agg(F.sum("n").alias("n")).toArrow()
    per = np.zeros(BINS, np.int64)
    per[binned.column("b").to_numpy()] = binned.column("n").to_numpy()
    n, upto = int(per.sum()), np.cumsum(per)
    if not n:
        return float("nan"), float("nan")
    at = [min(int(q * n), n - 1) for q in (0.33, 0.66)]
    own = [int(np.searchsorted(upto, k, side="right")) for k in at]
    out: list[float | None] = [None, None]
    beside = BESIDE
    while None in out:
        ends = {k: (own[k] * 2 / BINS - beside, (own[k] + 1) * 2 / BINS + beside) for k, v in enumerate(out) if v is None}
        ranked = _between(shelved, spark, ends).withColumn("upto", F.sum("n").over(W.partitionBy("k").orderBy("v")))
        hit = F.greatest(*[F.when(F.col("k") == k, F.lit(at[k])) for k in ends], F.lit(-1))
        for r in ranked.where((F.col("upto") > hit) & (F.col("upto") - F.col("n") <= hit)).collect():
            # a value of -1 stands for what lies below
            if r.v >= 0:
                out[r.k] = r.v
        beside *= 64
    return out[0], out[1]


def _between(shelved: shelf.Shelf, spark: SparkSession, ends: dict[int, tuple[float, float]]) -> DataFrame:
    """(k, v, n): the distances of pairs between the k-th ends, how often they stand there, and at -1 how many lie below."""

    def look(state: dict, lib: shelf.Opened, units: np.ndarray, first: int, places: np.ndarray, s: np.ndarray) -> None:
        for k, (low, high) in ends.items():
            # cosines go the other way
            below = s > np.float32(1 - low + lib.error)
            state[k][0] += int(np.count_nonzero(below))
            flat = np.flatnonzero((s >= np.float32(1 - high - lib.error)) & ~below)
            r, c = np.divmod(flat, s.shape[1])
            v = _distances(lib, units, r, places[c])
            state[k][0] += int(np.count_nonzero(v < low))
            state[k][1].append(v[(v >= low) & (v <= high)])
            if len(state[k][1]) > 1024:
                state[k][1] = [np.concatenate(state[k][1])]

    def seen(state: dict) -> pa.Table:
        parts = []
        for k, (below, found) in state.items():
            v, m = np.unique(np.concatenate([np.zeros(0), *found]), return_counts=True)
            parts.append((np.full(len(v) + 1, k, np.int32), np.append(v, -1.0), np.append(m, below)))
        return pa.table(dict(zip(("k", "v", "n"), (np.concatenate(x) for x in zip(*parts, strict=True)), strict=True)))

    return durable(_all_pairs(shelved, spark, lambda: {k: [0, []] for k in ends}, look, seen, "k int, v double, n bigint").groupBy("k", "v").agg(F.sum("n").alias("n")))


def band_means(entries: DataFrame, *by: str) -> DataFrame:
    """(by, band, mean_distance, n): a missing band is ``?``, a missing distance 0."""
    return entries.groupBy(*by, F.coalesce("band", F.lit("?")).alias("band")).agg(F.avg(F.coalesce("distance", F.lit(0.0))).alias("mean_distance"), F.count("*").alias("n"))


def anchor_flags(entries: DataFrame, library: DataFrame, seeds: DataFrame, most: int = 2, share: float = 0.10) -> DataFrame:
    """(walk_id, position, key_ok, tempo_ok, mood_ok) of each transition; entries and seeds name tracks by ``id``."""
    steps = entries.select("walk_id", "position", "id").unionByName(seeds.select("walk_id", F.lit(0).alias("position"), "id"))
    known = steps.join(library.select("id", "slot", "bpm"), "id")
    w = W.partitionBy("walk_id").orderBy("position")
    s, b = F.lag("slot").over(w), F.lag("bpm").over(w)
    ok = F.when((b > 0) & (F.col("bpm") > 0), C.tempo_ok(b, F.col("bpm"), share)).otherwise(True)
    flags = known.select("walk_id", "position", (C.key_verdict(C.key_steps(s, F.col("slot")), most) != "block").alias("key_ok"), ok.alias("tempo_ok"), F.lit(True).alias("mood_ok"))
    return flags.where("position > 0")


def adherence(flags: DataFrame, *by: str) -> DataFrame:
    """(by, mood, key, tempo, key_violations): share of transitions that hold; 1 where there are none."""

    def share(c: str) -> Column:
        return F.coalesce(F.avg(F.col(c).cast("double")), F.lit(1.0))

    grouped = flags.groupBy(*by) if by else flags.groupBy()
    return grouped.agg(share("mood_ok").alias("mood"), share("key_ok").alias("key"), share("tempo_ok").alias("tempo"), F.count_if(~F.col("key_ok")).alias("key_violations"))


def overlap(first: DataFrame, second: DataFrame, library: DataFrame, seed: int) -> DataFrame:
    """(a, b): for each track that both of two walks chose, its plain feature distance to the track before it in the first, and its distance in the second."""
    steps = first.select("position", "id").unionByName(library.sparkSession.createDataFrame([(0, seed)], "position int, id bigint"))
    known = steps.join(library.select("id", "vector"), "id").withColumn("before", F.lag("vector").over(W.orderBy("position")))
    return known.where("position > 0").join(second.select("id", F.col("distance").alias("b")), "id").select(C.rms_distance(F.col("before"), F.col("vector")).alias("a"), "b")


def _compared(lib: shelf.Opened, units: np.ndarray, closed: tuple[np.ndarray, np.ndarray], band: str, low: float, high: float) -> tuple[np.ndarray, np.ndarray]:
    """(place, distance) of each row's nearest open row (Near), nearest beyond the lower cut (Mid) or farthest (Far); -1 where it isn't in the band."""
    n, r0, p0 = len(units), *closed
    error, sign = 2 * lib.error, np.float32(-1 if band == "Far" else 1)
    top = np.full(n, -np.inf, np.float32)
    # rows nearer than the lower cut for certain, and beyond it for certain
    inside, beyond = (np.float32(1 - low + e) for e in (error, -error)) if band == "Mid" else (np.float32(np.inf), np.float32(np.inf))
    found: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32))]
    for places, s in _whole(lib, units):
        s *= sign
        c = np.minimum(np.searchsorted(places, p0), len(places) - 1)
        hit = places[c] == p0
        s[r0[hit], c[hit]] = -np.inf
        if band == "Mid":
            s[s > inside] = -np.inf
            np.maximum(top, np.where(s <= beyond, s, -np.inf).max(axis=1), out=top)
        else:
            np.maximum(top, s.max(axis=1), out=top)
        flat = np.flatnonzero((s >= (top - error)[:, None]) & (s > -np.inf))
        r, c = np.divmod(flat, s.shape[1])
        found.append((r, places[c], s.ravel()[flat]))
    r, p, s = (np.concatenate(x) for x in zip(*found, strict=True))
    kept = s >= top[r] - error
    r, p = r[kept], p[kept]
    d = _distances(lib, units, r, p)
    fits = (d > low) & (d <= high) if band == "Mid" else d > high if band == "Far" else np.ones(len(d), bool)
    r, p, d = r[fits], p[fits], d[fits]
    order = np.lexsort((lib.plain["id"][p], -d if band == "Far" else d, r))
    r, p, d = r[order], p[order], d[order]
    first = np.flatnonzero(np.r_[True, r[1:] != r[:-1]]) if len(r) else r
    place, far = np.full(n, -1, np.int64), np.full(n, np.nan)
    place[r[first]], far[r[first]] = p[first], d[first]
    return place, far


def compare_walk(library: DataFrame, seeds: DataFrame, limit: int = 9, schedule: tuple[str, ...] = ("Near", "Mid", "Far", "Mid", "Near")) -> DataFrame:
    """(walk_id, position, id, band, distance): walks over all rows of the library that have a vector (``raw`` or ``unit``); ``seeds``: (walk_id, id).

    The cuts are those of all pairs of the library. Near takes the nearest up to the lower cut, Mid the
    nearest between the cuts, Far the farthest beyond the upper cut; else the nearest; an unknown band
    name ends the walk. A walk is one task's work from its seed to its end.
    """
    shelved, spark = _shelved(library), library.sparkSession
    schema = "walk_id bigint, position int, id bigint, band string, d double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if not parts or not shelved.files:
            return
        lib = shelved.open()
        t = pa.Table.from_batches(parts)
        walks, starts = (t.column(c).to_numpy() for c in ("walk_id", "id"))
        for a in range(0, len(walks), TOGETHER // 4):
            seed = starts[a : a + TOGETHER // 4]
            r, at = lib.places(seed[:, None])
            r, at = r[lib.known[at]], at[lib.known[at]]
            walk, visited = walks[a : a + TOGETHER // 4][r], seed[r][:, None]
            for step in range(limit):
                band = schedule[step % len(schedule)]
                if band not in ("Near", "Mid", "Far") or not len(at):
                    break
                units, closed = lib.units(at), lib.places(visited)
                place, d = _compared(lib, units, closed, band, low, high)
                miss = np.flatnonzero(place < 0)
                if len(miss):
                    new = np.full(len(at), -1)
                    new[miss] = np.arange(len(miss))
                    mine = new[closed[0]] >= 0
                    place[miss], d[miss] = _compared(lib, units[miss], (new[closed[0][mine]], closed[1][mine]), "Near", low, high)
                go = np.flatnonzero(place >= 0)
                ids = lib.plain["id"][place[go]]
                walk, at, visited = walk[go], place[go], np.hstack([visited[go], ids[:, None]])
                yield pa.record_batch([pa.array(walk), pa.array(np.full(len(go), step + 1, np.int32)), pa.array(ids), pa.array([band] * len(go), pa.string()), pa.array(d[go])], names=["walk_id", "position", "id", "band", "d"])

    try:
        low, high = _cuts(shelved, spark)
        found = durable(seeds.select("walk_id", "id").repartition(max(spark.sparkContext.defaultParallelism, 1)).mapInArrow(run, schema))
    finally:
        shelved.drop()
    return found.select("walk_id", "position", "id", "band", F.round("d", 4).alias("distance"))
