"""Ranking by cosine, quantile bands, and distances of a stated query set against all rows."""

from __future__ import annotations

import io
import math
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from crateflow.functions import columns as C
from crateflow.operators import blocks, shelf
from crateflow.session import durable


def _top_kernel(k: int):
    def kernel(q: pa.Table, x: pa.Table) -> pa.Table:
        a, b = blocks.rows_of(q.column("unit")), blocks.rows_of(x.column("unit"))
        qi, xi = q.column("id").to_numpy(), x.column("id").to_numpy()
        sim = np.round(a @ b.T, 12)
        sim[qi[:, None] == xi[None, :]] = -np.inf
        top = np.argsort(-sim, axis=1, kind="stable")[:, :k]
        s = np.take_along_axis(sim, top, axis=1)
        r, c = np.nonzero(np.isfinite(s))
        return pa.table({"query_id": qi[r], "id": xi[top[r, c]], "sim": s[r, c]})

    return kernel


def top_k(queries: DataFrame, library: DataFrame, k: int) -> DataFrame:
    """(query_id, id, sim, rank): exact ``k`` most similar rows of each query; both sides (id, unit).

    Ties go to the lower id. Each pair of blocks sends ``k`` rows a query, ranked again.
    """
    near = blocks.cross(queries.select("id", "unit").where("unit is not null"), library.select("id", "unit").where("unit is not null"), _top_kernel(k), "query_id bigint, id bigint, sim double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("sim").desc(), "id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k)


#: Cosines that a task holds at once, and queries that it takes at most at a time.
HELD, BANDED = 1 << 26, 128
#: Bits of a digit of an id: the sum of as many as a product has columns is exact in single precision.
DIGIT = 12


def band_report(library: DataFrame, every: int = 20, near: float = 0.10, mid: float = 0.40) -> DataFrame:
    """(query_id, band, n, first_rank, id_sum, most, least): the quantile bands of each stated query's ranking of all other rows.

    ``library``: (id, raw); the queries are its ids divisible by ``every``. A task holds all cosines of some
    queries in single precision; rows near the end of a band or of the ranking, which it can't tell apart, are
    ranked in double. Nothing but bands leaves a task.
    """
    spark, shelved = library.sparkSession, shelf.shelve(library.where("raw is not null").select("id", F.col("raw").alias("x")), "x")
    tasks = 4 * max(spark.sparkContext.defaultParallelism, 1)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = [n for b in batches for n in b.column(0).to_pylist()]
        if not numbers or not shelved.files:
            return
        lib = shelved.open()
        asked = np.flatnonzero(lib.known & (lib.plain["id"] % every == 0))
        mine, digits = np.concatenate([asked[n::tasks] for n in numbers]), _digits(lib.plain["id"])
        together = max(1, min(BANDED, len(mine), HELD // len(lib.known)))
        held = np.empty((together, len(lib.known)), np.float32)
        for at in range(0, len(mine), together):
            own = mine[at : at + together]
            yield from _bands(lib, own, held[: len(own)], digits, near, mid).to_batches(max_chunksize=100_000)

    try:
        return durable(spark.range(0, tasks, 1, tasks).mapInArrow(work, "query_id bigint, band string, n bigint, first_rank bigint, id_sum bigint, most double, least double"))
    finally:
        shelved.drop()


def _digits(ids: np.ndarray) -> np.ndarray:
    """A column of ones, then the digits of what each id is above the least."""
    above = ids.astype(np.uint64) - np.uint64(int(ids.min()) % 2**64)
    count = -(-int(above.max()).bit_length() // DIGIT)
    return np.column_stack([np.ones(len(ids)), *((above >> np.uint64(DIGIT * k)) & np.uint64(2**DIGIT - 1) for k in range(count))]).astype(np.float32)


def _bands(lib: shelf.Opened, own: np.ndarray, s: np.ndarray, digits: np.ndarray, near: float, mid: float) -> pa.Table:
    """The bands of the queries at these places; ``s`` is room for their cosines with all rows."""
    units, ids = lib.units(own), lib.plain["id"]
    spans = [(k, at, min(shelf.WIDE, int(lib.starts[k + 1] - lib.starts[k]) - at)) for k in range(len(lib.starts) - 1) for at in range(0, int(lib.starts[k + 1] - lib.starts[k]), shelf.WIDE)]
    for places, d in lib.products(units, ((k, at, slice(0, n)) for k, at, n in spans)):
        s[:, places[0] : places[-1] + 1] = d
    r0, p0 = lib.places(ids[own][:, None])
    unknown = np.flatnonzero(~lib.known)
    s[:, unknown] = s[r0, p0] = np.inf
    lowest = s.min(axis=1)
    s[:, unknown] = s[r0, p0] = -np.inf
    out = r0[lib.known[p0]]
    total = np.count_nonzero(lib.known) - np.bincount(out, minlength=len(own))
    all_ids = [int(ids[lib.known].sum())] * len(own)
    for r, p in zip(r0.tolist(), p0.tolist(), strict=True):
        all_ids[r] -= int(ids[p]) if lib.known[p] else 0
    # what cosines are off, compared with 12 decimals
    off = np.float32(2.02 * lib.error + 1e-10)
    ends = np.array([[min(n, math.ceil(n * share)) for n in total.tolist()] for share in (near, mid)], np.int64)
    ends[1] = np.maximum(*ends)
    low, high = (np.full((2, len(own)), np.inf, np.float32) for _ in range(2))
    top = np.full(len(own), np.inf, np.float32)
    for i in np.flatnonzero(total):
        e1, e2 = ends[:, i].tolist()
        part = np.partition(s[i], s.shape[1] - e2)
        upper, beyond = part[s.shape[1] - e2 :], part[: s.shape[1] - e2].max(initial=-np.inf)
        inner = np.partition(upper, e2 - e1)
        for k, last, first in ((0, inner[e2 - e1], inner[: e2 - e1].max() if e2 > e1 else beyond), (1, upper[0], beyond)):
            high[k, i], low[k, i] = last + off, (first if first > -np.inf else last) - off
        top[i] = inner[e2 - e1 :].max() - off
    lowest += off
    sums = np.zeros((2, len(own), digits.shape[1]))
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32), np.zeros(0))]
    for k, at, n in spans:
        lo = int(lib.starts[k]) + at
        v, weights = s[:, lo : lo + n], digits[lo : lo + n]
        hit = v >= top[:, None]
        hit |= (v <= lowest[:, None]) & (v > -np.inf)
        for b in range(2):
            above = v > high[b][:, None]
            sums[b] += above.astype(np.float32) @ weights
            hit |= above ^ (v >= low[b][:, None])
        r, c = np.nonzero(hit)
        x = lib.stored(k)[at : at + n]
        for e in range(0, len(r), shelf.EXACT):
            q, p = r[e : e + shelf.EXACT], c[e : e + shelf.EXACT]
            exact = np.einsum("ij,ij->i", units[q], x[p].astype(np.float64)) * lib.inverse[lo + p]
            found.append((q, lo + p, v[q, p], np.round(exact, 12)))
    r, p, rough, sim = (np.concatenate(y) for y in zip(*found, strict=True))
    order = np.lexsort((ids[p], -sim, r))
    r, p, rough, sim = r[order], p[order], rough[order], sim[order]
    bounds = np.searchsorted(r, np.arange(len(own) + 1))
    base, rows = int(ids.min()), []
    for i in np.flatnonzero(total).tolist():
        mine = slice(bounds[i], bounds[i + 1])
        w, v, x = rough[mine], sim[mine], ids[p[mine]]
        last, upto, edge = [], [], []
        for b in range(2):
            inside = np.flatnonzero((w >= low[b, i]) & (w <= high[b, i]))
            weight = [int(y) for y in sums[b, i]]
            need = int(ends[b, i]) - weight[0]
            upto.append(base * weight[0] + sum(y << (DIGIT * d) for d, y in enumerate(weight[1:])) + int(x[inside[:need]].sum()))
            last.append(v[inside[need - 1]])
            edge.append(v[inside[need]] if need < len(inside) else np.nan)
        e = [0, *ends[:, i].tolist(), int(total[i])]
        sofar, most, least = [0, *upto, all_ids[i]], [v[0], *edge], [*last, v[-1]]
        for b, band in enumerate(("Near", "Mid", "Far")):
            if e[b + 1] > e[b]:
                rows.append((int(ids[own[i]]), band, e[b + 1] - e[b], e[b] + 1, sofar[b + 1] - sofar[b], most[b], least[b]))
    names = ("query_id", "band", "n", "first_rank", "id_sum", "most", "least")
    types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
    return pa.table({c: pa.array([row[k] for row in rows], t) for k, (c, t) in enumerate(zip(names, types, strict=True))})


def column_stats(vectors: DataFrame, column: str) -> tuple[np.ndarray, np.ndarray]:
    """Mean and population deviation (1 where 0) of each position; partial sums per partition, merged."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, mean, m2 = 0, None, None
        for b in batches:
            m = blocks.rows_of(b.column(0))
            if not len(m):
                continue
            k, mu = len(m), m.mean(axis=0)
            sq = ((m - mu) ** 2).sum(axis=0)
            if mean is None:
                n, mean, m2 = k, mu, sq
            else:
                d = mu - mean
                m2 += sq + d * d * n * k / (n + k)
                mean += d * k / (n + k)
                n += k
        if mean is not None:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([mean.tolist()]), pa.array([m2.tolist()])], names=["n", "mean", "m2"])

    return merged((r.n, np.array(r.mean), np.array(r.m2)) for r in vectors.select(column).where(F.col(column).isNotNull()).mapInArrow(local, "n bigint, mean array<double>, m2 array<double>").toLocalIterator())


def merged(parts: Iterable[tuple[int, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation (1 where 0) from the counts, means and squared deviations of parts."""
    n, mean, m2 = 0, np.zeros(0), np.zeros(0)
    for k, mu, sq in parts:
        if not n:
            n, mean, m2 = k, mu, sq
        else:
            d = mu - mean
            m2 = m2 + sq + d * d * n * k / (n + k)
            mean = mean + d * k / (n + k)
            n += k
    sigma = np.sqrt(m2 / max(n, 1))
    return mean, np.where(sigma > 1e-12, sigma, 1.0)


#: Queries that a task standardises together, those and rows of the library whose distances it holds at once.
PART_ROWS, TOGETHER, COLUMNS = 1024, 128, 1024
#: Distances are whole numbers of this many to one: equal to 12 decimals is equal.
GRID = 1e12
#: Cells of distances, so many to one; least and most bins that they are divided into as the pairs crowd, one for about four pairs; bins that are sent together.
CELLS, CELL, FEWEST, RANK_BINS, SENT = 1 << 16, 4096, 1 << 18, 1 << 24, 1 << 16
#: Queries whose distances say how cells are divided: any division gives the same result, at more or less work.
LAID_OUT = 256
#: Pairs of shared bins that are ranked in memory; more are ranked by a shuffle, to the same ranks.
RANKED = 4_000_000


#: Queries and rows of the library that meet at once in single precision.
ASKED, MET = 2048, 1024


class _Side:
    """Standardised rows in double and in single precision, with their squared and plain lengths."""

    def __init__(self, rows: np.ndarray, mu: np.ndarray, sigma: np.ndarray, second: bool = False):
        self.mu, self.sigma, self.second = mu, sigma, second
        self.z = (rows - mu) / sigma
        self.single = self.z.astype(np.float32)
        self.square = np.einsum("ij,ij->i", self.z, self.z)
        self.length = np.sqrt(self.square)

    def exact(self, lib: shelf.Opened, r: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Root-mean-square distances of these rows to those at places of the library, 12 decimals."""
        out = np.empty(len(r))
        for at in range(0, len(r), shelf.EXACT):
            part = slice(at, at + shelf.EXACT)
            d = self.z[r[part]] - (lib.rows(places[part], self.second) - self.mu) / self.sigma
            out[part] = np.einsum("ij,ij->i", d, d)
        return np.round(np.sqrt(out / self.z.shape[1]), 12)


class Pairs:
    """Stated queries (ids divisible by 20) against all other rows of a library in files: ``rows`` has (id, vector, raw).

    The distances are root-mean-square ones, of standardised embeddings (``d_clap``) and of standardised
    feature vectors (``d_essentia``), in double. A task takes a share of the queries over the whole library.
    """

    def __init__(self, rows: DataFrame, every: int = 20):
        self.spark, self.every = rows.sparkSession, every
        self.shelf = shelf.shelve(rows.select("id", "vector", "raw"), "raw", _spread, even=False)
        try:
            self.clap, self.essentia = self._stats()
        except BaseException:
            self.shelf.drop()
            raise

    def _stats(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """Mean and deviation (1 where 0) of embeddings and of feature vectors."""
        shelved, files = self.shelf, len(self.shelf.files)

        def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lib = shelved.open()
            for b in batches:
                for k in b.column(0).to_pylist():
                    known = lib.known[lib.starts[k] : lib.starts[k + 1]]
                    for what, m in enumerate((lib.stored(k), lib.features(k))):
                        m = m[known].astype(np.float64)
                        if len(m):
                            mu = m.mean(axis=0)
                            yield pa.RecordBatch.from_arrays([pa.array([what], pa.int32()), pa.array([len(m)]), pa.array([mu.tolist()]), pa.array([((m - mu) ** 2).sum(axis=0).tolist()])], names=["what", "n", "mean", "m2"])

        parts = self.spark.range(0, files, 1, max(1, min(files, self.spark.sparkContext.defaultParallelism))).mapInArrow(local, "what int, n bigint, mean array<double>, m2 array<double>").collect() if files else []
        out = []
        for what in range(2):
            self.known = sum(r.n for r in parts if r.what == what)
            mean, sigma = merged(sorted(((r.n, np.array(r.mean), np.array(r.m2)) for r in parts if r.what == what), key=lambda r: (r[0], *r[1])))
            out.append((mean, sigma))
        return out

    def run(self, start: Callable[[], object], add: Callable[..., pa.Table | None], end: Callable[[object], pa.Table | None], schema: str, some: int = 0) -> DataFrame:
        """What tasks say of their pairs; ``add`` has (state, d_clap, d_essentia, (row, column) of no pairs), distances in parts of ``GRID``.

        What ``add`` and ``end`` return is sent. ``some``: only about so many queries are asked.
        """
        tasks = 2 * max(self.spark.sparkContext.defaultParallelism, 1)
        both, files, every = (self.clap, self.essentia), self.shelf, self.every

        def standard(m: np.ndarray, k: int) -> np.ndarray:
            mu, sigma = both[k]
            return (m - mu) / sigma * (GRID / math.sqrt(max(1, m.shape[1])))

        def left(z: np.ndarray) -> np.ndarray:
            return np.hstack([-2 * z, np.einsum("ij,ij->i", z, z)[:, None], np.ones((len(z), 1))])

        def right(z: np.ndarray) -> np.ndarray:
            return np.hstack([z, np.ones((len(z), 1)), np.einsum("ij,ij->i", z, z)[:, None]])

        def distances(q: np.ndarray, x: np.ndarray) -> np.ndarray:
            sq = q @ x.T
            # close pairs lose digits in that form: they are taken directly
            r, c = np.divmod(np.flatnonzero(sq < 1e-6 * GRID**2), sq.shape[1])
            for at in range(0, len(r), 4096):
                i, j = r[at : at + 4096], c[at : at + 4096]
                sq[i, j] = ((q[i, :-2] / -2 - x[j, :-2]) ** 2).sum(axis=1)
            return np.rint(np.sqrt(sq, out=sq), out=sq)

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lib, state = files.open(), start()
            asked = np.flatnonzero(lib.known & (lib.plain["id"] % every == 0)) if files.files else np.zeros(0, np.int64)
            asked = asked[:: max(1, len(asked) // some)] if some else asked
            for b in batches:
                for item in b.column(0).to_pylist():
                    mine = asked[item::tasks]
                    for at in range(0, len(mine), PART_ROWS):
                        own = mine[at : at + PART_ROWS]
                        r0, p0 = lib.places(lib.plain["id"][own][:, None])
                        q = [left(standard(lib.rows(own, bool(k)), k)) for k in range(2)]
                        for k in range(len(lib.starts) - 1):
                            x, y = lib.stored(k), lib.features(k)
                            for lo in range(0, len(x), COLUMNS):
                                there = np.flatnonzero(lib.known[lib.starts[k] + lo : lib.starts[k] + min(lo + COLUMNS, len(x))]) + lo
                                if not len(there):
                                    continue
                                places = lib.starts[k] + there
                                c = np.minimum(np.searchsorted(places, p0), len(places) - 1)
                                hit = places[c] == p0
                                r, c = r0[hit], c[hit]
                                others = [right(standard(m[there], i)) for i, m in enumerate((x, y))]
                                for top in range(0, len(own), TOGETHER):
                                    in_ = slice(*np.searchsorted(r, [top, top + TOGETHER]))
                                    out = add(state, *(distances(q[i][top : top + TOGETHER], others[i]) for i in range(2)), (r[in_] - top, c[in_]))
                                    if out is not None:
                                        yield from out.to_batches(max_chunksize=100_000)
            out = end(state)
            if out is not None:
                yield from out.to_batches(max_chunksize=100_000)

        return self.spark.range(0, tasks, 1, tasks).mapInArrow(work, schema)

    def meet(self, begin: Callable[..., object], add: Callable[..., None], end: Callable[..., pa.Table], schema: str, ids: DataFrame | None = None) -> DataFrame:
        """What tasks say of many queries at a time; ``ids`` names the queries, else all stated ones are.

        ``begin`` has (library, queries' places, their two sides), ``add`` (state, library, stored rows, their
        two sides, places, (row, column) of no pairs), ``end`` (state, library).
        """
        tasks = 2 * max(self.spark.sparkContext.defaultParallelism, 1)
        both, files, every = (self.clap, self.essentia), self.shelf, self.every
        given = ids is not None

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            numbers = [n for b in batches for n in b.column(0).to_pylist()]
            if not numbers or not files.files:
                return
            lib = files.open()
            if given:
                mine = np.sort(lib.places(np.array(numbers, np.int64)[:, None])[1])
                mine = mine[lib.known[mine]]
            else:
                asked = np.flatnonzero(lib.known & (lib.plain["id"] % every == 0))
                mine = np.concatenate([asked[n::tasks] for n in numbers])
            for at in range(0, len(mine), ASKED):
                own = mine[at : at + ASKED]
                r0, p0 = lib.places(lib.plain["id"][own][:, None])
                state = begin(lib, own, [_Side(lib.rows(own, bool(k)), *both[k], bool(k)) for k in range(2)])
                for k in range(len(lib.starts) - 1):
                    x, y = lib.stored(k), lib.features(k)
                    for lo in range(0, len(x), MET):
                        there = np.flatnonzero(lib.known[lib.starts[k] + lo : lib.starts[k] + min(lo + MET, len(x))]) + lo
                        if not len(there):
                            continue
                        places = lib.starts[k] + there
                        c = np.minimum(np.searchsorted(places, p0), len(places) - 1)
                        hit = places[c] == p0
                        add(state, lib, x[there], [_Side(m[there], *both[i], bool(i)) for i, m in enumerate((x, y))], places, (r0[hit], c[hit]))
                yield from end(state, lib).to_batches(max_chunksize=100_000)

        rows = ids.repartition(tasks) if given else self.spark.range(0, tasks, 1, tasks)
        return rows.mapInArrow(work, schema)


def _spread(t: pa.Table) -> pa.Table:
    """``id`` and the feature vector's axes as columns."""
    m = blocks.rows_of(t.column("vector"))
    return pa.table({"id": t.column("id"), **{f"v:{k}": m[:, k] for k in range(m.shape[1])}})


def _cells(d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distances in cells, and their cells."""
    x = np.minimum(d * (CELL / GRID), CELLS - 1)
    return x, x.astype(np.int64)


def _layout(n: np.ndarray, bins: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(offset, bins) of each cell, as many of all ``bins`` as ``n`` has of all: the bin of x cells is offset + x * bins, whole."""
    width = 1.0 + np.floor(n * ((bins - CELLS) / max(1, int(n.sum()))))
    return np.cumsum(width) - width - np.arange(CELLS) * width, width, bins


def _rank_bins(d: np.ndarray, layout: tuple[np.ndarray, np.ndarray, int]) -> np.ndarray:
    x, cell = _cells(d)
    x *= layout[1][cell]
    x += layout[0][cell]
    return np.minimum(x, layout[2] - 1, out=x).astype(np.int64)


def _binned(n: np.ndarray) -> pa.Table:
    """Counts of bins as (part, counts), parts without any left out."""
    parts = [(k, n[k * SENT : (k + 1) * SENT]) for k in range(-(-len(n) // SENT))]
    rows = [(k, zlib.compress(p.astype(np.min_scalar_type(int(p.max()))).tobytes(), 1), np.min_scalar_type(int(p.max())).itemsize) for k, p in parts if p.any()]
    return pa.table({c: pa.array([r[k] for r in rows], t) for k, (c, t) in enumerate((("part", pa.int32()), ("counts", pa.binary()), ("size", pa.int32())))})


def _counts(packed: bytes, size: int) -> np.ndarray:
    return np.frombuffer(zlib.decompress(packed), f"u{size}").astype(np.int64)


def _merge(t: pa.Table) -> pa.Table:
    """Counts of the same bins by several tasks, added up."""
    total = sum(_counts(c, s) for c, s in zip(t.column("counts").to_pylist(), t.column("size").to_pylist(), strict=True))
    return pa.table({"k": t.column("k")[:1], "part": t.column("part")[:1], "counts": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary()), "n": pa.array([int(total.sum())])})


class _Ranks:
    """Mean ranks of bins in a file, from the middle and as shares of all pairs; how many pairs a bin holds, up to 255, in another."""

    def __init__(self, folder: str, parts: list[tuple[int, bytes]], bins: int, total: int):
        self.places = f"{folder}/ranks-{uuid.uuid4().hex}", f"{folder}/held-{uuid.uuid4().hex}"
        #: Sums of squares: of the bins' ranks, and at most, where no two pairs tie, of what ranks are off in their bins; pairs of shared bins.
        self.square, self.most, self.open = 0.0, 0.0, 0
        # pairs below a bin and those up to it
        self.type, self.total, self.sizes = np.min_scalar_type(max(1 << 16, 2 * total)), total, np.zeros(256)
        packed, below = dict(parts), 0
        with shelf.sink(self.places[0]) as ranks, shelf.sink(self.places[1]) as held:
            for k in range(bins // SENT):
                n = _counts(packed[k], 8) if k in packed else np.zeros(SENT, np.int64)
                twice = 2 * (below + np.cumsum(n)) - n
                ranks.write(twice.astype(self.type).tobytes())
                few = np.minimum(n, 255).astype(np.uint8)
                held.write(few.tobytes())
                self.sizes += np.bincount(few, minlength=256)
                m = n.astype(np.float64)
                self.square += float(m @ ((twice - total) / (2 * total)) ** 2)
                self.most += float((m * (m * m - 1)).sum()) / 12 / total**2
                self.open += int(n[n > 1].sum())
                below += int(n.sum())

    def rest(self, size: int) -> float:
        """``most`` of bins with up to so many pairs (254 at most)."""
        m = np.arange(size + 1, dtype=np.float64)
        return float(self.sizes[: size + 1] @ (m * (m * m - 1))) / 12 / self.total**2

    def twice(self) -> np.ndarray:
        return shelf.flat(self.places[0], self.type)

    def held(self) -> np.ndarray:
        return shelf.flat(self.places[1], np.uint8)

    def ranks(self, twice: np.ndarray) -> np.ndarray:
        r = np.subtract(twice, float(self.total), dtype=np.float64)
        r *= 0.5 / self.total
        return r


def _inside(bins: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Ranks, ties at their mean, among the rows of a row's bin, from their middle."""
    order = np.lexsort((values, bins))
    b, v = bins[order], values[order]
    new = np.append(True, b[1:] != b[:-1])
    tied = new | np.append(True, v[1:] != v[:-1])

    def middle(first: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(first)
        n = np.diff(np.append(at, len(first)))
        return np.repeat(at + (n - 1) / 2, n)

    out = np.empty(len(b))
    out[order] = middle(tied) - middle(new) if len(b) else 0.0
    return out


def _summed(pairs: Pairs) -> tuple[int, list, list[_Ranks], float]:
    """Number of pairs, layouts, ranks of the bins of both distances, and the sum of the ranks' products."""

    bins = min(RANK_BINS, max(FEWEST, 1 << (pairs.known * pairs.known // (4 * pairs.every)).bit_length()))

    def laid(state: list, a, b, none) -> None:
        for n, d in zip(state, (a, b), strict=True):
            n += np.bincount(_cells(d)[1].ravel(), minlength=CELLS)

    def cells(state: list) -> pa.Table:
        at = [np.flatnonzero(n) for n in state]
        return pa.table({"k": np.repeat(np.arange(2, dtype=np.int32), [len(x) for x in at]), "cell": np.concatenate(at), "n": np.concatenate([n[x] for n, x in zip(state, at, strict=True)])})

    def counted(state: dict) -> pa.Table:
        out = [_binned(n) for n in state["n"]]
        return pa.concat_tables([t.add_column(0, "k", pa.array(np.full(len(t), k, np.int32))) for k, t in enumerate(out)])

    def fresh() -> dict:
        return {"n": [np.zeros(bins, np.int32) for _ in range(2)], "met": 0}

    found = pairs.run(lambda: [np.zeros(CELLS, np.int64) for _ in range(2)], laid, cells, "k int, cell bigint, n bigint", LAID_OUT).groupBy("k", "cell").agg(F.sum("n").alias("n")).toArrow()
    k, cell, n = (found.column(c).to_numpy() for c in ("k", "cell", "n"))
    layouts = []
    for side in range(2):
        per = np.zeros(CELLS, np.int64)
        per[cell[k == side]] = n[k == side]
        layouts.append(_layout(per, bins))

    def count(state: dict, a, b, none) -> pa.Table | None:
        out = None
        if state["met"] + a.size >= 1 << 31:
            out = counted(state)
            state.update(fresh())
        state["met"] += a.size
        for n, d, layout in zip(state["n"], (a, b), layouts, strict=True):
            at = _rank_bins(d, layout)
            np.add.at(n, at.ravel(), np.int32(1))
            np.subtract.at(n, at[none], np.int32(1))
        return out

    by_task = pairs.run(fresh, count, counted, "k int, part int, counts binary, size int")
    binned = by_task.groupBy("k", "part").applyInArrow(_merge, "k int, part int, counts binary, n bigint").toArrow().to_pylist()
    total = sum(r["n"] for r in binned if r["k"] == 0)
    if total < 2:
        return total, layouts, [], 0.0
    sides = [_Ranks(pairs.shelf.folder, [(r["part"], r["counts"]) for r in binned if r["k"] == side], bins, total) for side in range(2)]
    del binned

    def add(state: dict, a, b, none) -> None:
        if not state:
            state.update(s=0.0, twice=[x.twice() for x in sides])
        ra, rb = (x.ranks(twice[_rank_bins(d, layout)]) for x, twice, d, layout in zip(sides, state["twice"], (a, b), layouts, strict=True))
        ra[none] = 0
        state["s"] += float(np.dot(ra.ravel(), rb.ravel()))

    product = pairs.run(dict, add, lambda state: pa.table({"s": [state.get("s", 0.0)]}), "s double").agg(F.sum("s")).first()[0]
    return total, layouts, sides, product


def pair_correlation(pairs: Pairs, digits: int = 6) -> DataFrame:
    """(n, rho): rank correlation of the two distances over all pairs, right to ``digits`` decimals at any number of them.

    Pairs are counted in bins, and the products of their bins' mean ranks added up. How the pairs of a bin are ordered
    can change the correlation by no more than a bound (Cauchy-Schwarz, from the counts). Where that leaves open how it is rounded,
    pairs of a bin are ranked one by one, by their distances: those of the fullest bins, and if that doesn't decide it, all that share
    a bin. 0 where a side is constant, null below two pairs.
    """
    spark, place = pairs.spark, 10**digits

    def decided(product: float, squares: list[float], off: float, most: list[float]) -> bool:
        if not off:
            return True
        if not squares[0] * squares[1]:
            return False
        ends = [(product + e) / math.sqrt((squares[0] + m * most[0]) * (squares[1] + m * most[1])) for e in (-off, off) for m in (0, 1)]
        return math.floor((min(ends) - SLACK) * place + 0.5) == math.floor((max(ends) + SLACK) * place + 0.5)

    try:
        total, layouts, sides, product = _summed(pairs)
        if total < 2:
            return spark.createDataFrame([(total, None)], "n bigint, rho double")
        a, b = sides
        squares, most = [a.square, b.square], [a.most, b.most]

        def off(rest: list[float]) -> float:
            cut = 2.0**-16 * math.sqrt(total) * (math.sqrt(most[0]) + math.sqrt(most[1]))
            return math.sqrt(b.square * rest[0]) + math.sqrt(a.square * rest[1]) + math.sqrt(most[0] * most[1]) + cut

        done = decided(product, squares, off(most), most)
        if not done and a.open + b.open > RANKED:
            # the fullest bins, so many that the bound of all others decides; the correlation hardly moves
            size = next((m for m in range(254, 0, -1) if decided(product, squares, 1.05 * off([x.rest(m) for x in sides]), most)), 0)
            if size:
                more, inside = _fullest(pairs, layouts, sides, size)
                now, wider = product + more, [s + i for s, i in zip(squares, inside, strict=True)]
                done = decided(now, wider, off([x.rest(size) for x in sides]), most)
                if done:
                    product, squares = now, wider
        if not done:
            more, inside = _ranked(pairs, layouts, sides)
            product, squares = product + more, [s + i for s, i in zip(squares, inside, strict=True)]
        spread = math.sqrt(squares[0] * squares[1])
        return spark.createDataFrame([(total, product / spread if spread > SLACK else 0.0)], "n bigint, rho double")
    finally:
        pairs.shelf.drop()


#: What sums of floating point may be off, relative to the pairs.
SLACK = 1e-11


#: Pairs whose distances a task gathers before they are sent, and pairs of bins that are ranked together, about.
GATHERED, SORTED = 1 << 20, 1 << 20


def _alike(values: np.ndarray, n: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values in their order, with their numbers and sums."""
    order = np.argsort(values)
    v = values[order]
    at = np.flatnonzero(np.append(True, v[1:] != v[:-1]))
    return v[at], np.add.reduceat(n[order], at), np.add.reduceat(sums[order], at)


def _fullest(pairs: Pairs, layouts: list, sides: list[_Ranks], size: int) -> tuple[float, list[float]]:
    """What ranks inside bins of more than ``size`` pairs add to the sum of products, without products of two such ranks, and to the two sums of squares."""
    total = sides[0].total
    wide = max(1, layouts[0][2] * SORTED // max(total, SORTED))
    # 16 bits of a rank are enough here: the bound has what they leave out
    cut = max(0, (2 * total).bit_length() - 16)

    def flush(state: dict, k: int) -> pa.Table | None:
        d, twice = (np.concatenate(x) for x in zip(*state["kept"][k], strict=True)) if state["kept"][k] else (np.zeros(0), np.zeros(0, np.int64))
        state["kept"][k], state["n"][k] = [], 0
        if not len(d):
            return None
        v, n, s = _alike(d, np.ones(len(d), np.int64), twice.astype(np.int64))
        part = _rank_bins(v, layouts[k]) // wide
        ends = np.append(np.flatnonzero(np.append(True, part[1:] != part[:-1])), len(part))
        out = []
        for lo, hi in zip(ends[:-1], ends[1:], strict=True):
            step = np.diff(v[lo:hi], prepend=v[lo]).astype(np.int64)
            columns = [x.astype(np.min_scalar_type(int(x.max()))) for x in (step, n[lo:hi], s[lo:hi])]
            held = io.BytesIO()
            with pa.ipc.new_stream(held, (t := pa.table(columns, names=["step", "n", "s"])).schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                w.write_table(t)
            out.append((k, int(part[lo]), v[lo], held.getvalue()))
        return pa.table({c: pa.array([r[i] for r in out], t) for i, (c, t) in enumerate((("k", pa.int32()), ("part", pa.int64()), ("first", pa.float64()), ("pairs", pa.binary())))})

    def keep(state: dict, a, b, none) -> pa.Table | None:
        if "held" not in state:
            state.update(twice=[x.twice() for x in sides], held=[x.held() for x in sides], kept=[[], []], n=[0, 0])
        bins = [_rank_bins(d, layout) for d, layout in zip((a, b), layouts, strict=True)]
        out = []
        for k, d in enumerate((a, b)):
            hit = state["held"][k][bins[k]] > size
            hit[none] = False
            state["kept"][k].append((d[hit], state["twice"][1 - k][bins[1 - k][hit]] >> cut))
            state["n"][k] += len(state["kept"][k][-1][0])
            if state["n"][k] >= GATHERED:
                out.append(flush(state, k))
        return pa.concat_tables(out) if out else None

    def end(state: dict) -> pa.Table | None:
        out = [t for k in range(2) if (t := flush(state, k)) is not None] if state else []
        return pa.concat_tables(out) if out else None

    def rank(t: pa.Table) -> pa.Table:
        k = t.column("k")[0].as_py()
        given = []
        for first, held in zip(t.column("first").to_pylist(), t.column("pairs"), strict=True):
            x = pa.ipc.open_stream(held.as_buffer()).read_all()
            step, n, s = (x.column(c).to_numpy().astype(np.int64) for c in ("step", "n", "s"))
            given.append((np.cumsum(step) + int(first), n, s))
        v, n, s = _alike(*(np.concatenate(x) for x in zip(*given, strict=True)))
        bins = _rank_bins(v.astype(np.float64), layouts[k])
        at = np.flatnonzero(np.append(True, bins[1:] != bins[:-1]))
        below, held = np.cumsum(n) - n, np.add.reduceat(n, at)
        middle = np.repeat(below[at] + held / 2, np.diff(np.append(at, len(v))))
        off = (below + n / 2 - middle) / total
        return pa.table({"k": pa.array([k], pa.int32()), "s": [float(off @ ((s * 2.0**cut + n * ((2.0**cut - 1) / 2 - total)) * (0.5 / total)))], "q": [float(n @ off**2)]})

    rows = pairs.run(dict, keep, end, "k int, part bigint, first double, pairs binary").groupBy("k", "part").applyInArrow(rank, "k int, s double, q double")
    found = {r.k: (r.s, r.q) for r in rows.groupBy("k").agg(F.sum("s").alias("s"), F.sum("q").alias("q")).collect()}
    return sum(s for s, _ in found.values()), [found.get(k, (0.0, 0.0))[1] for k in range(2)]


def _ranked(pairs: Pairs, layouts: list, sides: list[_Ranks]) -> tuple[float, list[float]]:
    """What ranks inside bins add to the sum of products, and to the two sums of squares."""
    total = sides[0].total

    def keep(state: dict, a, b, none) -> pa.Table | None:
        if not state:
            state.update(twice=[x.twice() for x in sides], held=[x.held() for x in sides])
        bins = [_rank_bins(d, layout) for d, layout in zip((a, b), layouts, strict=True)]
        hit = (state["held"][0][bins[0]] > 1) | (state["held"][1][bins[1]] > 1)
        hit[none] = False
        if not hit.any():
            return None
        x, y = (k[hit] for k in bins)
        return pa.table({"a": a[hit], "b": b[hit], "i": x, "j": y, "ra": sides[0].ranks(state["twice"][0][x]), "rb": sides[1].ranks(state["twice"][1][y])})

    rows = pairs.run(dict, keep, lambda state: None, "a double, b double, i bigint, j bigint, ra double, rb double")
    if sum(x.open for x in sides) <= RANKED:
        t = {c: v.to_numpy() for c, v in zip(rows.columns, rows.toArrow().columns, strict=True)}
        x, y = _inside(t["i"], t["a"]) / total, _inside(t["j"], t["b"]) / total
        return float(t["rb"] @ x + t["ra"] @ y + x @ y), [float(x @ x), float(y @ y)]
    for bin_, value, out in (("i", "a", "x"), ("j", "b", "y")):
        alike = W.partitionBy(bin_, value)
        rank = F.rank().over(W.partitionBy(bin_).orderBy(value)) + (F.count("*").over(alike) - 1) / 2.0
        rows = rows.withColumn(out, (rank - (F.count("*").over(W.partitionBy(bin_)) + 1) / 2.0) / total)
    more, x, y = rows.agg(F.sum(F.col("rb") * F.col("x") + F.col("ra") * F.col("y") + F.col("x") * F.col("y")), F.sum(F.col("x") * F.col("x")), F.sum(F.col("y") * F.col("y"))).first()
    return more, [x, y]


#: Rows of a product, and columns between those that tell what single precision may be off.
TALL, TOLD = 256, 16


class _Means:
    """Sums of some queries' three distances to all other rows, and their nearest cosine.

    Sums of cosines are a product with the sum of all unit vectors. ``d_clap`` is taken from products in single
    precision, or in ``double``, close pairs directly; ``d_essentia`` in double. Single precision finds the rows
    that may have the nearest cosine, double decides.
    """

    def __init__(self, lib: shelf.Opened, own: np.ndarray, sides: list[_Side], double: bool):
        self.own, self.sides, self.double = own, sides, double
        self.twice = [-2 * sides[0].z if double else sides[0].single * np.float32(-2), -2 * sides[1].z]
        self.units = lib.units(own)
        self.units32 = self.units.astype(np.float32)
        self.best, self.sums, self.n = np.full(len(own), -np.inf), np.zeros((2, len(own))), np.zeros(len(own), np.int64)
        self.all, self.widest, self.inverse, self.told = np.zeros(self.units.shape[1]), 0.0, np.zeros(len(own)), np.zeros(len(own))

    def add(self, lib: shelf.Opened, x: np.ndarray, others: list[_Side], places: np.ndarray, none: tuple[np.ndarray, np.ndarray]) -> None:
        self.n += len(places) - np.bincount(none[0], minlength=len(self.n))
        inverse = lib.inverse[places]
        self.all += inverse @ x.astype(np.float64)
        self.widest = max(self.widest, float(others[0].length.max()))
        order = np.argsort(none[0], kind="stable")
        r0, c0 = none[0][order], none[1][order]
        for at in range(0, len(self.own), TALL):
            rows = slice(at, at + TALL)
            mine = slice(*np.searchsorted(r0, [at, at + TALL]))
            for k, other in enumerate(others):
                side = self.sides[k]
                sq = self.twice[k][rows] @ (other.z if k or self.double else other.single).T + other.square
                sq += side.square[rows][:, None]
                # close pairs lose digits in that form: they are taken directly
                close = np.full(len(sq), 1e-6 * side.z.shape[1]) if k or self.double else np.maximum(1e-3 * side.square[rows], 1e-6 * side.z.shape[1])
                r, c = np.divmod(np.flatnonzero(sq <= close[:, None]), sq.shape[1])
                for e in range(0, len(r), shelf.EXACT):
                    i, j = r[e : e + shelf.EXACT], c[e : e + shelf.EXACT]
                    d = side.z[at + i] - other.z[j]
                    sq[i, j] = np.einsum("ij,ij->i", d, d)
                sq[r0[mine] - at, c0[mine]] = 0
                np.sqrt(sq, out=sq)
                self.sums[k][rows] += sq.sum(axis=1)
                if not k and not self.double:
                    some = sq[:, ::TOLD]
                    told = some > np.sqrt(close)[:, None]
                    self.inverse[rows] += np.divide(1.0, some, out=np.zeros(some.shape), where=told).sum(axis=1)
                    self.told[rows] += told.sum(axis=1)
        r, c = self._nearest(lib, x, places, none)
        for e in range(0, len(r), shelf.EXACT):
            i, j = r[e : e + shelf.EXACT], c[e : e + shelf.EXACT]
            np.maximum.at(self.best, i, np.round(np.einsum("ij,ij->i", self.units[i], x[j].astype(np.float64)) * inverse[j], 12))

    def _nearest(self, lib: shelf.Opened, x: np.ndarray, places: np.ndarray, none: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Pairs whose cosine may be the nearest of all, by single precision."""
        s = self.units32 @ x.astype(np.float32, copy=False).T
        s *= lib.inverse32[places]
        s[none] = -np.inf
        off = 1.01 * lib.error + 1e-10
        limit = (np.maximum(self.best, s.max(axis=1) - off) - off).astype(np.float32)
        return np.divmod(np.flatnonzero((s >= limit[:, None]) & (s > -np.inf)), s.shape[1])

    def end(self, lib: shelf.Opened) -> pa.Table:
        r, p = lib.places(lib.plain["id"][self.own][:, None])
        r, p = r[lib.known[p]], p[lib.known[p]]
        same, none = (np.bincount(r, w, len(self.own)) for w in (np.einsum("ij,ij->i", self.units[r], lib.units(p)), lib.inverse[p] == 0))
        zero, zeros = lib.inverse[self.own] == 0, np.count_nonzero(lib.known & (lib.inverse == 0)) - none
        cosine = self.n - np.where(zero, zeros, self.units @ self.all - same)
        least = np.where(zero, np.where(zeros > 0, 0.0, 1.0), np.round(1 - np.clip(self.best, -1, 1), 12))
        # a distance is off by the product's error over the distance; rows far longer than the query are that far away, too
        length = self.sides[0].length
        off = 2.0**-26 * length * np.minimum(self.widest, 2 * length) / np.sqrt(self.sides[0].z.shape[1]) * self.inverse / np.maximum(self.told, 1)
        s1, s2 = self.sums / np.sqrt([[x.z.shape[1]] for x in self.sides])
        return pa.table({"query_id": lib.plain["id"][self.own], "n": self.n, "s0": cosine, "s1": s1, "s2": s2, "s3": least, "off": np.zeros(len(off)) if self.double else off})


def pair_means(pairs: Pairs, digits: int = 6) -> DataFrame:
    """(query_id, n, mean_cosine, mean_clap, mean_essentia, least_cosine): each query against every other row, summed where the pairs are.

    Where single precision leaves open how a mean is rounded to ``digits`` decimals, that query is computed again in double.
    """

    def met(double: bool, ids: DataFrame | None = None) -> DataFrame:
        parts = pairs.meet(
            lambda lib, own, sides: _Means(lib, own, sides, double), lambda state, *of: state.add(*of), lambda state, lib: state.end(lib), "query_id bigint, n bigint, s0 double, s1 double, s2 double, s3 double, off double", ids
        ).where("n > 0")
        means = [(F.sum(f"s{k}") / F.sum("n")).alias(c) for k, c in enumerate(("mean_cosine", "mean_clap", "mean_essentia"))]
        return durable(parts.groupBy("query_id").agg(F.sum("n").alias("n"), *means, F.min("s3").alias("least_cosine"), F.max("off").alias("off")))

    try:
        found = met(False)
        place = F.col("mean_clap") * 10.0**digits
        open_ = F.abs(place - F.floor(place) - 0.5) <= F.col("off") * 10.0**digits
        again = met(True, found.where(open_).select("query_id"))
        return found.where(~open_).unionByName(again).drop("off")
    finally:
        pairs.shelf.drop()


#: Candidates that a query may have before they are decided.
WAITING = 64


class _Nearest:
    """The ``k`` nearest rows of some queries, ties to the lower id: single precision finds candidates, double decides."""

    def __init__(self, side: _Side, k: int, most: int):
        self.side, self.k, self.most, self.dim = side, k, most, side.z.shape[1]
        self.twice = side.single * np.float32(-2)
        #: what the k nearest are at most away, as squares without the query's own, which changes no order
        self.top = np.full((len(side.z), k), np.inf)
        self.best = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.found, self.waiting = [], 0

    def _first(self, r: np.ndarray, *by: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which are among the first ``k`` of their row, at which place of it)."""
        order = np.lexsort((*by, r))
        place = np.arange(len(order)) - np.searchsorted(r[order], r[order], side="left")
        return order[place < self.k], place[place < self.k]

    def add(self, lib: shelf.Opened, other: _Side, places: np.ndarray, none: tuple[np.ndarray, np.ndarray]) -> None:
        d = self.twice @ other.single.T
        d += other.square.astype(np.float32)
        d[none] = np.inf
        # rounding of the rows, of the product's sum and of the norm, and of distances to 12 decimals
        reach = self.side.length + other.length.max()
        off = (self.dim + 32) * 2.0**-25 * reach**2 + 4e-12 * self.dim * (1 + reach)
        least = self.top[:, -1]
        if np.isinf(least).any() and d.shape[1] >= self.k:
            least = np.minimum(least, np.partition(d, self.k - 1, axis=1)[:, self.k - 1] + off)
        limit = np.nextafter((least + off).astype(np.float32), np.float32(np.inf))
        r, c = np.divmod(np.flatnonzero((d <= limit[:, None]) & (d < np.inf)), d.shape[1])
        v = d[r, c] + off[r]
        near = np.full(self.top.shape, np.inf)
        kept, place = self._first(r, v)
        near[r[kept], place] = v[kept]
        self.top = np.sort(np.hstack([self.top, near]), axis=1)[:, : self.k]
        self.found.append((r, places[c]))
        self.waiting += len(r)
        if self.waiting > self.most * len(self.top):
            self.decide(lib)

    def decide(self, lib: shelf.Opened) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, id, distance) of the nearest so far."""
        r, p = (np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*self.found, strict=True)) if self.found else self.best[:2]
        r, p, d = (np.concatenate(x) for x in zip(self.best, (r, p, self.side.exact(lib, r, p)), strict=True)) if self.found else self.best
        kept, _ = self._first(r, lib.plain["id"][p], d)
        self.best, self.found, self.waiting = (r[kept], p[kept], d[kept]), [], 0
        return r[kept], lib.plain["id"][p[kept]], d[kept]


def pair_nearest(pairs: Pairs, k: int = 3) -> DataFrame:
    """(query_id, id, d_clap, d_essentia): the ``k`` nearest rows of each query by either distance; an infinite distance stands for one by which a row isn't."""

    def begin(lib: shelf.Opened, own: np.ndarray, sides: list[_Side]) -> tuple:
        return own, [_Nearest(side, k, WAITING) for side in sides]

    def add(state: tuple, lib: shelf.Opened, x: np.ndarray, sides: list[_Side], places: np.ndarray, none: tuple[np.ndarray, np.ndarray]) -> None:
        for near, side in zip(state[1], sides, strict=True):
            near.add(lib, side, places, none)

    def end(state: tuple, lib: shelf.Opened) -> pa.Table:
        parts = []
        for m, near in enumerate(state[1]):
            r, ids, d = near.decide(lib)
            none = np.full(len(r), np.inf)
            parts.append((lib.plain["id"][state[0][r]], ids, *((none, d) if m else (d, none))))
        return pa.table(dict(zip(("query_id", "id", "d_clap", "d_essentia"), (np.concatenate(y) for y in zip(*parts, strict=True)), strict=True)))

    try:
        return durable(pairs.meet(begin, add, end, "query_id bigint, id bigint, d_clap double, d_essentia double"))
    finally:
        pairs.shelf.drop()


#: Bins of squared distances in single precision: 2**14 a factor of two, 16 factors of two below and above 1.
FINE_BITS, SPAN = 9, 16
FIRST, LAST = (127 - SPAN) << (23 - FINE_BITS), ((127 + SPAN) << (23 - FINE_BITS)) - 1
#: Rows whose distances a task holds at once, and pairs that are computed in double at once.
PART, EXACT = 256, 1024


class _Rough:
    """Squared ``d_clap`` distances of two blocks in single precision, part by part, with what they can be off."""

    def __init__(self, sigma: np.ndarray, centre: np.ndarray):
        self.sigma, self.centre, self.sides = sigma, centre, {}

    def _side(self, which: str, block: pa.Table) -> tuple:
        known = self.sides.get(which)
        if known is None or known[0] is not block:
            raw = blocks.rows_of(block.column("raw"), len(self.sigma))
            z = (raw - self.centre) / self.sigma
            single = z.astype(np.float32)
            norm = np.einsum("ij,ij->i", z, z)
            known = self.sides[which] = (block, z, single, norm.astype(np.float32), np.sqrt(norm), block.column("id").to_numpy())
        return known

    def parts(self, q: pa.Table, x: pa.Table):
        """(standardised query rows, library rows, squares over the dimensions, their greatest error by query row, whether pairs are of one row)."""
        _, m, a, na, la, qi = self._side("q", q)
        _, k, b, nb, lb, xi = self._side("x", x)
        dim = len(self.sigma)
        # rounding of the rows, of the product's sum and of the norms: a product is at most a quarter of the lengths' sum squared
        widest = float(lb.max(initial=0.0))
        off = (dim + 32) * 2.0**-25 * (la + widest) ** 2 / dim + 1e-30
        for at in range(0, len(a), PART):
            part = slice(at, at + PART)
            d = a[part] @ b.T
            d *= np.float32(-2 / dim)
            d += (na[part] / np.float32(dim))[:, None]
            d += (nb / np.float32(dim))[None, :]
            np.maximum(d, 0, out=d)
            yield m[part], k, d, off[part], qi[part, None] == xi[None, :]

    def exact(self, m: np.ndarray, k: np.ndarray) -> np.ndarray:
        d = m - k
        return np.round(np.sqrt(np.einsum("ij,ij->i", d, d) / len(self.sigma)), 12)


def pair_cuts(queries: DataFrame, library: DataFrame, sigma: np.ndarray, centre: np.ndarray, shares: tuple[float, ...] = (0.33, 0.66)) -> list[float]:
    """The ``d_clap`` distances at these shares of the sorted list of pairs, exact; both sides (id, raw).

    Single precision counts pairs by bin. The second pass counts what lies below the bin of each cut and
    sends the values in it, in double wherever single precision can't tell; only where a place is in none
    of them, which the counts show, the bin is made wider. Nothing is collected but bins. Distances don't
    change with ``centre``; rounding errors are least where it is the mean.
    """
    asked, packed = blocks.packed_queries(queries.select("id", "raw")), blocks.packed_library(library.select("id", "raw"))

    def count(state: dict, q: pa.Table, x: pa.Table) -> None:
        for _, _, d, _, same in state["rough"].parts(q, x):
            bins = np.clip(d.view(np.int32) >> FINE_BITS, FIRST, LAST)
            bins -= FIRST
            low = int(bins.min(initial=LAST))
            n = np.bincount((bins - low).ravel())
            state["n"][low : low + len(n)] += n
            np.subtract.at(state["n"], bins[same], 1)

    def counted(state: dict) -> pa.Table:
        at = np.flatnonzero(state["n"])
        return pa.table({"bin": at, "n": state["n"][at]})

    def begin() -> dict:
        return {"rough": _Rough(sigma, centre), "n": np.zeros(LAST - FIRST + 1, np.int64)}

    binned = blocks.gather(asked, packed, begin, count, counted, "bin bigint, n bigint").groupBy("bin").agg(F.sum("n").alias("n")).toArrow().sort_by("bin")
    bins, n = binned.column("bin").to_numpy(), binned.column("n").to_numpy()
    total, upto = int(n.sum()), np.cumsum(n)
    if not total:
        return [float("nan") for _ in shares]
    places = [min(int(share * total), total - 1) for share in shares]
    own = [int(bins[np.searchsorted(upto, p, side="right")]) for p in places]
    out: list[float | None] = [None] * len(shares)
    wide = 0.125
    while None in out:
        ends = {k: _distances(own[k], wide) for k, v in enumerate(out) if v is None}
        found = _within(asked, packed, sigma, centre, ends)
        ranked = found.withColumn("upto", F.sum("n").over(W.partitionBy("k").orderBy("v")))
        hit = F.greatest(*[F.when(F.col("k") == k, F.lit(places[k])) for k in ends], F.lit(-1))
        for r in ranked.where((F.col("upto") > hit) & (F.col("upto") - F.col("n") <= hit)).collect():
            # a value of -1 stands for what lies below
            if r.v >= 0:
                out[r.k] = r.v
        wide *= 64
    return out


def _distances(own: int, wide: float) -> tuple[float, float]:
    """The distances at which a bin begins and ends, moved apart by so many times its width; the outermost bins take what lies beyond."""
    edges = (np.array([own + FIRST, own + FIRST + 1], np.int32) << FINE_BITS).view(np.float32).astype(np.float64)
    low, high = np.sqrt(edges) * (1 + wide * 2.0**-14 * np.array([-1, 1]))
    return (-1.0 if own == 0 or low <= 0 else float(low)), (float("inf") if own == LAST - FIRST else float(high))


def _within(asked: DataFrame, packed: DataFrame, sigma: np.ndarray, centre: np.ndarray, ends: dict[int, tuple[float, float]]) -> DataFrame:
    """(k, v, n): the values of pairs between the k-th ends, how often they stand there, and at -1 how many lie below."""

    def look(state: dict, q: pa.Table, x: pa.Table) -> None:
        for m, k, d, off, same in state["rough"].parts(q, x):
            d[same] = np.inf
            for c, (low, high) in ends.items():
                # squares below which, and above which, no rounding brings a pair between the ends
                under = (np.sign(low) * low * low * (1 - 1e-6) - off).astype(np.float32)[:, None]
                over = (high * high * (1 + 1e-6) + off).astype(np.float32)[:, None]
                at = np.flatnonzero(~((d < under) | (d > over)) & ~same)
                state["below"][c] += int(np.count_nonzero(d < under))
                for s in range(0, len(at), EXACT):
                    i, j = np.divmod(at[s : s + EXACT], d.shape[1])
                    v = state["rough"].exact(m[i], k[j])
                    state["below"][c] += int(np.count_nonzero(v < low))
                    state["found"][c].append(v[(v >= low) & (v <= high)])
                if len(state["found"][c]) > 4096:
                    state["found"][c] = [np.concatenate(state["found"][c])]

    def seen(state: dict) -> pa.Table:
        parts = []
        for c in ends:
            v, n = np.unique(np.concatenate([np.zeros(0), *state["found"][c]]), return_counts=True)
            parts.append((np.full(len(v) + 1, c, np.int32), np.append(v, -1.0), np.append(n, state["below"][c])))
        return pa.table(dict(zip(("k", "v", "n"), (np.concatenate(x) for x in zip(*parts, strict=True)), strict=True)))

    def begin() -> dict:
        return {"rough": _Rough(sigma, centre), "below": dict.fromkeys(ends, 0), "found": {c: [] for c in ends}}

    return durable(blocks.gather(asked, packed, begin, look, seen, "k int, v double, n bigint").groupBy("k", "v").agg(F.sum("n").alias("n")))


def legacy_report(queries: DataFrame, library: DataFrame, sigma: np.ndarray, hold: int, near: float = 0.3, mid: float = 0.7) -> DataFrame:
    """(query_id, band, n, least, most, id, d): per query, the bands of standardised distance, and as band ``Jump`` the rows far away
    but for the hold axis; ``id`` and ``d`` are the nearest of them. Counted in the kernel."""
    from crateflow.operators.walk import legacy_distances

    names = ("Near", "Mid", "Far", "Jump")

    def start(q: pa.Table) -> dict:
        shape = (len(names), q.num_rows)
        return {"n": np.zeros(shape, np.int64), "least": np.full(shape, np.inf), "most": np.full(shape, -np.inf), "id": np.full(shape, np.iinfo(np.int64).max)}

    def add(state: dict, q: pa.Table, x: pa.Table) -> None:
        ids = x.column("id").to_numpy()
        d, free, held = legacy_distances(blocks.rows_of(q.column("vector")), blocks.rows_of(x.column("vector")), sigma, hold)
        apart = q.column("id").to_numpy()[:, None] != ids[None, :]
        for k, hit in enumerate(((d > 0) & (d <= near), (d > near) & (d <= mid), d > mid, (free > mid) & (held <= near))):
            hit &= apart
            v = np.where(hit, d, np.inf)
            best = v.argmin(axis=1)
            low, who = v[np.arange(len(v)), best], ids[best]
            state["n"][k] += hit.sum(axis=1)
            state["most"][k] = np.maximum(state["most"][k], np.where(hit, d, -np.inf).max(axis=1))
            better = np.isfinite(low) & ((low < state["least"][k]) | ((low == state["least"][k]) & (who < state["id"][k])))
            state["least"][k][better], state["id"][k][better] = low[better], who[better]

    def end(state: dict, q: pa.Table) -> pa.Table:
        k, r = np.nonzero(state["n"])
        return pa.table({"query_id": q.column("id").to_numpy()[r], "band": np.array(names)[k], "n": state["n"][k, r], "most": state["most"][k, r], "d": state["least"][k, r], "id": state["id"][k, r]})

    parts = blocks.tally(queries.select("id", "vector"), library.select("id", "vector"), start, add, end, "query_id bigint, band string, n bigint, most double, d double, id bigint")
    return parts.groupBy("query_id", "band").agg(F.sum("n").alias("n"), F.min("d").alias("least"), F.max("most").alias("most"), F.min(F.struct("d", "id")).alias("b")).select("query_id", "band", "n", "least", "most", "b.id", "b.d")


def legacy_band(d: Column, near: float = 0.3, mid: float = 0.7) -> Column:
    """Band of a distance; a copy at distance 0 is in none."""
    return F.when((d > 0) & (d <= near), "Near").when((d > near) & (d <= mid), "Mid").when(d > mid, "Far")


def pool_distances(seed: DataFrame, library: DataFrame, sigma: np.ndarray) -> DataFrame:
    """(id, a, b): standardised feature distance and cosine distance of the seed's one row to every other row with an embedding."""
    vector, unit = seed.select("vector", "unit").first()
    rows = library.join(seed.select("id"), "id", "left_anti").where("unit is not null")
    if unit is None:
        return rows.where("false").select("id", F.lit(0.0).alias("a"), F.lit(0.0).alias("b"))
    far = C.weighted_distance(F.col("vector"), F.array(*map(F.lit, vector)), sigma.tolist())
    return rows.select("id", far.alias("a"), (1 - C.dot(F.col("unit"), F.array(*map(F.lit, unit)))).alias("b"))
