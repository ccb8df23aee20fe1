"""Playlist walks, all seeds at once.

A walk is sequential in its steps and independent of other walks: a task takes a share of the walks through
all their steps, over a library that stands in files once (``shelf``), in the order of tempo. How many rows
pass a walk's gates, and so at which place its scheduled band begins, is counted from sorted tempos. One
pass over the rows that the tempo gate allows finds the row at that place: a sample says between which
cosines to look, the counts say whether it was right. No table of survivors exists.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from crateflow.functions import columns as C
from crateflow.operators import blocks, shelf
from crateflow.session import durable

SMALL = 20
#: The slot of a track without one.
NO_SLOT = 24
#: Survivors from which a sample tells where to look, and at least every how many-th row it takes.
SAMPLED, STRIDE = 8192, 16
#: Walks that a task takes at a time, and walks that meet the library together.
WALKS, TOGETHER_WALKS = 4096, 128
RELAXATIONS = 3
BINS = 256
ENTRY = "walk_id bigint, position int, id bigint, band string, distance double, reason string"


@dataclass(frozen=True)
class Sampler:
    """Settings of a walk, with their defaults."""

    near_quantile: float = 0.10
    mid_quantile: float = 0.40
    mood_box: dict = field(default_factory=dict)
    key_max_steps: int = 2
    tempo_max_step_pct: float = 0.10
    tempo_drift_per_step: float = 0.0
    band_schedule: tuple[str, ...] = ("Near", "Mid", "Far", "Mid", "Near")
    allow_missing_clap: bool = False
    allow_missing_mood: bool = False

    @classmethod
    def from_dict(cls, given: dict) -> Sampler:
        """Defaults overridden by what is given; unknown settings are ignored."""
        known = {k: v for k, v in given.items() if k in cls.__dataclass_fields__}
        if "band_schedule" in known:
            known["band_schedule"] = tuple(known["band_schedule"])
        return cls(**known)

    def boxes(self) -> list[dict]:
        """The mood box and its relaxations, in the order in which they are tried."""
        out = [self.mood_box]
        while self.mood_box and len(out) <= RELAXATIONS:
            out.append(C.relax_mood_box(out[-1]))
        return out


def _levels(x: pa.Table, s: Sampler) -> np.ndarray:
    """Bit k is set where a row passes the k-th box."""
    bits = np.zeros(x.num_rows, np.int32)
    for k, box in enumerate(s.boxes()):
        ok = np.ones(x.num_rows, bool)
        if box:
            ok &= x.column("has_mood").to_numpy(zero_copy_only=False) | s.allow_missing_mood
        for name, bounds in box.items():
            v = x.column(name.split(".", 1)[-1]).to_numpy(zero_copy_only=False).astype(float)
            with np.errstate(invalid="ignore"):
                ok &= ~np.isnan(v)
                ok &= v >= float(bounds["min"]) if "min" in bounds else True
                ok &= v <= float(bounds["max"]) if "max" in bounds else True
        bits |= ok.astype(np.int32) << k
    return bits


def _gated(q: pa.Table, x: pa.Table, s: Sampler) -> tuple[np.ndarray, ...]:
    """(similarities, open rows, survivors of tempo and key gates, penalised ones, box bits of the library's rows)."""
    return _sims(q, x), *_passed(q, x, s)


def _passed(q: pa.Table, x: pa.Table, s: Sampler) -> tuple[np.ndarray, ...]:
    """As ``_gated``, without similarities; a library without embeddings says which rows have one (``there``)."""
    open_ = ~blocks.closed(x.column("id").to_numpy(), q.column("visited"))
    bits = _levels(x, s)
    a, b = (t.column("slot").to_numpy(zero_copy_only=False).astype(float) for t in (q, x))
    d = np.abs(a[:, None] - b[None, :]) % 24
    steps = np.minimum(d, 24 - d)
    block = steps > s.key_max_steps + 2
    now, centre, bpm = (q.column("bpm").to_numpy(), q.column("centre").to_numpy(), x.column("bpm").to_numpy())
    with np.errstate(divide="ignore", invalid="ignore"):
        far = ~((centre[:, None] > 0) & (np.abs(bpm[None, :] - centre[:, None]) / centre[:, None] <= s.tempo_max_step_pct))
    off = (now[:, None] > 0) & (bpm[None, :] > 0) & far
    ok = open_ & ~block & ~off & (bits > 0)[None, :]
    if not s.allow_missing_clap:
        there = x.column("there") if "there" in x.column_names else x.column("unit").is_valid()
        ok &= there.to_numpy(zero_copy_only=False)[None, :]
    return open_, ok, (steps > s.key_max_steps) & ~block, bits


def gate_kernel(s: Sampler):
    """Every survivor of the gates, for callers that want them all."""

    def kernel(q: pa.Table, x: pa.Table) -> pa.Table:
        _, ok, verdict, _ = _passed(q, x, s)
        r, c = np.divmod(np.flatnonzero(ok), ok.shape[1]) if ok.size else np.nonzero(ok)
        return pa.table({"walk_id": q.column("walk_id").to_numpy()[r], "id": x.column("id").to_numpy()[c], "verdict": verdict[r, c].astype(np.int32)})

    return kernel


def _bins(sim: np.ndarray) -> np.ndarray:
    return np.clip(np.floor((sim + 1.0) * (BINS / 2)), 0, BINS - 1).astype(np.int64)


def gate_counts(state: DataFrame, library: DataFrame, s: Sampler) -> DataFrame:
    """(walk_id, kind, key, n, id, sim): per walk and task, survivors by box (kind 0), by box and similarity bin (kind 1), and the nearest open row (kind 2)."""
    levels = len(s.boxes())

    def start(q: pa.Table) -> dict:
        n = q.num_rows
        return {"any": np.zeros((n, levels), np.int64), "bin": np.zeros((n, levels, BINS), np.int64), "sim": np.full(n, -np.inf), "id": np.full(n, np.iinfo(np.int64).max)}

    def add(state: dict, q: pa.Table, x: pa.Table) -> None:
        sim, open_, ok, _, bits = _gated(q, x, s)
        n, ids = q.num_rows, x.column("id").to_numpy()
        known = ~np.isnan(sim)
        r, c = np.nonzero(ok)
        there, b, row_bits = known[r, c], _bins(np.where(known, sim, 0.0)[r, c]), bits[c]
        for k in range(levels):
            hit = row_bits >> k & 1 == 1
            state["any"][:, k] += np.bincount(r[hit], minlength=n)
            hit &= there
            state["bin"][:, k] += np.bincount(r[hit] * BINS + b[hit], minlength=n * BINS).reshape(n, BINS)
        near = np.where(open_ & known, sim, -np.inf)
        best = near.argmax(axis=1)
        top, who = near[np.arange(n), best], ids[best]
        better = (top > state["sim"]) | ((top == state["sim"]) & (who < state["id"]))
        better &= np.isfinite(top)
        state["sim"][better], state["id"][better] = top[better], who[better]

    def end(state: dict, q: pa.Table) -> pa.Table:
        w = q.column("walk_id").to_numpy()
        r, k = np.nonzero(state["any"])
        a = (w[r], np.zeros(len(r), np.int32), k, state["any"][r, k], np.zeros(len(r), np.int64), np.zeros(len(r)))
        r, k, b = np.nonzero(state["bin"])
        c = (w[r], np.ones(len(r), np.int32), k * BINS + b, state["bin"][r, k, b], np.zeros(len(r), np.int64), np.zeros(len(r)))
        r = np.flatnonzero(np.isfinite(state["sim"]))
        e = (w[r], np.full(len(r), 2, np.int32), np.zeros(len(r), np.int64), np.zeros(len(r), np.int64), state["id"][r], state["sim"][r])
        return pa.table(dict(zip(("walk_id", "kind", "key", "n", "id", "sim"), (np.concatenate(x) for x in zip(a, c, e, strict=True)), strict=True)))

    return blocks.tally(state, library, start, add, end, COUNTED)


def _sims(q: pa.Table, x: pa.Table) -> np.ndarray:
    """Cosines of unit rows, NaN where either has no embedding."""
    dim = next((len(v) for t in (q, x) for v in t.column("unit").combine_chunks().drop_null()[:1].to_pylist()), 1)
    # 12 decimals: copies tie wherever they stand in a block
    return np.round(blocks.rows_of(q.column("unit"), dim) @ blocks.rows_of(x.column("unit"), dim).T, 12)


GATED = "walk_id bigint, id bigint, verdict int"
COUNTED = "walk_id bigint, kind int, key bigint, n bigint, id bigint, sim double"
_SLIM = ["id", "slot", "bpm", "has_mood", *C.MOODS, "unit"]


def box_levels(counts: DataFrame) -> DataFrame:
    """(walk_id, level): the first box that anything passes."""
    return counts.where("kind = 0").groupBy("walk_id").agg(F.min("key").cast("int").alias("level"))


def band_starts(n: Column, near: float, mid: float) -> dict[str, Column]:
    """1-based rank at which each quantile band begins, null where it is empty."""
    n_near, upto = F.ceil(n * F.lit(near)), F.ceil(n * F.lit(mid))
    return {"Near": F.when((n > 0) & (n_near > 0), F.lit(1)), "Mid": F.when(upto - n_near > 0, n_near + 1).cast("long"), "Far": F.when(upto < n, F.greatest(upto, F.lit(0)) + 1).cast("long")}


def _gate_columns(s: Sampler):
    """What a walk's gates need of a library row: ``id``, ``slot`` (24 for none), ``bpm`` (0 for none) and the boxes it passes."""

    def prepare(t: pa.Table) -> pa.Table:
        slot, bpm = t.column("slot").to_numpy(zero_copy_only=False).astype(float), t.column("bpm").to_numpy(zero_copy_only=False).astype(float)
        with np.errstate(invalid="ignore"):
            return pa.table({"id": t.column("id"), "slot": np.where(np.isnan(slot), NO_SLOT, np.nan_to_num(slot) % NO_SLOT).astype(np.int32), "bpm": np.where(bpm > 0, bpm, 0.0), "bits": _levels(t, s)})

    return prepare


def _tempo_ends(now: np.ndarray, centre: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray]:
    """The least and the greatest tempo above 0 that passes, exact to the last bit; any where there is none now."""
    some = centre > 0
    c = np.where(some, centre, 1.0)
    ends = []
    for sign in (-1, 1):
        edge = c + sign * share * c
        with np.errstate(invalid="ignore", over="ignore"):
            for _ in range(64):
                edge = np.where(np.abs(edge - c) / c > share, np.nextafter(edge, c), edge)
            for _ in range(64):
                wider = np.nextafter(edge, sign * np.inf)
                edge = np.where(np.abs(wider - c) / c <= share, wider, edge)
        ends.append(edge)
    none = ~some | ~(np.abs(c - c) / c <= share)
    low, high = np.where(none, np.inf, ends[0]), np.where(none, -np.inf, ends[1])
    return np.where(now > 0, low, -np.inf), np.where(now > 0, high, np.inf)


class _Gates:
    """Survivors of the gates counted without a comparison: tempos in order, by slot and box."""

    def __init__(self, lib, s: Sampler):
        self.lib, self.s, self.levels = lib, s, len(s.boxes())
        self.slot, self.bpm, self.bits = (lib.plain[c] for c in ("slot", "bpm", "bits"))
        gap = np.abs(np.arange(NO_SLOT)[:, None] - np.arange(NO_SLOT)[None, :])
        #: Steps between slots; none where one isn't known.
        self.steps = np.zeros((NO_SLOT + 1, NO_SLOT + 1), np.int64)
        self.steps[:NO_SLOT, :NO_SLOT] = np.minimum(gap, NO_SLOT - gap)
        self.open = self.steps <= s.key_max_steps + 2
        self.verdict = (self.steps > s.key_max_steps).astype(np.int64)
        self.tempos: dict[tuple[bool, int, int], np.ndarray] = {}
        for known in (True, False):
            # rows without an embedding only say which box counts, where they may be missing at all
            rows = lib.known if known else ~lib.known & (s.allow_missing_clap | lib.plain["there"])
            for k in range(self.levels):
                hit = rows & (self.bits >> k & 1 == 1)
                for g in range(NO_SLOT + 1):
                    self.tempos[known, k, g] = np.sort(self.bpm[hit & (self.slot == g)])

    def counts(self, slot: np.ndarray, low: np.ndarray, high: np.ndarray, closed: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(survivors, survivors with an embedding) of each walk by box, without what it visited."""
        any_, known = np.zeros((len(slot), self.levels), np.int64), np.zeros((len(slot), self.levels), np.int64)
        for (there, k, g), tempos in self.tempos.items():
            r = np.flatnonzero(self.open[slot, g]) if len(tempos) else ()
            if not len(r):
                continue
            none = np.searchsorted(tempos, 0.0, side="right")
            n = none + np.maximum(np.searchsorted(tempos, high[r], side="right") - np.maximum(np.searchsorted(tempos, low[r], side="left"), none), 0)
            any_[r, k] += n
            if there:
                known[r, k] += n
        r, p = closed
        b = self.bpm[p]
        fits = self.open[slot[r], self.slot[p]] & ((b <= 0) | (b >= low[r]) & (b <= high[r])) & self.lib.known[p]
        for k in range(self.levels):
            lost = np.bincount(r[fits & (self.bits[p] >> k & 1 == 1)], minlength=len(slot))
            any_[:, k] -= lost
            known[:, k] -= lost
        return any_, known


def _want(n: int, s: Sampler, sched: str) -> tuple[int, str] | None:
    """(place among ``n`` survivors, band) of a walk's pick; none where no band has a row."""
    if n < SMALL:
        return (1, sched) if n else None
    near, upto = math.ceil(n * s.near_quantile), math.ceil(n * s.mid_quantile)
    start = {"Near": 1 if near > 0 else None, "Mid": near + 1 if upto > near else None, "Far": max(upto, 0) + 1 if upto < n else None}
    band = next((b for b in (sched, *start) if start.get(b) is not None), None)
    return None if band is None or not 1 <= start[band] <= n else (start[band], band)


class _Chunk:
    """Walks whose picks are looked for together: their rank-th of all open rows, or of the gates' survivors."""

    def __init__(self, gates: _Gates, units: np.ndarray, slot: np.ndarray, low: np.ndarray, high: np.ndarray, rank: np.ndarray, n: np.ndarray, level: int | None, closed: tuple[np.ndarray, np.ndarray]):
        self.gates, self.lib, self.units, self.slot, self.low, self.high, self.rank, self.n, self.level, self.closed = gates, gates.lib, units, slot, low, high, rank, n, level, closed
        self.bias = np.where(gates.open[slot], 0, -np.inf).astype(np.float32)

    def spans(self, stride: int = 1) -> Iterator[tuple[int, int, slice | np.ndarray]]:
        starts = self.lib.starts
        for k in range(len(starts) - 1):
            at, end = int(starts[k]), int(starts[k + 1])
            parts = [(0, end - at)]
            if self.level is not None:
                b = self.gates.bpm[at:end]
                none = int(np.searchsorted(b, 0.0, side="right"))
                first, last = max(none, int(np.searchsorted(b, self.low.min(), side="left"))), int(np.searchsorted(b, self.high.max(), side="right"))
                parts = [(0, none), (first, last)] if first > none else [(0, max(none, last))]
            for a, z in parts:
                for lo in range(a, z, shelf.WIDE * stride):
                    hi = min(z, lo + shelf.WIDE * stride)
                    cols = slice(0, hi - lo, stride)
                    ok = self.lib.known[at + lo : at + hi : stride]
                    if self.level is not None and self.gates.levels > 1:
                        ok = ok & (self.gates.bits[at + lo : at + hi : stride] >> self.level & 1 == 1)
                    if not ok.all():
                        cols = np.flatnonzero(ok) * stride
                        if not len(cols):
                            continue
                    yield k, lo, cols

    def cosines(self, stride: int = 1) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(places, cosines), minus infinity where a row is closed or held back by a gate."""
        r, p = self.closed
        for places, d in self.lib.products(self.units, self.spans(stride)):
            if self.level is not None:
                b = self.gates.bpm[places]
                none = int(np.searchsorted(b, 0.0, side="right"))
                first, last = np.maximum(none, np.searchsorted(b, self.low, side="left")), np.searchsorted(b, self.high, side="right")
                for row in np.flatnonzero((first > none) | (last < len(b))):
                    d[row, none : first[row]] = -np.inf
                    d[row, max(none, last[row]) :] = -np.inf
                d += np.take(self.bias, self.gates.slot[places], axis=1)
            c = np.minimum(np.searchsorted(places, p), len(places) - 1)
            hit = places[c] == p
            d[r[hit], c[hit]] = -np.inf
            yield places, d

    def window(self) -> tuple[np.ndarray, np.ndarray]:
        """Cosines between which the pick of each walk most likely is, told from a sample of the rows; the counts decide."""
        low, high = np.full(len(self.n), -np.inf, np.float32), np.full(len(self.n), np.inf, np.float32)
        if self.n.max(initial=0) < SAMPLED:
            return low, high
        stride = max(STRIDE, int(self.n.max()) // SAMPLED)
        sample = -np.sort(-np.hstack([d for _, d in self.cosines(stride)]), axis=1)
        m = np.isfinite(sample).sum(axis=1)
        share = self.rank / np.maximum(self.n, 1)
        at = share * m
        off = 4.5 * np.sqrt(np.maximum(at * (1 - share), 0)) + 4
        every = np.arange(len(m))
        below, above = np.ceil(at + off).astype(np.int64), np.floor(at - off).astype(np.int64)
        below[self.n < SAMPLED], above[self.n < SAMPLED] = len(sample[0]), -1
        low = np.where(below < m, sample[every, np.clip(below, 0, sample.shape[1] - 1)], low)
        high = np.where((above >= 0) & (above < m), sample[every, np.clip(above, 0, sample.shape[1] - 1)], high)
        return low, high

    def picks(self) -> tuple[np.ndarray, np.ndarray]:
        """(place, cosine) of each walk's pick, place -1 where there is none."""
        place, sim = np.full(len(self.n), -1, np.int64), np.full(len(self.n), np.nan)
        low, high = self.window()
        todo = np.arange(len(self.n))
        while len(todo):
            part = self if len(todo) == len(self.n) else self.only(todo)
            done, p, v = part.within(low, high)
            place[todo[done]], sim[todo[done]] = p[done], v[done]
            # what the window missed is looked for among all rows
            todo, low, high = todo[~done], np.full((~done).sum(), -np.inf, np.float32), np.full((~done).sum(), np.inf, np.float32)
        return place, sim

    def only(self, rows: np.ndarray) -> _Chunk:
        new = np.full(len(self.n), -1)
        new[rows] = np.arange(len(rows))
        r, p = self.closed
        kept = new[r] >= 0
        return _Chunk(self.gates, self.units[rows], self.slot[rows], self.low[rows], self.high[rows], self.rank[rows], self.n[rows], self.level, (new[r[kept]], p[kept]))

    def within(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(whether the pick could be told, place, cosine) from the rows between two cosines of each walk."""
        count, n = np.zeros(len(low), np.int64), len(low)
        found: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32))]
        for places, d in self.cosines():
            over = d > high[:, None]
            count += np.count_nonzero(over, axis=1)
            flat = np.flatnonzero((d >= low[:, None]) & ~over)
            s = d.ravel()[flat]
            if not np.isfinite(low).all():
                flat, s = flat[np.isfinite(s)], s[np.isfinite(s)]
            r, c = np.divmod(flat, d.shape[1])
            found.append((r, places[c], s))
        r, p, s = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(r, kind="stable")
        r, p, s = r[order], p[order], s[order]
        ends = np.searchsorted(r, np.arange(n + 1))
        error = 2 * self.lib.error
        done, left, near = np.ones(n, bool), self.rank - count, []
        for k in range(n):
            own, want = s[ends[k] : ends[k + 1]], left[k]
            if not 1 <= want <= len(own):
                # with all rows in view there is no such place
                done[k] = not (np.isfinite(low[k]) or np.isfinite(high[k]))
                continue
            t = np.partition(own, len(own) - want)[len(own) - want]
            if t - error < low[k] or t + error > high[k]:
                done[k] = False
                continue
            left[k] -= np.count_nonzero(own > t + error)
            near.append(ends[k] + np.flatnonzero((own >= t - error) & (own <= t + error)))
        place, sim = np.full(n, -1, np.int64), np.full(n, np.nan)
        if near:
            at = np.concatenate(near)
            r, p = r[at], p[at]
            v = self.lib.cosines(self.units, r, p)
            verdict = self.gates.verdict[self.slot[r], self.gates.slot[p]] if self.level is not None else np.zeros(len(r), np.int64)
            order = np.lexsort((self.lib.plain["id"][p], verdict, -v, r))
            r, p, v = r[order], p[order], v[order]
            hit = np.flatnonzero(np.arange(len(r)) - np.searchsorted(r, r) == left[r] - 1)
            place[r[hit]], sim[r[hit]] = p[hit], v[hit]
        return done, place, sim


def _walked(lib, gates: _Gates, walk_id: np.ndarray, seed: np.ndarray, limit: int, s: Sampler) -> Iterator[dict]:
    """The entries of these walks, step by step."""
    r, p = lib.places(seed[:, None])
    keep = lib.known[p]
    r, at = r[keep], p[keep]
    walk_id, visited, seed_bpm = walk_id[r], seed[r][:, None], gates.bpm[at]
    for step in range(limit):
        if not len(at):
            break
        sched = s.band_schedule[step % len(s.band_schedule)]
        units, slot, now = lib.units(at), gates.slot[at], gates.bpm[at]
        centre = np.where(seed_bpm > 0, seed_bpm * (1 + s.tempo_drift_per_step) ** step, now) if s.tempo_drift_per_step else now
        low, high = _tempo_ends(now, centre, s.tempo_max_step_pct)
        cr, cp = lib.places(visited)
        any_, known = gates.counts(slot, low, high, (cr, cp))
        level = np.where((any_ > 0).any(axis=1), (any_ > 0).argmax(axis=1), -1)
        n = np.where(level >= 0, known[np.arange(len(at)), level], 0)
        wanted = [_want(int(k), s, sched) for k in n]
        level = np.where([w is None for w in wanted], -1, level)
        rank = np.array([w[0] if w else 1 for w in wanted], np.int64)
        every = int(lib.known.sum())
        n_all = every - np.bincount(cr[lib.known[cp]], minlength=len(at))
        place, sim = np.full(len(at), -1, np.int64), np.full(len(at), np.nan)
        for k in np.unique(level):
            own = np.flatnonzero(level == k)
            own = own[np.lexsort((high[own], low[own]))]
            for a in range(0, len(own), TOGETHER_WALKS):
                rows = own[a : a + TOGETHER_WALKS]
                new = np.full(len(at), -1)
                new[rows] = np.arange(len(rows))
                mine = new[cr] >= 0
                chunk = _Chunk(gates, units[rows], slot[rows], low[rows], high[rows], rank[rows], (n if k >= 0 else n_all)[rows], None if k < 0 else int(k), (new[cr[mine]], cp[mine]))
                place[rows], sim[rows] = chunk.picks()
        text, bands = [], []
        for w, k, m in zip(wanted, level, n, strict=True):
            relaxed = f", mood relaxed x{k}" if k > 0 else ""
            band = w[1] if w else sched
            bands.append(band)
            text.append(f"Fallback: gates empty, global-nearest-by-CLAP (sched {sched})" if w is None else f"Small library (n={m}<{SMALL}): greedy nearest-by-CLAP (sched {sched}){relaxed}" if m < SMALL else f"{band} CLAP pick (sched {sched}){relaxed}")
        go = np.flatnonzero(place >= 0)
        ids = lib.plain["id"][place[go]]
        yield {"walk_id": walk_id[go], "position": np.full(len(go), step + 1, np.int32), "id": ids, "band": np.array(bands, object)[go], "sim": sim[go], "reason": np.array(text, object)[go]}
        walk_id, at, seed_bpm, visited = walk_id[go], place[go], seed_bpm[go], np.hstack([visited[go], ids[:, None]])


def clap_walk(library: DataFrame, seeds: DataFrame, limit: int = 9, sampler: Sampler | None = None) -> DataFrame:
    """ENTRY rows of the gated, banded walk from each seed; ``seeds``: (walk_id, id).

    A walk ends early where the current track has no embedding or nothing is left. ``library`` has the
    embeddings as they are stored (``raw``) or at unit length (``unit``).
    """
    s = sampler or Sampler()
    spark = library.sparkSession
    vector = "raw" if "raw" in library.columns else "unit"
    shelved = shelf.shelve(library.select(*[c for c in _SLIM if c != "unit"], F.col(vector).isNotNull().alias("there"), F.col(vector).alias("x")), "x", _prepared(s), "bpm")
    tasks = max(spark.sparkContext.defaultParallelism, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lib = gates = None
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        t = pa.Table.from_batches(parts)
        lib = shelved.open()
        if not len(lib.starts) > 1:
            return
        gates = _Gates(lib, s)
        ids, seed = (t.column(c).to_numpy() for c in ("walk_id", "id"))
        for at in range(0, len(ids), WALKS):
            for rows in _walked(lib, gates, ids[at : at + WALKS], seed[at : at + WALKS], limit, s):
                yield pa.record_batch([pa.array(rows[c], type_) for c, type_ in _FOUND.items()], names=list(_FOUND))

    try:
        found = durable(seeds.select("walk_id", "id").repartition(tasks).mapInArrow(run, "walk_id bigint, position int, id bigint, band string, sim double, reason string"))
    finally:
        shelved.drop()
    return found.select("walk_id", "position", "id", "band", F.round(1 - F.col("sim"), 4).alias("distance"), "reason")


_FOUND = {"walk_id": pa.int64(), "position": pa.int32(), "id": pa.int64(), "band": pa.string(), "sim": pa.float64(), "reason": pa.string()}


def _prepared(s: Sampler):
    plain = _gate_columns(s)
    return lambda t: plain(t).append_column("there", t.column("there"))


def axis_stats(library: DataFrame) -> DataFrame:
    """(axis, mu, sigma) over all rows, population deviation, 1 where there is none."""
    one = library.select(F.posexplode("vector").alias("axis", "v"))
    spread = F.when(F.max("v") > F.min("v"), F.stddev_pop("v")).otherwise(F.lit(1.0))
    return one.groupBy("axis").agg(F.avg("v").alias("mu"), spread.alias("sigma"))


def _stats(library: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    rows = sorted(axis_stats(library).collect(), key=lambda r: r.axis)
    return np.array([r.mu for r in rows]), np.array([r.sigma for r in rows])


#: Library rows compared at a time, few at first, and pairs whose distance is computed exactly at once.
CHUNKS, TOGETHER = (64, 256, 1024), 1 << 16


def legacy_best(state: DataFrame, packed: DataFrame, sigma: np.ndarray, centre: np.ndarray, sched: str, hold: int, near: float = 0.3, mid: float = 0.7, weights: np.ndarray | None = None) -> DataFrame:
    """(walk_id, kind, id, d): a task's best row of the scheduled band (kind 0), else its nearest row at all (kind 1), by standardised distance.

    A matrix product gives every distance but for rounding; the distance proper, its band and whether the
    row was visited are only computed where a pair may be better than the walk's best so far.
    """
    n = len(sigma)
    weights = np.ones(n) if weights is None else weights
    scale = np.sqrt(np.abs(weights)) / sigma / np.sqrt(n)
    # a negative weight is no distance: every pair is computed
    bounded = bool((weights >= 0).all())
    reach = {"Near": near, "Mid": mid}.get(sched, np.inf)

    def start(q: pa.Table) -> dict:
        lists, a = q.column("visited").to_pylist(), blocks.rows_of(q.column("vector"))
        longest = max(map(len, lists), default=0)
        z = (a - centre) * scale
        norm = (z * z).sum(axis=1)
        return {
            "a": a,
            "z": np.hstack([-2 * z, norm[:, None], np.ones((len(z), 1))]),
            "norm": norm,
            "visited": np.array([v + v[-1:] * (longest - len(v)) for v in lists], np.int64).reshape(len(lists), longest),
            "d": np.full((2, q.num_rows), np.inf),
            "id": np.full((2, q.num_rows), np.iinfo(np.int64).max),
        }

    def look(s: dict, b: np.ndarray, ids: np.ndarray, r: np.ndarray, c: np.ndarray) -> None:
        d, other, raw = _legacy(((s["a"][r, k], b[c, k]) for k in range(n)), sigma, hold, weights)
        open_ = (s["visited"][r] != ids[c][:, None]).all(axis=1)
        band = (d > 0) & (d <= near) if sched == "Near" else (d > near) & (d <= mid) if sched == "Mid" else (other > mid) & (raw <= near)
        for kind, ok in ((0, open_ & band), (1, open_)):
            hit = np.flatnonzero(ok & np.isfinite(d))
            hit = hit[np.lexsort((ids[c[hit]], d[hit], r[hit]))]
            hit = hit[np.r_[True, r[hit][1:] != r[hit][:-1]]] if len(hit) else hit
            w, v, i = r[hit], d[hit], ids[c[hit]]
            better = (v < s["d"][kind][w]) | ((v == s["d"][kind][w]) & (i < s["id"][kind][w]))
            s["d"][kind][w[better]], s["id"][kind][w[better]] = v[better], i[better]

    def add(s: dict, q: pa.Table, x: pa.Table) -> None:
        b, ids = blocks.rows_of(x.column("vector")), x.column("id").to_numpy()
        z = (b - centre) * scale
        norm = (z * z).sum(axis=1)
        z = np.hstack([z, np.ones((len(z), 1)), norm[:, None]])
        at = 0
        for size in (*CHUNKS, *[CHUNKS[-1]] * (len(b) // CHUNKS[-1] + 1)):
            part = slice(at, at + size)
            at += size
            if not len(ids[part]):
                break
            sq = s["z"] @ z[part].T
            off = 1e-12 + 1e-13 * (s["norm"] + norm[part].max())
            best, any_ = ((v + 1e-9) ** 2 + off for v in (np.minimum(s["d"][0], reach), s["d"][1]))
            # the nearest at all only counts where the band has nothing
            any_ = np.where(np.isfinite(s["d"][0]), -np.inf, any_)
            if not bounded:
                may = np.ones(sq.shape, bool)
            elif sched in ("Near", "Mid"):
                may = ~(sq > np.maximum(best, any_)[:, None])
            else:
                may = ~(sq > best[:, None]) & ~(np.abs(s["a"][:, hold][:, None] - b[part, hold][None, :]) > near)
                may |= ~(sq > any_[:, None])
            flat = np.flatnonzero(may)
            for k in range(0, len(flat), TOGETHER):
                look(s, b[part], ids[part], *np.divmod(flat[k : k + TOGETHER], sq.shape[1]))

    def end(s: dict, q: pa.Table) -> pa.Table:
        kind, r = np.nonzero(np.isfinite(s["d"]))
        return pa.table({"walk_id": q.column("walk_id").to_numpy()[r], "kind": kind.astype(np.int32), "id": s["id"][kind, r], "d": s["d"][kind, r]})

    return blocks.tally(blocks.packed_queries(state), packed, start, add, end, "walk_id bigint, kind int, id bigint, d double")


def legacy_distances(a: np.ndarray, b: np.ndarray, sigma: np.ndarray, hold: int, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distance, distance with the candidate's hold axis set to 0, raw difference on the hold axis)."""
    return _legacy(((a[:, None, k], b[None, :, k]) for k in range(len(sigma))), sigma, hold, np.ones(len(sigma)) if weights is None else weights)


def _legacy(axes, sigma: np.ndarray, hold: int, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``legacy_distances`` of two sides that are given axis by axis."""
    total = parts = own = raw = None
    for k, (a, b) in enumerate(axes):
        sq = ((a - b) / sigma[k]) ** 2 * weights[k]
        if k == hold:
            parts, own, raw = sq.copy(), (a / sigma[k]) ** 2 * weights[k], np.abs(a - b)
        total = sq if total is None else np.add(total, sq, out=total)
    free = total - parts + own
    return np.round(np.sqrt(total / len(sigma)), 12), np.round(np.sqrt(np.maximum(free, 0) / len(sigma)), 12), raw


def legacy_walk(library: DataFrame, seeds: DataFrame, limit: int = 9, hold_axis: str = "tempo.bpm", schedule: tuple[str, ...] = ("Near", "Mid", "Far", "Mid", "Near"), actual_labels: bool = True, near: float = 0.3, mid: float = 0.7, weights: tuple[float, ...] = ()) -> DataFrame:
    """ENTRY rows of the standardised-Euclidean walk. ``actual_labels``: a fallback is named by its distance, else as scheduled.

    ``near`` and ``mid`` are the bands' greatest distances; an axis without a weight weighs 1.
    """
    if hold_axis not in C.AXIS_NAMES:
        raise ValueError(f"unknown axis {hold_axis!r}")
    slim = durable(library.select("id", "vector"))
    packed = blocks.packed_library(slim)
    mean, sigma = _stats(slim)
    weight = np.array([*weights, *[1.0] * len(sigma)])[: len(sigma)]
    state = durable(seeds.select("walk_id", "id").join(slim, "id").select("walk_id", "vector", F.array("id").alias("visited")))
    out = None
    for step in range(limit):
        sched = schedule[step % len(schedule)]
        found = legacy_best(state, packed, sigma, mean, sched, C.AXIS_NAMES.index(hold_axis), near, mid, weight)
        best = found.groupBy("walk_id").agg(F.min(F.struct("kind", "d", "id")).alias("b"))
        d = F.col("b.d")
        actual = F.when(d <= near, "Near").when(d <= mid, "Mid").otherwise("Far")
        hit = F.col("b.kind") == 0
        band = F.when(hit | F.lit(not actual_labels), F.lit(sched)).otherwise(actual)
        reason = F.when(hit, F.lit(f"{sched} band transition from seed")).otherwise(F.concat(F.lit(f"Fallback: scheduled {sched} empty, global-nearest (actual "), actual, F.lit(") from seed")))
        chosen = durable(best.select("walk_id", F.col("b.id").alias("id"), band.alias("band"), F.round(d, 4).alias("distance"), reason.alias("reason")))
        rows = chosen.select("walk_id", F.lit(step + 1).alias("position"), "id", "band", "distance", "reason")
        out = rows if out is None else out.unionByName(rows)
        state = durable(chosen.select("walk_id", "id").join(slim, "id").join(state.select("walk_id", "visited"), "walk_id").select("walk_id", "vector", F.array_append("visited", F.col("id")).alias("visited")))
    return out if out is not None else library.sparkSession.createDataFrame([], ENTRY)
