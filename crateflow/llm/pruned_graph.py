"""A directed proximity graph with robust pruning, and beam search over it, for one shard in numpy.

Searches run for a whole block of queries at a time: each step expands, for every query, its best
unexpanded candidate. Distances are taken between short random projections of the vectors; callers
rank the beam again with the full vectors.
"""

from __future__ import annotations

import numpy as np

DEGREE = 20
BEAM = 32
ALPHA = 1.2
PROJECTED = 64
BLOCK = 512


def project(unit: np.ndarray, dims: int = PROJECTED) -> np.ndarray:
    """A fixed Gaussian projection, scaled to unit length again."""
    if unit.shape[1] <= dims:
        return np.ascontiguousarray(unit, np.float32)
    rng = np.random.default_rng(7)
    short = unit @ rng.standard_normal((unit.shape[1], dims)).astype(np.float32)
    return (short / np.maximum(np.linalg.norm(short, axis=1), 1e-12)[:, None]).astype(np.float32)


def beam_search(points: np.ndarray, graph: np.ndarray, queries: np.ndarray, starts: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, similarities) of the beam of each query, -1 where it isn't full.

    ``starts``: one row of distinct entry nodes per query.
    """
    q, n = len(queries), len(points)
    rows = np.arange(q)
    ids = np.full((q, beam), -1, np.int32)
    sims = np.full((q, beam), -np.inf, np.float32)
    open_ = np.zeros((q, beam), bool)
    seen = np.zeros((q, n), bool)
    m = min(beam, starts.shape[1])
    ids[:, :m] = starts[:, :m]
    sims[:, :m] = np.einsum("bsd,bd->bs", points[starts[:, :m]], queries)
    open_[:, :m] = True
    np.put_along_axis(seen, starts[:, :m].astype(np.int64), True, axis=1)
    while len(rows):
        waiting = np.where(open_[rows], sims[rows], -np.inf)
        best = waiting.argmax(axis=1)
        top = waiting[np.arange(len(rows)), best]
        going = np.isfinite(top)
        rows, best = rows[going], best[going]
        if not len(rows):
            break
        open_[rows, best] = False
        near = graph[ids[rows, best]]
        new = near >= 0
        safe = np.where(new, near, 0)
        new &= ~seen[rows[:, None], safe]
        seen[rows[:, None], safe] |= new
        s = np.where(new, np.matmul(points[safe], queries[rows][:, :, None])[:, :, 0], -np.inf)
        all_s = np.concatenate([sims[rows], s], axis=1)
        keep = np.argpartition(-all_s, beam - 1, axis=1)[:, :beam]
        sims[rows] = np.take_along_axis(all_s, keep, axis=1)
        ids[rows] = np.take_along_axis(np.concatenate([ids[rows], np.where(new, near, -1)], axis=1), keep, axis=1)
        open_[rows] = np.take_along_axis(np.concatenate([open_[rows], new], axis=1), keep, axis=1)
    return ids, sims


def robust_prune(points: np.ndarray, own: np.ndarray, cand: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Up to ``degree`` diverse neighbours for each node of ``own`` out of its row of ``cand`` (-1: none).

    The nearest candidate is kept and every candidate that is ``alpha`` times nearer to it than to
    the node is dropped, until nothing is left.
    """
    out = np.full((len(own), degree), -1, np.int32)
    for at in range(0, len(own), BLOCK):
        o, c = own[at : at + BLOCK], np.sort(cand[at : at + BLOCK], axis=1)
        bad = (c < 0) | (c == o[:, None])
        bad[:, 1:] |= c[:, 1:] == c[:, :-1]
        v = points[np.where(bad, 0, c)]
        d = np.where(bad, np.inf, 2 - 2 * np.matmul(v, points[o][:, :, None])[:, :, 0])
        between = 2 - 2 * np.matmul(v, v.transpose(0, 2, 1))
        r = np.arange(len(o))
        for k in range(degree):
            best = d.argmin(axis=1)
            found = np.isfinite(d[r, best])
            if not found.any():
                break
            out[at + r[found], k] = c[r[found], best[found]]
            d[alpha * between[r, best] <= d] = np.inf
            d[r, best] = np.inf
    return out


def build(points: np.ndarray, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA) -> np.ndarray:
    """The graph (nodes x degree, -1 padded): random at first, then every node is searched for and relinked."""
    n = len(points)
    if n <= degree + 1:
        near = np.tile(np.arange(n, dtype=np.int32), (n, 1))
        near[np.arange(n), np.arange(n)] = -1
        return np.pad(near, ((0, 0), (0, max(0, degree - n))), constant_values=-1)[:, :max(degree, n)]
    rng = np.random.default_rng(11)
    graph = rng.integers(0, n, (n, degree), dtype=np.int32)
    graph[graph == np.arange(n)[:, None]] = -1
    order = rng.permutation(n)
    entry = np.unique(np.concatenate([[int((points @ points.mean(axis=0)).argmax())], rng.integers(0, n, 3)]))
    for factor, own in [(1.0, x) for x in np.array_split(order, max(2, n // 400))] + [(alpha, x) for x in np.array_split(order, max(2, n // 400))]:
        parts = []
        for at in range(0, len(own), BLOCK):
            o = own[at : at + BLOCK]
            starts = np.tile(entry, (len(o), 1))
            parts.append(beam_search(points, graph, points[o], starts, beam)[0])
        cand = np.concatenate([np.concatenate(parts), graph[own]], axis=1)
        graph[own] = robust_prune(points, own, cand, degree, factor)
        _link_back(points, graph, own, degree, factor)
    return graph


def _link_back(points: np.ndarray, graph: np.ndarray, own: np.ndarray, degree: int, alpha: float) -> None:
    """Give every new edge its reverse; nodes with too many edges are pruned again."""
    src, dst = np.repeat(own, graph.shape[1]).astype(np.int64), graph[own].ravel().astype(np.int64)
    src, dst = src[dst >= 0], dst[dst >= 0]
    there = (graph[dst] == src[:, None]).any(axis=1)
    src, dst = src[~there], dst[~there]
    if not len(src):
        return
    by = np.lexsort((-np.einsum("bd,bd->b", points[src], points[dst]), dst))
    src, dst = src[by], dst[by]
    target, start, count = np.unique(dst, return_index=True, return_counts=True)
    slot = np.arange(len(dst)) - np.repeat(start, count)
    fits = slot < 2 * degree
    extra = np.full((len(target), int(min(count.max(), 2 * degree))), -1, np.int32)
    extra[np.repeat(np.arange(len(target)), count)[fits], slot[fits]] = src[fits]
    cand = np.concatenate([graph[target], extra], axis=1)
    full = (cand >= 0).sum(axis=1) > degree
    if full.any():
        graph[target[full]] = robust_prune(points, target[full], cand[full], degree, alpha)
    few = cand[~full]
    if len(few):
        first = np.argsort(few < 0, axis=1, kind="stable")[:, :degree]
        graph[target[~full]] = np.take_along_axis(few, first, axis=1)
