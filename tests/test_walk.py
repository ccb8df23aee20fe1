"""Walks against an independent model in plain Python."""

import json
import math
import random

import pytest

from crateflow.operators import library, metrics, similarity
from crateflow.operators.walk import Sampler, clap_walk, legacy_walk

KEYS = ["C", "G", "D", "A", "E", "B", "F#", "Db", "Ab", "Eb", "Bb", "F"]
SCHEMA = "id bigint, file_path string, title string, artist string, duration_sec double, feature_json string, clap_embedding array<float>"


def row(i, vector, bpm=120.0, key="C", mode="major", mood=None):
    sidecar = {"tempo": {"bpm": bpm}, "key": {"key": key, "mode": mode}}
    if mood is not None:
        sidecar["mood"] = mood
    return (i, f"/m/{i}.mp3", f"t{i}", "a", 100.0, json.dumps(sidecar), vector)


def run(spark, rows, limit, seeds=(1,), **kw):
    lib = library.load(spark.createDataFrame(rows, SCHEMA), dim=2)
    out = clap_walk(lib, spark.createDataFrame([(s, s) for s in seeds], "walk_id bigint, id bigint"), limit, Sampler(**kw))
    return sorted(map(tuple, out.collect()))


def test_mood_box_prefers_the_one_that_passes(spark):
    rows = [row(1, [1.0, 0.0], mood={"sad": 0.9}), row(2, [0.5, 0.5], mood={"sad": 0.9}), row(3, [1.0, 0.1], mood={"sad": 0.0})]
    got = run(spark, rows, 1, mood_box={"mood.sad": {"min": 0.5}})
    assert [(r[2], r[3]) for r in got] == [(2, "Near")]


def test_missing_embeddings_end_a_walk(spark):
    assert run(spark, [row(1, [1.0, 0.0]), row(2, None), row(3, [])], 2) == []
    assert run(spark, [row(1, None), row(2, [1.0, 0.0])], 2) == []


def test_small_library_keeps_the_scheduled_label(spark):
    got = run(spark, [row(1, [1.0, 0.0]), row(2, [0.0, 1.0]), row(3, [1.0, 0.1])], 1, band_schedule=("Far",))
    assert got[0][2:4] == (3, "Far") and got[0][5].startswith("Small library (n=2<20)")


def test_fallback_when_gates_are_empty(spark):
    got = run(spark, [row(1, [1.0, 0.0], bpm=100.0), row(2, [1.0, 0.0], bpm=200.0, key="F#")], 1)
    assert got[0][2] == 2 and got[0][5] == "Fallback: gates empty, global-nearest-by-CLAP (sched Near)"


def test_drift(spark):
    rows = [row(1, [1.0, 0.0], 100.0), row(2, [1.0, 0.01], 105.0), row(3, [1.0, 0.02], 150.0)]
    assert [r[2] for r in run(spark, rows, 2, tempo_drift_per_step=0.5)] == [2, 3]


def model(rows, seed, limit, s):
    """The walk, one track at a time."""
    lib = {r[0]: (json.loads(r[5]), [float(x) for x in r[6]] if r[6] else None) for r in rows}

    def unit(v):
        n = math.sqrt(sum(x * x for x in v))
        return [x / n for x in v]

    def slot(k):
        i = KEYS.index(k["key"])
        return 2 * i if k["mode"] == "major" else (2 * i - 6) % 24 + 1

    def passes(mood, box):
        return not box or (mood is not None and all(a in mood and b.get("min", -9) <= mood[a] <= b.get("max", 9) for a, b in box.items()))

    visited, now, out = {seed}, seed, []
    for step in range(limit):
        sched = s.band_schedule[step % len(s.band_schedule)]
        cand = [i for i in sorted(lib) if i not in visited and lib[i][1]]
        kept, level = [], 0
        if lib[now][1] is None or not cand:
            break
        sim = {i: round(sum(x * y for x, y in zip(unit(lib[now][1]), unit(lib[i][1]))), 12) for i in cand}
        for level, box in enumerate(s.boxes()):
            kept = []
            for i in cand:
                d = abs(slot(lib[now][0]["key"]) - slot(lib[i][0]["key"])) % 24
                d = min(d, 24 - d)
                a, b = lib[now][0]["tempo"]["bpm"], lib[i][0]["tempo"]["bpm"]
                if d <= 4 and passes(lib[i][0].get("mood"), box) and not (a > 0 and b > 0 and abs(b - a) / a > 0.1):
                    kept.append((-sim[i], d > 2, i))
            if kept:
                break
        if not kept:
            best = min(cand, key=lambda i: (-sim[i], i))
            out.append((seed, step + 1, best, sched))
        else:
            kept.sort()
            n = len(kept)
            near, upto = math.ceil(n * 0.1), math.ceil(n * 0.4)
            bands = {"Near": kept[:near], "Mid": kept[near:upto], "Far": kept[upto:]}
            label = sched if n < 20 or bands[sched] else next(b for b in bands if bands[b])
            best = (kept if n < 20 else bands[label])[0][2]
            out.append((seed, step + 1, best, label))
        visited.add(best)
        now = best
    return out


def test_against_the_model(spark):
    rng = random.Random(4)
    rows = []
    for i in range(1, 301):
        vector = None if i % 29 == 0 else [rng.gauss(0, 1), rng.gauss(0, 1)]
        mood = None if i % 11 == 0 else {"sad": round(rng.random(), 2)}
        rows.append(row(i, vector, 0.0 if i % 17 == 0 else 90 + rng.random() * 20, rng.choice(KEYS[:5]), rng.choice(["major", "minor"]), mood))
    rows = [(*r[:6], None if r[6] is None else [float(__import__("numpy").float32(x)) for x in r[6]]) for r in rows]
    for kw in ({}, {"mood_box": {"sad": {"min": 0.97}}}):
        seeds = [3, 29, 40, 77, 180]
        got = [r[:4] for r in run(spark, rows, 5, seeds, **kw)]
        want = sorted(r for s in seeds for r in model(rows, s, 5, Sampler(**kw)))
        assert got == want
        assert all(len({r[2] for r in got if r[0] == s} | {s}) == 1 + sum(r[0] == s for r in got) for s in seeds)


def test_legacy_walk_labels(spark):
    rows = [(i, "/m", "t", "a", 1.0, json.dumps({"tempo": {"bpm": b}}), None) for i, b in ((1, 100.0), (2, 100.0), (3, 140.0))]
    lib = library.sidecars(spark.createDataFrame(rows, SCHEMA))
    seeds = spark.createDataFrame([(1, 1)], "walk_id bigint, id bigint")
    got = sorted(map(tuple, legacy_walk(lib, seeds, 3).collect()))
    # a copy at distance 0 is in no band
    assert [(r[2], r[3]) for r in got] == [(2, "Near"), (3, "Mid")] and got[1][5] == "Mid band transition from seed"
    assert got[0][5] == "Fallback: scheduled Near empty, global-nearest (actual Near) from seed"
    with pytest.raises(ValueError):
        legacy_walk(lib, seeds, 1, hold_axis="nothing")


def test_spearman_and_agreement(spark):
    df = spark.createDataFrame([(float(i), float(i * i), -float(i), 1.0) for i in range(10)], "a double, b double, c double, k double")
    assert metrics.spearman(df, "a", "b").first().rho == pytest.approx(1) and metrics.spearman(df, "a", "c").first().rho == pytest.approx(-1) and metrics.spearman(df, "a", "k").first().rho == 0.0
    pairs = spark.createDataFrame([(1, 2, 0.1, 0.3), (1, 3, 0.2, 0.1), (2, 1, 0.1, 0.1), (2, 3, 0.5, 0.5)], "query_id bigint, id bigint, x double, y double")
    r = metrics.nn_agreement(pairs, "x", "y").first()
    assert (r.n, r.exact_match) == (2, 0.5) and r.top3_overlap == pytest.approx(2 / 3)


def test_ties_share_ranks(spark):
    from crateflow.operators.blocks import at_positions, ordered_ranks

    df = spark.createDataFrame([(v,) for v in (5.0, 1.0, 5.0, 2.0)], "v double")
    assert sorted((r.v, r.r) for r in ordered_ranks(df, "v", "r").collect()) == [(1.0, 1.0), (2.0, 2.0), (5.0, 3.5), (5.0, 3.5)]
    assert at_positions(df, "v", [0, 1, 3]) == [1.0, 2.0, 5.0]


def test_adherence(spark):
    lib = spark.createDataFrame([(1, 0, 100.0), (2, 0, 104.0), (3, 12, 105.0)], "id bigint, slot int, bpm double")
    e = spark.createDataFrame([(1, 1, 2), (1, 2, 3)], "walk_id bigint, position int, id bigint")
    seeds = spark.createDataFrame([(1, 1)], "walk_id bigint, id bigint")
    r = metrics.adherence(metrics.anchor_flags(e, lib, seeds)).first()
    assert (r.mood, r.key, r.tempo, r.key_violations) == (1.0, 0.5, 1.0, 1)
    assert metrics.adherence(metrics.anchor_flags(e.limit(0), lib, seeds)).first().key == 1.0


def test_top_k_skips_itself(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, None)], "id bigint, unit array<double>")
    got = sorted((r.query_id, r.id) for r in similarity.top_k(df, df, 1).collect())
    assert got == [(1, 2), (2, 1), (3, 1)]


def test_seeds(spark):
    df = spark.createDataFrame([(1, "Blue"), (2, "Blue sky"), (3, None)], "id bigint, title string")
    assert library.seed_by_title(df, "SKY") == 2 and library.default_seed(df) == 3
    for wanted in ("blue", "nothing"):
        with pytest.raises(LookupError):
            library.seed_by_title(df, wanted)


def test_empty_library(spark):
    lib = library.load(spark.createDataFrame([], SCHEMA), dim=2)
    assert clap_walk(lib, spark.createDataFrame([], "walk_id bigint, id bigint"), 1).count() == 0
    assert library.coverage(spark.createDataFrame([], SCHEMA)).first().clap_coverage == 0.0
