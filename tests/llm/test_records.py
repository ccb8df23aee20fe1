import itertools
import unicodedata

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from crateflow.llm import format_duplicates as D
from crateflow.llm import quantiles as Q

SCHEMA = "id bigint, title string, artist string, duration_sec double, key string, h int, maybe string"


def records(spark, rows):
    return spark.createDataFrame([(*r, "k", 1, "m") for r in rows], SCHEMA)


ROWS = [
    (1, "Été Bleu", "The  Band", 200.0),
    (2, "the band", "ÉTÉ-BLEU", 200.001),
    (3, unicodedata.normalize("NFD", "été bleu"), "the_band!", 199.999),
    (4, "Ete Bleu", "The Band", 200.0),
    (5, "Été Bleu", "The Band", 200.02),
    (6, None, "x", 10.0),
    (7, None, "x", 10.0),
    (8, "...", "x", 10.0),
    (9, "a", "b", None),
    (10, "a", "b", 0.0),
    (11, "a", "b", float("nan")),
    (12, "x" * 50_000, "y", 5.0),
    (13, "X" * 50_000 + ".", "Y", 5.0),
]


def test_duplicates(spark):
    df = records(spark, ROWS)
    assert {tuple(r) for r in D.pairs(df).collect()} == {(1, 2), (1, 3), (2, 3), (12, 13)}
    groups = {r.id: r.copies for r in D.groups(df).collect()}
    assert groups == {1: 3, 4: 1, 5: 1, 6: 1, 7: 1, 8: 1, 9: 1, 10: 1, 11: 1, 12: 2}


def test_duplicates_of_nothing_and_of_repeated_rows(spark):
    assert D.pairs(records(spark, [])).count() == 0 and D.groups(records(spark, [])).count() == 0
    df = records(spark, ROWS[:1])
    assert [tuple(r) for r in D.groups(df.union(df)).collect()] == [(1, 2)] and D.pairs(df.union(df)).count() == 0


def test_filter_has_no_false_negatives(spark):
    rows = [(i, f"t{i % 3000}", "a", 1.0) for i in range(5000)]
    marked = D.marked(records(spark, rows).repartition(7)).collect()
    assert all(r.maybe for r in marked if int(r.key.split("\x1f")[1][1:]) < 2000)
    assert sum(r.maybe for r in marked) < 4200


def test_a_hot_group(spark):
    rows = [(i, "same", "artist", 3.0) for i in range(300)] + [(1000 + i, f"other {i}", "artist", 3.0) for i in range(600)]
    assert {r.id: r.copies for r in D.groups(records(spark, rows)).collect()}[0] == 300


def digest(spark, values, k=Q.K):
    df = spark.createDataFrame(list(enumerate(values)), "id bigint, value double").selectExpr("'g' as g", "value", "id as node")
    return df, Q.digest(df.repartition(5), ["g"], k=k)


def test_bounds_hold_and_exact_is_exact(spark):
    rng = np.random.default_rng(0)
    values = [float(x) for x in np.concatenate([rng.lognormal(3, 1, 4000), np.zeros(300), -rng.lognormal(1, 1, 700)])] + [None, float("nan")]
    ordered = sorted(v for v in values if v is not None and v == v)
    df, dg = digest(spark, values, k=240)
    assert dg.count() <= 3 * 240 + 24
    for r in Q.quantiles(dg, ["g"], (1.0, 50.0, 99.0)).collect():
        truth = ordered[int(np.ceil(len(ordered) * r.q / 100)) - 1]
        assert np.float32(r.low) <= np.float32(truth) <= np.float32(r.high) and r.total == len(ordered)
        lo, hi = np.searchsorted(np.float32(ordered), np.float32(r.low)), np.searchsorted(np.float32(ordered), np.float32(r.high), "right")
        assert hi - lo <= 2 * Q.BITS / 240 * len(ordered) + 350
    exact = {r.q: r.exact for r in Q.exact(df, Q.quantiles(dg, ["g"], (1.0, 50.0, 99.0)), ["g"]).collect()}
    assert exact == {q: ordered[int(np.ceil(len(ordered) * q / 100)) - 1] for q in (1.0, 50.0, 99.0)}


def test_merging_days(spark):
    _, a = digest(spark, [float(x) for x in range(500)])
    _, b = digest(spark, [float(x) for x in range(500, 1000)])
    r = Q.quantiles(Q.merge(a.union(b), ["g"]), ["g"], (50.0,)).first()
    assert r.total == 1000 and r.low <= 499 <= r.high


def test_no_values(spark):
    df, dg = digest(spark, [None])
    assert dg.count() == 0 and Q.exact(df, Q.quantiles(dg, ["g"], (1.0,)), ["g"]).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.floats(allow_nan=False, width=32), min_size=1, max_size=200))
def test_quantise_keeps_the_order(values):
    v = np.array(sorted(values))
    cells = Q.quantise(v)
    assert (np.diff(cells) >= 0).all() and (cells >= 0).all() and (cells < 1 << Q.BITS).all()
    with np.errstate(invalid="ignore"):
        low, high = Q.bounds(cells)
    ok = np.isfinite(v)
    assert ((low <= v.astype(np.float32)) & (v.astype(np.float32) <= high))[ok].all()


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, 5000), min_size=1, max_size=400), st.integers(2, 60))
def test_compress_keeps_counts(cells, k):
    nodes, counts = np.unique(np.array(cells) + (1 << Q.BITS), return_counts=True)
    small, c = Q.compress(nodes, counts, len(cells), k)
    assert c.sum() == len(cells) and len(small) == len(set(small.tolist())) and (small >= 1).all()


def test_canonical_text_without_letters():
    assert D.canonical_key("!", "a", 1.0) is None and D.canonical_key("a", "b", -1.0) is None
    assert len({D.canonical_key(a, b, 1.5) for a, b in itertools.permutations(("One", "two"))}) == 1


def test_rounding():
    assert D.canonical_key("a", "b", 219.550000001) == D.canonical_key("a", "b", 219.55)
    assert pytest.approx(1) == 1


def test_a_filter_larger_than_a_slice_and_chunks_smaller_than_a_partition(spark, monkeypatch):
    from crateflow.llm import format_duplicates as D

    monkeypatch.setattr(D, "BITS_PER_ROW", 1 << 14)
    rows = [(i, f"Song {i % 700}", "Some One", 10.0) for i in range(1000)] + [(5000 + i, "hot song!", "some ONE", 10.0) for i in range(500)] + [(9000, None, "x", 1.0)]
    df = spark.createDataFrame(rows, "id bigint, title string, artist string, duration_sec double")
    keys = D.keyed(df).repartition(3).cache()
    assert D._blocks(len(rows)) > 8
    want = {r.h for r in keys.groupBy("h").count().where("count > 1 and h is not null").collect()}
    for most, chunk in ((1, 50), (4000, 200), (1 << 30, 1 << 20)):
        got = D.possible_repeats(keys, len(rows), most, chunk).collect()
        assert sorted(r.id for r in got) == sorted(r[0] for r in rows)
        found = {r.h for r in got if r.maybe}
        assert want <= found and len(found) < len(want) + 20
    assert D.slices([(3, 5), (7, 5), (8, 20)], 10, 10) == [(0, 8), (8, 10)] and D.slices([], 4, 10) == [(0, 4)]
