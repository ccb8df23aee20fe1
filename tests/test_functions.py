import math

import pytest
from pyspark.sql import functions as F

from crateflow.functions import columns as C
from crateflow.operators.walk import Sampler, band_starts


def one(spark, *columns):
    return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


def vec(*x):
    return F.array(*[F.lit(float(v)) for v in x])


def test_vectors(spark):
    got = one(
        spark,
        C.cosine_similarity(vec(1, 0), vec(2, 0)),
        C.cosine_distance(vec(1, 0), vec(0, 1)),
        C.cosine_distance(vec(0, 0), vec(0, 0)),
        C.cosine_distance(vec(0, 0), vec(1, 0)),
        C.l2_normalize(vec(0, 0)),
        C.weighted_distance(vec(1, 2), vec(1, 4), [1.0, 2.0]),
        C.weighted_distance(vec(1, 2), F.lit(None).cast("array<double>"), [1.0, 2.0]),
    )
    assert got[:5] == (1.0, 1.0, 0.0, 1.0, [0.0, 0.0])
    assert got[5] == pytest.approx(math.sqrt(0.5)) and got[6] == math.inf


def test_length_mismatch_is_an_error(spark):
    with pytest.raises(Exception, match="one length"):
        one(spark, C.cosine_similarity(vec(1), vec(1, 2)))


def slot(spark, key, mode=None, scale=None):
    return one(spark, C.key_slot(F.lit(key).cast("string"), F.lit(mode).cast("string"), F.lit(scale).cast("string")))[0]


def test_keys(spark):
    assert slot(spark, "C", "major") == 0 and slot(spark, "A", "minor") == 1 and slot(spark, "c#", "major") == 14
    assert slot(spark, "A", None, "A minor") == 1 and slot(spark, "X", "major") is None and slot(spark, "C", "dorian", "C major") is None
    steps = [one(spark, C.key_steps(F.lit(a).cast("int"), F.lit(b).cast("int")))[0] for a, b in ((0, 1), (0, 12), (0, 4), (0, None))]
    assert steps == [1, 12, 4, None]
    assert [one(spark, C.key_verdict(F.lit(s).cast("int")))[0] for s in (1, 4, 12, None)] == ["allow", "penalise", "block", "allow"]
    assert one(spark, *C.key_to_circle(F.lit(None).cast("int"))) == (0.0, 0.0)


def test_tempo_and_mood(spark):
    assert one(spark, C.tempo_ok(F.lit(120.0), F.lit(126.0)), C.tempo_ok(F.lit(120.0), F.lit(150.0)), C.tempo_ok(F.lit(0.0), F.lit(1.0))) == (True, False, False)
    axis = {"sad": F.lit(0.5), "happy": F.lit(None).cast("double")}
    assert one(spark, C.mood_passes(axis, {"mood.sad": {"min": 0.5, "max": 0.5}}), C.mood_passes(axis, {"happy": {"min": 0.0}})) == (True, False)


def test_relaxing_adds_up_as_floats_do():
    box = {"sad": {"min": 0.5, "max": 0.95}}
    twice = C.relax_mood_box(C.relax_mood_box(C.relax_mood_box(box)))
    assert twice["sad"]["min"] == 0.5 - 0.1 - 0.1 - 0.1 and twice["sad"]["max"] == 1.0


def test_bands_of_ten(spark):
    s = band_starts(F.lit(10), 0.10, 0.40)
    assert one(spark, s["Near"], s["Mid"], s["Far"]) == (1, 2, 5)


def test_sampler_ignores_unknown_settings():
    assert Sampler.from_dict({"near_quantile": 0.2, "nonsense": 1}).near_quantile == 0.2 and len(Sampler(mood_box={"sad": {"min": 1}}).boxes()) == 4


def test_stale(spark):
    rows = [(None, None, None), ("{}", "0.0", None), ("{}", "1.1", "other"), ("{}", "1.1", None), ("{}", "1.1", C.SCHEMA_HASH)]
    df = spark.createDataFrame(rows, "j string, v string, h string")
    assert [r[0] for r in df.select(C.is_stale(F.col("j"), F.col("v"), F.col("h"), "1.1", C.SCHEMA_HASH)).collect()] == [True, True, True, False, False]
