import json

from pyspark.sql import functions as F

from crateflow.operators import schema_drift as S


def report(spark, sidecars):
    t = spark.createDataFrame([(i, j, 1) for i, j in enumerate(sidecars, 1)], "id bigint, feature_json string, batch_id bigint")
    log = t.select("batch_id", F.col("id").alias("track_id"), F.lit("processed").alias("status")).union(t.select("batch_id", F.col("id"), F.lit("failed")))
    schema = spark.createDataFrame([(f, k, f == "version") for f, k in S.FIELDS.items()], "field_path string, json_type string, required boolean")
    return sorted(tuple(r)[1:] for r in S.drift_report(t, log.union(log), schema).collect())


def test_each_kind(spark):
    got = report(spark, [json.dumps({"tempo": {"BPM": 120, "beats": [1]}, "mood": {"happy": {"p": 0.1}}, "key": None, "duration": 3.5, "x": {}})])
    assert got == [("duration_sec", "renamed", "duration"), ("mood.happy", "type", "mood.happy"), ("tempo.beats", "added", "tempo.beats"), ("tempo.bpm", "renamed", "tempo.BPM"), ("version", "removed", "")]


def test_old_path_beside_the_field_is_added(spark):
    got = report(spark, [json.dumps({"version": "1", "tempo": {"bpm": None, "conf": 1.0, "confidence": 2.0}})])
    assert got == [("tempo.conf", "added", "tempo.conf")]


def test_nothing_to_report(spark):
    assert report(spark, [None, "", "{}", "[1]", '{"version": "1', "3"]) == []
    assert report(spark, ['{"version": "1.1"}', '{"version": "1.1"}']) == []


def test_values(spark):
    rows = [
        {"tempo": {"bpm": "77,2 bpm"}, "duration_sec": "4:08"},
        {"tempo": 99.5, "key": "A minor"},
        {"rhythm": {"bpm": "88"}, "spectral": {"rolloff": [12.5]}},
        {"tempo": {"bpm": False}, "mood": {"happy": {"p": 0.3}}, "key": {"confidence": "low"}},
        {"tempo": {"bpm": "1,234.5"}, "moods": {"sad": 0.5}, "loudness": {"integrated": "-9.1 LUFS"}},
    ]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(rows)] + [(9, None), (10, "{bad")], "id bigint, feature_json string")
    got = {r.id: r for r in S.unify(df).collect()}
    assert [got[i].tempo__bpm for i in range(5)] == [77.2, 99.5, 88.0, None, 1234.5]
    assert got[0].duration_sec == 248 and got[1].key__scale == "A minor" and got[2].spectral__rolloff == 12.5 and got[3].mood__happy == 0.3 and got[3].key__confidence is None and got[4].mood__sad == 0.5 and got[4].loudness__integrated == -9.1
    assert got[9].tempo__bpm is None and got[10].version is None


def test_odd_names():
    assert S.parse_fingerprint("OBJECT<`a b: c`: NUMBER, d: ARRAY<OBJECT<x: STRING>>>") == {"a b: c": "NUMBER", "d": "ARRAY<OBJECT<x: STRING>>"}
    assert S.migrate("Tempo.Bpm") == "tempo.bpm" and S.migrate("nothing") == "nothing"
