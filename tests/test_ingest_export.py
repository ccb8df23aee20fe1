import json
import sys
from pathlib import Path

import pandas as pd
import pytest

from crateflow.operators import export, extractors, ingest
from crateflow.streaming import watch


def make_extractor():
    # nested, so that workers get it by value
    def extractor(batches):
        for pdf in batches:
            bad = pdf["file_path"].str.contains("bad")
            ok = pd.Series(['{"version": "1.1"}'] * len(pdf), index=pdf.index)
            yield pd.DataFrame({"file_path": pdf["file_path"], "title": "T", "artist": None, "duration_sec": 9.5, "feature_json": ok.where(~bad), "clap_embedding": [[1.0, 2.0]] * len(pdf), "error": pd.Series("no", index=pdf.index).where(bad)})

    return extractor


extractor = make_extractor()
OPTIONS = ingest.Options(with_embedding=True, dim=2)


def files(folder: Path, *names):
    for n in names:
        (folder / n).parent.mkdir(parents=True, exist_ok=True)
        (folder / n).write_bytes(b"x")


def test_ingest_is_incremental(spark, tmp_path):
    music, lib = tmp_path / "music", str(tmp_path / "lib")
    files(music, "a.MP3", "sub/b.flac", "bad.ogg", "notes.txt")
    first = {Path(r.file_path).name: r.status for r in ingest.run(spark, str(music), lib, extractor, OPTIONS).collect()}
    assert first == {"a.MP3": "processed", "b.flac": "processed", "bad.ogg": "failed"}
    files(music, "c.wav")
    second = {Path(r.file_path).name: r.status for r in ingest.run(spark, str(music), lib, extractor, OPTIONS).collect()}
    assert second == {"a.MP3": "skipped", "b.flac": "skipped", "bad.ogg": "failed", "c.wav": "processed"}
    rows = ingest.read(spark, lib).orderBy("id").collect()
    assert [r.id for r in rows] == [1, 2, 3, 4] and Path(rows[3].file_path).name == "c.wav"
    assert [r.feature_json is None for r in rows] == ["bad" in r.file_path for r in rows]


def test_forced_and_missing_mood(spark):
    t = spark.createDataFrame([(1, "/a.mp3", '{"version":"1.1"}', [1.0, 2.0]), (2, "/b.mp3", "{bad", None)], "id bigint, file_path string, feature_json string, clap_embedding array<float>")
    f = t.select("file_path")

    def actions(**kw):
        return {r.file_path: (r.action, r.needs_embedding) for r in ingest.classify(f, t, ingest.Options(**kw)).collect()}

    assert actions() == {"/a.mp3": ("skip", False), "/b.mp3": ("re-extract", False)}
    assert actions(force=True, with_embedding=True)["/a.mp3"] == ("re-extract", True)
    assert actions(retry_missing_mood=True)["/a.mp3"][0] == "re-extract"
    assert actions(with_embedding=True) == {"/a.mp3": ("skip", False), "/b.mp3": ("re-extract", True)}


def test_watch(spark, tmp_path):
    music, lib = tmp_path / "m", str(tmp_path / "l")
    files(music, "a.mp3")
    for _ in range(2):
        watch.watch(spark, str(music), lib, str(tmp_path / "c"), extractor, OPTIONS, once=True).awaitTermination()
        files(music, "b.mp3")
    assert sorted(Path(r.file_path).name for r in ingest.read(spark, lib).collect()) == ["a.mp3", "b.mp3"]


def counting(folder):
    # a file per call: workers share nothing else
    def extractor(batches):
        import uuid

        for pdf in batches:
            for f in pdf["file_path"]:
                Path(folder, uuid.uuid4().hex).write_text(f)
            yield pd.DataFrame({"file_path": pdf["file_path"], "title": None, "artist": None, "duration_sec": 1.0, "feature_json": '{"version": "1.1"}', "clap_embedding": None, "error": None})

    return extractor


def test_each_new_file_is_extracted_once(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    files(tmp_path / "m", *[f"{i}.mp3" for i in range(5)])
    ingest.run(spark, str(tmp_path / "m"), str(tmp_path / "l"), counting(str(calls))).collect()
    assert sorted(Path(p.read_text()).name for p in calls.iterdir()) == [f"{i}.mp3" for i in range(5)]


def test_a_crash_before_the_commit_loses_nothing(spark, tmp_path, monkeypatch):
    music, lib = tmp_path / "m", str(tmp_path / "l")
    files(music, "a.mp3", "b.mp3")
    ingest.run(spark, str(music), lib, extractor, OPTIONS).collect()
    files(music, "c.mp3")

    def crash(*_):
        raise OSError("killed")

    with monkeypatch.context() as m:
        m.setattr(ingest, "_commit", crash)
        with pytest.raises(OSError):
            ingest.run(spark, str(music), lib, extractor, OPTIONS)
    assert ingest.read(spark, lib).count() == 2
    ingest.init(spark, lib)
    assert ingest.read(spark, lib).count() == 2
    ingest.run(spark, str(music), lib, extractor, OPTIONS).collect()
    assert sorted((r.id, Path(r.file_path).name) for r in ingest.read(spark, lib).collect()) == [(1, "a.mp3"), (2, "b.mp3"), (3, "c.mp3")]


def test_deltas_are_compacted(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ingest, "COMPACT", 2)
    music, lib = tmp_path / "m", str(tmp_path / "l")
    for name in "abcd":
        files(music, f"{name}.mp3")
        ingest.run(spark, str(music), lib, extractor, OPTIONS).collect()
    assert [(n, k) for n, k, _ in ingest._folders(spark, lib)] == [(1, "v"), (2, "d"), (3, "d"), (4, "v"), (5, "d")]
    assert [r.id for r in ingest.read(spark, lib).orderBy("id").collect()] == [1, 2, 3, 4]


def make_tools():
    def load():
        import time

        from crateflow.operators.extractors import Tools

        def features(path):
            if "broken" in path:
                raise ValueError("cannot decode")
            if "slow" in path:
                time.sleep(30)
            return {"version": "1.1", "duration_sec": 12.5}

        def mood(path):
            if "moodless" in path:
                raise RuntimeError("no model")
            return {"sad": 0.5}

        def embedding(path):
            if "deaf" in path:
                raise RuntimeError("no sound")
            return [1.0, 2.0]

        return Tools(lambda path: ("T", None), features, mood, embedding)

    return load


def test_phases_fail_apart_and_files_apart(spark, tmp_path):
    music, lib = tmp_path / "m", str(tmp_path / "l")
    files(music, "ok.mp3", "broken.mp3", "slow.mp3", "moodless.mp3", "deaf.mp3")
    run = extractors.phased(make_tools(), extractors.Limits(dsp=1))
    status = {Path(r.file_path).stem: r.status for r in ingest.run(spark, str(music), lib, run, OPTIONS).collect()}
    assert status == {"ok": "processed", "broken": "failed", "slow": "failed", "moodless": "processed", "deaf": "failed"}
    rows = {Path(r.file_path).stem: r for r in ingest.read(spark, lib).collect()}
    assert json.loads(rows["ok"].feature_json)["mood"] == {"sad": 0.5} and rows["ok"].clap_embedding == [1.0, 2.0] and rows["ok"].duration_sec == 12.5
    assert "mood" not in json.loads(rows["moodless"].feature_json) and rows["broken"].feature_json is None and rows["slow"].feature_json is None
    assert rows["deaf"].feature_json and rows["deaf"].clap_embedding is None
    again = {Path(r.file_path).stem: r.action for r in ingest.classify(ingest.scan(spark, str(music)), ingest.read(spark, lib), ingest.Options(retry_missing_mood=True, dim=2)).collect()}
    assert again == {"ok": "skip", "broken": "re-extract", "slow": "re-extract", "moodless": "re-extract", "deaf": "skip"}


def test_limits(monkeypatch):
    for name, _ in extractors.LIMITS.values():
        monkeypatch.delenv(name, raising=False)
    assert [extractors.limit_of(p) for p in ("all", "dsp", "mood")] == [180, 60, 180]
    monkeypatch.setenv("EXTRACT_DSP_TIMEOUT_SEC", "90")
    assert extractors.limit_of("dsp") == 90 and extractors.limit_of("dsp", 5) == 5 and extractors.limit_of("dsp", 5, 7) == 7
    for bad in ("soon", " "):
        monkeypatch.setenv("EXTRACT_DSP_TIMEOUT_SEC", bad)
        assert extractors.limit_of("dsp") == 60
    with pytest.raises(ValueError):
        extractors.limit_of("lyrics")


def test_commands_and_manifests(spark, tmp_path):
    script = tmp_path / "x.py"
    script.write_text("import sys, json, pathlib\nif 'bad' in sys.argv[1]: sys.exit('cannot')\nif 'none' not in sys.argv[1]: pathlib.Path(sys.argv[2]).write_text(json.dumps({'at': sys.argv[1]}))")
    run = extractors.command([sys.executable, str(script)], 20)
    assert run("/a.mp3") == {"at": "/a.mp3"}
    for path, text in (("/bad.mp3", "cannot"), ("/none.mp3", "no output")):
        with pytest.raises(RuntimeError, match=text):
            run(path)
    m = spark.createDataFrame([("/a", "1"), ("/b", "2"), ("/c", "3")], "audio_path string, output_path string")
    x = spark.createDataFrame([("/a", None), ("/b", "no")], "file_path string, error string")
    assert {r.output_path: (r.ok, r.error) for r in extractors.manifest_summary(m, x).collect()} == {"1": (True, None), "2": (False, "no"), "3": (False, "not extracted")}


def test_log_activity(spark, tmp_path):
    rows = [(1, "failed", "2024-01-01 10:01:00"), (1, "failed", "2024-01-01 10:01:00"), (2, "processed", "2024-01-01 10:30:00"), (3, "processed", "2024-01-01 14:00:00")]
    df = spark.createDataFrame(rows, "log_id bigint, status string, t string").selectExpr("log_id", "status", "cast(t as timestamp) as logged_at")
    df.write.parquet(str(tmp_path / "in"))
    s = watch.log_activity(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    q = s.writeStream.format("memory").queryName("activity").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination()
    assert sorted((r.status, r.n) for r in spark.table("activity").collect()) == [("failed", 1), ("processed", 1), ("processed", 1)]


def tracks(spark):
    return spark.createDataFrame([(7, "/lib/x/s.mp3", "S", "A", 200.9), (43, "/lib/y.mp3", None, "", 185.6), (13, None, "T", None, 0.0)], "id bigint, file_path string, title string, artist string, duration_sec double")


def test_files(spark, tmp_path):
    doc = tmp_path / "p.json"
    doc.write_text(json.dumps({"seed": {"id": 7}, "playlist": [{"position": 2, "id": 13}, {"position": 1, "id": 43}]}))
    rows = export.load_ordered(spark, str(doc), tracks(spark))
    assert [r.id for r in rows] == [7, 43, 13]
    out = export.export(spark, str(tmp_path / "p"), rows, "all")
    assert [p.suffix for p in out] == [".m3u", ".pls"]
    m3u = out[0].read_text().splitlines()
    assert m3u[0] == "#EXTM3U" and m3u[1] == "#EXTINF:200,A - S" and m3u[3] == "#EXTINF:185,Unknown - Unknown" and m3u[5] == "#EXTINF:-1,Unknown - T" and m3u[2].endswith("lib/x/s.mp3") and m3u[2].startswith("..")
    pls = out[1].read_text().splitlines()
    assert pls[0] == "[playlist]" and pls[-2:] == ["NumberOfEntries=3", "Version=2"] and "Length3=-1" in pls
    with pytest.raises(ValueError):
        export.export(spark, str(tmp_path / "p"), rows, "mp3")
    doc.write_text(json.dumps({"seed": {"id": 999}, "playlist": []}))
    with pytest.raises(KeyError):
        export.load_ordered(spark, str(doc), tracks(spark))


def test_json(spark):
    e = spark.createDataFrame([(1, 2, 5, "f", "a\"b", None, "Near", 0.12345, None), (1, 1, 4, "g", None, "x", "Far", None, "r")], "playlist_id bigint, position int, id bigint, file string, title string, artist string, band string, distance double, reason string")
    seeds = spark.createDataFrame([(1, 7, "s", "t", None), (2, 8, None, None, None)], "playlist_id bigint, id bigint, file string, title string, artist string")
    got = {r.playlist_id: json.loads(r.json) for r in export.playlist_json(e, seeds).collect()}
    assert [x["id"] for x in got[1]["playlist"]] == [4, 5] and got[1]["playlist"][1] == {"position": 2, "id": 5, "file": "f", "title": 'a"b', "artist": "", "band": "Near", "distance": 0.1235, "reason": ""}
    assert got[2] == {"seed": {"id": 8, "file": "", "title": "", "artist": ""}, "playlist": []}
