import json

import pytest

from crateflow import cli

SCHEMA = "id bigint, file_path string, title string, artist string, duration_sec double, feature_json string, clap_embedding array<float>"


@pytest.fixture(scope="module")
def lib(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("lib") / "tracks.parquet")
    rows = [(i, f"/m/{i}.mp3", f"Song {i}", None, 60.0 + i, '{"tempo": {"bpm": %d}, "key": {"key": "C", "mode": "major"}}' % (100 + i), [1.0, i / 10]) for i in range(1, 7)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(path)
    return path


@pytest.mark.parametrize("sampler", ["clap", "essentia"])
def test_generate_and_export(spark, lib, tmp_path, sampler):
    out = tmp_path / "p.json"
    assert cli.main(["generate", lib, "--dim", "2", "--seed-title", "song 3", "--limit", "2", "--sampler", sampler, "--output", str(out), "--summary", str(tmp_path / "s.txt"), "--export", "m3u"], spark) == 0
    doc = json.loads(out.read_text())
    assert doc["seed"]["id"] == 3 and [e["position"] for e in doc["playlist"]] == [1, 2] and doc["playlist"][0]["id"] in (2, 4)
    report = (tmp_path / "s.txt").read_text().split("\n")
    assert len(report) == 7 + 3 * 8 + 1 and report[1] == "PLAYLIST SUMMARY" and report[4].endswith("(3 tracks)") and report[7:9] == ["0. id=3 | SEED", "   'Song 3' - Unknown"]
    assert report[9:11] == ["   Duration: 0.0s | Loudness: 0.0 LUFS (range 0.0)", "   Tempo: 103 BPM (conf 0.00) | Key: N/A"]
    assert (tmp_path / "p.m3u").read_text().count("#EXTINF") == 3
    assert cli.main(["export", lib, str(out), "--format", "pls"], spark) == 0 and (tmp_path / "p.pls").exists()


def test_evaluate(spark, lib, capsys):
    assert cli.main(["evaluate", lib, "--dim", "2", "--seed-id", "1", "--limit", "2"], spark) == 0
    lines = [json.loads(x) for x in capsys.readouterr().out.splitlines()]
    assert [x.get("sampler") for x in lines] == ["essentia", "clap", None, None] and lines[2]["pool"] == 5 and lines[2]["spearman"] == 1.0 and lines[3]["overlap"] <= 2


@pytest.mark.parametrize(("more", "status"), [(["--hold-axis", "x"], 2), (["--limit", "0"], 2), (["--seed-id", "99"], 1), (["--seed-title", "song"], 1), (["--dim", "3"], 1)])
def test_faults(spark, lib, tmp_path, more, status):
    assert cli.main(["generate", lib, "--dim", "2", "--output", str(tmp_path / "p.json"), *more], spark) == status


PLUG = """
from crateflow.operators.extractors import Tools

def tools():
    return Tools(lambda path: (path.rsplit("/", 1)[-1], None), lambda path: {"version": "1.1", "tempo": {"bpm": 100}}, None, lambda path: [1.0, float(len(path))])
"""


def test_run_takes_in_and_generates(spark, tmp_path, monkeypatch):
    (tmp_path / "plugged_tools.py").write_text(PLUG)
    monkeypatch.syspath_prepend(str(tmp_path))
    spark.sparkContext.addPyFile(str(tmp_path / "plugged_tools.py"))
    for n in "abc":
        (tmp_path / "m" / n).mkdir(parents=True)
        (tmp_path / "m" / n / "x.mp3").write_bytes(b"x")
    out = tmp_path / "p.json"
    more = ["--extractor", "plugged_tools:tools", "--tools", "--clap", "--no-mood", "--dim", "2", "--generate-playlist", "--seed-id", "1", "--limit", "2", "--output", str(out)]
    assert cli.main(["run", str(tmp_path / "lib"), str(tmp_path / "m"), *more], spark) == 0
    assert len(json.loads(out.read_text())["playlist"]) == 2
    assert cli.main(["run", str(tmp_path / "lib"), str(tmp_path / "none"), *more], spark) == 2
