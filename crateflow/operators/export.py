"""Playlists as JSON, M3U, PLS and text.

The lines are DataFrames, in order and with their playlist; only a single playlist's few lines are ever
gathered, to write its file.
"""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from crateflow.functions import columns as C


def display_title(artist: Column, title: Column) -> Column:
    return F.concat(F.coalesce(F.nullif(artist, F.lit("")), F.lit("Unknown")), F.lit(" - "), F.coalesce(F.nullif(title, F.lit("")), F.lit("Unknown")))


def whole_seconds(duration: Column) -> Column:
    """Seconds cut off towards zero; -1 for null or nothing."""
    return F.when(duration.isNotNull() & (duration > 0), F.floor(duration).cast("bigint")).otherwise(F.lit(-1))


def relative(path: str | None, base: str) -> str:
    if not path:
        return ""
    try:
        return os.path.relpath(path, base)
    except ValueError:
        return os.path.abspath(path)


def relative_to(path: Column, base: str) -> Column:
    """``relative`` for POSIX paths, inside the JVM."""
    parts, root = F.filter(F.split(path, "/"), lambda p: p != ""), [p for p in os.path.abspath(base).split("/") if p]
    same = F.lit(0)
    for k in reversed(range(len(root))):
        same = F.when(F.get(parts, F.lit(k)).eqNullSafe(F.lit(root[k])), F.lit(1) + same).otherwise(0)
    up = F.array_repeat(F.lit(".."), F.lit(len(root)) - same)
    return F.when(path.isNull() | (path == ""), "").otherwise(F.array_join(F.concat(up, F.slice(parts, same + 1, F.greatest(F.size(parts) - same, F.lit(0)))), "/"))


def m3u_lines(tracks: DataFrame, base: str, key: str = "playlist_id") -> DataFrame:
    """(key, line_no, line); ``tracks``: key, position, file_path, title, artist, duration_sec."""
    info = F.concat(F.lit("#EXTINF:"), whole_seconds(F.col("duration_sec")).cast("string"), F.lit(","), display_title(F.col("artist"), F.col("title")))
    n = F.row_number().over(W.partitionBy(key).orderBy("position"))
    rows = tracks.select(key, n.alias("n"), F.array(info, relative_to(F.col("file_path"), base)).alias("l"))
    body = rows.select(key, "n", F.posexplode("l").alias("k", "line")).select(key, (2 * F.col("n") + F.col("k")).cast("int").alias("line_no"), "line")
    return body.unionByName(tracks.select(key).distinct().select(key, F.lit(1).alias("line_no"), F.lit("#EXTM3U").alias("line")))


def pls_lines(tracks: DataFrame, base: str, key: str = "playlist_id") -> DataFrame:
    """(key, line_no, line), as ``m3u_lines``."""
    n = F.row_number().over(W.partitionBy(key).orderBy("position"))
    rows = tracks.select("*", n.alias("n"))
    no = F.col("n").cast("string")
    three = F.array(
        F.concat(F.lit("File"), no, F.lit("="), relative_to(F.col("file_path"), base)),
        F.concat(F.lit("Title"), no, F.lit("="), display_title(F.col("artist"), F.col("title"))),
        F.concat(F.lit("Length"), no, F.lit("="), whole_seconds(F.col("duration_sec")).cast("string")),
    )
    body = rows.select(key, "n", F.posexplode(three).alias("k", "line")).select(key, (3 * F.col("n") - 1 + F.col("k")).cast("int").alias("line_no"), "line")
    ends = tracks.groupBy(key).agg(F.count("*").alias("c"))
    frame = ends.select(key, F.posexplode(F.array(F.lit("[playlist]"), F.concat(F.lit("NumberOfEntries="), F.col("c").cast("string")), F.lit("Version=2"))).alias("k", "line"), "c")
    return body.unionByName(frame.select(key, F.when(F.col("k") == 0, 1).otherwise(3 * F.col("c") + 1 + F.col("k")).cast("int").alias("line_no"), "line"))


def entry() -> Column:
    """One playlist entry of the JSON form; missing title, artist, file and reason are empty."""
    blank = {c: F.coalesce(c, F.lit("")).alias(c) for c in ("file", "title", "artist", "reason")}
    return F.struct(F.col("position").alias("position"), F.col("id").alias("id"), blank["file"], blank["title"], blank["artist"], F.col("band").alias("band"), F.round("distance", 4).alias("distance"), blank["reason"])


def playlist_json(entries: DataFrame, seeds: DataFrame, key: str = "playlist_id") -> DataFrame:
    """(key, json). ``entries``: key, position, id, file, title, artist, band, distance, reason; ``seeds``: key, id, file, title, artist."""
    lists = entries.select(key, entry().alias("e")).groupBy(key).agg(F.sort_array(F.collect_list("e")).alias("playlist"))
    seed = F.struct("id", *[F.coalesce(c, F.lit("")).alias(c) for c in ("file", "title", "artist")])
    joined = seeds.select(key, seed.alias("seed")).join(lists, key, "left")
    return joined.select(key, F.to_json(F.struct("seed", F.coalesce("playlist", F.array()).alias("playlist")), {"ignoreNullFields": "false"}).alias("json"))


def _fixed(value: Column, digits: int) -> Column:
    """A number with so many digits, halves of its exact value to even, without grouping."""
    if digits:
        # the formatter takes the shortest text of numbers below one unit of the last digit: their half is above it in binary
        unit = 10.0**-digits
        value = F.when((F.abs(value) >= unit / 2) & (F.abs(value) < unit), F.signum(value) * unit).otherwise(value)
    return F.call_function("format_number", value, F.lit("0" + ("." + "0" * digits if digits else "")))


def text_summary(entries: DataFrame, library: DataFrame, schedule: tuple[str, ...] = ("Near", "Mid", "Far", "Mid", "Near"), hold_axis: str = "tempo.bpm", key: str = "playlist_id") -> DataFrame:
    """(key, line_no, line): a report of each playlist; the seed, at position 0, is labelled ``SEED``.

    A number that a sidecar doesn't hold is 0, a missing scale ``N/A``, an empty name ``Unknown``.
    """
    vector, at = F.col("vector"), {name: k for k, name in enumerate(C.AXIS_NAMES)}

    def num(name: str, digits: int) -> Column:
        return _fixed(vector[at[name]], digits)

    def text(*parts: str | Column) -> Column:
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    name = {c: F.coalesce(F.nullif(c, F.lit("")), F.lit("Unknown")) for c in ("title", "artist")}
    index = F.row_number().over(W.partitionBy(key).orderBy("position")) - 1
    rows = entries.select(key, "position", "id", "band").join(library.select("id", "title", "artist", "scale", "vector"), "id").withColumn("n", index)
    block = F.array(
        text(F.col("n").cast("string"), ". id=", F.col("id").cast("string"), " | ", F.when(F.col("position") == 0, "SEED").otherwise(F.coalesce("band", F.lit("")))),
        text("   '", name["title"], "' - ", name["artist"]),
        text("   Duration: ", num("duration_sec", 1), "s | Loudness: ", num("loudness.integrated", 1), " LUFS (range ", num("loudness.range", 1), ")"),
        text("   Tempo: ", num("tempo.bpm", 0), " BPM (conf ", num("tempo.confidence", 2), ") | Key: ", F.coalesce("scale", F.lit("N/A"))),
        text("   Spectral: centroid=", num("spectral.centroid", 0), " Hz, rolloff=", num("spectral.rolloff", 0), " Hz, flatness=", num("spectral.flatness", 3)),
        text("   Rhythm: danceability=", num("rhythm.danceability", 2), ", onset_rate=", num("rhythm.onset_rate", 1), "/sec"),
        text("   Mood: ", *[p for k, m in enumerate(C.MOODS) for p in (f"{', ' if k else ''}{m}=", num(f"mood.{m}", 2))]),
        F.lit(""),
    )
    body = rows.select(key, "n", F.posexplode(block).alias("k", "line")).select(key, (8 + 8 * F.col("n") + F.col("k")).cast("int").alias("line_no"), "line")
    seed = F.max_by(F.struct("id", name["title"].alias("title"), name["artist"].alias("artist")), F.when(F.col("position") == 0, 1))
    heads = rows.groupBy(key).agg(seed.alias("s"), F.count("*").cast("string").alias("c"))
    rule = F.lit("=" * 60)
    top = F.array(
        rule,
        F.lit("PLAYLIST SUMMARY"),
        rule,
        text("Seed: id=", F.col("s.id").cast("string"), " '", F.col("s.title"), "' by ", F.col("s.artist")),
        text(f"Schedule: {' -> '.join(schedule)} (", F.col("c"), " tracks)"),
        F.lit(f"Hold axis: {hold_axis}"),
        F.lit(""),
    )
    return body.unionByName(heads.select(key, F.posexplode(top).alias("k", "line")).select(key, (F.col("k") + 1).cast("int").alias("line_no"), "line"))


def load_ordered(spark, json_path: str, tracks: DataFrame) -> list:
    """Rows of a recorded playlist, seed first, then by position; a track that isn't there is an error."""
    doc = spark.read.option("multiLine", "true").schema("seed struct<id bigint>, playlist array<struct<position int, id bigint>>").json(json_path)
    wanted = doc.select(F.lit(0).alias("position"), F.col("seed.id").alias("id")).unionByName(doc.select(F.explode("playlist").alias("p")).select("p.position", "p.id"))
    rows = wanted.join(tracks.select("id", F.col("id").alias("found"), "file_path", "title", "artist", "duration_sec"), "id", "left").orderBy("position").collect()
    for r in rows:
        if r.found is None:
            raise KeyError(r.id)
    return rows


def export(spark, base: str, rows: list, fmt: str) -> list[Path]:
    """Write the ordered tracks beside ``base`` as m3u, pls or all; m3u comes first."""
    if fmt not in ("m3u", "pls", "all"):
        raise ValueError(f"unknown format {fmt!r}")
    out = []
    df = spark.createDataFrame([(0, i, r["file_path"], r["title"], r["artist"], r["duration_sec"]) for i, r in enumerate(rows)], "playlist_id int, position int, file_path string, title string, artist string, duration_sec double")
    for kind, make in (("m3u", m3u_lines), ("pls", pls_lines)):
        if fmt in (kind, "all"):
            target = Path(base).with_suffix("." + kind)
            target.parent.mkdir(parents=True, exist_ok=True)
            lines = [r.line for r in make(df, str(target.resolve().parent)).orderBy("line_no").collect()]
            target.write_text("\n".join(lines or (["#EXTM3U"] if kind == "m3u" else ["[playlist]", "NumberOfEntries=0", "Version=2"])) + "\n", encoding="utf-8")
            out.append(target)
    return out
