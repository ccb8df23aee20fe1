"""Command line: ``python -m crateflow.cli run|ingest|generate|evaluate|export``.

A library is a folder written by ``ingest``, or any Parquet table with its columns. Exit status: 0 done,
1 nothing to work on (empty library, no or several seeds, no embeddings), 2 bad arguments.
"""

from __future__ import annotations

import argparse
import importlib
import json
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crateflow.functions.columns import AXIS_NAMES
from crateflow.operators import export, extractors, ingest, library, metrics, similarity, walk
from crateflow.session import durable, session


class Fault(Exception):
    """A message and the exit status it stands for."""

    def __init__(self, text: str, status: int):
        super().__init__(text)
        self.status = status


def open_library(spark: SparkSession, path: str) -> DataFrame:
    try:
        return ingest.read(spark, path)
    except FileNotFoundError:
        return spark.read.parquet(path)


def pick_seed(tracks: DataFrame, a: argparse.Namespace) -> int:
    try:
        if a.seed_id is not None:
            return library.seed_by_id(tracks, a.seed_id)
        return library.seed_by_title(tracks, a.seed_title) if a.seed_title is not None else library.default_seed(tracks)
    except LookupError as e:
        raise Fault(str(e), 1) from e


def walked(spark: SparkSession, tracks: DataFrame, seed: int, a: argparse.Namespace) -> tuple[DataFrame, DataFrame]:
    """(library, entries) of one walk with the chosen sampler."""
    lib = durable(library.load(tracks, a.dim))
    seeds = spark.createDataFrame([(seed, seed)], "walk_id bigint, id bigint")
    if a.sampler == "essentia":
        return lib, walk.legacy_walk(lib, seeds, a.limit, a.hold_axis)
    if not lib.where("unit is not null").limit(1).count():
        raise Fault("no track has an embedding", 1)
    settings = json.loads(Path(a.config).read_text(encoding="utf-8")) if a.config else {}
    return lib, walk.clap_walk(lib, seeds, a.limit, walk.Sampler.from_dict(settings))


def generate(spark: SparkSession, a: argparse.Namespace) -> None:
    if a.hold_axis not in AXIS_NAMES:
        raise Fault(f"unknown axis {a.hold_axis!r}", 2)
    if a.limit < 1:
        raise Fault("the limit must be 1 or more", 2)
    tracks = open_library(spark, a.library)
    if not tracks.limit(1).count():
        raise Fault("the library is empty", 1)
    seed = pick_seed(tracks, a)
    lib, entries = walked(spark, tracks, seed, a)
    meta = lib.select("id", F.col("file_path").alias("file"), "title", "artist")
    rows = durable(entries.withColumnRenamed("walk_id", "playlist_id").join(meta, "id"))
    one = meta.where(F.col("id") == seed).withColumn("playlist_id", F.lit(seed).cast("bigint"))
    out = Path(a.output)
    out.parent.mkdir(parents=True, exist_ok=True)
    out.write_text(export.playlist_json(rows, one).first().json + "\n", encoding="utf-8")
    if a.summary:
        first = spark.createDataFrame([(seed, 0, seed, None)], "playlist_id bigint, position int, id bigint, band string")
        lines = export.text_summary(first.unionByName(rows.select(*first.columns)), lib, hold_axis=a.hold_axis).orderBy("line_no").collect()
        Path(a.summary).write_text("\n".join(r.line for r in lines) + "\n", encoding="utf-8")
    if a.export:
        export.export(spark, str(out), export.load_ordered(spark, str(out), tracks), a.export)


def evaluate(spark: SparkSession, a: argparse.Namespace) -> None:
    """Adherence and band means of both samplers from one seed, and how their distances to it agree."""
    tracks = open_library(spark, a.library)
    if not tracks.limit(1).count():
        raise Fault("the library is empty", 1)
    seed = pick_seed(tracks, a)
    seeds = spark.createDataFrame([(seed, seed)], "walk_id bigint, id bigint")
    chosen = {}
    for sampler in ("essentia", "clap"):
        a.sampler = sampler
        lib, entries = walked(spark, tracks, seed, a)
        chosen[sampler] = entries = durable(entries)
        r = metrics.adherence(metrics.anchor_flags(entries, lib, seeds)).first()
        means = {m.band: round(m.mean_distance, 3) for m in metrics.band_means(entries).collect()}
        print(json.dumps({"sampler": sampler, "key": round(r.key, 3), "tempo": round(r.tempo, 3), "mood": round(r.mood, 3), "key_violations": r.key_violations, "band_means": means}))
    one = lib.where(F.col("id") == seed)
    pool = similarity.pool_distances(one, lib, walk._stats(lib)[1])
    pairs = metrics.overlap(chosen["essentia"], chosen["clap"], lib, seed)
    for name, rows in (("pool", pool), ("overlap", pairs)):
        r = metrics.spearman(rows, "a", "b").first()
        print(json.dumps({name: r.n, "spearman": None if r.rho is None else round(r.rho, 4)}))


def convert(spark: SparkSession, a: argparse.Namespace) -> None:
    tracks = open_library(spark, a.library)
    for path in a.playlists:
        for made in export.export(spark, path, export.load_ordered(spark, path, tracks), a.format):
            print(made)


def extractor_of(a: argparse.Namespace):
    """``--extractor module:function``: the plug-in, or with ``--tools`` a loader of ``extractors.Tools``."""
    module, _, name = a.extractor.partition(":")
    found = getattr(importlib.import_module(module), name)
    return extractors.phased(found, extractors.Limits(a.timeout, a.dsp_timeout, a.mood_timeout), a.no_mood) if a.tools else found


def take_in(spark: SparkSession, a: argparse.Namespace) -> None:
    options = ingest.Options(force=a.re_extract, with_embedding=a.clap, dim=a.dim, retry_missing_mood=a.tools and not a.no_mood)
    if not Path(a.music_dir).is_dir() and "://" not in a.music_dir:
        raise Fault(f"not a folder: {a.music_dir}", 2)
    for r in ingest.run(spark, a.music_dir, a.library, extractor_of(a), options).orderBy("file_path").toLocalIterator():
        print(f"{r.status}\t{r.file_path}")


def run_all(spark: SparkSession, a: argparse.Namespace) -> None:
    """Ingest, then with ``--generate-playlist`` a playlist."""
    take_in(spark, a)
    if a.generate_playlist:
        generate(spark, a)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="crateflow", description=__doc__)
    p.add_argument("--master")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, run, *, seeded: bool = False) -> argparse.ArgumentParser:
        c = sub.add_parser(name)
        c.set_defaults(run=run)
        c.add_argument("library")
        c.add_argument("--dim", type=int, default=512)
        if seeded:
            which = c.add_mutually_exclusive_group()
            which.add_argument("--seed-id", type=int)
            which.add_argument("--seed-title")
            c.add_argument("--limit", type=int, default=9)
            c.add_argument("--hold-axis", default="tempo.bpm")
            c.add_argument("--config")
        return c

    def takes(c: argparse.ArgumentParser) -> None:
        c.add_argument("music_dir")
        c.add_argument("--extractor", required=True)
        c.add_argument("--tools", action="store_true")
        c.add_argument("--clap", action="store_true")
        c.add_argument("--re-extract", action="store_true")
        c.add_argument("--no-mood", action="store_true")
        for phase in ("", "dsp-", "mood-"):
            c.add_argument(f"--{phase}timeout", type=int)

    def makes(c: argparse.ArgumentParser, required: bool) -> None:
        c.add_argument("--sampler", choices=("clap", "essentia"), default="clap")
        c.add_argument("--output", required=required, default="playlist.json")
        c.add_argument("--summary")
        c.add_argument("--export", choices=("m3u", "pls", "all"))

    makes(command("generate", generate, seeded=True), True)
    command("evaluate", evaluate, seeded=True)
    e = command("export", convert)
    e.add_argument("playlists", nargs="+")
    e.add_argument("--format", choices=("m3u", "pls", "all"), default="all")
    takes(command("ingest", take_in))
    r = command("run", run_all, seeded=True)
    takes(r)
    makes(r, False)
    r.add_argument("--generate-playlist", action="store_true")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    try:
        a.run(spark or session("crateflow", a.master), a)
    except Fault as e:
        print(e, file=sys.stderr)
        return e.status
    return 0


if __name__ == "__main__":
    sys.exit(main())
