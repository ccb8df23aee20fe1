"""The registered queries of the core, and their SQL.

Searches take as queries every row whose id is divisible by 20, against all rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crateflow.functions import columns as C
from crateflow.operators import blocks, export, ingest, library, metrics, schema_drift, similarity, walk
from crateflow.plans import reference_sql
from crateflow.session import durable
from crateflow.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
MOOD_BOX = {"mood.sad": {"min": 0.9}, "aggressive": {"max": 0.1}, "party": {"min": 0.8}}


def query(f: Query) -> Query:
    _QUERIES[f.__name__] = f
    return f


def _lib(s: SparkSession, d: str) -> DataFrame:
    return library.load(table(s, d, "tracks"))


def _plain(s: SparkSession, d: str) -> DataFrame:
    return library.sidecars(table(s, d, "tracks", "id", "title", "artist", "duration_sec", "file_path", "feature_json"))


def _asked(lib: DataFrame) -> DataFrame:
    return lib.where((F.col("id") % 20 == 0) & F.col("unit").isNotNull())


def _entries(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "playlist_entries").distinct()


def _playlists(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "playlists", "playlist_id", "seed_id", "sampler").distinct()


def entry(s: SparkSession, d: str) -> DataFrame:
    lib = _lib(s, d)
    return walk.clap_walk(lib, _asked(lib).select(F.col("id").alias("walk_id"), "id"), 3)


@query
def p2_found(s: SparkSession, d: str) -> DataFrame:
    return schema_drift.drift_report(table(s, d, "tracks", "id", "feature_json"), table(s, d, "ingest_log"), table(s, d, "sidecar_schema"))


@query
def p2_table(s: SparkSession, d: str) -> DataFrame:
    return schema_drift.unify(table(s, d, "tracks", "id", "feature_json"))


@query
def library_scan(s: SparkSession, d: str) -> DataFrame:
    return _plain(s, d).select("id", "version", "schema_hash", "slot", "has_mood", "bpm", *C.MOODS)


@query
def feature_vectors(s: SparkSession, d: str) -> DataFrame:
    return _plain(s, d).select("id", F.posexplode("vector").alias("axis", "value")).select("id", "axis", F.round("value", 6).alias("value"))


@query
def axis_stats(s: SparkSession, d: str) -> DataFrame:
    return walk.axis_stats(_plain(s, d)).select("axis", F.round("mu", 6).alias("mu"), F.round("sigma", 6).alias("sigma"))


@query
def coverage(s: SparkSession, d: str) -> DataFrame:
    return library.coverage(table(s, d, "tracks", "id", "clap_embedding"))


@query
def key_slots(s: SparkSession, d: str) -> DataFrame:
    return _plain(s, d).select("id", "slot")


def _played(s: SparkSession, d: str) -> DataFrame:
    """Seed and entry of each playlist position, with their slots and tempos."""
    lib = durable(_plain(s, d).select("id", "slot", "bpm"))
    rows = _entries(s, d).select("playlist_id", F.col("track_id").alias("b_id")).join(_playlists(s, d).select("playlist_id", F.col("seed_id").alias("a_id")), "playlist_id")
    a, b = (lib.select(*[F.col(c).alias(f"{p}_{c}") for c in lib.columns]) for p in "ab")
    return rows.join(a, "a_id").join(b, "b_id")


@query
def key_verdicts(s: SparkSession, d: str) -> DataFrame:
    return _played(s, d).groupBy(C.key_verdict(C.key_steps(F.col("a_slot"), F.col("b_slot"))).alias("verdict")).agg(F.count("*").alias("n"))


@query
def tempo_gate(s: SparkSession, d: str) -> DataFrame:
    return _played(s, d).groupBy(C.tempo_ok(F.col("a_bpm"), F.col("b_bpm")).alias("ok")).agg(F.count("*").alias("n"))


@query
def mood_box(s: SparkSession, d: str) -> DataFrame:
    return _plain(s, d).where(C.mood_passes({m: F.col(m) for m in C.MOODS}, {"mood.sad": {"min": 0.5}, "party": {"max": 0.6}})).select("id")


def _states(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(one state a query, the library)."""
    lib = durable(_lib(s, d).select(*walk._SLIM))
    state = _asked(lib).select(F.col("id").alias("walk_id"), "slot", "bpm", F.col("bpm").alias("centre"), "unit", F.array("id").alias("visited"))
    return state, lib


@query
def gate_filter(s: SparkSession, d: str) -> DataFrame:
    # the gates ask whether there is an embedding, not which
    tracks = table(s, d, "tracks", "id", "duration_sec", "feature_json", "clap_embedding")
    slim = library.sidecars(tracks).select(*[c for c in walk._SLIM if c != "unit"], library.embedding().isNotNull().alias("there"))
    lib = durable(slim.repartition(max(slim.rdd.getNumPartitions(), s.sparkContext.defaultParallelism)))
    asked = lib.where((F.col("id") % 20 == 0) & F.col("there"))
    state = asked.select(F.col("id").alias("walk_id"), "slot", "bpm", F.col("bpm").alias("centre"), F.array("id").alias("visited"))
    return blocks.cross(state, lib, walk.gate_kernel(walk.Sampler()), walk.GATED).select(F.col("walk_id").alias("query_id"), "id", "verdict")


@query
def mood_relax_levels(s: SparkSession, d: str) -> DataFrame:
    return walk.box_levels(walk.gate_counts(*_states(s, d), walk.Sampler(mood_box=MOOD_BOX))).withColumnRenamed("walk_id", "query_id")


def _units(s: SparkSession, d: str) -> DataFrame:
    return durable(_lib(s, d).select("id", "unit"))


@query
def cosine_topk(s: SparkSession, d: str) -> DataFrame:
    lib = _units(s, d)
    return similarity.top_k(_asked(lib), lib, 5).select("query_id", "id", "rank", F.round("sim", 6).alias("sim"))


@query
def global_nearest(s: SparkSession, d: str) -> DataFrame:
    lib = _units(s, d)
    return similarity.top_k(_asked(lib), lib, 1).select("query_id", "id", F.round(1 - F.col("sim"), 4).alias("distance"))


@query
def similarity_bands(s: SparkSession, d: str) -> DataFrame:
    tracks = table(s, d, "tracks", "id", "clap_embedding")
    return similarity.band_report(tracks.select("id", _stored(tracks))).withColumns({c: F.round(c, 6) for c in ("most", "least")})


def _stored(tracks: DataFrame) -> Column:
    """Whole embeddings as they are stored: floats take half the room."""
    return library.embedding().cast(tracks.schema["clap_embedding"].dataType).alias("raw")


def _seeds(tracks: DataFrame) -> DataFrame:
    """A walk from each of the stated queries."""
    asked = tracks.select("id", "clap_embedding").where((F.col("id") % 20 == 0) & library.embedding().isNotNull())
    return asked.select(F.col("id").alias("walk_id"), "id")


def _walk(s: SparkSession, d: str, limit: int, sampler: walk.Sampler) -> DataFrame:
    tracks = table(s, d, "tracks", "id", "duration_sec", "feature_json", "clap_embedding")
    lib = library.sidecars(tracks).select(*[c for c in walk._SLIM if c != "unit"], _stored(tracks))
    return walk.clap_walk(lib, _seeds(tracks), limit, sampler)


@query
def playlist_walk(s: SparkSession, d: str) -> DataFrame:
    return _walk(s, d, 9, walk.Sampler())


@query
def playlist_walk_drift(s: SparkSession, d: str) -> DataFrame:
    return _walk(s, d, 9, walk.Sampler(tempo_drift_per_step=0.03))


@query
def playlist_walk_moodbox(s: SparkSession, d: str) -> DataFrame:
    return _walk(s, d, 9, walk.Sampler(mood_box=MOOD_BOX))


@query
def playlist_walk_fallback(s: SparkSession, d: str) -> DataFrame:
    return _walk(s, d, 9, walk.Sampler(mood_box={"sad": {"min": 1.5}}))


def _raw(tracks: DataFrame) -> DataFrame:
    return tracks.withColumn("raw", library.embedding()).where("raw is not null")


def _shelved_pairs(s: SparkSession, d: str) -> similarity.Pairs:
    tracks = table(s, d, "tracks", "id", "duration_sec", "feature_json", "clap_embedding")
    return similarity.Pairs(library.sidecars(tracks).select("id", "vector", _stored(tracks)).where("raw is not null"))


@query
def pairwise_report(s: SparkSession, d: str) -> DataFrame:
    means = similarity.pair_means(_shelved_pairs(s, d))
    return means.withColumns({c: F.round(c, 6) for c in means.columns[2:]})


@query
def spearman_pairs(s: SparkSession, d: str) -> DataFrame:
    return similarity.pair_correlation(_shelved_pairs(s, d)).select("n", F.round("rho", 6).alias("rho"))


@query
def nn_agreement(s: SparkSession, d: str) -> DataFrame:
    near = similarity.pair_nearest(_shelved_pairs(s, d))
    return metrics.nn_agreement(near, "d_clap", "d_essentia").select("n", F.round("exact_match", 6).alias("exact_match"), F.round("top3_overlap", 6).alias("top3_overlap"))


@query
def distance_cuts(s: SparkSession, d: str) -> DataFrame:
    # numbers are kept as they are stored: floats take half the room
    tracks = table(s, d, "tracks", "id", "clap_embedding")
    lib = _raw(tracks).select("id", F.col("raw").cast(tracks.schema["clap_embedding"].dataType).alias("raw"))
    mean, sigma = similarity.column_stats(lib, "raw")
    low, high = similarity.pair_cuts(lib.where(F.col("id") % 20 == 0), lib, sigma, mean)
    return s.createDataFrame([(round(low, 6), round(high, 6))], "low double, high double")


@query
def candidate_pool_spearman(s: SparkSession, d: str) -> DataFrame:
    rows = _entries(s, d).where("distance is not null").join(_playlists(s, d), "playlist_id")
    mean = rows.groupBy("track_id").agg(*[F.round(F.avg(F.when(F.col("sampler") == k, F.col("distance"))), 9).alias(c) for c, k in (("a", "clap"), ("b", "legacy"))])
    return metrics.spearman(mean.where("a is not null and b is not null"), "a", "b").select("n", F.round("rho", 6).alias("rho"))


@query
def compare_walk(s: SparkSession, d: str) -> DataFrame:
    tracks = table(s, d, "tracks", "id", "clap_embedding")
    return metrics.compare_walk(tracks.select("id", _stored(tracks)), _seeds(tracks), 9)


def _legacy_report(s: SparkSession, d: str) -> DataFrame:
    lib = durable(_plain(s, d).select("id", "vector"))
    return similarity.legacy_report(lib.where(F.col("id") % 20 == 0), lib, walk._stats(lib)[1], C.AXIS_NAMES.index("tempo.bpm"))


@query
def legacy_bands(s: SparkSession, d: str) -> DataFrame:
    return _legacy_report(s, d).where("band <> 'Jump'").select("query_id", "band", "n", F.round("least", 6).alias("least"), F.round("most", 6).alias("most"))


@query
def directed_jump(s: SparkSession, d: str) -> DataFrame:
    return _legacy_report(s, d).where("band = 'Jump'").select("query_id", "id", "n", F.round("d", 6).alias("d"))


@query
def legacy_walk(s: SparkSession, d: str) -> DataFrame:
    lib = _plain(s, d).select("id", "vector")
    return walk.legacy_walk(lib, lib.where(F.col("id") % 20 == 0).select(F.col("id").alias("walk_id"), "id"))


@query
def legacy_walk_scheduled(s: SparkSession, d: str) -> DataFrame:
    """As ``legacy_walk``, each entry labelled as its step was scheduled."""
    lib = _plain(s, d).select("id", "vector")
    return walk.legacy_walk(lib, lib.where(F.col("id") % 20 == 0).select(F.col("id").alias("walk_id"), "id"), actual_labels=False).select("walk_id", "position", "id", "band")


@query
def anchor_adherence(s: SparkSession, d: str) -> DataFrame:
    lists = _playlists(s, d)
    seeds = lists.select(F.col("playlist_id").alias("walk_id"), F.col("seed_id").alias("id"))
    rows = _entries(s, d).select(F.col("playlist_id").alias("walk_id"), "position", F.col("track_id").alias("id"))
    flags = metrics.anchor_flags(rows, _plain(s, d), seeds).join(lists.select(F.col("playlist_id").alias("walk_id"), "sampler"), "walk_id")
    return metrics.adherence(flags, "sampler").select("sampler", "mood", F.round("key", 6).alias("key"), F.round("tempo", 6).alias("tempo"), "key_violations")


@query
def band_means(s: SparkSession, d: str) -> DataFrame:
    rows = metrics.band_means(_entries(s, d).join(_playlists(s, d).select("playlist_id", "sampler"), "playlist_id"), "sampler")
    return rows.select("sampler", "band", F.round("mean_distance", 6).alias("mean_distance"), "n")


@query
def stale_rows(s: SparkSession, d: str) -> DataFrame:
    rows = ingest.stamps(table(s, d, "tracks", "id", "feature_json"))
    return rows.select("id", C.is_stale(F.col("feature_json"), F.col("version"), F.col("stamp"), "1.1", C.SCHEMA_HASH).alias("stale"))


_WITH_VECTORS = ingest.Options(with_embedding=True)


def _plan(s: SparkSession, d: str, o: ingest.Options) -> DataFrame:
    return ingest.classify(table(s, d, "ingest_log", "file_path"), table(s, d, "tracks"), o)


@query
def ingest_plan(s: SparkSession, d: str) -> DataFrame:
    return _plan(s, d, _WITH_VECTORS)


def stub_extractor(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Stands for audio extraction: the path's length as duration; Ogg files fail."""
    for pdf in batches:
        bad = pdf["file_path"].str.lower().str.endswith(".ogg")
        text = pd.Series('{"version": "1.1"}', index=pdf.index)
        yield pd.DataFrame({"file_path": pdf["file_path"], "title": None, "artist": None, "duration_sec": pdf["file_path"].str.len().astype(float).where(~bad), "feature_json": text.where(~bad), "clap_embedding": None, "error": pd.Series("cannot decode", index=pdf.index).where(bad)})


@query
def upsert_tracks(s: SparkSession, d: str) -> DataFrame:
    plan = durable(_plan(s, d, ingest.Options()))
    rows = ingest.upsert(table(s, d, "tracks"), plan, ingest.extract(plan, stub_extractor))
    return rows.select("id", "file_path", "status", "duration_sec", F.col("feature_json").isNotNull().alias("has_json"))


@query
def seed_search(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "tracks", "id", "title").where(C.title_contains(F.col("title"), "Mirror")).select("id")


def _ordered(s: SparkSession, d: str) -> DataFrame:
    """Every playlist's tracks, the seed first."""
    rows = _playlists(s, d).select("playlist_id", F.lit(0).alias("position"), F.col("seed_id").alias("id")).unionByName(_entries(s, d).select("playlist_id", "position", F.col("track_id").alias("id")))
    return rows.join(table(s, d, "tracks", "id", "file_path", "title", "artist", "duration_sec"), "id")


@query
def m3u_lines(s: SparkSession, d: str) -> DataFrame:
    return export.m3u_lines(_ordered(s, d), "/lib/playlists")


@query
def pls_lines(s: SparkSession, d: str) -> DataFrame:
    return export.pls_lines(_ordered(s, d), "/lib/playlists")


def _json(s: SparkSession, d: str) -> DataFrame:
    seeds = _playlists(s, d).select("playlist_id", F.col("seed_id").alias("id")).join(table(s, d, "tracks", "id", F.col("file_path").alias("file"), "title", "artist"), "id", "left")
    return export.playlist_json(_entries(s, d).withColumnRenamed("track_id", "id"), seeds)


@query
def playlist_json(s: SparkSession, d: str) -> DataFrame:
    return _json(s, d)


@query
def playlist_members(s: SparkSession, d: str) -> DataFrame:
    """The entries read back from the JSON form."""
    shape = "struct<playlist array<struct<position int, id bigint, file string, title string, artist string, band string, distance double, reason string>>>"
    doc = _json(s, d).select("playlist_id", F.from_json("json", shape.replace("struct<playlist array", "playlist array", 1)[:-1]).alias("j"))
    return doc.select("playlist_id", F.explode("j.playlist").alias("e")).select("playlist_id", "e.*")


@query
def text_summary(s: SparkSession, d: str) -> DataFrame:
    rows = _playlists(s, d).select("playlist_id", F.lit(0).alias("position"), F.col("seed_id").alias("id"), F.lit(None).cast("string").alias("band"))
    return export.text_summary(rows.unionByName(_entries(s, d).select("playlist_id", "position", F.col("track_id").alias("id"), "band")), _plain(s, d))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return reference_sql.sql()
