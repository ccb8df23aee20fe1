"""The library: tracks with their sidecars parsed once, gates' inputs, feature vectors and unit embeddings.

Sidecars are read strictly at their reference paths (``schema_drift.unify`` is for drifted ones): a
missing, null or non-numeric leaf is null, an unparsable sidecar has no fields at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crateflow.functions import columns as C


def _text(path: str) -> Column:
    return F.try_variant_get(F.col("__v"), "$." + path, "string")


def _number(path: str) -> Column:
    return _text(path).try_cast("double")


def sidecars(tracks: DataFrame) -> DataFrame:
    """Tracks plus version, schema_hash, bpm, scale, slot, has_mood, the moods, and the 20-axis vector."""
    base = tracks.withColumn("__v", F.try_parse_json("feature_json"))
    plain = [p for p in C.AXIS_NAMES if not p.startswith("key.fifths")]
    wide = base.select(
        *tracks.columns,
        F.nullif(_text("version"), F.lit("")).alias("version"),
        F.nullif(_text("schema_hash"), F.lit("")).alias("schema_hash"),
        _text("key.scale").alias("scale"),
        C.key_slot(_text("key.key"), _text("key.mode"), _text("key.scale")).alias("slot"),
        F.coalesce(F.schema_of_variant(F.try_variant_get("__v", "$.mood", "variant")).isNotNull(), F.lit(False)).alias("has_mood"),
        F.array(*[_number(p) for p in plain]).alias("__axes"),
    )
    x, y = C.key_to_circle(F.col("slot"))
    moods = [F.col("__axes")[plain.index(f"mood.{m}")].alias(m) for m in C.MOODS]
    vector = F.concat(F.transform("__axes", lambda v: F.coalesce(v, F.lit(0.0))), F.array(x, y))
    return wide.select(*[c for c in wide.columns if c != "__axes"], F.coalesce(F.col("__axes")[plain.index("tempo.bpm")], F.lit(0.0)).alias("bpm"), *moods, vector.alias("vector"))


def embedding(column: str = "clap_embedding", dim: int | None = 512) -> Column:
    """The embedding in doubles; null where missing, empty, of another length than ``dim``, or with NaN."""
    v = F.col(column).cast("array<double>")
    fine = (F.size(v) == dim) if dim else (F.size(v) > 0)
    return F.when(fine & ~F.exists(v, lambda x: x.isNull() | F.isnan(x)), v)


def load(tracks: DataFrame, dim: int | None = 512) -> DataFrame:
    """The library that samplers walk over: one row per track, ``unit`` null where there is no embedding."""
    unit = C.l2_normalize(F.col("__e"))
    return sidecars(tracks).withColumn("__e", embedding(dim=dim)).withColumn("unit", F.when(F.col("__e").isNotNull(), unit)).drop("__e", "clap_embedding", "feature_json")


def coverage(tracks: DataFrame, dim: int | None = 512) -> DataFrame:
    """(n_tracks, n_clap, clap_coverage); the ratio of an empty library is 0."""
    have = tracks.select(embedding(dim=dim).isNotNull().alias("e"))
    return have.agg(F.count("*").alias("n_tracks"), F.count_if("e").alias("n_clap")).withColumn("clap_coverage", F.coalesce(F.try_divide(F.col("n_clap"), F.col("n_tracks")), F.lit(0.0)))


def seed_by_id(tracks: DataFrame, seed_id: int) -> int:
    if not tracks.where(F.col("id") == seed_id).limit(1).count():
        raise LookupError(f"no track with id {seed_id}")
    return seed_id


def seed_by_title(tracks: DataFrame, wanted: str) -> int:
    """The one track whose title contains the text; an error if there is none, or more than one."""
    found = tracks.where(C.title_contains(F.col("title"), wanted)).select("id").limit(2).collect()
    if len(found) != 1:
        raise LookupError(f"{'no' if not found else 'more than one'} title contains {wanted!r}")
    return found[0].id


def default_seed(tracks: DataFrame, preferred: int = 17) -> int:
    """The preferred id if there, else the greatest."""
    row = tracks.agg(F.max("id").alias("m"), F.max(F.col("id") == preferred).alias("p")).first()
    if row.m is None:
        raise LookupError("the library is empty")
    return preferred if row.p else row.m
