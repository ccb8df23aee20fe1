"""The pN_ queries of the operators in this package, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crateflow.llm import format_duplicates, garbled_text, markov_clusters, mixing, name_variants, packing, quantiles, similar_vectors, stuffed_pages, tokens
from crateflow.llm.vectors import matrix
from crateflow.operators.schema_drift import unify
from crateflow.session import durable
from crateflow.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    near = similar_vectors.most_similar(table(spark, d, "tracks", "id", "clap_embedding"), k=5, least=0.75)
    return near.select(F.least("id", "near_id").alias("id_a"), F.greatest("id", "near_id").alias("id_b")).distinct()


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return garbled_text.garbled(table(spark, d, "tracks", "id", "title", "artist")).select("id", "field_name")


def p3_restored(spark: SparkSession, d: str) -> DataFrame:
    return garbled_text.garbled(table(spark, d, "tracks", "id", "title", "artist"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return format_duplicates.pairs(table(spark, d, "tracks", "id", "title", "artist", "duration_sec"))


def p4_groups(spark: SparkSession, d: str) -> DataFrame:
    return format_duplicates.groups(table(spark, d, "tracks", "id", "title", "artist", "duration_sec"))


def _tempo(spark: SparkSession, d: str) -> DataFrame:
    return unify(table(spark, d, "tracks", "id", "feature_json", "clap_embedding"), ["tempo.bpm"], keep=("id", "clap_embedding"))


def p5_members(spark: SparkSession, d: str) -> DataFrame:
    return markov_clusters.groups(_tempo(spark, d), F.col("tempo__bpm"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return markov_clusters.pairs(p5_members(spark, d))


def p5_clusters(spark: SparkSession, d: str) -> DataFrame:
    return markov_clusters.describe(durable(p5_members(spark, d)))


def _measures(spark: SparkSession, d: str) -> DataFrame:
    """(id, volume, measure, value) of every track."""
    import numpy as np
    import pyarrow as pa

    def norms(batches):
        for b in batches:
            at, m = matrix(b.column(5))
            norm = np.full(b.num_rows, np.nan)
            norm[at] = np.sqrt((m * m).sum(axis=1))
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(norm, from_pandas=True)], names=["id", "volume", "bpm", "centroid", "danceability", "embedding_norm"])

    volume = F.get(F.split("file_path", "/"), F.lit(2)).alias("volume")
    tracks = table(spark, d, "tracks", "id", "file_path", "feature_json", "clap_embedding").select("id", volume, "feature_json", "clap_embedding")
    read = unify(tracks, ["tempo.bpm", "spectral.centroid", "rhythm.danceability"], keep=("id", "volume", "clap_embedding"))
    bpm = F.when(F.col("tempo__bpm") > 0, F.col("tempo__bpm"))
    wide = read.select("id", "volume", bpm.alias("bpm"), "spectral__centroid", "rhythm__danceability", "clap_embedding").mapInArrow(norms, "id bigint, volume string, bpm double, centroid double, danceability double, embedding_norm double")
    wide = durable(wide)
    long = F.explode(F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).alias("value")) for c in ("bpm", "centroid", "danceability", "embedding_norm")]))
    return wide.select("id", "volume", long.alias("m")).select("id", "volume", "m.measure", "m.value").where("value is not null and volume is not null")


_GROUP = ["volume", "measure"]


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    values = _measures(spark, d)
    brackets = quantiles.quantiles(quantiles.digest(values, _GROUP), _GROUP, (1.0, 99.0))
    exact = quantiles.exact(values, durable(brackets), _GROUP).groupBy(*_GROUP).agg(F.max(F.when(F.col("q") == 1, F.col("exact"))).alias("p1"), F.max(F.when(F.col("q") == 99, F.col("exact"))).alias("p99"))
    tail = F.when(F.col("value") > F.col("p99"), "high").when(F.col("value") < F.col("p1"), "low")
    return values.join(exact, _GROUP).select("id", "measure", tail.alias("tail")).where("tail is not null")


def p6_percentiles(spark: SparkSession, d: str) -> DataFrame:
    values = _measures(spark, d)
    return quantiles.quantiles(quantiles.digest(values, _GROUP), _GROUP, (1.0, 25.0, 50.0, 75.0, 95.0, 99.0))


def p7_entities(spark: SparkSession, d: str) -> DataFrame:
    return name_variants.linked(table(spark, d, "tracks", "title", "artist"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return name_variants.pairs(p7_entities(spark, d))


def _sized(spark: SparkSession, d: str) -> DataFrame:
    return durable(tokens.sized(table(spark, d, "documents", "doc_id", "text", "source")))


def p8_packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.packed(_sized(spark, d), table(spark, d, "mix_targets"), table(spark, d, "pack_limits"))


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.report(p8_packed(spark, d), table(spark, d, "pack_limits"))


def p9_mixed(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixed(_sized(spark, d), table(spark, d, "mix_targets"))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.report(_sized(spark, d), table(spark, d, "mix_targets"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return stuffed_pages.stuffed_pages(table(spark, d, "documents", "doc_id", "text", "agenda_item", "speaker")).select("doc_id")


def queries() -> dict[str, Query]:
    return {k: v for k, v in globals().items() if k.startswith("p") and k[1].isdigit()}


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


_SQL: dict[str, str] = {}
_KEYED = r"""
with canon as (
  select id, regexp_replace(nfc_normalize(lower(nfc_normalize(title))), '[^\p{L}\p{Nd}]', '', 'g') as a,
         regexp_replace(nfc_normalize(lower(nfc_normalize(artist))), '[^\p{L}\p{Nd}]', '', 'g') as b, floor(duration_sec * 100 + 0.5) as c
  from tracks where duration_sec > 0 and not isinf(duration_sec) and not isnan(duration_sec)),
keyed as (select id, least(a, b) as k1, greatest(a, b) as k2, c from canon where a <> '' and b <> '')
"""
_SQL["p4_found"] = _KEYED + "select x.id as id_a, y.id as id_b from keyed x join keyed y on x.k1 = y.k1 and x.k2 = y.k2 and x.c = y.c and x.id < y.id"
_SQL["p4_groups"] = _KEYED + "select min(id) as id, count(*) as copies from keyed group by k1, k2, c union all select id, 1 from tracks where id not in (select id from keyed)"
