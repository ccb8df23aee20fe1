"""Incremental, idempotent ingest: scan, classify, extract what is new or stale, upsert.

A library is a folder of numbered Parquet versions, whole ones (``v``) and deltas (``d``, the rows that
changed). A version counts once its marker file stands, which is created in one step after the rows are
written; nothing is renamed or overwritten, so a crash at any point leaves the last version as it was and
readers never see half a table. Every ``COMPACT`` deltas a whole version is written. Extraction is a
plug-in (``extractors``): audio decoding and models aren't part of the engine.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from crateflow.functions import columns as C
from crateflow.session import durable

#: Deltas after which the next version is a whole one.
COMPACT = 16
_MARKER = "_COMMITTED"
#: File name endings of audio files.
AUDIO = (".mp3", ".flac", ".ogg", ".wav", ".m4a")
TRACKS = "id bigint, file_path string, title string, artist string, duration_sec double, feature_json string, clap_embedding array<float>, created_at timestamp"
#: What an extractor returns for each path; ``error`` null where it worked.
EXTRACTED = "file_path string, title string, artist string, duration_sec double, feature_json string, clap_embedding array<float>, error string"
Extractor = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]


@dataclass(frozen=True)
class Options:
    current_version: str | None = "1.1"
    current_stamp: str | None = C.SCHEMA_HASH
    force: bool = False
    with_embedding: bool = False
    retry_missing_mood: bool = False
    dim: int | None = 512


def is_audio(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1)).isin(*AUDIO)


def scan(spark: SparkSession, folder: str) -> DataFrame:
    """(file_path): audio files below a folder; only names are read, not contents."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select(F.regexp_replace("path", "^file:/*", "/").alias("file_path")).where(is_audio(F.col("file_path")))


def stamps(tracks: DataFrame) -> DataFrame:
    """Tracks plus version and stamp of the stored sidecar; both null where it doesn't parse."""
    v = F.try_parse_json("feature_json")
    return tracks.withColumn("version", F.nullif(F.try_variant_get(v, "$.version", "string"), F.lit(""))).withColumn("stamp", F.nullif(F.try_variant_get(v, "$.schema_hash", "string"), F.lit("")))


def classify(files: DataFrame, tracks: DataFrame, o: Options = Options()) -> DataFrame:
    """(file_path, id, action, needs_embedding): ``process`` new files, ``re-extract`` stale rows, ``skip`` the rest."""
    known = stamps(tracks.select("id", "file_path", "feature_json", "clap_embedding"))
    joined = files.select("file_path").distinct().join(known, "file_path", "left")
    stale = C.is_stale(F.col("feature_json"), F.col("version"), F.col("stamp"), o.current_version, o.current_stamp)
    if o.retry_missing_mood:
        stale |= ~F.coalesce(F.array_contains(F.json_object_keys("feature_json"), "mood"), F.lit(False))
    again = F.lit(True) if o.force else stale
    action = F.when(F.col("id").isNull(), "process").when(again, "re-extract").otherwise("skip")
    needs = F.lit(o.with_embedding) & (F.lit(o.force) | F.col("clap_embedding").isNull())
    return joined.select("file_path", "id", action.alias("action"), needs.alias("needs_embedding"))


def extract(plan: DataFrame, extractor: Extractor) -> DataFrame:
    """EXTRACTED rows for what the plan wants; the extractor loads its models once per partition."""
    return plan.where((F.col("action") != "skip") | F.col("needs_embedding")).select("file_path", "action", "needs_embedding").mapInPandas(extractor, EXTRACTED)


def upsert(tracks: DataFrame, plan: DataFrame, extracted: DataFrame, o: Options = Options()) -> DataFrame:
    """The next version of the library, with a ``status`` column.

    Existing rows keep what an extraction doesn't bring, and always an embedding they have unless forced.
    New rows come even where extraction failed, without features, to be tried again. New ids continue
    after the greatest, in the order of the paths.
    """
    # the extractor runs once: its rows are kept before anything is made of them
    extracted = durable(extracted)
    fresh = extracted.select("file_path", *[F.col(c).alias(f"x_{c}") for c in ("title", "artist", "duration_sec", "feature_json", "clap_embedding", "error")])
    full = tracks.join(plan.select("file_path", "action", "needs_embedding"), "file_path", "full_outer").join(fresh, "file_path", "left")
    worked = F.col("x_error").isNull() & F.col("action").isin("process", "re-extract")
    new_vector = F.when(F.size("x_clap_embedding") == o.dim, F.col("x_clap_embedding")) if o.dim else F.col("x_clap_embedding")
    vector = F.when(F.col("needs_embedding"), F.coalesce(new_vector, "clap_embedding")).otherwise(F.col("clap_embedding"))
    top = tracks.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    add = plan.where("action = 'process'").select("file_path").distinct().join(tracks.select("file_path"), "file_path", "left_anti")
    # ids of new rows: ranks inside ranges of paths plus the ranges' offsets, without one global sort
    numbered = _numbered(add, "file_path").crossJoin(F.broadcast(top)).select("file_path", (F.col("top") + F.col("n")).alias("new_id"))
    status = F.when(F.col("action").isNull(), "kept").when(F.col("action") == "skip", "skipped").when(~worked, "failed").when(F.col("action") == "process", "processed").otherwise("re-extracted")
    # features that came before a later phase failed are kept
    got = F.col("action").isin("process", "re-extract") & (F.col("x_error").isNull() | F.col("x_feature_json").isNotNull())
    pick = {c: F.when(got, F.coalesce(f"x_{c}", c)).otherwise(F.col(c)).alias(c) for c in ("title", "artist", "duration_sec", "feature_json")}
    return full.join(numbered, "file_path", "left").select(F.coalesce("id", "new_id").alias("id"), "file_path", *pick.values(), vector.alias("clap_embedding"), F.coalesce("created_at", F.current_timestamp()).alias("created_at"), status.alias("status"), (F.col("action").isin("process", "re-extract") | F.coalesce("needs_embedding", F.lit(False))).alias("changed"))


def _numbered(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` with ``n``, 1-based by ``key``; ordered ranges are counted and numbered apart."""
    ranged = durable(rows.select(key).repartitionByRange(key).withColumn("p", F.spark_partition_id()))
    count = ranged.groupBy("p").agg(F.count("*").alias("c"))
    before = count.withColumn("before", F.sum("c").over(W.partitionBy().orderBy("p")) - F.col("c")).select("p", "before")
    return ranged.join(before, "p").select(key, (F.col("before") + F.row_number().over(W.partitionBy("p").orderBy(key))).alias("n"))


def init(spark: SparkSession, path: str) -> None:
    """An empty library where there is none."""
    if not _versions(spark, path):
        write(spark.createDataFrame([], TRACKS), path)


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _folders(spark: SparkSession, path: str) -> list[tuple[int, str, bool]]:
    """(number, kind, committed) of every version's folder, in order."""
    jvm, fs, p = _fs(spark, path)
    if not fs.exists(p):
        return []
    out = []
    for status in fs.listStatus(p):
        name = status.getPath().getName()
        if name[:1] in ("v", "d") and name[1:].isdigit():
            out.append((int(name[1:]), name[0], fs.exists(jvm.org.apache.hadoop.fs.Path(status.getPath(), _MARKER))))
    return sorted(out)


def _versions(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """The committed versions that a reader needs: the last whole one and the deltas after it."""
    done = [(n, kind) for n, kind, committed in _folders(spark, path) if committed]
    base = max((n for n, kind in done if kind == "v"), default=None)
    return [] if base is None else [(n, kind) for n, kind in done if n >= base]


def write(tracks: DataFrame, path: str, kind: str = "v") -> int:
    """Write the next version, whole (``v``) or the rows that changed (``d``); returns its number.

    A folder that a crashed or other writer left is never touched: the number after it is taken, and two
    writers of one number can't both succeed.
    """
    spark = tracks.sparkSession
    version = max((n for n, _, _ in _folders(spark, path)), default=0) + 1
    tracks.select(*[c.split()[0] for c in TRACKS.split(", ")]).write.mode("errorifexists").parquet(f"{path}/{kind}{version}")
    _commit(spark, path, f"{kind}{version}")
    return version


def _commit(spark: SparkSession, path: str, folder: str) -> None:
    jvm, fs, p = _fs(spark, path)
    fs.create(jvm.org.apache.hadoop.fs.Path(p, f"{folder}/{_MARKER}"), False).close()


def read(spark: SparkSession, path: str) -> DataFrame:
    """The library as its last version has it: the newest row of each id."""
    versions = _versions(spark, path)
    if not versions:
        raise FileNotFoundError(path)
    base = spark.read.schema(TRACKS).parquet(f"{path}/v{versions[0][0]}")
    deltas = [spark.read.schema(TRACKS).parquet(f"{path}/d{n}").withColumn("__n", F.lit(n)) for n, _ in versions[1:]]
    if not deltas:
        return base
    rows = deltas[0]
    for more in deltas[1:]:
        rows = rows.unionByName(more)
    newest = rows.groupBy("id").agg(F.max_by(F.struct(*base.columns), "__n").alias("r")).select("r.*")
    return base.join(newest.select("id"), "id", "left_anti").select(*base.columns).unionByName(newest)


def publish(done: DataFrame, path: str) -> int:
    """Write an upsert's rows as the next version: what changed, or after ``COMPACT`` deltas everything."""
    if len(_versions(done.sparkSession, path)) > COMPACT:
        return write(done, path)
    return write(done.where("changed"), path, "d")


def run(spark: SparkSession, folder: str, path: str, extractor: Extractor, o: Options = Options()) -> DataFrame:
    """Ingest a folder into the library at ``path``; (file_path, status) of every file."""
    init(spark, path)
    tracks = read(spark, path)
    plan = durable(classify(scan(spark, folder), tracks, o))
    if not plan.where((F.col("action") != "skip") | F.col("needs_embedding")).limit(1).count():
        return plan.select("file_path", F.lit("skipped").alias("status"))
    done = durable(upsert(tracks, plan, extract(plan, extractor), o))
    publish(done, path)
    return done.where("status <> 'kept'").select("file_path", "status")
