"""Keep a library up to date with a folder: new audio files are ingested as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from crateflow.operators import ingest
from crateflow.session import durable


def watch(spark: SparkSession, folder: str, path: str, checkpoint: str, extractor: ingest.Extractor, o: ingest.Options = ingest.Options(), once: bool = False) -> StreamingQuery:
    """Each micro-batch of new files is classified, extracted and written as a delta; a repeated batch changes nothing."""
    ingest.init(spark, path)
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("recursiveFileLookup", "true").load(folder)
    names = files.select(F.regexp_replace("path", "^file:/*", "/").alias("file_path")).where(ingest.is_audio(F.col("file_path")))

    def batch(df: DataFrame, _: int) -> None:
        s = df.sparkSession
        tracks = ingest.read(s, path)
        plan = durable(ingest.classify(df, tracks, o))
        if plan.where((F.col("action") != "skip") | F.col("needs_embedding")).limit(1).count():
            ingest.publish(durable(ingest.upsert(tracks, plan, ingest.extract(plan, extractor), o)), path)

    writer = names.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def log_activity(log: DataFrame, late: str = "1 hour", window: str = "1 hour") -> DataFrame:
    """(window_start, status, n): ingest log rows per window, each log_id once, late rows up to the watermark."""
    once = log.withWatermark("logged_at", late).dropDuplicatesWithinWatermark(["log_id"])
    return once.groupBy(F.window("logged_at", window), "status").agg(F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), "status", "n")
