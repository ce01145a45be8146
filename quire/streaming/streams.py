"""Streams: the same kernels over arriving files, deduplication within a watermark, windowed counts, sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.sources.registry import Registry, default_registry


def arriving_documents(spark: SparkSession, path: str, registry: Registry | None = None, files_per_trigger: int = 1000) -> DataFrame:
    """(path, format, blocks, issues, fault) of files as they arrive; a bad file is a row with a fault."""
    registry = registry or default_registry()
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_trigger).load(path)
    return registry.read(registry.typed(files))


def first_seen(rows: DataFrame, content: str, time: str, delay: str = "1 hour") -> DataFrame:
    """Rows whose content hasn't come within the watermark; the state holds digests, not contents."""
    keyed = rows.withColumn("sha256", F.sha2(F.col(content).cast("binary"), 256)).withWatermark(time, delay)
    return keyed.dropDuplicatesWithinWatermark(["sha256"])


def windowed_counts(events: DataFrame, time: str, by: list[str], window: str = "1 hour", slide: str | None = None, delay: str = "2 hours", value: str = "value") -> DataFrame:
    """(start, end, by, n, total) per tumbling or sliding window; late rows beyond the watermark are dropped."""
    w = F.window(time, window, slide) if slide else F.window(time, window)
    out = events.withWatermark(time, delay).groupBy(w.alias("_w"), *by).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("_w.start").alias("start"), F.col("_w.end").alias("end"), *by, "n", "total")


def sessions(events: DataFrame, time: str, by: list[str], gap: str = "30 minutes", delay: str = "2 hours") -> DataFrame:
    """(start, end, by, n) of sessions that end after a gap."""
    out = events.withWatermark(time, delay).groupBy(F.session_window(time, gap).alias("_w"), *by).agg(F.count("*").alias("n"))
    return out.select(F.col("_w.start").alias("start"), F.col("_w.end").alias("end"), *by, "n")


def running_totals(events: DataFrame, key: str, value: str) -> DataFrame:
    """(key, n, total, largest), in update mode again with every trigger that brings rows of the key: plain
    aggregates, whose state is a few numbers a key. Nulls count as rows and add nothing; a key that only has
    nulls has a total of 0 and no largest value."""
    v = F.col(value).cast("double")
    return events.groupBy(key).agg(F.count("*").alias("n"), F.coalesce(F.sum(v), F.lit(0.0)).alias("total"), F.max(v).alias("largest"))
