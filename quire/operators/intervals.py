"""Intervals on lines: merging, covering, gaps, islands and complements."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def merge_intervals(rows: DataFrame, by: list[str], start: str = "start", end: str = "end", touch: float = 0.0) -> DataFrame:
    """(by, start, end) of the unions of intervals that overlap or lie at most ``touch`` apart."""
    w = Window.partitionBy(*by).orderBy(start, end)
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(before.isNull() | (F.col(start) > before + touch), 1).otherwise(0)
    islands = rows.withColumn("_new", new).withColumn("_island", F.sum("_new").over(w))
    return islands.groupBy(*by, "_island").agg(F.min(start).alias("start"), F.max(end).alias("end")).drop("_island")


def covers(rows: DataFrame, by: list[str], low: str, high: str, start: str = "start", end: str = "end", tolerance: float = 0.001) -> DataFrame:
    """(by, covered): whether the intervals of a key cover [low, high] without a gap over the tolerance.
    ``low`` and ``high`` are columns with one value per key."""
    w = Window.partitionBy(*by).orderBy(start, end)
    reach = F.greatest(F.coalesce(F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.col(low)), F.col(low))
    # what begins behind the range can't open a gap in it
    joined = (F.col(start) <= reach + tolerance) | (reach >= F.col(high) - tolerance)
    return rows.withColumn("_ok", joined).groupBy(*by).agg((F.bool_and("_ok") & (F.max(end) >= F.max(high) - tolerance)).alias("covered"))


def largest_gap(rows: DataFrame, by: list[str], at: str) -> DataFrame:
    """(by, gap_start, gap_end, gap): the widest distance between neighbours, the first of equals; keys with
    one value are left out."""
    after = F.lead(at).over(Window.partitionBy(*by).orderBy(at))
    gaps = rows.withColumn("_next", after).where("_next IS NOT NULL").withColumn("_gap", F.col("_next") - F.col(at))
    best = gaps.groupBy(*by).agg(F.max(F.struct(F.col("_gap"), (-F.col(at)).alias("_at"), F.col("_next"))).alias("_b"))
    return best.select(*by, (-F.col("_b._at")).alias("gap_start"), F.col("_b._next").alias("gap_end"), F.col("_b._gap").alias("gap"))


def complement(rows: DataFrame, by: list[str], low: str, high: str, start: str = "start", end: str = "end") -> DataFrame:
    """(by, start, end) of the strips of [low, high] that no interval covers; an interval ends a strip."""
    merged = merge_intervals(rows.withColumn(start, F.col(start)), by, start, end)
    frame = rows.groupBy(*by).agg(F.max(low).alias("_low"), F.max(high).alias("_high"))
    w = Window.partitionBy(*by).orderBy("start")
    gaps = merged.join(frame, by).withColumn("_from", F.greatest(F.coalesce(F.lag("end").over(w), F.col("_low")), F.col("_low")))
    inner = gaps.select(*by, F.col("_from").alias("start"), F.least("start", "_high").alias("end"))
    tail = merged.groupBy(*by).agg(F.max("end").alias("_e")).join(frame, by).select(*by, F.greatest("_e", "_low").alias("start"), F.col("_high").alias("end"))
    return inner.unionByName(tail).where(F.col("start") < F.col("end"))


def touching_stacks(rows: DataFrame, by: list[str], start: str = "y0", end: str = "y1", gap: float = 0.1) -> DataFrame:
    """Add ``stack``: boxes of a key that follow each other at most ``gap`` apart share a number, from 0."""
    w = Window.partitionBy(*by).orderBy(start, end)
    apart = F.col(start) - F.lag(end).over(w) > gap
    return rows.withColumn("stack", F.sum(F.when(apart, 1).otherwise(0)).over(w))


def overlapping_spans(rows: DataFrame, by: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """Add ``overlaps``: whether a span begins before an earlier one of its key has ended."""
    w = Window.partitionBy(*by).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("overlaps", F.coalesce(F.col(start) < F.max(end).over(w), F.lit(False)))
