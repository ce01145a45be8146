"""Sharding: minimax contiguous partition of ordered atomic groups."""

from __future__ import annotations

import bisect

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.plans.scratch import Scratch

#: Buckets of a level of the histogram, and so rows of its result.
BINS = 4096
#: Hexadecimal digits of a digest that pick its bucket: 4096 buckets.
DIGITS = 3


class _Level:
    """Smallest and largest group end in each bucket of [low, low + step * BINS)."""

    def __init__(self, low: int, step: int, rows: list[tuple[int, int, int]]):
        self.low, self.high, self.step = low, low + step * BINS, step
        self.rows = sorted(rows)
        self.at = [b for b, _, _ in self.rows]

    def floor(self, x: int) -> tuple[int, int] | None:
        """Bounds of the last end up to x; None if it lies before this level."""
        i = bisect.bisect_right(self.at, (x - self.low) // self.step) - 1
        if i < 0:
            return None
        bucket, least, most = self.rows[i]
        if x >= most:
            return most, most
        if x < least:
            return (self.rows[i - 1][2],) * 2 if i else None
        return least, min(x, most)


class Ends:
    """The ends of all groups on a line of bytes, known more finely where a cut may fall.

    ``look(low, step)`` returns (bucket, least, most) of the ends in a window; each call is one
    aggregation whose result has at most ``BINS`` rows, whatever the number of groups.
    """

    def __init__(self, total: int, look):
        self.total, self.look = total, look
        self.levels = [_Level(0, s := -(-(total + 1) // BINS), look(0, s))]

    def floor(self, x: int) -> tuple[int, int]:
        """Bounds of the largest end not above x; 0 where there is none."""
        x, best = min(x, self.total), (0, 0)
        for level in self.levels:
            if level.low <= x < level.high:
                found = level.floor(x)
                if found is None:
                    continue
                best = max(best[0], found[0]), found[1] if found[0] == found[1] else min(found[1], best[1] or found[1])
                if best[0] >= best[1]:
                    return found
        return best

    def walk(self, capacity: int, shards: int, side: int) -> list[int]:
        """Greedy ends of the shards, each step at its lower (0) or upper (1) bound."""
        at, out = 0, []
        for _ in range(shards):
            at = max(at, self.floor(at + capacity)[side])
            out.append(at)
        return out

    def _least(self, low: int, high: int, shards: int, side: int) -> int:
        """The smallest capacity in [low, high] that reaches the end on that side; high is taken to."""
        while low < high:
            mid = (low + high) // 2
            if self.walk(mid, shards, side)[-1] >= self.total:
                high = mid
            else:
                low = mid + 1
        return low

    def cuts(self, shards: int) -> tuple[int, list[int]]:
        """The smallest feasible capacity, and the end of each shard under it."""
        low, high = -(-self.total // shards), self.total
        while True:
            sure = self._least(low, high, shards, 0)
            low = self._least(low, sure, shards, 1)
            high = sure
            near, far = self.walk(low, shards, 0), self.walk(high, shards, 1)
            if low == high and near == far:
                return low, near
            seen = set()
            for a, b in zip([0, *near], [0, *far], strict=False):
                lo, hi = a + low, min(b + high, self.total)
                if lo > self.total:
                    continue
                fine = min((v for v in self.levels if v.low <= lo and hi < v.high), key=lambda v: v.step)
                lo -= (lo - fine.low) % fine.step
                step = max(1, -(-(hi - lo + 1) // BINS))
                if step < fine.step and (lo, step) not in seen:
                    seen.add((lo, step))
                    self.levels.append(_Level(lo, step, self.look(lo, step)))
            if not seen:  # every window is as fine as bytes are
                return high, self.walk(high, shards, 0)


def shard_documents(docs: DataFrame, shards: int = 8, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every row of ``docs``.

    Atomic groups are equal texts (null texts are one group), in the order of their SHA-256 digests. The
    shards are runs of that order; the largest shard is as small as any such partition allows: the
    smallest feasible capacity is found by binary search with a greedy check, and the greedy ends under it
    are the cuts. A size is the text's UTF-8 bytes plus 1. ``slot`` counts a shard's rows from 0 without
    gaps. ``text_crc32`` of a null text is null. An empty input gives no rows; fewer groups than shards
    leave the last shards empty; repeated rows each get a slot.

    A row finds its shard by comparing its digest with the cuts, so the documents are read once and their
    texts never move. A group that holds a third of all rows is one row after partial aggregation.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "sharding")
    t = F.col(text)
    rows = scratch.keep(
        docs.select(
            F.col(doc_id).alias("doc_id"),
            (F.coalesce(F.octet_length(t), F.lit(0)).cast("long") + 1).alias("size"),
            F.crc32(t.cast("binary")).alias("text_crc32"),
            F.coalesce(F.sha2(t.cast("binary"), 256), F.lit("")).alias("g"),
            F.spark_partition_id().alias("part"),
            F.monotonically_increasing_id().alias("at"),
        )
    )
    bucket = F.coalesce(F.conv(F.substring("g", 1, DIGITS), 16, 10).cast("int"), F.lit(0)).alias("bucket")
    groups = scratch.keep(rows.groupBy("g").agg(F.sum("size").alias("bytes")).select("g", "bytes", bucket))
    before, total = [], 0
    for b, n in sorted(map(tuple, groups.groupBy("bucket").agg(F.sum("bytes")).collect())):  # at most 4096 rows
        before.append((b, total))
        total += n
    offsets = spark.createDataFrame(before, "bucket int, before long")
    running = F.sum("bytes").over(Window.partitionBy("bucket").orderBy("g").rowsBetween(Window.unboundedPreceding, 0))
    ends = scratch.keep(groups.withColumn("within", running).join(F.broadcast(offsets), "bucket").select("g", (F.col("before") + F.col("within")).alias("end")))

    def look(low: int, step: int) -> list[tuple[int, int, int]]:
        b = F.floor((F.col("end") - low) / step).cast("int")
        inside = ends.where((F.col("end") >= low) & (F.col("end") < low + step * BINS))
        return [tuple(r) for r in inside.groupBy(b.alias("b")).agg(F.min("end"), F.max("end")).collect()]

    cuts = Ends(total, look).cuts(shards)[1][:-1] if total else []
    digests = sorted(r[0] for r in ends.where(F.col("end").isin(sorted({c for c in cuts if c}))).select("g").collect()) if any(cuts) else []
    by_end = sorted({c for c in cuts if c})
    shard = F.lit(0)
    for c in cuts:  # a cut at 0 leaves shards empty; all rows are behind it
        shard = shard + (F.col("g") > digests[by_end.index(c)]).cast("int") if c else shard + 1
    rows = rows.withColumn("shard", shard.cast("int"))
    counts = rows.groupBy("part", "shard").agg(F.count("*").alias("n"))
    start = F.sum("n").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = scratch.keep(counts.withColumn("start", F.coalesce(start, F.lit(0))).drop("n"))
    slot = F.row_number().over(Window.partitionBy("part", "shard").orderBy("at")) - 1
    placed = rows.withColumn("within", slot).join(starts, ["part", "shard"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("start") + F.col("within")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
