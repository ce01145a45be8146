"""Duplicates, comparisons of snapshots, and first-wins resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def content_hash(content: Column, algorithm: str = "sha256") -> Column:
    """Hexadecimal digest by name; crc32 as eight digits."""
    c = content.cast("binary")
    made = {"sha256": F.sha2(c, 256), "sha384": F.sha2(c, 384), "sha512": F.sha2(c, 512), "sha224": F.sha2(c, 224), "sha1": F.sha1(c), "md5": F.md5(c), "crc32": F.lpad(F.lower(F.hex(F.crc32(c))), 8, "0")}
    if algorithm not in made:
        raise ValueError(f"unknown digest {algorithm!r}")
    return made[algorithm]


def duplicate_groups(rows: DataFrame, content: str, row_id: str) -> DataFrame:
    """(sha256, n, ids) of contents that two rows or more share; ids in order. Null contents are left out.

    Groups are found by partial aggregation; the ids of a group are gathered only here, where they are the
    result. For groups of any size use ``canonical_rows``.
    """
    keyed = rows.where(F.col(content).isNotNull()).select(content_hash(F.col(content)).alias("sha256"), F.col(row_id).alias("_id"))
    shared = keyed.groupBy("sha256").agg(F.count("*").alias("n")).where("n > 1")
    return keyed.join(shared, "sha256").groupBy("sha256").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("_id")).alias("ids"))


def canonical_rows(rows: DataFrame, content: str, row_id: str) -> DataFrame:
    """(row_id, canonical_id) of every row whose content an earlier row has too; the smallest id is canonical.

    The smallest id of a content is a partial aggregate, and goes back to the rows by a join that Spark can
    split where one content is very frequent; no window holds a whole group.
    """
    keyed = rows.where(F.col(content).isNotNull()).select(content_hash(F.col(content)).alias("_h"), F.col(row_id))
    least = keyed.groupBy("_h").agg(F.min(row_id).alias("canonical_id"), F.count("*").alias("_n")).where("_n > 1")
    return keyed.join(least, "_h").where(F.col(row_id) != F.col("canonical_id")).select(row_id, "canonical_id")


def diff_snapshots(before: DataFrame, after: DataFrame, locator: str | list[str], content: str = "sha256", storage: str | None = None, details: str | None = None) -> DataFrame:
    """(locator, status): added, removed, content_changed or storage_changed; equal items are left out.

    Storage has changed where contents agree but the stored digest or the details don't. Locators must be
    unique on each side: use ``repeated_locators`` first.
    """
    keys = [locator] if isinstance(locator, str) else locator
    rest = [c for c in (content, storage, details) if c]
    b = before.select(*keys, F.struct(*rest).alias("_b"))
    a = after.select(*keys, F.struct(*rest).alias("_a"))
    same = lambda c: F.col("_b")[c].eqNullSafe(F.col("_a")[c])
    status = F.when(F.col("_b").isNull(), "added").when(F.col("_a").isNull(), "removed").when(~same(content), "content_changed")
    for c in (storage, details):
        if c:
            status = status.when(~same(c), "storage_changed")
    return b.join(a, keys, "full_outer").select(*keys, status.alias("status")).where("status IS NOT NULL")


def repeated_locators(rows: DataFrame, locator: list[str]) -> DataFrame:
    return rows.groupBy(*locator).agg(F.count("*").alias("n")).where("n > 1")


def first_wins(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in a total order; a row of any state shadows those behind it.

    One partial aggregate per key (the smallest order with its row), not a window."""
    others = [c for c in rows.columns if c not in keys]
    rank = F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(order)])
    best = rows.groupBy(*keys).agg(F.min_by(F.struct(*others), rank).alias("_r"))
    return best.select(*keys, *[F.col("_r")[c].alias(c) for c in others])


def set_algebra(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, side): left, right or both, over the distinct keys."""
    a = left.select(*keys).distinct().withColumn("_l", F.lit(True))
    b = right.select(*keys).distinct().withColumn("_r", F.lit(True))
    side = F.when(F.col("_r").isNull(), "left").when(F.col("_l").isNull(), "right").otherwise("both")
    return a.join(b, keys, "full_outer").select(*keys, side.alias("side"))


def consume_as_multiset(wanted: DataFrame, held: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Add ``matched`` to ``wanted``: of the rows with a key, in order, as many match as ``held`` has."""
    n = held.groupBy(*keys).agg(F.count("*").alias("_held"))
    w = Window.partitionBy(*keys).orderBy(*order)
    ranked = wanted.withColumn("_rank", F.row_number().over(w))
    return ranked.join(n, keys, "left").withColumn("matched", F.coalesce(F.col("_rank") <= F.col("_held"), F.lit(False))).drop("_rank", "_held")
