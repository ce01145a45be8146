"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.plans.scratch import Scratch

#: Hexadecimal digits of a digest that make a uniform number.
DIGITS = 13
#: A step's chance below which no hash can reach it.
TINY = 2.0**-52
#: Chances of all sources that may be broadcast together.
BROADCAST_STEPS = 4_000_000


def least_count(rate: float) -> int:
    """A count below which no hash can stay: 9 deviations under the mean, 0 up to a mean of 81."""
    return max(0, math.floor(rate - 9 * math.sqrt(rate)))


def thresholds(rate: float) -> list[float]:
    """P(k <= i), P(k <= i + 1), ... of a Poisson with this mean from i = ``least_count``, until no hash lies above."""
    if rate <= 0:
        return [1.0]
    k = least_count(rate)
    out, log_p, total = [], k * math.log(rate) - rate - math.lgamma(k + 1), 0.0
    while True:
        total += math.exp(log_p)
        out.append(min(total, 1.0))
        if k > rate and math.exp(log_p) < TINY:
            return out
        k += 1
        log_p += math.log(rate) - math.log(k)


def mix_sources(docs: DataFrame, weights: dict[str | None, float] | None = None, temperature: float = 0.5, total: float | None = None, source: str = "source", doc_id: str = "doc_id", seed: int = 0, broadcast_sources: int = 20_000, salts: int = 64) -> DataFrame:
    """Replicate each document a Poisson number of times so that sources come out at their weights.

    A source's mean repetition rate is weight * ``total`` / (its documents), ``total`` being the number of
    documents where it is None. ``weights`` are normalised over the sources that are there; a source that
    they don't name gets none. Without ``weights``, a source weighs (its documents) ** ``temperature``.
    Rates have no limit, so a rare source never ends a run. Null sources are one source. An empty input,
    or weights for none of its sources, give no rows.

    A document's count inverts the Poisson distribution at a uniform number made of the MD5 digest of
    seed and id (null: empty), so rows with one id get one count. Copies then move to a place given by the digest
    of document and copy, and are in the order of that digest within each partition: a global shuffle.
    Adds ``rate, n_copies, copy, shuffle_key`` (columns of these names are replaced); rows with a count
    of 0 are gone. Repeated rows are replicated alike; long texts only travel.

    Rates return to the documents by a broadcast where the sources are at most ``broadcast_sources`` and
    have at most ``BROADCAST_STEPS`` chances, else by a join whose keys are dealt over ``salts``.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mixing")
    name = F.col(source).cast("string")
    sizes = scratch.keep(docs.groupBy(name.alias("_s")).agg(F.count("*").alias("_n")))
    given = None
    if weights is not None:
        given = spark.createDataFrame([(k, float(v)) for k, v in weights.items()] or [(None, 0.0)], "_k string, _w double")
        weighed = sizes.join(given, sizes["_s"].eqNullSafe(given["_k"]), "left").select("_s", "_n", F.coalesce("_w", F.lit(0.0)).alias("_w"))
    else:
        weighed = sizes.withColumn("_w", F.pow(F.col("_n"), F.lit(temperature)))
    n_sources, n_docs, all_weights = weighed.agg(F.count("*"), F.sum("_n"), F.sum("_w")).first()
    want = float(n_docs or 0) if total is None else float(total)
    share = want / all_weights if all_weights else 0.0
    rates = scratch.keep(weighed.select("_s", (F.col("_w") * share / F.col("_n")).alias("rate")))
    rates = scratch.keep(rates.withColumn("_steps", _steps()(F.col("rate"))).withColumn("_least", F.greatest(F.lit(0), F.floor(F.col("rate") - 9 * F.sqrt("rate")))))
    n_steps = rates.agg(F.sum(F.size("_steps"))).first()[0] or 0
    own = {c: f"_mix_{c}" for c in ("source", "steps", "least", "u", "salt", "rate")}
    rates = rates.select(F.col("_s").alias(own["source"]), F.col("rate").alias(own["rate"]), F.col("_steps").alias(own["steps"]), F.col("_least").alias(own["least"]))
    docs = docs.drop("rate", "n_copies", "copy", "shuffle_key")
    key = F.concat_ws("\x1f", F.lit(str(seed)), F.coalesce(F.col(doc_id).cast("string"), F.lit("")))
    u = F.conv(F.substring(F.md5(key.cast("binary")), 1, DIGITS), 16, 10).cast("long") / F.lit(float(16**DIGITS))
    docs = docs.withColumn(own["u"], u)
    same = F.col(source).cast("string").eqNullSafe(F.col(own["source"]))
    if n_sources <= broadcast_sources and n_steps <= BROADCAST_STEPS:
        joined = docs.join(F.broadcast(rates), same)
    else:
        dealt = docs.withColumn(own["salt"], F.pmod(F.xxhash64(doc_id), F.lit(salts)))
        spread = rates.withColumn("_mix_z", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
        joined = dealt.join(spread, same & (F.col(own["salt"]) == F.col("_mix_z"))).drop(own["salt"], "_mix_z")
    # chances up to u, counted without a lambda: the optimiser moves the count into the join's condition, which can't bind one
    steps, at = F.col(own["steps"]), F.col(own["u"])
    above = F.array_position(F.sort_array(F.array_append(steps, at), asc=False), at) - 1
    counted = joined.withColumn("n_copies", (F.col(own["least"]) + F.size(steps) - above).cast("int")).withColumn("rate", F.col(own["rate"]))
    copies = counted.where("n_copies > 0").drop(*own.values()).withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("n_copies") - 1)))
    place = F.md5(F.concat_ws("\x1f", key, F.col("copy").cast("string"), F.lit("place")).cast("binary"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return copies.withColumn("shuffle_key", place).repartition(n, "shuffle_key").sortWithinPartitions("shuffle_key", doc_id)


def _steps():
    @F.arrow_udf("array<double>")
    def steps(rates: pa.Array) -> pa.Array:  # a row per source, not per document
        return pa.array([thresholds(r) for r in rates.to_pylist()], pa.list_(pa.float64()))

    return steps
