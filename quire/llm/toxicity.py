"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import binary_rows, held_out
from quire.plans.scratch import Scratch

#: ASCII marks count as blanks; letters of other scripts stay.
_MARKS = bytes(32 if chr(i) in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" else i for i in range(256))
#: Odd multipliers for the later words of a gram, and for the kinds of gram.
_NEXT, _SKIP, _FINAL = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F))


def grams(text: bytes, bits: int, words: dict[bytes, int]) -> np.ndarray:
    """Distinct buckets of a text's words, pairs of neighbours, and pairs with one word between."""
    tokens = text.lower().translate(_MARKS).split()
    h = np.empty(len(tokens), np.uint64)
    for i, w in enumerate(tokens):
        v = words.get(w)
        if v is None:
            if len(words) >= 200_000:
                words.clear()
            v = words[w] = xxhash.xxh64_intdigest(w)
        h[i] = v
    parts = [h, h[:-1] * _NEXT + h[1:], h[:-2] * _SKIP + h[2:]]
    mixed = np.concatenate(parts) * _FINAL
    return np.unique((mixed >> np.uint64(64 - bits)).astype(np.int32)) if len(tokens) else np.empty(0, np.int32)


@dataclass
class Ftrl:
    """Per-coordinate FTRL-proximal; a weight is 0 until its gradient sum passes ``l1``."""

    bits: int
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 10.0
    l2: float = 1.0

    def __post_init__(self):
        self.z, self.n, self.bias = np.zeros(1 << self.bits), np.zeros(1 << self.bits), [0.0, 0.0]

    def _weights(self, z, n, l1):
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, label: int) -> None:
        z, n = self.z[at], self.n[at]
        w = self._weights(z, n, self.l1)
        b = float(self._weights(self.bias[0], self.bias[1], 0.0))
        g = 1 / (1 + np.exp(-np.clip(w.sum() + b, -35, 35))) - label
        self.z[at] = z + g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g
        zb, nb = self.bias
        self.bias = [zb + g - (np.sqrt(nb + g * g) - np.sqrt(nb)) / self.alpha * b, nb + g * g]

    def weights(self) -> tuple[np.ndarray, np.ndarray, float]:
        """(buckets, their weights, bias) of what isn't 0."""
        w = self._weights(self.z, self.n, self.l1)
        at = np.flatnonzero(w)
        return at.astype(np.int32), w[at].astype(np.float32), float(self._weights(*self.bias, 0.0))


@dataclass
class ToxicityModel:
    bits: int
    at: np.ndarray
    w: np.ndarray
    bias: float

    def __getstate__(self):
        return {"bits": self.bits, "at": self.at, "w": self.w, "bias": self.bias}

    @cached_property
    def words(self) -> dict[bytes, int]:
        """A process's memory of word hashes; ``grams`` bounds it."""
        return {}

    @cached_property
    def dense(self) -> np.ndarray:
        out = np.zeros(1 << self.bits, np.float32)
        out[self.at] = self.w
        return out


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "toxic", bits: int = 22, epochs: int = 8, max_per_class: int = 6_000, max_grams: int = 40_000_000, **settings) -> ToxicityModel:
    """Learn from labelled rows that aren't held out; a class without rows leaves a constant score.

    Bounds of the sample, so that it is one task's work and memory at any size of the corpus: at most
    ``max_per_class`` labelled ids of each class, those with the smallest hashes; of an id that repeats, the
    text with the smallest digest; and in the order of the hashes as many whole texts of a class as have
    ``max_grams / 2`` distinct grams together (4 bytes each). An id labelled both ways counts as 1. Null and
    empty texts are rows without grams; an empty table leaves the bias at 0.

    Grams are hashed on all executors, the online learner runs over the sample in one task, in hash order,
    ``epochs`` times; non-zero weights return to the driver.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "toxicity")
    known = labels.select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("y")).where(F.col("id").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("id")))
    known = known.groupBy("id").agg(F.max("y").alias("y")).withColumn("order", F.xxhash64("id"))
    taken = [known.where(F.col("y") == y).orderBy("order", "id").limit(max_per_class) for y in (0, 1)]
    sample = F.broadcast(taken[0].unionByName(taken[1]))  # 2 * max_per_class ids at most
    own = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").cast("binary").alias("t")).join(sample, "id")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[bytes, int] = {}
        for batch in batches:
            texts = binary_rows(batch["t"])
            rows = [grams(t, bits, words) for t in texts]
            digests = [xxhash.xxh3_128_digest(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch["order"], batch["y"], pa.array([len(x) for x in rows], pa.int64()), pa.array(digests, pa.binary()), pa.array([x.tobytes() for x in rows], pa.binary())], ["order", "y", "n", "digest", "x"]
            )

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((o, x, y) for b in batches for o, y, x in zip(*(b[c].to_pylist() for c in ("order", "y", "x")), strict=True))
        model = Ftrl(bits, **settings)
        for _ in range(epochs):
            for _, x, y in rows:
                model.learn(np.frombuffer(x, np.int32), y)
        at, w, bias = model.weights()
        yield pa.RecordBatch.from_arrays([pa.array([*at.tolist(), -1], pa.int32()), pa.array([*w.tolist(), bias], pa.float64())], ["at", "w"])

    ready = scratch.keep(own.mapInArrow(features, "order long, y int, n long, digest binary, x binary"))
    chosen = ready.groupBy("order", "y").agg(F.min(F.struct("digest", "n")).alias("c")).select("order", "y", "c.*")
    before = F.sum("n").over(Window.partitionBy("y").orderBy("order").rowsBetween(Window.unboundedPreceding, 0))
    chosen = chosen.withColumn("upto", before).where(F.col("upto") <= max_grams // 2).select("order", "y", "digest")  # the sample's ids at most
    sampled = ready.join(F.broadcast(chosen), ["order", "y", "digest"]).dropDuplicates(["order", "y"])
    found = sampled.select("order", "y", "x").coalesce(1).mapInArrow(learn, "at int, w double").toArrow()
    scratch.drop(ready)
    at, w = found["at"].to_numpy(), found["w"].to_numpy()
    return ToxicityModel(bits, at[at >= 0], w[at >= 0].astype(np.float32), float(w[at < 0].sum()))


def _scorer(shared):
    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        model = shared.value
        sums = [float(model.dense[grams(t, model.bits, model.words)].sum()) + model.bias for t in binary_rows(texts)]
        return pa.array(1 / (1 + np.exp(-np.clip(np.array(sums, float), -35, 35))))

    return score


def score_toxicity(docs: DataFrame, model: ToxicityModel, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (columns of these names are replaced). Null and
    empty texts get the score of the bias alone. The broadcast holds the non-zero weights, 2**bits at most."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    out = docs.withColumn("score", _scorer(shared)(F.col(text).cast("string").cast("binary")))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
