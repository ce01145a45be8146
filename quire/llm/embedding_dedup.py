"""Near-duplicate embeddings: iterative quantisation, multi-index Hamming tables, exact reranking.

Codes are the signs of a vector after a learned rotation (ITQ): the rotation that brings centred,
decorrelated vectors nearest to a binary cube, found by alternating signs and a Procrustes solution. Each
code is cut into substrings, a table each; two vectors that share a substring (and label) meet in a bucket
and are compared by the cosine of their original vectors. Several rotations, from different starts, give as
many tables as the wanted recall needs at the similarity threshold. Equal vectors go as one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from quire.llm.common import cells, runs
from quire.llm.jaccard_join import _Links
from quire.plans.components import connected_components
from quire.plans.scratch import Scratch

#: Bits of a code per rotation at most, and rows of a bucket's chunk.
MAX_BITS, CHUNK_ROWS = 64, 1024


def fit_rotation(x: np.ndarray, bits: int, seed: int, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """(mean, projection dim x bits) of iterative quantisation over the rows of ``x``."""
    mean = x.mean(0)
    c = x - mean
    _, vectors = np.linalg.eigh(c.T @ c)
    principal = vectors[:, ::-1][:, :bits]
    v = c @ principal
    r, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((bits, bits)))
    for _ in range(rounds):
        u, _, w = np.linalg.svd(np.where(v @ r >= 0, 1.0, -1.0).T @ v)
        r = (u @ w).T
    return mean, principal @ r


@dataclass
class Tables:
    """Projections by dimension, and how their codes are cut."""

    models: dict[int, list[tuple[np.ndarray, np.ndarray]]]
    width: int
    tables: int
    seed: int
    #: Tables of dimensions that need more than ``tables``.
    more: dict[int, int] = field(default_factory=dict)
    #: Dimensions with so few vectors that all of a label share one bucket.
    whole: set[int] = field(default_factory=set)

    def of(self, dim: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """A dimension that isn't fitted gets random rotations, the same everywhere."""
        if dim not in self.models:
            self.models[dim] = [self.turned(dim, i) for i in range(-(-self.tables // self.per(dim)))]
        return self.models[dim]

    def per(self, dim: int) -> int:
        """Tables that a rotation gives."""
        bits = min(dim, MAX_BITS)
        return max(1, bits // min(self.width, bits))

    def turned(self, dim: int, i: int) -> tuple[np.ndarray, np.ndarray]:
        """A random rotation about the origin: its bits differ by the angle of the vectors themselves."""
        draw = np.random.default_rng([self.seed, dim, i])
        return np.zeros(dim), np.linalg.qr(draw.standard_normal((dim, dim)))[0][:, : min(dim, MAX_BITS)]

    def met(self, x: np.ndarray, y: np.ndarray) -> float:
        """The share of these pairs that meet in a table."""
        return float((self.keys(x) == self.keys(y)).any(1).mean())

    def keys(self, x: np.ndarray) -> np.ndarray:
        """rows x tables: the substrings of the codes. Vectors and projections are rounded to integers whose
        sums of products a double holds exactly, so a vector has one code whatever batch it is in."""
        dim = x.shape[1]
        if dim in self.whole:
            return np.zeros((len(x), 1), np.int64)
        scale = 2.0 ** ((52 - math.ceil(math.log2(dim + 1))) // 2)
        fixed, out = np.rint(x * scale), []
        for mean, projection in self.of(dim):
            turn = np.rint(projection * scale)
            bits = fixed @ turn >= np.rint(mean * scale) @ turn
            width = min(self.width, bits.shape[1])
            for i in range(0, bits.shape[1] - width + 1, width):
                out.append(bits[:, i : i + width] @ (np.int64(1) << np.arange(width, dtype=np.int64)))
        return np.stack(out[: self.more.get(dim, self.tables)], 1)


def plan_tables(n: int, threshold: float, recall: float) -> tuple[int, int]:
    """(bits of a substring, tables): substrings grow with the logarithm of the rows, so that buckets of
    unlike vectors stay small; tables are as many as a pair at the threshold needs to share one with the
    wanted probability. A bit differs with probability angle / pi."""
    width = min(max(8, math.ceil(math.log2(max(n, 2))) - 6), 32)
    same = (1 - math.acos(threshold) / math.pi) ** width
    return width, max(1, math.ceil(math.log(1 - recall) / math.log(1 - same)))


def pairs_at(x: np.ndarray, threshold: float, seed: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Unit vectors turned to the threshold's angle: in any direction, and towards another one."""
    draw, out = np.random.default_rng(seed), []
    for way in (draw.standard_normal(x.shape), x[draw.permutation(len(x))]):
        way = way - (way * x).sum(1, keepdims=True) * x
        size = np.sqrt((way * way).sum(1))
        fine = size > 1e-6  # a copy shows no direction
        if fine.any():
            out.append((x[fine], threshold * x[fine] + math.sqrt(1 - threshold**2) * way[fine] / size[fine, None]))
    return out


def add_tables(tables: Tables, x: np.ndarray, threshold: float, recall: float) -> None:
    """Add tables for the vectors' dimension until pairs at the threshold meet with the wanted recall. Bits are
    of centred vectors, whose angles are larger than the plan's where the vectors have a common direction;
    where four times the plan doesn't do, rotations about the origin take over, for which the plan holds."""
    dim, pairs = x.shape[1], pairs_at(x, threshold, tables.seed)
    models, per, centred = tables.models[dim], tables.per(dim), True
    n = tables.tables
    while min((tables.met(*p) for p in pairs), default=1.0) < recall:
        n += 1
        if centred and n > 4 * tables.tables:
            centred, n = False, tables.tables
            models.clear()
        while len(models) * per < n:
            i = len(models)
            models.append(fit_rotation(x, min(dim, MAX_BITS), tables.seed + i) if centred else tables.turned(dim, i))
        tables.more[dim] = n


def _unit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which rows can link, the unit vectors of these in double precision)."""
    with np.errstate(all="ignore"):
        top = np.abs(x).max(1, initial=0)
        fine = np.isfinite(x).all(1) & (top > 0)
        x = x[fine].astype(np.float64)
        x /= np.abs(x).max(1, initial=0, keepdims=True)
        return fine, x / np.sqrt((x * x).sum(1, keepdims=True))


def _clean(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, their components as they are, unit vectors) by dimension, of vectors that can link."""
    lists = batch["v"]
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    for dim in np.unique(sizes[sizes > 0]):
        rows = np.flatnonzero(sizes == dim)
        raw = lists.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
        fine, x = _unit(raw)
        yield rows[fine], raw[fine], x


def _spread(shared, payload: bool):
    """A row for each vector and table; with ``payload``, its copies and components too."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                for rows, raw, x in _clean(part):
                    if not len(rows):
                        continue
                    keys = tables.keys(x)
                    n, t = keys.shape
                    which = np.repeat(np.arange(n), t)
                    take = pa.array(rows[which])
                    columns = {"label": part["label"].take(take), "dim": pa.array(np.full(n * t, x.shape[1], np.int32)), "tab": pa.array(np.tile(np.arange(t, dtype=np.int32), n)), "key": pa.array(keys.ravel())}
                    if payload:
                        columns |= {"uid": part["uid"].take(take), "copies": part["copies"].take(take), "x": pa.array([v.tobytes() for v in raw], pa.binary()).take(pa.array(which))}
                    yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return spread


def _least_reached(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n rows the smallest row that the pairs (i, j) reach from it."""
    out = np.arange(n)
    while True:
        low = np.minimum(out[i], out[j])
        new = out.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == out).all():
            return out
        out = new


def _compare(shared, threshold: float, kind: type):
    keys = ["label", "dim", "tab", "key", "cell_i", "cell_j"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, links = shared.value, _Links()
        for table, starts in runs(batches, keys):
            ids, copies, tab, chunk, ci, cj = (table[c].to_numpy() for c in ("uid", "copies", "tab", "chunk", "cell_i", "cell_j"))
            degree = np.zeros(len(ids), np.int64)
            for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(ids)], strict=True):
                if e - s < 2:
                    continue
                raw = np.frombuffer(b"".join(table["x"].slice(s, e - s).to_pylist()), kind).reshape(e - s, -1)
                x = _unit(raw)[1]
                ch, across = chunk[s:e], ci[s] != cj[s]
                pairs = []
                for a in range(0, e - s, 256):
                    i, j = np.nonzero(x[a : a + 256] @ x.T >= threshold)
                    i += a
                    ok = i < j
                    if across:
                        ok &= ch[i] != ch[j]
                    pairs.append((i[ok], j[ok]))
                i, j = (np.concatenate(p) for p in zip(*pairs, strict=True))
                if not len(i):
                    continue
                if tab[s]:  # a pair counts in the first table that both are in a bucket of
                    some, at = np.unique(np.concatenate([i, j]), return_inverse=True)
                    code = tables.keys(x[some])[:, : tab[s]]
                    p, q = at[: len(i)], at[len(i) :]
                    new = np.empty(len(i), bool)
                    for a in range(0, len(i), 100_000):
                        new[a : a + 100_000] = ~(code[p[a : a + 100_000]] == code[q[a : a + 100_000]]).any(1)
                    i, j = i[new], j[new]
                np.add.at(degree, s + i, copies[s + j])
                np.add.at(degree, s + j, copies[s + i])
                root = _least_reached(e - s, i, j)
                for p in np.flatnonzero(root != np.arange(e - s)).tolist():
                    links.join(int(ids[s + p]), int(ids[s + root[p]]))
            some = np.flatnonzero(degree)
            if len(some):
                nothing = pa.nulls(len(some), pa.int64())
                yield pa.RecordBatch.from_arrays([nothing, nothing, pa.array(ids[some]), pa.array(degree[some])], ["a", "b", "uid", "links"])
            for edges in links.flush():
                nothing = pa.nulls(edges.num_rows, pa.int64())
                yield pa.RecordBatch.from_arrays([edges["a"], edges["b"], nothing, nothing], ["a", "b", "uid", "links"])

    return compare


def fit_tables(vectors: DataFrame, threshold: float, recall: float, sample: int, seed: int, max_dims: int) -> Tables:
    """Fit on at most ``sample`` vectors (those with the smallest hashes) of each of the ``max_dims`` commonest
    dimensions; plan for the largest label, and add tables where pairs made of the sample meet too rarely. A
    dimension with fewer than twice as many vectors as components is one bucket a label, where all are compared."""
    per_label = vectors.groupBy("label").count().agg(F.max("count")).first()[0] or 1
    width, tables = plan_tables(per_label, threshold, recall)
    out = Tables({}, width, tables, seed)
    good = vectors.where("size(v) > 0")
    for dim, n in good.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(max_dims).collect():
        if n < 2 * dim:
            out.whole.add(dim)
            continue
        rows = good.where(F.size("v") == dim).orderBy(F.xxhash64("uid"), "uid").limit(sample).select("v").toArrow().combine_chunks()
        parts = [x for b in rows.to_batches() for _, _, x in _clean(b)]
        x = np.concatenate(parts) if parts else np.empty((0, dim))
        if len(x) >= 2 * dim:
            out.models[dim] = [fit_rotation(x, min(dim, MAX_BITS), seed + i) for i in range(-(-tables // out.per(dim)))]
            add_tables(out, x, threshold, recall)
    return out


def dedup_embeddings(vectors: DataFrame, threshold: float = 0.93, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", recall: float = 0.97, sample: int = 4_096, seed: int = 0, max_dims: int = 64, broadcast_keys: int = 500_000) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors``.

    Vectors of equal, non-null labels and equal dimensions link if the cosine of their original vectors, in
    double precision, is ``threshold`` or more. Vectors that are null, empty, zero or hold null or
    non-finite components, and those with a null label, link with nothing. ``n_links`` counts the other rows
    linked directly; ``component_id`` is the smallest id reachable (its own without links), and the row that
    bears it is ``kept``. Repeated rows link with each other. An empty table gives no rows. No pair below the
    threshold links; a pair at the threshold is found with probability ``recall``, closer ones more surely,
    copies always.

    The rotations are fitted on ``sample`` vectors of a dimension on the driver; all vectors are indexed.
    Dimensions beyond the ``max_dims`` commonest get rotations about the origin, for which the plan's recall
    holds without a fit. Equal vectors are one row with their number. A bucket with more than ``CHUNK_ROWS``
    rows is dealt into cells in which all its pairs meet; pairs are counted where they are compared, and only
    counts and a spanning forest leave a task.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "embeddings")
    single = isinstance(vectors.schema[embedding].dataType, ArrayType) and isinstance(vectors.schema[embedding].dataType.elementType, FloatType)
    v = F.col(embedding).cast("array<float>" if single else "array<double>")
    rows = scratch.keep(vectors.select(F.col(vec_id).alias("vec_id"), v.alias("v"), F.xxhash64(F.col(label).cast("string")).alias("label"), (v.isNotNull() & F.col(label).isNotNull()).alias("some"), F.monotonically_increasing_id().alias("uid")))
    rows = rows.withColumns({"h": F.xxhash64("label", "v"), "g": F.xxhash64("v", "label", F.lit(1))})
    classes = scratch.keep(rows.where("some").groupBy("h", "g").agg(F.min("uid").alias("rep"), F.count("*").alias("copies"), F.min("vec_id").alias("first_id")))
    several = classes.where("copies > 1")
    several = F.broadcast(several) if several.count() <= broadcast_keys else several
    ones = rows.where("some").join(several.select("h", "g", "rep", "copies"), ["h", "g"], "left").where("rep IS NULL OR rep = uid")
    ones = ones.select("uid", "label", "v", F.coalesce("copies", F.lit(1)).cast("long").alias("copies"))
    shared = spark.sparkContext.broadcast(fit_tables(ones, threshold, recall, sample, seed, max_dims))
    at = ["label", "dim", "tab", "key"]
    kind = "label long, dim int, tab int, key long"
    full = ones.select("label", "v").mapInArrow(_spread(shared, False), kind).groupBy(*at).agg(F.count("*").alias("rows"))
    full = scratch.keep(full.where(F.col("rows") > CHUNK_ROWS))
    full = F.broadcast(full) if full.count() <= broadcast_keys else full
    spread = ones.mapInArrow(_spread(shared, True), kind + ", uid long, copies long, x binary")
    met = cells(spread.join(full, at, "left").fillna(1, ["rows"]), "rows", "uid", F.lit(CHUNK_ROWS)).drop("rows")
    keys = [*at, "cell_i", "cell_j"]
    met = met.repartition(*keys).sortWithinPartitions(*keys)
    found = scratch.keep(met.mapInArrow(_compare(shared, threshold, np.float32 if single else np.float64), "a long, b long, uid long, links long"))
    links = found.where("uid IS NOT NULL").groupBy("uid").agg(F.sum("links").alias("n"))
    joined = connected_components(spark, found.where("a IS NOT NULL").select("a", "b"), scratch)
    named = scratch.keep(joined.join(classes.select(F.col("rep").alias("node"), "first_id"), "node"))
    least = scratch.keep(named.groupBy("component").agg(F.min("first_id").alias("component_id")))
    named = named.join(least, "component").select(F.col("node").alias("uid"), "component_id")
    # a vector that can't link has a class of its own kind, but no links, not even with its copies
    able = F.exists("v", lambda x: x != 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    final = classes.withColumnRenamed("rep", "uid").join(links, "uid", "left").join(named, "uid", "left")
    final = scratch.keep(final.where("copies > 1 OR n IS NOT NULL").select("h", "g", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component_id", "first_id").alias("component_id")))
    final = F.broadcast(final) if final.count() <= broadcast_keys else final
    joins = F.coalesce(F.col("some") & able, F.lit(False))
    out = rows.withColumn("able", joins).join(final, ["h", "g"], "left")
    component = F.when(F.col("able"), F.coalesce("component_id", "vec_id")).otherwise(F.col("vec_id"))
    n_links = F.when(F.col("able"), F.coalesce("n_links", F.lit(0))).otherwise(0).cast("long")
    return out.select("vec_id", n_links.alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
