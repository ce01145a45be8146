"""N-gram Jaccard join: documents as count vectors in R-trees, bounded by summed coordinate minima.

A document is its set of distinct word shingles. Shingles are hashed into groups, and a document's group
counts are a point; for two documents the sum of the smaller coordinates bounds the shingles they share.

1. *Routing.* Under one global order of shingles (frequent ones last) two linked documents share some of
   their leading shingles: the bound over the rest is too small. A document goes to the tile of each.
   Exact copies go as one.
2. *Search.* In a tile, an R-tree over the points finds the pairs whose bound admits a link; a node holds
   the largest coordinates below it, so a pair of nodes is left as soon as its summed minima are too small.
   A tile of an infrequent shingle with at most ``SHORT`` rows is a tree of three leaves: it gives its pairs
   of like size, and those that meet in as many tiles as linked documents must are bounded once each. A spanning forest of the surviving pairs joins documents into blocks.
3. *Verification.* Only documents in blocks are shingled again; the R-tree of a block gives the pairs, and
   those whose documents aren't connected yet are compared exactly.

No step is sampled or capped. A tile or block that is too large for one task is first compared with a few
of its own rows; what these connect needs no comparison among itself, so a large group of near copies is
settled in linear work. The other pairs of such a tile or block are dealt into cells that they meet in.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import Forest, binary_rows, runs
from quire.plans.components import connected_components
from quire.plans.scratch import Scratch

#: Groups of a point, and of one with many shingles; powers of two, so that the finer folds into the coarser.
FEW, MANY, LARGE = 64, 512, 1024
#: The largest coordinate; points beyond it aren't bounded. Only sets of tens of millions of shingles have such.
MOST = 65_535
LEAF = 16
#: Rows of a large tile or block that all its rows are compared with first.
PIVOTS = 8
#: Leading shingles that linked documents must share, where they have as many, and the longest tile whose
#: pairs are counted.
SHARED, SHORT = 3, 48
#: The most shingles that are known to be frequent. Only the order of shingles depends on them.
FREQUENT = 500_000
#: Rows of a chunk in a tile; shingles of a chunk in a block.
TILE_ROWS, BLOCK_ROWS, BLOCK_SHINGLES = 512, 1024, 2_000_000
_P, _Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def shingles(text: bytes, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles of ``k`` words, A-Z lower-cased. Fewer words are
    one shingle; no words are none."""
    words = text.lower().split()
    if len(words) < k:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), 1)] if words else [], np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = len(h) - k + 1
    s = np.zeros(n, np.uint64)
    for j in range(k):
        s = (s + h[j : j + n]) * _P
    return np.unique((s ^ (s >> np.uint64(31))) * _Q)


def point(hashes: np.ndarray) -> bytes:
    """Group counts, 16 bits each; nothing where they could overflow."""
    d = MANY if len(hashes) > LARGE else FEW
    counts = np.bincount((hashes & np.uint64(d - 1)).astype(np.int64), minlength=d)
    return b"" if counts.max() > MOST else counts.astype(np.uint16).tobytes()


def _prefixes(n: int, percent: int) -> tuple[int, int]:
    """How many leading shingles a set of n is routed by, and how many as the smaller set of a pair: of two
    linked sets, these hold SHARED common ones, or all that are common."""
    most = lambda least: min(n, n - least + SHARED)
    return most(-(-percent * n // 100)), most(-(-2 * percent * n // (100 + percent)))


class Points:
    """Points of rows: all folded to FEW groups, and the finer ones where there are any."""

    def __init__(self, rows: list[bytes], sizes: np.ndarray):
        self.n = sizes.astype(np.int64)
        self.free = np.array([not r for r in rows], bool)
        self.few = np.zeros((len(rows), FEW), np.uint32)
        self.fine = np.array([len(r) == 2 * MANY for r in rows], bool)
        self.many = np.zeros((int(self.fine.sum()), MANY), np.uint16)
        self.at = np.cumsum(self.fine) - 1
        short = [i for i, r in enumerate(rows) if len(r) == 2 * FEW]
        if short:
            self.few[short] = np.frombuffer(b"".join(rows[i] for i in short), np.uint16).reshape(-1, FEW)
        for i in np.flatnonzero(self.fine):
            v = np.frombuffer(rows[i], np.uint16)
            self.many[self.at[i]] = v
            self.few[i] = v.reshape(-1, FEW).sum(0)

    def admit(self, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
        """Which pairs may be linked: shared * (100 + percent) >= percent * (n + n)."""
        need = percent * (self.n[a] + self.n[b])
        ok = np.minimum(self.n[a], self.n[b]) * (100 + percent) >= need
        free = self.free[a] | self.free[b]
        both = self.fine[a] & self.fine[b]
        for few, rows, step in ((True, np.flatnonzero(ok & ~free & ~both), 65_536), (False, np.flatnonzero(ok & ~free & both), 8_192)):
            for i in range(0, len(rows), step):
                r = rows[i : i + step]
                v, x, y = (self.few, a[r], b[r]) if few else (self.many, self.at[a[r]], self.at[b[r]])
                ok[r] = np.minimum(v[x], v[y]).sum(1, dtype=np.int64) * (100 + percent) >= need[r]
        return ok


def tree_pairs(points: Points, rows: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs among ``rows`` that the bound admits, by a packed R-tree joined with itself.

    Rows are packed in the order of their sizes; a node has the largest coordinates and the smallest and
    largest size below it. Two nodes are opened only if the summed minima of their largest coordinates
    reach what the smallest sizes below them need.
    """
    rows = rows[np.lexsort((points.few[rows].argmax(1), points.n[rows]))]
    starts = np.arange(0, len(rows), LEAF)
    top = np.maximum.reduceat(points.few[rows], starts, 0)
    low, high = np.minimum.reduceat(points.n[rows], starts), np.maximum.reduceat(points.n[rows], starts)
    free = np.maximum.reduceat(points.free[rows], starts)
    levels = [(top, low, high, free)]
    while len(levels[-1][1]) > LEAF:
        t, lo, hi, f = levels[-1]
        s = np.arange(0, len(lo), LEAF)
        levels.append((np.maximum.reduceat(t, s, 0), np.minimum.reduceat(lo, s), np.maximum.reduceat(hi, s), np.maximum.reduceat(f, s)))
    n = len(levels[-1][1])
    a, b = np.triu_indices(n)
    for depth in range(len(levels) - 1, -1, -1):
        t, lo, hi, f = levels[depth]
        keep = np.zeros(len(a), bool)
        for i in range(0, len(a), 65_536):
            x, y = a[i : i + 65_536], b[i : i + 65_536]
            near = 100 * np.minimum(hi[x], hi[y]) >= percent * np.maximum(lo[x], lo[y])
            reach = np.minimum(t[x], t[y]).sum(1, dtype=np.int64) * (100 + percent) >= percent * (lo[x] + lo[y])
            keep[i : i + 65_536] = near & (reach | f[x] | f[y])
        a, b = a[keep], b[keep]
        if depth:
            below = len(levels[depth - 1][1])
            x = (a[:, None] * LEAF + np.arange(LEAF))[:, :, None]
            y = (b[:, None] * LEAF + np.arange(LEAF))[:, None, :]
            x, y = np.broadcast_arrays(x, y)
            ok = (x < below) & (y < below) & (x <= y)
            a, b = x[ok], y[ok]
    for i in range(0, len(a), 256):
        x = (a[i : i + 256, None] * LEAF + np.arange(LEAF))[:, :, None]
        y = (b[i : i + 256, None] * LEAF + np.arange(LEAF))[:, None, :]
        x, y = np.broadcast_arrays(x, y)
        ok = (x < len(rows)) & (y < len(rows)) & (x < y)
        p, q = rows[x[ok]], rows[y[ok]]
        ok = points.admit(p, q, percent)
        yield p[ok], q[ok]


def _small_pairs(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs in many runs of at most SHORT rows."""
    a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for m in np.unique(sizes):
        if 1 < m <= SHORT:
            s = starts[sizes == m][:, None]
            i, j = np.triu_indices(m, 1)
            a.append((s + i).ravel())
            b.append((s + j).ravel())
    return np.concatenate(a), np.concatenate(b)


class _Links:
    """Edges that connect what a task hasn't connected yet; ids are any integers."""

    def __init__(self):
        self.at: dict[int, int] = {}
        self.forest = Forest(0)
        self.edges: list[tuple[int, int]] = []

    def _node(self, x: int) -> int:
        i = self.at.get(x)
        if i is None:
            i = self.at[x] = len(self.forest.up)
            self.forest.up.append(i)
        return i

    def connected(self, x: int, y: int) -> bool:
        return self.forest.root(self._node(x)) == self.forest.root(self._node(y))

    def join(self, x: int, y: int) -> None:
        if self.forest.join(self._node(x), self._node(y)):
            self.edges.append((x, y))

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.edges:
            a, b = zip(*self.edges, strict=True)
            self.edges = []
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _allowed(labels, chunk, ci, cj, a, b):
    """Pairs that aren't connected already and that this cell is for: of two chunks, one row of each."""
    return (labels[a] != labels[b]) & ((ci[a] == cj[a]) | (chunk[a] != chunk[b]))


def _pair_up(percent: int):
    """Counted pairs of like size from short runs of a key; of a long run only the key, however long it is."""

    def pair_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty = np.empty(0, np.int64)
        held = {c: empty for c in ("key", "uid", "size")}  # the run at the end, up to SHORT + 1 rows of it

        def emit(rows: dict[str, np.ndarray], starts: np.ndarray) -> Iterator[pa.RecordBatch]:
            sizes = np.diff([*starts, len(rows["key"])])
            a, b = _small_pairs(starts, sizes)
            n, lead, uid = rows["size"] >> 1, (rows["size"] & 1).astype(bool), rows["uid"]
            near = 100 * np.minimum(n[a], n[b]) >= percent * np.maximum(n[a], n[b])
            a, b = a[near], b[near]
            # the smaller set of a pair leads by fewer shingles
            ok = np.where(n[a] < n[b], lead[a], np.where(n[b] < n[a], lead[b], lead[a] & lead[b]))
            a, b = a[ok], b[ok]
            need = np.minimum(SHARED, -(-percent * (n[a] + n[b]) // (100 + percent)))
            found = np.stack([np.minimum(uid[a], uid[b]), np.maximum(uid[a], uid[b]), need], 1)
            pairs, counts = np.unique(found, axis=0, return_counts=True)
            large = rows["key"][starts[sizes > SHORT]]
            m, k = len(pairs), len(large)
            yield pa.RecordBatch.from_arrays(
                [pa.concat_arrays([pa.array(v), pa.nulls(k, pa.int64())]) for v in (pairs[:, 0], pairs[:, 1], pairs[:, 2], counts)] + [pa.concat_arrays([pa.nulls(m, pa.int64()), pa.array(large)])], ["a", "b", "need", "met", "key"]
            )

        for batch in batches:
            new = {c: batch[c].to_numpy(zero_copy_only=False).astype(np.int64) for c in held}
            rows = {c: np.concatenate([held[c], new[c]]) for c in held}
            if not len(rows["key"]):
                continue
            starts = np.flatnonzero(np.r_[True, rows["key"][1:] != rows["key"][:-1]])
            last = starts[-1]
            if last:
                yield from emit({c: v[:last] for c, v in rows.items()}, starts[:-1])
            held = {c: v[last : last + SHORT + 1] for c, v in rows.items()}
        if len(held["key"]):
            yield from emit(held, np.zeros(1, np.int64))

    return pair_up


def _admit(percent: int):
    """Of pairs with both points, those that the bound admits and that connect something new to the task."""

    def admit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links = _Links()
        for batch in batches:
            for at in range(0, batch.num_rows, 4000):
                part = batch.slice(at, 4000)
                m = part.num_rows
                sizes = np.concatenate([part["n"].to_numpy(), part["m"].to_numpy()])
                points = Points(binary_rows(part["point"]) + binary_rows(part["other"]), sizes)
                ok = points.admit(np.arange(m), np.arange(m) + m, percent)
                for x, y in zip(part["a"].to_numpy()[ok].tolist(), part["b"].to_numpy()[ok].tolist(), strict=True):
                    links.join(x, y)
            yield from links.flush()

    return admit


def _search(percent: int):
    keys = ["key", "cell_i", "cell_j"]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links = _Links()
        for table, starts in runs(batches, keys):
            ids, n, lead, labels = (table[c].to_numpy() for c in ("uid", "n", "lead", "label"))
            chunk, ci, cj = (table[c].to_numpy() for c in ("chunk", "cell_i", "cell_j"))
            points = Points(binary_rows(table["point"]), n)
            for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(ids)], strict=True):
                for a, b in tree_pairs(points, np.arange(s, e), percent):
                    # the smaller set of a pair leads by fewer shingles
                    ok = np.where(n[a] < n[b], lead[a], np.where(n[b] < n[a], lead[b], lead[a] & lead[b])) & _allowed(labels, chunk, ci, cj, a, b)
                    for x, y in zip(ids[a[ok]].tolist(), ids[b[ok]].tolist(), strict=True):
                        links.join(x, y)
            yield from links.flush()

    return search


def _verify(percent: int):
    keys = ["block", "cell_i", "cell_j"]

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links = _Links()
        for table, starts in runs(batches, keys):
            ids, n, labels = (table[c].to_numpy() for c in ("uid", "n", "label"))
            chunk, ci, cj = (table[c].to_numpy() for c in ("chunk", "cell_i", "cell_j"))
            raw = table["grams"]
            for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(ids)], strict=True):
                if e - s < 2:
                    continue
                sets = [np.frombuffer(x, np.uint64) for x in raw.slice(s, e - s).to_pylist()]
                points = Points([point(x) for x in sets], n[s:e])
                own, ch, oi, oj, lab = ids[s:e], chunk[s:e], ci[s:e], cj[s:e], labels[s:e]
                for a, b in tree_pairs(points, np.arange(e - s), percent):
                    ok = _allowed(lab, ch, oi, oj, a, b)
                    for i, j in zip(a[ok].tolist(), b[ok].tolist(), strict=True):
                        x, y = int(own[i]), int(own[j])
                        if links.connected(x, y):
                            continue
                        shared = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                        if shared * (100 + percent) >= percent * (len(sets[i]) + len(sets[j])):
                            links.join(x, y)
            yield from links.flush()

    return verify


def _star_points(percent: int):
    """Edges between the pivots of a chunk and those of its rows that the bound admits."""

    def star(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links = _Links()
        for table, starts in runs(batches, ["key", "chunk"]):
            ids, n, lead, pivot = (table[c].to_numpy() for c in ("uid", "n", "lead", "pivot"))
            points = Points(binary_rows(table["point"]), n)
            for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(ids)], strict=True):
                rows = np.arange(s, e)
                for p in rows[pivot[s:e]].tolist():
                    b = np.full(len(rows), p)
                    leads = np.where(n[rows] < n[p], lead[rows], np.where(n[rows] > n[p], lead[p], lead[rows] & lead[p]))
                    for x in ids[rows[points.admit(rows, b, percent) & leads & (ids[rows] != ids[p])]].tolist():
                        links.join(int(ids[p]), x)
            yield from links.flush()

    return star


def _star_sets(percent: int):
    """Edges between the pivots of a chunk and those of its rows that are linked with them."""

    def star(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links = _Links()
        for table, starts in runs(batches, ["key", "chunk"]):
            ids, pivot = table["uid"].to_numpy(), table["pivot"].to_numpy()
            for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(ids)], strict=True):
                heads = [(int(ids[p]), np.frombuffer(table["grams"][int(p)].as_py(), np.uint64)) for p in np.flatnonzero(pivot[s:e]) + s]
                for i in range(s, e):
                    own, x = None, int(ids[i])
                    for p, head in heads:
                        if p == x or links.connected(p, x):
                            continue
                        own = np.frombuffer(table["grams"][i].as_py(), np.uint64) if own is None else own
                        if 100 * min(len(own), len(head)) < percent * max(len(own), len(head)):
                            continue
                        if len(np.intersect1d(own, head, assume_unique=True)) * (100 + percent) >= percent * (len(own) + len(head)):
                            links.join(p, x)
            yield from links.flush()

    return star


def _star(rows: DataFrame, payload: DataFrame, judge, columns: list[str]) -> DataFrame:
    """(a, b): edges from the rows (key, rows, cap, uid, ...) of large groups to PIVOTS rows of their own group.

    Pivots are those with the smallest hashes, found by partial aggregation. A group is dealt into chunks of
    ``cap`` rows, and each chunk gets the group's pivots, so work and copies are linear in the group."""
    heads = F.array(*[F.min(F.struct(F.xxhash64("uid", F.lit(i)).alias("h"), F.col("uid").alias("u"))) for i in range(PIVOTS)])
    pivots = rows.groupBy("key", "rows", "cap").agg(heads.alias("_h")).withColumn("uid", F.explode(F.array_distinct(F.transform("_h", lambda x: x["u"]))))
    n = F.ceil(F.col("rows") / F.col("cap")).cast("int")
    pivots = pivots.select("key", "uid", F.explode(F.sequence(F.lit(0), n - 1)).alias("chunk")).withColumn("pivot", F.lit(True))
    extra = [c for c in rows.columns if c not in ("key", "rows", "cap", "uid")]
    pivots = pivots.join(rows.select("key", "uid", *extra), ["key", "uid"])
    own = rows.withColumn("chunk", F.pmod(F.xxhash64("uid"), n.cast("long")).cast("int")).withColumn("pivot", F.lit(False))
    both = own.select("key", "chunk", "uid", "pivot", *extra).unionByName(pivots.select("key", "chunk", "uid", "pivot", *extra)).join(payload, "uid")
    both = both.select(*columns).repartition("key", "chunk").sortWithinPartitions("key", "chunk")
    return both.mapInArrow(judge, "a long, b long")


def _deal(rows: DataFrame, labels: DataFrame, scratch: Scratch, broadcast_ids: int) -> DataFrame:
    """Rows (key, rows, cap, uid, ...) of large groups with ``label, cell_i, cell_j, chunk``: those pairs of a
    group that ``labels`` (node, component) doesn't connect meet in one cell. The commonest label is dealt
    into chunks of its own, which meet the others' chunks but not each other; a group of one label is gone."""
    rows = scratch.keep(rows.join(labels.select(F.col("node").alias("uid"), F.col("component").alias("_c")), "uid", "left").withColumn("label", F.coalesce("_c", "uid")).drop("_c"))
    per_label = rows.groupBy("key", "rows", "cap", "label").agg(F.count("*").alias("_n"))
    main = per_label.groupBy("key", "rows", "cap").agg(F.max(F.struct("_n", "label")).alias("_m"))
    most = F.col("_m._n")
    chunks = lambda n: F.ceil(n / F.col("cap")).cast("int")
    main = scratch.keep(main.where(most < F.col("rows")).select("key", F.col("_m.label").alias("_main"), chunks(F.col("rows") - most).alias("_few"), chunks(most).alias("_many")))
    main = F.broadcast(main) if main.count() <= broadcast_ids else main
    rows = rows.join(main, "key")
    is_main = F.col("label") == F.col("_main")
    at = F.pmod(F.xxhash64("uid"), F.when(is_main, F.col("_many")).otherwise(F.col("_few")).cast("long")).cast("int")
    rows = rows.withColumn("chunk", F.when(is_main, F.col("_few") + at).otherwise(at))
    other = F.explode(F.sequence(F.lit(0), F.when(is_main, F.col("_few")).otherwise(F.col("_few") + F.col("_many")) - 1))
    rows = rows.withColumn("_o", other).withColumn("cell_i", F.least("chunk", "_o")).withColumn("cell_j", F.greatest("chunk", "_o"))
    return rows.drop("_o", "_main", "_few", "_many")


def _one_cell(groups: DataFrame) -> DataFrame:
    """Rows of groups that are small enough for one cell."""
    zero = F.lit(0)
    return groups.withColumns({"label": F.col("uid"), "cell_i": zero, "cell_j": zero, "chunk": zero})


def _with_large(small: DataFrame, large: DataFrame, payload: DataFrame, star, columns: list[str], scratch: Scratch, broadcast_ids: int) -> tuple[DataFrame, list[DataFrame]]:
    """The cells of small groups (with their payload) and of large ones (key, rows, cap, uid, ...; their payload comes by uid),
    and the edges that the large groups' pivots gave."""
    large = scratch.keep(large)
    if large.isEmpty():
        return small, []
    edges = scratch.keep(_star(large, payload, star, columns))
    labels = connected_components(large.sparkSession, edges, scratch)
    dealt = _deal(large, labels, scratch, broadcast_ids).join(payload, "uid")
    return small.unionByName(dealt.select(*small.columns)), [edges]


def frequent_shingles(texts: DataFrame, k: int, least: int = 64) -> np.ndarray:
    """Sorted hashes of shingles that many documents share, for the order only. Counted over all documents:
    each task reports those that recur among the documents it holds at a time, and the sums decide."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def report() -> pa.RecordBatch:
            h, c = np.unique(np.concatenate(held), return_counts=True) if held else (np.empty(0, np.uint64), np.empty(0, np.int64))
            often = c >= 3
            return pa.RecordBatch.from_arrays([pa.array(h[often].view(np.int64)), pa.array(c[often].astype(np.int64))], ["h", "c"])

        for batch in batches:
            for t in binary_rows(batch["t"]):
                held.append(shingles(t, k))
                size += len(held[-1])
                if size > 3_000_000:
                    yield report()
                    held, size = [], 0
        yield report()

    sums = texts.select("t").mapInArrow(count, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))
    top = sums.where(F.col("c") >= least).orderBy(F.desc("c"), "h").limit(FREQUENT)
    return np.sort(top.select("h").toArrow()["h"].to_numpy().view(np.uint64))


def _route(k: int, percent: int, frequent):
    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        late = frequent.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                n, sig, keys, leads, fresh, points = [], [], [], [], [], []
                for t in binary_rows(part["t"]):
                    s = shingles(t, k)
                    many, few = _prefixes(len(s), percent) if len(s) else (0, 0)
                    hit = np.zeros(len(s), bool)
                    if len(late) and len(s):
                        hit = late[np.minimum(np.searchsorted(late, s), len(late) - 1)] == s
                    order = np.concatenate([s[~hit], s[hit]])[:many]
                    n.append(len(s))
                    sig.append(xxhash.xxh3_128_digest(s.tobytes()))
                    keys.append(order.view(np.int64))
                    leads.append(few)
                    fresh.append(int((~hit).sum()))
                    points.append(point(s) if len(s) else b"")
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in keys])]).astype(np.int32)
                flat = np.concatenate(keys) if keys else np.empty(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part["doc_id"], part["td"], pa.array(n, pa.int64()), pa.array(sig, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), pa.array(leads, pa.int32()), pa.array(fresh, pa.int64()), pa.array(points, pa.binary())],
                    ["doc_id", "td", "n", "sig", "keys", "leads", "fresh", "point"],
                )

    return route


def _regram(k: int):
    def regram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                sets = [shingles(t, k).tobytes() for t in binary_rows(batch.slice(at, 1000)["t"])]
                yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(s) for s in sets], pa.binary()), pa.array(sets, pa.binary())], ["sig", "grams"])

    return regram


def _link(docs: DataFrame, k: int, percent: int, text: str, doc_id: str, broadcast_ids: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """((doc_id, td, n, sig) of every row, (sig, component_id, first) of every set that isn't empty): ``td`` is the
    text's digest, ``sig`` the set's; ``first`` (absent, doc_id, td) is the row of a component with the smallest id."""
    spark = docs.sparkSession
    raw = F.col(text).cast("string").cast("binary")
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.md5(raw).alias("td"), raw.alias("t"))
    kind = texts.schema["doc_id"].dataType.simpleString()
    frequent = spark.sparkContext.broadcast(frequent_shingles(texts, k))
    routed = texts.mapInArrow(_route(k, percent, frequent), f"doc_id {kind}, td string, n long, sig binary, keys array<long>, leads int, fresh long, point binary")
    routed = scratch.keep(routed.withColumn("uid", F.monotonically_increasing_id()))
    first = F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id", "td")
    rows = scratch.keep(routed.select("doc_id", "td", "n", "sig"))
    classes = scratch.keep(routed.where("n > 0").groupBy("sig").agg(F.min("doc_id").alias("first_id"), F.min("uid").alias("uid"), F.min(first).alias("first")))
    firsts = classes.select("uid")
    firsts = F.broadcast(firsts) if classes.count() <= broadcast_ids else firsts
    ones = scratch.keep(routed.join(firsts, "uid").select("uid", "n", "keys", "leads", "fresh", "point"))
    scratch.drop(routed)
    # a set's size, and whether it leads by the shingle, as one number
    size = (2 * F.col("n") + (F.col("pos") < F.col("leads")).cast("long")).alias("size")
    keyed = ones.select("uid", "n", "leads", "fresh", F.posexplode("keys").alias("pos", "key")).select("key", "uid", size, (F.col("pos") >= F.col("fresh")).alias("_often"))
    # tiles of shingles that are known to be frequent are dealt out; no other shingle can be in very many documents
    rare = keyed.where("NOT _often").drop("_often")
    met = scratch.keep(rare.repartition("key").sortWithinPartitions("key").mapInArrow(_pair_up(percent), "a long, b long, need long, met long, key long"))
    point = lambda n, p, u: ones.select(F.col("uid").alias(u), F.col("n").alias(n), F.col("point").alias(p))
    often = met.where("a IS NOT NULL").groupBy("a", "b").agg(F.sum("met").alias("met"), F.min("need").alias("need")).where("met >= need").select("a", "b")
    few = often.join(point("n", "point", "a"), "a").join(point("m", "other", "b"), "b")
    near = few.mapInArrow(_admit(percent), "a long, b long")
    large = scratch.keep(met.where("key IS NOT NULL").select("key"))
    side = F.broadcast(large) if large.count() <= broadcast_ids else large
    busy = scratch.keep(keyed.where("_often").drop("_often").unionByName(rare.join(side, "key")))
    busy = busy.select("key", "uid", F.shiftright("size", 1).alias("n"), (F.col("size") % 2 == 1).alias("lead"))
    sized = scratch.keep(busy.join(busy.groupBy("key").agg(F.count("*").alias("rows")).where("rows > 1"), "key").withColumn("cap", F.lit(TILE_ROWS)))
    points = ones.select("uid", "point")
    columns = ["key", "cell_i", "cell_j", "chunk", "label", "uid", "n", "lead", "point"]
    small = _one_cell(sized.where("rows <= cap")).join(points, "uid").select(*columns)
    tiles, found = _with_large(small, sized.where("rows > cap"), points, _star_points(percent), ["key", "chunk", "uid", "pivot", "n", "lead", "point"], scratch, broadcast_ids)
    tiles = tiles.repartition("key", "cell_i", "cell_j").sortWithinPartitions("key", "cell_i", "cell_j", "n")
    near = near.unionByName(tiles.mapInArrow(_search(percent), "a long, b long"))
    for edges in found:
        near = near.unionByName(edges)
    near = scratch.keep(near)
    scratch.drop(met, sized, ones)
    blocks = scratch.keep(connected_components(spark, near, scratch).select(F.col("node").alias("uid"), F.col("component").alias("key")))
    active = scratch.keep(blocks.join(classes.select("uid", "sig", "first"), "uid"))
    n_active = active.count()
    ids = active.select(F.col("first.doc_id").alias("_id"), F.col("first.td").alias("_td")).distinct()
    ids = F.broadcast(ids) if n_active <= broadcast_ids else ids
    again = texts.join(ids, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("td") == F.col("_td")), "left_semi").select("t").mapInArrow(_regram(k), "sig binary, grams binary")
    sets = again.join(active.select("sig", "uid", "key"), "sig").withColumn("n", (F.octet_length("grams") / 8).cast("long"))
    sets = scratch.keep(sets.select("key", "uid", "n", "grams"))
    twice = scratch.keep(sets.groupBy("uid").count().where("count > 1").select("uid"))
    if not twice.isEmpty():  # rows that repeat in both id and text
        rest = sets.join(twice, "uid", "left_semi").groupBy("uid").agg(*[F.min(c).alias(c) for c in ("key", "n", "grams")])
        sets = scratch.keep(sets.join(twice, "uid", "left_anti").unionByName(rest))
    sizes = sets.groupBy("key").agg(F.count("*").alias("rows"), F.max("n").alias("most"))
    cap = F.greatest(F.lit(8), F.least(F.lit(BLOCK_ROWS), F.floor(F.lit(BLOCK_SHINGLES) / F.col("most")))).cast("int")
    sizes = scratch.keep(sizes.select("key", "rows", cap.alias("cap")))
    columns = ["key", "cell_i", "cell_j", "chunk", "label", "uid", "n", "grams"]
    small = _one_cell(sets.join(sizes.where("rows <= cap"), "key")).select(*columns)
    large = sets.select("key", "uid", "n").join(sizes.where("rows > cap"), "key")
    pairs, found = _with_large(small, large, sets.select("uid", "grams"), _star_sets(percent), ["key", "chunk", "uid", "pivot", "grams"], scratch, broadcast_ids)
    pairs = pairs.withColumnRenamed("key", "block")
    pairs = pairs.repartition("block", "cell_i", "cell_j").sortWithinPartitions("block", "cell_i", "cell_j", "n")
    links = pairs.mapInArrow(_verify(percent), "a long, b long")
    for edges in found:
        links = links.unionByName(edges)
    joined = connected_components(spark, links, scratch)
    linked = scratch.keep(joined.withColumnRenamed("node", "uid").join(classes.select("uid", "first_id", "first"), "uid"))
    least = scratch.keep(linked.groupBy("component").agg(F.min("first_id").alias("component_id"), F.min("first").alias("whole")))
    named = linked.join(least, "component").select("uid", "component_id", "whole")
    final = classes.join(named, "uid", "left").select("sig", F.coalesce("component_id", "first_id").alias("component_id"), F.coalesce("whole", "first").alias("first"))
    final = scratch.keep(final)
    scratch.drop(near, sets)
    return rows, final


def link_documents(docs: DataFrame, k: int = 5, percent: int = 80, text: str = "text", doc_id: str = "doc_id", broadcast_ids: int = 500_000) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs``.

    Two documents link when 100 * shared >= ``percent`` * (all) of their distinct shingles of ``k`` words
    (code points 9 to 13 and the space part words; A-Z are lower-cased). ``component_id`` is the smallest
    doc_id that links reach. Documents without words (null, empty, blank) have no shingles, link with
    nothing, and are their own component. Repeated rows and equal sets are linked. Rows without a doc_id
    take part; a component of such rows alone has a null id. Long texts are read whole; an empty table gives
    no rows. Shingles are compared by 64-bit hashes, texts and sets by 128-bit ones.
    """
    routed, final = _link(docs, k, percent, text, doc_id, broadcast_ids, Scratch(docs.sparkSession, "jaccard"))
    out = routed.join(final.drop("first"), "sig", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one_of_each(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", broadcast_ids: int = 500_000, k: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each component, untouched: the one with the smallest id, then the smallest digest
    of its text; rows without an id come last. Rows are told apart by id and text, so an id that repeats with
    another text loses only what is a copy; of rows that agree in both, one stays. Rows without words all
    stay. What goes is broadcast where there are at most ``broadcast_ids`` such ids and texts."""
    scratch = Scratch(docs.sparkSession, "dedup")
    routed, final = _link(docs, k, percent, text, doc_id, broadcast_ids, scratch)
    chosen = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("td") == F.col("first.td"))
    found = scratch.keep(routed.where("n > 0").join(final.select("sig", "first"), "sig").select("doc_id", "td", chosen.alias("stays")))
    name = lambda df: df.select(F.col("doc_id").alias("_keep_id"), F.col("td").alias("_keep_td"))
    gone = scratch.keep(name(found.where("NOT stays")).distinct())
    gone = F.broadcast(gone) if gone.count() <= broadcast_ids else gone
    digest = F.md5(F.col(text).cast("string").cast("binary"))
    same = F.col(doc_id).eqNullSafe(F.col("_keep_id")) & (digest == F.col("_keep_td"))
    kept = docs.join(gone, same, "left_anti")
    often = scratch.keep(name(found.where("stays").groupBy("doc_id", "td").count().where("count > 1")))
    if often.isEmpty():
        return kept
    once = kept.join(often, same, "left_anti")
    again = kept.join(often, same, "left_semi").withColumn("_keep_td", digest).dropDuplicates([doc_id, "_keep_td"]).drop("_keep_td")
    return once.unionByName(again)
