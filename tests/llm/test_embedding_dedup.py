import math

import numpy as np
import pytest

from quire.llm.common import Forest
from quire.llm.embedding_dedup import dedup_embeddings, fit_rotation, plan_tables

SCHEMA = "vec_id long, embedding array<float>, label int, kept string"


def brute(rows, threshold):
    ok = [v is not None and lab is not None and len(v) and None not in v and np.isfinite(v).all() and any(v) for _, v, lab, _ in rows]
    unit = [np.array(v, np.float32).astype(float) / np.linalg.norm(np.array(v, np.float32).astype(float)) if good else None for (_, v, _, _), good in zip(rows, ok, strict=True)]
    f, n = Forest(len(rows)), [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold:
                f.join(i, j)
                n[i] += 1
                n[j] += 1
    least = {}
    for i, r in enumerate(rows):
        least[f.root(i)] = min(least.get(f.root(i), r[0]), r[0])
    return {r[0]: (n[i], least[f.root(i)], least[f.root(i)] == r[0]) for i, r in enumerate(rows)}


def vectors(seed, dim=32, n=400):
    draw = np.random.default_rng(seed)
    centers = draw.normal(size=(12, dim))
    rows = []
    for i in range(n):
        v = centers[draw.integers(12)] + draw.normal(size=dim) * 0.08 if draw.random() < 0.6 else draw.normal(size=dim)
        rows.append((i, [float(x) for x in v], int(draw.integers(3)), "x"))
    return rows


def test_near_copies_and_odd_vectors(spark, monkeypatch):
    import quire.llm.embedding_dedup as m

    monkeypatch.setattr(m, "CHUNK_ROWS", 25)
    rows = vectors(1)
    rows += [(1000, None, 1, "x"), (1001, [0.0] * 32, 1, "x"), (1002, [1.0, None] * 16, 1, "x"), (1003, [math.nan] + [1.0] * 31, 1, "x"), (1004, rows[0][1], None, "x"), (1005, [], 1, "x"), (1006, [1.0, 2.0, 3.0], 1, "x"), (1007, [2.0, 4.0, 6.0], 1, "x"), (1008, [1e-30] * 32, 1, "x"), (1009, [3e38] * 32, 1, "x"), (1010, [math.inf] + [1.0] * 31, 1, "x")]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in dedup_embeddings(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()}
    want = brute(rows, 0.93)
    assert got.keys() == want.keys()
    links = sum(n for n, _, _ in want.values())
    assert links > 500 and sum(n for n, _, _ in got.values()) >= 0.97 * links
    assert all(got[k][0] <= want[k][0] for k in want)
    assert got[1007] == (1, 1006, False) and got[1009] == (1, 1008, False)
    for k in (1000, 1001, 1002, 1003, 1004, 1005, 1010):
        assert got[k] == (0, k, True)


def test_recall_on_the_given_vectors(spark):
    """The table's vectors, which have no links, with a neighbour of every third one from the threshold up."""
    r = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").toPandas()
    draw = np.random.default_rng(9)
    x = np.array(r.embedding.tolist(), float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    at = np.arange(0, len(x), 3)
    way = draw.normal(size=(len(at), x.shape[1]))
    way -= (way * x[at]).sum(1, keepdims=True) * x[at]
    way /= np.linalg.norm(way, axis=1, keepdims=True)
    c = draw.uniform(0.9305, 0.96, size=(len(at), 1))
    y = c * x[at] + np.sqrt(1 - c * c) * way
    ids = [int(v) for v in r.vec_id] + [10**9 + i for i in range(len(y))]
    labels = [int(v) for v in r.label] + [int(r.label.iloc[i]) for i in at]
    e = spark.createDataFrame([(i, [float(a) for a in v], k, "x") for i, v, k in zip(ids, [*x, *y], labels, strict=True)], SCHEMA)
    got = {v.vec_id: v for v in dedup_embeddings(e.repartition(6)).collect()}
    z = np.concatenate([x, y]).astype(np.float32).astype(float)
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    links, labels = 0, np.array(labels)
    for k in np.unique(labels):
        own = np.flatnonzero(labels == k)
        n = (z[own] @ z[own].T >= 0.93).sum(1) - 1
        links += n.sum()
        assert all(got[ids[v]].n_links <= m for v, m in zip(own, n, strict=True))
    assert links >= 2 * len(y) and sum(v.n_links for v in got.values()) >= 0.95 * links


def test_codes_keep_angles():
    draw = np.random.default_rng(3)
    x = draw.normal(size=(2000, 16))
    mean, p = fit_rotation(x, 16, 0)
    assert np.allclose((p.T @ p), np.eye(16), atol=1e-9)
    bits = (x - mean) @ p >= 0
    assert np.abs(bits.mean(0) - 0.5).max() < 0.1  # balanced
    width, tables = plan_tables(10**6, 0.93, 0.97)
    assert (1 - (1 - (1 - math.acos(0.93) / math.pi) ** width) ** tables) >= 0.97


def test_empty(spark):
    assert dedup_embeddings(spark.createDataFrame([], SCHEMA)).count() == 0
    twice = spark.createDataFrame([(5, [1.0, 0.0], 1, "x"), (5, [1.0, 0.0], 1, "x"), (None, [1.0, 0.0], 1, "x")], SCHEMA)
    assert sorted(r.n_links for r in dedup_embeddings(twice).collect()) == [2, 2, 2]


@pytest.mark.parametrize("n", [2, 10**4, 10**9])
def test_plan(n):
    width, tables = plan_tables(n, 0.93, 0.97)
    assert 8 <= width <= 32 and tables >= 1


def test_recall_with_a_common_direction(spark):
    draw = np.random.default_rng(5)
    unit = lambda a: a / np.linalg.norm(a, axis=1, keepdims=True)
    common = unit(draw.normal(size=(1, 64)))
    x = unit(math.sqrt(0.7) * common + math.sqrt(0.3) * unit(draw.normal(size=(1500, 64))))
    way = draw.normal(size=x.shape)
    way = unit(way - (way * x).sum(1, keepdims=True) * x)
    c = draw.uniform(0.932, 0.94, size=(1500, 1))
    y = c * x + np.sqrt(1 - c * c) * way
    rows = [(i, [float(v) for v in r], 1, "x") for i, r in enumerate(np.concatenate([x, y]))]
    e = spark.createDataFrame(rows, SCHEMA)
    got = {r.vec_id: r.n_links for r in dedup_embeddings(e.repartition(4)).collect()}
    z = np.array([r[1] for r in rows], np.float32).astype(float)
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    want = (z @ z.T >= 0.93).sum(1) - 1
    assert all(got[i] <= n for i, n in enumerate(want))
    assert sum(got.values()) >= 0.95 * want.sum() > 0


def test_copies_count_as_the_rows_they_are(spark, monkeypatch):
    import quire.llm.embedding_dedup as m

    monkeypatch.setattr(m, "CHUNK_ROWS", 30)
    rows = vectors(7, n=200)
    draw = np.random.default_rng(1)
    rows += [(1000 + i, rows[int(draw.integers(5))][1], int(draw.integers(2)), "x") for i in range(200)]
    rows += [(2000 + i, [0.0] * 32, 1, "x") for i in range(3)] + [(2010 + i, None, 1, "x") for i in range(2)] + [(2020 + i, rows[0][1], None, "x") for i in range(2)]
    want = brute(rows, 0.93)
    for most in (500_000, 0):
        got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in dedup_embeddings(spark.createDataFrame(rows, SCHEMA).repartition(3), broadcast_keys=most).collect()}
        assert sum(n for n, _, _ in got.values()) >= 0.97 * sum(n for n, _, _ in want.values())
        assert all(got[k][0] <= want[k][0] for k in want) and all(got[k] == (0, k, True) for k in got if k >= 2000)


def test_rare_dimensions_are_compared_whole(spark):
    draw = np.random.default_rng(2)
    rows = []
    for dim in range(3, 40):
        base = draw.normal(size=(3, dim))
        rows += [(len(rows) + i, [float(x) for x in base[i % 3] + draw.normal(size=dim) * 0.15], 1, "x") for i in range(min(2 * dim - 1, 12))]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in dedup_embeddings(spark.createDataFrame(rows, SCHEMA), max_dims=100).collect()}
    assert got == brute(rows, 0.93)


def test_labels_and_ids_of_any_kind(spark):
    df = spark.createDataFrame([("a", [1.0, 0.0], "x"), ("b", [2.0, 0.0], "x"), ("c", [1.0, 0.0], "y")], "vec_id string, embedding array<double>, label string")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in dedup_embeddings(df).collect()}
    assert got == {"a": (1, "a", True), "b": (1, "a", False), "c": (0, "c", True)}
