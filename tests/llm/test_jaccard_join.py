import random
import re

import numpy as np
import pytest

from quire.llm.common import Forest
from quire.llm.jaccard_join import LEAF, Points, keep_one_of_each, link_documents, point, shingles, tree_pairs


def plain_shingles(t, k):
    """Tuples of words, without the operator's code."""
    lower = (t or "").translate({i: i + 32 for i in range(65, 91)})
    w = re.findall(r"[^\x20\x09-\x0D]+", lower)
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute(rows, k, percent):
    sets = [plain_shingles(t, k) for _, t in rows]
    f = Forest(len(rows))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                f.join(i, j)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = f.root(i)
        least[r] = min(least.get(r, d), d)
    return {d: (len(sets[i]), least[f.root(i)]) for i, (d, _) in enumerate(rows)}


def corpus(seed, n=150):
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(400)] + ["the", "of", "a"]
    fresh = lambda m: [draw.choice(words) for _ in range(m)]
    passage, bases, rows = fresh(60), [fresh(draw.randint(3, 120)) for _ in range(8)], []
    for _ in range(n):
        kind = draw.random()
        w = list(draw.choice(bases)) if kind < 0.6 else fresh(draw.randint(0, 150))
        for _ in range(draw.choice([0, 0, 1, 2, 3, 6])):
            if w:
                w[draw.randrange(len(w))] = draw.choice(words)
        if draw.random() < 0.2:
            w += passage
        rows.append(" ".join(w) if draw.random() < 0.9 else " ".join(w).upper())
    rows += [None, "", " \n", "one", "One", "two words", "a b c", "A\tb\nC"]
    return list(enumerate(rows))


@pytest.mark.parametrize(("seed", "k", "percent"), [(1, 4, 85), (2, 5, 80), (3, 1, 50)])
def test_components_agree_with_brute_force(spark, seed, k, percent):
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in link_documents(docs, k, percent).collect()}
    assert got == brute(rows, k, percent)


def test_large_groups_are_dealt_into_cells(spark, monkeypatch):
    import quire.llm.jaccard_join as m

    monkeypatch.setattr(m, "TILE_ROWS", 20)
    monkeypatch.setattr(m, "BLOCK_ROWS", 20)
    draw = random.Random(5)
    base = [f"b{i}" for i in range(80)]
    rows = []
    for i in range(160):
        w = list(base)
        for _ in range(draw.randint(0, 3)):
            w[draw.randrange(80)] = f"x{draw.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in link_documents(docs, 4, 85, broadcast_ids=0).collect()}
    assert got == brute(rows, 4, 85)


def test_tree_loses_no_pair_that_the_bound_admits():
    draw = np.random.default_rng(0)
    sets = []
    for _ in range(30):
        base = draw.integers(0, 2**63, draw.integers(5, 1500), dtype=np.uint64)
        for _ in range(8):
            s = base.copy()
            s[: draw.integers(0, max(1, len(s) // 6))] = draw.integers(0, 2**63, 1, dtype=np.uint64)
            sets.append(np.unique(s))
    points = Points([point(s) for s in sets], np.array([len(s) for s in sets]))
    n = len(sets)
    assert n > 2 * LEAF
    a, b = np.triu_indices(n, 1)
    ok = points.admit(a, b, 85)
    want = {(i, j) for i, j in zip(a[ok].tolist(), b[ok].tolist(), strict=True)}
    got = {tuple(sorted(p)) for x, y in tree_pairs(points, np.arange(n), 85) for p in zip(x.tolist(), y.tolist(), strict=True)}
    assert got == want
    for i, j in zip(a.tolist(), b.tolist(), strict=True):
        common = len(np.intersect1d(sets[i], sets[j]))
        if 100 * common >= 85 * (len(sets[i]) + len(sets[j]) - common):
            assert (i, j) in want


def test_odd_tables(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (3, None), (None, "alone by itself here")], "doc_id long, text string")
    got = sorted(link_documents(docs, 4, 85).collect(), key=str)
    assert sorted((r.doc_id, r.component_id) for r in got if r.doc_id) == [(1, 1), (1, 1), (3, 3)]
    assert sorted(str(r.component_id) for r in got if r.doc_id is None) == ["1", "None"]
    assert link_documents(docs.limit(0)).count() == 0


def test_one_of_each_stays(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(5, text, 1), (2, text, 2), (9, text + " more", 3), (7, "something else entirely here now", 4), (2, text, 5), (8, None, 6), (6, "", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id int")
    kept = keep_one_of_each(docs, k=5, percent=80).collect()
    assert sorted(r.doc_id for r in kept) == [2, 6, 7, 8]
    assert keep_one_of_each(docs, k=5, percent=80, broadcast_ids=0).count() == 4


def test_an_id_with_several_texts_loses_only_copies(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    rows = [(1, a), (2, a), (2, b), (None, b + " more"), (None, "x y z v w q"), (None, "x y z v w q"), (3, None), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(map(str, ((r.doc_id, r.text) for r in keep_one_of_each(docs, k=5, percent=80).collect())))
    assert kept == sorted(map(str, [(1, a), (2, b), (None, "x y z v w q"), (3, None), (3, None)]))
    named = docs.selectExpr("concat('k', doc_id) AS doc_id", "text")
    got = {(r.doc_id, r.component_id) for r in link_documents(named).collect()}
    assert ("k2", "k1") in got and (None, "k2") in got and ("k3", "k3") in got


@pytest.mark.parametrize("seed", [1, 2])
def test_large_groups_agree_with_brute_force(spark, monkeypatch, seed):
    """Tiles and blocks of several clusters, of chains that no pivot sees whole, and of unlike documents that share a passage."""
    import quire.llm.jaccard_join as m

    for name, value in (("TILE_ROWS", 12), ("BLOCK_ROWS", 12), ("PIVOTS", 2), ("SHORT", 6)):
        monkeypatch.setattr(m, name, value)
    draw = random.Random(seed)
    passage = [f"p{i}" for i in range(70)]
    rows = []
    for c in range(3):
        w = [f"c{c}x{i}" for i in range(40)]
        for i in range(40):  # a chain: each a word further from the first
            w = list(w)
            w[i] = f"n{c}x{i}"
            rows.append(" ".join(w))
            if draw.random() < 0.3:
                rows.append(" ".join(w))
    rows += [" ".join([*passage, *[f"u{draw.randrange(10**6)}" for _ in range(draw.choice([3, 10, 60]))]]) for _ in range(60)]
    draw.shuffle(rows)
    rows = list(enumerate(rows))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(m, "frequent_shingles", lambda texts, k: np.sort(np.unique(np.concatenate([m.shingles(" ".join(passage).encode(), k), m.shingles(rows[0][1].encode(), k)]))))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in link_documents(docs, 4, 85, broadcast_ids=500_000 if seed == 1 else 0).collect()}
    assert got == brute(rows, 4, 85)


def test_sets_of_very_many_shingles_are_bounded():
    big = np.unique(np.random.default_rng(1).integers(0, 2**63, 200_000, dtype=np.uint64))
    near, other = big[5_000:], np.unique(np.random.default_rng(2).integers(0, 2**63, 190_000, dtype=np.uint64))
    sets = [big, near, other]
    points = Points([point(s) for s in sets], np.array([len(s) for s in sets]))
    assert not points.free.any()
    assert points.admit(np.array([0, 0, 1]), np.array([1, 2, 2]), 85)[0]
    got = {tuple(sorted(p)) for x, y in tree_pairs(points, np.arange(3), 85) for p in zip(x.tolist(), y.tolist(), strict=True)}
    assert (0, 1) in got
