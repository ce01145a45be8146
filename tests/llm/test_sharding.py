import hashlib
import random
import zlib

import pytest

from quire.llm.sharding import Ends, shard_documents


def greedy(sizes, capacity, shards):
    ends, at, total = [], 0, sum(sizes)
    i = 0
    for _ in range(shards):
        load = 0
        while i < len(sizes) and load + sizes[i] <= capacity:
            load += sizes[i]
            i += 1
        at += load
        ends.append(at)
    return ends if at == total else None


def smallest(sizes, shards):
    low, high = 0, sum(sizes)
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if greedy(sizes, mid, shards) else (mid + 1, high)
    return low


@pytest.mark.parametrize("seed", range(12))
def test_cuts_are_the_smallest_feasible(seed):
    draw = random.Random(seed)
    sizes = [draw.choice([1, 2, 5, draw.randint(1, 10**6)]) for _ in range(draw.choice([1, 3, 50, 4000]))]
    if seed % 3 == 0:
        sizes[len(sizes) // 2] += sum(sizes) // 2
    ends, at = [], 0
    for s in sizes:
        at += s
        ends.append(at)

    def look(low, step):
        out = {}
        for e in ends:
            if low <= e < low + step * 4096:
                b = (e - low) // step
                a, z = out.get(b, (e, e))
                out[b] = min(a, e), max(z, e)
        return [(b, a, z) for b, (a, z) in out.items()]

    capacity, cuts = Ends(at, look).cuts(8)
    assert capacity == smallest(sizes, 8)
    assert cuts == greedy(sizes, capacity, 8)


def test_documents_against_brute_force(spark):
    draw = random.Random(3)
    texts = [draw.choice([None, "", "é" * draw.randint(0, 9), "x" * draw.randint(0, 400), "hot"]) for _ in range(600)]
    texts += ["hot"] * 300
    rows = [(i, t, "s") for i, t in enumerate(texts)]
    got = shard_documents(spark.createDataFrame(rows, "doc_id long, text string, shard string").repartition(5), 8).collect()
    assert len(got) == len(rows)
    by_text = {}
    for r in got:
        t = texts[r.doc_id]
        data = (t or "").encode()
        assert r["size"] == len(data) + 1 and r.law == "bytes" and r.grown_shard is None
        assert r.text_crc32 == (None if t is None else zlib.crc32(data))
        assert by_text.setdefault(t, r.shard) == r.shard
    for k in range(8):
        slots = sorted(r.slot for r in got if r.shard == k)
        assert slots == list(range(len(slots)))
    groups = {}
    for t in texts:
        groups[t] = groups.get(t, 0) + len((t or "").encode()) + 1
    order = sorted(groups, key=lambda t: "" if t is None else hashlib.sha256(t.encode()).hexdigest())
    load = [sum(r["size"] for r in got if r.shard == k) for k in range(8)]
    assert max(load) == smallest([groups[t] for t in order], 8)


def test_few_rows(spark):
    schema = "doc_id long, text string"
    assert shard_documents(spark.createDataFrame([], schema)).count() == 0
    one = shard_documents(spark.createDataFrame([(None, None), (None, None), (4, "")], schema)).collect()
    assert sorted((r.doc_id is None, r["size"]) for r in one) == [(False, 1), (True, 1), (True, 1)]
