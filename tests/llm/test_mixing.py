import hashlib
import math

import pytest

from quire.llm.mixing import least_count, mix_sources, thresholds


def inverse(rate, u):
    k, p = 0, math.exp(-rate)
    total = p
    while total <= u:
        k += 1
        p *= rate / k
        total += p
    return k


def test_counts_invert_the_distribution(spark):
    rows = [(i, f"t{i}", ["a", "b", None][min(i % 10, 2)]) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    out = mix_sources(docs, weights={"a": 2.0, "b": 1.0, None: 1.0}, total=6000, seed=7).collect()
    n = {s: sum(r[2] == s for r in rows) for s in ("a", "b", None)}
    seen = {}
    for r in out:
        seen.setdefault(r.doc_id, []).append(r.copy)
    for i, _, s in rows:
        rate = {"a": 3000, "b": 1500, None: 1500}[s] / n[s]
        u = int(hashlib.md5(f"7\x1f{i}".encode()).hexdigest()[:13], 16) / 16**13
        assert sorted(seen.get(i, [])) == list(range(inverse(rate, u))), i
    share = lambda s: sum(r.source == s for r in out)
    assert abs(share("a") - 3000) < 5 * math.sqrt(3000) and abs(share(None) - 1500) < 5 * math.sqrt(1500) * 2
    again = mix_sources(docs.repartition(2), weights={"a": 2.0, "b": 1.0, None: 1.0}, total=6000, seed=7).collect()
    assert sorted(map(str, again)) == sorted(map(str, out))
    salted = mix_sources(docs, weights={"a": 2.0, "b": 1.0, None: 1.0}, total=6000, seed=7, broadcast_sources=0).collect()
    assert sorted(map(str, salted)) == sorted(map(str, out))


def test_order_is_that_of_the_digests(spark):
    docs = spark.range(2000).selectExpr("id AS doc_id", "'x' AS text", "'s' AS source", "1 AS copy")
    out = mix_sources(docs)
    for part in out.rdd.mapPartitions(lambda rows: [[r.shuffle_key for r in rows]]).collect():
        assert part == sorted(part)
    ids = [r.doc_id for r in out.collect()]
    assert ids != sorted(ids)


def test_odd_inputs(spark):
    docs = spark.createDataFrame([(None, None, "a"), (1, "", "a"), (1, "", "a"), (2, "z" * 100_000, "b")], "doc_id long, text string, source string")
    out = mix_sources(docs, weights={"a": 1.0, "zzz": 4.0}).collect()
    assert {r.source for r in out} <= {"a"}
    assert mix_sources(docs.limit(0)).count() == 0
    assert mix_sources(docs, weights={}).count() == 0
    many = mix_sources(docs, weights={"b": 1.0}, total=1000)
    assert 800 < many.count() < 1200 and many.select("doc_id").distinct().count() == 1
    assert thresholds(0.0) == [1.0] and thresholds(2.0)[0] == pytest.approx(math.exp(-2)) and thresholds(60.0)[-1] == pytest.approx(1)


def test_a_rare_source_among_many_documents(spark):
    n, rare = 20_000, {20_000: "rare", 20_001: None}
    docs = spark.range(n + 2).selectExpr("id AS doc_id", "'t' AS text", f"CASE WHEN id < {n} THEN 'big' WHEN id = {n} THEN 'rare' END AS source")
    rate = (n + 2) / (math.sqrt(n) + 2)
    assert rate > 81  # the list of chances starts above 0
    got = {}
    for r in mix_sources(docs).where(f"doc_id >= {n}").collect():
        assert r.rate == pytest.approx(rate) and r.source == rare[r.doc_id]
        got.setdefault(r.doc_id, []).append(r.copy)
    for i in rare:
        u = int(hashlib.md5(f"0\x1f{i}".encode()).hexdigest()[:13], 16) / 16**13
        assert sorted(got[i]) == list(range(inverse(rate, u)))


def test_chances_of_large_rates():
    for rate in (64.0, 81.0, 100.0, 700.0):
        first = least_count(rate)
        p, k, below = math.exp(-rate), 0, math.exp(-rate)
        for t, want in enumerate(thresholds(rate)):
            while k < first + t:
                k += 1
                p *= rate / k
                below += p
            assert want == pytest.approx(below, abs=1e-12)
    assert thresholds(1e6)[-1] == pytest.approx(1, abs=1e-8) and len(thresholds(1e6)) < 20_000


def test_an_input_that_is_not_a_file_and_clashing_names(spark):
    docs = spark.range(100_000).selectExpr("id AS doc_id", "'x' AS text", "CASE WHEN id = 5 THEN 'rare' ELSE cast(id % 20 AS string) END AS source", "1 AS _s", "2 AS _steps", "3 AS _u", "4 AS _salt", "5 AS _least", "6 AS _n")
    out = mix_sources(docs)
    assert {"_s", "_steps", "_u", "_salt", "_least", "_n"} <= set(out.columns)
    rare = out.where("source = 'rare'").collect()
    assert len(rare) > 30 and {r._steps for r in rare} == {2} and {r.n_copies for r in rare} == {len(rare)}
    assert abs(out.count() - 100_000) < 2_000
