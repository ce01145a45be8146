import zlib

import numpy as np
import pytest

from quire.llm import language_id
from quire.llm.language_id import NaiveBayes, _grams, _pieces, fit, predict_languages

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = predict_languages(docs).select("doc_id", "lang", "held_out", "lang_pred", "score").collect()
    assert len(out) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out)
    held = [r for r in out if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) > 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in out)


def test_labels_of_held_out_rows_change_nothing(spark):
    from pyspark.sql import functions as F

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    mixed = docs.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, "xx").otherwise(F.col("lang")))
    a, b = ({r.doc_id: (r.lang_pred, r.score) for r in predict_languages(d).collect()} for d in (docs, mixed))
    assert a == b


def plain_buckets(t, orders, bits):
    """The bucket of each gram of a framed, lower-cased text, a gram at a time."""
    t, mod = f" {t.lower()} ", 1 << 64
    for n in orders:
        for i in range(len(t) - n + 1):
            code = 0
            for c in t[i : i + n]:
                code = (code + ord(c) + 1) * 0x9E3779B97F4A7C15 % mod
            yield ((code ^ (code >> 29)) * 0xC2B2AE3D27D4EB4F % mod) >> (64 - bits)


def test_scores_agree_with_counting_grams():
    """The batch scorer against a dictionary that scores one text at a time."""
    draw = np.random.default_rng(2)
    bits, orders = 8, (1, 2, 3)
    weights = np.concatenate([draw.normal(size=(3, 1 << bits)), np.zeros((3, 1))], 1)
    model = NaiveBayes(["a", "b", "c"], np.log([0.5, 0.3, 0.2]), weights, orders, bits)
    texts = ["", "x", "Hello wörld", "😀 ok", "long " * 300, "zz"]
    best, sure = model.score(texts)
    for t, k, p in zip(texts, best, sure, strict=True):
        total = model.prior.copy()
        for b in plain_buckets(t, orders, bits):
            total += weights[:, b]
        want = np.exp(total - total.max())
        assert k == total.argmax() and p == pytest.approx(1 / want.sum())


def test_odd_rows(spark):
    rows = [(1, "the cat sat on the mat and the dog", "en", 1), (3, "le chat est sur la table avec le chien", "fr", 1), (5, None, "en", 1), (4, "", None, 1), (7, "123 !!", "en", 1), (None, "the dog", "fr", 1), (9, "the", None, 1), (9, "the", None, 1), (10, "a" * 300_000, "en", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    out = predict_languages(docs).collect()
    assert len(out) == len(rows)
    for r in out:
        if r.text in (None, "", "123 !!"):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        else:
            assert r.lang_pred in ("en", "fr")
    assert len({(r.lang_pred, r.score) for r in out if r.text == "the"}) == 1
    assert predict_languages(docs.limit(0)).count() == 0
    assert fit(docs.where("lang IS NULL")) is None
    assert fit(docs, max_langs=1).langs == ["en"]


@pytest.mark.parametrize("most", [3, 7, 1000])
def test_pieces_hold_every_gram_once(most):
    texts, orders, bits = ["", "x", "Hello wörld 😀", "long " * 30, "zz"], (1, 2, 3), 10
    got = [[] for _ in texts]
    for own, more, rows in _pieces(texts, orders, most):
        assert sum(map(len, own)) <= most + 2
        for bucket, starts in _grams(own, orders, bits, more):
            for i, a, b in zip(rows, starts, [*starts[1:], len(bucket)], strict=True):
                got[i] += [x for x in bucket[a:b].tolist() if x < 1 << bits]
    for t, found in zip(texts, got, strict=True):
        assert sorted(found) == sorted(plain_buckets(t, orders, bits))


def test_a_long_text_is_judged_as_its_pieces(monkeypatch, spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = fit(docs)
    texts = [r.text * 3 for r in docs.limit(20).collect()]
    whole = model.score(texts)
    monkeypatch.setattr(language_id._pieces, "__defaults__", (400,))
    parts = model.score(texts)
    assert (whole[0] == parts[0]).all() and np.allclose(whole[1], parts[1])


def test_fitted_counts_and_rare_languages(spark):
    """Counts of the fit against counting each sampled text; a rare language is learned from all it has."""
    words = {"aa": "alpha beta gamma", "bb": "uno dos tres", "cc": "zzz yyy"}
    rows = [(i, words["aa" if i % 2 else "bb"] + f" {i}", "aa" if i % 2 else "bb") for i in range(2000)] + [(5000 + i, words["cc"], "cc") for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    learnable = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 != 2]
    model = fit(docs, bits=10, max_docs=300)
    assert model.langs == ["aa", "bb", "cc"]
    n = {k: sum(r[2] == k for r in learnable) for k in model.langs}
    assert np.allclose(model.prior, np.log([n[k] / len(learnable) for k in model.langs]))
    counts = np.zeros(1 << 10)
    for r in learnable:
        if r[2] == "cc":
            np.add.at(counts, list(plain_buckets(r[1], (1, 2, 3), 10)), 1)
    assert np.allclose(model.weights[2][:-1], np.log(counts + 0.5) - np.log(counts.sum() + 512))
    whole = fit(docs, bits=10)
    counts = np.zeros(1 << 10)
    for r in learnable:
        if r[2] == "aa":
            np.add.at(counts, list(plain_buckets(r[1], (1, 2, 3), 10)), 1)
    assert np.allclose(whole.weights[0][:-1], np.log(counts + 0.5) - np.log(counts.sum() + 512))


def test_many_labels_share_a_bounded_matrix(spark):
    rows = [(4 * i, f"word{i} text{i}", f"l{i:03d}") for i in range(150)]
    model = fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), max_cells=1 << 15)
    assert len(model.langs) > 65 and model.weights.size <= 1 << 16
