import math

import numpy as np
from pyspark.sql import functions as F

from quire.llm import toxicity
from quire.llm.common import held_out

SF = "/root/testdata/sf0.1"


def test_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    out = toxicity.score_toxicity(docs, model).select("doc_id", "score", "predicted", held_out(F.col("doc_id")).alias("h")).join(labels, "doc_id").where("h").toPandas()
    assert out.score.between(0, 1).all() and ((out.score >= 0.3) == (out.predicted == 1)).all()
    bad, good = out[out.toxic == 1], out[out.toxic == 0]
    assert bad.predicted.mean() > 0.7 and good.predicted.mean() < 0.02
    assert 0 < len(model.at) < 20_000  # sparse


def plain_ftrl(rows, alpha, beta, l1, l2):
    """The published update, a coordinate at a time."""
    z, n = {}, {}

    def w(i, lam):
        if abs(z.get(i, 0.0)) <= lam:
            return 0.0
        return -(z[i] - math.copysign(lam, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)

    for at, y in rows:
        keys = [("w", i) for i in at]
        weights = {k: w(k, l1) for k in keys}
        weights["b"] = w("b", 0.0)
        g = 1 / (1 + math.exp(-sum(weights.values()))) - y
        for k in [*keys, "b"]:
            s = (math.sqrt(n.get(k, 0.0) + g * g) - math.sqrt(n.get(k, 0.0))) / alpha
            z[k] = z.get(k, 0.0) + g - s * weights[k]
            n[k] = n.get(k, 0.0) + g * g
    return {k[1]: w(k, l1) for k in z if k != "b" and w(k, l1)}, w("b", 0.0)


def test_learner_agrees_with_the_plain_update():
    draw = np.random.default_rng(4)
    rows = [(np.unique(draw.integers(0, 64, 9)).astype(np.int32), int(draw.integers(0, 2))) for _ in range(200)]
    model = toxicity.Ftrl(6, alpha=0.3, beta=1.0, l1=0.5, l2=0.7)
    for at, y in rows:
        model.learn(at, y)
    at, w, bias = model.weights()
    want, b = plain_ftrl([(a.tolist(), y) for a, y in rows], 0.3, 1.0, 0.5, 0.7)
    assert dict(zip(at.tolist(), w.tolist(), strict=True)).keys() == want.keys()
    assert np.allclose([want[i] for i in at.tolist()], w, atol=1e-6) and math.isclose(b, bias)


def test_odd_rows(spark):
    rows = [(i, "you vile fool" if i % 2 else "a fine day", 9) for i in range(40)] + [(100, None, 9), (101, "", 9), (102, "x " * 100_000, 9), (None, "vile", 9), (1, "again", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(None, 1), (3, None), (1, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, l1=1.0)
    out = {r.doc_id: r for r in toxicity.score_toxicity(docs, model).collect()}
    assert out[100].score == out[101].score and 0 <= out[102].score <= 1
    assert out[5].score > out[6].score
    empty = toxicity.fit(docs.limit(0), labels.limit(0))
    assert len(empty.at) == 0 and toxicity.score_toxicity(docs, empty).select("score").distinct().collect()[0][0] == 0.5
    few = toxicity.fit(docs, labels, max_per_class=3, l1=1.0)
    assert len(few.at) <= len(model.at) + 50
