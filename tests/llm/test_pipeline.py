import corpus_pipeline as p
from quire.llm.queries import tokenizer_path
from quire.llm.sentencepiece_codec import load_model
from quire.plans.scratch import Scratch


def test_stages_on_planted_documents(spark):
    text = lambda i: " ".join(f"the word{i}x{j} and of" for j in range(40))
    rows = [(i, text(i), "en", "a", 1) for i in range(20)]
    rows += [(100, text(3), "en", "a", 1), (101, text(4) + " tail", "en", "b", 1), (102, None, "en", "a", 1), (103, "", "en", "a", 1), (104, "1234 !!!", "en", "a", 1), (105, text(50) + " mail me@x.org now", "en", "b", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert [n for n, _ in p.STAGES] == ["language_id", "jaccard_join", "personal_data", "source_mixing", "sentencepiece"]
    scratch = Scratch(spark, "test")
    one = scratch.keep(p.language_id(spark, docs, ""))
    assert {r.doc_id for r in one.collect()} == {*range(20), 100, 101, 105}
    two = scratch.keep(p.jaccard_join(spark, one, ""))
    assert {r.doc_id for r in two.collect()} == {*range(20), 105}
    three = scratch.keep(p.personal_data(spark, two, ""))
    by = {r.doc_id: r for r in three.collect()}
    assert by[105].text.endswith("mail [EMAIL] now") and by[105].n_chars == len(by[105].text) and by[3].text == text(3)
    four = scratch.keep(p.source_mixing(spark, three, ""))
    for d in (one, two, three, four):
        assert d.columns == list(p.COLUMNS)
    assert {r.doc_id for r in four.collect()} <= {*range(20), 105} and four.count() > 5
    five = p.sentencepiece(spark, four, "").collect()
    model = load_model(tokenizer_path())
    assert len(five) == four.count() and all(model.decode(r.ids) == by[r.doc_id].text and r.n_tokens == len(r.ids) for r in five)
    empty = docs.limit(0)
    for _, f in p.STAGES:
        empty = f(spark, empty, "")
    assert empty.count() == 0


def test_run(spark):
    out = p.run(spark, "/root/testdata/sf0.001")
    assert out.count() > 100 and set(out.columns) == {"doc_id", "lang", "source", "n_tokens", "ids"}
