import pytest

from quire.llm.queries import tokenizer_path
from quire.llm.sentencepiece_codec import BPE, UNIGRAM, PieceModel, decode_documents, encode_documents, load_model, recode_documents

sentencepiece = pytest.importorskip("sentencepiece")
TEXTS = ["", " ", "  ", " a", "a b  c\n\n d\t e ", "日本語テキスト 123 4567", "<s> </s> <unk> <0x41>", "\x00 é́ ß İ 🤯👨‍👩‍👧", "a" * 500, "   " * 40 + "x", "Hello   world. (x), y-z/w " * 20, "Straße étoile mañana", "The the\nThe.Then,so", "￿ \ud7ff\U0010ffff"]


@pytest.fixture(scope="module")
def model():
    return load_model(tokenizer_path())


def test_bpe_ids_are_the_library_s(model):
    lib = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path())
    assert model.kind == BPE
    for t in TEXTS:
        ids = model.encode(t)
        assert ids == lib.encode(t), t
        assert model.decode(ids) == t == lib.decode(ids)


def test_bpe_on_documents(model):
    duckdb = pytest.importorskip("duckdb")
    lib = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path())
    for (t,) in duckdb.sql("SELECT text FROM '/root/testdata/sf0.001/documents.parquet'").fetchall():
        assert model.encode(t) == lib.encode(t)


def _unigram_bytes():
    pb = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    m = pb.ModelProto()
    with open(tokenizer_path(), "rb") as f:
        m.ParseFromString(f.read())
    m.trainer_spec.model_type = UNIGRAM
    for i, p in enumerate(m.pieces):
        if p.type == 1:  # sums of these are exact in single precision
            p.score = -2.0 - (i * 7919 % 8191) / 1024
    return m.SerializeToString()


def test_unigram_reaches_the_library_s_best_score():
    data = _unigram_bytes()
    own, lib = PieceModel(data), sentencepiece.SentencePieceProcessor(model_proto=data)
    total = lambda ids: sum(own.scores[i] for i in ids if i > 258)
    same = 0
    for t in TEXTS:
        a, b = own.encode(t), lib.encode(t)
        assert total(a) == pytest.approx(total(b)) and own.decode(a) == t
        same += a == b
    assert same >= len(TEXTS) - 3  # ties aside


def test_documents(spark, model):
    rows = [(i, t, "x") for i, t in enumerate([*TEXTS, None])]
    out = decode_documents(encode_documents(spark.createDataFrame(rows, "doc_id long, text string, ids string"), model), model).collect()
    for r in out:
        assert r.decoded == r.text and (r.ids is None) == (r.text is None)
    again = recode_documents(spark.createDataFrame(rows, "doc_id long, text string, ids string"), model).collect()
    assert sorted(map(str, again)) == sorted(map(str, out))
    assert encode_documents(spark.createDataFrame([], "doc_id long, text string"), model).count() == 0


def test_models_that_it_refuses():
    with pytest.raises((ValueError, KeyError)):
        PieceModel(b"\x12\x02\x18\x03")
