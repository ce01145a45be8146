import pytest
from pyspark.sql import functions as F

from quire.functions import text
from quire.sources.text import TextProfile, comparable, decode_bytes, decode_text, decode_with_fallback, encode_string, fold, paragraphs


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "t string").select(column.alias("o")).collect()[0].o


@pytest.mark.parametrize(("t", "want"), [("a{b}", r"a\{b\}"), ("\\", r"\textbackslash{}"), ("50% $x_1^2~[#&]", r"50\% \$x\_1\^{}2\~{}\[\#\&\]"), ("…", r"\dots{}"), ("", "")])
def test_latex(spark, t, want):
    assert one(spark, text.escape_latex(F.col("t")), t) == want


@pytest.mark.parametrize(("t", "want"), [("a<b>c", "a_b_c"), ("<>test<>", "test"), ("x::y", "x_y"), (" a ", "a"), ("???", "")])
def test_file_names(spark, t, want):
    assert one(spark, text.sanitize_filename(F.col("t")), t) == want
    assert one(spark, text.sanitize_filename(F.col("t"), "-"), t) == want.replace("_", "-")


def test_artifact_names(spark):
    for t, want in (("a/b/con.txt", "_con.txt"), ("..", "artifact"), (None, "artifact"), ("x\x01y", "xy"), ("z" * 300, "z" * 160)):
        assert one(spark, text.safe_artifact_name(F.col("t")), t) == want


def test_newlines(spark):
    t = "a\r\nb\rc\nd"
    assert one(spark, text.normalize_newlines(F.col("t")), t) == "a\nb\nc\nd"
    assert one(spark, text.separators(F.col("t")), t) == ["\r\n", "\r", "\n"]
    assert one(spark, text.restore_newlines(text.normalize_newlines(F.col("t")), text.separators(F.col("t"))), t) == t
    counts = text.newline_counts(F.col("t"))
    assert [one(spark, counts[k], t) for k in ("n_crlf", "n_cr", "n_lf")] == [1, 1, 1]
    df = spark.createDataFrame([(1, "a\n")], "id long, text string")
    assert [r.text for r in paragraphs(df, "id").orderBy("pos").collect()] == ["a", ""]


def test_decoding():
    reason = lambda b, **k: decode_bytes(b, TextProfile(**k))["reason"]
    assert decode_bytes("тест".encode("cp1251"), TextProfile("cp1251"))["text"] == "тест"
    assert decode_bytes("\ufeffx".encode())["text"] == "x" and decode_bytes("\ufeffx".encode())["bom"]
    assert decode_bytes(b"\xff\xfea\0")["text"] == "a" and decode_bytes(b"\xfe\xff\0a")["encoding"] == "utf-16-be"
    assert reason(b"\xff\xfe\0\0x\0\0\0") == "unsupported-encoding"
    assert reason(b"x", bom="require") == "missing-bom" and reason(b"\xef\xbb\xbfx", bom="forbid") == "forbidden-bom"
    assert reason(b"\xff\xfex\0", encoding="utf-8") == "conflicting-bom"
    assert reason(b"\xff") == "ambiguous-encoding" and reason(b"\xff", encoding="utf-8") == "invalid-encoding"
    assert reason(b"a\0b") == "binary-or-ambiguous"
    with pytest.raises(ValueError):
        TextProfile("cp1251", "require")
    assert encode_string("a\nb", TextProfile(newline="crlf"))[0] == b"a\r\nb"
    assert encode_string("a\nb\n", TextProfile(), separators=["\r", "\n"]) == (b"a\rb\n", False)
    assert encode_string("a\nb\n", TextProfile(), separators=["\r"]) == (b"a\nb\n", True)


def test_decoding_columns(spark):
    df = spark.createDataFrame([(bytearray(b"ok"),), (bytearray("тест".encode("cp1251")),), (None,), (bytearray(b""),)], "c binary")
    rows = df.select(decode_text(F.col("c")).alias("d"), decode_with_fallback(F.col("c")).alias("f")).collect()
    assert [r.f for r in rows] == ["ok", "тест", None, ""]
    assert rows[0].d.text == "ok" and rows[1].d.reason == "ambiguous-encoding" and rows[2].d is None


def test_folds_and_keys(spark):
    assert one(spark, fold(F.col("t")), "Straße") == "strasse"
    assert one(spark, comparable(F.col("t")), "ﬁ x\u00ad y") == "fixy"
    assert one(spark, text.repeat_key(F.col("t")), "  Page\u00a012 of  A4 ") == "page # of a4"
    assert one(spark, text.font_family_key(F.col("t")), "Times New-Roman 2") == "timesnewroman2"
    assert [one(spark, text.font_class(F.col("t")), x) for x in ("Courier New", "Noto Serif", "Open Sans", "Zapf")] == ["mono", "serif", "sans", "sans"]
    assert one(spark, text.relationship_owner(F.col("t")), "/a/_rels/b.rels") == "/a/b"
    assert [one(spark, text.is_part_name(F.col("t")), x) for x in ("/a/b.xml", "/a//b", "a", "/a/../b", "/a?b")] == [True, False, False, False, False]
    assert [one(spark, text.allowed_link(F.col("t")), x) for x in ("#a", "HTTP://x", "javascript:1", "/rel", "mailto:a@b.c")] == ["#a", "HTTP://x", None, None, "mailto:a@b.c"]
    assert one(spark, text.latex_paragraphs(F.col("t")), "a\n\n--\n\n\nb c\n") == 2
    assert one(spark, text.escape_html(F.col("t")), '<a b="c">&') == "&lt;a b=&quot;c&quot;&gt;&amp;"
    assert one(spark, text.css_identifier(F.col("t")), "9 a!") == "_9-a-"
