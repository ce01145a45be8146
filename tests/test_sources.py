import hashlib
import io
import struct
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from quire.sources import binary, office, tex
from quire.sources.archive import ArchiveLimits, build_archive, check_archives, members, resolve_target
from quire.sources.epub import Epub, reveal_font
from quire.sources.registry import default_registry
from quire.sources.sinks import publish, render_epub, render_lists, to_html, to_latex, to_text, verify_html

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
TYPES = '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="xml" ContentType="application/xml"/></Types>'
RELS = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{}</Relationships>'
MAIN = '<Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="{}"/>'


def docx(body):
    return build_archive([("[Content_Types].xml", TYPES.encode()), ("_rels/.rels", RELS.format(MAIN.format("word/document.xml")).encode()), ("word/document.xml", f'<w:document xmlns:w="{W}"><w:body>{body}</w:body></w:document>'.encode())])


def p(text):
    return f'<w:p><w:r><w:t xml:space="preserve">{text}</w:t></w:r></w:p>'


BODY = p("One") + "<w:p/>" + p("two words") + f'<w:tbl><w:tr><w:tc><w:tcPr><w:gridSpan w:val="2"/></w:tcPr>{p("wide")}</w:tc></w:tr><w:tr><w:tc><w:tcPr><w:vMerge w:val="restart"/></w:tcPr>{p("a")}</w:tc><w:tc>{p("b")}</w:tc></w:tr><w:tr><w:tc><w:tcPr><w:vMerge/></w:tcPr>{p("")}</w:tc><w:tc>{p("c")}</w:tc></w:tr></w:tbl>'


def test_docx():
    flat = office.docx_flat(docx(BODY))
    assert flat["paragraphs"] == ["One", "", "two words"]
    assert flat["tables"] == [[["wide", "wide"], ["a", "b"], ["a", "c"]]]
    assert flat["plain"].endswith("wide | wide\na | b\na | c")
    ids = [x["id"] for x in office.docx_paragraphs(docx(BODY))]
    patched = office.docx_patch(docx(BODY), [{"id": ids[2], "start": 0, "end": 3, "text": "THREE"}, {"id": ids[2], "start": 4, "end": 9, "text": "x"}, {"id": ids[0], "text": "Whole"}])
    assert office.docx_flat(patched)["paragraphs"] == ["Whole", "", "THREE x"]
    for bad in ([{"id": "nope", "text": ""}], [{"id": ids[2], "start": 0, "end": 4, "text": ""}, {"id": ids[2], "start": 3, "end": 5, "text": ""}], [{"id": ids[0], "text": "a"}, {"id": ids[0], "start": 0, "end": 1, "text": "b"}], [{"id": ids[0], "start": 2, "end": 99, "text": ""}]):
        with pytest.raises(ValueError):
            office.docx_patch(docx(BODY), bad)
    with pytest.raises(ValueError):
        office.parse_xml(b"<!DOCTYPE a><a/>")


def pptx(texts):
    a, pp, r = "http://schemas.openxmlformats.org/drawingml/2006/main", "http://schemas.openxmlformats.org/presentationml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    slides = [(f"ppt/slides/s{i}.xml", f'<p:sld xmlns:p="{pp}" xmlns:a="{a}"><p:cSld><p:spTree><p:sp><p:txBody><a:p><a:r><a:t>{t}</a:t></a:r><a:br/><a:r><a:t>x</a:t></a:r></a:p></p:txBody></p:sp><p:grpSp><p:sp><p:txBody><a:p><a:r><a:t>grouped</a:t></a:r></a:p></p:txBody></p:sp></p:grpSp></p:spTree></p:cSld></p:sld>'.encode()) for i, t in enumerate(texts)]
    ids = "".join(f'<p:sldId r:id="r{i}"/>' for i in reversed(range(len(texts))))
    rels = "".join(f'<Relationship Id="r{i}" Type="slide" Target="slides/s{i}.xml"/>' for i in range(len(texts)))
    return build_archive([("[Content_Types].xml", TYPES.encode()), ("_rels/.rels", RELS.format(MAIN.format("ppt/p.xml")).encode()), ("ppt/p.xml", f'<p:presentation xmlns:p="{pp}" xmlns:r="{r}"><p:sldIdLst>{ids}</p:sldIdLst></p:presentation>'.encode()), ("ppt/_rels/p.xml.rels", RELS.format(rels).encode()), *slides])


def test_pptx():
    assert office.pptx_flat(pptx(["first", "second"]))["slides"] == ["second\vx", "first\vx"]
    with pytest.raises(ValueError, match="no-shape-tree"):
        office.pptx_flat(build_archive([(n, b.replace(b"spTree", b"other")) for n, b in members(pptx(["a"])).items()]))


def test_archives(spark):
    bomb = io.BytesIO()
    with zipfile.ZipFile(bomb, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a", b"0" * 1_000_000)
    with pytest.raises(ValueError, match="suspicious-ratio"):
        members(bomb.getvalue())
    with pytest.raises(ValueError, match="unsafe-name"):
        members(build_archive([("../x", b"")]))
    rows = [(1, bytearray(build_archive([("a", b"x"), ("b", b"y")]))), (2, bytearray(bomb.getvalue())), (3, bytearray(b"no")), (4, bytearray(build_archive([("/abs", b"")])))]
    got = {r.id: r.fault for r in check_archives(spark.createDataFrame(rows, "id long, content binary"), "id").collect()}
    assert got == {1: None, 2: "suspicious-ratio", 3: "not-an-archive", 4: "unsafe-name"}
    assert check_archives(spark.createDataFrame(rows[:1], "id long, content binary"), "id", limits=ArchiveLimits(entries=1)).first().fault == "too-many-entries"
    assert resolve_target("/a/b.xml", "../c.xml") == "/c.xml" and resolve_target("/a/b.xml", "") == "/a/b.xml" and resolve_target("/a/b.xml", "/d/./e%20f") == "/d/e f"
    for bad in ("../../x", "http://x/y", "a?b", "a\\b", "a%2fb"):
        with pytest.raises(ValueError):
            resolve_target("/a/b.xml", bad)


def test_epub():
    rows = [{"text": "Chapter 1", "level": 1}, {"text": "a & b", "level": 0}, {"text": "item", "level": 0, "list_level": 0}, {"text": "Two", "level": 1}, {"text": "end", "level": 0}]
    data = render_epub(rows, "urn:x:1", "Book", "en")
    book = Epub(data)
    assert next(iter(book.files)) == "mimetype" and book.metadata()["title"] == ["Book"]
    assert [s["title"] for s in book.spine()] == ["Chapter 1", "Two"]
    blocks, lost = book.chapters()
    assert [b["text"] for b in blocks] == [r["text"] for r in rows] and lost == []
    assert book.font_key() == hashlib.sha1(b"urn:x:1").digest()
    font = bytes(range(256)) * 8
    assert reveal_font(reveal_font(font, b"key"), b"key") == font and reveal_font(font, b"key")[1040:] == font[1040:]


def test_tex():
    src = r"""\documentclass{article}% note
\begin{document}
\section{T\"itle}
Hello \textbf{bold} \'e~x % gone
and more.

\begin{enumerate}\item one \item[a] two\end{enumerate}
\[ x = y^2 \label{eq} \]
\begin{tabular}{l|c}\hline a & b \\ \multicolumn{2}{c}{wide} \\ \end{tabular}
\unknowncmd{} $a$ \end{document} after"""
    r = tex.Reader(src)
    assert [(b["kind"], b["text"]) for b in r.blocks] == [("heading", "Tïtle"), ("paragraph", "Hello bold é\u00a0x and more."), ("item", "one"), ("item", "a two"), ("formula", "x = y^2"), ("table", "a | b\nwide | wide"), ("paragraph", "a")]
    assert r.labels == ["eq"] and r.issues == ["unknown command unknowncmd"]
    assert [b["list_value"] for b in r.blocks if b["kind"] == "item"] == [1, 2]
    kinds = [(k, v) for k, v, _, _ in tex.tokens(r"a\b{c}%x" + "\n\nd")]
    assert kinds == [("text", "a"), ("command", "b"), ("symbol", "{"), ("text", "c"), ("symbol", "}"), ("text", "\n"), ("text", "d")] or kinds[-1] == ("text", "d")
    assert tex.column_tokens("|l*{2}{c}p{3cm}|") == ["l", "c", "c", "p{3cm}"] and tex.column_tokens("lq") is None
    assert tex.math_fault(r"\frac{a}{b}") is None and tex.math_fault("{") == "unbalanced" and tex.math_fault(r"\evil") == "unknown evil"


def png(extra=()):
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    return binary.PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", 3, 2, 8, 2, 0, 0, 0)) + b"".join(chunk(k, b) for k, b in extra) + chunk(b"IDAT", zlib.compress(b"\0" * 20)) + chunk(b"IEND", b"")


def test_filters():
    data = bytes(range(256)) * 20
    assert binary.inflate(zlib.compress(data)) == data
    assert binary.unpack_runs(bytes([2, 65, 66, 67, 254, 68, 128])) == b"ABCDDD"
    assert binary.ascii85(b"87cURD]i,\"Ebo80~>") == b"Hello World!" and binary.ascii85(b"z~>") == b"\0" * 4
    assert binary.ascii_hex(b"48 65 6C7>") == b"Help"
    assert binary.unpack_lzw(bytes([0x80, 0x0B, 0x60, 0x50, 0x22, 0x0C, 0x0C, 0x85, 0x01])) == bytes([45, 45, 45, 45, 45, 65, 45, 45, 45, 66])
    for f, bad in ((binary.inflate, b"xx"), (binary.unpack_runs, b"\x05a"), (binary.ascii85, b"\x80"), (binary.ascii_hex, b"zz>"), (binary.unpack_lzw, b"\x80")):
        with pytest.raises(ValueError):
            f(bad)
    with pytest.raises(ValueError):
        binary.inflate(zlib.compress(b"0" * 1000), 10)
    assert binary.undo_png(bytes([1, 1, 1, 1, 2, 1, 1, 1]), 3, 1) == bytes([1, 2, 3, 2, 3, 4])
    assert binary.undo_tiff(bytes([1, 1, 1, 1]), 1, 8, 4) == bytes([1, 2, 3, 4])


def test_png_and_fonts():
    kinds = [c["kind"] for c in binary.png_chunks(png([(b"gAMA", struct.pack(">I", 45455))]))]
    assert kinds == ["IHDR", "gAMA", "IDAT", "IEND"] and binary.png_header(png())["width"] == "3"
    broken = bytearray(png())
    broken[20] ^= 1
    assert not binary.png_chunks(bytes(broken))[0]["crc_ok"]
    head = struct.pack(">IIIIHH", 0x10000, 0, 0, 0x5F0F3CF5, 0, 1000) + bytes(34)
    cmap = struct.pack(">HHHHI", 0, 1, 3, 10, 12) + struct.pack(">HHIIIIII", 12, 0, 28, 0, 1, 65, 70, 3)
    tables = {b"cmap": cmap, b"head": head, b"hhea": struct.pack(">Ihhh", 0x10000, 800, -200, 90) + bytes(26)}
    at, directory, body = 12 + 16 * len(tables), b"", b""
    for k, v in tables.items():
        directory += struct.pack(">4sIII", k, binary.sfnt_sum(v, k == b"head"), at + len(body), len(v))
        body += v + b"\0" * (-len(v) % 4)
    font = b"\0\1\0\0" + struct.pack(">HHHH", len(tables), 0, 0, 0) + directory + body
    assert all(t["checksum_ok"] for t in binary.sfnt_directory(font))
    assert binary.sfnt_metrics(font) == {"units_per_em": 1000, "ascender": 800, "descender": -200, "line_gap": 90}
    assert binary.sfnt_cmap(font) == {65 + i: 3 + i for i in range(6)}


def test_pdf_and_kernels(spark):
    pdf = b"%PDF-1.7\n1 0 obj<</Type /Pages /Kids[] /Count 7>>endobj\n2 0 obj<</Title (A \\(b\\)) /Author <FEFF0416>>>endobj"
    assert binary.pdf_info(pdf) == {"version": "1.7", "pages": "7", "Title": "A (b)", "Author": "Ж"}
    df = spark.createDataFrame([(bytearray(pdf),), (bytearray(b"zz"),), (None,)], "c binary")
    rows = [r.o for r in df.select(binary.read_pdf_info(F.col("c")).alias("o")).collect()]
    assert rows[0].value["pages"] == "7" and rows[1].fault == "not-pdf" and rows[2] is None


def test_registry_reads_files_of_any_kind(spark, tmp_path):
    files = {"a.txt": b"x\r\ny", "b.html": b"<h1>T</h1><p>x", "c.tex": rb"\section{S} body", "d.docx": docx(BODY), "e.pptx": pptx(["s"]), "f.png": png(), "g.bin": b"?", "h.txt": b"\xff\xff", "i.docx": b"broken", "j.epub": render_epub([{"text": "C", "level": 1}], "i", "t")}
    for n, b in files.items():
        (tmp_path / n).write_bytes(b)
    r = default_registry()
    got = {x.path.rpartition("/")[2]: x for x in r.read(r.files(spark, str(tmp_path))).collect()}
    assert len(got) == len(files)
    assert [b.text for b in got["a.txt"].blocks] == ["x", "y"] and [b.text for b in got["b.html"].blocks] == ["T", "x"]
    assert got["d.docx"].blocks[-1].text == "a | c" and got["e.pptx"].blocks[0].text == "s\vx" and got["j.epub"].blocks[0].text == "C"
    assert got["g.bin"].fault == "unknown-format" and got["h.txt"].fault == "ambiguous-encoding" and got["i.docx"].fault == "not-an-archive"
    assert "width=3" in [b.text for b in got["f.png"].blocks]
    assert all(x.fault == "too-large" for x in r.read(r.files(spark, str(tmp_path), glob="*.tex"), most_bytes=3).collect())
    with pytest.raises(ValueError):
        r.register(r.formats["txt"])


def test_sinks(spark, tmp_path):
    rows = [(1, 0, "Head", 1, None, "en"), (1, 1, "a & b", 0, None, "en"), (1, 2, "one", 0, 0, "en"), (1, 3, "in", 0, 1, "en"), (1, 4, "two", 0, 0, "en"), (1, 5, "end", 0, None, "en"), (2, 0, "x", 0, None, None)]
    blocks = spark.createDataFrame(rows, "id long, pos int, text string, level int, list_level int, lang string")
    text = {r.id: bytes(r.content).decode() for r in to_text(blocks, "id").collect()}
    assert text[1] == "Head\na & b\none\nin\ntwo\nend"
    page = to_html(blocks, "id")
    html = {r.id: bytes(r.content).decode() for r in page.collect()}
    assert "<ul><li><p>one</p><ul><li><p>in</p></li></ul></li><li><p>two</p></li></ul>" in html[1] and "a &amp; b" in html[1]
    faults = verify_html(page, "id", blocks)
    assert faults.where("fault IS NOT NULL").count() == 0
    tex_out = {r.id: bytes(r.content).decode() for r in to_latex(blocks, "id").collect()}
    assert "\\section{Head}\n\na \\& b" in tex_out[1] and "\\begin{itemize}\n\\item one\n\\item in\n\\item two\n\\end{itemize}" in tex_out[1]
    path = publish(spark, page, str(tmp_path / "out"), faults)
    assert spark.read.parquet(path).count() == 2
    publish(spark, page.limit(1), path)
    assert spark.read.parquet(path).count() == 1
    with pytest.raises(ValueError):
        publish(spark, page, path, page.selectExpr("id", "'bad' AS fault"))
    assert render_lists([{"text": "x", "list_level": 1}]) == "<ul><li><ul><li><p>x</p></li></ul></li></ul>"
