"""Operators of the rich model, chains of any length, PDF objects, exporters, and one pass over files."""

import struct
import zlib

import pytest
from pyspark.sql import functions as F

from quire.operators import graph, styles
from quire.plans.jobs import job_scope, progress
from quire.sources import build, clean, ooxml, pdf
from quire.sources.exporters import Exporter, ExportOptions, default_exporters
from quire.sources.registry import default_registry


def test_chains_of_any_length(spark):
    n = 1000
    rows = [(1, i, i - 1 if i else None, "root" if i == 0 else None, "mid" if i == 700 else None) for i in range(n)]
    rows += [(2, i, (i + 1) % 5, "loop" if i == 3 else None, None) for i in range(5)]
    nodes = spark.createDataFrame(rows, "doc int, id int, up int, a string, b string")
    out = {(r.doc, r.node): (r.a, r.b) for r in graph.inherited(nodes, "id", "up", ["doc"], ["a", "b"]).collect()}
    assert all(out[1, i] == ("root", "mid" if i >= 700 else None) for i in range(n)) and all(out[2, i] == ("loop", None) for i in range(5))
    few = nodes.where("doc = 2 OR id < 40")
    pairs = {(r.doc, r.node, r.ancestor): r.depth for r in graph.ancestors(few, "id", "up", ["doc"]).collect()}
    assert all(pairs[1, i, j] == i - j for i in range(40) for j in range(i + 1)) and len(pairs) == 40 * 41 // 2 + 25
    assert all(pairs[2, i, j] == (j - i) % 5 for i in range(5) for j in range(5))


def test_reaching_with_few_and_many_levels(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(0, 100 + i) for i in range(50)] + [(30, 0)], "src int, dst int")
    got = {r.node: r.depth for r in graph.reachable(edges, spark.createDataFrame([(0,)], "node int")).collect()}
    assert got == {i: i for i in range(31)} | {100 + i: 1 for i in range(50)}




def _xref_stream_pdf():
    """Two objects in an object stream, found by a cross-reference stream."""
    packed = b"10 0 11 22 <</Type /Thing /N (a\\)b)>> [1 (x) /Y]"
    first = packed.index(b"<<")
    head = f"10 0 11 {packed.index(b'[') - first} ".encode()
    body = head + packed[first:]
    raw = zlib.compress(body)
    out = bytearray(b"%PDF-1.5\n")
    at_objects = len(out)
    out += f"2 0 obj\n<</Type /ObjStm /N 2 /First {len(head)} /Filter /FlateDecode /Length {len(raw)}>>\nstream\n".encode() + raw + b"\nendstream\nendobj\n"
    at_xref = len(out)
    rows = [(0, 0, 0), (1, at_xref, 0), (1, at_objects, 0), (2, 2, 0), (2, 2, 1)]
    table = zlib.compress(b"".join(struct.pack(">BHB", *r) for r in rows))
    out += f"1 0 obj\n<</Type /XRef /W [1 2 1] /Index [0 3 10 2] /Size 12 /Filter /FlateDecode /Length {len(table)}>>\nstream\n".encode() + table + b"\nendstream\nendobj\n"
    return bytes(out) + f"startxref\n{at_xref}\n%%EOF".encode()


def test_pdf_objects(spark):
    found = {o["object"]: o for o in pdf.pdf_objects(_xref_stream_pdf())}
    assert found[10]["type"] == "Thing" and found[10]["packed"] and found[11]["kind"] == "array" and found[2]["type"] == "ObjStm"
    assert pdf.Values(rb"<</A [1 2.5 -3 true null] /B (x\(y\)\101) /C <414> /D#20E 5 0 R>>").read() == {"A": [1, 2.5, -3, True, None], "B": b"x(y)A", "C": b"A@", "D E": (5, 0)}
    for bad in (b"", b"%PDF-1.4 startxref 5", build.render_pdf({}, 1).replace(b"/Kids", b"/Kids [" + b"[" * 100), build.render_pdf({}, 2)[:-30] + b"startxref\n9\n"):
        with pytest.raises(ValueError):
            pdf.pdf_objects(bad)
    df = spark.createDataFrame([(1, bytearray(_xref_stream_pdf())), (2, bytearray(b"zz")), (3, None)], "id int, content binary")
    rows = pdf.object_table(df, "id").collect()
    assert sum(r.id == 1 for r in rows) == 4 and {r.fault for r in rows if r.id > 1} == {"not-pdf"}


def test_exporters(spark):
    r = default_registry()
    files = r.typed(spark.createDataFrame([("/a.txt", 3, bytearray(b"x\ny"), None), ("/b.bin", 1, bytearray(b"?"), None)], "path string, length long, content binary, modificationTime timestamp"))
    out = {x.path: x for x in default_exporters().convert(files, "html").collect()}
    assert b"<p>x</p><p>y</p>" in bytes(out["/a.html"].content) and out["/b.html"].fault == "unknown-format"
    e = default_exporters()
    with pytest.raises(ValueError):
        e.register(Exporter("txt", ".x", None))
    with pytest.raises(ValueError):
        e.render(files, "path", "nothing")
    with pytest.raises(Exception, match="unknown-format"):
        e.convert(files, "txt", write=ExportOptions(strict=True)).collect()
    docx = e.convert(files.where("format = 'txt'"), "docx").collect()[0]
    assert [b["text"] for b in ooxml.docx_blocks(bytes(docx.content))] == ["x", "y"]


def test_contents_are_read_once(spark, tmp_path):
    for i in range(4):
        (tmp_path / f"f{i}.txt").write_text("x")
    (tmp_path / "g.html").write_text("<p>y</p>")
    r = default_registry()
    plan = r.read(r.files(spark, str(tmp_path)))._jdf.queryExecution().executedPlan().toString()
    scans = [x for x in plan.split("\n") if "FileScan binaryFile" in x]
    assert len(scans) == 2 and sum("content#" in x.split("ReadSchema")[0] for x in scans) == 1


def test_jobs(spark):
    with job_scope(spark, "counting"):
        assert spark.range(1000).repartition(3).count() == 1000
    done, total = progress(spark, "counting")
    assert 3 <= done <= total
    with pytest.raises(RuntimeError), job_scope(spark, "failing"):
        raise RuntimeError


def test_embedded_xml():
    xml, said = clean.clean_xml('<svg viewbox="0 0 1 1"><g onclick="x"><a href="http://x"/><script/><style/></g></svg>', "svg")
    assert 'viewBox="0 0 1 1"' in xml and "script" not in xml and "http://x" not in xml and len(said) == 4
    assert clean.clean_xml("<b/>", "svg")[0] is None and clean.clean_xml("<svg", "svg")[0] is None
    assert clean.svg_colors('<g><path style="fill:#abc" stroke="none"/></g>') == [{"element": "path", "attribute": "fill", "color": "#aabbcc", "alpha": 1.0}]


def test_styles_of_odd_rows(spark):
    own = spark.createDataFrame([(1, 0, "a", None), (1, 1, None, 5.0), (1, 2, "nope", None)], "doc int, p int, style string, v double")
    known = spark.createDataFrame([(1, "a", "b", None), (1, "b", "a", 7.0)], "doc int, style string, base string, v double")
    assert {r.p: r.v for r in styles.effective_values(own, known, ["doc"], "p", ["v"]).collect()} == {0: 7.0, 1: 5.0, 2: None}
    none = F.lit(None).cast("array<struct<name:string,value:double>>")
    one = spark.range(1).select(styles.resolve_color(F.lit("#102030"), none).alias("c"), styles.resolve_color(F.lit("zz"), none).alias("d")).first()
    assert one.c.hex == "#102030" and one.c.alpha == 1.0 and one.d is None
