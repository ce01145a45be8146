"""What only shows in fresh workers, on odd pages or on larger tables."""

import subprocess
import sys
from pathlib import Path

import pyarrow as pa
import pytest

from quire.queries import QUERIES
from quire.sources import html
from quire.sources.archive import build_archive, members
from quire.sources.sinks import render_epub

REPO = str(Path(__file__).resolve().parents[1])


@pytest.mark.parametrize("module", ["core_queries", "source_queries", "model_queries", "queries"])
def test_modules_import_first(module):
    """A worker imports the module of the kernel that it gets, and no other before it."""
    subprocess.run([sys.executable, "-c", f"import quire.{module}; from quire.queries import QUERIES; assert 'font_tables' in QUERIES"], cwd=REPO, check=True)


def test_archives_of_repeated_words_can_be_read():
    """A text of one word over and over shrinks beyond the ratio that readers refuse."""
    files = [("a", b"Von " * 50_000), ("b", b"x")]
    assert members(build_archive(files)) == dict(files)
    assert b"Von Von" in members(render_epub([{"text": "Von " * 50_000, "level": 1}, {"text": "y", "level": 0}], "1", "t"))["c0.xhtml"]


@pytest.mark.parametrize("name", ["epub_blocks", "epub_chapters", "epub_metadata"])
def test_books_of_repeated_words(spark, tmp_path, name):
    spark.createDataFrame([(1, "Von " * 50_000 + "\nend", "de"), (2, "a\nb", "de")], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(r.doc_id for r in QUERIES[name](spark, str(tmp_path)).collect())
    assert got == ([1, 2] if name == "epub_metadata" else [1, 1, 2, 2])


def test_strokes_are_not_broadcast(spark):
    """They are exploded to their neighbours, which estimated sizes leave out; small inputs show in the plan only."""
    df = QUERIES["stroke_sides"](spark, "/root/testdata/sf0.001")
    assert "Broadcast" not in df._jdf.queryExecution().sparkPlan().toString()


def test_converted_files_are_not_broadcast(spark):
    """Contents count as a hundred bytes in estimated sizes, whatever their length."""
    df = QUERIES["converted_files"](spark, "/root/testdata/sf0.001")
    assert "Broadcast" not in df._jdf.queryExecution().sparkPlan().toString()


def test_equal_pages_are_read_once(monkeypatch):
    """What was read of a page is kept within bounds, and a page is never taken for another."""
    monkeypatch.setattr(html, "_kept", {})
    monkeypatch.setattr(html, "MOST_KEPT_CHARACTERS", 400)
    read, seen = html._read, []
    monkeypatch.setattr(html, "_read", lambda h, wanted: seen.append(h) or read(h, wanted))
    kind = pa.struct([("flat", pa.string()), ("title", pa.string())])
    for k in (0, 0, 1, 30, 0, 60):
        rows = [f"<head><title>t{i % 7 + k}</title></head><p>x{i % 7 + k}</p>" if i % 5 else None for i in range(40)]
        got = html._read_batch(pa.array(rows, pa.string()), ("flat", "title"), kind).to_pylist()
        assert got == [{"flat": f"x{i % 7 + k}", "title": f"t{i % 7 + k}"} if i % 5 else {"flat": None, "title": None} for i in range(40)]
    assert 7 < len([h for h in seen if h]) < 6 * 7


PAGES = ["<p>a</p><table><caption>c</caption><tr><td>1<td>2<tr><td><p>x</p><table><tr><td>in</td></tr></table></table><p> </p><p>z</p>", "<table></table>", "", None, "<p></p>", "<table><tr><td></td></tr></table>b", "<ul><li>1<li><table><tr><td>q</table></ul>"]


def test_flat_text_is_the_flat_projection(spark):
    from quire.operators import pages

    df = spark.createDataFrame(list(enumerate(PAGES)), "id long, html string")
    want = pages.flat_projection(pages.blocks(df, "id"), html.html_table(df, "cells", "id"), "id").collect()
    assert len(want) >= 3 and sorted(map(tuple, pages.flat_pages(df, "id").collect())) == sorted(map(tuple, want))


def test_decoding_joins_texts_at_once(monkeypatch):
    """Line ends are bytes in the model, and don't need the way for bytes that are part of a character."""
    queries = pytest.importorskip("quire.llm.queries")
    model = queries.load_model(queries.tokenizer_path())
    odd = "a͸b\U0001f9ff\n\x00é"
    assert model.decode(model.encode(odd)) == odd
    monkeypatch.setattr(type(model), "_with_bytes", None)
    assert model.decode(model.encode("one\ntwo\tthree ")) == "one\ntwo\tthree "
