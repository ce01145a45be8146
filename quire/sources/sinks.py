"""Sinks: documents as text, HTML, LaTeX, JSON and EPUB, rendered from block rows and published as a whole."""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.text import escape_latex
from quire.sources.archive import build_archive

#: Fixed value: the command of a heading level by document class.
LATEX_LEVELS = {"article": {1: "section", 2: "subsection", 3: "subsubsection", 4: "paragraph", 5: "subparagraph", 6: "subparagraph"}, "book": {1: "chapter", 2: "section", 3: "subsection", 4: "subsubsection", 5: "paragraph", 6: "subparagraph"}}


def to_text(blocks: DataFrame, row_id: str, newline: str = "\n", bom: bool = False) -> DataFrame:
    """(row_id, content): all paragraphs in order, a line each, as UTF-8."""
    lines = F.sort_array(F.collect_list(F.struct("pos", "text")))
    text = F.array_join(F.transform(lines, lambda s: s["text"]), newline)
    text = F.concat(F.lit("\ufeff"), text) if bom else text
    return blocks.groupBy(row_id).agg(F.encode(text, "UTF-8").alias("content"))


def to_json(blocks: DataFrame, row_id: str) -> DataFrame:
    """(row_id, content): one canonical JSON object with the blocks in order; null fields are left out."""
    rest = [c for c in blocks.columns if c != row_id]
    rows = F.sort_array(F.collect_list(F.struct("pos", *[c for c in rest if c != "pos"])))
    return blocks.groupBy(row_id).agg(F.encode(F.to_json(F.struct(rows.alias("blocks"))), "UTF-8").alias("content"))


def from_json(rendered: DataFrame, row_id: str, kind: str = "pos int, text string, level int, list_level int, lang string") -> DataFrame:
    """(row_id, the fields of ``kind``) of the blocks in canonical JSON; a field that is left out is null. What
    isn't such an object gives no rows."""
    found = F.from_json(F.decode("content", "UTF-8"), f"blocks array<struct<{kind}>>")
    return rendered.select(row_id, F.inline(found["blocks"]))


def render_lists(rows: list[dict]) -> str:
    """Flat paragraphs to nested lists, by an explicit stack of open levels."""
    out, open_tags = [], []
    for r in rows:
        depth = -1 if r.get("list_level") is None else r["list_level"]
        tag = "ol" if r.get("list_kind") == "enumerate" else "ul"
        while len(open_tags) > depth + 1 or (depth >= 0 and len(open_tags) == depth + 1 and open_tags[-1] != tag):
            out.append(f"</li></{open_tags.pop()}>")
        if depth >= 0 and len(open_tags) == depth + 1:
            out.append("</li>")
        while len(open_tags) < depth + 1:
            open_tags.append(tag)
            out.append(f"<{tag}>" + ("<li>" if len(open_tags) < depth + 1 else ""))
        text = html.escape(r["text"]).replace("\n", "<br>")
        level = r.get("level") or 0
        body = f"<h{level}>{text}</h{level}>" if 0 < level <= 6 else f"<p>{text}</p>"
        out.append(f"<li>{body}" if depth >= 0 else body)
    out += [f"</li></{t}>" for t in reversed(open_tags)]
    return "".join(out)


def render_html(rows: list[dict], title: str = "", lang: str | None = None) -> str:
    head = f'<!DOCTYPE html><html{f" lang={chr(34)}{html.escape(lang)}{chr(34)}" if lang else ""}><head><meta charset="utf-8"><title>{html.escape(title)}</title></head><body>'
    return head + render_lists(rows) + "</body></html>"


def _records(pdf: pd.DataFrame) -> list[dict]:
    rows = pdf.sort_values("pos").to_dict("records")
    return [{k: None if v is None or (isinstance(v, float) and v != v) else v for k, v in r.items()} for r in rows]


def to_html(blocks: DataFrame, row_id: str) -> DataFrame:
    """(row_id, content): self-contained pages. A document is one group: nesting is a state of its blocks."""
    kind = blocks.schema[row_id].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = _records(pdf)
        for r in rows:
            r["list_level"] = None if r.get("list_level") is None else int(r["list_level"])
            r["level"] = int(r.get("level") or 0)
        title = next((r["text"] for r in rows if r["level"] == 1), "")
        return pd.DataFrame({row_id: pdf[row_id].iloc[:1].to_list(), "content": [render_html(rows, title, next((r.get("lang") for r in rows if r.get("lang")), None)).encode()]})

    return blocks.groupBy(row_id).applyInPandas(run, f"`{row_id}` {kind}, content binary")


def latex_line(text: Column, level: Column, cls: str = "article") -> Column:
    """A block as LaTeX: a heading's command or the escaped text."""
    names = F.create_map(*[x for k, v in LATEX_LEVELS[cls].items() for x in (F.lit(k), F.lit(v))])
    body = escape_latex(text)
    return F.when(level > 0, F.concat(F.lit("\\"), F.try_element_at(names, level), F.lit("{"), body, F.lit("}"))).otherwise(body)


def to_latex(blocks: DataFrame, row_id: str, cls: str = "article") -> DataFrame:
    """(row_id, content): a document with its blocks; runs of list items (``list_level``) become itemize
    environments, found as islands of consecutive rows."""
    from quire.operators.charts import runs_of

    b = runs_of(blocks.withColumn("_l", F.col("list_level").isNotNull()), [row_id], ["pos"], ["_l"])
    line = F.when(F.col("_l"), F.concat(F.lit("\\item "), escape_latex(F.col("text")))).otherwise(latex_line(F.col("text"), F.col("level"), cls))
    parts = b.select(row_id, "run", "_l", "pos", line.alias("_t")).groupBy(row_id, "run", "_l").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "_t"))), lambda s: s["_t"]), "\n").alias("_b"))
    wrapped = F.when(F.col("_l"), F.concat(F.lit("\\begin{itemize}\n"), "_b", F.lit("\n\\end{itemize}"))).otherwise(F.replace("_b", F.lit("\n"), F.lit("\n\n")))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("run", wrapped.alias("_w")))), lambda s: s["_w"]), "\n\n")
    text = F.concat(F.lit(f"\\documentclass{{{cls}}}\n\\usepackage[utf8]{{inputenc}}\n\\begin{{document}}\n\n"), body, F.lit("\n\n\\end{document}\n"))
    return parts.groupBy(row_id).agg(F.encode(text, "UTF-8").alias("content"))


_CONTAINER = '<?xml version="1.0"?><container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="content.opf" media-type="application/oebps-package+xml"/></rootfiles></container>'


def render_epub(rows: list[dict], identifier: str, title: str, lang: str = "und") -> bytes:
    """An EPUB 3 archive: the type first and stored, one chapter per level-1 heading, a navigation document."""
    chapters: list[tuple[str, list[dict]]] = []
    for r in rows:
        if r.get("level") == 1 or not chapters:
            chapters.append((r["text"] if r.get("level") == 1 else title, []))
        chapters[-1][1].append(r)
    page = lambda name, body: f'<?xml version="1.0" encoding="utf-8"?><html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops"><head><title>{html.escape(name)}</title></head><body>{body}</body></html>'
    files = [("mimetype", b"application/epub+zip"), ("META-INF/container.xml", _CONTAINER.encode())]
    items = "".join(f'<item id="c{i}" href="c{i}.xhtml" media-type="application/xhtml+xml"/>' for i in range(len(chapters)))
    refs = "".join(f'<itemref idref="c{i}"/>' for i in range(len(chapters)))
    files.append(("content.opf", f'<?xml version="1.0"?><package xmlns="http://www.idpf.org/2007/opf" version="3.0" unique-identifier="id"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:identifier id="id">{html.escape(identifier)}</dc:identifier><dc:title>{html.escape(title)}</dc:title><dc:language>{html.escape(lang)}</dc:language></metadata><manifest><item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/>{items}</manifest><spine>{refs}</spine></package>'.encode()))
    nav = "".join(f'<li><a href="c{i}.xhtml">{html.escape(name)}</a></li>' for i, (name, _) in enumerate(chapters))
    files.append(("nav.xhtml", page(title, f'<nav epub:type="toc"><ol>{nav}</ol></nav>').encode()))
    files += [(f"c{i}.xhtml", page(name, render_lists(own).replace("<br>", "<br/>")).encode()) for i, (name, own) in enumerate(chapters)]
    return build_archive(files, stored=("mimetype",))


def to_epub(blocks: DataFrame, row_id: str) -> DataFrame:
    """(row_id, content): one archive a document."""
    kind = blocks.schema[row_id].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = _records(pdf)
        for r in rows:
            r["level"] = int(r.get("level") or 0)
            r["list_level"] = None if r.get("list_level") is None else int(r["list_level"])
        ident = str(pdf[row_id].iloc[0])
        title = next((r["text"] for r in rows if r["level"] == 1), ident)
        return pd.DataFrame({row_id: pdf[row_id].iloc[:1].to_list(), "content": [render_epub(rows, ident, title, next((r.get("lang") for r in rows if r.get("lang")), None) or "und")]})

    return blocks.groupBy(row_id).applyInPandas(run, f"`{row_id}` {kind}, content binary")


def publish(spark: SparkSession, rendered: DataFrame, path: str, checked: DataFrame | None = None) -> str:
    """Write rendered documents next to ``path`` and move them there at once; what was there is replaced.

    With ``checked`` (row_id, fault), nothing is published if there is a fault. The move is the file
    system's rename, so readers see the old table or the new one."""
    if checked is not None and not checked.where("fault IS NOT NULL").isEmpty():
        raise ValueError("some documents failed their checks; nothing was published")
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    stage, old = (jvm.org.apache.hadoop.fs.Path(re.sub(r"/*$", "", path) + x) for x in (".staged", ".replaced"))
    fs = target.getFileSystem(conf)
    rendered.write.mode("overwrite").parquet(stage.toString())
    fs.delete(old, True)
    if fs.exists(target) and not fs.rename(target, old):
        raise OSError(f"can't replace {path}")
    if not fs.rename(stage, target):
        fs.rename(old, target)
        raise OSError(f"can't publish {path}")
    fs.delete(old, True)
    return path


def verify_html(rendered: DataFrame, row_id: str, blocks: DataFrame) -> DataFrame:
    """(row_id, fault): pages are read again; every text must come back, as often as it went in."""
    from quire.operators.dedup import consume_as_multiset
    from quire.sources.html import html_table

    back = html_table(rendered.withColumn("html", F.decode("content", "UTF-8")), "blocks", row_id)
    squeezed = lambda df: df.select(row_id, "pos", F.trim(F.regexp_replace("text", r"\s+", " ")).alias("t")).where("t <> ''")
    met = consume_as_multiset(squeezed(blocks), squeezed(back), [row_id, "t"], ["pos"])
    lost = met.where("NOT matched").groupBy(row_id).agg(F.count("*").alias("_n"))
    return rendered.select(row_id).join(lost, row_id, "left").select(row_id, F.when(F.col("_n").isNotNull(), F.concat("_n", F.lit(" texts are missing"))).alias("fault"))
