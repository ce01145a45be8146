"""Small writers of binary formats: office packages, fonts, images, PDF and compound files, from rows.

What they write is complete enough for the readers of this library and for other readers of the formats;
styles beyond headings, lists and tables are left to the packages that documents come from.
"""

from __future__ import annotations

import html
import struct
import zlib
from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.sources.archive import build_archive
from quire.sources.binary import PNG, sfnt_sum

#: Names of the office formats.
_W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
_A = "http://schemas.openxmlformats.org/drawingml/2006/main"
_P = "http://schemas.openxmlformats.org/presentationml/2006/main"
_R = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_RELS = "http://schemas.openxmlformats.org/package/2006/relationships"
_TYPES = "http://schemas.openxmlformats.org/package/2006/content-types"
_CORE = "http://schemas.openxmlformats.org/package/2006/metadata/core-properties"
_WORD = "application/vnd.openxmlformats-officedocument.wordprocessingml."
_SLIDES = "application/vnd.openxmlformats-officedocument.presentationml."
_TABLE = "http://schemas.openxmlformats.org/drawingml/2006/table"


def _package(main: str, main_type: str, parts: list[tuple[str, str, str]], links: dict[str, list[tuple[str, str, str]]], core: dict[str, str] | None = None) -> bytes:
    """An archive of XML parts (name, content type, body) with the relationships (id, type, target) of each owner."""
    own = {"/": [("rId1", f"{_R}/officeDocument", main)]}
    if core:
        own["/"].append(("rId2", _CORE.replace("core-properties", "relationships/metadata/core-properties"), "docProps/core.xml"))
        fields = "".join(f"<{'cp' if k in ('keywords', 'lastModifiedBy', 'category', 'revision') else 'dcterms' if k in ('created', 'modified') else 'dc'}:{k}>{html.escape(v)}</{'cp' if k in ('keywords', 'lastModifiedBy', 'category', 'revision') else 'dcterms' if k in ('created', 'modified') else 'dc'}:{k}>" for k, v in core.items())
        parts = [*parts, ("docProps/core.xml", "application/vnd.openxmlformats-package.core-properties+xml", f'<cp:coreProperties xmlns:cp="{_CORE}" xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:dcterms="http://purl.org/dc/terms/">{fields}</cp:coreProperties>')]
    own |= links
    types = "".join(f'<Override PartName="/{n}" ContentType="{t}"/>' for n, t, _ in parts)
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    files = [("[Content_Types].xml", f'{head}<Types xmlns="{_TYPES}"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>{types}</Types>')]
    for owner, found in own.items():
        folder, _, name = owner.rpartition("/")
        path = "_rels/.rels" if owner == "/" else f"{folder}/_rels/{name}.rels"
        body = "".join(f'<Relationship Id="{i}" Type="{t}" Target="{html.escape(x)}"{" TargetMode=" + chr(34) + "External" + chr(34) if "://" in x else ""}/>' for i, t, x in found)
        files.append((path, f'{head}<Relationships xmlns="{_RELS}">{body}</Relationships>'))
    files += [(n, head + b) for n, _, b in parts]
    return build_archive([(n, b.encode("utf-8", "xmlcharrefreplace")) for n, b in files])


def _run(text: str, bold: bool = False) -> str:
    clean = "".join(c for c in text if c in "\t\n" or ord(c) >= 32)
    pieces = []
    for i, line in enumerate(clean.split("\n")):
        pieces += ["<w:br/>"] if i else []
        for j, part in enumerate(line.split("\t")):
            pieces += ["<w:tab/>"] if j else []
            pieces.append(f'<w:t xml:space="preserve">{html.escape(part, False)}</w:t>' if part else "")
    return f"<w:r>{'<w:rPr><w:b/></w:rPr>' if bold else ''}{''.join(pieces)}</w:r>"


def render_docx(rows: list[dict], core: dict[str, str] | None = None) -> bytes:
    """A document of blocks: ``text``, ``level`` (a heading's), ``list_level`` (a list item's), and ``cells`` (rows
    of texts: a table instead of a paragraph)."""
    body = []
    for r in rows:
        if r.get("cells") is not None:
            lines = "".join("<w:tr>" + "".join(f"<w:tc><w:p>{_run(c or '')}</w:p></w:tc>" for c in line) + "</w:tr>" for line in r["cells"])
            body.append(f"<w:tbl>{lines}</w:tbl>")
            continue
        own = f'<w:pStyle w:val="Heading{int(r["level"])}"/>' if r.get("level") else ""
        if r.get("list_level") is not None:
            own += f'<w:numPr><w:ilvl w:val="{int(r["list_level"])}"/><w:numId w:val="1"/></w:numPr>'
        body.append(f"<w:p>{f'<w:pPr>{own}</w:pPr>' if own else ''}{_run(r.get('text') or '')}</w:p>")
    headings = "".join(f'<w:style w:type="paragraph" w:styleId="Heading{i}"><w:name w:val="heading {i}"/><w:basedOn w:val="Normal"/><w:pPr><w:outlineLvl w:val="{i - 1}"/></w:pPr></w:style>' for i in range(1, 10))
    styles = f'<w:styles xmlns:w="{_W}"><w:style w:type="paragraph" w:default="1" w:styleId="Normal"><w:name w:val="Normal"/></w:style>{headings}</w:styles>'
    parts = [("word/document.xml", _WORD + "document.main+xml", f'<w:document xmlns:w="{_W}"><w:body>{"".join(body)}</w:body></w:document>'), ("word/styles.xml", _WORD + "styles+xml", styles)]
    return _package("word/document.xml", "", parts, {"word/document.xml": [("rId1", f"{_R}/styles", "styles.xml")]}, core)


def render_pptx(slides: list[list[dict]], core: dict[str, str] | None = None) -> bytes:
    """A presentation: each slide a list of shapes with ``text`` (lines are paragraphs), ``kind`` (a placeholder's) or ``cells``."""

    def paragraphs(text: str) -> str:
        return "".join(f"<a:p>{f'<a:r><a:t>{html.escape(x, False)}</a:t></a:r>' if x else ''}</a:p>" for x in "".join(c for c in text if c == "\n" or ord(c) >= 32).split("\n"))

    def shape(i: int, s: dict) -> str:
        if s.get("cells") is not None:
            rows = "".join("<a:tr>" + "".join(f"<a:tc><a:txBody>{paragraphs(c or '')}</a:txBody></a:tc>" for c in line) + "</a:tr>" for line in s["cells"])
            return f'<p:graphicFrame><p:nvGraphicFramePr><p:cNvPr id="{i + 2}" name="t{i}"/></p:nvGraphicFramePr><a:graphic><a:graphicData uri="{_TABLE}"><a:tbl>{rows}</a:tbl></a:graphicData></a:graphic></p:graphicFrame>'
        place = f'<p:ph type="{s["kind"]}"/>' if s.get("kind") else ""
        return f'<p:sp><p:nvSpPr><p:cNvPr id="{i + 2}" name="s{i}"/><p:nvPr>{place}</p:nvPr></p:nvSpPr><p:txBody>{paragraphs(s.get("text") or "")}</p:txBody></p:sp>'

    parts, links = [], []
    for i, slide in enumerate(slides):
        inner = "".join(shape(k, s) for k, s in enumerate(slide))
        parts.append((f"ppt/slides/slide{i + 1}.xml", _SLIDES + "slide+xml", f'<p:sld xmlns:p="{_P}" xmlns:a="{_A}"><p:cSld><p:spTree>{inner}</p:spTree></p:cSld></p:sld>'))
        links.append((f"rId{i + 1}", f"{_R}/slide", f"slides/slide{i + 1}.xml"))
    ids = "".join(f'<p:sldId id="{256 + i}" r:id="rId{i + 1}"/>' for i in range(len(slides)))
    main = ("ppt/presentation.xml", _SLIDES + "presentation.main+xml", f'<p:presentation xmlns:p="{_P}" xmlns:r="{_R}"><p:sldIdLst>{ids}</p:sldIdLst></p:presentation>')
    return _package("ppt/presentation.xml", "", [main, *parts], {"ppt/presentation.xml": links}, core)


def render_png(width: int, height: int, text: dict[str, str] | None = None, gamma: int | None = None) -> bytes:
    """A gray image with its size, gamma and no other content than zeros."""
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    out = PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0))
    if gamma is not None:
        out += chunk(b"gAMA", struct.pack(">I", gamma))
    for k, v in (text or {}).items():
        out += chunk(b"tEXt", k.encode("latin-1") + b"\0" + v.encode("latin-1", "replace"))
    return out + chunk(b"IDAT", zlib.compress(bytes((width + 1) * height))) + chunk(b"IEND", b"")


def render_font(family: str, first: int, last: int, units: int = 1000, ascender: int = 800) -> bytes:
    """A font file without outlines: a name, metrics, and a map from the code points ``first`` to ``last``."""
    head = struct.pack(">IIIIHH", 0x10000, 0, 0, 0x5F0F3CF5, 0, units) + bytes(34)
    cmap = struct.pack(">HHHHI", 0, 1, 3, 10, 12) + struct.pack(">HHIIIIII", 12, 0, 28, 0, 1, first, last, 1)
    raw = family.encode("utf-16-be")
    name = struct.pack(">HHH", 0, 1, 18) + struct.pack(">HHHHHH", 3, 1, 0x409, 1, len(raw), 0) + raw
    tables = {b"cmap": cmap, b"head": head, b"hhea": struct.pack(">Ihhh", 0x10000, ascender, -200, 90) + bytes(26), b"name": name}
    at, directory, body = 12 + 16 * len(tables), b"", b""
    for k, v in sorted(tables.items()):
        directory += struct.pack(">4sIII", k, sfnt_sum(v, k == b"head"), at + len(body), len(v))
        body += v + b"\0" * (-len(v) % 4)
    return b"\0\1\0\0" + struct.pack(">HHHH", len(tables), 0, 0, 0) + directory + body


def render_pdf(info: dict[str, str], pages: int, xmp: str | None = None) -> bytes:
    """A PDF file of empty pages with a document information dictionary, a metadata stream and a cross-reference table."""
    text = lambda v: "<" + ("﻿" + v).encode("utf-16-be").hex().upper() + ">"
    objects = [
        f"<</Type /Catalog /Pages 2 0 R{' /Metadata 4 0 R' if xmp else ''}>>",
        f"<</Type /Pages /Kids [{' '.join(f'{5 + i} 0 R' for i in range(pages))}] /Count {pages}>>",
        "<<" + " ".join(f"/{k} {text(v)}" for k, v in info.items()) + ">>",
    ]
    raw = (xmp or "").encode()
    bodies = [o.encode() for o in objects] + [f"<</Type /Metadata /Subtype /XML /Length {len(raw)}>>\nstream\n".encode() + raw + b"\nendstream"]
    bodies += [b"<</Type /Page /Parent 2 0 R /MediaBox [0 0 300 400]>>"] * pages
    out, places = bytearray(b"%PDF-1.7\n"), []
    for i, b in enumerate(bodies):
        places.append(len(out))
        out += f"{i + 1} 0 obj\n".encode() + b + b"\nendobj\n"
    at = len(out)
    out += f"xref\n0 {len(bodies) + 1}\n0000000000 65535 f \n".encode() + b"".join(f"{p:010d} 00000 n \n".encode() for p in places)
    return bytes(out + f"trailer\n<</Size {len(bodies) + 1} /Root 1 0 R /Info 3 0 R>>\nstartxref\n{at}\n%%EOF\n".encode())


def render_cfbf(streams: list[tuple[str, bytes]]) -> bytes:
    """A compound file (version 3, 512-byte sectors) with streams below its root; each is padded to 4,096 bytes
    or more, so that no mini stream is needed."""
    free, end, size = 0xFFFFFFFF, 0xFFFFFFFE, 512
    blobs = [b + bytes(max(0, 4096 - len(b))) for _, b in streams]
    entries = -(-(len(streams) + 1) // 4)
    spans = [-(-len(b) // size) for b in blobs]
    total = entries + sum(spans)
    tables = 1
    while tables * 128 < total + tables:
        tables += 1
    if tables > 109:
        raise ValueError("too large for one header")
    chain = [0xFFFFFFFD] * tables
    starts, at = [], tables
    for n in [entries, *spans]:
        starts.append(at)
        chain += [*range(at + 1, at + n), end]
        at += n
    chain += [free] * (tables * 128 - len(chain))
    header = bytes.fromhex("D0CF11E0A1B11AE1") + bytes(16) + struct.pack("<HHHHH", 62, 3, 0xFFFE, 9, 6) + bytes(6)
    header += struct.pack("<IIIIIIIII", 0, tables, starts[0], 0, 4096, end, 0, end, 0)
    header += struct.pack("<109I", *range(tables), *[free] * (109 - tables))

    def entry(name: str, kind: int, right: int, child: int, start: int, length: int) -> bytes:
        raw = (name + "\0").encode("utf-16-le")
        return raw.ljust(64, b"\0") + struct.pack("<HBBIII", len(raw), kind, 1, free, right, child) + bytes(36) + struct.pack("<IQ", start, length)

    # siblings hang on each other's right side, in the order of the format: shorter names first, then upper case
    order = sorted(range(len(streams)), key=lambda i: (len(streams[i][0]), streams[i][0].upper()))
    rows = [entry("Root Entry", 5, free, 1 if streams else free, end, 0)]
    for place, i in enumerate(order):
        rows.append(entry(streams[i][0], 2, place + 2 if place + 1 < len(order) else free, free, starts[1 + i], len(blobs[i])))
    rows += [bytes(68) + struct.pack("<III", free, free, free) + bytes(48)] * (entries * 4 - len(rows))
    return header + struct.pack(f"<{len(chain)}I", *chain) + b"".join(rows) + b"".join(b + bytes(-len(b) % size) for b in blobs)


def binary_kernel(f: Callable[..., bytes], *columns: Column) -> Column:
    """Bytes made of a row's columns, in Arrow batches; a null in any gives null."""

    def run(*arrays: pa.Array) -> pa.Array:
        rows = zip(*(a.to_pylist() for a in arrays), strict=True)
        return pa.array([None if any(v is None for v in r) else f(*r) for r in rows], pa.binary())

    return F.arrow_udf(run, "binary")(*columns)


def _grouped(blocks: DataFrame, row_id: str, render: Callable[[list[dict]], bytes]) -> DataFrame:
    kind = blocks.schema[row_id].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [{k: None if v is None or (isinstance(v, float) and v != v) else v for k, v in r.items()} for r in pdf.sort_values("pos").to_dict("records")]
        return pd.DataFrame({row_id: pdf[row_id].iloc[:1].to_list(), "content": [render(rows)]})

    return blocks.groupBy(row_id).applyInPandas(run, f"`{row_id}` {kind}, content binary")


def to_docx(blocks: DataFrame, row_id: str) -> DataFrame:
    """(row_id, content) from blocks (pos, text, level, list_level, cells array<array<string>>): one document a group."""
    return _grouped(blocks, row_id, lambda rows: render_docx([r | {"cells": None if r.get("cells") is None else [list(x) for x in r["cells"]]} for r in rows]))


def to_pptx(shapes: DataFrame, row_id: str) -> DataFrame:
    """(row_id, content) from shapes (slide, pos, text, kind, cells): slides in the order of their numbers."""

    def render(rows: list[dict]) -> bytes:
        slides: dict[int, list[dict]] = {}
        for r in rows:
            slides.setdefault(r["slide"], []).append(r | {"cells": None if r.get("cells") is None else [list(x) for x in r["cells"]]})
        return render_pptx([slides[k] for k in sorted(slides)])

    return _grouped(shapes, row_id, render)
