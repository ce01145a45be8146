"""DOCX and PPTX packages by the standard library: flat texts, paragraphs, cells, relationships, properties, patches."""

from __future__ import annotations

import posixpath
import re
import xml.etree.ElementTree as ET
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.sources.archive import build_archive, members, resolve_target

#: Namespaces and relationship types.
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
REL = "{http://schemas.openxmlformats.org/package/2006/relationships}"
CT = "{http://schemas.openxmlformats.org/package/2006/content-types}"
XML_SPACE = "{http://www.w3.org/XML/1998/namespace}space"
MAIN = "http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument"
CORE_FIELDS = ("title", "creator", "subject", "description", "keywords", "language", "created", "modified", "lastModifiedBy", "category", "revision")


def parse_xml(data: bytes) -> ET.Element:
    """Documents with a type declaration are refused: they could name entities."""
    if b"<!DOCTYPE" in data[:4096] or b"<!ENTITY" in data:
        raise ValueError("declared-entities")
    try:
        return ET.fromstring(data)
    except ET.ParseError as e:
        raise ValueError("bad-xml") from e


class Package:
    def __init__(self, data: bytes):
        self.parts = {"/" + n.lstrip("/"): b for n, b in members(data).items()}
        types = parse_xml(self.parts.get("/[Content_Types].xml", b"<Types/>"))
        self.defaults = {e.get("Extension", "").lower(): e.get("ContentType") for e in types.iter(CT + "Default")}
        self.overrides = {e.get("PartName"): e.get("ContentType") for e in types.iter(CT + "Override")}

    def content_type(self, name: str) -> str | None:
        return self.overrides.get(name) or self.defaults.get(name.rpartition(".")[2].lower())

    def relations(self, owner: str) -> list[dict]:
        folder, name = posixpath.split(owner)
        data = self.parts.get("/_rels/.rels" if owner == "/" else f"{folder.rstrip('/')}/_rels/{name}.rels")
        if data is None:
            return []
        out = []
        for e in parse_xml(data).iter(REL + "Relationship"):
            mode, target = e.get("TargetMode", "Internal"), e.get("Target", "")
            if mode == "Internal":
                try:
                    target = resolve_target(owner, target)
                except ValueError:
                    mode = "Invalid"
            out.append({"owner": owner, "id": e.get("Id"), "type": e.get("Type"), "target": target, "mode": mode})
        return out

    def all_relations(self) -> list[dict]:
        return [r for o in ["/", *sorted(p for p in self.parts if not p.endswith(".rels"))] for r in self.relations(o)]

    def main(self) -> str:
        found = [r["target"] for r in self.relations("/") if r["type"] == MAIN and r["mode"] == "Internal"]
        if len(found) != 1 or found[0] not in self.parts:
            raise ValueError("no-main-part")
        return found[0]


def run_text(run: ET.Element) -> str:
    """Text, tabs, breaks and hyphens of a run; white space at the ends of a text stays only if it says so."""
    out = []
    for e in run:
        if e.tag == W + "t":
            t = re.sub("[\r\n\t]", " ", e.text or "")
            out.append(re.sub("[\r\n]", " ", e.text or "") if e.get(XML_SPACE) == "preserve" else t.strip(" "))
        elif e.tag == W + "tab":
            out.append("\t")
        elif e.tag in (W + "br", W + "cr"):
            out.append("\n")
        elif e.tag == W + "noBreakHyphen":
            out.append("‑")
    return "".join(out)


def paragraph_text(p: ET.Element) -> str:
    return "".join(run_text(r) for r in p.iter(W + "r"))


def _span(cell: ET.Element) -> int:
    v = cell.find(f"{W}tcPr/{W}gridSpan")
    return max(1, int(v.get(W + "val", "1"))) if v is not None else 1


def docx_rows(table: ET.Element) -> list[list[str]]:
    """Rows of a table on its grid: a cell over n columns n times, a continued cell with the text above."""
    out: list[list[str]] = []
    for row in table.findall(W + "tr"):
        line: list[str] = []
        for cell in row.findall(W + "tc"):
            merge = cell.find(f"{W}tcPr/{W}vMerge")
            go_on = merge is not None and merge.get(W + "val", "continue") == "continue"
            above = out[-1][len(line)] if go_on and out and len(line) < len(out[-1]) else None
            text = above if above is not None else "\n".join(paragraph_text(p) for p in cell.findall(W + "p"))
            line += [text] * _span(cell)
        out.append(line)
    return out


def docx_flat(data: bytes, include_tables: bool = True) -> dict:
    """{paragraphs, tables, plain}: body paragraphs in order, empty ones too, then the tables' rows."""
    package = Package(data)
    body = parse_xml(package.parts[package.main()]).find(W + "body")
    if body is None:
        raise ValueError("no-body")
    texts = [paragraph_text(p) for p in body.findall(W + "p")]
    tables = [docx_rows(t) for t in body.findall(W + "tbl")] if include_tables else []
    plain = "\n".join([*texts, *(" | ".join(r) for t in tables for r in t)])
    return {"paragraphs": texts, "tables": tables, "plain": plain}


def docx_paragraphs(data: bytes) -> list[dict]:
    """Every paragraph of the body's part, in tables too, with its style and runs' formats."""
    package = Package(data)
    part = package.main()
    out = []
    for i, p in enumerate(parse_xml(package.parts[part]).iter(W + "p")):
        style, level = p.find(f"{W}pPr/{W}pStyle"), p.find(f"{W}pPr/{W}numPr/{W}ilvl")
        runs = [r for r in p.iter(W + "r") if run_text(r)]
        flag = lambda r, name: (e := r.find(f"{W}rPr/{W}{name}")) is not None and e.get(W + "val", "true") not in ("0", "false", "none")
        out.append({"id": f"{part}:{i}", "text": paragraph_text(p), "style": style.get(W + "val") if style is not None else None, "list_level": int(level.get(W + "val", "0")) if level is not None else None, "bold": bool(runs) and all(flag(r, "b") for r in runs), "italic": bool(runs) and all(flag(r, "i") for r in runs)})
    return out


def docx_patch(data: bytes, patches: list[dict]) -> bytes:
    """The package with spans of paragraphs replaced: {id, start, end, text}, offsets into the original text;
    a patch without start replaces the whole. Unknown ids, overlaps, a whole and a span of one paragraph,
    paragraphs with other content than plain runs, and signed packages are ValueErrors."""
    package = Package(data)
    part = package.main()
    if any("digital-signature" in (r["type"] or "") for r in package.relations("/")):
        raise ValueError("signed")
    root = parse_xml(package.parts[part])
    known = {f"{part}:{i}": p for i, p in enumerate(root.iter(W + "p"))}
    by: dict[str, list[dict]] = {}
    for x in patches:
        if x["id"] not in known:
            raise ValueError("unknown-id")
        by.setdefault(x["id"], []).append(x)
    for ident, own in by.items():
        p = known[ident]
        text = paragraph_text(p)
        if len(own) > 1 and any(x.get("start") is None for x in own):
            raise ValueError("whole-and-span")
        if any(e.tag not in (W + "pPr", W + "r") for e in p) or any(e.tag not in (W + "rPr", W + "t") for r in p.findall(W + "r") for e in r):
            raise ValueError("unsafe-paragraph")
        own = sorted(own, key=lambda x: (x.get("start") or 0, len(text) if x.get("end") is None else x["end"]))
        end, last_empty = -1, False
        for x in own:
            a, b = x.get("start") or 0, len(text) if x.get("end") is None else x["end"]
            if not 0 <= a <= b <= len(text):
                raise ValueError("bad-span")
            if a < end or (a == end and (a == b or last_empty)):
                raise ValueError("overlap")
            end, last_empty = b, a == b
        for x in reversed(own):
            a, b = x.get("start") or 0, len(text) if x.get("end") is None else x["end"]
            text = text[:a] + x["text"] + text[b:]
        first = p.find(W + "r")
        for r in p.findall(W + "r"):
            if r is not first:
                p.remove(r)
        if first is None:
            first = ET.SubElement(p, W + "r")
        for t in first.findall(W + "t"):
            first.remove(t)
        t = ET.SubElement(first, W + "t", {XML_SPACE: "preserve"})
        t.text = text
    parts = {n: (ET.tostring(root, "utf-8", xml_declaration=True) if n == part else b) for n, b in package.parts.items()}
    out = build_archive([(n.lstrip("/"), b) for n, b in parts.items()])
    Package(out).main()
    return out


def pptx_flat(data: bytes, include_tables: bool = True) -> dict:
    """{slides, plain}: texts of each slide's own shapes (not those in groups) and tables in the presentation's order,
    without white space at their ends; a line break is a vertical tab, as the format's flat texts have it. A slide
    that is named twice, isn't there or has no shape tree is a ValueError."""
    package = Package(data)
    main = package.main()
    targets = {r["id"]: r["target"] for r in package.relations(main) if r["mode"] == "Internal"}
    order = [targets.get(e.get(R + "id")) for e in parse_xml(package.parts[main]).iter(P + "sldId")]
    if len(set(order)) != len(order) or any(o not in package.parts for o in order):
        raise ValueError("bad-slides")
    slides = []
    for name in order:
        tree = parse_xml(package.parts[name]).find(f"{P}cSld/{P}spTree")
        if tree is None:
            raise ValueError("no-shape-tree")
        lines = []
        for e in tree:
            if e.tag == P + "sp" and (body := e.find(P + "txBody")) is not None:
                lines.append(_body_text(body).strip())
            elif e.tag == P + "graphicFrame" and include_tables and (table := e.find(f"{A}graphic/{A}graphicData/{A}tbl")) is not None:
                lines += [" | ".join(_body_text(c.find(A + "txBody")) for c in row.findall(A + "tc")) for row in table.findall(A + "tr")]
        slides.append("\n".join(x for x in lines if x))
    return {"slides": slides, "plain": "\n".join(s for s in slides if s)}


def _body_text(body: ET.Element | None) -> str:
    return "\n".join(_drawing_text(p, "\v") for p in body.findall(A + "p")) if body is not None else ""


def _drawing_text(p: ET.Element, break_: str = "\n") -> str:
    out = []
    for e in p:
        if e.tag in (A + "r", A + "fld"):
            out.append("".join(t.text or "" for t in e.iter(A + "t")))
        elif e.tag == A + "br":
            out.append(break_)
    return "".join(out)


def core_properties(data: bytes) -> dict[str, str]:
    """docProps/core.xml alone; dates stay texts."""
    package = Package(data)
    found = package.parts.get("/docProps/core.xml")
    if found is None:
        return {}
    values = {e.tag.rpartition("}")[2]: (e.text or "").strip() for e in parse_xml(found)}
    return {k: values[k] for k in CORE_FIELDS if values.get(k)}


def _udf(f: Callable[[bytes], object], kind: pa.DataType, ddl: str, empty: Callable[[str], object]):
    """A kernel over content where a bad file is a value, not a failure."""

    def run(rows: pa.Array) -> pa.Array:
        out = []
        for b in rows.to_pylist():
            try:
                out.append(None if b is None else f(b))
            except (ValueError, KeyError) as e:
                out.append(empty(str(e) if isinstance(e, ValueError) else "missing-part"))
        return pa.array(out, kind)

    return F.arrow_udf(run, ddl)


_FLAT = pa.struct([("plain", pa.string()), ("paragraphs", pa.list_(pa.string())), ("tables", pa.list_(pa.list_(pa.list_(pa.string())))), ("fault", pa.string())])


def read_docx(content: Column, include_tables: bool = True) -> Column:
    """struct(plain, paragraphs, tables, fault)."""
    return _udf(lambda b: docx_flat(b, include_tables) | {"fault": None}, _FLAT, "struct<plain: string, paragraphs: array<string>, tables: array<array<array<string>>>, fault: string>", lambda e: {"fault": e})(content)


def read_pptx(content: Column, include_tables: bool = True) -> Column:
    """struct(plain, slides, fault)."""
    kind = pa.struct([("plain", pa.string()), ("slides", pa.list_(pa.string())), ("fault", pa.string())])
    return _udf(lambda b: pptx_flat(b, include_tables) | {"fault": None}, kind, "struct<plain: string, slides: array<string>, fault: string>", lambda e: {"fault": e})(content)


def read_core_properties(content: Column) -> Column:
    return _udf(lambda b: list(core_properties(b).items()), pa.map_(pa.string(), pa.string()), "map<string, string>", lambda e: None)(content)


def package_tables(docs: DataFrame, row_id: str, content: str = "content") -> tuple[DataFrame, DataFrame]:
    """(parts(row_id, name, content_type, sha256, size), relationships(row_id, owner, id, type, target, mode))."""
    import hashlib

    part = pa.struct([("name", pa.string()), ("content_type", pa.string()), ("sha256", pa.string()), ("size", pa.int64())])
    rel = pa.struct([(c, pa.string()) for c in ("owner", "id", "type", "target", "mode")])

    def both(b: bytes) -> dict:
        p = Package(b)
        return {"parts": [{"name": n, "content_type": p.content_type(n), "sha256": hashlib.sha256(c).hexdigest(), "size": len(c)} for n, c in p.parts.items()], "relations": p.all_relations()}

    ddl = "struct<parts: array<struct<name: string, content_type: string, sha256: string, size: bigint>>, relations: array<struct<owner: string, id: string, type: string, target: string, mode: string>>>"
    found = docs.select(row_id, _udf(both, pa.struct([("parts", pa.list_(part)), ("relations", pa.list_(rel))]), ddl, lambda e: None)(F.col(content)).alias("_t"))
    return tuple(found.select(row_id, F.explode(f"_t.{c}").alias("_x")).select(row_id, "_x.*") for c in ("parts", "relations"))


def docx_paragraph_table(docs: DataFrame, row_id: str, content: str = "content") -> DataFrame:
    """(row_id, id, text, style, list_level, bold, italic) of every paragraph."""
    kind = pa.list_(pa.struct([("id", pa.string()), ("text", pa.string()), ("style", pa.string()), ("list_level", pa.int32()), ("bold", pa.bool_()), ("italic", pa.bool_())]))
    found = _udf(docx_paragraphs, kind, "array<struct<id: string, text: string, style: string, list_level: int, bold: boolean, italic: boolean>>", lambda e: None)(F.col(content))
    return docs.select(row_id, F.explode(found).alias("_p")).select(row_id, "_p.*")


def patch_docx(docs: DataFrame, patches: DataFrame, row_id: str, content: str = "content") -> DataFrame:
    """(row_id, content, fault) with each document's patches (row_id, id, start, end, text) applied, all or none."""
    own = patches.groupBy(row_id).agg(F.collect_list(F.struct("id", "start", "end", "text")).alias("_p"))
    kind = pa.struct([("content", pa.binary()), ("fault", pa.string())])

    def run(rows: pa.Array, changes: pa.Array) -> pa.Array:
        out = []
        for b, ps in zip(rows.to_pylist(), changes.to_pylist(), strict=True):
            try:
                out.append({"content": docx_patch(b, ps) if ps else b, "fault": None})
            except (ValueError, KeyError) as e:
                out.append({"content": None, "fault": str(e)})
        return pa.array(out, kind)

    found = F.arrow_udf(run, "struct<content: binary, fault: string>")(F.col(content), F.col("_p"))
    return docs.join(own, row_id, "left").select(row_id, found.alias("_f")).select(row_id, "_f.*")
