"""EPUB packages: manifest, spine, titles, Dublin Core, chapters as blocks, font obfuscation."""

from __future__ import annotations

import hashlib
import posixpath
import re
import urllib.parse

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.sources.archive import members
from quire.sources.html import Reader
from quire.sources.office import parse_xml

#: Fixed values.
OPF = "{http://www.idpf.org/2007/opf}"
DC = "{http://purl.org/dc/elements/1.1/}"
NCX = "{http://www.daisy.org/z3986/2005/ncx/}"
XHTML = "{http://www.w3.org/1999/xhtml}"
EPUB_TYPE = "{http://www.idpf.org/2007/ops}type"
CONTAINER = "{urn:oasis:names:tc:opendocument:xmlns:container}"
DC_FIELDS = ("title", "creator", "subject", "description", "publisher", "contributor", "date", "type", "format", "identifier", "source", "language", "relation", "coverage", "rights")
OBFUSCATED_BYTES = 1040


def local_path(base: str, href: str) -> str:
    """A name within the archive; ValueError for what is elsewhere."""
    url = urllib.parse.urlsplit(href)
    if url.scheme or url.netloc:
        raise ValueError("external")
    path = posixpath.normpath(posixpath.join(posixpath.dirname(base), urllib.parse.unquote(url.path)))
    if path.startswith(("../", "/")) or path == "..":
        raise ValueError("outside")
    return path


class Epub:
    def __init__(self, data: bytes):
        self.files = members(data)
        roots = [e.get("full-path") for e in parse_xml(self._get("META-INF/container.xml")).iter(CONTAINER + "rootfile")]
        if not roots:
            raise ValueError("no-rootfile")
        self.opf = roots[0]
        self.root = parse_xml(self._get(self.opf))

    def _get(self, name: str) -> bytes:
        if name not in self.files:
            raise ValueError("missing-part")
        return self.files[name]

    def metadata(self) -> dict[str, list[str]]:
        out: dict[str, list[str]] = {}
        for e in self.root.iter():
            if e.tag.startswith(DC) and (name := e.tag[len(DC) :]) in DC_FIELDS and (e.text or "").strip():
                out.setdefault(name, []).append(e.text.strip())
        return out

    def manifest(self) -> list[dict]:
        items, seen = [], set()
        for e in self.root.iter(OPF + "item"):
            ident, href = e.get("id"), e.get("href") or ""
            if ident in seen:
                raise ValueError("duplicate-id")
            seen.add(ident)
            try:
                path, status = local_path(self.opf, href), "local"
            except ValueError as x:
                path, status = href, f"{x}-unassessed"
            if status == "local" and path not in self.files:
                status = "missing"
            items.append({"id": ident, "path": path, "media_type": e.get("media-type"), "properties": e.get("properties") or "", "status": status})
        return items

    def spine(self) -> list[dict]:
        """Items in reading order with titles; a navigation document's titles win over those of an NCX."""
        items = {i["id"]: i for i in self.manifest()}
        titles = self._titles(items)
        out = []
        for n, e in enumerate(self.root.iter(OPF + "itemref")):
            item = items.get(e.get("idref"))
            if item is None:
                raise ValueError("unknown-idref")
            out.append({"pos": n, "linear": e.get("linear", "yes") != "no", "title": titles.get(item["path"]), **item})
        return out

    def _titles(self, items: dict[str, dict]) -> dict[str, str]:
        out: dict[str, str] = {}
        for item in sorted(items.values(), key=lambda i: "nav" in i["properties"].split()):
            if item["status"] != "local":
                continue
            if item["media_type"] == "application/x-dtbncx+xml":
                points = [(p.findtext(f"{NCX}navLabel/{NCX}text"), p.find(NCX + "content")) for p in parse_xml(self._get(item["path"])).iter(NCX + "navPoint")]
                found = [(t, c.get("src")) for t, c in points if c is not None]
            elif "nav" in item["properties"].split():
                navs = [n for n in parse_xml(self._get(item["path"])).iter(XHTML + "nav") if n.get(EPUB_TYPE) in (None, "toc")]
                found = [("".join(a.itertext()), a.get("href")) for n in navs[:1] for a in n.iter(XHTML + "a")]
            else:
                continue
            own: dict[str, str] = {}
            for text, href in found:
                if text and href:
                    own.setdefault(local_path(item["path"], href), re.sub(r"\s+", " ", text).strip())
            out |= own
        return out

    def chapters(self, nonlinear: bool = False) -> tuple[list[dict], list[str]]:
        """(blocks with their chapter's place and title, losses)."""
        blocks, lost = [], []
        for s in self.spine():
            if not s["linear"] and not nonlinear:
                lost.append(f"non-linear item {s['id']}")
            elif s["media_type"] != "application/xhtml+xml" or "nav" in s["properties"].split() or s["status"] != "local":
                lost.append(f"item {s['id']} is no chapter")
            else:
                reader = Reader(self._get(s["path"]).decode("utf-8", "replace"))
                blocks += [{"chapter": s["pos"], "title": s["title"], "pos": b["pos"], "tag": b["tag"], "level": b["level"], "text": b["text"]} for b in reader.blocks]
        return blocks, lost

    def font_key(self) -> bytes | None:
        ident = self.root.get("unique-identifier")
        value = next((e.text for e in self.root.iter(DC + "identifier") if e.get("id") == ident and e.text), None)
        return hashlib.sha1(re.sub(r"[\x20\t\r\n]", "", value).encode()).digest() if value else None


def reveal_font(data: bytes, key: bytes) -> bytes:
    """Undo (or apply) the obfuscation of a font's first bytes."""
    head = bytes(b ^ key[i % len(key)] for i, b in enumerate(data[:OBFUSCATED_BYTES]))
    return head + data[OBFUSCATED_BYTES:]


_BLOCK = [("chapter", pa.int32()), ("title", pa.string()), ("pos", pa.int32()), ("tag", pa.string()), ("level", pa.int32()), ("text", pa.string())]
_ITEM = [("pos", pa.int32()), ("id", pa.string()), ("path", pa.string()), ("media_type", pa.string()), ("linear", pa.bool_()), ("title", pa.string()), ("status", pa.string())]


def read_epub(content: Column, nonlinear: bool = False) -> Column:
    """struct(blocks, losses, fault)."""
    kind = pa.struct([("blocks", pa.list_(pa.struct(_BLOCK))), ("losses", pa.list_(pa.string())), ("fault", pa.string())])

    def run(rows: pa.Array) -> pa.Array:
        out = []
        for b in rows.to_pylist():
            try:
                blocks, losses = Epub(b or b"").chapters(nonlinear)
                out.append({"blocks": blocks, "losses": losses, "fault": None})
            except ValueError as e:
                out.append({"fault": str(e)})
        return pa.array(out, kind)

    return F.arrow_udf(run, "struct<blocks: array<struct<chapter: int, title: string, pos: int, tag: string, level: int, text: string>>, losses: array<string>, fault: string>")(content)


def read_epub_metadata(content: Column) -> Column:
    """map(field, values): the package document alone is read."""

    def run(rows: pa.Array) -> pa.Array:
        out = []
        for b in rows.to_pylist():
            try:
                out.append(list(Epub(b or b"").metadata().items()))
            except ValueError:
                out.append(None)
        return pa.array(out, pa.map_(pa.string(), pa.list_(pa.string())))

    return F.arrow_udf(run, "map<string, array<string>>")(content)


def spine_table(docs: DataFrame, row_id: str, content: str = "content") -> DataFrame:
    kind = pa.list_(pa.struct(_ITEM))

    def run(rows: pa.Array) -> pa.Array:
        out = []
        for b in rows.to_pylist():
            try:
                out.append([{k: s[k] for k, _ in _ITEM} for s in Epub(b or b"").spine()])
            except ValueError:
                out.append(None)
        return pa.array(out, kind)

    found = F.arrow_udf(run, "array<struct<pos: int, id: string, path: string, media_type: string, linear: boolean, title: string, status: string>>")(F.col(content))
    return docs.select(row_id, F.explode(found).alias("_s")).select(row_id, "_s.*")


def merge_metadata(own: Column, defaults: Column) -> Column:
    """Fields of ``own``, and of ``defaults`` those that it lacks."""
    return F.map_concat(own, F.map_filter(defaults, lambda k, _: ~F.map_contains_key(own, k)))
