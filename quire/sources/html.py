"""HTML as tables: a standard-library tree walk in an Arrow kernel, one row of nested arrays a document.

Nesting follows the source: no end tag is implied, and an end tag closes the nearest open element of its
name, or nothing. Nothing is executed or fetched.
"""

from __future__ import annotations

import base64
import hashlib
import re
import urllib.parse
from collections import Counter
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.sources.css import Cascade

#: Roles of tags.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote figcaption dt dd".split())
CONTAINERS = frozenset("html body main section article div header footer nav aside figure".split())
SKIPPED = frozenset("head style script link meta base iframe object embed template".split())
LISTS = ("ul", "ol")
INLINE = frozenset("a abbr b bdi bdo big br cite code del dfn em font i img ins kbd label mark math q s samp small span strike strong sub sup svg time tt u var wbr".split())
IMAGE_TYPES = {"image/png": "png", "image/jpeg": "jpg", "image/gif": "gif", "image/webp": "webp", "image/svg+xml": "svg"}
MOST_IMAGE_BYTES = 10 * 1024 * 1024
MOST_HTML_CHARACTERS = 10 * 1024 * 1024
MOST_SPAN = 100
_HEADINGS = frozenset(f"h{i}" for i in range(1, 7))
_SPACE = re.compile(r"\s+")


@dataclass(eq=False, slots=True)
class Node:
    tag: str
    attrs: dict[str, str | None] = field(default_factory=dict)
    parent: Node | None = None
    children: list = field(default_factory=list)

    def walk(self):
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(c for c in reversed(node.children) if not isinstance(c, str))

    @property
    def text(self) -> str:
        out, stack = [], [self]
        while stack:
            c = stack.pop()
            if isinstance(c, str):
                out.append(c)
            else:
                stack.extend(reversed(c.children))
        return "".join(out)


def _through(steps) -> None:
    """Run a generator that yields the generators it wants run: recursion that nesting can't exhaust."""
    stack = [steps]
    while stack:
        step = next(stack[-1], None)
        if step is None:
            stack.pop()
        else:
            stack.append(step)


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("")
        self.at = self.root
        self.open: Counter[str] = Counter()
        self.sheets: list[Node] = []
        self.has_lang = self.has_shift = False

    def updatepos(self, i, j):
        return j  # lines and columns aren't asked for

    def handle_starttag(self, tag, attrs):
        node = Node(tag, {}, self.at)
        for k, v in attrs:
            node.attrs.setdefault(k, v)
            self.has_lang = self.has_lang or k == "lang"
        if tag == "style":
            self.sheets.append(node)
        elif tag in ("sub", "sup"):
            self.has_shift = True
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node
            self.open[tag] += 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.at = self.at.parent
            self.open[tag] -= 1

    def handle_endtag(self, tag):
        if self.open[tag] <= 0:
            return
        while True:
            up, self.at = self.at, self.at.parent
            self.open[up.tag] -= 1
            if up.tag == tag:
                return

    def handle_data(self, data):
        self.at.children.append(data)


def _built(html: str) -> _Builder:
    b = _Builder()
    b.feed(html)
    b.close()
    return b


def parse(html: str) -> Node:
    return _built(html).root


def allowed(href: str) -> bool:
    return href.startswith("#") or urllib.parse.urlsplit(href).scheme.lower() in ("http", "https", "mailto")


class Reader:
    """Walks a tree once and collects rows; those of runs when they are asked for."""

    def __init__(self, html: str):
        built = _built(html)
        self.root, self._has_lang, self._has_shift = built.root, built.has_lang, built.has_shift
        sheets = [n.text for n in built.sheets if (n.attrs.get("media") or "all").strip().lower() in ("", "all", "screen")]
        self.css = Cascade(sheets)
        self.blocks: list[dict] = []
        self._runs: list[tuple[int, int, dict]] = []
        self.cells: list[dict] = []
        self.images: list[dict] = []
        self.warnings: list[tuple[str, str]] = []
        self._open: list[dict] | None = None
        self._frame: dict = {}
        self._lists = self._tables = 0
        self._langs: dict[int, str | None] = {}
        self._shifts: dict[int, str] = {}
        _through(self._children(self.root, None))
        self._flush()
        self.warnings += [("css", w) for w in self.css.warnings]

    # -- paragraphs

    def _start(self, node: Node | None, **more) -> None:
        self._flush()
        tag = node.tag if node is not None else ""
        align = self.css.style(node).get("text-align") if node is not None else None
        self._open = []
        self._frame = {"tag": tag, "level": int(tag[1]) if tag in _HEADINGS else 0, "align": align, "lang": self._lang(node), **more}

    def _flush(self) -> None:
        if self._open is None:
            return
        runs, frame = self._open, self._frame
        self._open, self._frame = None, {}
        if not runs and not frame.get("force"):
            return
        seen = [r for r in runs if r["text"]]
        if seen and not seen[0]["keep"]:
            seen[0]["text"] = seen[0]["text"].lstrip()
        if seen and not seen[-1]["keep"]:
            seen[-1]["text"] = seen[-1]["text"].rstrip()
        text = "".join(r["text"] for r in runs)
        anchors = [r["anchor"] for r in runs if r.get("anchor")]
        if not text and not anchors and not frame.get("force"):
            return
        pos = len(self.blocks)
        self.blocks.append({"pos": pos, "kind": "paragraph", "text": text, "list_id": None, "list_level": None, "list_value": None, "table_ix": None, **{k: v for k, v in frame.items() if k != "force"}})
        self._runs += [(pos, i, r) for i, r in enumerate(r for r in runs if r["text"] or r.get("anchor"))]

    @property
    def runs(self) -> list[dict]:
        return [{"pos": pos, "ix": i, "text": r["text"], "link": r["link"], "anchor": r.get("anchor"), **self._style(r["node"])} for pos, i, r in self._runs]

    def _style(self, node: Node | None) -> dict:
        if node is None:
            return _PLAIN
        css = self.css.style(node) if node.tag else {}
        return {
            "bold": css.get("font-weight", "normal") in ("bold", "bolder", "600", "700", "800", "900"),
            "italic": css.get("font-style", "normal") in ("italic", "oblique"),
            "underline": "underline" in css.get("text-decoration", ""),
            "shift": css.get("vertical-align", "") or self._raised(node) or None,
            "color": css.get("color"),
            "size": float(css.get("font-size", "12pt")[:-2]),
            "family": css.get("font-family"),
        }

    def _lang(self, node: Node | None) -> str | None:
        return None if not self._has_lang else self._from_above(node, self._langs, lambda n: n.attrs.get("lang") or None, None)

    @staticmethod
    def _from_above(node: Node | None, known: dict, own, nothing):
        """The nearest value that an element or one above it has of its own, remembered for each."""
        chain = []
        while node is not None and id(node) not in known:
            chain.append(node)
            if (value := own(node)) is not None:
                break
            node = node.parent
        else:
            value = known[id(node)] if node is not None else nothing
        known.update(dict.fromkeys(map(id, chain), value))
        return value

    def _raised(self, node: Node) -> str:
        if not self._has_shift:
            return ""
        own = lambda n: "" if not n.tag or n.tag in PARAGRAPHS else {"sub": "sub", "sup": "super"}.get(n.tag)
        return self._from_above(node, self._shifts, own, "")

    def _say(self, text: str, node: Node, link: str | None) -> None:
        css = self.css.style(node) if node.tag else {}
        keep = css.get("white-space", "normal") in ("pre", "pre-wrap")
        if self._open is None:
            if not text.strip():
                return
            self._start(None)
            self._frame["lang"] = self._lang(node)
        if not keep:
            text = _SPACE.sub(" ", text)
            before = next((r["text"] for r in reversed(self._open) if r["text"]), "")
            if text.startswith(" ") and (not before or before[-1] in " \n"):
                text = text[1:]
        if not text:
            return
        self._open.append({"text": text, "link": link, "keep": keep, "node": node})

    # -- structure

    def _hidden(self, node: Node) -> bool:
        return node.tag in SKIPPED or "hidden" in node.attrs or (node.tag != "" and self.css.style(node).get("display") == "none")

    def _children(self, node: Node, link: str | None):
        for c in node.children:
            if isinstance(c, str):
                self._say(c, node, link)
            else:
                yield self._child(c, link)

    def _child(self, c: Node, link: str | None):
        if self._hidden(c):
            return
        elif c.tag in PARAGRAPHS:
            self._start(c)
            self._anchor(c)
            yield self._children(c, link)
            self._flush()
        elif c.tag in CONTAINERS or c.tag == "":
            self._flush()
            yield self._children(c, link)
            self._flush()
        elif c.tag in LISTS:
            self._flush()
            yield self._list(c, 0)
        elif c.tag == "table":
            self._flush()
            yield self._table(c)
        elif c.tag == "br":
            if self._open is not None:
                self._open.append({"text": "\n", "link": None, "keep": False, "node": None})
        elif c.tag == "img":
            self._image(c, link)
        else:
            self._anchor(c)
            if c.tag not in INLINE:
                self.warnings.append(("element", f"unknown element {c.tag}"))
            if c.tag == "a" and c.attrs.get("href") is not None:
                href = c.attrs["href"]
                link = href if allowed(href) else None
                if link is None:
                    self.warnings.append(("link", f"link left out: {href[:80]}"))
            if c.tag in ("math", "svg"):
                self._say(c.text, c, link)
                return
            yield self._children(c, link)

    def _anchor(self, node: Node) -> None:
        ident = node.attrs.get("id")
        if ident and self._open is not None:
            self._open.append({"text": "", "link": None, "keep": False, "node": None, "anchor": ident})

    def _image(self, node: Node, link: str | None) -> None:
        src, alt = node.attrs.get("src") or "", node.attrs.get("alt") or ""
        m = re.match(r"data:([\w/+.-]+)((?:;[\w=.-]+)*),", src)
        if not m or m[1].lower() not in IMAGE_TYPES:
            self.warnings.append(("image", "image without embedded data"))
            if alt:
                self._say(alt, node, link)
            return
        try:
            raw = src[m.end() :]
            data = base64.b64decode(re.sub(r"\s", "", urllib.parse.unquote(raw)), validate=True) if ";base64" in m[2] else urllib.parse.unquote_to_bytes(raw)
        except ValueError:
            self.warnings.append(("image", "image data can't be read"))
            return
        if len(data) > MOST_IMAGE_BYTES:
            self.warnings.append(("image", "image is too large"))
            return
        self.images.append({"pos": len(self.blocks), "resource_id": "html-" + hashlib.sha256(data).hexdigest()[:20], "media_type": m[1].lower(), "size": len(data), "alt": alt})

    def _list(self, node: Node, depth: int):
        ident = self._lists
        self._lists += 1
        try:
            value = int(node.attrs.get("start") or 1)
        except ValueError:
            value = 1
        for item in node.children:
            if isinstance(item, str) or item.tag != "li" or self._hidden(item):
                continue
            frame = {"list_id": ident, "list_level": depth, "list_value": value}
            value += 1
            first = len(self.blocks)
            self._start(item, **frame)
            self._anchor(item)
            for c in item.children:
                if not isinstance(c, str) and c.tag in LISTS and not self._hidden(c):
                    self._flush()
                    self._list_gap(first, item, frame)
                    yield self._list(c, depth + 1)
                elif not isinstance(c, str) and c.tag in PARAGRAPHS and not self._hidden(c):
                    self._start(c, **frame)
                    yield self._children(c, None)
                    self._flush()
                else:
                    if self._open is None and (not isinstance(c, str) or c.strip()):
                        self._start(item, **frame)
                    if isinstance(c, str):
                        self._say(c, item, None)
                    else:
                        yield self._child(c, None)
            self._flush()
            self._list_gap(first, item, frame)

    def _list_gap(self, first: int, item: Node, frame: dict) -> None:
        """An item without a paragraph of its own gets an empty one."""
        if len(self.blocks) == first:
            self._start(item, force=True, **frame)
            self._flush()

    def _table(self, node: Node):
        ix = self._tables
        self._tables += 1
        for c in node.children:
            if not isinstance(c, str) and c.tag == "caption":
                self._start(c)
                yield self._children(c, None)
                self._flush()
        rows = _rows(node)
        taken: dict[int, int] = {}
        for r, row in enumerate(rows):
            group = row.parent.tag if row.parent and row.parent.tag in ("thead", "tbody", "tfoot") else "tbody"
            col = 0
            for k, cell in enumerate(c for c in row.children if not isinstance(c, str) and c.tag in ("td", "th")):
                high, wide = (self._span(cell, a) for a in ("rowspan", "colspan"))
                while any(taken.get(col + i, 0) > r for i in range(wide)):
                    col += 1
                for i in range(wide):
                    taken[col + i] = r + high
                first, held = len(self.blocks), self._open
                self._open = None
                yield self._children(cell, None)
                self._flush()
                self._open = held
                for b in self.blocks[first:]:
                    if b["table_ix"] is None:
                        b["table_ix"], b["kind"] = ix, "cell"
                text = "\n".join(b["text"] for b in self.blocks[first:])
                self.cells.append({"table_ix": ix, "row_ix": r, "cell_ix": k, "grid_col": col, "row_span": high, "col_span": wide, "role": "header" if cell.tag == "th" else "data", "scope": cell.attrs.get("scope"), "row_group": group, "text": text})
                col += wide

    def _span(self, cell: Node, name: str) -> int:
        value = cell.attrs.get(name)
        if value is None:
            return 1
        if value.strip().isdecimal() and 1 <= int(value) <= MOST_SPAN:
            return int(value)
        self.warnings.append(("table", f"{name} {value[:20]} read as 1"))
        return 1


_PLAIN = {"bold": False, "italic": False, "underline": False, "shift": None, "color": None, "size": None, "family": None}


def _rows(table: Node) -> list[Node]:
    """Rows of a table, not of the tables in it."""
    out, stack = [], [table]
    while stack:
        node = stack.pop()
        if node.tag == "tr":
            out.append(node)
        stack.extend(c for c in reversed(node.children) if not isinstance(c, str) and c.tag != "table")
    return out


def metrics(root: Node) -> dict[str, int]:
    """Counts of start tags and visible characters."""
    names = {"section": "sections", "p": "paragraphs", "table": "tables", "tr": "rows", "td": "cells", "th": "cells", "img": "images", "math": "formulas", "ul": "lists", "ol": "lists", "li": "items", **{f"h{i}": "headings" for i in range(1, 7)}}
    out = dict.fromkeys([*names.values(), "internal_links", "hyperlinks", "characters", "text_runs"], 0)

    stack: list[tuple[Node, bool]] = [(root, False)]
    while stack:
        node, quiet = stack.pop()
        if node.tag in names:
            out[names[node.tag]] += 1
        if node.tag == "a" and node.attrs.get("href") is not None:
            out["internal_links" if node.attrs["href"].startswith("#") else "hyperlinks"] += 1
        quiet = quiet or node.tag in ("head", "script", "style", "math")
        for c in node.children:
            if not isinstance(c, str):
                stack.append((c, quiet))
            elif not quiet and c.strip():
                out["characters"] += len(c)
                out["text_runs"] += 1
    return out


def flat_text(blocks: list[dict], cells: list[dict]) -> str | None:
    """Paragraphs that aren't empty, and tables as rows of cells joined by `` | ``, in order; null without any."""
    if not blocks and not cells:
        return None
    tables: dict[int, dict[int, list[tuple[int, str]]]] = {}
    for c in cells:
        tables.setdefault(c["table_ix"], {}).setdefault(c["row_ix"], []).append((c["cell_ix"], c["text"]))
    first: dict[int, int] = {}
    for b in blocks:
        if b["table_ix"] is not None:
            first.setdefault(b["table_ix"], b["pos"])
    placed = [(b["pos"], b["text"]) for b in blocks if b["table_ix"] is None]
    placed += [(first.get(ix, 1 << 30), "\n".join(" | ".join(t for _, t in sorted(row)) for _, row in sorted(rows.items()))) for ix, rows in tables.items()]
    return "\n".join(t for _, t in sorted(placed) if t)


_BLOCK = [("pos", pa.int32()), ("kind", pa.string()), ("tag", pa.string()), ("level", pa.int32()), ("text", pa.string()), ("align", pa.string()), ("lang", pa.string()), ("list_id", pa.int32()), ("list_level", pa.int32()), ("list_value", pa.int32()), ("table_ix", pa.int32())]
_RUN = [("pos", pa.int32()), ("ix", pa.int32()), ("text", pa.string()), ("link", pa.string()), ("anchor", pa.string()), ("bold", pa.bool_()), ("italic", pa.bool_()), ("underline", pa.bool_()), ("shift", pa.string()), ("color", pa.string()), ("size", pa.float64()), ("family", pa.string())]
_CELL = [("table_ix", pa.int32()), ("row_ix", pa.int32()), ("cell_ix", pa.int32()), ("grid_col", pa.int32()), ("row_span", pa.int32()), ("col_span", pa.int32()), ("role", pa.string()), ("scope", pa.string()), ("row_group", pa.string()), ("text", pa.string())]
_IMAGE = [("pos", pa.int32()), ("resource_id", pa.string()), ("media_type", pa.string()), ("size", pa.int64()), ("alt", pa.string())]
_ISSUE = [("code", pa.string()), ("message", pa.string())]
_LINK = [("ix", pa.int32()), ("href", pa.string()), ("text", pa.string())]
PARTS = {"blocks": _BLOCK, "runs": _RUN, "cells": _CELL, "images": _IMAGE, "issues": _ISSUE, "links": _LINK}
_NAMES = {pa.int32(): "int", pa.int64(): "bigint", pa.string(): "string", pa.bool_(): "boolean", pa.float64(): "double"}


def _ddl(fields) -> str:
    return ", ".join(f"{n}: {_NAMES[t]}" for n, t in fields)


def _parts(html: str | None, wanted: tuple[str, ...]) -> dict:
    if html is None:
        return {w: None for w in wanted}
    if len(html) > MOST_HTML_CHARACTERS:
        return {"issues": [{"code": "limit", "message": "the source is too large"}]}
    out: dict = {}
    if {"blocks", "runs", "cells", "images", "issues", "flat"} & set(wanted):
        r = Reader(html)
        root = r.root
        out |= {"blocks": r.blocks, "runs": r.runs if "runs" in wanted else None, "cells": r.cells, "images": r.images, "issues": [{"code": c, "message": m} for c, m in dict.fromkeys(r.warnings)]}
        if "flat" in wanted:
            out["flat"] = flat_text(r.blocks, r.cells)
    else:
        root = parse(html)
    if not {"links", "ids", "title", "lang", "metrics"} & set(wanted):
        return {w: out.get(w) for w in wanted}
    nodes = list(root.walk())
    out["links"] = [{"ix": i, "href": n.attrs["href"], "text": re.sub(r"\s+", " ", n.text).strip()} for i, n in enumerate(n for n in nodes if n.tag == "a" and n.attrs.get("href") is not None)]
    out["ids"] = [n.attrs["id"] for n in nodes if n.attrs.get("id")]
    out["title"] = next((re.sub(r"\s+", " ", n.text).strip() for n in nodes if n.tag == "title"), None)
    out["lang"] = next((n.attrs["lang"] for n in nodes if n.tag == "html" and n.attrs.get("lang")), None)
    if "metrics" in wanted:
        out["metrics"] = list(metrics(root).items())
    return {w: out.get(w) for w in wanted}


def _read(html: str | None, wanted: tuple[str, ...]) -> dict:
    """The wanted parts; a page that the reader fails on is an issue, not a failed job."""
    try:
        return _parts(html, wanted)
    except Exception as e:
        return {w: [{"code": "fault", "message": type(e).__name__}] if w == "issues" else None for w in wanted}


#: Bounds of what a worker keeps of the pages that it has read: bytes of parts, characters of sources; and of a batch.
MOST_KEPT_BYTES, MOST_KEPT_CHARACTERS, MOST_BATCH_BYTES = 64 << 20, 16 << 20, 16 << 20
_kept: dict[tuple[str, ...], tuple[dict[str, int], pa.Array]] = {}


def _read_batch(rows: pa.Array, wanted: tuple[str, ...], kind: pa.StructType) -> pa.Array:
    """The wanted parts of each page. Pages that are the same are read once in a batch, and once in a worker while what
    they gave is kept; their parts are repeated as Arrow arrays."""
    each = rows.dictionary_encode()
    texts = each.dictionary.to_pylist()
    parts = lambda pages: pa.StructArray.from_arrays([pa.array([page.get(f.name) for page in pages], f.type) for f in kind], fields=list(kind))
    held, pool = _kept.get(wanted, ({}, None))
    if pool is None or pool.nbytes > MOST_KEPT_BYTES or sum(map(len, held)) > MOST_KEPT_CHARACTERS:
        held, pool = {}, parts([_read(None, wanted)])
    new = [t for t in texts if t not in held]
    if new:
        held = held | {t: len(pool) + i for i, t in enumerate(new)}
        pool = pa.concat_arrays([pool, parts([_read(t, wanted) for t in new])])
    if len(_kept) > 3:
        _kept.clear()
    if rows.nbytes <= MOST_BATCH_BYTES:
        _kept[wanted] = held, pool
    places = pa.array([held[t] for t in texts], pa.int64()).take(each.indices)
    return pool.take(places.fill_null(0))


def read_html(html: Column, *wanted: str) -> Column:
    """A struct of the wanted parts of a document: ``blocks, runs, cells, images, issues, links`` (arrays of
    structs), ``ids`` (array), ``flat`` (text, null without blocks and cells), ``title``, ``lang``, ``metrics`` (map). Null gives nulls. What isn't wanted
    isn't computed where it would cost a walk. Sources over 10 Mi characters give an issue and no parts."""
    types = {k: pa.list_(pa.struct(v)) for k, v in PARTS.items()} | {"ids": pa.list_(pa.string()), "flat": pa.string(), "title": pa.string(), "lang": pa.string(), "metrics": pa.map_(pa.string(), pa.int64())}
    names = {k: f"array<struct<{_ddl(v)}>>" for k, v in PARTS.items()} | {"ids": "array<string>", "flat": "string", "title": "string", "lang": "string", "metrics": "map<string,bigint>"}

    kind = pa.struct([(w, types[w]) for w in wanted])

    def run(rows: pa.Array) -> pa.Array:
        return _read_batch(rows, wanted, kind)

    return F.arrow_udf(run, "struct<" + ", ".join(f"{w}: {names[w]}" for w in wanted) + ">")(html)


def html_table(docs: DataFrame, part: str, row_id: str, html: str = "html") -> DataFrame:
    """One part of all documents as rows: ``row_id`` with the part's columns."""
    inner = docs.select(row_id, F.explode(read_html(F.col(html), part)[part]).alias("_p"))
    return inner.select(row_id, F.col("_p").alias(part)) if part == "ids" else inner.select(row_id, "_p.*")
