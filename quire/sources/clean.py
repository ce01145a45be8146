"""Embedded XML made harmless, the colors of drawings, and containers within containers."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.color import _functional
from quire.sources.archive import members
from quire.sources.binary import CFBF, PNG, cfbf_streams, png_chunks
from quire.sources.css import declarations

#: Namespaces, elements that act, names whose case matters, and attributes that hold a color.
NAMESPACES = {"svg": "http://www.w3.org/2000/svg", "math": "http://www.w3.org/1998/Math/MathML"}
ACTIVE = frozenset("script foreignobject iframe style animate animatetransform set annotation-xml".split())
CASED = {n.lower(): n for n in "viewBox preserveAspectRatio linearGradient radialGradient gradientUnits gradientTransform spreadMethod clipPath clipPathUnits".split()}
COLOR_ATTRIBUTES = ("color", "fill", "flood-color", "lighting-color", "stop-color", "stroke")
_OUTSIDE = re.compile(r"url\(\s*['\"]?(?!#)", re.I)


def _local(name: str) -> str:
    return name.rpartition("}")[2]


def clean_xml(value: str, kind: str) -> tuple[str | None, list[str]]:
    """(the drawing or formula without what acts or leads elsewhere, warnings); no text where it isn't one."""
    if re.search(r"<!\s*(DOCTYPE|ENTITY)", value, re.I):
        return None, [f"{kind}: declarations aren't allowed"]
    try:
        root = ET.fromstring(value)
    except ET.ParseError:
        return None, [f"{kind}: not well-formed"]
    if _local(root.tag).lower() != kind:
        return None, [f"{kind}: another root"]
    said: list[str] = []
    space, todo = NAMESPACES[kind], [root]
    while todo:
        node = todo.pop()
        own = _local(node.tag)
        node.tag = f"{{{space}}}{CASED.get(own.lower(), own)}"
        kept = []
        for c in list(node):
            name = _local(c.tag).lower() if isinstance(c.tag, str) else "comment"
            if name in ACTIVE or name == "comment":
                said.append(f"{kind} element left out: {name}")
                node.remove(c)
            else:
                kept.append(c)
        todo += reversed(kept)
        attributes, node.attrib = dict(node.attrib), {}
        for key, v in attributes.items():
            name = _local(key).lower()
            if name.startswith("on") or name in ("style", "src") or (name == "href" and not v.startswith("#")) or _OUTSIDE.search(v):
                said.append(f"{kind} attribute left out: {name}")
            else:
                node.set(CASED.get(name, key), v)
    ET.register_namespace("", space)
    return ET.tostring(root, "unicode"), said


def _paint(raw: str | None, opacity: str | None) -> tuple[str, float] | None:
    """(#rrggbb, alpha) of a paint; none for keywords without a color and for references."""
    v = (raw or "").strip().lower()
    m = re.fullmatch(r"#([0-9a-f]{3}|[0-9a-f]{6})", v)
    if m:
        hexes = m[1] if len(m[1]) == 6 else "".join(c * 2 for c in m[1])
        rgb, alpha = hexes, 1.0
    elif found := _functional(v):
        rgb, alpha = "".join(f"{round(found[n] * 255):02x}" for n in "rgb"), found["alpha"]
    else:
        return None
    try:
        o = (opacity or "1").strip()
        alpha *= min(max(float(o.removesuffix("%")) / (100.0 if o.endswith("%") else 1.0), 0.0), 1.0)
    except ValueError:
        pass
    return f"#{rgb}", alpha


def svg_colors(value: str) -> list[dict]:
    """(element, attribute, color, alpha) of all paints of a drawing, an attribute before its declaration in ``style``."""
    try:
        root = ET.fromstring(value)
    except ET.ParseError:
        return []
    out = []
    for e in root.iter():
        styled = {n: v for n, v, _ in declarations(e.get("style") or "")}
        get = lambda n, e=e, styled=styled: e.get(n, styled.get(n))
        for name in COLOR_ATTRIBUTES:
            if paint := _paint(get(name), get(f"{name}-opacity")):
                out.append({"element": _local(e.tag), "attribute": name, "color": paint[0], "alpha": paint[1]})
    return out


def _profile(data: bytes) -> str | None:
    return "zip" if data[:4] == b"PK\x03\x04" else "cfbf" if data[:8] == CFBF else "png" if data[:8] == PNG else None


def container_tree(data: bytes, max_depth: int = 8, max_containers: int = 128, max_items: int = 10_000, max_bytes: int = 1 << 30) -> list[dict]:
    """(location, profile, depth, items, size) of a container and of those in it, in order. The limits are shared by
    all of them: what exceeds one is a ValueError, as is a container that can't be read."""
    out: list[dict] = []
    items = total = 0
    todo: list[tuple[bytes, str, int]] = [(data, "", 0)]
    while todo:
        own, at, depth = todo.pop()
        profile = _profile(own)
        if profile is None:
            raise ValueError("no-container")
        if depth > max_depth or len(out) >= max_containers:
            raise ValueError("too-deep" if depth > max_depth else "too-many-containers")
        inner = sorted(members(own).items()) if profile == "zip" else []
        n = len(inner) if profile == "zip" else len(cfbf_streams(own) if profile == "cfbf" else png_chunks(own))
        items, total = items + max(1, n), total + len(own) + sum(len(b) for _, b in inner)
        if items > max_items or total > max_bytes:
            raise ValueError("too-large")
        out.append({"location": at, "profile": profile, "depth": depth, "items": n, "size": len(own)})
        todo += [(b, f"{at}/{name}", depth + 1) for name, b in reversed(inner) if _profile(b)]
    return out


_TREE = pa.struct([("nodes", pa.list_(pa.struct([("location", pa.string()), ("profile", pa.string()), ("depth", pa.int32()), ("items", pa.int64()), ("size", pa.int64())]))), ("fault", pa.string())])


def read_container_tree(content: Column, **limits) -> Column:
    """struct(nodes, fault)."""

    def one(b: bytes) -> dict:
        try:
            return {"nodes": container_tree(b, **limits), "fault": None}
        except ValueError as e:
            return {"nodes": None, "fault": str(e)}

    run = lambda rows: pa.array([None if b is None else one(b) for b in rows.to_pylist()], _TREE)
    return F.arrow_udf(run, "struct<nodes: array<struct<location: string, profile: string, depth: int, items: bigint, size: bigint>>, fault: string>")(content)


def read_clean_xml(value: Column, kind: str) -> Column:
    """struct(xml, warnings)."""
    out = pa.struct([("xml", pa.string()), ("warnings", pa.list_(pa.string()))])
    run = lambda rows: pa.array([None if v is None else dict(zip(("xml", "warnings"), clean_xml(v, kind), strict=True)) for v in rows.to_pylist()], out)
    return F.arrow_udf(run, "struct<xml: string, warnings: array<string>>")(value)


def read_svg_colors(value: Column) -> Column:
    kind = pa.list_(pa.struct([("element", pa.string()), ("attribute", pa.string()), ("color", pa.string()), ("alpha", pa.float64())]))
    run = lambda rows: pa.array([None if v is None else svg_colors(v) for v in rows.to_pylist()], kind)
    return F.arrow_udf(run, "array<struct<element: string, attribute: string, color: string, alpha: double>>")(value)
