"""The object layer of PDF files: values, cross-reference tables and streams, object streams. Nothing is rendered."""

from __future__ import annotations

import re
import struct
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.sources.binary import MOST_BYTES, inflate, undo_png

_BLANK = b"\0\t\n\x0c\r "
_STOP = _BLANK + b"()<>[]{}/%"
_NUMBER = re.compile(rb"[+-]?(?:\d+\.?\d*|\.\d+)$")
_REFERENCE = re.compile(rb"(\d+)[\0\t\n\x0c\r ]+(\d+)[\0\t\n\x0c\r ]+R(?![^\0\t\n\x0c\r ()<>\[\]{}/%])")
_OBJECT = re.compile(rb"\s*(\d+)\s+(\d+)\s+obj\b")
MOST_DEPTH, MOST_SECTIONS, MOST_OBJECTS = 64, 256, 1_000_000


class Name(str):
    """A name object."""


class Reference(tuple):
    """(object, generation)."""


class Values:
    """Reads one value after another; containers are kept on a stack of their own, so nesting is a limit, not a crash."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def _skip(self) -> None:
        data, at = self.data, self.at
        while at < len(data):
            if data[at] in _BLANK:
                at += 1
            elif data[at] == 0x25:
                end = min((p for p in (data.find(b"\n", at), data.find(b"\r", at)) if p >= 0), default=len(data))
                at = end
            else:
                break
        self.at = at

    def read(self):
        """The next value: numbers, booleans and null, names, strings as bytes, lists, dicts, references."""
        open_: list[tuple[bytes, list]] = []
        while True:
            self._skip()
            two, one = self.data[self.at : self.at + 2], self.data[self.at : self.at + 1]
            if two == b"<<" or one == b"[":
                if len(open_) >= MOST_DEPTH:
                    raise ValueError("too-deep")
                open_.append((b">>" if two == b"<<" else b"]", []))
                self.at += 2 if two == b"<<" else 1
                continue
            if open_ and (two if open_[-1][0] == b">>" else one) == open_[-1][0]:
                end, items = open_.pop()
                self.at += len(end)
                value = self._pairs(items) if end == b">>" else items
            else:
                value = self._scalar()
            if not open_:
                return value
            open_[-1][1].append(value)

    @staticmethod
    def _pairs(items: list) -> dict:
        if len(items) % 2 or not all(isinstance(k, Name) for k in items[::2]):
            raise ValueError("bad-dictionary")
        return dict(zip(items[::2], items[1::2], strict=True))

    def _scalar(self):
        data, at = self.data, self.at
        one = data[at : at + 1]
        if one == b"(":
            return self._literal()
        if one == b"<":
            end = data.find(b">", at)
            if end < 0:
                raise ValueError("bad-string")
            self.at = end + 1
            raw = re.sub(rb"\s", b"", data[at + 1 : end])
            try:
                return bytes.fromhex((raw + b"0" * (len(raw) % 2)).decode("ascii"))
            except ValueError as e:
                raise ValueError("bad-string") from e
        if one == b"/":
            self.at += 1
            return Name(re.sub(rb"#([0-9A-Fa-f]{2})", lambda m: bytes([int(m[1], 16)]), self._word()).decode("latin-1"))
        if m := _REFERENCE.match(data, at):
            self.at = m.end()
            return Reference((int(m[1]), int(m[2])))
        word = self._word()
        if not word:
            raise ValueError("bad-value")
        if _NUMBER.match(word):
            return float(word) if b"." in word else int(word)
        known = {b"true": True, b"false": False, b"null": None}
        if word not in known:
            raise ValueError("bad-value")
        return known[word]

    def _word(self) -> bytes:
        start = self.at
        while self.at < len(self.data) and self.data[self.at] not in _STOP:
            self.at += 1
        return self.data[start : self.at]

    def _literal(self) -> bytes:
        out, depth, at, data = bytearray(), 0, self.at, self.data
        named = dict(zip(b"nrtbf", b"\n\r\t\b\f", strict=True))
        while at < len(data):
            c = data[at]
            at += 1
            if c == 0x5C and at < len(data):
                m = re.compile(rb"[0-7]{1,3}").match(data, at)
                if m:
                    out.append(int(m[0], 8) & 255)
                    at = m.end()
                elif data[at] in b"\r\n":
                    at += 2 if data[at : at + 2] == b"\r\n" else 1
                else:
                    out.append(named.get(data[at], data[at]))
                    at += 1
                continue
            depth += {0x28: 1, 0x29: -1}.get(c, 0)
            if depth == 0:
                self.at = at
                return bytes(out)
            if not (c == 0x28 and depth == 1 and not out and at == self.at + 1):
                out.append(c)
        raise ValueError("bad-string")


def _stream(data: bytes, at: int, about: dict) -> bytes | None:
    m = re.compile(rb"\s*stream(?:\r\n|\n|\r)").match(data, at)
    if not m:
        return None
    length = about.get("Length")
    end = m.end() + length if isinstance(length, int) else data.find(b"endstream", m.end())
    if end < m.end() or end > len(data):
        raise ValueError("bad-stream")
    return data[m.end() : end]


def _decoded(about: dict, raw: bytes) -> bytes:
    """A stream behind flate, with a row predictor if it names one."""
    names = about.get("Filter", [])
    names = names if isinstance(names, list) else [names]
    if any(n != "FlateDecode" for n in names):
        raise ValueError("unknown-filter")
    for _ in names:
        raw = inflate(raw, MOST_BYTES)
    how = about.get("DecodeParms") or {}
    if isinstance(how, dict) and how.get("Predictor", 1) >= 10:
        raw = undo_png(raw, how.get("Columns", 1), 1)
    return raw


def _object(data: bytes, at: int) -> tuple[int, int, object, bytes | None]:
    m = _OBJECT.match(data, at)
    if not m:
        raise ValueError("no-object")
    values = Values(data, m.end())
    value = values.read()
    return int(m[1]), int(m[2]), value, _stream(data, values.at, value) if isinstance(value, dict) else None


def _table(data: bytes, at: int) -> tuple[list[dict], dict]:
    out, values = [], Values(data, at + 4)
    while True:
        values._skip()
        if data[values.at : values.at + 7] == b"trailer":
            values.at += 7
            trailer = values.read()
            if not isinstance(trailer, dict):
                raise ValueError("bad-trailer")
            return out, trailer
        m = re.compile(rb"(\d+)\s+(\d+)").match(data, values.at)
        if not m or len(out) + int(m[2]) > MOST_OBJECTS:
            raise ValueError("bad-xref")
        values.at = m.end()
        for i in range(int(m[2])):
            row = re.compile(rb"\s*(\d{10})\s(\d{5})\s([fn])").match(data, values.at)
            if not row:
                raise ValueError("bad-xref")
            values.at = row.end()
            out.append({"object": int(m[1]) + i, "kind": 1 if row[3] == b"n" else 0, "generation": int(row[2]), "offset": int(row[1])})


def _table_stream(data: bytes, at: int) -> tuple[list[dict], dict]:
    _, _, about, raw = _object(data, at)
    if raw is None or about.get("Type") != "XRef":
        raise ValueError("bad-xref")
    widths = about.get("W")
    if not isinstance(widths, list) or len(widths) != 3 or not all(isinstance(w, int) and 0 <= w <= 8 for w in widths):
        raise ValueError("bad-xref")
    body, step = _decoded(about, raw), sum(widths)
    ranges = about.get("Index", [0, about.get("Size", 0)])
    out, place = [], 0
    for first, n in zip(ranges[::2], ranges[1::2], strict=True):
        if n < 0 or len(out) + n > MOST_OBJECTS or place + n * step > len(body):
            raise ValueError("bad-xref")
        for i in range(n):
            fields, p = [], place
            for w in widths:
                fields.append(int.from_bytes(body[p : p + w], "big"))
                p += w
            kind = fields[0] if widths[0] else 1
            out.append({"object": first + i, "kind": kind, "generation": fields[2] if kind != 2 else 0, "offset": fields[1], "index": fields[2] if kind == 2 else None})
            place += step
    return out, about


def xref_entries(data: bytes) -> list[dict]:
    """Entries of all cross-reference sections, the newest first: search_index, object, kind (0 free, 1 in the file, 2 in
    an object stream), generation, offset (of a kind 2: the stream's object), index."""
    m = list(re.finditer(rb"startxref\s+(\d+)", data))
    if data[:5] != b"%PDF-" or not m:
        raise ValueError("not-pdf")
    todo, met, out = [int(m[-1][1])], set(), []
    while todo:
        at = todo.pop(0)
        if at in met or at >= len(data) or len(met) >= MOST_SECTIONS:
            raise ValueError("bad-xref-chain")
        met.add(at)
        rows, trailer = _table(data, at) if data[at : at + 4] == b"xref" else _table_stream(data, at)
        out += [{"search_index": len(met) - 1, "index": None} | r for r in rows]
        todo += [trailer[k] for k in ("XRefStm", "Prev") if isinstance(trailer.get(k), int)]
    return out


def _packed(data: bytes, at: int) -> dict[int, object]:
    """The objects of an object stream by their place."""
    _, _, about, raw = _object(data, at)
    if raw is None or about.get("Type") != "ObjStm":
        raise ValueError("bad-object-stream")
    body, first, n = _decoded(about, raw), about.get("First", 0), about.get("N", 0)
    head = Values(body)
    pairs = [(head.read(), head.read()) for _ in range(min(n, MOST_OBJECTS))]
    return {i: Values(body, first + offset).read() for i, (_, offset) in enumerate(pairs)}


def pdf_objects(data: bytes) -> list[dict]:
    """(object, generation, packed, kind, type, stream_size) of the objects that count: of several entries of a number the
    first found does, also if it says that the object is free. ``stream_size`` is that of the bytes as stored."""
    won: dict[int, dict] = {}
    for e in xref_entries(data):
        won.setdefault(e["object"], e)
    streams: dict[int, dict[int, object]] = {}
    out = []
    for number, e in sorted(won.items()):
        if e["kind"] == 1:
            found, generation, value, raw = _object(data, e["offset"])
            if found != number:
                raise ValueError("wrong-object")
        elif e["kind"] == 2:
            holder = won.get(e["offset"])
            if holder is None or holder["kind"] != 1:
                raise ValueError("bad-object-stream")
            if e["offset"] not in streams:
                streams[e["offset"]] = _packed(data, holder["offset"])
            if e["index"] not in streams[e["offset"]]:
                raise ValueError("bad-object-stream")
            generation, value, raw = 0, streams[e["offset"]][e["index"]], None
        else:
            continue
        kind = "stream" if raw is not None else {dict: "dict", list: "array", bytes: "string", bool: "boolean", type(None): "null", Name: "name", Reference: "reference"}.get(type(value), "number")
        named = value.get("Type") if isinstance(value, dict) else None
        out.append({"object": number, "generation": generation, "packed": e["kind"] == 2, "kind": kind, "type": str(named) if isinstance(named, Name) else None, "stream_size": None if raw is None else len(raw)})
    return out


_OBJECTS = pa.struct([("objects", pa.list_(pa.struct([("object", pa.int32()), ("generation", pa.int32()), ("packed", pa.bool_()), ("kind", pa.string()), ("type", pa.string()), ("stream_size", pa.int64())]))), ("fault", pa.string())])


def object_table(docs: DataFrame, row_id: str, content: str = "content") -> DataFrame:
    """(row_id, object, generation, packed, kind, type, stream_size, fault): a file that can't be read is one row with a fault."""

    def one(b: bytes | None) -> dict:
        try:
            return {"objects": pdf_objects(b or b""), "fault": None}
        except (ValueError, TypeError, IndexError, zlib.error, struct.error) as e:
            return {"objects": None, "fault": str(e) if isinstance(e, ValueError) else "bad-pdf"}

    run = lambda rows: pa.array([one(b) for b in rows.to_pylist()], _OBJECTS)
    kind = "struct<objects: array<struct<object: int, generation: int, packed: boolean, kind: string, type: string, stream_size: bigint>>, fault: string>"
    found = docs.select(row_id, F.arrow_udf(run, kind)(F.col(content)).alias("_o"))
    return found.select(row_id, F.explode_outer("_o.objects").alias("_x"), F.col("_o.fault").alias("fault")).select(row_id, "_x.*", "fault")
