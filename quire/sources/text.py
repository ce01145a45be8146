"""Decoding and encoding of text files: strict, with a reason where a file can't be read as text."""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import normalize_newlines

#: Encodings, byte order marks and policies.
ENCODINGS = {"auto": None, "utf-8": "utf-8", "utf-16-le": "utf-16-le", "utf-16-be": "utf-16-be", "cp1251": "cp1251"}
MARKS = (("utf-8", b"\xef\xbb\xbf"), ("utf-16-le", b"\xff\xfe"), ("utf-16-be", b"\xfe\xff"))
WIDE_MARKS = (b"\xff\xfe\x00\x00", b"\x00\x00\xfe\xff")
BOM_POLICIES = ("auto", "require", "forbid")
NEWLINES = {"preserve": None, "lf": "\n", "crlf": "\r\n", "cr": "\r"}


@dataclass(frozen=True)
class TextProfile:
    """How a text is read and written; impossible combinations are errors at once."""

    encoding: str = "auto"
    bom: str = "auto"
    newline: str = "preserve"

    def __post_init__(self):
        if self.encoding not in ENCODINGS or self.bom not in BOM_POLICIES or self.newline not in NEWLINES:
            raise ValueError(f"unknown text profile {self}")
        if self.encoding == "cp1251" and self.bom == "require":
            raise ValueError("cp1251 has no byte order mark")


def decode_bytes(data: bytes, profile: TextProfile = TextProfile()) -> dict:
    """{text, encoding, bom, reason}: text is None where reason isn't."""
    fail = lambda reason: {"text": None, "encoding": None, "bom": None, "reason": reason}
    if data.startswith(WIDE_MARKS):
        return fail("unsupported-encoding")
    found, mark = next(((e, m) for e, m in MARKS if data.startswith(m)), (None, b""))
    if profile.bom == "require" and not mark:
        return fail("missing-bom")
    if profile.bom == "forbid" and mark:
        return fail("forbidden-bom")
    if mark and profile.encoding not in ("auto", found):
        return fail("conflicting-bom")
    encoding = found or ENCODINGS[profile.encoding] or "utf-8"
    try:
        text = data[len(mark) :].decode(encoding)
    except UnicodeDecodeError:
        return fail("ambiguous-encoding" if profile.encoding == "auto" and not mark else "invalid-encoding")
    if "\0" in text:
        return fail("binary-or-ambiguous")
    return {"text": text, "encoding": encoding, "bom": bool(mark), "reason": None}


def encode_string(text: str, profile: TextProfile, encoding: str = "utf-8", bom: bool = False, separators: list[str] | None = None) -> tuple[bytes, bool]:
    """(bytes, whether separators had to change). ``preserve`` puts recorded separators back where their
    number is that of the line ends, else all become LF."""
    lines = re.sub("\r\n|\r", "\n", text).split("\n")
    changed, end = False, NEWLINES[profile.newline]
    if end is None:
        if separators is not None and len(separators) == len(lines) - 1:
            out = "".join(a + b for a, b in zip(lines, [*separators, ""], strict=True))
        else:
            out, changed = "\n".join(lines), separators is not None
    else:
        out = end.join(lines)
    name = ENCODINGS[profile.encoding] or encoding
    mark = profile.bom == "require" or (profile.bom == "auto" and bom and name != "cp1251")
    data = (dict(MARKS)[name] if mark else b"") + out.encode(name)
    if data[len(dict(MARKS)[name]) if mark else 0 :].decode(name) != out:
        raise ValueError("the text doesn't survive its encoding")
    return data, changed


_DECODED = pa.struct([("text", pa.string()), ("encoding", pa.string()), ("bom", pa.bool_()), ("reason", pa.string())])


def decode_text(content: Column, profile: TextProfile = TextProfile()) -> Column:
    """struct(text, encoding, bom, reason) of binary content; null stays null."""

    def run(rows: pa.Array) -> pa.Array:
        return pa.array([None if b is None else decode_bytes(b, profile) for b in rows.to_pylist()], _DECODED)

    return F.arrow_udf(run, "struct<text: string, encoding: string, bom: boolean, reason: string>")(content)


def decode_with_fallback(content: Column) -> Column:
    """UTF-8 where it is valid (decided and decoded in the JVM), else cp1251; bytes that neither has become U+FFFD."""

    def run(rows: pa.Array) -> pa.Array:
        return pa.array([None if b is None else b.decode("cp1251", "replace") for b in rows.to_pylist()], pa.string())

    valid = F.is_valid_utf8(content.cast("string"))
    other = F.arrow_udf(run, "string")(F.when(~valid, content))
    return F.when(valid, content.cast("string")).otherwise(other)


def paragraphs(docs: DataFrame, row_id: str, text: str = "text") -> DataFrame:
    """(row_id, pos, text): one paragraph per line, empty ones too."""
    return docs.select(row_id, F.posexplode(F.split(normalize_newlines(F.col(text)), "\n", -1)).alias("pos", "text"))


def fold(text: Column, form: str | None = None) -> Column:
    """Unicode case folding, after normalisation to ``form`` if given: what Spark's ``lower`` can't do."""
    import unicodedata

    def run(rows: pa.Array) -> pa.Array:
        one = (lambda t: unicodedata.normalize(form, t).casefold()) if form else str.casefold
        return pa.array([None if t is None else one(t) for t in rows.to_pylist()], pa.string())

    return F.arrow_udf(run, "string")(text)


def comparable(text: Column) -> Column:
    """NFKC without white space and soft hyphens."""
    import unicodedata

    def run(rows: pa.Array) -> pa.Array:
        return pa.array([None if t is None else re.sub(r"[\s­]", "", unicodedata.normalize("NFKC", t)) for t in rows.to_pylist()], pa.string())

    return F.arrow_udf(run, "string")(text)
