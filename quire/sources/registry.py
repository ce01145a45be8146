"""Readers by format: one table of results for files of any kind, where a bad file is a row, not a failure."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.sources.binary import read_cfbf, read_pdf_info, read_png_header, read_sfnt
from quire.sources.epub import read_epub
from quire.sources.html import read_html
from quire.sources.office import read_docx, read_pptx
from quire.sources.tex import read_tex
from quire.sources.text import TextProfile, decode_text

BLOCK = "array<struct<pos: int, level: int, text: string>>"


@dataclass(frozen=True)
class Format:
    """``read``: binary content to struct(blocks, issues, fault)."""

    name: str
    suffixes: tuple[str, ...]
    read: Callable[[Column], Column]


def _result(blocks: Column, issues: Column, fault: Column) -> Column:
    return F.struct(blocks.cast(BLOCK).alias("blocks"), F.coalesce(issues, F.array().cast("array<string>")).alias("issues"), fault.cast("string").alias("fault"))


def _lines(texts: Column) -> Column:
    return F.transform(texts, lambda t, i: F.struct(i.alias("pos"), F.lit(0).alias("level"), t.alias("text")))


def _txt(content: Column) -> Column:
    d = decode_text(content, TextProfile())
    return _result(_lines(F.split(F.regexp_replace(d["text"], "\r\n|\r", "\n"), "\n", -1)), F.array().cast("array<string>"), d["reason"])


def _html(content: Column) -> Column:
    d = decode_text(content, TextProfile())
    h = read_html(d["text"], "blocks", "issues")
    return _result(F.transform(h["blocks"], lambda b: F.struct(b["pos"].alias("pos"), b["level"].alias("level"), b["text"].alias("text"))), F.transform(h["issues"], lambda i: F.concat_ws(": ", i["code"], i["message"])), d["reason"])


def _tex(content: Column) -> Column:
    d = decode_text(content, TextProfile(encoding="utf-8"))
    t = read_tex(d["text"])
    return _result(F.transform(t["blocks"], lambda b: F.struct(b["pos"].alias("pos"), b["level"].alias("level"), b["text"].alias("text"))), t["issues"], d["reason"])


def _epub(content: Column) -> Column:
    e = read_epub(content)
    return _result(F.transform(e["blocks"], lambda b, i: F.struct(i.alias("pos"), b["level"].alias("level"), b["text"].alias("text"))), e["losses"], e["fault"])


def _docx(content: Column) -> Column:
    d = read_docx(content)
    rows = F.transform(F.flatten(d["tables"]), lambda r: F.array_join(r, " | "))
    return _result(_lines(F.concat(d["paragraphs"], rows)), F.array().cast("array<string>"), d["fault"])


def _pptx(content: Column) -> Column:
    p = read_pptx(content)
    return _result(_lines(p["slides"]), F.array().cast("array<string>"), p["fault"])


def _facts(read: Callable[[Column], Column], shown: Callable[[Column], Column]) -> Callable[[Column], Column]:
    def run(content: Column) -> Column:
        r = read(content)
        return _result(_lines(shown(r["value"])), F.array().cast("array<string>"), r["fault"])

    return run


def _pairs(m: Column) -> Column:
    return F.transform(F.map_entries(m), lambda e: F.concat_ws("=", e["key"], e["value"]))


@dataclass
class Registry:
    """Formats by name and suffix; both are unique."""

    formats: dict[str, Format] = field(default_factory=dict)
    suffixes: dict[str, str] = field(default_factory=dict)

    def register(self, fmt: Format) -> Registry:
        if fmt.name in self.formats or any(s in self.suffixes for s in fmt.suffixes):
            raise ValueError(f"{fmt.name} or one of {fmt.suffixes} is registered already")
        self.formats[fmt.name] = fmt
        self.suffixes |= dict.fromkeys(fmt.suffixes, fmt.name)
        return self

    def files(self, spark: SparkSession, path: str, recursive: bool = True, glob: str | None = None) -> DataFrame:
        """(path, modificationTime, length, content, format); the format is by suffix, null for others."""
        reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
        return self.typed((reader.option("pathGlobFilter", glob) if glob else reader).load(path))

    def typed(self, files: DataFrame) -> DataFrame:
        """Add ``format`` by the path's suffix, null for others."""
        names = F.create_map(*[x for k, v in self.suffixes.items() for x in (F.lit(k), F.lit(v))])
        return files.withColumn("format", F.try_element_at(names, F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))))

    def read(self, files: DataFrame, most_bytes: int = 10 << 20) -> DataFrame:
        """(path, format, blocks, issues, fault). Too large files and unknown formats are refused unread: the
        scan that reads contents has a filter on ``length`` and ``format``, the other one reads no content.

        Contents are read once, in one pass: each format's reader gets those of its own files and nulls for
        all others."""
        wanted = (F.col("length") <= most_bytes) & F.col("format").isNotNull()
        rows = files.where(wanted).select("path", "format", "content")
        found = F.lit(None).cast(f"struct<blocks: {BLOCK}, issues: array<string>, fault: string>")
        for fmt in self.formats.values():
            own = F.when(F.col("format") == fmt.name, F.col("content"))
            found = F.when(F.col("format") == fmt.name, fmt.read(own)).otherwise(found)
        read = rows.select("path", "format", found.alias("_r")).select("path", "format", "_r.blocks", "_r.issues", "_r.fault")
        refused = F.when(F.col("length") > most_bytes, "too-large").otherwise("unknown-format")
        none = lambda kind: F.lit(None).cast(kind)
        rest = files.where(~F.coalesce(wanted, F.lit(False))).select("path", "format", none(BLOCK).alias("blocks"), none("array<string>").alias("issues"), refused.alias("fault"))
        return read.unionByName(rest)


def default_registry() -> Registry:
    r = Registry()
    for fmt in (
        Format("txt", (".txt",), _txt), Format("html", (".html", ".htm", ".xhtml"), _html), Format("tex", (".tex",), _tex), Format("epub", (".epub",), _epub), Format("docx", (".docx",), _docx), Format("pptx", (".pptx",), _pptx),
        Format("pdf", (".pdf",), _facts(read_pdf_info, _pairs)), Format("png", (".png",), _facts(read_png_header, _pairs)),
        Format("font", (".ttf", ".otf", ".ttc"), _facts(read_sfnt, lambda v: F.transform(v, lambda t: t["tag"]))), Format("cfbf", (".doc", ".xls", ".ppt", ".msg"), _facts(read_cfbf, lambda v: F.transform(v, lambda s: s["path"]))),
    ):
        r.register(fmt)
    return r


def file_table(files: DataFrame) -> DataFrame:
    """(path, name, suffix, size_mb, modified) without reading any content; sort by ``name, path`` to list them."""
    name = F.element_at(F.split("path", "/"), -1)
    return files.select("path", name.alias("name"), F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).alias("suffix"), F.round(F.col("length") / 1048576, 2).alias("size_mb"), F.col("modificationTime").alias("modified"))


