"""Writers by name, and conversions: files of any format that can be read to any that can be written."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.sources import build, sinks
from quire.sources.registry import Registry, default_registry


@dataclass(frozen=True)
class ImportOptions:
    """What is read: the largest file, and the formats (all where empty)."""

    most_bytes: int = 10 << 20
    formats: frozenset[str] = frozenset()


@dataclass(frozen=True)
class ExportOptions:
    """Whether documents whose reading failed are left out or end the export."""

    strict: bool = False


@dataclass(frozen=True)
class Exporter:
    """``render``: blocks (row_id, pos, text, level, list_level, lang) to (row_id, content)."""

    name: str
    suffix: str
    render: Callable[[DataFrame, str], DataFrame]


@dataclass
class Exporters:
    """Writers by name; names and suffixes are unique."""

    known: dict[str, Exporter] = field(default_factory=dict)

    def register(self, exporter: Exporter) -> Exporters:
        if exporter.name in self.known or any(e.suffix == exporter.suffix for e in self.known.values()):
            raise ValueError(f"{exporter.name} or {exporter.suffix} is registered already")
        self.known[exporter.name] = exporter
        return self

    def render(self, blocks: DataFrame, row_id: str, name: str) -> DataFrame:
        """(row_id, content) in the format of that name; an unknown one is an error that names the known ones."""
        if name not in self.known:
            raise ValueError(f"no exporter {name!r}; known: {', '.join(sorted(self.known))}")
        return self.known[name].render(blocks, row_id)

    def write(self, spark: SparkSession, blocks: DataFrame, row_id: str, name: str, path: str) -> str:
        """Rendered documents published at ``path`` at once."""
        return sinks.publish(spark, self.render(blocks, row_id, name), path)

    def convert(self, files: DataFrame, name: str, registry: Registry | None = None, read: ImportOptions = ImportOptions(), write: ExportOptions = ExportOptions()) -> DataFrame:
        """(path, content, fault) of files (path, length, content, format): the path with the new suffix. A file with a
        fault has no content; with ``strict``, one is an error when the result is computed."""
        registry = registry or default_registry()
        wanted = files.where(F.col("format").isin(*read.formats)) if read.formats else files
        found = registry.read(wanted, read.most_bytes)
        fault = F.when(F.col("fault").isNotNull(), F.raise_error(F.concat_ws(": ", "path", "fault"))).otherwise(F.lit(None).cast("string")) if write.strict else F.col("fault")
        blocks = found.where("fault IS NULL").select("path", F.inline("blocks")).withColumns({"list_level": F.lit(None).cast("int"), "lang": F.lit(None).cast("string")})
        made = self.render(blocks, "path", name)
        renamed = F.concat(F.regexp_replace("path", r"\.[^./]+$", ""), F.lit(self.known[name].suffix))
        # a file counts as a hundred bytes where sizes are estimated, so the contents would be broadcast
        return found.select("path", fault.alias("fault")).join(made.hint("merge"), "path", "left").select(renamed.alias("path"), "content", "fault")


def default_exporters() -> Exporters:
    """Text, JSON, HTML, LaTeX, EPUB and DOCX."""
    out = Exporters()
    docx = lambda blocks, row_id: build.to_docx(blocks.withColumn("cells", F.lit(None).cast("array<array<string>>")), row_id)
    for e in (Exporter("txt", ".txt", sinks.to_text), Exporter("json", ".json", sinks.to_json), Exporter("html", ".html", sinks.to_html), Exporter("latex", ".tex", sinks.to_latex), Exporter("epub", ".epub", sinks.to_epub), Exporter("docx", ".docx", docx)):
        out.register(e)
    return out
