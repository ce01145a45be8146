"""ZIP archives as tables, behind limits that are checked before anything is inflated."""

from __future__ import annotations

import io
import posixpath
import urllib.parse
import zipfile
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ArchiveLimits:
    entries: int = 10_000
    total: int = 1 << 30
    ratio: float = 200.0


def unsafe(name: str) -> bool:
    """Absolute names, drive letters, parent steps, control characters."""
    flat = name.replace("\\", "/")
    return flat.startswith("/") or flat[1:2] == ":" or ".." in flat.split("/") or any(ord(c) < 32 for c in name)


def fault(archive: zipfile.ZipFile, limits: ArchiveLimits) -> str | None:
    infos = archive.infolist()
    if len(infos) > limits.entries:
        return "too-many-entries"
    if sum(i.file_size for i in infos) > limits.total:
        return "too-large"
    if any(i.file_size > limits.ratio * max(i.compress_size, 1) for i in infos):
        return "suspicious-ratio"
    if any(unsafe(i.filename) for i in infos):
        return "unsafe-name"
    return None


def members(data: bytes, limits: ArchiveLimits = ArchiveLimits()) -> dict[str, bytes]:
    """All files of an archive that is within the limits; a fault is a ValueError."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            if reason := fault(z, limits):
                raise ValueError(reason)
            return {i.filename: z.read(i) for i in z.infolist() if not i.is_dir()}
    except (zipfile.BadZipFile, NotImplementedError, RuntimeError, EOFError) as e:
        raise ValueError("not-an-archive") from e


_ENTRY = pa.struct([("name", pa.string()), ("size", pa.int64()), ("stored", pa.int64()), ("crc32", pa.int64()), ("is_dir", pa.bool_())])


def read_entries(content: Column) -> Column:
    """array of (name, size, stored, crc32, is_dir) from the directory alone; null for what isn't an archive."""

    def run(rows: pa.Array) -> pa.Array:
        out = []
        for b in rows.to_pylist():
            try:
                with zipfile.ZipFile(io.BytesIO(b or b"")) as z:
                    out.append([{"name": i.filename, "size": i.file_size, "stored": i.compress_size, "crc32": i.CRC, "is_dir": i.is_dir()} for i in z.infolist()])
            except zipfile.BadZipFile:
                out.append(None)
        return pa.array(out, pa.list_(_ENTRY))

    return F.arrow_udf(run, "array<struct<name: string, size: bigint, stored: bigint, crc32: bigint, is_dir: boolean>>")(content)


def check_archives(docs: DataFrame, row_id: str, content: str = "content", limits: ArchiveLimits = ArchiveLimits()) -> DataFrame:
    """(row_id, n_entries, total, worst_ratio, fault): the gate as expressions over the entries."""
    e = docs.select(row_id, read_entries(F.col(content)).alias("_e"))
    total = F.aggregate("_e", F.lit(0).cast("long"), lambda a, x: a + x["size"])
    ratio = F.array_max(F.transform("_e", lambda x: x["size"] / F.greatest(x["stored"], F.lit(1))))
    bad = F.exists("_e", lambda x: x["name"].rlike(r"^[/\\]|^.:|(^|[/\\])\.\.([/\\]|$)|[\x00-\x1f]"))
    reason = F.when(F.col("_e").isNull(), "not-an-archive").when(F.size("_e") > limits.entries, "too-many-entries").when(total > limits.total, "too-large").when(ratio > limits.ratio, "suspicious-ratio").when(bad, "unsafe-name")
    return e.select(row_id, F.when(F.col("_e").isNotNull(), F.size("_e")).alias("n_entries"), total.alias("total"), ratio.alias("worst_ratio"), reason.alias("fault"))


def archive_parts(docs: DataFrame, row_id: str, content: str = "content", limits: ArchiveLimits = ArchiveLimits()) -> DataFrame:
    """(row_id, name, content, fault): every file; one row with a fault where the archive is refused."""
    part = pa.struct([("name", pa.string()), ("content", pa.binary()), ("fault", pa.string())])

    def run(rows: pa.Array) -> pa.Array:
        out = []
        for b in rows.to_pylist():
            try:
                out.append([{"name": n, "content": c, "fault": None} for n, c in members(b or b"", limits).items()])
            except ValueError as e:
                out.append([{"name": None, "content": None, "fault": str(e)}])
        return pa.array(out, pa.list_(part))

    found = F.arrow_udf(run, "array<struct<name: string, content: binary, fault: string>>")(F.col(content))
    return docs.select(row_id, F.explode(found).alias("_p")).select(row_id, "_p.*")


def resolve_target(owner: str, target: str) -> str:
    """The part that a relationship's target names, from its owner; ValueError for what leaves the package."""
    if any(ord(c) < 32 for c in target) or "\\" in target:
        raise ValueError("bad target")
    url = urllib.parse.urlsplit(target)
    if url.scheme or url.netloc or url.query or "%2f" in url.path.lower() or "%5c" in url.path.lower():
        raise ValueError("bad target")
    if not url.path:
        return owner
    path = urllib.parse.unquote(url.path)
    full = path if path.startswith("/") else posixpath.join(posixpath.dirname(owner), path)
    steps: list[str] = []
    for s in full.split("/"):
        if s == "..":
            if not steps:
                raise ValueError("above the root")
            steps.pop()
        elif s not in ("", "."):
            steps.append(s)
    return "/" + "/".join(steps)


def build_archive(files: list[tuple[str, bytes]], stored: tuple[str, ...] = ()) -> bytes:
    """A reproducible archive: given order, fixed dates; ``stored`` names aren't compressed, and neither is what
    shrinks so far that the readers' limits would refuse it."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in files:
            info = zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0))
            info.compress_type = zipfile.ZIP_STORED if name in stored else zipfile.ZIP_DEFLATED
            z.writestr(info, data)
        tight = tuple(i.filename for i in z.infolist() if i.file_size > ArchiveLimits.ratio * max(i.compress_size, 1))
    return build_archive(files, (*stored, *tight)) if tight else out.getvalue()
