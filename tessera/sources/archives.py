"""Archives within archives: zips of pictures and further zips, read to a bounded depth, narrowed by a manifest.

A reader takes any table of binary contents, such as spark.read.format("binaryFile").  Members come out as rows of their own
while an archive is walked, so a task holds one archive and one member at a time.
"""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator
from pathlib import PurePosixPath

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

# Pictures that are taken, and how deep archives may lie in each other
PICTURES = (".png", ".jpg", ".jpeg", ".webp")
DEEPEST = 5
#: Bytes of a member and members of an archive at most; what is beyond is told by status, not read.
MOST_BYTES, MOST_MEMBERS = 64 << 20, 100_000
MEMBERS = "label string, ext string, depth int, status string, bytes long, content binary"
_TYPES = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.int64(), pa.binary()]
Member = tuple[str, str | None, int, str, int | None, bytes | None]


def _wanted(archive: zipfile.ZipFile) -> set[str] | None:
    """File names of the archive's manifest; None without one that names any."""
    try:
        items = json.loads(archive.read("manifest.json"))["items"]
        names = {str(item.get("file") or "").strip() for item in items} - {""}
    except (KeyError, ValueError, TypeError, AttributeError, RuntimeError, NotImplementedError, zipfile.BadZipFile):
        return None
    return names or None


def _read(archive: zipfile.ZipFile, name: str, most: int) -> bytes | None:
    """A member's bytes; None beyond most, whatever its header declares."""
    with archive.open(name) as f:
        data = f.read(most + 1)
    return data if len(data) <= most else None


def members(data: bytes, label: str, depth: int = 0, deepest: int = DEEPEST, most_bytes: int = MOST_BYTES, most_members: int = MOST_MEMBERS) -> Iterator[Member]:
    """Pictures of an archive and of those in it, in the order of names: label::name, and label>inner::name further in.

    A manifest.json that names files narrows the pictures of its own archive.  status is ok, damaged, too_large, too_many or
    too_deep (these without content).
    """
    if depth > deepest:
        yield label, None, depth, "too_deep", len(data), None
        return
    try:
        archive = zipfile.ZipFile(io.BytesIO(data))
    except (zipfile.BadZipFile, ValueError, NotImplementedError):
        yield label, None, depth, "damaged", len(data), None
        return
    names = sorted({i.filename for i in archive.infolist() if not i.is_dir()})
    if len(names) > most_members:
        yield label, None, depth, "too_many", len(names), None
        return
    wanted = _wanted(archive)
    for name in names:
        base = PurePosixPath(name).name
        ext = PurePosixPath(base).suffix.lower()
        picture, inner = ext in PICTURES and (wanted is None or base in wanted), ext == ".zip"
        if not picture and not inner:
            continue
        try:
            content = _read(archive, name, most_bytes)
        except (zipfile.BadZipFile, ValueError, RuntimeError, NotImplementedError, EOFError, OSError):
            yield f"{label}::{name}", ext, depth, "damaged", None, None
            continue
        if content is None:
            yield f"{label}::{name}", ext, depth, "too_large", None, None
        elif inner:
            yield from members(content, f"{label}>{name}", depth + 1, deepest, most_bytes, most_members)
        else:
            yield f"{label}::{name}", ext, depth, "ok", len(content), content


def read_archives(files: DataFrame, path: str = "path", content: str = "content", deepest: int = DEEPEST) -> DataFrame:
    """(label, ext, depth, status, bytes, content) of files' archives; null contents are skipped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for label, data in zip(batch.column(0), batch.column(1), strict=True):
                if not data.is_valid:
                    continue
                for member in members(data.as_py(), label.as_py() or "", deepest=deepest):
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(member, _TYPES, strict=True)], names=["label", "ext", "depth", "status", "bytes", "content"])

    return files.select(path, content).mapInArrow(run, MEMBERS)


def archive_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of the zips under a folder, hidden ones left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "[!.]*.zip").load(path)
    return files.selectExpr("element_at(split(path, '/'), -1) AS path", "content")


def zipped(entries: list[tuple[str, bytes]]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        for name, content in entries:
            archive.writestr(zipfile.ZipInfo(name), content)
    return out.getvalue()
