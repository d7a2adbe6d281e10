"""Compressed files and archives → one row per member.

Only bytes are handled in Python, in Arrow batches inside the tasks; what the members mean is decided by Catalyst.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import lzma
import tarfile
import zipfile
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from doclake.functions.detect import GZ, TAR, XZ, ZIP, file_ext, has_signature
from doclake.session import ship_with_tasks

ship_with_tasks(__name__)

MEMBERS = "path string, member_no int, member string, content binary, error string"
INFLATED = T.StructType([T.StructField("content", T.BinaryType()), T.StructField("error", T.StringType())])
#: Bytes and rows that a task hands on at a time.
BATCH_BYTES, BATCH_ROWS = 4 << 20, 2_000
# Spark holds a binary value in one array.
MOST_CELL = (1 << 31) - 64


def _inflate(data: bytes) -> bytes:
    if data[:2] == b"\x1f\x8b":
        return gzip.decompress(data)
    if data[:6] == b"\xfd7zXZ\0":
        return lzma.decompress(data)
    return data


@F.pandas_udf(INFLATED)
def _inflate_udf(content: pd.Series) -> pd.DataFrame:
    out = []
    for data in content:
        try:
            out.append((None if data is None else _inflate(bytes(data)), None))
        except Exception as e:  # damaged input becomes a row with its error
            out.append((None, f"{type(e).__name__}: {e}"))
    return pd.DataFrame(out, columns=["content", "error"])


def decompress(files: DataFrame) -> DataFrame:
    """Replaces gz and xz ``content`` by what is inside; adds ``error``. Other rows never travel to Python."""
    packed = has_signature(F.col("content"), GZ + XZ)
    opened = files.withColumn("_packed", packed).withColumn("_out", _inflate_udf(F.when(F.col("_packed"), F.col("content"))))
    return opened.withColumn("content", F.when(F.col("_packed"), F.col("_out.content")).otherwise(F.col("content"))).withColumn(
        "error", F.col("_out.error")).drop("_packed", "_out")


def skip_member(name: Column) -> Column:
    """Members a zip carries for one desktop system only."""
    return (F.startswith(name, F.lit("__MACOSX/")) | F.contains(name, F.lit("/._"))
            | F.startswith(F.substring_index(name, "/", -1), F.lit("._")))


def _office_names(names: list[str]) -> bool:
    """Office packages name their content types, or start with their media type."""
    return "[Content_Types].xml" in names or names[:1] == ["mimetype"]


def _too_large(size: int) -> None:
    if size > MOST_CELL:
        raise ValueError(f"{size} bytes do not fit in one cell")


def _members(data: bytes) -> Iterator[tuple[str, bytes | Exception]]:
    """Names and bytes; a member that cannot be read comes with its error, the others stay."""
    if data[:2] == b"PK":
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            for info in z.infolist():
                name = info.filename
                if not info.is_dir() and not (name.startswith("__MACOSX/") or "/._" in name or name.split("/")[-1].startswith("._")):
                    try:
                        _too_large(info.file_size)
                        yield name, z.read(info)
                    except Exception as e:
                        yield name, e
    else:
        with tarfile.open(fileobj=io.BytesIO(data), mode="r:") as t:
            for info in t:
                if info.isfile():
                    try:
                        _too_large(info.size)
                        yield info.name, t.extractfile(info).read()
                    except Exception as e:
                        yield info.name, e


def _is_archive(data: bytes) -> bool:
    return data[:4] in (b"PK\x03\x04", b"PK\x05\x06", b"PK\x07\x08") or data[257:262] == b"ustar"


def _is_office(data: bytes) -> bool:
    if data[:2] != b"PK":
        return False
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        return _office_names(z.namelist())


def _walk(data: bytes, nested: bool) -> Iterator[tuple[str, bytes | Exception]]:
    """Members in order; with ``nested`` archives among them are opened in place, however deep they lie.

    The open archives are a stack. One that holds its own bytes again ends in an error instead of going on for ever.
    """
    stack = [("", _members(data), hashlib.sha256(data).digest())]
    while stack:
        prefix, members, _ = stack[-1]
        found = next(members, None)
        if found is None:
            stack.pop()
            continue
        name, body = found
        if not nested or isinstance(body, Exception):
            yield prefix + name, body
            continue
        try:
            inner = _inflate(body)
            _too_large(len(inner))
            if _is_archive(inner) and not _is_office(inner):
                mark = hashlib.sha256(inner).digest()
                if any(mark == above for _, _, above in stack):
                    raise ValueError("archive holds itself")
                stack.append((f"{prefix}{name}/", _guarded(_members(inner)), mark))
            else:
                yield prefix + name, inner
        except Exception as e:
            yield prefix + name, e


def _guarded(members: Iterator[tuple[str, bytes | Exception]]) -> Iterator[tuple[str, bytes | Exception]]:
    """A damaged inner archive is an error of its own, after the members it still gave."""
    try:
        yield from members
    except Exception as e:
        yield "", e


def in_batches(rows: Iterator[tuple], fields: list[tuple[str, pa.DataType]]) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches of bounded size; a value that is larger by itself travels alone."""
    held, size = [], 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*held), fields)], [n for n, _ in fields])

    for row in rows:
        more = sum(len(v) for v in row if isinstance(v, bytes))
        if held and (size + more > BATCH_BYTES or len(held) == BATCH_ROWS):
            yield batch()
            held, size = [], 0
        held.append(row)
        size += more
    if held:
        yield batch()


def _explode(nested: bool):
    fields = [("path", pa.string()), ("member_no", pa.int32()), ("member", pa.string()), ("content", pa.binary()), ("error", pa.string())]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content")):  # one archive at a time becomes an object
                path = path.as_py()
                try:
                    for n, (name, body) in enumerate(_walk(content.as_py(), nested)):
                        failed = isinstance(body, Exception)
                        yield path, n, name, None if failed else body, f"{type(body).__name__}: {body}" if failed else None
                except Exception as e:
                    yield path, None, None, None, f"{type(e).__name__}: {e}"

    return lambda batches: in_batches(rows(batches), fields)


def archive_members(files: DataFrame) -> DataFrame:
    """Zip and tar files → ``path, member_no, member, ext, content, error``; folders and desktop litter are dropped."""
    archives = files.select("path", "content").filter(has_signature(F.col("content"), ZIP + TAR))
    return archives.mapInArrow(_explode(False), MEMBERS).withColumn("ext", file_ext(F.col("member")))


def expand_nested(files: DataFrame) -> DataFrame:
    """Archives inside archives, and gz or xz members, opened in the same pass; paths of inner members are joined.

    Depth has no limit. A member that cannot be read, a damaged inner archive and an archive that holds itself are rows
    with their error.
    """
    archives = files.select("path", "content").filter(has_signature(F.col("content"), ZIP + TAR))
    return archives.mapInArrow(_explode(True), MEMBERS).withColumn("ext", file_ext(F.col("member")))


def package_parts(files: DataFrame) -> DataFrame:
    """Office packages → ``doc_id, part, content``."""
    return archive_members(files).select(F.col("path").alias("doc_id"), F.col("member").alias("part"), "content", "error")
