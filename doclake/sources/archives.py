"""Archives that are not read as a whole: their directories first, then the members, each by its place in the file.

A zip names its members at its end, a tar before each of them; both are read with a few seeks and without the contents. The
directory is a table of members, which are dealt out evenly, so one archive keeps all tasks busy and may be larger than a cell;
only its members must fit in one.
"""

from __future__ import annotations

import io
import tarfile
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doclake.functions.detect import detect_format, file_ext
from doclake.operators.containers import MOST_CELL, decompress, expand_nested, skip_member
from doclake.session import partition_count, ship_with_tasks, work_dir
from doclake.sources.files import open_store

ship_with_tasks(__name__)

DIRECTORY = "path string, member_no int, member string, kind string, offset long, stored long, size long, method int, crc long, error string"
STORED, DEFLATED = 0, 8
#: Bytes of contents that a task hands on at a time, and that it asks a store for at least.
BYTES_TOGETHER, BLOCK = 4 << 20, 1 << 16


class StoreFile(io.RawIOBase):
    """A store's file as the standard library wants one: a place before the start is an OSError."""

    def __init__(self, path: str):
        store, at = open_store(path)
        self.file = store.open_input_file(at)

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def seek(self, offset: int, whence: int = 0) -> int:
        at = offset + (0, self.file.tell() if whence == 1 else 0, self.file.size())[whence]
        if at < 0:
            raise OSError("a place before the start")
        self.file.seek(at)
        return at

    def tell(self) -> int:
        return self.file.tell()

    def readinto(self, out) -> int:
        data = self.file.read(len(out))
        out[: len(data)] = data
        return len(data)

    def close(self) -> None:
        if not self.closed:
            self.file.close()
        super().close()


def opened(path: str) -> io.BufferedReader:
    return io.BufferedReader(StoreFile(path), BLOCK)


def members_of(f, path: str) -> list[tuple]:
    """Rows of one archive's directory."""
    f.seek(0)
    head = f.read(262)
    f.seek(0)
    if head[:2] == b"PK":
        with zipfile.ZipFile(f) as z:
            return [(path, n, i.filename, "zip", i.header_offset, i.compress_size, i.file_size, i.compress_type, i.CRC, "encrypted" if i.flag_bits & 1 else None)
                    for n, i in enumerate(z.infolist()) if not i.is_dir()]
    if head[257:262] == b"ustar":
        with tarfile.open(fileobj=f, mode="r:") as t:
            return [(path, n, i.name, "tar", i.offset_data, i.size, i.size, STORED, None, "sparse" if i.issparse() else None) for n, i in enumerate(t) if i.isfile()]
    return []


def list_directories(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members of the archives that come as ``path``; one that cannot be read is a row with its error, other files give none."""
    kinds = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string()]
    names = [c.split()[0] for c in DIRECTORY.split(", ")]
    for batch in batches:
        for path in batch.column("path").to_pylist():
            try:
                with opened(path) as f:
                    rows = members_of(f, path)
            except Exception as e:
                rows = [(path, *[None] * 8, f"{type(e).__name__}: {e}")]
            for a in range(0, len(rows), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[a: a + 10_000]), kinds)], names)


def body_of(f, kind: str, offset: int, stored: int, size: int, method: int, crc: int | None) -> bytes:
    """One member's bytes from its place in the file."""
    if max(size, stored) > MOST_CELL:
        raise ValueError(f"{size} bytes do not fit in one cell")
    f.seek(offset)
    if kind == "zip":
        head = f.read(30)  # the local header repeats the name; its own lengths count
        if head[:4] != b"PK\x03\x04":
            raise zipfile.BadZipFile("Bad magic number for file header")
        f.seek(offset + 30 + int.from_bytes(head[26:28], "little") + int.from_bytes(head[28:30], "little"))
    data = f.read(stored)
    if len(data) != stored:
        raise EOFError("archive ends inside a member")
    if method == DEFLATED:
        inflate = zlib.decompressobj(-15)
        data = inflate.decompress(data) + inflate.flush()
    elif method != STORED:
        raise NotImplementedError(f"compression method {method}")
    if len(data) != size or (crc is not None and zlib.crc32(data) != crc):
        raise zipfile.BadZipFile("member differs from its directory entry")
    return data


def read_bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds ``content``; a member that cannot be read gets its error instead. A file stays open while its members follow each other."""
    path, f = None, None
    for batch in batches:
        first, data, errors, held = 0, [], [], 0
        for i, r in enumerate(batch.to_pylist()):
            body, error = None, r["error"]
            if error is None:
                try:
                    if r["path"] != path:
                        if f is not None:
                            f.close()
                        path, f = r["path"], opened(r["path"])
                    body = body_of(f, *(r[c] for c in ("kind", "offset", "stored", "size", "method", "crc")))
                except Exception as e:
                    error = f"{type(e).__name__}: {e}"
            data.append(body)
            errors.append(error)
            held += len(body or b"")
            if held > BYTES_TOGETHER or i == batch.num_rows - 1:
                part = batch.slice(first, len(data))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("path", "member_no", "member")), pa.array(data, pa.binary()), pa.array(errors, pa.string())], ["path", "member_no", "member", "content", "error"])
                first, data, errors, held = i + 1, [], [], 0
    if f is not None:
        f.close()


def archive_directory(files: DataFrame) -> DataFrame:
    """``path, member_no, member, kind, offset, stored, size, method, crc, error`` of the members of all zip and tar archives among ``files(path)``.

    Contents are neither read nor inflated. Folders, and in zips desktop litter, are dropped; an archive that cannot be opened is a row with its error.
    """
    rows = files.select("path").repartition(partition_count(files.sparkSession), "path").mapInArrow(list_directories, DIRECTORY)
    return rows.where(F.col("member").isNull() | (F.col("kind") == "tar") | ~skip_member(F.col("member")))


def read_members(directory: DataFrame) -> DataFrame:
    """``path, member_no, member, ext, content, error`` of the members that ``directory`` (rows of ``archive_directory``) names.

    Members are dealt by path and number: those of one archive go to all tasks, in the order in which they lie in it. Each
    opens the archive and reads its own range, so a lost task is repeated alone.
    """
    spark = directory.sparkSession
    dealt = directory.repartition(partition_count(spark), "path", "member_no").sortWithinPartitions("path", "offset")
    return dealt.mapInArrow(read_bodies, "path string, member_no int, member string, content binary, error string").withColumn("ext", file_ext(F.col("member")))


def scan_archives(files: DataFrame, nested: bool = False) -> DataFrame:
    """Members of the archives that ``files(path)`` names, as ``archive_members`` gives them, without an archive ever being a cell.

    The directory is written to the shared folder first. With ``nested`` compressed members are inflated and archives among them opened, as ``expand_nested`` does.
    """
    spark = files.sparkSession
    out = work_dir(spark, "directory")
    archive_directory(files).write.parquet(out)
    members = read_members(spark.read.schema(DIRECTORY).parquet(out))
    if not nested:
        return members
    # what members are decides where they go; it is worked out once
    fine = decompress(members.where("error is null").drop("error", "ext"))
    inner_archive = F.col("error").isNull() & detect_format(F.col("content"), F.nullif(file_ext(F.col("member")), F.lit(""))).isin("zip", "tar")
    fine = fine.withColumn("inner", F.coalesce(inner_archive, F.lit(False)))
    held = work_dir(spark, "members")
    fine.unionByName(members.where("error is not null").drop("ext").withColumn("inner", F.lit(False))).write.parquet(held)
    fine = spark.read.schema("path string, member_no int, member string, content binary, error string, inner boolean").parquet(held)
    named = fine.where("inner").select(F.concat("path", F.lit("\n"), "member_no", F.lit("\n"), "member").alias("path"), "content")
    inside = expand_nested(named).select(F.split("path", "\n", 3).alias("p"), "member", "content", "error")
    inside = inside.select(F.col("p")[0].alias("path"), F.col("p")[1].cast("int").alias("member_no"), F.concat_ws("/", F.col("p")[2], F.nullif("member", F.lit(""))).alias("member"), "content", "error")
    return fine.where("not inner").drop("inner").unionByName(inside).withColumn("ext", file_ext(F.col("member")))
