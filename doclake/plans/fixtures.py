"""Packages derived from table rows: templates filled by Spark, zipped per row inside the tasks."""

from __future__ import annotations

import gzip
import io
import lzma
import re
import tarfile
import zipfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doclake.operators.containers import in_batches
from doclake.session import ship_with_tasks

ship_with_tasks(__name__)


def xml_escape(value: Column) -> Column:
    for char, name in [("&", "amp"), ("<", "lt"), (">", "gt")]:
        value = F.replace(value, F.lit(char), F.lit(f"&{name};"))
    return value


def fill(template: str, columns: list[str]) -> Column:
    """Template with ``{column}`` marks → string column, values escaped."""
    pieces = re.split(r"\{(" + "|".join(columns) + r")\}", template)
    return F.concat(*[xml_escape(F.col(p).cast("string")) if i % 2 else F.lit(p) for i, p in enumerate(pieces)])


def _zip(entries) -> bytes:
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        for entry in entries:
            stored = entry["name"] == "mimetype"
            z.writestr(zipfile.ZipInfo(entry["name"]), bytes(entry["body"]), zipfile.ZIP_STORED if stored else zipfile.ZIP_DEFLATED)
    return buffer.getvalue()


def _tar(entries) -> bytes:
    buffer = io.BytesIO()
    with tarfile.open(fileobj=buffer, mode="w") as t:
        for entry in entries:
            info = tarfile.TarInfo(entry["name"])
            info.size = len(entry["body"])
            t.addfile(info, io.BytesIO(bytes(entry["body"])))
    return buffer.getvalue()


PACKERS = {"zip": _zip, "tar": _tar, "gz": lambda e: gzip.compress(bytes(e[0]["body"]), mtime=0), "xz": lambda e: lzma.compress(bytes(e[0]["body"]))}


def packed(batches):
    """``path, entries, kind`` → ``path, content``; one file's members at a time become objects."""
    def files():
        for batch in batches:
            for p, e, k in zip(*(batch.column(c) for c in ("path", "entries", "kind"))):
                e, k = e.as_py(), k.as_py()
                yield p.as_py(), e[0]["body"] if k == "raw" else PACKERS[k](e)

    return in_batches(files(), [("path", pa.string()), ("content", pa.binary())])


def pack(df: DataFrame, path: Column, parts: list[tuple[str | Column, Column]], kind: Column | str = "zip") -> DataFrame:
    """``path, content``: one file per row with the given members; a null body leaves a member out."""
    entries = F.filter(F.array(*[F.struct((F.lit(n) if isinstance(n, str) else n).alias("name"), b.cast("binary").alias("body")) for n, b in parts]),
                       lambda e: e["body"].isNotNull())
    rows = df.select(path.alias("path"), entries.alias("entries"), (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"))
    return rows.mapInArrow(packed, "path string, content binary")
