"""WARC archives: records written as whole-file gzip streams, the normaliser that gives every record a member of its own, and its offset index.

All files go through Spark's own readers and writers, so archives can lie in any store and a repeated task leaves no second
copy. A record block ends with two line ends, which is also what the text writer puts after a row. A gzip member ends with
the high byte of its length, which is zero below 16 MB; the normaliser writes members without that byte and has the writer add it as the
line end, so that members follow each other without a gap.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from collections.abc import Iterator
from itertools import repeat

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from doclake.llm.common import stored
from doclake.session import ship_with_tasks

ship_with_tasks(__name__)

# The record format.
VERSION, CRLF = "WARC/1.1", "\r\n"
IDENTICAL_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payloads from this many bytes on are stored once.
LEAST_SHARED = 1000
#: Compressed bytes after which the normaliser begins another archive; one archive is read as one cell.
ARCHIVE_BYTES = 32 << 20
#: Bits of the table that keeps payloads without copies from being shuffled: 1 MB.
BITMAP = 1 << 23
EMPTY_MEMBER = bytes.fromhex("1f8b08000000000000030300") + bytes(8)
LEVEL = 4

INDEX = T.StructType([T.StructField(n, t) for n, t in (
    ("offset", T.LongType()), ("length", T.LongType()), ("record_type", T.StringType()), ("record_id", T.StringType()), ("uri", T.StringType()),
    ("refers_to", T.StringType()), ("payload_digest", T.StringType()))])


# ------------------------------------------------------------------------------------------------------- writing


def record_id(id: Column) -> Column:
    """The record id of a row; rows without an id share one."""
    return F.concat(F.lit("<urn:page:"), F.coalesce(id.cast("string"), F.lit("")), F.lit(">"))


def may_be_in(digest: Column, digests: DataFrame, column: str) -> tuple[DataFrame, Column]:
    """A table of at most ``BITMAP`` bits in which every digest of ``digests`` has one, to be broadcast, and the bit's place for ``digest``."""
    def place(x: Column) -> Column:
        return F.pmod(F.xxhash64(x), F.lit(BITMAP))

    at = place(F.col(column))
    bits = digests.groupBy(F.bitmap_bucket_number(at).alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("_bits"))
    return bits, place(digest)


def with_revisits(pages: DataFrame, id: str, payload: str, least_bytes: int = LEAST_SHARED) -> DataFrame:
    """``pages`` plus ``_payload, _digest, _first``: the greatest id with an equal payload.

    Of equal payloads of at least ``least_bytes`` bytes the row with the greatest id holds the payload, the others refer to
    it; ``_first`` is null for rows that hold their own. Digests are combined before they are shuffled. Payloads move only
    where a bitmap of fixed size cannot rule out a copy; when it fills up more of them do, and results stay the same.
    The join has one row a digest on one side, so the adaptive skew join can split a payload that many rows have.
    """
    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    rows = pages.withColumn("_payload", body).withColumn("_digest", F.sha1("_payload"))
    big = F.octet_length("_payload") >= least_bytes
    holders = rows.where(big).groupBy("_digest").agg(F.max(id).alias("_first"), F.count("*").alias("_copies")).where("_copies > 1").drop("_copies")
    holders = stored(holders, "warc-holders")
    bits, at = may_be_in(F.col("_digest"), holders, "_digest")  # BITMAP bits at most, in rows of 4 KB
    marked = rows.withColumn("_at", F.when(big, at)).withColumn("_bucket", F.bitmap_bucket_number("_at")).join(F.broadcast(bits), "_bucket", "left")
    place = F.bitmap_bit_position("_at")
    byte = F.conv(F.hex(F.substring("_bits", (place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    copied = F.coalesce(F.pmod(F.floor(byte / F.pow(F.lit(2), F.pmod(place, F.lit(8)))), F.lit(2)) == 1, F.lit(False))
    marked = marked.withColumn("_copied", copied).drop("_at", "_bucket", "_bits")
    shared = marked.where("_copied").join(holders, "_digest", "left").select(*rows.columns, F.when(~F.col(id).eqNullSafe(F.col("_first")), F.col("_first")).alias("_first"))
    return shared.unionByName(marked.where("not _copied").drop("_copied").withColumn("_first", F.lit(None).cast(pages.schema[id].dataType)))


def warc_records(pages: DataFrame, id: str, uri: str, payload: str, least_bytes: int = LEAST_SHARED, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """``record``: the bytes of one WARC record for every row, without the two line ends behind it.

    A null payload is empty, a null URI leaves its header out; line ends in a URI become blanks. Rows that share the greatest
    id of a payload all hold it, and rows without an id refer to a row that has one. Other columns are not read; their
    names may clash with nothing, since only ``id``, ``uri`` and ``payload`` are taken.
    """
    rows = with_revisits(pages.select(F.col(id).alias("id"), F.col(uri).cast("string").alias("uri"), F.col(payload).alias("payload")), "id", "payload", least_bytes).drop("payload")
    revisit = F.col("_first").isNotNull()
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.octet_length("_payload"), F.lit(CRLF + CRLF)).cast("binary")
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("_payload")))

    def line(name: str, value: Column) -> Column:
        return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)), F.lit(""))

    head = F.concat(
        F.lit(VERSION + CRLF), line("WARC-Type", F.when(revisit, "revisit").otherwise("response")), line("WARC-Record-ID", record_id(F.col("id"))),
        line("WARC-Target-URI", F.regexp_replace("uri", r"[\r\n]", " ")), F.lit(f"WARC-Date: {date}{CRLF}"), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "_digest")),
        line("WARC-Refers-To", F.when(revisit, record_id(F.col("_first")))), line("WARC-Profile", F.when(revisit, IDENTICAL_PAYLOAD)),
        F.lit(f"Content-Type: application/http; msgtype=response{CRLF}"), line("Content-Length", F.octet_length("block").cast("string")), F.lit(CRLF))
    return rows.withColumn("block", block).select(F.concat(head.cast("binary"), "block").alias("record"))


def write_monolithic(records: DataFrame, folder: str) -> None:
    """``record`` rows as WARC archives: one file a partition, each one gzip stream over all its records."""
    records.select(F.col("record").cast("string")).write.option("lineSep", CRLF + CRLF).option("compression", "gzip").text(folder)


# --------------------------------------------------------------------------------------------------- normalising


def header_fields(head: bytes) -> dict[str, str]:
    """Header fields with names in lower case; the first of a name counts, a line that starts with a blank goes on with the line before it."""
    lines = re.sub(rb"\r?\n[ \t]+", b" ", head).decode("utf-8", "replace").split("\n")
    fields: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if colon:
            fields.setdefault(name.strip().lower(), value.strip())
    return fields


class Records:
    """Cuts lines, as they come from one archive, into records.

    A record is its header up to an empty line, as many bytes as Content-Length says, and the line ends behind them. What is
    no record (damaged bytes, a header without a length) is a record of its own up to the next line that starts one.
    """

    def __init__(self):
        self.parts: list[bytes] = []
        self.missing = -1  # bytes of the block still to come; -1 in a header, -2 outside of records
        self.head: bytes | None = None

    def feed(self, line: bytes) -> tuple[bytes | None, bytes] | None:
        """The record that ends before or with this line (with its line end), as (header or None, bytes)."""
        done = None
        if self.missing <= 0 and self.head is not None:  # line ends behind a block
            if not line.strip(b"\r\n"):
                return None
            done = self.finish()
        if self.head is None and self.missing != 0:
            if line.startswith(b"WARC/") and (self.missing == -2 or not self.parts):
                done = done or self.finish()
                self.missing = -1
            elif not self.parts and not line.strip(b"\r\n"):
                return done  # empty lines between records
            elif not self.parts:
                self.missing = -2
            self.parts.append(line)
            if self.missing == -1 and not line.strip(b"\r\n"):
                head = b"".join(self.parts)
                length = header_fields(head).get("content-length", "")
                if length.isascii() and length.isdigit():
                    self.head, self.missing = head, int(length)
                else:
                    self.missing = -2
            return done
        self.parts.append(line)
        self.missing -= len(line)
        if self.missing < 0:  # the block ends inside this line; what follows it are line ends
            tail = self.parts[-1][self.missing:]
            if tail.strip(b"\r\n"):  # the stated length was wrong: the bytes stay what they are
                self.head, self.missing = None, -2
            else:
                self.parts[-1] = self.parts[-1][: self.missing]
                self.missing = 0
        return done

    def finish(self) -> tuple[bytes | None, bytes] | None:
        """What is left at the end of an archive. A block that ends too early is no record."""
        out = None
        if self.parts:
            whole = b"".join(self.parts)
            out = (self.head if self.missing <= 0 else None, whole)
        self.parts, self.head, self.missing = [], None, -1
        return out


def member(record: bytes, level: int) -> bytes:
    """One gzip member; an empty one follows where the last byte would not be zero."""
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    out = packer.compress(record) + packer.flush()
    return out if out[-1] == 0 else out + EMPTY_MEMBER


def entry(head: bytes | None, offset: int, length: int) -> dict:
    fields = header_fields(head) if head else {}
    return {"offset": offset, "length": length, "record_type": fields.get("warc-type") if head else "damaged", "record_id": fields.get("warc-record-id"),
            "uri": fields.get("warc-target-uri"), "refers_to": fields.get("warc-refers-to"), "payload_digest": fields.get("warc-payload-digest")}


def rewrite(batches: Iterator[pa.RecordBatch], most_bytes: int, level: int) -> Iterator[pa.RecordBatch]:
    """Lines of archives, in order → (archive, kind, seq, value): members and their index entries, each without its last byte zero."""
    out: list[list] = [[], [], [], []]
    held = 0
    path, reader, part, offset, seq = None, Records(), 0, 0, 0

    def flush():
        nonlocal out, held
        done = pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.binary())], ["archive", "kind", "seq", "value"])
        out, held = [[], [], [], []], 0
        return done

    def add(found):
        nonlocal part, offset, seq, held
        head, whole = found
        packed = member(whole + b"\r\n\r\n" if head else whole, level)
        if offset and offset + len(packed) > most_bytes:
            part, offset = part + 1, 0
        archive = f"{archive_name(path)}-{part:05d}"
        index = json.dumps(entry(head, offset, len(packed)), ensure_ascii=False).encode("utf-8", "replace")
        for kind, value in (("records", packed[:-1]), ("index", index)):
            for column, x in zip(out, (archive, kind, seq, value)):
                column.append(x)
        offset, seq, held = offset + len(packed), seq + 1, held + len(packed)

    for batch in batches:
        if not batch.num_rows:
            continue
        paths, lines = batch.column("path"), batch.column("line").to_pylist()
        one = paths[0] == paths[-1]  # an archive's lines come together
        for line, now in zip(lines, repeat(paths[0].as_py()) if one else paths.to_pylist()):
            if now != path:
                if found := reader.finish():
                    add(found)
                path, part, offset, seq = now, 0, 0, 0
            if found := reader.feed(line + b"\n"):
                add(found)
                if held > 8 << 20:
                    yield flush()
    if found := reader.finish():
        add(found)
    yield flush()


def archive_name(path: str) -> str:
    """The file's name without its endings, and what tells it from files of the same name elsewhere."""
    stem = re.sub(r"[^A-Za-z0-9_-]", "_", path.rsplit("/", 1)[-1].split(".", 1)[0])
    return f"{stem}-{hashlib.sha1(path.encode()).hexdigest()[:8]}"


def normalize(spark: SparkSession, source: str, out: str, most_bytes: int = ARCHIVE_BYTES, level: int = LEVEL) -> None:
    """Archives below ``source`` (gzip files: one stream, or members of any cut) → below ``out`` archives with a member for each record and their index.

    Each stream is inflated once, as lines, so memory holds one record at a time whatever the archive's size. Output lies in
    ``archive=<name>/kind=records`` and ``archive=<name>/kind=index``; an archive begins a new part after ``most_bytes``.
    An index entry is a JSON object ended by a zero byte: offset and length of the member, type, ids, URI and digest. What
    is no record is kept as a member of type ``damaged``, with a line end where its last line had none; a block that lacks just
    one byte at the very end of an archive is taken as ended by it. An empty archive gives nothing.
    """
    lines = spark.read.option("lineSep", "\n").option("pathGlobFilter", "*.gz").text(source).select(F.col("_metadata.file_path").alias("path"), F.col("value").cast("binary").alias("line"))
    rows = lines.mapInArrow(lambda b: rewrite(b, most_bytes, level), "archive string, kind string, seq long, value binary")
    rows = rows.sortWithinPartitions("archive", "kind", "seq")  # what the writer of folders asks for, and the order inside them
    rows.select(F.col("value").cast("string"), "archive", "kind").write.option("lineSep", "\0").partitionBy("archive", "kind").text(out)


# ------------------------------------------------------------------------------------------------------- reading


def read_index(spark: SparkSession, out: str) -> DataFrame:
    """``archive, offset, length, record_type, record_id, uri, refers_to, payload_digest`` of every record."""
    schema = T.StructType([T.StructField("value", T.StringType()), T.StructField("archive", T.StringType()), T.StructField("kind", T.StringType())])
    rows = spark.read.schema(schema).option("lineSep", "\0").text(out).where("kind = 'index'")
    return rows.select("archive", F.from_json("value", INDEX).alias("e")).select("archive", "e.*")


def http_payload(record: bytes) -> bytes:
    """What a record's block holds, behind the HTTP header where it has one. What is no whole record stays as it is."""
    head, _, block = record.partition(b"\r\n\r\n")
    fields = header_fields(head)
    length = fields.get("content-length", "")
    if not head.startswith(b"WARC/") or not (length.isascii() and length.isdigit()) or len(block) != int(length) + 4:
        return record
    if fields.get("content-type", "").lower().startswith("application/http"):
        return block[:-4].partition(b"\r\n\r\n")[2]
    return block[:-4]


HEADERS = ["record_type", "record_id", "uri", "refers_to", "payload_digest"]


def archive_files(spark: SparkSession, out: str) -> DataFrame:
    """``archive, content`` of the normalised archives below ``out``; one archive is a cell of bounded size."""
    files = spark.read.format("binaryFile").load(out)
    if "kind" not in files.columns:  # no archive, no folders
        files = files.withColumns({"archive": F.lit(""), "kind": F.lit("")})
    return files.where("kind = 'records'").select(F.col("archive").cast("string"), "content")


def read_at(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            content, entries = batch.column("content")[i].as_py(), batch.column("entries")[i].as_py()
            out: list[list] = [[] for _ in range(8)]
            for e in sorted(entries, key=lambda e: e["offset"]):
                record = zlib.decompress(content[e["offset"]: e["offset"] + e["length"]], 31)
                payload = http_payload(record)
                for column, x in zip(out, (*(e[h] for h in HEADERS), len(payload), hashlib.sha1(payload).hexdigest(), payload)):
                    column.append(x)
            kinds = [*[pa.string()] * 5, pa.int64(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds)], [*HEADERS, "payload_bytes", "sha1", "payload"])


def read_records(spark: SparkSession, out: str, index: DataFrame | None = None) -> DataFrame:
    """Records of the normalised archives below ``out`` that ``index`` (rows of ``read_index``; all by default) names, each inflated alone from its offset.

    ``record_type, record_id, uri, refers_to, payload_digest`` are the headers', ``payload_bytes, sha1, payload`` those of the
    bytes that were found. Archives without a wanted record are not opened beyond the join that finds them.
    """
    index = read_index(spark, out) if index is None else index
    wanted = index.groupBy("archive").agg(F.collect_list(F.struct("offset", "length", *HEADERS)).alias("entries"))
    schema = "record_type string, record_id string, uri string, refers_to string, payload_digest string, payload_bytes long, sha1 string, payload binary"
    return archive_files(spark, out).join(wanted, "archive").mapInArrow(read_at, schema)


def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(archive, offset, length, payload_bytes, sha1) of every member."""
    for batch in batches:
        for i in range(batch.num_rows):
            archive, content, at = batch.column("archive")[i].as_py(), memoryview(batch.column("content")[i].as_py()), 0
            out: list[list] = [[] for _ in range(5)]
            while at < len(content):
                record, size = b"", 0
                while at + size < len(content) and (not size or content[at + size: at + size + len(EMPTY_MEMBER)] == EMPTY_MEMBER):
                    inflate = zlib.decompressobj(31)
                    part, first, step = [], at + size, 1 << 13  # small steps first: what follows a member is handed back
                    while not inflate.eof:
                        if first >= len(content):
                            raise ValueError(f"archive {archive} ends inside a member")
                        part.append(inflate.decompress(content[first: first + step]))
                        first, step = first + step, min(2 * step, 1 << 20)
                    size = min(first, len(content)) - len(inflate.unused_data) - at
                    record += b"".join(part)
                payload = http_payload(record)
                for column, x in zip(out, (archive, at, size, len(payload), hashlib.sha1(payload).hexdigest())):
                    column.append(x)
                at += size
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds)], ["archive", "offset", "length", "payload_bytes", "sha1"])


def record_facts(spark: SparkSession, out: str) -> DataFrame:
    """Like ``read_records`` for all records, but without payloads: archives are read where they lie, and only sizes and digests meet their index entries."""
    schema = "archive string, offset long, length long, payload_bytes long, sha1 string"
    found = archive_files(spark, out).mapInArrow(measure, schema)
    return found.join(read_index(spark, out), ["archive", "offset", "length"]).select(*HEADERS, "payload_bytes", "sha1")


def resolve_revisits(records: DataFrame) -> DataFrame:
    """``records`` with payload facts of revisits taken from the record that they refer to, found by its id and digest; nulls where there is none.

    One side of the join has one row a record, so the adaptive skew join can split a record that many others refer to.
    """
    full = F.coalesce(F.col("record_type") != "revisit", F.lit(True))
    facts = [c for c in records.columns if c in ("payload_bytes", "sha1", "payload")]
    same = [c for c in records.columns if c not in facts]
    holders = records.where(full).groupBy(F.col("record_id").alias("refers_to"), "payload_digest").agg(F.min(F.struct(*facts)).alias("held"))
    revisits = records.where(~full).select(*same).join(holders, ["refers_to", "payload_digest"], "left")
    return records.where(full).unionByName(revisits.select(*same, *[F.col(f"held.{c}") for c in facts]))
