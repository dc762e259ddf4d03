"""Seekable Zstandard bundles of WARC records (operator 13).

``write`` turns rows into WARC/1.1 records and packs them into bundles, one
file each.  A bundle is a row of independent Zstandard frames, every one
holding whole records, then a skippable frame with the record map (record id ->
frame, offset within the decompressed frame, length), then the footer: a seek
table in the public seekable format (compressed size, decompressed size and
checksum of each frame).  Any Zstandard reader gives the plain WARC file; with
the footer one record costs one frame.

Tasks pack their rows into bundles of bounded size and Spark's text writer
stores each bundle as one file, byte for byte: the last four bytes of the
format, its magic number, are written as the line end.  So files go through
Spark's commit protocol to whatever store Spark reaches, and a lost executor's
half-written files are never seen.  ``read`` and ``index`` use Spark's binary
file source.

Rows whose payloads are equal and long enough are stored once: the row with the
smallest id is the response, others are revisits (profile identical payload
digest) with the HTTP header alone.  The smallest ids come from a grouped
minimum over digests; payloads are not shuffled unless more digests repeat than
``shared`` rows, and then the few digests that hold many rows are joined by
broadcast (their number has a bound), so none of them meets in one task.

Nulls: a null payload is empty; a null address is left out (characters that no
header holds are percent-encoded); a row with a null
id is a revisit if another row of its payload has an id, else a response.  Rows
that repeat both smallest id and payload are responses, each with its payload.
A payload of any length that a Spark row can hold is one record; it then has a
frame of its own.  An empty table gives an archive without records.  Columns
other than those named are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stages, as_bytes, importable, slices

# Numbers of the Zstandard seekable format and of the record map's own frame.
SEEK_FRAME, MAP_FRAME, SEEK_MAGIC = 0x184D2A5E, 0x184D2A50, 0x8F92EAB1
CHECKED = 0x80
# WARC header fields.
ID_SCHEME = "urn:x-page:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FRAME_BYTES, BUNDLE_BYTES = 1 << 20, 16 << 20
#: Rows of repeated digests (about 100 bytes each) that are broadcast; more are shuffled.
SHARED = 1 << 16
#: A digest with this share of all rows or more counts as hot; there are at most as many as its inverse.
HOT_SHARE = 1024
RECORD = ("record_id string, record_type string, target_uri string, refers_to string, payload_digest string, payload_bytes long, "
          "payload binary, file string, frame int, offset long, length long")
MAP = "record_id string, file string, frame int, frame_start long, frame_bytes long, offset long, length long"


# ----------------------------------------------------------------- records
def record(name: str, url: str | None, payload: bytes, digest: str, refers: str | None, date: str) -> bytes:
    """One WARC record: a response with its payload, or a revisit of ``refers`` without."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers is None else 'revisit'}", f"WARC-Record-ID: <{name}>", f"WARC-Date: {date}",
            f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response"]
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe="!#$%&'()*+,/:;=?@[]~"))
    if refers is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{refers}>"]
        payload = b""
    head.append(f"Content-Length: {len(http) + len(payload)}")
    return b"".join(["\r\n".join(head).encode(), b"\r\n\r\n", http, payload, b"\r\n\r\n"])


def _fields(lines: bytes) -> dict[str, str]:
    pairs = (line.split(":", 1) for line in lines.decode().split("\r\n")[1:])
    return {k.strip().lower(): v.strip() for k, v in pairs}


def parsed(data: bytes, start: int = 0) -> dict:
    """The record that begins at ``start``; ``payload`` is None for a revisit."""
    end = data.index(b"\r\n\r\n", start)
    head = _fields(data[start:end])
    body = end + 4
    stop = body + int(head["content-length"])
    http = data.index(b"\r\n\r\n", body, stop)
    size, digest = int(_fields(data[body:http])["content-length"]), head["warc-payload-digest"].removeprefix("sha256:")
    payload = None
    if head["warc-type"] == "response":
        payload = data[http + 4 : stop]
        if len(payload) != size or hashlib.sha256(payload).hexdigest() != digest:
            raise ValueError(f"payload of {head['warc-record-id']} does not have its digest")
    if data[stop : stop + 4] != b"\r\n\r\n":
        raise ValueError(f"record {head['warc-record-id']} does not end where its length says")
    return {"record_id": head["warc-record-id"].strip("<>"), "record_type": head["warc-type"], "target_uri": head.get("warc-target-uri"),
            "refers_to": head["warc-refers-to"].strip("<>") if "warc-refers-to" in head else None,
            "payload_digest": digest, "payload_bytes": size, "payload": payload, "offset": start, "length": stop + 4 - start}


# ----------------------------------------------------------------- bundles
class Bundle:
    """Frames, record map and seek table of one file while it is built."""

    def __init__(self, frame_bytes: int, level: int = 3):
        self.codec, self.frame_bytes = zstandard.ZstdCompressor(level=level, write_content_size=True), frame_bytes
        self.frames: list[bytes] = []
        self.table: list[tuple[int, int, int]] = []
        self.entries: list[tuple[str, int, int, int]] = []
        self.open: list[bytes] = []
        self.held = self.size = 0

    def add(self, name: str, data: bytes) -> None:
        if self.open and self.held + len(data) > self.frame_bytes:
            self.close_frame()
        self.entries.append((name, len(self.frames), self.held, len(data)))
        self.open.append(data)
        self.held += len(data)

    def close_frame(self) -> None:
        plain = b"".join(self.open)
        packed = self.codec.compress(plain)
        self.frames.append(packed)
        self.table.append((len(packed), len(plain), xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF))
        self.size += len(packed)
        self.open, self.held = [], 0

    def finished(self) -> bytes:
        if self.open:
            self.close_frame()
        listed = b"".join(struct.pack("<IQQH", f, at, n, len(b := name.encode())) + b for name, f, at, n in self.entries)
        listed = self.codec.compress(listed)
        self.frames.append(struct.pack("<II", MAP_FRAME, len(listed)) + listed)
        self.table.append((len(listed) + 8, 0, xxhash.xxh64_intdigest(b"") & 0xFFFFFFFF))
        rows = b"".join(struct.pack("<III", *row) for row in self.table)
        footer = struct.pack("<IBI", len(self.table), CHECKED, SEEK_MAGIC)
        return b"".join([*self.frames, struct.pack("<II", SEEK_FRAME, len(rows) + len(footer)), rows, footer])


def seek_table(data: bytes) -> list[tuple[int, int, int, int | None]]:
    """Start, compressed size, decompressed size and checksum of each frame, from the footer alone."""
    n, kind, magic = struct.unpack("<IBI", data[-9:])
    if magic != SEEK_MAGIC:
        raise ValueError("the file does not end with a seek table")
    width = 12 if kind & CHECKED else 8
    out, at = [], 0
    for i in range(len(data) - 9 - n * width, len(data) - 9, width):
        packed, plain = struct.unpack("<II", data[i : i + 8])
        out.append((at, packed, plain, struct.unpack("<I", data[i + 8 : i + 12])[0] if width == 12 else None))
        at += packed
    return out


def frame(data: bytes, entry: tuple) -> bytes:
    """One frame's records, nothing else decompressed."""
    start, packed, plain, check = entry
    out = zstandard.ZstdDecompressor().decompress(data[start : start + packed], max_output_size=plain)
    if check is not None and xxhash.xxh64_intdigest(out) & 0xFFFFFFFF != check:
        raise ValueError("a frame does not have its checksum")
    return out


def record_map(data: bytes, table: list) -> list[tuple[str, int, int, int]]:
    """Record id, frame, offset and length of all records of a bundle."""
    start, packed, *_ = table[-1]
    listed = zstandard.ZstdDecompressor().decompress(data[start + 8 : start + packed])
    out, at = [], 0
    while at < len(listed):
        f, offset, length, n = struct.unpack_from("<IQQH", listed, at)
        at += struct.calcsize("<IQQH")
        out.append((listed[at : at + n].decode(), f, offset, length))
        at += n
    return out


# ----------------------------------------------------------------- Spark
def _first_of_each(stages: Stages, rows: DataFrame, least: int, shared: int) -> DataFrame:
    """``rows`` (id, url, payload) with ``digest`` and ``first``: the smallest id of those with
    the same payload, if it is long enough and repeats."""
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    repeats = stages.put(rows.where(F.octet_length("payload") >= least).groupBy("digest").agg(F.min("id").alias("least_id"), F.count(F.lit(1)).alias("n"))
                         .where("n > 1").select(F.col("digest").alias("same"), "least_id", "n"))
    if repeats.count() <= shared:
        return rows.join(F.broadcast(repeats.drop("n")), F.col("digest") == F.col("same"), "left").withColumnRenamed("least_id", "first")
    total = repeats.agg(F.sum("n")).first()[0]
    hot = repeats.where(F.col("n") * HOT_SHARE >= total).select(F.col("same").alias("hot"), F.col("least_id").alias("hot_id"))
    rows = rows.join(F.broadcast(hot), F.col("digest") == F.col("hot"), "left")
    key = F.when(F.col("hot").isNull(), F.col("digest")).otherwise(F.concat(F.lit("-"), F.monotonically_increasing_id().cast("string")))
    return (rows.withColumn("key", key).join(repeats.hint("merge"), F.col("key") == F.col("same"), "left")
            .withColumn("first", F.coalesce("hot_id", "least_id")))


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 100,
          date: str = "1970-01-01T00:00:00Z", frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES, shared: int = SHARED) -> None:
    """Writes the rows as WARC records into bundles under ``path`` (a new folder)."""
    stages = Stages(pages.sparkSession, "warc")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), as_bytes(payload_col).alias("payload"))
    marked = _first_of_each(stages, rows, least, shared)
    refers = F.when(~F.col("id").eqNullSafe(F.col("first")), F.col("first"))
    marked = marked.select(_name("id").alias("name"), "url", "payload", "digest", F.when(refers.isNotNull(), _name(refers)).alias("refers"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle = Bundle(frame_bytes)
        for batch in slices(batches, "payload"):
            for row in batch.to_pylist():
                bundle.add(row["name"], record(row["name"], row["url"], row["payload"], row["digest"], row["refers"], date))
                if bundle.size >= bundle_bytes:
                    yield _bundle_row(bundle)
                    bundle = Bundle(frame_bytes)
        if bundle.entries:
            yield _bundle_row(bundle)

    packed = marked.mapInArrow(pack, "bundle binary").select(F.col("bundle").cast("string").alias("value"))
    # one bundle a file; the writer ends each "line" with the format's own last four bytes
    (packed.write.option("maxRecordsPerFile", 1).option("encoding", "ISO-8859-1")
     .option("lineSep", struct.pack("<I", SEEK_MAGIC).decode("latin-1")).text(path))


def _name(column) -> Column:
    return F.concat(F.lit(ID_SCHEME), F.coalesce((F.col(column) if isinstance(column, str) else column).cast("string"), F.lit("")))


def page_id(column: str) -> Column:
    """The id within a record id, null if it has none."""
    return F.nullif(F.substring(column, len(ID_SCHEME) + 1, 1 << 20), F.lit("")).try_cast("long")


def _bundle_row(bundle: Bundle) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([bundle.finished()[:-4]], pa.binary())], ["bundle"])


def _files(spark: SparkSession, paths) -> DataFrame:
    importable(spark)
    return spark.read.format("binaryFile").load(paths).where("length > 0").select("path", "content")


def _schema(text: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    return pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in text.split(", ")])


def _bundles(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.column(0)[i].as_py(), batch.column(1)[i].as_buffer().to_pybytes(), batch.slice(i, 1)


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """All records of an archive.  Digests, lengths and checksums are verified; a revisit has
    the digest and length of its payload, but no payload (see ``resolved``)."""
    schema = _schema(RECORD)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for file, data, _ in _bundles(batches):
            for k, entry in enumerate(seek_table(data)[:-1]):
                plain, at, found = frame(data, entry), 0, []
                while at < len(plain):
                    one = parsed(plain, at)
                    at += one["length"]
                    found.append({**one, "payload": one["payload"] if payloads else None, "file": file, "frame": k})
                yield pa.RecordBatch.from_pylist(found, schema)

    return _files(spark, path).mapInArrow(unpack, RECORD)


def resolved(records: DataFrame) -> DataFrame:
    """``records`` where revisits have the payload of the response that they refer to."""
    full = records.where("record_type = 'response'").groupBy("payload_digest").agg(F.first("payload").alias("_full"))
    back = records.where("record_type = 'revisit'").drop("payload").join(full, "payload_digest")
    return records.where("record_type <> 'revisit'").unionByName(back.withColumnRenamed("_full", "payload"))


def index(spark: SparkSession, path: str) -> DataFrame:
    """Where each record is: file, frame, the frame's bytes in the file and the record's in
    the decompressed frame.  Read from footers and record maps; no frame is decompressed."""
    schema = _schema(MAP)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for file, data, _ in _bundles(batches):
            table = seek_table(data)
            rows = [dict(zip(schema.names, (name, file, f, table[f][0], table[f][1], at, n))) for name, f, at, n in record_map(data, table)]
            yield pa.RecordBatch.from_pylist(rows, schema)

    return _files(spark, path).mapInArrow(listed, MAP)


def fetch(spark: SparkSession, located: DataFrame) -> DataFrame:
    """The records that rows of ``index`` point to; only the frames that hold one are decompressed.

    Files are named to the scan if they are at most 1,000, else found by a join."""
    schema = _schema(RECORD)
    spots = located.groupBy("file").agg(F.collect_set(F.struct("frame", "offset")).alias("spots"))
    files = [r[0] for r in spots.select("file").limit(1001).collect()]
    if not files:
        return spark.createDataFrame([], RECORD)
    base = files if len(files) <= 1000 else files[0].rsplit("/", 1)[0]

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for file, data, row in _bundles(batches):
            table, wanted = seek_table(data), {}
            for spot in row.column(2)[0].as_py():
                wanted.setdefault(spot["frame"], []).append(spot["offset"])
            for k, offsets in sorted(wanted.items()):
                plain = frame(data, table[k])
                yield pa.RecordBatch.from_pylist([{**parsed(plain, at), "file": file, "frame": k} for at in sorted(offsets)], schema)

    return _files(spark, base).join(spots, F.col("path") == F.col("file")).select("path", "content", "spots").mapInArrow(pick, RECORD)


def archive_path(spark: SparkSession) -> str:
    """A new folder below the shared one; it stays there, as the rows that are read from it are lazy."""
    return f"{Stages(spark, 'warc').base}/archive"
