"""WARC archives as seekable Zstandard bundles.

Records are grouped into independent Zstandard frames; a bundle ends with a footer, a skippable frame that holds the
seek table of the public seekable format (compressed and plain size of every frame). An index table maps a record
identifier to its bundle, frame and offset inside the frame, so one record is read by one frame.

Of records with equal payloads of at least `min_revisit` bytes, the one with the largest id is a response and the
others are revisits that name it; their payloads are not stored again.

Defined results: a null payload is empty; a null url is an empty target; rows with a null id are responses without a
place in the index's order (their id reads back as null); rows that share an id are each written; an empty table
writes no bundle; columns beyond id, url and payload are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_arrow, scratch_path

#: Fixed values of the seekable format: magic numbers and the skippable frame that a seek table is.
SEEKABLE_MAGIC, SKIPPABLE_MAGIC = 0x8F92EAB1, 0x184D2A5E
FRAME_BYTES, BUNDLE_BYTES = 1 << 20, 32 << 20


# ---------------------------------------------------------------- records


def record(page_id: int | None, url: str, payload: bytes, digest: str, size: int, refers_to: int | None) -> bytes:
    """One WARC/1.1 record. A revisit has no payload, but its digest and size."""
    revisit = refers_to is not None
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + (b"" if revisit else payload)
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_urn(page_id)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {url.replace('\r', '%0D').replace('\n', '%0A')}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {size}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(body)}",
    ]
    if revisit:
        head.insert(4, f"WARC-Refers-To: {record_urn(refers_to)}")
        head.insert(5, "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def record_urn(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def parse_records(data: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, header fields, payload) of each record in plain WARC bytes."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        fields = dict(x.split(": ", 1) for x in lines[1:])
        size = int(fields["Content-Length"])
        body = data[end + 4 : end + 4 + size]
        yield at, fields, body[body.index(b"\r\n\r\n") + 4 :]
        at = end + 4 + size + 4


# ---------------------------------------------------------------- bundles


class Bundle:
    """Frames of one archive, in memory up to its limit."""

    def __init__(self, level: int):
        import zstandard

        self.compressor, self.parts, self.table, self.held, self.size = zstandard.ZstdCompressor(level=level), [], [], [], 0
        self.bytes = 0

    def add(self, data: bytes, frame_bytes: int) -> tuple[int, int]:
        """Appends a record; returns its frame's number and its offset there."""
        if self.held and self.size + len(data) > frame_bytes:
            self.flush()
        place = len(self.table), self.size
        self.held.append(data)
        self.size += len(data)
        return place

    def flush(self) -> None:
        if self.held:
            frame = self.compressor.compress(b"".join(self.held))
            self.parts.append(frame)
            self.table.append((len(frame), self.size))
            self.bytes += len(frame)
            self.held, self.size = [], 0

    def finish(self) -> bytes:
        self.flush()
        table = b"".join(struct.pack("<II", *x) for x in self.table)
        footer = table + struct.pack("<IBI", len(self.table), 0, SEEKABLE_MAGIC)
        return b"".join(self.parts) + struct.pack("<II", SKIPPABLE_MAGIC, len(footer)) + footer


def seek_table(data: bytes) -> list[tuple[int, int, int]]:
    """(start, compressed size, plain size) of each frame, from the footer at the end of a bundle."""
    n, _, magic = struct.unpack("<IBI", data[-9:])
    if magic != SEEKABLE_MAGIC:
        raise ValueError("no seek table")
    start, out = 0, []
    for k in range(n):
        packed, plain = struct.unpack_from("<II", data, len(data) - 9 - 8 * (n - k))
        out.append((start, packed, plain))
        start += packed
    return out


def read_frames(data: bytes) -> Iterator[bytes]:
    """The frames of a bundle in turn, by its seek table."""
    import zstandard

    plain = zstandard.ZstdDecompressor()
    for start, packed, size in seek_table(data):
        yield plain.decompress(data[start : start + packed], max_output_size=max(size, 1))


def _write(where: str, frame_bytes: int, bundle_bytes: int, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = pafs.FileSystem.from_uri(where)
        bundle, rows = Bundle(level), []

        def close() -> pa.RecordBatch:
            # a task that runs twice leaves a second file that no index names: names are new each time, and a file shows whole or not at all
            name = f"{uuid.uuid4().hex}.warc.zst"
            with fs.open_output_stream(f"{folder}/_{name}", compression=None) as out:
                out.write(bundle.finish())
            fs.move(f"{folder}/_{name}", f"{folder}/{name}")
            return pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array([name] * len(rows)), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int64())],
                ["id", "bundle", "frame", "offset"],
            )

        for batch in batches:
            for row in zip(*(batch.column(k) for k in ("id", "url", "payload", "digest", "size", "refers_to")), strict=True):
                page_id, url, payload, digest, size, refers_to = (x.as_py() for x in row)
                place = bundle.add(record(page_id, url or "", payload or b"", digest, size, refers_to), frame_bytes)
                rows.append((page_id, *place))
                if bundle.bytes + bundle.size >= bundle_bytes:
                    yield close()
                    bundle, rows = Bundle(level), []
        if rows:
            yield close()

    return run


def decide(pages: DataFrame, min_revisit: int = 1000) -> DataFrame:
    """pages (id, url, payload binary) with digest, size and refers_to (null: a response).

    Groups of copies are pre-aggregated; pages meet their decision by (id, digest), which has no hot value, and
    only ids and digests are joined by digest.
    """
    pages = pages.withColumn("digest", F.sha1("payload")).withColumn("size", F.length("payload").cast("long"))
    narrow = pages.where((F.col("size") >= min_revisit) & F.col("id").isNotNull()).select("id", "digest")
    last = narrow.groupBy("digest").agg(F.max("id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").select(F.col("digest").alias("d"), "refers_to")
    revisits = narrow.join(last, F.col("digest") == F.col("d")).where("id <> refers_to").select("id", "digest", "refers_to").distinct()
    return pages.join(revisits, ["id", "digest"], "left")


def write_archives(pages: DataFrame, where: str, *, min_revisit: int = 1000, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES, level: int = 3) -> DataFrame:
    """Writes pages (id long, url string, payload binary) below the URI `where`; returns the index: id, bundle, frame, offset.

    The index is a table beside the bundles (`where`/index), written by the same job, so it names just the files of
    tasks that were committed.
    """
    spark = pages.sparkSession
    bounded_arrow(spark)
    fs, folder = pafs.FileSystem.from_uri(where)
    fs.create_dir(f"{folder}/bundles", recursive=True)
    rows = decide(pages, min_revisit).select("id", "url", F.when(F.col("refers_to").isNull(), F.col("payload")).alias("payload"), "digest", "size", "refers_to")
    index = rows.mapInArrow(_write(f"{where}/bundles", frame_bytes, bundle_bytes, level), "id long, bundle string, frame int, offset long")
    index.write.parquet(f"{where}/index")
    return spark.read.parquet(f"{where}/index")


def _read(where: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = pafs.FileSystem.from_uri(where)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with fs.open_input_file(f"{folder}/{name}") as file:
                    data = file.read()
                for frame, plain in enumerate(read_frames(data)):
                    cols = [[] for _ in range(7)]
                    for offset, fields, payload in parse_records(plain):
                        ref = fields.get("WARC-Refers-To")
                        digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                        if ref is None and (hashlib.sha1(payload).hexdigest() != digest or len(payload) != int(fields["X-Payload-Length"])):
                            raise ValueError(f"{name}: frame {frame}, offset {offset}: the payload does not match its digest")
                        number = fields["WARC-Record-ID"][10:-1]
                        row = (int(number) if number else None, fields["WARC-Target-URI"], fields["WARC-Type"], int(fields["X-Payload-Length"]), digest, int(ref[10:-1]) if ref else None, payload if ref is None else None)
                        for c, v in zip(cols, row, strict=True):
                            c.append(v)
                    kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"])

    return run


def read_archives(spark: SparkSession, where: str) -> DataFrame:
    """All records of the bundles that the index names: id, url, record_type, payload_bytes, payload_digest, refers_to, payload (null for revisits)."""
    names = spark.read.parquet(f"{where}/index").select("bundle").distinct()
    # a bundle is much work for a few bytes of name, so names are dealt out one by one
    names = names.repartition(min(max(names.count(), 1), 100_000))
    return names.mapInArrow(_read(f"{where}/bundles"), "id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary")


def read_record(where: str, bundle: str, frame: int, offset: int) -> tuple[dict[str, str], bytes]:
    """One record by its place: reads the footer and one frame."""
    import zstandard

    fs, folder = pafs.FileSystem.from_uri(where)
    with fs.open_input_file(f"{folder}/bundles/{bundle}") as file:
        size = file.size()
        file.seek(size - 9)
        n = struct.unpack("<IBI", file.read(9))[0]
        file.seek(size - 9 - 8 * n)
        table = [struct.unpack("<II", file.read(8)) for _ in range(n)]
        file.seek(sum(p for p, _ in table[:frame]))
        data = zstandard.ZstdDecompressor().decompress(file.read(table[frame][0]), max_output_size=max(table[frame][1], 1))
    return next((fields, payload) for at, fields, payload in parse_records(data) if at == offset)


def archive_and_read(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_revisit: int = 1000) -> DataFrame:
    """Writes pages to a new scratch folder and reads the archives back, as read_archives()."""
    spark = pages.sparkSession
    where = scratch_path(spark, "warc")
    where = where if "://" in where or where.startswith("file:") else f"file://{where}"
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.encode(F.col(payload_col), "UTF-8"), F.lit(b"")).alias("payload"))
    write_archives(rows, where, min_revisit=min_revisit)
    return read_archives(spark, where)
