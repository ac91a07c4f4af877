"""WARC archives in seekable Zstandard bundles.

An archive is a folder: ``bundles`` has files of independent Zstandard frames of about ``FRAME_BYTES`` of records each, with a
seek table (compressed and plain size of each frame) in a skippable frame at the end, so that any Zstandard program reads a
bundle as one WARC file; ``index`` is a table of record_id, file, frame, offset and length (in the plain frame).

One record is written for each page.  Of pages whose payloads are equal and have ``LEAST_BYTES`` or more, those with the
smallest id are responses and the others revisits, which refer to the first and have the payload's digest and the HTTP header
with its length, but not the payload.  Which payloads repeat is known from an aggregation of digests; only repeated digests
are joined to the pages, and Spark broadcasts them if the stored table is small, or else deals skewed digests to several tasks.

Tasks write their bundles themselves, through pyarrow's file systems, under a name that no other attempt uses; the index,
which Spark commits, names only bundles of tasks that have ended, so lost executors and repeated tasks leave no record twice.  The
folder must be one that all executors share.  Readers take one frame at a time.

Cases: a null or empty html has an empty payload and is a response; a null page id is kept as such, never the first
of its payload, and a response if all ids of the payload are null; rows that repeat the smallest id are responses all;
urls are percent-encoded where they have white space or control characters, and null is empty; a page of any size is one
record, and a frame of its own if it is larger than a frame; extra columns aren't written.  An archive of no pages has no bundle.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote, unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, shared_path, slices

LEAST_BYTES, FRAME_BYTES, BUNDLE_BYTES, LEVEL = 100, 1 << 20, 1 << 30, 3
#: Fixed values of the seekable format and of the WARC standard.
SKIPPABLE_MAGIC, SEEKABLE_MAGIC = 0x184D2A5E, 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"
INDEX = "record_id string, file string, frame int, offset long, length long"


# --- bundles of bytes


class BundleWriter:
    """Frames and the seek table of one bundle, written to an open file."""

    def __init__(self, sink, level: int = LEVEL):
        import zstandard

        self.sink, self.compressor, self.sizes, self.written = sink, zstandard.ZstdCompressor(level=level, write_checksum=True), [], 0

    def add(self, data: bytes) -> int:
        """Writes a frame; returns its number."""
        frame = self.compressor.compress(data)
        self.sink.write(frame)
        self.sizes.append((len(frame), len(data)))
        self.written += len(frame)
        return len(self.sizes) - 1

    def close(self) -> None:
        table = b"".join(struct.pack("<II", *s) for s in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, SEEKABLE_MAGIC)
        self.sink.write(struct.pack("<II", SKIPPABLE_MAGIC, len(table)) + table)
        self.sink.close()


class BundleReader:
    """Any frame of a bundle, by the seek table at its end."""

    def __init__(self, source, size: int):
        import zstandard

        self.source, self.decompressor = source, zstandard.ZstdDecompressor()
        source.seek(size - 9)
        count, flags, magic = struct.unpack("<IBI", source.read(9))
        if magic != SEEKABLE_MAGIC:
            raise ValueError("no seek table at the end of the bundle")
        width = 12 if flags & 0x80 else 8  # other writers may add checksums
        source.seek(size - 9 - count * width)
        table = source.read(count * width)
        self.starts, self.sizes, at = [], [], 0
        for k in range(count):
            packed, plain = struct.unpack_from("<II", table, k * width)
            self.starts.append(at)
            self.sizes.append((packed, plain))
            at += packed

    def frame(self, k: int) -> bytes:
        packed, plain = self.sizes[k]
        self.source.seek(self.starts[k])
        return self.decompressor.decompress(self.source.read(packed), max_output_size=plain) if plain else b""


def _files(uri: str):
    """The pyarrow file system of a folder, and the folder's path in it."""
    from pyarrow import fs

    # Hadoop writes file:/x where others write file:///x
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))


# --- records


def record_id(page_id) -> str:
    return "urn:x-page:" + quote(str(page_id), safe="") if page_id is not None else "urn:x-page-null:"


def page_of(record: str) -> str | None:
    kind, _, name = record.strip("<>").partition("page:")
    return unquote(name) if kind == "urn:x-" else None


def _url(url: str | None) -> str:
    return re.sub(r"[\x00-\x20\x7f-\xa0  ]", lambda m: quote(m[0]), url or "")


def _record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def page_record(page_id, url: str | None, payload: bytes | None, digest: str, n_bytes: int, first_id, date: str = DATE) -> bytes:
    """A response, or a revisit of the page ``first_id`` if ``payload`` is None."""
    headers = [
        ("WARC-Type", "revisit" if payload is None else "response"),
        ("WARC-Record-ID", f"<{record_id(page_id)}>"),
        ("WARC-Date", date),
        ("WARC-Target-URI", _url(url)),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
    ]
    if payload is None:
        headers += [("WARC-Refers-To", f"<{record_id(first_id)}>"), ("WARC-Profile", PROFILE)]
    headers.append(("Content-Type", "application/http;msgtype=response"))
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n"
    return _record(headers, http.encode() + (payload or b""))


def _headers(data: bytes, at: int) -> tuple[str, dict[str, str], int]:
    """First line, headers by lower-case name, and where what follows them begins."""
    end = data.index(b"\r\n\r\n", at)
    first, *lines = data[at:end].decode().split("\r\n")
    return first, {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}, end + 4


def read_records(data: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """Offset, length, headers and block of every record of a plain frame."""
    at = 0
    while at < len(data):
        version, headers, body = _headers(data, at)
        if not version.startswith("WARC/"):
            raise ValueError(f"no record at byte {at} of the frame")
        end = body + int(headers["content-length"])
        if data[end : end + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} has another length than its header says")
        yield at, end + 4 - at, headers, data[body:end]
        at = end + 4


def parse_page(headers: dict[str, str], block: bytes) -> dict:
    """What a page's record says; the digest of a payload that is there is computed, not believed."""
    _, http, body = _headers(block, 0)
    payload = block[body:]
    stated = headers["warc-payload-digest"].removeprefix("sha256:")
    if headers["warc-type"] == "response":
        digest = hashlib.sha256(payload).hexdigest()
        if digest != stated or len(payload) != int(http["content-length"]):
            raise ValueError(f"record {headers['warc-record-id']}: the payload isn't the one that was written")
    else:
        payload, digest = None, stated
    return {
        "record_id": headers["warc-record-id"].strip("<>"),
        "page_id": page_of(headers["warc-record-id"]),
        "url": headers["warc-target-uri"],
        "record_type": headers["warc-type"],
        "payload_bytes": int(http["content-length"]),
        "payload_digest": digest,
        "refers_to": page_of(headers["warc-refers-to"]) if "warc-refers-to" in headers else None,
        "payload": payload,
    }


# --- archives


def with_first_pages(pages: DataFrame, id_col: str, url_col: str, html_col: str, least_bytes: int) -> DataFrame:
    """page_id, url, payload (null for revisits), digest, n_bytes, first_id of every page."""
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"digest": F.sha2("payload", 256), "n_bytes": F.octet_length("payload").cast("long")})
    groups = rows.where(F.col("n_bytes") >= least_bytes).groupBy("digest").agg(F.count("*").alias("n"), F.min("page_id").alias("first_id"))
    copies = materialize(groups.where("n > 1").select("digest", "first_id"), "payload-copies")
    again = F.col("first_id").isNotNull() & ~F.col("first_id").eqNullSafe(F.col("page_id"))
    joined = rows.join(copies, "digest", "left").withColumn("__again", again)
    return joined.select("page_id", "url", F.when(~F.col("__again"), F.col("payload")).alias("payload"), "digest", "n_bytes", F.when(F.col("__again"), F.col("first_id")).alias("first_id"))


def write_archive(
    pages: DataFrame,
    path: str,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    least_bytes: int = LEAST_BYTES,
    frame_bytes: int = FRAME_BYTES,
    bundle_bytes: int = BUNDLE_BYTES,
) -> None:
    """Writes a record for each page to new bundles in ``path`` and their index.

    A bundle is closed once it has ``bundle_bytes``; a task has one at a time, and one frame of records in memory.
    """

    def write(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        files, base = _files(f"{path}/bundles")
        files.create_dir(base, recursive=True)
        part = TaskContext.get().partitionId()
        bundle, name, number, held, places, size = None, "", 0, [], [], 0

        def begin():
            name = f"part-{part:05d}-{number:04d}-{uuid.uuid4().hex}.warc.zst"
            bundle = BundleWriter(files.open_output_stream(f"{base}/{name}", compression=None))
            about = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", DATE), ("Content-Type", "application/warc-fields")]
            bundle.add(_record(about, b"format: WARC File Format 1.1\r\n"))
            return name, bundle

        def flush():
            frame = bundle.add(b"".join(held))
            columns = [pa.array([p[0] for p in places]), pa.array([name] * len(places)), pa.array([frame] * len(places), pa.int32())]
            columns += [pa.array([p[k] for p in places], pa.int64()) for k in (1, 2)]
            return pa.RecordBatch.from_arrays(columns, names=["record_id", "file", "frame", "offset", "length"])

        for batch in slices(batches):
            for page_id, url, payload, digest, n_bytes, first_id in zip(*(c.to_pylist() for c in batch.columns)):
                record = page_record(page_id, url, payload, digest, n_bytes, first_id)
                if held and size + len(record) > frame_bytes:
                    yield flush()
                    held, places, size = [], [], 0
                    if bundle.written >= bundle_bytes:
                        bundle.close()
                        bundle, number = None, number + 1
                if bundle is None:
                    name, bundle = begin()
                places.append((record_id(page_id), size, len(record)))
                held.append(record)
                size += len(record)
        if held:
            yield flush()
            bundle.close()

    with_first_pages(pages, id_col, url_col, html_col, least_bytes).mapInArrow(write, INDEX).write.parquet(f"{path}/index")


def _schema(id_type: str) -> str:
    return f"record_id string, page_id {id_type}, url string, record_type string, payload_bytes long, payload_digest string, refers_to {id_type}"


def _open(path: str, name: str):
    files, base = _files(f"{path}/bundles")
    return BundleReader(files.open_input_file(f"{base}/{name}"), files.get_file_info(f"{base}/{name}").size)


def _arrow(rows: list[dict], names: list[str]):
    import pyarrow as pa

    kinds = {"payload_bytes": pa.int64(), "payload": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kinds.get(c, pa.string())) for c in names], names=names)


def _typed(rows: DataFrame, id_type: str) -> DataFrame:
    return rows.withColumns({c: F.col(c).cast(id_type) for c in ("page_id", "refers_to")})


def read_archive(spark: SparkSession, path: str, id_type: str = "long", payloads: bool = False) -> DataFrame:
    """record_id, page_id, url, record_type, payload_bytes, payload_digest, refers_to (and payload, null for revisits) of all pages.

    Frames are dealt to tasks and read one at a time.
    """
    names = ["record_id", "page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", *(["payload"] if payloads else [])]

    def read(batches):
        last, bundle = None, None
        for batch in batches:
            for name, frame in zip(*(c.to_pylist() for c in batch.columns)):
                if name != last:
                    last, bundle = name, _open(path, name)
                records = (parse_page(h, b) for _, _, h, b in read_records(bundle.frame(frame)) if h["warc-type"] != "warcinfo")
                yield _arrow(list(records), names)

    frames = spark.read.schema(INDEX).parquet(f"{path}/index").select("file", "frame").distinct()
    schema = _schema("string") + (", payload binary" if payloads else "")
    return _typed(frames.mapInArrow(read, schema), id_type)


def fetch(spark: SparkSession, path: str, ids: DataFrame, id_type: str = "long") -> DataFrame:
    """The records of the pages in the first column of ``ids``, payloads included, from the frames that hold them.

    A revisit has the payload of the page that it refers to.
    """
    index = spark.read.schema(INDEX).parquet(f"{path}/index")
    names = ["record_id", "page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"]

    def look_up(batches):
        last, bundle, data = (None, None), None, b""
        for batch in batches:
            for name, frame, offset, length in zip(*(batch.column(c).to_pylist() for c in ("file", "frame", "offset", "length"))):
                if name != last[0]:
                    bundle = _open(path, name)
                if (name, frame) != last:
                    data, last = bundle.frame(frame), (name, frame)
                _, _, headers, block = next(read_records(data[offset : offset + length]))
                yield _arrow([parse_page(headers, block)], names)

    def found(wanted: DataFrame) -> DataFrame:
        places = index.join(wanted.distinct(), "record_id", "left_semi").repartition("file", "frame").sortWithinPartitions("file", "frame", "offset")
        return places.mapInArrow(look_up, _schema("string") + ", payload binary")

    key = F.col(ids.columns[0]).cast("string")
    plain = F.udf(record_id)
    first = materialize(found(ids.select(F.coalesce(plain(key), F.lit("urn:x-page-null:")).alias("record_id"))), "fetched")
    seen = first.where("record_type = 'revisit'").select(plain("refers_to").alias("record_id"))
    payload = found(seen).select("payload_digest", F.col("payload").alias("__first")).dropDuplicates(["payload_digest"])
    out = first.join(payload, "payload_digest", "left").withColumn("payload", F.coalesce("payload", "__first"))
    return _typed(out.select(*names), id_type)


def archive_digest(pages: DataFrame, path: str | None = None, **options) -> DataFrame:
    """Writes an archive, reads it back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    spark, id_col = pages.sparkSession, options.get("id_col", "page_id")
    path = path or shared_path(spark, "warc")
    write_archive(pages, path, **options)
    rows = read_archive(spark, path, pages.schema[id_col].dataType.simpleString())
    return rows.select(F.col("page_id").alias(id_col), "payload_bytes", "payload_digest", "record_type", "refers_to")


def plain_bundle(data: bytes) -> bytes:
    """A whole bundle as any reader of Zstandard sees it."""
    import zstandard

    return zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read()
