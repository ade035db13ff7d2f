"""Zstandard WARC archives: writer and reader.

An archive begins with a skippable frame that holds the compression dictionary; then comes
one frame for each record.  Pages whose payload another page has already are revisit
records.  Tasks write archives under names of their own; the manifest lists those of the
attempts that counted.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tensorspark.llm.common import blocks, bound_batches, open_fs, shared_folder, small

#: Smaller payloads are stored each time.
LEAST_BYTES = 100
DATE = "2024-01-01T00:00:00Z"
# Fixed values of the formats.
DICTIONARY_MAGIC = 0x184D2A5D
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: The dictionary is trained on the first records of an archive, up to this much text.
SAMPLE_BYTES = 2 << 20
DICTIONARY_BYTES = 32 << 10
READ_BYTES = 4 << 20
MANIFEST = "file string, records long, bytes long"
RECORDS = (
    "page_id long, url string, record_type string, record_id string, refers_id string, "
    "payload_bytes long, payload_digest string, payload binary"
)


def _dictionary(samples: list[bytes]) -> zstandard.ZstdCompressionDict:
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples)
    except zstandard.ZstdError:  # too few or too short samples to train on
        raw = b"".join(samples)[-DICTIONARY_BYTES:].ljust(8, b" ")
        return zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def _record_id(kind: str, digest: str, page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{kind}:{digest}:{page_id}')}>"


def _record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    fields = [*fields, ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}")]
    fields.append(("Content-Length", len(block)))
    head = b"".join(f"{k}: {v}\r\n".encode() for k, v in fields if v is not None)
    return VERSION + b"\r\n" + head + b"\r\n" + block + b"\r\n\r\n"


def page_record(
    page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None
) -> bytes:
    """A response record, or a revisit record if ``refers_to`` names another page."""
    revisit = refers_to is not None
    kind = "revisit" if revisit else "response"
    fields = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", _record_id(kind, digest, page_id)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", url and url.replace("\r", "%0D").replace("\n", "%0A")),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Refers-To", _record_id("response", digest, refers_to) if revisit else None),
        ("WARC-Profile", REVISIT_PROFILE if revisit else None),
        ("Page-ID", page_id),
        ("Content-Type", "application/http;msgtype=response"),
    ]
    http = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    head = f"{http}Content-Length: {len(payload)}\r\n\r\n".encode()
    return _record(fields, head if revisit else head + payload)


def _write(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    filesystem, path = open_fs(folder)
    name = f"{uuid.uuid4().hex}.warc.zst"
    stream = compressor = None
    records = size = 0
    order = ("page_id", "url", "payload", "digest", "refers_to")
    for batch in blocks(batches, "payload", SAMPLE_BYTES):
        rows = zip(*(batch.column(c).to_pylist() for c in order), strict=True)
        found = [page_record(*row) for row in rows]
        if stream is None:
            samples = [r[:SAMPLE_BYTES] for r in found]
            trained = _dictionary(samples)
            content = trained.as_bytes()
            compressor = zstandard.ZstdCompressor(
                dict_data=trained, write_checksum=True, write_content_size=True
            )
            stream = filesystem.open_output_stream(f"{path}/{name}", compression=None)
            stream.write(struct.pack("<II", DICTIONARY_MAGIC, len(content)) + content)
            about = b"software: page archive writer\r\nformat: WARC File Format 1.1\r\n"
            info = [
                ("WARC-Type", "warcinfo"),
                ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"),
                ("WARC-Date", DATE),
                ("Content-Type", "application/warc-fields"),
            ]
            found.insert(0, _record(info, about))
        for record in found:
            frame = compressor.compress(record)
            stream.write(frame)
            size += len(frame)
        records += len(found)
    if stream is not None:
        stream.close()
        yield pa.RecordBatch.from_pydict({"file": [name], "records": [records], "bytes": [size]})


def write_archives(pages: DataFrame, folder: str | None = None, least: int = LEAST_BYTES) -> str:
    """Writes a record for each row of ``pages`` (page_id, url, html); returns the folder.

    Of rows with equal payloads of at least ``least`` bytes, that with the smallest page_id
    is the response (all of them, if several rows have that page_id), the others revisit
    it.  Null html is an empty payload.  Null page ids count as smallest only where all are
    null, and then all are responses.  A null url has no header.  Other columns are ignored;
    an empty table gives no archives.
    """
    bound_batches(pages.sparkSession)
    folder = folder or shared_folder(pages.sparkSession, "archives")
    rows = pages.select(
        pages["page_id"].cast("long").alias("page_id"),
        pages["url"].alias("url"),
        F.encode(F.coalesce(pages["html"], F.lit("")), "UTF-8").alias("payload"),
    ).withColumn("digest", F.sha2("payload", 256))
    long = F.octet_length("payload") >= least
    shared = rows.where(long).groupBy("digest").agg(
        F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")
    )
    shared = small(shared.where("n > 1").drop("n"), 100)
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    joined = rows.join(shared, "digest", "left").withColumn("refers_to", refers)
    out = joined.select("page_id", "url", "payload", "digest", "refers_to")
    out.mapInArrow(partial(_write, folder=folder), MANIFEST).write.parquet(f"{folder}/manifest")
    return folder


# ---- reading ---------------------------------------------------------------


def _frame_length(data: memoryview) -> int | None:
    """Bytes of the frame that begins in ``data``, or None if it doesn't end there."""
    try:
        parameters = zstandard.get_frame_parameters(data[:18])
        at = zstandard.frame_header_size(data[:18])
    except zstandard.ZstdError as error:
        if len(data) < 18:
            return None
        raise ValueError("archive is damaged: not a Zstandard frame") from error
    last = False
    while not last:
        if at + 3 > len(data):
            return None
        header = int.from_bytes(data[at : at + 3], "little")
        last, kind, length = bool(header & 1), header >> 1 & 3, header >> 3
        at += 3 + (1 if kind == 1 else length)
    at += 4 * parameters.has_checksum
    return at if at <= len(data) else None


def frames(stream: pa.NativeFile) -> Iterator[bytes]:
    """Decoded frames of an archive, by the dictionary of its leading skippable frame."""
    head = stream.read(8)
    magic, length = struct.unpack("<II", head) if len(head) == 8 else (0, 0)
    if magic != DICTIONARY_MAGIC:
        raise ValueError("archive is damaged: it doesn't begin with a dictionary")
    content = stream.read(length)
    if len(content) != length:
        raise ValueError("archive is damaged: its dictionary is cut off")
    if content[:4] == zstandard.FRAME_HEADER:  # a dictionary may itself be compressed
        content = zstandard.ZstdDecompressor().decompress(content)
    trained = zstandard.ZstdCompressionDict(content)
    decompressor = zstandard.ZstdDecompressor(dict_data=trained)
    data, at = b"", 0
    while True:
        size = _frame_length(memoryview(data)[at:]) if at < len(data) else None
        if size is None:
            more = stream.read(max(READ_BYTES, len(data) - at))
            if not more:
                if at < len(data):
                    raise ValueError("archive is damaged: its last frame is cut off")
                return
            data, at = data[at:] + more, 0
            continue
        yield decompressor.decompress(memoryview(data)[at : at + size])
        at += size


def _require(holds: bool, what: str) -> None:
    if not holds:
        raise ValueError(f"record is damaged: {what}")


def parse_record(record: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (lower-case names) and block of a record; raises if it isn't valid."""
    head, blank, rest = record.partition(b"\r\n\r\n")
    _require(bool(blank), "no end of header")
    version, *lines = head.split(b"\r\n")
    _require(version == VERSION, "its version")
    fields = {}
    for line in lines:
        name, colon, value = line.partition(b":")
        _require(bool(colon), "a header line without colon")
        fields[name.decode().strip().lower()] = value.decode().strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        _require(name in fields, f"no {name}")
    _require(fields["content-length"].isdigit(), "content-length is not a number")
    _require(rest[-4:] == b"\r\n\r\n", "no end of block")
    block = rest[:-4]
    _require(len(block) == int(fields["content-length"]), "content-length")
    digest = fields.get("warc-block-digest")
    _require(digest in (None, f"sha256:{hashlib.sha256(block).hexdigest()}"), "block digest")
    return fields, block


def _page(record: bytes) -> tuple | None:
    """A row of RECORDS, or None for a record that holds no page."""
    fields, block = parse_record(record)
    kind = fields["warc-type"]
    if kind not in ("response", "revisit"):
        return None
    http, blank, payload = block.partition(b"\r\n\r\n")
    _require(bool(blank) and http.startswith(b"HTTP/"), "no HTTP header")
    lengths = [x.split(b":")[1] for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
    _require(len(lengths) == 1, "HTTP content-length")
    size, digest = int(lengths[0]), fields.get("warc-payload-digest", "")
    _require(digest.startswith("sha256:"), "no payload digest")
    digest = digest.removeprefix("sha256:")
    if kind == "response":
        _require(size == len(payload), "HTTP content-length")
        _require(digest == hashlib.sha256(payload).hexdigest(), "payload digest")
    else:
        _require(not payload, "a revisit record with payload")
        _require("warc-refers-to" in fields, "no warc-refers-to")
        payload = None
    page = fields.get("page-id")
    return (
        None if page is None else int(page),
        fields.get("warc-target-uri"),
        kind,
        fields["warc-record-id"],
        fields.get("warc-refers-to"),
        size,
        digest,
        payload,
    )


def _read(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    filesystem, path = open_fs(folder)
    names = [field.split()[0] for field in RECORDS.split(", ")]
    types = [pa.int64(), *[pa.string()] * 4, pa.int64(), pa.string(), pa.binary()]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [()] * len(names)
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, types, strict=True)], names
        )

    for batch in batches:
        for archive in batch.to_pylist():
            rows, seen, size = [], 0, 0
            with filesystem.open_input_stream(f"{path}/{archive["file"]}", compression=None) as stream:
                for record in frames(stream):
                    seen += 1
                    row = _page(record)
                    if row is not None:
                        rows.append(row)
                        size += len(record)
                    if size > READ_BYTES:
                        yield batch_of(rows)
                        rows, size = [], 0
            _require(seen == archive["records"], f"{seen} of {archive['records']} records")
            yield batch_of(rows)


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """Validated page records of all archives of a folder; a task reads whole archives.

    Damaged frames, headers, lengths and digests raise.  A revisit has no payload here.
    """
    manifest = spark.read.parquet(f"{folder}/manifest")
    files = manifest.select("file", "records").coalesce(1).repartition(max(1, manifest.count()))
    return files.mapInArrow(partial(_read, folder=folder), RECORDS)


def resolve_revisits(records: DataFrame) -> DataFrame:
    """page_id, url, record_type, refers_to and the payload's bytes and digest.

    A revisit takes them from the response it refers to, and fails without one of the same
    digest and length.
    """
    pages = records.drop("payload")
    target = pages.where("record_type = 'response'").select(
        F.col("record_id").alias("refers_id"),
        F.col("page_id").alias("target"),
        F.col("payload_bytes").alias("bytes"),
        F.col("payload_digest").alias("digest"),
    )
    revisits = pages.where("record_type = 'revisit'")
    found = revisits.join(target.dropDuplicates(["refers_id"]), "refers_id", "left")
    same = (F.col("bytes") == F.col("payload_bytes")) & (F.col("digest") == F.col("payload_digest"))
    missing = F.raise_error(F.lit("a revisit record refers to no response with its payload"))
    out = ["page_id", "url", "record_type", "payload_bytes", "payload_digest"]
    responses = pages.where("record_type = 'response'").select(
        *out, F.lit(None).cast("long").alias("refers_to")
    )
    refers = F.when(F.coalesce(same, F.lit(False)), F.col("target")).otherwise(missing)
    return responses.unionByName(found.select(*out, refers.cast("long").alias("refers_to")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: all pages written to archives and read back."""
    folder = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return resolve_revisits(read_archives(spark, folder)).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


SQL = f"""
WITH p AS (
    SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
    FROM pages
), f AS (
    SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= {LEAST_BYTES} AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= {LEAST_BYTES} AND page_id <> first THEN first END AS refers_to
FROM f
"""
