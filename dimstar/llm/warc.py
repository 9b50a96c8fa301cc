"""WARC archives compressed with Zstandard: one frame per record after a leading skippable frame that holds the dictionary.

Archives are rows (path, content), which is also what Spark's binaryFile source gives for real .warc.zst files, so that the reader
takes either. Written archives stay below a size limit and are kept as a Parquet table in the shared folder, since executors can
write to a store only through Spark; `save_files` puts them out as files where a POSIX path is shared.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dimstar.functions.runtime import materialize, ship_code
from dimstar.llm.skew import attach_groups, few_bytes, small_batches

# Formats of the archives.
DICTIONARY_FRAME = 0x184D2A5D
ZSTD_MAGIC = 0xFD2FB528
VERSION = b"WARC/1.1"
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: An archive is closed once it has this many bytes; one record more may follow.
ARCHIVE_BYTES = 4_000_000
DICTIONARY_BYTES, SAMPLE_BYTES = 32_768, 2_000_000
#: Compressed bytes that the reader takes at once.
STEP = 4096


def payload_digest(payload: bytes) -> str:
    """Bare upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def write_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """A response record, or a revisit record that leaves out the payload; its HTTP headers keep the payload's length."""
    clean = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m.group()):02X}", url or "")
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    head = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Target-URI", clean),
        ("WARC-Payload-Digest", f"sha1:{payload_digest(payload)}"),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if revisit:
        head += [("WARC-Profile", SAME_PAYLOAD), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    else:
        block += payload
    head.append(("Content-Length", str(len(block))))
    return VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def train_dictionary(samples: list[bytes]) -> bytes:
    """A dictionary from some records; raw content of the first ones where there are too few to train on."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:DICTIONARY_BYTES] or VERSION


def compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary), write_checksum=True, write_content_size=True)


def dictionary_frame(dictionary: bytes) -> bytes:
    return struct.pack("<II", DICTIONARY_FRAME, len(dictionary)) + dictionary


class BadArchive(ValueError):
    """An archive or record that isn't what it says."""


def read_archive(content: bytes, largest: int = 1 << 30) -> Iterator[dict]:
    """The records of an archive, in order; raises BadArchive. A leading dictionary may itself be a Zstandard frame."""
    at, data = 0, None
    if len(content) >= 8 and struct.unpack_from("<I", content)[0] == DICTIONARY_FRAME:
        size = struct.unpack_from("<I", content, 4)[0]
        if 8 + size > len(content):
            raise BadArchive("the dictionary frame is cut short")
        raw, at = content[8 : 8 + size], 8 + size
        if raw[:4] == struct.pack("<I", ZSTD_MAGIC):
            raw = zstandard.ZstdDecompressor().decompress(raw, max_output_size=largest)
        data = zstandard.ZstdCompressionDict(raw)
    opener = zstandard.ZstdDecompressor(dict_data=data) if data else zstandard.ZstdDecompressor()
    view = memoryview(content)
    while at < len(content):
        one, parts, start = opener.decompressobj(), [], at
        try:
            while not one.eof and at < len(content):  # in small steps, as what follows a frame is copied
                parts.append(one.decompress(view[at : at + STEP]))
                at = min(at + STEP, len(content))
        except zstandard.ZstdError as error:
            raise BadArchive(f"frame at byte {start}: {error}") from error
        if not one.eof:
            raise BadArchive(f"frame at byte {start} is cut short")
        at -= len(one.unused_data)
        yield parse_record(b"".join(parts))


def parse_record(record: bytes) -> dict:
    """Validate one frame's record: version, headers, length, end, and the payload's digest and length."""
    head, gap, rest = record.partition(b"\r\n\r\n")
    version, *lines = head.split(b"\r\n")
    if not gap or version not in (b"WARC/1.0", VERSION):
        raise BadArchive("no WARC version line")
    fields: dict[str, str] = {}
    for line in lines:
        name, colon, value = line.decode("utf-8", "replace").partition(":")
        if not colon or not re.fullmatch(r"[!#$%&'*+.^_`|~0-9A-Za-z-]+", name):
            raise BadArchive(f"bad header line {line[:60]!r}")
        if name.lower() in fields and name.lower() in ("warc-type", "warc-record-id", "content-length", "warc-date"):
            raise BadArchive(f"{name} is there twice")
        fields[name.lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in fields:
            raise BadArchive(f"no {name}")
    if not fields["content-length"].isdigit():
        raise BadArchive("Content-Length isn't a number")
    length = int(fields["content-length"])
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise BadArchive(f"Content-Length is {length}, the frame has {len(rest) - 4} bytes")
    http, _, payload = rest[:length].partition(b"\r\n\r\n")
    said = re.search(rb"(?im)^content-length:\s*(\d+)\s*$", http.replace(b"\r", b""))
    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    if fields["warc-type"] == "response":
        if digest and payload_digest(payload) != digest:
            raise BadArchive("the payload doesn't have its digest")
        if said and int(said[1]) != len(payload):
            raise BadArchive("the payload doesn't have its length")
        digest = digest or payload_digest(payload)
    number = lambda field: int(m[1]) if (m := re.fullmatch(r"<urn:page:(-?\d+)>", fields.get(field, ""))) else None
    return {
        "page_id": number("warc-record-id"), "url": fields.get("warc-target-uri"), "record_type": fields["warc-type"],
        "payload": payload if fields["warc-type"] == "response" else None,
        "payload_bytes": len(payload) if fields["warc-type"] == "response" else int(said[1]) if said else None,
        "payload_digest": digest or None, "refers_to": number("warc-refers-to"),
    }


def _records(pages: DataFrame, id_col: str, url_col: str, payload_col: str, least_bytes: int) -> DataFrame:
    """(id, url, payload, refers_to): refers_to is the smallest other id whose payload has the same SHA-256, for revisits only."""
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.unhex(F.sha2("payload", 256)))
    groups = rows.filter(F.octet_length("payload") >= least_bytes).groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    groups = materialize(groups.filter("n > 1"), "warc-groups")
    shared = groups.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    again = attach_groups(rows.select("id", "digest"), groups, "digest", "n", shared)
    again = again.filter("id is null or id != first").select(F.col("id").alias("own"), F.col("digest").alias("same"), F.col("first").alias("refers_to"))
    again = materialize(again.distinct(), "warc-revisits")
    joined = rows.join(F.broadcast(again) if few_bytes(again) else again, (F.col("digest") == F.col("same")) & F.col("id").eqNullSafe(F.col("own")), "left")
    return joined.select("id", "url", "payload", "refers_to")


def write_archives(
    pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES
) -> DataFrame:
    """Archives (path, content) with one record per row of `pages`, as a table in the shared folder.

    Of rows with equal payloads (null: empty) of at least `least_bytes` bytes, those with the smallest id are responses and the others
    revisit it; ids are taken as unique but for repeated rows, which are written alike. A null id has no number, a null url is empty.
    Each task trains a dictionary on its first records. An empty table makes no archives.
    """
    ship_code(pages.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        waiting: list[bytes] = []
        state: dict = {"sample": 0, "press": None, "lead": b"", "parts": [], "size": 0, "n": 0}

        def archive() -> pa.RecordBatch:
            name = f"part-{TaskContext.get().partitionId():05d}-{state['n']:05d}.warc.zst"
            content = b"".join([state["lead"], *state["parts"]])
            state.update(parts=[], size=0, n=state["n"] + 1)
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([content], pa.binary())], ["path", "content"])

        def add(record: bytes) -> None:
            frame = state["press"].compress(record)
            state["parts"].append(frame)
            state["size"] += len(frame)

        def start() -> None:
            dictionary = train_dictionary(waiting)
            state.update(press=compressor(dictionary), lead=dictionary_frame(dictionary))

        for batch in small_batches(batches, 200):
            for id_, url, payload, refers in zip(*(c.to_pylist() for c in batch.columns)):
                record = write_record(id_, url, payload, refers, refers is not None)
                if state["press"] is None:
                    waiting.append(record)
                    state["sample"] += len(record)
                    if state["sample"] < SAMPLE_BYTES:
                        continue
                    start()
                    ready, waiting = waiting, []
                else:
                    ready = [record]
                for r in ready:
                    add(r)
                    if state["size"] >= archive_bytes:
                        yield archive()
        if waiting:
            start()
            for r in waiting:
                add(r)
                if state["size"] >= archive_bytes:
                    yield archive()
        if state["parts"]:
            yield archive()

    records = _records(pages, id_col, url_col, payload_col, least_bytes)
    return materialize(records.mapInArrow(write, "path string, content binary"), "warc-archives")


def save_files(archives: DataFrame, folder: str) -> DataFrame:
    """Write each archive as a file of `folder`, a path that driver and executors share; returns (path, bytes).

    A file is written beside its place and renamed, so a repeated task leaves the same file. Archives have names of their own, which
    aren't null; no archives give no files and no rows.
    """
    os.makedirs(folder, exist_ok=True)

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 200):
            paths, sizes = [], []
            for name, content in zip(*(c.to_pylist() for c in batch.columns)):
                path = os.path.join(folder, name)
                with open(f"{path}.{os.getpid()}.part", "wb") as out:
                    out.write(content)
                os.replace(f"{path}.{os.getpid()}.part", path)
                paths.append(path)
                sizes.append(len(content))
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(sizes, pa.int64())], ["path", "bytes"])

    ship_code(archives.sparkSession)
    return materialize(archives.select("path", "content").mapInArrow(save, "path string, bytes long"), "warc-files")


def read_archives(archives: DataFrame, *, payloads: bool = True) -> DataFrame:
    """One row per record of archives (path, content): page_id, url, record_type, payload, payload_bytes, payload_digest, refers_to.

    A damaged archive fails the job with its path. payload is null for revisits, or always with payloads=False.
    """
    spark = archives.sparkSession
    ship_code(spark)
    schema = "page_id long, url string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to long"
    kinds = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 200):
            for path, content in zip(batch.column(0), batch.column(1)):
                rows: list[dict] = []
                size = 0
                try:
                    for row in read_archive(content.as_py()):
                        size += row["payload_bytes"] or 0
                        rows.append(row if payloads else row | {"payload": None})
                        if size > 8_000_000:
                            yield pa.RecordBatch.from_pylist(rows, kinds)
                            rows, size = [], 0
                except BadArchive as error:
                    raise BadArchive(f"{path.as_py()}: {error}") from error
                yield pa.RecordBatch.from_pylist(rows, kinds)

    return archives.select("path", "content").mapInArrow(read, schema)
