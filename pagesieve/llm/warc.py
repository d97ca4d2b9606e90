"""WARC archives with a Zstandard dictionary.

Each archive starts with a skippable frame that holds a dictionary built from
its own records; every record is a frame of its own, so one record can be read
without the others. Of records with equal payloads one is a response and the
others revisit it, so a payload is stored once over all archives.

Archives are part files of Spark's text writer, whose committer makes them safe
against lost tasks: a value is the bytes of a frame, and the line separator is
an empty skippable frame, which readers pass over.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagesieve.llm.common import bounded, materialize

DICTIONARY_FRAME = 0x184D2A5D
SKIPPABLE = 0x184D2A50
EMPTY_FRAME = struct.pack("<II", SKIPPABLE, 0).decode("ascii")
#: Payload bytes an archive holds on average.
ARCHIVE_BYTES = 64 << 20
#: The dictionary, and the records of an archive that it is built from.
DICTIONARY_BYTES = 64 << 10
SAMPLE_BYTES = 4 << 20
#: Payloads below this are stored each time.
REVISIT_BYTES = 100
_URN = "urn:pagesieve:page:"
_DATE = "2024-01-01T00:00:00Z"


def record(kind: str, record_id: str, url: str, digest: str, size: int, payload: bytes, refers: str | None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode() + payload
    fields = [
        f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {_DATE}", f"WARC-Target-URI: {url}",
        f"WARC-Payload-Digest: sha256:{digest}"]
    if kind == "revisit":
        fields += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{refers}>"]
    fields += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(http)}"]
    return b"WARC/1.1\r\n" + "\r\n".join(fields).encode() + b"\r\n\r\n" + http + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], int, bytes]:
    """Fields, the payload's full size, and the payload (empty for revisits) of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    http, _, payload = rest[:int(fields["Content-Length"])].partition(b"\r\n\r\n")
    size = next(int(line[16:]) for line in http.split(b"\r\n") if line.startswith(b"Content-Length: "))
    return fields, size, payload


def build_dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary; of too few or too small records, their last bytes."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, d=8, k=512).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY_BYTES:]


def frame_end(data: memoryview, at: int) -> int:
    """Where the Zstandard frame that starts at a byte ends."""
    checksum = data[at + 4] & 4
    at += zstandard.frame_header_size(data[at:at + 18])
    last = False
    while not last:
        header = int.from_bytes(data[at:at + 3], "little")
        last, kind, size = header & 1, header >> 1 & 3, header >> 3
        at += 3 + (1 if kind == 1 else size)
    return at + (4 if checksum else 0)


def read_frames(content: bytes) -> Iterator[bytes]:
    """The records of an archive."""
    data, at = memoryview(content), 0
    reader = zstandard.ZstdDecompressor()
    while at < len(data):
        magic, size = struct.unpack_from("<II", data, at)
        if magic & ~0xF == SKIPPABLE:
            if magic == DICTIONARY_FRAME and size:
                reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(bytes(data[at + 8:at + 8 + size])))
            at += 8 + size
            continue
        end = frame_end(data, at)
        yield reader.decompress(bytes(data[at:end]))
        at = end


def _frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The frames of one archive, from its rows in order of page_id."""
    def records() -> Iterator[bytes]:
        page, copies, stored = object(), 0, set()
        for batch in batches:
            for row in batch.to_pylist():
                if row["page_id"] != page:
                    page, copies, stored = row["page_id"], 0, set()
                kind = "revisit" if row["equal"] and (not row["first"] or row["digest"] in stored) else "response"
                if row["equal"] and row["first"]:
                    stored.add(row["digest"])
                name = f"{_URN}{page}" + (f":{copies}" if copies else "")
                copies += 1
                payload = (row["html"] or "").encode() if kind == "response" else b""
                url = " ".join((row["url"] or "").split()) or "about:blank"
                yield record(kind, name, url, row["digest"], row["bytes"], payload, f"{_URN}{row['refers']}")

    def frames() -> Iterator[bytes]:
        source, sample, size = records(), [], 0
        for data in source:
            sample.append(data)
            size += len(data)
            if size >= SAMPLE_BYTES:
                break
        if not sample:
            return
        dictionary = build_dictionary(sample)
        yield struct.pack("<II", DICTIONARY_FRAME, len(dictionary)) + dictionary
        writer = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary))
        yield from map(writer.compress, sample)
        del sample
        yield from map(writer.compress, source)

    block: list[bytes] = []
    size = 0
    for frame in frames():
        block.append(frame)
        size += len(frame)
        if size > 4 << 20:
            yield pa.RecordBatch.from_arrays([pa.array(block, pa.binary())], ["frame"])
            block, size = [], 0
    yield pa.RecordBatch.from_arrays([pa.array(block, pa.binary())], ["frame"])


def write_archives(pages: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write a record for each row of ``pages`` (page_id, url, html; more columns are ignored).

    A null html is an empty payload and a null url ``about:blank``. Of rows with
    equal payloads of at least 100 bytes that with the smallest page_id is a
    response (null ids come last; of rows with that same id, one) and the others
    revisit it. Rows with one page_id are in one archive. No rows write no archive.
    """
    html = F.coalesce("html", F.lit(""))
    rows = pages.select(
        "page_id", "url", "html", F.sha2(html.cast("binary"), 256).alias("digest"),
        F.octet_length(html).cast("long").alias("bytes"))
    known = (rows.where(F.col("bytes") >= REVISIT_BYTES).groupBy("digest")
             .agg(F.min("page_id").alias("refers"), F.count(F.lit(1)).alias("n"))
             .where("n > 1").select(F.col("digest").alias("known"), "refers", F.lit(True).alias("equal")))
    size = rows.agg(F.sum("bytes")).first()[0] or 0
    first = F.col("page_id").eqNullSafe(F.col("refers"))
    # payloads that repeat are few next to all; while they are, the pages are not shuffled to find them
    joined = rows.join(bounded(materialize(known, "payloads")), F.col("digest") == F.col("known"), "left").select(
        "page_id", "url", F.when(F.col("equal").isNull() | first, F.col("html")).alias("html"), "digest", "bytes", "refers",
        F.coalesce("equal", F.lit(False)).alias("equal"), first.alias("first"))
    (joined.repartition(int(size // archive_bytes) + 1, "page_id").sortWithinPartitions("page_id")
     .mapInArrow(_frames, "frame binary").select(F.col("frame").cast("string").alias("value"))
     .write.option("lineSep", EMPTY_FRAME).text(path))


_READ = ("page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def read_archives(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """The records of all archives of a folder; the digest of a response is taken of its payload anew."""
    import hashlib

    def page(urn: str | None) -> int | None:
        name = urn.strip("<>")[len(_URN):].split(":")[0] if urn else "None"
        return None if name == "None" else int(name)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                block, size = [], 0
                for data in read_frames(content.as_py()):
                    fields, full, body = parse(data)
                    kind = fields["WARC-Type"]
                    digest = hashlib.sha256(body).hexdigest() if kind == "response" else fields["WARC-Payload-Digest"][7:]
                    block.append((
                        page(fields["WARC-Record-ID"]), fields["WARC-Target-URI"], len(body) if kind == "response" else full,
                        digest, kind, page(fields.get("WARC-Refers-To")), body if payload and kind == "response" else None))
                    size += len(data) if payload else 100
                    if size > 4 << 20:
                        yield _batch(block)
                        block, size = [], 0
                yield _batch(block)

    return spark.read.format("binaryFile").load(f"{path}/part-*").select("content").mapInArrow(read, _READ)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [()] * 7, kinds)], names)
