"""Zstandard WARC archives: one frame per record behind a skippable frame that holds the dictionary."""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the two formats.
DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = 0xFD2FB528
DICTIONARY_ID_BYTES = (0, 1, 2, 4)
CONTENT_SIZE_BYTES = (0, 2, 4, 8)
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
VERSION = "WARC/1.1"

MIN_SHARED_BYTES = 100
ARCHIVE_BYTES = 16 << 20
SAMPLE_RECORDS, SAMPLE_BYTES, DICTIONARY_BYTES = 256, 8 << 10, 32 << 10
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")

PLANNED = "page_id long, url string, payload binary, payload_digest string, refers_to long"
ARCHIVES = "archive string, content binary"
RECORDS = (
    "archive string, position long, page_id long, url string, record_type string, refers_to long, payload binary, "
    "stored_digest string, error string"
)


def plan_records(pages: DataFrame, min_shared: int = MIN_SHARED_BYTES) -> DataFrame:
    """Payload, digest and, for a page whose payload another page stores, that page's id.

    The smallest page_id of a payload stores it. Rows that repeat this id store it as well; a payload whose pages all lack
    an id is stored by each. The smallest id is found per digest before any join, and adaptive execution may split a digest
    that many pages share.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"),
    ).withColumn("payload_digest", F.sha2("payload", 256))
    large = F.octet_length("payload") >= min_shared
    shared = (
        rows.where(large).groupBy("payload_digest").agg(F.min("page_id").alias("holder"), F.count(F.lit(1)).alias("pages"))
        .where("pages > 1").drop("pages")
    )
    return rows.join(shared, "payload_digest", "left").select(
        "page_id", "url", "payload", "payload_digest",
        F.when(large & ~F.col("page_id").eqNullSafe(F.col("holder")), F.col("holder")).alias("refers_to"),
    )


def _record_id(page: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'page:{page}')}>"


def _known(value) -> bool:
    return value is not None and not pd.isna(value)


def encode_record(page, url, payload: bytes, digest: str, refers) -> bytes:
    """The bytes of one record. A revisit carries the response's head and digest but no payload."""
    revisit = _known(refers)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    own = _record_id(int(page)) if _known(page) else f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{url}:{digest}')}>"
    head = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", own), ("WARC-Date", "2000-01-01T00:00:00Z")]
    if _known(url):
        head.append(("WARC-Target-URI", quote(url, safe="%:/?#[]@!$&'()*+,;=~-._") if _plain(url) else "data:," + quote(url, safe="")))
    if _known(page):
        head.append(("WARC-Page-ID", str(int(page))))
    if revisit:
        head += [("WARC-Refers-To", _record_id(int(refers))), ("WARC-Refers-To-Page", str(int(refers))), ("WARC-Profile", REVISIT_PROFILE)]
    head += [
        ("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-Block-Digest", "sha256:" + hashlib.sha256(block).hexdigest()),
        ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block))),
    ]
    lines = "".join(f"{name}: {value}\r\n" for name, value in head)
    return f"{VERSION}\r\n{lines}\r\n".encode() + block + b"\r\n\r\n"


def _plain(url: str) -> bool:
    """Whether a URL survives as it is: printable ASCII that quoting leaves alone."""
    return not url.startswith("data:,") and quote(url, safe="%:/?#[]@!$&'()*+,;=~-._") == url


def build_archive(records: list[bytes]) -> bytes:
    """A dictionary trained on the leading records (a bounded sample), then one frame with checksum per record."""
    sample = [r[:SAMPLE_BYTES] for r in records[:SAMPLE_RECORDS]]
    try:
        trained = zstandard.train_dictionary(DICTIONARY_BYTES, sample).as_bytes()
    except zstandard.ZstdError:  # too few or too even records: their own bytes serve as raw content
        trained = b"".join(sample)[-DICTIONARY_BYTES:] or VERSION.encode()
    packed = zstandard.ZstdCompressor(level=9, write_checksum=True).compress(trained)
    out = [struct.pack("<II", DICTIONARY_MAGIC, len(packed)), packed]
    press = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(trained), write_checksum=True)
    out += [press.compress(r) for r in records]
    return b"".join(out)


def write_archives(planned: DataFrame, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Archives of about ``archive_bytes`` of records each, as rows (archive, content): one binary cell is one file."""

    def pack(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        records: list[bytes] = []
        size = 0

        def flush() -> pd.DataFrame:
            content = build_archive(records)
            return pd.DataFrame({"archive": [hashlib.sha256(content).hexdigest()[:32] + ".warc.zst"], "content": [content]})

        for part in parts:
            for row in part.itertuples(index=False):
                records.append(encode_record(row.page_id, row.url, row.payload, row.payload_digest, row.refers_to))
                size += len(records[-1])
                if size >= archive_bytes:
                    yield flush()
                    records, size = [], 0
        if records:
            yield flush()

    nullable = planned.withColumn("page_id", F.col("page_id").cast("string")).withColumn("refers_to", F.col("refers_to").cast("string"))
    return nullable.mapInPandas(pack, ARCHIVES)


def frame_end(data: memoryview, at: int) -> int:
    """Where the frame that starts at ``at`` ends, found from its block headers without decoding it."""
    if len(data) - at < 6 or struct.unpack_from("<I", data, at)[0] != FRAME_MAGIC:
        raise ValueError(f"no frame at byte {at}")
    flags = data[at + 4]
    single = flags >> 5 & 1
    size = CONTENT_SIZE_BYTES[flags >> 6] or single
    at += 5 + (1 - single) + DICTIONARY_ID_BYTES[flags & 3] + size
    last = False
    while not last:
        if at + 3 > len(data):
            raise ValueError("the archive ends inside a frame")
        head = int.from_bytes(data[at : at + 3], "little")
        last, kind, length = bool(head & 1), head >> 1 & 3, head >> 3
        if kind == 3:
            raise ValueError("reserved block type")
        at += 3 + (1 if kind == 1 else length)
    at += 4 * (flags >> 2 & 1)
    if at > len(data):
        raise ValueError("the archive ends inside a frame")
    return at


def parse_record(raw: bytes) -> dict:
    """Headers and payload of one record; raises where a header, length or digest doesn't hold."""
    head, sep, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not sep or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise ValueError("no WARC head")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not name.strip():
            raise ValueError("bad header line")
        fields[name.strip().lower()] = value.strip()
    missing = {"warc-type", "warc-record-id", "warc-date", "content-length"} - fields.keys()
    if missing:
        raise ValueError(f"header missing: {min(missing)}")
    if not fields["content-length"].isdigit() or int(fields["content-length"]) != len(rest) - 4 or rest[-4:] != b"\r\n\r\n":
        raise ValueError("content length doesn't fit")
    block = rest[:-4]
    if "warc-block-digest" in fields and fields["warc-block-digest"] != "sha256:" + hashlib.sha256(block).hexdigest():
        raise ValueError("block digest doesn't fit")
    http, gap, payload = block.partition(b"\r\n\r\n")
    sizes = [int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
    stored = fields.get("warc-payload-digest", "").removeprefix("sha256:")
    if fields["warc-type"] == "response" and (not gap or sizes != [len(payload)] or stored != hashlib.sha256(payload).hexdigest()):
        raise ValueError("payload doesn't fit its length or digest")
    if fields["warc-type"] == "revisit" and payload:
        raise ValueError("revisit with a payload")
    url = fields.get("warc-target-uri")
    return {
        "page_id": int(fields["warc-page-id"]) if "warc-page-id" in fields else None,
        "url": unquote(url[6:]) if url and url.startswith("data:,") else url,
        "record_type": fields["warc-type"],
        "refers_to": int(fields["warc-refers-to-page"]) if "warc-refers-to-page" in fields else None,
        "payload": payload if fields["warc-type"] == "response" else None,
        "stored_digest": stored,
        "error": None,
    }


def read_dictionary(data: memoryview) -> tuple[zstandard.ZstdCompressionDict | None, int]:
    """The dictionary in the leading skippable frame, if there is one, and where the records start."""
    if bytes(data[:4]) != struct.pack("<I", DICTIONARY_MAGIC):
        return None, 0
    if len(data) < 8 or 8 + (length := struct.unpack_from("<I", data, 4)[0]) > len(data):
        raise ValueError("the archive ends inside its dictionary")
    raw = bytes(data[8 : 8 + length])
    if raw[:4] == struct.pack("<I", FRAME_MAGIC):
        packed = zstandard.ZstdDecompressor().decompressobj()
        raw = packed.decompress(raw)
        if not packed.eof:
            raise ValueError("the dictionary's frame has no end")
    return zstandard.ZstdCompressionDict(raw), 8 + length


def read_archive(content: bytes) -> Iterator[dict]:
    """Records of one archive in order. A frame that can't be decoded or validated gives a row with ``error``; damage that
    hides where the next frame starts, or a dictionary that can't be read, ends the archive with one such row."""
    data = memoryview(content)
    blank = dict.fromkeys(("page_id", "url", "record_type", "refers_to", "payload", "stored_digest"))
    try:
        dictionary, at = read_dictionary(data)
        opener = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
    except (ValueError, zstandard.ZstdError) as broken:
        yield {**blank, "position": 0, "error": f"dictionary: {broken}"}
        return
    position = 0
    while at < len(data):
        try:
            end = frame_end(data, at)
        except ValueError as broken:
            yield {**blank, "position": position, "error": str(broken)}
            return
        try:
            row = parse_record(opener.decompressobj().decompress(data[at:end]))
        except (ValueError, zstandard.ZstdError) as broken:
            row = {**blank, "error": str(broken)}
        yield {**row, "position": position}
        position, at = position + 1, end


def read_archives(archives: DataFrame, name: str = "archive", content: str = "content") -> DataFrame:
    """Records of archives given as (name, content) rows; a binaryFile scan fits with ``name="path"``. Null contents give none."""
    names = [f.split()[0] for f in RECORDS.split(", ")]

    def unpack(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def table(rows: list[dict]) -> pd.DataFrame:
            found = pd.DataFrame(rows, columns=names)
            return found.astype({c: "Int64" for c in ("position", "page_id", "refers_to")})

        for part in parts:
            for archive, data in zip(part["archive"], part["content"], strict=True):
                rows, size = [], 0
                for record in read_archive(data or b""):
                    rows.append({"archive": archive, **record})
                    size += len(record["payload"] or b"")
                    if size > 4 << 20:
                        yield table(rows)
                        rows, size = [], 0
                if rows:
                    yield table(rows)

    return archives.select(F.col(name).alias("archive"), F.col(content).alias("content")).mapInPandas(unpack, RECORDS)


def resolve(records: DataFrame) -> DataFrame:
    """Give each revisit the size and digest of the response it refers to; ``valid`` is false where that one is missing."""
    own = records.select(
        "archive", "position", "page_id", "url", "record_type", "refers_to", "stored_digest", "error",
        F.octet_length("payload").cast("long").alias("own_bytes"),
    )
    held = (
        own.where("record_type = 'response' and page_id is not null")
        .groupBy(F.col("page_id").alias("refers_to"), "stored_digest").agg(F.max("own_bytes").alias("held_bytes"))
    )
    return own.join(held, ["refers_to", "stored_digest"], "left").select(
        "archive", "position", "page_id", "url", "record_type", "refers_to",
        F.coalesce("own_bytes", "held_bytes").alias("payload_bytes"), F.col("stored_digest").alias("payload_digest"),
        (F.col("error").isNull() & F.coalesce("own_bytes", "held_bytes").isNotNull()).alias("valid"), "error",
    )


def export_files(archives: DataFrame, folder: str) -> None:
    """Write each archive as a file into a folder that all executors mount; an attempt that runs twice writes the same bytes."""

    def put(rows) -> None:
        import os

        for row in rows:
            part = f"{folder}/.{row.archive}.{os.getpid()}"
            with open(part, "wb") as out:
                out.write(row.content)
            os.replace(part, f"{folder}/{row.archive}")

    archives.foreachPartition(put)
