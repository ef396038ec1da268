"""WARC archives with a two-level capture index.

Pages are written as records, one gzip member each, so that a record can be read by its range. The
index sorts captures by reversed-host URL key into blocks of ``BLOCK_LINES`` lines, compressed one by
one; a sparse directory holds each block's first key and range. A lookup binary-searches the index
parts, then the part's directory, reads the block's range, and from it the record's range.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearwell.llm.files import Reader, Writer
from nearwell.session import materialize, scratch_path

MIN_REVISIT_BYTES = 100
BLOCK_LINES = 1000
FILE_BYTES = 256 << 20
# Names and identifiers of the WARC 1.1 format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CAPTURE = ("surt string, page_id long, file string, offset long, length long, record_type string, "
           "payload_digest string")
BLOCK_ROW = ("part int, block int, first_surt string, first_page long, file string, offset long, "
             "length long, lines int, directory string")


def surt(url: str | None) -> str:
    """``http://www.Example.org/A?b`` as ``org,example,www)/a?b``; an empty key without ``://``."""
    if not url or "://" not in url:
        return ""
    rest = url.split("://", 1)[1].split("#", 1)[0].lower()
    end = min((i for i in (rest.find("/"), rest.find("?")) if i >= 0), default=len(rest))
    return ",".join(reversed(rest[:end].split("."))) + ")" + (rest[end:] or "/")


def _header(value: str) -> str:
    return value.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def _unheader(value: str) -> str:
    return value.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")


def record(page_id: int, url: str | None, payload: bytes, digest: str, refers_to: int | None,
           date: str) -> bytes:
    """One WARC record as a gzip member; a revisit holds the HTTP header without the payload."""
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
            f"Content-Length: {len(payload)}\r\n\r\n").encode()
    block = http + (payload if refers_to is None else b"")
    lines = [VERSION, f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
             f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {date}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_header(url)}")
    lines.append(f"WARC-Payload-Digest: sha256:{digest}")
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    head = "\r\n".join(lines).encode() + b"\r\n\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(head + block + b"\r\n\r\n") + packer.flush()


def parse(member: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers and payload of a record's gzip member."""
    data = zlib.decompress(member, 31)

    def split(raw: bytes) -> tuple[dict[str, str], bytes]:
        head, _, rest = raw.partition(b"\r\n\r\n")
        pairs = (line.partition(": ") for line in head.decode().split("\r\n")[1:])
        return {k: v for k, _, v in pairs}, rest

    warc, rest = split(data)
    http, payload = split(rest[:int(warc["Content-Length"])])
    return warc, http, payload


def _write(folder: str, date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                if out is None or out.size >= FILE_BYTES:
                    if out:
                        out.close()
                    out = Writer(folder, ".warc.gz")
                payload = (r["html"] or "").encode()
                offset, length = out.append(record(r["page_id"], r["url"], payload, r["digest"],
                                                   r["refers_to"], date))
                rows.append({"surt": surt(r["url"]), "page_id": r["page_id"], "file": out.path,
                             "offset": offset, "length": length,
                             "record_type": "response" if r["refers_to"] is None else "revisit",
                             "payload_digest": r["digest"]})
            if rows:
                yield pa.RecordBatch.from_pylist(rows)
        if out:
            out.close()
    return run


def write_archives(pages: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write every page as a record under ``folder``; the captures, as a written table.

    Of records with equal payloads of at least ``MIN_REVISIT_BYTES`` bytes, that of the smallest
    page_id is a response and the others revisit it. A null html is an empty payload; a null url
    leaves out the target; rows with a null page_id are left out; repeated rows are records each.
    Other columns are ignored.
    """
    html = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.where("page_id IS NOT NULL").select(
        F.col("page_id").cast("long"), "url", "html", F.sha2(html, 256).alias("digest"))
    long_ = F.octet_length(F.coalesce("html", F.lit(""))) >= MIN_REVISIT_BYTES
    heads = rows.where(long_).select("page_id", "digest")
    first = heads.groupBy("digest").agg(F.min("page_id").alias("refers_to"))
    again = heads.join(first, "digest").where("page_id <> refers_to").distinct()
    both = rows.join(again, ["page_id", "digest"], "left").select(
        "page_id", "url", "html", "digest", "refers_to")
    return materialize(both.mapInArrow(_write(folder, date), CAPTURE), "captures")


def _index(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        out, blocks, lines = None, [], []

        def close_block() -> None:
            body = "".join(f"{r['surt']} {r['page_id']} " + json.dumps(
                {k: r[k] for k in ("file", "offset", "length", "record_type", "payload_digest")},
                separators=(",", ":")) + "\n" for r in lines)
            offset, length = out.append(gzip.compress(body.encode(), 6, mtime=0))
            blocks.append({"first_surt": lines[0]["surt"], "first_page": lines[0]["page_id"],
                           "file": out.path, "offset": offset, "length": length,
                           "lines": len(lines)})
            lines.clear()

        for batch in batches:
            for r in batch.to_pylist():
                out = out or Writer(folder, ".cdx.gz")
                # a line is "key id json": blanks within a key would read as its end
                lines.append(r | {"surt": "".join("%20" if c.isspace() else c for c in r["surt"])})
                if len(lines) == BLOCK_LINES:
                    close_block()
        if lines:
            close_block()
        if out:
            out.close()
            directory = Writer(folder, ".idx")
            directory.append("".join(json.dumps(
                [b["first_surt"], b["file"], b["offset"], b["length"]]) + "\n"
                for b in blocks).encode())
            directory.close()
            yield pa.RecordBatch.from_pylist(
                [b | {"part": part, "block": i, "directory": directory.path}
                 for i, b in enumerate(blocks)],
                schema=pa.schema([("part", pa.int32()), ("block", pa.int32()),
                                  ("first_surt", pa.string()), ("first_page", pa.int64()),
                                  ("file", pa.string()), ("offset", pa.int64()),
                                  ("length", pa.int64()), ("lines", pa.int32()),
                                  ("directory", pa.string())]))
    return run


def write_index(captures: DataFrame, folder: str) -> DataFrame:
    """Write the capture index under ``folder``; the directory of its blocks, as a written table."""
    n = int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = captures.repartitionByRange(n, "surt", "page_id").sortWithinPartitions(
        "surt", "page_id")
    return materialize(ordered.mapInArrow(_index(folder), BLOCK_ROW), "directory")


def _lines(reader: Reader, block: dict) -> Iterator[tuple[str, int, dict]]:
    raw = reader.read(block["file"], block["offset"], block["length"])
    for line in gzip.decompress(raw).decode().split("\n")[:-1]:
        key, page_id, rest = line.split(" ", 2)
        yield key, int(page_id), json.loads(rest)


READ = ("page_id long, url string, payload binary, payload_bytes long, payload_digest string, "
        "record_type string, refers_to long")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    reader = Reader()
    for batch in batches:
        for block in batch.to_pylist():
            rows, held = [], 0
            for _, page_id, at in _lines(reader, block):
                warc, http, payload = parse(reader.read(at["file"], at["offset"], at["length"]))
                revisit = warc["WARC-Type"] == "revisit"
                stated = warc["WARC-Payload-Digest"].removeprefix("sha256:")
                digest = stated if revisit else hashlib.sha256(payload).hexdigest()
                if digest != stated:
                    raise ValueError(f"record of page {page_id} in {at['file']} is damaged")
                target = warc.get("WARC-Target-URI")
                rows.append({
                    "page_id": int(warc["WARC-Record-ID"][len("<urn:page:"):-1]),
                    "url": None if target is None else _unheader(target),
                    "payload": None if revisit else payload,
                    "payload_bytes": int(http["Content-Length"]), "payload_digest": digest,
                    "record_type": warc["WARC-Type"],
                    "refers_to": int(warc["WARC-Refers-To"][len("<urn:page:"):-1])
                    if revisit else None})
                held += len(payload)
                if held > 4 << 20:
                    yield pa.RecordBatch.from_pylist(rows, schema=_READ_SCHEMA)
                    rows, held = [], 0
            yield pa.RecordBatch.from_pylist(rows, schema=_READ_SCHEMA)


_READ_SCHEMA = pa.schema([
    ("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()),
    ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
    ("record_type", pa.string()), ("refers_to", pa.int64())])


def read_archives(directory: DataFrame) -> DataFrame:
    """Every record, read through the index: block by block, each record by its range.

    A response's digest is computed from the payload read, and has to be the stated one; a revisit
    has the length and digest of the full payload, and no payload.
    """
    n = int(directory.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return directory.repartition(n).mapInArrow(_read, READ)


@dataclass(frozen=True)
class Parts:
    """First key and directory file of each index part, in order: one entry per partition."""

    keys: list[str]
    directories: list[str]


def index_parts(directory: DataFrame) -> Parts:
    """The upper level of the index; as many rows as the index has partitions come to the driver."""
    rows = directory.where("block = 0").select("part", "first_surt", "directory").orderBy(
        "part").collect()
    return Parts([r["first_surt"] for r in rows], [r["directory"] for r in rows])


def _find(parts: Parts):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, known = Reader(), {}
        for batch in batches:
            rows = []
            for url in batch.column("url").to_pylist():
                key = "".join("%20" if c.isspace() else c for c in surt(url))
                part = max(0, bisect.bisect_left(parts.keys, key) - 1)
                while part < len(parts.keys) and parts.keys[part] <= key:
                    name = parts.directories[part]
                    if name not in known:
                        text = reader.read_all(name).decode()
                        known[name] = [json.loads(x) for x in text.split("\n")[:-1]]
                    blocks = known[name]
                    i = max(0, bisect.bisect_left(blocks, key, key=lambda b: b[0]) - 1)
                    while i < len(blocks) and blocks[i][0] <= key:
                        _, file, offset, length = blocks[i]
                        for k, page_id, at in _lines(reader, {"file": file, "offset": offset,
                                                              "length": length}):
                            if k == key:
                                rows.append({"url": url, "surt": key, "page_id": page_id} | at)
                        i += 1
                    part += 1
            if rows:
                yield pa.RecordBatch.from_pylist(rows)
    return run


def lookup(urls: DataFrame, directory: DataFrame) -> DataFrame:
    """Captures of each row's url: (url, surt, page_id, file, offset, length, record_type, ...)."""
    return urls.where("url IS NOT NULL").select("url").mapInArrow(
        _find(index_parts(directory)),
        "url string, surt string, page_id long, file string, offset long, length long, "
        "record_type string, payload_digest string")


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write the pages' archives and index to the shared folder and read all records back."""
    folder = scratch_path(spark, "warc")
    captures = write_archives(pages, f"{folder}/archives")
    return read_archives(write_index(captures, f"{folder}/index"))
