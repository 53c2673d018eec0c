"""WARC archives: monolithic gzip files, a normaliser that makes every record a member of its own, an offset index.

1. :func:`write_monolithic` writes each partition's records as ``.warc.gz`` files of one gzip stream each.
2. :func:`normalise` inflates each such stream once, front to back, one record in memory at a time, rewrites every record as
   its own gzip member and writes a sidecar index ``offset length record-id type`` beside the file.
3. :func:`read_indexed` reads records by the index: seek, inflate one member, parse.

Records with payloads equal to that of an earlier page are ``revisit`` records without payload; readers resolve them
through the payload digest.  Which page is first is found on digests alone, with partial minima, so a payload that a
third of all pages share is no bottleneck.

Files are written through Hadoop-independent file systems named by the shared folder's URI, under names of one task
attempt; the manifest, a table written when all tasks are done, names those that count.

Defined cases: a null html is an empty payload; a null url is empty; line breaks and other control characters in a url are
percent-encoded; a null page_id is written as such and never named as first unless no other id has the payload; rows that
repeat an id and its payload are captures of their own, each a response; an empty table writes no file and gives an empty
result; damaged members raise.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tiermill.llm.common import stored, whole
from tiermill.operators.joins import bounded_broadcast
from tiermill.session import shared_dir

FILE_BYTES = 256 << 20  # inflated bytes after which a partition begins another file
READ = 1 << 20
DATE = "1970-01-01T00:00:00Z"
_MANIFEST = "file string, records long, bytes long"


def open_fs(uri: str):
    from pyarrow import fs
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def record_id(page) -> str:
    return f"<urn:page:{'' if page is None else page}>"


def page_of(record: str | None):
    m = re.fullmatch(r"<urn:page:(-?\d+)>", record or "")
    return int(m[1]) if m else None


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def build_record(page, url: str, payload: bytes, first) -> bytes:
    """A response record, or, when ``first`` names another page, a revisit record."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    head = {"WARC-Type": "response", "WARC-Record-ID": record_id(page), "WARC-Date": DATE,
            "WARC-Target-URI": re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or ""),
            "WARC-Payload-Digest": f"sha1:{digest(payload)}"}
    if first is None:
        block = http + b"Content-Length: %d\r\n\r\n" % len(payload) + payload
    else:
        block = http + b"\r\n"
        head |= {"WARC-Type": "revisit", "WARC-Refers-To": record_id(first),
                 "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"}
    head |= {"Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse_head(raw: bytes) -> dict[str, str]:
    lines = raw.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    return {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if x)}


def split_records(chunks: Iterator[bytes]) -> Iterator[tuple[dict, bytes]]:
    """``header, whole record`` of an inflated stream."""
    buf, at, more = b"", 0, True
    chunks = iter(chunks)

    def fill():
        nonlocal buf, at, more
        x = next(chunks, None)
        more = x is not None
        if more:
            buf, at = buf[at:] + x, 0

    while True:
        end = buf.find(b"\r\n\r\n", at)
        while end < 0 and more:
            fill()
            end = buf.find(b"\r\n\r\n", at)
        if end < 0:
            if buf[at:].strip():
                raise ValueError("the stream ends inside a record")
            return
        head = parse_head(buf[at:end])
        size = end + 4 - at + int(head["content-length"]) + 4
        parts, have = [], len(buf) - at
        while have < size and more:  # a long record is gathered once, not copied again with every chunk
            x = next(chunks, None)
            more = x is not None
            if more:
                parts.append(x)
                have += len(x)
        if parts:
            buf, at = b"".join([buf[at:], *parts]), 0
        if len(buf) - at < size:
            raise ValueError("the stream ends inside a record")
        yield head, buf[at:at + size]
        at += size


def inflate(f) -> Iterator[bytes]:
    """The inflated bytes of a gzip file, one or more members, in bounded pieces."""
    z, begun = zlib.decompressobj(31), False
    while raw := f.read(READ):
        while raw:
            begun = True
            yield z.decompress(raw, 8 * READ)
            while z.unconsumed_tail:
                yield z.decompress(z.unconsumed_tail, 8 * READ)
            raw = z.unused_data
            if z.eof:
                z, begun = zlib.decompressobj(31), False
    if begun:
        raise ValueError("the gzip stream is cut off")


def _manifest(rows) -> pa.RecordBatch:
    name, n, size = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(name, pa.string()), pa.array(n, pa.int64()), pa.array(size, pa.int64())],
                                      ["file", "records", "bytes"])


def write_monolithic(pages: DataFrame, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url",
                     html_col: str = "html") -> str:
    """Write all pages; returns the folder.  Pages with equal payloads of at least ``min_bytes`` become revisits of the
    one with the smallest id."""
    spark = pages.sparkSession
    folder = shared_dir(spark, "warc-monolithic")
    html = whole(F.col(html_col))
    x = pages.select(F.col(id_col).cast("long").alias("page"), F.col(url_col).cast("string").alias("url"), html.alias("html"),
                     F.sha2(html, 256).alias("key"))
    first = (x.where(F.octet_length("html") >= min_bytes).groupBy("key").agg(F.min("page").alias("first"), F.count("*").alias("n"))
              .where("first IS NOT NULL AND n > 1").select("key", "first"))
    # payloads found more than once: broadcast where their measured size allows, so that html isn't shuffled; else a stored
    # side, against which the pages of a hot payload can be split
    x = x.join(bounded_broadcast(first), "key", "left").select(
        "page", "url", "html", F.when(~F.col("page").eqNullSafe(F.col("first")), F.col("first")).alias("refers"))

    def write(batches):
        system, path = open_fs(folder)
        system.create_dir(path, recursive=True)
        out, rows = None, []

        def close():
            out.write(z.flush())
            out.close()
            rows.append((name, n, size))

        for b in batches:
            for page, url, text, refers in zip(*[c.to_pylist() for c in b.columns]):
                if out is None:
                    name, n, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out, z = system.open_output_stream(f"{path}/{name}", compression=None), zlib.compressobj(6, wbits=31)
                raw = build_record(page, url, text.encode(), refers)
                out.write(z.compress(raw))
                n, size = n + 1, size + len(raw)
                if size >= FILE_BYTES:
                    close()
                    out = None
        if out is not None:
            close()
        if rows:
            yield _manifest(rows)

    x.mapInArrow(write, _MANIFEST).write.parquet(f"{folder}/manifest")
    return folder


def _over_files(spark: SparkSession, folder: str, each, schema: str) -> DataFrame:
    """``each(system, path, file)`` for every file of the manifest, a task for each."""
    files = spark.read.parquet(f"{folder}/manifest").select("file")

    def run(batches):
        system, path = open_fs(folder)
        for b in batches:
            for name in b.column(0).to_pylist():
                yield from each(system, path, name)

    return files.repartition(max(1, files.count()), "file").mapInArrow(run, schema)


def normalise(spark: SparkSession, folder: str) -> str:
    """Rewrite every file of ``folder`` with a gzip member per record and a sidecar index; returns the new folder."""
    target = shared_dir(spark, "warc-records")

    def each(system, path, name):
        to_system, to = open_fs(target)
        to_system.create_dir(to, recursive=True)
        new, at, n, index = f"{uuid.uuid4().hex}.warc.gz", 0, 0, []
        with system.open_input_stream(f"{path}/{name}", compression=None) as f, to_system.open_output_stream(f"{to}/{new}", compression=None) as out:
            for head, raw in split_records(inflate(f)):
                z = zlib.compressobj(6, wbits=31)
                member = z.compress(raw) + z.flush()
                out.write(member)
                index.append(f"{at} {len(member)} {head['warc-record-id']} {head['warc-type']}\n")
                at += len(member)
                n += 1
        with to_system.open_output_stream(f"{to}/{new}.idx", compression=None) as out:
            out.write("".join(index).encode())
        yield _manifest([(new, n, at)])

    _over_files(spark, folder, each, _MANIFEST).write.parquet(f"{target}/manifest")
    return target


def read_indexed(spark: SparkSession, folder: str, with_payload: bool = False) -> DataFrame:
    """``page_id, url, record_type, payload_digest, payload_bytes, refers_to`` of every record, read by the index."""
    def each(system, path, name):
        names = ["page_id", "url", "record_type", "payload_digest", "payload_bytes", "refers_to", "payload"]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
        with system.open_input_stream(f"{path}/{name}.idx", compression=None) as f:
            index = f.read().decode().splitlines()
        rows, held = [], 0
        with system.open_input_file(f"{path}/{name}") as f:
            for line in index:
                at, size, rid, kind = line.split(" ")
                z = zlib.decompressobj(31)
                raw = z.decompress(f.read_at(int(size), int(at)))
                (head, _), = split_records(iter([raw]))
                if not z.eof or head["warc-record-id"] != rid or head["warc-type"] != kind:
                    raise ValueError(f"{name}: the index doesn't fit at {at}")
                block = raw[raw.index(b"\r\n\r\n") + 4:-4]
                payload = block[block.index(b"\r\n\r\n") + 4:]
                said = head["warc-payload-digest"].removeprefix("sha1:")
                if kind == "response" and digest(payload) != said:
                    raise ValueError(f"{name}: the payload at {at} doesn't match its digest")
                whole_ = kind == "response"
                rows.append((page_of(rid), head["warc-target-uri"], kind, said, len(payload) if whole_ else None,
                             page_of(head.get("warc-refers-to")), payload if with_payload and whole_ else None))
                held += len(payload)
                if len(rows) >= 5000 or held > 16 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return _over_files(spark, folder, each, "page_id long, url string, record_type string, payload_digest string, "
                                            "payload_bytes long, refers_to long, payload binary")


def archived(pages: DataFrame, min_bytes: int = 0, **names) -> DataFrame:
    """Write, normalise and read back: ``page_id, payload_bytes, payload_digest, record_type, refers_to`` per page.

    A revisit's payload is that of the response with its digest.
    """
    spark = pages.sparkSession
    records = stored(read_indexed(spark, normalise(spark, write_monolithic(pages, min_bytes, **names))).drop("payload"), "warc-records")
    response, revisit = records.where("record_type = 'response'"), records.where("record_type = 'revisit'")
    wanted = revisit.select("payload_digest").distinct()
    size = bounded_broadcast(response.join(wanted, "payload_digest", "left_semi").groupBy("payload_digest")
                                     .agg(F.max("payload_bytes").alias("full")))
    revisit = revisit.join(size, "payload_digest", "left").withColumn("payload_bytes", F.coalesce("payload_bytes", "full"))
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return response.select(columns).unionByName(revisit.select(columns))
