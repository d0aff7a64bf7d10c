"""Web archives without repeated payloads.

Pages become WARC records, gzip-compressed one by one.  Of pages with one
payload the one with the largest id is written whole; the others become revisit
records that name it.  Only digests and ids are shuffled to find out which is
which; up to ``MAX_BROADCAST_DIGESTS`` repeated digests then travel to the rows,
beyond it the rows are shuffled to them.  Reading turns the archives back into rows and resolves the revisits by a
join of their headers with those of the responses.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import zlib
from collections.abc import Iterator

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from edgetables.llm.common import Folder, arrow_schema, batch_of, write_file

LEAST_BYTES = 1000  # shorter payloads are always written whole
FILE_BYTES = 8_000_000
MAX_BROADCAST_DIGESTS = 500_000  # of 20 bytes, with an id: 50 MB in memory
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CRLF = b"\r\n"
LIST = "file string, n_records bigint"
RECORDS = (
    "page_id bigint, url string, record_id string, record_type string, payload_digest string, "
    "payload_bytes bigint, refers_to_record string, payload binary"
)


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}:{digest}>"


def warc_record(
    page_id: int | None, url: str | None, payload: bytes, digest: str, original: int | None, revisit: bool, date: str
) -> bytes:
    """One record; a revisit holds the HTTP head alone and refers to the record of page ``original``."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": record_id(page_id, digest),
        "WARC-Date": date,
        "WARC-Payload-Digest": "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode(),
        "Content-Type": "application/http; msgtype=response",
    }
    if url is not None:
        head["WARC-Target-URI"] = url.translate({10: "%0A", 13: "%0D"})
    if revisit:
        head |= {"WARC-Profile": PROFILE, "WARC-Refers-To": record_id(original, digest)}
    block = http if revisit else http + payload
    head["Content-Length"] = str(len(block))
    lines = "".join(f"{name}: {value}\r\n" for name, value in head.items())
    return b"WARC/1.1\r\n" + lines.encode() + CRLF + block + CRLF + CRLF


def members(content: memoryview) -> Iterator[bytes]:
    """The gzip members of a file, each decompressed."""
    at = 0
    while at < len(content):
        inflate, parts = zlib.decompressobj(31), []
        while not inflate.eof:
            step = content[at : at + 65_536]
            if not step:
                raise ValueError("the archive ends within a record")
            parts.append(inflate.decompress(step))
            at += len(step)
        at -= len(inflate.unused_data)
        yield b"".join(parts)


def parse_record(record: bytes) -> tuple:
    """A row of ``RECORDS`` from one record; digests of responses are computed from what is there."""
    head, _, block = record.partition(CRLF + CRLF)
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines)
    name = fields["WARC-Record-ID"]
    page = name.split(":")[2]
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    kind = fields["WARC-Type"]
    payload = None
    if kind == "response":
        payload = block[: int(fields["Content-Length"])].partition(CRLF + CRLF)[2]
        if hashlib.sha1(payload).hexdigest() != digest:
            raise ValueError(f"the payload of {name} does not match its digest")
    return (
        None if page == "none" else int(page),
        fields.get("WARC-Target-URI"),
        name,
        kind,
        digest,
        None if payload is None else len(payload),
        fields.get("WARC-Refers-To"),
        payload,
    )


def write_warc(pages: DataFrame, uri: str | None = None, least_bytes: int = LEAST_BYTES, date: str = DATE) -> Folder:
    """Write ``pages (page_id, url, html)`` as archives and return their folder.

    A null html is an empty payload.  Payloads below ``least_bytes`` are always
    responses.  If several rows share the largest id of a payload, all of them
    are responses; where no row of a payload has an id, all are.  A missing url
    leaves its header out.  An empty table writes no archive.  Further columns
    are not looked at.
    """
    folder = Folder(pages.sparkSession, uri)
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload")
    ).withColumn("digest", F.sha1("payload"))
    repeated = (
        rows.filter(F.octet_length("payload") >= least_bytes)
        .groupBy("digest")
        .agg(F.max("page_id").alias("original"), F.count(F.lit(1)).alias("copies"))
        .filter("copies > 1 and original is not null")
        .select(F.unhex("digest").alias("key"), "original")
    )
    repeated = folder.store(repeated, "repeated")
    few = repeated.count() <= MAX_BROADCAST_DIGESTS
    decided = rows.join(F.broadcast(repeated) if few else repeated, F.unhex("digest") == F.col("key"), "left").select(
        "page_id",
        "url",
        "payload",
        "digest",
        "original",
        F.coalesce(~F.col("original").eqNullSafe(F.col("page_id")) & F.col("original").isNotNull(), F.lit(False)).alias("revisit"),
    )
    target = folder.uri

    def write(batches: Iterator) -> Iterator:
        import pyarrow as pa

        task = TaskContext.get()
        part, attempt = task.partitionId(), task.taskAttemptId()
        held, size, number = [], 0, 0

        def out():
            # The attempt is part of the name, so files of attempts that failed are never listed.
            name = f"{part:06d}-{attempt}-{number:06d}.warc.gz"
            write_file(f"{target}/files/{name}", b"".join(held))
            return pa.RecordBatch.from_pydict({"file": [name], "n_records": pa.array([len(held)], pa.int64())})

        for batch in batches:
            for i in range(batch.num_rows):
                page, url, content, digest, original, revisit = (column[i].as_py() for column in batch.columns)
                held.append(gzip.compress(warc_record(page, url, content, digest, original, revisit, date), 4, mtime=0))
                size += len(held[-1])
                if size >= FILE_BYTES:
                    yield out()
                    held, size, number = [], 0, number + 1
        if held:
            yield out()

    folder.store(decided.mapInArrow(write, LIST), "list")
    return folder


def read_records(spark: SparkSession, uri: str) -> DataFrame:
    """Every record of the archives as a row; revisits have no payload.

    A page without an id or url gives nulls there, an empty payload an empty
    binary.  Rows that were repeated come back as often; archives of no rows give
    no rows.  A record cut short or unlike its digest raises.
    """
    listed = spark.read.schema(LIST).parquet(f"{uri}/list")
    if listed.isEmpty():
        return spark.createDataFrame([], RECORDS)
    content = (
        spark.read.format("binaryFile")
        .load(f"{uri}/files")
        .select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
        .join(listed.select("file"), "file", "left_semi")
        .select("content")
    )

    schema = arrow_schema(RECORDS)

    def parse(batches: Iterator) -> Iterator:
        for batch in batches:
            for i in range(batch.num_rows):
                rows, held = [], 0
                for record in members(memoryview(batch.column(0)[i].as_buffer())):
                    rows.append(parse_record(record))
                    held += len(record)
                    if held >= FILE_BYTES:
                        yield batch_of(rows, schema)
                        rows, held = [], 0
                if rows:
                    yield batch_of(rows, schema)

    return content.mapInArrow(parse, RECORDS)


def resolve_revisits(records: DataFrame, with_payload: bool = False) -> DataFrame:
    """Records with the size, and if asked for the payload, of the response that a revisit refers to.

    ``refers_to`` is the page id of that response, null for responses; if several
    rows share id and payload, their responses are equal and one stands for all.
    A revisit without its response keeps nulls; no records give no rows.
    """
    given = ["payload_bytes", *(["payload"] if with_payload else [])]
    responses = (
        records.filter("record_type = 'response'")
        .groupBy(F.col("record_id").alias("refers_to_record"))
        .agg(F.first("page_id").alias("refers_to"), *[F.first(c).alias(f"found_{c}") for c in given])
    )
    return records.join(responses, "refers_to_record", "left").select(
        "page_id",
        "url",
        "record_type",
        "payload_digest",
        "refers_to",
        *[F.coalesce(c, f"found_{c}").alias(c) for c in given],
    )
