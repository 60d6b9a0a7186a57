"""WARC archives written from and read into a chunked record table.

A payload is a run of rows (record, chunk number, bytes), each of CHUNK_BYTES at most, with the digest of the
payload up to and including the row; a task holds one chunk and one digest state, never a record.  An oversized
payload becomes a WARC record with continuation segments, one per row.  Archives go through Spark's text
writer, with the blank lines that end a record as separator, so they commit like any table and lie in any
store that Spark writes to.  No block holds the byte string that opens the next record (a segment ends inside
it), so Spark's text reader can read the archives back by that string.  Archives are compressed whole, which
also keeps the reader from splitting them: at a split inside a separator of several bytes it can lose a record.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm.common import new_folder, ship, small_side, stored

CHUNK_BYTES = 32_768
#: Payloads of fewer bytes are always written in full.
REVISIT_BYTES = 0
VERSION = b"WARC/1.1\r\n"
RECORD_END = "\r\n\r\n"
SEPARATOR = RECORD_END.encode() + VERSION
CRAWLED = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes of records in one batch of results.
BATCH_BYTES = 4_000_000


def base32(sha1) -> str:
    return base64.b32encode(sha1.digest()).decode()


def chunk_table(pages: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """page_id, url, mark, size, chunk, chunks, data: the payload of every page in rows of bounded size, in order.

    mark is a hash that tells pages with one page_id apart.  An empty payload is one empty row.  Columns of
    pages other than page_id, url and html are left out; all others of the input frame are passed on.
    """
    passed = [c for c in pages.columns if c not in ("page_id", "url", "html", "mark", "size")]
    payload = F.coalesce("html", F.lit("")).cast("binary")
    marked = pages.select("page_id", "url", *passed, payload.alias("payload"), F.xxhash64(payload).alias("mark"), F.octet_length(payload).alias("size"))
    chunks = F.greatest(F.lit(1), F.ceil(F.col("size") / chunk_bytes)).cast("int")
    rows = marked.withColumn("chunks", chunks).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    return rows.withColumn("data", F.substring("payload", F.col("chunk") * chunk_bytes + 1, F.lit(chunk_bytes))).drop("payload")


def payload_digests(chunks: DataFrame) -> DataFrame:
    """page_id, mark, size and digest of every payload, from chunk rows that follow each other."""
    ship(__name__)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha1 = None
        for batch in batches:
            numbers, counts = batch.column("chunk").to_pylist(), batch.column("chunks").to_pylist()
            digests = []
            for number, count, data in zip(numbers, counts, batch.column("data")):
                if number == 0:
                    sha1 = hashlib.sha1()
                sha1.update(data.as_buffer())
                digests.append(base32(sha1) if number == count - 1 else None)
            made = pa.array(digests, pa.string())
            columns = [batch.column(c) for c in ("page_id", "mark", "size")]
            yield pa.RecordBatch.from_arrays([*columns, made], names=["page_id", "mark", "size", "digest"]).filter(made.is_valid())

    kind = dict(chunks.dtypes)["page_id"]
    return chunks.select("page_id", "mark", "size", "chunk", "chunks", "data").mapInArrow(work, f"page_id {kind}, mark long, size int, digest string")


def revisits(digests: DataFrame, least_bytes: int = REVISIT_BYTES) -> DataFrame:
    """page_id, mark and refers_to of the pages whose payload an earlier page_id holds; null ids come last.

    Rows with the smallest page_id of a payload are all responses, also when that row is repeated.
    """
    first = digests.filter(F.col("size") >= least_bytes).groupBy("digest", "size").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n"))
    first = first.filter("n > 1 AND refers_to IS NOT NULL").select(F.col("digest").alias("first_digest"), F.col("size").alias("first_size"), "refers_to")
    same = (F.col("digest") == F.col("first_digest")) & (F.col("size") == F.col("first_size"))
    later = digests.join(first, same).filter(~F.col("page_id").eqNullSafe(F.col("refers_to")))
    return later.select(F.col("page_id").alias("later_id"), F.col("mark").alias("later_mark"), F.col("digest").alias("later_digest"), "refers_to").distinct()


def record_id(page_id: object, digest: str) -> str:
    return f"<{uuid.UUID(bytes=hashlib.md5(f'{page_id}:{digest}'.encode()).digest()).urn}>"


def _head(fields: list[tuple[str, object]], block: bytes) -> bytes:
    lines = [f"{name}: {value}" for name, value in fields if value is not None]
    lines += [f"WARC-Date: {CRAWLED}", f"WARC-Block-Digest: sha1:{base32(hashlib.sha1(block))}", f"Content-Length: {len(block)}"]
    return VERSION + "\r\n".join(lines).encode() + b"\r\n\r\n" + block


def _blocks(data: bytes) -> list[bytes]:
    """Cut a block wherever the opening of a record would stand inside, its head and its end included."""
    out, edge = [], RECORD_END.encode()
    while (at := (edge + data + edge).find(SEPARATOR)) >= 0:
        out.append(data[: at + 4])
        data = data[at + 4 :]
    return [*out, data]


def _records(batches: Iterable[pa.RecordBatch]) -> Iterator[bytes]:
    """The records of a run of chunk rows; a row's name is its task and its number there."""
    task, row, segment, sha1 = TaskContext.get().partitionId(), 0, 0, None
    yield _head([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<{uuid.uuid5(uuid.NAMESPACE_URL, f'part:{task}').urn}>"), ("Content-Type", "application/warc-fields")], b"software: record table\r\n")
    for batch in batches:
        for x in batch.to_pylist():
            last_chunk = x["chunk"] == x["chunks"] - 1
            if x["chunk"] == 0:
                row, segment, sha1 = row + 1, 0, hashlib.sha1()
                http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {x['size']}\r\n\r\n".encode()
            name = [("X-Page-ID", x["page_id"]), ("X-Row", f"{task}-{row}")]
            if x["refers_to"] is not None:
                if x["chunk"] == 0:
                    url = None if x["url"] is None else x["url"].replace("\r", "%0D").replace("\n", "%0A")
                    yield _head(
                        [("WARC-Type", "revisit"), ("WARC-Record-ID", record_id(x["page_id"], x["later_digest"])), ("WARC-Target-URI", url), *name, ("WARC-Profile", PROFILE),
                         ("WARC-Refers-To", record_id(x["refers_to"], x["later_digest"])), ("X-Refers-To-Page", x["refers_to"]),
                         ("WARC-Payload-Digest", f"sha1:{x['later_digest']}"), ("Content-Type", "application/http; msgtype=response")], http)
                continue
            sha1.update(x["data"])
            blocks = _blocks((http if x["chunk"] == 0 else b"") + x["data"])
            for k, block in enumerate(blocks):
                segment += 1
                last = last_chunk and k == len(blocks) - 1
                many = segment > 1 or not last
                origin = f"<{uuid.uuid5(uuid.NAMESPACE_URL, f'row:{task}-{row}').urn}>"
                fields = [("WARC-Type", "response" if segment == 1 else "continuation"), *name, ("WARC-Segment-Number", segment if many else None)]
                if segment == 1:
                    url = None if x["url"] is None else x["url"].replace("\r", "%0D").replace("\n", "%0A")
                    fields += [("WARC-Record-ID", origin if many else record_id(x["page_id"], base32(sha1))), ("WARC-Target-URI", url), ("Content-Type", "application/http; msgtype=response")]
                else:
                    fields += [("WARC-Record-ID", f"<{uuid.uuid5(uuid.NAMESPACE_URL, f'row:{task}-{row}:{segment}').urn}>"), ("WARC-Segment-Origin-ID", origin)]
                if last:
                    fields += [("WARC-Payload-Digest", f"sha1:{base32(sha1)}"), ("WARC-Segment-Total-Length", len(http) + x["size"] if many else None)]
                yield _head(fields, block)


def write_archives(pages: DataFrame, path: str, chunk_bytes: int = CHUNK_BYTES, least_bytes: int = REVISIT_BYTES) -> None:
    """One record per page into archives under `path`; pages needs page_id, url and html.

    A null html is an empty payload, a null url or page_id leaves its field out.  An empty table gives archives
    without pages.
    """
    ship(__name__)
    needed = pages.select("page_id", "url", "html")
    digests = stored(payload_digests(chunk_table(needed, chunk_bytes)), "digests")
    later = small_side(stored(revisits(digests, least_bytes), "revisits"))
    mark = F.xxhash64(F.coalesce("html", F.lit("")).cast("binary"))
    told = needed.join(later, F.col("page_id").eqNullSafe(F.col("later_id")) & (mark == F.col("later_mark")), "left").drop("later_id", "later_mark")

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some, size = [], 0
        for record in _records(batches):
            some.append(record)
            size += len(record)
            if size >= BATCH_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.binary())], names=["record"])
                some, size = [], 0
        if some:
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.binary())], names=["record"])

    records = chunk_table(told, chunk_bytes).drop("mark").mapInArrow(work, "record binary")
    records.select(F.col("record").cast("string")).write.option("lineSep", RECORD_END).option("compression", "gzip").text(path)


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Fields and block of one record as it stands between separators; its length and digest are checked."""
    raw = raw[len(VERSION) :] if raw.startswith(VERSION) else raw
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n"))
    size = int(fields["Content-Length"])
    block = rest[:size]
    if len(block) < size or rest[size:] not in (b"", RECORD_END.encode()):
        raise ValueError(f"record {fields.get('WARC-Record-ID')}: {len(rest)} bytes where {size} are announced")
    if fields["WARC-Block-Digest"] != f"sha1:{base32(hashlib.sha1(block))}":
        raise ValueError(f"record {fields.get('WARC-Record-ID')}: wrong block digest")
    return fields, block


ROW = "page_id string, url string, record_row string, segment int, last boolean, record_type string, refers_to string, payload_bytes long, payload_digest string, data binary"


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """The chunked record table of archives: a row per response segment or revisit.

    data is the part of the payload that the row holds; whole responses are already digested and carry none.
    """
    ship(__name__)

    def row(raw: bytes) -> dict | None:
        fields, block = parse(raw)
        if fields["WARC-Type"] == "warcinfo":
            return None
        segment = int(fields.get("WARC-Segment-Number", 1))
        if segment == 1:
            http, _, block = block.partition(b"\r\n\r\n")
        digest = fields.get("WARC-Payload-Digest", "sha1:")[5:] or None
        whole = "WARC-Segment-Number" not in fields
        out = {"page_id": fields.get("X-Page-ID"), "url": fields.get("WARC-Target-URI"), "record_row": fields["X-Row"], "segment": segment, "last": digest is not None}
        out |= {"record_type": "response", "refers_to": None, "payload_bytes": len(block), "payload_digest": digest, "data": None if whole else block}
        if fields["WARC-Type"] == "revisit":
            size = next(int(line.split(b": ")[1]) for line in http.split(b"\r\n") if line.startswith(b"Content-Length"))
            out |= {"record_type": "revisit", "refers_to": fields["X-Refers-To-Page"], "payload_bytes": size}
        elif whole and base32(hashlib.sha1(block)) != digest:
            raise ValueError(f"row {out['record_row']}: wrong payload digest")
        return out

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r for r in map(row, batch.column("record").to_pylist()) if r]
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=ARROW_ROW)

    lines = spark.read.option("lineSep", SEPARATOR.decode()).text(path)
    return lines.select(F.col("value").cast("binary").alias("record")).mapInArrow(work, ROW)


ARROW_ROW = pa.schema([
    ("page_id", pa.string()), ("url", pa.string()), ("record_row", pa.string()), ("segment", pa.int32()), ("last", pa.bool_()), ("record_type", pa.string()),
    ("refers_to", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("data", pa.binary()),
])


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per page of archives; segments of a payload are digested in order and checked against its record.

    Only the segments of oversized payloads are shuffled with their bytes.
    """
    ship(__name__)
    kept = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, sha1, size = None, None, 0
        for batch in batches:
            rows = []
            for x in batch.to_pylist():
                if x["data"] is None:
                    rows.append({c: x[c] for c in kept})
                    continue
                if x["segment"] == 1:
                    first, sha1, size = x, hashlib.sha1(), 0
                if first is None or first["record_row"] != x["record_row"]:
                    raise ValueError(f"row {x['record_row']}: its first segment is missing")
                sha1.update(x["data"])
                size += len(x["data"])
                if x["last"]:
                    if base32(sha1) != x["payload_digest"]:
                        raise ValueError(f"row {x['record_row']}: wrong payload digest")
                    rows.append({c: first[c] for c in kept} | {"payload_bytes": size, "payload_digest": x["payload_digest"]})
                    first = None
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([ARROW_ROW.field(c) for c in kept]))

    ordered = read_records(spark, path).repartition("record_row").sortWithinPartitions("record_row", "segment")
    return ordered.mapInArrow(work, "page_id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string")


def archive_report(pages: DataFrame, chunk_bytes: int = CHUNK_BYTES, least_bytes: int = REVISIT_BYTES) -> DataFrame:
    """Write pages into archives in the shared folder and return what reading them gives."""
    path = new_folder(pages.sparkSession, "warc")
    write_archives(pages, path, chunk_bytes, least_bytes)
    kind = pages.schema["page_id"].dataType
    found = read_archives(pages.sparkSession, path)
    return found.select(F.col("page_id").cast(kind), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind), "url")
