"""Dictionary-compressed WARC archives.

Each archive starts with a skippable frame (magic 0x184D2A5D) that holds a Zstandard dictionary built from records of
that archive; every record after it (a warcinfo record first) is a frame of its own, compressed with that dictionary, so that
a record can be read from its offset alone. Payloads of at least ``REVISIT_BYTES`` bytes that occur more than once are stored
once, by the greatest page_id; the others are revisit records that name its URI, its page_id and the digest.

Archives are written in the folder that the session shares (spark.checkpoint.dir), each under a name of its task attempt; the
table of archives in the same folder lists those of the attempts that counted, and only these are read. So two attempts of a
task, at once or after a loss, never touch each other's archives, and what a failed one leaves is never read.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkdossier.session import cut, scratch

#: Fixed value: the skippable frame that holds a dictionary, little-endian.
DICTIONARY_MAGIC = 0x184D2A5D
REVISIT_BYTES = 1000
#: Records and bytes the dictionary is built from, and its size.
SAMPLE_RECORDS, SAMPLE_BYTES, DICTIONARY_BYTES = 1000, 2 << 20, 64 << 10
#: An archive is closed beyond so many bytes.
ARCHIVE_BYTES = 256 << 20
LEVEL = 3
#: Repeated digests are broadcast (about 100 bytes each) up to so many; beyond, payloads are shuffled to them.
BROADCAST_ROWS = 200_000


def uri_of(page_id: int | None, url: str | None) -> str:
    """A WARC target URI: the url without blanks, else a URN of the page."""
    return quote(url or "", safe="%/:?#[]@!$&'()*+,;=~-._") or f"urn:page:{'' if page_id is None else page_id}"


def info_record(date: str, name: str) -> bytes:
    """The warcinfo record that begins an archive."""
    block = b"software: sparkdossier\r\nformat: WARC File Format 1.1\r\n"
    head = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>", f"WARC-Date: {date}", f"WARC-Filename: {name}",
            "Content-Type: application/warc-fields", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def record(kind: str, page_id: int | None, number: int, url: str | None, date: str, payload: bytes, digest: str, refers_to: int | None, refers_url: str | None = None) -> bytes:
    """One WARC/1.1 record. A revisit has the HTTP head only; its payload is the one it refers to.

    The target URI must hold no blanks, so the url as it is stands in a header of its own, as a JSON string.
    """
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{number}/{digest}')}>",
        f"WARC-Target-URI: {uri_of(page_id, url)}",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http;msgtype=response",
        f"WARC-Page-ID: {'' if page_id is None else page_id}",
    ]
    if url is not None:
        head.append(f"WARC-Page-URL: {json.dumps(url)}")
    if kind == "revisit":
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To-Target-URI: {uri_of(refers_to, refers_url)}",
            f"WARC-Refers-To-Page-ID: {refers_to}",
        ]
    head += [f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict | None:
    """Fields of one record, none for a warcinfo; checks lengths, and for a response the digest."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC/1.1 record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("the record's length is not that of its header")
    kind = fields["WARC-Type"]
    if kind == "warcinfo":
        return None
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(http.rpartition(b"Content-Length: ")[2])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError("the payload is not the one that was stored")
    page, to, url = fields["WARC-Page-ID"], fields.get("WARC-Refers-To-Page-ID"), fields.get("WARC-Page-URL")
    return {"page_id": int(page) if page else None, "payload_bytes": size, "payload_digest": digest, "record_type": kind,
            "refers_to": int(to) if to else None, "url": None if url is None else json.loads(url), "payload": payload if kind == "response" else None}


def build_dictionary(samples: list[bytes]) -> zstandard.ZstdCompressionDict:
    """A trained dictionary, or where the records are too few to train on, their first bytes as they are."""
    if len(samples) >= 16:
        try:
            size = min(DICTIONARY_BYTES, max(1024, sum(map(len, samples)) // 8))
            return zstandard.train_dictionary(size, samples, k=512, d=8, level=LEVEL)
        except zstandard.ZstdError:
            pass
    raw = b"".join(samples)[: DICTIONARY_BYTES // 4]
    return zstandard.ZstdCompressionDict(raw.ljust(8, b"\0"), dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def _writer(folder: str, date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        context = TaskContext.get()
        part, attempt = (context.partitionId(), context.taskAttemptId()) if context else (0, 0)
        done: list[tuple[str, int, int]] = []
        waiting: list[bytes] = []
        out, name, compressor, written, count = None, "", None, 0, 0

        def begin() -> None:
            nonlocal out, name, compressor, written, count
            dictionary = build_dictionary(waiting)
            content = dictionary.as_bytes()
            compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary)
            name = f"part-{part:06d}-{attempt}-{len(done):04d}.warc.zst"
            out = fs.open_output_stream(f"{base}/{name}", compression=None)
            out.write(struct.pack("<II", DICTIONARY_MAGIC, len(content)) + content)
            info = compressor.compress(info_record(date, name))
            out.write(info)
            written, count = 8 + len(content) + len(info), 0

        def put(raw: bytes) -> None:
            nonlocal written, count
            frame = compressor.compress(raw)
            out.write(frame)
            written += len(frame)
            count += 1

        def flush() -> None:
            if waiting:
                begin()
                for x in waiting:
                    put(x)
                waiting.clear()

        def finish() -> None:
            nonlocal out
            out.close()
            done.append((name, count, written))
            out = None

        number = held = 0
        for batch in batches:
            for page_id, url, html, digest, refers_to, refers_url in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                raw = record("response" if refers_to is None else "revisit", page_id, number, url, date, (html or "").encode(), digest, refers_to, refers_url)
                number += 1
                if out is None:
                    waiting.append(raw)
                    held += len(raw)
                    if len(waiting) >= SAMPLE_RECORDS or held >= SAMPLE_BYTES:
                        flush()
                        held = 0
                else:
                    put(raw)
                if out is not None and written >= ARCHIVE_BYTES:
                    finish()
        flush()
        if out is not None:
            finish()
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in done], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))], ["archive", "records", "bytes"])

    return run


def frames(source) -> Iterator[bytes]:
    """Records of an archive, from a file-like object, one after the other in bounded memory."""
    magic, size = struct.unpack("<II", source.read(8))
    if magic != DICTIONARY_MAGIC:
        raise ValueError("the archive has no leading dictionary frame")
    decompressor = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(source.read(size)))
    rest, at_end = b"", False
    one, parts = decompressor.decompressobj(), []
    while True:
        if not rest:
            rest = source.read(1 << 20)
            at_end = not rest
        if at_end:
            if parts:
                raise ValueError("the archive ends within a record")
            return
        parts.append(one.decompress(rest))
        rest = one.unused_data if one.eof else b""
        if one.eof:
            yield b"".join(parts)
            one, parts = decompressor.decompressobj(), []


def _reader(folder: str, payloads: bool):
    kinds = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "url": pa.string()}
    kinds |= {"payload": pa.binary()} if payloads else {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, records in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows, seen, held = [], 0, 0
                with fs.open_input_stream(f"{base}/{name}", compression=None) as source:
                    for raw in frames(source):
                        if (row := parse(raw)) is None:
                            continue
                        rows.append(row)
                        seen += 1
                        held += len(raw) if payloads else 0
                        if len(rows) >= 2000 or held > 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in kinds.items()], list(kinds))
                            rows, held = [], 0
                if seen != records:
                    raise ValueError(f"{name} has {seen} records, not {records}")
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in kinds.items()], list(kinds))

    return run


def write_archives(pages: DataFrame, folder: str | None = None, date: str = "2024-01-01T00:00:00Z") -> str:
    """Writes ``page_id, url, html`` as archives below ``folder`` and returns it.

    A null html is an empty payload, a null url a URN of the page_id as target and null when read. A null page_id is kept as empty; it can refer to a
    response, and is one only if no row with its payload has an id. Rows that repeat the greatest page_id
    with its payload are responses, each. Very long payloads are records like any other. An empty table gives no archives.
    """
    spark = pages.sparkSession
    folder = folder or scratch(spark, "warc")
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    p = p.withColumn("digest", F.sha1(F.col("html").cast("binary")))
    # Only payloads that occur more than once are looked up, one row each. While these are few they are broadcast and no
    # payload is shuffled; beyond, the join stands on two plain exchanges, so that a hot digest's pages can be split.
    first = F.max(F.struct("page_id", "url"))
    several = cut(
        p.where(F.octet_length("html") >= REVISIT_BYTES).groupBy("digest").agg(first.alias("first"), F.count(F.lit(1)).alias("n"))
        .where("n > 1 and first.page_id is not null").select(F.col("digest").alias("again"), F.col("first.page_id").alias("first_id"), F.col("first.url").alias("first_url"))
    )
    several = F.broadcast(several) if several.count() <= BROADCAST_ROWS else several
    q = p.join(several, (F.col("digest") == F.col("again")) & (F.octet_length("html") >= REVISIT_BYTES), "left")
    again = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    q = q.select("page_id", "url", "html", "digest", F.when(again, F.col("first_id")).alias("refers_to"), F.when(again, F.col("first_url")).alias("refers_url"))
    q.mapInArrow(_writer(folder, date), "archive string, records long, bytes long").write.parquet(f"{folder}/archives")
    return folder


def read_archives(spark: SparkSession, folder: str, payloads: bool = False) -> DataFrame:
    """A row per record of the archives below ``folder``, the payload of responses only if asked for."""
    listed = spark.read.parquet(f"{folder}/archives").where("records > 0").select("archive", "records")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string" + ", payload binary" * payloads
    return listed.repartition(parts, "archive").mapInArrow(_reader(folder, payloads), schema)


#: What the archives hold, in DuckDB SQL, but for the digest, which DuckDB's sha1 gives.
SQL = f"""
WITH p AS (SELECT page_id, url, encode(coalesce(html, '')) AS h FROM pages),
d AS (SELECT page_id, url, octet_length(h) AS n, sha1(h) AS digest FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY digest, n) AS first_id FROM d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN n >= {REVISIT_BYTES} AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= {REVISIT_BYTES} AND page_id <> first_id THEN first_id END AS refers_to, url
FROM m
"""
