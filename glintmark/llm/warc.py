"""WARC archives with a Zstandard dictionary: skippable dictionary frame first, then one frame a record.

A dictionary is trained on a bounded sample of the records (SAMPLES of the smallest hashes of page_id and url, at
most SAMPLE_BYTES of each; only the dictionary depends on it, every record is archived whole). Each file begins with
the skippable frame 0x184D2A5D that holds the dictionary, so it can be read alone.

Records with equal payloads: the one with the smallest page_id is a response, the others are revisits that name it.
The representative of each payload comes from an aggregate by digest; the rows join it on the digest, where a
payload that most rows share is split by the adaptive skew join.

Null html counts as empty. Null page_ids never represent a payload, unless a payload has no other: then all its
rows are responses. Rows that repeat the smallest page_id with the same payload are responses too. Empty tables make
no file. Null urls leave the header out. Further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

DICTIONARY_MAGIC = 0x184D2A5D
SAMPLES, SAMPLE_BYTES, DICTIONARY_BYTES = 512, 1 << 15, 112_640
LEVEL = 3
FILE_BYTES = 1 << 30
#: Bytes that are given to the decompressor at once.
PIECE = 1 << 12
DATE = "1970-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(hex_digest: str) -> str:
    return base64.b32encode(bytes.fromhex(hex_digest)).decode()


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:glintmark:page:{'' if page_id is None else page_id}:{digest}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record. digest: bare base32 SHA-1 of the payload; refers_to: the response's page of a revisit."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id, digest)}",
        f"WARC-Date: {DATE}",
        *([f"WARC-Target-URI: {quote(url, safe=SAFE)}"] if url is not None else []),
        f"WARC-Payload-Digest: sha1:{digest}",
        *([f"WARC-Refers-To: {record_id(refers_to, digest)}", f"WARC-Profile: {REVISIT}"] if refers_to is not None else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


SAFE = "".join(chr(c) for c in range(33, 127))


def parse(data: bytes) -> dict:
    """A record's headers (lower-case names), its HTTP headers under `http`, its payload under `payload`."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = lambda xs: {k.lower(): v for k, _, v in (x.partition(": ") for x in xs)}
    out: dict = fields(lines[1:])
    block, tail = rest[: int(out["content-length"])], rest[int(out["content-length"]) :]
    if tail != b"\r\n\r\n":
        raise ValueError("the record's length is wrong")
    http, _, payload = block.partition(b"\r\n\r\n")
    return out | {"http": fields(http.decode().split("\r\n")[1:]), "payload": payload}


def train(samples: list[bytes]) -> bytes:
    """Dictionary bytes; the samples themselves, in raw form, where there are too few to train on."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY_BYTES:]


def dictionary_of(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> bytes:
    """The smallest hashes are found without reading any html; then only their rows' html is, one row a hash."""
    hashed = pages.select(F.xxhash64(F.col(id_col).cast("string"), url_col).alias("h"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    last = hashed.select("h").distinct().orderBy("h").limit(SAMPLES).agg(F.max("h")).first()[0]
    if last is None:
        return b""
    body = F.substring(F.coalesce("html", F.lit("")).cast("binary"), 1, SAMPLE_BYTES)
    rows = hashed.where(F.col("h") <= last).groupBy("h").agg(F.min(F.struct("url", body.alias("body"))).alias("x")).collect()
    return train([record(None, r.x.url, bytes(r.x.body), base32_sha1(hashlib.sha1(r.x.body).hexdigest()), None) for r in sorted(rows, key=lambda r: r.h)])


class Archive:
    """A file of records that share a dictionary."""

    def __init__(self, out, dictionary: bytes, level: int = LEVEL) -> None:
        self.out, self.n, self.size = out, 0, 0
        kind = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        self.press = zstandard.ZstdCompressor(level=level, dict_data=kind, write_checksum=True)
        out.write(struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)))
        out.write(dictionary)

    def add(self, data: bytes) -> None:
        frame = self.press.compress(data)
        self.out.write(frame)
        self.n, self.size = self.n + 1, self.size + len(frame)


def records(source, step: int = 1 << 20) -> Iterator[bytes]:
    """Records of an open file, one in memory at a time."""
    magic, size = struct.unpack("<II", source.read(8))
    if magic != DICTIONARY_MAGIC:
        raise ValueError("no dictionary frame")
    dictionary = source.read(size)
    press = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
    data, at = source.read(step), 0
    while at < len(data) or (data := source.read(step)):
        at = at if at < len(data) else 0
        one, parts = press.decompressobj(), []
        while not one.eof:
            if at >= len(data):
                data, at = source.read(step), 0
                if not data:
                    raise ValueError("the last record is cut off")
            # Small steps, so that what follows a record is not copied again for each.
            piece = data[at : at + PIECE]
            parts.append(one.decompress(piece))
            at += len(piece) - len(one.unused_data)
        yield b"".join(parts)


def with_references(pages: DataFrame, id_col: str, url_col: str, html_col: str, least_bytes: int) -> DataFrame:
    """page_id, url, html, sha1 (hex), refers_to."""
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), html.alias("html"), F.sha1(html.cast("binary")).alias("sha1"))
    first = rows.where(F.octet_length("html") >= least_bytes).groupBy("sha1").agg(F.min("page_id").alias("least"))
    same = F.col("page_id").eqNullSafe(F.col("least"))
    return rows.join(first, "sha1", "left").select("page_id", "url", "html", "sha1", F.when(~same, F.col("least")).alias("refers_to"))


def write(pages: DataFrame, at: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0, level: int = LEVEL, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes pages as .warc.zst files below the folder `at`; returns file and n_records."""
    dictionary = dictionary_of(pages, id_col, url_col, html_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, files = TaskContext.get().partitionId(), []
        rows = ((b, k) for b in shared.cut(batches) for k in range(b.num_rows))
        held = next(rows, None)
        while held:
            uri, count = f"{at}/pages-{part:06d}-{len(files):05d}.warc.zst", 0

            def body(out) -> None:
                nonlocal held, count
                archive = Archive(out, dictionary, level)
                while held and archive.size < file_bytes:
                    b, k = held
                    page, url, html, sha1, refers = (b.column(i)[k] for i in range(5))
                    payload = html.as_buffer().to_pybytes()
                    archive.add(record(page.as_py(), url.as_py(), payload, base32_sha1(sha1.as_py()), refers.as_py()))
                    held = next(rows, None)
                count = archive.n

            shared.publish(uri, body)
            files.append({"file": uri, "n_records": count})
        yield pa.RecordBatch.from_pylist(files, schema=pa.schema([("file", pa.string()), ("n_records", pa.int64())]))

    rows = with_references(pages, id_col, url_col, html_col, least_bytes)
    return shared.stored(rows.mapInArrow(run, "file string, n_records long"), "warc-manifest")


def _page(rid: str) -> int | None:
    at = rid.strip("<>").split(":")[3]
    return int(at) if at else None


READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"


def read(manifest: DataFrame) -> DataFrame:
    """One row a record; response payloads are hashed again and compared with their header."""
    kinds = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string())])

    def row(data: bytes) -> dict:
        x = parse(data)
        digest = x["warc-payload-digest"].removeprefix("sha1:")
        if x["warc-type"] == "response" and base32_sha1(hashlib.sha1(x["payload"]).hexdigest()) != digest:
            raise ValueError(f"payload of {x['warc-record-id']} is damaged")
        return {
            "page_id": _page(x["warc-record-id"]),
            "payload_bytes": len(x["payload"]) if x["warc-type"] == "response" else int(x["http"]["content-length"]),
            "payload_digest": digest,
            "record_type": x["warc-type"],
            "refers_to": _page(x["warc-refers-to"]) if "warc-refers-to" in x else None,
            "url": x.get("warc-target-uri"),
        }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri in b.column(0).to_pylist():
                fs, path = shared.filesystem(uri)
                with fs.open_input_stream(path, compression=None) as source:
                    rows: list[dict] = []
                    for data in records(source):
                        rows.append(row(data))
                        if len(rows) >= 2048:
                            yield pa.RecordBatch.from_pylist(rows, schema=kinds)
                            rows = []
                    yield pa.RecordBatch.from_pylist(rows, schema=kinds)

    tasks = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("file").repartition(tasks).mapInArrow(run, READ)


def op2_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = shared.table(spark, sf_dir, "pages")
    return read(write(pages, shared.scratch(spark, "warc"))).drop("url")


OP2_SQL = """
SELECT page_id, octet_length(encode(html)) AS payload_bytes,
       list_aggregate(list_transform(range(0, 32), lambda k:
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (substr(bits, 5 * k + 1, 5)::BIT::INT)::INT, 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM least THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS NOT DISTINCT FROM least THEN NULL ELSE least END AS refers_to
FROM (
  SELECT page_id, html, min(page_id) OVER (PARTITION BY sha1(html)) AS least,
         list_aggregate(list_transform(range(1, 41), lambda i:
           substr('0000000100100011010001010110011110001001101010111100110111101111',
                  4 * (instr('0123456789abcdef', substr(sha1(html), i, 1)) - 1) + 1, 4)), 'string_agg', '') AS bits
  FROM (SELECT page_id, coalesce(html, '') AS html FROM pages))
"""
