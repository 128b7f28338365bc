"""Operator 6: WARC archives in Zstandard, with a dictionary.

An archive is a dictionary in a leading skippable frame and then one frame per record.
Spark's text sink writes the frames to any store that Spark can write; its line separator
is an empty skippable frame, which readers pass over.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelane.llm.common import shared_dir, small, table

#: Smaller payloads are never revisits.
LEAST_REVISIT = 1000
#: Pages the dictionary is trained on (those with the least MD5 of payload), bytes of each, and of the dictionary.
SAMPLE_PAGES, SAMPLE_BYTES, DICTIONARY_BYTES = 300, 1 << 16, 1 << 15
DATE = "2024-01-01T00:00:00Z"
DICTIONARY_MAGIC = b"\x5d\x2a\x4d\x18"
SEPARATOR = "P*M\x18\0\0\0\0"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, target_uri string"


def _urn(page_id: int | None) -> str:
    return f"<urn:x-page:{'none' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record; a revisit has the HTTP head of its response, and no payload."""
    uri = re.sub(r"[^!-~]", lambda x: "".join(f"%{b:02X}" for b in x[0].encode()), url or "urn:x-page:unknown")
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block += b"" if revisit else payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_urn(page_id)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {uri}"]
    head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_urn(refers_to)}"] if revisit else []
    head += ["Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest}", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def frames(archive: bytes) -> Iterator[bytes]:
    """The content of each frame; the dictionary comes from the leading skippable frame, if there is one."""
    view, at, words = memoryview(archive), 0, None
    if archive[:4] == DICTIONARY_MAGIC:
        words = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(archive[8 : 8 + int.from_bytes(archive[4:8], "little")]))
    reader = zstandard.ZstdDecompressor(dict_data=words)
    while at < len(archive):
        magic = int.from_bytes(view[at : at + 4], "little")
        if magic >> 4 == 0x184D2A5:
            at += 8 + int.from_bytes(view[at + 4 : at + 8], "little")
            continue
        frame, out = reader.decompressobj(), []
        while not frame.eof:
            if at >= len(archive):
                raise ValueError("the archive ends within a frame")
            piece = view[at : at + (1 << 16)]
            out.append(frame.decompress(piece))
            at += len(piece) - len(frame.unused_data)
        yield b"".join(out)


def _header(raw: bytes, what: str) -> dict[str, str]:
    lines = raw.decode().split("\r\n")
    pairs = [x.partition(":") for x in lines[1:]]
    if any(not x[1] for x in pairs):
        raise ValueError(f"a {what} header without a colon")
    return {k.lower(): v.strip() for k, _, v in pairs} | {"": lines[0]}


def parse(raw: bytes) -> tuple:
    """READ's fields of a record, whose headers, lengths and digest are checked."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    h = _header(head, "WARC")
    missing = {"warc-type", "warc-record-id", "warc-date", "content-length", "warc-payload-digest"} - set(h)
    if h[""] != "WARC/1.1" or not gap or missing:
        raise ValueError(f"not a WARC/1.1 record, or without {sorted(missing)}")
    if not h["content-length"].isdigit() or len(rest) != int(h["content-length"]) + 4 or rest[-4:] != b"\r\n\r\n":
        raise ValueError("the block's length is not its Content-Length")
    http, gap, payload = rest[:-4].partition(b"\r\n\r\n")
    size = int(_header(http, "HTTP")["content-length"])
    digest = base64.b32decode(h["warc-payload-digest"].removeprefix("sha1:")).hex()
    kind = h["warc-type"]
    if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError("the payload is not what its length and digest say")
    if kind not in ("response", "revisit") or kind == "revisit" and payload:
        raise ValueError(f"a {kind} record with {len(payload)} bytes of payload")
    number = lambda x: None if x is None or x == "<urn:x-page:none>" else int(x[len("<urn:x-page:") : -1])
    return number(h["warc-record-id"]), size, digest, kind, number(h.get("warc-refers-to")), h.get("warc-target-uri")


def _dictionary(pages: DataFrame) -> bytes:
    """A trained dictionary as a compressed frame, or b"" where the sample is too small to train on."""
    sample = pages.select(F.substring("payload", 1, SAMPLE_BYTES).alias("p")).filter("length(p) > 0").orderBy(F.md5("p")).limit(SAMPLE_PAGES)
    samples = [bytes(r.p) for r in sample.collect()]
    try:
        trained = zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""
    return zstandard.ZstdCompressor().compress(trained)


def write_archives(pages: DataFrame, path: str) -> None:
    """Writes one record for each row of pages (page_id long, url string, html string) under path.

    The payload is the html in UTF-8; null is empty. Of records with equal payloads of 1000
    bytes or more, those with the largest page_id are responses and the others revisit it;
    smaller ones are all responses. Repeated rows are records of their own. A null url gets
    a placeholder URI, and characters that a header can't hold are percent-encoded; a null
    page_id is a record without number. Each input partition makes one archive; none for no
    rows. Payloads are grouped by digest alone; html itself is never shuffled for that
    unless the repeated digests are too many to broadcast.
    """
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload")).withColumn("digest", F.sha1("payload"))
    large = pages.filter(F.length("payload") >= LEAST_REVISIT)
    again = large.groupBy("digest").agg(F.count("*").alias("n"), F.max("page_id").alias("top")).filter("n > 1").select("digest", "top")
    joined = pages.join(small(again), "digest", "left").select("page_id", "url", "payload", "top")
    packed = _dictionary(pages)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(packed)) if packed else None
        pack = zstandard.ZstdCompressor(level=6, dict_data=words, write_checksum=True)
        lead = DICTIONARY_MAGIC + len(packed).to_bytes(4, "little") + packed if packed else b""
        for batch in batches:
            out = []
            for page_id, url, payload, top in zip(*(batch.column(k) for k in range(4))):
                page_id, top = page_id.as_py(), top.as_py()
                revisit = top is not None and page_id != top
                out.append(lead + pack.compress(record(page_id, url.as_py(), payload.as_py(), top, revisit)))
                lead = b""
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["frame"])

    joined.mapInArrow(write, "frame binary").select(F.col("frame").cast("string").alias("frame")).write.option("lineSep", SEPARATOR).text(path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row for each record of the archives under path; a record that is not sound is an error."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in READ.split(", ")]
        kinds = [pa.string() if x.endswith("string") else pa.int64() for x in READ.split(", ")]
        for batch in batches:
            for archive in batch.column("content"):
                rows = [parse(x) for x in frames(archive.as_py())]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("content").mapInArrow(read, READ)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(table(spark, sf_dir, "pages"), path)
    return read_archives(spark, path)


ORACLE_SQL = {
    "op6_warc": r"""
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS digest FROM pages),
q AS (SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY html) END AS top FROM p)
SELECT page_id, n AS payload_bytes, digest AS payload_digest, CASE WHEN page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id < top THEN top END AS refers_to, url AS target_uri FROM q"""
}
