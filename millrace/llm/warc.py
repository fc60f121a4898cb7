"""WARC archives with revisit records.

Only headers (digest, size, id) are shuffled to find which records repeat a payload; the
repeated ones become revisit records of one response. Records are built as columns and
written by Spark's text writer, whose line separator is the last byte of a record's end, so
archives are plain (gzipped) WARC files on any file system that Spark can write.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import mapped, shared_dir, written

ID = "urn:x-page:"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"


def headers(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """page_id, url, payload, payload_digest (hex SHA-1) and payload_bytes of each row; a null payload is empty."""
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit("").cast("binary"))
    df = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    return df.withColumns({"payload_digest": F.sha1("payload"), "payload_bytes": F.octet_length("payload").cast("long")})


def responses(heads: DataFrame, least: int = 1000) -> DataFrame:
    """payload_digest and refers_to, the largest page_id, of payloads of at least so many bytes that more than one row has."""
    found = heads.where(F.col("payload_bytes") >= least).groupBy("payload_digest").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n"))
    return found.where((F.col("n") > 1) & F.col("refers_to").isNotNull()).select("payload_digest", "refers_to")


def resolve(heads: DataFrame, least: int = 1000) -> DataFrame:
    """heads with record_type and refers_to.

    Of rows with equal payloads of at least `least` bytes the one with the largest page_id is
    the response (all of them, if it is repeated), the others revisit it; rows without an id
    revisit it too, or are responses where no row has an id. Payloads are equal when their
    SHA-1 digests are. Which digests are repeated is found from headers alone and written; the
    rows with their payloads are moved for that join only where Spark cannot broadcast those
    digests, and it can then split a hot one.
    """
    first = written(responses(heads, least), "responses")
    out = heads.join(first, "payload_digest", "left")
    revisit = F.col("refers_to").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("refers_to")) & (F.col("payload_bytes") >= least)
    return out.withColumns({"record_type": F.when(revisit, "revisit").otherwise("response"), "refers_to": F.when(revisit, F.col("refers_to"))})


def record(date: str = DATE) -> Column:
    """The bytes of a WARC record but for its last line feed, from the columns of resolve()."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    url = F.regexp_replace(text(F.col("url")), r"[\x00-\x20\x7F<>]", "_")
    revisit = F.col("record_type") == "revisit"
    block = F.when(revisit, F.lit(HTTP)).otherwise(F.concat(F.lit(HTTP), F.col("payload").cast("string")))
    size = F.when(revisit, F.lit(len(HTTP)).cast("long")).otherwise(F.lit(len(HTTP)) + F.col("payload_bytes"))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.col("record_type"), F.lit(f"\r\nWARC-Record-ID: <{ID}"), text(F.col("page_id")), F.lit(f">\r\nWARC-Date: {date}"),
        F.when(url == "", F.lit("")).otherwise(F.concat(F.lit("\r\nWARC-Target-URI: "), url)),
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("payload_digest"),
        F.when(revisit, F.concat(F.lit(f"\r\nWARC-Profile: {PROFILE}\r\nWARC-Refers-To: <{ID}"), text(F.col("refers_to")), F.lit(">"))).otherwise(F.lit("")),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), size.cast("string"), F.lit("\r\n\r\n"), block, F.lit("\r\n\r"),
    )


#: Payload bytes below which so many records go into one archive, so that none holds much more than a GB.
SIZES = [(1 << 20, 1000), (1 << 24, 60), (None, 4)]


def write_archives(resolved: DataFrame, path: str | None = None, largest: int | None = None) -> str:
    """Writes gzipped archives, larger payloads in archives of fewer records (SIZES); gives their folder. largest: the largest payload's bytes, if known."""
    path = path or shared_dir(resolved.sparkSession, "warc")
    n, low = F.when(F.col("record_type") == "revisit", 0).otherwise(F.col("payload_bytes")), 0
    if largest is None:
        largest = resolved.agg(F.max("payload_bytes")).first()[0]
    largest = largest or 0
    for high, records in SIZES:
        if low <= largest:
            some = resolved if high is None and not low else resolved.where((n >= low) & (n < high) if high else n >= low)
            some.select(record().alias("value")).write.option("lineSep", "\n").option("compression", "gzip").option("maxRecordsPerFile", records).text(f"{path}/from-{low}")
        low = high
    return path


def inflated(data: memoryview, step: int = 1 << 20) -> Iterator[bytes]:
    """The bytes of gzip members one after the other, in pieces."""
    at, engine = 0, zlib.decompressobj(31)
    while at < len(data):
        piece = engine.decompress(data[at : at + step])
        at += step
        if piece:
            yield piece
        while engine.eof and engine.unused_data:
            rest, engine = engine.unused_data, zlib.decompressobj(31)
            if piece := engine.decompress(rest):
                yield piece
    if not engine.eof:
        raise ValueError("an archive ends within a gzip member")


def parse(chunks: Iterable[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record; one record is held at a time."""
    held, base = bytearray(), 0
    chunks = iter(chunks)

    def more() -> bool:
        piece = next(chunks, None)
        held.extend(piece or b"")
        return piece is not None

    while held or more():
        while (top := held.find(b"\r\n\r\n")) < 0:
            if not more():
                raise ValueError(f"a header's end is missing after byte {base}")
        lines = held[:top].decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {base}")
        head = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
        low = top + 4
        high = low + int(head["content-length"])
        while len(held) < high + 4 and more():
            pass
        if held[high : high + 4] != b"\r\n\r\n":
            raise ValueError(f"a record's end is missing at byte {base + high}")
        block = bytes(memoryview(held)[low:high])
        del held[: high + 4]
        base += high + 4
        yield head, block


RECORDS = "page_id long, record_type string, payload_digest string, stored_bytes long, stored_digest string, refers_to long, url string"


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """A row for each record of gzipped archives: what its header says, and size and SHA-1 of the payload it stores."""

    def number(uri: str | None) -> int | None:
        digits = (uri or "").strip("<>").removeprefix(ID)
        return int(digits) if digits else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                out = []
                for head, raw in parse(inflated(memoryview(batch.column(0)[k].as_buffer()))):
                    payload = memoryview(raw)[raw.index(b"\r\n\r\n") + 4 :]
                    out.append((number(head["warc-record-id"]), head["warc-type"], head["warc-payload-digest"].removeprefix("sha1:"), len(payload), hashlib.sha1(payload).hexdigest(), number(head.get("warc-refers-to")), head.get("warc-target-uri")))
                kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 7, kinds)], names=[x.split()[0] for x in RECORDS.split(", ")])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").option("recursiveFileLookup", "true").load(path).select("content")
    return mapped(files, run, RECORDS)


def resolve_archives(records: DataFrame) -> DataFrame:
    """Joins revisit records to the responses they refer to.

    Gives page_id, record_type, refers_to and payload_bytes and payload_digest of the full
    payload. A response's own stored payload must have the digest of its header, else its
    payload_digest is null; a revisit of a missing or different response has null payload_bytes.
    """
    own = records.where(F.col("record_type") != "revisit").groupBy(F.col("page_id").alias("refers_to"), F.col("stored_digest").alias("payload_digest")).agg(F.max("stored_bytes").alias("payload_bytes"))
    wanted = records.where(F.col("record_type") == "revisit").select("page_id", "record_type", "payload_digest", "refers_to", "url")
    back = wanted.join(written(own.where(F.col("payload_bytes") >= 0), "stored"), ["refers_to", "payload_digest"], "left")
    whole = records.where(F.col("record_type") != "revisit").select(
        "page_id", "record_type", F.when(F.col("payload_digest") == F.col("stored_digest"), F.col("payload_digest")).alias("payload_digest"), F.lit(None).cast("long").alias("refers_to"), "url", F.col("stored_bytes").alias("payload_bytes")
    )
    return whole.unionByName(back.select(*whole.columns))


def deduplicated(pages: DataFrame, path: str | None = None, *, least: int = 1000) -> DataFrame:
    """Writes pages (page_id, url, html; other columns are not read) as archives with revisits and gives them, read back and resolved.

    Null payloads are empty and stored in full, as all below `least` bytes. A null url leaves
    its header out. An empty table makes no record. Repeated rows are records of their own.
    A very long payload is one record, in an archive of a few; a reading task holds one
    record and the compressed archive.
    """
    spark = pages.sparkSession
    heads = headers(pages)
    largest = heads.agg(F.max("payload_bytes")).first()[0]  # of column sizes alone, without digests
    path = write_archives(resolve(heads, least), path, largest)
    return resolve_archives(written(read_archives(spark, path), "records"))
