"""WARC archives as a chunked record table.

An archive is a Parquet table of chunk rows: (record_id, archive, chunk_no, n_chunks, bytes, crc32, running). The chunks of a
record, in order, are the bytes of one WARC/1.1 record: header, payload, two line ends; all records of an archive in a
row are a valid .warc file (``export_warc``). A payload larger than a chunk becomes several rows, cut in the JVM, so
that neither a Python worker nor a reader ever holds it whole. Each row carries the checksum of its bytes and ``running``, the SHA-1 of the
payload up to its end: a writer adds one chunk at a time to the running digest, a reader checks it at every chunk, so a record that is
read in part is known to be good so far.

Writing: payloads are digested natively; of records with equal payloads, the one with the largest page id is the
``response``, the others are ``revisit`` records that refer to it.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.llm.common import attach, lean, materialize, small_batches

CHUNK_BYTES = 1 << 20
#: What ends a record.
END = b"\r\n\r\n"
DATE = "2020-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
TABLE_SCHEMA = "record_id string, archive int, chunk_no int, n_chunks int, bytes binary, crc32 long, running binary"
READ_SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
_RADIX32, _BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 SHA-1, from the hex digest five digits (four base32 characters) at a time."""
    hexed = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(hexed, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.upper(F.concat(*parts)), _RADIX32, _BASE32)


def write_warc(
    pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_revisit_bytes: int = 0,
    chunk_bytes: int = CHUNK_BYTES, archives: int = 64,
) -> None:
    """Write one record for each row (null payload: empty; null url: an empty target).

    Rows that share the winning page id are all responses; a row without an id is one only if its whole group has none.
    Payloads under ``min_revisit_bytes`` are always responses. An empty table writes an empty archive.
    """
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = pages.select(
        F.col(id_col).cast("long").alias("id"), F.coalesce(F.regexp_replace(url_col, r"[\r\n]", ""), F.lit("")).alias("url"), payload.alias("payload"),
        base32_sha1(payload).alias("digest"), F.octet_length(payload).cast("long").alias("size"),
    )
    # The winner of each digest that occurs more than once; partial sums keep a hot payload's rows apart.
    spark = pages.sparkSession
    winners = rows.groupBy("digest").agg(F.max("id").alias("response"), F.count(F.lit(1)).alias("n"))
    winners = winners.where((F.col("n") > 1) & F.col("response").isNotNull()).select("digest", "response", "n")
    winners = materialize(winners, "warc-winners")
    tagged = attach(rows, ["digest"], winners, "n", F.struct("id", "url"))
    revisit = F.col("response").isNotNull() & (F.col("size") >= min_revisit_bytes) & ~F.col("id").eqNullSafe(F.col("response"))
    tagged = tagged.withColumn("refers", F.when(revisit, F.col("response")))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    uri = lambda page: F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("none")), F.lit(">"))
    body = F.when(F.col("refers").isNull(), F.col("payload")).otherwise(F.lit(b""))
    tagged = tagged.withColumn("body", body)
    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(F.col("refers").isNull(), F.lit("response")).otherwise(F.lit("revisit"))),
        line("WARC-Record-ID", uri(F.col("id"))),
        line("WARC-Date", F.lit(DATE)),
        line("WARC-Target-URI", F.col("url")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        line("X-Payload-Length", F.col("size").cast("string")),
        F.when(F.col("refers").isNotNull(), line("WARC-Profile", F.lit(PROFILE))).otherwise(F.lit("")),
        F.when(F.col("refers").isNotNull(), line("WARC-Refers-To", uri(F.col("refers")))).otherwise(F.lit("")),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.octet_length("body").cast("string")),
        F.lit("\r\n"),
    ).cast("binary")
    last = F.floor((F.greatest(F.octet_length("body"), F.lit(1)) - 1) / chunk_bytes).cast("int")
    tagged = tagged.select(F.expr("uuid()").alias("record_id"), F.pmod(F.xxhash64("digest", "id"), F.lit(archives)).cast("int").alias("archive"), header.alias("header"), "body", last.alias("last"))
    cut = tagged.withColumn("chunk_no", F.explode(F.sequence(F.lit(0), F.col("last"))))
    piece = F.call_function("substring", F.col("body"), F.col("chunk_no") * chunk_bytes + 1, F.lit(chunk_bytes))
    full = F.concat(
        F.when(F.col("chunk_no") == 0, F.col("header")).otherwise(F.lit(b"")), piece, F.when(F.col("chunk_no") == F.col("last"), F.lit(END)).otherwise(F.lit(b""))
    )
    head = F.when(F.col("chunk_no") == 0, F.octet_length("header")).otherwise(F.lit(0)).cast("int").alias("head")
    out = cut.select("record_id", "archive", "chunk_no", (F.col("last") + 1).alias("n_chunks"), full.alias("bytes"), head).withColumn("crc32", F.crc32("bytes"))
    small_batches(spark)
    out = out.select("record_id", "archive", "chunk_no", "n_chunks", "bytes", "crc32", "head").mapInArrow(lean(_running), TABLE_SCHEMA)
    out.write.mode("overwrite").option("compression", "zstd").parquet(path)


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunk rows as they are cut, those of a record one after another, with the SHA-1 of the payload up to each chunk's end."""
    sha = hashlib.sha1()
    for batch in batches:
        found = []
        for i, (no, n, head) in enumerate(zip(*(batch.column(c).to_pylist() for c in (2, 3, 6)))):
            if no == 0:
                sha = hashlib.sha1()
            data = batch.column(4)[i].as_buffer()
            end = data.size - (len(END) if no == n - 1 else 0)
            sha.update(memoryview(data)[head:end])
            found.append(sha.digest())
        yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(found, pa.binary())], [*batch.schema.names[:6], "running"])


_page = re.compile(r"<urn:page:(-?\d+|none)>")


class RecordParser:
    """Takes a record's chunks one after another; ``finish`` checks and describes it. Holds the header and a running SHA-1 only."""

    def __init__(self):
        self.header, self.fields, self.left, self.sha, self.tail = b"", None, 0, hashlib.sha1(), b""

    def feed(self, data: bytes) -> None:
        if self.fields is None:
            head, mark, rest = (self.header + data).partition(b"\r\n\r\n")
            if not mark:
                self.header += data
                return
            first, *lines = head.decode("utf-8").split("\r\n")
            if not first.startswith("WARC/1."):
                raise ValueError("not a WARC record")
            self.fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines)
            self.left, data = int(self.fields["Content-Length"]), rest
        self.sha.update(data[: self.left])
        self.tail += data[self.left :]
        self.left -= min(self.left, len(data))

    def finish(self) -> tuple:
        f = self.fields
        if f is None or self.left or self.tail != END:
            raise ValueError("a WARC record is cut short")
        digest = f["WARC-Payload-Digest"].removeprefix("sha1:")
        if f["WARC-Type"] == "response" and base64.b32encode(self.sha.digest()).decode() != digest:
            raise ValueError("a payload disagrees with its digest")
        number = lambda x: None if x is None or (m := _page.fullmatch(x)) is None or m[1] == "none" else int(m[1])
        size = int(f.get("X-Payload-Length", f["Content-Length"]))
        return number(f["WARC-Record-ID"]), size, digest, f["WARC-Type"], number(f.get("WARC-Refers-To"))


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunk rows, those of a record together and in order -> a row for each record."""
    parser, current, expected, count = None, None, 0, 0
    names = [c.split()[0] for c in READ_SCHEMA.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    for batch in batches:
        rows = []
        for record, no, n, data, crc, running in zip(*(c.to_pylist() for c in batch.columns)):
            if zlib.crc32(data) != crc:
                raise ValueError("a chunk is damaged")
            if parser is None:
                parser, current, expected, count = RecordParser(), record, 0, n
            if record != current or no != expected:
                raise ValueError("a chunk is missing")
            parser.feed(data)
            if parser.sha.digest() != running:
                raise ValueError("a payload disagrees with its running digest")
            expected += 1
            if expected == count:
                rows.append(parser.finish())
                parser = None
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
    if parser is not None:
        raise ValueError("a chunk is missing")


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every record, parsed and verified from its bytes.

    Records of one chunk are parsed where they lie; the chunks of longer ones are brought together and read in order.
    """
    table = spark.read.schema(TABLE_SCHEMA).parquet(path)
    columns = ["record_id", "chunk_no", "n_chunks", "bytes", "crc32", "running"]
    small_batches(spark)
    short = table.where(F.col("n_chunks") == 1).select(columns).mapInArrow(lean(_parse), READ_SCHEMA)
    long = table.where(F.col("n_chunks") > 1).select(columns).repartition("record_id").sortWithinPartitions("record_id", "chunk_no")
    return short.unionByName(long.mapInArrow(lean(_parse), READ_SCHEMA))


def export_warc(spark: SparkSession, path: str, archive: int, out) -> int:
    """Write one archive's records to the binary file object ``out`` as a .warc stream, chunk by chunk; returns its bytes."""
    rows = spark.read.schema(TABLE_SCHEMA).parquet(path).where(F.col("archive") == archive).orderBy("record_id", "chunk_no").select("bytes")
    return sum(out.write(bytes(r[0])) for r in rows.toLocalIterator())
