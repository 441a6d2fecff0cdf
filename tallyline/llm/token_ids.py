"""Token-ID output: documents' ids in ascending id order, each compressed by itself against a shared zstandard dictionary.

A file set is a folder of two Parquet tables, so that Spark's commit protocol and any Hadoop store carry it:

* ``dictionary``: one row with the dictionary and its SHA-256;
* ``data``: one row for each segment: shard, segment, the smallest and largest document id, the tokens before it in
  its shard, its tokens, and a binary ``payload``.

A payload is: magic ``TLID0001``, the dictionary's SHA-256, the id width and the number of documents, an index (for
each document: id, null flag, tokens, the frame's offset), then one zstandard frame for each document. To fetch a
document, the min/max columns find its segment and the index its frame; nothing else is decompressed.
Shards follow ranges of document ids: ascending shards, segments and index entries are the order of the documents.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.llm.common import bounded_sample, lean, slices, small_batches, small_frame
from tallyline.llm.encoders import encoder

MAGIC = b"TLID0001"
HEAD = struct.Struct("<8s32sII")
SEGMENT_BYTES, SEGMENT_DOCS = 2 << 20, 4096
DICT_BYTES, DICT_DOCS, DICT_PIECE, DICT_PIECES = 64 << 10, 1000, 8 << 10, 4
DATA_SCHEMA = "shard int, segment int, min_id long, max_id long, first_token long, n_tokens long, n_docs int, payload binary"


def _ids(tokenizer: str, end_id: int, text: str) -> np.ndarray:
    e = encoder(tokenizer)
    ids = e.encode_bytes(text)
    return np.frombuffer(ids + np.array([end_id], e.dtype).tobytes(), e.dtype)


def train_dictionary(docs: DataFrame, tokenizer: str, end_id: int, *, max_docs: int = DICT_DOCS, size: int = DICT_BYTES) -> bytes:
    """A dictionary from at most ``max_docs`` documents, each giving at most four pieces of 8 KiB, evenly spaced.

    Too few or too uniform samples give a raw-content dictionary; an empty table gives one of eight zero bytes.
    """
    chosen = docs.where(bounded_sample(docs, F.col("doc_id"), max_docs, more=F.col("text"))).select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 0):
                found = []
                for text in part.column(0).to_pylist():
                    raw = _ids(tokenizer, end_id, text or "").tobytes()
                    starts = range(0, len(raw), DICT_PIECE)
                    step = max(1, len(starts) // DICT_PIECES)
                    found += [raw[s : s + DICT_PIECE] for s in [*starts][::step][:DICT_PIECES]]
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], ["piece"])

    pieces = sorted(bytes(r[0]) for r in chosen.mapInArrow(lean(run, keeps=True), "piece binary").collect())
    try:
        return zstandard.train_dictionary(size, pieces).as_bytes()
    except zstandard.ZstdError:
        return b"".join(pieces)[-size:].rjust(8, b"\0")


@lru_cache(maxsize=2)
def _codec(dictionary: bytes) -> tuple[zstandard.ZstdCompressor, zstandard.ZstdDecompressor]:
    d = zstandard.ZstdCompressionDict(dictionary)
    return zstandard.ZstdCompressor(level=3, dict_data=d), zstandard.ZstdDecompressor(dict_data=d)


def pack_segment(sha: bytes, width: int, docs: list[tuple[int | None, int, bytes]]) -> bytes:
    """docs: (id, tokens, frame)."""
    ids = np.array([0 if d[0] is None else d[0] for d in docs], "<i8")
    nulls = np.array([d[0] is None for d in docs], "u1")
    tokens = np.array([d[1] for d in docs], "<i8")
    offsets = np.concatenate([[0], np.cumsum([len(d[2]) for d in docs])]).astype("<i8")
    return b"".join([HEAD.pack(MAGIC, sha, width, len(docs)), ids.tobytes(), nulls.tobytes(), tokens.tobytes(), offsets.tobytes(), *(d[2] for d in docs)])


class Segment:
    """Random access to one payload."""

    def __init__(self, payload: bytes, dictionary: bytes):
        magic, sha, width, n = HEAD.unpack_from(payload)
        if magic != MAGIC or sha != hashlib.sha256(dictionary).digest():
            raise ValueError("not a token-id segment, or another dictionary's")
        at = HEAD.size
        self.ids = np.frombuffer(payload, "<i8", n, at)
        self.nulls = np.frombuffer(payload, "u1", n, at + 8 * n)
        self.tokens = np.frombuffer(payload, "<i8", n, at + 9 * n)
        self.offsets = np.frombuffer(payload, "<i8", n + 1, at + 17 * n)
        self.frames = memoryview(payload)[at + 25 * n + 8 :]
        self.dtype = np.dtype(f"<u{width}")
        self._open = _codec(dictionary)[1]

    def __len__(self) -> int:
        return len(self.ids)

    def __getitem__(self, i: int) -> np.ndarray:
        raw = self._open.decompress(self.frames[self.offsets[i] : self.offsets[i + 1]])
        return np.frombuffer(raw, self.dtype)


def write_token_ids(docs: DataFrame, path: str, tokenizer: str, *, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every whole text (null: empty), append ``end_id``, write the file set to ``path``.

    Documents are ordered by id (null ids first), equal ids by a hash of the text, so that an id which very many rows
    share is dealt to many ranges; only repeated rows, equal in both, stay together. One range shuffle of the texts;
    encoding happens once, after it. Repeated rows stay repeated; an empty table writes an empty file set. Other columns
    are not read.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    dictionary = train_dictionary(base, tokenizer, end_id)
    sha = hashlib.sha256(dictionary).digest()
    small_frame(spark, pa.table({"dictionary": pa.array([dictionary], pa.binary()), "sha256": [sha.hex()]})).coalesce(1).write.mode("overwrite").parquet(f"{path}/dictionary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compress = _codec(dictionary)[0].compress
        shard, segment, first = TaskContext.get().partitionId(), 0, 0
        held: list[tuple[int | None, int, bytes]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            known = [d[0] for d in held if d[0] is not None]
            n = sum(d[1] for d in held)
            row = [shard, segment, min(known, default=None), max(known, default=None), first, n, len(held), pack_segment(sha, width, held)]
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], [c.split()[0] for c in DATA_SCHEMA.split(", ")])

        width = encoder(tokenizer).dtype.itemsize
        for batch in batches:
            for part in slices(batch, 1):
                for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    ids = _ids(tokenizer, end_id, text)
                    held.append((key, len(ids), frame := compress(ids.tobytes())))
                    size += len(frame)
                    if size >= SEGMENT_BYTES or len(held) >= SEGMENT_DOCS:
                        yield flush()
                        first, segment, size = first + sum(d[1] for d in held), segment + 1, 0
                        held.clear()
        if held:
            yield flush()

    small_batches(spark)
    spread = F.xxhash64("text").alias("spread")  # texts of one id, null ids above all, lie in many ranges
    ordered = base.repartitionByRange("doc_id", spread).sortWithinPartitions("doc_id", spread)
    ordered.mapInArrow(lean(run, keeps=True), DATA_SCHEMA).write.mode("overwrite").option("compression", "uncompressed").parquet(f"{path}/data")


def _dictionary(spark: SparkSession, path: str) -> bytes:
    row = spark.read.parquet(f"{path}/dictionary").first()
    if hashlib.sha256(d := bytes(row["dictionary"])).hexdigest() != row["sha256"]:
        raise ValueError("the dictionary is damaged")
    return d


def read_token_ids(spark: SparkSession, path: str, *, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of every document, decompressed from the files at ``path``.

    Only the shards' token totals (a row for each shard) come to the driver.
    """
    dictionary = _dictionary(spark, path)
    data = spark.read.schema(DATA_SCHEMA).parquet(f"{path}/data")
    totals = {r["shard"]: r["n"] for r in data.groupBy("shard").agg(F.sum("n_tokens").alias("n")).collect()}
    bases, total = {}, 0
    for shard in sorted(totals):
        bases[shard] = total
        total += totals[shard]
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, first, payload in zip(*(c.to_pylist() for c in batch.columns)):
                s = Segment(payload, dictionary)
                starts = bases[shard] + first + np.concatenate([[0], np.cumsum(s.tokens)[:-1]])
                crcs, ids = [], []
                for i in range(len(s)):
                    x = s[i].astype("<u4")
                    if len(x) != s.tokens[i]:
                        raise ValueError("a frame disagrees with the index")
                    crcs.append(zlib.crc32(x.tobytes()))
                    if with_ids:
                        ids.append(x.astype("<i4"))
                columns = [pa.array(s.ids, mask=s.nulls.astype(bool)), pa.array(starts.astype("i8")), pa.array(s.tokens), pa.array(crcs, pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array(ids, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    return data.select("shard", "first_token", "payload").mapInArrow(lean(run), schema)


def read_document(spark: SparkSession, path: str, doc_id: int) -> list[list[int]]:
    """The ids of every document with this id, through the index: one segment is read, one frame decompressed."""
    dictionary = _dictionary(spark, path)
    rows = spark.read.schema(DATA_SCHEMA).parquet(f"{path}/data").where((F.col("min_id") <= doc_id) & (F.col("max_id") >= doc_id)).orderBy("shard", "segment").select("payload").toLocalIterator()
    found = []
    for row in rows:
        s = Segment(bytes(row["payload"]), dictionary)
        found += [s[int(i)].astype(int).tolist() for i in np.flatnonzero((s.ids == doc_id) & (s.nulls == 0))]
    return found
