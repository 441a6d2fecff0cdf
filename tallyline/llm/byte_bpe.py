"""Byte-level BPE encoding and decoding over a rank file, with a hierarchical-bitmap rank queue.

A pre-token's bytes form a doubly linked list. Each adjacent pair that the ranks know is put into the bucket of its
merge rank, and the rank's bit is set in a bitmap of two levels; the next merge is found by find-first-set from the
top level down, two word operations whatever the length. Buckets give their positions from the left; an entry whose
pair has changed since is stale and skipped. A pre-token of n bytes takes O(n log n) time at worst and O(n) memory.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import cache
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyline.llm.common import lean, resident, slices, small_batches, texts_of
from tallyline.llm.encoders import _Cache, aligned, differing, every_character, splitter

WORD = 256  # bits of a bitmap word (a Python integer)
_BITS = [1 << i for i in range(WORD)]


class RankQueue:
    """A priority queue of (rank, position) with ranks below a fixed bound; empty between pre-tokens.

    Bit ``r`` of the low level: bucket ``r`` has entries; the top level has a bit for each word of the low level that has
    bits. 256 bits a word make two levels reach for 65,536 ranks; more ranks only lengthen the top word.
    """

    def __init__(self, ranks: int):
        self.low = [0] * (-(-ranks // WORD))
        self.buckets: dict[int, list[int]] = {}


@cache
def _differing() -> dict[int, int]:
    import tiktoken

    def members(kind: str) -> frozenset[str]:
        pattern = rf"\p{{{kind}}}+" if kind else r"[^\s\p{L}\p{N}]+"
        single = tiktoken.Encoding("class", pat_str=pattern, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
        return frozenset(bytes(single.encode_ordinary(every_character())).decode())

    return differing(members)


class ByteBPE:
    """Encoder and decoder of a rank file (base64 token and rank a line)."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes_of = {r: t for t, r in self.ranks.items()}
        self.queue = RankQueue(max(self.ranks.values()) + 1)
        self.split = splitter(pattern, aligned(pattern, _differing))
        self.words = _Cache(self._word)
        #: Rank of each pair of bytes, -1 for none.
        self.two = {(a, b): self.ranks.get(bytes((a, b)), -1) for a in range(256) for b in range(256)}
        self.bytes_by_text = {str(r): t for t, r in self.ranks.items()}

    def _word(self, word: str) -> str:
        return ",".join(map(str, self.merge(word.encode("utf-8", "surrogatepass"))))

    def merge(self, data: bytes) -> list[int]:
        """The ranks of one pre-token's tokens. The queue's steps stand in line here: calls would take longer than they do."""
        get, n = self.ranks.get, len(data)
        if (whole := get(data)) is not None:
            return [whole]
        queue = self.queue
        low, buckets, top, bits = queue.low, queue.buckets, 0, _BITS
        # Node i stands for the token from byte i to end[i]; before[i] is the node to its left; pair[i] is the rank of
        # the pair that it begins, or -1.
        end, before, pair = list(range(1, n + 1)), list(range(-1, n - 1)), [-1] * n
        for i, r in enumerate(map(self.two.__getitem__, zip(data, data[1:]))):
            if r >= 0:
                pair[i] = r
                if r in buckets:
                    buckets[r].append(i)
                else:
                    buckets[r] = [i]
                    k = r >> 8
                    low[k] |= bits[r & 255]
                    top |= 1 << k
        todo = []
        while True:
            for i in todo:  # pairs that came about
                r = get(data[i : end[end[i]]], -1)
                pair[i] = r
                if r >= 0:
                    if r in buckets:
                        heappush(buckets[r], i)
                    else:
                        buckets[r] = [i]
                        k = r >> 8
                        low[k] |= bits[r & 255]
                        top |= 1 << k
            if not top:
                break
            k = (top & -top).bit_length() - 1
            word = low[k]
            r = k << 8 | (word & -word).bit_length() - 1
            bucket = buckets[r]
            if len(bucket) > 1:
                i = heappop(bucket)
            else:
                i = bucket[0]
                del buckets[r]
                low[k] = word = word & (word - 1)
                if not word:
                    top &= top - 1
            todo = []
            if pair[i] != r:
                continue  # stale
            j = end[i]
            stop = end[i] = end[j]
            pair[j] = pair[i] = -1
            if (h := before[i]) >= 0:
                todo.append(h)
            if stop < n:
                before[stop] = i
                todo.append(i)
        ranks, out, i = self.ranks, [], 0
        while i < n:
            out.append(ranks[data[i : end[i]]])
            i = end[i]
        return out

    def encode_text(self, text: str) -> str:
        """The ids in decimal, joined by commas."""
        return ",".join(map(self.words.__getitem__, self.split(text)))

    def encode(self, text: str) -> list[int]:
        return [int(x) for x in self.encode_text(text).split(",")] if text else []

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def decode_text(self, ids: str) -> bytes:
        return b"".join(map(self.bytes_by_text.__getitem__, ids.split(","))) if ids else b""


def codec(path: str, pattern: str) -> ByteBPE:
    """The Python worker's codec for a rank file."""
    return resident(("codec", path), lambda: ByteBPE(path, pattern))


def encode_documents(docs: DataFrame, path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids]) of every whole text; null counts as empty.

    ``ids_sha256`` is of the decimal ids joined by commas, ``decoded_sha256`` of the bytes that decoding the ids gives; an
    empty text has no ids and the digests of nothing. Repeated rows stay; an empty table gives an empty one. Other
    columns are not read and nothing is shuffled.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in batches:
            for part in slices(batch, 1):
                counts, first, second, kept = [], [], [], []
                for text in texts_of(part, 1):
                    ids = c.encode_text(text)
                    counts.append(ids.count(",") + 1 if ids else 0)
                    first.append(hashlib.sha256(ids.encode()).hexdigest())
                    second.append(hashlib.sha256(c.decode_text(ids)).hexdigest())
                    if with_ids:
                        kept.append([int(x) for x in ids.split(",")] if ids else [])
                columns = [part.column(0), pa.array(counts, pa.int64()), pa.array(first, pa.string()), pa.array(second, pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    columns.append(pa.array(kept, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(lean(run, keeps=True), schema)
