"""Packing: an order-preserving dynamic programme cuts the stream of documents into sequences.

Within a partition, documents' ids (with an end id after each) form a stream in the rows' order. The programme chooses
window cuts at document ends (free), sentence ends or, where those lie far apart, on a coarse grid of tokens
(each at its truncation penalty), minimising padding plus penalties plus a cost for each sequence. A window's
padding is the sequence length less its own, or nothing if its length is a power of two, so the best start for
an end ``j`` is the least ``best[i] + i`` within the length before it (a monotone queue) or one of a few exact
distances. Nothing is lost at a cut: the rest of a document opens the next sequence.

Partitions pack on their own and at once, without any shuffle; each closes one possibly short sequence.
"""

from __future__ import annotations

import json
import os
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyline.llm.common import lean, resident, slices, small_batches, texts_of
from tallyline.llm.encoders import CachedEncoder

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
BLOCK_TOKENS = 1 << 18
CACHED_WORDS = 120_000
#: UTF-8 bytes of text that are cut and looked up at once.
SLICE_BYTES = 1 << 19
SENTENCE_PENALTY, TOKEN_PENALTY, SEQUENCE_COST, GRID, FULL = 1.0, 3.0, 8.0, 128, 4


def choose_cuts(ends: list[int], penalties: list[float], length: int, final: bool) -> list[int]:
    """Window ends within a block that begins at 0; ``ends`` are the allowed cuts, ascending, the last the block's end.

    With ``final``, the last cut is the block's end; otherwise up to ``length`` tokens may be left for the next block.
    """
    exact = [length >> k for k in (1, 2, 3)] if length & (length - 1) == 0 else []
    at = {0: 0}
    position, best, came = [0], [0.0], [-1]
    queue = deque([(0.0, 0)])  # (best + position, index), values ascending
    for end, penalty in zip(ends, penalties):
        low = end - length
        while queue and position[queue[0][1]] < low:
            queue.popleft()
        if not queue:
            raise ValueError("allowed cuts lie more than a sequence apart")
        value, source = queue[0]
        value += length - end
        for d in exact:
            i = at.get(end - d)
            if i is not None and best[i] < value:
                value, source = best[i], i
        value += penalty + SEQUENCE_COST
        at[end] = k = len(best)
        position.append(end)
        best.append(value)
        came.append(source)
        key = value + end
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, k))
    last = len(best) - 1
    if not final:
        end, slope = position[-1], SEQUENCE_COST / length
        k = last
        while k > 0 and position[k] > end - length:
            if best[k] + slope * (end - position[k]) < best[last] + slope * (end - position[last]):
                last = k
            k -= 1
    cuts = []
    while last > 0:
        cuts.append(position[last])
        last = came[last]
    return cuts[::-1]


def _sentence_ends(tokenizer: str) -> np.ndarray:
    """By token id: whether the token ends a sentence."""
    vocab = json.load(open(tokenizer, encoding="utf-8"))["model"]["vocab"]
    table = np.zeros(max([*vocab.values(), 0]) + 1, bool)
    for token, i in vocab.items():
        t = token.removesuffix("</w>")
        table[i] = bool(t) and t[-1] in ".!?" and not any(c.isalnum() for c in t)
    return table


class Packer:
    """Feeds on documents, gives pieces (one tuple a piece, as SCHEMA)."""

    def __init__(self, ends: np.ndarray, length: int, first_sequence: int):
        self.ends, self.length, self.sequence = ends, length, first_sequence
        self.docs: deque[tuple[int | None, np.ndarray, int]] = deque()  # id, ids, position of its first token in the stream
        self.origin = self.total = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> list[tuple]:
        self.docs.append((doc_id, ids, self.total))
        self.total += len(ids)
        return self.pack(False) if self.total - self.origin >= BLOCK_TOKENS else []

    def pack(self, final: bool) -> list[tuple]:
        if not self.docs:
            return []
        span = self.total - self.origin
        price = np.full(span + 1, np.inf)
        price[:: min(GRID, self.length)] = TOKEN_PENALTY
        for _, ids, base in self.docs:
            at = np.flatnonzero(self.ends[np.minimum(ids, len(self.ends) - 1)]) + 1 + base - self.origin
            price[at[(at > 0)]] = SENTENCE_PENALTY
        for _, ids, base in self.docs:  # whole sequences from a document's end on can be full to the last token
            end = base + len(ids) - self.origin
            full = price[end + self.length : end + FULL * self.length + 1 : self.length]
            np.minimum(full, TOKEN_PENALTY, out=full)
        for _, ids, base in self.docs:
            price[base + len(ids) - self.origin] = 0.0
        price[0] = np.inf
        allowed = np.flatnonzero(np.isfinite(price))
        pieces = []
        pieces, begin = [], 0
        for end in choose_cuts(allowed.tolist(), price[allowed].tolist(), self.length, final):
            pieces += self._window(self.origin + begin, self.origin + end)
            begin = end
        self.origin += begin
        return pieces

    def _window(self, begin: int, end: int) -> list[tuple]:
        """The pieces of one sequence; documents that it finishes are let go."""
        pieces, offset, at = [], 0, begin
        while at < end:
            doc_id, ids, base = self.docs[0]
            stop = min(end, base + len(ids))
            part = ids[at - base : stop - base]
            pieces.append((doc_id, at - base, len(part), zlib.crc32(part.astype("<u4").tobytes()), len(ids), self.sequence, offset))
            offset += len(part)
            at = stop
            if stop == base + len(ids):
                self.docs.popleft()
        self.sequence += 1
        return pieces


def pack(docs: DataFrame, tokenizer: str, *, end_id: int, length: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack every whole text (null: empty) into sequences of at most ``length`` tokens: one row for each piece.

    Columns: doc_id, start (its document's ids before it), length, ids_crc32, doc_tokens, sequence_id, offset. Each id
    lies in exactly one piece; offsets are gapless from 0; ``sequence_id`` is the partition in the high bits and a count.
    Repeated rows are packed as often as they occur; an empty table gives an empty one. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        e, ends = resident(("packing", tokenizer), lambda: (CachedEncoder(tokenizer, CACHED_WORDS), _sentence_ends(tokenizer)))
        packer = Packer(ends, length, TaskContext.get().partitionId() << 33)
        names = [c.split()[0] for c in SCHEMA.split(", ")]

        def rows(pieces: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*pieces)], names)

        for batch in batches:
            for part in slices(batch, 1, SLICE_BYTES):
                ids, stops = e.encode_batch(texts_of(part, 1), end_id)
                stops = stops.tolist()
                for doc_id, begin, stop in zip(part.column(0).to_pylist(), [0, *stops], stops):
                    if pieces := packer.add(doc_id, ids[begin:stop]):
                        yield rows(pieces)
        if pieces := packer.pack(True):
            yield rows(pieces)

    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(lean(run, keeps=True), SCHEMA)
