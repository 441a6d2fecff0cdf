"""Language-model scoring by a weighted backoff automaton over the n-grams of the whole corpus.

The model. ``P(w | h) = (c(hw) + a P(w | h')) / (c(h) + a)`` with h' the history h without its first word, down to
``P(w) = (c(w) + 1) / (N + V + 1)``; c counts in training texts, a is ``PRIOR``. It sums to one over the known words and one unknown
word. As an automaton: each history with a count is a state, each n-gram with a count an arc that carries the log of its
probability and leads to the longest history that the text then ends in; a state's failure arc carries
``log(a / (c(h) + a))`` and leads to h'. A text starts in the state "start of text" and is traversed once from left to right.

The corpus. The automaton of all texts has no size bound, so no task holds it. Texts are put into blocks of some megabytes; a
block needs the arcs of its own n-grams only. One pass reads the texts, and for each block sends its different n-grams (64-bit hashes
in order, with their counts in the block's training texts) to shards of the hash space, with the packed texts beside them. A shard adds the counts
up over all blocks and answers each block in the order it asked in. The answers are stored; they meet their block's texts
in a second shuffle, where the block's automaton is built and its texts are traversed.

Every n-gram of every training text counts, once for each block at most in a shuffle, so that a word with a third of all
tokens is one number for each block. Two of a billion different n-grams share a hash with a probability of 0.03; they then count
as one. Shards are as many as keep one within ``SHARD_BYTES`` of text. Memory is bounded by a block (or the longest text) and a shard.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline.llm.common import lean, materialize, slices, small_batches, sweep, texts_of
from tallyline.llm.encoders import _Cache

ORDER = 2
#: The weight of the shorter history, as a number of occurrences.
PRIOR = 256.0
#: UTF-8 bytes of text in a block, and for each shard of the hash space.
BLOCK_BYTES, SHARD_BYTES = 6 << 20, 8 << 20
CACHED_WORDS = 200_000
_U = np.uint64
_START, _END = _U(0x5851F42D4C957F2D), _U(xxhash.xxh64_intdigest(b""))
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: Kinds of rows on the way: a block's packed texts, an n-gram question or its answer, a shard's sums.
TEXTS, GRAMS, SUMS = 0, 1, 2


def held_out(key: Column) -> Column:
    """Whether crc32 of the id as text leaves 2 modulo 7; a null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(7)) == 2, F.lit(False))


def words_of(text: str) -> list[bytes]:
    """Words between ASCII white space, with A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").translate(_LOWER).split()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Tokens:
    """The tokens of some texts in a row: hashes, and where each text starts."""

    def __init__(self, texts: list[str], cache: _Cache):
        ids, starts = [], [0]
        for text in texts:
            words = words_of(text)
            ids.append(np.fromiter(map(cache.__getitem__, words), _U, len(words)))
            ids.append(np.array([_END]))
            starts.append(starts[-1] + len(words) + 1)
        self.words = np.concatenate(ids)
        self.starts = np.array(starts[:-1], np.int64)
        self.lengths = np.diff(starts)

    def grams(self, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each k up to ``order``: the different k-grams in the order of their hashes, and of each position the index of the k-gram
        that ends there (-1 if the text is too short; the start of text counts as the word before the first)."""
        keys, valid, out = self.words, np.ones(len(self.words), bool), []
        since = np.arange(len(self.words)) - np.repeat(self.starts, self.lengths)
        for k in range(1, order + 1):
            if k > 1:
                before = np.empty_like(keys)
                before[1:] = keys[:-1]
                before[since == 0] = _START
                # At the start of a text only the pair with the start itself exists.
                valid = since >= k - 2
                keys = _mix(before * _U(0x9E3779B97F4A7C15) + self.words * _U(0xD6E8FEB86659FD93) + _U(k))
            found, at = np.unique(keys[valid], return_inverse=True)
            index = np.full(len(keys), -1, np.int64)
            index[valid] = at
            out.append((found, index))
        return out


def _small(counts: np.ndarray) -> bytes:
    top = int(counts.max(initial=0))
    return zstandard.ZstdCompressor(level=1).compress(struct.pack("<B", width := 1 if top < 1 << 8 else 2 if top < 1 << 16 else 4 if top < 1 << 32 else 8) + counts.astype(f"<u{width}").tobytes())


def _counts(data: bytes) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(data)
    return np.frombuffer(raw, f"<u{raw[0]}", offset=1).astype(np.int64)


def _gaps(keys: np.ndarray) -> bytes:
    """Sorted hashes as the first one and the gaps between them, in as few bytes as the largest gap takes: six, mostly."""
    gaps = np.diff(keys)
    width = max(1, (int(gaps.max(initial=0)).bit_length() + 7) // 8)
    return struct.pack("<BQ", width, int(keys[0])) + gaps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _from_gaps(data: bytes) -> np.ndarray:
    width, first = struct.unpack_from("<BQ", data)
    cells = np.frombuffer(data, np.uint8, offset=9).reshape(-1, width)
    wide = np.zeros((len(cells) + 1, 8), np.uint8)
    wide[1:, :width] = cells
    gaps = wide.reshape(-1).view("<u8")
    gaps[0] = first
    return np.cumsum(gaps, dtype=_U)


def _packed(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(data).read_next_batch()


def _blocks(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """Rows gathered to ``BLOCK_BYTES`` of a text column (or one larger text)."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        for part in slices(batch, column, BLOCK_BYTES // 8):
            n = pa.compute.sum(pa.compute.binary_length(part.column(column))).as_py() or 0
            if held and size + n > BLOCK_BYTES:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size = [], 0
            if part.num_rows:
                held.append(part)
                size += n
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


_SCHEMA = "block long, shard int, kind int, gram int, keys binary, counts binary"
_NAMES = ["block", "shard", "kind", "gram", "keys", "counts"]


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 6, types)], _NAMES)


def _questions(rows: DataFrame, order: int, shards: int) -> DataFrame:
    """``rows`` (id, held_out, text) as blocks: the packed texts of each, and its n-grams for each shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, task = _Cache(xxhash.xxh64_intdigest, CACHED_WORDS), TaskContext.get().partitionId()
        edges = np.array([(i << 64) // shards for i in range(1, shards)], _U)
        for n, part in enumerate(_blocks(batches, 2)):
            block = task << 24 | n
            tokens = Tokens(texts_of(part, 2), cache)
            train = np.repeat(~part.column(1).to_numpy(zero_copy_only=False), tokens.lengths)
            yield _rows([(block, (task + 7919 * n) % shards, TEXTS, 0, _packed(part), None)])
            for k, (keys, index) in enumerate(tokens.grams(order), 1):
                counts = np.bincount(index[train & (index >= 0)], minlength=len(keys))
                cuts = [0, *np.searchsorted(keys, edges).tolist(), len(keys)]
                ranges = [(s, a, b) for s, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]
                yield _rows([(block, s, GRAMS, k, _gaps(keys[a:b]), _small(counts[a:b])) for s, a, b in ranges])

    return rows.mapInArrow(lean(run), _SCHEMA)


def _answers(questions: DataFrame, shards: int) -> DataFrame:
    """Counts over all blocks in place of each block's own; packed texts pass. A shard's sums are N and V of its part of the words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, asked = None, {}

        def done() -> Iterator[pa.RecordBatch]:
            for k, parts in sorted(asked.items()):
                keys = [_from_gaps(keys) for _, keys, _ in parts]
                distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
                own = np.concatenate([_counts(counts) for _, _, counts in parts])
                total = np.bincount(at, own, len(distinct)).astype(np.int64)
                if k == 1:
                    yield _rows([(-1, shard, SUMS, k, None, struct.pack("<qq", int(own.sum()), int(np.count_nonzero(total))))])
                ends = np.cumsum(list(map(len, keys)))[:-1]
                yield _rows([(block, shard, GRAMS, k, None, _small(x)) for (block, _, _), x in zip(parts, np.split(total[at], ends))])

        for batch in batches:
            for block, s, kind, k, keys, counts in zip(*(c.to_pylist() for c in batch.columns)):
                if s != shard:
                    yield from done()
                    shard, asked = s, {}
                if kind == TEXTS:
                    yield _rows([(block, s, kind, k, keys, counts)])
                else:
                    asked.setdefault(k, []).append((block, keys, counts))
        yield from done()

    return questions.repartition(shards, "shard").sortWithinPartitions("shard").mapInArrow(lean(run), _SCHEMA)


class Automaton:
    """The states and arcs that the texts of a block can meet.

    ``grams`` are as ``Tokens.grams`` gives them, ``counts`` their counts in training, of each order. State 0 is the empty history, 1
    the start of a text, the others are histories with a count. The arc of a state of depth d on the word at a position is that of the d + 1 words
    ending there, so arcs are found by the index of their n-gram; -1 stands for none. Words always have an arc from state 0.
    """

    def __init__(self, tokens: Tokens, grams: list[tuple[np.ndarray, np.ndarray]], counts: list[np.ndarray], texts: int, total: int, distinct: int, prior: float):
        order = len(grams)
        word, ends = grams[0][1], grams[0][0] == _END
        begins = np.zeros(len(word), bool)
        begins[tokens.starts] = True
        fail, back, depth = [np.array([0.0, math.log10(prior / (texts + prior))])], [np.array([-1, 0])], [np.array([0, 1])]
        states, size = [], 2
        weights, targets, self.arcs, offset = [], [], [], 0
        p = None
        for k, ((keys, index), c) in enumerate(zip(grams, counts), 1):
            # A position where each k-gram occurs: from it follow its k-gram without the first word, and its history.
            at = np.zeros(len(keys), np.int64)
            there = np.flatnonzero(index >= 0)
            at[index[there]] = there
            if k == 1:
                p, shorter = (c + 1) / (total + distinct + 1), None
            else:
                shorter = grams[k - 2][1][at]
                history = np.where(begins[at], texts, counts[k - 2][grams[k - 2][1][at - 1]])
                p = (c + prior * p[shorter]) / (history + prior)
            if k < order:
                real = (c > 0) & ~ends[word[at]]
                state = np.zeros(len(keys), np.int64) if k == 1 else states[-1][shorter]
                suffix = state[real]
                state[real] = size + np.arange(len(suffix))
                size += len(suffix)
                fail.append(np.log10(prior / (c[real] + prior)))
                back.append(suffix)
                depth.append(np.full(len(suffix), k))
                states.append(state)
            weights.append(np.log10(p))
            targets.append(states[-1] if k < order else states[-1][shorter] if order > 1 else np.zeros(len(keys), np.int64))
            arc = np.where(index < 0, -1, offset + index)
            if k > 1:
                arc[(index < 0) | (c[index] == 0)] = -1
            self.arcs.append(arc)
            offset += len(keys)
        self.weights, self.targets = np.concatenate(weights).tolist(), np.concatenate(targets).tolist()
        self.fail, self.back, self.depth = (np.concatenate(x).tolist() for x in (fail, back, depth))
        self.start = 1 if order > 1 else 0

    def score(self, start: int, length: int) -> float:
        """The log10 probability of the text of some positions: one traversal from its start."""
        weights, targets, fail, back, depth = self.weights, self.targets, self.fail, self.back, self.depth
        state, total = self.start, 0.0
        for arcs in zip(*(x[start : start + length].tolist() for x in self.arcs)):
            arc = arcs[depth[state]]
            while arc < 0:
                total += fail[state]
                state = back[state]
                arc = arcs[depth[state]]
            total += weights[arc]
            state = targets[arc]
        return total


_OUT = ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def _scores(answers: DataFrame, order: int, texts: int, total: int, distinct: int, prior: float, id_type: str) -> DataFrame:
    rows = answers.where(F.col("kind") != SUMS).repartition("block").sortWithinPartitions("block", "kind", "gram", "shard")

    def block(packed: bytes, by_order: dict[int, list[np.ndarray]], cache: _Cache) -> pa.RecordBatch:
        part = _unpacked(packed)
        tokens = Tokens(texts_of(part, 2), cache)
        grams = tokens.grams(order)
        counts = [np.concatenate(by_order[k]) for k in range(1, order + 1)]
        machine = Automaton(tokens, grams, counts, texts, total, distinct, prior)
        words = grams[0][1]
        c = counts[0][words]
        base = np.add.reduceat(np.log10((c + 1) / (total + distinct + 1)), tokens.starts)
        known = np.add.reduceat((c > 0).astype(np.int64), tokens.starts)
        scores = [machine.score(s, n) for s, n in zip(tokens.starts.tolist(), tokens.lengths.tolist())]
        lengths = pa.array(tokens.lengths)
        return pa.RecordBatch.from_arrays([part.column(0), part.column(1), lengths, pa.array(known), pa.array(np.full(len(known), total)), pa.array(base), pa.array(scores, pa.float64())], list(_OUT))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _Cache(xxhash.xxh64_intdigest, CACHED_WORDS)
        at, packed, by_order = None, None, {}
        for batch in batches:
            for row in range(batch.num_rows):
                b, kind, k = (batch.column(i)[row].as_py() for i in (0, 2, 3))
                if b != at:
                    if at is not None:
                        yield block(packed, by_order, cache)
                    at, packed, by_order = b, None, {}
                if kind == TEXTS:
                    packed = batch.column(4)[row].as_py()
                else:
                    by_order.setdefault(k, []).append(_counts(batch.column(5)[row].as_py()))
        if at is not None:
            yield block(packed, by_order, cache)

    return rows.mapInArrow(lean(run), f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def lm_score(docs: DataFrame, *, out: Column | None = None, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, prior: float = PRIOR) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    Rows of which ``out`` (by default ``held_out`` of the id) is true are scored, not learned from. A null text is empty: one token, the end. Without
    training rows every word is unknown. Repeated rows count and are scored as often as they occur; a null id is a
    training row; an empty table gives an empty one. Other columns aren't read, so their names can't clash. Ties can't arise.
    """
    spark = docs.sparkSession
    small_batches(spark)
    out = held_out(F.col(f"`{id_col}`")) if out is None else F.coalesce(out, F.lit(False))
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), out.alias("held_out"), F.col(f"`{text_col}`").alias("text"))
    size, texts = rows.agg(F.sum(F.octet_length("text")), F.count_if(~F.col("held_out"))).first()
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), (size or 0) // SHARD_BYTES + 1)
    answers = materialize(_answers(_questions(rows, order, shards), shards), "lm-answers")
    sweep(spark)  # the questions' shuffle is the largest
    sums = answers.where(F.col("kind") == SUMS).select("counts")

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, v = np.array([struct.unpack("<qq", x) for x in batch.column(0).to_pylist()], np.int64).reshape(-1, 2).sum(axis=0)
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([v])], ["n", "v"])

    total, distinct = sums.mapInArrow(lean(added), "n long, v long").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    return _scores(answers, order, texts, total, distinct, prior, rows.schema["doc_id"].dataType.simpleString())
