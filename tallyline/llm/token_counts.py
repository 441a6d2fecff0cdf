"""Token counts by compiled finite-state transducers.

Two deterministic transducers count the tokens of a byte-level BPE tokenizer (``tokenizers`` .json files):

* The *splitter* finds pre-token boundaries. It has thirteen states over character classes and writes boundary marks
  at each transition, at most one character late. The characters of a batch of texts, joined with an end class after
  each, are cut into chunks of equal length; each chunk's state map (where it ends, for each state it may begin in) is
  computed for all chunks side by side, the maps are composed by a parallel prefix scan, and a second sweep from
  the now known states writes the marks. The length of a text does not matter.
* The *merger* reads the bytes of a pre-token; each transition carries the change of the token count. A state is what
  later bytes can see: the longest suffix that begins a token, the last token at each position within it and the
  token counts there. Of the tokens that end at the new byte, the one that is compatible with the token
  before it is the last token of the unique BPE result. States are determinised on demand and kept within a bound.

Counts of short pre-tokens are remembered within a bound.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyline.llm.common import fresh, lean, plus, resident, slices, small_batches, texts_of
from tallyline.llm.encoders import _Cache, library_class

# Character classes.
SP, WS, LETTER, NUMBER, APOS, OTHER, STMD, R, V, LL, E, END = range(12)
_K = 16  # row length of the transition table
# States: beginning; within letters, numbers, others; one space, more white space ending in a space; one other white
# space, more ending so; apostrophe; apostrophe and r, v, l; contraction finished.
B, SL, SN, SO, S1, S2, T1, T2, A, AR, AV, AL, C = range(13)
_STATES = 13


def splitter() -> tuple[np.ndarray, np.ndarray]:
    """Transition and output tables, ``state * 16 + class``. Output bit 0: a boundary before this character; 1: before the last."""
    go = np.zeros(_STATES * _K, np.uint8)
    out = np.zeros(_STATES * _K, np.uint8)
    begin = {SP: S1, WS: T1, LETTER: SL, NUMBER: SN, APOS: A, OTHER: SO, STMD: SL, R: SL, V: SL, LL: SL, E: SL, END: B}
    letters = {LETTER, STMD, R, V, LL, E}
    for state in range(_STATES):
        for c in range(12):
            to, mark = begin[c], 1
            if c == END:
                mark = 3 if state in (AR, AV, AL) else 1
            elif state == SL and c in letters or state == SN and c == NUMBER:
                mark = 0
            elif state == SO and c in (OTHER, APOS):
                to, mark = SO, 0
            elif state in (S1, S2, T1, T2) and c in (SP, WS):
                to, mark = (S2 if c == SP else T2), 0
            elif state in (S1, S2):  # the last space goes with what follows
                to, mark = (SO if c == APOS else to), (0 if state == S1 else 2)
            elif state == T2:
                mark = 3
            elif state == A:
                if c in (STMD, R, V, LL):
                    to, mark = {STMD: C, R: AR, V: AV, LL: AL}[c], 0
                elif c in (OTHER, APOS):
                    to, mark = SO, 0
            elif state in (AR, AV) and c == E or state == AL and c == LL:
                to, mark = C, 0
            elif state in (AR, AV, AL):  # no contraction after all: the letter began a run of its own
                mark = 2 if c in letters else 3
            go[state * _K + c], out[state * _K + c] = to, mark
    return go, out


#: Unicode White_Space outside ASCII (fixed values).
WHITE_SPACE = (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)


#: Below this code point Python's character tables are those of the tokenizers library.
COMMON = 0x250


@cache
def character_classes(whole: bool = True) -> np.ndarray:
    """By code point, by the library's tables; without ``whole`` only those below ``COMMON``, which are quick to make."""
    table = np.full(0x110000, OTHER, np.uint8)
    for kind, k in (("L", LETTER), ("N", NUMBER)):
        members = library_class(kind) if whole else (c for c in map(chr, range(COMMON)) if unicodedata.category(c)[0] == kind)
        table[[ord(c) for c in members]] = k
    table[list(range(9, 14)) + list(WHITE_SPACE)] = WS
    table[ord(" ")], table[ord("'")] = SP, APOS
    for c, k in (("s", STMD), ("t", STMD), ("m", STMD), ("d", STMD), ("r", R), ("v", V), ("l", LL), ("e", E)):
        table[ord(c)] = k
    return table


def compose_prefix(maps: np.ndarray) -> np.ndarray:
    """Inclusive prefix composition of state maps, in log2(n) rounds: row i maps a state before chunk 0 to the one after chunk i."""
    done, step = maps.copy(), 1
    while step < len(done):
        done[step:] = np.take_along_axis(done[step:], done[:-step], axis=1)
        step *= 2
    return done


def boundaries(classes: np.ndarray, chunk: int = 512) -> np.ndarray:
    """Whether a pre-token begins at each position of ``classes`` (a flat array in which END follows each text)."""
    n = len(classes)
    lanes = -(-n // chunk)
    padded = np.full(lanes * chunk, END, np.uint8)
    padded[:n] = classes
    columns = np.ascontiguousarray(padded.reshape(lanes, chunk).T)
    go, out = splitter()
    maps = np.tile(np.arange(_STATES, dtype=np.uint8), (lanes, 1))
    settled = None
    for j in range(chunk):
        if settled is None:
            maps = go[(maps.astype(np.uint16) * _K) + columns[j][:, None]]
            if j % 16 == 15 and (maps == maps[:, :1]).all():
                settled = maps[:, 0].copy()  # every chunk has forgotten how it began
        else:
            settled = go[settled.astype(np.uint16) * _K + columns[j]]
    if settled is not None:
        maps = np.repeat(settled[:, None], _STATES, axis=1)
    state = np.full(lanes, B, np.uint8)
    state[1:] = compose_prefix(maps)[:-1, B]
    marks = np.empty((chunk, lanes), np.uint8)
    for j in range(chunk):
        at = state.astype(np.uint16) * _K + columns[j]
        marks[j] = out[at]
        state = go[at]
    flat = np.ascontiguousarray(marks.T).reshape(-1)
    begins = (flat & 1).astype(bool)
    begins[:-1] |= (flat[1:] & 2).astype(bool)
    return begins[:n]


def _byte_letters() -> dict[str, int]:
    """The printable characters that byte-level vocabularies write for the 256 bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


#: Bounds of the determinised machine: states; transitions; tokens and pairs of tokens whose merging is known.
STATES, ARCS, KNOWN = 300_000, 900_000, 400_000


class Merger:
    """The transducer over a pre-token's bytes; ``count(bytes)`` sums the emitted changes."""

    def __init__(self, path: str, states: int = STATES):
        spec = json.load(open(path, encoding="utf-8"))
        model, letters = spec["model"], _byte_letters()
        if model["type"] != "BPE" or (spec["pre_tokenizer"] or {}).get("type") != "ByteLevel":
            raise ValueError(f"{path} holds no byte-level BPE")
        raw = {t: bytes(letters[c] for c in t) for t in model["vocab"] if all(c in letters for c in t)}
        self.rank = {}
        for i, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.rank[raw[a], raw[b]] = i
        self.tokens = {raw[x] for x in model["vocab"] if x in raw}
        self.special = [x["content"] for x in spec["added_tokens"]]
        self.prefixes = {t[:i] for t in self.tokens for i in range(1, len(t) + 1)}
        self.limit, self._pairs, self._whole = states, {}, {}
        self._reset()

    def _reset(self) -> None:
        self.arcs: dict[int, tuple[int, int]] = {}
        self.keys: list[tuple] = [(True, b"", (), ())]
        self.ids = {self.keys[0]: 0}

    def merge(self, parts: list[bytes]) -> list[bytes]:
        """Plain BPE; used only to test whether tokens stand as they are."""
        rank = self.rank
        while len(parts) > 1:
            best = min(((rank.get(p, 1 << 60), i) for i, p in enumerate(zip(parts, parts[1:]))), default=None)
            if best is None or best[0] == 1 << 60:
                break
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def stands(self, token: bytes) -> bool:
        known = self._whole.get(token)
        if known is None:
            if len(self._whole) > KNOWN:
                self._whole.clear()
            known = self._whole[token] = token in self.tokens and len(self.merge([token[i : i + 1] for i in range(len(token))])) == 1
        return known

    def compatible(self, left: bytes, right: bytes) -> bool:
        """Whether BPE leaves the two tokens as they are when they stand side by side."""
        known = self._pairs.get((left, right))
        if known is None:
            both = left + right
            if len(self._pairs) > KNOWN:
                self._pairs.clear()
            known = self._pairs[left, right] = self.merge([both[i : i + 1] for i in range(len(both))]) == [left, right]
        return known

    def _arc(self, state: int, byte: int) -> tuple[int, int]:
        # suffix: the longest suffix that begins a token. lasts[i], counts[i]: last token and token count (less the
        # count at the end) after the suffix's byte i; entry -1 before it is given by whole (nothing) or base.
        whole, suffix, lasts, counts = self.keys[state]
        grown = suffix + bytes((byte,))
        n = len(grown)
        token = None
        for length in range(n, 0, -1):
            t = grown[n - length :]
            if not self.stands(t):
                continue
            at = n - length  # bytes of the suffix before t
            if at == 0:
                if whole:
                    token, before = t, self._zero(counts)
                    break
                if self.compatible(lasts[0], t):
                    token, before = t, counts[0]
                    break
            elif self.compatible(lasts[at - (1 if whole else 0)], t):
                token, before = t, counts[at - (1 if whole else 0)]
                break
        if token is None:
            raise ValueError("the vocabulary lacks single bytes")
        change = before + 1
        # Entries: for whole suffixes, after each byte; else also the position just before the suffix.
        lasts, counts = (*lasts, token), tuple(c - change for c in counts) + (0,)
        zero = whole
        while grown not in self.prefixes:
            grown = grown[1:]
            if zero:
                zero = False  # the entry after the dropped byte becomes the one before the suffix
            else:
                lasts, counts = lasts[1:], counts[1:]
        key = (zero, grown, lasts, counts)
        to = self.ids.get(key)
        if to is None:
            to = self.ids[key] = len(self.keys)
            self.keys.append(key)
        self.arcs[state << 8 | byte] = to, change
        return to, change

    @staticmethod
    def _zero(counts: tuple[int, ...]) -> int:
        """The count before the first byte, less the count at the end (whole suffixes only: the first byte makes one token)."""
        return counts[0] - 1 if counts else 0

    def count(self, data: bytes) -> int:
        state = total = 0
        arcs = self.arcs
        for byte in data:
            arc = arcs.get(state << 8 | byte)
            if arc is None:
                arc = self._arc(state, byte)
            state = arc[0]
            total += arc[1]
            if (len(self.keys) > self.limit or len(arcs) > ARCS) and state:
                key = self.keys[state]
                self._reset()
                arcs = self.arcs
                state = self.ids.setdefault(key, len(self.keys))
                if state == len(self.keys):
                    self.keys.append(key)
        return total


class TokenCounter:
    def __init__(self, path: str):
        self.merger = Merger(path)
        self.words = _Cache(lambda w: self.merger.count(w.encode("utf-8", "surrogatepass")))

    def counts(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text."""
        pieces, owner, extra = [], [], np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            parts = [text]
            for s in self.merger.special:  # found first, whatever surrounds them
                if s in text:
                    parts = [q for p in parts for q in p.split(s)]
            extra[i] = len(parts) - 1
            pieces.extend(parts)
            owner.extend([i] * len(parts))
        joined = "\0".join(pieces) + "\0"
        raw = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        classes = character_classes(int(raw.max()) >= COMMON)[raw]
        ends = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)) + 1) - 1
        classes[ends] = END
        begins = np.flatnonzero(boundaries(classes))
        last = np.searchsorted(begins, ends)  # each text's end is a pre-token of its own
        cut = begins.tolist()
        words = [joined[a:b] for a, b in zip(cut, [*cut[1:], len(joined)])]
        for k in last.tolist():
            words[k] = ""
        n = np.fromiter(map(self.words.__getitem__, words), np.int64, len(words))
        sums = np.add.reduceat(n, np.concatenate([[0], last[:-1] + 1])) if len(n) else n
        np.add.at(extra, np.array(owner, np.int64), sums)
        return extra


def counter(path: str) -> TokenCounter:
    """The Python worker's counter for a file."""
    return resident(("counter", path), lambda: TokenCounter(path))


def count_tokens(docs: DataFrame, tokenizer: str, *, text_col: str = "text", out_col: str = "n_tokens") -> DataFrame:
    """``docs`` with the number of tokens of each whole text (long), without begin, end or added special tokens.

    A special token's string inside a text counts as that token, as the library has it. Null and empty texts have 0
    tokens. The input's other columns, repeated rows and order within partitions stay as they are; an empty table
    gives an empty one. If ``out_col`` is taken, an underscore is added to it. Nothing is shuffled.
    """
    name, at = fresh(docs.columns, out_col), docs.columns.index(text_col)
    schema = plus(docs.schema, (name, T.LongType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(tokenizer)
        for batch in batches:
            for part in slices(batch, at):
                n = pa.array(c.counts(texts_of(part, at)))
                yield pa.RecordBatch.from_arrays([*part.columns, n], [*part.schema.names, name])

    small_batches(docs.sparkSession)
    return docs.mapInArrow(lean(run, keeps=True), schema)


def token_report(docs: DataFrame, tokenizer: str, *, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every row; the text does not leave the counting step."""
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"), F.col(text_col).alias("text"))
    return count_tokens(base, tokenizer).select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
