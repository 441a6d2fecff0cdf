"""Tokenizer access for executors: pre-token caches in front of the public libraries.

A ``tokenizers`` BPE pipeline works on pre-tokens independently of each other, so a text's ids are its
pre-tokens' ids in a row. ``CachedEncoder`` splits with the pipeline's own pattern, asks the library once for
each new pre-token, and remembers the answer within a bounded dictionary. A text with characters that Python's
tables and the library's may treat differently goes to the library whole.

Where pre-tokens hold no white space (``WORD_PATTERN``), ``encode_batch`` cuts many texts at once: boundaries come from
arrays of character classes, Arrow numbers the different pre-tokens, each of these is looked up once, and the library
gets all unknown ones in one call.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Callable
from functools import cache
from itertools import islice

import numpy as np
import pyarrow as pa
import regex

from tallyline.llm.common import resident

CACHE_ENTRIES = 500_000
LONGEST_CACHED = 64
#: Contractions, runs of letters, single digits, runs of other characters; white space is in none.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SPACE, LETTER, NUMBER, OTHER = range(4)


#: The Latin-1 members of \\p{L}, \\p{N} and \\s, as class members (fixed values).
_LATIN = {"L": "A-Za-zªµºÀ-ÖØ-öø-ÿ", "N": "0-9²³¹¼½¾", "s": " \\t-\\r\\x85\\xa0"}


#: Blocks in which all characters in normal form C have the same class, case and normal form in all Unicode versions since 6
#: (fixed values): Latin, Greek, Cyrillic, punctuation and currency, kana, unified ideographs, Hangul syllables.
SETTLED = (
    (0x0000, 0x024F), (0x0386, 0x03FF), (0x0400, 0x0482), (0x048A, 0x0523), (0x2010, 0x2027), (0x2030, 0x205E), (0x20AC, 0x20AC), (0x3001, 0x3020),
    (0x3041, 0x3096), (0x30A1, 0x30FA), (0x4E00, 0x9FA5), (0xAC00, 0xD7A3),
)


@cache
def settled() -> Callable[[str], object]:
    """Truthy for a text whose characters are all starters in normal form C of the ``SETTLED`` blocks: it stays as it is under NFC."""
    import re

    plain = lambda c: unicodedata.is_normalized("NFC", c) and not unicodedata.combining(c) and unicodedata.category(c) != "Cn"
    kept = [c for low, high in SETTLED for c in map(chr, range(low, high + 1)) if plain(c)]
    runs: list[list[int]] = []
    for c in map(ord, kept):
        if runs and runs[-1][1] == c - 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return re.compile("[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in runs) + "]*").fullmatch


#: Classes of characters: the library's name, a member that no version doubts, the pattern of ``regex``.
_CLASSES = {"L": (r"\p{L}", "a"), "N": (r"\p{N}", "1"), "": (r"[^\s\p{L}\p{N}]", "!")}


def every_character() -> str:
    return "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)


@cache
def library_class(kind: str) -> frozenset[str]:
    """The characters of a class by the tables of the ``tokenizers`` library."""
    from tokenizers import Regex
    from tokenizers.pre_tokenizers import Split

    return frozenset("".join(x for x, _ in Split(Regex(_CLASSES[kind][0] + "+"), "removed", invert=True).pre_tokenize_str(every_character())))


def differing(of_library: Callable[[str], frozenset[str]]) -> dict[int, int]:
    """Characters that the ``regex`` module classes otherwise than a library, each to one that both class as the library does."""
    every, out = every_character(), {}
    for kind, (pattern, member) in _CLASSES.items():
        out |= {ord(c): ord(member) for c in of_library(kind).difference(regex.findall(pattern, every))}
    return out


@cache
def _differing() -> dict[int, int]:
    return differing(library_class)


def aligned(pattern: str, table: Callable[[], dict[int, int]]) -> Callable[[str], list[str]]:
    """``findall`` of the pattern by a library's classes: the text is split as if its differing characters were others of their class."""
    find = regex.compile(pattern).finditer

    def split(text: str) -> list[str]:
        seen = text.translate(table())
        return [text[m.start() : m.end()] for m in find(seen)]

    return split


def splitter(pattern: str, full: Callable[[str], list[str]] | None = None):
    """``findall`` of a pre-token pattern; texts within Latin-1 go to the faster ``re`` with spelled-out classes, others to ``full``."""
    import re

    full = full or regex.compile(pattern).findall
    latin = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{_LATIN['s']}{_LATIN['L']}{_LATIN['N']}]")
    for name in "LN":
        latin = latin.replace(rf"[\p{{{name}}}]", f"[{_LATIN[name]}]").replace(rf"\p{{{name}}}", f"[{_LATIN[name]}]")
    latin = latin.replace(r"\s", f"[{_LATIN['s']}]").replace(r"\S", f"[^{_LATIN['s']}]")
    if "\\p" in latin:
        return full
    quick = re.compile(latin).findall

    def split(text: str) -> list[str]:
        if not text.isascii():
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                return full(text)
        return quick(text)

    return split


@cache
def _kinds() -> np.ndarray:
    """The class of each character of the basic plane (lower-casing settled texts gives no others)."""
    every = "".join(chr(c) for c in range(0x10000) if not 0xD800 <= c < 0xE000)
    out = np.full(0x10000, OTHER, np.uint8)
    for kind, pattern in ((SPACE, r"\s"), (LETTER, r"\p{L}"), (NUMBER, r"\p{N}")):
        out[[ord(c) for c in regex.findall(pattern, every)]] = kind
    return out


def cut_words(texts: list[str]) -> tuple[pa.StringArray, np.ndarray]:
    """The matches of ``WORD_PATTERN`` in texts of the basic plane, in a row, and how many there are up to each text's end."""
    joined = "\n".join([*texts, "\n\n"])
    raw = np.frombuffer(joined.encode(), np.uint8)
    point = raw if joined.isascii() else np.frombuffer(joined.encode("utf-32-le"), "<u4")
    kind = _kinds()[point]
    first = np.empty(len(kind), bool)
    first[0] = True
    np.not_equal(kind[1:], kind[:-1], out=first[1:])
    first |= kind == NUMBER
    at = np.flatnonzero(point == ord("'"))
    at = at[first[at] & first[at + 1] & (kind[at + 1] == LETTER)]  # alone before a letter: perhaps a contraction
    a, b = point[at + 1], point[at + 2]
    one = at[np.isin(a, [ord(c) for c in "stmd"])]
    two = at[((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))]
    first[one + 1] = first[two + 1] = False
    first[one + 2] = first[two + 3] = True
    keep = kind != SPACE
    start = np.flatnonzero(first & keep)
    if point is raw:
        place = np.cumsum(keep, dtype=np.int32)[start] - 1
    else:
        width = 1 + (point > 0x7F).view(np.uint8) + (point > 0x7FF).view(np.uint8)
        place = np.cumsum(width * keep, dtype=np.int32)[start] - width[start]
        keep = np.repeat(keep, width)
    data = raw[keep]
    words = pa.StringArray.from_buffers(len(start), pa.py_buffer(np.append(place, len(data)).astype(np.int32)), pa.py_buffer(data))
    return words, np.searchsorted(start, np.cumsum([len(x) + 1 for x in texts]))


class _Cache(dict):
    """Pre-token -> value in two generations: when the young one is full it becomes the old one, from which words in use
    come back, so memory stays bounded and frequent words stay known."""

    def __init__(self, make, entries: int = CACHE_ENTRIES):
        super().__init__()
        self.make, self.entries, self.old = make, entries, {}

    def __missing__(self, word: str):
        value = self.old.get(word)
        if value is None:
            value = self.make(word)
        if len(word) <= LONGEST_CACHED:
            if len(self) >= self.entries:
                self.old = dict(self)
                self.clear()
            self[word] = value
        return value

    def values_of(self, words: list[str], make_all: Callable[[list[str]], list]) -> list:
        """The values of different words; ``make_all`` makes those of all unknown ones at once."""
        found = list(map(self.get, words))
        lost = [w for w, x in zip(words, found) if x is None]
        values = list(map(self.old.get, lost))
        if new := [w for w, x in zip(lost, values) if x is None]:
            made = iter(make_all(new))
            values = [next(made) if x is None else x for x in values]
        short = {w: x for w, x in zip(lost, values) if len(w) <= LONGEST_CACHED}
        if len(self) + len(short) > self.entries:
            self.old = dict(self)
            self.clear()
        self.update(islice(short.items(), self.entries))
        rest = iter(values)
        return [next(rest) if x is None else x for x in found]


def _byte_alphabet() -> dict[int, str]:
    """The library's letter for each byte, but a space stays one."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(0x100) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(0x100 + i) for i, b in enumerate(hidden)} | {0x20: " "}


class CachedEncoder:
    """``encode(text)`` gives the ids of ``Tokenizer.encode(text, add_special_tokens=False)``."""

    def __init__(self, path: str, entries: int = CACHE_ENTRIES):
        from tokenizers import Tokenizer

        import public_tokenizers

        spec = json.load(open(path, encoding="utf-8"))
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.cache = _Cache(self._word, entries)
        self.normalize, self.fits, self.words = self._plain, None, None
        before = spec["pre_tokenizer"] or {}
        kinds = [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])] if spec["normalizer"] else []
        if before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space") and not kinds:
            self.split = splitter(public_tokenizers.PATTERN, aligned(public_tokenizers.PATTERN, _differing))
        elif before.get("type") == "Sequence" and kinds == ["NFC", "Replace", "Lowercase"]:
            self.split = splitter(before["pretokenizers"][0]["pattern"]["Regex"])
            self.normalize, self.fits = self._lower, settled()
            self._prepare_words(spec, before)
        else:
            self.split = None  # another pipeline: the library does all

    def _prepare_words(self, spec: dict, before: dict) -> None:
        """``words``, the library's model behind a cut at spaces, and ``closing``, the ids that end a word, where the pipeline has both."""
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        vocab, suffix, steps = spec["model"]["vocab"], spec["model"].get("end_of_word_suffix"), before["pretokenizers"]
        cut = {"type": "Split", "pattern": {"Regex": WORD_PATTERN}, "behavior": "Removed", "invert": True}
        bytewise = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": False}
        self.alphabet = _byte_alphabet()
        letters = [c for b, c in self.alphabet.items() if b != 0x20]
        if len(steps) != 2 or steps[0] != cut or not bytewise.items() <= steps[1].items() or not suffix or not all(c in vocab and c + suffix in vocab for c in letters):
            return
        self.closing = np.zeros(max(vocab.values()) + 1, bool)
        self.closing[[i for token, i in vocab.items() if token.endswith(suffix)]] = True
        self.words = Tokenizer(self.tokenizer.model)
        self.words.pre_tokenizer = WhitespaceSplit()

    @staticmethod
    def _plain(text: str) -> str:
        return text

    @staticmethod
    def _lower(text: str) -> str:
        if not text.isascii():
            text = text.replace("Σ", "σ")  # character by character, as the library does: no final sigma
        return text.lower()

    def _word(self, word: str) -> bytes:
        if self.split is not None and word.isascii() and word.isprintable():
            # Letters of the byte alphabet already, but for the space: straight to the library's BPE model.
            found = [t.id for t in self.tokenizer.model.tokenize(word.replace(" ", "Ġ"))]
        else:
            found = self.tokenizer.encode(word, add_special_tokens=False).ids
        return np.array(found, self.dtype).tobytes()

    def _words(self, words: list[str]) -> list[bytes]:
        """The ids of pre-tokens, from one call: each ends with its only id that closes a word."""
        text = " ".join(words).encode().decode("latin-1").translate(self.alphabet)
        ids = np.array(self.words.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype)
        ends = ((np.flatnonzero(self.closing[ids]) + 1) * self.dtype.itemsize).tolist()
        if len(ends) != len(words):
            return list(map(self._word, words))
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip([0, *ends], ends)]

    def encode_batch(self, texts: list[str], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids in a row, ``end_id`` after each text's, and where each text ends."""
        if self.words is None:
            alone = range(len(texts))
        else:
            alone = [i for i, x in enumerate(texts) if "<|" in x or not x.isascii() and not self.fits(x)]
        own = {i: np.frombuffer(self.encode_bytes(texts[i]), self.dtype) for i in alone}
        if len(own) == len(texts):
            ids, ends = np.zeros(0, self.dtype), np.zeros(len(texts), np.int64)
        else:
            ids, ends = self._cut_and_look_up(["" if i in own else self.normalize(x) for i, x in enumerate(texts)])
        if own:
            begins = np.append(0, ends[:-1])
            parts = [own.get(i, ids[a:b]) for i, (a, b) in enumerate(zip(begins, ends))]
            ids, ends = np.concatenate(parts), np.cumsum([len(x) for x in parts])
        return np.insert(ids, ends, end_id), ends + np.arange(1, len(ends) + 1)

    def _cut_and_look_up(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        words, counts = cut_words(texts)
        words = words.dictionary_encode()
        values = self.cache.values_of(words.dictionary.to_numpy(zero_copy_only=False).tolist(), self._words)
        flat = np.frombuffer(b"".join(values), self.dtype)
        size = np.fromiter(map(len, values), np.int64, len(values)) // self.dtype.itemsize
        begin, code = np.cumsum(size) - size, words.indices.to_numpy()
        n = size[code]
        end = np.append(0, np.cumsum(n))
        return flat[np.repeat(begin[code] - end[:-1], n) + np.arange(end[-1])], end[counts]

    def encode_bytes(self, text: str) -> bytes:
        """The ids as little-endian numbers of ``dtype``."""
        if self.split is None or self.fits and not text.isascii() and not self.fits(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()
        if self.cut is not None and "<|" in text and len(parts := self.cut.split(text)) > 1:
            return b"".join(np.array([self.special[x]], self.dtype).tobytes() if i % 2 else self._segment(x) for i, x in enumerate(parts))
        return self._segment(text)

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(self.encode_bytes(text), self.dtype)

    def _segment(self, text: str) -> bytes:
        return b"".join(map(self.cache.__getitem__, self.split(self.normalize(text))))


def encoder(path: str, entries: int = CACHE_ENTRIES) -> CachedEncoder:
    """The Python worker's encoder for a file and cache bound."""
    return resident(("encoder", path, entries), lambda: CachedEncoder(path, entries))
