"""Token counts, ids, byte BPE and packing against the public libraries."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from tallyline.llm import byte_bpe, packing, token_counts, token_ids  # noqa: E402
from tallyline.llm.common import scratch_path  # noqa: E402
from tallyline.llm.encoders import CachedEncoder  # noqa: E402

BPE, WORD, RANKS = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json", "byte_bpe_multi_50k.tiktoken"))
random.seed(7)
LETTERS = "abstrvelmd''  \n\t1é.,日<|>ª  ΣΑİÅ"
TEXTS = [
    None, "", " ", "\n", "a  ", "don't I'll 'll 've''s '''s 'r 're 'v 'l 'lll '", "x\n\n y", "<|endoftext|>a<|endoftext|> b", "é" * 50, "a" * 3000, "日本語テキスト 12345 ½²", "'" * 20 + "s",
    "\x1c a\x85b\xa0 c", "ΑΣ ΟΔΟΣ", "İstanbul", "Ġhello Ġ", "same text", "same text", "word. " * 3000, "x" * 20_000,
    *("".join(random.choice(LETTERS) for _ in range(random.randint(0, 80))) for _ in range(300)),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "clash", 1) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, start int")


def library(path):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def test_cached_encoders_equal_the_library():
    for path in (BPE, WORD):
        e, t = CachedEncoder(path), library(path)
        for text in TEXTS:
            assert e.encode(text or "").tolist() == t.encode(text or "", add_special_tokens=False).ids


def test_every_character_and_random_sequences():
    """All code points in some contexts, and sequences of characters that combine, reorder or are newly assigned."""
    import tiktoken

    rng = random.Random(9)
    points = [c for c in range(1, 0x32000, 3) if not 0xD800 <= c < 0xE000] + [0x558, 0x2EAB, 0x208F, 0x962, 0x58C, 0x2A61, 0xEC8, 0xD3C, 0x10EE7, 0x2CEA7, 0xE0001, 0x10FFFF]
    texts = [f"a{chr(c)}b 1{chr(c)}2 {chr(c)}{chr(c)}' {chr(c)}" for c in points]
    odd = [chr(c) for c in (*range(0x300, 0x330), 0xEC8, 0xD3C, 0x1100, 0x1161, 0x11A8, 0x3099, 0x958, 0x9BE, 0x2126, 0x130, 0x345, 0x1F80, 0x558, 0x2EAB, 0x10EE7, 0x20, 0xA0, 0x85)] + list("aÉΣs'1.")
    texts += ["".join(rng.choice(odd) for _ in range(12)) for _ in range(3000)] + ["".join(chr(rng.choice(points)) for _ in range(12)) for _ in range(3000)]
    for path in (BPE, WORD):
        e, want = CachedEncoder(path, 2000), library(path).encode_batch_fast(texts, add_special_tokens=False)
        assert [x for x, w in zip(texts, want) if e.encode(x).tolist() != w.ids] == []
        if path == BPE:
            assert token_counts.TokenCounter(BPE).counts(texts).tolist() == [len(w.ids) for w in want]
    c = byte_bpe.ByteBPE(RANKS, public_tokenizers.PATTERN)
    k = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=c.ranks, special_tokens={})
    assert [x for x in texts if c.encode(x) != k.encode_ordinary(x)] == []


def test_batches_of_texts_equal_the_library():
    """Many texts at once: contractions, digits, white space, texts that go to the library whole, full caches."""
    rng = random.Random(11)
    odd = "strevlmda''''  \t1é!.ßΣ’日\x1c\x85\xa0"
    texts = [x or "" for x in TEXTS] + ["".join(rng.choice(odd) for _ in range(rng.randint(0, 40))) for _ in range(4000)]
    texts += ["a'", "'", "x're've'd1'll'l 'lls 's's", "𝒜b 'S", " á b", "a<|endoftext|>'s <|", "</w> a</w>", ""]
    for path, sizes in ((WORD, (50, 2000, 100_000)), (BPE, (2000,))):
        want = [[*x.ids, 1] for x in library(path).encode_batch_fast(texts, add_special_tokens=False)]
        for entries in sizes:
            e = CachedEncoder(path, entries)
            for k in (1, 7, len(texts)):
                for at in range(0, len(texts) if k > 1 else 400, k):
                    ids, ends = e.encode_batch(texts[at : at + k], 1)
                    assert [x.tolist() for x in np.split(ids, ends[:-1])] == want[at : at + k] and ends[-1] == len(ids)
                    assert len(e.cache) <= entries and len(e.cache.old) <= entries


def test_packing_looks_each_word_up_once_a_slice(monkeypatch):
    """Not once for each occurrence; the library gets unknown words in one call."""
    e, looked, made = CachedEncoder(WORD), [], []
    values, words = e.cache.values_of, e._words
    monkeypatch.setattr(e.cache, "values_of", lambda x, make: looked.append(x) or values(x, make))
    monkeypatch.setattr(e, "_words", lambda x: made.append(x) or words(x))
    monkeypatch.setattr(e, "_word", None)
    text = "The cat's 12 hats, the cat.\n" * 500
    for _ in range(2):
        ids, ends = e.encode_batch([text, "", "the é"], 1)
        assert ids[: ends[0] - 1].tolist() == library(WORD).encode(text, add_special_tokens=False).ids
    assert [sorted(x) for x in looked] == [sorted(["the", "cat", "'s", "1", "2", "hats", ",", ".", "é"])] * 2 and [len(x) for x in made] == [9]


def test_token_counts(spark, docs):
    t = library(BPE)
    got = {r["doc_id"]: r for r in token_counts.token_report(docs, BPE).collect()}
    for i, text in enumerate(TEXTS):
        n = len(t.encode(text or "", add_special_tokens=False).ids)
        assert (got[i]["n_tokens"], got[i]["n_bytes"], got[i]["over_limit"]) == (n, len((text or "").encode()), n > 1024)
    assert token_counts.count_tokens(docs, BPE).columns[-1] == "n_tokens_"
    assert token_counts.count_tokens(docs.limit(0), BPE).count() == 0


def test_chunk_maps_compose():
    text = "".join(random.choice(LETTERS) for _ in range(5000)) + "a" * 3000
    classes = token_counts.character_classes()[np.frombuffer((text + "\0").encode("utf-32-le"), np.uint32)].copy()
    classes[-1] = token_counts.END
    whole = token_counts.boundaries(classes, 1 << 14)
    for chunk in (16, 48, 512):
        assert (token_counts.boundaries(classes, chunk) == whole).all()


def test_bounded_transducer_states():
    small, large = token_counts.Merger(BPE, states=50), token_counts.Merger(BPE)
    for w in ("thering" * 30, "aaaaaaa", "é" * 40, " international"):
        assert small.count(w.encode()) == large.count(w.encode())


def test_token_id_files(spark, docs):
    path = scratch_path(spark, "test-ids")
    token_ids.write_token_ids(docs, path, BPE, end_id=2)
    t, start = library(BPE), 0
    rows = token_ids.read_token_ids(spark, path).orderBy("start").collect()
    assert [r["doc_id"] for r in rows] == list(range(len(TEXTS)))
    for r in rows:
        ids = [*t.encode(TEXTS[r["doc_id"]] or "", add_special_tokens=False).ids, 2]
        assert (r["ids"], r["start"], r["n_tokens"], r["ids_crc32"]) == (ids, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert token_ids.read_document(spark, path, 5) == [rows[5]["ids"]] and token_ids.read_document(spark, path, -1) == []
    empty = scratch_path(spark, "test-ids")
    token_ids.write_token_ids(docs.limit(0), empty, BPE, end_id=2)
    assert token_ids.read_token_ids(spark, empty).count() == 0
    odd = spark.createDataFrame([(None, "a"), (3, "b"), (3, "b"), (None, None)], "doc_id long, text string")
    again = scratch_path(spark, "test-ids")
    token_ids.write_token_ids(odd, again, BPE, end_id=2)
    assert [r["doc_id"] for r in token_ids.read_token_ids(spark, again).orderBy("start").collect()] == [None, None, 3, 3]


def test_damage_is_found():
    d = b"\0" * 8
    payload = token_ids.pack_segment(hashlib.sha256(d).digest(), 2, [(1, 1, token_ids._codec(d)[0].compress(b"\1\0"))])
    assert token_ids.Segment(payload, d)[0].tolist() == [1]
    with pytest.raises(ValueError):
        token_ids.Segment(payload, b"another!")


def test_byte_bpe(spark, docs):
    import tiktoken

    c = byte_bpe.ByteBPE(RANKS, public_tokenizers.PATTERN)
    e = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=c.ranks, special_tokens={})
    got = {r["doc_id"]: r for r in byte_bpe.encode_documents(docs, RANKS, public_tokenizers.PATTERN, with_ids=True).collect()}
    for i, text in enumerate(TEXTS):
        ids = e.encode_ordinary(text or "")
        assert got[i]["ids"] == ids and got[i]["n_tokens"] == len(ids) and c.decode(ids) == (text or "").encode()
        assert got[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()
    for _ in range(200):
        word = bytes(random.choice(b"abtheing ") for _ in range(random.randint(1, 200)))
        assert c.merge(word) == e._encode_single_piece(word)


def brute_cuts(ends, prices, length):
    best = {0: 0.0}
    for e, p in zip(ends, prices):
        options = []
        for i, b in best.items():
            n = e - i
            if 0 < n <= length:
                pad = 0 if n in (length, length >> 1, length >> 2, length >> 3) else length - n
                options.append(b + pad + p + packing.SEQUENCE_COST)
        best[e] = min(options)
    return best[ends[-1]]


def test_cuts_are_optimal():
    for _ in range(60):
        length = 16
        ends, prices, at = [], [], 0
        for _ in range(40):
            at += random.randint(1, 8)
            ends.append(at)
            prices.append(random.choice([0.0, 1.0, 3.0]))
        cuts = packing.choose_cuts(ends, prices, length, True)
        price, cost, last = dict(zip(ends, prices)), 0.0, 0
        for c in cuts:
            n = c - last
            assert 0 < n <= length
            cost += (0 if n in (16, 8, 4, 2) else length - n) + price[c] + packing.SEQUENCE_COST
            last = c
        assert last == ends[-1] and abs(cost - brute_cuts(ends, prices, length)) < 1e-9


def test_packing(spark, docs):
    rows = packing.pack(docs.repartition(3), WORD, end_id=1, length=256).collect()
    t, by_doc, by_sequence = library(WORD), defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    assert sorted(by_doc) == list(range(len(TEXTS)))
    for i, parts in by_doc.items():
        ids, at = np.array([*t.encode(TEXTS[i] or "", add_special_tokens=False).ids, 1], "<u4"), 0
        for r in sorted(parts, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    padding = 0
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert 0 < at <= 256
        padding += 0 if at & (at - 1) == 0 else 256 - at
    assert padding <= 3 * 256 + 0.01 * sum(r["length"] for r in rows)
    assert packing.pack(docs.limit(0), WORD, end_id=1).count() == 0
