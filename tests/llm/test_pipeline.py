"""The corpus pipeline and the registered queries on the smallest tables, each against a plain version or a library."""

import hashlib
import sys
import zlib
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest

import corpus_pipeline
from tallyline.llm import queries, quality_rules

sys.path.insert(0, str(Path(__file__).resolve().parent))
import brute  # noqa: E402

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test data")


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


def stage_by_hand(name, spark, rows):
    """Ids that the stage keeps of ``rows`` (doc_id, text, lang)."""
    if name == "quality rules":
        rules = quality_rules.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.read.parquet(f"{SF}/labels.parquet"))
        return {i for i, t, _ in rows if brute.kept(t, rules)}
    if name == "language ID":
        found = brute.languages([(t, lang) for _, t, lang in rows if lang is not None], [t for _, t, _ in rows])
        return {i for (i, _, _), (lang, score) in zip(rows, found) if lang != "und" and score >= corpus_pipeline.LEAST_SCORE}
    if name == "exact dedup":
        first = {}
        for i, t, _ in sorted(rows):
            first.setdefault(brute.normalised(t), i)
        return set(first.values())
    classes = brute.near_classes([(i, t) for i, t, _ in rows])
    return set(classes.values())


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality rules", "language ID", "exact dedup", "near dedup", "packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = [(r["doc_id"], r["text"], r["lang"]) for r in docs.collect()]
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        docs = corpus_pipeline.materialize(out, "test-stage")
        assert {r["doc_id"] for r in docs.select("doc_id").collect()} == stage_by_hand(name, spark, rows)
        assert 0 < docs.count() <= len(rows)
    packed(corpus_pipeline.pack(spark, docs, SF).collect(), {r["doc_id"]: r["text"] for r in docs.collect()})


def library(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer(name))


def packed(rows, texts):
    t, by_doc, by_sequence = library("word_bpe_49k.json"), defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    assert by_doc.keys() == texts.keys()
    for i, parts in by_doc.items():
        ids, at = np.array([*t.encode(texts[i] or "", add_special_tokens=False).ids, queries.WORD_END], "<u4"), 0
        for r in sorted(parts, key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(ids[at : at + r["length"]].tobytes()))
            at += r["length"]
        assert at == len(ids)
    for parts in by_sequence.values():
        ends = sorted((r["offset"], r["length"]) for r in parts)
        assert [o for o, _ in ends] == [sum(n for _, n in ends[:i]) for i in range(len(ends))] and sum(n for _, n in ends) <= queries.SEQUENCE


def test_token_queries(spark, texts):
    t = library("byte_bpe_50k.json")
    ids = {i: t.encode(x or "", add_special_tokens=False).ids for i, x in texts.items()}
    for r in queries.op3_token_counts(spark, SF).collect():
        n = len(ids[r["doc_id"]])
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len((texts[r["doc_id"]] or "").encode()), n, n > 1024)
    start, rows = 0, queries.op5_token_ids(spark, SF).orderBy("doc_id").collect()
    assert [r["doc_id"] for r in rows] == sorted(texts)
    for r in rows:
        own = np.array([*ids[r["doc_id"]], queries.BPE_END], "<u4")
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(own), zlib.crc32(own.tobytes()))
        start += len(own)
    packed(queries.op6_packing(spark, SF).collect(), texts)


def test_byte_bpe_query(spark, texts):
    import public_tokenizers
    import tiktoken

    from tallyline.llm.byte_bpe import ByteBPE

    ranks = ByteBPE(queries.tokenizer("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN).ranks
    e = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    sha = lambda b: hashlib.sha256(b).hexdigest()
    for r in queries.op8_byte_bpe(spark, SF).collect():
        ids = e.encode_ordinary(texts[r["doc_id"]] or "")
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(",".join(map(str, ids)).encode()), sha((texts[r["doc_id"]] or "").encode()))


def test_learned_queries(spark, texts):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()
    lang = {r["doc_id"]: r["lang"] for r in docs}
    held = {i for i in texts if zlib.crc32(str(i).encode()) % 4 == 2}
    found = {r["doc_id"]: r for r in queries.op2_language_id(spark, SF).collect()}
    assert found.keys() == texts.keys() and {i for i, r in found.items() if r["held_out"]} == held
    known = [i for i in held if lang[i] is not None and any(c.isalpha() for c in texts[i] or "")]
    assert sum(found[i]["lang_pred"] == lang[i] for i in known) >= 0.97 * len(known)
    rules = quality_rules.train(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    for r in queries.op4_quality_rules(spark, SF).collect():
        base, _ = brute.statistics(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == base
        assert r["base_failed"] == (base[0] < 50 or 100 * base[4] > 50 * base[0]) and r["kept"] == brute.kept(texts[r["doc_id"]], rules)


def test_near_query(spark, texts):
    classes = brute.near_classes(list(texts.items()))
    assert {r["doc_id"]: r["class_id"] for r in queries.op10_near_dedup(spark, SF).collect()} == classes


def test_empty_documents_pass_through(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, corpus_pipeline.materialize(docs, "test-empty"), SF).count() == 0


def messy(spark):
    """Real documents with nulls in every column, an empty and a very long text, ties, repeated rows, and columns whose names the stages use themselves."""
    real = [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    long = next(t for _, t, lang, _, _ in real if lang == "en" and len(t or "") > 2000)
    rows = real[:120] + real[:40] + [(9001, None, "en", None, None), (9002, "", None, "x", 0), (9003, (long + "\n") * 60, "en", None, 5), (None, long, "en", None, None), (None, real[3][1], None, None, None), (9004, long, None, None, None)]
    rows = [(*r, i % 7 or None, i % 2 == 0, 0.5, "t") for i, r in enumerate(rows)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, rid long, kept boolean, score double, label string"
    return corpus_pipeline.materialize(spark.createDataFrame(rows, schema).repartition(5), "test-messy"), rows


def test_stages_on_messy_documents(spark):
    docs, rows = messy(spark)
    stages = dict(corpus_pipeline.STAGES)
    key = lambda r: tuple(map(str, r))
    out = {name: sorted(map(tuple, stages[name](spark, docs, SF).collect()), key=key) for name in list(stages)[:-1]}
    rules = quality_rules.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    assert out["quality rules"] == sorted((r for r in rows if brute.kept(r[1], rules)), key=key)
    found = brute.languages([(t, lang) for _, t, lang, *_ in rows if lang is not None], [r[1] for r in rows])
    assert out["language ID"] == sorted((r for r, (lang, score) in zip(rows, found) if lang != "und" and score >= corpus_pipeline.LEAST_SCORE), key=key)
    groups = defaultdict(list)
    for r in rows:
        groups[brute.normalised(r[1])].append(r)
    first = lambda g: min((r[0] is None, r[0] or 0) for r in g)
    assert len(out["exact dedup"]) == len(groups)
    assert {brute.normalised(r[1]): (r[0] is None, r[0] or 0) for r in out["exact dedup"]} == {t: first(g) for t, g in groups.items()}
    classes = brute.near_classes([(i, r[1]) for i, r in enumerate(rows)])
    assert len(out["near dedup"]) == len(set(classes.values()))
    lowest = {c: min((r[0] is None, r[0] or 0) for i, r in enumerate(rows) if classes[i] == c) for c in set(classes.values())}
    assert sorted((r[0] is None, r[0] or 0) for r in out["near dedup"]) == sorted(lowest.values())
    pieces, t = corpus_pipeline.pack(spark, docs, SF).collect(), library("word_bpe_49k.json")
    assert sum(p["length"] for p in pieces) == sum(len(t.encode(r[1] or "", add_special_tokens=False).ids) + 1 for r in rows)
    assert {p["doc_id"] for p in pieces} == {r[0] for r in rows}
    by_sequence = defaultdict(list)
    for p in pieces:
        by_sequence[p["sequence_id"]].append((p["offset"], p["length"]))
    for parts in by_sequence.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:i]) for i in range(len(parts))] and sum(n for _, n in parts) <= queries.SEQUENCE


def test_model_queries(spark, texts):
    import test_models

    rows = {r["doc_id"]: tuple(r) for r in queries.op13_lm_score(spark, SF).collect()}
    from tallyline.llm import lm_score

    for want in test_models.plain_scores(list(texts.items()), lm_score.ORDER, lm_score.PRIOR):
        got = rows[want[0]]
        assert got[:5] == want[:5] and np.allclose(got[5:], want[5:], rtol=1e-9)


def test_oracles(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    for name, sql in queries.oracle_sql().items():
        got = queries.queries()[name](spark, SF)
        want = con.execute(sql)
        columns = [c[0] for c in want.description]
        assert sorted(columns) == sorted(got.columns)
        assert sorted(map(str, map(tuple, got.select(columns).collect()))) == sorted(map(str, want.fetchall()))
