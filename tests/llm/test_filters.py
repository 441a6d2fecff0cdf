"""URL filters, language ID and quality rules against brute force and held-out labels."""

import random
import sys
from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

from tallyline.llm import language_id, quality_rules, url_filters

sys.path.insert(0, str(Path(__file__).resolve().parent))
import brute  # noqa: E402

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"), ("a.b.net", "/en/x", "block"), ("b.net", "", "allow"), ("net", "/", "allow")]
URLS = [
    None, "", "no-scheme.net/x", "http://", "http://A.Example.NET/en/1?q=/de/", "https://example.net/en", "https://example.net", "http://x.a.b.net/en/xy", "http://a.b.net/en/y#f", "http://b.net?x", "http://badexample.com/de/1",
    "http://x.example.com/de/1", "http://example.com:80/de/1", "http://a.org/fr/", "http://u@a.org/fr/z", "x://y://z.net/", "http://net/", "http://ümlaut.org/fr/é", "http://" + "a." * 3000 + "net/" + "/p" * 3000, "http://a.org/fr/\nx",
]


def judge(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    at = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, rest = "".join(c.lower() if c.isascii() else c for c in rest[:at]), rest[at:]
    path = rest[: min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
    fits = [r for r in RULES[:6] if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    best = max(fits, key=lambda r: (len(r[0] + r[1]), len(r[0])), default=None)
    return host, path, best and best[0] + best[1], best[2] if best else "allow"


def test_url_filter(spark, monkeypatch):
    rows = [(i, u, "x") for i, u in enumerate(URLS)] + [(4, URLS[4], "y"), (None, URLS[4], "z")]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    for bound in (100, 0):
        got = sorted(map(tuple, url_filters.url_filter(pages, rules, broadcast_rules=bound).collect()), key=str)
        assert got == sorted(((i, *judge(u)) for i, u, _ in rows), key=str)
    monkeypatch.setattr(url_filters, "MAX_SHAPES", 2)
    got = sorted(map(tuple, url_filters.url_filter(pages, rules).collect()), key=str)
    assert got == sorted(((i, *judge(u)) for i, u, _ in rows), key=str)
    monkeypatch.undo()
    assert url_filters.url_filter(pages.limit(0), rules).count() == 0
    assert {r["verdict"] for r in url_filters.url_filter(pages, rules.limit(0)).collect()} == {"allow"}


VOCABULARY = {"aa": ["der", "und", "nicht", "schön"], "bb": ["the", "and", "not", "nice"], "cc": ["le", "et", "pas", "joli"]}


def test_language_id(spark):
    random.seed(1)
    rows = [(i, " ".join(random.choices(VOCABULARY[lang], k=30)), lang, "x") for i, lang in enumerate(random.choices(list(VOCABULARY), k=400))]
    docs = spark.createDataFrame([*rows, (900, None, "aa", "x"), (901, "", None, "x"), (902, "123 !!", "bb", "x"), (903, "schönheit", None, "x")], "doc_id long, text string, lang string, score string")
    out = language_id.held_out(F.col("doc_id"))
    model = language_id.train(docs.where(~out), max_docs=60)
    assert model.languages == ("aa", "bb", "cc")
    found = {r["doc_id"]: r for r in language_id.predict(docs, model).collect()}
    assert all(found[i]["lang_pred"] == lang and 0 <= found[i]["score_"] <= 1 for i, _, lang, _ in rows)
    assert [found[i]["lang_pred"] for i in (900, 901, 902)] == ["und"] * 3
    assert found[903]["lang_pred"] == "aa"  # an unseen word: by its n-grams
    empty = language_id.train(docs.limit(0))
    assert language_id.predict(docs.limit(3), empty).first()["lang_pred"] == "und"


def test_language_scores_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    docs = docs.unionByName(spark.createDataFrame([(-1, "x" * 300 + " der " * 40_000, None), (-2, "", "xx"), (-3, None, None)], docs.schema))
    rows, out = docs.collect(), language_id.held_out(F.col("doc_id"))
    held = {r["doc_id"] for r in docs.where(out).collect()}
    model = language_id.train(docs.where(~out), max_words=10**6, max_grams=10**6)
    got = {r["doc_id"]: r for r in language_id.predict(docs, model).collect()}
    want = brute.languages([(r["text"], r["lang"]) for r in rows if r["lang"] is not None and r["doc_id"] not in held], [r["text"] for r in rows])
    right = 0
    for r, (lang, score) in zip(rows, want):
        assert got[r["doc_id"]]["lang_pred"] == lang and abs(got[r["doc_id"]]["score"] - score) < 1e-3
        right += r["doc_id"] in held and r["lang"] == lang
    assert right >= 0.97 * sum(r["doc_id"] in held and r["lang"] is not None for r in rows)


def test_vocabulary_bound(spark):
    rows = [("aa", w, k) for k, w in enumerate(["eins", "zwei", "drei", "vier"])] + [("bb", w, k) for k, w in enumerate(["un", "deux"])]
    docs = spark.createDataFrame([(i, " ".join([w] * (k + 2)), lang) for i, (lang, w, k) in enumerate(rows)], "doc_id long, text string, lang string")
    model = language_id.train(docs, max_words=2, max_grams=1000)
    assert model.words == ["deux", "drei", "un", "vier"] and model.languages == ("aa", "bb")


def test_word_cache_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(language_id, "CACHED_WORDS", 64)
    model = language_id.LanguageModel(("x", "y"), ["w"], np.array([[0.0, -1.0]]), ["a"], np.array([[-1.0, 0.0]]))
    scores = language_id._Scores(model)
    assert np.allclose(scores.total([f"a{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(500)] + ["w"]), [-500.0, -1.0])


def test_statistics():
    random.seed(3)
    cases = ["", " \n ", "a b c a b c", "a a a a", "x\ny\nx\n \n x", "#|<>\x1c\x85é", "one two"] + ["".join(random.choice("ab c\n\t#é\x1f") for _ in range(120)) for _ in range(200)]
    for text in cases:
        assert quality_rules.statistics_of(text)[:5] == brute.statistics(text)[0]


def test_quality_rules(spark):
    random.seed(5)
    words = ["alpha", "beta", "gamma", "delta", "omega", "sigma"]
    good = [" ".join(random.choice(words) + random.choice(words) for _ in range(80)) for _ in range(300)]
    bad = [" ".join(random.choice(words) + random.choice(words) + "%%%" for _ in range(80)) for _ in range(150)]
    rows = [(i, t, "c") for i, t in enumerate(good + bad)]
    docs = spark.createDataFrame([*rows, (9000, None, "c"), (9001, "short", "c"), (9002, "alpha beta %%% gamma " * 200_000, "c"), (0, good[0], "c")], "doc_id long, text string, kept string")
    labels = spark.createDataFrame([(i, int(i < 300), 0) for i in range(450)] + [(None, 1, 0), (3, None, 0), (5, 1, 0), (7, 0, 0)], "doc_id long, quality int, toxic int")
    rules = quality_rules.train(docs, labels)
    assert 1 <= len(rules.rules) <= 3
    judged, names = quality_rules.judge(docs, rules)
    kept = {r["doc_id"]: r[names["kept"]] for r in judged.collect()}
    assert names["kept"] == "kept_" and judged.count() == docs.count()
    assert all(kept[i] == (i < 300) for i in range(450)) and not kept[9000] and not kept[9001] and not kept[9002]
    assert quality_rules.train(docs, labels.limit(0)).rules == ()
    assert quality_rules.judge(docs.limit(0), rules)[0].count() == 0


def test_learning_ignores_noise():
    rng = np.random.default_rng(0)
    x = rng.random((3000, len(quality_rules.FEATURES)))
    assert quality_rules.learn(x, rng.random(3000) < 0.1).rules == ()
    bad = (x[:, 2] > 0.8) & (x[:, 3] < 0.5)
    rules = quality_rules.learn(x, bad).rules
    assert rules and {f for f, _, _ in rules[0].tests} == {list(quality_rules.FEATURES)[2], list(quality_rules.FEATURES)[3]}
