"""Clustering, filter audit and language-model scoring against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest

from tallyline.llm import clustering, filter_audit, lm_score


def lloyd(rows, k=8, rounds=10, dims=64):
    """Plain integer k-means over (id, vector)."""
    kept = []
    for i, v in rows:
        if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [math.floor(1024 * x) for x in v]))
    name = lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    centroids = [list(v) for _, v in sorted(kept, key=name)[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda v: min(range(len(centroids)), key=lambda c: (far(v, centroids[c]), c))
    for _ in range(rounds):
        members = defaultdict(list)
        for _, v in kept:
            members[nearest(v)].append(v)
        for c, vs in members.items():
            centroids[c] = [sum(x) // len(vs) for x in zip(*vs)]
    found = [(i, c := nearest(v), far(v, centroids[c])) for i, v in kept]
    inertia = Counter()
    for _, c, d in found:
        inertia[c] += d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted((i is None, i or 0, c, d, inertia[c], sum(inertia.values()), digest[c]) for i, c, d in found)


def clustered(spark, rows, **more):
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, cluster string")
    got = clustering.cluster(df, **more)
    return sorted((r[0] is None, r[0] or 0, *r[1:6]) for r in got.collect()), got


def test_clustering(spark):
    """Groups, ties, copies of a third of the rows, unusable vectors, null and repeated ids; all against the plain version."""
    rng = np.random.default_rng(4)
    centres = rng.normal(0, 0.3, (10, 64))
    rows = [(i, (centres[i % 10] + rng.normal(0, 0.05 + 0.2 * (i % 3 == 0), 64)).astype(np.float32).tolist()) for i in range(240)]
    rows += [(1000 + i, rows[7][1]) for i in range(120)]
    rows += [(5, rows[5][1]), (5, rows[6][1]), (None, rows[8][1])]
    bad = [None, [], [0.1] * 63, [0.1] * 65, [0.1] * 63 + [None], [0.1] * 63 + [math.nan], [0.1] * 63 + [math.inf]]
    rows += [(2000 + i, v) for i, v in enumerate(bad)]
    got, df = clustered(spark, rows)
    assert got == lloyd(rows)
    # The bounds settle most vectors without a scan.
    assert sum(r["scans"] for r in df.collect()) < 0.6 * 11 * len(got)
    ties = [(i, [float(x)] * 64) for i, x in enumerate([0, 1, 2, 1, 0, 2, 1, 1, 3, 1])]
    assert clustered(spark, ties, k=3)[0] == lloyd(ties, k=3)
    for few in (rows[:3], rows[:1]):
        assert clustered(spark, few)[0] == lloyd(few)
    assert clustered(spark, [])[0] == [] and clustered(spark, [(1, None)])[0] == []
    with pytest.raises(ValueError):
        clustered(spark, [(1, [1e6] * 64)])


def test_bounds_are_safe():
    """No vector that the bounds settle would be assigned otherwise, and ties are scanned."""
    rng = np.random.default_rng(8)
    v = rng.integers(-40, 40, (3000, 6))
    centroids = v[:5].copy()
    step = clustering.Round(centroids, None)
    state = step(v, np.full(len(v), -1, np.int32), np.zeros(len(v)), np.zeros(len(v)))
    for _ in range(12):
        moved = centroids + rng.integers(-2, 3, centroids.shape)
        step = clustering.Round(moved, centroids)
        state = step(v, *state[:3])
        best, own, second = clustering.nearest(v, moved)
        assert (state[0] == best).all() and (state[1] ** 2 >= own * 0.999999).all() and (np.maximum(state[2], 0) ** 2 <= second * 1.000001).all()
        centroids = moved
    assert 0 < state[3].sum() < len(v)


def audited(docs, labels):
    """Plain counts of every order."""
    first = {}
    for i, text, _ in docs:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    rows = []
    for i, text, lang in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
            "D": bool(re.search(r"[#$%&*|]", text)), "E": i is not None and text in first and first[text] < i,
        }
        rows.append((lang or "", {f for f in fails if fails[f]}, i in good, i in toxic))
    out = {}
    for part in {r[0] for r in rows}:
        shapley = Counter()
        for order in permutations("ABCDE"):
            left = [r for r in rows if r[0] == part]
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                all_of = [r for r in rows if r[0] == part and f in r[1]]
                shapley[f] += len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), len(all_of) - len(gone), sum(r[1] == {f} for r in all_of), sum(r[2] for r in gone), sum(r[3] for r in gone)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return out


def test_filter_audit(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))
    texts = [None, "", " \t\n", "ONE TWO", "a b\x0bc\x1cd e", "é" * 300, "x " * 50_000]
    texts += [" ".join(word() for _ in range(rng.choice([150, 199, 200, 201, 260]))) for _ in range(40)]
    texts += [" ".join(rng.choice(["aa", "bb", "CC", "#d"]) for _ in range(rng.choice([100, 300]))) for _ in range(30)]
    texts += [t + " & more" for t in texts[10:20] if t] + [(t or "").upper() for t in texts[20:30]]
    docs = [(i, t, rng.choice(["en", "de", None, ""])) for i, t in enumerate(texts)]
    docs += [(500 + i, texts[9], "en") for i in range(60)] + [(3, "ONE TWO", "en"), (3, texts[9], "en"), (None, texts[9], "en"), (None, None, None)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 560, 2)] + [(500, 1, 0), (500, 0, 1), (None, 1, 1)]
    made = lambda rows: spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, lang string, part string, fails long")
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = filter_audit.audit(made(docs), known).collect()
    want = audited(docs, labels)
    assert {(r["part"], r["filter_order"], r["step"]): list(r[3:]) for r in got} == want and len(got) == 600 * 3
    assert filter_audit.audit(made(docs).limit(0), known).count() == 0
    alone = filter_audit.audit(made(docs[:2]), known.limit(0)).collect()
    assert {(r["part"], r["filter_order"], r["step"]): list(r[3:]) for r in alone} == audited(docs[:2], [])


def plain_scores(docs, order, prior):
    """Scores by the recursive definition, for (id, text)."""
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    split = lambda t: re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode())) + [None]
    counts = Counter()
    for i, t in docs:
        if not out(i):
            tokens = ["start", *split(t)]
            for at in range(len(tokens)):
                for k in range(1, order + 1):
                    if at - k + 1 >= 0:
                        counts[tuple(tokens[at - k + 1 : at + 1])] += 1
    words = {g[0]: n for g, n in counts.items() if len(g) == 1 and g[0] != "start"}
    total = sum(words.values())

    def p(history, w):
        if not history:
            return (words.get(w, 0) + 1) / (total + len(words) + 1)
        return (counts[(*history, w)] + prior * p(history[1:], w)) / (counts[tuple(history)] + prior)

    found = []
    for i, t in docs:
        tokens = ["start", *split(t)]
        score = sum(math.log10(p(tuple(tokens[max(0, at - order + 1) : at]), tokens[at])) for at in range(1, len(tokens)))
        base = sum(math.log10((words.get(w, 0) + 1) / (total + len(words) + 1)) for w in tokens[1:])
        found.append((i, out(i), len(tokens) - 1, sum(w in words for w in tokens[1:]), total, base, score))
    return found


@pytest.mark.parametrize("order", [1, 2, 3])
def test_lm_score(spark, order, monkeypatch):
    rng = random.Random(order)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(3)) for _ in range(60)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 60))) for _ in range(80)]
    texts += [None, "", " \n", "AbC abc ABC", "É é", "a\x0bb\x1cc", "the " * 3000, " ".join(rng.choice(vocabulary) for _ in range(9000))] + [texts[3]] * 40
    docs = list(enumerate(texts)) + [(7, texts[8]), (7, texts[8]), (None, texts[1])]
    monkeypatch.setattr(lm_score, "SHARD_BYTES", 20_000)  # some shards
    df = spark.createDataFrame([(i, t, 1.0, "n") for i, t in docs], "doc_id long, text string, score double, held_out string").repartition(5)
    got = lm_score.lm_score(df, order=order, prior=3.0).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[6])
    want = sorted(plain_scores(docs, order, 3.0), key=key)
    got = sorted(map(tuple, got), key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5:] for r in got], [r[5:] for r in want], rtol=1e-9)


def test_lm_blocks_and_empty(spark):
    """Blocks of a few texts each give what one block gives; without training texts all words are unknown."""
    texts = [f"w{i % 7} w{i % 5} W{i % 3} x" for i in range(200)]
    batch = lambda a, b: __import__("pyarrow").RecordBatch.from_pydict({"doc_id": list(range(a, b)), "held_out": [False] * (b - a), "text": texts[a:b]})
    cut = list(lm_score._blocks(iter([batch(0, 150), batch(150, 200)]), 2))
    assert [x for b in cut for x in b.column(2).to_pylist()] == texts
    df = spark.createDataFrame([(2, "b a"), (9, None)], "doc_id long, text string")
    assert lm_score.lm_score(df.limit(0)).count() == 0
    rows = lm_score.lm_score(df, out=df["doc_id"] > 0).collect()
    assert [(r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in rows] == [(0, 0, 0.0, 0.0)] * 2


def test_lm_beats_the_base_on_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [r for r in lm_score.lm_score(docs).collect() if r["held_out"]]
    assert len(rows) > 100 and sum(r["score"] for r in rows) > 0.93 * sum(r["base_score"] for r in rows)
