"""Plain versions of the operators, without Spark: what tests compare with."""

import itertools
import re
from collections import Counter, defaultdict

import numpy as np

from tallyline.llm import language_id, near_dedup, quality_rules


def normalised(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def statistics(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and what else rules test, by the letter of their definitions."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    letters = sum(c.isalpha() for c in text)
    n, chars = len(words), sum(map(len, words))
    share = lambda a, b: a / b if b else 0.0
    base = (n, chars, sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))
    features = {
        "n_words": n, "mean_word_chars": share(chars, n), "symbols_per_word": share(base[2], n), "dup_line_share": share(base[3], len(lines)), "repeat_word_share": share(base[4], n),
        "distinct_word_share": share(len(set(words)), n), "upper_share": share(sum(bool(re.match("[A-ZÀ-ÖØ-Þ]", c)) for c in text), letters),
        "digit_share": share(sum(c in "0123456789" for c in text), chars), "mark_share": share(sum(c in quality_rules._MARKS for c in text), chars), "letter_share": share(letters, chars),
    }
    return base, features


def kept(text, rules):
    """The base, then the decision list."""
    base, features = statistics(text)
    if base[0] < 50 or 100 * base[4] > 50 * base[0]:
        return False
    holds = lambda f, at_least, t: features[f] >= t if at_least else features[f] < t
    return not any(all(holds(*x) for x in r.tests) for r in rules.rules)


def languages(train, texts):
    """(language, score) of each text: word-first backoff without caches, bounds or Spark. ``train``: (text, lang)."""
    words = lambda t: re.findall(r"[^\W\d_]+", (t or "").lower())
    counts = [Counter() for _ in range(6)]  # 0: words; else n-grams by order
    for text, lang in train:
        for w in words(text):
            if len(w) <= language_id.LONGEST_WORD:
                counts[0][w, lang] += 1
            for order in language_id.ORDERS:
                for g in language_id.grams_of(w, order):
                    counts[len(g)][g, lang] += 1
    counts = [{k: n for k, n in c.items() if n > 1} for c in counts]
    names = sorted({lang for c in counts for _, lang in c})
    logs = []
    for c in counts:
        items = {i for i, _ in c}
        total = {x: sum(c.get((i, x), 0) + 0.5 for i in items) for x in names}
        logs.append({i: [np.log((c.get((i, x), 0) + 0.5) / total[x]) for x in names] for i in items})
    out = []
    for text in texts:
        total = np.zeros(len(names))
        for w in words(text):
            if w in logs[0]:
                total += logs[0][w]
                continue
            for order in language_id.ORDERS:
                if known := [logs[len(g)][g] for g in language_id.grams_of(w, order) if g in logs[len(g)]]:
                    total += np.mean(known, axis=0)
                    break
        p = np.exp(total - total.max()) if names else total
        out.append((names[int(p.argmax())], float(p.max() / p.sum())) if names and words(text) else ("und", 0.0))
    return out


def near_classes(rows, words=5, threshold=near_dedup.THRESHOLD):
    """{id: least id of its class} of (id, text): every pair's weighted Jaccard similarity, over shingles of words themselves."""
    def shingles(text):
        w = (text or "").lower().encode().split()
        return Counter(tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))) if w else Counter()

    sets = [shingles(t) for _, t in rows]
    df = Counter(s for x in sets for s in x)
    weight = {s: 1 + np.log(len(rows) / n) for s, n in df.items()}
    total = [sum(weight[s] * n for s, n in x.items()) for x in sets]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    where = defaultdict(list)
    for i, x in enumerate(sets):
        for s in x or [None]:
            where[s].append(i)
    for i, j in {p for members in where.values() for p in itertools.combinations(members, 2)}:
        shared = sum(weight[s] * min(n, sets[j][s]) for s, n in sets[i].items() if s in sets[j])
        if not sets[i] or shared >= threshold * (total[i] + total[j] - shared):
            a, b = sorted((find(i), find(j)))
            parent[b] = a
    least = {}
    for i, (key, _) in enumerate(rows):
        root = find(i)
        least[root] = min(least.get(root, key), key)
    return {key: least[find(i)] for i, (key, _) in enumerate(rows)}
