"""Quality rules: text statistics and a learned decision list over them.

Statistics are computed for every whole text in one pass. A decision list is learned by sequential covering on the
statistics of labelled documents: each rule is grown (a conjunction of thresholds, by information gain, on two thirds
of the rows), pruned (on the rest), kept if it is precise there, and its rows are removed before the next. The list
is emitted as one ordered Spark conditional expression over the statistics' columns.
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyline.llm.common import bounded_sample, fresh, lean, plus, slices, small_batches, texts_of

SYMBOLS = "#*$%&|<>"
MAX_LABELLED = 20_000
_LONG = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_chars", "n_upper", "n_letters", "n_digits", "n_marks", "n_lines", "n_distinct_words")
_MARKS = "!?;:()[]{}\"/\\=+_~^@"


@cache
def _letters() -> np.ndarray:
    """By code point: whether it is a letter."""
    return np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)), bool, 0x110000)


def statistics_of(text: str) -> tuple[int, ...]:
    """The values of ``_LONG`` for one text."""
    words = text.encode("utf-8", "surrogatepass").split()  # bytes split at x20 and x09 to x0D alone
    blank = sum(map(text.count, " \t\n\v\f\r"))
    lines = [x for x in text.split("\n") if x.strip(" \t\v\f\r")]
    repeated = 0
    if len(words) > 3:
        windows = list(zip(words, words[1:], words[2:]))
        distinct = set(windows)
        if len(distinct) < len(windows):
            seen: dict[tuple, int] = {}
            for w in windows:
                seen[w] = seen.get(w, 0) + 1
            covered = bytearray(len(words))
            for i, w in enumerate(windows):
                if seen[w] > 1:
                    covered[i] = covered[i + 1] = covered[i + 2] = 1
            repeated = sum(covered)
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    upper = int(((raw >= 65) & (raw <= 90) | (raw >= 0xC0) & (raw <= 0xDE) & (raw != 0xD7)).sum())
    letters = int(_letters()[raw].sum())
    digits = int(((raw >= 48) & (raw <= 57)).sum())
    return (
        len(words), len(text) - blank, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated,
        len(text), upper, letters, digits, sum(map(text.count, _MARKS)), len(lines), len(set(words)),
    )


def with_statistics(docs: DataFrame, *, text_col: str = "text", prefix: str = "") -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with the statistics (long) of every whole text (null: empty), and the names that they got."""
    at, taken, names = docs.columns.index(text_col), list(docs.columns), {}
    for n in _LONG:
        names[n] = fresh(taken, prefix + n)
        taken.append(names[n])
    schema = plus(docs.schema, *((names[n], T.LongType()) for n in _LONG))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, at):
                columns = zip(*map(statistics_of, texts_of(part, at)))
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(c, pa.int64()) for c in columns)], [*part.schema.names, *names.values()])

    small_batches(docs.sparkSession)
    return docs.mapInArrow(lean(run), schema), names


#: What rules may test: name -> (numerator, denominator or None); a ratio with denominator 0 is 0.
FEATURES = {
    "n_words": ("n_words", None),
    "mean_word_chars": ("word_chars", "n_words"),
    "symbols_per_word": ("n_symbols", "n_words"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "repeat_word_share": ("n_repeat_words", "n_words"),
    "distinct_word_share": ("n_distinct_words", "n_words"),
    "upper_share": ("n_upper", "n_letters"),
    "digit_share": ("n_digits", "word_chars"),
    "mark_share": ("n_marks", "word_chars"),
    "letter_share": ("n_letters", "word_chars"),
}


def feature(name: str, names: dict[str, str]) -> Column:
    a, b = FEATURES[name]
    value = F.col(names[a]).cast("double")
    return value if b is None else F.when(F.col(names[b]) > 0, value / F.col(names[b])).otherwise(0.0)


def base_failed(names: dict[str, str]) -> Column:
    return (F.col(names["n_words"]) < 50) | (100 * F.col(names["n_repeat_words"]) > 50 * F.col(names["n_words"]))


@dataclass(frozen=True)
class Rule:
    """Reject if every (feature, is_at_least, threshold) holds."""

    tests: tuple[tuple[str, bool, float], ...]

    def column(self, names: dict[str, str]) -> Column:
        out = F.lit(True)
        for f, at_least, t in self.tests:
            out = out & ((feature(f, names) >= t) if at_least else (feature(f, names) < t))
        return out

    def __str__(self) -> str:
        return " and ".join(f"{f} {'>=' if g else '<'} {t:.6g}" for f, g, t in self.tests)


@dataclass(frozen=True)
class DecisionList:
    rules: tuple[Rule, ...]

    def verdict(self, names: dict[str, str]) -> Column:
        """One ordered conditional: whether the text is kept."""
        out = None
        for r in self.rules:
            out = F.when(r.column(names), F.lit(False)) if out is None else out.when(r.column(names), F.lit(False))
        return F.lit(True) if out is None else out.otherwise(F.lit(True))


def _covers(x: np.ndarray, tests) -> np.ndarray:
    out = np.ones(len(x), bool)
    for f, at_least, t in tests:
        out &= (x[:, f] >= t) if at_least else (x[:, f] < t)
    return out


def _best_test(x: np.ndarray, bad: np.ndarray) -> tuple[float, tuple | None]:
    """The threshold test of the largest information gain."""
    p, n = int(bad.sum()), int((~bad).sum())
    if not p or not n:
        return 0.0, None
    start, best = math.log2(p / (p + n)), (1e-9, None)
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, b = x[order, f], bad[order]
        cut = np.flatnonzero(v[1:] > v[:-1]) + 1
        if not len(cut):
            continue
        below = np.cumsum(b)[cut - 1]
        for at_least in (True, False):
            pp = p - below if at_least else below
            total = len(v) - cut if at_least else cut
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(pp > 0, pp * (np.log2(pp / total) - start), 0.0)
            i = int(gain.argmax())
            if gain[i] > best[0]:
                best = (float(gain[i]), (f, at_least, float((v[cut[i] - 1] + v[cut[i]]) / 2)))
    return best


def learn(x: np.ndarray, bad: np.ndarray, *, max_rules: int = 12, max_tests: int = 3, precision: float = 0.95, least: int = 5) -> DecisionList:
    """Sequential covering over rows of features (in FEATURES' order) and labels; a fixed split, so the same rows give the same list."""
    names = list(FEATURES)
    grow = np.arange(len(x)) % 3 != 0
    left = np.ones(len(x), bool)
    rules = []
    while len(rules) < max_rules and (left & bad & grow).sum() >= least:
        tests: list[tuple] = []
        rows = left & grow
        while len(tests) < max_tests:
            inside = rows & _covers(x, tests)
            _, test = _best_test(x[inside], bad[inside])
            if test is None:
                break
            tests.append(test)
        if not tests:
            break
        held = left & ~grow

        def worth(k: int) -> float:
            c = held & _covers(x, tests[:k])
            p, n = int((c & bad).sum()), int((c & ~bad).sum())
            return (p - n) / (p + n) if p + n else -1.0

        k = max(range(1, len(tests) + 1), key=lambda k: (worth(k), -k))
        tests = tests[:k]
        covered = left & _covers(x, tests)
        test_rows = covered & ~grow
        enough = (covered & bad).sum() >= least and (covered & bad).sum() >= precision * covered.sum()
        if not enough or (bad & test_rows).sum() < precision * test_rows.sum():
            break
        rules.append(Rule(tuple((names[f], g, t) for f, g, t in tests)))
        left &= ~covered
    return DecisionList(tuple(rules))


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", max_labelled: int = MAX_LABELLED) -> DecisionList:
    """Learn from at most ``max_labelled`` labelled documents (chosen by a hash of the id), from their whole texts.

    Documents that fail the base anyway are left out.
    ``labels`` has (doc_id, quality: 0 is bad). Null ids and labels are left out; of differing labels of an id, none
    counts; of differing texts of an id, the one with the least statistics counts, repeated rows once. The chosen
    labels, bounded so, are broadcast; one row of statistics for each comes to the driver.
    """
    clean = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
    chosen = clean.where(bounded_sample(clean, F.col("doc_id"), max_labelled)).groupBy("doc_id").agg(F.min("quality").alias("lo"), F.max("quality").alias("hi"))
    chosen = chosen.where(F.col("lo") == F.col("hi")).select(F.col("doc_id").alias("l_id"), (F.col("lo") == 0).alias("l_bad"))
    base = docs.select(F.col(id_col).alias("d_id"), F.col(text_col).alias("d_text"))
    joined = base.join(F.broadcast(chosen), F.col("d_id") == F.col("l_id")).select("d_id", "l_bad", "d_text")
    stats, names = with_statistics(joined, text_col="d_text")
    one = F.min(F.struct("l_bad", *(feature(f, names).alias(f) for f in FEATURES))).alias("r")
    rows = [r["r"] for r in stats.where(~base_failed(names)).groupBy("d_id").agg(one).select("r").collect()]
    rows.sort(key=lambda r: tuple(r))
    if not rows:
        return DecisionList(())
    return learn(np.array([[r[f] for f in FEATURES] for r in rows], float), np.array([r["l_bad"] for r in rows], bool))


def judge(docs: DataFrame, rules: DecisionList, *, text_col: str = "text") -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with statistics, ``base_failed`` and ``kept``; the second value maps plain names to the columns' names.

    A null or empty text has no words and fails the base. Repeated rows, other columns and empty tables pass through.
    """
    out, names = with_statistics(docs, text_col=text_col)
    taken = list(out.columns)
    for n, c in (("base_failed", base_failed(names)), ("kept", ~base_failed(names) & rules.verdict(names))):
        names[n] = fresh(taken, n)
        taken.append(names[n])
        out = out.withColumn(names[n], c)
    return out, names
