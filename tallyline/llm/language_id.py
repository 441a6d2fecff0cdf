"""Language ID by word-first backoff.

The model holds, for each language, log frequencies of frequent words and of character n-grams (of the padded words).
A known word scores by its frequencies; an unseen word falls back to the longest n-gram order of which at least one of
its n-grams is known. A text's language is the one with the largest sum over all its words.

The model is fitted on at most ``max_docs`` documents of each language, chosen by a hash of their id; its
vocabulary has a fixed bound for each language, so it can be sent to every task. Prediction reads every whole text once, without a shuffle.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyline.llm.common import bounded_sample, fresh, lean, materialize, plus, remove, slices, small_batches, texts_of

MAX_DOCS = 3000
#: For each language.
MAX_WORDS, MAX_GRAMS = 15_000, 15_000
ORDERS = (5, 4, 3, 2, 1)
LONGEST_WORD = 100
CACHED_WORDS = 60_000
_words = re.compile(r"[^\W\d_]+").findall


def words_of(text: str) -> list[str]:
    return _words(text.lower())


def grams_of(word: str, order: int) -> list[str]:
    padded = f"^{word}$" if order > 1 else word
    return [padded[i : i + order] for i in range(max(1, len(padded) - order + 1))]


@dataclass(frozen=True)
class LanguageModel:
    """Words and n-grams, each with a row of log frequencies by language."""

    languages: tuple[str, ...]
    words: list[str]
    word_logs: np.ndarray
    grams: list[str]
    gram_logs: np.ndarray


def train(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_docs: int = MAX_DOCS, max_words: int = MAX_WORDS, max_grams: int = MAX_GRAMS
) -> LanguageModel:
    """Fit on rows with a language, at most ``max_docs`` of each. Without any such row the model has no language and predicts ``und``.

    The vocabulary holds what occurs at least twice: of each language at most ``max_words`` words and ``max_grams``
    n-grams, the most frequent there (equal counts at the cut go together). Words of over 100 characters are no vocabulary words; they
    count by their n-grams. Null and empty texts add nothing; repeated rows count as often as they occur.
    """
    base = docs.where(F.col(lang_col).isNotNull()).select(F.col(id_col).alias("k"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    chosen = base.where(bounded_sample(base, F.col("k"), max_docs, F.col("lang"), F.col("text"))).select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                seen: dict[str, Counter] = {}
                for lang, text in zip(part.column(0).to_pylist(), texts_of(part, 1)):
                    seen.setdefault(lang, Counter()).update(words_of(text))
                rows = []
                for lang, words in seen.items():
                    grams: Counter = Counter()
                    for w, n in words.items():
                        for order in ORDERS:
                            for g in grams_of(w, order):
                                grams[g] += n
                    rows += [(lang, True, w, n) for w, n in words.items() if len(w) <= LONGEST_WORD] + [(lang, False, g, n) for g, n in grams.items()]
                types = (pa.string(), pa.bool_(), pa.string(), pa.int64())
                columns = zip(*rows) if rows else [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["lang", "word", "item", "n"])

    small_batches(docs.sparkSession)
    counts = chosen.mapInArrow(lean(run), "lang string, word boolean, item string, n long")
    by_lang = materialize(counts.groupBy("word", "item", "lang").agg(F.sum("n").alias("n")).where(F.col("n") > 1), "language-counts")
    # How many items have each count: few rows. The least count of a language that keeps it within its bound.
    spread = sorted(map(tuple, by_lang.groupBy("lang", "word", "n").agg(F.count(F.lit(1)).alias("items")).collect()), key=lambda r: -r[2])
    cuts: dict[tuple, int] = {}
    total: Counter = Counter()
    full = set()
    for lang, word, n, items in spread:
        total[lang, word] += items
        if total[lang, word] > (max_words if word else max_grams):
            full.add((lang, word))
        if (lang, word) not in full:
            cuts[lang, word] = n
    if not cuts:
        remove(docs.sparkSession, by_lang)
        return LanguageModel((), [], np.zeros((0, 0)), [], np.zeros((0, 0)))
    languages = tuple(sorted({lang for lang, _ in cuts}))
    least = F.create_map(*(F.lit(x) for (lang, word), n in cuts.items() for x in (f"{int(word)}{lang}", n)))[F.concat(F.col("word").cast("int").cast("string"), "lang")]
    table = by_lang.groupBy("word", "item").agg(F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("by_lang"), F.max(F.col("n") >= least).alias("kept"))
    rows = table.where("kept").select("word", "item", "by_lang").collect()
    remove(docs.sparkSession, by_lang)

    def logs(rows: list) -> tuple[list[str], np.ndarray]:
        n = np.array([[r["by_lang"].get(lang, 0) for lang in languages] for r in rows], float).reshape(len(rows), len(languages)) + 0.5
        return [r["item"] for r in rows], np.log(n / n.sum(axis=0)).astype(np.float32)

    # n-grams are compared within their order.
    orders = [logs(sorted((r for r in rows if not r["word"] and len(r["item"]) == order), key=lambda r: r["item"])) for order in ORDERS]
    return LanguageModel(languages, *logs(sorted((r for r in rows if r["word"]), key=lambda r: r["item"])), [g for items, _ in orders for g in items], np.concatenate([x for _, x in orders]))


class _Scores(dict):
    """Word -> row of ``matrix``; unseen words are scored once and remembered within a bound."""

    def __init__(self, model: LanguageModel):
        super().__init__(zip(model.words, range(len(model.words))))
        self.known = self.size = len(self)
        self.grams, self.gram_logs = dict(zip(model.grams, range(len(model.grams)))), model.gram_logs
        self.matrix = np.zeros((self.known + CACHED_WORDS, len(model.languages)), np.float32)
        self.matrix[: self.known] = model.word_logs

    def __missing__(self, word: str) -> int:
        if self.size == len(self.matrix):
            raise MemoryError  # make_room() is called between texts; a single text with more new words goes on in parts
        grams = self.grams
        i = self[word] = self.size
        for order in ORDERS:
            known = [grams[g] for g in grams_of(word, order) if g in grams]
            if known:
                self.matrix[i] = self.gram_logs[known].mean(axis=0)
                break
        else:
            self.matrix[i] = 0.0
        self.size += 1
        return i

    def make_room(self, words: int) -> None:
        if self.size + words > len(self.matrix):
            for w, i in list(self.items()):
                if i >= self.known:
                    del self[w]
            self.size = self.known

    def total(self, words: list[str]) -> np.ndarray:
        sums = np.zeros(self.matrix.shape[1], np.float64)
        step = CACHED_WORDS // 2
        for at in range(0, len(words), step):
            part = words[at : at + step]
            self.make_room(len(part))
            rows = self.matrix[np.fromiter(map(self.__getitem__, part), np.int64, len(part))]
            sums += rows.sum(axis=0, dtype=np.float64)
        return sums


def predict(docs: DataFrame, model: LanguageModel, *, text_col: str = "text", lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """``docs`` with the predicted language and its score (0 to 1: its posterior under equal priors).

    ``und`` with score 0 for a null text, one without any letter, or an empty model. Of equal languages the first by
    name. Columns, repeated rows and empty tables are kept; taken output names get an underscore.
    """
    at = docs.columns.index(text_col)
    lang_out = fresh(docs.columns, lang_out)
    score_out = fresh([*docs.columns, lang_out], score_out)
    schema = plus(docs.schema, (lang_out, T.StringType()), (score_out, T.DoubleType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = _Scores(model) if model.languages else None
        for batch in batches:
            for part in slices(batch, at):
                langs, values = [], []
                for text in texts_of(part, at):
                    words = words_of(text)
                    if scores is None or not (any(map(str.isalpha, words)) or any(map(str.isalpha, text))):
                        langs.append("und")
                        values.append(0.0)
                        continue
                    total = scores.total(words)
                    total -= total.max()
                    best = int(total.argmax())
                    langs.append(model.languages[best])
                    values.append(float(1 / np.exp(total).sum()))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(langs, pa.string()), pa.array(values, pa.float64())], [*part.schema.names, lang_out, score_out])

    small_batches(docs.sparkSession)
    return docs.mapInArrow(lean(run), schema)


def held_out(key: Column) -> Column:
    """Whether crc32 of the id as text leaves 2 modulo 4; a null id is not held out. Repeated ids fall alike; texts don't matter."""
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
