"""A training-corpus pipeline over ``documents``: each stage works on all that the one before it kept.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next stage's ``docs``. All but the last return the columns of ``documents``, and others that ``docs`` has, whatever
their names. An empty table passes every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.llm import exact_dedup, language_id, near_dedup, packing, quality_rules
from tallyline.llm.common import materialize
from tallyline.llm.queries import SEQUENCE, WORD_END, tokenizer

#: A text goes if the posterior of its most likely language is lower.
LEAST_SCORE = 0.5


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base and the learned decision list keep; null and short texts fail the base, repeated rows fare alike."""
    rules = quality_rules.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    judged, names = quality_rules.judge(docs, rules)
    return judged.where(F.col(names["kept"])).select(docs.columns)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the learned languages; null texts, those without letters or any likely language go.

    Learned from the documents' own ``lang`` where it isn't null; without any, all go. Of equally likely languages the first by name counts.
    """
    model = language_id.train(docs)
    found = language_id.predict(docs, model)
    lang, score = found.columns[-2:]
    return found.where((F.col(lang) != "und") & (F.col(score) >= LEAST_SCORE)).select(docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, that of the smallest id (null ids last; of equal ids one row). Null and empty texts are one text."""
    return exact_dedup.drop_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, that of the smallest id (null ids last; of equal ids one row). Texts without words are one class."""
    return near_dedup.drop_near_duplicates(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences, of every row: a null text is its end token alone, a long one is cut, repeated rows are packed as often as they occur."""
    return packing.pack(docs, tokenizer("word_bpe_49k.json"), end_id=WORD_END, length=SEQUENCE)


STAGES = [("quality rules", quality), ("language ID", language), ("exact dedup", exact), ("near dedup", near), ("packing", pack)]

#: Learned stages and sampling have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
