"""A corpus pipeline out of the operators of stepweave.llm: filter, deduplicate, mix, encode."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepweave.llm import language_id, mixing, quality, sentencepiece_nbest, simhash
from stepweave.llm.common import column, fresh, table, written

#: A document goes if no language is as likely as this.
LANGUAGE_SCORE = 0.4
#: Segments that a Python worker remembers, twice over: workers share an executor with a heap that earlier stages have filled.
REMEMBERED = 60_000


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble doesn't reject; labels of its training folds alone are learned from."""
    labels = table(spark, sf_dir, "labels").where(quality.in_training(F.col("doc_id")))
    return quality.keep_good(docs, quality.fit(docs, labels))


def known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the corpus's languages; prototypes are learned from what is here."""
    prototypes = language_id.train(docs.where(language_id.in_training(F.col("doc_id"))))
    pred, score = fresh(docs.columns, "lang_pred"), fresh(docs.columns, "score")
    found = language_id.predict(docs, prototypes, into=(pred, score))
    return found.where((F.col(pred) != "und") & (F.col(score) >= LANGUAGE_SCORE)).select(*map(column, docs.columns))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest doc_id."""
    return simhash.keep_one_each(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix by target weights takes them."""
    return mixing.mixed_rows(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document of the mix with the ids of its best segmentation and the scores of the best few."""
    return sentencepiece_nbest.encoded(docs.select("doc_id", "lang", "source", "text"), remembered=REMEMBERED).drop("text")


STAGES = [
    ("quality_classifier", good_documents),
    ("language_id", known_languages),
    ("simhash_near_dedup", near_copies),
    ("mix_to_weights", mixed),
    ("sentencepiece", encoded),
]

#: Hashes, learned models and the piece lattice are out of SQL's reach.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
