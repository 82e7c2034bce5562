"""Corpus preparation in five stages, each a table of documents for the next.

Language ID drops what is no text in a known language; the n-gram Jaccard join keeps the
smallest id of each group of near copies (five words, similarity 0.8); decontamination drops
documents that hold benchmark items; mixing repeats and drops documents towards the sources'
target weights; the last stage writes token ids and reports each document's place in the store.
Every stage but the last returns the columns of its input.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from spindle.llm.common import staged, table
from spindle.llm.decontaminate import clean_documents
from spindle.llm.jaccard import near_duplicates_removed
from spindle.llm.langid import accepted_documents
from spindle.llm.mixing import mixed
from spindle.llm.tokenstore import round_trip


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return accepted_documents(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_duplicates_removed(docs, k=5, num=80, den=100)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document that the mix repeats is written as often; its rows differ in ``start``."""
    return round_trip(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1)


STAGES = [
    ("language ID", identify_language),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", decontaminate),
    ("mixing sources", mix_sources),
    ("token-ID output", write_tokens),
]

#: SQL can't express the text model, the singular vectors or the tokenizer; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = staged(docs, f"pipeline-{i}")
    return docs
