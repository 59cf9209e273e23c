"""Corpus pipeline: stages over ``documents``, each written as Parquet and read by the next.

A stage takes all rows that the one before it kept and, but for the last one, returns the columns of the
documents, whatever these are called besides doc_id, text, lang and source. Null ids and repeated rows go
through all stages like others, except that near copies keep one row of an id. A null text has no words, so that the quality rules
reject it. Ties are broken as the operators state. An empty table stays empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairwell.llm.bpe import with_ids
from pairwell.llm.common import kept, packed, unpacked
from pairwell.llm.language import in_language
from pairwell.llm.language import learn as learn_languages
from pairwell.llm.mixing import mix, repeated
from pairwell.llm.ngram_join import one_of_each
from pairwell.llm.quality import good_documents


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and the rules learned from ``labels``; null and empty texts fail it.

    Rows are judged one by one; without labels of both kinds only the base rule rejects.
    """
    return good_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language of those that state one, from which the model is learned.

    Null texts and texts without letters go; rows with a null language are judged like others. If no row states a
    language, none stays.
    """
    return in_language(docs, learn_languages(docs, F.lit(True), foreign=True))


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares four fifths of its five-word shingles: the one of the smallest id.

    Texts without words and rows with a null id link with nothing and stay.
    """
    return one_of_each(docs, size=5, percent=80)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: up to twice, or not at all.

    A null source is one of its own. Rows of equal id and text are taken together.
    """
    own = {"doc_id": "doc_id", "text": "text", "source": "source"}
    return repeated(mix(packed(docs, **own))).select(*unpacked(docs, **own))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document that the mix holds; each row's ids are decoded and held against its text.

    The result has doc_id, lang, source, n_tokens and token_ids; a null or empty text has no ids.
    """
    own = docs.select("doc_id", "lang", "source", "text")
    coded = with_ids(own, public_tokenizers.path("byte_bpe_50k.json"), ids="token_ids", decoded=True)
    return coded.select("doc_id", "lang", "source", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids")


STAGES = [
    ("quality rules", quality_stage),
    ("language", language_stage),
    ("near copies", near_copy_stage),
    ("mixing", mix_stage),
    ("tokens", token_stage),
]

#: Learned rules, language models and BPE have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        docs = kept(stage(spark, docs, sf_dir), f"stage-{number}")
    return docs
