"""A corpus from raw documents to token ids in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents, whatever they are. An empty table passes through all
stages; null texts are rejected by the first. Line dedup leaves later copies of a text empty, and the n-gram join takes
empty texts as copies of each other, so one of all emptied documents stays.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberline.llm import bpe, jaccard, language, lines, mixing
from emberline.llm.common import read, written

#: A document is rejected where its language holds a smaller share of its letters.
LEAST_SHARE = 1 / 3


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents of no known language, or of several of which none prevails."""
    model = language.train(docs.where(language.fold() != 0))
    names = ("emberline_lang_pred", "emberline_lang_score", "emberline_lang_spans")
    added = tuple(T.StructField(n, f.dataType) for n, f in zip(names, language.ADDED, strict=True))
    found = language.identify(docs, model, added)
    return found.where((F.col(names[0]) != language.UNKNOWN) & (F.col(names[1]) >= LEAST_SHARE)).drop(*names)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents, text without boilerplate lines."""
    return lines.cleaned(docs).select("doc.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of similar texts."""
    return jaccard.keep_one(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mixed_rows(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents, their token_ids as little-endian unsigned 32-bit integers, and n_tokens."""
    coded = bpe.encode(docs, public_tokenizers.path(bpe.VOCABULARY))
    return coded.withColumn("n_tokens", (F.octet_length("token_ids") / 4).cast("long"))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("source_mix", source_mix),
    ("encode", encode),
]

#: Encoding is beyond SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
