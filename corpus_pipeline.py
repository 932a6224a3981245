"""The corpus pipeline: raw documents to encoded training text, in stages that each read what the one before wrote."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tieout.llm.common import table
from tieout.llm.mixing import remixed
from tieout.llm.near_copies import one_of_near_copies
from tieout.llm.piece_codec import encode_decode
from tieout.llm.secret_scan import redacted
from tieout.llm.toxicity import without_toxic

#: Near-duplicates: words in a shingle, and the least share of common shingles among all of two texts.
SHINGLE, SIMILARITY = 5, "0.8"
#: Target shares of words by the quality mark of the labelled table: good text comes about twice as often as it is.
SHARES = {"quality0": 0.05, "quality1": 0.95}


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return without_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the one with the smallest id. Groups are by SimHash and, beyond its reach, by verified shingles."""
    return one_of_near_copies(docs, SHINGLE, SIMILARITY)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts become marks."""
    return redacted(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents come as often as the target shares ask, once at least."""
    return remixed(docs, table(spark, sf_dir, "labels"), F.concat(F.lit("quality"), F.col("quality").cast("string")), SHARES)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each text and its decoded text, and checksums of both."""
    return encode_decode(docs, public_tokenizers.path("piece_bpe_32k.model"), keep=True)


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("secrets", secrets), ("mixing", mixing), ("pieces", pieces)]

#: SQL can't express the classifier, the fingerprints or the encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
