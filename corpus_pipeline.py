"""A corpus pipeline: language ID, near-duplicate removal, PII surrogates, source mixing, BPE encoding.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame; `docs` has the columns of `documents`.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilframe.llm import bpe, jaccard, langid, mixing, pii
from vigilframe.llm.common import table, written
from vigilframe.llm.queries import PII_KEY, VOCABULARY

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Below this score the predicted language is taken for a guess and the document goes; the sample tables' texts score above 0.36.
LEAST_SCORE = 0.2


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognised language go; the others get it as `lang`."""
    found = langid.identify(docs.select(*COLUMNS), langid.fit(docs))
    kept = found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return kept.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8 or more) one document stays."""
    return jaccard.keep_one(docs, n=5, t=80).select(*COLUMNS)


def replace_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data give way to surrogates; `n_chars` follows the new text."""
    out = pii.replace_pii(docs, PII_KEY, counts=None)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.repeated(mixing.mix(docs), COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens; documents repeated by the mix repeat."""
    out = bpe.encode(docs.select(*COLUMNS), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)
    return out.select("doc_id", "lang", "source", "n_chars", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", remove_near_duplicates),
    ("pii", replace_pii),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: The first stage is a fitted classifier, so run() has no SQL; tests hold it against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written as Parquet and read again; a table goes when the next is written."""
    docs, remove = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        docs, after = written(stage(spark, docs, sf_dir))
        if remove:
            remove()
        remove = after
    return STAGES[-1][1](spark, docs, sf_dir)
