"""A corpus pipeline: quality, near-duplicates, decontamination, personal data, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
reread as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pactlake.llm import bpe, decontaminate, pii, quality, simhash
from pactlake.llm.common import materialize, own_steps, table, unused


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts (score 0.5 or more)."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    good = unused(docs.columns, "good")
    return quality.score(docs, model, docs.columns, into=good).where(F.col(good) >= 0.5).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (0.8 or more of their 5-word shingles in common),
    that with the smallest doc_id."""
    return simhash.similar_one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    names = [unused(docs.columns, n) for n in ("n_words", "hits", "items")]
    found = decontaminate.scan(docs, table(spark, sf_dir, "benchmark"), docs.columns, into=names)
    return found.where(F.size(names[1]) == 0).select(*docs.columns)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data and disclosing terms redacted; n_chars follows the text."""
    clean = pii.redacted(docs)
    if "n_chars" not in docs.columns:
        return clean
    return clean.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document."""
    return bpe.encode(docs, keep=["doc_id", "lang", "source"])


STAGES = [
    ("quality", keep_good),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal_data", redact_personal_data),
    ("encoding", encode),
]

#: Models, automata and fingerprints can't be written in SQL; tests hold the run against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        with own_steps():  # what a stage wrote on its way goes when its result is written
            docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
