"""A training-corpus pipeline: toxic documents go, one of each group of near duplicates stays, copies of the benchmark go,
personal data gets surrogates, and the sources are mixed to target weights.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. ``run``
writes what a stage returns to the shared folder and reads it back as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm.common import kept
from weftgraph.llm.decontaminate import clean
from weftgraph.llm.jaccard import one_of_each
from weftgraph.llm.mixing import mix_sources
from weftgraph.llm.pii import replace_entities, session_key
from weftgraph.llm.toxicity import score_toxicity

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _columns(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model doesn't reject. Null, empty and blank texts have no evidence and pass, unless most labels are toxic; repeated rows pass or go alike; without labels all pass."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return _columns(score_toxicity(_columns(docs), labels).filter("predicted = 0"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by 0.8 or more of their five-word shingles the one of the smallest doc_id, null last. A row is known by doc_id and text; of rows equal in both one stays; rows without words all stay."""
    return _columns(one_of_each(_columns(docs), n=5, percent=80))


def drop_benchmark_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no copy of a benchmark item. Null and empty texts, and all without a benchmark, stay; a row is known by doc_id and text."""
    return _columns(clean(_columns(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with surrogates for personal data, by the session's key; null and empty texts as they are; repeated rows alike."""
    return _columns(replace_entities(_columns(docs), session_key(spark)))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, size, source_size, target and taken of each document that the mix takes; texts without words are never taken."""
    return mix_sources(_columns(docs)).filter("taken > 0")


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_duplicates),
    ("benchmark decontamination", drop_benchmark_copies),
    ("personal data", replace_personal_data),
    ("mixing", mix),
]
#: No stage but the last step's sums can be told in SQL. The tests hold the two joins of stages against brute force, the others against planted cases.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = kept(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
