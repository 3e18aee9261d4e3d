"""A corpus from raw documents to token ids, in five stages.

Each stage takes the session, the documents its predecessor kept and the folder
of the tables, and returns a DataFrame that is written as Parquet and read
again for the next one. All but the last return the columns of documents.

1. toxicity: documents scored toxic go.
2. near duplicates: of each class of documents whose sets of five-word shingles
   reach a Jaccard similarity of 0.8 (linked directly or over others), the
   smallest id stays.
3. benchmark decontamination: documents that share a window of ten words with
   a benchmark item (or hold a shorter item whole) go.
4. personal data: every span found is replaced by its kind in brackets.
5. byte-level BPE: the ids of every whole text; decoding gives the text back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tickstat.llm import bpe, decontaminate, jaccard, pii, toxicity
from tickstat.llm.store import stored, table

#: No SQL: the first stage learns a model and the last one follows a rank file.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.without_copies(docs, words=5, similarity=(8, 10))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("pii", redact_personal_data),
    ("bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
