"""A corpus pipeline in stages: toxicity, quality rules, near-duplicates, packing.

Every stage takes (spark, docs, sf_dir), works on all that the stage before it kept, and returns a DataFrame; all
but the last return the columns of `docs`.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from skepsis.llm import packing, quality, similar, toxic
from skepsis.llm.common import materialize, table

#: Near-duplicates of the pipeline: the similarity of sets of shingles of five words, and the bits within which texts of that similarity
#: mostly lie, of the fingerprint that is searched for candidates and of the second one.
SIMILARITY = 0.8
WORDS, RADIUS, CHECK = 5, 11, 17


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject."""
    model = toxic.fit(*toxic.labelled(docs, table(spark, sf_dir, "labels")))
    return toxic.score(docs, model).filter("predicted = 0").select(*docs.columns)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and lie near a language's distributions."""
    return quality.judge(docs, quality.references(docs)).filter("kept").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest id."""
    return similar.distinct_documents(docs, SIMILARITY, WORDS, RADIUS, CHECK)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' ids, each a sequence of its own."""
    p = packing.pack(docs)
    return p.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")


STAGES = [("toxicity", drop_toxic), ("quality", keep_quality), ("near_duplicates", drop_near_duplicates), ("packing", pack)]
ORACLE_SQL = None       # stages 1, 3 and 4 can't be expressed in SQL; tests/llm compares them with plain versions


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; each stage's result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
