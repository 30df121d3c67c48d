"""The corpus pipeline: documents to shards, one operator per stage.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; it works on all rows
that its predecessor kept.  All but the last return the columns of documents.  Every stage takes
empty tables; what it does with nulls, empty texts and repeated rows is said by its operator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from soundkeel.llm import mixing, rules, shards, simhash, winnow
from soundkeel.llm.common import stored, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or an adaptive cutoff reject go; null and empty texts are among them."""
    return rules.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard index of 0.8 or more of five-word shingles one stays, that with the least id."""
    return simhash.first_of_groups(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of a benchmark item go; null texts stay."""
    return winnow.clean_rows(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of each source up to its budget, some more than once; texts without words are not taken."""
    return mixing.mixed_rows(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their shard."""
    return shards.shard_rows(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("simhash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources", mixture),
    ("sharding", sharding),
]

#: The near-duplicate stage and the split search are iterative; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
