"""The corpus pipeline: toxicity, near-duplicates, contamination, personal data, mixing.

Each stage takes (spark, docs, sf_dir) and returns a table, which is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents. Filters keep rows as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from bytewright.llm import decontaminate, mixing, pii, simhash, toxicity
from bytewright.llm.common import materialize, table

def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity grammar scores at 0.7 or more go; null and empty texts stay."""
    return toxicity.reject(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one with the smallest id. Links are 5-word similarities of 0.8 or more.

    Null, empty and blank texts are copies of each other; rows without an id stay.
    """
    return simhash.keep_similar(docs)


def contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth of the words or more lies in windows of the benchmark go; those without words stay."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; no document goes, and null texts stay null."""
    return pii.redact(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample by calibrated probabilities, with the weights of what stays, in the place of columns of those names.

    Null and empty texts have the probability of their cell; rows that share an id are drawn together.
    """
    made = ["mix_topic", "mix_tokens", "mix_weight", "mix_probability"]
    found = mixing.mix(docs, mixing.DIMENSIONS, mixing.TARGETS, mixing.SHARE)
    return found.where("mix_kept").select(*[c for c in docs.columns if c.lower() not in made], *made)


STAGES = [
    ("toxicity", toxic),
    ("near_duplicates", near_duplicates),
    ("contamination", contaminated),
    ("personal_data", personal_data),
    ("mixing", mixed),
]

#: SQL expresses neither the grammar nor the random field; the pipeline is tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
