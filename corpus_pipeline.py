"""A training corpus from `documents`: five stages, each written as Parquet and read by the next.

Stages call the operators of `motionloom.llm` and take effect: toxic documents go, repeated
passages go, one document of each near-duplicate group stays, contaminated documents go, and what
is left is packed. All but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motionloom.llm import decontaminate, line_dedup, near_dup, packing, toxicity
from motionloom.llm.shared import table
from motionloom.session import ship_package, stored

TOXIC_SCORE = 0.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below TOXIC_SCORE; the weights are fitted on the labelled documents."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).filter(F.col("toxicity") < TOXIC_SCORE).select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of passages removed, n_chars of the new text; texts that lose every line go."""
    clean = line_dedup.remove_repeats(docs)
    emptied = (F.col("n_removed") > 0) & (F.col("n_removed") == F.col("n_lines"))
    changed = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return clean.filter(~emptied).withColumn("n_chars", changed).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least doc_id of each group linked at a similarity of 0.8 of five-word shingles."""
    return near_dup.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of whose words less than a twentieth lies in benchmark passages."""
    return decontaminate.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of the documents' pieces in sequences of 1024 tokens."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

ORACLE_SQL = None  # weights are learned, signatures and tokens are not SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to `documents`, each one's result stored before the next."""
    ship_package(spark)
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return stored(STAGES[-1][1](spark, docs, sf_dir))
