"""A corpus pipeline: quality, near copies, benchmark passages, tokens. Each stage works on all its predecessor kept.

Defined results: a null text is the empty text, which the classifier scores like any other; rows with null or repeated ids are rows like others, and
of equal texts one row stays, that of the smallest id (null ids last); labels of null or unknown ids and null labels are left out, without labels every score is 0.5 and
nothing stays; without benchmark items nothing is contaminated; other columns are kept up to the last stage, also if they are named like a
stage's own; an empty table gives no rows. Texts are read whole.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.session import remove, shared_folder
from tidemark.llm import bpe, decontaminate, neardup, quality
from tidemark.llm.queries import vocabulary


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier gives at least 0.7. It learns from labelled rows that are not held out."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~quality.held_out())
    model = quality.fit(docs, labels)
    scored = quality.scored(docs, model, into="score")
    return scored.where(F.col(scored.columns[-1]) >= 0.7).select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    return neardup.drop_near_duplicates(docs)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    judged = decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return judged.where(~F.col(judged.columns[-1])["contaminated"]).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of what they decode to."""
    return bpe.code_digests(docs, vocabulary())


STAGES = [("quality", good_quality), ("near copies", one_of_each), ("decontamination", uncontaminated), ("tokens", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; each one's rows are written to the shared folder and read again. A stage's table is deleted
    once the next one's is there."""
    where = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{where}/{k}")
        docs = spark.read.parquet(f"{where}/{k}")
        if k:
            remove(spark, f"{where}/{k - 1}")
    return docs


#: The classifier is trained and the tokenizer cuts by Unicode classes: SQL cannot express them.
ORACLE_SQL = None
