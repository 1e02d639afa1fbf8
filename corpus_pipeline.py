"""Documents to token ids: the corpus operators one after another.

Every stage reads what its predecessor kept. All but the last return the
columns of ``documents``; the last returns the encoded texts.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession

from ledgerline.llm import bpe, decontaminate, quality_forest, sanitise, simhash_dedup
from ledgerline.llm.common import prepare
from ledgerline.llm.queries import split_pattern, table, vocabulary
from ledgerline.session import ensure_checkpoint_dir

#: The SimHash contract's shingle length (words) and largest distance (bits).
SHINGLE, RADIUS = 4, 4


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules or the isolation forest reject go."""
    prepare(spark)
    model = quality_forest.fit_model(docs, table(spark, sf_dir, "labels"))
    return quality_forest.filter_documents(docs, model)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near-duplicates one document stays, the one with the smallest id."""
    prepare(spark)
    return simhash_dedup.drop_near_duplicates(docs, shingle=SHINGLE, radius=RADIUS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    prepare(spark)
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and the terms that disclose it are replaced in the texts;
    ``n_chars`` stays the length of the text as it came in."""
    prepare(spark)
    return sanitise.sanitise(docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, ids, decoded``: token ids and the bytes they decode to."""
    prepare(spark)
    path, pattern = vocabulary("byte_bpe_50k.tiktoken"), split_pattern()
    return bpe.decode_documents(bpe.encode_documents(docs, path, pattern), path, pattern)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("byte_bpe", byte_bpe),
]

#: SQL has neither an isolation forest nor SimHash components nor a BPE encoder;
#: the tests compare the stages with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each keeps is written to the shared folder and read again."""
    prepare(spark)
    folder = os.path.join(ensure_checkpoint_dir(spark), f"corpus-pipeline-{uuid.uuid4().hex}")
    docs = table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
