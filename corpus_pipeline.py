"""The corpus pipeline: stages over the documents table, each written and read again before the next."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from colscope.llm import queries, stages
from colscope.llm.common import read, shared_path

# No SQL: the first stage is a trained classifier.
ORACLE_SQL = None

STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", lambda spark, docs, sf_dir: stages.drop_toxic(docs, read(spark, sf_dir, "labels"))),
    ("line_dedup", lambda spark, docs, sf_dir: stages.drop_repeated_lines(docs)),
    ("ngram_jaccard", lambda spark, docs, sf_dir: stages.drop_near_copies(docs)),
    ("decontamination", lambda spark, docs, sf_dir: stages.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))),
    ("byte_bpe", lambda spark, docs, sf_dir: stages.tokenize(docs, queries.RANKS, public_tokenizers.PATTERN)),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents of ``sf_dir``."""
    docs = read(spark, sf_dir, "documents")
    for at, (name, stage) in enumerate(STAGES):
        done = stage(spark, docs, sf_dir)
        if at == len(STAGES) - 1:
            return done
        path = shared_path(spark, f"stage-{name}")
        done.write.parquet(path)
        docs = spark.read.schema(done.schema).parquet(path)
    return docs
