"""Stages of the corpus pipeline: each takes documents and gives documents with the same columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe, decontaminate, jaccard, lines, toxicity


def drop_repeated_lines(docs: DataFrame) -> DataFrame:
    """Lines shared by five documents or more stay in one of them. Texts and ``n_chars`` change, documents stay."""
    done = lines.apply_bitmaps(docs, lines.keep_bitmaps(docs)).withColumn("text", F.col("__lines.kept_text"))
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return done.select(docs.columns)


def tokenize(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids) of the documents that are left; decoding checks that nothing is lost."""
    encoded = bpe.encode_documents(docs, ranks_path, pattern)
    return encoded.select("doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("text_sha256"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents that the classifier doesn't call toxic."""
    model = toxicity.train(docs, labels)
    return toxicity.with_score(docs, model).where(F.col("__score") < toxicity.THRESHOLD).select(docs.columns)


def drop_near_copies(docs: DataFrame, rule: jaccard.Rule = jaccard.Rule(words=5, num=80, den=100)) -> DataFrame:
    """One document of each group of near copies stays: the one with the smallest doc_id."""
    found = jaccard.jaccard_components(docs, rule)
    gone = found.where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents without a verified passage of a benchmark item."""
    hits = decontaminate.contaminated(docs, benchmark).select("doc_id").distinct()
    return docs.join(hits, "doc_id", "left_anti").select(docs.columns)
