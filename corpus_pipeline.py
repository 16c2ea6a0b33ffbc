"""From raw documents to packed training sequences, in five stages.

run() writes each stage as Parquet to the shared folder and reads it back as the next stage's
input, so that a lost executor costs no more than the stage that it worked on.

Every stage takes texts of any length and other columns of any name, and all but the last return the
columns that they got.  An empty table passes all stages and gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from evidentia.llm import exact_dedup, jaccard_join, packing, pii, quality
from evidentia.llm.common import new_path, scratch

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go.  Null and empty texts have no words and are rejected; repeated rows are judged alike."""
    return quality.keep_good(docs)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays, a null id counting as the smallest; null equals
    the empty text; of rows equal in id and text one stays."""
    return exact_dedup.keep_one(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component the document with the smallest doc_id stays, a null id counting as the smallest; of
    equal ids one row.  Documents without words link with nothing and all stay."""
    return jaccard_join.keep_smallest(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans are replaced by their kind; n_chars follows.  A null text stays null."""
    return pii.redact(docs, length_col="n_chars")


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document, with its sequence and place.  Null counts as empty: one piece, the end mark."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_duplicates),
    ("near_dedup", near_duplicates),
    ("pii", personal_data),
    ("packing", best_fit_packing),
]

#: The stages' models and tokens can't be expressed in SQL; tests/llm holds a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows.  A stage's own intermediate tables go when its result has been written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_path(spark, name)
        with scratch(spark):
            made = stage(spark, docs, sf_dir)
            made.write.parquet(path)
        docs = spark.read.schema(made.schema).parquet(path)
    return docs
