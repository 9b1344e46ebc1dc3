"""From raw documents to packed training sequences, in five stages.

Each stage works on what its predecessor kept, written as Parquet and read again; texts go to Python workers
in batches of few MB. Toxic documents go;
of each near-duplicate class one document stays; documents that overlap with the benchmark go; personal
data is replaced; what is left is packed.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.llm import decontaminate, packing, pii, shingles, toxicity
from termloom.llm.columns import unused
from termloom.llm.queries import TOKENIZER, table
from termloom.session import small_batches, staged


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5."""
    small_batches(spark)
    model, own = toxicity.fit(docs, table(spark, sf_dir, "labels")), unused(docs, "score")
    return toxicity.score(docs, model, name=own).where(F.col(own) < 0.5).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each class of near copies (five-word shingles, similarity 0.8 or more), by SimHash fingerprints, pigeonring filtering and an exact check."""
    small_batches(spark)
    return shingles.survivors(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a stretch of a benchmark item."""
    small_batches(spark)
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def replace_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with surrogates in their texts and n_chars counted anew."""
    return pii.pseudonymise(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents and their places in sequences."""
    small_batches(spark)
    return packing.pack(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("toxicity", reject_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", decontaminated),
    ("pii", replace_pii),
    ("packing", packed),
]

#: Fingerprints, learned scores and token ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of the last stage on the documents table."""
    docs = table(spark, sf_dir, "documents")
    for n, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            docs = staged(docs, name)
    return docs
