"""From raw documents to packed sequences: five stages over whole tables, each written and read again.

A stage is ``function(spark, docs, sf_dir) -> DataFrame`` and works on all that the one before it
kept. All but the last return the columns of ``documents``, and further ones, whatever their names,
as they came. No stage cuts a text, and an empty table gives an empty table in all of them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluicewire.llm import mixing, packing, pii, quality, simhash
from sluicewire.llm.common import documents, named, remove, shared_folder


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject; it learns from the labels and these texts.

    Null and blank texts have no features: the thresholds alone decide. Repeated rows and equal texts
    go or stay together. Without labels nothing is rejected.
    """
    return quality.keep_good(docs, quality.fit(docs, quality.labels_table(spark, sf_dir)))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of SimHash near-duplicates: that with the least id, then text hash.

    Null and blank texts are one group. Null ids come last. Of rows equal in id and text one stays.
    """
    return simhash.keep_one(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by tags, and n_chars as the new text has them.

    Null texts stay null with their old n_chars; empty ones stay empty; repeated rows stay.
    """
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document once or more: a row for each pass of its source that takes it.

    Shares and budgets are in the ids that packing will pack. Null sources are a source; null and
    empty texts have no ids; rows equal in id and text go together, and repeated rows stay.
    Inside a partition passes follow each other, in the order of their permuted blocks, so that
    repeats of a document don't meet in a sequence.
    """
    mixed = mixing.mix(docs.select(F.struct(*map(named, docs.columns)).alias("doc"), "doc_id", "source", "text"), tokens=mixing.id_count(F.col("text")))
    return mixed.sortWithinPartitions("mix_pass", "mix_rank").select("doc.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences. Null texts count as empty; every row is packed, repeated ones too."""
    return packing.pack_table(docs)


STAGES = [
    ("quality classifier", keep_good),
    ("SimHash near-dedup", drop_near_copies),
    ("PII", redact_personal_data),
    ("mixing sources", mix_sources),
    ("packing", pack),
]

#: Neither the classifier nor the tokenizer can be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written to the shared folder, and goes when the next one is."""
    place = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = documents(spark, sf_dir)
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs.write.parquet(f"{place}/{i}")
            docs = spark.read.parquet(f"{place}/{i}")
            if i:
                remove(spark, f"{place}/{i - 1}")
    return docs
