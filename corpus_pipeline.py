"""The corpus pipeline: language ID, near-duplicates, decontamination, mixing and sharding, each stage written and reread.

Every stage works on all rows that its predecessor kept. Stages but the last return the columns of documents.

Defined results: rows without an id pass every stage (they are never a copy to drop, nor reported as contaminated). Texts that
are null, empty or without a letter go in the first stage. Rows that repeat stay together through decontamination, count as
documents of their own in mixing and get slots of their own. Whole texts are read, whatever their length. An empty table
gives an empty result. Extra columns pass through; ``size``, ``text_crc32``, ``shard`` and ``slot`` are replaced by the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.llm import decontaminate, langid, mixing, shuffle_shards, simhash
from dossier.llm.common import materialize, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fits on the labelled rows of docs; rejected documents (no letters, or unlike every known language) go."""
    model = langid.fit(docs, "doc_id", "text", "lang")
    names = docs.columns
    return docs.withColumn("__lid", langid.identify(model, F.col("text"), spark)).where("NOT __lid.rejected").select(*names)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked near copies (five-word Jaccard similarity of 0.8 or more) the document with the smallest id stays."""
    return simhash.near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix to the target weights takes them, in the order of its schedule."""
    return mixing.mixed(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row, text included, with its shard and slot; written shard after shard, in the order of slots."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.withColumns({"size": (F.octet_length(text) + F.lit(1)).cast("long"), "text_crc32": F.crc32(text.cast("binary")).cast("long")})
    placed = shuffle_shards.assign(rows, "doc_id", order=["text_crc32", "size"])
    return placed.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")


STAGES = [
    ("language_id", language),
    ("simhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("source_mixing", mixture),
    ("sharding", sharding),
]

#: Language identification is a trained model; the pipeline is tested against a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
